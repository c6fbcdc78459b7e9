"""Windows over cut keys against Spark's own."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tideframe.operators import running


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.fixture(scope="module")
def table(spark):
    hot = spark.range(3000).select(F.lit("hot").alias("k"), (F.col("id") % 1500).alias("t"), F.when(F.col("id") % 7 > 0, F.col("id")).alias("v"), "id")
    rest = spark.range(400).select(F.when(F.col("id") % 5 > 0, F.concat(F.lit("k"), F.col("id") % 40)).alias("k"), F.when(F.col("id") % 9 > 0, F.col("id")).alias("t"), (-F.col("id")).alias("v"), (F.col("id") + 10_000).alias("id"))
    nothing = spark.createDataFrame([("none", i, None, 20_000 + i) for i in range(5)], "k string, t long, v long, id long")
    return hot.unionByName(rest).unionByName(nothing).repartition(6).cache()


def test_running_sum(spark, table):
    w = Window.partitionBy("k").orderBy("t", "id").rowsBetween(Window.unboundedPreceding, 0)
    assert rows(running.running_sum(table, ["k"], ["t", "id"], "v")) == rows(table.withColumn("running", F.sum("v").over(w)))


def test_previous(spark, table):
    w = Window.partitionBy("k").orderBy("t", "id")
    assert rows(running.previous(table, ["k"], ["t", "id"], "v")) == rows(table.withColumn("previous", F.lag("v").over(w)))


def test_equal_rows_and_none(spark):
    same = spark.range(1000).select(F.lit(1).alias("k"), F.lit(1).alias("t"), F.lit(2).alias("v"))
    assert sorted(r["running"] for r in running.running_sum(same, ["k"], ["t"], "v").collect()) == list(range(2, 2001, 2))
    assert [r["previous"] for r in running.previous(same, ["k"], ["t"], "v").collect()].count(None) == 1
    assert running.previous(same.limit(0), ["k"], ["t"], "v").count() == 0
