"""Checksum trees against the full diff, united sketches against those of all rows."""

import random
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tideframe.operators import diff, difftree, publish, quality, sketches

NOW = datetime(2024, 1, 1)


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.fixture(scope="module")
def before(spark):
    return spark.range(20_000).select("id", F.md5(F.col("id").cast("string")).alias("v")).union(spark.createDataFrame([(None, "null")], "id long, v string")).cache()


class TestTree:
    def test_one_row_reads_one_range(self, spark, before):
        after = before.withColumn("v", F.when(F.col("id") == 777, "other").otherwise(F.col("v")))
        changed, ranges = difftree.rows(before, after, "id")
        assert len(ranges) == 1 and rows(changed) == rows(diff.rows(before, after)) and changed.count() == 2

    @pytest.mark.parametrize("levels,fan", [(1, 8), (2, 4), (3, 16)])
    def test_as_the_full_diff(self, spark, before, levels, fan):
        rng = random.Random(levels)
        ids = [rng.randrange(20_000) for _ in range(9)]
        after = before.filter(~F.coalesce(F.col("id").isin(ids[:4]), F.lit(False))).withColumn("v", F.when(F.col("id").isin(ids[4:]) | F.col("id").isNull(), "x").otherwise(F.col("v")))
        after = after.unionByName(spark.createDataFrame([(30_000, "new"), (-5, "new"), (ids[8], "x")], "id long, v string"))
        changed, ranges = difftree.rows(before, after, "id", levels, fan)
        assert rows(changed) == rows(diff.rows(before, after)) and difftree.NULLS in ranges

    def test_equal_and_empty(self, spark, before):
        changed, ranges = difftree.rows(before, before.repartition(3), "id")
        assert ranges == [] and changed.count() == 0
        empty = before.limit(0)
        assert difftree.rows(empty, empty, "id")[1] == []
        changed, _ = difftree.rows(empty, before.filter("id < 5"), "id")
        assert changed.count() == 5

    @pytest.mark.parametrize("kind", ["string", "date", "timestamp"])
    def test_other_keys(self, spark, kind):
        make = {"string": lambda i: f"key {i}", "date": lambda i: date(2000, 1, 1) + timedelta(days=i), "timestamp": lambda i: datetime(2000, 1, 1) + timedelta(hours=i)}[kind]
        a = spark.createDataFrame([(make(i), i) for i in range(500)], f"k {'timestamp_ntz' if kind == 'timestamp' else kind}, v int")
        b = a.withColumn("v", F.when(F.col("v") == 99, -1).otherwise(F.col("v"))).filter("v <> 400")
        changed, ranges = difftree.rows(a, b, "k")
        assert rows(changed) == rows(diff.rows(a, b)) and 1 <= len(ranges) <= 2

    def test_the_filter_reaches_the_scan(self, spark, before, tmp_path):
        before.orderBy("id").write.parquet(str(tmp_path / "a"))
        df = spark.read.parquet(str(tmp_path / "a"))
        plan = difftree.within(df, "id", 0, 5, [7, 8, 20])._jdf.queryExecution().executedPlan().toString()
        assert "GreaterThanOrEqual(id,35)" in plan and "LessThan(id,45)" in plan

    def test_stored_trees(self, spark, before, tmp_path):
        """Trees kept with versions: the next diff reads no row of what agrees."""
        at = difftree.bounds(before, before, "id")
        difftree.tree(before, "id", *at).write.parquet(str(tmp_path / "tree"))
        after = before.filter("id <> 5 or id is null")
        trees = spark.read.parquet(str(tmp_path / "tree")), difftree.tree(after, "id", *at)
        changed, ranges = difftree.rows(before, after, "id", trees=trees, at=at)
        assert [r["id"] for r in changed.collect()] == [5] and len(ranges) == 1


@pytest.fixture(scope="module")
def table(spark):
    part = F.when(F.col("id") % 10 < 9, (F.col("id") % 3).cast("string"))
    return spark.range(30_000).select(part.alias("p"), "id", (F.col("id") % 2000).alias("k"), F.when(F.col("id") % 4 > 0, F.concat(F.lit("v"), F.col("id") % 50)).alias("s"), F.lit(None).cast("string").alias("n"), (F.col("id") / 7).alias("x")).cache()


class TestSketches:
    def test_union_is_the_whole(self, spark, table):
        united = {r["column_name"]: r for r in sketches.report(sketches.parts(table, "p")).collect()}
        whole = {r["column_name"]: r for r in sketches.report(sketches.parts(table.withColumn("p", F.lit("all")), "p")).collect()}
        exact = {r["column_name"]: r for r in quality.profile_table(table.drop("p"), approximate=False).collect()}
        assert set(united) == set(exact) == {"id", "k", "s", "n", "x"}
        for c, e in exact.items():
            for r in (united[c], whole[c]):
                assert (r["row_count"], r["null_percent"]) == (e["row_count"], e["null_percent"])
                assert abs(r["distinct_count"] - e["distinct_count"]) <= 0.05 * e["distinct_count"]
                assert r["mean"] is None and e["mean"] is None or r["mean"] == pytest.approx(e["mean"], abs=1e-3)
        assert (united["s"]["least"], united["s"]["greatest"], united["k"]["greatest"]) == ("v0", "v9", "1999") and united["n"]["least"] is None and united["n"]["distinct_count"] == 0
        for q, want in zip(united["id"]["quantiles"], sketches.QUANTILES, strict=True):
            assert abs(q / 30_000 - want) < 0.02
        assert united["s"]["quantiles"] is None

    def test_only_new_parts_are_profiled(self, spark, table, tmp_path):
        root = str(tmp_path / "store")
        assert sketches.refresh(table.filter("p = '0'"), root, "p", NOW) == ["0"]
        assert sketches.refresh(table, root, "p", NOW) == [None, "1", "2"] and sketches.refresh(table, root, "p", NOW) == []
        assert publish.read_log(spark, root).last == 2
        got = {r["column_name"]: r["row_count"] for r in sketches.report(sketches.stored(spark, root)).collect()}
        assert got == dict.fromkeys(("id", "k", "s", "n", "x"), 30_000)
        assert sketches.refresh(table.filter("p <> '1' or id < 100"), root, "p", NOW, again=["1"]) == ["1"]
        after = {r["column_name"]: r["row_count"] for r in sketches.report(sketches.stored(spark, root)).collect()}
        assert after["id"] == table.filter("p is null or p <> '1' or id < 100").count()

    def test_history_of_parts(self, spark):
        days = spark.range(600).select(F.format_string("day %02d", F.floor(F.col("id") / 20)).alias("day"), F.col("id").alias("v"))
        odd = days.union(spark.range(900).select(F.lit("day 30").alias("day"), F.col("id").alias("v")))
        odd = odd.filter("not (day = 'day 05' and v % 20 = 0)")
        found = quality.anomalies(sketches.history(sketches.parts(odd, "day")), threshold=3)
        assert ("v", "row_count", "day 30") in {(r["model"], r["metric"], r["profiled_at"]) for r in found.collect()}
