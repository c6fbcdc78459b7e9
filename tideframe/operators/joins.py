"""Joins that Spark has no single call for."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def null_safe(left: str, right: str, keys: list[str]) -> Column:
    """All keys equal, nulls matching nulls; a hash join in Spark."""
    return reduce(lambda a, b: a & b, (F.col(f"{left}.{k}").eqNullSafe(F.col(f"{right}.{k}")) for k in keys))


def _bucket(column: Column, kind: str, width: float) -> Column:
    seconds = F.unix_micros(column.cast("timestamp")) / 1e6 if kind.startswith(("timestamp", "date")) else column.cast("double")
    return F.floor(seconds / width)


def asof(left: DataFrame, right: DataFrame, on: list[str], left_time: str, right_time: str, values: list[str], width: float | None = None) -> DataFrame:
    """Rows of ``left`` with the ``values`` of the latest row of ``right`` of equal ``on``, not after it.

    Both sides are laid in one time order by key and the last right row is
    carried forward: one shuffle and one sort, no pairs. Of right rows at one
    instant the one with the largest values is taken; left rows without an
    earlier right row get nulls. With ``width`` (seconds, or units of a numeric
    time) a key's rows are parted into ranges of time of that width, so a key
    with very many rows is many tasks; each range gets the last right row of
    those before it from an aggregate of a row for each range.
    """
    values_of = F.struct(*values)
    if width is not None:
        kinds = {n: df.schema[n].dataType.simpleString() for df, n in ((left, left_time), (right, right_time))}
        cut = lambda df, name: df.withColumn("__range", _bucket(F.col(name), kinds[name], width))
        left, right = cut(left, left_time), cut(right, right_time)
        best = F.max(F.struct(F.col(right_time).alias("t"), values_of.alias("v")))
        last = right.filter(F.col(right_time).isNotNull()).groupBy(*on, "__range").agg(best.alias("__best")).unionByName(left.select(*on, "__range").distinct(), allowMissingColumns=True)
        last = last.groupBy(*on, "__range").agg(F.first("__best", ignorenulls=True).alias("__best"))
        before = Window.partitionBy(*on).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
        carried = last.withColumn("__before", F.last("__best", ignorenulls=True).over(before)).filter("__before is not null").select(*on, "__range", F.col("__before.t").alias(right_time), *(F.col("__before.v")[v].alias(f"__v_{v}") for v in values))
        # the carried row opens its range; it has the values and a time before all others there
        names = [c for c in [*on, "__range", right_time, *values]]
        names = list(dict.fromkeys(names))
        opening = carried.select(*(F.col(f"__v_{c}").alias(c) if c in values else F.col(c) for c in names))
        found = asof(left, right.select(*names).unionByName(opening), [*on, "__range"], left_time, right_time, values)
        return found.drop("__range")
    one = left.select(*on, F.col(left_time).alias("__t"), F.lit(1).alias("__side"), F.struct(*left.columns).alias("__left"), F.lit(None).cast(right.select(values_of.alias("v")).schema["v"].dataType).alias("__right"))
    two = right.select(*on, F.col(right_time).alias("__t"), F.lit(0).alias("__side"), F.lit(None).cast(one.schema["__left"].dataType).alias("__left"), values_of.alias("__right"))
    order = Window.partitionBy(*on).orderBy("__t", "__side", F.col("__right").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    carried = one.union(two).withColumn("__right", F.last("__right", ignorenulls=True).over(order))
    return carried.filter("__side = 1").select("__left.*", *(F.col("__right")[v].alias(v) for v in values))


def fanout(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """One row: rows of either side, of their join, and the join over the larger side, without joining the rows."""
    a = left.groupBy(*keys).agg(F.count("*").alias("n"))
    b = right.groupBy(*keys).agg(F.count("*").alias("m"))
    joined = a.join(b, keys, "full").agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("left_rows"), F.coalesce(F.sum("m"), F.lit(0)).alias("right_rows"), F.coalesce(F.sum(F.col("n") * F.col("m")), F.lit(0)).alias("joined_rows")
    )
    return joined.withColumn("ratio", F.col("joined_rows") / F.greatest("left_rows", "right_rows", F.lit(1)))


def star(left: DataFrame, right: DataFrame, condition: Column, how: str = "inner") -> DataFrame:
    """SELECT * of a join: every column of both sides; a name the left has too gets the suffix ``_1``."""
    joined = left.alias("l").join(right.alias("r"), condition, how)
    taken = {c.lower() for c in left.columns}
    return joined.select(*(F.col(f"l.`{c}`") for c in left.columns), *(F.col(f"r.`{c}`").alias(f"{c}_1" if c.lower() in taken else c) for c in right.columns))
