"""Windows over keys of any number of rows: each key's rows are cut by ranges of their order, and what lies before a part is added to it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideframe.sources.files import settled

_PART, _APART = "__part", "__apart"


def _dealt(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The rows, by ranges of key and order, with the number of their range; a table, as ranges are found by sampling. Equal rows are told apart."""
    columns = [*(F.col(f"`{c}`") for c in [*keys, *order]), F.col(_APART)]
    return settled(df.withColumn(_APART, F.monotonically_increasing_id()).repartitionByRange(*columns).withColumn(_PART, F.spark_partition_id()))


def _own(keys: list[str], order: list[str]):
    return Window.partitionBy(*(F.col(f"`{k}`") for k in keys), _PART).orderBy(*(F.col(f"`{c}`") for c in order), _APART)


def _with_before(rows: DataFrame, keys: list[str], sums: DataFrame, before: Column) -> DataFrame:
    """``rows`` with ``__before``, what the earlier parts of their key come to, from a row of ``sums`` for each key and part.

    Only the first key of a part can have begun before it, so there is a row a
    part at most to look up, which is broadcast.
    """
    earlier = sums.select(*(F.col(f"`{k}`").alias(f"__k{i}") for i, k in enumerate(keys)), F.col(_PART).alias("__p"), before.alias("__before")).filter("__before is not null")
    match = reduce(lambda a, b: a & b, (rows[k].eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(keys)), rows[_PART] == F.col("__p"))
    return rows.join(F.broadcast(earlier), match, "left")


def running_sum(df: DataFrame, keys: list[str], order: list[str], value: str, name: str = "running") -> DataFrame:
    """``df`` with the sum of ``value`` over the rows of a key up to each, in ``order``; nulls add nothing, and are null until there is a value."""
    rows = _dealt(df, keys, order)
    v = F.col(f"`{value}`")
    sums = rows.groupBy(*(F.col(f"`{k}`") for k in keys), _PART).agg(F.sum(v).alias("__sum"))
    ahead = Window.partitionBy(*(F.col(f"`{k}`") for k in keys)).orderBy(_PART).rowsBetween(Window.unboundedPreceding, -1)
    own = rows.withColumn("__own", F.sum(v).over(_own(keys, order).rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    out = _with_before(own, keys, sums, F.sum("__sum").over(ahead))
    total = F.when(F.col("__own").isNotNull() | F.col("__before").isNotNull(), F.coalesce("__own", F.lit(0)) + F.coalesce("__before", F.lit(0)))
    return out.select(*(F.col(f"`{c}`") for c in df.columns), total.alias(name))


def previous(df: DataFrame, keys: list[str], order: list[str], value: str, name: str = "previous") -> DataFrame:
    """``df`` with the ``value`` of the row before each of its key, in ``order``; null for the first."""
    rows = _dealt(df, keys, order)
    last = F.max_by(F.struct(F.col(f"`{value}`").alias("v")), F.struct(*(F.struct(F.col(f"`{c}`").isNotNull(), F.col(f"`{c}`")) for c in order), F.col(_APART)))
    sums = rows.groupBy(*(F.col(f"`{k}`") for k in keys), _PART).agg(last.alias("__last"))
    ahead = Window.partitionBy(*(F.col(f"`{k}`") for k in keys)).orderBy(_PART)
    window = _own(keys, order)
    own = rows.withColumn("__own", F.lag(F.col(f"`{value}`")).over(window)).withColumn("__first", F.row_number().over(window) == 1)
    out = _with_before(own, keys, sums, F.lag("__last").over(ahead))
    return out.select(*(F.col(f"`{c}`") for c in df.columns), F.when(F.col("__first"), F.col("__before.v")).otherwise(F.col("__own")).alias(name))
