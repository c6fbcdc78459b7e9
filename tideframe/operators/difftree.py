"""Differences of large tables by a tree of checksums over key ranges.

A table's keys are cut into ranges, and each range gets the checksum of its rows;
ranges add up to wider ones, up to the whole table. Two such trees are compared
from the top: only below nodes that differ does anything have to be looked at, and
only rows of the lowest ranges that differ are read and compared.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ByteType, DateType, IntegerType, LongType, ShortType, StructType

from tideframe.operators import diff
from tideframe.operators.keys import row_hash

#: Levels below the root, and children of a node: the lowest level has FAN ** LEVELS ranges.
LEVELS, FAN = 3, 16
NULLS = -1


def _number(key: Column, kind) -> Column:
    """Whole numbers and dates as they are, everything else as a hash without order."""
    if isinstance(kind, (ByteType, ShortType, IntegerType, LongType)):
        return key.cast("long")
    if isinstance(kind, DateType):
        return F.unix_date(key).cast("long")
    return F.pmod(F.xxhash64(key), F.lit(1 << 40))


def ordered(schema: StructType, key: str) -> bool:
    """Whether ranges of the key are ranges of values, which reach the scan as filters."""
    return isinstance(schema[key].dataType, (ByteType, ShortType, IntegerType, LongType, DateType))


def bounds(before: DataFrame, after: DataFrame, key: str, levels: int = LEVELS, fan: int = FAN) -> tuple[int, int]:
    """(least number, width of a lowest range) that two states share."""
    both = [df.select(_number(F.col(f"`{key}`"), df.schema[key].dataType).alias("n")) for df in (before, after)]
    lo, hi = both[0].unionByName(both[1]).agg(F.min("n"), F.max("n")).first()
    return (0, 1) if lo is None else (lo, (hi - lo) // fan**levels + 1)


def _leaf(df: DataFrame, key: str, lo: int, width: int, ranges: int) -> Column:
    """The lowest range of a row; NULLS for null keys, and keys beyond the bounds in the outermost ranges."""
    n = F.floor((_number(F.col(f"`{key}`"), df.schema[key].dataType) - lo) / width)
    return F.when(n.isNull(), F.lit(NULLS)).otherwise(F.greatest(F.lit(0), F.least(n, F.lit(ranges - 1)))).cast("long")


def tree(df: DataFrame, key: str, lo: int, width: int, columns: list[str] | None = None, levels: int = LEVELS, fan: int = FAN) -> DataFrame:
    """level, node, rows, hash_sum, hash_xor of every node with rows, the root's level being 0: one aggregate with map-side combine, and sums of its few rows.

    ``columns`` are those that count, all if not given. A tree is small and can
    be stored with a version of its table.
    """
    h = F.conv(F.left(row_hash(columns or df.columns), F.lit(15)), 16, 10).cast("long")
    leaves = df.select(_leaf(df, key, lo, width, fan**levels).alias("node"), h.alias("h")).groupBy("node").agg(F.count("*").alias("rows"), F.sum(F.col("h").cast("decimal(38,0)")).alias("hash_sum"), F.bit_xor("h").alias("hash_xor"))
    levels_ = F.explode(F.sequence(F.lit(0), F.lit(levels))).alias("level")
    above = leaves.select(levels_, "*").withColumn("node", F.when(F.col("node") == NULLS, F.when(F.col("level") == 0, F.lit(0)).otherwise(F.lit(NULLS))).otherwise(F.floor(F.col("node") / F.pow(F.lit(float(fan)), F.lit(levels) - F.col("level")))).cast("long"))
    return above.groupBy("level", "node").agg(F.sum("rows").alias("rows"), F.sum("hash_sum").cast("decimal(38,0)").alias("hash_sum"), F.bit_xor("hash_xor").alias("hash_xor"))


def differing(a: DataFrame, b: DataFrame, levels: int = LEVELS, fan: int = FAN) -> list[int]:
    """The lowest ranges in which two trees differ, from the root down; below nodes that agree nothing is compared."""
    wrong = [0]
    for level in range(levels + 1):
        own = [t.filter(F.col("level") == level) for t in (a, b)]
        if level:
            under = F.floor(F.col("node") / fan).isin(wrong) | (F.col("node") == NULLS)
            own = [t.filter(under) for t in own]
        j = own[0].alias("a").join(own[1].alias("b"), F.col("a.node") == F.col("b.node"), "full")
        same = reduce(lambda x, y: x & y, (F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in ("rows", "hash_sum", "hash_xor")))
        wrong = [r[0] for r in j.filter(~same).select(F.coalesce("a.node", "b.node")).collect()]
        if not wrong:
            return []
    return sorted(wrong)


def within(df: DataFrame, key: str, lo: int, width: int, nodes: list[int], levels: int = LEVELS, fan: int = FAN) -> DataFrame:
    """The rows of some lowest ranges; neighbouring ones are one filter, which reaches the scan where keys are ordered."""
    if not nodes:
        return df.filter(F.lit(False))
    ranges, spans = fan**levels, []
    for n in sorted(set(nodes) - {NULLS}):
        if spans and spans[-1][1] == n:
            spans[-1][1] = n + 1
        else:
            spans.append([n, n + 1])
    k = F.col(f"`{key}`")
    conditions = [k.isNull()] if NULLS in nodes else []
    if ordered(df.schema, key):
        kind = df.schema[key].dataType
        literal = (lambda v: F.date_from_unix_date(F.lit(v))) if isinstance(kind, DateType) else (lambda v: F.lit(v))
        for first, last in spans:
            low = F.lit(True) if first == 0 else k >= literal(lo + first * width)
            high = F.lit(True) if last >= ranges else k < literal(lo + last * width)
            conditions.append(k.isNotNull() & low & high)
    elif spans:
        leaf = _leaf(df, key, lo, width, ranges)
        conditions += [(leaf >= first) & (leaf < last) for first, last in spans]
    return df.filter(reduce(lambda x, y: x | y, conditions))


def rows(before: DataFrame, after: DataFrame, key: str, levels: int = LEVELS, fan: int = FAN, trees: tuple[DataFrame, DataFrame] | None = None, at: tuple[int, int] | None = None) -> tuple[DataFrame, list[int]]:
    """(``diff.rows`` of two states, the lowest ranges that were read for it).

    ``trees`` are those of both states over ``diff.common_columns``, with the
    bounds ``at``; they are made if not given.
    """
    names = diff.common_columns(before, after)
    a, b = before.select(*(F.col(f"`{c}`") for c in names)), after.select(*(F.col(f"`{c}`") for c in names))
    lo, width = at or bounds(a, b, key, levels, fan)
    x, y = trees or tuple(tree(df, key, lo, width, names, levels, fan) for df in (a, b))
    nodes = differing(x, y, levels, fan)
    return diff.rows(within(a, key, lo, width, nodes, levels, fan), within(b, key, lo, width, nodes, levels, fan)), nodes


def equal(a: DataFrame, b: DataFrame) -> bool:
    """Whether two trees agree, by their roots alone."""
    top = [t.filter("level = 0").select("rows", "hash_sum", "hash_xor").collect() for t in (a, b)]
    return top[0] == top[1]

