"""Comparing two states of a table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideframe.operators.keys import row_hash
from tideframe.operators.schema import diff as schema_diff


def common_columns(before: DataFrame, after: DataFrame) -> list[str]:
    names = {c.lower() for c in after.columns}
    return [c for c in before.columns if c.lower() in names]


def changes_of_schema(before: DataFrame, after: DataFrame) -> DataFrame:
    """(column_name, change, old_type, new_type, filled): added, removed, type_changed.

    ``filled`` counts the values that are not null in the state that has the
    column, the later one if both have; an aggregate over each state.
    """
    d = schema_diff(before.schema, after.schema)
    rows = [(f.name, "added", None, f.dataType.simpleString()) for f in d.added]
    rows += [(f.name, "removed", f.dataType.simpleString(), None) for f in d.removed]
    rows += [(a.name, "type_changed", a.dataType.simpleString(), b.dataType.simpleString()) for a, b in d.retyped]
    gone = [f.name for f in d.removed]
    here = [f.name for f in d.added] + [b.name for _, b in d.retyped]
    filled = {}
    for df, names in ((before, gone), (after, here)):
        if names:
            filled |= df.agg(*(F.count(f"`{c}`").alias(c) for c in names)).first().asDict()
    last = {a.name: b.name for a, b in d.retyped}
    rows = [(*r, filled[last.get(r[0], r[0])]) for r in rows]
    return before.sparkSession.createDataFrame(rows, "column_name string, change string, old_type string, new_type string, filled long")


def rows(before: DataFrame, after: DataFrame) -> DataFrame:
    """Rows of either side whose hash over the common columns the other lacks, with ``side`` (added, removed); duplicates are not netted."""
    names = common_columns(before, after)
    a, b = (x.select(*names).withColumn("__h", row_hash(names)) for x in (before, after))
    only = lambda x, y, side: x.join(y.select("__h").distinct(), "__h", "left_anti").drop("__h").withColumn("side", F.lit(side))
    return only(b, a, "added").unionByName(only(a, b, "removed"))


def modified(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """Keys on both sides (plain equality, so null keys never match) with any other common column different, nulls counting."""
    others = [c for c in common_columns(before, after) if c not in keys]
    joined = before.alias("a").join(after.alias("b"), [F.col(f"a.{k}") == F.col(f"b.{k}") for k in keys])
    differs = reduce(lambda x, y: x | y, (~F.col(f"a.`{c}`").eqNullSafe(F.col(f"b.`{c}`")) for c in others), F.lit(False))
    return joined.filter(differs).select(*(F.col(f"a.{k}").alias(k) for k in keys))


def summary(before: DataFrame, after: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """One row: rows before and after, added, removed, modified; what is modified is in neither of the others."""
    counts = rows(before, after).agg(F.count_if(F.col("side") == "added").alias("added"), F.count_if(F.col("side") == "removed").alias("removed"))
    # three single rows
    out = before.agg(F.count("*").alias("before")).crossJoin(after.agg(F.count("*").alias("after"))).crossJoin(counts)
    n = modified(before, after, keys).agg(F.count("*").alias("modified")) if keys else before.sparkSession.range(1).select(F.lit(0).cast("long").alias("modified"))
    out = out.crossJoin(n)
    less = lambda c: F.greatest(F.col(c) - F.col("modified"), F.lit(0)).alias(c)
    return out.select("before", "after", less("added"), less("removed"), "modified")


def except_counts(before: DataFrame, after: DataFrame) -> DataFrame:
    """One row: row counts, and distinct rows that only one side has, over the columns equal in name and type."""
    names = [f.name for f in before.schema if any(f.name.lower() == g.name.lower() and f.dataType == g.dataType for g in after.schema)]
    a, b = before.select(*names), after.select(*names)
    one = lambda df, name: df.agg(F.count("*").alias(name))
    return one(before, "before").crossJoin(one(after, "after")).crossJoin(one(a.subtract(b), "only_before")).crossJoin(one(b.subtract(a), "only_after"))


def branches(base: dict[str, DataFrame], other: dict[str, DataFrame], built: set[str] | None = None) -> dict[str, str]:
    """For each table: added, removed, changed, unchanged, or not_built on the branch."""
    out = {}
    for name in sorted(set(base) | set(other)):
        if name not in base:
            out[name] = "added"
        elif name not in other:
            out[name] = "removed" if built is None or name in built else "not_built"
        else:
            r = except_counts(base[name], other[name]).first()
            same = base[name].dtypes == other[name].dtypes and r["before"] == r["after"] and not r["only_before"] and not r["only_after"]
            out[name] = "unchanged" if same and base[name].exceptAll(other[name]).isEmpty() else "changed"
    return out


def unit_compare(expected: DataFrame, actual: DataFrame, order: str | None = None) -> DataFrame:
    """Rows that differ, with ``side`` (missing, unexpected): as multisets, or place by place when ``order`` names a column on both sides."""
    names = expected.columns
    actual = actual.select(*names)
    if order is None:
        return expected.exceptAll(actual).withColumn("side", F.lit("missing")).unionByName(actual.exceptAll(expected).withColumn("side", F.lit("unexpected")))
    j = expected.alias("e").join(actual.alias("a"), F.col(f"e.{order}").eqNullSafe(F.col(f"a.{order}")), "full")
    differs = reduce(lambda x, y: x | y, (~F.col(f"e.`{c}`").eqNullSafe(F.col(f"a.`{c}`")) for c in names))
    sides = F.array(F.struct(*(F.col(f"e.`{c}`").alias(c) for c in names), F.lit("missing").alias("side")), F.struct(*(F.col(f"a.`{c}`").alias(c) for c in names), F.lit("unexpected").alias("side")))
    return j.filter(differs).select(F.explode(sides).alias("r")).select("r.*").filter(F.col(order).isNotNull())
