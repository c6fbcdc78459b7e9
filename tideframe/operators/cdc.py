"""Change data capture: normalising change records and applying them to a target."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideframe.operators.keys import comparable

SEQ, DELETED = "_seq", "_deleted"


def is_delete(op: Column) -> Column:
    """Whether the operation's first non-blank letter is D; a null operation is an upsert."""
    return F.coalesce(F.upper(F.left(F.trim(op), F.lit(1))) == "D", F.lit(False))


def lsn_number(lsn: Column) -> Column:
    """A ``hi/lo`` pair of hexadecimal numbers as one."""
    part = lambda i: F.conv(F.split_part(lsn, F.lit("/"), F.lit(i)), 16, 10).cast("long")
    return F.shiftleft(part(1), 32) + part(2)


def normalize(changes: DataFrame) -> DataFrame:
    """(op I/U/D, lsn, payload) from records (op, lsn, before, after): a delete has the image before it, others the one after; unknown operations go."""
    # Names of operations in change feeds.
    names = {"c": "I", "r": "I", "i": "I", "insert": "I", "create": "I", "read": "I", "u": "U", "update": "U", "d": "D", "delete": "D"}
    kinds = F.create_map(*(F.lit(x) for kv in names.items() for x in kv))
    known = changes.withColumn("op", F.try_element_at(kinds, F.lower(F.trim("op")))).filter("op is not null")
    return known.select("op", lsn_number(F.col("lsn")).alias("lsn"), F.when(F.col("op") == "D", F.col("before")).otherwise(F.col("after")).alias("payload"))


def dedupe(changes: DataFrame, keys: list[str], seq: str, op: str, values: list[str] | None = None) -> DataFrame:
    """The last change of each key: highest sequence, null sequences last, a delete on ties, of those left the one of the greatest ``values`` (all columns).

    ``max_by`` combines on the map side, so a key with very many changes is no
    hot partition.
    """
    rows = F.struct(*changes.columns)
    ties = comparable(changes.schema, changes.columns if values is None else [c for c in values if c in changes.columns])
    best = F.max_by(rows, F.struct(F.col(seq).isNotNull(), F.col(seq), is_delete(F.col(op)).cast("int"), *(F.col(f"`{c}`") for c in ties)))
    return changes.groupBy(*(F.col(k).alias(f"__k{i}") for i, k in enumerate(keys))).agg(best.alias("r")).select("r.*")


def _newer(held: DataFrame) -> Column:
    """Whether the change ``c`` replaces the row ``t`` of ``held``: the rule of ``dedupe``, so that how changes are dealt to batches does not matter; an equal one does not."""
    ties = [DELETED, *(c for c in comparable(held.schema, held.columns) if c not in (SEQ, DELETED))]
    place = lambda side: F.struct(*(F.col(f"{side}.`{c}`").try_cast(held.schema[c].dataType).alias(c) for c in ties))
    tied = (F.col(f"c.{SEQ}") == F.col(f"t.{SEQ}")) & (place("c") > place("t"))
    return F.col("c.__in") & (F.col(f"t.{SEQ}").isNull() | F.col(f"c.{SEQ}").isNull() | (F.col(f"c.{SEQ}") > F.col(f"t.{SEQ}")) | tied)


def evolved(target: DataFrame, changes: DataFrame, ignore: list[str], schema: str) -> DataFrame:
    """The target with what ``schema`` makes of columns of the changes that it lacks: append (as null), ignore, or fail."""
    known = {c.lower() for c in [*target.columns, *ignore]}
    new = [f for f in changes.schema.fields if f.name.lower() not in known]
    if schema not in ("append", "ignore", "fail"):
        raise ValueError(f"unknown schema policy {schema}")
    if new and schema == "fail":
        raise ValueError(f"the target has no column {', '.join(f.name for f in new)}")
    return target.withColumns({f.name: F.lit(None).cast(f.dataType) for f in new}) if schema == "append" and new else target


def apply_changes(held: DataFrame, changes: DataFrame, keys: list[str], seq: str, op: str) -> DataFrame:
    """Target and tombstones in one: rows with ``_seq`` and ``_deleted``, after one aggregate of the changes and one full join.

    A change newer than the row held of its key replaces it, as does one of the
    same sequence that ``dedupe`` would take; a delete leaves the keys, ``_seq``
    and ``_deleted`` alone.
    """
    last = dedupe(changes, keys, seq, op, held.columns).withColumn(SEQ, F.col(seq)).withColumn(DELETED, is_delete(F.col(op)))
    own = [F.col(f"`{c}`") if c in [*keys, SEQ, DELETED] else F.when(~F.col(DELETED), F.col(f"`{c}`")).alias(c) if c in last.columns else F.lit(None).cast(held.schema[c].dataType).alias(c) for c in held.columns]
    joined = held.alias("t").join(last.select(*own, F.lit(True).alias("__in")).alias("c"), [F.col(f"t.{k}").eqNullSafe(F.col(f"c.{k}")) for k in keys], "full")
    newer = _newer(held)
    return joined.select(*(F.when(newer, F.col(f"c.`{c}`")).otherwise(F.col(f"t.`{c}`")).alias(c) for c in held.columns))


def apply_hard(target: DataFrame, tombstones: DataFrame, changes: DataFrame, keys: list[str], seq: str, op: str, schema: str = "append") -> tuple[DataFrame, DataFrame]:
    """(new target, new tombstones). The target holds the columns of ``changes`` without the operation, its sequence as ``_seq``.

    Changes not newer than what the target or a tombstone has of the key are
    dropped (of equal sequences a delete is the newer one), so replays and late events change nothing. A delete removes the row
    and leaves (keys, _seq); a newer insert takes that away again. ``schema``
    says what becomes of columns that the target lacks, see ``evolved``.
    """
    target = evolved(target, changes, [seq, op], schema)
    held = target.withColumn(DELETED, F.lit(False)).unionByName(tombstones.select(*keys, SEQ).withColumn(DELETED, F.lit(True)), allowMissingColumns=True)
    both = apply_changes(held, changes, keys, seq, op)
    return both.filter(f"not {DELETED}").select(*target.columns), both.filter(DELETED).select(*keys, SEQ)



def apply_soft(target: DataFrame, changes: DataFrame, keys: list[str], seq: str, op: str, schema: str = "append") -> DataFrame:
    """The new target: a newer change replaces its key's row; a delete stays as its last image with ``_deleted`` true."""
    target = evolved(target, changes, [seq, op], schema)
    last = dedupe(changes, keys, seq, op, target.columns).withColumn(SEQ, F.col(seq)).withColumn(DELETED, is_delete(F.col(op)))
    joined = target.alias("t").join(last.select(*target.columns).withColumn("__in", F.lit(True)).alias("c"), [F.col(f"t.{k}").eqNullSafe(F.col(f"c.{k}")) for k in keys], "full")
    newer = _newer(target)
    return joined.select(*(F.when(newer, F.col(f"c.`{c}`")).otherwise(F.col(f"t.`{c}`")).alias(c) for c in target.columns))
