"""Slowly changing history (type 2) from full snapshots of a source."""

from __future__ import annotations

from datetime import datetime
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideframe.operators.keys import require_unique, row_hash

META = ["valid_from", "valid_to", "is_current", "row_hash"]


def apply(
    history: DataFrame | None,
    staging: DataFrame,
    keys: list[str],
    now: datetime,
    strategy: str = "check",
    check_cols: list[str] | None = None,
    updated_at: str | None = None,
    hard_deletes: str = "ignore",
    guard: bool = True,
) -> DataFrame:
    """The history after one snapshot.

    A row is new when its key has no current version, changed when the MD5 of
    its tracked columns differs (``check``) or its ``updated_at`` is after the
    version's ``valid_from`` (``timestamp``). Changed versions are closed at the
    new one's start. Keys gone from the snapshot are left (``ignore``), closed
    (``invalidate``), or closed with a tombstone row (``new_record``, column
    is_deleted); a key that returns opens a new version. Null keys match
    themselves; duplicate keys and null ``updated_at`` are refused. Columns that
    are new in staging are null in the past. An equal snapshot changes nothing.
    """
    tracked = check_cols or [c for c in staging.columns if c not in keys]
    if guard:
        require_unique(staging, keys)
        if strategy == "timestamp" and staging.filter(F.col(updated_at).isNull()).limit(1).count():
            raise ValueError(f"{updated_at} has nulls")
    tombs = hard_deletes == "new_record"
    clock = F.lit(now).cast("timestamp_ntz")
    stamp = F.col(updated_at).cast("timestamp_ntz") if strategy == "timestamp" else clock
    fresh = staging.select("*", stamp.alias("valid_from"), F.lit(None).cast("timestamp_ntz").alias("valid_to"), F.lit(True).alias("is_current"), row_hash(tracked).alias("row_hash"))
    if tombs:
        fresh = fresh.withColumn("is_deleted", F.lit(False))
    if history is None:
        return fresh
    if history.columns and set(c for c in history.columns if c not in [*META, "is_deleted"]) - set(staging.columns):
        raise ValueError("columns were removed from the snapshot: " + ", ".join(sorted(set(history.columns) - set(staging.columns) - {*META, "is_deleted"})))
    if tombs:
        history = history.withColumn("is_deleted", F.coalesce(F.col("is_deleted"), F.lit(False))) if "is_deleted" in history.columns else history.withColumn("is_deleted", F.lit(False))
    elif "is_deleted" in history.columns:
        fresh = fresh.withColumn("is_deleted", F.lit(False))
    # new columns of the source are null in the versions there are
    for f in fresh.schema:
        if f.name not in history.columns:
            history = history.withColumn(f.name, F.lit(None).cast(f.dataType))
    history = history.select(*fresh.columns)
    closed, current = history.filter("not is_current"), history.filter("is_current")
    tracks_deletes = "is_deleted" in fresh.columns
    # each side joins what decides about it: a version there is becomes one row, whatever happens to it
    seen = fresh.select(*(F.col(f"`{k}`").alias(f"__k{i}") for i, k in enumerate(keys)), F.col("valid_from").alias("__from"), F.col("row_hash").alias("__hash"), F.lit(True).alias("__in"))
    matches = lambda left: reduce(lambda x, y: x & y, (left[k].eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(keys)))
    held = current.join(seen, matches(current), "left")
    dead = F.col("is_deleted") if tracks_deletes else F.lit(False)
    differs = F.col("__from") > F.col("valid_from") if strategy == "timestamp" else ~F.col("__hash").eqNullSafe(F.col("row_hash"))
    changed = F.col("__in").isNotNull() & (differs | dead)
    vanished = F.col("__in").isNull() & ~dead & F.lit(hard_deletes != "ignore")
    ends = {"valid_to": F.when(changed, F.col("__from")).when(vanished, clock).otherwise(F.col("valid_to")), "is_current": F.col("is_current") & ~(changed | vanished)}
    out = closed.unionByName(held.select(*(ends[c].alias(c) if c in ends else F.col(f"`{c}`") for c in fresh.columns)))
    known = current.select(
        *(F.col(f"`{k}`").alias(f"__k{i}") for i, k in enumerate(keys)), F.col("valid_from").alias("__from"), F.col("row_hash").alias("__hash"), (F.col("is_deleted") if tracks_deletes else F.lit(False)).alias("__dead"), F.lit(True).alias("__in")
    )
    newer = F.col("valid_from") > F.col("__from") if strategy == "timestamp" else ~F.col("row_hash").eqNullSafe(F.col("__hash"))
    out = out.unionByName(fresh.join(known, matches(fresh), "left").filter(F.col("__in").isNull() | newer | F.col("__dead")).select(*fresh.columns))
    if tombs:
        gone = held.filter(vanished).select(*(clock.alias(c) if c == "valid_from" else F.lit(True).alias(c) if c == "is_deleted" else F.col(f"`{c}`") for c in fresh.columns))
        out = out.unionByName(gone)
    return out


def as_of(history: DataFrame, moment: datetime | str) -> DataFrame:
    """Versions valid at an instant: begun by then and not closed by then."""
    t = F.lit(moment).cast("timestamp_ntz")
    return history.filter((F.col("valid_from") <= t) & (F.col("valid_to").isNull() | (F.col("valid_to") > t)))
