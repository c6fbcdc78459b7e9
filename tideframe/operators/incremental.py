"""Incremental loads as pure functions (target, staging) -> new target.

Nothing is written here: the result is published as a new version, or, where
the strategy replaces whole partitions, by dynamic partition overwrite, so a
failed job leaves the old target as it was.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideframe.operators.keys import require_unique, same_key
from tideframe.operators.schema import evolve


def watermark(target: DataFrame, column: str):
    """Largest value of the column; None for an empty target. One aggregate, one value to the driver."""
    return target.agg(F.max(column)).first()[0]


def new_rows(staging: DataFrame, target: DataFrame | None, column: str, keyed: bool) -> DataFrame:
    """Rows of staging at or above the target's watermark (``keyed``), or above it (append).

    The watermark is a literal, so the filter reaches the scan. An empty or
    missing target takes all.
    """
    mark = None if target is None else watermark(target, column)
    if mark is None:
        return staging
    literal = F.lit(mark).cast(target.schema[column].dataType)
    return staging.filter(F.col(column) >= literal if keyed else F.col(column) > literal)


def filtered(staging: DataFrame, target: DataFrame | None, condition) -> DataFrame:
    """A model's own filter: ``condition`` maps the target to a predicate; the first run is unfiltered."""
    return staging if target is None else staging.filter(condition(target))


def append(target: DataFrame | None, staging: DataFrame, policy: str = "append_new_columns") -> DataFrame:
    """All rows of both."""
    if target is None:
        return staging
    old, new = evolve(target, staging, policy)
    return old.unionByName(new)


def delete_insert(target: DataFrame | None, staging: DataFrame, keys: list[str], policy: str = "append_new_columns") -> DataFrame:
    """Target rows whose key is not in staging, and every staging row. Nulls match nulls."""
    if target is None:
        return staging
    if not keys:
        return append(target, staging, policy)
    old, new = evolve(target, staging, policy, keys)
    return old.join(new.select(*keys).distinct(), same_key(old, new, keys), "left_anti").unionByName(new)


def merge(target: DataFrame | None, staging: DataFrame, keys: list[str], policy: str = "append_new_columns") -> DataFrame:
    """Matched rows take staging's columns, unmatched ones are inserted; duplicate staging keys are refused.

    Columns that staging lacks under ``ignore`` keep the target's values.
    """
    if target is None:
        return staging
    if not keys:
        return append(target, staging, policy)
    require_unique(staging, keys)
    given = {c.lower() for c in staging.columns}
    old, new = evolve(target, staging, policy, keys)
    joined = old.alias("t").join(new.withColumn("__in", F.lit(True)).alias("s"), [F.col(f"t.{k}").eqNullSafe(F.col(f"s.{k}")) for k in keys], "full")
    pick = lambda c: (F.when(F.col("s.__in"), F.col(f"s.`{c}`")).otherwise(F.col(f"t.`{c}`")) if c.lower() in given else F.col(f"t.`{c}`")).alias(c)
    return joined.select(*(pick(c) for c in old.columns))


def partition_overwrite(target: DataFrame | None, staging: DataFrame, partition: str, policy: str = "append_new_columns") -> DataFrame:
    """Target rows of partitions that staging does not touch, and staging.

    The null partition is replaced like any other.
    """
    if target is None:
        return staging
    old, new = evolve(target, staging, policy)
    touched = new.select(partition).distinct()
    return old.join(touched, same_key(old, touched, [partition]), "left_anti").unionByName(new)


def write_partitions(staging: DataFrame, path: str, partition: str) -> None:
    """Replace the partitions present in staging on disk and leave the others alone."""
    staging.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)


def apply(strategy: str, target: DataFrame | None, staging: DataFrame, keys: list[str] | None = None, partition: str | None = None, policy: str = "append_new_columns") -> DataFrame:
    """Choose by strategy: append wins, then a missing key appends, then merge, partitions, delete and insert."""
    if strategy == "append" or not keys:
        return append(target, staging, policy)
    if strategy == "merge":
        return merge(target, staging, keys, policy)
    if partition:
        return partition_overwrite(target, staging, partition, policy)
    return delete_insert(target, staging, keys, policy)


def greater_than_max(target: DataFrame, column: str) -> Column:
    """The common incremental filter: column above the target's largest."""
    return F.col(column) > F.lit(watermark(target, column)).cast(target.schema[column].dataType)
