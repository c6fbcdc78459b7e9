"""Aggregates over a table that changes: each change takes its old row back and adds its new one.

A batch upserts and deletes rows of a keyed table (silver). What that does to sums
and counts by group (gold) is the sum of signed rows, -1 for each row that goes
and +1 for each that comes, so gold is kept right by appending a few partial sums
a batch, whatever the tables' sizes.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType

from tideframe.operators import cdc, filetable
from tideframe.operators.keys import require_unique, same_key, spread
from tideframe.operators.publish import append, read, read_log
from tideframe.sources.files import delete, exists
from tideframe.streaming.stream import run_available

ROWS = "n_rows"


def signed_sums(old: DataFrame | None, new: DataFrame, groups: list[str], sums: list[str]) -> DataFrame:
    """groups, n_rows and ``sums`` of the rows of ``new`` less those of ``old``, where anything is left.

    Sums are of whole or decimal numbers, which take back exactly what they have added.
    """
    for c in sums:
        if isinstance(new.schema[c].dataType, (DoubleType, FloatType)):
            raise ValueError(f"{c} must be a whole or decimal number: sums of floats cannot be taken back exactly")
    sign = F.col("__sign")
    rows = new.select(*groups, *sums).withColumn("__sign", F.lit(1).cast("long"))
    if old is not None:
        rows = rows.unionByName(old.select(*groups, *sums).withColumn("__sign", F.lit(-1).cast("long")))
    out = rows.groupBy(*groups).agg(F.sum(sign).alias(ROWS), *(F.coalesce(F.sum(F.when(sign > 0, F.col(c)).otherwise(-F.col(c))), F.lit(0)).cast("decimal(38,6)").alias(c) for c in sums))
    return out.filter(" or ".join(f"`{c}` <> 0" for c in [ROWS, *sums]))


def _added(parts: DataFrame, groups: list[str], sums: list[str]) -> DataFrame:
    return parts.groupBy(*groups).agg(F.sum(ROWS).alias(ROWS), *(F.sum(c).cast("decimal(38,6)").alias(c) for c in sums))


def retract_refresh(stream: DataFrame, checkpoint: str, silver: str, gold: str, now: datetime, keys: list[str], groups: list[str], sums: list[str], op: str | None = None, where: str | None = None, most: int = 16) -> None:
    """Apply a stream of rows to the keyed table ``silver`` and keep the sums by group of its rows that pass ``where`` in ``gold``.

    A row replaces that of its key; one whose ``op`` is a delete removes it. A
    key that repeats within a batch is refused. Only files of silver that may
    hold a key of the batch are read and written. The partial sums are computed
    from the very rows that the commit of silver replaces and written before it,
    so a batch that dies in between, or comes again, counts once.
    """
    spark = stream.sparkSession

    def each(batch: DataFrame, batch_id: int) -> None:
        tag, parts = f"delta-{batch_id}", f"{gold}/_parts/batch={batch_id}"
        if tag not in read_log(spark, gold).tags:
            batch = spread(batch, keys).persist()
            require_unique(batch, keys)
            live = batch.filter(~cdc.is_delete(F.col(op))).drop(op) if op else batch
            passing = lambda rows: rows.filter(where) if where else rows

            def build(old: DataFrame | None) -> DataFrame:
                gone = None if old is None else old.join(batch, same_key(old, batch, keys), "left_semi")
                signed_sums(None if gone is None else passing(gone), passing(live), groups, sums).write.mode("overwrite").parquet(parts)
                return live if old is None else old.join(batch, same_key(old, batch, keys), "left_anti").unionByName(live, allowMissingColumns=True)

            filetable.rewrite(spark, silver, batch, keys, build, now, tag)
            append(spark.read.parquet(parts), gold, now, tag, fold=lambda whole: _added(whole, groups, sums), most=most)
            batch.unpersist()
        if exists(spark, parts):
            delete(spark, parts)

    run_available(stream, checkpoint, each)


def retracted(spark: SparkSession, gold: str, groups: list[str], sums: list[str]) -> DataFrame | None:
    """groups, n_rows and sums of the groups that have rows."""
    held = read(spark, gold)
    return None if held is None else _added(held, groups, sums).filter(f"{ROWS} <> 0")
