"""Structured Streaming: inbox flush, sequence stamps, live refresh, lag and its log."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from tideframe.operators import cdc
from tideframe.operators.closure import propagate
from tideframe.operators.keys import comparable, require_unique
from tideframe.operators.publish import ConflictError, append, publish, read, read_log
from tideframe.operators.quality import Check, require

SEQ = "_seq"


def file_stream(spark: SparkSession, path: str, schema: StructType | str, format: str = "parquet", files: int = 8) -> DataFrame:
    """A stream of the files of a folder, so many a batch; the checkpoint remembers those seen."""
    return spark.readStream.format(format).schema(schema).option("maxFilesPerTrigger", files).load(path)


def stamp(batch: DataFrame, base: int) -> tuple[DataFrame, int]:
    """(batch with ``_seq`` from base + 1 without gaps, its last number).

    One count a partition reaches the driver; no global sort. Numbers rise from
    batch to batch, which is all a watermark needs. The caller persists the
    batch, so that both passes see the same rows.
    """
    placed = batch.withColumn("__p", F.spark_partition_id()).withColumn("__i", F.monotonically_increasing_id())
    counts = dict(placed.groupBy("__p").count().collect())
    before, total = {}, base
    for p in sorted(counts):
        before[p] = total
        total += counts[p]
    if not counts:
        return batch.withColumn(SEQ, F.lit(None).cast("long")), base
    start = F.create_map(*(F.lit(x).cast("long") for kv in before.items() for x in kv))
    place = F.col("__i").bitwiseAND((1 << 33) - 1)  # the place in the partition, by the function's definition
    return placed.withColumn(SEQ, start[F.col("__p").cast("long")] + place + 1).drop("__p", "__i"), total


def run_available(df: DataFrame, checkpoint: str, each: Callable[[DataFrame, int], None]) -> None:
    """Process what is there in batches and stop; run again, it goes on where it stopped."""
    df.writeStream.trigger(availableNow=True).option("checkpointLocation", checkpoint).foreachBatch(each).start().awaitTermination()


def run_interval(df: DataFrame, checkpoint: str, each: Callable[[DataFrame, int], None], seconds: int) -> StreamingQuery:
    """Keep processing, a batch every so many seconds at most; rows that come meanwhile go together."""
    return df.writeStream.trigger(processingTime=f"{seconds} seconds").option("checkpointLocation", checkpoint).foreachBatch(each).start()


def inbox_flush(stream: DataFrame, checkpoint: str, folder: str) -> None:
    """Inbox rows (source, id, received_at, payload) to ``folder``, one folder a source, oldest first; a replayed batch overwrites its own files.

    Rows are dealt by ranges of source, time and id, so a source that sends very
    many rows, even within an hour, is many tasks and files.
    """

    def each(batch: DataFrame, batch_id: int) -> None:
        ordered = batch.withColumn("batch", F.lit(batch_id)).repartitionByRange("source", "received_at", "id").sortWithinPartitions("source", "received_at", "id")
        ordered.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch", "source").parquet(folder)

    run_available(stream, checkpoint, each)


def mark_flushed(inbox: DataFrame, flushed: DataFrame) -> DataFrame:
    """The inbox with ``flushed``: whether ``flushed`` (source, id) has the row."""
    known = flushed.select("source", "id").distinct().withColumn("__flushed", F.lit(True))
    return inbox.join(known, ["source", "id"], "left").withColumn("flushed", F.coalesce("__flushed", F.lit(False))).drop("__flushed")


def purge_flushed(marked: DataFrame, now: datetime, keep_hours: int) -> DataFrame:
    """What stays in the inbox: rows that are not flushed, however old, and flushed ones of the last so many hours."""
    since = F.lit(now).cast("timestamp_ntz") - F.make_dt_interval(hours=F.lit(keep_hours))
    return marked.filter(~F.col("flushed") | (F.col("received_at").cast("timestamp_ntz") >= since))


def stamp_stream(stream: DataFrame, checkpoint: str, root: str, log: str, now: datetime, source: str = "source") -> None:
    """Append each batch to the versioned table ``root`` with sequence numbers, and the advance to ``log``.

    The last number and the number of rows are the note of the version, written
    with it, so a batch that is replayed after a crash in between writes the same
    line of the log again. Numbers go on from those of the version that the batch
    is appended to; where another writer gets ahead, they are given anew, so that
    several streams into one table share one sequence without a number twice.
    """
    spark = stream.sparkSession

    def stamped(batch: DataFrame, tag: str) -> tuple[int, int] | None:
        while True:
            log = read_log(spark, root)
            if tag in log.tags:
                held = log.live.get(log.tags[tag])  # gone only long after its line was written
                return tuple(map(int, held["note"].split("/"))) if held else None
            noted = [log.live[v]["note"] for v in sorted(log.live) if log.live[v]["note"]]
            base = int(noted[-1].split("/")[0]) if noted else 0
            rows, last = stamp(batch, base)
            try:
                append(rows, root, now, tag, note=f"{last}/{last - base}", expect=log.version or 0)
                return last, last - base
            except ConflictError:
                continue

    def each(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        done = stamped(batch, f"stamp-{source}-{batch_id}")
        batch.unpersist()
        if done:
            line = spark.createDataFrame([(source, *done, now)], "source string, watermark long, rows long, advanced_at timestamp_ntz")
            line.coalesce(1).write.mode("overwrite").parquet(f"{log}/stream={source}/batch={batch_id}")

    run_available(stream, checkpoint, each)


def live_refresh(stream: DataFrame, checkpoint: str, root: str, now: datetime, build: Callable[[DataFrame | None, DataFrame], DataFrame], checks: list[Check] | None = None) -> None:
    """Keep a small table, such as an aggregate, up to date: each batch makes a new version by ``build(target, batch)``, which is written whole.

    The checkpoint is the mark of what is consumed, the batch's number the
    version's tag, so a replay changes nothing. A failing error check raises
    before anything is published, and the batch is tried again.
    """
    spark = stream.sparkSession

    def each(batch: DataFrame, batch_id: int) -> None:
        while True:
            version = read_log(spark, root).version
            new = build(None if version is None else read(spark, root, version), batch)
            try:
                publish(require(new, checks) if checks else new, root, now, tag=f"live-{batch_id}", expect=version or 0)
                return
            except ConflictError:
                continue  # another writer's version is the one to build on

    run_available(stream, checkpoint, each)


def appender(spark: SparkSession, root: str, now: datetime, checks: list[Check] | None = None) -> Callable[[DataFrame, int], None]:
    """For ``run_available`` or ``run_interval``: each batch's rows are appended, and only they are checked and written."""

    def each(batch: DataFrame, batch_id: int) -> None:
        append(require(batch, checks) if checks else batch, root, now, tag=f"live-{batch_id}")

    return each


BATCH = "_batch"


def live_upsert(stream: DataFrame, checkpoint: str, root: str, now: datetime, keys: list[str], checks: list[Check] | None = None, most: int = 16) -> None:
    """Merge a stream by key without rewriting the table: batches are appended with their number, ``upserted`` reads the last row of each key.

    A key that repeats within a batch is refused. Once there are ``most`` folders
    they are put together, older rows of a key left out.
    """
    spark = stream.sparkSession

    def each(batch: DataFrame, batch_id: int) -> None:
        require_unique(batch, keys)
        rows = (require(batch, checks) if checks else batch).withColumn(BATCH, F.lit(batch_id).cast("long"))
        append(rows, root, now, tag=f"live-{batch_id}", fold=lambda whole: _last(whole, keys, F.col(BATCH)), most=most)

    run_available(stream, checkpoint, each)


def _last(rows: DataFrame, keys: list[str], order: Column) -> DataFrame:
    """The row of each key with the greatest order."""
    best = F.max_by(F.struct(*rows.columns), order)
    return rows.groupBy(*(F.col(k).alias(f"__k{i}") for i, k in enumerate(keys))).agg(best.alias("r")).select("r.*")


def upserted(spark: SparkSession, root: str, keys: list[str]) -> DataFrame | None:
    """The rows of a table kept by ``live_upsert``."""
    held = read(spark, root)
    return None if held is None else _last(held, keys, F.col(BATCH)).drop(BATCH)


def cdc_refresh(stream: DataFrame, checkpoint: str, root: str, now: datetime, keys: list[str], values: list[str], seq: str, op: str, most: int = 16) -> None:
    """Apply a stream of changes: the last change of each key of a batch is appended, ``_deleted`` for deletes; ``cdc_rows`` reads what they come to.

    As in ``cdc.apply_changes``, a change counts if its sequence is greater than
    that of the row held, or the same and its row goes before, so late and repeated ones change nothing; one without a
    sequence always does, and what comes after it does too.
    """

    def each(batch: DataFrame, batch_id: int) -> None:
        last = cdc.dedupe(batch, keys, seq, op, [*keys, *values])
        rows = last.select(*keys, *values, F.col(seq).alias(cdc.SEQ), cdc.is_delete(F.col(op)).alias(cdc.DELETED), F.lit(batch_id).cast("long").alias(BATCH))
        append(rows, root, now, tag=f"cdc-{batch_id}", fold=lambda whole: _changes(whole, keys), most=most)

    run_available(stream, checkpoint, each)


def _changes(rows: DataFrame, keys: list[str]) -> DataFrame:
    """For each key the greatest sequence (of equal ones a delete, then the greatest values) since its last change without one, or that change."""
    unordered = rows.filter(F.col(cdc.SEQ).isNull()).groupBy(*keys).agg(F.max(BATCH).alias("__since"))
    since = rows.join(unordered.select(*(F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)), "__since"), reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(keys))), "left")
    counting = since.filter("__since is null or _batch >= __since").select(*rows.columns)
    ties = comparable(rows.schema, [c for c in rows.columns if c not in (cdc.SEQ, cdc.DELETED, BATCH)])
    return _last(counting, keys, F.struct(F.col(cdc.SEQ).isNotNull(), F.col(cdc.SEQ), F.col(cdc.DELETED), *(F.col(f"`{c}`") for c in ties), -F.col(BATCH)))


def cdc_rows(spark: SparkSession, root: str, keys: list[str]) -> DataFrame | None:
    """The live rows of a table kept by ``cdc_refresh``, with ``_seq``."""
    held = read(spark, root)
    return None if held is None else _changes(held, keys).filter(f"not {cdc.DELETED}").drop(cdc.DELETED, BATCH)


def lag(advances: DataFrame, consumed: DataFrame, now: datetime) -> DataFrame:
    """(model, lag_seconds): age of the oldest advance (source, watermark, origin_at) a model (model, source, consumed) has not taken; 0 without any, the slowest of its sources."""
    j = consumed.alias("c").join(advances.alias("a"), (F.col("a.source") == F.col("c.source")) & (F.col("a.watermark") > F.col("c.consumed")), "left")
    age = F.timestamp_diff("SECOND", F.min("a.origin_at"), F.lit(now).cast("timestamp_ntz"))
    return j.groupBy("c.model").agg(F.coalesce(age, F.lit(0)).alias("lag_seconds"))


def view_lag(lags: DataFrame, reads: DataFrame) -> DataFrame:
    """(model, lag_seconds) of live models, as ``lag`` has them, and of the views that read them (source, derived), however many views lie between.

    A view shows its inputs as they are, so it lags as far as the slowest live
    model it reads through; 0 if there is none.
    """
    live = lags.select(F.col("model").alias("node"), "lag_seconds")
    reached = propagate(reads, live, {"lag_seconds": F.max}, stop=live.select("node")).withColumnRenamed("node", "model")
    every = lags.select("model").union(reads.select("derived")).distinct()
    return every.join(reached.hint("merge"), "model", "left").select("model", F.coalesce("lag_seconds", F.lit(0)).alias("lag_seconds"))


def events_per_second(advances: DataFrame, now: datetime, seconds: int = 60) -> DataFrame:
    """(source, per_second) over the last so many seconds (source, rows, advanced_at)."""
    since = F.lit(now).cast("timestamp_ntz") - F.make_dt_interval(secs=F.lit(seconds))
    recent = (F.col("advanced_at") > since) & (F.col("advanced_at") <= F.lit(now).cast("timestamp_ntz"))
    return advances.groupBy("source").agg((F.coalesce(F.sum(F.when(recent, F.col("rows"))), F.lit(0)) / seconds).alias("per_second"))


def prune_advances(advances: DataFrame, consumed: DataFrame, now: datetime, keep_hours: int = 1, most_days: int = 7) -> DataFrame:
    """The log without advances that all consumers have passed and that are old, and without very old ones."""
    least = consumed.groupBy("source").agg(F.min("consumed").alias("__least"))
    age = lambda **k: F.col("advanced_at") < F.lit(now).cast("timestamp_ntz") - F.make_dt_interval(**{a: F.lit(b) for a, b in k.items()})
    passed = F.coalesce(F.col("watermark") <= F.col("__least"), F.lit(False)) & age(hours=keep_hours)
    return advances.join(least, "source", "left").filter(~(passed | age(days=most_days))).drop("__least")


def newest_per_source(advances: DataFrame) -> DataFrame:
    """Each source's last advance."""
    w = Window.partitionBy("source").orderBy(F.desc("watermark"))
    return advances.withColumn("__rn", F.row_number().over(w)).filter("__rn = 1").drop("__rn")
