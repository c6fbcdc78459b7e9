"""Sources, sinks, versions and streams; each writes what it reads below the shared work folder."""

from __future__ import annotations

import math
import os
import tempfile
import time
import zipfile
from concurrent.futures import ThreadPoolExecutor
from datetime import datetime, timedelta

from py4j.protocol import Py4JJavaError
from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideframe.operators import cdc, filetable, incremental, publish
from tideframe.operators.govern import Mask
from tideframe.operators.keys import ROWS_A_TASK
from tideframe.operators.quality import Check
from tideframe.plans.registry import query, table
from tideframe.sources import paged, readers, writers
from tideframe.sources.files import _file_system, delete, names, rename, set_modified, settled, work_folder
from tideframe.streaming import deltas, stream

NOW = datetime(2030, 1, 1)


def _orders(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")


@query("scan_parquet", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey < 500")
def _(spark, d):
    return readers.parquet(spark, f"{d}/orders.parquet").filter("o_custkey < 500").select("o_orderkey", "o_totalprice")


@query("scan_csv", "SELECT s_suppkey, s_name, s_nationkey FROM supplier")
def _(spark, d):
    path = work_folder(spark, "csv")
    table(spark, d, "supplier").select("s_suppkey", "s_name", "s_nationkey").write.option("header", True).csv(path)
    return readers.csv(spark, path)


@query("scan_json", "SELECT c_custkey, c_name, c_acctbal FROM customer")
def _(spark, d):
    path = work_folder(spark, "json")
    table(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal").write.json(path)
    return readers.json(spark, path, "c_custkey long, c_name string, c_acctbal double")


@query("scan_object_store", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity > 45")
def _(spark, d):
    # any URL of a store that Hadoop reads; here the shared folder's own
    return readers.external(spark, "parquet", f"{d}/lineitem.parquet").filter("l_quantity > 45").select("l_orderkey", "l_linenumber", "l_quantity")


@query("scan_warehouse", "SELECT p_partkey, p_brand FROM part WHERE p_size = 10")
def _(spark, d):
    return readers.external(spark, "parquet", f"{d}/part.parquet", mergeSchema="false").filter("p_size = 10").select("p_partkey", "p_brand")


@query("sync_high_watermark", "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders")
def _(spark, d):
    o = _orders(spark, d)
    first, mark = readers.sync_high_watermark(o.filter("o_orderkey <= 5000"), None, "o_orderkey")
    return readers.sync_high_watermark(o, first, "o_orderkey", mark)[0]


@query("sync_changed_files", "SELECT o_orderstatus, count(*) AS n FROM orders WHERE o_orderstatus <> 'F' GROUP BY 1")
def _(spark, d):
    """Files there before the mark are left out, those after it are read."""
    path, o = work_folder(spark, "changed"), _orders(spark, d)
    o.filter("o_orderstatus = 'F'").write.parquet(path)
    _, mark = readers.changed_files(spark, path)
    time.sleep(1.1)  # modification times of some stores are whole seconds
    o.filter("o_orderstatus <> 'F'").write.mode("append").parquet(path)
    fresh, _ = readers.changed_files(spark, path, since=mark)
    return fresh.groupBy("o_orderstatus").agg(F.count("*").alias("n"))


def _by_status(spark: SparkSession, o: DataFrame, path: str, at: int) -> None:
    """One file for each status, all of one modification time."""
    for status in ("F", "O", "P"):
        folder = work_folder(spark, "part")
        o.filter(F.col("o_orderstatus") == status).coalesce(1).write.parquet(folder)
        part = next(n for n in names(spark, folder) if n.endswith(".parquet"))
        rename(spark, f"{folder}/{part}", f"{path}/{status}.parquet")
        set_modified(spark, f"{path}/{status}.parquet", at)


@query(
    "sync_file_states",
    "SELECT o_orderkey, o_custkey, o_orderstatus, CASE WHEN o_orderstatus = 'O' THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice, (SELECT count(DISTINCT o_orderstatus) FROM orders) AS states FROM orders WHERE o_orderstatus <> 'F'",
)
def _(spark, d):
    """Files of one instant: one is replaced, one deleted, one stays; then one that was deleted comes back and goes again."""
    path, o, noon = work_folder(spark, "files"), _orders(spark, d), 1_700_000_000_000
    _by_status(spark, o, path, noon)
    fresh, changes, state = readers.file_changes(spark, path, None, "parquet", o.schema, NOW)
    target, states = settled(readers.apply_file_changes(None, fresh, changes)), state.count()
    delete(spark, f"{path}/F.parquet")
    delete(spark, f"{path}/O.parquet")
    other = work_folder(spark, "files")
    _by_status(spark, o.withColumn("o_totalprice", F.col("o_totalprice") + 1), other, noon + 5000)
    rename(spark, f"{other}/O.parquet", f"{path}/O.parquet")
    fresh, changes, state = readers.file_changes(spark, path, state, "parquet", o.schema, NOW)
    assert {r["change"] for r in changes.collect()} == {"replaced", "deleted"}
    return readers.apply_file_changes(target, fresh, changes).drop("_file").withColumn("states", F.lit(states))


@query("load_seed", "SELECT p_partkey, p_name FROM part")
def _(spark, d):
    path = work_folder(spark, "seed")
    table(spark, d, "part").select("p_partkey", "p_name").write.option("header", True).csv(path)
    rows, digest = readers.load_seed(spark, path)
    again, _ = readers.load_seed(spark, path, digest)
    return rows if again is None else again


@query("ingest_paged_json", "SELECT e.event_id AS id, e.event_type AS kind, e.value FROM events e")
def _(spark, d):
    """Pages of records under data.items whose properties are a nested struct."""
    item = F.struct(F.col("event_id").alias("id"), F.struct(F.col("event_type").alias("kind"), "value").alias("properties"))
    pages = table(spark, d, "events").groupBy(F.expr("event_id div 500").alias("page")).agg(F.collect_list(item).alias("items")).select(F.to_json(F.struct(F.struct("items").alias("data"))).alias("value"))
    schema = "data struct<items: array<struct<id: bigint, properties: struct<kind: string, value: double>>>>"
    return readers.paged_json(pages, schema, "$.data.items", lift="properties")


def _paged(spark: SparkSession, d: str) -> str:
    """Raw pages of 500 events each, as a client lands them."""
    path, item = work_folder(spark, "pages"), F.struct("event_id", F.col("event_type").alias("kind"), "value")
    pages = table(spark, d, "events").groupBy(F.expr("event_id div 500").alias("page")).agg(F.to_json(F.struct(F.struct(F.collect_list(item).alias("items")).alias("data"))).alias("text"))
    pages.write.partitionBy("page").text(path)
    paged.register(spark)
    return path


_PAGE_ITEM = "event_id long, kind string, value double"


@query("scan_pages", "SELECT event_id // 500 AS page, event_id, event_type AS kind, value FROM events WHERE event_id // 500 BETWEEN 1 AND 12 AND value > 10")
def _(spark, d):
    """A range of pages: the others are not read."""
    rows = paged.pages(spark, _paged(spark, d), 1, 12, rows="$.data.items")
    return rows.select("page", F.from_json("value", _PAGE_ITEM).alias("r")).select("page", "r.*").filter("value > 10")


@query("stream_pages", "SELECT event_type AS kind, count(*) AS n, sum(event_id)::BIGINT AS ids FROM events GROUP BY 1")
def _(spark, d):
    """The same pages as a stream, which goes on behind the last page read."""
    path, root = _paged(spark, d), work_folder(spark, "paged")
    for _ in range(2):  # the second run finds nothing new
        source = spark.readStream.format(paged.NAME).option("rows", "$.data.items").load(path)
        stream.run_available(source.select(F.from_json("value", _PAGE_ITEM).alias("r")).select("r.*"), f"{root}-checkpoint", stream.appender(spark, root, NOW))
    return publish.read(spark, root).groupBy("kind").agg(F.count("*").alias("n"), F.sum("event_id").alias("ids"))


@query("poll_watermark", "SELECT max(event_id::VARCHAR) AS mark FROM events")
def _(spark, d):
    return spark.createDataFrame([(readers.poll_watermark(table(spark, d, "events"), "event_id", "0"),)], "mark string")


def _inbox(spark: SparkSession, d: str) -> DataFrame:
    payload = F.to_json(F.struct("user_id", "value"))
    return table(spark, d, "events").select(F.col("event_type").alias("source"), F.col("event_id").cast("string").alias("id"), F.col("ts").alias("received_at"), payload.alias("payload"))


@query("flatten_inbox", "SELECT event_id::VARCHAR AS id, ts AS received_at, user_id, value FROM events")
def _(spark, d):
    return readers.flatten_inbox(_inbox(spark, d).drop("source"), "user_id long, value double")


@query("export_csv", "SELECT c_custkey, '***' AS c_name FROM customer")
def _(spark, d):
    path = work_folder(spark, "export")
    writers.export_csv(table(spark, d, "customer").select("c_custkey", "c_name"), path, [Mask("c_name", "redact")])
    return readers.csv(spark, path, "c_custkey long, c_name string")


@query("export_parquet", "SELECT s_suppkey, s_name FROM supplier")
def _(spark, d):
    path = work_folder(spark, "export")
    writers.export_parquet(table(spark, d, "supplier").select("s_suppkey", "s_name"), path)
    return readers.parquet(spark, path)


@query("compact_small_files", "SELECT count(*) AS rows, true AS fewer FROM orders")
def _(spark, d):
    source, target = work_folder(spark, "small"), work_folder(spark, "large")
    _orders(spark, d).repartition(20).write.parquet(source)
    files = writers.compact(spark, source, target)
    return readers.parquet(spark, target).agg(F.count("*").alias("rows")).withColumn("fewer", F.lit(files < writers.file_count(spark, source)))


@query("compact_partitions", "SELECT o_orderkey, o_totalprice, o_orderstatus, true AS packed FROM orders")
def _(spark, d):
    """Many small files of each status and large ones of all; the large ones stay as they are, the others become few."""
    o, path = _orders(spark, d).select("o_orderkey", "o_totalprice", "o_orderstatus"), work_folder(spark, "partitions")
    parts = math.ceil(o.count() / ROWS_A_TASK)
    o.filter("o_orderkey % 5 > 0").repartition(parts, "o_orderkey").write.partitionBy("o_orderstatus").parquet(path)
    large = {r["path"]: r["bytes"] for r in readers.listed(spark, path).collect()}
    o.filter("o_orderkey % 5 = 0").repartition(6 * parts, "o_orderkey").write.mode("append").partitionBy("o_orderstatus").parquet(path)
    taken, made = writers.compact_small(spark, path, target=2 * min(large.values()))
    left = {r["path"] for r in readers.listed(spark, path).collect()}
    return spark.read.parquet(path).withColumn("packed", F.lit(set(large) <= left and made < taken and len(left) == len(large) + made))


# ---- versions


def _versions(spark: SparkSession, d: str) -> str:
    """Orders of status F, then all, then all again with a column more."""
    root, o = work_folder(spark, "versions"), _orders(spark, d)
    publish.publish(o.filter("o_orderstatus = 'F'"), root, NOW)
    publish.publish(o, root, NOW + timedelta(days=1))
    publish.publish(o.withColumn("channel", F.lit("web")), root, NOW + timedelta(days=2))
    return root


@query("version_create", "SELECT * FROM (SELECT 1 AS version, count(*) FILTER (WHERE o_orderstatus = 'F') AS rows FROM orders UNION ALL SELECT 2, count(*) FROM orders UNION ALL SELECT 3, count(*) FROM orders)")
def _(spark, d):
    return publish.manifest(spark, _versions(spark, d)).select("version", "rows")


@query("version_append_all", "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders")
def _(spark, d):
    """Four writers append at once; each rebases on what the others have committed."""
    root, o = work_folder(spark, "appends"), _orders(spark, d)
    publish.publish(o.filter("o_orderkey % 5 = 0"), root, NOW)
    with ThreadPoolExecutor(4) as writers:
        list(writers.map(lambda k: publish.append(o.filter(f"o_orderkey % 5 = {k}"), root, NOW), range(1, 5)))
    return publish.read(spark, root)


@query("version_conflict", "SELECT o_orderstatus, count(*) AS n, true AS refused FROM orders GROUP BY 1")
def _(spark, d):
    """A version computed from one that is no longer the newest is refused; the newest stays."""
    root, o = work_folder(spark, "conflict"), _orders(spark, d)
    base = publish.publish(o.filter("o_orderstatus = 'F'"), root, NOW)
    publish.append(o.filter("o_orderstatus <> 'F'"), root, NOW)
    try:
        publish.publish(publish.read(spark, root, base).filter("o_orderkey < 0"), root, NOW, expect=base)
        refused = False
    except publish.ConflictError:
        refused = True
    return publish.read(spark, root).groupBy("o_orderstatus").agg(F.count("*").alias("n")).withColumn("refused", F.lit(refused))


@query("version_diff", "SELECT count(*) FILTER (WHERE o_orderstatus = 'F') AS rows_a, count(*) AS rows_b, count(*) FILTER (WHERE o_orderstatus <> 'F') AS row_change, ['channel'] AS added, []::VARCHAR[] AS removed FROM orders")
def _(spark, d):
    return publish.version_diff(spark, _versions(spark, d), 1, 3)


@query("version_restore", "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderstatus = 'F'")
def _(spark, d):
    root = _versions(spark, d)
    publish.restore(spark, root, 1, NOW + timedelta(days=3))
    return publish.read(spark, root)


@query(
    "version_timeline",
    f"SELECT * FROM (SELECT 1 AS version, TIMESTAMP '{NOW}' AS created_at, count(*) FILTER (WHERE o_orderstatus = 'F') AS rows, NULL::BIGINT AS row_change FROM orders UNION ALL SELECT 2, TIMESTAMP '{NOW + timedelta(days=1)}', count(*), count(*) FILTER (WHERE o_orderstatus <> 'F') FROM orders UNION ALL SELECT 3, TIMESTAMP '{NOW + timedelta(days=2)}', count(*), 0 FROM orders)",
)
def _(spark, d):
    return publish.timeline(spark, _versions(spark, d))


@query("version_cleanup", "SELECT 2 AS version, count(*) AS rows FROM orders UNION ALL SELECT 3, count(*) FROM orders")
def _(spark, d):
    root = _versions(spark, d)
    publish.cleanup(spark, root, 2, NOW + timedelta(days=3))
    return publish.manifest(spark, root).select("version", "rows")


@query("snapshot_dedupe", "SELECT 1 AS version, NULL::BIGINT AS source_version, count(*) AS rows FROM orders UNION ALL SELECT 2, 1, count(*) FROM orders")
def _(spark, d):
    root, o = work_folder(spark, "versions"), _orders(spark, d)
    publish.publish(o, root, NOW, dedupe=True)
    publish.publish(o.repartition(3, "o_custkey"), root, NOW, dedupe=True)
    return publish.manifest(spark, root).select("version", "source_version", "rows")


@query("snapshot_gc", "SELECT 3 AS version, count(*) AS rows FROM orders")
def _(spark, d):
    root = _versions(spark, d)
    publish.collect_garbage(spark, root, NOW + timedelta(days=3), max_age_days=2, max_bytes=1)
    return publish.manifest(spark, root).select("version", "rows")


# ---- streams, drained into versioned tables


def _landed(df: DataFrame, files: int) -> str:
    path = work_folder(df.sparkSession, "landing")
    df.repartition(files).write.parquet(path)
    return path


@query("inbox_flush", "SELECT event_type AS source, count(*) AS n, sum(event_id)::BIGINT AS ids FROM events GROUP BY 1")
def _(spark, d):
    rows, out = _inbox(spark, d), work_folder(spark, "flushed")
    landing = _landed(rows, 6)
    for _ in range(2):  # the second run finds nothing new
        stream.inbox_flush(stream.file_stream(spark, landing, rows.schema, files=2), f"{out}-checkpoint", out)
    return spark.read.parquet(out).groupBy("source").agg(F.count("*").alias("n"), F.sum(F.col("id").cast("long")).alias("ids"))


@query("inbox_purge", "SELECT event_type AS source, count(*) AS n FROM events WHERE event_id % 3 = 0 OR ts >= (SELECT max(ts) FROM events) - INTERVAL 240 HOUR GROUP BY 1")
def _(spark, d):
    """Two thirds are flushed; of these the last ten days stay."""
    rows = _inbox(spark, d)
    marked = stream.mark_flushed(rows, rows.filter("id % 3 <> 0"))
    return stream.purge_flushed(marked, rows.agg(F.max("received_at")).first()[0], 240).groupBy("source").agg(F.count("*").alias("n"))


def _stamped(spark: SparkSession, d: str) -> tuple[str, str]:
    rows, root = table(spark, d, "events").select("event_id", "ts"), work_folder(spark, "stamped")
    stream.stamp_stream(stream.file_stream(spark, _landed(rows, 4), rows.schema, files=2), f"{root}-checkpoint", root, f"{root}-log", NOW, "events")
    return root, f"{root}-log"


@query("seq_stamp", "SELECT count(*) AS n, 1 AS first, count(*) AS last, count(*) AS distinct_seq FROM events")
def _(spark, d):
    held = publish.read(spark, _stamped(spark, d)[0])
    return held.agg(F.count("*").alias("n"), F.min(stream.SEQ).alias("first"), F.max(stream.SEQ).alias("last"), F.count_distinct(stream.SEQ).alias("distinct_seq"))


@query("live_refresh", "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders")
def _(spark, d):
    o, root = _orders(spark, d), work_folder(spark, "live")
    landing, check = _landed(o, 4), [Check("no_nulls", ("o_orderkey",))]
    for _ in range(2):
        stream.live_upsert(stream.file_stream(spark, landing, o.schema, files=2), f"{root}-checkpoint", root, NOW, ["o_orderkey"], check)
    return stream.upserted(spark, root, ["o_orderkey"])


@query("live_upsert", "SELECT o_orderkey, o_totalprice + (o_orderkey % 3 = 0)::INT AS o_totalprice FROM orders")
def _(spark, d):
    """Orders, then a third of them again with another price; folders are put together on the way."""
    o, root, landing = _orders(spark, d).select("o_orderkey", "o_totalprice"), work_folder(spark, "upsert"), work_folder(spark, "landing")
    for rows in (o, o.filter("o_orderkey % 3 = 0").withColumn("o_totalprice", F.col("o_totalprice") + 1)):
        rows.coalesce(2).write.mode("append").parquet(landing)
        stream.live_upsert(stream.file_stream(spark, landing, o.schema, files=1), f"{root}-checkpoint", root, NOW, ["o_orderkey"], most=2)
    return stream.upserted(spark, root, ["o_orderkey"])


@query("live_cdc", "SELECT user_id, value, lsn AS _seq FROM (SELECT user_id, value, event_id AS lsn, event_id % 4 = 0 AS gone FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1) WHERE NOT gone")
def _(spark, d):
    changes = table(spark, d, "events").select("user_id", "value", F.when(F.col("event_id") % 4 == 0, "D").otherwise("I").alias("op"), F.col("event_id").alias("lsn"))
    root = work_folder(spark, "cdc")
    stream.cdc_refresh(stream.file_stream(spark, _landed(changes, 4), changes.schema, files=2), f"{root}-checkpoint", root, NOW, ["user_id"], ["value"], "lsn", "op")
    return stream.cdc_rows(spark, root, ["user_id"]).select("user_id", "value", cdc.SEQ)


@query("live_chain", "SELECT o_orderstatus, count(*) AS n FROM orders WHERE o_totalprice > 1000 GROUP BY 1")
def _(spark, d):
    """Bronze to silver to gold: each hop reads the files the last one has written."""
    o, silver, gold = _orders(spark, d), work_folder(spark, "silver"), work_folder(spark, "gold")
    bronze = _landed(o, 2)

    def clean(batch: DataFrame, batch_id: int) -> None:
        batch.filter("o_totalprice > 1000").withColumn("batch", F.lit(batch_id)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(silver)

    stream.run_available(stream.file_stream(spark, bronze, o.schema), f"{silver}-checkpoint", clean)

    def add(held: DataFrame | None, batch: DataFrame) -> DataFrame:
        n = batch.groupBy("o_orderstatus").agg(F.count("*").alias("n"))
        return n if held is None else held.union(n).groupBy("o_orderstatus").agg(F.sum("n").alias("n"))

    stream.live_refresh(stream.file_stream(spark, silver, o.schema), f"{gold}-checkpoint", gold, NOW, add)
    return publish.read(spark, gold)


_SILVER = "(SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'X' ELSE o_orderstatus END AS status, (o_totalprice + (o_orderkey % 3 = 0)::INT * 10)::DECIMAL(20,2) AS price FROM orders WHERE o_orderkey % 7 <> 1)"


def _changing(spark: SparkSession, d: str) -> tuple[str, str]:
    """Orders, then a third of them with another status and price, then a seventh deleted; the gold table counts those above a price."""
    silver, gold, landing = work_folder(spark, "silver"), work_folder(spark, "gold"), work_folder(spark, "landing")
    o = _orders(spark, d).select("o_orderkey", F.col("o_orderstatus").alias("status"), F.col("o_totalprice").cast("decimal(20,2)").alias("price"), F.lit("I").alias("op"))
    third = o.filter("o_orderkey % 3 = 0").withColumn("status", F.lit("X")).withColumn("price", (F.col("price") + 10).cast("decimal(20,2)"))
    for rows in (o, third, o.filter("o_orderkey % 7 = 1").withColumn("op", F.lit("D"))):
        rows.write.mode("append").parquet(landing)
        stream_ = stream.file_stream(spark, landing, o.schema, files=1_000_000)  # all that has landed is a batch
        deltas.retract_refresh(stream_, f"{gold}-checkpoint", silver, gold, NOW, ["o_orderkey"], ["status"], ["price"], op="op", where="price > 100000", most=2)
    return silver, gold


@query("live_retract", f"SELECT status, count(*) AS n_rows, sum(price)::DECIMAL(38,6) AS price FROM {_SILVER} WHERE price > 100000 GROUP BY 1")
def _(spark, d):
    """Rows of silver that change or go are taken back from gold, which is what a rebuild would give."""
    return deltas.retracted(spark, _changing(spark, d)[1], ["status"], ["price"])


@query("live_retract_silver", f"SELECT * FROM {_SILVER}")
def _(spark, d):
    return filetable.read(spark, _changing(spark, d)[0])


@query("assert_in_batch", "SELECT 0 AS published, true AS failed FROM region WHERE r_regionkey = 0")
def _(spark, d):
    o, root = _orders(spark, d), work_folder(spark, "guarded")
    failed = False
    try:
        stream.live_refresh(stream.file_stream(spark, _landed(o, 1), o.schema), f"{root}-checkpoint", root, NOW, lambda t, b: b, [Check("accepted_values", ("o_orderstatus",), ("none",))])
    except StreamingQueryException as error:  # the stream ends with the batch's error
        failed = "AssertionFailure" in str(error)
    return publish.manifest(spark, root).agg(F.count("*").alias("published")).withColumn("failed", F.lit(failed))


# an hour of events of one type is an advance, users are models that have consumed some


def _advances(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").groupBy(F.col("event_type").alias("source"), F.date_trunc("day", "ts").cast("timestamp_ntz").alias("advanced_at"))
    return e.agg(F.max("event_id").alias("watermark"), F.count("*").alias("rows")).withColumn("origin_at", F.col("advanced_at"))


_ADV = "(SELECT event_type AS source, date_trunc('day', ts)::TIMESTAMP AS advanced_at, max(event_id) AS watermark, count(*) AS rows FROM events GROUP BY 1, 2)"
_CONSUMED = "(SELECT 'all' AS model, source, (max(watermark) * 3 / 4)::BIGINT AS consumed FROM (SELECT source, max(watermark) // 4 * 4 AS watermark FROM adv GROUP BY 1) GROUP BY 1, 2)"


def _consumed(adv: DataFrame) -> DataFrame:
    return adv.groupBy("source").agg((F.floor(F.max("watermark") / 4) * 3).alias("consumed")).withColumn("model", F.lit("all"))


@query("live_lag", f"WITH adv AS {_ADV}, c AS {_CONSUMED} SELECT c.model, coalesce(date_diff('second', min(advanced_at), TIMESTAMP '{NOW}'), 0) AS lag_seconds FROM c LEFT JOIN adv ON adv.source = c.source AND adv.watermark > c.consumed GROUP BY 1")
def _(spark, d):
    adv = _advances(spark, d)
    return stream.lag(adv, _consumed(adv), NOW)


@query(
    "live_lag_views",
    """WITH RECURSIVE k AS (SELECT c_custkey FROM customer), e AS (SELECT c_custkey // 2 AS source, c_custkey AS derived FROM k WHERE c_custkey > 1 UNION SELECT c_custkey // 5, c_custkey FROM k WHERE c_custkey >= 5),
    l AS (SELECT c_custkey AS model, c_custkey * 7919 % 1000 AS lag_seconds FROM k WHERE c_custkey % 6 = 1),
    r(node, lag) AS (SELECT * FROM l UNION SELECT e.derived, r.lag FROM r JOIN e ON e.source = r.node WHERE e.derived % 6 <> 1)
    SELECT c_custkey AS model, coalesce(max(lag), 0) AS lag_seconds FROM k LEFT JOIN r ON r.node = c_custkey WHERE c_custkey > 0 GROUP BY 1""",
)
def _(spark, d):
    """Every sixth customer is a live model, the others are views over views; a view lags as the slowest live model that it reads through."""
    c = table(spark, d, "customer").select("c_custkey")
    reads = c.filter("c_custkey > 1").selectExpr("c_custkey div 2 AS source", "c_custkey AS derived").union(c.filter("c_custkey >= 5").selectExpr("c_custkey div 5", "c_custkey"))
    live = c.filter("c_custkey % 6 = 1").selectExpr("c_custkey AS model", "c_custkey * 7919 % 1000 AS lag_seconds")
    return stream.view_lag(live, reads)


@query("events_per_second", f"WITH adv AS {_ADV}, m AS (SELECT max(advanced_at) AS now FROM adv) SELECT source, coalesce(sum(rows) FILTER (WHERE advanced_at > now - INTERVAL 864000 SECOND), 0) / 864000 AS per_second FROM adv, m GROUP BY 1")
def _(spark, d):
    adv = _advances(spark, d)
    return stream.events_per_second(adv, adv.agg(F.max("advanced_at")).first()[0], 864000)


@query(
    "prune_advances",
    f"WITH adv AS {_ADV}, c AS {_CONSUMED}, m AS (SELECT max(advanced_at) AS now FROM adv) SELECT adv.source, adv.advanced_at, adv.watermark, adv.rows FROM adv JOIN c USING (source), m WHERE NOT (watermark <= consumed AND advanced_at < now - INTERVAL 1 HOUR) AND NOT advanced_at < now - INTERVAL 7 DAY",
)
def _(spark, d):
    adv = _advances(spark, d)
    return stream.prune_advances(adv, _consumed(adv), adv.agg(F.max("advanced_at")).first()[0]).select("source", "advanced_at", "watermark", "rows")


@query("live_coalesce", "SELECT count(*) AS rows, 1 AS refreshes FROM orders")
def _(spark, d):
    """A burst of files is one refresh."""
    o, root = _orders(spark, d), work_folder(spark, "burst")
    stream.run_available(stream.file_stream(spark, _landed(o, 5), o.schema, files=100), f"{root}-checkpoint", stream.appender(spark, root, NOW))
    refreshes = publish.manifest(spark, root).count()
    return publish.read(spark, root).agg(F.count("*").alias("rows")).withColumn("refreshes", F.lit(refreshes))


@query("live_interval", "SELECT count(*) AS rows FROM orders")
def _(spark, d):
    """Refreshes a second apart at most, until the stream is idle."""
    o, root = _orders(spark, d), work_folder(spark, "interval")
    q = stream.run_interval(stream.file_stream(spark, _landed(o, 3), o.schema, files=2), f"{root}-checkpoint", stream.appender(spark, root, NOW), 1)
    q.processAllAvailable()
    q.stop()
    return publish.read(spark, root).agg(F.count("*").alias("rows"))


@query("partition_overwrite_files", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice, o_orderstatus FROM orders")
def _(spark, d):
    o, path = _orders(spark, d).select("o_orderkey", "o_totalprice", "o_orderstatus"), work_folder(spark, "partitions")
    incremental.write_partitions(o, path, "o_orderstatus")
    incremental.write_partitions(o.filter("o_orderstatus = 'F'").withColumn("o_totalprice", F.col("o_totalprice") + 1), path, "o_orderstatus")
    return spark.read.parquet(path)


@query("defer_to_base", "SELECT p_partkey, p_name FROM part")
def _(spark, d):
    mine = work_folder(spark, "mine")
    delete(spark, mine)
    return readers.table_or_base(spark, mine, f"{d}/part.parquet").select("p_partkey", "p_name")


def _database(rows: DataFrame, name: str) -> str:
    """URL of a database with the rows as its one table, readable from every executor; on a cluster it would be a server's.

    The database that comes with Spark serves one process alone, unless it is
    packed and so read-only. The driver's process makes it of files that Spark
    writes, and packs it into the work folder, which must be mounted.
    """
    spark = rows.sparkSession
    kinds = {"bigint": "BIGINT", "string": "CLOB"}  # fixed values: the types of the two tables below
    landed, packed = work_folder(spark, "rows"), work_folder(spark, "database") + ".jar"
    rows.write.option("escape", '"').csv(landed)
    fs, folder = _file_system(spark, landed)
    with tempfile.TemporaryDirectory() as home:
        connect = lambda url: spark._jvm.org.apache.derby.jdbc.EmbeddedDriver().connect(url, spark._jvm.java.util.Properties())
        connection = connect(f"jdbc:derby:{home}/db;create=true")
        statement = connection.createStatement()
        statement.execute(f"CREATE TABLE {name} ({', '.join(f'\"{c}\" {kinds[kind]}' for c, kind in rows.dtypes)})")
        for part in names(spark, landed):
            if part.endswith(".csv"):
                fs.copyToLocalFile(False, spark._jvm.org.apache.hadoop.fs.Path(folder, part), spark._jvm.org.apache.hadoop.fs.Path(f"file://{home}/{part}"), True)
                statement.execute(f"CALL SYSCS_UTIL.SYSCS_IMPORT_TABLE(NULL, '{name.upper()}', '{home}/{part}', NULL, NULL, 'UTF-8', 0)")
                os.remove(f"{home}/{part}")
        connection.close()
        try:
            connect(f"jdbc:derby:{home}/db;shutdown=true")
        except Py4JJavaError as error:  # so it tells that it has ended
            if error.java_exception.getSQLState() != "08006":
                raise
        with zipfile.ZipFile(f"{home}/db.jar", "w", zipfile.ZIP_STORED) as jar:  # stored, so that pages are found by their place
            for at, _, files in os.walk(f"{home}/db"):
                for f in files:
                    jar.write(f"{at}/{f}", os.path.relpath(f"{at}/{f}", home))
        fs.copyFromLocalFile(False, True, spark._jvm.org.apache.hadoop.fs.Path(f"file://{home}/db.jar"), spark._jvm.org.apache.hadoop.fs.Path(packed))
    where = fs.resolvePath(spark._jvm.org.apache.hadoop.fs.Path(packed)).toUri()
    if where.getScheme() != "file":
        raise RuntimeError("the work folder must be mounted where the database is read")
    return f"jdbc:derby:jar:({where.getPath()})db"


_DERBY = {"driver": "org.apache.derby.jdbc.EmbeddedDriver"}


@query("scan_jdbc", "SELECT c_custkey, c_name FROM customer WHERE c_custkey >= 5")
def _(spark, d):
    rows = table(spark, d, "customer").select("c_custkey", "c_name")
    back = readers.jdbc(spark, _database(rows, "customer"), "customer", '"c_custkey"', rows.agg(F.min("c_custkey"), F.max("c_custkey")).first(), 4, **_DERBY)
    return back.filter("c_custkey >= 5").select("c_custkey", "c_name")


@query("scan_jdbc_skewed", "SELECT o_orderkey, o_custkey, true AS even FROM (SELECT CASE WHEN o_orderkey % 50 = 0 THEN NULL WHEN o_orderkey % 50 = 1 THEN o_orderkey * 1000000 ELSE o_orderkey END AS o_orderkey, o_custkey FROM orders)")
def _(spark, d):
    """A key with a few values far away and some nulls: no part holds much more than its share."""
    key = F.when(F.col("o_orderkey") % 50 == 0, None).when(F.col("o_orderkey") % 50 == 1, F.col("o_orderkey") * 1_000_000).otherwise(F.col("o_orderkey"))
    rows = table(spark, d, "orders").select(key.alias("o_orderkey"), "o_custkey")
    back = readers.jdbc_by_quantiles(spark, _database(rows, "skewed"), "skewed", "o_orderkey", 8, **_DERBY)
    parts = [r["count"] for r in back.groupBy(F.spark_partition_id()).count().collect()]
    return back.withColumn("even", F.lit(max(parts) <= 2 * sum(parts) / 8 and len(parts) >= 8))
