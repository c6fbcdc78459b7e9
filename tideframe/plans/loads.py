"""Incremental loads, history and change capture over batches carved from the shared tables."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideframe.operators import cdc, filetable, incremental, keys, microbatch, publish, schema, scd2
from tideframe.operators.publish import read_log
from tideframe.plans.registry import query, table
from tideframe.sources.files import work_folder

CUT, NOW = datetime(1995, 6, 1), datetime(2030, 1, 1)


def _orders(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate")


def _target(spark: SparkSession, d: str) -> DataFrame:
    return _orders(spark, d).filter(F.col("o_orderkey") % 3 != 0)


def _batch(spark: SparkSession, d: str) -> DataFrame:
    """Two thirds known keys with new prices, one third new ones."""
    return _orders(spark, d).filter(F.col("o_orderkey") % 2 == 0).withColumn("o_totalprice", F.col("o_totalprice") + 1)


_O = "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate FROM orders"
_T = f"({_O} WHERE o_orderkey % 3 <> 0)"
_B = f"(SELECT * REPLACE (o_totalprice + 1 AS o_totalprice) FROM ({_O} WHERE o_orderkey % 2 = 0))"


@query("build_table", "SELECT o_orderstatus, count(*) AS n, max(o_totalprice) AS most FROM orders GROUP BY 1")
def _(spark, d):
    """Built, and replaced as a whole by a second build with another column."""
    root, o = work_folder(spark, "table"), table(spark, d, "orders")
    publish.publish(o.groupBy("o_orderstatus").agg(F.count("*").alias("n")), root, NOW)
    publish.publish(o.groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.max("o_totalprice").alias("most")), root, NOW)
    return publish.read(spark, root)


@query("build_view", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P'")
def _(spark, d):
    table(spark, d, "orders").filter("o_orderstatus = 'P'").createOrReplaceTempView("silver_open_orders")
    return spark.table("silver_open_orders").select("o_orderkey")


@query("build_python_model", "SELECT n_name, count(*) AS customers FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY n_name")
def _(spark, d):
    def model(ref):
        return ref("customer").join(ref("nation"), F.col("n_nationkey") == F.col("c_nationkey")).groupBy("n_name").agg(F.count("*").alias("customers"))

    declared = {"customer", "nation"}

    def ref(name):
        if name not in declared:
            raise KeyError(f"{name} is not a declared input")
        return table(spark, d, name)

    return model(ref)


@query("inc_filter", f"SELECT * FROM {_B} WHERE o_orderkey > (SELECT max(o_orderkey) FROM {_T} WHERE o_orderkey % 10 < 5 AND o_orderkey < 20000)")
def _(spark, d):
    target = _target(spark, d).filter("o_orderkey % 10 < 5 AND o_orderkey < 20000")
    return incremental.filtered(_batch(spark, d), target, lambda t: incremental.greater_than_max(t, "o_orderkey"))


@query("inc_watermark", f"SELECT * FROM ({_O}) WHERE o_orderdate >= (SELECT max(o_orderdate) FROM ({_O}) WHERE o_orderdate < TIMESTAMP '{CUT}')")
def _(spark, d):
    o = _orders(spark, d)
    return incremental.new_rows(o, o.filter(F.col("o_orderdate") < F.lit(CUT).cast("timestamp_ntz")), "o_orderdate", keyed=True)


@query("inc_append", f"SELECT * FROM {_T} UNION ALL SELECT * FROM {_B}")
def _(spark, d):
    return incremental.append(_target(spark, d), _batch(spark, d))


@query("inc_delete_insert", f"SELECT * FROM {_T} t WHERE NOT EXISTS (SELECT 1 FROM {_B} b WHERE b.o_custkey IS NOT DISTINCT FROM t.o_custkey) UNION ALL SELECT * FROM {_B}")
def _(spark, d):
    return incremental.delete_insert(_target(spark, d), _batch(spark, d), ["o_custkey"])


@query("inc_merge", f"SELECT * FROM {_T} t WHERE NOT EXISTS (SELECT 1 FROM {_B} b WHERE b.o_orderkey = t.o_orderkey) UNION ALL SELECT * FROM {_B}")
def _(spark, d):
    return incremental.merge(_target(spark, d), _batch(spark, d), ["o_orderkey"])


# ---- the same, kept as files of which a batch rewrites those that may hold its keys


def _file_table(rows: DataFrame, keys: list[str], files: int = 64) -> str:
    root = work_folder(rows.sparkSession, "files")
    filetable.create(rows, root, keys, NOW, file_rows=max(1, rows.count() // files))
    return root


@query("inc_merge_files", f"SELECT * FROM {_T} t WHERE NOT EXISTS (SELECT 1 FROM {_B} b WHERE b.o_orderkey = t.o_orderkey) UNION ALL SELECT * FROM {_B}")
def _(spark, d):
    root = _file_table(_target(spark, d), ["o_orderkey"])
    filetable.merge(spark, root, _batch(spark, d), ["o_orderkey"], NOW)
    return filetable.read(spark, root)


@query("inc_delete_insert_files", f"SELECT * FROM {_T} t WHERE NOT EXISTS (SELECT 1 FROM {_B} b WHERE b.o_custkey IS NOT DISTINCT FROM t.o_custkey) UNION ALL SELECT * FROM {_B}")
def _(spark, d):
    root = _file_table(_target(spark, d), ["o_custkey"])
    filetable.delete_insert(spark, root, _batch(spark, d), ["o_custkey"], NOW)
    return filetable.read(spark, root)


_NEAR = "(o_orderkey % 999 = 0 OR o_orderkey BETWEEN 500 AND 500 + (SELECT max(o_orderkey) // 1000 FROM orders))"


@query("merge_files_touched", f"SELECT count(*) AS rows, count(*) FILTER (WHERE {_NEAR}) AS changed, true AS few_files FROM orders WHERE o_orderkey % 3 <> 0 OR {_NEAR}")
def _(spark, d):
    """A thousandth of the keys, next to each other, and as many new ones all over the table rewrite less than a twentieth of the files."""
    root, o = _file_table(_target(spark, d), ["o_orderkey"], 100), _orders(spark, d)
    most = o.agg(F.max("o_orderkey")).first()[0]
    near = (F.col("o_orderkey") % 999 == 0) | F.col("o_orderkey").between(500, 500 + most // 1000)
    done = filetable.merge(spark, root, o.filter(near).withColumn("o_totalprice", F.lit(-1.0)), ["o_orderkey"], NOW)
    few = F.lit(20 * done.replaced < done.files)
    return filetable.read(spark, root).agg(F.count("*").alias("rows"), F.count_if(F.col("o_totalprice") == -1).alias("changed")).withColumn("few_files", few)


@query("inc_partition_overwrite", f"SELECT * FROM {_T} WHERE o_orderstatus <> 'F' UNION ALL SELECT * FROM {_B} WHERE o_orderstatus = 'F'")
def _(spark, d):
    return incremental.apply("delete+insert", _target(spark, d), _batch(spark, d).filter("o_orderstatus = 'F'"), ["o_orderkey"], partition="o_orderstatus")


@query(
    "window_buckets",
    "SELECT w AS window_start, w + INTERVAL 1 MONTH AS window_end FROM (SELECT unnest(generate_series(date_trunc('month', min(ts))::TIMESTAMP, date_trunc('month', max(ts))::TIMESTAMP, INTERVAL 1 MONTH)) AS w FROM events)",
)
def _(spark, d):
    span = table(spark, d, "events").agg(F.min("ts"), F.max("ts")).first()
    return microbatch.windows(spark, span[0], span[1].replace(microsecond=0) + (datetime(2000, 1, 1, 0, 0, 1) - datetime(2000, 1, 1)), "month")


@query(
    "inc_microbatch",
    """WITH m AS (SELECT min(ts) AS lo, max(ts) AS hi FROM events), c AS (SELECT date_trunc('day', hi)::TIMESTAMP - INTERVAL 2 DAY AS cut FROM m)
       SELECT event_id, ts, value FROM events, c WHERE ts < cut AND event_id % 2 = 0 UNION ALL SELECT event_id, ts, value FROM events, c WHERE ts >= cut""",
)
def _(spark, d):
    e = table(spark, d, "events").select("event_id", "ts", "value")
    lo, hi = e.agg(F.min("ts"), F.max("ts")).first()
    day = hi.replace(hour=0, minute=0, second=0, microsecond=0)
    state = spark.range(1).select(
        F.explode(F.sequence(F.date_trunc("day", F.lit(lo).cast("timestamp_ntz")).cast("timestamp_ntz"), F.lit(day).cast("timestamp_ntz") - F.expr("interval 2 day"), F.expr("interval 1 day"))).alias("window_start")
    )
    state = state.select("window_start", (F.col("window_start") + F.expr("interval 1 day")).alias("window_end"), F.lit("done").alias("status"), F.lit(0).cast("long").alias("rows"))
    # the target has half of the past; the last recorded window is built again as lookback
    end = datetime(hi.year + 1, 1, 1)
    result, _ = microbatch.run(e.filter("event_id % 2 = 0"), e, "ts", state, lo, end, "day", lookback=1)
    return result


_DAYS = "SELECT event_id, ts, value FROM events"


@query("inc_microbatch_windows", f"{_DAYS} WHERE event_id % 2 = 0 OR ts >= (SELECT date_trunc('day', max(ts))::TIMESTAMP - INTERVAL 2 DAY FROM events)")
def _(spark, d):
    """Half of the events by windows of their own, then all of them for the last day closed before and those after it."""
    e, root = table(spark, d, "events").select("event_id", "ts", "value"), work_folder(spark, "windows")
    lo, hi = e.agg(F.min("ts"), F.max("ts")).first()
    day = hi.replace(hour=0, minute=0, second=0, microsecond=0)
    microbatch.run_windows(spark, root, e.filter("event_id % 2 = 0"), "ts", lo, day - timedelta(days=1), "day")
    microbatch.run_windows(spark, root, e, "ts", lo, day + timedelta(days=1), "day", lookback=1)
    return microbatch.read_windows(spark, root)


@query("microbatch_resume", "SELECT count(*) AS rows, sum(event_id)::BIGINT AS ids, true AS kept FROM events")
def _(spark, d):
    """A run that dies between windows goes on with the first one that is not committed; what was committed keeps its files."""
    e, root = table(spark, d, "events").select("event_id", "ts", "value"), work_folder(spark, "windows")
    lo, hi = e.agg(F.min("ts"), F.max("ts")).first()
    end, left = hi + timedelta(days=40), [2]

    def source(a, b):
        left[0] -= 1
        if left[0] < 0:
            raise InterruptedError
        return e

    try:
        microbatch.run_windows(spark, root, source, "ts", lo, end, "month", at_once=1)
    except InterruptedError:
        left[0] = 10_000
    before = {w["start"]: w["run"] for w in read_log(spark, root, microbatch.WindowLog).windows.values()}
    microbatch.run_windows(spark, root, source, "ts", lo, end, "month", at_once=100)
    after = {w["start"]: w["run"] for w in read_log(spark, root, microbatch.WindowLog).windows.values()}
    rows = microbatch.read_windows(spark, root)
    return rows.agg(F.count("*").alias("rows"), F.sum("event_id").alias("ids")).withColumn("kept", F.lit(all(after[k] == run for k, run in before.items())))


_S1 = "(SELECT c_custkey, c_name, c_mktsegment FROM customer WHERE c_custkey % 5 <> 0)"
_S2 = "(SELECT c_custkey, c_name, CASE WHEN c_custkey % 3 = 0 THEN 'CHANGED' ELSE c_mktsegment END AS c_mktsegment FROM customer WHERE c_custkey % 7 <> 0)"
_T1, _T2 = datetime(2024, 1, 1), datetime(2024, 2, 1)
_COLS = ["c_custkey", "c_name", "c_mktsegment", "valid_from", "valid_to", "is_current"]


def _snapshots(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    c = table(spark, d, "customer").select("c_custkey", "c_name", "c_mktsegment")
    two = c.filter("c_custkey % 7 <> 0").withColumn("c_mktsegment", F.when(F.col("c_custkey") % 3 == 0, "CHANGED").otherwise(F.col("c_mktsegment")))
    return c.filter("c_custkey % 5 <> 0"), two


def _scd_sql(gone: str, extra: str = "", deleted: str = "") -> str:
    return f"""
WITH a AS {_S1}, b AS {_S2}, j AS (SELECT a.*, b.c_custkey AS bk, b.c_mktsegment AS seg FROM a LEFT JOIN b ON a.c_custkey = b.c_custkey)
SELECT c_custkey, c_name, c_mktsegment, TIMESTAMP '{_T1}' AS valid_from,
       CASE WHEN (bk IS NOT NULL AND seg <> c_mktsegment) OR (bk IS NULL AND {gone}) THEN TIMESTAMP '{_T2}' END AS valid_to,
       NOT ((bk IS NOT NULL AND seg <> c_mktsegment) OR (bk IS NULL AND {gone})) AS is_current{deleted and ', false AS is_deleted'} FROM j
UNION ALL SELECT b.c_custkey, b.c_name, b.c_mktsegment, TIMESTAMP '{_T2}', NULL, true{deleted and ', false'} FROM b LEFT JOIN a ON a.c_custkey = b.c_custkey
WHERE a.c_custkey IS NULL OR a.c_mktsegment <> b.c_mktsegment {extra}"""


def _scd(spark, d, **options) -> DataFrame:
    one, two = _snapshots(spark, d)
    first = scd2.apply(None, one, ["c_custkey"], _T1, **options)
    return scd2.apply(first, two, ["c_custkey"], _T2, **options)


@query("scd2_check", _scd_sql("false"))
def _(spark, d):
    return _scd(spark, d).select(*_COLS)


@query("scd2_hard_deletes", _scd_sql("true", f"UNION ALL SELECT c_custkey, c_name, c_mktsegment, TIMESTAMP '{_T2}', NULL, true, true FROM j WHERE bk IS NULL", "yes"))
def _(spark, d):
    return _scd(spark, d, hard_deletes="new_record").select(*_COLS, "is_deleted")


@query("scd2_invalidate", _scd_sql("true"))
def _(spark, d):
    return _scd(spark, d, hard_deletes="invalidate").select(*_COLS)


@query(
    "scd2_timestamp",
    """WITH e AS (SELECT user_id, event_type, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events),
       a AS (SELECT * FROM e WHERE rn = 1), b AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY rn DESC) = 1)
       SELECT a.user_id, a.event_type, a.ts AS valid_from, CASE WHEN b.ts > a.ts THEN b.ts END AS valid_to, NOT b.ts > a.ts AS is_current FROM a JOIN b USING (user_id)
       UNION ALL SELECT b.user_id, b.event_type, b.ts, NULL, true FROM a JOIN b USING (user_id) WHERE b.ts > a.ts""",
)
def _(spark, d):
    e = table(spark, d, "events")
    pick = lambda f: e.groupBy("user_id").agg(f(F.struct("event_type", "ts"), F.struct("ts", "event_id")).alias("r")).select("user_id", "r.*")
    first = scd2.apply(None, pick(F.min_by), ["user_id"], _T1, strategy="timestamp", updated_at="ts")
    second = scd2.apply(first, pick(F.max_by), ["user_id"], _T2, strategy="timestamp", updated_at="ts")
    return second.select("user_id", "event_type", "valid_from", "valid_to", "is_current")


@query("scd2_schema_append", f"SELECT a.c_custkey, NULL::VARCHAR AS tier, a.c_custkey % 4 <> 1 AS is_current FROM {_S1} a UNION ALL SELECT c_custkey, 'gold', true FROM {_S1} WHERE c_custkey % 4 = 1")
def _(spark, d):
    one, _ = _snapshots(spark, d)
    first = scd2.apply(None, one, ["c_custkey"], _T1)
    wider = one.withColumn("tier", F.lit("gold")).withColumn("c_name", F.when(F.col("c_custkey") % 4 == 1, F.upper(F.concat("c_name", F.lit("x")))).otherwise(F.col("c_name")))
    return scd2.apply(first, wider, ["c_custkey"], _T2, check_cols=["c_name", "c_mktsegment"]).select("c_custkey", "tier", "is_current")


@query("scd2_as_of", f"SELECT c_custkey, c_mktsegment FROM {_S1}")
def _(spark, d):
    return scd2.as_of(_scd(spark, d), datetime(2024, 1, 15)).select("c_custkey", "c_mktsegment")


@query("duplicate_key_guard", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) > 1 ORDER BY n DESC, o_custkey LIMIT 3")
def _(spark, d):
    return keys.duplicate_keys(table(spark, d, "orders"), ["o_custkey"])


@query(
    "schema_evolve",
    f"SELECT o_orderkey, o_custkey, NULL::VARCHAR AS channel FROM {_T} UNION ALL SELECT o_orderkey, o_custkey, 'web' FROM {_B}",
)
def _(spark, d):
    t, b = _target(spark, d).select("o_orderkey", "o_custkey"), _batch(spark, d).select("o_orderkey", "o_custkey").withColumn("channel", F.lit("web"))
    old, new = schema.evolve(t, b, "append_new_columns")
    return old.unionByName(new)


@query("row_hash", "SELECT md5('V:' || o_orderkey || '|' || 'V:' || o_orderpriority || '|N') AS h, o_orderkey FROM orders")
def _(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_orderpriority").withColumn("gone", F.lit(None).cast("string"))
    return o.select(keys.row_hash(["o_orderkey", "o_orderpriority", "gone"]).alias("h"), "o_orderkey")


# ---- change capture: the events of each user as a log, `purchase` as the delete


def _changes(spark: SparkSession, d: str) -> DataFrame:
    # sequence numbers run against time here and there, and every fifth is missing
    op = F.when(F.col("event_id") % 4 == 0, "D").otherwise("u")
    return table(spark, d, "events").select("user_id", "value", op.alias("op"), F.when(F.col("event_id") % 5 != 0, F.col("event_id") * 7919 % 10007).alias("lsn"), "event_id")


_C = "(SELECT user_id, value, CASE WHEN event_id % 4 = 0 THEN 'D' ELSE 'u' END AS op, CASE WHEN event_id % 5 <> 0 THEN event_id * 7919 % 10007 END AS lsn, event_id FROM events)"
_LAST = "QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY lsn DESC NULLS LAST, (op = 'D') DESC) = 1"


@query("cdc_dedupe", f"SELECT user_id, lsn, op FROM {_C} WHERE lsn IS NOT NULL {_LAST}")
def _(spark, d):
    return cdc.dedupe(_changes(spark, d).filter("lsn is not null"), ["user_id"], "lsn", "op").select("user_id", "lsn", "op")


@query("cdc_is_delete", "SELECT event_type, upper(left(trim(event_type), 1)) = 'D' AS gone, count(*) AS n FROM (SELECT CASE WHEN event_id % 3 = 0 THEN ' delete' ELSE event_type END AS event_type FROM events) GROUP BY ALL")
def _(spark, d):
    e = table(spark, d, "events").select(F.when(F.col("event_id") % 3 == 0, " delete").otherwise(F.col("event_type")).alias("event_type"))
    return e.groupBy("event_type", cdc.is_delete(F.col("event_type")).alias("gone")).agg(F.count("*").alias("n"))


@query(
    "cdc_normalize",
    """SELECT CASE event_id % 4 WHEN 0 THEN 'D' WHEN 1 THEN 'I' ELSE 'U' END AS op, event_id + 4294967296 AS lsn,
       CASE WHEN event_id % 4 = 0 THEN 'before' ELSE 'after' END || event_id AS payload FROM events WHERE event_id % 4 <> 3""",
)
def _(spark, d):
    e = table(spark, d, "events")
    op = F.element_at(F.array(F.lit("delete"), F.lit("c"), F.lit("UPDATE"), F.lit("truncate")), (F.col("event_id") % 4 + 1).cast("int"))
    i = F.col("event_id").cast("string")
    return cdc.normalize(e.select(op.alias("op"), F.concat(F.lit("1/"), F.hex("event_id")).alias("lsn"), F.concat(F.lit("before"), i).alias("before"), F.concat(F.lit("after"), i).alias("after")))


def _halves(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    c = _changes(spark, d).filter("lsn is not null")
    return c.filter("event_id % 2 = 0"), c.filter("event_id % 2 <> 0")


def _empty(df: DataFrame, columns: list[str], name: str) -> DataFrame:
    return df.select(*columns, F.col("lsn").alias(name)).limit(0)


def _settled(df: DataFrame) -> DataFrame:
    """Written and read again, as a target is between two batches; lazily nested, each batch would redo all before it."""
    path = work_folder(df.sparkSession, "batch")
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


_FINAL = f"(SELECT * FROM {_C} WHERE lsn IS NOT NULL {_LAST})"


def _held(spark: SparkSession, d: str) -> DataFrame:
    """Target and tombstones after two batches, the second with events older than the first's, and the first once more."""
    one, two = _halves(spark, d)
    held = _empty(one, ["user_id", "value"], cdc.SEQ).withColumn(cdc.DELETED, F.lit(False))
    for batch in (two, one, two):
        held = _settled(cdc.apply_changes(held, batch, ["user_id"], "lsn", "op"))
    return held


@query("cdc_apply_hard", f"SELECT user_id, value, lsn AS _seq FROM {_FINAL} WHERE op <> 'D'")
def _(spark, d):
    return _held(spark, d).filter(f"not {cdc.DELETED}").drop(cdc.DELETED)


@query("cdc_apply_files", f"SELECT user_id, value, lsn AS _seq, op = 'D' AS _deleted FROM (SELECT user_id, CASE WHEN op <> 'D' THEN value END AS value, lsn, op FROM {_FINAL})")
def _(spark, d):
    """Changes applied to the files that may hold their keys; the batch that comes again by its tag does nothing."""
    one, two = _halves(spark, d)
    first = cdc.apply_changes(_empty(one, ["user_id", "value"], cdc.SEQ).withColumn(cdc.DELETED, F.lit(False)), two, ["user_id"], "lsn", "op")
    root = _file_table(first, ["user_id"], 16)
    for tag, batch in (("one", one), ("two", two), ("one", two.limit(0))):
        filetable.apply_changes(spark, root, batch, ["user_id"], "lsn", "op", NOW, tag)
    return filetable.read(spark, root)


@query("cdc_schema_append", f"SELECT user_id, value, CASE WHEN event_id % 2 = 0 THEN NULL ELSE event_id END AS event_id, lsn AS _seq FROM {_FINAL} WHERE op <> 'D'")
def _(spark, d):
    """The second batch has a column that the target lacks; rows of the first stay null in it."""
    one, two = _halves(spark, d)
    target, tombs = _empty(one, ["user_id", "value"], cdc.SEQ), _empty(one, ["user_id"], cdc.SEQ)
    for batch in (one.drop("event_id"), two):
        target, tombs = map(_settled, cdc.apply_hard(target, tombs, batch, ["user_id"], "lsn", "op"))
    return target


@query("cdc_tombstones", f"SELECT user_id, lsn AS _seq FROM {_FINAL} WHERE op = 'D'")
def _(spark, d):
    one, two = _halves(spark, d)
    target, tombs = _empty(one, ["user_id", "value"], cdc.SEQ), _empty(one, ["user_id"], cdc.SEQ)
    for batch in (two, one):
        target, tombs = map(_settled, cdc.apply_hard(target, tombs, batch, ["user_id"], "lsn", "op"))
    return tombs


@query("cdc_apply_soft", f"SELECT user_id, value, lsn AS _seq, op = 'D' AS _deleted FROM {_FINAL}")
def _(spark, d):
    one, two = _halves(spark, d)
    target = _empty(one, ["user_id", "value"], cdc.SEQ).withColumn(cdc.DELETED, F.lit(False))
    for batch in (two, one, two):
        target = _settled(cdc.apply_soft(target, batch, ["user_id"], "lsn", "op", schema="ignore"))
    return target


@query("late_data", "SELECT count(*) AS n, count(*) FILTER (WHERE event_id % 2 = 1) AS late FROM events")
def _(spark, d):
    """Rows of windows built before arrive late and are picked up by the lookback."""
    e = table(spark, d, "events").select("event_id", "ts")
    lo, hi = e.agg(F.min("ts"), F.max("ts")).first()
    state = spark.createDataFrame([], microbatch.STATE)
    end = datetime(hi.year + 1, 1, 1)
    early, state = microbatch.run(None, e.filter("event_id % 2 = 0"), "ts", state, lo, end, "year")
    full, _ = microbatch.run(early, e, "ts", state, lo, end, "year", lookback=end.year - lo.year)
    return full.agg(F.count("*").alias("n"), F.count_if(F.col("event_id") % 2 == 1).alias("late"))
