"""Data quality, diffs and run history over the shared tables."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tideframe.operators import diff, difftree, history, keys, quality, schema, sketches
from tideframe.operators.quality import Check
from tideframe.plans.registry import query, table
from tideframe.sources.files import work_folder

NOW = datetime(2030, 1, 1)


def _nulled(spark: SparkSession, d: str) -> DataFrame:
    """Orders with a null status in place of F."""
    return table(spark, d, "orders").withColumn("s", F.when(F.col("o_orderstatus") != "F", F.col("o_orderstatus"))).select("o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority", "s")


_N = "(SELECT o_orderkey, o_custkey, o_totalprice, o_orderpriority, CASE WHEN o_orderstatus <> 'F' THEN o_orderstatus END AS s FROM orders)"


def _one(sql: str, name: str, severity: str = "error") -> str:
    return f"SELECT '{name}' AS \"check\", '{severity}' AS severity, v = 0 AS passed, v AS violations FROM (SELECT ({sql})::BIGINT AS v FROM {_N})"


_CHECKS = {
    "assert_row_count": (Check("row_count", op=">", number=100), "CASE WHEN count(*) > 100 THEN 0 ELSE 1 END"),
    "assert_no_nulls": (Check("no_nulls", ("s",)), "count(*) - count(s)"),
    "assert_unique": (Check("unique", ("s",)), "count(*) - count(DISTINCT s)"),
    "assert_accepted_values": (Check("accepted_values", ("s",), ("O",), severity="warn"), "count(*) FILTER (WHERE s NOT IN ('O'))"),
    "assert_grain": (Check("grain", ("o_custkey", "s")), "count(*) - count(DISTINCT (o_custkey, s))"),
    "assert_expression": (Check("expression", expr="o_totalprice > 50000 and s <> 'P'"), "count(*) FILTER (WHERE NOT (o_totalprice > 50000 AND s <> 'P'))"),
    "assert_expression_aggregate": (Check("expression", expr="max(o_totalprice) < 100"), "CASE WHEN NOT (max(o_totalprice) < 100) THEN 1 ELSE 0 END"),
}

for _name, (_check, _sql) in _CHECKS.items():
    query(_name, _one(_sql, _check.name.replace("'", "''"), _check.severity))(lambda spark, d, c=_check: quality.run_assertions(_nulled(spark, d), [c]))


@query("run_assertions", " UNION ALL ".join(_one(sql, c.name.replace("'", "''"), c.severity) for c, sql in _CHECKS.values()))
def _(spark, d):
    return quality.run_assertions(_nulled(spark, d), [c for c, _ in _CHECKS.values()])


@query("assert_no_nulls_percent", f"SELECT 's' AS column_name, count(*) - count(s) AS nulls, round((count(*) - count(s)) * 100.0 / count(*), 2)::DOUBLE AS percent FROM {_N}")
def _(spark, d):
    return quality.null_percent(_nulled(spark, d), "s")


@query("assert_accepted_values_sample", f"SELECT s AS value, count(*) AS rows FROM {_N} WHERE s NOT IN ('O') GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5")
def _(spark, d):
    return quality.unaccepted_values(_nulled(spark, d), Check("accepted_values", ("s",), ("O",)))


@query(
    "profile_samples",
    " UNION ALL ".join(f"SELECT '{c}' AS column_name, list(v::VARCHAR ORDER BY v::VARCHAR) AS samples FROM (SELECT DISTINCT {c} AS v FROM {_N} WHERE {c} IS NOT NULL ORDER BY v::VARCHAR LIMIT 5)" for c in ("o_orderpriority", "s", "o_custkey")),
)
def _(spark, d):
    return quality.profile_samples(_nulled(spark, d).select("o_orderpriority", "s", "o_custkey"))


@query("failing_rows", f"SELECT * FROM {_N} WHERE o_custkey IN (SELECT o_custkey FROM orders GROUP BY 1 HAVING count(*) > 1)")
def _(spark, d):
    return quality.failing_rows(_nulled(spark, d), Check("unique", ("o_custkey",)))


@query("freshness_sources", f"SELECT count(*) AS rows, max(ts) AS newest, date_diff('second', max(ts), TIMESTAMP '{NOW}') AS age_seconds, date_diff('second', max(ts), TIMESTAMP '{NOW}') > 3600 AS stale FROM events")
def _(spark, d):
    # whole seconds on both sides
    return quality.freshness(table(spark, d, "events"), "ts", 3600, NOW).withColumn("age_seconds", F.timestamp_diff("SECOND", F.date_trunc("second", "newest").cast("timestamp_ntz"), F.lit(NOW).cast("timestamp_ntz")))


_RUNS = "(SELECT event_type AS model, max(ts) AS last_run, count(*) AS rows, 1000 + length(event_type) * 300 AS min_rows FROM events GROUP BY 1)"


@query(
    "freshness_models",
    f"""SELECT model, round(date_diff('second', date_trunc('second', last_run), now) / 3600.0, 6) AS hours, date_diff('second', date_trunc('second', last_run), now) > 3600 * 2 OR model = 'view' OR rows < min_rows AS stale
        FROM {_RUNS}, (SELECT date_trunc('second', max(ts)) + INTERVAL 1 HOUR AS now FROM events)""",
)
def _(spark, d):
    """Late runs, a stale source and too few rows each make a model stale; the others are fresh."""
    e = table(spark, d, "events")
    runs = e.groupBy(F.col("event_type").alias("model")).agg(F.max("ts").alias("last_run"), F.count("*").alias("rows"), (F.lit(1000) + F.max(F.length("event_type")) * 300).alias("min_rows"))
    now = e.agg(F.date_trunc("second", F.max("ts")) + F.expr("interval 1 hour")).first()[0]
    sources = runs.select("model", (F.col("model") == "view").alias("stale"))
    return quality.freshness_models(runs, sources, 2, now).withColumn("hours", F.round("hours", 6))


def _profile_sql(table_: str, columns: list[str]) -> str:
    return " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, count(*) AS row_count, round((count(*) - count({c})) * 100.0 / count(*), 1)::DOUBLE AS null_percent, count(DISTINCT {c}) AS distinct_count FROM {table_}" for c in columns
    )


@query("profile_basic", _profile_sql(_N, ["o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority", "s"]))
def _(spark, d):
    return quality.profile_basic(_nulled(spark, d), approximate=False)


@query(
    "profile_table",
    " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, count(*) AS row_count, round((count(*) - count({c})) * 100.0 / count(*), 1)::DOUBLE AS null_percent, count(DISTINCT {c}) AS distinct_count, min({c})::VARCHAR AS least, max({c})::VARCHAR AS greatest, {m} AS mean FROM customer"
        for c, m in (("c_custkey", "round(avg(c_custkey), 4)"), ("c_name", "NULL::DOUBLE"), ("c_nationkey", "round(avg(c_nationkey), 4)"), ("c_mktsegment", "NULL::DOUBLE"))
    ),
)
def _(spark, d):
    return quality.profile_table(table(spark, d, "customer").drop("c_acctbal"), approximate=False)


@query(
    "profile_merged",
    " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, count(*) AS row_count, round((count(*) - count({c})) * 100.0 / count(*), 1)::DOUBLE AS null_percent, min({c})::VARCHAR AS least, max({c})::VARCHAR AS greatest, {m} AS mean, true AS close FROM events"
        for c, m in (("event_id", "round(avg(event_id), 4)"), ("user_id", "round(avg(user_id), 4)"), ("event_type", "NULL::DOUBLE"))
    ),
)
def _(spark, d):
    """Profiles of the parts of a table put together: the first parts, then the others, of which alone rows are read."""
    e, root = table(spark, d, "events").select("event_id", "user_id", "event_type", F.col("event_type").alias("part")), work_folder(spark, "profiles")
    sketches.refresh(e.filter("part < 'm'"), root, "part", NOW)
    sketches.refresh(e, root, "part", NOW)
    whole = sketches.report(sketches.stored(spark, root))
    exact = quality.profile_basic(e.drop("part"), approximate=False).select("column_name", "distinct_count")
    half = e.agg(F.avg((F.col("event_id") <= whole.filter("column_name = 'event_id'").first()["quantiles"][1]).cast("int"))).first()[0]
    near = F.abs(F.col("w.distinct_count") - F.col("x.distinct_count")) <= 0.05 * F.col("x.distinct_count")
    return whole.alias("w").join(exact.alias("x"), "column_name").select("column_name", "row_count", "null_percent", "least", "greatest", F.round("mean", 4).alias("mean"), (near & F.lit(abs(half - 0.5) < 0.02)).alias("close"))


@query("high_null_alert", f"SELECT * FROM ({_profile_sql(_N, ['o_orderkey', 's'])}) WHERE null_percent > 20")
def _(spark, d):
    return quality.high_nulls(quality.profile_basic(_nulled(spark, d).select("o_orderkey", "s"), approximate=False), 20.0)


@query(
    "contract_schema",
    f"""SELECT * FROM (VALUES ('o_custkey', 'widened', 'warn', 'int -> bigint'), ('o_totalprice', 'narrowed', 'error', 'decimal(12,2) -> double'), ('gone', 'missing', 'error', 'string'),
        ('o_orderpriority', 'changed', 'error', 'date -> string')) t(column_name, finding, severity, detail) UNION ALL SELECT 's', 'null_values', 'error', (count(*) - count(s))::VARCHAR FROM {_N}""",
)
def _(spark, d):
    declared = {"o_orderkey": "bigint", "o_custkey": "int", "o_totalprice": "decimal(12,2)", "gone": "string", "o_orderpriority": "date", "s": "string"}
    return schema.contract(_nulled(spark, d), declared, not_null=["s", "o_orderkey"])


# daily counts by event type stand for the profiles of tables


def _daily(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").groupBy(F.col("event_type").alias("model"), F.date_trunc("day", "ts").cast("timestamp_ntz").alias("profiled_at"))
    return e.agg(F.count("*").alias("row_count"), F.avg("value").alias("mean_value"))


_DAILY = "(SELECT event_type AS model, date_trunc('day', ts)::TIMESTAMP AS profiled_at, count(*) AS row_count, avg(value) AS mean_value FROM events GROUP BY 1, 2)"


@query(
    "contract_eval",
    f"""WITH o AS (SELECT model, profiled_at, row_count >= 10 AS passed FROM {_DAILY}), s AS (SELECT *, max(passed::INT) OVER (PARTITION BY model ORDER BY profiled_at DESC) AS ok FROM o)
        SELECT model, 'volume' AS "check", count(*) FILTER (WHERE ok = 0) AS failures, CASE WHEN count(*) FILTER (WHERE ok = 0) >= 3 THEN 'error' ELSE 'warn' END AS severity FROM s GROUP BY model""",
)
def _(spark, d):
    daily = _daily(spark, d).select("model", F.lit("volume").alias("check"), F.lit("warn").alias("severity"), (F.col("row_count") >= 10).alias("passed"), F.col("profiled_at").alias("checked_at"))
    return quality.contract_eval(daily)


@query("contract_previous", f"SELECT model, row_count AS previous FROM {_DAILY} QUALIFY row_number() OVER (PARTITION BY model ORDER BY profiled_at DESC) = 2")
def _(spark, d):
    return quality.previous_profile(_daily(spark, d))


@query(
    "anomaly_zscore",
    f"""WITH w AS (SELECT model, profiled_at, row_count::DOUBLE AS value, avg(row_count) OVER p AS mean, stddev_pop(row_count) OVER p AS stddev, count(*) OVER p AS n FROM {_DAILY}
        WINDOW p AS (PARTITION BY model ORDER BY profiled_at ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING))
        SELECT model, 'row_count' AS metric, profiled_at, value, round(mean, 6) AS mean, round(stddev, 6) AS stddev, round((value - mean) / stddev, 6) AS z FROM w WHERE n >= 3 AND stddev > 0 AND abs((value - mean) / stddev) > 2""",
)
def _(spark, d):
    h = _daily(spark, d).select("model", F.lit("row_count").alias("metric"), F.col("row_count").cast("double").alias("value"), "profiled_at")
    return quality.anomalies(h).withColumns({c: F.round(c, 6) for c in ("mean", "stddev", "z")})


@query(
    "schema_drift",
    """SELECT * FROM (VALUES ('orders', 2, 'o_totalprice', 'column_renamed', 'breaking', 'o_totalprice', 'price'), ('orders', 2, 'o_orderdate', 'column_removed', 'breaking', 'timestamp_ntz', NULL),
       ('orders', 2, 'note', 'column_added', 'info', NULL, 'string'), ('orders', 2, 'o_custkey', 'type_narrowed', 'breaking', 'bigint', 'int')) t(table_name, version, column_name, change, severity, old_value, new_value)""",
)
def _(spark, d):
    def version(df: DataFrame, n: int) -> list[tuple]:
        return [("orders", n, f.name, f.dataType.simpleString(), i, True) for i, f in enumerate(df.schema)]

    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate")
    later = o.select("o_orderkey", F.col("o_custkey").cast("int").alias("o_custkey"), "o_orderstatus", F.col("o_totalprice").alias("price"), F.lit("").alias("note"))
    history_ = spark.createDataFrame(version(o, 1) + version(later, 2), "table_name string, version int, column_name string, type string, position int, nullable boolean")
    return schema.drift(history_)


@query(
    "schema_drift_clash",
    """SELECT * FROM (VALUES ('part', 2, 'p_name', 'column_renamed', 'breaking', 'p_name', 'x'), ('part', 2, 'p_brand', 'column_renamed', 'breaking', 'p_brand', 'y'),
       ('part', 2, 'p_retailprice', 'column_removed', 'breaking', 'double', NULL), ('part', 2, 'n', 'column_added', 'info', NULL, 'int'), ('part', 2, 'p_partkey', 'order_changed', 'info', '2', '0')) t(table_name, version, column_name, change, severity, old_value, new_value)""",
)
def _(spark, d):
    """Two old columns match one new column best; the second takes the next one."""
    p = table(spark, d, "part")
    before = p.select("p_name", "p_brand", "p_partkey", "p_retailprice")
    after = p.select("p_partkey", F.col("p_name").alias("x"), F.col("p_size").cast("int").alias("n"), F.col("p_brand").alias("y"))
    rows = [("part", n, f.name, f.dataType.simpleString(), i, True) for n, df in ((1, before), (2, after)) for i, f in enumerate(df.schema)]
    return schema.drift(spark.createDataFrame(rows, "table_name string, version int, column_name string, type string, position int, nullable boolean"))


_EXPECTED = f"(SELECT o_orderkey, s FROM {_N} WHERE o_orderkey % 5 <> 0)"
_ACTUAL = f"(SELECT o_orderkey, CASE WHEN o_orderkey % 11 = 0 THEN 'X' ELSE s END AS s FROM {_N} WHERE o_orderkey % 7 <> 0)"


@query("unit_compare", f"SELECT *, 'missing' AS side FROM (SELECT * FROM {_EXPECTED} EXCEPT ALL SELECT * FROM {_ACTUAL}) UNION ALL SELECT *, 'unexpected' FROM (SELECT * FROM {_ACTUAL} EXCEPT ALL SELECT * FROM {_EXPECTED})")
def _(spark, d):
    n = _nulled(spark, d).select("o_orderkey", "s")
    actual = n.filter("o_orderkey % 7 <> 0").withColumn("s", F.when(F.col("o_orderkey") % 11 == 0, "X").otherwise(F.col("s")))
    return diff.unit_compare(n.filter("o_orderkey % 5 <> 0"), actual)


# ---- diffs: customers before and after


def _states(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    c = table(spark, d, "customer").select("c_custkey", "c_name", "c_nationkey")
    after = c.filter("c_custkey % 9 <> 0").withColumn("c_nationkey", F.when(F.col("c_custkey") % 4 == 0, None).otherwise(F.col("c_nationkey")))
    return c.filter("c_custkey % 8 <> 0"), after


_A = "(SELECT c_custkey, c_name, c_nationkey FROM customer WHERE c_custkey % 8 <> 0)"
_B = "(SELECT c_custkey, c_name, CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE c_nationkey END AS c_nationkey FROM customer WHERE c_custkey % 9 <> 0)"


@query(
    "diff_schema",
    f"""SELECT 'tier' AS column_name, 'added' AS change, NULL AS old_type, 'string' AS new_type, count(*) FILTER (WHERE c_custkey % 4 = 0) AS filled FROM {_B}
        UNION ALL SELECT 'c_name', 'removed', 'string', NULL, count(c_name) FROM {_A} UNION ALL SELECT 'c_nationkey', 'type_changed', 'int', 'bigint', count(c_nationkey) FROM {_B}""",
)
def _(spark, d):
    a, b = _states(spark, d)
    after = b.drop("c_name").withColumn("c_nationkey", F.col("c_nationkey").cast("long")).withColumn("tier", F.when(F.col("c_custkey") % 4 == 0, "x"))
    return diff.changes_of_schema(a, after)


@query("diff_rows", f"SELECT *, 'added' AS side FROM (SELECT * FROM {_B} EXCEPT SELECT * FROM {_A}) UNION ALL SELECT *, 'removed' FROM (SELECT * FROM {_A} EXCEPT SELECT * FROM {_B})")
def _(spark, d):
    return diff.rows(*_states(spark, d))


_LATER = "(SELECT l_orderkey, l_linenumber, l_quantity + (l_orderkey BETWEEN 40 AND 60)::INT AS l_quantity FROM lineitem WHERE l_orderkey <> 1001 UNION ALL SELECT max(l_orderkey) + 1, 1, 5 FROM lineitem)"
_EARLIER = "(SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem)"


@query("diff_tree", f"SELECT *, true AS few_ranges FROM (SELECT *, 'added' AS side FROM {_LATER} ANTI JOIN {_EARLIER} USING (l_orderkey, l_linenumber, l_quantity) UNION ALL SELECT *, 'removed' FROM {_EARLIER} ANTI JOIN {_LATER} USING (l_orderkey, l_linenumber, l_quantity))")
def _(spark, d):
    """A few orders change, one goes, one comes: only their ranges of keys are read to tell which."""
    before = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    last = before.agg((F.max("l_orderkey") + 1).alias("l_orderkey"), F.lit(1).alias("l_linenumber"), F.lit(5.0).alias("l_quantity"))
    after = before.filter("l_orderkey <> 1001").withColumn("l_quantity", F.col("l_quantity") + F.when(F.col("l_orderkey").between(40, 60), 1).otherwise(0)).unionByName(last)
    changed, ranges = difftree.rows(before, after, "l_orderkey")
    return changed.withColumn("few_ranges", F.lit(1 <= len(ranges) <= 25))


@query("tree_equal", "SELECT true AS same, false AS other FROM region WHERE r_regionkey = 0")
def _(spark, d):
    """Whole tables compared by their roots: another order of rows is the same table, one copy more is not."""
    o = table(spark, d, "orders").select("o_orderkey", "o_totalprice", "o_orderdate")
    at = difftree.bounds(o, o, "o_orderkey")
    own, shuffled = difftree.tree(o, "o_orderkey", *at), difftree.tree(o.repartition(5), "o_orderkey", *at)
    more = difftree.tree(o.unionByName(o.orderBy("o_orderkey").limit(1)), "o_orderkey", *at)
    return spark.createDataFrame([(difftree.equal(own, shuffled), difftree.equal(own, more))], "same boolean, other boolean")


@query("diff_modified", f"SELECT a.c_custkey FROM {_A} a JOIN {_B} b ON a.c_custkey = b.c_custkey WHERE a.c_nationkey IS DISTINCT FROM b.c_nationkey")
def _(spark, d):
    return diff.modified(*_states(spark, d), ["c_custkey"])


@query(
    "diff_summary",
    f"""WITH m AS (SELECT count(*) AS n FROM {_A} a JOIN {_B} b ON a.c_custkey = b.c_custkey WHERE a.c_nationkey IS DISTINCT FROM b.c_nationkey)
        SELECT (SELECT count(*) FROM {_A}) AS before, (SELECT count(*) FROM {_B}) AS after, greatest((SELECT count(*) FROM (SELECT * FROM {_B} EXCEPT SELECT * FROM {_A})) - n, 0) AS added,
        greatest((SELECT count(*) FROM (SELECT * FROM {_A} EXCEPT SELECT * FROM {_B})) - n, 0) AS removed, n AS modified FROM m""",
)
def _(spark, d):
    return diff.summary(*_states(spark, d), ["c_custkey"])


_EXCEPT = f"SELECT (SELECT count(*) FROM {_A}) AS before, (SELECT count(*) FROM {_B}) AS after, (SELECT count(*) FROM (SELECT * FROM {_A} EXCEPT SELECT * FROM {_B})) AS only_before, (SELECT count(*) FROM (SELECT * FROM {_B} EXCEPT SELECT * FROM {_A})) AS only_after"


@query("diff_except", _EXCEPT)
def _(spark, d):
    return diff.except_counts(*_states(spark, d))


@query("except_count", f"SELECT count(*) AS n FROM (SELECT * FROM {_A} EXCEPT SELECT * FROM {_B})")
def _(spark, d):
    a, b = _states(spark, d)
    return a.subtract(b).agg(F.count("*").alias("n"))


_SAME = "CASE WHEN EXISTS (({0} EXCEPT ALL {1}) UNION ALL ({1} EXCEPT ALL {0})) THEN '{2}' ELSE '{3}' END"
_HALF = "SELECT * FROM orders WHERE o_orderkey % 2 = 0"


@query(
    "diff_branches",
    f"""SELECT 'customer' AS table_name, {_SAME.format(f"SELECT * FROM {_A}", f"SELECT * FROM {_B}", "changed", "unchanged")} AS status UNION ALL SELECT 'orders', {_SAME.format(_HALF, _HALF, "changed", "unchanged")}
        UNION ALL SELECT 'region', 'not_built' UNION ALL SELECT 'supplier', 'added'""",
)
def _(spark, d):
    a, b = _states(spark, d)
    o, r = table(spark, d, "orders").filter("o_orderkey % 2 = 0"), table(spark, d, "region")
    found = diff.branches({"customer": a, "orders": o, "region": r}, {"customer": b, "orders": o.repartition(5, "o_custkey"), "supplier": table(spark, d, "supplier")}, built={"customer", "orders", "supplier"})
    return spark.createDataFrame(list(found.items()), "table_name string, status string")


@query("table_checksum", "SELECT count(*) AS rows, true AS same_reordered, false AS same_changed FROM orders")
def _(spark, d):
    """A checksum does not depend on order or partitions, and does on values."""
    o = table(spark, d, "orders")
    sums = [keys.table_checksum(x).withColumn("k", F.lit(i)) for i, x in enumerate((o, o.repartition(7, "o_custkey"), o.withColumn("o_totalprice", F.col("o_totalprice") + F.when(F.col("o_orderkey") == 1, 1.0).otherwise(0.0))))]
    one = sums[0].union(sums[1]).union(sums[2]).groupBy().pivot("k", [0, 1, 2]).agg(F.max("rows").alias("rows"), F.max("hash_sum").alias("h"))
    return one.select(F.col("0_rows").alias("rows"), (F.col("0_h") == F.col("1_h")).alias("same_reordered"), (F.col("0_h") == F.col("2_h")).alias("same_changed"))


_SIGN = "NOT EXISTS (({0} EXCEPT ALL {1}) UNION ALL ({1} EXCEPT ALL {0}))"


@query("table_signature_diff", f"""SELECT 'customer' AS table_name, {_SIGN.format(f"SELECT * FROM {_A}", f"SELECT * FROM {_B}")} AS same UNION ALL SELECT 'orders', {_SIGN.format(_HALF, _HALF)}""")
def _(spark, d):
    a, b = _states(spark, d)
    o = table(spark, d, "orders").filter("o_orderkey % 2 = 0")
    sign = lambda **t: [keys.table_checksum(df).withColumn("table_name", F.lit(k)) for k, df in t.items()]
    union = lambda frames: frames[0].union(frames[1])
    old, new = union(sign(customer=a, orders=o)), union(sign(customer=b, orders=o.repartition(5, "o_custkey")))
    return old.alias("o").join(new.alias("n"), "table_name").select("table_name", ((F.col("o.rows") == F.col("n.rows")) & (F.col("o.hash_sum") == F.col("n.hash_sum")) & (F.col("o.hash_xor") == F.col("n.hash_xor"))).alias("same"))


# ---- run history: each nation's orders by month stand for the builds of a model


def _builds(spark: SparkSession, d: str) -> DataFrame:
    o, c = table(spark, d, "orders").select("o_custkey", "o_orderdate", "o_totalprice"), table(spark, d, "customer").select("c_custkey", "c_nationkey")
    month = F.date_trunc("month", "o_orderdate").cast("timestamp_ntz").alias("built_at")
    return o.join(c, o.o_custkey == c.c_custkey).groupBy(F.col("c_nationkey").alias("model"), month).agg(F.round(F.sum("o_totalprice") / 1000).alias("duration_ms"), F.count("*").alias("rows_in"))


_BUILDS = "(SELECT c_nationkey AS model, date_trunc('month', o_orderdate)::TIMESTAMP AS built_at, round(sum(o_totalprice) / 1000) AS duration_ms, count(*) AS rows_in FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1, 2)"


@query(
    "robust_zscore",
    f"""WITH p AS (SELECT model, built_at, duration_ms, list(duration_ms) OVER (PARTITION BY model ORDER BY built_at ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) AS past FROM {_BUILDS}),
        m AS (SELECT *, list_aggregate(past, 'median') AS med FROM p WHERE len(past) >= 5),
        a AS (SELECT *, list_aggregate(list_transform(past, lambda x: abs(x - med)), 'median') AS mad FROM m)
        SELECT model, built_at, round((duration_ms - med) / greatest(1.4826 * mad, 0.05 * med, 1e-9), 4) AS z FROM a""",
)
def _(spark, d):
    return history.robust_zscore(_builds(spark, d), ["model"], "duration_ms", "built_at").select("model", "built_at", F.round("z", 4).alias("z"))


def _z(value: str, rows: str) -> str:
    return f"""(SELECT model, built_at, {value} AS v, (v - med) / greatest(1.4826 * mad, 0.05 * med, 1e-9) AS z, v / med AS ratio, med FROM (SELECT *, list_aggregate(list_transform(past, lambda x: abs(x - med)), 'median') AS mad FROM
        (SELECT *, list_aggregate(past, 'median') AS med FROM (SELECT *, list({value}) OVER (PARTITION BY model ORDER BY built_at ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) AS past FROM {rows}) WHERE len(past) >= 5)))"""


@query(
    "perf_regression",
    f"""SELECT a.model, a.built_at, a.v AS duration_ms, a.med AS median, round(a.z, 2) AS z, round(a.ratio, 2) AS ratio FROM {_z("duration_ms", _BUILDS)} a
        JOIN {_z("(duration_ms / (rows_in / 1000))", _BUILDS)} b ON a.model = b.model AND a.built_at = b.built_at WHERE a.z >= 2 AND a.ratio >= 1.2 AND a.v - a.med >= 50 AND b.z >= 2 AND b.ratio >= 1.2""",
)
def _(spark, d):
    return history.regressions(_builds(spark, d), threshold=2.0, ratio=1.2, delta_ms=50)


@query(
    "incremental_candidate",
    f"""WITH c AS (SELECT model, built_at, sum(rows_in) OVER (PARTITION BY model ORDER BY built_at)::BIGINT AS rows_out FROM {_BUILDS}), s AS (SELECT *, lag(rows_out) OVER (PARTITION BY model ORDER BY built_at) AS b FROM c)
        SELECT model, count(*) AS builds, arg_max(rows_out, built_at) AS rows, round(avg((rows_out - b) / b), 6) AS mean_growth FROM s GROUP BY model HAVING count(*) >= 3 AND avg((rows_out - b) / b) BETWEEN 0 AND 0.2""",
)
def _(spark, d):
    w = Window.partitionBy("model").orderBy("built_at").rowsBetween(Window.unboundedPreceding, 0)
    builds = _builds(spark, d).select("model", "built_at", F.sum("rows_in").over(w).alias("rows_out"))
    return history.incremental_candidates(builds).withColumn("mean_growth", F.round("mean_growth", 6))


_LOG = "(SELECT date_trunc('month', ts)::TIMESTAMP AS run_id, event_type AS model, CASE WHEN value > 90 THEN 'failed' ELSE 'success' END AS status, value AS duration_ms, ts AS started_at FROM events)"


def _log(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select(
        F.date_trunc("month", "ts").cast("timestamp_ntz").alias("run_id"), F.col("event_type").alias("model"), F.when(F.col("value") > 90, "failed").otherwise("success").alias("status"), F.col("value").alias("duration_ms"), F.col("ts").alias("started_at")
    )


@query("run_metrics", f"SELECT status, count(*) AS n, round(avg(duration_ms), 3) AS mean_ms FROM {_LOG} WHERE run_id = (SELECT max(run_id) FROM {_LOG}) GROUP BY status")
def _(spark, d):
    return history.run_metrics(_log(spark, d))[0]


@query("run_metrics_slowest", f"SELECT model, round(avg(duration_ms), 3) AS mean_ms FROM {_LOG} GROUP BY model ORDER BY 2 DESC, 1 LIMIT 10")
def _(spark, d):
    return history.run_metrics(_log(spark, d))[1]
