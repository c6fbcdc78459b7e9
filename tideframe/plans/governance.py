"""Masks, row policies, metrics and dashboard filters over the shared tables."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideframe.functions import masks
from tideframe.operators import govern, metrics
from tideframe.operators.govern import Mask, RowPolicy, Viewer
from tideframe.operators.metrics import Metric
from tideframe.plans.registry import query, table


def _contacts(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    return table(spark, d, "customer").select(
        "c_custkey", "c_nationkey", "c_acctbal", "c_mktsegment", F.when(k % 10 != 0, F.concat(F.lower("c_mktsegment"), k.cast("string"), F.lit("@mail.org"))).alias("email"), F.concat(F.lit("+47 99 88 "), F.lpad(k.cast("string"), 6, "0")).alias("phone"),
        F.concat(F.lit("4242-4242-"), F.lpad(k.cast("string"), 8, "0")).alias("card"), F.concat(F.lit("10.20."), (k % 256).cast("string"), F.lit("."), (k % 7).cast("string")).alias("ip"), F.date_add(F.lit("2000-01-01").cast("date"), (k % 5000).cast("int")).alias("born"), "c_name",
    )


_CON = """(SELECT c_custkey, c_nationkey, c_acctbal, c_mktsegment, CASE WHEN c_custkey % 10 <> 0 THEN lower(c_mktsegment) || c_custkey || '@mail.org' END AS email, '+47 99 88 ' || lpad(c_custkey::VARCHAR, 6, '0') AS phone,
 '4242-4242-' || lpad(c_custkey::VARCHAR, 8, '0') AS card, '10.20.' || (c_custkey % 256) || '.' || (c_custkey % 7) AS ip, DATE '2000-01-01' + (c_custkey % 5000)::INT AS born, c_name FROM customer)"""


def _share(value: str, key: str) -> str:
    return f"(('0x' || left(sha256({value} || '{key}'), 13))::BIGINT / 4503599627370496.0::DOUBLE)"



_MASKS = {
    "mask_hash": ("c_name", "hash", {}, "left(sha256(c_name), 8)"),
    "mask_redact": ("c_name", "redact", {}, "'***'"),
    "mask_null": ("c_name", "null", {}, "NULL::VARCHAR"),
    "mask_partial": ("email", "partial", {"show_first": 2, "show_last": 3}, "left(email, 2) || repeat('*', greatest(length(email) - 5, 0)) || right(email, 3)"),
    "mask_email": ("email", "email", {}, "CASE WHEN email LIKE '%@%' THEN '***' || substring(email, position('@' IN email)) ELSE '***' END"),
    "mask_phone": ("phone", "phone", {}, "'***' || right(phone, 4)"),
    "mask_credit_card": ("card", "credit_card", {}, "repeat('*', greatest(length(regexp_replace(card, '[^0-9]', '', 'g')) - 4, 0)) || right(regexp_replace(card, '[^0-9]', '', 'g'), 4)"),
    "mask_first_initial": ("c_name", "first_initial", {}, "left(c_name, 1) || '.'"),
    "mask_ip_address": ("ip", "ip_address", {"keep_octets": 2}, "split_part(ip, '.', 1) || '.' || split_part(ip, '.', 2) || '.x.x'"),
    "mask_range": ("c_acctbal", "range", {"bucket_size": 1000}, "(floor(c_acctbal / 1000) * 1000)::BIGINT || '-' || ((floor(c_acctbal / 1000) * 1000)::BIGINT + 1000)"),
    "mask_noise": ("c_custkey", "noise", {"percentage": 10.0, "seed_key": "k"}, f"c_custkey * (0.9::DOUBLE + 0.2::DOUBLE * {_share('c_custkey::VARCHAR', 'k')})"),
    "mask_date_shift": ("born", "date_shift", {"max_days": 30, "seed_key": "k"}, f"born - 30 + floor({_share('born::VARCHAR', 'k')} * 61)::INT"),
    "mask_truncate": ("c_mktsegment", "truncate", {"length": 3}, "CASE WHEN length(c_mktsegment) <= 3 THEN c_mktsegment ELSE left(c_mktsegment, 3) || '...' END"),
    "mask_consistent_hash": ("email", "consistent_hash", {"prefix": "u_", "length": 10}, "'u_' || left(sha256(email), 10)"),
}

for _name, (_column, _method, _config, _sql) in _MASKS.items():
    query(_name, f"SELECT c_custkey AS id, {_sql} AS masked FROM {_CON}")(
        lambda spark, d, c=_column, m=_method, o=_config: _contacts(spark, d).select(F.col("c_custkey").alias("id"), masks.mask(F.col(c), m, o).alias("masked"))
    )


@query(
    "stdlib_pii",
    f"""SELECT c_custkey, '+** ** ** ' || repeat('*', length(phone) - 14) || right(phone, 4) AS phone, left(c_name, 4) || repeat('*', length(c_name) - 4) AS national_id,
        split_part(ip, '.', 1) || '.' || split_part(ip, '.', 2) || '.' || split_part(ip, '.', 3) || '.0' AS ip, left(sha256('salt:' || email), 16) AS key FROM {_CON}""",
)
def _(spark, d):
    return _contacts(spark, d).select("c_custkey", masks.shape_digits(F.col("phone")).alias("phone"), masks.national_id(F.col("c_name")).alias("national_id"), masks.ip_network(F.col("ip")).alias("ip"), masks.salted_hash(F.col("email"), "salt").alias("key"))


_POLICY_MASKS = [Mask("email", "email"), Mask("c_name", "partial", {"show_first": 1}, exempt=("admin", "steward")), Mask("phone", "phone", condition="c_nationkey = 3")]


@query(
    "apply_masks",
    f"""SELECT c_custkey, CASE WHEN email LIKE '%@%' THEN '***' || substring(email, position('@' IN email)) ELSE '***' END AS email, left(c_name, 1) || repeat('*', length(c_name) - 1) AS c_name,
        CASE WHEN c_nationkey = 3 THEN '***' || right(phone, 4) ELSE phone END AS phone FROM {_CON}""",
)
def _(spark, d):
    return govern.apply_masks(_contacts(spark, d), _POLICY_MASKS, "analyst").select("c_custkey", "email", "c_name", "phone")


@query("apply_row_policy", f"SELECT c_custkey, c_mktsegment FROM {_CON} WHERE c_nationkey = 7 AND c_mktsegment IN ('BUILDING', 'MACHINERY') AND c_acctbal > 0")
def _(spark, d):
    policies = [
        RowPolicy("c_nationkey = attr('Nation')"), RowPolicy("array_contains(attr_list('segments'), c_mktsegment)"), RowPolicy("c_acctbal > 0", ("analyst",)), RowPolicy("false", ("guest",)),
        RowPolicy("false", users=("lee",)), RowPolicy("false", exempt_users=("kim",)), RowPolicy("false", exempt_roles=("analyst",)), RowPolicy("false", enabled=False), RowPolicy("array_contains(attr_list('nation'), cast(c_nationkey as string))"),
        RowPolicy("c_nationkey = 7", users=("kim",)),
    ]
    viewer = Viewer("kim", "analyst", {"nation": 7, "Segments": ["BUILDING", "MACHINERY"]})
    return govern.apply_row_policies(_contacts(spark, d), policies, viewer).select("c_custkey", "c_mktsegment")


@query("governed_read", f"SELECT '***' AS c_name, count(*) AS n FROM {_CON} WHERE c_name LIKE '%1' GROUP BY 1")
def _(spark, d):
    seen = govern.governed(_contacts(spark, d), Viewer("kim", "analyst"), [RowPolicy("c_name like '%1'")], [Mask("c_name", "redact")])
    return seen.groupBy("c_name").agg(F.count("*").alias("n"))


@query("strongest_mask", "SELECT n_name AS derived, CASE WHEN n_regionkey > 0 THEN 'hash' ELSE 'email' END AS method, CASE WHEN n_regionkey > 0 THEN ['admin'] ELSE ['admin', 'steward'] END AS exempt FROM nation")
def _(spark, d):
    n = table(spark, d, "nation")
    edges = n.select(F.col("n_name").alias("derived"), F.lit("mail").alias("source")).union(n.filter("n_regionkey > 0").select("n_name", F.lit("name")))
    rows = spark.createDataFrame([("mail", "email", ["admin", "steward"]), ("name", "hash", ["admin", "auditor"])], "source string, method string, exempt array<string>")
    return govern.strongest_mask(edges, rows)


# a lineage of columns, one for each customer: each derives from two earlier ones, which meet again further up
_LINKS = "(SELECT DISTINCT source, c_custkey AS derived FROM (SELECT c_custkey, c_custkey // 2 AS source FROM customer UNION ALL SELECT c_custkey, c_custkey // 3 FROM customer) WHERE source > 0)"
_MASKED = "(SELECT c_custkey AS node, CASE c_custkey % 3 WHEN 0 THEN 'email' WHEN 1 THEN 'hash' ELSE 'noise' END AS method, CASE WHEN c_custkey % 2 = 0 THEN ['admin', 'steward'] ELSE ['admin', 'auditor'] END AS exempt FROM customer WHERE c_custkey % 7 = 3)"
_OPEN = "(SELECT c_custkey AS node FROM customer WHERE c_custkey % 11 = 5 AND c_custkey % 7 <> 3)"


def _lineage(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    c = table(spark, d, "customer").select("c_custkey")
    links = c.select(F.expr("c_custkey div 2").alias("source"), F.col("c_custkey").alias("derived")).union(c.selectExpr("c_custkey div 3", "c_custkey")).filter("source > 0")
    method = F.element_at(F.array(F.lit("email"), F.lit("hash"), F.lit("noise")), (F.col("c_custkey") % 3 + 1).cast("int"))
    exempt = F.when(F.col("c_custkey") % 2 == 0, F.array(F.lit("admin"), F.lit("steward"))).otherwise(F.array(F.lit("admin"), F.lit("auditor")))
    masks = c.filter("c_custkey % 7 = 3").select(F.col("c_custkey").alias("source"), method.alias("method"), exempt.alias("exempt"))
    return links, masks, c.filter("c_custkey % 11 = 5 and c_custkey % 7 <> 3").withColumnRenamed("c_custkey", "node")


_REACHED = f"""WITH RECURSIVE e AS {_LINKS}, m AS {_MASKED}, o AS {_OPEN},
r(node, origin) AS (SELECT node, node FROM m UNION SELECT e.derived, r.origin FROM r JOIN e ON e.source = r.node WHERE e.derived NOT IN (SELECT node FROM m) AND e.derived NOT IN (SELECT node FROM o)),
j AS (SELECT r.node, m.* EXCLUDE (node) FROM r JOIN m ON m.node = r.origin WHERE r.node NOT IN (SELECT node FROM m)),
n AS (SELECT node, count(*) AS n FROM j GROUP BY node),
x AS (SELECT node, role, count(*) AS k FROM (SELECT node, unnest(exempt) AS role FROM j) GROUP BY ALL)
SELECT n.node AS derived, min_by(method, CASE method WHEN 'hash' THEN 1 WHEN 'email' THEN 2 ELSE 3 END) AS method, (SELECT list(role ORDER BY role) FROM x WHERE x.node = n.node AND k = n.n) AS exempt FROM n JOIN j USING (node) GROUP BY n.node, n.n"""


@query("mask_closure", _REACHED)
def _(spark, d):
    """Masks inherited over any number of steps, through diamonds, up to columns that have their own or are declassified."""
    return govern.strongest_mask(*_lineage(spark, d))


@query(
    "pii_closure",
    f"""WITH RECURSIVE e AS {_LINKS}, o AS {_OPEN}, p AS (SELECT c_custkey AS node, c_mktsegment AS class FROM customer WHERE c_custkey % 13 = 2),
    r(node, class) AS (SELECT * FROM p UNION SELECT e.derived, r.class FROM r JOIN e ON e.source = r.node WHERE e.derived NOT IN (SELECT node FROM p) AND e.derived NOT IN (SELECT node FROM o))
    SELECT 'customer' AS table_name, node::VARCHAR AS column_name, min(class) AS class FROM r WHERE node % 7 <> 3 GROUP BY node""",
)
def _(spark, d):
    """Columns without a mask that are classified or derive from one that is."""
    links, masks, open_ = _lineage(spark, d)
    known = table(spark, d, "customer").filter("c_custkey % 13 = 2").select(F.col("c_custkey").alias("node"), F.col("c_mktsegment").alias("class"))
    name = lambda df, c: df.select(F.lit("customer").alias("table_name"), F.col(c).cast("string").alias("column_name"), *(["class"] if "class" in df.columns else []))
    return govern.pii_report(name(govern.inherited_classes(links, known, open_), "node"), name(masks, "source"))


@query("pii_report", "SELECT 'customer' AS table_name, n_name AS column_name, 'name' AS class FROM nation WHERE n_regionkey <> 1")
def _(spark, d):
    n = table(spark, d, "nation").select(F.lit("customer").alias("table_name"), F.col("n_name").alias("column_name"), F.lit("name").alias("class"), "n_regionkey")
    return govern.pii_report(n.drop("n_regionkey"), n.filter("n_regionkey = 1").select("table_name", "column_name"))


REVENUE = Metric("revenue", "round(sum(o_totalprice), 2)", ("o_orderstatus", "o_orderpriority"), "o_orderdate", (("o_totalprice", ">", 1000),))
ORDERS = Metric("orders", "count(*)", ("o_orderstatus", "o_orderpriority"), "o_orderdate")


@query(
    "metric_query",
    """SELECT date_trunc('month', o_orderdate)::TIMESTAMP AS month, o_orderstatus, round(sum(o_totalprice), 2) AS revenue FROM orders
       WHERE o_totalprice > 1000 AND o_orderdate >= TIMESTAMP '1995-01-01' AND o_orderdate < TIMESTAMP '1996-01-01' AND o_orderpriority IN ('1-URGENT', '2-HIGH') GROUP BY 1, 2""",
)
def _(spark, d):
    return metrics.metric_query(table(spark, d, "orders"), REVENUE, ["o_orderstatus"], "month", "1995-01-01", "1996-01-01", [("o_orderpriority", "in", ["1-URGENT", "2-HIGH", None])])


@query("metric_filter", "SELECT count(*) AS orders FROM orders WHERE o_orderstatus IS NOT NULL AND o_orderpriority NOT IN ('5-LOW') AND o_orderstatus != 'P' AND o_orderdate >= TIMESTAMP '1996-01-01'")
def _(spark, d):
    return metrics.metric_query(table(spark, d, "orders"), ORDERS, where=[("o_orderstatus", "!=", None), ("o_orderpriority", "not in", ["5-LOW", None]), ("o_orderstatus", "!=", "P"), ("o_orderdate", ">=", datetime(1996, 1, 1))])


@query("metric_order_limit", "SELECT o_orderpriority, round(sum(o_totalprice), 2) AS revenue FROM orders WHERE o_totalprice > 1000 GROUP BY 1 ORDER BY 2 DESC LIMIT 3")
def _(spark, d):
    return metrics.metric_query(table(spark, d, "orders"), REVENUE, ["o_orderpriority"], order_by=[("revenue", True)], limit=3)


@query(
    "multi_metric",
    "SELECT o_orderstatus, a.revenue, b.orders FROM (SELECT o_orderstatus, round(sum(o_totalprice), 2) AS revenue FROM orders WHERE o_totalprice > 1000 GROUP BY 1) a FULL JOIN (SELECT o_orderstatus, count(*) AS orders FROM orders GROUP BY 1) b USING (o_orderstatus)",
)
def _(spark, d):
    o = table(spark, d, "orders")
    return metrics.multi_metric([(o, REVENUE), (o, ORDERS)], ["o_orderstatus"])


@query("kpi_value", "SELECT round(sum(o_totalprice), 2) AS value FROM orders WHERE o_totalprice > 1000")
def _(spark, d):
    return metrics.kpi(metrics.metric_query(table(spark, d, "orders"), REVENUE))


@query("dashboard_freshness", "SELECT min(a) AS oldest, max(a) AS newest FROM (SELECT event_type, max(ts) AS a FROM events WHERE event_type IN (SELECT DISTINCT event_type FROM events ORDER BY 1 LIMIT 2) GROUP BY 1)")
def _(spark, d):
    state = table(spark, d, "events").select(F.col("event_type").alias("model"), F.col("ts").alias("built_at"))
    two = [r[0] for r in state.select("model").distinct().orderBy("model").limit(2).collect()]
    return metrics.dashboard_freshness(state, two)


@query(
    "widget_filter",
    """SELECT o_orderpriority, count(*) AS n FROM orders WHERE o_orderstatus IN ('F', 'O') AND o_orderdate >= TIMESTAMP '1995-03-01' AND o_orderdate < TIMESTAMP '1996-04-01' AND o_totalprice BETWEEN 1000 AND 250000
       AND o_orderpriority ILIKE '%i%' GROUP BY 1""",
)
def _(spark, d):
    values = {"o_orderstatus": ["F", "O"], "o_orderdate": {"from": "1995-03-01", "to": "1996-03-31"}, "o_totalprice": {"from": 1000, "to": 250000}, "o_orderpriority": "i", "o_custkey": None}
    kinds = {"o_orderstatus": "multi_select", "o_orderdate": "date_range", "o_totalprice": "number_range", "o_orderpriority": "text"}
    return metrics.apply_filters(table(spark, d, "orders"), values, kinds).groupBy("o_orderpriority").agg(F.count("*").alias("n"))
