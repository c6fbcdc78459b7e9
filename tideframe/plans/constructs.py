"""Projections, joins, aggregates, windows, sorts, sets and functions over the shared tables."""

from __future__ import annotations

import datetime as dt

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tideframe.operators import joins, running
from tideframe.operators.keys import spread
from tideframe.plans.registry import query, table

DAY = "1998-09-02"


@query("scan_count", "SELECT count(*) AS n FROM lineitem")
def _(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").agg(F.count("*").alias("n"))


@query("projection", "SELECT o_orderkey, o_totalprice * 2 AS doubled, upper(o_orderpriority) AS priority FROM orders")
def _(spark, d):
    return table(spark, d, "orders").select("o_orderkey", (F.col("o_totalprice") * 2).alias("doubled"), F.upper("o_orderpriority").alias("priority"))


@query("filter", "SELECT o_orderkey, o_custkey FROM orders WHERE o_totalprice > 100000 AND o_orderstatus = 'F' AND o_orderpriority LIKE '1%'")
def _(spark, d):
    return table(spark, d, "orders").filter("o_totalprice > 100000 AND o_orderstatus = 'F' AND o_orderpriority LIKE '1%'").select("o_orderkey", "o_custkey")


@query("case", "SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'debt' WHEN c_acctbal < 5000 THEN 'low' ELSE 'high' END AS band FROM customer")
def _(spark, d):
    b = F.col("c_acctbal")
    return table(spark, d, "customer").select("c_custkey", F.when(b < 0, "debt").when(b < 5000, "low").otherwise("high").alias("band"))


@query("star_exclude", "SELECT * EXCLUDE (c_acctbal) FROM customer")
def _(spark, d):
    return table(spark, d, "customer").drop("c_acctbal")


@query("star_replace", "SELECT * REPLACE (upper(c_mktsegment) AS c_name) FROM customer")
def _(spark, d):
    return table(spark, d, "customer").withColumn("c_name", F.upper("c_mktsegment"))


@query("columns_regex", "SELECT COLUMNS('c_.*key') FROM customer")
def _(spark, d):
    c = table(spark, d, "customer")
    return c.select(c.colRegex("`c_.*key`"))


@query("struct_access", "SELECT event_id, payload.kind AS kind, payload['score'] AS score FROM (SELECT event_id, {'kind': event_type, 'score': value} AS payload FROM events)")
def _(spark, d):
    e = table(spark, d, "events").select("event_id", F.struct(F.col("event_type").alias("kind"), F.col("value").alias("score")).alias("payload"))
    return e.select("event_id", F.col("payload.kind").alias("kind"), F.col("payload")["score"].alias("score"))


_CTE = """
WITH big AS (SELECT o_custkey, o_totalprice FROM orders WHERE o_totalprice > 200000),
     per AS (SELECT o_custkey, count(*) AS n FROM big GROUP BY o_custkey)
SELECT n, count(*) AS customers FROM per GROUP BY n
"""


@query("cte", _CTE)
def _(spark, d):
    table(spark, d, "orders").createOrReplaceTempView("orders")
    return spark.sql(_CTE)


_SUBQUERY = "SELECT seg, n FROM (SELECT c_mktsegment AS seg, count(*) AS n FROM customer GROUP BY c_mktsegment) q WHERE n > 10"


@query("subquery", _SUBQUERY)
def _(spark, d):
    table(spark, d, "customer").createOrReplaceTempView("customer")
    return spark.sql(_SUBQUERY)


_SCALAR = "SELECT c_custkey, (SELECT max(o_totalprice) FROM orders WHERE o_custkey = c_custkey) AS largest FROM customer"


@query("correlated_scalar", _SCALAR)
def _(spark, d):
    table(spark, d, "customer").createOrReplaceTempView("customer")
    table(spark, d, "orders").createOrReplaceTempView("orders")
    return spark.sql(_SCALAR)


@query("where_correlated", "SELECT o_orderkey, o_custkey FROM orders o WHERE o_totalprice = (SELECT max(i.o_totalprice) FROM orders i WHERE i.o_custkey = o.o_custkey LIMIT 1)")
def _(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    top = o.groupBy("o_custkey").agg(F.max("o_totalprice").alias("top"))
    return o.join(top, "o_custkey").filter("o_totalprice = top").select("o_orderkey", "o_custkey")


_RECURSIVE = """
WITH RECURSIVE tree(id, depth) AS (
  SELECT c_custkey, 0 FROM customer WHERE c_custkey = 1
  UNION ALL SELECT c.c_custkey, tree.depth + 1 FROM tree JOIN customer c ON CAST(floor(c.c_custkey / 2) AS BIGINT) = tree.id)
SELECT depth, count(*) AS n, max(id) AS last FROM tree GROUP BY depth
"""


@query("recursive_cte", _RECURSIVE)
def _(spark, d):
    """A hierarchy of customers, level by level."""
    table(spark, d, "customer").createOrReplaceTempView("customer")
    return spark.sql(_RECURSIVE)


_LATERAL = """
SELECT c_custkey, x.n, x.total FROM customer,
LATERAL (SELECT count(*) AS n, coalesce(round(sum(o_totalprice), 2), 0) AS total FROM orders WHERE o_custkey = c_custkey) x
"""


@query("lateral", _LATERAL)
def _(spark, d):
    table(spark, d, "customer").createOrReplaceTempView("customer")
    table(spark, d, "orders").createOrReplaceTempView("orders")
    return spark.sql(_LATERAL)


@query("lateral_series", "SELECT c_custkey, i::BIGINT AS i FROM customer, LATERAL (SELECT unnest(generate_series(1, c_nationkey + 1)) AS i)")
def _(spark, d):
    return table(spark, d, "customer").select("c_custkey", F.explode(F.sequence(F.lit(1).cast("long"), (F.col("c_nationkey") + 1).cast("long"))).alias("i"))


@query("named_params", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O' AND o_totalprice >= 150000")
def _(spark, d):
    table(spark, d, "orders").createOrReplaceTempView("orders")
    return spark.sql("SELECT o_orderkey FROM orders WHERE o_orderstatus = :status AND o_totalprice >= :least", args={"status": "O", "least": 150000})


@query("paged_query", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 50 OFFSET 100")
def _(spark, d):
    return table(spark, d, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").offset(100).limit(50).select("o_orderkey", "o_totalprice")


# ---- joins


@query(
    "join_inner",
    """SELECT c_mktsegment, n_name, count(*) AS n, round(sum(o_totalprice), 2) AS revenue FROM orders
       JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey GROUP BY c_mktsegment, n_name""",
)
def _(spark, d):
    c = table(spark, d, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    n = table(spark, d, "nation").select("n_nationkey", "n_name")
    o = table(spark, d, "orders").select("o_custkey", "o_totalprice")
    joined = o.join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey)
    return joined.groupBy("c_mktsegment", "n_name").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("revenue"))


@query("join_left", "SELECT c_custkey, count(o_orderkey) AS orders FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey")
def _(spark, d):
    o = table(spark, d, "orders").groupBy("o_custkey").agg(F.count("o_orderkey").alias("n"))
    c = table(spark, d, "customer").select("c_custkey")
    return c.join(o, c.c_custkey == o.o_custkey, "left").select("c_custkey", F.coalesce("n", F.lit(0)).alias("orders"))


@query("self_join", "SELECT c.c_custkey, c.c_name, p.c_name AS parent FROM customer c LEFT JOIN customer p ON c.c_custkey // 2 = p.c_custkey")
def _(spark, d):
    c = table(spark, d, "customer").select("c_custkey", "c_name")
    return c.alias("c").join(c.alias("p"), F.expr("c.c_custkey div 2 = p.c_custkey"), "left").select("c.c_custkey", "c.c_name", F.col("p.c_name").alias("parent"))


@query("join_star", "SELECT a.*, b.o_orderkey AS o_orderkey_1, b.o_custkey AS o_custkey_1 FROM (SELECT o_orderkey, o_custkey FROM orders) a JOIN (SELECT o_orderkey, o_custkey FROM orders) b ON a.o_custkey = b.o_orderkey")
def _(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey")
    return joins.star(o, o, F.col("l.o_custkey") == F.col("r.o_orderkey"))


@query(
    "join_full_using",
    """SELECT k, a.n AS customers, b.n AS suppliers FROM (SELECT c_nationkey AS k, count(*) AS n FROM customer WHERE c_acctbal > 9000 GROUP BY 1) a
       FULL OUTER JOIN (SELECT s_nationkey AS k, count(*) AS n FROM supplier WHERE s_acctbal > 5000 GROUP BY 1) b USING (k)""",
)
def _(spark, d):
    a = table(spark, d, "customer").filter("c_acctbal > 9000").groupBy(F.col("c_nationkey").alias("k")).agg(F.count("*").alias("customers"))
    b = table(spark, d, "supplier").filter("s_acctbal > 5000").groupBy(F.col("s_nationkey").alias("k")).agg(F.count("*").alias("suppliers"))
    return a.join(b, "k", "full")


@query("join_cross", "SELECT * FROM (SELECT count(*) AS orders FROM orders) CROSS JOIN (SELECT count(*) AS customers FROM customer)")
def _(spark, d):
    # both sides are single rows
    return table(spark, d, "orders").agg(F.count("*").alias("orders")).crossJoin(table(spark, d, "customer").agg(F.count("*").alias("customers")))


_NULLED = "(SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN NULL ELSE o_orderstatus END AS s FROM orders)"


@query(
    "join_null_safe",
    f"SELECT a.s, a.n, b.m FROM (SELECT s, count(*) AS n FROM {_NULLED} GROUP BY s) a JOIN (SELECT s, max(o_orderkey) AS m FROM {_NULLED} GROUP BY s) b ON a.s IS NOT DISTINCT FROM b.s",
)
def _(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderstatus") != "F", F.col("o_orderstatus")).alias("s"))
    a, b = o.groupBy("s").agg(F.count("*").alias("n")), o.groupBy("s").agg(F.max("o_orderkey").alias("m"))
    return a.alias("l").join(b.alias("r"), joins.null_safe("l", "r", ["s"])).select("l.s", "n", "m")


@query("join_semi", "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)")
def _(spark, d):
    c, o = table(spark, d, "customer").select("c_custkey"), table(spark, d, "orders").filter("o_totalprice > 300000").select("o_custkey")
    return c.join(o, c.c_custkey.eqNullSafe(o.o_custkey), "left_semi")


@query("join_anti", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)")
def _(spark, d):
    c, o = table(spark, d, "customer").select("c_custkey"), table(spark, d, "orders").filter("o_totalprice > 300000").select("o_custkey")
    return c.join(o, c.c_custkey.eqNullSafe(o.o_custkey), "left_anti")


@query(
    "join_asof",
    """WITH l AS (SELECT event_id, user_id, ts FROM events WHERE event_id % 2 = 0), r AS (SELECT user_id, ts AS r_ts, event_id AS r_id FROM events WHERE event_id % 2 = 1)
       SELECT l.event_id, l.user_id, l.ts, max(r.r_ts) AS r_ts, arg_max(r.r_id, (r.r_ts, r.r_id)) AS r_id FROM l LEFT JOIN r ON l.user_id = r.user_id AND r.r_ts <= l.ts GROUP BY ALL""",
)
def _(spark, d):
    e = table(spark, d, "events")
    left = e.filter("event_id % 2 = 0").select("event_id", "user_id", "ts")
    right = e.filter("event_id % 2 = 1").select("user_id", F.col("ts").alias("r_ts"), F.col("event_id").alias("r_id"))
    return joins.asof(left, right, ["user_id"], "ts", "r_ts", ["r_ts", "r_id"], width=7 * 86_400)


@query("join_theta", "SELECT n_name, count(*) AS n FROM customer JOIN nation ON c_nationkey > n_nationkey AND c_custkey % 5 < n_regionkey GROUP BY n_name")
def _(spark, d):
    # a nested-loop join with the fixed list of nations; ranges of two large tables belong in asof
    n = table(spark, d, "nation").select("n_nationkey", "n_regionkey", "n_name")
    cond = (F.col("c_nationkey") > F.col("n_nationkey")) & (F.col("c_custkey") % 5 < F.col("n_regionkey"))
    return table(spark, d, "customer").select("c_custkey", "c_nationkey").join(F.broadcast(n), cond).groupBy("n_name").agg(F.count("*").alias("n"))


@query(
    "join_fanout_check",
    """SELECT a.n AS left_rows, b.n AS right_rows, c.n AS joined_rows, c.n / greatest(a.n, b.n) AS ratio FROM (SELECT count(*) AS n FROM orders) a, (SELECT count(*) AS n FROM lineitem) b,
       (SELECT count(*) AS n FROM orders JOIN lineitem ON l_orderkey = o_orderkey) c""",
)
def _(spark, d):
    return joins.fanout(table(spark, d, "orders").select(F.col("o_orderkey").alias("k")), table(spark, d, "lineitem").select(F.col("l_orderkey").alias("k")), ["k"])


# ---- aggregates


@query(
    "agg_q1",
    f"""SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base_price,
        round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc_price, round(sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)), 2) AS sum_charge,
        round(avg(l_quantity), 6) AS avg_qty, round(avg(l_extendedprice), 6) AS avg_price, count(*) AS count_order
        FROM lineitem WHERE l_shipdate <= TIMESTAMP '{DAY}' GROUP BY l_returnflag, l_linestatus ORDER BY l_returnflag, l_linestatus""",
)
def _(spark, d):
    return (
        table(spark, d, "lineitem")
        .filter(F.col("l_shipdate") <= F.lit(dt.datetime.fromisoformat(DAY)).cast("timestamp_ntz"))
        .groupBy("l_returnflag", "l_linestatus")
        .agg(
            F.sum("l_quantity").alias("sum_qty"),
            F.round(F.sum("l_extendedprice"), 2).alias("sum_base_price"),
            F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("sum_disc_price"),
            F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount")) * (1 + F.col("l_tax"))), 2).alias("sum_charge"),
            F.round(F.avg("l_quantity"), 6).alias("avg_qty"),
            F.round(F.avg("l_extendedprice"), 6).alias("avg_price"),
            F.count("*").alias("count_order"),
        )
        .orderBy("l_returnflag", "l_linestatus")
    )


@query("agg_filtered_scan", "SELECT count(*) AS n, round(sum(l_extendedprice), 2) AS total FROM lineitem WHERE l_shipdate > TIMESTAMP '1997-01-01' AND l_quantity > 30")
def _(spark, d):
    return table(spark, d, "lineitem").filter("l_shipdate > TIMESTAMP_NTZ '1997-01-01' AND l_quantity > 30").agg(F.count("*").alias("n"), F.round(F.sum("l_extendedprice"), 2).alias("total"))


@query("agg_having", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) >= 12")
def _(spark, d):
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n")).filter("n >= 12")


_ALL = "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ALL"


@query("group_by_all", _ALL)
def _(spark, d):
    table(spark, d, "orders").createOrReplaceTempView("orders")
    return spark.sql(_ALL)


@query(
    "conditional_agg",
    "SELECT event_type, count(*) FILTER (WHERE value > 50) AS high, round(sum(CASE WHEN value <= 50 THEN value ELSE 0 END), 2) AS low_sum FROM events GROUP BY event_type",
)
def _(spark, d):
    v = F.col("value")
    return table(spark, d, "events").groupBy("event_type").agg(F.count_if(v > 50).alias("high"), F.round(F.sum(F.when(v <= 50, v).otherwise(0)), 2).alias("low_sum"))


@query("arg_max", "SELECT c_nationkey, arg_max(c_name, (c_acctbal, c_custkey)) AS richest FROM customer GROUP BY c_nationkey")
def _(spark, d):
    return table(spark, d, "customer").groupBy("c_nationkey").agg(F.max_by("c_name", F.struct("c_acctbal", "c_custkey")).alias("richest"))


@query(
    "count_distinct",
    "SELECT count(DISTINCT o_custkey) AS customers, count(DISTINCT (s, o_orderpriority)) AS tuples FROM (SELECT o_custkey, o_orderpriority, CASE WHEN o_orderstatus = 'F' THEN NULL ELSE o_orderstatus END AS s FROM orders)",
)
def _(spark, d):
    o = table(spark, d, "orders").withColumn("s", F.when(F.col("o_orderstatus") != "F", F.col("o_orderstatus")))
    # a struct, since count(distinct a, b) drops rows with a null
    return o.agg(F.count_distinct("o_custkey").alias("customers"), F.count_distinct(F.struct("s", "o_orderpriority")).alias("tuples"))


@query("ordered_list", "SELECT o_custkey, list(o_orderkey ORDER BY o_orderkey) AS keys FROM orders GROUP BY o_custkey")
def _(spark, d):
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.sort_array(F.collect_list("o_orderkey")).alias("keys"))


@query("string_agg", "SELECT o_custkey, string_agg(o_orderpriority, ',' ORDER BY o_orderpriority) AS names FROM orders GROUP BY o_custkey")
def _(spark, d):
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.array_join(F.sort_array(F.collect_list("o_orderpriority")), ",").alias("names"))


@query(
    "pivot",
    "SELECT * FROM (PIVOT (SELECT o_orderpriority, o_orderstatus, o_totalprice FROM orders) ON o_orderstatus IN ('F', 'O', 'P') USING round(sum(o_totalprice), 2) GROUP BY o_orderpriority)",
)
def _(spark, d):
    return table(spark, d, "orders").groupBy("o_orderpriority").pivot("o_orderstatus", ["F", "O", "P"]).agg(F.round(F.sum("o_totalprice"), 2))


@query("unpivot", "UNPIVOT (SELECT l_orderkey, l_linenumber, l_quantity, l_tax FROM lineitem) ON l_quantity, l_tax INTO NAME metric VALUE val")
def _(spark, d):
    return table(spark, d, "lineitem").unpivot(["l_orderkey", "l_linenumber"], ["l_quantity", "l_tax"], "metric", "val")


@query(
    "magnitude_frequency",
    """WITH b AS (SELECT floor(value / 10)::BIGINT * 10 AS bin, count(*) AS n FROM events WHERE value IS NOT NULL GROUP BY 1)
       SELECT bin, n, sum(n) OVER (ORDER BY bin DESC)::BIGINT AS at_least, round(log10(sum(n) OVER (ORDER BY bin DESC)), 6) AS log_n FROM b""",
)
def _(spark, d):
    b = table(spark, d, "events").filter("value IS NOT NULL").groupBy((F.floor(F.col("value") / 10) * 10).alias("bin")).agg(F.count("*").alias("n"))
    # the window runs over the bins, of which there are few, not over the rows
    w = Window.orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, 0)
    return b.withColumn("at_least", F.sum("n").over(w)).withColumn("log_n", F.round(F.log10("at_least"), 6))


# ---- windows


@query("window_rank", "SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders")
def _(spark, d):
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return table(spark, d, "orders").select("o_orderkey", F.row_number().over(w).cast("long").alias("rn"))


@query("window_sum", "SELECT o_orderkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey), 2) AS total FROM orders")
def _(spark, d):
    return table(spark, d, "orders").select("o_orderkey", F.round(F.sum("o_totalprice").over(Window.partitionBy("o_custkey")), 2).alias("total"))


@query("qualify", "SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1")
def _(spark, d):
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey"))
    return table(spark, d, "orders").withColumn("rn", F.row_number().over(w)).filter("rn = 1").select("o_custkey", "o_orderkey")


@query("latest_per_key", "SELECT user_id, max(ts) AS ts, arg_max(event_type, (ts, event_id)) AS event_type FROM events GROUP BY user_id")
def _(spark, d):
    return table(spark, d, "events").groupBy("user_id").agg(F.max("ts").alias("ts"), F.max_by("event_type", F.struct("ts", "event_id")).alias("event_type"))


@query("dup_rank", "SELECT l_returnflag, l_linestatus, l_quantity, count(*) AS copies FROM lineitem GROUP BY ALL")
def _(spark, d):
    # multisets compare by count, so no row needs a rank of its own
    return table(spark, d, "lineitem").groupBy("l_returnflag", "l_linestatus", "l_quantity").agg(F.count("*").alias("copies"))


@query("window_lag", "SELECT event_id, lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS previous FROM events")
def _(spark, d):
    return table(spark, d, "events").select("event_id", F.lag("value").over(Window.partitionBy("user_id").orderBy("ts", "event_id")).alias("previous"))


@query("running_sum", "SELECT event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 4) AS running FROM events")
def _(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return table(spark, d, "events").select("event_id", F.round(F.sum("value").over(w), 4).alias("running"))


@query("window_lag_split", "SELECT event_id, lag(value) OVER (PARTITION BY event_type ORDER BY ts, event_id) AS previous FROM events")
def _(spark, d):
    """Keys of very many rows, which no task has as a whole."""
    return running.previous(table(spark, d, "events").select("event_id", "event_type", "ts", "value"), ["event_type"], ["ts", "event_id"], "value").select("event_id", "previous")


@query("running_sum_split", "SELECT event_id, sum(user_id) OVER (PARTITION BY event_type ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS running FROM events")
def _(spark, d):
    return running.running_sum(table(spark, d, "events").select("event_id", "event_type", "ts", "user_id"), ["event_type"], ["ts", "event_id"], "user_id").select("event_id", "running")


# ---- sorts and sets


@query(
    "top_k",
    """SELECT l_orderkey, o_orderdate, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM customer JOIN orders ON c_custkey = o_custkey
       JOIN lineitem ON l_orderkey = o_orderkey WHERE c_mktsegment = 'BUILDING' AND o_orderdate < TIMESTAMP '1995-03-15' AND l_shipdate > TIMESTAMP '1995-03-15' GROUP BY 1, 2 ORDER BY revenue DESC, o_orderdate, l_orderkey LIMIT 10""",
)
def _(spark, d):
    c = table(spark, d, "customer").filter("c_mktsegment = 'BUILDING'").select("c_custkey")
    o = table(spark, d, "orders").filter("o_orderdate < TIMESTAMP_NTZ '1995-03-15'").select("o_orderkey", "o_custkey", "o_orderdate")
    li = table(spark, d, "lineitem").filter("l_shipdate > TIMESTAMP_NTZ '1995-03-15'").select("l_orderkey", (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("r"))
    j = o.join(c, o.o_custkey == c.c_custkey, "left_semi").join(li, o.o_orderkey == li.l_orderkey)
    return j.groupBy("l_orderkey", "o_orderdate").agg(F.round(F.sum("r"), 2).alias("revenue")).orderBy(F.desc("revenue"), "o_orderdate", "l_orderkey").limit(10)


@query("sample_rows", "SELECT DISTINCT o_orderpriority AS value FROM orders WHERE o_orderpriority IS NOT NULL ORDER BY 1 LIMIT 5")
def _(spark, d):
    o = table(spark, d, "orders").filter("o_orderpriority IS NOT NULL").select(F.col("o_orderpriority").alias("value"))
    return o.distinct().orderBy("value").limit(5)


@query("union_all", "SELECT c_custkey AS k, c_name AS name FROM customer UNION ALL SELECT s_suppkey, s_name FROM supplier")
def _(spark, d):
    return table(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("name")).union(table(spark, d, "supplier").select("s_suppkey", "s_name"))


@query("union_by_name", "SELECT c_custkey AS k, c_name AS name FROM customer UNION ALL BY NAME SELECT s_name AS name, s_acctbal AS balance FROM supplier")
def _(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("name"))
    return c.unionByName(table(spark, d, "supplier").select(F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance")), allowMissingColumns=True)


# ---- functions


@query(
    "fn_string",
    """SELECT c_custkey, left(c_name, 3) AS a, right(c_name, 3) AS b, repeat('*', length(c_mktsegment)) AS c, substring(c_name, 2, 4) AS d, position('#' IN c_name) AS e,
       regexp_replace(c_name, '[^0-9]', '', 'g') AS f, split_part(c_name, '#', 2) AS g, upper(trim(c_mktsegment)) AS h, concat_ws('|', c_name, c_mktsegment) AS i,
       replace(c_name, '0', 'o') AS j, c_mktsegment ILIKE '%build%' AS k FROM customer""",
)
def _(spark, d):
    n, m = F.col("c_name"), F.col("c_mktsegment")
    return table(spark, d, "customer").select(
        "c_custkey", F.left(n, F.lit(3)).alias("a"), F.right(n, F.lit(3)).alias("b"), F.repeat(F.lit("*"), F.length(m)).alias("c"), F.substring(n, 2, 4).alias("d"), F.locate("#", n).cast("long").alias("e"),
        F.regexp_replace(n, "[^0-9]", "").alias("f"), F.split_part(n, F.lit("#"), F.lit(2)).alias("g"), F.upper(F.trim(m)).alias("h"), F.concat_ws("|", n, m).alias("i"), F.replace(n, F.lit("0"), F.lit("o")).alias("j"), m.ilike("%build%").alias("k"),
    )


@query(
    "fn_datetime",
    """SELECT event_id, date_trunc('month', ts)::TIMESTAMP AS m, hour(ts) AS h, ts::DATE AS d, ts + INTERVAL 1 DAY AS next, date_diff('day', TIMESTAMP '2020-01-01', date_trunc('day', ts)) AS days,
       extract(dow FROM ts) AS dow, epoch_ms(event_id * 1000) AS from_ms, floor(extract(epoch FROM ts))::BIGINT AS epoch FROM events""",
)
def _(spark, d):
    ts = F.col("ts")
    return table(spark, d, "events").select(
        "event_id", F.date_trunc("month", ts).cast("timestamp_ntz").alias("m"), F.hour(ts).cast("long").alias("h"), ts.cast("date").alias("d"), (ts + F.expr("INTERVAL 1 DAY")).alias("next"),
        F.expr("timestampdiff(DAY, TIMESTAMP_NTZ '2020-01-01', cast(date_trunc('day', ts) AS timestamp_ntz))").alias("days"), (F.dayofweek(ts) - 1).cast("long").alias("dow"),
        F.timestamp_millis(F.col("event_id") * 1000).cast("timestamp_ntz").alias("from_ms"), F.unix_timestamp(ts.cast("timestamp")).alias("epoch"),
    )


@query("fn_math", "SELECT o_orderkey, floor(o_totalprice)::BIGINT AS a, greatest(o_totalprice, 100000) AS b, round(o_totalprice / 7, 3) AS c, o_orderkey % 10 AS d FROM orders")
def _(spark, d):
    p = F.col("o_totalprice")
    return table(spark, d, "orders").select("o_orderkey", F.floor(p).alias("a"), F.greatest(p, F.lit(100000.0)).alias("b"), F.round(p / 7, 3).alias("c"), (F.col("o_orderkey") % 10).alias("d"))


@query("fn_hash", "SELECT c_custkey, md5(c_name) AS m, sha256(c_name) AS s FROM customer")
def _(spark, d):
    return table(spark, d, "customer").select("c_custkey", F.md5("c_name").alias("m"), F.sha2("c_name", 256).alias("s"))


@query("fn_cast", "SELECT event_id, try_cast(props AS BIGINT) AS n, coalesce(try_cast(event_type AS DOUBLE), -1) AS x, value::BIGINT::VARCHAR AS v FROM (SELECT * REPLACE (floor(value) AS value) FROM events)")
def _(spark, d):
    e = table(spark, d, "events").withColumn("value", F.floor("value"))
    return e.select("event_id", F.col("props").try_cast("long").alias("n"), F.coalesce(F.col("event_type").try_cast("double"), F.lit(-1.0)).alias("x"), F.col("value").cast("string").alias("v"))


@query(
    "fn_json",
    """SELECT event_id, j->>'$.type' AS kind, (j->>'$.n')::BIGINT AS n, k AS item FROM (SELECT event_id, event_type, '{"type":"' || event_type || '","n":' || event_id || ',"items":["a","b"]}' AS j FROM events),
       LATERAL (SELECT unnest(from_json(j->'$.items', '["VARCHAR"]')) AS k)""",
)
def _(spark, d):
    j = F.concat(F.lit('{"type":"'), "event_type", F.lit('","n":'), F.col("event_id").cast("string"), F.lit(',"items":["a","b"]}'))
    e = table(spark, d, "events").select("event_id", j.alias("j")).select("event_id", F.get_json_object("j", "$.type").alias("kind"), F.get_json_object("j", "$.n").cast("long").alias("n"), F.from_json("j", "items array<string>").alias("p"))
    return e.select("event_id", "kind", "n", F.explode("p.items").alias("item"))


@query("fn_array", "SELECT doc_id, unnest(list_distinct(['x', lang, source])) AS tag FROM documents WHERE lang IS NOT NULL AND source IS NOT NULL")
def _(spark, d):
    return table(spark, d, "documents").filter("lang IS NOT NULL AND source IS NOT NULL").select("doc_id", F.explode(F.array_distinct(F.array(F.lit("x"), "lang", "source"))).alias("tag"))


def classify(value: pd.Series) -> pd.Series:
    """A user's scalar function over a batch of values; a null is small."""
    return pd.cut(value, [-float("inf"), 50, 90, float("inf")], right=False, labels=["small", "middle", "great"]).astype(object).fillna("small")


@query("udf_scalar", "SELECT event_id, CASE WHEN value >= 90 THEN 'great' WHEN value >= 50 THEN 'middle' ELSE 'small' END AS class FROM events")
def _(spark, d):
    """Registered by name and called from SQL; values reach Python in Arrow batches."""
    spark.udf.register("classify", F.pandas_udf(classify, "string"))
    table(spark, d, "events").createOrReplaceTempView("events")
    return spark.sql("SELECT event_id, classify(value) AS class FROM events")


@query("udf_sql", "SELECT o_orderkey, round(o_totalprice * 1.2, 2) AS gross FROM orders")
def _(spark, d):
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION with_tax(net DOUBLE) RETURNS DOUBLE RETURN round(net * 1.2D, 2)")
    table(spark, d, "orders").createOrReplaceTempView("orders")
    return spark.sql("SELECT o_orderkey, with_tax(o_totalprice) AS gross FROM orders")


@query("udtf", "SELECT n_nationkey, p::BIGINT AS part, substring(n_name, p, 1) AS letter FROM (SELECT c_custkey AS n_nationkey, c_mktsegment AS n_name, unnest(range(1, length(c_mktsegment) + 1)) AS p FROM customer)")
def _(spark, d):
    spark.sql(
        "CREATE OR REPLACE TEMPORARY FUNCTION letters(word STRING) RETURNS TABLE (part BIGINT, letter STRING) "
        "RETURN SELECT p.pos + 1L, substring(word, p.pos + 1, 1) FROM (SELECT posexplode(sequence(1, length(word))) AS (pos, n)) p"
    )
    table(spark, d, "customer").createOrReplaceTempView("customer")
    return spark.sql("SELECT c_custkey AS n_nationkey, l.part, l.letter FROM customer, LATERAL letters(c_mktsegment) l")


@F.udtf(returnType="part bigint, letter string", useArrow=True)
class Letters:
    """A user's table function: the letters of a word with their places."""

    def eval(self, word: str):
        for i, c in enumerate(word or "", 1):
            yield i, c


@query("udtf_python", "SELECT p_partkey, p::BIGINT AS part, substring(p_brand, p, 1) AS letter FROM (SELECT p_partkey, p_brand, unnest(range(1, length(p_brand) + 1)) AS p FROM part)")
def _(spark, d):
    spark.udtf.register("python_letters", Letters)
    # Python takes its time for each row, so tasks are small
    spread(table(spark, d, "part").select("p_partkey", "p_brand"), ["p_partkey"], 20_000).createOrReplaceTempView("part")
    return spark.sql("SELECT p_partkey, l.part, l.letter FROM part, LATERAL python_letters(p_brand) l")
