"""Queries for the relational operators: projections, joins, aggregates, windows, sorts, sets, functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import timeparts as tp
from tidemark.functions import vectors
from tidemark.functions.scalars import (
    flag, joined, map_values, min_max, number, overlap, ratio, surrogate_key, words,
)
from tidemark.operators import aggregates as agg
from tidemark.operators import joins, keyed, ordered
from tidemark.operators.conform import conform, production_view
from tidemark.operators.gram import pair_sums
from tidemark.operators.links import best_shared
from tidemark.plans import market, payments
from tidemark.sources.tables import source
from tidemark.workload import adapters as ad
from tidemark.workload.registry import query, rounded as R


def t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return source(spark, sf, name)


# --- projections and predicates ----------------------------------------------


@query("p1_conform", """
SELECT CAST(o_orderkey AS VARCHAR) AS order_id, CAST(o_orderdate AS DATE) AS order_day,
       CAST(floor(o_totalprice) AS BIGINT) AS amount, o_orderstatus AS status FROM orders""")
def p1(spark, sf):
    return conform(t(spark, sf, "orders"), {
        "order_id": ("o_orderkey", "string"), "order_day": ("o_orderdate", "date"),
        "amount": F.floor("o_totalprice").cast("bigint"), "status": "o_orderstatus",
    })


@query("p2_computed_columns", """
SELECT l_orderkey, l_linenumber, l_partkey, l_quantity * l_linenumber AS product,
       l_linenumber * 60 + l_suppkey AS clock, l_quantity - l_linenumber AS difference FROM lineitem""")
def p2(spark, sf):
    q, n = F.col("l_quantity"), F.col("l_linenumber")
    return t(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", (q * n).alias("product"),
        (n * 60 + F.col("l_suppkey")).alias("clock"), (q - n).alias("difference"))


@query("p3_flag", """
SELECT event_id, CASE WHEN k % 3 = 2 THEN NULL ELSE k % 3 = 1 END AS is_one, k > 50 AS is_high FROM ev""")
def p3(spark, sf):
    raw = F.when(F.col("k") % 3 != 2, F.col("k") % 3)
    return ad.ev(spark, sf).select("event_id", flag(raw).alias("is_one"), (F.col("k") > 50).alias("is_high"))


@query("p4_case", """
SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'debt' WHEN c_acctbal < 5000 THEN 'small' ELSE 'large' END AS class
FROM customer""")
def p4(spark, sf):
    bal = F.col("c_acctbal")
    return t(spark, sf, "customer").select(
        "c_custkey", F.when(bal < 0, "debt").when(bal < 5000, "small").otherwise("large").alias("class"))


@query("p5_map_values", """
SELECT o_orderkey, CASE WHEN o_orderpriority IN ('1-URGENT','2-HIGH') THEN 'fast'
       WHEN o_orderpriority IN ('5-LOW') THEN 'slow' ELSE 'unknown' END AS pace FROM orders""")
def p5(spark, sf):
    pace = map_values("o_orderpriority", {"fast": ["1-URGENT", "2-HIGH"], "slow": ["5-LOW"]}, "unknown")
    return t(spark, sf, "orders").select("o_orderkey", pace.alias("pace"))


@query("p6_partial_date", """
SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN date_trunc('year', o_orderdate)::DATE
       WHEN 1 THEN date_trunc('month', o_orderdate)::DATE ELSE o_orderdate::DATE END AS day FROM orders""")
def p6(spark, sf):
    text = F.substring(F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit(1),
                       F.when(F.col("o_orderkey") % 3 == 0, 4).when(F.col("o_orderkey") % 3 == 1, 7).otherwise(10))
    return t(spark, sf, "orders").select("o_orderkey", tp.partial_date(text).alias("day"))


@query("p7_safe_cast", """
SELECT doc_id, TRY_CAST(CASE WHEN doc_id % 3 = 0 THEN lang ELSE CAST(n_chars AS VARCHAR) END AS DOUBLE) AS n
FROM documents""")
def p7(spark, sf):
    text = F.when(F.col("doc_id") % 3 == 0, F.col("lang")).otherwise(F.col("n_chars").cast("string"))
    return t(spark, sf, "documents").select("doc_id", number(text).alias("n"))


@query("p8_filters", """
SELECT event_id, event_type, value FROM ev WHERE event_type IN ('click','view') AND value > 10 AND value <= 200
AND k <> 7 AND props IS NOT NULL""")
def p8(spark, sf):
    rows = ad.ev(spark, sf).filter(
        F.col("event_type").isin("click", "view") & (F.col("value") > 10) & (F.col("value") <= 200)
        & F.col("props").isNotNull() & (F.col("k") != 7))
    return rows.select("event_id", "event_type", "value")


@query("p9_null_handling", f"""
SELECT event_id, {R("CAST(value AS DOUBLE) / nullif(k % 10, 0)", 6)} AS ratio, coalesce(nullif(k % 10, 0), -1) AS filled FROM ev""")
def p9(spark, sf):
    rest = F.col("k") % 10
    return ad.ev(spark, sf).select(
        "event_id", ratio("value", rest, 6).alias("ratio"),
        F.coalesce(F.nullif(rest, F.lit(0)), F.lit(-1)).alias("filled"))


@query("p10_all_but", "SELECT * EXCLUDE (c_name, c_acctbal) FROM customer")
def p10(spark, sf):
    return t(spark, sf, "customer").drop("c_name", "c_acctbal")


@query("p11_privacy", """
SELECT event_id, event_at, event_type, anonymous_id, page_type, product_id, category_id, brand_line, search_query,
       filter_size, filter_colour, order_id, quantity, unit_price, is_marketplace, seller_id, device_type, traffic_source
FROM clicks""")
def p11(spark, sf):
    from tidemark.plans.gold import PRIVATE
    return production_view(ad.raw_clicks(spark, sf), PRIVATE)


@query("p12_parameters", """
SELECT event_type, count(*) AS n FROM events WHERE ts < TIMESTAMP '2024-01-15 12:00:00' AND value > 20 GROUP BY 1""")
def p12(spark, sf):
    return spark.sql(
        "SELECT event_type, count(*) AS n FROM {events} "
        "WHERE ts < to_timestamp_ntz(:cutoff) AND value > :least GROUP BY event_type",
        args={"cutoff": "2024-01-15 12:00:00", "least": 20.0}, events=t(spark, sf, "events"))


# --- joins -------------------------------------------------------------------


@query("j1_left", """
SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_orderstatus = 'P'""")
def j1(spark, sf):
    orders = t(spark, sf, "orders").filter("o_orderstatus = 'P'")
    return t(spark, sf, "customer").join(orders, F.col("c_custkey") == F.col("o_custkey"), "left").select(
        "c_custkey", "o_orderkey")


@query("j2_inner", "SELECT o_orderkey, c_mktsegment FROM orders JOIN customer ON o_custkey = c_custkey")
def j2(spark, sf):
    return t(spark, sf, "orders").join(
        t(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_mktsegment")


@query("j3_composite", """
SELECT a.l_partkey, a.l_suppkey, a.qty, b.n FROM
 (SELECT l_partkey, l_suppkey, sum(l_quantity) AS qty FROM lineitem WHERE l_linestatus = 'O' GROUP BY ALL) a
 LEFT JOIN (SELECT l_partkey, l_suppkey, count(*) AS n FROM lineitem WHERE l_linestatus = 'F' GROUP BY ALL) b
 USING (l_partkey, l_suppkey)""")
def j3(spark, sf):
    line, keys = t(spark, sf, "lineitem"), ["l_partkey", "l_suppkey"]
    a = line.filter("l_linestatus = 'O'").groupBy(*keys).agg(F.sum("l_quantity").alias("qty"))
    b = line.filter("l_linestatus = 'F'").groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return a.join(b, keys, "left")


@query("j4_full_outer", """
SELECT coalesce(a.c, b.c) AS c, n_orders, n_users FROM
 (SELECT o_custkey AS c, count(*) AS n_orders FROM orders WHERE o_orderstatus = 'P' GROUP BY 1) a
 FULL JOIN (SELECT user_id AS c, count(*) AS n_users FROM events WHERE event_type = 'signup' GROUP BY 1) b ON a.c = b.c""")
def j4(spark, sf):
    a = t(spark, sf, "orders").filter("o_orderstatus = 'P'").groupBy(F.col("o_custkey").alias("c")).agg(
        F.count(F.lit(1)).alias("n_orders"))
    b = t(spark, sf, "events").filter("event_type = 'signup'").groupBy(F.col("user_id").alias("c")).agg(
        F.count(F.lit(1)).alias("n_users"))
    return joins.outer_merge([a, b], "c")


@query("j5_parent", """
SELECT n.n_name AS name, r.r_name AS parent FROM nation n LEFT JOIN region r ON n_regionkey = r_regionkey
UNION ALL SELECT r_name, NULL FROM region""")
def j5(spark, sf):
    rows = joins.with_parent(
        ad.raw_categories(spark, sf), "category_id", "parent_category_id", "category_name", "parent")
    return rows.select(F.col("category_name").alias("name"), "parent")


@query("j6_anti", """
SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000)""")
def j6(spark, sf):
    big = t(spark, sf, "orders").filter("o_totalprice > 400000").select(F.col("o_custkey").alias("c_custkey"))
    return t(spark, sf, "customer").select("c_custkey").join(big, "c_custkey", "left_anti")


@query("j7_membership", """
SELECT c_custkey, c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000) AS is_big FROM customer""")
def j7(spark, sf):
    big = t(spark, sf, "orders").filter("o_totalprice > 400000").select(F.col("o_custkey").alias("c_custkey"))
    return joins.membership(t(spark, sf, "customer").select("c_custkey"), big, "c_custkey", "is_big")


@query("j8_scalar", """
SELECT o_orderkey, date_diff('day', o_orderdate, (SELECT max(o_orderdate) FROM orders)) AS age FROM orders""")
def j8(spark, sf):
    orders = t(spark, sf, "orders")
    newest = orders.agg(F.max("o_orderdate")).scalar()
    return orders.select("o_orderkey", tp.days_between("o_orderdate", newest).alias("age"))


@query("j9_shared_attribute", """
SELECT source, target, strength FROM (
  SELECT u.source, w.target, count(*) AS strength,
         row_number() OVER (PARTITION BY u.source ORDER BY count(*) DESC, w.target) AS rn
  FROM (SELECT DISTINCT o_custkey AS source, l_partkey % 500 AS key FROM orders JOIN lineitem ON o_orderkey = l_orderkey) u
  JOIN (SELECT DISTINCT l_suppkey AS target, l_partkey % 500 AS key FROM lineitem) w USING (key)
  GROUP BY u.source, w.target) WHERE rn = 1""")
def j9(spark, sf):
    line, orders = t(spark, sf, "lineitem"), t(spark, sf, "orders")
    key = (F.col("l_partkey") % 500).alias("key")
    a = orders.join(line, F.col("o_orderkey") == F.col("l_orderkey")).select(
        F.col("o_custkey").alias("source"), key).distinct()
    b = line.select(F.col("l_suppkey").alias("target"), key).distinct()
    return best_shared(a, b, "source", "target", "key")


@query("j10_extra_predicate", """
SELECT p_partkey, count(l_orderkey) AS n FROM part LEFT JOIN lineitem ON p_partkey = l_partkey
 AND l_quantity > p_size AND l_returnflag = 'R' GROUP BY 1""")
def j10(spark, sf):
    cond = ((F.col("p_partkey") == F.col("l_partkey")) & (F.col("l_quantity") > F.col("p_size"))
            & (F.col("l_returnflag") == "R"))
    joined_rows = t(spark, sf, "part").join(t(spark, sf, "lineitem"), cond, "left")
    return joined_rows.groupBy("p_partkey").agg(F.count("l_orderkey").alias("n"))


@query("j11_within_time", """
SELECT q.payment_id, requested_at, rejected_at FROM requests q LEFT JOIN raw_rejections r
ON q.payment_id = r.payment_id AND rejected_at >= requested_at AND rejected_at <= requested_at + INTERVAL 60 MINUTE""")
def j11(spark, sf):
    req = payments.stage_requests(ad.raw_requests(spark, sf))
    rej = payments.stage_rejections(ad.raw_rejections(spark, sf))
    a, b, cond = joins.within_time(req, rej, "payment_id", "requested_at", "rejected_at", "60 MINUTES")
    return a.join(b, cond, "left").select(
        "a.payment_id", F.col("a.requested_at").cast("timestamp_ntz").alias("requested_at"),
        F.col("b.rejected_at").cast("timestamp_ntz").alias("rejected_at"))


@query("j12_lookup", """
SELECT o_orderkey, n_name, r_name FROM orders JOIN customer ON o_custkey = c_custkey
LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey""")
def j12(spark, sf):
    rows = t(spark, sf, "orders").join(t(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    rows = joins.lookup(rows, t(spark, sf, "nation"), "c_nationkey",
                        {"n_name": "n_name", "n_regionkey": "region"}, "n_nationkey")
    rows = joins.lookup(rows, t(spark, sf, "region"), "region", {"r_name": "r_name"}, "r_regionkey")
    return rows.select("o_orderkey", "n_name", "r_name")


@query("j13_pairs", """
WITH d AS (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem)
SELECT a.l_suppkey AS item_a, b.l_suppkey AS item_b, CAST(count(*) AS DOUBLE) AS dot
FROM d a JOIN d b ON a.l_orderkey = b.l_orderkey AND a.l_suppkey < b.l_suppkey GROUP BY ALL""")
def j13(spark, sf):
    rows = t(spark, sf, "lineitem").select("l_orderkey", "l_suppkey").distinct()
    ones = rows.withColumn("one", F.lit(1.0))
    return pair_sums(ones, "l_orderkey", "l_suppkey", "one", "one")


# --- aggregates --------------------------------------------------------------


@query("a1_group_by", f"""
SELECT l_returnflag, l_linestatus, count(*) AS n, {R("sum(l_quantity)", 2)} AS qty, min(l_extendedprice) AS low,
       max(l_extendedprice) AS high, {R("avg(l_quantity)", 6)} AS mean FROM lineitem GROUP BY ALL""")
def a1(spark, sf):
    return t(spark, sf, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("l_quantity"), 2).alias("qty"),
        F.min("l_extendedprice").alias("low"), F.max("l_extendedprice").alias("high"),
        F.round(F.avg("l_quantity"), 6).alias("mean"))


@query("a2_count_distinct", """
SELECT l_suppkey, count(DISTINCT l_orderkey) AS orders, count(DISTINCT l_partkey) AS parts FROM lineitem GROUP BY 1""")
def a2(spark, sf):
    return t(spark, sf, "lineitem").groupBy("l_suppkey").agg(
        F.count_distinct("l_orderkey").alias("orders"), F.count_distinct("l_partkey").alias("parts"))


@query("a3_conditional", """
SELECT l_shipdate, count(CASE WHEN l_returnflag = 'A' THEN 1 END) AS a, sum(CASE WHEN l_returnflag = 'R' THEN l_quantity ELSE 0 END) AS r
FROM lineitem GROUP BY 1""")
def a3(spark, sf):
    flagged = F.col("l_returnflag")
    return t(spark, sf, "lineitem").groupBy("l_shipdate").agg(
        F.count_if(flagged == "A").alias("a"),
        F.sum(F.when(flagged == "R", F.col("l_quantity")).otherwise(0.0)).alias("r"))


@query("a4_filter", """
SELECT l_suppkey, count(*) FILTER (WHERE l_linestatus = 'O') AS open, sum(l_quantity) FILTER (WHERE l_returnflag = 'N' AND l_quantity > 49) AS kept
FROM lineitem GROUP BY 1""")
def a4(spark, sf):
    rows = t(spark, sf, "lineitem")
    return spark.sql(
        "SELECT l_suppkey, count(*) FILTER (WHERE l_linestatus = 'O') AS open, "
        "sum(l_quantity) FILTER (WHERE l_returnflag = 'N' AND l_quantity > 49) AS kept "
        "FROM {rows} GROUP BY l_suppkey", rows=rows)


@query("a5_pivot", """
SELECT l_orderkey, max(CASE WHEN l_linestatus = 'O' THEN l_quantity END) AS open_qty, max(CASE WHEN l_linestatus = 'O' THEN l_tax END) AS open_tax,
       max(CASE WHEN l_linestatus = 'F' THEN l_quantity END) AS done_qty, max(CASE WHEN l_linestatus = 'F' THEN l_tax END) AS done_tax
FROM lineitem GROUP BY 1""")
def a5(spark, sf):
    cells = agg.pivot_max("l_linestatus", {"open_{}": "O", "done_{}": "F"}, {"qty": "l_quantity", "tax": "l_tax"})
    return t(spark, sf, "lineitem").groupBy("l_orderkey").agg(*cells)


@query("a6_first_last", """
SELECT symbol, date_trunc('day', trade_time) AS day, arg_min(price, trade_time) AS open, arg_max(price, trade_time) AS close
FROM trades GROUP BY ALL""")
def a6(spark, sf):
    at = F.struct("trade_time", "trade_id")
    return ad.raw_trades(spark, sf).groupBy(
        "symbol", F.date_trunc("day", "trade_time").cast("timestamp_ntz").alias("day")).agg(
        F.min_by("price", at).alias("open"), F.max_by("price", at).alias("close"))


@query("a7_mode", """
SELECT l_suppkey, flag FROM (SELECT l_suppkey, l_linenumber AS flag,
  row_number() OVER (PARTITION BY l_suppkey ORDER BY count(*) DESC, l_linenumber) AS rn FROM lineitem GROUP BY l_suppkey, l_linenumber) WHERE rn = 1""")
def a7(spark, sf):
    return keyed.mode_per_key(t(spark, sf, "lineitem"), ["l_suppkey"], "l_linenumber", "flag")


@query("a8_any_true", "SELECT user_id, bool_or(event_type = 'signup' AND value > 150) AS ever FROM events GROUP BY 1")
def a8(spark, sf):
    hit = (F.col("event_type") == "signup") & (F.col("value") > 150)
    return t(spark, sf, "events").groupBy("user_id").agg(F.bool_or(hit).alias("ever"))


@query("a9_any_value", """
SELECT user_id, arg_min(k, event_id) FILTER (WHERE k % 2 = 0) AS k FROM ev GROUP BY 1""")
def a9(spark, sf):
    even = F.when(F.col("k") % 2 == 0, F.col("k"))
    return ad.ev(spark, sf).groupBy("user_id").agg(
        F.min_by(even, F.when(even.isNotNull(), F.col("event_id"))).alias("k"))


@query("a10_weighted_mean", f"""
SELECT l_suppkey, {R("sum(CAST(l_partkey % 11 AS DOUBLE) * l_quantity) / nullif(sum(l_quantity), 0)", 6)} AS mean FROM lineitem GROUP BY 1""")
def a10(spark, sf):
    mean = agg.weighted_mean((F.col("l_partkey") % 11).cast("double"), "l_quantity")
    return t(spark, sf, "lineitem").groupBy("l_suppkey").agg(F.round(mean, 6).alias("mean"))


@query("a11_rollup", """
SELECT symbol, date_trunc('day', trade_time) AS candle_open_time, arg_min(price, trade_time) AS open, max(price) AS high, min(price) AS low,
       arg_max(price, trade_time) AS close, sum(quantity) AS volume, round(sum(notional_value), 2) AS notional_volume, count(*) AS trade_count
FROM trades GROUP BY ALL""")
def a11(spark, sf):
    hours = market.candles(market.stage_trades(ad.raw_trades(spark, sf)), "hour")
    days = market.rollup_candles(hours, "day")
    return days.withColumn("notional_volume", F.round("notional_volume", 2)).withColumn(
        "candle_open_time", F.col("candle_open_time").cast("timestamp_ntz")).withColumn(
        "trade_count", F.col("trade_count").cast("bigint"))


@query("a12_rates", f"""
SELECT l_suppkey, {R("CAST(count(CASE WHEN l_returnflag = 'R' THEN 1 END) AS DOUBLE) / nullif(count(*), 0)", 3)} AS rate FROM lineitem GROUP BY 1""")
def a12(spark, sf):
    return t(spark, sf, "lineitem").groupBy("l_suppkey").agg(
        ratio(F.count_if(F.col("l_returnflag") == "R"), F.count(F.lit(1)), 3).alias("rate"))


@query("a13_distinct", "SELECT DISTINCT l_suppkey, l_returnflag, l_linestatus FROM lineitem")
def a13(spark, sf):
    return t(spark, sf, "lineitem").select("l_suppkey", "l_returnflag", "l_linestatus").distinct()


@query("a14_having", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) > 10")
def a14(spark, sf):
    return t(spark, sf, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n")).filter("n > 10")


@query("a15_ungrouped", "SELECT max(o_orderdate) AS newest, count(*) AS n, min(o_totalprice) AS low FROM orders")
def a15(spark, sf):
    return t(spark, sf, "orders").agg(
        F.max("o_orderdate").alias("newest"), F.count(F.lit(1)).alias("n"), F.min("o_totalprice").alias("low"))


@query("a16_share", f"""
SELECT event_type, count(*) AS n, {R("100.0 * count(*) / sum(count(*)) OVER ()", 1)} AS pct FROM events GROUP BY 1""")
def a16(spark, sf):
    return agg.share_of_total(t(spark, sf, "events"), ["event_type"], "n", "pct")


piece_vec = """
SELECT label, list(round(s / l, 6) ORDER BY i) AS centre FROM (
  SELECT label, i, s, sqrt(sum(s * s) OVER (PARTITION BY label)) AS l FROM (
    SELECT label, i, sum(CAST(x AS DOUBLE) * (1 + vec_id % 3)) AS s FROM (
      SELECT label, vec_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY ALL))
GROUP BY label"""


@query("a17_vector_mean", piece_vec)
def a17(spark, sf):
    weight = 1 + F.col("vec_id") % 3
    out = agg.vector_mean(t(spark, sf, "embeddings"), ["label"], "embedding", weight, 64, "centre")
    return out.withColumn("centre", F.transform("centre", lambda x: F.round(x, 6)))


@query("a18_time_bucket", f"""
SELECT time_bucket(INTERVAL 5 MINUTE, ts) AS bucket, count(*) AS n, {R("sum(value)", 2)} AS total FROM events GROUP BY 1""")
def a18(spark, sf):
    return t(spark, sf, "events").groupBy(tp.bucket_start("ts", 5).alias("bucket")).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("total"))


@query("a18_time_bucket_any_width", f"""
SELECT time_bucket(INTERVAL 7 MINUTE, ts) AS bucket, count(*) AS n, {R("sum(value)", 2)} AS total FROM events GROUP BY 1""")
def a18_any_width(spark, sf):
    return t(spark, sf, "events").groupBy(tp.bucket_start("ts", 7).alias("bucket")).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("total"))


@query("a19_percent_true", f"""
SELECT l_suppkey, {R("100.0::DOUBLE * avg(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END)", 1)} AS pct FROM lineitem GROUP BY 1""")
def a19(spark, sf):
    return t(spark, sf, "lineitem").groupBy("l_suppkey").agg(
        agg.percent_true(F.col("l_returnflag") == "R").alias("pct"))


# --- windows -----------------------------------------------------------------


@query("w1_first_per_key", """
SELECT o_custkey, o_orderkey, o_totalprice FROM orders
QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) = 1""")
def w1(spark, sf):
    best = keyed.first_per_key(t(spark, sf, "orders"), ["o_custkey"], [F.desc("o_totalprice"), F.asc("o_orderkey")])
    return best.select("o_custkey", "o_orderkey", "o_totalprice")


def _null_customers(spark, sf):
    """Orders with a customer group that is null for one in fifty customers."""
    return t(spark, sf, "orders").withColumn("_cust", F.expr("nullif(o_custkey % 50, 7)"))


@query("w2_lag", """
SELECT o_orderkey, lag(o_orderdate) OVER w AS before, coalesce(o_orderdate - lag(o_orderdate) OVER w > INTERVAL 90 DAY, true) AS long_gap
FROM orders WINDOW w AS (PARTITION BY nullif(o_custkey % 50, 7) ORDER BY o_orderdate, o_orderkey)""")
def w2(spark, sf):
    rows = ordered.previous_value(
        _null_customers(spark, sf), ["_cust"], "o_orderdate", ["o_orderdate", "o_orderkey"], "before")
    gap = F.col("o_orderdate") - F.col("before") > F.expr("INTERVAL 90 DAYS")
    return rows.select("o_orderkey", "before", F.coalesce(gap, F.lit(True)).alias("long_gap"))


@query("w3_running_sum", """
SELECT o_orderkey, CAST(sum(CASE WHEN o_orderkey % 3 > 0 THEN CAST(floor(o_totalprice) AS BIGINT) END) OVER (
  PARTITION BY nullif(o_custkey % 50, 7) ORDER BY o_orderdate, o_orderkey
  ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS spent FROM orders""")
def w3(spark, sf):
    rows = _null_customers(spark, sf).withColumn("amount", F.when(F.col("o_orderkey") % 3 > 0, F.floor("o_totalprice")))
    out = ordered.running_total(rows, ["_cust"], "amount", ["o_orderdate", "o_orderkey"], "spent")
    return out.select("o_orderkey", "spent")


@query("w4_lead_validity", """
SELECT o_orderkey, o_orderdate AS valid_from, lead(o_orderdate) OVER w AS valid_to, lead(o_orderdate) OVER w IS NULL AS is_current
FROM orders WINDOW w AS (PARTITION BY nullif(o_custkey % 50, 7) ORDER BY o_orderdate, o_orderkey)""")
def w4(spark, sf):
    rows = ordered.next_value(
        _null_customers(spark, sf), ["_cust"], "o_orderdate", ["o_orderdate", "o_orderkey"], "valid_to")
    return rows.select("o_orderkey", F.col("o_orderdate").alias("valid_from"), "valid_to",
                       F.col("valid_to").isNull().alias("is_current"))


@query("w5_partition_stats", """
SELECT o_custkey, o_orderkey, min(o_orderdate) OVER (PARTITION BY o_custkey) AS first_at, count(*) OVER (PARTITION BY o_custkey) AS n
FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1""")
def w5(spark, sf):
    return t(spark, sf, "orders").groupBy("o_custkey").agg(
        F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("o_orderkey"),
        F.min("o_orderdate").alias("first_at"), F.count(F.lit(1)).alias("n"))


@query("w6_ranks", """
SELECT p_partkey, row_number() OVER (ORDER BY p_size DESC, p_partkey) AS rank_overall,
       row_number() OVER (PARTITION BY p_type ORDER BY p_size DESC, p_partkey) AS rank_in_type FROM part""")
def w6(spark, sf):
    order = [F.desc("p_size"), F.asc("p_partkey")]
    ranked = ordered.rank_rows(t(spark, sf, "part"), order, "rank_overall")
    ranked = ordered.rank_rows(ranked, order, "rank_in_type", within=["p_type"])
    return ranked.select("p_partkey", "rank_overall", "rank_in_type")


@query("w7_deciles", """
SELECT c_custkey, CAST(greatest(1, ceil((rn - 1) * 10.0 / (n - 1))) AS INTEGER) AS decile FROM (
  SELECT c_custkey, row_number() OVER (ORDER BY c_acctbal, c_custkey) AS rn, count(*) OVER () AS n FROM customer)""")
def w7(spark, sf):
    ranked = ordered.rank_rows(t(spark, sf, "customer"), [F.asc("c_acctbal"), F.asc("c_custkey")], "rn")
    return ordered.deciles(ranked, "rn", "decile").select("c_custkey", "decile")


@query("w8_group_size", "SELECT l_orderkey, l_partkey, l_quantity, count(*) OVER (PARTITION BY nullif(l_suppkey % 30, 4)) AS n FROM lineitem")
def w8(spark, sf):
    rows = t(spark, sf, "lineitem").withColumn("_supp", F.expr("nullif(l_suppkey % 30, 4)"))
    return keyed.with_group_size(rows, ["_supp"], "n").select(
        "l_orderkey", "l_partkey", "l_quantity", "n")


# --- sort, limit, sets -------------------------------------------------------


@query("t1_sort", "SELECT c_custkey, c_mktsegment, c_acctbal FROM customer ORDER BY c_mktsegment DESC NULLS LAST, c_acctbal, c_custkey")
def t1(spark, sf):
    return t(spark, sf, "customer").select("c_custkey", "c_mktsegment", "c_acctbal").orderBy(
        F.desc_nulls_last("c_mktsegment"), "c_acctbal", "c_custkey")


@query("t2_null_sentinel", """
SELECT event_id, nullif(k % 20, 0) AS place FROM ev ORDER BY coalesce(nullif(k % 20, 0), 999), event_id""")
def t2(spark, sf):
    from tidemark.plans.media import best_first
    rows = ad.ev(spark, sf).select("event_id", F.nullif(F.col("k") % 20, F.lit(0)).alias("place"))
    return best_first(rows, "place", "event_id")


@query("t3_top_n", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def t3(spark, sf):
    return t(spark, sf, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(25).select("o_orderkey", "o_totalprice")


@query("t4_top_n_per_group", """
SELECT l_suppkey, l_orderkey, l_partkey, l_extendedprice FROM lineitem
QUALIFY row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_partkey) <= 3""")
def t4(spark, sf):
    rows = t(spark, sf, "lineitem").select("l_suppkey", "l_orderkey", "l_partkey", "l_extendedprice")
    return keyed.top_per_key(rows, ["l_suppkey"], [F.desc("l_extendedprice"), "l_orderkey", "l_partkey"], 3)


@query("t5_dedupe_best", """
SELECT p_name, p_partkey, p_size FROM part QUALIFY row_number() OVER (PARTITION BY p_name ORDER BY p_size = 7 DESC, p_retailprice DESC, p_partkey) = 1""")
def t5(spark, sf):
    order = [F.desc(F.col("p_size") == 7), F.desc("p_retailprice"), F.asc("p_partkey")]
    return keyed.first_per_key(t(spark, sf, "part"), ["p_name"], order).select("p_name", "p_partkey", "p_size")


@query("u1_union_all", """
SELECT CAST(c_custkey AS VARCHAR) AS id, c_acctbal AS balance, 'customer' AS channel FROM customer
UNION ALL SELECT CAST(s_suppkey AS VARCHAR), s_acctbal, 'supplier' FROM supplier""")
def u1(spark, sf):
    a = conform(t(spark, sf, "customer"), {"id": ("c_custkey", "string"), "balance": "c_acctbal", "channel": F.lit("customer")})
    b = conform(t(spark, sf, "supplier"), {"id": ("s_suppkey", "string"), "balance": "s_acctbal", "channel": F.lit("supplier")})
    return a.unionByName(b)


@query("u2_set_union", "SELECT c_nationkey AS n, c_mktsegment AS s FROM customer UNION SELECT s_nationkey, 'SUPPLIER' FROM supplier")
def u2(spark, sf):
    a = t(spark, sf, "customer").select(F.col("c_nationkey").alias("n"), F.col("c_mktsegment").alias("s"))
    b = t(spark, sf, "supplier").select(F.col("s_nationkey").alias("n"), F.lit("SUPPLIER").alias("s"))
    return a.union(b).distinct()


@query("u3_difference", """
SELECT DISTINCT l_suppkey, l_partkey FROM lineitem WHERE l_returnflag = 'A'
EXCEPT SELECT l_suppkey, l_partkey FROM lineitem WHERE l_returnflag = 'R'""")
def u3(spark, sf):
    line, keys = t(spark, sf, "lineitem"), ["l_suppkey", "l_partkey"]
    seen = line.filter("l_returnflag = 'R'").select(*keys)
    return line.filter("l_returnflag = 'A'").select(*keys).distinct().join(seen, keys, "left_anti")


# --- functions ---------------------------------------------------------------


@query("f1_concat", "SELECT n_nationkey, n_name || ' (' || CAST(n_regionkey AS VARCHAR) || ')' AS label FROM nation")
def f1(spark, sf):
    label = F.concat("n_name", F.lit(" ("), F.col("n_regionkey").cast("string"), F.lit(")"))
    return t(spark, sf, "nation").select("n_nationkey", label.alias("label"))


@query("f2_pad", """
SELECT p_partkey, lpad(CAST(p_partkey AS VARCHAR), 5, '0') AS padded, right(p_name, 3) AS tail, length(p_name) AS n FROM part""")
def f2(spark, sf):
    return t(spark, sf, "part").select(
        "p_partkey", F.lpad(F.col("p_partkey").cast("string"), 5, "0").alias("padded"),
        F.right("p_name", F.lit(3)).alias("tail"), F.length("p_name").alias("n"))


@query("f3_token_overlap", """
SELECT p_partkey, (CASE WHEN contains(lower(p_name || ' ' || p_type), 'red') THEN 1 ELSE 0 END)
  + (CASE WHEN contains(lower(p_name || ' ' || p_type), 'econ') THEN 1 ELSE 0 END)
  + (CASE WHEN contains(lower(p_name || ' ' || p_type), 'ring') THEN 1 ELSE 0 END) AS hits FROM part""")
def f3(spark, sf):
    text = F.lower(F.concat_ws(" ", "p_name", "p_type"))
    hits = overlap(words(F.lit("Red  ECON ring")), text)
    return t(spark, sf, "part").select("p_partkey", hits.alias("hits"))


@query("f4_like", """
SELECT doc_id, source LIKE 'src1%' AS starts, text ILIKE '%THE%' AS has_the FROM documents""")
def f4(spark, sf):
    return t(spark, sf, "documents").select(
        "doc_id", F.col("source").like("src1%").alias("starts"), F.col("text").ilike("%THE%").alias("has_the"))


@query("f5_join_list", """
SELECT p_partkey, p_brand || ', ' || p_type || ', ' || p_name AS listed FROM part""")
def f5(spark, sf):
    items = F.array(*[F.struct(F.col(c).alias("name")) for c in ("p_brand", "p_type", "p_name")])
    return t(spark, sf, "part").select("p_partkey", joined(items, "name").alias("listed"))


@query("f6_date_trunc", """
SELECT event_id, date_trunc('minute', ts) AS m, date_trunc('hour', ts) AS h, date_trunc('day', ts)::TIMESTAMP AS d FROM events""")
def f6(spark, sf):
    return t(spark, sf, "events").select("event_id", *[
        F.date_trunc(u, "ts").cast("timestamp_ntz").alias(a) for u, a in (("minute", "m"), ("hour", "h"), ("day", "d"))])


@query("f7_date_parts", """
SELECT event_id, CAST(hour(ts) AS INTEGER) AS h, CAST(year(ts) AS INTEGER) AS y, CAST(month(ts) AS INTEGER) AS m, strftime(ts, '%Y-%m') AS ym FROM events""")
def f7(spark, sf):
    return t(spark, sf, "events").select(
        "event_id", F.hour("ts").alias("h"), F.year("ts").alias("y"), F.month("ts").alias("m"),
        F.date_format("ts", "yyyy-MM").alias("ym"))


@query("f8_season", """
SELECT o_orderkey, s AS season, s || '-' || right(CAST(s + 1 AS VARCHAR), 2) AS label FROM (
  SELECT o_orderkey, CAST(CASE WHEN month(o_orderdate) >= 7 THEN year(o_orderdate) ELSE year(o_orderdate) - 1 END AS INTEGER) AS s FROM orders)""")
def f8(spark, sf):
    rows = t(spark, sf, "orders").select("o_orderkey", tp.season_start("o_orderdate").alias("season"))
    return rows.withColumn("label", tp.season_label("season"))


@query("f9_differences", """
SELECT event_id, date_diff('day', ts, TIMESTAMP '2024-02-01 06:00:00') AS days, date_diff('second', ts, TIMESTAMP '2024-02-01 06:00:00.5') AS seconds FROM events""")
def f9(spark, sf):
    at = F.lit("2024-02-01 06:00:00").cast("timestamp_ntz")
    half = F.lit("2024-02-01 06:00:00.5").cast("timestamp_ntz")
    return t(spark, sf, "events").select(
        "event_id", tp.days_between("ts", at).alias("days"), tp.seconds_between("ts", half).alias("seconds"))


@query("f10_intervals", """
SELECT event_id, ts + INTERVAL 10 MINUTE AS due, ts + INTERVAL 10 DAY >= TIMESTAMP '2024-01-25' AS late FROM events""")
def f10(spark, sf):
    late = F.col("ts") + F.expr("INTERVAL 10 DAYS") >= F.lit("2024-01-25").cast("timestamp_ntz")
    return t(spark, sf, "events").select(
        "event_id", (F.col("ts") + F.expr("INTERVAL 10 MINUTES")).alias("due"), late.alias("late"))


@query("f11_scaling", """
SELECT c_custkey, round((c_acctbal - lo) / (hi - lo), 9) AS scaled, round(sqrt(abs(c_acctbal)), 6) AS root,
       0.5::DOUBLE AS flat FROM customer, (SELECT min(c_acctbal) AS lo, max(c_acctbal) AS hi FROM customer)""")
def f11(spark, sf):
    rows = agg.scale_column(t(spark, sf, "customer"), "c_acctbal", "scaled")
    one = F.lit(1.0)
    return rows.select("c_custkey", F.round("scaled", 9).alias("scaled"),
                       F.round(F.sqrt(F.abs("c_acctbal")), 6).alias("root"),
                       min_max(one, one, one, 0.5).alias("flat"))


@query("f12_surrogate_key", """
SELECT l_orderkey, l_linenumber, l_partkey, md5(l_orderkey || '-' || l_linenumber || '-' ||
  CASE WHEN l_returnflag = 'N' THEN '_dbt_utils_surrogate_key_null_' ELSE l_returnflag END) AS sk FROM lineitem""")
def f12(spark, sf):
    maybe = F.nullif("l_returnflag", F.lit("N"))
    return t(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", surrogate_key("l_orderkey", "l_linenumber", maybe).alias("sk"))


@query("f13_vectors", """
SELECT a.vec_id, round(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS dot,
       round(sqrt(list_dot_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[])), 6) AS length,
       round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS cos
FROM embeddings a, (SELECT embedding FROM embeddings WHERE vec_id = 0) b""")
def f13(spark, sf):
    rows = t(spark, sf, "embeddings")
    seed = rows.filter("vec_id = 0").select("embedding").scalar()
    return rows.withColumn("seed", seed).select(
        "vec_id", F.round(vectors.dot("embedding", "seed"), 6).alias("dot"),
        F.round(vectors.norm("embedding"), 6).alias("length"),
        F.round(vectors.cosine("embedding", "seed"), 6).alias("cos"))


@query("f14_epoch", """
SELECT event_id, epoch_ms(1700000000000 + event_id * 1000) AS at, CAST(strftime(ts, '%Y-%m-%d %H:%M:%S') AS TIMESTAMP) AS zoned FROM events""")
def f14(spark, sf):
    at = tp.from_millis(F.lit(1_700_000_000_000) + F.col("event_id") * 1000)
    zoned = F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit("+00:00")).cast("timestamp")
    return t(spark, sf, "events").select(
        "event_id", at.cast("timestamp_ntz").alias("at"), zoned.cast("timestamp_ntz").alias("zoned"))
