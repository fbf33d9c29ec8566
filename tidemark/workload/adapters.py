"""The given tables in the shapes the plans expect, in Spark and as oracle SQL.

Money is cut to whole units where a plan sums or averages it, so that sums are exact and
both engines round the same values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.scalars import map_values
from tidemark.sources.tables import source
from tidemark.workload.registry import piece

FIRST_DAY = "2024-01-01"
SHIFT = 200_000


def k() -> Column:
    return F.get_json_object("props", "$.k").cast("int")


def text(col: str | Column) -> Column:
    return (F.col(col) if isinstance(col, str) else col).cast("string")


def tag(prefix: str, col: str | Column) -> Column:
    return F.concat(F.lit(prefix), text(col))


piece("ev", r"SELECT *, CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER) AS k FROM events")


def ev(spark: SparkSession, sf: str) -> DataFrame:
    return source(spark, sf, "events").withColumn("k", k())


# --- market -----------------------------------------------------------------

piece("trades", """
SELECT event_id AS trade_id, event_type AS symbol, value AS price, CAST(k AS DOUBLE) AS quantity,
       value * CAST(k AS DOUBLE) AS notional_value, k % 2 = 0 AS buyer_maker,
       ts AS trade_time, ts AS event_time
FROM ev
""")


def raw_trades(spark: SparkSession, sf: str) -> DataFrame:
    return ev(spark, sf).select(
        F.col("event_id").alias("trade_id"), F.col("event_type").alias("symbol"),
        F.col("value").alias("price"), F.col("k").cast("double").alias("quantity"),
        (F.col("k") % 2 == 0).alias("buyer_maker"),
        F.col("ts").alias("trade_time"), F.col("ts").alias("event_time"),
        F.col("ts").alias("consumed_at"),
    )


# --- payments ---------------------------------------------------------------

# The payments are evaluated at the time of the newest event.
CLOCK_SQL = "(SELECT max(ts) FROM events)"
GRACE, LOOK_BACK = 120, 240

piece("raw_requests", """
SELECT CAST(event_id AS VARCHAR) AS payment_id, value AS amount, ts AS requested_at, ts AS consumed_at
FROM ev
UNION ALL
SELECT CAST(event_id AS VARCHAR), value, ts, ts + INTERVAL 1 MINUTE FROM ev WHERE event_id % 10 = 0
""")
piece("raw_rejections", f"""
SELECT CAST(event_id AS VARCHAR) AS payment_id, ts + to_seconds(k * 72) AS rejected_at
FROM ev WHERE k % 7 = 0 AND ts + to_seconds(k * 72) <= {CLOCK_SQL}
""")
piece("requests", "SELECT payment_id, amount, requested_at, min(consumed_at) AS consumed_at "
      "FROM raw_requests GROUP BY ALL")
piece("pay_status", f"""
SELECT q.payment_id, amount, requested_at, rejected_at,
       CASE WHEN j.payment_id IS NOT NULL THEN 'rejected'
            WHEN {CLOCK_SQL} >= requested_at + INTERVAL {GRACE} MINUTE THEN 'accepted'
            ELSE 'pending' END AS status
FROM requests q LEFT JOIN raw_rejections j ON q.payment_id = j.payment_id
""")


def clock(spark: SparkSession, sf: str) -> Column:
    """Time of the newest event, as a literal."""
    newest = source(spark, sf, "events").agg(F.max("ts").cast("string")).first()[0]
    return F.lit(newest).cast("timestamp_ntz")


def raw_requests(spark: SparkSession, sf: str) -> DataFrame:
    """Requests, every tenth one delivered a second time a minute later."""
    rows = ev(spark, sf).select(
        "event_id", text("event_id").alias("payment_id"), F.col("value").alias("amount"),
        F.col("ts").alias("requested_at"), F.col("ts").alias("consumed_at"),
    )
    again = rows.filter("event_id % 10 = 0").withColumn(
        "consumed_at", F.col("consumed_at") + F.expr("INTERVAL 1 MINUTE"))
    return rows.unionByName(again).drop("event_id")


def raw_rejections(spark: SparkSession, sf: str) -> DataFrame:
    at = F.col("ts") + F.make_dt_interval(secs=F.col("k") * 72)
    rows = ev(spark, sf).filter("k % 7 = 0").select(
        text("event_id").alias("payment_id"), at.alias("rejected_at"), at.alias("consumed_at"))
    return rows.filter(F.col("rejected_at") <= clock(spark, sf))


# --- clickstream ------------------------------------------------------------

ACTION = {"signup": "login", "view": "page_view", "click": "add_to_cart", "purchase": "purchase",
          "error": "search"}

piece("clicks", f"""
SELECT 'E' || event_id AS event_id, ts AS event_at, user_id, k,
       CASE WHEN event_type = 'signup' AND k % 3 = 0 THEN 'email_click'
            WHEN event_type = 'signup' THEN 'login' WHEN event_type = 'view' THEN 'page_view'
            WHEN event_type = 'click' THEN 'add_to_cart' WHEN event_type = 'error' THEN 'search'
            ELSE event_type END AS event_type,
       user_id || '-' || CAST(date_diff('day', DATE '{FIRST_DAY}', CAST(ts AS DATE)) // 3 AS VARCHAR) AS anonymous_id,
       CASE WHEN user_id % 5 <> 0 AND event_type IN ('signup', 'purchase') AND value > 100
            THEN 'C' || user_id END AS customer_id,
       CASE WHEN event_type = 'view' THEN CASE WHEN k % 2 = 0 THEN 'pdp' ELSE 'plp' END END AS page_type,
       CASE WHEN event_type IN ('view', 'click', 'purchase')
            THEN 'P' || ((event_id * 31 + k) % (SELECT count(*) FROM part)) END AS product_id,
       'cat' || (k % 6) AS category_id, 'Brand#' || (1 + k % 25) AS brand_line,
       CASE WHEN event_type = 'error' THEN 'q' || k END AS search_query,
       CASE WHEN event_type = 'view' AND k % 2 = 1 THEN CAST(k % 50 AS VARCHAR) END AS filter_size,
       CAST(NULL AS VARCHAR) AS filter_colour,
       CASE WHEN event_type = 'purchase' THEN 'O' || event_id END AS order_id,
       CAST(1 + k % 3 AS INTEGER) AS quantity, value AS unit_price, k % 10 = 0 AS is_marketplace,
       CASE WHEN k % 10 = 0 THEN 'S' || (k % 7) END AS seller_id,
       'd' || (user_id % 3) AS device_type, 'ua' || (user_id % 7) AS user_agent,
       'ip' || (user_id % 60) AS ip_address, 't' || (k % 4) AS traffic_source,
       CASE WHEN user_id % 5 = 0 THEN 'V' ELSE 'C' END || user_id AS true_id,
       user_id || '-' || CAST(date_diff('day', DATE '{FIRST_DAY}', CAST(ts AS DATE)) AS VARCHAR) AS true_session
FROM ev
""")


def raw_clicks(spark: SparkSession, sf: str) -> DataFrame:
    rows = ev(spark, sf)
    parts = source(spark, sf, "part").agg(F.count(F.lit(1))).scalar()
    kind, user = F.col("event_type"), text("user_id")
    day = F.datediff("ts", F.lit(FIRST_DAY).cast("date"))
    known = (F.col("user_id") % 5 != 0) & kind.isin("signup", "purchase") & (F.col("value") > 100)
    action = F.when((kind == "signup") & (F.col("k") % 3 == 0), "email_click").otherwise(
        map_values(kind, {v: [s] for s, v in ACTION.items()}, "unknown"))
    shop = F.col("k") % 10 == 0
    return rows.select(
        tag("E", "event_id").alias("event_id"),
        F.col("ts").alias("event_at"),
        action.alias("event_type"),
        F.concat(user, F.lit("-"), text(F.floor(day / 3))).alias("anonymous_id"),
        F.when(known, tag("C", "user_id")).alias("customer_id"),
        F.when(kind == "view", F.when(F.col("k") % 2 == 0, "pdp").otherwise("plp")).alias("page_type"),
        F.when(kind.isin("view", "click", "purchase"),
               tag("P", (F.col("event_id") * 31 + F.col("k")) % parts)).alias("product_id"),
        tag("cat", F.col("k") % 6).alias("category_id"),
        tag("Brand#", 1 + F.col("k") % 25).alias("brand_line"),
        F.when(kind == "error", tag("q", "k")).alias("search_query"),
        F.when((kind == "view") & (F.col("k") % 2 == 1), text(F.col("k") % 50)).alias("filter_size"),
        F.lit(None).cast("string").alias("filter_colour"),
        F.when(kind == "purchase", tag("O", "event_id")).alias("order_id"),
        (1 + F.col("k") % 3).alias("quantity"),
        F.col("value").alias("unit_price"),
        shop.alias("is_marketplace"),
        F.when(shop, tag("S", F.col("k") % 7)).alias("seller_id"),
        tag("d", F.col("user_id") % 3).alias("device_type"),
        tag("ua", F.col("user_id") % 7).alias("user_agent"),
        tag("ip", F.col("user_id") % 60).alias("ip_address"),
        tag("t", F.col("k") % 4).alias("traffic_source"),
        F.concat(F.when(F.col("user_id") % 5 == 0, "V").otherwise("C"), user).alias("_true_customer_id"),
        F.concat(user, F.lit("-"), text(day)).alias("_true_session_id"),
        F.col("ts").alias("ingested_at"),
    )


piece("search_logs", """
SELECT 'Q' || event_id AS search_id, event_at, anonymous_id, search_query AS query_text, category_id,
       k AS results_count, CASE WHEN k % 2 = 0 THEN k % 10 END AS clicked_position,
       CASE WHEN k % 2 = 0 THEN 'P' || k END AS clicked_product_id, k % 5 = 0 AS converted
FROM clicks WHERE event_type = 'search'
""")


def raw_search_logs(spark: SparkSession, sf: str) -> DataFrame:
    rows = raw_clicks(spark, sf).filter(F.col("event_type") == "search")
    n = F.substring("search_query", 2, 10).cast("int")
    hit = n % 2 == 0
    return rows.select(
        tag("Q", "event_id").alias("search_id"), "event_at", "anonymous_id", "customer_id",
        F.col("search_query").alias("query_text"), "category_id", n.alias("results_count"),
        F.when(hit, n % 10).alias("clicked_position"),
        F.when(hit, tag("P", n)).alias("clicked_product_id"),
        (n % 5 == 0).alias("converted"), "_true_customer_id", "ingested_at",
    )


piece("emails", """
SELECT 'M' || event_id AS email_event_id, 'c' || (k % 4) AS campaign_id, 'C' || user_id AS customer_id,
       CASE k % 10 WHEN 0 THEN 'sent' WHEN 1 THEN 'open' ELSE 'click' END AS event_type, ts AS event_at
FROM ev
""")


def raw_emails(spark: SparkSession, sf: str) -> DataFrame:
    rest = F.col("k") % 10
    kind = F.when(rest == 0, "sent").when(rest == 1, "open").otherwise("click")
    none = F.lit(None).cast("string")
    return ev(spark, sf).select(
        tag("M", "event_id").alias("email_event_id"), tag("c", F.col("k") % 4).alias("campaign_id"),
        tag("Campaign ", F.col("k") % 4).alias("campaign_name"),
        tag("C", "user_id").alias("customer_id"), kind.alias("event_type"),
        F.col("ts").alias("event_at"), none.alias("promoted_product_id"),
        none.alias("promoted_category"), tag("C", "user_id").alias("encoded_customer_id"),
        F.col("ts").alias("ingested_at"),
    )


# --- retail -----------------------------------------------------------------

piece("versions", f"""
SELECT 'C' || o_custkey AS customer_id,
       CAST(date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) * {SHIFT} + o_orderkey % {SHIFT} AS INTEGER) AS version_number,
       o_orderdate AS effective_at, o_orderpriority AS change_reason, c_name AS first_name,
       c_mktsegment AS last_name, lower(c_name) || '@example.org' AS email,
       CASE WHEN o_orderkey % 4 = 0 THEN 'Petite' ELSE 'Classic' END AS brand_line_affinity,
       CAST(o_orderkey % 10 AS VARCHAR) AS home_size, o_orderkey % 4 = 0 AS prefers_petite,
       CAST(c_nationkey AS VARCHAR) AS region, 'A' || c_nationkey AS postcode_area,
       CAST(o_orderdate AS DATE) AS signup_date, o_orderkey % 2 = 0 AS loyalty_member,
       CASE WHEN o_orderkey % 3 = 0 THEN 'Gold' ELSE 'Silver' END AS loyalty_tier,
       o_orderkey % 5 <> 0 AS email_consent, o_orderkey % 3 <> 0 AS marketing_consent,
       o_orderkey % 7 <> 0 AS data_processing_consent
FROM orders JOIN customer ON o_custkey = c_custkey
""")


def raw_versions(spark: SparkSession, sf: str) -> DataFrame:
    """Each order of a customer brings a new version of the customer."""
    orders, customer = source(spark, sf, "orders"), source(spark, sf, "customer")
    key = F.col("o_orderkey")
    days = F.datediff("o_orderdate", F.lit("1995-01-01").cast("date"))
    return orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).select(
        tag("C", "o_custkey").alias("customer_id"),
        (days * SHIFT + key % SHIFT).alias("version_number"),
        F.col("o_orderdate").alias("effective_at"), F.col("o_orderpriority").alias("change_reason"),
        F.col("c_name").alias("first_name"), F.col("c_mktsegment").alias("last_name"),
        F.concat(F.lower("c_name"), F.lit("@example.org")).alias("email"),
        F.when(key % 4 == 0, "Petite").otherwise("Classic").alias("brand_line_affinity"),
        text(key % 10).alias("home_size"), (key % 4 == 0).alias("prefers_petite"),
        text("c_nationkey").alias("region"), tag("A", "c_nationkey").alias("postcode_area"),
        F.col("o_orderdate").alias("signup_date"), (key % 2 == 0).alias("loyalty_member"),
        F.when(key % 3 == 0, "Gold").otherwise("Silver").alias("loyalty_tier"),
        (key % 5 != 0).alias("email_consent"), (key % 3 != 0).alias("marketing_consent"),
        (key % 7 != 0).alias("data_processing_consent"), F.col("o_orderdate").alias("ingested_at"),
    )


STATUS = {"completed": ["F"], "in_progress": ["O"], "cancelled": ["P"]}
STATES = ["SHIPPED", "RECEIVED", "CLOSED", "SHIPPING", "WAITING_ACCEPTANCE", "CANCELED", "REFUSED",
          "STAGING"]

piece("own_orders", """
SELECT 'O' || o_orderkey AS order_id, 'C' || o_custkey AS customer_id, o_orderdate AS order_at,
       'web' AS order_channel, false AS is_guest, floor(o_totalprice) AS net_amount,
       CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'in_progress' ELSE 'cancelled' END AS order_status,
       CAST(NULL AS VARCHAR) AS seller_id, 0.0::DOUBLE AS commission_amount
FROM orders WHERE o_orderpriority NOT LIKE '1%'
""")
piece("shop_orders", """
SELECT 'O' || o_orderkey AS order_id, CASE WHEN o_orderkey % 11 <> 0 THEN 'C' || o_custkey END AS customer_id,
       o_orderdate AS order_at, 'marketplace' AS order_channel, o_orderkey % 11 = 0 AS is_guest,
       floor(o_totalprice) AS net_amount,
       CASE WHEN o_orderkey % 8 < 3 THEN 'completed' WHEN o_orderkey % 8 < 5 THEN 'in_progress'
            WHEN o_orderkey % 8 < 7 THEN 'cancelled' ELSE 'unknown' END AS order_status,
       'S' || (o_custkey % 7) AS seller_id, floor(o_totalprice) * 0.15::DOUBLE AS commission_amount
FROM orders WHERE o_orderpriority LIKE '1%'
""")
piece("all_orders", "SELECT * FROM own_orders UNION ALL SELECT * FROM shop_orders")


def _orders(spark: SparkSession, sf: str, shop: bool) -> DataFrame:
    first = F.col("o_orderpriority").startswith("1")
    return source(spark, sf, "orders").filter(first if shop else ~first)


def raw_orders(spark: SparkSession, sf: str) -> DataFrame:
    amount = F.floor("o_totalprice").cast("double")
    return _orders(spark, sf, False).select(
        tag("O", "o_orderkey").alias("order_id"), tag("C", "o_custkey").alias("customer_id"),
        F.col("o_orderdate").alias("order_at"), F.lit("web").alias("order_channel"),
        F.lit(False).alias("is_guest"), F.lit(0).alias("num_lines"), F.lit(0).alias("num_units"),
        amount.alias("gross_amount"), F.lit(0.0).alias("discount_amount"), amount.alias("net_amount"),
        map_values("o_orderstatus", STATUS, "unknown").alias("order_status"),
        F.col("o_orderdate").alias("ingested_at"),
    )


def raw_shop_orders(spark: SparkSession, sf: str) -> DataFrame:
    amount = F.floor("o_totalprice").cast("double")
    guest = F.col("o_orderkey") % 11 == 0
    state = F.element_at(F.array(*[F.lit(s) for s in STATES]), (F.col("o_orderkey") % 8 + 1).cast("int"))
    return _orders(spark, sf, True).select(
        tag("O", "o_orderkey").alias("mirakl_order_id"), tag("S", F.col("o_custkey") % 7).alias("shop_id"),
        tag("Shop ", F.col("o_custkey") % 7).alias("shop_name"),
        F.when(~guest, tag("C", "o_custkey")).alias("customer_ref"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("created_date"), state.alias("order_state"),
        amount.alias("total_price"), F.lit("GBP").alias("currency_iso_code"),
        F.lit(0.15).alias("commission_rate"), (amount * 0.15).alias("commission_amount"),
        F.col("o_orderdate").alias("ingested_at"),
    )


piece("all_lines", """
SELECT 'L' || l_orderkey || '-' || l_linenumber AS line_id, 'O' || l_orderkey AS order_id,
       'P' || l_partkey AS variant_id, p_type AS category_id, CAST(l_quantity AS INTEGER) AS quantity,
       l_extendedprice / l_quantity AS unit_price, floor(l_extendedprice) AS line_amount,
       l_returnflag = 'R' AS is_returned, CASE WHEN l_returnflag = 'R' THEN 'fit' END AS return_reason,
       CASE WHEN o_orderpriority LIKE '1%' THEN 'marketplace' ELSE 'first_party' END AS order_channel
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey
""")


def _lines(spark: SparkSession, sf: str, shop: bool) -> DataFrame:
    orders = _orders(spark, sf, shop).select("o_orderkey")
    return source(spark, sf, "lineitem").join(orders, F.col("l_orderkey") == F.col("o_orderkey"))


def _line(prefix: dict[str, str]) -> dict[str, Column]:
    back = F.col("l_returnflag") == "R"
    return {
        prefix["line_id"]: F.concat(tag("L", "l_orderkey"), F.lit("-"), text("l_linenumber")),
        prefix["order_id"]: tag("O", "l_orderkey"),
        prefix["variant_id"]: tag("P", "l_partkey"),
        "quantity": F.col("l_quantity"),
        prefix["unit_price"]: F.col("l_extendedprice") / F.col("l_quantity"),
        prefix["line_amount"]: F.floor("l_extendedprice").cast("double"),
        prefix["is_returned"]: back,
        prefix["return_reason"]: F.when(back, "fit"),
        "ingested_at": F.col("l_shipdate"),
    }


def raw_lines(spark: SparkSession, sf: str) -> DataFrame:
    names = ["line_id", "order_id", "variant_id", "unit_price", "line_amount", "is_returned", "return_reason"]
    columns = _line({n: n for n in names})
    part = source(spark, sf, "part").select("p_partkey", "p_type")
    return _lines(spark, sf, False).join(part, F.col("l_partkey") == F.col("p_partkey")).select(
        *[c.alias(n) for n, c in columns.items()], F.col("p_type").alias("category_id"),
        F.lit(None).cast("timestamp_ntz").alias("returned_at"),
    )


def raw_shop_lines(spark: SparkSession, sf: str) -> DataFrame:
    columns = _line({
        "line_id": "mirakl_line_id", "order_id": "mirakl_order_id", "variant_id": "offer_sku",
        "unit_price": "price_unit", "line_amount": "line_total", "is_returned": "is_refunded",
        "return_reason": "refund_reason",
    })
    return _lines(spark, sf, True).select(*[c.alias(n) for n, c in columns.items()])


piece("variants", """
SELECT 'P' || p_partkey AS variant_id, p_name AS product_group_id, p_name AS style_name, p_type AS category_id,
       'D' || (p_size % 3) AS department, p_brand AS brand_line, split_part(p_name, ' ', 1) AS colour,
       CAST(p_size % 10 AS VARCHAR) AS size, CASE WHEN p_size % 10 < 5 THEN 'small' ELSE 'large' END AS size_range,
       split_part(p_name, ' ', 2) AS pattern, p_retailprice AS price, p_size % 5 AS stock_level,
       p_size % 5 > 0 AS is_in_stock, p_partkey % 9 <> 0 AS is_active
FROM part
""")


def raw_variants(spark: SparkSession, sf: str) -> DataFrame:
    word = F.split("p_name", " ")
    size = F.col("p_size")
    return source(spark, sf, "part").select(
        tag("P", "p_partkey").alias("variant_id"), F.col("p_name").alias("product_group_id"),
        F.col("p_name").alias("style_name"), F.col("p_type").alias("category_id"),
        tag("D", size % 3).alias("department"), F.col("p_brand").alias("brand_line"),
        word[0].alias("colour"), text(size % 10).alias("size"),
        F.when(size % 10 < 5, "small").otherwise("large").alias("size_range"),
        word[1].alias("pattern"), F.lit("cotton").alias("fabric"), F.lit("mid").alias("price_band"),
        F.col("p_retailprice").alias("price"), F.lit("AW").alias("season"),
        (size % 5).alias("stock_level"), (F.col("p_partkey") % 9 != 0).alias("is_active"),
        F.lit("2024-01-01 00:00:00").alias("ingested_at"),
    )


piece("styles", "SELECT p_name AS product_group_id, p_name || ' ' || min(p_type) || ' ' || min(p_brand) "
      "AS description FROM part GROUP BY p_name")


def raw_products(spark: SparkSession, sf: str) -> DataFrame:
    grouped = source(spark, sf, "part").groupBy("p_name").agg(
        F.min("p_type").alias("t"), F.min("p_brand").alias("b"), F.min("p_retailprice").alias("price"))
    return grouped.select(
        F.col("p_name").alias("product_group_id"), F.col("p_name").alias("style_name"),
        F.col("t").alias("category_id"), F.lit("D").alias("department"), F.col("b").alias("brand_line"),
        F.lit("plain").alias("pattern"), F.lit("cotton").alias("fabric"), F.lit("mid").alias("price_band"),
        F.col("price").alias("base_price"), F.lit("AW").alias("season"),
        F.concat_ws(" ", "p_name", "t", "b").alias("description"),
        F.lit("2024-01-01 00:00:00").alias("ingested_at"),
    )


def raw_categories(spark: SparkSession, sf: str) -> DataFrame:
    region, nation = source(spark, sf, "region"), source(spark, sf, "nation")
    at = F.lit("2024-01-01 00:00:00").alias("ingested_at")
    tops = region.select(
        tag("R", "r_regionkey").alias("category_id"), F.col("r_name").alias("category_name"),
        F.lit(None).cast("string").alias("parent_category_id"), F.lit(1).alias("category_level"),
        F.col("r_name").alias("department"), at)
    leaves = nation.select(
        tag("N", "n_nationkey").alias("category_id"), F.col("n_name").alias("category_name"),
        tag("R", "n_regionkey").alias("parent_category_id"), F.lit(2).alias("category_level"),
        F.lit("leaf").alias("department"), at)
    return tops.unionByName(leaves)


# --- sports -----------------------------------------------------------------

GAME_TYPES = ["Regular Season", "Playoffs", "Preseason"]

piece("box", """
SELECT l_orderkey AS game_id, s_nationkey AS team_id, c_nationkey AS opponent_team_id,
       CAST(l_shipdate AS DATE) AS game_date, l_shipdate AS game_at, l_suppkey AS person_id, l_partkey % 5 AS player_team_id,
       CASE l_linenumber % 3 WHEN 0 THEN 'Regular Season' WHEN 1 THEN 'Playoffs' ELSE 'Preseason' END AS game_type,
       l_linestatus = 'O' AS is_home,
       CASE l_returnflag WHEN 'A' THEN true WHEN 'N' THEN false END AS is_win,
       CAST(l_quantity AS BIGINT) AS team_score, CAST(l_partkey % 40 AS BIGINT) AS opponent_score,
       CASE WHEN l_linenumber > 2 THEN l_quantity END AS minutes, CAST(l_quantity AS BIGINT) AS points,
       CAST(l_partkey % 7 AS BIGINT) AS made, CAST(l_partkey % 7 + l_suppkey % 3 AS BIGINT) AS attempted,
       floor(l_extendedprice / 1000) AS rating, CAST(l_partkey % 11 AS DOUBLE) AS pct
FROM lineitem JOIN orders ON l_orderkey = o_orderkey
JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey
""")


def _box(spark: SparkSession, sf: str) -> DataFrame:
    orders, customer = source(spark, sf, "orders"), source(spark, sf, "customer")
    line, supplier = source(spark, sf, "lineitem"), source(spark, sf, "supplier")
    return (
        line.join(orders.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
        .join(customer.select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
        .join(supplier.select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
    )


def _common_box() -> dict[str, Column]:
    kind = F.element_at(F.array(*[F.lit(g) for g in GAME_TYPES]), F.col("l_linenumber") % 3 + 1)
    part, quantity = F.col("l_partkey"), F.col("l_quantity").cast("bigint")
    pct, rating = (part % 11).cast("double"), F.floor(F.col("l_extendedprice") / 1000).cast("double")
    shots = {}
    for shot in ("fieldGoals", "threePointers", "freeThrows"):
        shots[f"{shot}Made"] = part % 7
        shots[f"{shot}Attempted"] = part % 7 + F.col("l_suppkey") % 3
    same = ["rebounds Total", "assists", "steals", "blocks", "turnovers"]
    return {
        "gameId": F.col("l_orderkey"),
        "gameDate": F.date_format("l_shipdate", "yyyy-MM-dd"),
        "gameDateTimeEst": F.date_format("l_shipdate", "yyyy-MM-dd HH:mm:ss"),
        "gameType": kind,
        "home": F.when(F.col("l_linestatus") == "O", 1).otherwise(0),
        "win": F.when(F.col("l_returnflag") == "A", 1).when(F.col("l_returnflag") == "N", 0),
        **shots,
        **{n.replace(" ", ""): part % 7 for n in same},
        **{n: pct for n in (
            "usagePercentage", "trueShootingPercentage", "effectiveFieldGoalPercentage",
            "assistPercentage", "reboundPercentage", "playerImpactEstimate", "teamTurnoverPercentage",
            "percentFieldGoalAttempts3Point", "percentPointsInPaint", "percentPointsFastBreak")},
        **{n: rating for n in ("offensiveRating", "defensiveRating", "netRating", "pace")},
        "points": quantity,
        "ingested_at": F.date_format("l_shipdate", "yyyy-MM-dd HH:mm:ss"),
    }


def raw_team_box(spark: SparkSession, sf: str) -> DataFrame:
    columns = {
        **_common_box(),
        "teamId": F.col("s_nationkey"), "opponentTeamId": F.col("c_nationkey"),
        "teamScore": F.col("l_quantity").cast("bigint"), "opponentScore": F.col("l_partkey") % 40,
        "pointsInThePaint": F.col("l_partkey") % 7, "numMinutes": F.lit(240),
    }
    return _box(spark, sf).select(*[c.alias(n) for n, c in columns.items()])


def raw_player_box(spark: SparkSession, sf: str) -> DataFrame:
    minutes = (
        F.when(F.col("l_linenumber") == 1, F.lit(None)).when(F.col("l_linenumber") == 2, "DNP")
        .otherwise(F.col("l_quantity").cast("string"))
    )
    columns = {
        **_common_box(),
        "personId": F.col("l_suppkey"), "playerteamId": F.col("l_partkey") % 5, "numMinutes": minutes,
        "doubleDouble": F.when(F.col("l_quantity") >= 30, 1).otherwise(0),
        "tripleDouble": F.when(F.col("l_quantity") >= 45, 1).otherwise(0),
    }
    return source(spark, sf, "lineitem").select(*[c.alias(n) for n, c in columns.items()])


def raw_players(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("s_nationkey")
    return source(spark, sf, "supplier").select(
        F.col("s_suppkey").alias("personId"), F.col("s_name").alias("firstName"),
        tag("N", n).alias("lastName"), F.lit("1990-05-01").alias("birthDate"),
        F.when(n % 2 == 0, 1).otherwise(0).alias("guard"), F.when(n % 3 == 0, 1).otherwise(0).alias("forward"),
        F.when(n % 5 == 0, 1).otherwise(0).alias("center"), (n + 1990).alias("draftYear"),
        (n + 70).alias("heightInches"), F.lit("2024-01-01 00:00:00").alias("ingested_at"),
    )


piece("players", """
SELECT s_suppkey AS person_id, s_name AS first_name, 'N' || s_nationkey AS last_name,
       s_nationkey % 2 = 0 AS is_guard, s_nationkey % 3 = 0 AS is_forward, s_nationkey % 5 = 0 AS is_center,
       s_nationkey + 1990 AS draft_year, s_nationkey + 70 AS height_inches
FROM supplier
""")


def raw_games(spark: SparkSession, sf: str) -> DataFrame:
    order, cust = F.col("o_orderkey"), F.col("o_custkey")
    return source(spark, sf, "orders").select(
        order.alias("gameId"), F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss").alias("gameDateTimeEst"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("gameDate"),
        F.element_at(F.array(*[F.lit(g) for g in GAME_TYPES]), (order % 3 + 1).cast("int")).alias("gameType"),
        (cust % 25).alias("hometeamId"), tag("T", cust % 25).alias("hometeamName"),
        ((cust + 1) % 25).alias("awayteamId"), tag("T", (cust + 1) % 25).alias("awayteamName"),
        (order % 130).alias("homeScore"), (cust % 120).alias("awayScore"),
        F.when(order % 2 == 0, cust % 25).otherwise((cust + 1) % 25).alias("winner"),
        (order % 20000).alias("attendance"), F.col("o_orderpriority").alias("arenaName"),
        F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss").alias("ingested_at"),
    )


piece("games", """
SELECT o_orderkey AS game_id, o_orderdate AS game_datetime_est, CAST(o_orderdate AS DATE) AS game_date,
       CASE o_orderkey % 3 WHEN 0 THEN 'Regular Season' WHEN 1 THEN 'Playoffs' ELSE 'Preseason' END AS game_type,
       o_custkey % 25 AS home_team_id, 'T' || (o_custkey % 25) AS home_team_name,
       (o_custkey + 1) % 25 AS away_team_id, 'T' || ((o_custkey + 1) % 25) AS away_team_name,
       o_orderkey % 130 AS home_score, o_custkey % 120 AS away_score, o_orderkey % 2 = 0 AS home_team_won,
       o_orderkey % 20000 AS attendance, o_orderpriority AS arena_name, o_orderdate AS ingested_at
FROM orders
""")


def raw_histories(spark: SparkSession, sf: str) -> DataFrame:
    """Each order opens a new era of the customer's franchise."""
    days = F.datediff("o_orderdate", F.lit("1995-01-01").cast("date"))
    founded = days * SHIFT + F.col("o_orderkey") % SHIFT
    return source(spark, sf, "orders").select(
        F.col("o_custkey").alias("teamId"), F.col("o_orderpriority").alias("teamCity"),
        F.col("o_orderstatus").alias("teamName"), F.substring("o_orderpriority", 1, 1).alias("teamAbbrev"),
        founded.alias("seasonFounded"), (founded + 10).alias("seasonActiveTill"),
        F.lit("A").alias("league"), F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss").alias("ingested_at"),
    )


def raw_matches(spark: SparkSession, sf: str) -> DataFrame:
    order, cust = F.col("o_orderkey"), F.col("o_custkey")
    return source(spark, sf, "orders").select(
        order.alias("match_id"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("match_date"),
        F.concat(F.lpad(text(order % 24), 2, "0"), F.lit(":30:15.250")).alias("kick_off"),
        (cust % 9).alias("competition_id"), tag("Cup ", cust % 9).alias("competition_name"),
        F.year("o_orderdate").alias("season_id"), text(F.year("o_orderdate")).alias("season_name"),
        tag("T", cust % 25).alias("home_team_name"), tag("T", (cust + 1) % 25).alias("away_team_name"),
        (order % 5).alias("home_score"), (cust % 4).alias("away_score"),
        F.when(F.col("o_orderpriority") == "5-LOW", "deleted").otherwise("available").alias("match_status"),
        (order % 38).alias("match_week"), F.col("o_orderpriority").alias("competition_stage"),
        tag("Ground ", cust % 25).alias("stadium_name"), tag("Ref ", cust % 13).alias("referee_name"),
        F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss").alias("ingested_at"),
    )


piece("matches", """
SELECT o_orderkey AS match_id, CAST(o_orderdate AS DATE) AS match_date, (o_orderkey % 24) * 3600 + 1815.25::DOUBLE AS kick_off,
       o_custkey % 9 AS competition_id, 'Cup ' || (o_custkey % 9) AS competition_name, year(o_orderdate) AS season_id,
       CAST(year(o_orderdate) AS VARCHAR) AS season_name, 'T' || (o_custkey % 25) AS home_team_name,
       'T' || ((o_custkey + 1) % 25) AS away_team_name, o_orderkey % 5 AS home_score, o_custkey % 4 AS away_score,
       o_orderkey % 5 - o_custkey % 4 AS goal_difference,
       CASE sign(o_orderkey % 5 - o_custkey % 4) WHEN 1 THEN 'home_win' WHEN -1 THEN 'away_win' ELSE 'draw' END AS match_result,
       'available' AS match_status, o_orderkey % 38 AS match_week, o_orderpriority AS competition_stage,
       'Ground ' || (o_custkey % 25) AS stadium_name, 'Ref ' || (o_custkey % 13) AS referee_name,
       o_orderdate AS ingested_at
FROM orders WHERE o_orderpriority <> '5-LOW'
""")
KINDS = ["Pass", "Shot", "Dribble", "Pressure", "Carry", "Foul", "Block"]
piece("acts", """
SELECT l_orderkey AS match_id, (['Pass','Shot','Dribble','Pressure','Carry','Foul','Block'])[l_linenumber] AS event_type,
       CASE WHEN l_linenumber <> 7 THEN l_suppkey END AS player_id, 'Player ' || l_suppkey AS player_name,
       l_returnflag AS team, l_quantity AS duration, l_partkey % 90 AS minute, l_partkey % 60 AS second
FROM lineitem
""")


def raw_match_events(spark: SparkSession, sf: str) -> DataFrame:
    part = F.col("l_partkey")
    return source(spark, sf, "lineitem").select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey").alias("event_id"),
        F.col("l_orderkey").alias("match_id"), F.col("l_linenumber").alias("event_index"),
        F.lit(1).alias("period"), F.lit("00:01:02.500").alias("timestamp"),
        (part % 90).alias("minute"), (part % 60).alias("second"),
        F.element_at(F.array(*[F.lit(x) for x in KINDS]), F.col("l_linenumber")).alias("event_type"),
        F.lit(1).alias("possession"), F.col("l_returnflag").alias("possession_team"),
        F.lit("Regular Play").alias("play_pattern"), F.col("l_returnflag").alias("team"),
        F.when(F.col("l_linenumber") != 7, F.col("l_suppkey")).alias("player_id"),
        tag("Player ", "l_suppkey").alias("player_name"), (part % 120).cast("double").alias("location_x"),
        (part % 80).cast("double").alias("location_y"), F.col("l_quantity").alias("duration"),
        F.date_format("l_shipdate", "yyyy-MM-dd HH:mm:ss").alias("ingested_at"),
    )


def raw_lineups(spark: SparkSession, sf: str) -> DataFrame:
    return source(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("match_id"), F.col("l_returnflag").alias("team_name"),
        F.col("l_suppkey").alias("player_id"), tag("Player ", "l_suppkey").alias("player_name"),
        F.lit(None).cast("string").alias("player_nickname"), (F.col("l_suppkey") % 99).alias("jersey_number"),
        F.col("l_linestatus").alias("country_name"),
        F.date_format("l_shipdate", "yyyy-MM-dd HH:mm:ss").alias("ingested_at"),
    )


# --- media ------------------------------------------------------------------

piece("ranked_media", """
SELECT user_id, k, event_id, ts, event_id % 50 + 1 AS rank,
       CASE k % 3 WHEN 0 THEN 'short_term' WHEN 1 THEN 'medium_term' ELSE 'long_term' END AS time_range
FROM ev
""")


def _period() -> Column:
    rest = F.col("k") % 3
    return F.when(rest == 0, "short_term").when(rest == 1, "medium_term").otherwise("long_term")


def raw_top_artists(spark: SparkSession, sf: str) -> DataFrame:
    user = F.col("user_id")
    return ev(spark, sf).select(
        text(user).alias("id"), tag("Artist ", user).alias("name"),
        (F.col("event_id") % 50 + 1).alias("rank"), _period().alias("time_range"),
        F.col("k").alias("popularity"), (F.col("k") * 1000).alias("followers"),
        tag("g", user % 5).alias("genres"), tag("u/", user).alias("spotify_url"),
        tag("i/", user).alias("image_url"), F.col("ts").alias("ingested_at"),
    )


def raw_top_tracks(spark: SparkSession, sf: str) -> DataFrame:
    user = F.col("user_id")
    released = F.when(user % 3 == 0, "1999").when(user % 3 == 1, "1999-05").otherwise("1999-05-07")
    return ev(spark, sf).select(
        text(user).alias("id"), tag("Track ", user).alias("name"),
        (F.col("event_id") % 50 + 1).alias("rank"), _period().alias("time_range"),
        tag("a", user % 9).alias("artist_ids"), tag("Artist ", user % 9).alias("artist_names"),
        tag("b", user % 11).alias("album_id"), tag("Album ", user % 11).alias("album_name"),
        released.alias("album_release_date"), (user * 1000 + 90_000).cast("int").alias("duration_ms"),
        (user % 2 == 0).alias("explicit"), F.col("k").alias("popularity"),
        tag("u/", user).alias("spotify_url"), F.lit(None).cast("string").alias("preview_url"),
        F.col("ts").alias("ingested_at"),
    )


def raw_plays(spark: SparkSession, sf: str) -> DataFrame:
    user = F.col("user_id")
    return ev(spark, sf).select(
        F.col("ts").alias("played_at"), text(user).alias("track_id"), tag("Track ", user).alias("track_name"),
        tag("a", user % 9).alias("artist_ids"), tag("Artist ", user % 9).alias("artist_names"),
        tag("b", user % 11).alias("album_id"), tag("Album ", user % 11).alias("album_name"),
        (user * 1000 + 90_000).cast("int").alias("duration_ms"), (user % 2 == 0).alias("explicit"),
        F.col("k").alias("popularity"), tag("u/", user).alias("spotify_url"),
        F.lit("playlist").alias("context_type"), tag("p/", "k").alias("context_uri"),
        F.col("ts").alias("ingested_at"),
    )

