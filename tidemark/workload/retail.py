"""Queries for the retail layers: silver, sessions, identity, gold, quality, profile."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.plans import gold, identity, profile, quality, retail
from tidemark.session import cut
from tidemark.sources.tables import source
from tidemark.workload import adapters as ad
from tidemark.workload.registry import piece, query, rounded as R

GAP, GAP_SQL = "12 hours", "INTERVAL 12 HOUR"


def _session_sql(source_piece: str, gap: str) -> str:
    return f"""
SELECT * EXCLUDE (starts), anonymous_id || '-s' || lpad(CAST(CAST(sum(starts) OVER (PARTITION BY anonymous_id ORDER BY event_at, event_id
  ROWS UNBOUNDED PRECEDING) AS BIGINT) AS VARCHAR), 5, '0') AS session_id
FROM (SELECT *, CASE WHEN event_at - lag(event_at) OVER (PARTITION BY anonymous_id ORDER BY event_at, event_id) <= {gap} THEN 0 ELSE 1 END AS starts
      FROM {source_piece})"""


piece("visits", _session_sql("clicks", GAP_SQL))
piece("visits_short", _session_sql("clicks", "INTERVAL 30 MINUTE"))
piece("sess", """
SELECT session_id, anonymous_id, min(event_at) AS session_start, max(event_at) AS session_end, count(*) AS num_events,
 count(*) FILTER (WHERE event_type = 'page_view') AS num_page_views, count(*) FILTER (WHERE event_type = 'search') AS num_searches,
 count(*) FILTER (WHERE event_type = 'add_to_cart') AS num_add_to_cart, count(*) FILTER (WHERE event_type = 'purchase') AS num_purchases,
 max(customer_id) AS session_customer_id, count(customer_id) > 0 AS is_identified, bool_or(event_type = 'purchase') AS is_converted,
 arg_min(device_type, event_at) AS device_type, arg_min(traffic_source, event_at) AS traffic_source,
 arg_min(true_id, event_at) AS true_id, arg_min(true_session, event_at) AS true_session
FROM visits GROUP BY ALL""")
piece("sure_links", """
SELECT anonymous_id, customer_id, CASE max(CASE event_type WHEN 'login' THEN 3 WHEN 'email_click' THEN 2 ELSE 1 END)
  WHEN 3 THEN 'login' WHEN 2 THEN 'email_click_encoded' ELSE 'checkout_email' END AS link_method,
 min(event_at) AS linked_at, count(*) AS n_signals FROM clicks WHERE customer_id IS NOT NULL GROUP BY ALL""")
piece("seen_with", "SELECT DISTINCT anonymous_id, ip_address, user_agent FROM clicks")
piece("strangers", "SELECT * FROM seen_with s WHERE NOT EXISTS (FROM sure_links d WHERE d.anonymous_id = s.anonymous_id)")
piece("owned", "SELECT DISTINCT customer_id, ip_address, user_agent FROM seen_with JOIN sure_links USING (anonymous_id)")


def _best(left: str, right: str, on: str) -> str:
    return f"""
SELECT anonymous_id, customer_id, n FROM (
 SELECT anonymous_id, customer_id, count(*) AS n FROM {left} JOIN {right} USING ({on}) GROUP BY anonymous_id, customer_id)
QUALIFY row_number() OVER (PARTITION BY anonymous_id ORDER BY n DESC, customer_id) = 1"""


piece("by_print", _best("strangers", "owned", "ip_address, user_agent"))
piece("unprinted", "SELECT * FROM strangers s WHERE NOT EXISTS (FROM by_print p WHERE p.anonymous_id = s.anonymous_id)")
piece("owned_ip", "SELECT DISTINCT customer_id, ip_address FROM owned")
piece("by_ip", _best("unprinted", "owned_ip", "ip_address"))
piece("links", """
SELECT anonymous_id, customer_id, link_method, 'deterministic' AS confidence_tier,
 CASE link_method WHEN 'login' THEN 1.0 WHEN 'email_click_encoded' THEN 0.99 ELSE 0.98 END::DOUBLE AS confidence, linked_at, n_signals FROM sure_links
UNION ALL SELECT anonymous_id, customer_id, 'device_fingerprint', 'probabilistic', 0.55, NULL, n FROM by_print
UNION ALL SELECT anonymous_id, customer_id, 'shared_ip', 'probabilistic', 0.35, NULL, n FROM by_ip""")
piece("best_link", """
SELECT * FROM links QUALIFY row_number() OVER (PARTITION BY anonymous_id, confidence_tier ORDER BY confidence DESC, n_signals DESC, customer_id) = 1""")
piece("resolved", """
SELECT s.session_id, s.anonymous_id, session_start, num_events, is_converted, d.customer_id AS customer_id_strict,
 coalesce(d.customer_id, p.customer_id) AS customer_id_extended,
 CASE WHEN d.customer_id IS NOT NULL THEN 'deterministic' WHEN p.customer_id IS NOT NULL THEN 'probabilistic' ELSE 'unresolved' END AS resolution_tier,
 coalesce(d.link_method, p.link_method) AS resolution_method, coalesce(d.confidence, p.confidence) AS resolution_confidence, true_id
FROM sess s LEFT JOIN (SELECT * FROM best_link WHERE confidence_tier = 'deterministic') d ON s.anonymous_id = d.anonymous_id
LEFT JOIN (SELECT * FROM best_link WHERE confidence_tier = 'probabilistic') p ON s.anonymous_id = p.anonymous_id""")


# What sessions and links are made from; queries that ask for little else leave the other columns unread.
SESSION_COLUMNS = ["event_id", "event_at", "event_type", "anonymous_id", "customer_id", "ip_address", "user_agent"]


def events(spark, sf, gap=GAP, columns=None):
    raw = ad.raw_clicks(spark, sf)
    return retail.events(raw.select(*columns) if columns else raw, gap)


def links(spark, sf):
    # Links are made from the events as they come; they do not need sessions.
    return identity.bridge(ad.raw_clicks(spark, sf))


def resolved(spark, sf, columns=None):
    """Events with sessions, session rows, links and the resolved sessions; of `columns` only, if given."""
    rows = cut(events(spark, sf, columns=columns))
    per_session = identity.sessions(rows)
    found = cut(identity.bridge(rows))
    return rows, per_session, found, identity.graph(per_session, found)


# --- silver ------------------------------------------------------------------


@query("m18_categories", """
SELECT 'N' || n_nationkey AS category_id, n_name AS category_name, 'R' || n_regionkey AS parent_category_id, 2 AS category_level FROM nation
UNION ALL SELECT 'R' || r_regionkey, r_name, NULL, 1 FROM region""")
def m18_categories(spark, sf):
    return retail.categories(ad.raw_categories(spark, sf)).drop("department", "ingested_at")


@query("m18_products", "SELECT product_group_id, description FROM styles")
def m18_products(spark, sf):
    return retail.products(ad.raw_products(spark, sf)).select("product_group_id", "description")


@query("m18_variants", "SELECT * FROM variants")
def m18_variants(spark, sf):
    return retail.variants(ad.raw_variants(spark, sf)).drop("fabric", "price_band", "season", "ingested_at")


@query("m18_customer_versions", "SELECT * FROM versions")
def m18_versions(spark, sf):
    return retail.customer_versions(ad.raw_versions(spark, sf)).drop("ingested_at")


@query("m18_email_events", "SELECT * FROM emails")
def m18_emails(spark, sf):
    return retail.email_events(ad.raw_emails(spark, sf)).select(
        "email_event_id", "campaign_id", "customer_id", "event_type", "event_at")


@query("m18_events", "SELECT * EXCLUDE (user_id, k, true_id, true_session) FROM visits_short")
def m18_events(spark, sf):
    return events(spark, sf, "30 minutes").drop("_true_customer_id", "_true_session_id", "ingested_at")


@query("m18_orders", "SELECT * EXCLUDE (seller_id, commission_amount) FROM own_orders")
def m18_orders(spark, sf):
    kept = ["order_id", "customer_id", "order_at", "order_channel", "is_guest", "net_amount", "order_status"]
    return retail.orders(ad.raw_orders(spark, sf)).select(*kept)


@query("m18_order_lines", "SELECT * EXCLUDE (order_channel) FROM all_lines WHERE order_channel = 'first_party'")
def m18_lines(spark, sf):
    return retail.order_lines(ad.raw_lines(spark, sf)).drop("returned_at", "ingested_at")


@query("m18_marketplace_orders", "SELECT * FROM shop_orders")
def m18_shop(spark, sf):
    return retail.marketplace_orders(ad.raw_shop_orders(spark, sf)).drop(
        "seller_name", "commission_rate", "currency", "source_order_state", "ingested_at")


@query("m18_marketplace_lines", "SELECT * EXCLUDE (order_channel, category_id) FROM all_lines WHERE order_channel = 'marketplace'")
def m18_shop_lines(spark, sf):
    return retail.marketplace_order_lines(ad.raw_shop_lines(spark, sf)).drop("ingested_at")


@query("m18_search_logs", "SELECT * FROM search_logs")
def m18_search(spark, sf):
    return retail.search_logs(ad.raw_search_logs(spark, sf)).drop("customer_id", "_true_customer_id", "ingested_at")


# --- sessions and identity ---------------------------------------------------


@query("m19_sessions", "SELECT * RENAME (true_id AS _true_customer_id, true_session AS _true_session_id) FROM sess")
def m19(spark, sf):
    return identity.sessions(events(spark, sf))


@query("m20_bridge_identity", "SELECT * FROM links")
def m20(spark, sf):
    return links(spark, sf)


@query("m21_identity_graph", "SELECT * RENAME (true_id AS _true_customer_id) FROM resolved")
def m21(spark, sf):
    return resolved(spark, sf)[3]


@query("q9_link_precision", f"""
SELECT confidence_tier, link_method, count(*) AS links, count(*) FILTER (WHERE customer_id = true_id) AS correct,
 {R("100.0 * count(*) FILTER (WHERE customer_id = true_id) / count(*)", 1)} AS precision_pct
FROM links JOIN (SELECT DISTINCT anonymous_id, true_id FROM clicks) USING (anonymous_id) GROUP BY ALL""")
def q9(spark, sf):
    return identity.link_precision(links(spark, sf), ad.raw_clicks(spark, sf))


@query("q10_link_composition", f"""
SELECT confidence_tier, link_method, count(*) AS links, {R("avg(confidence)", 2)} AS conf FROM links GROUP BY ALL""")
def q10(spark, sf):
    return identity.link_composition(links(spark, sf))


@query("q10_session_coverage", f"""
SELECT resolution_tier, count(*) AS sessions, {R("100.0 * count(*) / sum(count(*)) OVER ()", 1)} AS pct FROM resolved GROUP BY 1""")
def q10_coverage(spark, sf):
    return identity.coverage(resolved(spark, sf)[3])


def _pr(key, col):
    return f"""SELECT '{key}' AS key, count({col}) AS resolved, count(*) FILTER (WHERE {col} = true_id) AS correct,
 {R(f"100.0 * count(*) FILTER (WHERE {col} = true_id) / nullif(count({col}), 0)", 1)} AS precision_pct,
 {R(f"100.0 * count(*) FILTER (WHERE {col} = true_id) / nullif(count(*) FILTER (WHERE true_id LIKE 'C%'), 0)", 1)} AS recall_pct FROM resolved"""


@query("q11_precision_recall", _pr("strict (deterministic)", "customer_id_strict") + " UNION ALL "
       + _pr("extended (det+prob)", "customer_id_extended"))
def q11(spark, sf):
    return identity.precision_recall(resolved(spark, sf)[3])


# --- gold --------------------------------------------------------------------

piece("dim_cust", """
SELECT md5(customer_id || '-' || version_number) AS customer_sk, * EXCLUDE (effective_at), effective_at AS valid_from,
 lead(effective_at) OVER w AS valid_to, lead(effective_at) OVER w IS NULL AS is_current
FROM versions WINDOW w AS (PARTITION BY customer_id ORDER BY version_number)""")


def dim_customer(spark, sf, *columns):
    """The dimension, with the key, the times and of the attributes only `columns`, if given."""
    # The adapter numbers versions by day, 200,000 numbers a day.
    versions = retail.customer_versions(ad.raw_versions(spark, sf))
    if columns:
        versions = versions.select("customer_id", "version_number", "effective_at", *columns)
    return gold.dim_customer(versions)


@query("m22_dim_customer", "SELECT * FROM dim_cust")
def m22(spark, sf):
    return dim_customer(spark, sf)


piece("engaged", f"""
SELECT coalesce(w.customer_id, m.customer_id) AS customer_id, coalesce(n_sessions, 0) AS n_sessions, coalesce(n_events, 0) AS n_events,
 coalesce(n_page_views, 0) AS n_page_views, coalesce(n_searches, 0) AS n_searches, coalesce(n_conv, 0) AS n_converting_sessions,
 last_seen_at, coalesce(s, 0) AS emails_sent, coalesce(o, 0) AS emails_opened, coalesce(c, 0) AS emails_clicked,
 {R("o::DOUBLE / nullif(s, 0)", 3)} AS email_open_rate, {R("c::DOUBLE / nullif(o, 0)", 3)} AS email_click_to_open_rate
FROM (SELECT customer_id_extended AS customer_id, count(*) AS n_sessions, CAST(sum(s.num_events) AS BIGINT) AS n_events,
       CAST(sum(num_page_views) AS BIGINT) AS n_page_views, CAST(sum(num_searches) AS BIGINT) AS n_searches,
       count(*) FILTER (WHERE s.is_converted) AS n_conv, max(s.session_start) AS last_seen_at
      FROM sess s JOIN resolved r ON s.session_id = r.session_id WHERE customer_id_extended IS NOT NULL GROUP BY 1) w
FULL JOIN (SELECT customer_id, count(*) FILTER (WHERE event_type = 'sent') AS s, count(*) FILTER (WHERE event_type = 'open') AS o,
       count(*) FILTER (WHERE event_type = 'click') AS c FROM emails GROUP BY 1) m ON w.customer_id = m.customer_id""")


def engagement(spark, sf):
    _, per_session, _, graph = resolved(spark, sf, SESSION_COLUMNS)
    return gold.customer_engagement(
        gold.session_summary(per_session, graph), retail.email_events(ad.raw_emails(spark, sf)))


@query("m23_customer_engagement", "SELECT * FROM engaged")
def m23(spark, sf):
    return engagement(spark, sf)


def fact_order(spark, sf):
    return gold.fact_order(
        retail.orders(ad.raw_orders(spark, sf)), retail.marketplace_orders(ad.raw_shop_orders(spark, sf)))


def dim_product(spark, sf):
    return gold.dim_product(
        retail.variants(ad.raw_variants(spark, sf)), retail.products(ad.raw_products(spark, sf)))


def fact_order_line(spark, sf):
    return gold.fact_order_line(
        retail.order_lines(ad.raw_lines(spark, sf)), retail.marketplace_order_lines(ad.raw_shop_lines(spark, sf)),
        retail.variants(ad.raw_variants(spark, sf)))


@query("m24_customer_360", f"""
SELECT d.customer_id, first_name, last_name, email, brand_line_affinity, home_size, region, loyalty_member, loyalty_tier, email_consent,
 marketing_consent, coalesce(n_orders, 0) AS n_orders, coalesce(spend, 0) AS total_net_spend, avg_order_value, first_order_at, last_order_at,
 date_diff('day', last_order_at, now_at) AS recency_days, coalesce(back, 0) AS n_returned_lines, {R("back::DOUBLE / n_lines", 3)} AS return_rate,
 coalesce(n_sessions, 0) AS n_sessions, coalesce(n_events, 0) AS n_events, coalesce(emails_opened, 0) AS emails_opened,
 coalesce(emails_clicked, 0) AS emails_clicked,
 CASE WHEN n_orders IS NULL THEN 'prospect' WHEN date_diff('day', last_order_at, now_at) <= 60 THEN 'active' ELSE 'lapsing' END AS lifecycle_stage
FROM dim_cust d CROSS JOIN (SELECT max(order_at) AS now_at FROM all_orders)
LEFT JOIN (SELECT customer_id, count(*) AS n_orders, sum(net_amount) AS spend, {R("avg(net_amount)", 2)} AS avg_order_value,
   min(order_at) AS first_order_at, max(order_at) AS last_order_at FROM all_orders WHERE order_status <> 'cancelled' AND customer_id IS NOT NULL GROUP BY 1) o
  ON d.customer_id = o.customer_id
LEFT JOIN (SELECT customer_id, count(*) FILTER (WHERE is_returned) AS back, count(*) AS n_lines FROM all_lines JOIN all_orders USING (order_id)
   WHERE customer_id IS NOT NULL GROUP BY 1) r ON d.customer_id = r.customer_id
LEFT JOIN engaged e ON d.customer_id = e.customer_id
WHERE is_current""")
def m24(spark, sf):
    attributes = ("first_name", "last_name", "email", "brand_line_affinity", "home_size", "region",
                  "loyalty_member", "loyalty_tier", "email_consent", "marketing_consent")
    return gold.customer_360(
        dim_customer(spark, sf, *attributes), fact_order(spark, sf), fact_order_line(spark, sf), engagement(spark, sf))


FACT_EVENT = """
SELECT event_id, event_at, event_type, v.anonymous_id, v.session_id, customer_id_strict, customer_id_extended, resolution_tier, page_type, product_id,
 category_id, brand_line, search_query, filter_size, filter_colour, order_id, quantity, unit_price, is_marketplace, seller_id, device_type, traffic_source
FROM visits v LEFT JOIN resolved r ON v.session_id = r.session_id"""
piece("fact_ev", FACT_EVENT)


def fact_event(spark, sf, *columns):
    """The events, with what sessions are made from and of the other columns only `columns`, if given."""
    rows, _, _, graph = resolved(spark, sf, [*SESSION_COLUMNS, *columns] if columns else None)
    return gold.fact_event(rows, graph)


@query("m25_fact_event", "SELECT * FROM fact_ev")
def m25(spark, sf):
    return fact_event(spark, sf)


@query("m26_fact_search", """
SELECT s.*, strict AS customer_id_strict, coalesce(strict, loose) AS customer_id_extended FROM search_logs s
LEFT JOIN (SELECT anonymous_id, max(customer_id) FILTER (WHERE confidence_tier = 'deterministic') AS strict,
  max(customer_id) FILTER (WHERE confidence_tier = 'probabilistic') AS loose FROM links GROUP BY 1) l ON s.anonymous_id = l.anonymous_id""")
def m26(spark, sf):
    return gold.fact_search(retail.search_logs(ad.raw_search_logs(spark, sf)), links(spark, sf))


@query("m27_session_summary", """
SELECT s.* EXCLUDE (session_customer_id, true_id, true_session), date_diff('second', s.session_start, session_end) AS duration_seconds,
 customer_id_strict, customer_id_extended, resolution_tier, resolution_confidence FROM sess s JOIN resolved r ON s.session_id = r.session_id""")
def m27(spark, sf):
    _, per_session, _, graph = resolved(spark, sf)
    return gold.session_summary(per_session, graph)


@query("m28_fact_order", "SELECT * FROM all_orders")
def m28(spark, sf):
    return fact_order(spark, sf)


@query("m29_fact_order_line", "SELECT * FROM all_lines")
def m29(spark, sf):
    return fact_order_line(spark, sf)


@query("m30_dim_category", """
SELECT 'N' || n_nationkey AS category_id, n_name AS category_name, 2 AS category_level, 'leaf' AS department, 'R' || n_regionkey AS parent_category_id,
 r_name AS parent_category_name FROM nation JOIN region ON n_regionkey = r_regionkey
UNION ALL SELECT 'R' || r_regionkey, r_name, 1, r_name, NULL, NULL FROM region""")
def m30(spark, sf):
    return gold.dim_category(retail.categories(ad.raw_categories(spark, sf)))


@query("m31_dim_product", "SELECT v.*, description FROM variants v JOIN styles USING (product_group_id)")
def m31(spark, sf):
    return dim_product(spark, sf).drop("fabric", "price_band", "season")


@query("m32_product_performance", f"""
SELECT v.variant_id, product_group_id, style_name, v.category_id, v.brand_line, price, is_in_stock, coalesce(views, 0) AS view_count,
 coalesce(carts, 0) AS add_to_cart_count, coalesce(units, 0) AS units_sold, coalesce(gross, 0) AS gross_revenue,
 coalesce(gross, 0) - coalesce(lost, 0) AS net_revenue, coalesce(back, 0) AS return_count, {R("back::DOUBLE / n", 3)} AS return_rate,
 {R("bought::DOUBLE / nullif(views, 0)", 4)} AS view_to_purchase_rate
FROM variants v LEFT JOIN (SELECT product_id, count(*) FILTER (WHERE page_type = 'pdp') AS views, count(*) FILTER (WHERE event_type = 'add_to_cart') AS carts,
  count(*) FILTER (WHERE event_type = 'purchase') AS bought FROM clicks WHERE product_id IS NOT NULL GROUP BY 1) f ON v.variant_id = product_id
LEFT JOIN (SELECT variant_id, CAST(sum(quantity) AS BIGINT) AS units, sum(line_amount) AS gross, sum(line_amount) FILTER (WHERE is_returned) AS lost,
  count(*) FILTER (WHERE is_returned) AS back, count(*) AS n FROM all_lines GROUP BY 1) s ON v.variant_id = s.variant_id""")
def m32(spark, sf):
    raw_events = retail.typed(ad.raw_clicks(spark, sf), event_at="timestamp_ntz")
    return gold.product_performance(dim_product(spark, sf), raw_events, fact_order_line(spark, sf))


# --- quality -----------------------------------------------------------------


def _check_sql(check, failures, severity="error"):
    return f"""SELECT '{check}' AS "check", '{severity}' AS severity, ({failures}) AS failures,
 CASE WHEN ({failures}) = 0 THEN 'pass' ELSE '{severity}' END AS status"""


@query("q1_not_null", _check_sql("not_null:c_name", "SELECT count(*) FROM customer WHERE c_name IS NULL") + " UNION ALL "
       + _check_sql("not_null:c_acctbal", "SELECT count(*) FROM customer WHERE c_acctbal IS NULL"))
def q1(spark, sf):
    return quality.row_checks(source(spark, sf, "customer"), not_null=["c_name", "c_acctbal"])


REPEATED = "SELECT count(*) FROM (SELECT {0} FROM {1} GROUP BY ALL HAVING count(*) > 1)"


@query("q2_unique", _check_sql("unique:o_orderkey", REPEATED.format("o_orderkey", "orders")) + " UNION ALL "
       + _check_sql("unique:c_nationkey", REPEATED.format("c_nationkey", "customer")))
def q2(spark, sf):
    return quality.report(
        quality.unique_check(source(spark, sf, "orders"), ["o_orderkey"]),
        quality.unique_check(source(spark, sf, "customer"), ["c_nationkey"]))


@query("q3_unique_combination", _check_sql(
    "unique:l_orderkey,l_linenumber", REPEATED.format("l_orderkey, l_linenumber", "lineitem")))
def q3(spark, sf):
    return quality.unique_check(source(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("q4_accepted_values", _check_sql(
    "accepted_values:event_type", "SELECT count(*) FROM events WHERE event_type NOT IN ('view','click','purchase','signup')"))
def q4(spark, sf):
    return quality.row_checks(
        source(spark, sf, "events"), accepted={"event_type": ["view", "click", "purchase", "signup"]})


@query("q5_relationships", _check_sql(
    "relationships:l_partkey", "SELECT count(*) FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size > 5)"))
def q5(spark, sf):
    parents = source(spark, sf, "part").filter("p_size > 5")
    return quality.reference_check(source(spark, sf, "lineitem"), "l_partkey", parents, "p_partkey")


@query("q6_severity", _check_sql("not_null:value", "SELECT count(*) FROM ev WHERE k % 5 = 0", "warn") + " UNION ALL "
       + _check_sql("not_null:ts", "SELECT count(*) FROM ev WHERE ts IS NULL"))
def q6(spark, sf):
    rows = ad.ev(spark, sf).withColumn("value", F.when(F.col("k") % 5 != 0, F.col("value")))
    return quality.row_checks(rows, not_null=["value", "ts"], warn=["not_null:value"])


piece("hour_spine", """
SELECT unnest(generate_series(date_trunc('hour', min(ts)), date_trunc('hour', max(ts)), INTERVAL 1 HOUR)) AS hour FROM events""")


def _anomaly_sql(base, size="abs(z)"):
    return f"""SELECT * EXCLUDE (v, z), round(z, 6) AS z_score, CASE WHEN {size} > 3 THEN 'warn' ELSE 'pass' END AS status FROM (
 SELECT *, (v - avg(v) OVER w) / nullif(stddev_samp(v) OVER w, 0) AS z FROM ({base})
 WINDOW w AS (ORDER BY hour ROWS BETWEEN 336 PRECEDING AND 1 PRECEDING))"""


@query("q7_volume_anomalies", _anomaly_sql("""
SELECT h.hour, count(e.ts) AS row_count, count(e.ts) AS v FROM hour_spine h LEFT JOIN events e ON date_trunc('hour', e.ts) = h.hour GROUP BY 1"""))
def q7(spark, sf):
    return quality.volume_anomalies(source(spark, sf, "events"), "ts").withColumn("z_score", F.round("z_score", 6))


@query("q8_freshness_anomalies", _anomaly_sql("""
SELECT hour, epoch_us(hour + INTERVAL 1 HOUR - max(newest) OVER (ORDER BY hour)) / 1e6 AS staleness_seconds, staleness_seconds AS v FROM (
 SELECT h.hour, max(e.ts) AS newest FROM hour_spine h LEFT JOIN events e ON date_trunc('hour', e.ts) = h.hour GROUP BY 1)""", "z"))
def q8(spark, sf):
    return quality.freshness_anomalies(source(spark, sf, "events"), "ts").withColumn("z_score", F.round("z_score", 6))


TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
          "embeddings", "pages", "benchmark", "labels", "conversations")


@query("q12_row_counts", " UNION ALL ".join(f"SELECT '{n}' AS \"table\", count(*) AS rows FROM {n}" for n in TABLES))
def q12_rows(spark, sf):
    return profile.row_counts({n: source(spark, sf, n) for n in TABLES})


@query("q12_identification_rate", f"""
SELECT count(*) AS sessions, CAST(sum(i) AS BIGINT) AS identified_sessions, {R("100.0 * sum(i) / count(*)", 1)} AS identified_pct FROM (
 SELECT true_session, max(CASE WHEN customer_id IS NOT NULL THEN 1 ELSE 0 END) AS i FROM clicks GROUP BY 1)""")
def q12_rate(spark, sf):
    return profile.identification_rate(ad.raw_clicks(spark, sf))


@query("q12_category_by_month", """
SELECT strftime(event_at, '%Y-%m') AS month, count(*) FILTER (WHERE category_id = 'cat1') AS cat1, count(*) FILTER (WHERE category_id = 'cat2') AS cat2,
 count(*) AS all_events FROM clicks GROUP BY 1""")
def q12_months(spark, sf):
    return profile.category_by_month(ad.raw_clicks(spark, sf), ["cat1", "cat2"])


@query("q12_top_filter_sizes", """
SELECT filter_size, count(*) AS plp_views FROM clicks WHERE page_type = 'plp' AND filter_size IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 8""")
def q12_sizes(spark, sf):
    return profile.top_filter_sizes(ad.raw_clicks(spark, sf))


@query("q12_return_rate", f"""
SELECT category_id, count(*) AS lines, {R("100.0::DOUBLE * avg(CASE WHEN is_returned THEN 1 ELSE 0 END)", 1)} AS return_pct FROM all_lines
WHERE order_channel = 'first_party' GROUP BY 1""")
def q12_returns(spark, sf):
    return profile.return_rate(retail.order_lines(ad.raw_lines(spark, sf)))


@query("q12_channel_share", f"""
SELECT a AS first_party, b AS marketplace, {R("100.0 * b / (a + b)", 1)} AS marketplace_share
FROM (SELECT count(*) AS a FROM own_orders), (SELECT count(*) AS b FROM shop_orders)""")
def q12_share(spark, sf):
    return profile.channel_share(ad.raw_orders(spark, sf), ad.raw_shop_orders(spark, sf))
