"""Queries for the recommender jobs and the activation tables."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from tidemark.operators.gram import dense_numbers
from tidemark.operators.joins import lookup
from tidemark.operators.ordered import deciles, rank_rows
from tidemark.plans import activation
from tidemark.plans.reco import blend, collaborative, copurchase, embeddings, popularity, propensity
from tidemark.session import cut
from tidemark.sources.tables import source
from tidemark.workload import adapters as ad
from tidemark.workload import retail
from tidemark.workload.published import published
from tidemark.workload.registry import piece, query, rounded as R

DIM = 64  # length of the given vectors
DAYS = 10  # recent window; the events cover one month

# --- popularity --------------------------------------------------------------

piece("demand", f"""
SELECT v.variant_id, product_group_id, style_name, v.category_id, v.brand_line, price, is_in_stock, is_active, size,
 coalesce(views, 0) AS views_all, coalesce(bought, 0) AS purchases_all, coalesce(recent, 0) AS demand_recent, coalesce(prior, 0) AS demand_prior,
 5.0::DOUBLE * coalesce(bought, 0) + coalesce(views, 0) AS popularity_score, (coalesce(recent, 0) + 1)::DOUBLE / (coalesce(prior, 0) + 1) AS trend_score
FROM variants v LEFT JOIN (
 SELECT product_id, count(*) FILTER (WHERE event_type = 'page_view') AS views, count(*) FILTER (WHERE event_type = 'purchase') AS bought,
  count(*) FILTER (WHERE event_at > newest - INTERVAL {DAYS} DAY) AS recent,
  count(*) FILTER (WHERE event_at <= newest - INTERVAL {DAYS} DAY AND event_at > newest - INTERVAL {2 * DAYS} DAY) AS prior
 FROM clicks, (SELECT max(event_at) AS newest FROM clicks) WHERE product_id IS NOT NULL GROUP BY 1) e ON v.variant_id = product_id""")


def _clicks(spark, sf):
    return ad.raw_clicks(spark, sf)


@query("k1_popularity", """
SELECT * EXCLUDE (is_active, size), row_number() OVER (ORDER BY popularity_score DESC, variant_id) AS rank_overall,
 row_number() OVER (PARTITION BY category_id ORDER BY popularity_score DESC, variant_id) AS rank_in_category FROM demand""")
def k1(spark, sf):
    return popularity.popularity(_clicks(spark, sf), retail.dim_product(spark, sf), DAYS)


# --- co-purchase -------------------------------------------------------------

piece("bought", "SELECT order_id, customer_id, product_group_id FROM all_lines JOIN all_orders USING (order_id) JOIN variants USING (variant_id)")
piece("tx", """
SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY t) AS n FROM (
 SELECT DISTINCT 'o:' || order_id AS t, product_group_id AS g, 2.0::DOUBLE AS w FROM bought
 UNION ALL SELECT DISTINCT 'c:' || customer_id, product_group_id, 1.0 FROM bought WHERE customer_id IS NOT NULL)) WHERE n >= 2""")
piece("occ", "SELECT g, sum(w) AS o FROM tx GROUP BY 1")
piece("style_of", "SELECT product_group_id, arg_min(style_name, variant_id) AS style_name, arg_min(category_id, variant_id) AS category_id FROM variants GROUP BY 1")
piece("bought_with", """
SELECT * FROM (
 SELECT p.g AS product_group_id, p.h AS neighbour_product_group_id, c AS cooc_weight, c / sqrt(a.o * b.o) AS score,
  row_number() OVER (PARTITION BY p.g ORDER BY c / sqrt(a.o * b.o) DESC, p.h) AS rank
 FROM (SELECT x.g, y.g AS h, sum(x.w) AS c FROM tx x JOIN tx y ON x.t = y.t AND x.g <> y.g GROUP BY x.g, y.g HAVING sum(x.w) >= 2) p
 JOIN occ a ON p.g = a.g JOIN occ b ON p.h = b.g) WHERE rank <= 10""")


def co_purchase(spark, sf):
    return copurchase.co_purchase(
        retail.fact_order_line(spark, sf), retail.fact_order(spark, sf), retail.dim_product(spark, sf))


@query("k2_co_purchase", """
SELECT b.product_group_id, s.style_name, s.category_id, neighbour_product_group_id, n.style_name AS neighbour_style_name,
 n.category_id AS neighbour_category_id, cooc_weight, round(score, 9) AS score, rank
FROM bought_with b JOIN style_of s ON b.product_group_id = s.product_group_id JOIN style_of n ON neighbour_product_group_id = n.product_group_id""")
def k2(spark, sf):
    return co_purchase(spark, sf).withColumn("score", F.round("score", 9))


# The same over variants, of which there are several blocks.
piece("bought_variants", "SELECT order_id, customer_id, variant_id FROM all_lines JOIN all_orders USING (order_id) JOIN variants USING (variant_id)")
piece("tx_variants", """
SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY t) AS n FROM (
 SELECT DISTINCT 'o:' || order_id AS t, variant_id AS g, 2.0::DOUBLE AS w FROM bought_variants
 UNION ALL SELECT DISTINCT 'c:' || customer_id, variant_id, 1.0 FROM bought_variants WHERE customer_id IS NOT NULL)) WHERE n >= 2""")
piece("occ_variants", "SELECT g, sum(w) AS o FROM tx_variants GROUP BY 1")


@query("k2_co_purchase_variants", """
SELECT variant_id, neighbour_variant_id, cooc_weight, round(score, 9) AS score, rank FROM (
 SELECT p.g AS variant_id, p.h AS neighbour_variant_id, c AS cooc_weight, c / sqrt(a.o * b.o) AS score,
  row_number() OVER (PARTITION BY p.g ORDER BY c / sqrt(a.o * b.o) DESC, p.h) AS rank
 FROM (SELECT x.g, y.g AS h, sum(x.w) AS c FROM tx_variants x JOIN tx_variants y ON x.t = y.t AND x.g <> y.g GROUP BY x.g, y.g HAVING sum(x.w) >= 2) p
 JOIN occ_variants a ON p.g = a.g JOIN occ_variants b ON p.h = b.g) WHERE rank <= 10""")
def k2_variants(spark, sf):
    own = retail.dim_product(spark, sf).withColumn("product_group_id", F.col("variant_id"))
    found = copurchase.co_purchase(retail.fact_order_line(spark, sf), retail.fact_order(spark, sf), own)
    return found.select(
        F.col("product_group_id").alias("variant_id"), F.col("neighbour_product_group_id").alias("neighbour_variant_id"),
        "cooc_weight", F.round("score", 9).alias("score"), "rank")


# --- collaborative filtering -------------------------------------------------


# Views and carts of resolved customers; all that follows learns from them, not from purchases.
piece("browsed_events", """
SELECT customer_id_extended AS customer_id, product_group_id, event_type, event_at FROM fact_ev JOIN variants ON product_id = variant_id
WHERE customer_id_extended IS NOT NULL AND event_type IN ('page_view', 'add_to_cart')""")
piece("inter", """
SELECT customer_id, product_group_id, CAST(sum(CASE WHEN event_type = 'add_to_cart' THEN 3 ELSE 1 END) AS BIGINT) AS weight,
 max(event_at) AS last_at FROM browsed_events GROUP BY ALL""")
piece("browsed", "SELECT customer_id, product_group_id, count(*) AS n FROM browsed_events GROUP BY ALL")


@query("k3_interactions", "SELECT * FROM inter")
def k3(spark, sf):
    return interactions(spark, sf)


def events(spark, sf):
    columns = ["customer_id_extended", "session_id", "event_type", "event_at", "product_id"]
    return published(spark, sf, "events", lambda: retail.fact_event(spark, sf, "product_id").select(*columns))


def interactions(spark, sf):
    return collaborative.interactions(events(spark, sf), retail.dim_product(spark, sf))


def browsed(spark, sf):
    return collaborative.browsed(events(spark, sf), retail.dim_product(spark, sf)).select(
        "customer_id", "product_group_id")


def cf_lists(spark, sf):
    return published(spark, sf, "cf", lambda: collaborative.recommend(interactions(spark, sf)))


def tastes_of(spark, sf):
    return published(
        spark, sf, "tastes", lambda: embeddings.embed_customers(browsed(spark, sf), group_vectors(spark, sf), DIM))


def _cf_pieces(prefix: str, table: str, customers: str) -> None:
    """Oracle pieces of item-based filtering over an interaction table."""
    piece(f"{prefix}sq", f"SELECT product_group_id AS g, sum(weight * weight)::DOUBLE AS sq, ln((1 + {customers}) / (1 + count(*))) + 1 AS idf FROM {table} GROUP BY 1")
    piece(f"{prefix}sim", f"""
SELECT p.g, p.h, d / sqrt(a.sq * b.sq) AS sim FROM (
 SELECT x.product_group_id AS g, y.product_group_id AS h, sum(x.weight * y.weight)::DOUBLE AS d FROM {table} x JOIN {table} y
 ON x.customer_id = y.customer_id AND x.product_group_id <> y.product_group_id GROUP BY ALL) p
JOIN {prefix}sq a ON p.g = a.g JOIN {prefix}sq b ON p.h = b.g
QUALIFY row_number() OVER (PARTITION BY p.g ORDER BY d / sqrt(a.sq * b.sq) DESC, p.h) <= 20""")
    piece(f"{prefix}rec", f"""
SELECT c.customer_id, g.product_group_id, coalesce(score, 0) AS score,
 row_number() OVER (PARTITION BY c.customer_id ORDER BY round(coalesce(score, 0), 9) DESC, g.product_group_id) AS rank
FROM (SELECT DISTINCT customer_id FROM {table}) c CROSS JOIN (SELECT DISTINCT product_group_id FROM inter) g LEFT JOIN (
 SELECT customer_id, h, sum(weight * idf * sim) AS score FROM {table} i JOIN {prefix}sim s ON i.product_group_id = s.g
 JOIN {prefix}sq q ON i.product_group_id = q.g GROUP BY customer_id, h) p ON p.customer_id = c.customer_id AND p.h = g.product_group_id
WHERE NOT EXISTS (FROM {table} o WHERE o.customer_id = c.customer_id AND o.product_group_id = g.product_group_id)""")


_cf_pieces("cf_", "inter", "(SELECT count(DISTINCT customer_id) FROM inter)")


@query("k4_cf_recommend", """
SELECT customer_id, product_group_id, style_name, category_id, round(score, 6) AS score, rank
FROM cf_rec LEFT JOIN style_of USING (product_group_id) WHERE rank <= 20""")
def k4(spark, sf):
    recs = collaborative.recommend(interactions(spark, sf))
    names = copurchase.group_names(retail.dim_product(spark, sf))
    named = lookup(recs, names, "product_group_id", {"style_name": "style_name", "category_id": "category_id"})
    return named.withColumn("score", F.round("score", 6))


piece("held", """
SELECT customer_id, product_group_id FROM (SELECT *, count(*) OVER (PARTITION BY customer_id) AS n FROM inter) WHERE n >= 2
QUALIFY row_number() OVER (PARTITION BY customer_id ORDER BY md5(customer_id || ':' || product_group_id), product_group_id) = 1""")
piece("train", "SELECT * FROM inter i WHERE NOT EXISTS (FROM held h WHERE h.customer_id = i.customer_id AND h.product_group_id = i.product_group_id)")
_cf_pieces("ev_", "train", "(SELECT count(DISTINCT customer_id) FROM inter)")
piece("place", """
SELECT g.product_group_id, row_number() OVER (ORDER BY coalesce(p, 0) DESC, g.product_group_id) AS place
FROM (SELECT DISTINCT product_group_id FROM inter) g LEFT JOIN (SELECT product_group_id, sum(weight) AS p FROM train GROUP BY 1) t
ON g.product_group_id = t.product_group_id""")


@query("k5_cf_evaluate", """
SELECT n_eval, cf_hits, base_hits, cf_hits / n_eval AS cf_hit_rate, base_hits / n_eval AS base_hit_rate FROM
 (SELECT count(*) AS n_eval FROM held),
 (SELECT count(*) AS cf_hits FROM held JOIN ev_rec USING (customer_id, product_group_id) WHERE rank <= 10),
 (SELECT count(*) AS base_hits FROM (
   SELECT h.customer_id, p.place - (SELECT count(*) FROM train t JOIN place q ON t.product_group_id = q.product_group_id
     WHERE t.customer_id = h.customer_id AND q.place < p.place) AS position
   FROM held h JOIN place p ON h.product_group_id = p.product_group_id) WHERE position <= 10)""")
def k5(spark, sf):
    return collaborative.evaluate(interactions(spark, sf))


# --- embeddings --------------------------------------------------------------


@query("k6_embed_text")
def k6(spark, sf):
    return embeddings.embed_text(source(spark, sf, "documents"), "doc_id", "text")


piece("group_vec", """
SELECT p_name AS product_group_id, embedding::DOUBLE[] AS embedding FROM (
 SELECT p_name, row_number() OVER (ORDER BY p_name) - 1 AS n FROM (SELECT DISTINCT p_name FROM part)) JOIN embeddings ON vec_id = n""")


def group_vectors(spark, sf):
    names = source(spark, sf, "part").select(F.col("p_name").alias("product_group_id"))
    numbers = dense_numbers(names, "product_group_id", "vec_id")
    vectors = source(spark, sf, "embeddings").select(
        "vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    return numbers.join(vectors, "vec_id").drop("vec_id")


piece("taste", """
SELECT customer_id, list(s / l ORDER BY i) AS embedding FROM (
 SELECT customer_id, i, s, sqrt(sum(s * s) OVER (PARTITION BY customer_id)) AS l FROM (
  SELECT customer_id, i, sum(x * n) AS s FROM browsed JOIN (
   SELECT product_group_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM group_vec) USING (product_group_id) GROUP BY ALL))
GROUP BY 1""")


@query("k7_embed_customers", "SELECT customer_id, list_transform(embedding, lambda x: round(x, 6)) AS embedding FROM taste")
def k7(spark, sf):
    out = embeddings.embed_customers(browsed(spark, sf), group_vectors(spark, sf), DIM)
    return out.withColumn("embedding", F.transform("embedding", lambda x: F.round(x, 6)))


@query("k8_nearest", """
SELECT e.vec_id, round(list_cosine_similarity(e.embedding::DOUBLE[], s.embedding::DOUBLE[]), 6) AS cos
FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = (SELECT min(vec_id) FROM embeddings WHERE label = 3)) s
WHERE vec_id <> (SELECT min(vec_id) FROM embeddings WHERE label = 3) ORDER BY 2 DESC, 1 LIMIT 5""")
def k8(spark, sf):
    rows = source(spark, sf, "embeddings")
    seed_key = rows.filter("label = 3").agg(F.min("vec_id")).scalar()
    seed = rows.filter("label = 3").agg(F.min_by("embedding", "vec_id")).scalar()
    near = embeddings.nearest(rows, "vec_id", "embedding", seed, seed_key)
    return near.withColumn("cos", F.round("cos", 6))


@query("k8_nearest_for_all", """
SELECT s.vec_id AS seed, e.vec_id, round(list_cosine_similarity(e.embedding::DOUBLE[], s.embedding::DOUBLE[]), 6) AS cos,
 row_number() OVER (PARTITION BY s.vec_id ORDER BY round(list_cosine_similarity(e.embedding::DOUBLE[], s.embedding::DOUBLE[]), 12) DESC, e.vec_id) AS rank
FROM embeddings e JOIN embeddings s ON e.vec_id <> s.vec_id QUALIFY rank <= 5""")
def k8_all(spark, sf):
    rows = source(spark, sf, "embeddings")
    return embeddings.nearest_for_all(rows, rows, "vec_id", "embedding").withColumn("cos", F.round("cos", 6))


# --- propensity --------------------------------------------------------------

# The events are moved back into the years of the orders.
SHIFT_DAYS = 8500
CUTOFF = datetime(2000, 10, 10)
piece("feat", f"""
SELECT c.customer_id, coalesce(n_sessions, 0) AS n_sessions, coalesce(n_events, 0) AS n_events, coalesce(views, 0) AS n_page_views, coalesce(searches, 0) AS n_searches,
 coalesce(carts, 0) AS n_add_to_cart, last_event_at, coalesce(n_orders, 0) AS n_orders, coalesce(spend, 0) AS total_spend, last_order_at,
 coalesce(o, 0) AS emails_opened, coalesce(k, 0) AS emails_clicked, CASE WHEN loyalty_member THEN 1 ELSE 0 END AS loyalty_member, loyalty_tier, brand_line_affinity,
 CASE WHEN n_orders > 0 THEN 1 ELSE 0 END AS has_prior_order,
 coalesce(CAST(floor(epoch_us(TIMESTAMP '{CUTOFF}' - last_event_at) / 86400000000) AS BIGINT), 999) AS recency_days,
 coalesce(CAST(floor(epoch_us(TIMESTAMP '{CUTOFF}' - last_order_at) / 86400000000) AS BIGINT), 999) AS order_recency_days,
 coalesce(spend / n_orders, 0) AS avg_order_value, CASE WHEN loyalty_tier = 'Gold' THEN 1 ELSE 0 END AS is_gold,
 CASE WHEN brand_line_affinity = 'Petite' THEN 1 ELSE 0 END AS is_petite
FROM (SELECT customer_id_extended AS customer_id FROM fact_ev WHERE customer_id_extended IS NOT NULL AND event_at - INTERVAL {SHIFT_DAYS} DAY < TIMESTAMP '{CUTOFF}'
  UNION SELECT customer_id FROM all_orders WHERE order_status <> 'cancelled' AND order_at < TIMESTAMP '{CUTOFF}' AND customer_id IS NOT NULL
  UNION SELECT customer_id FROM emails WHERE event_at - INTERVAL {SHIFT_DAYS} DAY < TIMESTAMP '{CUTOFF}') c
LEFT JOIN (SELECT customer_id_extended AS id, count(DISTINCT session_id) AS n_sessions, count(*) AS n_events, count(*) FILTER (WHERE event_type = 'page_view') AS views,
  count(*) FILTER (WHERE event_type = 'search') AS searches, count(*) FILTER (WHERE event_type = 'add_to_cart') AS carts,
  max(event_at) - INTERVAL {SHIFT_DAYS} DAY AS last_event_at FROM fact_ev WHERE event_at - INTERVAL {SHIFT_DAYS} DAY < TIMESTAMP '{CUTOFF}' GROUP BY 1) w ON c.customer_id = w.id
LEFT JOIN (SELECT customer_id AS id, count(*) AS n_orders, sum(net_amount) AS spend, max(order_at) AS last_order_at FROM all_orders
  WHERE order_status <> 'cancelled' AND order_at < TIMESTAMP '{CUTOFF}' GROUP BY 1) b ON c.customer_id = b.id
LEFT JOIN (SELECT customer_id AS id, count(*) FILTER (WHERE event_type = 'open') AS o, count(*) FILTER (WHERE event_type = 'click') AS k FROM emails
  WHERE event_at - INTERVAL {SHIFT_DAYS} DAY < TIMESTAMP '{CUTOFF}' GROUP BY 1) m ON c.customer_id = m.id
LEFT JOIN (SELECT customer_id AS id, loyalty_member, loyalty_tier, brand_line_affinity FROM dim_cust WHERE is_current) d ON c.customer_id = d.id""")


def features(spark, sf, cutoff=CUTOFF):
    from tidemark.plans import retail as silver

    back = F.expr(f"INTERVAL {SHIFT_DAYS} DAYS")
    moved = events(spark, sf).withColumn("event_at", F.col("event_at") - back)
    mails = silver.email_events(ad.raw_emails(spark, sf)).withColumn("event_at", F.col("event_at") - back)
    return propensity.features_asof(
        moved, retail.fact_order(spark, sf), mails,
        retail.dim_customer(spark, sf, "loyalty_member", "loyalty_tier", "brand_line_affinity"), cutoff)


@query("k9_features_asof", "SELECT * FROM feat")
def k9(spark, sf):
    return features(spark, sf)


@query("k10_label", f"""
SELECT customer_id, CASE WHEN customer_id IN (SELECT customer_id FROM all_orders WHERE order_status <> 'cancelled' AND customer_id IS NOT NULL
 AND order_at >= TIMESTAMP '{CUTOFF}') THEN 1 ELSE 0 END AS label FROM feat""")
def k10(spark, sf):
    marked = propensity.label(features(spark, sf), retail.fact_order(spark, sf), CUTOFF)
    return marked.select("customer_id", "label")


def _trained(spark, sf):
    rows = cut(propensity.label(features(spark, sf), retail.fact_order(spark, sf), CUTOFF))
    train, test = propensity.split(rows)
    return rows, test, propensity.fit(train)


@query("k11_fit_propensity")
def k11(spark, sf):
    _, _, model = _trained(spark, sf)
    return spark.createDataFrame(propensity.drivers(model), "feature string, coefficient double")


@query("k12_evaluate")
def k12(spark, sf):
    _, test, model = _trained(spark, sf)
    return propensity.evaluate(propensity.predict(model, test))


piece("spent", f"""
SELECT customer_id, total_spend + n_sessions AS s, CASE WHEN customer_id IN (SELECT customer_id FROM all_orders WHERE order_status <> 'cancelled' AND customer_id IS NOT NULL
 AND order_at >= TIMESTAMP '{CUTOFF}') THEN 1 ELSE 0 END AS label FROM feat""")


piece("spent_ranks", """
SELECT *, (rank() OVER (ORDER BY s) + rank() OVER (ORDER BY s) + count(*) OVER (PARTITION BY s) - 1) / 2.0 AS mean_rank,
 row_number() OVER (ORDER BY s, customer_id) AS rn, count(*) OVER () AS n, sum(label) OVER () AS p FROM spent""")
piece("spent_steps", """
SELECT h, sum(h) OVER w AS hits, sum(c) OVER w AS seen FROM (SELECT s, sum(label) AS h, count(*) AS c FROM spent GROUP BY s) WINDOW w AS (ORDER BY s DESC)""")
piece("spent_top", "SELECT avg(label) AS rate FROM spent_ranks WHERE greatest(1, ceil((rn - 1) * 10.0 / (n - 1))) = 10")


@query("k12_metrics_of_a_score", """
SELECT count(*) AS n_test, round((sum(mean_rank) FILTER (WHERE label = 1) - any_value(p) * (any_value(p) + 1) / 2.0) / (any_value(p) * (any_value(n) - any_value(p))), 9) AS roc_auc,
 (SELECT round(sum(hits / seen * h) / sum(h), 9) FROM spent_steps) AS pr_auc, round(avg(label), 9) AS base_rate, (SELECT round(rate, 9) FROM spent_top) AS top_decile_rate,
 round((SELECT rate FROM spent_top) / greatest(avg(label), 1e-9), 9) AS lift FROM spent_ranks""")
def k12_metrics(spark, sf):
    """The evaluation of a score that SQL can make too: what a customer spent, with ties."""
    marked = propensity.label(features(spark, sf), retail.fact_order(spark, sf), CUTOFF)
    scored = marked.withColumn("purchase_propensity", (F.col("total_spend") + F.col("n_sessions")).cast("double"))
    out = propensity.evaluate(scored)
    return out.select("n_test", *[F.round(c, 9).alias(c) for c in out.columns if c != "n_test"])


def window_end(spark, sf):
    """Just after the newest order: every event and order so far counts."""
    newest = source(spark, sf, "orders").agg(F.max("o_orderdate").cast("date")).first()[0]
    return datetime(newest.year, newest.month, newest.day) + timedelta(days=1)


@query("k13_score")
def k13(spark, sf):
    """Scores as of the end of the window, by the model trained at the cutoff."""
    _, _, model = _trained(spark, sf)
    return propensity.score(model, cut(features(spark, sf, window_end(spark, sf))))


# --- blended ranking ---------------------------------------------------------

piece("pop_group", "SELECT product_group_id, sum(popularity_score) AS pop FROM demand GROUP BY 1")
piece("seeds", "SELECT customer_id, product_group_id FROM browsed QUALIFY row_number() OVER (PARTITION BY customer_id ORDER BY n DESC, product_group_id) <= 5")


def _mm(col, part="customer_id"):
    lo, hi = f"min({col}) OVER (PARTITION BY {part})", f"max({col}) OVER (PARTITION BY {part})"
    return f"coalesce(CASE WHEN {hi} > {lo} THEN ({col} - {lo}) / ({hi} - {lo}) ELSE 0 END, 0)::DOUBLE"


piece("blended", f"""
SELECT customer_id, product_group_id, cf_score, copurchase_score, embedding_score, popularity_score, b,
 row_number() OVER (PARTITION BY customer_id ORDER BY round(b, 9) DESC, product_group_id) AS group_rank FROM (
 SELECT *, 0.40::DOUBLE * cf_score + 0.25::DOUBLE * copurchase_score + 0.20::DOUBLE * embedding_score + 0.15::DOUBLE * popularity_score AS b FROM (
  SELECT customer_id, product_group_id, {_mm("cf")} AS cf_score, {_mm("cp")} AS copurchase_score, {_mm("em")} AS embedding_score, {_mm("pop")} AS popularity_score FROM (
   SELECT c.customer_id, c.product_group_id, max(cf) AS cf, max(cp) AS cp, any_value(pop) AS pop,
    any_value(list_dot_product(t.embedding, v.embedding)) AS em FROM (
     SELECT customer_id, product_group_id, score AS cf, 0 AS cp FROM cf_rec WHERE rank <= 20
     UNION ALL SELECT s.customer_id, neighbour_product_group_id, 0, score FROM seeds s JOIN bought_with b ON s.product_group_id = b.product_group_id
     UNION ALL SELECT customer_id, product_group_id, 0, 0 FROM taste, (SELECT product_group_id FROM pop_group ORDER BY pop DESC, product_group_id LIMIT 30)) c
   JOIN taste t ON c.customer_id = t.customer_id LEFT JOIN group_vec v ON c.product_group_id = v.product_group_id
   LEFT JOIN pop_group p ON c.product_group_id = p.product_group_id
   WHERE NOT EXISTS (FROM seeds s WHERE s.customer_id = c.customer_id AND s.product_group_id = c.product_group_id)
   GROUP BY c.customer_id, c.product_group_id))) QUALIFY group_rank <= 20""")
piece("cards", "SELECT * FROM variants WHERE is_in_stock AND is_active")
# The rank counts what is left after the choice of a variant, so it is taken one level up.
piece("ranked", f"""
SELECT customer_id, product_group_id, variant_id, style_name, category_id, size, {R("price", 2)} AS price, {R("b", 4)} AS final_score,
 {R("cf_score", 3)} AS cf_score, {R("copurchase_score", 3)} AS copurchase_score, {R("embedding_score", 3)} AS embedding_score,
 {R("popularity_score", 3)} AS popularity_score, row_number() OVER (PARTITION BY customer_id ORDER BY {R("b", 4)} DESC, group_rank) AS rank
FROM (SELECT r.*, c.* EXCLUDE (product_group_id) FROM blended r JOIN (SELECT customer_id, home_size FROM dim_cust WHERE is_current) d ON r.customer_id = d.customer_id
 JOIN cards c ON r.product_group_id = c.product_group_id
 QUALIFY row_number() OVER (PARTITION BY r.customer_id, r.product_group_id ORDER BY c.size = d.home_size DESC, c.variant_id) = 1)""")


def demand_by_group(spark, sf):
    scores = popularity.demand(_clicks(spark, sf), retail.dim_product(spark, sf), DAYS)
    return scores.groupBy("product_group_id").agg(F.sum("popularity_score").alias("pop"))


def blended(spark, sf):
    near = published(spark, sf, "co_purchase", lambda: co_purchase(spark, sf).select(
        "product_group_id", "neighbour_product_group_id", "score"))
    popular = published(spark, sf, "demand_by_group", lambda: demand_by_group(spark, sf))
    tastes, seeds = tastes_of(spark, sf), cut(blend.recent_groups(browsed(spark, sf)))
    cands = blend.candidates(tastes, cf_lists(spark, sf), near, seeds, popular)
    return blend.blend(cands, tastes, group_vectors(spark, sf), popular)


@query("k14_blend", """
SELECT customer_id, product_group_id, round(cf_score, 6) AS cf_score, round(copurchase_score, 6) AS copurchase_score,
 round(embedding_score, 6) AS embedding_score, round(popularity_score, 6) AS popularity_score, round(b, 6) AS blended, group_rank FROM blended""")
def k14(spark, sf):
    rows = blended(spark, sf)
    names = [f"{s}_score" for s in blend.WEIGHTS] + ["blended"]
    return rows.withColumns({n: F.round(n, 6) for n in names})


def ranked(spark, sf):
    return blend.ranked_recommendations(
        blended(spark, sf), retail.dim_product(spark, sf), retail.dim_customer(spark, sf, "home_size").filter("is_current"))


def ranked_lists(spark, sf):
    return published(spark, sf, "ranked", lambda: ranked(spark, sf))


@query("k15_expand_variant", "SELECT * FROM ranked")
def k15(spark, sf):
    return ranked(spark, sf)


# --- activation --------------------------------------------------------------

piece("requests_in", """
SELECT c_custkey AS request_id, CASE WHEN c_custkey % 10 = 0 THEN 'Zzz' ELSE upper(p_name) || ' ' || p_type END AS query,
 CASE WHEN c_custkey % 3 <> 0 THEN 'C' || c_custkey END AS customer_id FROM customer JOIN part ON p_partkey = c_custkey""")
piece("shelf", """
SELECT c.variant_id, c.product_group_id, c.style_name, c.category_id, c.colour, c.size, c.price, d.popularity_score AS popularity,
 lower(c.style_name || ' ' || c.category_id || ' ' || c.brand_line || ' ' || colour || ' ' || pattern) AS words
FROM cards c JOIN demand d ON c.variant_id = d.variant_id""")
piece("asked", "SELECT DISTINCT query FROM requests_in")
piece("matched", """
SELECT query, s.*, list_sum(list_transform(string_split(lower(query), ' '), lambda w: CASE WHEN contains(words, w) THEN 1 ELSE 0 END)) AS relevance
FROM asked, shelf s""")
piece("pool", f"""
SELECT *, 0.6::DOUBLE * {_mm("relevance", "query")} + 0.4::DOUBLE * {_mm("popularity", "query")} AS base FROM (
 SELECT * FROM matched m WHERE relevance > 0 OR NOT EXISTS (FROM matched o WHERE o.query = m.query AND o.relevance > 0)
 QUALIFY row_number() OVER (PARTITION BY query ORDER BY relevance DESC, popularity DESC, variant_id) <= 60)""")


def _requests(spark, sf):
    rows = source(spark, sf, "customer").join(source(spark, sf, "part"), F.col("p_partkey") == F.col("c_custkey"))
    key = F.col("c_custkey")
    text = F.when(key % 10 == 0, "Zzz").otherwise(F.concat(F.upper("p_name"), F.lit(" "), "p_type"))
    return rows.select(key.alias("request_id"), text.alias("query"), F.when(key % 3 != 0, ad.tag("C", key)).alias("customer_id"))


def _scores(spark, sf):
    return popularity.demand(_clicks(spark, sf), retail.dim_product(spark, sf), DAYS)


@query("x1_search_rerank", f"""
SELECT request_id, query, customer_id, known AS personalized, rank, variant_id, style_name, category_id, colour, size, {R("price", 2)} AS price, {R("final", 4)} AS score FROM (
 SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY final DESC, variant_id) AS rank FROM (SELECT * FROM (
  SELECT *, round(CASE WHEN known THEN 0.6::DOUBLE * base + 0.4::DOUBLE * (0.6::DOUBLE * {_mm("em", "request_id")} + 0.4::DOUBLE * {_mm("cf", "request_id")}) ELSE base END, 9) AS final FROM (
   SELECT q.request_id, q.customer_id, p.*, t.embedding IS NOT NULL AS known, home_size, coalesce(list_dot_product(t.embedding, v.embedding), 0) AS em, coalesce(r.score, 0) AS cf
   FROM requests_in q JOIN pool p ON q.query = p.query LEFT JOIN taste t ON q.customer_id = t.customer_id
   LEFT JOIN (SELECT customer_id, home_size FROM dim_cust WHERE is_current) d ON q.customer_id = d.customer_id
   LEFT JOIN group_vec v ON p.product_group_id = v.product_group_id
   LEFT JOIN (SELECT * FROM cf_rec WHERE rank <= 20) r ON q.customer_id = r.customer_id AND p.product_group_id = r.product_group_id))
 QUALIFY row_number() OVER (PARTITION BY request_id, product_group_id ORDER BY coalesce(size = home_size, false) DESC, final DESC, variant_id) = 1))
WHERE rank <= 10""")
def x1(spark, sf):
    sizes = retail.dim_customer(spark, sf, "home_size").filter("is_current").select("customer_id", "home_size")
    items = cut(activation.catalogue(retail.dim_product(spark, sf), _scores(spark, sf)))
    return activation.search_rerank(
        _requests(spark, sf), items, sizes.join(tastes_of(spark, sf), "customer_id", "left"),
        cf_lists(spark, sf), group_vectors(spark, sf))


FALLBACK = """SELECT variant_id, style_name, category_id, price, NULL::VARCHAR AS size, NULL::DOUBLE AS score, row_number() OVER (ORDER BY popularity_score DESC, variant_id) AS rank
 FROM demand WHERE is_in_stock QUALIFY rank <= 10"""


@query("x2_homepage", f"""
SELECT customer_id, 'ranking' AS source, rank, variant_id, style_name, category_id, size, price, final_score FROM ranked WHERE rank <= 10
UNION ALL SELECT customer_id, 'popularity_fallback', rank, variant_id, style_name, category_id, size, price, score
 FROM (SELECT 'C' || c_custkey AS customer_id FROM customer UNION ALL SELECT 'V' || s_suppkey FROM supplier) c, ({FALLBACK})
 WHERE customer_id NOT IN (SELECT customer_id FROM ranked)""")
def x2(spark, sf):
    known = source(spark, sf, "customer").select(ad.tag("C", "c_custkey").alias("customer_id"))
    strangers = source(spark, sf, "supplier").select(ad.tag("V", "s_suppkey").alias("customer_id"))
    return activation.homepage(known.unionByName(strangers), ranked_lists(spark, sf), _scores(spark, sf))


@query("x3_product_page", f"""
SELECT b.product_group_id, 'co_purchase' AS source, rank, variant_id, n.style_name, n.category_id, price, round(score, 9) AS score FROM bought_with b
 JOIN style_of n ON neighbour_product_group_id = n.product_group_id
 LEFT JOIN (SELECT product_group_id, min(variant_id) AS variant_id, arg_min(price, variant_id) AS price FROM cards GROUP BY 1) c ON c.product_group_id = neighbour_product_group_id
UNION ALL SELECT g.product_group_id, 'popularity_fallback', rank, variant_id, style_name, category_id, price, score
 FROM (SELECT DISTINCT product_group_id FROM variants WHERE product_group_id NOT IN (SELECT product_group_id FROM bought_with)) g, ({FALLBACK})""")
def x3(spark, sf):
    pages = activation.product_page(co_purchase(spark, sf), retail.dim_product(spark, sf), _scores(spark, sf))
    return pages.withColumn("score", F.round("score", 9))


piece("likely", """
SELECT 'C' || c_custkey AS customer_id, (c_acctbal + 1000) / 11000 AS p, CAST(greatest(1, ceil((rn - 1) * 10.0 / (n - 1))) AS INTEGER) AS d FROM (
 SELECT *, row_number() OVER (ORDER BY c_acctbal, c_custkey) AS rn, count(*) OVER () AS n FROM customer)""")


def likely(spark, sf):
    """A propensity for every customer, read off the account balance."""
    ranked_rows = rank_rows(source(spark, sf, "customer"), [F.asc("c_acctbal"), F.asc("c_custkey")], "rn")
    return deciles(ranked_rows, "rn", "propensity_decile").select(
        ad.tag("C", "c_custkey").alias("customer_id"),
        ((F.col("c_acctbal") + 1000) / 11000).alias("purchase_propensity"), "propensity_decile")


REC_FIELDS = ("style_name", "category_id", "variant_id", "price")


def export_columns(out):
    """Every field of the recommendations as a list of its own, which SQL compares."""
    return out.withColumns({f"rec_{f}": F.col(f"recommendations.{f}") for f in REC_FIELDS}).drop("recommendations")


@query("x4_email_export", f"""
SELECT a.customer_id, email, first_name, {R("p", 4)} AS propensity, d AS propensity_decile,
 {", ".join(f"coalesce((SELECT list({f} ORDER BY rank) FROM ranked r WHERE r.customer_id = a.customer_id AND rank <= 3), []) AS rec_{f}" for f in REC_FIELDS)}
FROM (SELECT l.*, email, first_name FROM likely l JOIN dim_cust c ON l.customer_id = c.customer_id AND is_current
 WHERE marketing_consent AND d >= 5 ORDER BY p DESC, l.customer_id LIMIT 100) a""")
def x4(spark, sf):
    people = retail.dim_customer(spark, sf, "email", "first_name", "marketing_consent").filter("is_current")
    return export_columns(activation.email_export(cut(likely(spark, sf)), people, ranked_lists(spark, sf), min_decile=5))


@query("x4_email_export_scored")
def x4_scored(spark, sf):
    """The export as it is used: by the scores of the propensity model."""
    people = retail.dim_customer(spark, sf, "email", "first_name", "marketing_consent").filter("is_current")
    return export_columns(activation.email_export(cut(k13(spark, sf)), people, ranked_lists(spark, sf)))


def context(spark, sf, scores):
    people = retail.dim_customer(spark, sf, "home_size", "email", "marketing_consent").filter("is_current")
    strangers = source(spark, sf, "supplier").select(ad.tag("V", "s_suppkey").alias("customer_id"))
    asked = people.select("customer_id").unionByName(strangers)
    return activation.customer_context(asked, people, tastes_of(spark, sf), cf_lists(spark, sf), scores)


@query("x5_customer_context", f"""
SELECT q.customer_id, c.customer_id IS NOT NULL AS known, home_size, email, coalesce(marketing_consent, false) AS marketing_consent,
 {R("p", 6)} AS propensity, d AS propensity_decile, list_transform(embedding, lambda x: round(x, 6)) AS embedding,
 coalesce(cf_groups, []) AS cf_groups, coalesce(cf_scores, []) AS cf_scores
FROM (SELECT customer_id FROM dim_cust WHERE is_current UNION ALL SELECT 'V' || s_suppkey FROM supplier) q
LEFT JOIN (SELECT * FROM dim_cust WHERE is_current) c ON q.customer_id = c.customer_id
LEFT JOIN taste t ON q.customer_id = t.customer_id LEFT JOIN likely l ON q.customer_id = l.customer_id
LEFT JOIN (SELECT customer_id, list(product_group_id ORDER BY product_group_id) AS cf_groups, list(round(score, 6) ORDER BY product_group_id) AS cf_scores
 FROM cf_rec WHERE rank <= 20 GROUP BY 1) r ON q.customer_id = r.customer_id""")
def x5(spark, sf):
    rows = context(spark, sf, likely(spark, sf))
    entries = F.array_sort(F.map_entries("cf"))
    return rows.withColumns({
        "propensity": F.round("propensity", 6), "embedding": F.transform("embedding", lambda x: F.round(x, 6)),
        "cf_groups": F.transform(entries, lambda e: e["key"]),
        "cf_scores": F.transform(entries, lambda e: F.round(e["value"], 6)),
    }).drop("cf")


@query("x5_customer_context_scored")
def x5_scored(spark, sf):
    """The look-up rows as they are used: with the scores of the propensity model."""
    return context(spark, sf, k13(spark, sf))
