"""Retail gold marts: events, customers, orders, products."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.scalars import ratio, surrogate_key, zero_if_null
from tidemark.functions.timeparts import days_between, seconds_between
from tidemark.operators.conform import production_view
from tidemark.operators.joins import lookup, outer_merge, with_parent
from tidemark.operators.ordered import PART, next_value, split

PRIVATE = ("ip_address", "user_agent", "_true_customer_id", "_true_session_id", "ingested_at",
           "customer_id")
RESOLUTION = ("customer_id_strict", "customer_id_extended", "resolution_tier")


# --- events -----------------------------------------------------------------


def fact_event(events: DataFrame, graph: DataFrame) -> DataFrame:
    """Events with the resolved customer keys and without personal columns."""
    keys = graph.select("session_id", *RESOLUTION)
    return production_view(events, PRIVATE).join(keys, "session_id", "left")


def fact_search(searches: DataFrame, links: DataFrame) -> DataFrame:
    """Searches resolved at cookie grain."""
    def best(tier):
        return F.max(F.when(F.col("confidence_tier") == tier, F.col("customer_id")))

    cookies = links.groupBy("anonymous_id").agg(
        best("deterministic").alias("customer_id_strict"),
        F.coalesce(best("deterministic"), best("probabilistic")).alias("customer_id_extended"),
    )
    kept = searches.drop("customer_id", "_true_customer_id", "ingested_at")
    return kept.join(cookies, "anonymous_id", "left")


def session_summary(sessions: DataFrame, graph: DataFrame) -> DataFrame:
    keys = graph.select("session_id", *RESOLUTION, "resolution_confidence")
    kept = sessions.drop("session_customer_id", "_true_customer_id", "_true_session_id")
    timed = kept.withColumn("duration_seconds", seconds_between("session_start", "session_end"))
    return timed.join(keys, "session_id", "left")


# --- customers --------------------------------------------------------------


def dim_customer(versions: DataFrame, parts: int | None = None) -> DataFrame:
    """Type-2 dimension: each version is valid until the next one starts.

    `parts` is the number of parts the versions are cut into; by default Spark chooses.
    """
    keys, order = ["customer_id"], ["version_number"]
    if parts:
        versions = split(versions, keys, order, parts)
    dated = next_value(versions, keys, "effective_at", order, "valid_to").drop(PART)
    return (
        dated.withColumn("customer_sk", surrogate_key("customer_id", "version_number"))
        .withColumn("is_current", F.col("valid_to").isNull())
        .withColumnRenamed("effective_at", "valid_from")
        .drop("ingested_at")
    )


def customer_engagement(summary: DataFrame, emails: DataFrame) -> DataFrame:
    """Web behaviour by the extended key and e-mail behaviour, per customer."""
    web = (
        summary.filter(F.col("customer_id_extended").isNotNull())
        .groupBy(F.col("customer_id_extended").alias("customer_id"))
        .agg(
            F.count(F.lit(1)).alias("n_sessions"),
            F.sum("num_events").alias("n_events"),
            F.sum("num_page_views").alias("n_page_views"),
            F.sum("num_searches").alias("n_searches"),
            F.count_if("is_converted").alias("n_converting_sessions"),
            F.max("session_start").alias("last_seen_at"),
        )
    )
    kinds = {"emails_sent": "sent", "emails_opened": "open", "emails_clicked": "click"}
    mail = emails.groupBy("customer_id").agg(
        *[F.count_if(F.col("event_type") == kind).alias(name) for name, kind in kinds.items()]
    )
    # Rates look at the e-mail side only, before absent customers become zeros.
    mail = mail.withColumns({
        "email_open_rate": ratio("emails_opened", "emails_sent", 3),
        "email_click_to_open_rate": ratio("emails_clicked", "emails_opened", 3),
    })
    counts = ["n_sessions", "n_events", "n_page_views", "n_searches", "n_converting_sessions", *kinds]
    merged = outer_merge([web, mail], "customer_id")
    return merged.withColumns({c: zero_if_null(c) for c in counts})


def customer_360(
    customers: DataFrame, orders: DataFrame, lines: DataFrame, engagement: DataFrame,
    active_days: int = 60,
) -> DataFrame:
    """One row per customer: attributes, value, returns, engagement, lifecycle."""
    now = orders.agg(F.max("order_at")).scalar()
    bought = (
        orders.filter(F.col("customer_id").isNotNull() & (F.col("order_status") != "cancelled"))
        .groupBy("customer_id")
        .agg(
            F.count(F.lit(1)).alias("n_orders"),
            F.sum("net_amount").alias("total_net_spend"),
            F.round(F.avg("net_amount"), 2).alias("avg_order_value"),
            F.min("order_at").alias("first_order_at"),
            F.max("order_at").alias("last_order_at"),
        )
    )
    # Lines are counted per order before they meet the orders.
    per_order = lines.groupBy("order_id").agg(
        F.count_if("is_returned").alias("_returned"), F.count(F.lit(1)).alias("_lines")
    )
    returns = (
        orders.filter(F.col("customer_id").isNotNull())
        .join(per_order, "order_id")
        .groupBy("customer_id")
        .agg(F.sum("_returned").alias("n_returned_lines"), F.sum("_lines").alias("_lines"))
    )
    kept = customers.filter("is_current").select(
        "customer_id", "first_name", "last_name", "email", "brand_line_affinity", "home_size",
        "region", "loyalty_member", "loyalty_tier", "email_consent", "marketing_consent",
    )
    touch = engagement.select("customer_id", "n_sessions", "n_events", "emails_opened", "emails_clicked")
    joined = (
        kept.join(bought, "customer_id", "left")
        .join(returns, "customer_id", "left")
        .join(touch, "customer_id", "left")
    )
    recency = days_between("last_order_at", now)
    stage = (
        F.when(F.col("n_orders").isNull(), "prospect")
        .when(recency <= active_days, "active")
        .otherwise("lapsing")
    )
    counts = ["n_orders", "n_returned_lines", "n_sessions", "n_events", "emails_opened", "emails_clicked"]
    return (
        joined.withColumn("recency_days", recency)
        .withColumn("lifecycle_stage", stage)
        .withColumn("return_rate", ratio("n_returned_lines", "_lines", 3))
        .withColumns({c: zero_if_null(c) for c in counts})
        .withColumn("total_net_spend", zero_if_null("total_net_spend", "double"))
        .drop("_lines")
    )


# --- orders -----------------------------------------------------------------


def fact_order(first_party: DataFrame, marketplace: DataFrame) -> DataFrame:
    """Both channels in one grain."""
    kept = ["order_id", "customer_id", "order_at", "order_channel", "is_guest", "net_amount",
            "order_status"]
    own = first_party.select(
        *kept, F.lit(None).cast("string").alias("seller_id"), F.lit(0.0).alias("commission_amount")
    )
    return own.unionByName(marketplace.select(*kept, "seller_id", "commission_amount"))


def fact_order_line(first_party: DataFrame, marketplace: DataFrame, products: DataFrame) -> DataFrame:
    """Lines of both channels; marketplace lines take their category from the product."""
    kept = ["line_id", "order_id", "variant_id", "category_id", "quantity", "unit_price",
            "line_amount", "is_returned", "return_reason"]
    own = first_party.select(*kept, F.lit("first_party").alias("order_channel"))
    theirs = lookup(marketplace, products, "variant_id", {"category_id": "category_id"})
    return own.unionByName(theirs.select(*kept, F.lit("marketplace").alias("order_channel")))


# --- products ---------------------------------------------------------------


def dim_category(categories: DataFrame) -> DataFrame:
    named = with_parent(
        categories, "category_id", "parent_category_id", "category_name", "parent_category_name"
    )
    return named.drop("ingested_at")


def dim_product(variants: DataFrame, products: DataFrame) -> DataFrame:
    """Variant grain with the description of the product group."""
    kept = variants.drop("ingested_at")
    return lookup(kept, products, "product_group_id", {"description": "description"})


def product_performance(products: DataFrame, events: DataFrame, lines: DataFrame) -> DataFrame:
    """Browsing, sales and returns per variant, variants without traffic included."""
    kind = F.col("event_type")
    funnel = (
        events.filter(F.col("product_id").isNotNull())
        .groupBy(F.col("product_id").alias("variant_id"))
        .agg(
            F.count_if((kind == "page_view") & (F.col("page_type") == "pdp")).alias("view_count"),
            F.count_if(kind == "add_to_cart").alias("add_to_cart_count"),
            F.count_if(kind == "purchase").alias("_purchases"),
        )
    )
    back = F.col("is_returned")
    sales = lines.groupBy("variant_id").agg(
        F.sum("quantity").alias("units_sold"),
        F.sum("line_amount").alias("gross_revenue"),
        F.sum(F.when(back, F.col("line_amount")).otherwise(0.0)).alias("_returned"),
        F.count_if(back).alias("return_count"),
        F.count(F.lit(1)).alias("_lines"),
    )
    kept = products.select("variant_id", "product_group_id", "style_name", "category_id",
                           "brand_line", "price", "is_in_stock")
    joined = kept.join(funnel, "variant_id", "left").join(sales, "variant_id", "left")
    gross = zero_if_null("gross_revenue", "double")
    return (
        joined.withColumn("return_rate", ratio("return_count", "_lines", 3))
        .withColumn("view_to_purchase_rate", ratio("_purchases", "view_count", 4))
        .withColumn("net_revenue", gross - zero_if_null("_returned", "double"))
        .withColumn("gross_revenue", gross)
        .withColumns({c: zero_if_null(c) for c in
                      ("view_count", "add_to_cart_count", "units_sold", "return_count")})
        .drop("_purchases", "_returned", "_lines")
    )
