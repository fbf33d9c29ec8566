"""Demand and trend per variant: the recommendation for everybody nothing is known about."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.scalars import zero_if_null
from tidemark.operators.ordered import rank_rows

PURCHASE_WEIGHT = 5.0
VIEW_WEIGHT = 1.0


def demand(events: DataFrame, products: DataFrame, days: int = 30) -> DataFrame:
    """Views, purchases, recent and prior demand, and the two scores, for every variant."""
    newest = events.agg(F.max("event_at")).scalar()
    recent = F.col("event_at") > newest - F.expr(f"INTERVAL {days} DAYS")
    prior = ~recent & (F.col("event_at") > newest - F.expr(f"INTERVAL {2 * days} DAYS"))
    kind = F.col("event_type")
    counts = (
        events.filter(F.col("product_id").isNotNull())
        .groupBy(F.col("product_id").alias("variant_id"))
        .agg(
            F.count_if(kind == "page_view").alias("views_all"),
            F.count_if(kind == "purchase").alias("purchases_all"),
            F.count_if(recent).alias("demand_recent"),
            F.count_if(prior).alias("demand_prior"),
        )
    )
    kept = products.select("variant_id", "product_group_id", "style_name", "category_id",
                           "brand_line", "price", "is_in_stock")
    names = ["views_all", "purchases_all", "demand_recent", "demand_prior"]
    joined = kept.join(counts, "variant_id", "left").withColumns({n: zero_if_null(n) for n in names})
    return joined.withColumn(
        "popularity_score",
        F.col("purchases_all") * PURCHASE_WEIGHT + F.col("views_all") * VIEW_WEIGHT,
    ).withColumn("trend_score", (F.col("demand_recent") + 1) / (F.col("demand_prior") + 1))


def popularity(events: DataFrame, products: DataFrame, days: int = 30) -> DataFrame:
    """`demand` with the rank over all variants and inside the category."""
    by_score = [F.desc("popularity_score"), F.asc("variant_id")]
    ranked = rank_rows(demand(events, products, days), by_score, "rank_overall")
    return rank_rows(ranked, by_score, "rank_in_category", within=["category_id"])


def fallback(scores: DataFrame, n: int) -> DataFrame:
    """The n most popular variants in stock."""
    best = scores.filter("is_in_stock").orderBy(F.desc("popularity_score"), "variant_id").limit(n)
    return best.select("variant_id", "style_name", "category_id", "price", "popularity_score")
