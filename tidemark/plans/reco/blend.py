"""One ranked list per customer from all recommendation signals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import vectors
from tidemark.functions.scalars import min_max
from tidemark.operators.keyed import first_per_key, top_per_key
from tidemark.session import stored

WEIGHTS = {"cf": 0.40, "copurchase": 0.25, "embedding": 0.20, "popularity": 0.15}
TOP_N = 20
RECENT_SEED = 5
POPULAR = 30


def recent_groups(browsed: DataFrame, n: int = RECENT_SEED) -> DataFrame:
    """The product groups a customer browsed most."""
    counts = browsed.groupBy("customer_id", "product_group_id").agg(F.count(F.lit(1)).alias("w"))
    order = [F.desc("w"), F.asc("product_group_id")]
    return top_per_key(counts, ["customer_id"], order, n).drop("w")


def candidates(customers: DataFrame, cf: DataFrame, neighbours: DataFrame, seeds: DataFrame,
               popular: DataFrame) -> DataFrame:
    """Product groups per customer with their raw signals, without what was just browsed.

    Bounded by 20 filtered + 5 * 10 co-purchased + 30 popular groups per customer.
    """
    known = customers.select("customer_id")
    from_cf = cf.join(known, "customer_id", "left_semi").select(
        "customer_id", "product_group_id", F.col("score").alias("cf"))
    near = neighbours.select(
        "product_group_id", F.col("neighbour_product_group_id").alias("near"), "score")
    from_pairs = (
        seeds.join(known, "customer_id", "left_semi").join(near, "product_group_id")
        .select("customer_id", F.col("near").alias("product_group_id"), F.col("score").alias("copurchase"))
    )
    head = popular.orderBy(F.desc("pop"), "product_group_id").limit(POPULAR)
    head = head.agg(F.collect_list("product_group_id")).scalar()
    from_popular = known.select("customer_id", F.explode(head).alias("product_group_id"))

    together = from_cf.unionByName(from_pairs, allowMissingColumns=True)
    together = together.unionByName(from_popular, allowMissingColumns=True)
    taken = seeds.filter(F.col("product_group_id").isNotNull()).select(
        "customer_id", "product_group_id", F.lit(True).alias("_seed"))
    together = together.unionByName(taken, allowMissingColumns=True)
    # One shuffle by customer merges the lists; a signal that is absent counts zero.
    merged = together.repartition("customer_id").groupBy("customer_id", "product_group_id").agg(
        F.coalesce(F.max("cf"), F.lit(0.0)).alias("cf"),
        F.coalesce(F.max("copurchase"), F.lit(0.0)).alias("copurchase"), F.max("_seed").alias("_seed"),
    )
    return merged.filter(F.col("_seed").isNull()).drop("_seed")


def blend(cands: DataFrame, customers: DataFrame, products: DataFrame, popular: DataFrame,
          n: int = TOP_N) -> DataFrame:
    """Scale each signal inside the customer's candidates, weigh, keep the n best groups.

    `customers` and `products` carry embeddings, `popular` the demand per product group.
    """
    low, high = popular.agg(F.min("pop")).scalar(), popular.agg(F.max("pop")).scalar()
    demand = popular.select(
        "product_group_id", min_max(F.col("pop"), low, high, 0.0).alias("popularity"))
    # Written, so that Spark knows its size and a customer's vector need not travel to the groups.
    side = stored(products.select("product_group_id", F.col("embedding").alias("_group")), "group-vectors")
    rows = (
        cands.join(customers.select("customer_id", F.col("embedding").alias("_taste")), "customer_id")
        .join(side, "product_group_id", "left")
        .withColumn("embedding", vectors.dot("_taste", "_group"))
        .drop("_taste", "_group")
        .join(demand, "product_group_id", "left")
        .withColumn("popularity", F.coalesce("popularity", F.lit(0.0)))
    )
    mine = Window.partitionBy("customer_id")

    def scaled(signal: str) -> Column:
        col = F.col(signal)
        return F.coalesce(min_max(col, F.min(col).over(mine), F.max(col).over(mine), 0.0), F.lit(0.0))

    rows = rows.select("customer_id", "product_group_id",
                       *[scaled(s).alias(f"{s}_score") for s in WEIGHTS])
    total = sum((F.col(f"{s}_score") * w for s, w in WEIGHTS.items()), F.lit(0.0))
    rows = rows.withColumn("blended", total)
    order = [F.desc(F.round("blended", 9)), F.asc("product_group_id")]
    return top_per_key(rows, ["customer_id"], order, n, rank="group_rank")


def expand_variant(recs: DataFrame, variants: DataFrame, sizes: DataFrame) -> DataFrame:
    """Attach a sellable variant: the first in the customer's size, else the first of the group."""
    sellable = variants.filter(F.col("is_in_stock") & F.col("is_active"))
    columns = ["variant_id", "style_name", "category_id", "size", "price"]
    card = F.struct(*columns)
    # One row per group and size, and per group; written, so that Spark knows how few they are.
    in_size = stored(first_per_key(sellable, ["product_group_id", "size"], [F.asc("variant_id")]).select(
        F.col("product_group_id"), F.col("size").alias("home_size"), card.alias("_fit")), "cards-by-size")
    any_size = stored(first_per_key(sellable, ["product_group_id"], [F.asc("variant_id")]).select(
        "product_group_id", card.alias("_any")), "cards")
    return (
        recs.join(sizes.select("customer_id", "home_size"), "customer_id", "left")
        .join(in_size, ["product_group_id", "home_size"], "left")
        .join(any_size, "product_group_id")
        .withColumn("_card", F.coalesce("_fit", "_any"))
        .select(*recs.columns, *[F.col(f"_card.{c}").alias(c) for c in columns])
    )


def ranked_recommendations(blended: DataFrame, variants: DataFrame, sizes: DataFrame) -> DataFrame:
    """Final list with rounded scores; groups without a sellable variant close the gap."""
    rows = expand_variant(blended, variants, sizes)
    mine = Window.partitionBy("customer_id").orderBy(F.desc("final_score"), "group_rank")

    def shown(col: str, digits: int) -> Column:
        # Float noise must not decide which way a half is rounded.
        return F.round(F.round(col, 9), digits)

    return (
        rows.withColumn("final_score", shown("blended", 4))
        .withColumns({f"{s}_score": shown(f"{s}_score", 3) for s in WEIGHTS})
        .withColumn("price", F.round("price", 2))
        .withColumn("rank", F.row_number().over(mine))
        .drop("blended", "group_rank")
    )
