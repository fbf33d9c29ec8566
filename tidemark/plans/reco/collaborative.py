"""Item-based collaborative filtering over customer interactions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.gram import dense_numbers, pair_sums
from tidemark.operators.keyed import first_per_key, top_per_key, with_group_size
from tidemark.operators.ordered import rank_rows
from tidemark.session import cut, stored

N_NEIGHBOURS = 20
TOP_N = 20
EVAL_K = 10
CART_WEIGHT = 3


def browsed(events: DataFrame, products: DataFrame) -> DataFrame:
    """Product views and carts of resolved customers, at product-group grain."""
    rows = events.filter(
        F.col("customer_id_extended").isNotNull()
        & F.col("event_type").isin("page_view", "add_to_cart")
    )
    groups = products.select(F.col("variant_id").alias("product_id"), "product_group_id")
    return rows.join(groups, "product_id").withColumnRenamed("customer_id_extended", "customer_id")


def interactions(events: DataFrame, products: DataFrame) -> DataFrame:
    """Weighted interactions per customer and product group, with the last time."""
    weight = F.when(F.col("event_type") == "add_to_cart", CART_WEIGHT).otherwise(1)
    summed = browsed(events, products).groupBy("customer_id", "product_group_id").agg(
        F.sum(weight).alias("weight"), F.max("event_at").alias("last_at")
    )
    return summed.filter("weight > 0")


def item_neighbours(inter: DataFrame, n: int = N_NEIGHBOURS) -> DataFrame:
    """The n most similar items of each item, by cosine over the customers' weights.

    Document-frequency weights scale an item's whole column, so they drop out of the cosine.
    """
    # Written, so that Spark knows how few they are and the interactions are not shuffled by item.
    numbers = stored(dense_numbers(inter, "product_group_id", "number"), "numbers")
    numbered = inter.join(numbers, "product_group_id").withColumn("one", F.lit(1.0))
    dots = pair_sums(numbered, "customer_id", "number", "weight", "one")
    squares = inter.groupBy("product_group_id").agg(
        F.sum(F.col("weight") * F.col("weight")).cast("double").alias("sq")
    )
    stats = numbers.join(squares, "product_group_id")
    sides = [
        stats.select(F.col("number").alias(f"item_{s}"), F.col("product_group_id").alias(f"group_{s}"),
                     F.col("sq").alias(f"sq_{s}"))
        for s in "ab"
    ]
    pairs = dots.join(sides[0], "item_a").join(sides[1], "item_b").withColumn(
        "sim", F.col("dot") / F.sqrt(F.col("sq_a") * F.col("sq_b"))
    )
    both = pairs.select("sim", F.inline(F.array(
        F.struct(F.col("group_a").alias("item"), F.col("group_b").alias("neighbour")),
        F.struct(F.col("group_b").alias("item"), F.col("group_a").alias("neighbour")),
    )))
    return top_per_key(both, ["item"], [F.desc("sim"), F.asc("neighbour")], n)


def affinities(inter: DataFrame, customers: int | None = None) -> DataFrame:
    """Score of every unseen item a customer's items point to: sum of weight * idf * similarity."""
    total = F.lit(customers) if customers is not None else (
        inter.agg(F.count_distinct("customer_id")).scalar()
    )
    spread = inter.groupBy(F.col("product_group_id").alias("item")).agg(
        (F.log((1 + total) / (1 + F.count(F.lit(1)))) + 1).alias("idf")
    )
    # At most n + 1 rows per item, written so that Spark knows how few they are. An item points to
    # itself as seen, so a customer's rows are added up where they are, without a second shuffle.
    own = spread.select("item", F.col("item").alias("neighbour"), F.lit(0.0).alias("sim"), "idf", F.lit(True).alias("seen"))
    near = item_neighbours(inter).join(spread, "item").select("item", "neighbour", "sim", "idf", F.lit(False).alias("seen"))
    links = stored(near.unionByName(own), "links")
    scores = (
        inter.select("customer_id", F.col("product_group_id").alias("item"), "weight")
        .repartition("customer_id")
        .join(links, "item")
        .groupBy("customer_id", F.col("neighbour").alias("product_group_id"))
        .agg(F.sum(F.col("weight") * F.col("idf") * F.col("sim")).alias("score"), F.max("seen").alias("_seen"))
    )
    return scores.filter(~F.col("_seen")).drop("_seen")


def _best_first() -> list[Column]:
    return [F.desc(F.round("score", 9)), F.asc("product_group_id")]


def recommend(
    inter: DataFrame, n: int = TOP_N, customers: int | None = None, items: DataFrame | None = None
) -> DataFrame:
    """The n best unseen product groups per customer, with score and rank.

    Where a customer's items point to fewer, unseen groups with score 0 follow by name, as long as
    there are any. `items` are the groups to choose from, by default all of `inter`.
    """
    inter = cut(inter)
    best = cut(top_per_key(affinities(inter, customers), ["customer_id"], _best_first(), n))
    items = inter.select("product_group_id").distinct() if items is None else items
    filled = best.unionByName(_unseen(inter, best, items, n))
    return top_per_key(filled, ["customer_id"], _best_first(), n, rank="rank")


def _unseen(inter: DataFrame, best: DataFrame, items: DataFrame, n: int) -> DataFrame:
    """Groups with score 0 for customers with fewer than n others: enough of the first ones by name.

    A customer who has seen s groups and has p others is filled up from the first n + s + p.
    """
    numbers = cut(dense_numbers(items, "product_group_id", "_number"))
    total = numbers.agg(F.count(F.lit(1))).scalar()
    seen = inter.groupBy("customer_id").agg(F.count(F.lit(1)).alias("_seen"))
    have = best.groupBy("customer_id").agg(F.count(F.lit(1)).alias("_have"))
    short = seen.join(have, "customer_id", "left").withColumn("_have", F.coalesce("_have", F.lit(0))).filter(F.col("_have") < n)
    upto = F.least(n + F.col("_seen") + F.col("_have"), total)
    pool = short.filter(total > 0).select("customer_id", F.explode(F.sequence(F.lit(0).cast("bigint"), upto - 1)).alias("_number"))
    named = pool.join(numbers, "_number").select("customer_id", "product_group_id", F.lit(0.0).alias("score"))
    keys = ["customer_id", "product_group_id"]
    taken = inter.select(*keys).unionByName(best.select(*keys))
    return named.join(taken, keys, "left_anti")


def evaluate(inter: DataFrame, k: int = EVAL_K) -> DataFrame:
    """Leave one item out per customer; hit rate in the top k against plain popularity.

    The item left out is picked by a hash, so the split is the same in every run.
    """
    inter = cut(inter.select("customer_id", "product_group_id", "weight"))
    keys = ["customer_id", "product_group_id"]
    several = with_group_size(inter, ["customer_id"], "_n").filter("_n >= 2").drop("_n")
    pick = F.md5(F.concat_ws(":", *keys))
    held = cut(first_per_key(several, ["customer_id"], [pick, F.asc("product_group_id")]).select(*keys))
    train = cut(inter.join(held, keys, "left_anti"))

    n_customers = inter.select("customer_id").distinct().count()
    items = inter.select("product_group_id").distinct()
    top = recommend(train, k, n_customers, items)
    cf = held.join(top, keys, "left_semi").agg(F.count(F.lit(1)).alias("cf_hits"))

    # Popular items a customer has not seen: position among all, less the seen ones before it.
    pop = inter.select("product_group_id").distinct().join(
        train.groupBy("product_group_id").agg(F.sum("weight").alias("pop")), "product_group_id", "left"
    ).withColumn("pop", F.coalesce("pop", F.lit(0)))
    place = rank_rows(pop, [F.desc("pop"), F.asc("product_group_id")], "place").drop("pop")
    target = held.join(place, "product_group_id").select("customer_id", F.col("place").alias("target"))
    before = (
        train.join(place, "product_group_id")
        .join(target, "customer_id")
        .filter("place < target")
        .groupBy("customer_id").agg(F.count(F.lit(1)).alias("before"))
    )
    base = target.join(before, "customer_id", "left").agg(
        F.count(F.lit(1)).alias("n_eval"),
        F.count_if(F.col("target") - F.coalesce("before", F.lit(0)) <= k).alias("base_hits"),
    )
    hits = cf.agg(F.max("cf_hits")).scalar()
    return base.select(
        "n_eval", hits.alias("cf_hits"), "base_hits",
        (hits / F.nullif("n_eval", F.lit(0))).alias("cf_hit_rate"),
        (F.col("base_hits") / F.nullif("n_eval", F.lit(0))).alias("base_hit_rate"),
    )
