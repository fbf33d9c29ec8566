"""Customers also bought: item pairs from baskets and purchase histories."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.gram import dense_numbers, pair_sums
from tidemark.operators.joins import lookup
from tidemark.operators.keyed import first_per_key, top_per_key
from tidemark.session import freeing, stored

TOP_N = 10
MIN_COOC = 2.0
BASKET_WEIGHT = 2.0
CUSTOMER_WEIGHT = 1.0
SCORED = 1 << 23  # pairs that are scored at a time, at least
STEPS = 6  # steps they are scored in, at most


def group_names(products: DataFrame) -> DataFrame:
    """One style name and category per product group."""
    first = first_per_key(products, ["product_group_id"], [F.asc("variant_id")])
    return first.select("product_group_id", "style_name", "category_id")


@freeing
def transactions(lines: DataFrame, orders: DataFrame, products: DataFrame) -> DataFrame:
    """Distinct (transaction, product group, weight) of baskets and customers with two or more."""
    known = products.select("variant_id", "product_group_id").filter(F.col("product_group_id").isNotNull())
    # Written, so that what the lines were made from does not lie on disk beside what follows.
    items = stored(lines.select("order_id", "variant_id").join(known, "variant_id").select("order_id", "product_group_id"), "items")
    bought = items.join(orders.select("order_id", "customer_id"), "order_id")

    def member(id_col: str, tag: str, weight: float) -> Column:
        name = F.concat(F.lit(tag), F.col(id_col))
        return F.when(name.isNotNull(), F.struct(name.alias("transaction"), F.lit(weight).alias("weight")))

    kinds = F.array_compact(F.array(
        member("order_id", "o:", BASKET_WEIGHT), member("customer_id", "c:", CUSTOMER_WEIGHT)))
    # Shuffled by transaction once, which both the distinct rows and the window need.
    both = bought.select("product_group_id", F.inline(kinds)).repartition("transaction").distinct()
    # A transaction has at most one row per product group here, so its window is bounded.
    size = F.count(F.lit(1)).over(Window.partitionBy("transaction"))
    return both.withColumn("_size", size).filter("_size >= 2").drop("_size")


@freeing
def neighbours(
    baskets: DataFrame, names: DataFrame, min_weight: float = MIN_COOC, n: int = TOP_N
) -> DataFrame:
    """The n most similar product groups of each group, by cosine of weighted co-occurrence."""
    baskets = stored(baskets, "baskets")
    # Written, so that Spark knows how few they are: by product group, of which there are few, a
    # shuffle would send all rows to few tasks.
    numbers = stored(dense_numbers(baskets, "product_group_id", "number"), "numbers")
    return _named(_nearest(baskets.join(numbers, "product_group_id"), min_weight, n), numbers, names)


def _nearest(baskets: DataFrame, min_weight: float, n: int) -> DataFrame:
    """The n most similar numbers of each number; numbers are in the order of product groups."""
    pairs = pair_sums(
        baskets.select("transaction", "number", "weight", F.lit(1.0).alias("one")),
        "transaction", "number", "one", "weight", least=min_weight, written=True)
    occ = stored(baskets.groupBy("number").agg(F.sum("weight").alias("occ")), "occ")

    def best_of(some: DataFrame) -> DataFrame:
        for s in "ab":
            some = some.join(occ.select(F.col("number").alias(f"item_{s}"), F.col("occ").alias(f"occ_{s}")), f"item_{s}")
        score = F.col("dot") / F.sqrt(F.col("occ_a") * F.col("occ_b"))
        # Each unordered pair serves both of its members.
        both = some.select(F.col("dot").alias("cooc_weight"), score.alias("score"), F.inline(F.array(
            F.struct(F.col("item_a").alias("number"), F.col("item_b").alias("neighbour")),
            F.struct(F.col("item_b").alias("number"), F.col("item_a").alias("neighbour")))))
        return best(both)

    def best(rows: DataFrame) -> DataFrame:
        return top_per_key(rows, ["number"], [F.desc("score"), F.asc("neighbour")], n, rank="rank")

    # Of many pairs, those of a range of items are scored at a time, of which n per item stay.
    steps = min(STEPS, -(-pairs.count() // SCORED))
    if steps <= 1:
        return best_of(pairs)
    cuts = pairs.agg(F.percentile_approx("item_a", [k / steps for k in range(1, steps)], 10_000)).first()[0]
    step = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c < F.col("item_a")))
    some = [stored(best_of(pairs.filter(step == k)).drop("rank"), "nearest") for k in range(steps)]
    return best(reduce(DataFrame.unionByName, some))


def _named(best: DataFrame, numbers: DataFrame, names: DataFrame) -> DataFrame:
    """Neighbours with the product groups that the numbers stand for, their styles and categories."""
    other = numbers.select(F.col("number").alias("neighbour"), F.col("product_group_id").alias("neighbour_product_group_id"))
    best = best.join(numbers.select("number", "product_group_id"), "number").join(other, "neighbour").select(
        "cooc_weight", "score", "product_group_id", "neighbour_product_group_id", "rank")
    named = lookup(best, names, "product_group_id",
                   {"style_name": "style_name", "category_id": "category_id"})
    return lookup(
        named, names, "neighbour_product_group_id",
        {"style_name": "neighbour_style_name", "category_id": "neighbour_category_id"},
        dim_key="product_group_id",
    )


@freeing
def co_purchase(lines: DataFrame, orders: DataFrame, products: DataFrame) -> DataFrame:
    """`neighbours` of `transactions`, whose rows carry numbers of product groups from the start."""
    known = products.select("variant_id", "product_group_id").filter(F.col("product_group_id").isNotNull())
    numbers = stored(dense_numbers(known, "product_group_id", "number"), "numbers")
    numbered = known.join(numbers, "product_group_id").select("variant_id", F.col("number").alias("product_group_id"))
    baskets = stored(transactions(lines, orders, numbered), "baskets").withColumnRenamed("product_group_id", "number")
    return _named(_nearest(baskets, MIN_COOC, TOP_N), numbers, group_names(products))
