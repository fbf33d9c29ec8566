"""Activation tables: search re-ranking, page lists, e-mail export, customer context."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import vectors
from tidemark.functions.scalars import min_max, words
from tidemark.operators.joins import lookup
from tidemark.operators.keyed import first_per_key, top_per_key
from tidemark.plans.reco.popularity import fallback
from tidemark.session import cut

POOL = 60


def catalogue(products: DataFrame, scores: DataFrame) -> DataFrame:
    """Sellable variants with their searchable text and popularity."""
    sellable = products.filter(F.col("is_in_stock") & F.col("is_active"))
    text = F.lower(F.concat_ws(
        " ", "style_name", "category_id", "brand_line", "colour", "pattern"))
    return lookup(sellable, scores, "variant_id", {"popularity_score": "popularity"}).select(
        "variant_id", "product_group_id", "style_name", "category_id", "colour", "size", "price",
        text.alias("search_text"), F.coalesce("popularity", F.lit(0.0)).alias("popularity"),
    )


def asked_words(queries: DataFrame) -> DataFrame:
    """(query, token, times): the words of every distinct query."""
    tokens = queries.select("query").distinct().select("query", F.explode(words("query")).alias("token"))
    return tokens.groupBy("query", "token").agg(F.count(F.lit(1)).alias("times"))


def word_sets(tokens: DataFrame, texts: DataFrame) -> DataFrame:
    """(search_text, found): the asked words that occur anywhere inside each text, sorted.

    Texts are cut into all pieces that are as long as some asked word, and pieces meet whole
    words, so the join is on a selective key. Texts without an asked word are left out.
    """
    asked = tokens.select("token").distinct()
    lengths = asked.agg(F.collect_set(F.length("token"))).scalar()
    size = F.length("search_text")
    cut_up = F.transform(
        F.filter("_lengths", lambda n: (n > 0) & (n <= size)),
        lambda n: F.transform(F.sequence(F.lit(1), size - n + 1), lambda i: F.substring(F.col("search_text"), i, n)),
    )
    pieces = texts.withColumn("_lengths", lengths).select(
        "search_text", F.explode(F.array_distinct(F.flatten(cut_up))).alias("token"))
    return (
        pieces.join(asked, "token").groupBy("search_text")
        .agg(F.sort_array(F.collect_set("token")).alias("found"))
    )


def set_relevance(tokens: DataFrame, sets: DataFrame) -> DataFrame:
    """(query, found, relevance): how many words of the query are in each set of words."""
    spread = sets.select("found").distinct().select("found", F.explode("found").alias("token"))
    return tokens.join(spread, "token").groupBy("query", "found").agg(F.sum("times").alias("relevance"))


def text_hits(queries: DataFrame, texts: DataFrame) -> DataFrame:
    """(query, search_text, relevance): how many words of the query occur inside the text."""
    tokens = asked_words(queries)
    sets = word_sets(tokens, texts)
    return set_relevance(tokens, sets).join(sets, "found").select("query", "search_text", "relevance")


def needed_sets(relevance: DataFrame, short: DataFrame, size: int) -> DataFrame:
    """The (query, found, relevance) that can give one of a query's `size` best variants.

    Sets are read in order of relevance, then of their most popular variant, until those before
    hold enough: nothing of a less relevant set can come before them, and of `size` sets of one
    relevance the next one's best variant comes after all of theirs.
    """
    heads = short.groupBy("found").agg(
        F.count(F.lit(1)).alias("_variants"), F.min(F.struct((-F.col("popularity")).alias("p"), "variant_id")).alias("_best"))
    ranked = relevance.join(heads, "found")
    # Levels of relevance are as many as a query has words.
    levels = ranked.groupBy("query", "relevance").agg(F.sum("_variants").alias("_n"))
    above = Window.partitionBy("query").orderBy(F.desc("relevance")).rowsBetween(Window.unboundedPreceding, -1)
    open_ = levels.withColumn("_above", F.coalesce(F.sum("_n").over(above), F.lit(0))).filter(F.col("_above") < size)
    reached = ranked.join(open_.select("query", "relevance"), ["query", "relevance"])
    return top_per_key(reached, ["query", "relevance"], ["_best"], size).select("query", "found", "relevance")


def search_pools(queries: DataFrame, items: DataFrame, size: int = POOL) -> DataFrame:
    """Per distinct query text the best variants by relevance and popularity, with a base score.

    Variants whose texts hold the same asked words are equally relevant to every query, so
    the `size` most popular of each such set are enough, and queries meet sets, not texts.
    """
    texts = queries.select("query").distinct()
    tokens = cut(asked_words(queries))
    sets = cut(word_sets(tokens, items.select("search_text").distinct()))
    short = cut(top_per_key(
        items.join(sets, "search_text"), ["found"], [F.desc("popularity"), F.asc("variant_id")], size))
    order = [F.desc("relevance"), F.desc("popularity"), F.asc("variant_id")]
    needed = needed_sets(set_relevance(tokens, sets), short, size)
    hits = needed.join(short, "found").drop("found").select("query", *items.columns, "relevance")
    # Small (at most `size` rows per query text) and read twice below.
    matched = cut(top_per_key(hits, ["query"], order, size))
    # Nothing matched: the most popular variants, which are the same for all such queries.
    head = items.orderBy(F.desc("popularity"), "variant_id").limit(size)
    head = head.agg(F.collect_list(F.struct(*items.columns))).scalar()
    unmatched = texts.join(matched.select("query").distinct(), "query", "left_anti").select(
        "query", F.inline(head)).withColumn("relevance", F.lit(0).cast("bigint"))
    pool = matched.unionByName(unmatched)
    mine = Window.partitionBy("query")
    base = 0.6 * _scaled(F.col("relevance"), mine) + 0.4 * _scaled(F.col("popularity"), mine)
    return pool.withColumn("base", base)


def _scaled(col: Column, window) -> Column:
    return min_max(col, F.min(col).over(window), F.max(col).over(window), 0.0)


def search_rerank(
    requests: DataFrame, items: DataFrame, customers: DataFrame, cf: DataFrame,
    groups: DataFrame, limit: int = 10,
) -> DataFrame:
    """Answer a table of (request_id, query, customer_id) with ranked variants.

    `customers` has home_size and embedding, `groups` an embedding per product group.
    Every window below sees one request's pool of at most 60 rows.
    """
    pools = search_pools(requests, items)
    taste = customers.select("customer_id", "home_size", F.col("embedding").alias("_taste"))
    near = F.coalesce(vectors.dot("_taste", "_group"), F.lit(0.0))
    rows = (
        requests.join(taste, "customer_id", "left")
        .join(pools, "query")
        .join(groups.select("product_group_id", F.col("embedding").alias("_group")),
              "product_group_id", "left")
        .withColumns({"_near": near, "personalized": F.col("_taste").isNotNull()})
        # The vectors end here; only numbers go through the shuffles below.
        .drop("_taste", "_group")
        .join(cf.select("customer_id", "product_group_id", F.col("score").alias("_cf")),
              ["customer_id", "product_group_id"], "left")
        .withColumn("_cf", F.coalesce("_cf", F.lit(0.0)))
    )
    mine = Window.partitionBy("request_id")
    personal = 0.6 * _scaled(F.col("_near"), mine) + 0.4 * _scaled(F.col("_cf"), mine)
    final = F.when(F.col("personalized"), 0.6 * F.col("base") + 0.4 * personal).otherwise(F.col("base"))
    fits = F.coalesce(F.col("size") == F.col("home_size"), F.lit(False)) | (F.col("size") == "One Size")
    rows = rows.withColumns({"final": F.round(final, 9), "_fits": fits})
    one = first_per_key(
        rows, ["request_id", "product_group_id"],
        [F.desc("_fits"), F.desc("final"), F.asc("variant_id")],
    )
    best = top_per_key(one, ["request_id"], [F.desc("final"), F.asc("variant_id")], limit, rank="rank")
    return best.select(
        "request_id", "query", "customer_id", "personalized", "rank", "variant_id", "style_name",
        "category_id", "colour", "size", F.round("price", 2).alias("price"),
        F.round("final", 4).alias("score"),
    )


def _fallback_rows(keys: DataFrame, scores: DataFrame, limit: int) -> DataFrame:
    best = fallback(scores, limit)
    order = F.struct((-F.col("popularity_score")).alias("p"), F.col("variant_id"),
                     F.col("style_name"), F.col("category_id"), F.col("price"))
    items = best.agg(F.sort_array(F.collect_list(order))).scalar()
    rows = keys.select("*", F.posexplode(items).alias("_pos", "_item"))
    return rows.select(
        *keys.columns, F.lit("popularity_fallback").alias("source"),
        (F.col("_pos") + 1).alias("rank"),
        *[F.col(f"_item.{c}").alias(c) for c in ("variant_id", "style_name", "category_id", "price")],
    )  # without a size of the customer's or a score of theirs


def homepage(customers: DataFrame, ranked: DataFrame, scores: DataFrame, limit: int = 10) -> DataFrame:
    """The customer's ranked list, or the popular variants for customers without one."""
    own = ranked.join(customers.select("customer_id"), "customer_id", "left_semi")
    own = own.filter(F.col("rank") <= limit).select(
        "customer_id", F.lit("ranking").alias("source"), "rank", "variant_id", "style_name",
        "category_id", "size", "price", "final_score",
    )
    cold = customers.select("customer_id").join(own.select("customer_id").distinct(), "customer_id", "left_anti")
    return own.unionByName(_fallback_rows(cold, scores, limit), allowMissingColumns=True)


def product_page(neighbours: DataFrame, products: DataFrame, scores: DataFrame, limit: int = 10):
    """Also-bought list per product group with one sellable variant each, else popular variants."""
    sellable = products.filter(F.col("is_in_stock") & F.col("is_active"))
    one = first_per_key(sellable, ["product_group_id"], [F.asc("variant_id")]).select(
        F.col("product_group_id").alias("neighbour_product_group_id"), "variant_id", "price")
    also = (
        neighbours.filter(F.col("rank") <= limit)
        .join(one, "neighbour_product_group_id", "left")
        .select("product_group_id", F.lit("co_purchase").alias("source"), "rank", "variant_id",
                F.col("neighbour_style_name").alias("style_name"),
                F.col("neighbour_category_id").alias("category_id"), "price", "score")
    )
    bare = products.select("product_group_id").distinct().join(
        also.select("product_group_id").distinct(), "product_group_id", "left_anti")
    return also.unionByName(_fallback_rows(bare, scores, limit), allowMissingColumns=True)


def email_export(
    propensity: DataFrame, customers: DataFrame, ranked: DataFrame, min_decile: int = 1,
    limit: int = 100, recs: int = 3,
) -> DataFrame:
    """The most likely buyers who consented to marketing, each with a few recommendations."""
    consenting = customers.filter("marketing_consent").select("customer_id", "email", "first_name")
    audience = (
        propensity.filter(F.col("propensity_decile") >= min_decile)
        .join(consenting, "customer_id")
        .orderBy(F.desc("purchase_propensity"), "customer_id").limit(limit)
    )
    item = F.struct("rank", "style_name", "category_id", "variant_id", "price")
    # At most `recs` rows per customer.
    lists = (
        ranked.filter(F.col("rank") <= recs)
        .join(audience.select("customer_id"), "customer_id", "left_semi")
        .groupBy("customer_id")
        .agg(F.sort_array(F.collect_list(item)).alias("recommendations"))
    )
    shown = F.transform(
        F.coalesce("recommendations", F.array()),
        lambda r: F.struct(r["style_name"], r["category_id"], r["variant_id"], r["price"]))
    return audience.join(lists, "customer_id", "left").select(
        "customer_id", "email", "first_name",
        F.round("purchase_propensity", 4).alias("propensity"), "propensity_decile",
        shown.alias("recommendations"),
    )


def customer_context(
    asked: DataFrame, customers: DataFrame, embeddings: DataFrame, cf: DataFrame, propensity: DataFrame
) -> DataFrame:
    """Everything the online side looks up for the customers asked for, one row each.

    Customers without a profile are not known: they have no consent, and an empty map of groups.
    """
    affinity = cf.groupBy("customer_id").agg(
        F.map_from_entries(F.collect_list(F.struct("product_group_id", "score"))).alias("cf"))
    profile = customers.select("customer_id", "home_size", "email", "marketing_consent", F.lit(True).alias("known"))
    none = F.create_map().cast("map<string,double>")
    return (
        asked.select("customer_id").join(profile, "customer_id", "left")
        .join(embeddings.select("customer_id", "embedding"), "customer_id", "left")
        .join(affinity, "customer_id", "left")
        .join(propensity.select("customer_id", F.col("purchase_propensity").alias("propensity"),
                                "propensity_decile"), "customer_id", "left")
        .withColumns({c: F.coalesce(c, F.lit(False)) for c in ("known", "marketing_consent")})
        .withColumn("cf", F.coalesce("cf", none))
    )
