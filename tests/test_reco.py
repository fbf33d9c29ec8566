import re
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators.keyed import top_per_key
from tidemark.plans import activation
from tidemark.plans.reco import blend, collaborative, copurchase, embeddings, propensity


def test_co_purchase_thresholds(spark):
    """A pair of one shared customer stays below the floor; repeats in a basket count once."""
    lines = [("o1", "a1"), ("o1", "b1"), ("o1", "b1"), ("o2", "a1"), ("o3", "c1"), ("o4", "b1")]
    orders = [("o1", None), ("o2", "k"), ("o3", "k"), ("o4", None)]
    products = [(f"{g}1", g, g.upper(), "cat") for g in "abc"]
    out = copurchase.co_purchase(
        spark.createDataFrame(lines, "order_id string, variant_id string"),
        spark.createDataFrame(orders, "order_id string, customer_id string"),
        spark.createDataFrame(products, "variant_id string, product_group_id string, style_name string, category_id string"))
    got = {(r["product_group_id"], r["neighbour_product_group_id"]): (r["cooc_weight"], round(r["score"], 6)) for r in out.collect()}
    score = round(2 / np.sqrt(3 * 2), 6)  # a: basket 2 + customer 1, b: basket 2
    assert got == {("a", "b"): (2.0, score), ("b", "a"): (2.0, score)}


def test_neighbours_of_many_pairs_are_scored_in_steps(spark, rows, monkeypatch):
    """The steps give what one step gives, ties and all; the shuffles of a step are dropped when it is written."""
    rng = np.random.default_rng(6)
    bought = [(f"t{t}", f"g{g:02d}", 2.0) for t in range(60) for g in np.flatnonzero(rng.random(25) < 0.2)]
    baskets = spark.createDataFrame(bought, "transaction string, product_group_id string, weight double")
    names = spark.createDataFrame([(f"g{g:02d}", "s", "c") for g in range(25)], "product_group_id string, style_name string, category_id string")
    want = rows(copurchase.neighbours(baskets, names, n=3))
    freed, real = [], copurchase.stored
    monkeypatch.setattr(copurchase, "SCORED", 1)
    monkeypatch.setattr(copurchase, "stored", lambda df, label: freed.append(
        (label, spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled"))) or real(df, label))
    before = spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled")
    assert rows(copurchase.neighbours(baskets, names, n=3)) == want and len(want) == 75
    assert freed.count(("nearest", "true")) == copurchase.STEPS
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == before


@pytest.fixture(scope="module")
def matrix(spark):
    rng = np.random.default_rng(5)
    x = (rng.random((30, 25)) < 0.3) * rng.integers(1, 5, (30, 25))
    x[0] = 2  # has seen everything
    x[1:, 0] = 1  # an item everybody has
    cells = [(f"c{c:02d}", f"i{i:02d}", int(x[c, i])) for c, i in zip(*np.nonzero(x))]
    return x, spark.createDataFrame(cells, "customer_id string, product_group_id string, weight int")


def dense_scores(x, k):
    df = (x > 0).sum(axis=0)
    idf = np.log((1 + len(x)) / (1 + df)) + 1
    w = x * idf
    cols = w / np.linalg.norm(w, axis=0)
    sim = cols.T @ cols
    np.fill_diagonal(sim, 0)
    for i, row in enumerate(sim):
        keep = sorted(range(len(row)), key=lambda j: (-round(row[j], 12), j))[:k]
        sim[i] = [row[j] if j in keep else 0 for j in range(len(row))]
    return w @ sim


@pytest.mark.parametrize("n", [5, 20])
def test_recommendations_match_dense_product(matrix, n):
    """Unseen items by score; items that nothing points to fill up, by name."""
    x, inter = matrix
    want = dense_scores(x, 20)
    got = {}
    for r in collaborative.recommend(inter, n).collect():
        got.setdefault(r["customer_id"], {})[r["rank"]] = (r["product_group_id"], r["score"])
    assert "c00" not in got
    for c in range(1, 30):
        unseen = sorted((i for i in range(25) if x[c, i] == 0), key=lambda i: (-round(want[c, i], 9), i))[:n]
        mine = got[f"c{c:02d}"]
        assert sorted(mine) == list(range(1, len(unseen) + 1))
        assert [mine[k][0] for k in sorted(mine)] == [f"i{i:02d}" for i in unseen]
        assert [mine[k][1] for k in sorted(mine)] == pytest.approx([want[c, i] for i in unseen])


def test_lists_are_filled_up(spark, rows):
    """a points to y only; b has seen all; c has one item that nobody else has."""
    data = [("a", "x", 1), ("d", "x", 2), ("d", "y", 1), ("c", "z", 1)] + [("b", i, 1) for i in "uvwxyz"]
    inter = spark.createDataFrame([r for r in data if r[0] != "b"] + [("b", i, 1) for i in "xyz"], "customer_id string, product_group_id string, weight int")
    got = rows(collaborative.recommend(inter, 3).select("customer_id", "rank", "product_group_id"))
    assert [r for r in got if r[0] == "b"] == []
    assert {r[2] for r in got if r[0] == "a"} == {"y", "z"} and {r[2] for r in got if r[0] == "c"} == {"x", "y"}
    items = spark.createDataFrame([(i,) for i in "tuvwxyz"], "product_group_id string")
    wide = rows(collaborative.recommend(inter, 3, items=items).select("customer_id", "product_group_id", "score"))
    assert {c: sum(r[0] == c for r in wide) for c in "abcd"} == dict.fromkeys("abcd", 3)
    assert {r[1] for r in wide if r[0] == "b"} == {"t", "u", "v"} and all(r[2] == 0 for r in wide if r[0] == "b")


def test_search_reads_only_sets_that_can_count(spark):
    """The sets that are read give the same best variants as all sets."""
    rng = np.random.default_rng(4)
    relevance = spark.createDataFrame(
        [(f"q{q}", [f"w{s}"], int(rng.integers(1, 4))) for q in range(6) for s in range(40)], "query string, found array<string>, relevance long")
    short = spark.createDataFrame(
        [([f"w{s}"], f"v{s:02}{k}", float(rng.integers(0, 9))) for s in range(40) for k in range(int(rng.integers(1, 5)))],
        "found array<string>, variant_id string, popularity double")
    needed = activation.needed_sets(relevance, short, 5)

    def best(pairs):
        order = [F.desc("relevance"), F.desc("popularity"), F.asc("variant_id")]
        kept = top_per_key(pairs.join(short, "found"), ["query"], order, 5)
        return sorted((r["query"], r["variant_id"]) for r in kept.collect())

    assert best(needed) == best(relevance)
    assert needed.count() < relevance.count() / 3


def test_evaluation_counts_every_customer_with_two_items(matrix):
    x, inter = matrix
    row = collaborative.evaluate(inter, 10).first()
    assert row["n_eval"] == int(((x > 0).sum(axis=1) >= 2).sum())
    assert 0 <= row["cf_hits"] <= row["n_eval"] and 0 <= row["base_hit_rate"] <= 1


def test_text_embeddings_match_dense_svd(spark):
    texts = ["red silk dress", "blue silk dress", "green wool coat", "grey wool coat coat", "red coat", "the of and"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    rows = {r["id"]: r["row"].toArray() for r in embeddings.term_weights(df, "id", "text", 50).collect()}
    x = np.stack([rows[i] for i in range(6)])
    u, s, vt = np.linalg.svd(x, full_matrices=False)
    want = (x @ vt[:3].T)
    want = want @ want.T
    norms = np.sqrt(np.diag(want))
    got = {r["id"]: np.array(r["embedding"]) for r in embeddings.embed_text(df, "id", "text", 50, 3).collect()}
    for i in range(5):
        for j in range(5):
            assert got[i] @ got[j] == pytest.approx(want[i, j] / norms[i] / norms[j], abs=1e-9)
    assert not got[5].any()


def test_features_strictly_before_the_cutoff(spark):
    cutoff = datetime(2024, 1, 10)
    ntz = lambda df, c: df.withColumn(c, F.col(c).cast("timestamp_ntz"))
    events = ntz(spark.createDataFrame(
        [("a", "s1", "page_view", "2024-01-09 12:00:00"), ("a", "s2", "page_view", "2024-01-10 00:00:00")],
        "customer_id_extended string, session_id string, event_type string, event_at string"), "event_at")
    orders = ntz(spark.createDataFrame(
        [("b", "completed", 10.0, "2024-01-01 00:00:00"), ("b", "cancelled", 99.0, "2024-01-02 00:00:00"),
         ("a", "completed", 5.0, "2024-01-10 00:00:00")],
        "customer_id string, order_status string, net_amount double, order_at string"), "order_at")
    mails = ntz(spark.createDataFrame([("b", "open", "2024-01-03 00:00:00")], "customer_id string, event_type string, event_at string"), "event_at")
    people = spark.createDataFrame([("b", True, "Gold", "Petite", True)],
                                   "customer_id string, loyalty_member boolean, loyalty_tier string, brand_line_affinity string, is_current boolean")
    out = propensity.label(propensity.features_asof(events, orders, mails, people, cutoff), orders, cutoff)
    got = {r["customer_id"]: r for r in out.collect()}
    a, b = got["a"], got["b"]
    assert (a["n_events"], a["recency_days"], a["order_recency_days"], a["label"], a["has_prior_order"]) == (1, 0, 999, 1, 0)
    assert (b["recency_days"], b["order_recency_days"], b["total_spend"], b["avg_order_value"], b["label"]) == (999, 9, 10.0, 10.0, 0)
    assert (b["loyalty_member"], b["is_gold"], b["is_petite"], a["loyalty_member"]) == (1, 1, 1, 0)


@pytest.fixture(scope="module")
def scored(spark):
    rng = np.random.default_rng(1)
    n = 400
    data = []
    for i in range(n):
        spend = float(rng.gamma(2, 50))
        bought = int(rng.random() < 1 / (1 + np.exp(-(spend - 120) / 20)))
        row = {c: 0.0 for c in propensity.FEATURES}
        row.update(customer_id=f"c{i:03d}", total_spend=spend, n_events=float(rng.integers(1, 9)), label=bought, has_prior_order=1)
        data.append(row)
    return spark.createDataFrame(data)


def test_model_split_metrics_and_deciles(scored):
    train, test = propensity.split(scored)
    total, positives = scored.count(), scored.filter("label = 1").count()
    assert train.count() + test.count() == total
    assert test.filter("label = 1").count() == round(positives * 0.25)
    model = propensity.fit(train)
    assert propensity.drivers(model)[0][0] == "total_spend"
    predicted = propensity.predict(model, test)
    row = propensity.evaluate(predicted).first()
    pdf = predicted.select("label", "purchase_propensity").toPandas().sort_values("purchase_propensity", ascending=False)
    hits = pdf["label"].cumsum()
    steps = (hits / np.arange(1, len(pdf) + 1) * pdf["label"]).sum() / hits.iloc[-1]
    assert row["pr_auc"] == pytest.approx(steps)
    assert row["roc_auc"] > 0.8 and row["lift"] > 1
    deciles = propensity.score(model, scored).groupBy("propensity_decile").count().collect()
    assert sorted(r["propensity_decile"] for r in deciles) == list(range(1, 11))
    assert {r["count"] for r in deciles} == {40}


def test_average_precision_with_ties(spark):
    df = spark.createDataFrame([(0.9, 1), (0.5, 1), (0.5, 0), (0.5, 0), (0.1, 1)], "s double, y int")
    got = df.limit(1).select(propensity.average_precision(df, "s", "y").alias("ap")).first()["ap"]
    # recall steps 1/3 each at precision 1, 2/4 and 3/5
    assert got == pytest.approx((1 + 2 / 4 + 3 / 5) / 3)


def test_variant_prefers_the_size(spark, rows):
    recs = spark.createDataFrame([("k", "g"), ("m", "g"), ("k", "none")], "customer_id string, product_group_id string")
    variants = spark.createDataFrame(
        [("v1", "g", "S", True, True), ("v2", "g", "M", True, True), ("v0", "g", "M", False, True)],
        "variant_id string, product_group_id string, size string, is_in_stock boolean, is_active boolean")
    variants = variants.withColumns({"style_name": F.lit("s"), "category_id": F.lit("c"), "price": F.lit(1.0)})
    sizes = spark.createDataFrame([("k", "M"), ("m", "XL")], "customer_id string, home_size string")
    assert rows(blend.expand_variant(recs, variants, sizes), "customer_id", "variant_id") == [("k", "v2"), ("m", "v1")]


def test_text_hits_find_words_inside_words(spark, rows):
    queries = spark.createDataFrame([("Red x RED",), ("zzz",), ("",)], "query string")
    texts = spark.createDataFrame([("bored fox",), ("red",), ("blue",)], "search_text string")
    assert rows(activation.text_hits(queries, texts), "query", "search_text", "relevance") == [
        ("Red x RED", "bored fox", 3), ("Red x RED", "red", 2)]


def test_words_of_four_languages_are_kept(spark):
    from tidemark.plans.reco import embeddings

    texts = ["größe über straße", "café naïve élève", "niño corazón año", "plain words stand"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    rows = embeddings.term_weights(df, "id", "text").collect()
    assert all(r["row"].numNonzeros() == 3 for r in rows)


@pytest.mark.parametrize("blocks", [(1024, 16384), (7, 11)])
def test_nearest_for_all_seeds(spark, blocks):
    """Several blocks, ties, null and zero vectors, seeds that are no items, fewer items than asked for."""
    rng = np.random.default_rng(8)
    items = [(i, [float(x) for x in rng.integers(-2, 3, 3)]) for i in range(80)] + [(90, None), (91, [0.0] * 3)]
    seeds = items[:20] + [(500 + i, [float(x) for x in rng.integers(1, 4, 3)]) for i in range(10)]
    a, b = (spark.createDataFrame(x, "k long, v array<double>") for x in (seeds, items))
    got = {}
    for r in embeddings.nearest_for_all(a, b, "k", "v", 4, *blocks).collect():
        got.setdefault(r["seed"], {})[r["rank"]] = (r["k"], round(r["cos"], 9))

    def cos(x, y):
        return float(np.dot(x, y) / np.linalg.norm(x) / np.linalg.norm(y))

    for name, v in seeds:
        if not any(v):
            assert name not in got
            continue
        near = sorted((-round(cos(v, w), 12), k) for k, w in items if w is not None and any(w) and k != name)[:4]
        assert [got[name][i + 1] for i in range(4)] == [(k, round(-c, 9)) for c, k in near]
    few = embeddings.nearest_for_all(a, b.filter("k < 2"), "k", "v", 4, *blocks)
    assert few.groupBy("seed").count().agg({"count": "max"}).first()[0] <= 2


def test_vectors_are_copied_for_few_blocks(spark):
    """Blocks are as large as the tasks allow: 9000 vectors were copied nine times before. Results stay exact."""
    rng = np.random.default_rng(4)
    data = [(i, [float(x) for x in rng.integers(-9, 10, 4)]) for i in range(9000)]
    df = spark.createDataFrame(data, "k long, v array<float>")
    out = embeddings.nearest_for_all(df.filter("k < 30"), df, "k", "v", 3)
    plan = out._jdf.queryExecution().analyzed().toString()
    copies = [int(x) + 1 for x in re.findall(r"explode\(sequence\(0, (?:\(?)(\d+)", plan)]
    tasks = 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert len(copies) == 2 and max(copies) ** 2 <= tasks
    v = np.array([x for _, x in data])
    length = np.linalg.norm(v, axis=1)
    for r in out.filter("rank = 1").collect():
        cos = np.divide(v @ v[r["seed"]], length * length[r["seed"]], out=np.full(len(v), -2.0), where=length > 0)
        cos[r["seed"]] = -2
        assert round(r["cos"], 9) == round(cos.max(), 9)


def exchanges(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [line for line in plan.splitlines() if "Exchange hashpartitioning(" in line]


def test_lists_of_a_customer_are_made_where_the_customer_is(spark, rows):
    """Scores and candidates, many for each interaction, are not shuffled by customer and group."""
    cells = [(f"c{c}", f"g{g}", 1 + (c + g) % 3) for c in range(12) for g in range(8) if (c * g) % 5 < 3]
    inter = spark.createDataFrame(cells, "customer_id string, product_group_id string, weight long")
    scores = collaborative.affinities(inter)
    assert not [e for e in exchanges(scores) if "customer_id" in e and "neighbour" in e]
    assert not set(rows(scores.select("customer_id", "product_group_id"))) & {c[:2] for c in cells}

    def table(data, schema):
        return spark.createDataFrame(data, schema)

    cands = blend.candidates(
        table([("k",), ("m",)], "customer_id string"),
        table([("k", "a", 0.5), ("k", "b", 0.4), ("z", "a", 1.0)], "customer_id string, product_group_id string, score double"),
        table([("s", "b", 0.9), ("s", "c", 0.8)], "product_group_id string, neighbour_product_group_id string, score double"),
        table([("k", "s"), ("k", "a"), ("m", None), ("z", "s")], "customer_id string, product_group_id string"),
        table([("p", 9.0), ("s", 5.0)], "product_group_id string, pop double"))
    assert not [e for e in exchanges(cands) if "customer_id" in e and "product_group_id" in e]
    assert rows(cands) == [("k", "b", 0.4, 0.9), ("k", "c", 0.0, 0.8), ("k", "p", 0.0, 0.0), ("m", "p", 0.0, 0.0), ("m", "s", 0.0, 0.0)]


def _final_plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]


def _bought(spark):
    lines = [(f"o{i // 2}", f"v{i % 5}") for i in range(40)] + [(None, "v1"), ("o1", None)]
    orders = [(f"o{i}", f"k{i % 3}" if i % 4 else None) for i in range(20)] + [("o1", "k1")]
    products = [(f"v{i}", f"g{i % 4}" if i else None, "style", "cat") for i in range(5)]
    return (
        spark.createDataFrame(lines, "order_id string, variant_id string"),
        spark.createDataFrame(orders, "order_id string, customer_id string"),
        spark.createDataFrame(products, "variant_id string, product_group_id string, style_name string, category_id string"),
    )


def test_transactions_are_shuffled_once(spark):
    """The distinct rows and the window over a transaction share one shuffle."""
    lines, orders, products = _bought(spark)
    out = copurchase.transactions(lines, orders, products)
    exchanges = [x for x in _final_plan(out).splitlines() if "Exchange" in x and "transaction" in x]
    assert len(exchanges) == 1
    group = {r["variant_id"]: r["product_group_id"] for r in products.collect()}
    buyers = [tuple(r) for r in orders.collect()]
    want = {}
    for order, variant in map(tuple, lines.collect()):
        for known, customer in buyers:
            if known == order and group.get(variant):
                want.setdefault((f"o:{order}", 2.0), set()).add(group[variant])
                if customer:
                    want.setdefault((f"c:{customer}", 1.0), set()).add(group[variant])
    want = sorted((t, w, g) for (t, w), gs in want.items() if len(gs) > 1 for g in gs)
    assert sorted((r["transaction"], r["weight"], r["product_group_id"]) for r in out.collect()) == want


def test_item_numbers_do_not_shuffle_the_rows(spark, monkeypatch):
    """Rows meet the numbers of their items where they are: by item, few tasks would get them all."""
    met = []

    def recorded(rows, *args, **kwargs):
        met.append(rows)
        return rows.selectExpr("1L AS item_a", "2L AS item_b", "1D AS dot")

    monkeypatch.setattr(copurchase, "pair_sums", recorded)
    monkeypatch.setattr(collaborative, "pair_sums", recorded)
    lines, orders, products = _bought(spark)
    copurchase.neighbours(copurchase.transactions(lines, orders, products), copurchase.group_names(products))
    seen = spark.createDataFrame([("k", "g1", 1), ("l", "g2", 3)], "customer_id string, product_group_id string, weight int")
    collaborative.item_neighbours(seen)
    for rows in met:
        plan = _final_plan(rows)
        assert "BroadcastHashJoin" in plan and "hashpartitioning(product_group_id" not in plan
