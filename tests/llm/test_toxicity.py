import math
import random
import zlib

import numpy as np
import pyarrow as pa

from odd_tables import no_docs, odd_docs, odd_rows  # noqa: F401
from tidemark.llm import toxicity


def corpus(n=600, seed=4):
    rng = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        words = ["".join(rng.choices("abcdefgh", k=rng.randint(2, 5))) for _ in range(rng.randint(10, 60))]
        toxic = rng.random() < 0.15
        if toxic:
            for _ in range(rng.randint(2, 4)):
                words.insert(rng.randrange(len(words)), "vilest" + "".join(rng.choices("xyz", k=3)))
        rows.append((i, " ".join(words)))
        if rng.random() < 0.5:
            labels.append((i, 1, int(toxic)))
    return rows, labels


def test_held_out_accuracy(spark):
    rows, labels = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 toxic", "2 score")
    got = toxicity.toxicity(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    known = {k: t for k, _, t in labels}
    held = [r for r in got if r["held_out"] and r["doc_id"] in known]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got)
    assert np.mean([r["predicted"] == known[r["doc_id"]] for r in held]) > 0.95


def test_odd_rows_and_held_out_labels_are_not_learned(spark, odd_docs, odd_rows, no_docs):
    labels = spark.createDataFrame([(None, 1, 1), (1, None, None), (2, 1, 1), (2, 1, 0)], "doc_id long, quality int, toxic int")
    got = toxicity.toxicity(odd_docs, labels).collect()
    assert len(got) == len(odd_rows) and all(0 <= r["score"] <= 1 for r in got)
    held = [k for k in range(200) if zlib.crc32(str(k).encode()) % 5 == 0]
    only_held = spark.createDataFrame([(k, 1, 1) for k in held], "doc_id long, quality int, toxic int")
    assert not any(r["predicted"] for r in toxicity.toxicity(odd_docs, only_held).collect())
    assert toxicity.toxicity(no_docs, labels).count() == 0


def test_features_are_distinct_per_text():
    features, bounds = toxicity.text_features(pa.array(["worthless worthless", None, "a"]))
    assert (np.diff(bounds) == [3, 0, 1]).all() and len(np.unique(features[:3])) == 3


def test_risk_does_not_go_negative():
    """With hardly any overlap, memorised positives are taken back: scores of the rest stay low."""
    rng = np.random.default_rng(0)
    positives = [np.array([0, rng.integers(2, 50)]) for _ in range(40)]
    unlabelled = [np.array([rng.integers(2, 50)]) for _ in range(360)] + positives
    w, bias = toxicity.fit(positives, unlabelled, 50, 0.1)
    assert w[0] + bias > 0 and (w[2:] + bias < 0).all()


def plain_risk(w, positives, unlabelled, prior, decay):
    """The estimated risk in loops; where its second part is negative, what a step back minimises."""
    def score(row):
        return 1 / (1 + math.exp(-(sum(w[f] for f in row) + w[-1])))

    p, u = [score(r) for r in positives], [score(r) for r in unlabelled]
    negative = sum(u) / len(u) - prior * sum(p) / len(p)
    positive = prior * sum(1 - s for s in p) / len(p)
    ridge = decay / 2 * sum(x * x for x in w[:-1])
    return (positive + negative if negative >= 0 else -negative) + ridge, negative


def test_fit_against_numeric_gradients():
    """Adam on gradients from differences of the plain risk; some steps are steps back."""
    rng = np.random.default_rng(6)
    positives = [np.unique(np.append(rng.integers(1, 6, 2), 0)) for _ in range(6)]
    unlabelled = [np.unique(rng.integers(1, 6, 2)) for _ in range(12)]
    features, prior, rate, decay = 6, 0.5, 0.2, 1e-3
    w = np.zeros(features + 1)
    mean, square, back = np.zeros_like(w), np.zeros_like(w), 0
    for step in range(1, 41):
        _, negative = plain_risk(w, positives, unlabelled, prior, decay)
        back += negative < 0
        change = np.zeros_like(w)
        for i in range(len(w)):
            up, down = w.copy(), w.copy()
            up[i] += 1e-6
            down[i] -= 1e-6
            change[i] = (plain_risk(up, positives, unlabelled, prior, decay)[0] - plain_risk(down, positives, unlabelled, prior, decay)[0]) / 2e-6
        mean = 0.9 * mean + 0.1 * change
        square = 0.99 * square + 0.01 * change * change
        w = w - rate * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-8)
    got, bias = toxicity.fit(positives, unlabelled, features, prior, steps=40, rate=rate, decay=decay)
    assert back > 0 and np.allclose(np.append(got, bias), w, atol=1e-3)


def test_select_against_plain_counts():
    rng = np.random.default_rng(3)
    n_p, n_u, prior = 60, 400, 0.1
    positive, unlabelled = rng.integers(0, 40, 300), rng.integers(0, 60, 300)
    positive[:5], unlabelled[:5] = [0, 60, 3, 2, 30], [0, 0, 1, 0, 30]
    want = []
    for f, (a, b) in enumerate(zip(positive.tolist(), unlabelled.tolist())):
        share = (a + b) / (n_p + n_u)
        evidence = 0.0
        for k, n in ((a, n_p), (b, n_u)):
            for seen, expected in ((k / n, share), (1 - k / n, 1 - share)):
                if seen > 0:
                    evidence += 2 * n * seen * math.log(seen / expected)
        if a >= toxicity.LEAST_POSITIVES and b / n_u < 1.5 * prior * a / n_p and evidence >= toxicity.EVIDENCE:
            want.append(f)
    assert want and toxicity.select(positive, unlabelled, n_p, n_u, prior).tolist() == want
