import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from odd_tables import no_docs, odd_docs, odd_rows  # noqa: F401
from tidemark.llm import scoring


def tokens(text):
    return [*(text or "").encode().lower().split(), None]


def brute_base(rows):
    counts = Counter()
    for k, t in rows:
        if k is not None and zlib.crc32(str(k).encode()) % 10:
            counts.update(tokens(t))
    n, v = sum(counts.values()), len(counts)
    out = []
    for k, t in rows:
        words = tokens(t)
        base = sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in words)
        out.append((repr(k), len(words), sum(counts[w] > 0 for w in words), n, base))
    return sorted(out)


def test_counts_and_base_match_brute_force(odd_docs, odd_rows):
    got = scoring.score(odd_docs.repartition(3).persist()).collect()
    want = brute_base([(r[0], r[1]) for r in odd_rows])
    have = sorted((repr(r["doc_id"]), r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"]) for r in got)
    assert [w[:4] for w in want] == [h[:4] for h in have]
    assert [h[4] for h in have] == pytest.approx([w[4] for w in want])
    for r in got:
        held = r["doc_id"] is None or zlib.crc32(str(r["doc_id"]).encode()) % 10 == 0
        assert r["held_out"] == held and -math.inf < r["score"] < 0


def test_model_is_the_interpolation(spark):
    """Scores are those of plain dictionaries with the weights that the cells give."""
    rows = [(i, " ".join("ab ba ca"[(i * k) % 6 : (i * k) % 6 + 2] for k in range(i % 7))) for i in range(60)]
    fold = {k: zlib.crc32(str(k).encode()) % 10 for k, _ in rows}

    def count(folds):
        one, two = Counter(), Counter()
        for k, t in rows:
            if fold[k] in folds:
                before = "start"
                one["start"] += 1
                for w in tokens(t):
                    one[w] += 1
                    two[before, w] += 1
                    before = w
        return one, two, sum(n for w, n in one.items() if w != "start"), len(one) - 1

    one, two, n, v = count(range(2, 10))
    cells = Counter()
    step = lambda p: 1 + min(round(-math.log2(p) * scoring.CELLS), 999) if p else 0
    bucket = lambda c: min(math.ceil(math.log2(c + 1)), scoring.BUCKETS - 1)
    for k, t in rows:
        if fold[k] == 1:
            before = "start"
            for w in tokens(t):
                p2 = two[before, w] / max(1, one[before])
                cells[(bucket(one[before]) * 1001 + step(p2)) * 1001 + step(one[w] / n)] += 1
                before = w
    weights = scoring.learn_weights(np.array(sorted(cells.items()), dtype=np.int64).reshape(-1, 2), 1 / (v + 1))
    one, two, n, v = count(range(1, 10))
    want = {}
    for k, t in rows:
        before, total = "start", 0.0
        for w in tokens(t):
            mixed = weights[bucket(one[before])] @ [two[before, w] / max(1, one[before]), one[w] / n, 1 / (v + 1)]
            total += math.log10(mixed)
            before = w
        want[k] = total
    got = scoring.score(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["score"] for r in got} == pytest.approx(want)


def test_weights_follow_the_held_out_counts():
    cell = lambda p2, p1: (5 * 1001 + p2) * 1001 + p1
    trusting = scoring.learn_weights(np.array([[cell(9, 80), 100]]), 1e-6)[5]
    doubting = scoring.learn_weights(np.array([[cell(0, 17), 100]]), 1e-6)[5]
    assert trusting[0] > 0.9 and doubting[1] > 0.9
    assert scoring.learn_weights(np.zeros((0, 2), np.int64), 0.1)[3] == pytest.approx([1 / 3] * 3)


def test_no_documents(no_docs):
    assert scoring.score(no_docs).count() == 0


def test_places_are_those_of_a_search_and_none_is_made(monkeypatch):
    """One sort places all n-grams of a chunk: six searches of every token were most of the time."""
    texts = pa.array(["b a b", None, "", "a b a b c", "B\tc"])
    g = scoring.tagged(scoring.grams_of(texts, np.array([0, 1, 2, 3, 4])))
    keys = sorted({*g.words.tolist(), *g.bigrams.tolist(), int(scoring.START)})
    want = [[keys.index(x) for x in grams.tolist()] for grams in (g.words, g.bigrams, g.contexts)]
    monkeypatch.setattr(np, "searchsorted", None)
    at = scoring.places_of(g)
    assert at.keys.tolist() == keys and keys[at.start] == int(scoring.START)
    assert [at.words.tolist(), at.bigrams.tolist(), at.contexts.tolist()] == want
