import numpy as np
import pytest

from tidemark.llm import multiindex

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, asked, k, width=4):
    held = [
        (key, np.array(v, dtype=np.float64)) for key, v, _ in rows
        if not (key is None or v is None or len(v) != width or any(x is None or not np.isfinite(x) for x in v) or not any(v))
    ]
    out = []
    for i, (q, a) in enumerate(held):
        if asked(q):
            found = []
            for j, (key, b) in enumerate(held):
                if j != i:
                    x, y = a / np.abs(a).max(), b / np.abs(b).max()
                    found.append((-(x * y).sum() / (np.sqrt((x * x).sum()) * np.sqrt((y * y).sum())), key))
            out += [(q, n + 1, key, -s) for n, (s, key) in enumerate(sorted(found)[:k])]
    return sorted(out, key=lambda r: (r[0], r[1], -r[3], r[2]))


def odd_rows():
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in rng.integers(-3, 4, 4)], i % 3) for i in range(0, 300)]
    rows += [(1000, None, 1), (1001, [0.0] * 4, 1), (1002, [1.0, None, 2.0, 3.0], 1), (1003, [float("nan")] * 4, None)]
    rows += [(1004, [float("inf"), 1.0, 1.0, 1.0], 1), (1005, [1.0, 2.0], 1), (None, [1.0] * 4, 1), (50, rows[50][1], 1)]
    return rows + [(2000 + i, [1.0, 1.0, 1.0, 2.0], 0) for i in range(40)]


def compare(df, want):
    got = sorted((tuple(r) for r in df.collect()), key=lambda r: (r[0], r[1], -r[3], r[2]))
    assert [(g[0], g[1]) for g in got] == [(w[0], w[1]) for w in want]
    assert np.allclose([g[3] for g in got], [w[3] for w in want], atol=1e-12)
    # Ties by rounding aside, the ids agree; equal vectors are in order of their ids.
    assert np.mean([g[2] == w[2] for g, w in zip(got, want)]) > 0.9


def test_exact_when_all_cells_are_walked(spark, monkeypatch):
    monkeypatch.setattr(multiindex, "SLAB", 16)
    monkeypatch.setattr(multiindex, "QUERY_BLOCK", 3)
    df = spark.createDataFrame(odd_rows(), SCHEMA).selectExpr("*", "1 cell", "2 slab")
    found = multiindex.nearest(df, df.filter("vec_id % 50 = 0"), share=1.0, centroids=5)
    compare(found, brute(odd_rows(), lambda q: q % 50 == 0, 5))


def test_every_row_is_a_candidate(spark):
    """Rows of one key are rows of their own; very large and very small vectors have their cosine."""
    rows = [(0, [1.0, 0.0], 1), (1, [0.0, 1.0], 1), (1, [1.0, 0.1], 1), (2, [0.7, 0.7], 1), (0, [1.0, 0.0], 1),
            (3, [1e200, 1e199], 1), (4, [1e-200, 2e-200], 1), (5, [-1e-310, 1e-310], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    found = multiindex.nearest(df, df.filter("vec_id in (0, 3)"), share=1.0)
    want = brute(rows, lambda q: q in (0, 3), 5, 2)
    compare(found, want)
    assert {(0, 1, 0), (3, 1, 1)} <= {w[:3] for w in want}


@pytest.mark.parametrize("size", ["sf0.01", "sf0.1"])
def test_recall_on_the_given_vectors(spark, size):
    df = spark.read.parquet(f"/root/testdata/{size}/embeddings.parquet")
    rows = df.select("vec_id", "embedding").toPandas()
    m = np.stack(rows["embedding"].to_numpy()).astype(float)
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    found = multiindex.nearest(df, df.filter("vec_id % 50 = 0")).collect()
    hits = 0
    for i in np.flatnonzero(rows["vec_id"] % 50 == 0):
        s = m @ m[i]
        s[i] = -2
        best = set(rows["vec_id"].to_numpy()[np.argsort(-s)[:5]].tolist())
        hits += len(best & {r["vec_id"] for r in found if r["query_id"] == rows["vec_id"][i]})
    print(size, hits / len(found))
    assert hits >= 0.9 * len(found)


def test_walk_is_in_order_of_summed_distance():
    rng = np.random.default_rng(0)
    a, b = rng.random(6), rng.random(5)
    cells = multiindex.walk(a, b, np.ones(30, dtype=int), 30)
    sums = [a[c // 5] + b[c % 5] for c in cells]
    assert sorted(cells) == list(range(30)) and sums == sorted(sums)
    assert multiindex.walk(a, b, np.ones(30, dtype=int), 7) == cells[:7]


def test_few_and_no_vectors(spark):
    few = spark.createDataFrame([(0, [1.0, 0.0], 1), (1, [1.0, 1.0], 1)], SCHEMA)
    assert [tuple(r)[:3] for r in multiindex.nearest(few, few).orderBy("query_id").collect()] == [(0, 1, 1), (1, 1, 0)]
    none = few.filter("false")
    assert multiindex.nearest(none, none).count() == 0
    assert multiindex.nearest(few.filter("vec_id = 0"), few).count() == 0
