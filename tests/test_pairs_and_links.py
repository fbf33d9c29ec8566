from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.operators import gram, links
from tidemark.operators.links import best_shared


@pytest.mark.parametrize("n_items,salts,small", [(30, 1, False), (30, 5, True), (2300, 3, False), (300, 2, True)])
def test_pair_sums_match_matrix_product(spark, n_items, salts, small):
    """Several blocks, a group that holds every item, groups of one item; chunks and sums that do not fit."""
    sizes = {"block": 16, "chunk": 50, "spill": 40} if small else {}
    rng = np.random.default_rng(n_items)
    x = (rng.random((25, n_items)) < 0.05) * rng.integers(1, 5, (25, n_items))
    x[0] = 1
    w = rng.integers(1, 4, 25)
    cells = [(int(g), int(i), float(x[g, i]), float(w[g])) for g, i in zip(*np.nonzero(x))]
    df = spark.createDataFrame(cells, "g int, i int, v double, w double")
    got = {(r["item_a"], r["item_b"]): r["dot"]
           for r in gram.pair_sums(df, "g", "i", "v", "w", salts, **sizes).collect()}
    full = x.T @ (x * w[:, None])
    want = {(int(a), int(b)): float(full[a, b]) for a, b in zip(*np.nonzero(np.triu(full, 1)))}
    assert got == want


@pytest.mark.parametrize("shift", [0, -7, 1 << 40])
def test_pair_sums_end_small_sums_and_take_any_numbers(spark, shift):
    """Sums below `least` do not leave the strips; a repeated cell is no pair of its own."""
    cells = [("g", 1), ("g", 2), ("h", 1), ("h", 2), ("h", 3), ("i", 4), ("i", 4), (None, 1), (None, 3), (None, 3), ("g", None)]
    df = spark.createDataFrame([(g, None if i is None else i + shift, 1.0) for g, i in cells], "g string, i long, one double")
    out = gram.pair_sums(df, "g", "i", "one", "one", least=2.0)
    assert [tuple(r) for r in out.collect()] == [(1 + shift, 2 + shift, 2.0)]
    assert gram.pair_sums(df.limit(0), "g", "i", "one", "one").count() == 0


def test_pairs_are_sent_in_few_rows():
    """Items spread over 2000 blocks of the earlier layout; a row holds hundreds of pairs, not one."""
    rng = np.random.default_rng(5)
    width = 2_000_000
    keys = np.unique(rng.integers(0, 1000, 50_000) * 2000 * width + rng.integers(0, width, 50_000))
    sent = [r for b in gram._runs(keys, np.ones(len(keys)), width, np.array([500_000, 1_000_000])) for r in b.to_pylist()]
    assert len(sent) < 110 and {r["strip"] for r in sent} == {0, 1, 2}
    back = [h * width + p for r in sent for h, p in zip(np.repeat(r["heads"], r["counts"]), r["partners"])]
    assert back == keys.tolist()


@pytest.mark.parametrize("block", [16, 4096])
def test_pair_sums_in_rounds(spark, monkeypatch, block):
    """Many pairs of few cells are made in rounds over ranges of the smaller item, and each round is written."""
    for name, size in (("ROUND", 100), ("CELLS", 1)):
        monkeypatch.setattr(gram, name, size)
    rounds, real = [], gram.stored
    monkeypatch.setattr(gram, "stored", lambda df, label: rounds.append(real(df, label)) or rounds[-1])
    rng = np.random.default_rng(8)
    x = (rng.random((12, 60)) < 0.5) * rng.integers(1, 5, (12, 60))
    cells = [(int(g), int(i), float(x[g, i]), 1.0) for g, i in zip(*np.nonzero(x))]
    out = gram.pair_sums(spark.createDataFrame(cells, "g int, i int, v double, w double"), "g", "i", "v", "w", block=block, least=4.0)
    full = np.triu(x.T @ x, 1)
    assert {(r["item_a"], r["item_b"]): r["dot"] for r in out.collect()} == {
        (int(a), int(b)): float(full[a, b]) for a, b in zip(*np.nonzero(full >= 4))}
    sizes = [r.count() for r in rounds]
    assert len(sizes) > 3 and max(sizes) < sum(sizes) / 2


def test_runs_that_are_sent_compress():
    """Pairs as whole numbers and doubles take almost twice the room."""
    rng = np.random.default_rng(4)
    width, edges = 100_000, np.array([300, 700])
    keys = np.unique(rng.integers(0, 1000, 60_000) * width + rng.integers(1000, width, 60_000))
    values = rng.integers(1, 4, len(keys)).astype(float)
    plain = list(gram._runs(keys, values, width, edges))
    sent = [gram._packed(b) for b in plain]
    back = [gram._unpacked(b, width) for b in sent]
    assert (np.concatenate([k for k, _ in back]) == keys).all() and (np.concatenate([v for _, v in back]) == values).all()
    size = [sum(len(pa.Codec("lz4").compress(bytes(x))) for b in bs for c in b.columns[1:] for x in (c.flatten() if bs is plain else c).buffers()[-1:]) for bs in (plain, sent)]
    assert 1.8 * size[1] < size[0] and size[1] < 3.5 * len(keys)


def test_sparse_sums_spill_and_add_up():
    rng = np.random.default_rng(2)
    sums, out = gram.Sums(100), []
    keys, values = rng.integers(0, 500, 5000), rng.integers(1, 9, 5000).astype(float)
    for part in np.array_split(np.arange(5000), 70):
        out += list(sums.add(keys[part], values[part]))
        assert sums.held <= 100 + 72
    out += list(sums.rest())
    assert len(out) > 2 and all((np.diff(k) > 0).all() for k, _ in out)
    got = np.bincount(np.concatenate([k for k, _ in out]), np.concatenate([v for _, v in out]), 500)
    assert (got == np.bincount(keys, values, 500)).all()


def test_dense_numbers(spark):
    df = spark.createDataFrame([("b",), ("a",), ("b",), ("c",)], "v string")
    got = {r["v"]: r["n"] for r in gram.dense_numbers(df, "v", "n").collect()}
    assert got == {"a": 0, "b": 1, "c": 2}


def brute_force(sources, targets):
    by_key = defaultdict(set)
    for t, k in targets:
        by_key[k].add(t)
    best = {}
    strength = defaultdict(Counter)
    for s, k, w in sources:
        for t in by_key[k]:
            strength[s][t] += w
    for s, c in strength.items():
        t = min(c, key=lambda t: (-c[t], t))
        best[s] = (t, c[t])
    return best


def population(seed, n_sources, n_targets, n_keys, share):
    """Values from rare to one that most members have; members with one value and with very many."""
    rng = np.random.default_rng(seed)
    odds = np.linspace(0.02, 1.0, n_keys) ** 3 * share
    sources = {(f"s{m:03}", f"k{k}") for m in range(n_sources) for k in np.flatnonzero(rng.random(n_keys) < odds)}
    targets = {(f"t{m:03}", f"k{k}") for m in range(n_targets) for k in np.flatnonzero(rng.random(n_keys) < odds)}
    everything = {("s999", f"k{k}") for k in range(n_keys)} | {("lonely", "nobody")}
    return sorted(sources | everything), sorted(targets | {("t999", f"k{k}") for k in range(0, n_keys, 2)} | {("t998", "unasked")})


@pytest.mark.parametrize("shape", [(40, 30, 13, 0.8), (60, 60, 40, 0.3), (30, 50, 4, 1.0), (80, 20, 25, 0.1)])
@pytest.mark.parametrize("weighted", [False, True])
def test_best_shared(spark, shape, weighted):
    """The result is that of joining everything."""
    sources, targets = population(11, *shape)
    left = [(s, k, (hash_free(s, k) if weighted else 1)) for s, k in sources]
    a = spark.createDataFrame(left, "s string, k string, w int")
    b = spark.createDataFrame(targets, "t string, k string")
    out = best_shared(a, b, "s", "t", "k", "w" if weighted else None)
    got = {r["s"]: (r["t"], r["strength"]) for r in out.collect()}
    assert got == brute_force(left, targets)


@pytest.mark.parametrize("weighted,often", [(False, 1), (True, 40), (True, 10**9)])
def test_many_values_of_few_are_compared_in_blocks(spark, monkeypatch, weighted, often):
    """Members with most of 40 values, whose rests all differ: no pairs of rests are made."""
    monkeypatch.setattr(links, "_pairs", lambda *a: pytest.fail("pairs of rests"))
    for name, size in (("HEAVY", 1), ("TARGET_BLOCK", 32), ("SLICE", 10), ("VALUES", 7), ("OFTEN", often)):
        monkeypatch.setattr(links, name, size)
    sources, targets = population(3, 300, 70, 40, 0.9)
    left = [(s, k, (hash_free(s, k) if weighted else 1)) for s, k in sources]
    a = spark.createDataFrame(left, "s string, k string, w int")
    b = spark.createDataFrame(targets, "t string, k string")
    out = best_shared(a, b, "s", "t", "k", "w" if weighted else None)
    assert {r["s"]: (r["t"], r["strength"]) for r in out.collect()} == brute_force(left, targets)


@pytest.mark.parametrize("weighted", [False, True])
def test_blocks_of_members_travel_packed(spark, monkeypatch, weighted):
    """Many members in a row, and less than half a byte per value where half of all values are had; shuffles are dropped."""
    sent, real = [], links._members
    monkeypatch.setattr(links, "_members", lambda *a: sent.append(real(*a)) or sent[-1])
    freed = []
    monkeypatch.setattr(links, "stored", lambda df, label, real=links.stored: freed.append(
        spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled")) or real(df, label))
    grid = spark.range(300).join(spark.range(200).withColumnRenamed("id", "k")).filter("abs(xxhash64(id, k)) % 2 = 0")
    a = grid.select(F.col("id").alias("s"), "k", (F.col("k") % 3 + 1 if weighted else F.lit(1)).alias("w"))
    b = grid.filter("id < 120").select((F.col("id") + 1000).alias("t"), ((F.col("k") + 1) % 200).alias("k"))
    got = {tuple(r) for r in best_shared(a, b, "s", "t", "k", "w" if weighted else None).collect()}
    strength = a.join(b, "k").groupBy("s", "t").agg(F.sum("w").alias("n")).collect()
    best = {}
    for s, t, n in sorted(map(tuple, strength), key=lambda r: (r[0], -r[2], r[1])):
        best.setdefault(s, (s, t, n))
    assert got == set(best.values()) and freed == ["true"] * 3
    for rows, n in zip(sent, (300, 120)):
        kept = [r.asDict() for r in rows.collect()]
        cells = sum(r["cells"] for r in kept)
        assert sum(r["n"] for r in kept) == n and len(kept) <= 5 and cells > 80 * n
        assert sum(len(r["v"]) + len(r["counts"]) + (len(r["w"]) if not weighted else 0) for r in kept) < cells / 2


@pytest.mark.parametrize("values,often", [(1, 1), (4, 1), (1000, 1), (1000, 10**9)])
def test_bits_and_lists_of_targets_add_up(values, often):
    """Members without values, weights of many digits, blocks that are no multiple of eight."""
    rng = np.random.default_rng(values)

    def packed(n, odds):
        has = [np.flatnonzero(rng.random(50) < o).astype(np.int32) for o in rng.random(n) * odds]
        w = [rng.integers(1, 1 << 40, len(x)) for x in has]
        batch = pa.RecordBatch.from_pydict({"m": range(n), "v": pa.array(has, pa.list_(pa.int32())), "w": pa.array(w, pa.list_(pa.int64()))})
        return [r for b in links._packer([batch], 37) for r in b.to_pylist()], has, w

    sources, s, w = packed(100, 0.5)
    targets, t, _ = packed(90, 0.4)
    asked = np.bincount(np.concatenate(s), minlength=50)
    block = links._Targets(targets, asked, values, often)
    place, strength = (np.concatenate(x) for x in zip(*(block.best(*links._unpacked(r)) for r in sources)))
    for k in range(100):
        total = [int(w[k][np.isin(s[k], x)].sum()) for x in t]
        assert strength[k] == max(total)
        assert max(total) == 0 or np.searchsorted(block.names, place[k]) == total.index(max(total))


def test_no_stage_pairs_the_members_of_a_frequent_value(spark, monkeypatch):
    """500 sources and 500 targets share two values; what is compared is a handful of rests."""
    sizes = []
    real = links._pairs
    monkeypatch.setattr(links, "_pairs", lambda *a: (lambda out: sizes.append(out.count()) or out)(real(*a)))
    sources = [(f"s{i:03}", k) for i in range(500) for k in ("gateway", "agent") if k == "gateway" or i % 2]
    targets = [(f"t{i:03}", k) for i in range(500) for k in ("gateway", "agent") if k == "gateway" or i % 3 == 2]
    sources += [(f"s{i:03}", f"own{i}") for i in range(20)]
    targets += [(f"t{i + 400:03}", f"own{i}") for i in range(20)]
    a, b = spark.createDataFrame(sources, "s string, k string"), spark.createDataFrame(targets, "t string, k string")
    got = {r["s"]: (r["t"], r["strength"]) for r in best_shared(a, b, "s", "t", "k").collect()}
    assert got == brute_force([(*x, 1) for x in sources], targets)
    assert sum(sizes) < 100


def hash_free(s, k):
    return 1 + (sum(map(ord, s + k)) % 3)


def test_twins_share_the_answer(spark, rows):
    a = spark.createDataFrame([(f"s{i}", "ip") for i in range(50)], "s string, k string")
    b = spark.createDataFrame([(f"t{i:02d}", "ip") for i in range(50)], "t string, k string")
    out = best_shared(a, b, "s", "t", "k")
    assert {(r["t"], r["strength"]) for r in out.collect()} == {("t00", 1)}
    assert out.count() == 50
