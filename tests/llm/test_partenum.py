import random
from fractions import Fraction
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest

from odd_tables import no_docs, odd_docs, odd_rows  # noqa: F401
from tidemark.llm import partenum
from tidemark.llm.words import distinct, from_planes, planes, shingle_sets


def brute(rows):
    def shingles(text):
        w = (text or "").encode().lower().split()
        if not w:
            return frozenset()
        return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4)))

    sets = [(k, shingles(t)) for k, t in rows]
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, j in combinations(range(len(sets)), 2):
        both, total = len(sets[i][1] & sets[j][1]), len(sets[i][1] | sets[j][1])
        if total and 100 * both >= 80 * total:
            root[find(i)] = find(j)
    least = {}
    for i, (k, _) in enumerate(sets):
        if k is not None:
            least[find(i)] = min(k, least.get(find(i), k))
    return sorted(((k, len(s), least.get(find(i))) for i, (k, s) in enumerate(sets)), key=repr)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_odd_rows_match_brute_force(odd_docs, odd_rows):
    got = rows_of(partenum.jaccard_components(odd_docs))
    assert got == brute([(r[0], r[1]) for r in odd_rows])


@pytest.mark.parametrize("small, block", [(32, 2048), (2, 3)])
def test_edited_copies_match_brute_force(spark, monkeypatch, small, block):
    monkeypatch.setattr(partenum, "SMALL_GROUP", small)
    monkeypatch.setattr(partenum, "GROUP_BLOCK", block)
    rng = random.Random(3)
    rows, n = [], 0
    for _ in range(12):
        text = [str(rng.randint(0, 10**6)) for _ in range(rng.choice([5, 8, 12, 20, 60, 200]))]
        for _ in range(rng.randint(1, 9)):
            rows.append((n, " ".join(text)))
            n += 1
            for _ in range(rng.randint(0, 3)):
                at = rng.randrange(len(text))
                text[at : at + rng.randint(0, 2)] = [str(rng.randint(0, 10**6))] * rng.randint(0, 1)
    # Texts of one frequent passage, most of them not similar to each other.
    passage = [str(i) for i in range(40)]
    for _ in range(40):
        rows.append((n, " ".join(passage + [str(rng.randint(0, 10**6)) for _ in range(rng.randint(5, 14))])))
        n += 1
    got = rows_of(partenum.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)))
    assert got == brute(rows)


@pytest.mark.parametrize("small, block", [(32, 2048), (2, 3)])
def test_a_first_member_of_another_size_hides_no_link(spark, monkeypatch, small, block):
    """b links its copies and the longer c; the copies are too small for c, and often come first."""
    monkeypatch.setattr(partenum, "SMALL_GROUP", small)
    monkeypatch.setattr(partenum, "GROUP_BLOCK", block)
    rng, texts = random.Random(5), []
    for _ in range(8):
        b = [str(rng.randint(0, 10**9)) for _ in range(100)]
        texts += [b, *(b[:at] + b[at + 1 :] for at in rng.sample(range(5, 95), 10))]
        texts.append(b + [str(rng.randint(0, 10**9)) for _ in range(24)])
    rows = [(n, " ".join(text)) for n, text in enumerate(texts)]
    want = brute(rows)
    assert len({least for _, _, least in want}) == 8
    assert rows_of(partenum.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))) == want


@pytest.mark.parametrize("size", [4, 5, 9, 16, 40, 133, 700])
def test_similar_sets_share_a_signature(size):
    rng = np.random.default_rng(size)
    bands = partenum.Bands(Fraction(4, 5))
    for _ in range(60):
        a = np.unique(rng.integers(0, 2**64, size, dtype=np.uint64))
        gone = rng.integers(0, max(1, size // 5) + 1)
        extra = 0
        while 100 * (len(a) - gone) < 80 * (len(a) + extra):
            gone -= 1
        while 100 * (len(a) - gone) >= 80 * (len(a) + extra + 1) and rng.random() < 0.8:
            extra += 1
        b = np.unique(np.concatenate([rng.permutation(a)[gone:], rng.integers(0, 2**64, extra, dtype=np.uint64)]))
        if gone or extra:
            often = np.sort(np.concatenate([partenum.NONE, rng.permutation(a)[: rng.integers(0, size + 1)]]))
            for known in (partenum.NONE, often):
                assert np.intersect1d(
                    partenum.signatures(a, bands, known), partenum.signatures(b, bands, known)
                ).size


def test_no_documents(no_docs):
    assert partenum.jaccard_components(no_docs).count() == 0


def test_sketches_are_a_lower_bound_and_fold():
    rng = np.random.default_rng(1)
    for size in (3, 40, 700):
        a = rng.integers(0, 2**48, size, dtype=np.uint64)
        b = np.concatenate([a[size // 3 :], rng.integers(0, 2**48, size, dtype=np.uint64)])
        x, y = partenum.sketch(a), partenum.sketch(b)
        words = min(len(x), len(y))
        apart = int(np.bitwise_count(partenum.folded(x, words) ^ partenum.folded(y, words)).sum())
        assert 0 < apart <= len(np.setxor1d(a, b))
        assert (partenum.folded(np.stack([x, x]), words) == partenum.folded(x, words)).all()


def test_planes_round_trip():
    values = np.array([0, 1, 2**40 - 1, 12345678901], dtype=np.uint64)
    assert (from_planes(planes(values, 5), 5) == values).all()


def test_words_are_split_at_the_named_characters():
    import pyarrow as pa

    sets = shingle_sets(pa.array(["A b\x0bC\x0cd\re", "a b c d e", "a b c d e", None, " "]), 5)
    assert (sets[0] == sets[1]).all() and len(sets[2]) == 1 and sets[2][0] != sets[1][0]
    assert not len(sets[3]) and not len(sets[4])


def test_distinct_is_one_sort(monkeypatch):
    """Sets of shingles are sorted and distinct without np.unique, which hashes all values first."""
    values = np.array([5, 2**64 - 1, 0, 5, 0, 7], dtype=np.uint64)
    monkeypatch.setattr(np, "unique", None)
    assert distinct(values).tolist() == [0, 5, 7, 2**64 - 1]
    assert distinct(values[:0]).tolist() == [] and distinct(values[:1]).tolist() == [5]
    same, _ = shingle_sets(pa.array(["a b a b a b a", ""]), 2)
    assert len(same) == 2 and same[0] < same[1]
