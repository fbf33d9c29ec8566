import random
import re
from collections import Counter

import pytest

from odd_tables import no_docs, odd_docs, odd_rows, words  # noqa: F401
from tidemark.llm import repeats


def brute(texts, size):
    split = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    seen = Counter(tuple(w[i : i + size]) for w in split for i in range(len(w) - size + 1))
    out = []
    for w in split:
        gone = set()
        for i in range(len(w) - size + 1):
            if seen[tuple(w[i : i + size])] > 1:
                gone.update(range(i, i + size))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((len(w), len(gone), kept))
    return out


def result(df):
    return sorted(repr((r["doc_id"], r["n_words"], r["n_removed"], r["text"])) for r in df.collect())


def expected(rows, size):
    return sorted(repr((r[0], *found)) for r, found in zip(rows, brute([r[1] for r in rows], size)))


def test_odd_rows(odd_docs, odd_rows):
    for chunk_chars in (1 << 30, 3000):
        assert result(repeats.remove_repeats(odd_docs, chunk_chars=chunk_chars)) == expected(odd_rows, 35)


@pytest.mark.parametrize("size", [1, 3, 8])
def test_passages_and_periods(spark, size):
    rng = random.Random(3)
    passage = words(rng, 40)
    rows = [(i, f"{words(rng, rng.randint(0, 30), 'ab')} {passage} {words(rng, 20, 'abc')}") for i in range(30)]
    rows += [(100 + i, "a b " * rng.randint(1, 30)) for i in range(10)] + [(200 + i, words(rng, 60)) for i in range(20)]
    rows += [(300, passage)] * 5
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    for chunk_chars in (1 << 30, 2000):
        assert result(repeats.remove_repeats(df, size, chunk_chars=chunk_chars)) == expected(rows, size)


def test_a_full_sketch_loses_nothing(spark, monkeypatch):
    """With far fewer cells than windows every window passes the first pass; the result is the same."""
    monkeypatch.setattr(repeats, "_cells", lambda firsts, row, bits: firsts >> repeats._U(62))
    rng = random.Random(5)
    rows = [(i, words(rng, 50, "ab")) for i in range(20)] + [(50, "x " * 40)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert result(repeats.remove_repeats(df, 4)) == expected(rows, 4)


def test_texts_are_shuffled_once(spark):
    out = repeats.remove_repeats(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))
    out.collect()
    final = out._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert final.count("ReusedExchange") == 2 and final.count("FileScan") == 1


def test_no_documents(no_docs):
    assert repeats.remove_repeats(no_docs).count() == 0
