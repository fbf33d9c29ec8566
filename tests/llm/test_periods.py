import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest

from odd_tables import no_docs, odd_docs, odd_rows, words  # noqa: F401
from tidemark.llm import periods
from tidemark.llm.words import hashed


def smallest_period(w):
    """By the border table."""
    border, k = [0] * len(w), 0
    for i in range(1, len(w)):
        while k and w[i] != w[k]:
            k = border[k - 1]
        k += w[i] == w[k]
        border[i] = k
    return len(w) - border[-1]


def brute(w):
    """Runs as (start, length, period), from every period tried over the whole text."""
    found = set()
    for q in range(1, len(w) // 3 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            length = j + q - i
            if length >= max(24, 3 * q) and smallest_period(w[i : j + q]) == q:
                found.add((i, length, q))
            i = j + 1
    return sorted(found, key=lambda r: (r[0], r[2]))


def runs(texts):
    bounds = np.concatenate(([0], np.cumsum([len(t) for t in texts]))).astype(np.int64)
    flat = pa.array([x for t in texts for x in t], pa.string())
    got = [[] for _ in texts]
    for t, *run in periods.find_runs(hashed(flat), bounds).tolist():
        got[t].append(tuple(run))
    return got


def periodic_texts(rng):
    """Loops inside loops: words of a period that themselves repeat, with changes here and there."""
    for _ in range(60):
        text = []
        for _ in range(rng.randint(1, 4)):
            unit = [rng.choice("abc") for _ in range(rng.randint(1, 40))]
            if rng.random() < 0.5:
                inner = [rng.choice("ab") for _ in range(rng.randint(1, 4))]
                unit = inner * rng.randint(3, 12) + unit[: rng.randint(0, 3)]
            text += (unit * rng.randint(1, 8))[: rng.randint(1, 300)]
        for _ in range(rng.randint(0, 2)):
            text[rng.randrange(len(text))] = "z"
        yield text


@pytest.mark.parametrize("seed", range(8))
def test_runs_against_every_period(seed):
    texts = list(periodic_texts(random.Random(seed)))
    texts += [["a"] * n for n in (0, 1, 23, 24, 25, 400)] + [list("ab") * n for n in (11, 12, 200)]
    assert runs(texts) == [brute(t) for t in texts]


def test_fibonacci_and_thue_morse_words():
    a, b = "a", "ab"
    while len(b) < 1500:
        a, b = b, b + a
    morse = [str(bin(i).count("1") % 2) for i in range(1024)]
    texts = [list(b), morse, list(b[:700]) * 3, morse[:100] * 4]
    assert runs(texts) == [brute(t) for t in texts]


def test_groups_of_texts(monkeypatch):
    texts = list(periodic_texts(random.Random(99)))
    want = runs(texts)
    monkeypatch.setattr(periods, "GROUP_WORDS", 500)
    assert runs(texts) == want


def altered(doc_id, w):
    h, n = zlib.crc32(str(doc_id).encode()), len(w)
    g = h // 10
    if doc_id is None or h % 10 or not n:
        return w
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]


def judged(doc_id, text):
    w = altered(doc_id, re.findall(r"[^\x20\x09-\x0D]+", text or ""))
    found = brute(w)
    gone = {i for s, length, q in found for i in range(s + q, s + length)}
    best = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if found else (None, None, None)
    lines = "".join(f"{s},{length},{q}\n" for s, length, q in found)
    kept = " ".join(x for i, x in enumerate(w) if i not in gone)
    milli = 1000 * best[1] // best[2] if found else None
    return (doc_id, len(found), *best, milli, *(hashlib.sha256(x.encode()).hexdigest() for x in (lines, kept)))


def test_summary(spark, odd_docs, odd_rows):
    rng = random.Random(11)
    more = [(1000 + i, " ".join(t)) for i, t in enumerate(periodic_texts(rng))]
    more += [(2000 + i, words(rng, rng.randint(1, 300), "abcdefghij")) for i in range(200)]
    df = odd_docs.select("doc_id", "text").unionByName(spark.createDataFrame(more, "doc_id long, text string"))
    got = periods.summary(periods.collapse(df.withColumn("runs", df.doc_id), loops=True))
    # The longest text is compared in test_long_text, as trying every period takes long.
    short = [(r[0], r[1]) for r in odd_rows if r[0] != 10] + more
    assert sum(zlib.crc32(str(k).encode()) % 10 == 0 for k, _ in short) > 10
    got = sorted(repr(tuple(r)) for r in got.filter("doc_id is null or doc_id <> 10").collect())
    assert got == sorted(repr(judged(*r)) for r in short)


def test_long_text():
    rng = random.Random(1)
    loop = [rng.choice("abcdef") + str(rng.randint(0, 99)) for _ in range(30_000)]
    text = loop * 4 + ["end"] + ["x"] * 50_000 + loop[:100] * 3
    assert runs([text]) == [[(0, 120_000, 30_000), (120_001, 50_000, 1), (170_001, 300, 100)]]


def test_no_documents(no_docs):
    assert periods.summary(periods.collapse(no_docs)).count() == 0
