import hashlib
import re

import pytest
import xxhash

from odd_tables import no_docs, odd_docs, odd_rows  # noqa: F401
from tidemark.llm import fingerprints


def brute(rows):
    ordered = sorted(((r[0], r[1] or "") for r in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    out = []
    for i, (k, text) in enumerate(ordered):
        follower = ordered[(i + 1) % len(ordered)][1]
        cut = len(text) // 4
        edited = text[: len(text) - cut] + follower[:cut]
        out.append((k, len(text), hashlib.sha256(edited.encode()).hexdigest(), text, edited, follower))
    return out


def shingles(text):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", text.lower()) if x]
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def similarity(a, b):
    a, b = shingles(a), shingles(b)
    return len(a & b) / len(a | b)


def test_edits_and_likeness(odd_docs, odd_rows, monkeypatch):
    real = fingerprints.ordered_slices
    monkeypatch.setattr(fingerprints, "ordered_slices", lambda docs, key: real(docs, key, rows=6))
    got = fingerprints.compare_with_edits(odd_docs).collect()
    want = brute(odd_rows)
    assert sorted((repr(r["doc_id"]), r["n_chars"], r["edited_sha256"]) for r in got) == sorted(
        (repr(w[0]), w[1], w[2]) for w in want
    )
    by_hash = {(r["doc_id"], r["edited_sha256"]): r for r in got}
    for k, _, sha, text, edited, follower in want:
        r = by_hash[(k, sha)]
        assert abs(r["near_edited"] - similarity(text, edited)) < 0.25
        assert abs(r["near_next"] - similarity(text, follower)) < 0.25
        assert len(r["fingerprint"]) == 2 * fingerprints.BINS


def test_equal_texts_have_equal_fingerprints(odd_docs):
    rows = fingerprints.with_fingerprint(odd_docs.select("doc_id", "text"), "text", "f").collect()
    found = {}
    for r in rows:
        assert found.setdefault((r["text"] or "").lower(), r["f"]) == r["f"]


def test_one_document_and_none(spark, no_docs):
    (row,) = fingerprints.compare_with_edits(spark.createDataFrame([(1, "a b c d e f g h")], "doc_id long, text string")).collect()
    assert row["near_next"] == 1.0 and row["n_chars"] == 15
    assert fingerprints.compare_with_edits(no_docs).count() == 0


def plain_fingerprint(text, bins, bits):
    """Bins, probes and low bits in loops over numbers."""
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", text.lower().strip(fingerprints.SPACE))] or [""]
    least = {}
    for i in range(max(1, len(w) - 4)):
        h = 42
        for word in w[i : i + 5]:
            h = xxhash.xxh64_intdigest(word.encode(), h)
        h = h >> 1 | 1
        b = h >> (63 - (bins - 1).bit_length())
        least[b] = min(h, least.get(b, h))
    starts, steps = fingerprints.probe_order(bins)
    out = []
    for b in range(bins):
        at, attempt = b, 0
        while at not in least:
            at, attempt = (starts[b] + steps[b] * attempt) % bins, attempt + 1
        out.append(least[at] >> 1 & ((1 << bits) - 1))
    return out


@pytest.mark.parametrize("bins, bits", [(128, 8), (16, 4), (64, 31)])
def test_bins_against_loops(odd_docs, bins, bits):
    docs = odd_docs.select("doc_id", "text")
    for r in fingerprints.with_fingerprint(docs, "text", "f", bins, bits).collect():
        assert r["f"] == plain_fingerprint(r["text"] or "", bins, bits)


def test_probes_meet_every_bin():
    starts, steps = fingerprints.probe_order(128)
    assert all(len({(a + s * i) % 128 for i in range(128)}) == 128 for a, s in zip(starts, steps))


def test_slices_follow_the_order_of_the_key(spark):
    keys = [None] * 3 + [5] * 40 + list(range(-20, 200, 3)) + [1 << 60]
    df = spark.createDataFrame([(k,) for k in keys], "k long").repartition(3)
    got = df.withColumn("s", fingerprints.ordered_slices(df, "k", rows=10)).collect()
    pairs = sorted(((r["k"] is not None, r["k"] or 0), r["s"]) for r in got)
    assert [s for _, s in pairs] == sorted(s for _, s in pairs)
    assert len({s for _, s in pairs}) > 5 and pairs[0][1] == 0
    assert all(len({s for k, s in pairs if k == key}) == 1 for key, _ in pairs)
