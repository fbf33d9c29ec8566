import zlib
from collections import defaultdict

import numpy as np
from tokenizers import Tokenizer

from odd_tables import no_docs, odd_docs, odd_rows  # noqa: F401
from tidemark.llm import packing
from tidemark.llm.queries import tokenizer_path


def check(rows, texts, size):
    tokenizer = Tokenizer.from_file(tokenizer_path())
    want = sorted(
        (np.array(tokenizer.encode(t or "", add_special_tokens=False).ids + [1], dtype="<u4").tobytes(), k)
        for k, t in texts
    )
    sequences = defaultdict(list)
    for r in rows:
        assert zlib.crc32(r["ids"]) == r["ids_crc32"] and len(r["ids"]) == 4 * r["length"]
        sequences[r["sequence_id"]].append(r)
    for pieces in sequences.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= size
    # Copies of a document are told apart by nothing, so pieces are matched as a multiset.
    pool = defaultdict(list)
    for r in rows:
        pool[r["doc_id"]].append(r)
    for data, key in want:
        at = 0
        while at < len(data) // 4:
            r = next(
                r for r in pool[key]
                if r["start"] == at and r["doc_tokens"] == len(data) // 4
                and r["ids"] == data[4 * at : 4 * (at + r["length"])]
            )
            pool[key].remove(r)
            at += r["length"]
    assert not any(pool.values())
    return sequences


def test_every_id_is_in_one_piece(odd_docs, odd_rows):
    rows = packing.pack(odd_docs.repartition(5), tokenizer_path(), size=128, open_windows=4, with_ids=True).collect()
    sequences = check(rows, [(r[0], r[1]) for r in odd_rows], 128)
    tokens = sum(r["length"] for r in rows)
    assert 128 * len(sequences) < 1.1 * tokens + 5 * 128


def test_ids_are_left_out_and_many_tasks_are_merged(odd_docs):
    docs = odd_docs.repartition(40)
    df = packing.pack(docs, tokenizer_path(), size=256, open_windows=2)
    assert "ids" not in df.columns
    fill = [r["n"] for r in df.groupBy("sequence_id").agg({"length": "sum"}).toDF("s", "n").collect()]
    assert max(fill) <= 256 and sum(fill) / len(fill) > 200


def test_no_documents(no_docs):
    assert packing.pack(no_docs, tokenizer_path()).count() == 0


def test_best_fit_places_and_fullest_leaves():
    windows = packing.Windows(10, 2, 3)
    piece = lambda n: ("k", 0, np.zeros(n, dtype="<u4"), n)
    assert list(windows.add(piece(6))) == [] and list(windows.add(piece(5))) == []
    assert list(windows.add(piece(4)))[0][0][2].size == 6  # fills the window with 4 left
    assert list(windows.add(piece(9))) == []
    (out,) = windows.add(piece(8))  # fits nowhere: the window with 1 left goes, unfilled
    assert [p[2].size for p in out] == [9]
    assert sorted(free for free, _ in windows.open) == [2, 5]
    assert list(windows.add(piece(10)))[0][0][2].size == 10


def test_long_white_space():
    """The runs at which the fast encoder stops, against the tokenizer file's own library."""
    tokenizer = Tokenizer.from_file(tokenizer_path())
    mixed = (" \n\t \r   " * 130_000)[:1_000_003]
    for text in (
        "a" + " " * 1_000_001 + "b", "a" + " " * 3_000_000 + "b", "\n" * 1_000_001 + "b", "x\t" + mixed + "y z",
        " " * 199_999 + "a", "a" + " " * 200_000,
    ):
        assert packing.token_ids(tokenizer_path(), text).tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def test_a_document_of_white_space(spark):
    rows = [(1, "a" + " " * 1_000_001 + "b"), (2, "a b c")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    check(packing.pack(df, tokenizer_path(), with_ids=True).collect(), rows, packing.WINDOW)
