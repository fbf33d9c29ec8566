"""Packing token sequences: bounded-space online best fit.

A task reads its texts once and keeps a fixed number of open windows. A piece goes into the
window it fills best. If it fits into none, the fullest one is emitted, after the head of the
piece has filled it up where a gap worth filling is left, and a fresh window is opened.
Windows still open at the end of a task go to the next round, in which each task merges those
of several tasks in the same way, until one task has the last ones.
"""

from __future__ import annotations

import bisect
import json
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidemark.session import stored

WINDOW = 2048
OPEN_WINDOWS = 32
# A gap of fewer tokens is padded rather than filled with the head of another text.
SMALLEST_CUT = 16
END_ID = 1
# Tasks whose leftovers one task of the next round merges.
FAN_IN = 16

PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def _byte_of_letter() -> dict[str, int]:
    """The letters by which a byte-level vocabulary writes bytes.

    Visible bytes stand for themselves, the others follow from U+0100 on in order.
    """
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in visible]
    return {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(hidden)}


@lru_cache(maxsize=2)
def encoder(path: str) -> tiktoken.Encoding:
    """The byte-level BPE of a tokenizer file, as an encoding that does its merges by rank.

    In such a file the ids of merged tokens follow the order of the merges, so the id is the
    rank. Special tokens of the file are recognised in texts, as its own library does.
    """
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    special = {t["content"]: t["id"] for t in spec["added_tokens"] if t["special"]}
    letters = _byte_of_letter()
    ranks = {bytes(letters[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in special}
    # The split of byte-level tokenizers that add no space before a text.
    pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    return tiktoken.Encoding("file", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special)


# The split pattern backtracks over white space and gives up beyond a million characters of it.
_LONG_SPACE = re.compile(r"\s{200000}")


@lru_cache(maxsize=2)
def _slow_encoder(path: str) -> Tokenizer:
    return Tokenizer.from_file(path)


def token_ids(path: str, text: str) -> np.ndarray:
    """Ids of a text, as the tokenizer file's own library gives them."""
    if len(text) >= 200_000 and _LONG_SPACE.search(text):
        ids = _slow_encoder(path).encode(text, add_special_tokens=False).ids
    else:
        ids = encoder(path).encode(text, allowed_special="all")
    return np.array(ids, dtype="<u4")


class Windows:
    """Open windows of one task. Pieces are tuples (key, start, ids, total)."""

    def __init__(self, size: int, keep: int, smallest_cut: int):
        self.size, self.keep, self.smallest_cut = size, keep, smallest_cut
        self.open: list[tuple[int, int]] = []  # (free tokens, number), sorted
        self.content: dict[int, list] = {}
        self.made = 0

    def add(self, piece) -> Iterator[list]:
        """Place a piece of at most `size` ids; yields the windows that are emitted for it."""
        key, start, ids, total = piece
        if len(ids) == self.size:
            yield [piece]
            return
        at = bisect.bisect_left(self.open, (len(ids), -1))
        if at == len(self.open):
            if len(self.open) >= self.keep:
                free, number = self.open.pop(0)
                if free >= self.smallest_cut and len(ids) - free >= self.smallest_cut:
                    self.content[number].append((key, start, ids[:free], total))
                    start, ids = start + free, ids[free:]
                yield self.content.pop(number)
                yield from self.add((key, start, ids, total))
                return
            self.made += 1
            bisect.insort(self.open, (self.size, self.made))
            self.content[self.made] = []
            at = bisect.bisect_left(self.open, (len(ids), -1))
        free, number = self.open.pop(at)
        self.content[number].append((key, start, ids, total))
        if free == len(ids):
            yield self.content.pop(number)
        else:
            bisect.insort(self.open, (free - len(ids), number))

    def rest(self) -> list[list]:
        return [self.content[number] for _, number in self.open]


def _pieces(key, ids: np.ndarray, size: int):
    """Whole windows first, then what is left."""
    for start in range(0, len(ids), size):
        yield key, start, ids[start : start + size], len(ids)


def pieces_of_texts(batches, encode, size: int):
    for batch in batches:
        for key, text in zip(batch["doc_id"].to_pylist(), batch["text"]):
            ids = np.append(encode(text.as_py() or ""), END_ID).astype("<u4")
            yield from _pieces(key, ids, size)


def _rows(window: list, sequence: int, with_ids: bool):
    offset = 0
    for key, start, ids, total in window:
        data = ids.tobytes()
        yield key, start, len(ids), zlib.crc32(data), total, sequence, offset, data if with_ids else None
        offset += len(ids)


_SCHEMA = pa.schema(
    [(n, pa.int64()) for n in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")]
    + [("ids", pa.binary()), ("rest", pa.bool_())]
)
_DDL = PIECE + ", ids binary, rest boolean"


def _packed(pieces, task: int, round_: int, last: bool, with_ids: bool, size: int, keep: int, cut: int):
    """Record batches of one task: pieces of emitted windows, and of leftovers with their ids."""
    windows = Windows(size, keep, cut)
    held, n = [], 0
    base = (round_ << 56) | (task << 32)

    def take(window, rest):
        nonlocal n
        n += 1
        held.extend((*row, rest) for row in _rows(window, base | n, with_ids or rest))

    for piece in pieces:
        for window in windows.add(piece):
            take(window, False)
        if len(held) > 20_000:
            yield _batch(held)
            held = []
    for window in windows.rest():
        take(window, not last)
    if held:
        yield _batch(held)


def _batch(rows):
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _SCHEMA.types)], schema=_SCHEMA)


def pack(
    docs: DataFrame,
    tokenizer: str,
    size: int = WINDOW,
    open_windows: int = OPEN_WINDOWS,
    smallest_cut: int = SMALLEST_CUT,
    with_ids: bool = False,
) -> DataFrame:
    """Pieces of all texts in sequences of at most `size` tokens; with their ids on demand.

    doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids, little-endian
    unsigned 32-bit). Every text ends with id 1, and each of its ids is in exactly one piece.
    `tokenizer` is a path that every executor can read.

    Defined cases: a null or empty text is its end id alone; equal rows are packed each; a
    null doc_id stays null; an empty table gives an empty result; other columns are ignored.
    """
    from pyspark import TaskContext

    def texts(batches):
        yield from _packed(
            pieces_of_texts(batches, partial(token_ids, tokenizer), size), TaskContext.get().partitionId(), 0, False,
            with_ids, size, open_windows, smallest_cut,
        )

    source = docs.select(F.col("doc_id").cast("long"), "text")
    packed = stored(source.mapInArrow(texts, _DDL), "packed")
    done = packed.filter(~F.col("rest"))
    tasks = source.rdd.getNumPartitions()
    round_ = 0
    while True:
        round_ += 1
        last = tasks <= FAN_IN
        rest = packed.filter("rest").withColumn("_task", F.shiftright("sequence_id", 32).bitwiseAND(F.lit((1 << 24) - 1)))
        merged = stored(
            rest.withColumn("_task", F.floor(F.col("_task") / FAN_IN))
            .groupBy("_task")
            .applyInArrow(_merge(round_, last, with_ids, size, open_windows, smallest_cut), _DDL),
            "packed",
        )
        done = done.unionByName(merged.filter(~F.col("rest")))
        if last:
            return done.drop("rest") if with_ids else done.drop("rest", "ids")
        packed, tasks = merged, -(-tasks // FAN_IN)


def _merge(round_, last, with_ids, size, keep, cut):
    """Pack what the leftover windows of several tasks hold, at most FAN_IN * open windows, largest first."""

    def run(key, table):
        table = table.sort_by([("sequence_id", "ascending"), ("offset", "ascending")])
        windows: dict[int, list] = {}
        for doc, start, total, sequence, ids in zip(
            *(table[c].to_pylist() for c in ("doc_id", "start", "doc_tokens", "sequence_id", "ids"))
        ):
            windows.setdefault(sequence, []).append((doc, start, np.frombuffer(ids, dtype="<u4"), total))
        pieces = sorted((p for w in windows.values() for p in w), key=lambda p: -len(p[2]))
        batches = list(_packed(pieces, key[0].as_py(), round_, last, with_ids, size, keep, cut))
        return pa.Table.from_batches(batches, _SCHEMA)

    return run
