"""Removal of passages that occur more than once: a count-min prefilter, then exact groups.

A window is a run of consecutive words of one text. Most windows of a corpus occur once, and
moving a wide key for each of them is what such a job costs. So there are two passes:

* Each chunk of texts turns its windows into a sketch: `rows` hash rows of counters that stop
  at two. Of a sketch only the cells that are not zero travel, by ranges of cells, and the task
  of a range adds up the sketches of all chunks. A counter is never below the number of windows
  behind it, so a window that occurs twice has at least two in every row. The chunk gets one
  bit per cell back.
* Windows whose cells all say two are grouped by an 88-bit key over the corpus. A chunk sends
  each key once, with a mark if it has it several times, so a passage that a third of all texts
  share is one entry per chunk. Again the chunk gets one bit per key back.

The width of the sketch follows the size of the corpus, and a range has a fixed number of cells,
so a task's memory does not grow. A wrong width would let more windows through to the exact
pass and change no result. The texts are shuffled once, into chunks; all passes read that shuffle.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.words import from_planes, hashed, joined, mix, planes, runs_of, split_words

_U = np.uint64
WINDOW = 35
# Characters of a chunk, on average. Words, window hashes and cells of a chunk are in memory at once.
CHUNK_CHARS = 8 << 20
# Cells of a range: its counters are two bitmaps of as many bytes.
RANGE_BITS = 24
ROWS = 2
_ROW_SHIFT = 48
_SECOND_BYTES = 3
_SALTS = mix(np.arange(211, 219, dtype=np.uint64))


class Chunk:
    """Words and windows of a chunk's texts, in an order that does not depend on the shuffle."""

    def __init__(self, table: pa.Table, size: int):
        self.table = table.sort_by([("doc_id", "ascending"), ("text", "ascending")])
        self.words, self.bounds = split_words(self.table["text"], lower=False)
        self.hashes = hashed(self.words)
        self.size = size
        ends = np.repeat(self.bounds[1:], np.diff(self.bounds))
        self.starts = np.flatnonzero(np.arange(len(ends)) + size <= ends)

    def firsts(self) -> np.ndarray:
        """The first 64 bits of every window's key."""
        return runs_of(self.hashes, self.size)[self.starts]

    def keys(self, at: np.ndarray):
        """Distinct keys of the windows numbered `at` and, per window, which of them it has."""
        first = self.firsts()[at]
        second = runs_of(self.hashes, self.size, lane=1)[self.starts[at]] >> _U(64 - 8 * _SECOND_BYTES)
        order = np.lexsort((second, first))
        first, second = first[order], second[order]
        new = np.ones(len(order), dtype=bool)
        new[1:] = (first[1:] != first[:-1]) | (second[1:] != second[:-1])
        which = np.empty(len(order), dtype=np.int64)
        which[order] = np.cumsum(new) - 1
        return first[new], second[new], which


def _cells(firsts: np.ndarray, row: int, bits: int) -> np.ndarray:
    spread = firsts if row == 0 else mix(firsts ^ _SALTS[row])
    return spread >> _U(64 - bits)


def _cuts(ranges: np.ndarray) -> list[tuple[int, int, int]]:
    """(range, from, to) of sorted range numbers."""
    edges = [0, *(np.flatnonzero(ranges[1:] != ranges[:-1]) + 1).tolist(), len(ranges)]
    return [(int(ranges[a]), a, b) for a, b in zip(edges[:-1], edges[1:]) if a < b]


def _bits(flags: np.ndarray) -> bytes:
    return np.packbits(flags).tobytes()


def _flags(data: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(data, dtype=np.uint8), count=n).astype(bool)


def _table(rows: list[tuple], schema: pa.Schema) -> pa.Table:
    columns = zip(*rows) if rows else [[] for _ in schema]
    return pa.table([pa.array(c, t) for c, t in zip(columns, schema.types)], schema=schema)


_PACKED = pa.schema([("range", pa.int64()), ("chunk", pa.int64()), ("n", pa.int64()), ("keys", pa.binary()), ("twice", pa.binary())])
_PACKED_DDL = "range long, chunk long, n long, keys binary, twice binary"
_MASKS = pa.schema([("chunk", pa.int64()), ("range", pa.int64()), ("n", pa.int64()), ("mask", pa.binary())])
_MASKS_DDL = "chunk long, range long, n long, mask binary"


def _sketch(size: int, bits: int, rows: int):
    """The cells of a chunk's windows: offsets in their range, and whether the counter is two."""

    def run(key, table):
        chunk, out = key[0].as_py(), []
        firsts = Chunk(table, size).firsts()
        for row in range(rows):
            cells, counts = np.unique(_cells(firsts, row, bits), return_counts=True)
            for at, a, b in _cuts((cells >> _U(RANGE_BITS)).astype(np.int64)):
                offsets = cells[a:b] & _U((1 << RANGE_BITS) - 1)
                out.append((row << _ROW_SHIFT | at, chunk, b - a, planes(offsets, RANGE_BITS // 8), _bits(counts[a:b] > 1)))
        return _table(out, _PACKED)

    return run


def _merge_sketches(table: pa.Table) -> pa.Table:
    """Adds up one range of all sketches; per chunk, which of its cells count two or more."""
    seen = np.zeros(1 << RANGE_BITS, dtype=bool)
    twice = np.zeros(1 << RANGE_BITS, dtype=bool)
    rows = table.select(["range", "chunk", "n", "keys", "twice"]).to_pylist()
    for r in rows:
        cells = from_planes(r["keys"], RANGE_BITS // 8).astype(np.int64)
        twice[cells[seen[cells] | _flags(r["twice"], r["n"])]] = True
        seen[cells] = True
    out = []
    for r in rows:
        cells = from_planes(r["keys"], RANGE_BITS // 8).astype(np.int64)
        out.append((r["chunk"], r["range"], r["n"], _bits(twice[cells])))
    return _table(out, _MASKS)


def _mask(masks: list[dict]) -> np.ndarray:
    """The bits of all ranges, in order of the ranges."""
    parts = [_flags(m["mask"], m["n"]) for m in sorted(masks, key=lambda m: m["range"])]
    return np.concatenate(parts) if parts else np.zeros(0, dtype=bool)


def _candidates(size: int, bits: int, rows: int):
    """Keys of the windows that every row of the merged sketch has twice, by ranges of keys.

    One more row per chunk, with a negative range, keeps which windows those are.
    """

    def run(key, table, masks):
        if not table.num_rows:
            return _table([], _PACKED)
        chunk = Chunk(table, size)
        number, firsts = key[0].as_py(), chunk.firsts()
        at = np.arange(len(firsts))
        found = masks.to_pylist()
        for row in range(rows):
            mask = _mask([m for m in found if m["range"] >> _ROW_SHIFT == row])
            often = np.unique(_cells(firsts, row, bits))[mask]
            cells = _cells(firsts[at], row, bits)
            place = np.minimum(np.searchsorted(often, cells), max(0, len(often) - 1))
            at = at[often[place] == cells] if len(often) else at[:0]
        if not len(at):
            return _table([], _PACKED)
        first, second, which = chunk.keys(at)
        repeated = np.bincount(which, minlength=len(first)) > 1
        picked = np.zeros(len(firsts), dtype=bool)
        picked[at] = True
        out = [(-1 - number, number, len(firsts), _bits(picked), None)]
        shift = _U(64 - (bits - RANGE_BITS))
        ranges = (first >> shift if bits > RANGE_BITS else np.zeros_like(first)).astype(np.int64)
        for at_, a, b in _cuts(ranges):
            packed = planes(first[a:b], 8) + planes(second[a:b], _SECOND_BYTES)
            out.append((at_, number, b - a, packed, _bits(repeated[a:b])))
        return _table(out, _PACKED)

    return run


def _group_keys(table: pa.Table) -> pa.Table:
    """Exact groups of one range of keys; per chunk, which of its keys occur again anywhere."""
    rows = table.select(["range", "chunk", "n", "keys", "twice"]).to_pylist()
    if rows and rows[0]["range"] < 0:
        return _table([(r["chunk"], r["range"], r["n"], r["keys"]) for r in rows], _MASKS)
    first = np.concatenate([from_planes(r["keys"][: 8 * r["n"]], 8) for r in rows])
    second = np.concatenate([from_planes(r["keys"][8 * r["n"] :], _SECOND_BYTES) for r in rows])
    again = np.concatenate([_flags(r["twice"], r["n"]) for r in rows])
    order = np.lexsort((second, first))
    same = (first[order[1:]] == first[order[:-1]]) & (second[order[1:]] == second[order[:-1]])
    again[order[1:]] |= same
    again[order[:-1]] |= same
    out, done = [], 0
    for r in rows:
        out.append((r["chunk"], r["range"], r["n"], _bits(again[done : done + r["n"]])))
        done += r["n"]
    return _table(out, _MASKS)


_KEPT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("text", pa.string())])
_KEPT_DDL = "doc_id long, n_words long, n_removed long, text string"


def _remove(size: int):
    def run(key, table, masks):
        if not table.num_rows:
            return _table([], _KEPT)
        chunk = Chunk(table, size)
        covered = np.zeros(len(chunk.hashes) + 1, dtype=np.int64)
        found = masks.to_pylist()
        picked = [m for m in found if m["range"] < 0]
        if picked:
            at = np.flatnonzero(_flags(picked[0]["mask"], picked[0]["n"]))
            _, _, which = chunk.keys(at)
            starts = chunk.starts[at[_mask([m for m in found if m["range"] >= 0])[which]]]
            covered[starts] += 1
            np.subtract.at(covered, starts + size, 1)
        kept = np.cumsum(covered)[:-1] == 0
        before = np.concatenate(([0], np.cumsum(kept)))[chunk.bounds]
        words = np.diff(chunk.bounds)
        texts = joined(chunk.words.filter(pa.array(kept)), before)
        ids = chunk.table["doc_id"].combine_chunks()
        return pa.table([ids, pa.array(words), pa.array(words - np.diff(before)), texts], schema=_KEPT)

    return run


def remove_repeats(docs: DataFrame, size: int = WINDOW, rows: int = ROWS, chunk_chars: int = CHUNK_CHARS) -> DataFrame:
    """Texts without the words that repeated windows cover: doc_id, n_words, n_removed, text.

    A word is a run of characters other than white space, taken as it is; those kept are joined by one space. It is removed if a
    window of `size` words of its text covers it whose words also start anywhere else, in the
    same text or another. Windows are judged on the input.

    Defined cases: a null or empty text has no words and gives an empty one; a text
    shorter than a window keeps all; equal rows are texts of their own, so their windows repeat;
    a null doc_id is kept as it is; an empty table gives an empty result; other columns are ignored.
    """
    chars = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    chunks = max(1, -(-chars // chunk_chars))
    # More cells than windows: words have some six characters with the space.
    bits = max(RANGE_BITS, int(chars - 1).bit_length() if chars else 0)
    # Copies of one row in different input partitions go to different chunks.
    number = F.pmod(F.xxhash64("doc_id", "text", F.spark_partition_id()), F.lit(chunks))
    texts = docs.select(F.col("doc_id").cast("long"), "text", number.alias("chunk")).repartition("chunk")

    sketches = texts.groupBy("chunk").applyInArrow(_sketch(size, bits, rows), _PACKED_DDL)
    counted = sketches.groupBy("range").applyInArrow(_merge_sketches, _MASKS_DDL)
    candidates = (
        texts.groupBy("chunk").cogroup(counted.groupBy("chunk")).applyInArrow(_candidates(size, bits, rows), _PACKED_DDL)
    )
    grouped = candidates.groupBy("range").applyInArrow(_group_keys, _MASKS_DDL)
    return texts.groupBy("chunk").cogroup(grouped.groupBy("chunk")).applyInArrow(_remove(size), _KEPT_DDL)
