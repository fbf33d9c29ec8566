"""Runs of periodic text by internal pattern matching.

A run is a stretch of words that repeats with a period q at least three times and that no
neighbouring word extends. Runs of any period are found without trying all periods:

* Take the grid of blocks of m = 2^k words. A run with m <= q < 2m holds a whole block within
  its first 2q words, and that block occurs again q words on. (Runs have 24 words at least, so
  blocks of 8 words serve all periods below 8 too.)
* The suffix array of the text puts all occurrences of a block side by side. Those in a window
  of m places are asked for with range successors on a wavelet matrix over the suffix array:
  the first, the second and the last. Three or more of them are an arithmetic progression,
  whose difference is the block's own period.
* The first, second and last occurrence give candidate periods. Of a longer progression only the
  shift can be a period of a larger run that takes the stretch of the block's own period around
  the block to the one around the occurrence, so their ends give two more.
* Two longest common extensions tell how far a candidate period holds. They use the ranks that
  the suffix array was built from, which name every run of 2^k words.

Everything is array operations over many texts at once; a text without two equal runs of eight
words has no periodic run and needs no suffix array.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.words import hashed, joined, mix, runs_of, split_words

_U = np.uint64
LEAST_WORDS = 24
LEAST_REPEATS = 3
# The smallest blocks have 2^3 words. Least length and repeats are such that one lies in each run.
_BASE = 3
# Words whose suffix arrays are built together; a longer text is built alone.
GROUP_WORDS = 1 << 19


class Suffixes:
    """Suffix array of several texts, ranks of all runs of 2^k words, and a wavelet matrix.

    Texts never compare equal. The order of suffixes is that of the hashes of their first eight
    words, then of the next eight, and so on: any order will do that keeps equal runs together.
    """

    def __init__(self, words: np.ndarray, bounds: np.ndarray):
        n, lengths = len(words), np.diff(bounds)
        self.n = n
        self.start, self.end = np.repeat(bounds[:-1], lengths), np.repeat(bounds[1:], lengths)
        self.words = np.append(words, _U(0))
        place = np.arange(n)
        whole = place + (1 << _BASE) <= self.end
        # A run that the end of its text cuts off equals no other.
        keys = mix(place.astype(np.uint64) ^ _U(0x6A09E667F3BCC908))
        runs = runs_of(words, 1 << _BASE)
        text = mix(self.start.astype(np.uint64) ^ _U(0xBB67AE8584CAA73B))
        keys[: len(runs)] = np.where(whole[: len(runs)], mix(runs ^ text[: len(runs)]), keys[: len(runs)])
        self.array = np.argsort(keys, kind="stable")
        self.ranks = [self._rank(place, self.array, keys[self.array], np.full(n + 1, -1, dtype=np.int64))]
        while self._double():
            pass
        self._wavelet()

    @staticmethod
    def _rank(places: np.ndarray, order: np.ndarray, keys: np.ndarray, ranks: np.ndarray) -> np.ndarray:
        """Ranks, which are the place of the first suffix with the same key."""
        first = np.ones(len(keys), dtype=bool)
        first[1:] = keys[1:] != keys[:-1]
        ranks[order] = places[np.maximum.accumulate(np.where(first, np.arange(len(keys)), 0))]
        return ranks

    def _double(self) -> bool:
        """Ranks of twice the length; only suffixes that are still tied are sorted again."""
        ranks, length = self.ranks[-1], 1 << (_BASE + len(self.ranks) - 1)
        sorted_ranks = ranks[self.array]
        tied = np.zeros(self.n, dtype=bool)
        same = sorted_ranks[1:] == sorted_ranks[:-1]
        tied[1:] = same
        tied[:-1] |= same
        places = np.flatnonzero(tied)
        if not len(places):
            return False
        suffixes = self.array[places]
        later = suffixes + length
        inside = later < self.end[suffixes]
        second = np.where(inside, ranks[np.minimum(later, self.n)], -1)
        keys = sorted_ranks[places] * (self.n + 1) + second + 1
        order = np.argsort(keys, kind="stable")
        self.array[places] = suffixes[order]
        self.ranks.append(self._rank(places, suffixes[order], keys[order], ranks.copy()))
        return True

    def _wavelet(self) -> None:
        """Per bit of the values, from the highest: zeros before each place, and all zeros."""
        values, self.levels = self.array, []
        for bit in reversed(range(max(1, self.n.bit_length()))):
            zero = (values >> bit & 1) == 0
            before = np.concatenate(([0], np.cumsum(zero)))
            self.levels.append((bit, before, int(before[-1])))
            values = np.concatenate([values[zero], values[~zero]])

    def below(self, lo: np.ndarray, hi: np.ndarray, value: np.ndarray) -> np.ndarray:
        """How many of array[lo:hi] are less than `value`."""
        count = np.zeros(len(lo), dtype=np.int64)
        for bit, before, zeros in self.levels:
            one = (value >> bit & 1) == 1
            a, b = before[lo], before[hi]
            count += np.where(one, b - a, 0)
            lo, hi = np.where(one, lo - a + zeros, a), np.where(one, hi - b + zeros, b)
        return count

    def nth(self, lo: np.ndarray, hi: np.ndarray, n: np.ndarray) -> np.ndarray:
        """The n-th smallest of array[lo:hi], from 0."""
        value = np.zeros(len(lo), dtype=np.int64)
        for bit, before, zeros in self.levels:
            a, b = before[lo], before[hi]
            one = n >= b - a
            n = np.where(one, n - (b - a), n)
            value |= one.astype(np.int64) << bit
            lo, hi = np.where(one, lo - a + zeros, a), np.where(one, hi - b + zeros, b)
        return value

    def forward(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many words agree from places a < b on."""
        start = b
        for k in reversed(range(len(self.ranks))):
            step = np.where(self.ranks[k][a] == self.ranks[k][b], 1 << (_BASE + k), 0)
            a, b = a + step, b + step
        end = self.end[start]
        for _ in range((1 << _BASE) - 1):
            step = ((b < end) & (self.words[a] == self.words[b])).astype(np.int64)
            a, b = a + step, b + step
        return b - start

    def backward(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many words agree before places a < b."""
        first, begin = a, self.start[a]
        for k in reversed(range(len(self.ranks))):
            size = 1 << (_BASE + k)
            inside = a - size >= begin
            there, here = np.where(inside, a - size, 0), np.where(inside, b - size, 0)
            step = np.where(inside & (self.ranks[k][there] == self.ranks[k][here]), size, 0)
            a, b = a - step, b - step
        for _ in range((1 << _BASE) - 1):
            step = ((a > begin) & (self.words[a - 1] == self.words[b - 1])).astype(np.int64)
            a, b = a - step, b - step
        return first - a

    def occurrences(self, lo, hi, begin, stop):
        """First, second and last of array[lo:hi] in begin <= place < stop, and how many there are."""
        before, upto = self.below(lo, hi, begin), self.below(lo, hi, stop)
        last = hi - lo - 1
        first = self.nth(lo, hi, np.minimum(before, last))
        second = self.nth(lo, hi, np.minimum(before + 1, last))
        final = self.nth(lo, hi, np.clip(upto - 1, 0, last))
        return first, second, final, upto - before


def _candidates(s: Suffixes) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, periods) that may belong to runs; see the module."""
    longest = int((s.end - s.start).max(initial=0))
    for k, ranks in enumerate(s.ranks):
        m = 1 << (_BASE + k)
        if k and LEAST_REPEATS * m > longest:
            return
        by_rank = ranks[s.array]
        x = np.arange(0, s.n, m)
        x = x[x + m <= s.end[x]]
        lo = ranks[x]
        hi = np.searchsorted(by_rank, lo, side="right")
        x, lo, hi = (v[hi - lo > 1] for v in (x, lo, hi))
        for begin, stop in ([(1, m), (m, 2 * m)] if k == 0 else [(m, 2 * m)]):
            first, second, last, count = s.occurrences(lo, hi, x + begin, np.minimum(x + stop, s.n))
            for least, y in ((1, first), (2, second), (2, last)):
                at = count >= least
                yield x[at], y[at] - x[at]
            at = count > 2
            here, there, d = x[at], first[at], second[at] - first[at]
            left = (there - s.backward(there, there + d)) - (here - s.backward(here, here + d))
            right = (there + s.forward(there, there + d)) - (here + s.forward(here, here + d))
            for q in (left, right):
                fits = (q >= begin) & (q < stop)
                yield here[fits], q[fits]


def runs_of_texts(words: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """All runs, sorted: rows of text, start in the text, length, period."""
    s = Suffixes(words, bounds)
    found = []
    for x, q in _candidates(s):
        inside = x + q < s.end[x]
        x, q = x[inside], q[inside]
        start = x - s.backward(x, x + q)
        stop = x + q + s.forward(x, x + q)
        enough = stop - start >= np.maximum(LEAST_WORDS, LEAST_REPEATS * q)
        found.append(np.stack([start[enough], stop[enough], q[enough]], axis=1))
    runs = np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 3), dtype=np.int64)
    # Multiples of a period hold on the same stretch; the least of them is the run's.
    least = np.ones(len(runs), dtype=bool)
    least[1:] = (runs[1:, :2] != runs[:-1, :2]).any(axis=1)
    runs = runs[least]
    text = np.searchsorted(bounds, runs[:, 0], side="right") - 1
    out = np.stack([text, runs[:, 0] - bounds[text], runs[:, 1] - runs[:, 0], runs[:, 2]], axis=1)
    return out[np.lexsort((out[:, 3], out[:, 1], out[:, 0]))]


def _with_equal_runs(words: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Numbers of the texts in which some run of eight words occurs twice."""
    size = 1 << _BASE
    lengths = np.diff(bounds)
    text = np.repeat(np.arange(len(lengths)), lengths)[: max(0, len(words) - size + 1)]
    at = np.flatnonzero(np.arange(len(text)) + size <= bounds[1:][text])
    keys = mix(runs_of(words, size)[at] ^ mix(text[at].astype(np.uint64)))
    order = np.argsort(keys)
    same = keys[order[1:]] == keys[order[:-1]]
    return np.unique(text[at][order[1:][same]])


def _groups(texts: np.ndarray, lengths: np.ndarray) -> Iterator[np.ndarray]:
    held, size = [], 0
    for t in texts.tolist():
        if held and size + lengths[t] > GROUP_WORDS:
            yield np.array(held)
            held, size = [], 0
        held.append(t)
        size += int(lengths[t])
    if held:
        yield np.array(held)


def find_runs(words: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """All runs of a batch of texts, given as hashes of words: text, start, length, period."""
    lengths, out = np.diff(bounds), [np.zeros((0, 4), dtype=np.int64)]
    for group in _groups(_with_equal_runs(words, bounds), lengths):
        picked = np.concatenate([words[bounds[t] : bounds[t + 1]] for t in group])
        runs = runs_of_texts(picked, np.concatenate(([0], np.cumsum(lengths[group]))))
        runs[:, 0] = group[runs[:, 0]]
        out.append(runs)
    return np.concatenate(out)


def looped(doc_ids: list, bounds: np.ndarray) -> np.ndarray:
    """Which word stands at every place once one text in ten has its tail replaced by a loop.

    With h the CRC-32 of the decimal id and g = h // 10, a text of n words with h % 10 = 0 gets
    the loop of p = 1 + (n - a) // (3 + g % 8) words that begins at word a = g % n.
    """
    at = np.arange(bounds[-1])
    for doc_id, begin, end in zip(doc_ids, bounds[:-1].tolist(), bounds[1:].tolist()):
        h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
        n = end - begin
        if h % 10 or not n:
            continue
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        at[begin + a : end] = begin + a + np.arange(n - a) % p
    return at


_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
_FOUND = pa.schema([("doc_id", pa.int64()), ("runs", pa.list_(_RUN)), ("text", pa.string())])
_FOUND_DDL = "doc_id long, runs array<struct<start:long,length:long,period:long>>, text string"


def collapse(docs: DataFrame, loops: bool = False) -> DataFrame:
    """Runs of every text and the text without their repeats: doc_id, runs, text.

    Words are runs of characters other than white space; they are numbered from 0. A run has
    at least 24 words and three periods, its period is the smallest, and it cannot be extended.
    Runs are sorted by start, then period. A word goes if any run contains it after that run's
    first period; the words kept are joined by one space. With `loops`, some texts are changed
    first as `looped` says, so that the detection can be tried on known loops.

    Defined cases: a null or empty text has no runs and gives an empty text; a null doc_id is
    kept, and its text never looped; equal rows give equal results; an empty table gives an
    empty result; other columns are ignored. Words and runs of eight are compared by 64-bit hashes.
    """

    def run(batches):
        for batch in batches:
            words, bounds = split_words(batch["text"], lower=False)
            if loops:
                words = words.take(pa.array(looped(batch["doc_id"].to_pylist(), bounds)))
            runs = find_runs(hashed(words), bounds)
            begin = bounds[runs[:, 0]] + runs[:, 1]
            covered = np.zeros(len(words) + 1, dtype=np.int64)
            np.add.at(covered, begin + runs[:, 3], 1)
            np.subtract.at(covered, begin + runs[:, 2], 1)
            kept = np.cumsum(covered)[:-1] == 0
            before = np.concatenate(([0], np.cumsum(kept)))[bounds]
            of_text = np.searchsorted(runs[:, 0], np.arange(len(bounds)))
            structs = pa.StructArray.from_arrays([pa.array(runs[:, i]) for i in (1, 2, 3)], fields=list(_RUN))
            lists = pa.ListArray.from_arrays(pa.array(of_text, pa.int32()), structs)
            texts = joined(words.filter(pa.array(kept)), before)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], lists.cast(pa.list_(_RUN)), texts], schema=_FOUND)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, _FOUND_DDL)


def _stronger(a: Column, b: Column) -> Column:
    """Order of runs by falling length / period, compared exactly; then start, then period."""
    one, other = a["length"] * b["period"], b["length"] * a["period"]
    by_place = F.when(a["start"] != b["start"], F.when(a["start"] < b["start"], -1).otherwise(1)).otherwise(
        F.when(a["period"] < b["period"], -1).when(a["period"] > b["period"], 1).otherwise(0)
    )
    return F.when(one > other, -1).when(one < other, 1).otherwise(by_place)


def summary(collapsed: DataFrame) -> DataFrame:
    """doc_id, n_runs, the strongest run and digests, from the rows of `collapse`."""
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    best = F.get(F.array_sort("runs", _stronger), F.lit(0))
    return collapsed.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        best["start"].alias("start"),
        best["length"].alias("length"),
        best["period"].alias("period"),
        F.floor(1000 * best["length"] / best["period"]).cast("long").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform(lines, lambda x: F.concat(x, F.lit("\n"))), ""), 256).alias("runs_sha256"),
        F.sha2("text", 256).alias("collapsed_sha256"),
    )
