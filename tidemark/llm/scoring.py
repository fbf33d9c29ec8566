"""Language-model scores by deleted interpolation of bigrams, words and a uniform part.

P(w | h) = l2 c(h w) / c(h) + l1 c(w) / N + l0 / (V + 1), where the three weights depend on how
often the context h was seen (a bucket per power of two) and are learned by expectation
maximisation on documents whose counts are deleted from the model meanwhile.

All counts are of the whole corpus. A task turns a chunk of documents into its sorted distinct
n-grams and sends them, packed by ranges of their hash, to the tasks that count a range over
all chunks. The counts go back to the chunk in the same order, without the n-grams. The chunk's
documents then meet their counts and are scored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.words import from_planes, mix, planes, word_hashes
from tidemark.session import stored

_U = np.uint64
FOLDS = 10
# Rows of a chunk: a task holds one chunk's n-grams at a time. N-grams of a range in one task.
CHUNK_BITS = 11
RANGE_KEYS = 3_000_000
END, START = _U(0x5851F42D4C957F2C), _U(0x14057B7EF767814E)
# Buckets of context counts; the first is for contexts never seen.
BUCKETS = 24
# Cells per power of two in which EM sums up equal enough probabilities.
CELLS = 8


def fold_of(doc_id: Column, folds: int = FOLDS) -> Column:
    return (F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds).cast("int")


def chunked(docs: DataFrame, folds: int = FOLDS) -> DataFrame:
    """doc_id, text, fold, place and chunk. The place is that in the scan, which repeats alike.

    Deleted documents (fold 1) have odd chunks of their own, so that they can be read alone.
    """
    return docs.select(
        F.col("doc_id").cast("long"),
        F.coalesce("text", F.lit("")).alias("text"),
        fold_of(F.col("doc_id"), folds).alias("fold"),
        F.monotonically_increasing_id().alias("place"),
    ).withColumn("chunk", F.shiftright("place", CHUNK_BITS) * 2 + (F.col("fold") == 1).cast("long"))


@dataclass
class Grams:
    """N-grams of documents: a word, end included, and a bigram for every token."""

    words: np.ndarray
    bigrams: np.ndarray
    contexts: np.ndarray  # the word before, or the start
    bounds: np.ndarray
    fold: np.ndarray  # of every token


def grams_of(texts: pa.Array, folds: np.ndarray) -> Grams:
    hashes, bounds = word_hashes(texts)
    bounds = bounds + np.arange(len(bounds))
    words = np.full(bounds[-1], END, dtype=np.uint64)
    is_word = np.ones(bounds[-1], dtype=bool)
    is_word[bounds[1:] - 1] = False
    words[is_word] = hashes
    contexts = np.empty_like(words)
    contexts[1:] = words[:-1]
    contexts[bounds[:-1]] = START
    with np.errstate(over="ignore"):
        bigrams = mix(mix(contexts ^ _U(0x9E6C63D0876A9A47)) + words)
    return Grams(words, bigrams, contexts, bounds, np.repeat(folds, np.diff(bounds)))


def _chunks(batches: Iterator[pa.RecordBatch]):
    """(chunk, Grams) of rows that come in order of place."""
    held, pair = [], None

    def out():
        table = pa.Table.from_batches(held)
        for chunk in (2 * pair, 2 * pair + 1):
            rows = table.filter(pc.equal(table["chunk"], chunk))
            if rows.num_rows:
                yield chunk, tagged(grams_of(rows["text"], rows["fold"].to_numpy()))

    for batch in batches:
        values = batch["chunk"].to_numpy() >> 1
        cuts = [0, *(np.flatnonzero(np.diff(values)) + 1).tolist(), len(values)]
        for a, b in zip(cuts[:-1], cuts[1:]):
            if a == b:
                continue
            if held and int(values[a]) != pair:
                yield from out()
                held = []
            pair = int(values[a])
            held.append(batch.slice(a, b - a))
    if held:
        yield from out()


@dataclass
class Places:
    """Sorted distinct n-grams of a chunk, and where among them every token's are."""

    keys: np.ndarray
    words: np.ndarray
    bigrams: np.ndarray
    contexts: np.ndarray
    start: int


def places_of(g: Grams) -> Places:
    """One sort places all n-grams; a context is the word before, so it is not looked up."""
    n = len(g.words)
    keys, at = np.unique(np.concatenate([g.words, g.bigrams, np.array([START])]), return_inverse=True)
    words, bigrams, start = at[:n], at[n : 2 * n], int(at[-1])
    contexts = np.empty_like(words)
    contexts[1:] = words[:-1]
    contexts[g.bounds[:-1]] = start
    return Places(keys, words, bigrams, contexts, start)


def _sent(docs: DataFrame, range_bits: int) -> DataFrame:
    """Rows chunk, range, keys and two counts per key: learned and deleted occurrences.

    The lowest bit of a key tells words (0) and bigrams (1) apart.
    """
    names = ["chunk", "range", "keys", "learned", "deleted"]

    def run(batches):
        for chunk, g in _chunks(batches):
            at = places_of(g)
            keys, counts = at.keys, []
            for use in (g.fold > 1, g.fold == 1):
                found = np.bincount(np.concatenate([at.words[use], at.bigrams[use]]), minlength=len(keys))
                found[at.start] += int(use[g.bounds[:-1]].sum())
                counts.append(found.astype(np.uint64))
            learned, deleted = counts
            ranges = (keys >> _U(64 - range_bits)).astype(np.int64)
            cuts = [0, *(np.flatnonzero(np.diff(ranges)) + 1).tolist(), len(keys)]
            rows = [
                (chunk, int(ranges[a]), planes(keys[a:b], 8), planes(learned[a:b], 4), planes(deleted[a:b], 4))
                for a, b in zip(cuts[:-1], cuts[1:])
            ]
            types = [pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    return docs.mapInArrow(run, "chunk long, range int, keys binary, learned binary, deleted binary")


def tagged(g: Grams) -> Grams:
    """The same n-grams with words even and bigrams odd."""
    even, odd = ~_U(1), _U(1)
    return Grams(g.words & even, g.bigrams | odd, g.contexts & even, g.bounds, g.fold)


def _counted(sent: DataFrame) -> DataFrame:
    """Counts over all chunks, sent back in each chunk's order of keys.

    A row without a chunk says how many tokens and distinct words a range holds, learned and
    deleted ones together and learned ones alone.
    """
    names = ["chunk", "range", "learned", "deleted", "tokens", "types", "learned_tokens", "learned_types"]

    def run(table):
        lists = [[from_planes(x, w) for x in table[c].to_pylist()] for c, w in (("keys", 8), ("learned", 4), ("deleted", 4))]
        sizes = [len(k) for k in lists[0]]
        keys, inverse = np.unique(np.concatenate(lists[0]), return_inverse=True)
        sums = [np.bincount(inverse, np.concatenate(x), minlength=len(keys)).astype(np.uint64) for x in lists[1:]]
        is_word = ((keys & _U(1)) == 0) & (keys != START)
        seen, learned = (sums[0] + sums[1])[is_word], sums[0][is_word]
        rows = [(None, table["range"][0].as_py(), None, None, int(seen.sum()), int((seen > 0).sum()), int(learned.sum()), int((learned > 0).sum()))]
        at = 0
        for chunk, n in zip(table["chunk"].to_pylist(), sizes):
            mine = inverse[at : at + n]
            rows.append((chunk, table["range"][0].as_py(), planes(sums[0][mine], 5), planes(sums[1][mine], 5), *[None] * 4))
            at += n
        types = [pa.int64(), pa.int32(), pa.binary(), pa.binary(), *[pa.int64()] * 4]
        return pa.table([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    return sent.groupBy("range").applyInArrow(
        run,
        "chunk long, range int, learned binary, deleted binary, tokens long, types long, "
        "learned_tokens long, learned_types long",
    )


def _bucket(context_counts: np.ndarray) -> np.ndarray:
    return np.minimum(np.ceil(np.log2(context_counts + 1.0)).astype(np.int64), BUCKETS - 1)


def _parts(pair: np.ndarray, word: np.ndarray, context: np.ndarray, tokens: float):
    """Maximum-likelihood estimates of the bigram and of the word."""
    return pair / np.maximum(context, 1.0), word / max(tokens, 1.0)


def _with_counts(docs: DataFrame, counts: DataFrame, columns: list[str], run, ddl: str) -> DataFrame:
    """Apply run(grams, places, learned, deleted, rows) to every chunk and its counts.

    learned and deleted are the counts of the chunk's distinct n-grams.
    """

    def both(left, right):
        if not left.num_rows:
            return run(None, None, None, None, None)
        left = left.sort_by("place")
        right = right.sort_by("range")
        g = tagged(grams_of(left["text"], left["fold"].to_numpy()))
        at = places_of(g)
        kept = {c: [from_planes(x, 5) for x in right[c].to_pylist()] for c in ("learned", "deleted")}
        found = {c: (np.concatenate(x) if x else np.zeros(0, np.uint64)).astype(np.float64) for c, x in kept.items()}
        if len(found["learned"]) != len(at.keys):
            raise RuntimeError("the scan of documents did not repeat alike; write them as a table first")
        return run(g, at, found["learned"], found["deleted"], {c: left[c].combine_chunks() for c in columns})

    return docs.groupBy("chunk").cogroup(counts.groupBy("chunk")).applyInArrow(both, ddl)


def _held_out_cells(docs: DataFrame, counts: DataFrame, tokens: int) -> np.ndarray:
    """Cells (bucket, bigram estimate, word estimate) of deleted tokens with how many fall in each.

    Estimates are put into CELLS steps per power of two; 0 stands for an estimate of 0.
    """
    names = ["cell", "n"]

    def run(g, at, learned, deleted, rows):
        if g is None:
            return pa.table([pa.array([], pa.int64())] * 2, names=names)
        use = g.fold == 1
        pair, word, context = (learned[x[use]] for x in (at.bigrams, at.words, at.contexts))
        p2, p1 = _parts(pair, word, context, tokens)
        steps = [
            np.where(p > 0, 1 + np.minimum(np.round(-np.log2(np.maximum(p, 1e-18)) * CELLS), 999), 0).astype(np.int64)
            for p in (p2, p1)
        ]
        cells, n = np.unique((_bucket(context) * 1001 + steps[0]) * 1001 + steps[1], return_counts=True)
        return pa.table([pa.array(cells), pa.array(n)], names=names)

    odd = F.col("chunk").bitwiseAND(F.lit(1)) == 1
    found = _with_counts(docs.filter("fold = 1"), counts.filter(odd), [], run, "cell long, n long")
    cells = found.groupBy("cell").agg(F.sum("n").alias("n"))
    # At most BUCKETS * 1001 * 1001 cells, whatever the corpus; some ten thousand in practice.
    return cells.toPandas()[["cell", "n"]].to_numpy(dtype=np.int64)


def learn_weights(cells: np.ndarray, uniform: float, rounds: int = 60) -> np.ndarray:
    """Mixture weights (bigram, word, uniform) of every bucket, by expectation maximisation.

    A bucket without deleted tokens has the weights of all buckets together; without any
    deleted tokens the weights are equal. The uniform part keeps a millionth.
    """
    cell, n = cells[:, 0], cells[:, 1].astype(np.float64)
    bucket, rest = np.divmod(cell, 1001 * 1001)
    p = np.stack([np.where(s > 0, 2.0 ** (-(s - 1) / CELLS), 0.0) for s in np.divmod(rest, 1001)] + [np.full(len(cell), uniform)])

    def em(use):
        weights = np.full(3, 1 / 3)
        if not use.any():
            return None
        for _ in range(rounds):
            shares = weights[:, None] * p[:, use]
            shares = shares / shares.sum(axis=0) * n[use]
            weights = np.maximum(shares.sum(axis=1) / n[use].sum(), 1e-6)
            weights = weights / weights.sum()
        return weights

    everything = em(np.ones(len(cell), dtype=bool))
    if everything is None:
        everything = np.full(3, 1 / 3)
    out = np.stack([w if (w := em(bucket == b)) is not None else everything for b in range(BUCKETS)])
    # A context never seen has no bigram estimate.
    out[0] = np.array([0.0, out[0][1], out[0][2]]) / (out[0][1] + out[0][2])
    return out


def score(docs: DataFrame, folds: int = FOLDS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every text.

    Documents of fold 0 are held out. Fold 1 is the deleted part while weights are learned; the
    model that scores counts folds 1 to folds - 1.

    Defined cases: a null text is its end token alone; a null doc_id is in fold 0 (the checksum
    of nothing); equal rows are scored alike and count each; without training documents every
    count is 0 and the score is uniform; an empty table gives an empty result; other columns
    are ignored.
    """
    spark = docs.sparkSession
    source = chunked(docs, folds)
    # About two n-grams a token, and a token for every five characters.
    chars = docs.agg(F.sum(F.length("text")).alias("n")).first()["n"] or 0
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), chars * 2 // 5 // RANGE_KEYS)
    range_bits = min(20, max(1, (ranges - 1).bit_length()))
    counted = stored(_counted(_sent(source, range_bits)), "ngram-counts")
    totals = counted.filter(F.col("chunk").isNull()).agg(
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("tokens", "types", "learned_tokens", "learned_types")]
    ).first()
    counts = counted.filter(F.col("chunk").isNotNull()).select("chunk", "range", "learned", "deleted")
    cells = _held_out_cells(source, counts, totals["learned_tokens"])
    uniform = 1.0 / (totals["types"] + 1)
    weights = learn_weights(cells, 1.0 / (totals["learned_types"] + 1))
    tokens, types = totals["tokens"], totals["types"]
    names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    kinds = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]

    def run(g, at, learned, deleted, rows):
        if g is None:
            return pa.table([pa.array([], t) for t in kinds], names=names)
        counts_ = learned + deleted
        word, pair, context = (counts_[x] for x in (at.words, at.bigrams, at.contexts))
        base = np.log10((word + 0.1) / (tokens + 0.1 * (types + 1)))
        p2, p1 = _parts(pair, word, context, tokens)
        w = weights[_bucket(context)]
        model = np.log10(w[:, 0] * p2 + w[:, 1] * p1 + w[:, 2] * uniform)
        starts, sizes = g.bounds[:-1], np.diff(g.bounds)
        columns = [
            rows["doc_id"], pa.array(rows["fold"].to_numpy() == 0), pa.array(sizes.astype(np.int64)),
            pa.array(np.add.reduceat((word > 0).astype(np.int64), starts)),
            pa.array(np.full(len(sizes), tokens, dtype=np.int64)),
            pa.array(np.add.reduceat(base, starts)), pa.array(np.add.reduceat(model, starts)),
        ]
        return pa.table(columns, names=names)

    ddl = (
        "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, "
        "base_score double, score double"
    )
    return _with_counts(source, counts, ["doc_id", "fold"], run, ddl)
