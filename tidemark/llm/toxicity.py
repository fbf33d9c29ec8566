"""Toxicity by non-negative positive-unlabelled learning, in NumPy.

Confirmed toxic texts are the positives; all other text is unlabelled, toxic ones among it.
With the share p of toxic texts, the risk of a classifier g is estimated as
p E+[l(g)] + max(0, Eu[l(-g)] - p E+[l(-g)]): what the unlabelled texts say about negatives,
less the part that positives have in it. Where the bracket would turn negative, which is where
the classifier begins to learn positives by heart, a step is taken back instead.

Features of a text are which words it has and which beginnings of words, hashed. What only
toxic texts have is about 1/p times as frequent in positives as in unlabelled texts; features
that come near that, with enough evidence, go into a linear model. The loss is the sigmoid.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.words import split_words
from tidemark.session import stored

DIMENSIONS = 1 << 18
# Letters of a word's beginning.
BEGINNINGS = (4, 6)
# A feature is kept if so many positives have it, with so much evidence (likelihood ratio).
LEAST_POSITIVES = 3
EVIDENCE = 12.0
MOST_FEATURES = 4096


def held_out(doc_id: Column, folds: int = 5) -> Column:
    """True for the documents whose labels are never learned from."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds == 0


def _features_of_word(word: str) -> list[int]:
    names = ["=" + word] + [word[:k] for k in BEGINNINGS if len(word) > k]
    return [xxhash.xxh3_64_intdigest(n.encode()) % DIMENSIONS for n in names]


def text_features(texts: pa.Array, number: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct features of every text of a batch, and the bounds of every text.

    With `number`, features are renumbered by it, and those it gives -1 are left out.
    """
    words, bounds = split_words(texts)
    encoded = words.dictionary_encode()
    table = np.full((len(encoded.dictionary), 1 + len(BEGINNINGS)), -1, dtype=np.int64)
    for i, word in enumerate(encoded.dictionary.to_pylist()):
        named = _features_of_word(word)
        table[i, : len(named)] = named
    if number is not None:
        table = np.where(table >= 0, number[table], -1)
    owner = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    code = encoded.indices.to_numpy()
    useful = (table >= 0).any(axis=1)[code] if len(code) else np.zeros(0, dtype=bool)
    owner, code = owner[useful], code[useful]
    features = table[code]
    pairs = np.unique((owner[:, None] * np.int64(DIMENSIONS) + features)[features >= 0])
    owner, features = np.divmod(pairs, np.int64(DIMENSIONS))
    return features, np.searchsorted(owner, np.arange(len(bounds)))


def select(positive: np.ndarray, unlabelled: np.ndarray, n_p: int, n_u: int, prior: float) -> np.ndarray:
    """Features that hardly any but toxic texts have, from counts of texts with each feature."""
    share = (positive + unlabelled) / max(1, n_p + n_u)

    def part(k, n):
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(k > 0, k * np.log(k / n / share), 0.0) + np.where(
                k < n, (n - k) * np.log((1 - k / n) / (1 - share)), 0.0
            )

    evidence = 2 * (part(positive, n_p) + part(unlabelled, n_u))
    # Of the unlabelled texts with a feature, at least two thirds should be toxic ones.
    telling = unlabelled / n_u < 1.5 * prior * positive / n_p
    good = (positive >= LEAST_POSITIVES) & telling & (evidence >= EVIDENCE)
    found = np.flatnonzero(good)
    return np.sort(found[np.argsort(-evidence[found], kind="stable")[:MOST_FEATURES]])


@dataclass(frozen=True)
class Classifier:
    """A linear model: `number` names the kept features among all hashed ones."""

    number: np.ndarray
    weights: np.ndarray
    bias: float

    def score(self, texts: pa.Array) -> np.ndarray:
        features, bounds = text_features(texts, self.number)
        sums = np.concatenate(([0.0], np.cumsum(self.weights[features])))
        margin = (sums[bounds[1:]] - sums[bounds[:-1]]) + self.bias
        return 1 / (1 + np.exp(-np.clip(margin, -60, 60)))


def fit(
    positives: list[np.ndarray],
    unlabelled: list[np.ndarray],
    features: int,
    prior: float,
    steps: int = 600,
    rate: float = 0.05,
    decay: float = 1e-4,
) -> tuple[np.ndarray, float]:
    """Minimise the non-negative risk with Adam over all rows at once: weights and bias.

    Without positives or unlabelled texts there is nothing to learn and the score is near 0.
    """
    w = np.zeros(features + 1)
    w[-1] = np.log(prior / (1 - prior))
    if not positives or not unlabelled:
        return w[:-1], -10.0
    rows, n_p, n_u = positives + unlabelled, len(positives), len(unlabelled)
    owner = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    flat = np.concatenate(rows).astype(np.int64)
    mean, square = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, steps + 1):
        margin = np.bincount(owner, w[flat], minlength=len(rows)) + w[-1]
        toxic = 1 / (1 + np.exp(-np.clip(margin, -60, 60)))
        # The sigmoid loss of a text taken as clean is its score; its slope is the same either way.
        negative = toxic[n_p:].mean() - prior * toxic[:n_p].mean()
        slope = toxic * (1 - toxic)
        d = np.concatenate([-prior * slope[:n_p] / n_p, slope[n_p:] / n_u])
        if negative >= 0:
            d[:n_p] -= prior * slope[:n_p] / n_p
        else:
            d = -d
        change = np.append(np.bincount(flat, d[owner], minlength=features) + decay * w[:-1], d.sum())
        mean = 0.9 * mean + 0.1 * change
        square = 0.99 * square + 0.01 * change * change
        w = w - rate * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-8)
    return w[:-1], float(w[-1])


def _counts(sample: DataFrame) -> np.ndarray:
    """Texts with each feature, unlabelled and positive. At most two rows per feature."""

    def run(batches: Iterator[pa.RecordBatch]):
        counts = np.zeros((2, DIMENSIONS), dtype=np.int64)
        for batch in batches:
            toxic = batch["toxic"].to_numpy(zero_copy_only=False).astype(bool)
            features, bounds = text_features(batch["text"])
            owner = np.repeat(np.arange(len(toxic)), np.diff(bounds))
            for kind in (0, 1):
                counts[kind] += np.bincount(features[toxic[owner] == bool(kind)], minlength=DIMENSIONS)
        for kind in (0, 1):
            seen = np.flatnonzero(counts[kind])
            yield pa.RecordBatch.from_arrays(
                [pa.array(seen * 2 + kind), pa.array(counts[kind][seen])], names=["code", "n"]
            )

    rows = sample.mapInArrow(run, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(2 * DIMENSIONS)
    out[rows["code"].to_numpy(dtype=np.int64)] = rows["n"].to_numpy(dtype=np.float64)
    return out.reshape(-1, 2).T


def _kept_features(sample: DataFrame, number: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Kept features of the sampled texts, positives and unlabelled ones, in order of doc_id."""

    def run(batches):
        for batch in batches:
            features, bounds = text_features(batch["text"], number)
            rows = [features[a:b].astype(np.int32).tobytes() for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], batch["toxic"], pa.array(rows, pa.binary())], names=["doc_id", "toxic", "features"]
            )

    rows = sample.mapInArrow(run, "doc_id long, toxic boolean, features binary").toArrow().to_pylist()
    rows.sort(key=lambda r: (r["doc_id"], r["features"]))
    lists = [[np.frombuffer(r["features"], dtype=np.int32) for r in rows if r["toxic"] == kind] for kind in (True, False)]
    return lists[0], lists[1]


def train(
    docs: DataFrame,
    labels: DataFrame,
    positive_sample: int = 4000,
    unlabelled_sample: int = 12_000,
    folds: int = 5,
) -> Classifier:
    """Learn from labelled toxic texts and from other texts, all outside the held-out fold.

    Both samples are bounded, by the smallest hashes of doc_id: `positive_sample` of the toxic
    ids and `unlabelled_sample` of all ids. The share of toxic texts is that among the labelled
    ones. What reaches the driver are the counts per feature and the kept features of samples.
    """
    known = (
        labels.filter(~held_out(F.col("doc_id"), folds)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    )
    counts = known.agg(F.count("toxic").alias("n"), F.sum("toxic").alias("p")).first()
    nothing = Classifier(np.full(DIMENSIONS, -1), np.zeros(0), -10.0)
    if not counts["p"]:
        return nothing
    prior = min(0.9, max(1e-4, counts["p"] / counts["n"]))
    order = F.xxhash64("doc_id")
    texts = docs.filter(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"), folds)).select(
        F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text")
    )
    edge = texts.select(order.alias("_o")).orderBy("_o").limit(unlabelled_sample).agg(F.max("_o").alias("m")).first()["m"]
    if edge is None:
        return nothing
    toxic = known.filter(F.col("toxic") == 1).orderBy(order).limit(positive_sample)
    chosen = texts.join(F.broadcast(toxic), "doc_id", "left").withColumn("_near", order <= F.lit(edge))
    chosen = chosen.filter(F.col("_near") | F.col("toxic").isNotNull())
    # A confirmed text of the unlabelled sample stands in both.
    copies = F.array_compact(F.array(F.when(F.col("toxic").isNotNull(), True), F.when(F.col("_near"), False)))
    sample = stored(chosen.select("doc_id", "text", F.explode(copies).alias("toxic")), "toxic-sample")
    unlabelled, positive = _counts(sample)
    sizes = {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()}
    if not sizes.get(True) or not sizes.get(False):
        return nothing
    kept = select(positive, unlabelled, sizes[True], sizes[False], prior)
    number = np.full(DIMENSIONS, -1)
    number[kept] = np.arange(len(kept))
    return Classifier(number, *fit(*_kept_features(sample, number), len(kept), prior))


def score(docs: DataFrame, classifier: Classifier, columns: list[str], threshold: float = 0.5) -> DataFrame:
    """The given columns of every row with `score` and `predicted`. The text is only read here."""
    model = docs.sparkSession.sparkContext.broadcast((classifier.number, classifier.weights, classifier.bias))
    fields = [docs.schema[c] for c in columns]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", score double, predicted int"
    source = docs.select(*columns, *(["text"] if "text" not in columns else []))

    def run(batches):
        classifier = Classifier(*model.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                piece = batch.slice(at, 1024)
                scores = classifier.score(piece["text"])
                arrays = [piece[c] for c in columns]
                arrays += [pa.array(scores), pa.array((scores >= threshold).astype(np.int32))]
                yield pa.RecordBatch.from_arrays(arrays, names=[*columns, "score", "predicted"])

    return source.mapInArrow(run, schema)


def toxicity(docs: DataFrame, labels: DataFrame, folds: int = 5) -> DataFrame:
    """doc_id, held_out, score and predicted of every text.

    Defined cases: a null text is scored as an empty one, that is by the bias; a null doc_id
    falls into the held-out fold (the checksum of nothing is 0); a document with several
    labels is toxic if one of them says so; a null label is none; without toxic labels every
    score is near 0; equal texts have equal scores; other columns are ignored.
    """
    rows = docs.select("doc_id", held_out(F.col("doc_id"), folds).alias("held_out"), "text")
    return score(rows, train(docs, labels, folds=folds), ["doc_id", "held_out"])
