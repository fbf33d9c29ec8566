"""Approximate nearest neighbours by an inverted multi-index.

The two halves of a unit vector are quantised apart, each to the nearest of `centroids` points;
the pair of points is the vector's cell. A query walks the cells in order of the summed
distances of its halves, by a heap over pairs of centroids, until the cells it has met hold
enough vectors. These are compared exactly.

Cells are gathered into slabs of about equal size, large ones cut, and a slab meets a block of
queries in one task: both sides are bounded, whatever a cell holds.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.keyed import top_per_key
from tidemark.session import stored

CENTROIDS = 32
TRAINING_SAMPLE = 20_000
SLAB = 4096
QUERY_BLOCK = 1024
# Share of all vectors that the cells a query meets have to hold. The given vectors have no near
# neighbours (cosines of the first five around 0.4), which takes a large share.
CANDIDATE_SHARE = 0.6


def usable(vector: Column) -> Column:
    """Vectors that have a direction: no null or non-finite component, and one that is not 0."""
    finite = F.forall(
        vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))
    )
    return F.coalesce(vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of packed doubles as a matrix."""
    return np.frombuffer(b"".join(x.as_py() for x in column), dtype="<f8").reshape(len(column), -1)


def _unit(m: np.ndarray) -> np.ndarray:
    m = m / np.abs(m).max(axis=1, keepdims=True)
    return m / np.sqrt((m * m).sum(axis=1, keepdims=True))


def _distances(m: np.ndarray, points: np.ndarray) -> np.ndarray:
    return (m * m).sum(axis=1)[:, None] - 2 * (m @ points.T) + (points * points).sum(axis=1)


def k_means(m: np.ndarray, k: int, rounds: int = 20, seed: int = 5) -> np.ndarray:
    """Centroids of the rows; at most as many as there are rows."""
    rng = np.random.default_rng(seed)
    points = m[np.sort(rng.choice(len(m), min(k, len(m)), replace=False))].copy()
    for _ in range(rounds):
        nearest = _distances(m, points).argmin(axis=1)
        sums = np.zeros_like(points)
        np.add.at(sums, nearest, m)
        counts = np.bincount(nearest, minlength=len(points))
        points[counts > 0] = sums[counts > 0] / counts[counts > 0, None]
    return points


@dataclass(frozen=True)
class Codebooks:
    """Centroids of both halves of unit vectors."""

    first: np.ndarray
    second: np.ndarray

    def split(self, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        half = self.first.shape[1]
        return m[:, :half], m[:, half:]

    def cells(self, m: np.ndarray) -> np.ndarray:
        a, b = self.split(_unit(m))
        first = _distances(a, self.first).argmin(axis=1)
        return first * len(self.second) + _distances(b, self.second).argmin(axis=1)


def walk(a: np.ndarray, b: np.ndarray, sizes: np.ndarray, enough: int) -> list[int]:
    """Cells in order of summed distance until they hold `enough` vectors.

    `a` and `b` are the distances of a query's halves to the centroids. The pair (i, j) of
    ranks enters the heap once its predecessors (i - 1, j) and (i, j - 1) have left it.
    """
    by_a, by_b = np.argsort(a, kind="stable"), np.argsort(b, kind="stable")
    da, db = a[by_a].tolist(), b[by_b].tolist()
    left = [0] * len(da)  # how far each row of the grid has been walked
    heap, cells, held = [(da[0] + db[0], 0, 0)], [], 0
    while heap and held < enough:
        _, i, j = heapq.heappop(heap)
        left[i] = j + 1
        cell = int(by_a[i]) * len(db) + int(by_b[j])
        if sizes[cell]:
            cells.append(cell)
            held += int(sizes[cell])
        if i + 1 < len(da) and left[i + 1] == j:
            heapq.heappush(heap, (da[i + 1] + db[j], i + 1, j))
        if j + 1 < len(db) and (i == 0 or left[i - 1] > j + 1):
            heapq.heappush(heap, (da[i] + db[j + 1], i, j + 1))
    return cells


def _training_sample(rows: DataFrame, sample: int) -> np.ndarray:
    table = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).select("vector").toArrow()
    column = table["vector"].combine_chunks()
    return _matrix(column) if len(column) else np.zeros((0, 2))


def packed_vectors(df: DataFrame, key: str, vector: str) -> DataFrame:
    """(row, vec_id, vector): usable vectors of the most common length, packed as doubles.

    Every row is one, also of several with one key; `row` tells them apart. A vector is scaled by
    a power of two so that its largest component is about 1: that changes no cosine, and squares
    neither overflow nor vanish.
    """
    rows = df.filter(F.col(key).isNotNull() & usable(F.col(vector))).select(
        F.col(key).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("_v")
    )
    common = rows.groupBy(F.size("_v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    rows = rows.filter(F.size("_v") == (common["n"] if common else 0))
    rows = rows.withColumn("row", F.monotonically_increasing_id())

    def run(batches):
        for batch in batches:
            lists = batch["_v"]
            data = np.ascontiguousarray(lists.flatten().to_numpy(zero_copy_only=False), dtype="<f8")
            m = data.reshape(len(lists), -1) if len(lists) else data.reshape(0, 1)
            _, exponent = np.frexp(np.abs(m).max(axis=1, initial=0))
            m = np.ldexp(m, -exponent[:, None])
            yield pa.RecordBatch.from_arrays(
                [batch["row"], batch["vec_id"], pa.array([r.tobytes() for r in m], pa.binary())],
                names=["row", "vec_id", "vector"],
            )

    return rows.mapInArrow(run, "row long, vec_id long, vector binary")


def _slabs(sizes: np.ndarray, slab: int) -> tuple[np.ndarray, np.ndarray]:
    """First slab of every cell and in how many slabs it is cut."""
    first, cut = np.zeros(len(sizes), np.int64), np.ones(len(sizes), np.int64)
    at, held = 0, 0
    for cell in np.flatnonzero(sizes).tolist():
        n = int(sizes[cell])
        if held and held + n > slab:
            at, held = at + 1, 0
        first[cell] = at
        if n > slab:
            cut[cell] = -(-n // slab)
            at, held = at + int(cut[cell]), 0
        else:
            held += n
    return first, cut


def nearest(
    vectors: DataFrame,
    queries: DataFrame,
    k: int = 5,
    key: str = "vec_id",
    vector: str = "embedding",
    centroids: int = CENTROIDS,
    sample: int = TRAINING_SAMPLE,
    share: float = CANDIDATE_SHARE,
) -> DataFrame:
    """The k nearest vectors found for every query: query_id, rank, vec_id, score (cosine).

    Codebooks are fitted on `sample` vectors, those of the smallest hash of the key; every
    vector is in the index. With share = 1 the search is exact.

    `queries` names its rows by key: every row of `vectors` with such a key is a query of its own,
    and its candidates are all rows but itself.

    Defined cases: vectors that are null, zero, of an uncommon length, or that hold null or
    non-finite components take no part, nor do rows without a key; of several rows with one key
    each is a candidate, and a query finds the others; ties go to the smaller vec_id; with fewer
    candidates there are fewer rows; empty tables give an empty result; other columns are ignored.
    """
    base = stored(packed_vectors(vectors, key, vector), "vectors")
    training = _training_sample(base, sample)
    half = max(1, training.shape[1] // 2)
    if not len(training):
        return base.selectExpr("vec_id query_id", "1 rank", "vec_id", "0D score").filter("false")
    unit = _unit(training)
    books = Codebooks(k_means(unit[:, :half], centroids), k_means(unit[:, half:], centroids))

    def assign(batches):
        for batch in batches:
            cells = books.cells(_matrix(batch["vector"])) if batch.num_rows else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch["row"], batch["vec_id"], batch["vector"], pa.array(cells.astype(np.int64))],
                names=["row", "vec_id", "vector", "cell"],
            )

    entries = stored(base.mapInArrow(assign, "row long, vec_id long, vector binary, cell long"), "index")
    # One row per cell: at most centroids squared.
    sizes = np.zeros(len(books.first) * len(books.second), dtype=np.int64)
    for row in entries.groupBy("cell").count().collect():
        sizes[row["cell"]] = row["count"]
    first, cut = _slabs(sizes, SLAB)
    enough = max(k + 1, int(np.ceil(share * sizes.sum())))

    def place(batches):
        for batch in batches:
            cell = batch["cell"].to_numpy()
            spread = batch["row"].to_numpy() % cut[cell]
            yield pa.RecordBatch.from_arrays(
                [batch["row"], batch["vec_id"], batch["vector"], pa.array(first[cell] + spread)],
                names=["row", "vec_id", "vector", "slab"],
            )

    def visit(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            m = _matrix(batch["vector"])
            a, b = books.split(_unit(m))
            a, b = _distances(a, books.first), _distances(b, books.second)
            at, slabs = [], []
            for i in range(len(m)):
                met = {int(first[c]) + s for c in walk(a[i], b[i], sizes, enough) for s in range(int(cut[c]))}
                at += [i] * len(met)
                slabs += sorted(met)
            at = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch["row"].take(at), batch["vec_id"].take(at), batch["vector"].take(at), pa.array(slabs, pa.int64())],
                names=["query_row", "query_id", "query", "slab"],
            )

    asked = base.join(queries.select(F.col(key).cast("long").alias("vec_id")).distinct(), "vec_id", "left_semi")
    blocks = max(1, -(-asked.count() // QUERY_BLOCK))
    visits = asked.mapInArrow(visit, "query_row long, query_id long, query binary, slab long").withColumn(
        "block", F.pmod(F.xxhash64("query_row"), F.lit(blocks))
    )
    visits = stored(visits, "visits")
    # A slab goes to the blocks of queries that visit it; there are slabs * blocks of them at most.
    met = visits.select(F.col("slab").alias("_slab"), F.col("block").alias("_block")).distinct()
    placed = entries.mapInArrow(place, "row long, vec_id long, vector binary, slab long")
    placed = placed.join(met, F.col("slab") == F.col("_slab")).drop("_slab").withColumnRenamed("_block", "block")

    def compare(left, right):
        out = [[], [], [], []]
        if left.num_rows and right.num_rows:
            q, v = _matrix(left["query"].combine_chunks()), _matrix(right["vector"].combine_chunks())
            ids, rows = right["vec_id"].to_numpy(), right["row"].to_numpy()
            nq, nv = np.sqrt((q * q).sum(axis=1)), np.sqrt((v * v).sum(axis=1))
            rough = (q / nq[:, None]) @ (v / nv[:, None]).T
            for i, (own, name) in enumerate(zip(left["query_row"].to_pylist(), left["query_id"].to_pylist())):
                row = np.where(rows == own, -2.0, rough[i])
                n = min(k, len(row))
                # All that may be among the first k, compared again alike for equal vectors.
                near = np.flatnonzero(row >= np.partition(row, len(row) - n)[len(row) - n] - 1e-9)
                near = near[rows[near] != own]
                exact = (v[near] * q[i]).sum(axis=1) / (nq[i] * nv[near])
                best = np.lexsort((ids[near], -exact))[:k]
                out[0] += [own] * len(best)
                out[1] += [name] * len(best)
                out[2] += ids[near][best].tolist()
                out[3] += exact[best].tolist()
        return pa.table(
            [pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int64(), pa.int64(), pa.float64()))],
            names=["query_row", "query_id", "vec_id", "score"],
        )

    found = visits.groupBy("slab", "block").cogroup(placed.groupBy("slab", "block")).applyInArrow(
        compare, "query_row long, query_id long, vec_id long, score double"
    )
    ranked = top_per_key(found, ["query_row"], [F.desc("score"), F.asc("vec_id")], k, "rank")
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
