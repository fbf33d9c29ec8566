"""Pair sums over groups as a sparse matrix product in strips.

Counting which items share a group is the product X'X of the group-by-item matrix. A
self-join of the groups would write every pair of every group as a row. Here a task multiplies
the groups it holds and adds their pairs up before anything is sent. Items are cut into strips
with about equally many cells, a pair belongs to the strip of its smaller item, and what
tasks send of a strip are runs: an item, how many partners follow, the partners, their sums. Numbers
are sent as differences, first all low bytes, then all higher ones, which are alike and take little
room when compressed. One task adds up a whole strip, so the sums that leave it are final, and small
ones can end there.

Pairs may be many times the cells. If so, the strips are done in rounds, one range of them after the other:
the sums of a round are written and what it has shuffled is dropped before the next one begins.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.ordered import rank_rows
from tidemark.session import cut, freeing, stored

BLOCK = 4096  # cells of a group per row, at most
CHUNK = 1 << 20  # pairs made at a time
SPILL = 1 << 22  # sums held at a time by a task that makes pairs
STRIPS = 4096  # strips at most
RUN = 512  # pairs per row that is sent
RUNS = "strip int, heads binary, counts binary, partners binary, dots binary"
ROUND = 1 << 25  # pairs from which there is a further round, if they are more than CELLS times the cells
CELLS = 2


class Sums:
    """Sparse sums by key: entries are held as they come, and sorted and added up when there are many."""

    def __init__(self, spill: int):
        self.spill, self.runs, self.held = spill, [], 0

    def add(self, keys: np.ndarray, values: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Add values; yields partial sums if those held would be too many."""
        self._push(keys, values)
        if self.held > self.spill:
            merged = self._merged()
            # Sums that hardly shrink are of too many keys to hold.
            if len(merged[0]) > self.spill // 2:
                yield merged
            else:
                self._push(*merged)

    def add_all(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Add values and keep all sums, however many they are."""
        self._push(keys, values)
        if self.held > self.spill:
            self._push(*self._merged())
            self.spill = max(self.spill, 2 * self.held)

    def rest(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        if self.runs:
            yield self._merged()

    def _push(self, keys, values):
        self.runs.append((keys, values))
        self.held += len(keys)

    def _merged(self):
        keys, values = (np.concatenate(x) for x in zip(*self.runs))
        self.runs, self.held = [], 0
        return self._reduced(keys, values)

    @staticmethod
    def _reduced(keys, values):
        if len(keys) and keys.min() >= 0 and int(keys.max()) < len(keys):
            # Few different keys: counted into places instead of sorted.
            some = np.flatnonzero(np.bincount(keys))
            return some, np.bincount(keys, values)[some]
        order = np.argsort(keys, kind="stable")
        keys, values = keys[order], values[order]
        starts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))[: len(keys)]
        return keys[starts], np.add.reduceat(values, starts) if len(keys) else values


def _cells(batch: pa.RecordBatch, side: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cells per row, and item and value of every cell of a batch."""
    items, values = batch.column(f"items_{side}"), batch.column(f"values_{side}")
    lengths = pc.list_value_length(items).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    return lengths, items.flatten().to_numpy().astype(np.int64), values.flatten().to_numpy()


def _products(
    batch: pa.RecordBatch, width: int, diagonal: bool, chunk: int, least: int = 0, below: int = 1 << 31
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Keys and weighted products of the pairs of every row whose smaller item is in a range, a chunk at a time.

    Cells of a row are sorted by item. Inside one row a cell meets the ones after it, else all of
    the other side, which come after it too.
    """
    n, mine, x = _cells(batch, "a")
    rows = np.repeat(np.arange(len(n)), n)
    weight = batch.column("weight").to_numpy()[rows]
    if diagonal:
        theirs, y = mine, x
        starts = np.arange(len(rows)) + 1
        partners = np.cumsum(n)[rows] - starts
    else:
        m, theirs, y = _cells(batch, "b")
        starts, partners = (np.cumsum(m) - m)[rows], m[rows]
    partners = np.where((mine >= least) & (mine < below), partners, 0)
    upto = np.cumsum(partners)
    total = int(upto[-1]) if len(upto) else 0
    cuts = np.unique(np.searchsorted(upto, np.arange(chunk, total + chunk, chunk)))
    for first, last in zip([0, *(cuts[:-1] + 1).tolist()], (cuts + 1).tolist()):
        count = partners[first:last]
        a = np.repeat(np.arange(first, min(last, len(rows))), count)
        inside = np.arange(len(a)) - np.repeat(np.cumsum(count) - count, count)
        b = starts[a] + inside
        # A repeated cell is no pair.
        once = mine[a] < theirs[b]
        a, b = a[once], b[once]
        yield mine[a] * width + theirs[b], weight[a] * x[a] * y[b]


def _runs(keys: np.ndarray, values: np.ndarray, width: int, edges: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Sorted sums as rows of one strip each, at most RUN pairs long."""
    heads, partners = np.divmod(keys, width)
    strips = np.searchsorted(edges, heads, side="right")
    # A row ends with its strip or when it is full; a head's run ends with the row too.
    first = np.concatenate(([0], np.flatnonzero(np.diff(strips)) + 1))
    place = np.arange(len(keys)) - np.repeat(first, np.diff(np.append(first, len(keys))))
    rows = np.flatnonzero(place % RUN == 0)
    new_row = np.zeros(len(keys), dtype=bool)
    new_row[rows] = True
    runs = np.flatnonzero(new_row | np.concatenate(([True], heads[1:] != heads[:-1])))
    counts = np.diff(np.append(runs, len(keys)))
    of_runs = pa.array(np.append(np.searchsorted(runs, rows), len(runs)), pa.int32())
    of_pairs = pa.array(np.append(rows, len(keys)), pa.int32())
    whole = pa.RecordBatch.from_arrays([
        pa.array(strips[rows], pa.int32()),
        pa.ListArray.from_arrays(of_runs, pa.array(heads[runs], pa.int32())),
        pa.ListArray.from_arrays(of_runs, pa.array(counts, pa.int32())),
        pa.ListArray.from_arrays(of_pairs, pa.array(partners, pa.int32())),
        pa.ListArray.from_arrays(of_pairs, pa.array(values, pa.float64())),
    ], names=["strip", "heads", "counts", "partners", "dots"])
    for start in range(0, whole.num_rows, 1000):
        yield whole.slice(start, 1000)


def _planes(numbers: np.ndarray) -> bytes:
    """The lowest bytes of all numbers, then the next ones, and so on."""
    return numbers.view(np.uint8).reshape(len(numbers), numbers.itemsize).T.tobytes()


def _numbers(planes: bytes, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(size, len(planes) // size).T).view(kind).ravel()


def _packed(runs: pa.RecordBatch) -> pa.RecordBatch:
    """Runs as they are sent: heads and partners as differences, a run's first partner from its head."""
    columns = {"strip": runs.column("strip"), "heads": [], "counts": [], "partners": [], "dots": []}
    lists = {c: runs.column(c) for c in ("heads", "counts", "partners", "dots")}
    ends = {c: x.offsets.to_numpy() for c, x in lists.items()}
    values = {c: x.values.to_numpy() for c, x in lists.items()}
    for row in range(runs.num_rows):
        heads, counts, partners, dots = (values[c][ends[c][row]:ends[c][row + 1]] for c in lists)
        apart = np.diff(partners, prepend=np.int32(0))
        first = np.cumsum(counts) - counts
        apart[first] = partners[first] - heads
        for c, x in (("heads", np.diff(heads, prepend=np.int32(0))), ("counts", counts), ("partners", apart), ("dots", dots)):
            columns[c].append(_planes(x))
    return pa.RecordBatch.from_pydict({c: x if c == "strip" else pa.array(x, pa.binary()) for c, x in columns.items()})


def _unpacked(runs: pa.RecordBatch, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys and sums of runs that were sent."""
    keys, sums = [], []
    for row in range(runs.num_rows):
        heads, counts, apart = (_numbers(runs.column(c)[row].as_py(), np.int32).astype(np.int64) for c in ("heads", "counts", "partners"))
        heads, first, upto = np.cumsum(heads), np.cumsum(counts) - counts, np.cumsum(apart)
        keys.append(np.repeat(heads * (width + 1) - upto[first] + apart[first], counts) + upto)
        sums.append(_numbers(runs.column("dots")[row].as_py(), np.float64))
    return np.concatenate(keys), np.concatenate(sums)


def _multiplier(width: int, edges: list[int], diagonal: bool, chunk: int, spill: int, least: int = 0, below: int = 1 << 31):
    """Multiplies the groups of a task; yields runs of the sums whose smaller item is in a range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, bounds = Sums(spill), np.array(edges, dtype=np.int64)
        for batch in batches:
            for keys, values in _products(batch, width, diagonal, chunk, least, below):
                for done in sums.add(keys, values):
                    yield from map(_packed, _runs(*done, width, bounds))
        for done in sums.rest():
            if len(done[0]):
                yield from map(_packed, _runs(*done, width, bounds))

    return run


def _adder(width: int, least: float | None, spill: int):
    """Adds up runs sorted by strip; one strip is held at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, sums = None, Sums(spill)

        def finished() -> Iterator[pa.RecordBatch]:
            for keys, values in sums.rest():
                some = values != 0 if least is None else (values != 0) & (values >= least)
                left, right = np.divmod(keys[some], width)
                whole = pa.RecordBatch.from_pydict({"item_a": left, "item_b": right, "dot": values[some]})
                for start in range(0, whole.num_rows, 1 << 16):
                    yield whole.slice(start, 1 << 16)

        for batch in batches:
            strips = batch.column("strip").to_numpy()
            edges = np.flatnonzero(np.diff(strips)) + 1
            for start, stop in zip([0, *edges], [*edges, batch.num_rows]):
                if start == stop:
                    continue
                part, strip = batch.slice(start, stop - start), int(strips[start])
                if strip != current:
                    yield from finished()
                    current, sums = strip, Sums(spill)
                sums.add_all(*_unpacked(part, width))
        yield from finished()

    return run


def _ranges(edges: list[int], rounds: int) -> list[tuple[int, int]]:
    """Ranges of items for so many rounds: whole strips each, and about equally many pairs.

    The lower an item is, the more items come after it, so low ranges hold fewer strips.
    """
    strips = len(edges) + 1
    ends = sorted({round(strips * (1 - (1 - k / rounds) ** 0.5)) for k in range(1, rounds)} - {0, strips})
    cuts = [0, *(int(edges[e - 1]) for e in ends), 1 << 31]
    return list(zip(cuts[:-1], cuts[1:]))


@freeing
def pair_sums(
    df: DataFrame, group: str, item: str, value: str, weight: str, salts: int | None = None,
    block: int = BLOCK, chunk: int = CHUNK, spill: int = SPILL, least: float | None = None,
    written: bool = False,
) -> DataFrame:
    """sum over groups of weight * value_a * value_b for each unordered item pair.

    `item` is a whole number and (group, item) is unique; `weight` belongs to the
    group. Returns item_a < item_b, dot, where dot is not zero and not below `least`. Groups are
    dealt over at least `salts` tasks; a group with more than `block` cells is cut into
    rows of so many, which meet each other. With `written` the sums are written even if they take one round.
    """
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cells = df.filter(F.col(group).isNotNull() & F.col(item).isNotNull()).select(
        F.col(group).alias("_group"), F.col(item).cast("bigint").alias("_item"),
        F.col(value).cast("double").alias("_value"), F.col(weight).cast("double").alias("_weight"))
    place = F.row_number().over(Window.partitionBy("_group").orderBy("_item")) - 1
    placed = cells.repartition(max(partitions, salts or 1), "_group").withColumn("_place", place)
    cell = F.struct("_item", "_value")
    packed = cut(
        placed.groupBy("_group", F.floor(F.col("_place") / block).cast("int").alias("_part"))
        .agg(F.sort_array(F.collect_list(cell)).alias("_cells"), F.first("_weight").alias("weight"), F.sum("_place").alias("_pairs"))
        .select("_group", "_part", "weight", "_pairs", F.col("_cells._item").alias("items_a"), F.col("_cells._value").alias("values_a"))
    )
    ends = F.min(F.array_min("items_a")), F.max(F.array_max("items_a")), F.sum(F.size("items_a"))
    pairs, parts, lowest, highest, held = (int(x or 0) for x in packed.agg(F.sum("_pairs"), F.max("_part"), *ends).first())
    if lowest < 0 or highest >= 1 << 31:
        sums = _renumbered(df, group, item, value, weight, salts, block, chunk, spill, least)
        return stored(sums, "pairs") if written else sums
    width = highest + 1
    # A task sends a pair once, however many of its groups have it, unless it has to spill.
    sent = min(pairs, max(partitions, salts or 1) * width * highest // 2)
    rounds = max(1, -(-sent // max(ROUND, CELLS * held)))
    # So many strips that one is no more than a few times what a task holds anyway.
    count = min(STRIPS, max(partitions * rounds, -(-pairs // spill)))
    shares = [(i + 1) / count for i in range(count - 1)] or [0.5]
    edges = packed.select(F.explode("items_a").alias("item")).agg(F.percentile_approx("item", shares, 10 * STRIPS)).first()[0]
    edges = sorted(set(edges or []))
    if parts > 0:
        later = packed.select("_group", F.col("_part").alias("_later"), F.col("items_a").alias("items_b"), F.col("values_a").alias("values_b"))
        met = packed.join(later.filter("_later > 0"), "_group").filter("_part < _later")
        met = met.select("weight", "items_a", "values_a", "items_b", "values_b").repartition(partitions)

    def added(lowest: int, below: int) -> DataFrame:
        """The sums of pairs whose smaller item is in a range."""

        def multiplied(rows: DataFrame, diagonal: bool) -> DataFrame:
            return rows.mapInArrow(_multiplier(width, edges, diagonal, chunk, spill, lowest, below), RUNS)

        partial = multiplied(packed.select("weight", "items_a", "values_a"), True)
        if parts > 0:
            partial = partial.unionByName(multiplied(met, False))
        strips = sum(lowest < e < below for e in edges) + 1
        return (
            partial.repartition(min(count, strips) if edges else 1, "strip")
            .sortWithinPartitions("strip")
            .mapInArrow(_adder(width, least, spill), "item_a bigint, item_b bigint, dot double")
        )

    ranges = _ranges(edges, rounds)
    if len(ranges) == 1 and not written:
        return added(*ranges[0])
    return reduce(DataFrame.unionByName, [stored(added(*r), "pairs") for r in ranges])


def _renumbered(df: DataFrame, group: str, item: str, value: str, weight: str, *limits) -> DataFrame:
    """`pair_sums` of items that are no small numbers."""
    numbers = cut(dense_numbers(df.filter(F.col(item).isNotNull()), item, "_number"))
    sums = pair_sums(df.join(numbers, item), group, "_number", value, weight, *limits)
    for side in ("item_a", "item_b"):
        names = numbers.select(F.col("_number").alias(side), F.col(item).cast("bigint").alias("_name"))
        sums = sums.join(names, side).drop(side).withColumnRenamed("_name", side)
    return sums.select("item_a", "item_b", "dot")


def dense_numbers(df: DataFrame, col: str, name: str) -> DataFrame:
    """Each distinct value of `col` with a number from 0, in value order."""
    ranked = rank_rows(df.select(col).distinct(), [F.asc(col)], "_rank")
    return ranked.select(col, (F.col("_rank") - 1).alias(name))
