"""Best link between two populations that share attributes (a many-to-many match).

Strength is the number (or weight) of shared attribute values; each source keeps its strongest
target, ties going to the smallest target id. A value shared by very many (a carrier gateway
address, say) would join every source with every target behind it. One exact plan avoids that,
whatever the sizes:

* Values are ordered by how many targets have them. The rest of a member from a value on are that
  value and its more frequent ones. Two members whose rests are equal are interchangeable for
  the pairs that have this value as their rarest shared one, so rests are compared, not members,
  and of targets with one rest only the smallest can win. The more frequent a value, the fewer
  different rests there are from it on: the most frequent one has a single one on either side.
* The weight of a source's rest bounds what any target can reach whose rarest shared value is
  there. Sources are matched by their rarest value first; a more frequent one is looked at only
  where its bound is not below the strength found already.

A pair of rests is rated by the rows of one member of each; sets are never collected.

Where members have many values of few, nearly all rests differ and little is bounded: then rating pairs
of rests takes far more rows than there are. Their number is estimated before they are made. If it is too
large, blocks of sources meet blocks of targets instead, a pair of blocks in one task, which keeps one
target per source. Members travel packed, many in a row, as compressed differences of their values. A
task has a row of bits per value, one bit per target, and adds up the rows of a source's values for 64 targets
at a time; values that few targets have are added by target. Blocks are as large as a task can hold, so
that members are sent few times. The work grows with sources times targets, what is shuffled with members
times blocks.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tidemark.operators.gram import _numbers, _planes, dense_numbers
from tidemark.operators.keyed import first_per_key
from tidemark.operators.ordered import PART, running, split
from tidemark.session import cut, freeing, stored

_REST = ["_key", "_d1", "_d2"]
_ORDER = ["_often", "_key"]
HEAVY = 16  # rows that rating pairs of rests would take, per row there is, from which blocks are compared
SOURCE_BLOCK, TARGET_BLOCK = 262_144, 131_072  # members of a block at most
CELLS = 1 << 25  # values of all targets of a block, about
SLICE = 256  # members that are packed into a row
VALUES = 64  # a value has a row of bits in a block if one of so many targets has it,
OFTEN = 1 << 12  # and if so many pairs of members have it
WORDS = 1 << 12  # words of bits that are added up at a time


def _ordered(rows: DataFrame, member: str, frequency: DataFrame) -> DataFrame:
    """Rows of members in parts, ordered by how frequent their values are."""
    ranked = rows.join(frequency.select("_key", "_f"), "_key")
    ranked = ranked.select(member, "_key", "_w", (-F.col("_f")).alias("_often"))
    return split(ranked, [member], _ORDER)


def _rests(ordered: DataFrame, member: str, values: list[str]) -> DataFrame:
    """Rows of members with the name of their rest from that value on.

    _n is the number of values of the rest, _bound its weight; _d1 and _d2 are 128 bits of digest.
    """
    # Digests are made where they are added up, so they are not shuffled.
    hashed = ordered.repartition(member, PART).withColumns({
        "_one": F.lit(1).cast("long"), "_h1": F.xxhash64(F.lit(3), *values), "_h2": F.xxhash64(F.lit(17), *values)})
    added = running(
        hashed, [member], _ORDER,
        {"_n": ("_one", "sum"), "_bound": ("_w", "sum"), "_d1": ("_h1", "xor"), "_d2": ("_h2", "xor")},
    )
    return added.select(member, "_key", "_w", "_n", "_bound", "_d1", "_d2")


def _pairs(rests: DataFrame, right: DataFrame) -> DataFrame:
    """Pairs of a source's and a target's rest from the same value on; one member stands for each.

    A source that has its rest alone meets a target in the largest rest they share only: the other
    rests say less of the same pair.
    """
    mine = rests.groupBy(*_REST, "_n").agg(F.min("source").alias("_s"), F.count(F.lit(1)).alias("_size"))
    theirs = right.groupBy(*_REST, F.col("_n").alias("_m")).agg(F.min("target").alias("_t"))
    theirs = theirs.select(F.col("_key"), "_m", "_t")
    both = mine.join(theirs, "_key").withColumn("_alone", F.col("_size") == 1)
    rest = F.when(~F.col("_alone"), F.struct(*_REST))
    largest = F.struct("_n", *_REST, "_m")
    kept = both.groupBy("_s", "_t", "_alone", rest.alias("_rest")).agg(F.max(largest).alias("_at"))
    return kept.select("_s", "_t", "_alone", "_at.*")


def _rated(pairs: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """The strength of each pair of rests: the weight of the values that both have."""
    own = left.select(F.col("source").alias("_s"), F.col("_key").alias("_value"), F.col("_n").alias("_i"), "_w")
    other = right.select(F.col("target").alias("_t"), F.col("_key").alias("_value"), F.col("_n").alias("_j"))
    of_source = pairs.join(own, "_s").filter(F.col("_i") <= F.col("_n"))
    shared = of_source.join(other, ["_t", "_value"]).filter(F.col("_j") <= F.col("_m"))
    return shared.groupBy("_s", "_t", "_alone", *_REST).agg(F.sum("_w").alias("strength"))


def _per_source(rests: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """The strongest target that each source has through the given rests."""
    rated = cut(_rated(cut(_pairs(rests, right)), left, right))
    order = [F.desc("strength"), F.asc("target")]
    alone = rated.filter("_alone").select(F.col("_s").alias("source"), F.col("_t").alias("target"), "strength")
    shared = rated.filter(~F.col("_alone")).select(*_REST, F.col("_t").alias("target"), "strength")
    of_members = rests.select("source", *_REST).join(first_per_key(shared, _REST, order), _REST)
    return first_per_key(alone.unionByName(of_members.select("source", "target", "strength")), ["source"], order)


def _packer(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Packs so many members with their values into a row."""
    for batch in batches:
        for start in range(0, batch.num_rows, size):
            some = batch.slice(start, size)
            counts = pc.list_value_length(some.column("v")).to_numpy(zero_copy_only=False).astype(np.int32)
            v, w = some.column("v").flatten().to_numpy(), some.column("w").flatten().to_numpy()
            apart = np.diff(v, prepend=np.int32(0))
            first = (np.cumsum(counts) - counts)[counts > 0]
            apart[first] = v[first]
            packed = [[pa.compress(_planes(x), "zstd", asbytes=True)] for x in (counts, apart, w)]
            members = pa.ListArray.from_arrays(pa.array([0, some.num_rows], pa.int32()), some.column(0))
            sizes = [[len(x)] for x in (counts, v, w)]
            yield pa.RecordBatch.from_arrays(
                [members, *map(pa.array, sizes), *(pa.array(x, pa.binary()) for x in packed)],
                names=["members", "n", "cells", "weighted", "counts", "v", "w"])


def _members(rows: DataFrame, member: str, values: DataFrame, plain: bool, size: int, in_order: bool) -> DataFrame:
    """Members of a side, packed with the numbers of their values in order and, unless all are 1, their weights."""
    cell = F.struct(F.col("_number").cast("int").alias("v"), *([] if plain else ["_w"]))
    lists = rows.join(values, "_key").groupBy(member).agg(F.sort_array(F.collect_list(cell)).alias("_cells"))
    weights = F.array().cast("array<bigint>") if plain else F.col("_cells._w")
    lists = lists.select(member, F.col("_cells.v").alias("v"), weights.alias("w"))
    lists = lists.orderBy(member) if in_order else lists
    kind = rows.schema[member].dataType.simpleString()
    packed = lists.mapInArrow(
        lambda batches: _packer(batches, size),
        f"members array<{kind}>, n bigint, cells bigint, weighted bigint, counts binary, v binary, w binary")
    return cut(packed).withColumn("at", F.monotonically_increasing_id())


def _unpacked(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Values per member, values and weights of a packed row; no weights stand for ones."""
    shapes = (("counts", "n", np.int32), ("v", "cells", np.int32), ("w", "weighted", np.int64))
    counts, apart, w = (
        _numbers(pa.decompress(row[c], row[size] * np.dtype(kind).itemsize, "zstd", asbytes=True), kind) for c, size, kind in shapes)
    upto, first = np.cumsum(apart, dtype=np.int64), np.cumsum(counts) - counts
    some = counts > 0
    return counts, upto - np.repeat(upto[first[some]] - apart[first[some]], counts[some]), w


class _Targets:
    """The targets of a block: a row of bits for each frequent value, a list of targets for each other one."""

    def __init__(self, rows: list[dict], asked: np.ndarray, values: int, often: int):
        kept = [_unpacked(r)[:2] for r in rows]
        sizes = [-(-len(counts) // 8) * 8 for counts, _ in kept]
        starts = np.cumsum([0, *sizes])
        having = sum((np.bincount(v, minlength=len(asked)) for _, v in kept), np.zeros(len(asked), np.int64))
        frequent = np.flatnonzero((having > 0) & (having * values >= starts[-1]) & (having * asked >= often))
        self.row = np.full(len(asked), -1)
        self.row[frequent] = np.arange(len(frequent))
        # The last row has no bits.
        bits = np.zeros((len(frequent) + 1, -(-int(starts[-1]) // 64) * 8), np.uint8)
        rare = [], []
        for (counts, v), size, start in zip(kept, sizes, starts):
            at, row = np.repeat(np.arange(len(counts)), counts), self.row[v]
            some = row >= 0
            there = np.zeros((len(frequent), size), bool)
            there[row[some], at[some]] = True
            bits[:-1, start // 8:(start + size) // 8] = np.packbits(there, axis=1, bitorder="little")
            some = ~some & (asked[v] > 0)
            rare[0].append(v[some].astype(np.int32))
            rare[1].append((start + at[some]).astype(np.int32))
        self.bits = bits.view("<u8")
        v, at = (np.concatenate(x) for x in rare)
        order = np.argsort(v, kind="stable")
        self.at = at[order]
        # Only the values that some targets have, as there may be many.
        self.rare, ends = np.unique(v[order], return_index=True)
        self.ends = np.append(ends, len(v))
        # Where a target of the block, in order, has its bit.
        self.names = np.concatenate([np.arange(len(counts)) + start for (counts, _), start in zip(kept, starts)])

    def best(self, counts: np.ndarray, v: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The place of the first of the strongest targets of each source, and its strength; 0 if there is none."""
        n, row, member = len(counts), self.row[v], np.repeat(np.arange(len(counts)), counts)
        starts = np.cumsum(counts) - counts
        levels = []
        for level in range(int(w.max()).bit_length() if len(w) else 1):
            some = np.flatnonzero((row >= 0) & (w >> level & 1 == 1) if len(w) else row >= 0)
            have = np.bincount(member[some], minlength=n)
            rows = np.full((n, have.max(initial=0)), len(self.bits) - 1)
            rows[member[some], np.arange(len(some)) - (np.cumsum(have) - have)[member[some]]] = row[some]
            levels.append((have, rows))
        few = np.flatnonzero(row < 0) if len(self.rare) else np.zeros(0, int)
        few = few[self.rare[np.minimum(np.searchsorted(self.rare, v[few]), len(self.rare) - 1)] == v[few]] if len(few) else few
        few_of = dict(zip(*np.unique(member[few], return_index=True))) if len(few) else {}
        place, strength = np.full(n, -1), np.zeros(n, np.int64)
        order, at_once = np.argsort(counts, kind="stable"), max(1, WORDS // max(1, self.bits.shape[1]))
        for start in range(0, n, at_once):
            some = order[start:start + at_once]
            sums = self._sums([(rows[some], int(have[some].max(initial=0))) for have, rows in levels])
            place[some], strength[some] = self._first(sums, len(some))
            for k, source in enumerate(some.tolist()):
                if source in few_of:
                    cells = few[few_of[source]:]
                    cells = cells[:np.searchsorted(cells, starts[source] + counts[source])]
                    found = self._with_few(v[cells], w[cells] if len(w) else None, [x if x is None else x[k] for x in sums])
                    if (-found[1], found[0]) < (-strength[source], place[source]):
                        place[source], strength[source] = found
        return place, strength

    def _sums(self, levels: list[tuple[np.ndarray, int]]) -> list[np.ndarray | None]:
        """Adds up rows of bits per source; the sums of all places come as a row of bits per binary digit."""
        sums, carried = [], []
        while levels or carried:
            rows, upto = levels.pop(0) if levels else (None, 0)
            # A digit's rows are fetched when their turn comes.
            waiting = chain(carried, (self.bits[rows[:, k]] for k in range(upto)))
            one, carried = next(waiting, None), []
            for x in waiting:
                both = one & x
                one = one ^ x
                if (y := next(waiting, None)) is not None:
                    both |= one & y
                    one ^= y
                carried.append(both)
            sums.append(one)
        return sums

    def _first(self, sums: list[np.ndarray | None], n: int) -> tuple[np.ndarray, np.ndarray]:
        """Where the largest sum is first, and the sum."""
        found, strength = np.full((n, self.bits.shape[1]), ~np.uint64(0)), np.zeros(n, np.int64)
        for level in range(len(sums) - 1, -1, -1):
            if sums[level] is not None:
                some = found & sums[level]
                there = some.any(axis=1)
                found[there] = some[there]
                strength += there.astype(np.int64) << level
        word = (found != 0).argmax(axis=1)
        bits = found[np.arange(n), word]
        place = 64 * word + np.log2(bits & (~bits + np.uint64(1))).astype(np.int64)
        return np.where(strength > 0, place, -1), strength

    def _with_few(self, v: np.ndarray, w: np.ndarray | None, sums: list[np.ndarray | None]) -> tuple[int, int]:
        """The same among the targets that have one of these values, which have no row of bits."""
        lists = [self.at[self.ends[x]:self.ends[x + 1]] for x in np.searchsorted(self.rare, v)]
        at, inverse = np.unique(np.concatenate(lists), return_inverse=True)
        total = np.zeros(len(at), np.int64)
        np.add.at(total, inverse, np.repeat(np.ones(len(v), np.int64) if w is None else w, list(map(len, lists))))
        for level, x in enumerate(sums):
            if x is not None:
                total += (x[at >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1)).astype(np.int64) << level
        k = int(total.argmax())
        return int(at[k]), int(total[k])


def _strongest(values_: int, bits_of: int, often: int, source: pa.DataType, target: pa.DataType):
    """Compares a block of sources with a block of targets; the best target of each source."""
    kinds = pa.schema([("source", source), ("target", target), ("strength", pa.int64())])

    def compare(a: pa.Table, b: pa.Table) -> pa.Table:
        if not (a.num_rows and b.num_rows):
            return kinds.empty_table()
        packed = ["at", "n", "cells", "weighted", "counts", "v", "w"]
        b = b.sort_by("at")
        sources, targets = (x.select(packed).to_pylist() for x in (a, b))
        asked = np.zeros(values_, np.int64)
        for row in sources:
            asked += np.bincount(_unpacked(row)[1], minlength=values_)
        block = _Targets(targets, asked, bits_of, often)
        place, strength = (np.concatenate(x) for x in zip(*(block.best(*_unpacked(row)) for row in sources)))
        some = np.flatnonzero(strength > 0)
        names = [x.column("members").combine_chunks().flatten() for x in (a, b)]
        return pa.Table.from_arrays([
            names[0].take(pa.array(some)), names[1].take(pa.array(np.searchsorted(block.names, place[some]))), pa.array(strength[some])],
            schema=kinds)

    return compare


def _by_blocks(left: DataFrame, right: DataFrame, frequency: DataFrame, plain: bool) -> DataFrame:
    """The strongest target of each source, from all pairs of blocks."""
    spark = left.sparkSession
    values = stored(dense_numbers(frequency, "_key", "_number"), "values")
    mine = _members(left, "source", values, plain, SLICE, False)
    theirs = _members(right, "target", values, True, SLICE, True)
    n, m, cells, count = (int(x or 0) for x in (
        mine.agg(F.sum("n")).first()[0], *theirs.agg(F.sum("n"), F.sum("cells")).first(), values.count()))
    target_blocks = max(1, -(-m // TARGET_BLOCK), -(-cells // CELLS))
    source_blocks = max(1, -(-n // SOURCE_BLOCK), -(-4 * spark.sparkContext.defaultParallelism // target_blocks))

    def dealt(rows: DataFrame, own: str, blocks: int, other: str, others: int) -> DataFrame:
        block = F.pmod(F.xxhash64("at"), F.lit(blocks)).cast("int").alias(own)
        return rows.select("*", block, F.explode(F.sequence(F.lit(0), F.lit(others - 1))).alias(other))

    a = dealt(mine, "i", source_blocks, "j", target_blocks).groupBy("i", "j")
    b = dealt(theirs, "j", target_blocks, "i", source_blocks).groupBy("i", "j")
    kinds = [rows.schema[c].dataType for rows, c in ((left, "source"), (right, "target"))]
    found = a.cogroup(b).applyInArrow(
        _strongest(count, VALUES, OFTEN, *map(to_arrow_type, kinds)),
        f"source {kinds[0].simpleString()}, target {kinds[1].simpleString()}, strength bigint")
    return first_per_key(found, ["source"], [F.desc("strength"), F.asc("target")])


@freeing
def best_shared(
    sources: DataFrame, targets: DataFrame, source: str, target: str, key: str, weight: str | None = None
) -> DataFrame:
    """Per source the target sharing most values of `key`; columns source, target, strength.

    Both inputs hold distinct (member, key) rows without nulls. With `weight`, a shared value
    counts as much as the source row says; weights are not negative.
    """
    w = F.lit(1).cast("bigint") if weight is None else F.col(weight).cast("bigint")
    sources = sources.select(F.col(source).alias("source"), F.col(key).alias("_key"), w.alias("_w")).dropna(subset=["source"])
    targets = targets.select(F.col(target).alias("target"), F.col(key).alias("_key"), F.lit(1).cast("bigint").alias("_w")).dropna(subset=["target"])

    # Written, as they are read several times and what they were made from need not lie on disk beside it.
    sources, targets = stored(sources, "sources"), stored(targets, "targets")
    # Values that only one side has say nothing.
    frequency = targets.groupBy("_key").agg(F.count(F.lit(1)).alias("_f"))
    frequency = cut(frequency.join(sources.groupBy("_key").agg(F.count(F.lit(1)).alias("_g")), "_key"))
    ordered = _ordered(sources, "source", frequency), _ordered(targets, "target", frequency)
    left, right = _rests(ordered[0], "source", ["_key", "_w"]), _rests(ordered[1], "target", ["_key"])

    # Pairs of members are no fewer than pairs of rests; rests are looked at only if that does not say enough.
    rows, pairs = frequency.agg(F.sum(F.col("_f") + F.col("_g")), F.sum(F.col("_f").cast("double") * F.col("_g"))).first()
    longest = ordered[0].groupBy("source").agg(F.count(F.lit(1)).alias("_n")).agg(F.max("_n")).first()[0]
    if pairs and pairs * longest > HEAVY * rows:
        rest = F.approx_count_distinct(F.xxhash64("_d1", "_d2"))
        of_source = left.groupBy("_key").agg(
            (rest * F.avg("_n")).alias("_l"), F.min("_w").alias("_least"), F.max("_w").alias("_most"), F.max("_bound").alias("_bound"))
        of_target = right.groupBy("_key").agg(rest.alias("_r"))
        rated, least, most, bound = of_source.join(of_target, "_key").agg(
            F.sum(F.col("_l") * F.col("_r")), F.min("_least"), F.max("_most"), F.max("_bound")).first()
        if rated > HEAVY * rows and least > 0 and bound < 1 << 53:
            best = _by_blocks(*ordered, frequency, least == most == 1)
            return best.select(F.col("source").alias(source), F.col("target").alias(target), "strength")

    left, right = cut(left), cut(right)
    whole = left.groupBy("source").agg(F.max("_n").alias("_n"))
    first = cut(_per_source(left.join(whole, ["source", "_n"], "left_semi"), left, right))
    found = first.select("source", F.col("strength").alias("_least"))
    open_ = left.join(whole, ["source", "_n"], "left_anti").join(found, "source")
    # A rest of equal weight can still hold a smaller target.
    second = _per_source(cut(open_.filter(F.col("_bound") >= F.col("_least")).drop("_least")), left, right)
    best = first_per_key(first.unionByName(second), ["source"], [F.desc("strength"), F.asc("target")])
    return best.select(F.col("source").alias(source), F.col("target").alias(target), "strength")
