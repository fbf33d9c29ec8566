"""Jaccard self-join of word shingle sets by PartEnum signatures.

Sets are joined if their similarity is at least `threshold`. The signatures make two similar
sets share at least one value, for certain:

* Sizes are cut into bands so that a set and a larger similar one are in the same band or in
  neighbouring ones. Scheme i serves all pairs whose smaller set is in band i.
* Two similar sets of sizes n and m differ in at most (n + m) (1 - t) / (1 + t) elements. The
  scheme cuts the domain of elements into more parts than that; a differing element spoils
  one part, so some part is equal in both. One signature per part, of the elements in it.
  This is the enumeration with subsets of one part each, which has the fewest signatures.
* Parts with one element or none, or with frequent elements only, say little and are left out,
  as long as the set has more telling parts than it can differ in elements: one of them is
  then unspoiled. A set with too few telling parts also gives signatures of its non-empty parts
  of a finer cut, and, if those are too few as well, one per element. Of two similar sets, the
  one that stops first has an unspoiled part at a level at which the other one gives
  signatures too. Whether a part is telling follows from its elements alone, so it is the same
  in both sets. Which elements are frequent is estimated from a bounded sample of texts; that
  changes how many pairs are compared, never which are found.

Texts are read once; their sets are stored as packed arrays of 48-bit hashes. Signatures and sets
travel as packed arrays, one row per block of texts and bucket of values.
Equal sets are one node of the join. In a group of sets that share a signature, all are
compared with one of them; further pairs of the group are compared only between parts of it
that links found so far do not connect.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.graph import components
from tidemark.llm.words import from_planes, mix, planes, shingle_sets
from tidemark.session import stored

_U = np.uint64
NONE = np.zeros(0, dtype=np.uint64)
SIGNATURE_BYTES = 5
ELEMENT_BYTES = 6
# Signatures in a bucket, which one task holds; texts and signatures in a block of a task.
BUCKET_SIGNATURES = 1_500_000
BLOCK_TEXTS = 4096
BLOCK_SIGNATURES = 1_000_000
# Texts, about, in which elements are counted, and how many of them make an element frequent.
SAMPLE_TEXTS = 20_000
FREQUENT = 3
# Bins of a sketch per element, and members of a group in a block that one task compares.
SKETCH = 6
GROUP_BLOCK = 2048
# Groups of so many members at most give their pairs away; the number is linear in members.
SMALL_GROUP = 32
# Members of a group in one row.
GROUP_ROW = 4096
# Slots of the filter that says which texts are worth reading again.
FILTER_BITS = 23


@dataclass(frozen=True)
class Bands:
    """Size bands and bounds of a threshold."""

    threshold: Fraction

    @lru_cache(maxsize=None)  # noqa: B019
    def edges(self, upto: int) -> tuple[tuple[int, int], ...]:
        out, low = [], 1
        while low <= upto:
            high = int(low / self.threshold)
            out.append((low, high))
            low = high + 1
        return tuple(out)

    def of(self, n: int) -> tuple[int, int, int]:
        """(number, smallest, largest size) of the band of n."""
        bound = 64
        while bound < n:
            bound *= 2
        for i, (low, high) in enumerate(self.edges(bound)):
            if n <= high:
                return i, low, high
        raise AssertionError

    def difference(self, n: int, m: int) -> int:
        """Elements in which similar sets of sizes n and m differ at most."""
        t = self.threshold
        return int((n + m) * (1 - t) / (1 + t))

    @lru_cache(maxsize=1 << 16)  # noqa: B019
    def schemes(self, n: int) -> tuple[tuple[int, int, int], ...]:
        """(scheme, largest size of its band, elements to differ in) that a set of size n takes part in."""
        i, low, high = self.of(n)
        out = [(i, high, self.difference(n, int(n / self.threshold)))]
        if i and low - 1 >= n * self.threshold:
            out.append((i - 1, low - 1, self.difference(n, low - 1)))
        return tuple(s for s in out if s[2] > 0)  # a set that differs in none is the same node


def part_signatures(
    elements: np.ndarray, spread: np.ndarray, parts: int, salt: int, rare: np.ndarray | None = None
) -> np.ndarray:
    """Signatures of parts, which are ranges of hashes.

    With `rare`, which marks elements, only parts of two or more of which one is rare.
    """
    part = ((elements >> _U(32)) * _U(parts)) >> _U(32)
    starts = np.concatenate(([0], np.flatnonzero(part[1:] != part[:-1]) + 1))
    sums = np.add.reduceat(spread, starts)
    full = np.ones(len(starts), dtype=bool)
    if rare is not None:
        full = (np.diff(np.append(starts, len(elements))) > 1) & (np.add.reduceat(rare, starts) > 0)
    with np.errstate(over="ignore"):
        return mix(sums[full] ^ mix(part[starts[full]] + _U(salt) * _U(0x9E3779B97F4A7C15)))


def signatures(elements: np.ndarray, bands: Bands, frequent: np.ndarray = NONE) -> np.ndarray:
    """All signatures of a set, given as sorted hashes of its elements; so are frequent ones."""
    if not len(elements):
        return elements
    out, spread = [], mix(elements)
    rare = np.ones(len(elements), dtype=np.int64)
    if len(frequent):
        at = np.minimum(np.searchsorted(frequent, elements), len(frequent) - 1)
        rare = (frequent[at] != elements).astype(np.int64)
    for scheme, high, differ in bands.schemes(len(elements)):
        coarse = part_signatures(elements, spread, max(2, -(-high * 4 // 11)), 4 * scheme + 1, rare)
        out.append(coarse)
        if len(coarse) > differ:
            continue
        fine = part_signatures(elements, spread, max(2, -(-high * 5 // 11)), 4 * scheme + 2)
        out.append(fine)
        if len(fine) > differ:
            continue
        out.append(mix(spread ^ mix(np.full(1, 4 * scheme + 3, dtype=np.uint64))))
    return np.concatenate(out) if out else elements[:0]


def node_of(elements: np.ndarray) -> tuple[int, int]:
    """Two independent 63-bit names of a set. The first is its node in the join."""
    with np.errstate(over="ignore"):
        a = int(mix(elements ^ _U(0xD1B54A32D192ED03)).sum(dtype=np.uint64))
        b = int(mix(elements ^ _U(0x8CB92BA72F3D8DD7)).sum(dtype=np.uint64))
    last = mix(np.array([a, b], dtype=np.uint64) + _U(len(elements)))
    return int(last[0] >> _U(1)), int(last[1] >> _U(1))


def _described(batches: Iterator[pa.RecordBatch], shingle: int):
    """(doc_id, elements) of every text, over pieces of a batch that are not too large."""
    for batch in batches:
        for at in range(0, batch.num_rows, 1024):
            piece = batch.slice(at, 1024)
            yield from zip(piece["doc_id"].to_pylist(), shingle_sets(piece["text"], shingle))


def _sets(batches: Iterator[pa.RecordBatch]):
    """(node, elements) of the described texts that have a set; elements keep their upper bits."""
    for batch in batches:
        for node, packed in zip(batch["node"].to_pylist(), batch["elements"]):
            if node is not None:
                yield node, from_planes(packed.as_buffer(), ELEMENT_BYTES) << _U(64 - 8 * ELEMENT_BYTES)


def describe(docs: DataFrame, shingle: int) -> DataFrame:
    """doc_id, n_shingles, node, a second name and the packed elements of every text's set.

    Texts are read and cut into words here only. Nodes are null for empty sets.
    """
    schema = pa.schema([*((c, pa.int64()) for c in ("doc_id", "n_shingles", "node", "second")), ("elements", pa.binary())])

    def run(batches):
        held, size = [], 0
        for doc_id, elements in _described(batches, shingle):
            names = node_of(elements) if len(elements) else (None, None)
            held.append((doc_id, len(elements), *names, planes(elements >> _U(64 - 8 * ELEMENT_BYTES), ELEMENT_BYTES)))
            size += len(held[-1][-1])
            if len(held) == BLOCK_TEXTS or size > 8 << 20:
                yield _record(held)
                held, size = [], 0
        if held:
            yield _record(held)

    def _record(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)

    return docs.mapInArrow(run, "doc_id long, n_shingles long, node long, second long, elements binary")


def frequent_elements(info: DataFrame, texts: int, sample: int = SAMPLE_TEXTS) -> np.ndarray:
    """Sorted elements that FREQUENT or more sets of a sample have.

    `texts` is the number of texts. The sample has about `sample` of them by hash of the doc_id,
    so what reaches the driver is bounded by their elements.
    """
    part = -(-texts // sample) if texts else 1
    chosen = info.filter(F.pmod(F.xxhash64("doc_id"), F.lit(part)) == 0).select("node", "elements")

    def run(batches):
        held, size, seen = [], 0, set()

        def flush():
            elements = np.sort(np.concatenate(held))
            bucket = (elements >> _U(58)).astype(np.int64)
            starts = np.concatenate(([0], np.flatnonzero(np.diff(bucket)) + 1, [len(elements)]))
            rows = [planes(elements[a:b], 8) for a, b in zip(starts[:-1].tolist(), starts[1:].tolist())]
            return pa.RecordBatch.from_arrays(
                [pa.array(bucket[starts[:-1]].astype(np.int32)), pa.array(rows, pa.binary())], names=["bucket", "elements"]
            )

        for node, elements in _sets(batches):
            if node not in seen:
                seen.add(node)
                held.append(elements)
                size += len(elements)
            if size > BLOCK_SIGNATURES:
                yield flush()
                held, size, seen = [], 0, set()
        if held:
            yield flush()

    def count(table):
        values = np.sort(np.concatenate([from_planes(x, 8) for x in table["elements"].to_pylist()]))
        starts = np.concatenate(([0], np.flatnonzero(values[1:] != values[:-1]) + 1))
        often = np.diff(np.append(starts, len(values))) >= FREQUENT
        return pa.table([pa.array([planes(values[starts[often]], 8)], pa.binary())], names=["elements"])

    packed = chosen.mapInArrow(run, "bucket int, elements binary")
    found = packed.groupBy("bucket").applyInArrow(count, "elements binary").toArrow()["elements"].to_pylist()
    return np.sort(np.concatenate([NONE, *[from_planes(x, 8) for x in found]]))


def _blocks(info: DataFrame, bands: Bands, bucket_bits: int, frequent: np.ndarray) -> DataFrame:
    """Rows of packed signatures: bucket, signatures, place of each one's node, nodes."""
    names = ["bucket", "signatures", "places", "nodes"]
    known = info.sparkSession.sparkContext.broadcast(frequent)

    def run(batches):
        found, nodes, seen, n = [], [], set(), 0

        def flush():
            sizes = [len(s) for s in found]
            sig = np.concatenate(found)
            place = np.repeat(np.arange(len(found), dtype=np.uint16), sizes)
            order = np.argsort(sig, kind="stable")
            sig, place = sig[order], place[order]
            bucket = (sig >> _U(64 - bucket_bits)).astype(np.int64) if bucket_bits else np.zeros(len(sig), np.int64)
            starts = np.concatenate(([0], np.flatnonzero(bucket[1:] != bucket[:-1]) + 1, [len(sig)]))
            low = sig >> _U(64 - bucket_bits - 8 * SIGNATURE_BYTES)
            all_nodes = np.array(nodes, dtype=np.int64)
            rows = []
            for a, b in zip(starts[:-1].tolist(), starts[1:].tolist()):
                used, at = np.unique(place[a:b], return_inverse=True)
                rows.append((
                    int(bucket[a]), planes(low[a:b], SIGNATURE_BYTES),
                    planes(at.astype(np.uint64), 2), all_nodes[used].tobytes(),
                ))
            return pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*rows), [pa.int32(), pa.binary(), pa.binary(), pa.binary()])],
                names=names,
            )

        for node, elements in _sets(batches):
            if node in seen:
                continue
            seen.add(node)
            sig = signatures(elements, bands, known.value)
            if not len(sig):
                continue
            found.append(sig)
            nodes.append(node)
            n += len(sig)
            if n >= BLOCK_SIGNATURES or len(found) == BLOCK_TEXTS:
                yield flush()
                found, nodes, seen, n = [], [], set(), 0
        if found:
            yield flush()

    return info.select("node", "elements").mapInArrow(run, "bucket int, signatures binary, places binary, nodes binary")


def _groups(blocks: DataFrame) -> DataFrame:
    """What the signatures of a bucket say: pairs (a, b, votes) of a group's first member with
    the others, and rows (a, members) with the members of every group of three or more."""

    def run(table):
        sig, node = [], []
        for s, p, n in zip(*(table[c].to_pylist() for c in ("signatures", "places", "nodes"))):
            sig.append(from_planes(s, SIGNATURE_BYTES))
            node.append(np.frombuffer(n, dtype=np.int64)[from_planes(p, 2).astype(np.int64)])
        sig, node = np.concatenate(sig), np.concatenate(node)
        order = np.lexsort((node, sig))
        sig, node = sig[order], node[order]
        new = np.concatenate(([True], (sig[1:] != sig[:-1]) | (node[1:] != node[:-1])))
        sig, node = sig[new], node[new]
        first = np.concatenate(([True], sig[1:] != sig[:-1]))
        starts = np.flatnonzero(first)
        sizes = np.diff(np.append(starts, len(sig)))
        shared = np.repeat(sizes > 1, sizes)
        center = np.repeat(node[starts], sizes)
        other = shared & ~first
        a, b, votes = _counted(center[other], node[other])
        heads = [(int(x), int(y), int(v), None, None) for x, y, v in zip(a, b, votes)]
        large = np.flatnonzero(sizes > 2)
        if len(large):
            # Groups with the same members count once.
            with np.errstate(over="ignore"):
                sums = np.add.reduceat(mix(node.astype(np.uint64)), starts)[large]
            _, once = np.unique(np.stack([node[starts[large]].astype(np.uint64), sums]), axis=1, return_index=True)
            for g in large[once].tolist():
                members = node[starts[g] : starts[g] + sizes[g]]
                name = int(mix(sig[starts[g] : starts[g] + 1] + _U(table["bucket"][0].as_py() << 45))[0] >> _U(1))
                for at in range(0, len(members), GROUP_ROW):
                    heads.append((int(members[0]), None, None, name, members[at : at + GROUP_ROW].tolist()))
        columns = list(zip(*heads)) or [[]] * 5
        types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64())]
        return pa.table(
            [pa.array(c, t) for c, t in zip(columns, types)], names=["a", "b", "votes", "group", "members"]
        )

    return blocks.groupBy("bucket").applyInArrow(
        run, "a long, b long, votes long, group long, members array<long>"
    )


def _counted(a: np.ndarray, b: np.ndarray):
    if not len(a):
        return a, b, a
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    starts = np.concatenate(([0], np.flatnonzero((a[1:] != a[:-1]) | (b[1:] != b[:-1])) + 1))
    return a[starts], b[starts], np.diff(np.append(starts, len(a)))


def _worth_reading(ids: DataFrame) -> bytes:
    """A bit per slot of hashed doc_ids: 2^FILTER_BITS bits, whatever the number of ids."""
    slot = F.pmod(F.xxhash64("doc_id"), F.lit(1 << FILTER_BITS))
    words = (
        ids.select(F.shiftright(slot, 6).alias("w"), slot.bitwiseAND(F.lit(63)).cast("int").alias("bit"))
        .groupBy("w")
        .agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("bit"))).alias("bits"))
        .toPandas()
    )
    field = np.zeros(1 << (FILTER_BITS - 6), dtype=np.int64)
    field[words["w"].to_numpy(dtype=np.int64)] = words["bits"].to_numpy(dtype=np.int64)
    return field.tobytes()


def _packed_sets(info: DataFrame, ids: DataFrame) -> DataFrame:
    """(node, elements) of the texts whose doc_id is in `ids`, and of few others."""
    bits = info.sparkSession.sparkContext.broadcast(_worth_reading(ids))
    slots = info.filter(F.col("node").isNotNull()).select(
        "node", "elements", F.pmod(F.xxhash64("doc_id"), F.lit(1 << FILTER_BITS)).alias("_slot")
    )

    def run(batches):
        field = np.frombuffer(bits.value, dtype=np.int64)
        for batch in batches:
            slot = batch["_slot"].to_numpy()
            hit = (field[slot >> 6] >> (slot & 63)) & 1
            if hit.any():
                yield batch.select(["node", "elements"]).filter(pa.array(hit.astype(bool)))

    return slots.mapInArrow(run, "node long, elements binary").distinct()


def _linked(pairs: DataFrame, sets: DataFrame, threshold: Fraction) -> DataFrame:
    """The pairs (a, b) with a flag `linked`, by the exact similarity of their sets."""
    up, down = threshold.numerator, threshold.denominator
    with_b = pairs.join(sets.select(F.col("node").alias("b"), F.col("elements").alias("eb")), "b")
    with_both = with_b.join(sets.select(F.col("node").alias("a"), F.col("elements").alias("ea")), "a")

    def run(batches):
        for batch in batches:
            linked = []
            held, left = None, None
            for a, ea, eb in zip(batch["a"].to_pylist(), batch["ea"], batch["eb"]):
                if a != held:
                    held, left = a, from_planes(ea.as_py(), ELEMENT_BYTES)
                right = from_planes(eb.as_py(), ELEMENT_BYTES)
                both = len(np.intersect1d(left, right, assume_unique=True))
                linked.append(down * both >= up * (len(left) + len(right) - both))
            yield pa.RecordBatch.from_arrays(
                [batch["a"], batch["b"], pa.array(linked, pa.bool_())], names=["a", "b", "linked"]
            )

    return with_both.select("a", "b", "ea", "eb").mapInArrow(run, "a long, b long, linked boolean")


def _apart(pairs: DataFrame, parts: DataFrame) -> DataFrame:
    """The pairs whose ends no link connects so far."""
    a = parts.select(F.col("node").alias("a"), F.col("component").alias("_pa"))
    b = parts.select(F.col("node").alias("b"), F.col("component").alias("_pb"))
    joined = pairs.join(a, "a", "left").join(b, "b", "left")
    return joined.filter(
        F.coalesce("_pa", "a") != F.coalesce("_pb", "b")
    ).drop("_pa", "_pb")


def jaccard_components(docs: DataFrame, threshold: float = 0.8, shingle: int = 5) -> DataFrame:
    """Groups of texts that similar pairs connect: doc_id, n_shingles, component_id.

    component_id is the smallest doc_id of the group.

    Defined cases: a null or empty text, or one without words, has an empty set and is linked
    with nothing; a text of fewer words than a shingle is one shingle; equal rows are linked;
    a null doc_id is larger than all others; an empty table gives an empty result; other
    columns are ignored.
    """
    limit = Fraction(threshold).limit_denominator(1000)
    bands = Bands(limit)
    docs = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    info = stored(describe(docs, shingle), "partenum-sets")
    nodes = info.filter(F.col("node").isNotNull()).groupBy("node").agg(
        F.min("doc_id").alias("doc_id"), F.first("n_shingles").alias("n"),
        F.min("second").alias("_s"), F.max("second").alias("_t"),
    )
    nodes = stored(nodes, "partenum-nodes")
    totals = nodes.agg(F.sum("n").alias("n"), F.max(F.col("_s") != F.col("_t")).alias("clash")).first()
    if totals["clash"]:
        raise RuntimeError("two different sets have the same 63-bit name")

    buckets = max(
        int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")),
        int((totals["n"] or 0) * 0.6) // BUCKET_SIGNATURES,
    )
    bucket_bits = min(16, max(1, (buckets - 1).bit_length()))
    frequent = frequent_elements(info, info.count())
    found = stored(_groups(_blocks(info, bands, bucket_bits, frequent)), "partenum-groups")
    pairs = found.filter(F.col("b").isNotNull()).groupBy("a", "b").agg(F.sum("votes").alias("votes"))
    stars = stored(_sized(pairs, nodes, limit), "partenum-pairs")
    pairs = stars.filter("fits").drop("fits")
    ends = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    sets = stored(_packed_sets(info, nodes.join(ends, "node").select("doc_id")), "partenum-elements")

    # First the most promising pair of every set, then those that are still apart.
    best = pairs.groupBy("b").agg(F.max_by("a", F.struct("votes", "a")).alias("a"))
    checked = stored(_linked(best.select("a", "b"), sets, limit), "partenum-checked")
    parts = stored(components(checked.filter("linked"), "a", "b"), "partenum-parts")
    more = _apart(pairs.select("a", "b").join(checked, ["a", "b"], "left_anti"), parts)
    checked = stored(checked.unionByName(_linked(more, sets, limit)), "partenum-checked")
    parts = stored(components(checked.filter("linked"), "a", "b"), "partenum-parts")

    # Groups whose members links do not connect. A member whose size rules the first member out
    # may be in no pair so far; its set is read now.
    members = _split_groups(found, stars, parts, nodes)
    known = members.select("node").distinct()
    missing = known.join(sets.select("node"), "node", "left_anti").join(nodes, "node").select("doc_id")
    sets = sets.unionByName(stored(_packed_sets(info, missing), "partenum-elements"))
    sketches = stored(_sketches(sets.join(known, "node", "left_semi")), "partenum-sketches")
    small = _pairs_of_small_groups(members, limit).join(checked.select("a", "b"), ["a", "b"], "left_anti")
    large = _pairs_of_large_groups(members, sketches, limit).join(checked.select("a", "b"), ["a", "b"], "left_anti")
    rest = _left_open(stored(small, "partenum-small"), sketches, limit).unionByName(large)
    rest = stored(rest.distinct(), "partenum-rest")
    links = checked.unionByName(_linked(rest, sets, limit)).filter("linked")
    parts = components(links, "a", "b")

    named = nodes.select("node", "doc_id").join(parts, "node", "left")
    named = stored(named.withColumn("component", F.coalesce("component", "node")), "partenum-named")
    least = named.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    by_node = stored(named.join(least, "component").select("node", "component_id"), "partenum-by-node")
    return info.drop("second", "elements").join(by_node, "node", "left").select(
        "doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id")
    )


def _sized(pairs: DataFrame, nodes: DataFrame, threshold: Fraction) -> DataFrame:
    """The pairs with a flag `fits`: whether the sizes of the sets allow the similarity."""
    up, down = threshold.numerator, threshold.denominator
    sized = pairs.join(nodes.select(F.col("node").alias("a"), F.col("n").alias("_na")), "a").join(
        nodes.select(F.col("node").alias("b"), F.col("n").alias("_nb")), "b"
    )
    fits = F.least("_na", "_nb") * down >= F.greatest("_na", "_nb") * up
    return sized.withColumn("fits", fits).drop("_na", "_nb")


def sketch(elements: np.ndarray) -> np.ndarray:
    """Parities of the elements in bins, packed in words: at least SKETCH bins per element.

    Two sets differ in at least as many elements as their parities differ in bins. The number of
    bins is a power of two, and half as many follow from folding.
    """
    bins = 64
    while bins < SKETCH * len(elements):
        bins *= 2
    odd = np.bincount((mix(elements) & _U(bins - 1)).astype(np.int64), minlength=bins).astype(np.uint8) & np.uint8(1)
    return np.packbits(odd, bitorder="little").view(np.uint64)


def folded(words: np.ndarray, n: int) -> np.ndarray:
    """A sketch, or rows of sketches, with n words. Bin i folds onto bin i modulo the new number."""
    while words.shape[-1] > n:
        half = words.shape[-1] // 2
        words = words[..., :half] ^ words[..., half:]
    return words


def _split_groups(found, stars, parts, nodes) -> DataFrame:
    """Members of groups that links do not connect: group, node, component, n, size of the group.

    A group is split if its first member is apart from some other one. `stars` has all those
    pairs, also those that sizes rule out: the rest of such a group can be similar to each other.
    """
    split_at = _apart(stars.select("a", "b"), parts).select("a").distinct()
    members = (
        found.filter(F.col("members").isNotNull())
        .join(split_at, "a", "left_semi")
        .select("group", F.explode("members").alias("node"))
        .join(parts, "node", "left")
        .withColumn("component", F.coalesce("component", "node"))
    )
    members = stored(members, "partenum-members")
    split = members.groupBy("group").agg(
        F.min("component").alias("_l"), F.max("component").alias("_h"), F.count(F.lit(1)).alias("_n")
    )
    split = split.filter(F.col("_l") != F.col("_h")).select("group", "_n")
    return stored(members.join(split, "group").join(nodes.select("node", "n"), "node"), "partenum-members")


def _pairs_of_small_groups(members, threshold) -> DataFrame:
    """Pairs (a, b) of sets of similar size that are apart, of groups up to SMALL_GROUP members."""
    up, down = threshold.numerator, threshold.denominator
    lists = (
        members.filter(F.col("_n") <= SMALL_GROUP).groupBy("group")
        .agg(F.collect_list(F.struct("node", "component", "n")).alias("all"))
    )

    def partners(x):
        fits = lambda y: (
            (x["node"] < y["node"]) & (x["component"] != y["component"])
            & (F.least(x["n"], y["n"]) * down >= F.greatest(x["n"], y["n"]) * up)
        )
        return F.transform(F.filter("all", fits), lambda y: F.struct(x["node"].alias("a"), y["node"].alias("b")))

    pairs = lists.select(F.explode(F.flatten(F.transform("all", partners))).alias("pair"))
    return pairs.select("pair.a", "pair.b").distinct()


def _left_open(pairs, sketches, threshold) -> DataFrame:
    """The pairs that sizes and sketches do not rule out."""
    up, down = threshold.numerator, threshold.denominator
    with_b = pairs.join(sketches.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("sketch").alias("sb")), "b")
    with_both = with_b.join(
        sketches.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("sketch").alias("sa")), "a"
    )

    def run(batches):
        for batch in batches:
            open_ = []
            for na, nb, sa, sb in zip(batch["na"].to_pylist(), batch["nb"].to_pylist(), batch["sa"], batch["sb"]):
                x, y = (np.frombuffer(s.as_buffer(), dtype=np.uint64) for s in (sa, sb))
                words = min(len(x), len(y))
                apart = int(np.bitwise_count(folded(x, words) ^ folded(y, words)).sum())
                open_.append(apart * (up + down) <= (na + nb) * (down - up))
            yield pa.RecordBatch.from_arrays([batch["a"], batch["b"]], names=["a", "b"]).filter(pa.array(open_, pa.bool_()))

    return with_both.select("a", "b", "na", "nb", "sa", "sb").mapInArrow(run, "a long, b long")


def _pairs_of_large_groups(members, sketches, threshold) -> DataFrame:
    """The same of larger groups: pairs that sizes and sketches do not rule out.

    A task holds two blocks of members of a group and compares them. It returns a pair in one
    of the groups only that both sets are in.
    """
    members = members.filter(F.col("_n") > SMALL_GROUP)
    # Every member with its sketch and the groups it is in, so that a pair is returned once.
    own = members.groupBy("node").agg(F.first("component").alias("component"), F.collect_set("group").alias("groups"))
    own = own.join(sketches, "node")
    blocks = F.ceil(F.col("_n") / F.lit(GROUP_BLOCK)).cast("int")
    placed = members.select("group", "node", blocks.alias("_blocks")).withColumn(
        "_block", F.pmod(F.xxhash64("node"), F.col("_blocks")).cast("int")
    )
    # Blocks i <= j meet at (i, j): a member of block k goes to all (k, j) and (i, k).
    meets = F.transform(
        F.sequence(F.lit(0), F.col("_blocks") - 1),
        lambda other: F.struct(F.least(other, F.col("_block")).alias("i"), F.greatest(other, F.col("_block")).alias("j")),
    )
    placed = placed.withColumn("_meets", F.explode(meets)).join(own, "node")
    up, down = threshold.numerator, threshold.denominator

    def compare(table):
        columns = {c: table[c].to_pylist() for c in ("node", "component", "n", "groups", "sketch", "_block")}
        group = table["group"][0].as_py()
        i, j = table["_meets"][0].as_py()["i"], table["_meets"][0].as_py()["j"]
        node, component, n = (np.array(columns[c], dtype=np.int64) for c in ("node", "component", "n"))
        groups, block = columns["groups"], np.array(columns["_block"])
        sketches = [np.frombuffer(x, dtype=np.uint64) for x in columns["sketch"]]
        words = min(len(x) for x in sketches)
        m = np.stack([folded(x, words) for x in sketches])
        out = [[], []]
        for at in np.flatnonzero(block == i).tolist():
            later = (node > node[at]) if i == j else (block == j)
            open_ = np.flatnonzero(
                later & (component != component[at])
                & (np.minimum(n, n[at]) * down >= np.maximum(n, n[at]) * up)
            )
            apart = np.bitwise_count(m[open_] ^ m[at]).sum(axis=1)
            for other in open_[apart * (up + down) <= (n[open_] + n[at]) * (down - up)].tolist():
                if min(set(groups[at]).intersection(groups[other])) == group:
                    out[0].append(int(min(node[at], node[other])))
                    out[1].append(int(max(node[at], node[other])))
        return pa.table([pa.array(x, pa.int64()) for x in out], names=["a", "b"])

    return placed.groupBy("group", "_meets").applyInArrow(compare, "a long, b long")


def _sketches(sets: DataFrame) -> DataFrame:
    """(node, n, sketch): the size and the sketch of every set."""

    def run(batches):
        for batch in batches:
            elements = [from_planes(x.as_py(), ELEMENT_BYTES) for x in batch["elements"]]
            yield pa.RecordBatch.from_arrays(
                [batch["node"], pa.array([len(x) for x in elements], pa.int64()),
                 pa.array([sketch(x).tobytes() for x in elements], pa.binary())],
                names=["node", "n", "sketch"],
            )

    return sets.mapInArrow(run, "node long, n long, sketch binary")
