"""Prefix trie of conversations as a burst trie.

A trie node stands for a sequence of first turns, and its members are the conversations that
begin with it. Turns are named by 128-bit digests of role and text.

* A container holds the suffixes of the conversations below a trie head. The container of the
  root holds all; one with more suffixes than a limit is burst: its head becomes a node and its
  suffixes go to one container per next turn id. Bursting goes on, several levels a round, until
  no container is oversized. Members that end at a head need no container.
* The containers that are left are shuffled whole, by head, and sorted by suffix. Equal prefixes
  are then neighbours, and one sweep with a stack makes the nodes of a container, with all that is
  summed over their subtrees. The sweep streams; it holds the path and the nodes that wait for
  their parent, no more than a container has members.
* What the containers sum up to is folded along the burst heads, of which a level has at most as
  many as the limit allows.

A conversation is never held whole: it is cut into blocks of `BLOCK` turns. A later block is in
the trie below the head that all turns before it name. Blocks that only one conversation reaches
are swept at once; shared ones are swept from the deepest level up, so that what lies below a
block is known when it is swept.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import stored

WORD = r"[^\x20\x09-\x0D]+"
# Turns of a block, bytes of a turn id, and levels that one round of bursting looks at.
BLOCK = 1024
ID = 16
LEVELS = 32
# A container is oversized beyond the larger of this and all conversations / CONTAINERS, so a level
# has fewer than CONTAINERS burst heads.
LEAST_LIMIT = 256
CONTAINERS = 4096
_ROW_BITS = 33
ROOT = "root"
_NOTHING = hashlib.sha256().hexdigest()


def rebuilt(turns: DataFrame, every: int = 20, most: int = 4) -> tuple[DataFrame, DataFrame]:
    """Conversations that begin with turns of another one, as data of shared prefixes.

    Conversation c begins with the first h turns of conversation c - c % every, where h is the
    CRC-32 of the decimal c modulo `most`, and goes on with its own turns after its first h.
    Returns the turns (conv_id, depth from 1, id, words, total) and all conversations (conv_id,
    total). The remainder of a negative c is not positive, as in SQL.
    """
    rows = turns.filter(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long"),
        F.col("turn").cast("long"),
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    # One global sort, so that the turns of one conversation need not meet in one task.
    named = F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text")
    at = F.monotonically_increasing_id()
    rows = stored(
        rows.orderBy("conv_id", "turn", "role", "text").select(
            "conv_id",
            F.shiftright(at, _ROW_BITS).alias("part"),
            at.bitwiseAND(F.lit((1 << _ROW_BITS) - 1)).alias("row"),
            F.left(F.sha2(named, 256), F.lit(2 * ID)).alias("id"),
            F.regexp_count("text", F.lit(WORD)).cast("long").alias("words"),
        ),
        "trie-turns",
    )
    parts = rows.groupBy("conv_id", "part").agg(F.min("row").alias("first"), F.count(F.lit(1)).alias("n"))
    of_conv = Window.partitionBy("conv_id").orderBy("part")
    before = F.sum("n").over(of_conv.rowsBetween(Window.unboundedPreceding, -1))
    own = F.sum("n").over(Window.partitionBy("conv_id"))
    parts = parts.withColumn("before", F.coalesce(before, F.lit(0))).withColumn("own", own)

    convs = parts.groupBy("conv_id").agg(F.max("own").alias("own")).withColumns({
        "h": F.crc32(F.col("conv_id").cast("string").cast("binary")) % most,
        "base": F.col("conv_id") - F.col("conv_id") % every,
    })
    bases = convs.filter(F.col("conv_id") % every == 0).select(F.col("conv_id").alias("base"), F.col("own").alias("there"))
    convs = convs.join(bases, "base", "left").withColumn("head", F.least("h", F.coalesce("there", F.lit(0))))
    convs = stored(convs.withColumn("total", F.col("head") + F.greatest(F.lit(0), F.col("own") - F.col("h"))).drop("there", "own"), "trie-conversations")

    placed = rows.join(parts.drop("own"), ["conv_id", "part"]).withColumn("d", F.col("row") - F.col("first") + F.col("before"))
    # The facts of a conversation reach its turns through its parts, so a long one is not one join key.
    facts = parts.select("conv_id", "part", "first", "before").join(convs, "conv_id")
    kept = (
        rows.join(facts, ["conv_id", "part"])
        .withColumn("d", F.col("row") - F.col("first") + F.col("before"))
        .filter(F.col("d") >= F.col("h"))
        .select("conv_id", (F.col("head") + F.col("d") - F.col("h") + 1).alias("depth"), "id", "words", "total")
    )
    firsts = placed.filter((F.col("conv_id") % every == 0) & (F.col("d") < most - 1)).select(
        F.col("conv_id").alias("base"), "d", "id", "words"
    )
    taken = (
        convs.join(firsts, "base")
        .filter(F.col("d") < F.col("h"))
        .select("conv_id", (F.col("d") + 1).alias("depth"), "id", "words", "total")
    )
    return kept.unionByName(taken), convs.select("conv_id", "total")


def _ids(begin: Column, n: Column | None = None) -> Column:
    """Turn ids of a block from number `begin` on, `n` of them."""
    length = F.length("ids") if n is None else n * ID
    return F.substring("ids", (begin * ID + 1).cast("int"), length.cast("int"))


def _below(key: Column, ids: Column) -> Column:
    """Name of the trie node that `ids` lead to from the node `key`."""
    return F.md5(F.concat(key.cast("binary"), ids))


def blocks(turns: DataFrame, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """conv_id, level, ids, words, last, head: turns packed, and the node before the block.

    Also the heads of later levels: head, level, n (conversations that go on there) and least
    (smallest member, those that end there included).
    """
    level = F.floor((F.col("depth") - 1) / block).cast("long")
    packed = turns.groupBy("conv_id", level.alias("level")).agg(
        F.array_sort(F.collect_list(F.struct("depth", "id", "words"))).alias("turns"), F.max("total").alias("total")
    )
    packed = stored(
        packed.select(
            "conv_id",
            "level",
            F.unhex(F.array_join(F.transform("turns", lambda t: t["id"]), "")).alias("ids"),
            F.transform("turns", lambda t: t["words"]).alias("words"),
            (F.col("total") <= (F.col("level") + 1) * block).alias("last"),
        ),
        "trie-blocks",
    )
    # A head is named by the blocks before it: each gives two hashes with its level, joined by xor.
    so_far = Window.partitionBy("conv_id").orderBy("level").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    name = [F.bit_xor(F.xxhash64(F.lit(lane), "level", "ids")).over(so_far) for lane in (1, 2)]
    heads = packed.filter(F.length("ids") == block * ID).select(
        "conv_id", "last", (F.col("level") + 1).alias("level"), F.md5(F.concat_ws(":", F.col("level") + 1, *name)).alias("head")
    )
    by_head = heads.groupBy("head", "level").agg(F.count_if(~F.col("last")).alias("n"), F.min("conv_id").alias("least"))
    first = packed.filter(F.col("level") == 0).withColumn("head", F.lit(ROOT))
    later = packed.join(heads.drop("last"), ["conv_id", "level"])
    return first.unionByName(later), stored(by_head.filter("n > 0"), "trie-heads")


def burst(rows: DataFrame, limit: int, block: int = BLOCK, levels: int = LEVELS) -> tuple[DataFrame, DataFrame]:
    """Moves suffixes down until no container is oversized.

    Takes rows with head, head_convs and head_min (rows of the head, its smallest member). Adds at
    (node above the row's container), off (turns of the block above it) and above (smallest
    member of `at`). Also returns the burst heads: head, key, parent, depth, n, least, words.
    """
    start = {"at": F.col("head"), "off": F.lit(0).cast("long"), "above": F.col("head_min")}
    rows = rows.withColumns(start)
    settled = rows.filter(F.col("head_convs") <= limit)
    open_ = rows.filter((F.col("head_convs") > limit) & (F.length("ids") > 0))
    heads, off = None, 0
    while True:
        left = F.length("ids") / ID - off
        prefixes = (
            open_.filter(left > 0)
            .withColumn("k", F.explode(F.sequence(F.lit(1), F.least(F.lit(levels), left.cast("int")))))
            .select(
                "conv_id", "level", "head", "k",
                _below(F.col("at"), _ids(F.lit(off), F.col("k"))).alias("key"),
                F.when(F.col("k") == 1, F.col("at")).otherwise(_below(F.col("at"), _ids(F.lit(off), F.col("k") - 1))).alias("parent"),
                F.get("words", F.col("k") - 1 + off).alias("turn_words"),
            )
        )
        found = prefixes.groupBy("key").agg(
            F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("least"), F.min("head").alias("head"),
            F.min("parent").alias("parent"), F.max("turn_words").alias("words"),
            (F.min("level") * block + off + F.min("k")).alias("depth"),
        )
        found = stored(found.filter(F.col("n") > limit), "trie-burst")
        # At most CONTAINERS heads of each of the levels looked at.
        deepest = (
            prefixes.select("conv_id", "level", "key", "k")
            .join(F.broadcast(found.select("key", "least")), "key")
            .groupBy("conv_id", "level")
            .agg(F.max_by(F.struct("k", "key", "least"), "k").alias("to"))
        )
        moved = open_.join(deepest, ["conv_id", "level"], "left").withColumns({
            "at": F.coalesce(F.col("to.key"), F.col("at")),
            "off": F.col("off") + F.coalesce(F.col("to.k"), F.lit(0)),
            "above": F.coalesce(F.col("to.least"), F.col("above")),
        })
        moved = stored(moved.withColumn("on", F.coalesce(F.col("to.k") == levels, F.lit(False))).drop("to"), "trie-moved")
        heads = found if heads is None else heads.unionByName(found)
        settled = settled.unionByName(moved.filter(~F.col("on")).drop("on"))
        open_ = moved.filter("on").drop("on")
        if open_.isEmpty():
            return settled, heads
        off += levels


_NODE = pa.schema([
    ("conv_id", pa.int64()), ("depth", pa.int64()), ("parent_conv_id", pa.int64()), ("n_convs", pa.int64()),
    ("n_children", pa.int64()), ("n_leaves", pa.int64()), ("saved_tokens", pa.int64()), ("ends_sha256", pa.string()),
    ("at", pa.string()),
])
_NODE_DDL = (
    "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, "
    "saved_tokens long, ends_sha256 string, at string"
)
NODE = _NODE.names[:-1]


class _Open:
    """A node on the path of the sweep."""

    __slots__ = ("depth", "words", "least", "n", "children", "leaves", "saved", "ends", "waiting", "goes_on")

    def __init__(self, depth: int, words: int):
        self.depth, self.words, self.least = depth, words, None
        self.n = self.children = self.leaves = self.saved = 0
        self.ends, self.waiting, self.goes_on = None, [], False

    def add(self, least: int, n: int) -> None:
        self.least = least if self.least is None else min(self.least, least)
        self.n += n

    def end(self, conv_id: int) -> None:
        if self.ends is None:
            self.ends = hashlib.sha256(b"%d" % conv_id)
        else:
            self.ends.update(b",%d" % conv_id)

    def go_on(self, children: int, leaves: int, saved: int) -> None:
        """What lies below in the next block; the same for all members that reach it."""
        if not self.goes_on:
            self.goes_on = True
            self.children, self.leaves, self.saved = self.children + children, self.leaves + leaves, self.saved + saved

    def row(self) -> list:
        self.saved += (self.n - 1) * self.words
        self.leaves = self.leaves or 1
        ends = self.ends.hexdigest() if self.ends else _NOTHING
        return [self.least, self.depth, None, self.n, self.children, self.leaves, self.saved, ends, None]


def _common(a: bytes, b: bytes) -> int:
    """How many turn ids two suffixes share at their start."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n // ID
    x, y = np.frombuffer(a, np.uint8, n), np.frombuffer(b, np.uint8, n)
    return int(np.argmax(x != y)) // ID


def sweep(rows: Iterator[tuple]) -> Iterator[list]:
    """Nodes of containers from their suffixes in order.

    A row is (container, at, above, depth of the container's node, suffix, words of its turns,
    conv_id, last, and children, leaves and saved words below the next block).
    """
    path: list[_Open] = []
    before, held = None, b""

    def close(keep: int):
        while len(path) > keep:
            node = path.pop()
            done = node.row()
            for child in node.waiting:
                child[2] = node.least
                yield child
            if path:
                up = path[-1]
                up.add(node.least, node.n)
                up.children += 1
                up.leaves += node.leaves
                up.saved += node.saved
                up.waiting.append(done)
            else:
                done[2], done[-1] = before[2], before[1]
                yield done

    for container, at, above, depth, suffix, words, conv_id, last, children, leaves, saved in rows:
        if before is None or container != before[0]:
            yield from close(0)
            before, held = (container, at, above), b""
        shared = _common(held, suffix)
        yield from close(shared)
        for i in range(shared, len(suffix) // ID):
            path.append(_Open(depth + i, words[i]))
        held = suffix
        path[-1].add(conv_id, 1)
        if last:
            path[-1].end(conv_id)
        else:
            path[-1].go_on(children, leaves, saved)
    yield from close(0)


_SWEPT = ["container", "at", "above", "depth", "suffix", "words", "conv_id", "last", "next_children", "next_leaves", "next_saved"]


def _sweep_batches(batches):
    def rows():
        for batch in batches:
            yield from zip(*(batch[c].to_pylist() for c in _SWEPT))

    held = []
    for node in sweep(rows()):
        held.append(node)
        if len(held) == 1 << 14:
            yield _batch(held, _NODE)
            held = []
    if held:
        yield _batch(held, _NODE)


def _batch(rows: list, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)


def containers(settled: DataFrame, block: int = BLOCK) -> DataFrame:
    """Nodes below the burst heads, from containers that each lie in one partition in order."""
    rows = settled.filter(F.length("ids") > F.col("off") * ID).select(
        _below(F.col("at"), _ids(F.col("off"), F.lit(1))).alias("container"), "at", "above",
        (F.col("level") * block + F.col("off") + 1).alias("depth"),
        _ids(F.col("off")).alias("suffix"),
        F.slice("words", F.col("off").cast("int") + 1, F.size("words")).alias("words"),
        "conv_id", "last", "next_children", "next_leaves", "next_saved",
    )
    ordered = rows.repartition("container").sortWithinPartitions("container", "suffix", "conv_id")
    return stored(ordered.mapInArrow(_sweep_batches, _NODE_DDL), "trie-nodes")


_ENDS = pa.schema([("key", pa.string()), ("ends", pa.string())])


def ends_at(members: DataFrame) -> DataFrame:
    """key, ends: digest of the ids of all members (key, conv_id), ascending, joined by commas.

    Ids are joined by slices of 4096 numbers first; a key's slices are then streamed in order.
    """
    slices = members.groupBy("key", F.shiftright("conv_id", 12).alias("slice")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda c: c.cast("string")), ",").alias("ids")
    )

    def run(batches):
        held, key, digest = [], None, None
        for batch in batches:
            for k, ids in zip(batch["key"].to_pylist(), batch["ids"].to_pylist()):
                if k == key:
                    digest.update(b"," + ids.encode())
                    continue
                if key is not None:
                    held.append((key, digest.hexdigest()))
                key, digest = k, hashlib.sha256(ids.encode())
            if len(held) > 1 << 12:
                yield _batch(held, _ENDS)
                held = []
        if key is not None:
            held.append((key, digest.hexdigest()))
        if held:
            yield _batch(held, _ENDS)

    ordered = slices.repartition("key").sortWithinPartitions("key", "slice").select("key", "ids")
    return ordered.mapInArrow(run, "key string, ends string")


_FOLD = pa.schema([*_NODE, ("key", pa.string())])


def _fold(table: pa.Table) -> pa.Table:
    """Sums of one head's skeleton, from the deepest node up."""
    rows = sorted(table.to_pylist(), key=lambda r: -r["depth"])
    by_key = {r["key"]: r for r in rows}
    out = []
    for r in rows:
        r["saved"] += (r["n"] - 1) * r["words"]
        r["leaves"] = r["leaves"] or 1
        up = by_key.get(r["parent"])
        if up is not None:
            up["children"] += 1
            up["leaves"] += r["leaves"]
            up["saved"] += r["saved"]
        parent = up["least"] if up is not None else None
        out.append((r["least"], r["depth"], parent, r["n"], r["children"], r["leaves"], r["saved"], None, None, r["key"]))
    return pa.Table.from_batches([_batch(out, _FOLD)] if out else [], _FOLD)


def skeleton(heads: DataFrame, bursts: DataFrame, nodes: DataFrame, settled: DataFrame) -> DataFrame:
    """Burst heads, and the heads they hang from, with their sums: columns of nodes, and key.

    `heads` has head, n, least and depth. A head has fewer than CONTAINERS burst heads a level.
    """
    top = heads.select(
        "head", F.col("head").alias("key"), F.lit(None).cast("string").alias("parent"), "depth", "n", "least",
        F.lit(0).cast("long").alias("words"),
    )
    inner = top.unionByName(bursts)
    tops = nodes.filter(F.col("at").isNotNull()).groupBy(F.col("at").alias("key")).agg(
        F.count(F.lit(1)).alias("children"), F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved")
    )
    on = settled.filter((F.length("ids") == F.col("off") * ID) & ~F.col("last")).groupBy(F.col("at").alias("key")).agg(
        F.max("next_children").alias("more_children"), F.max("next_leaves").alias("more_leaves"), F.max("next_saved").alias("more_saved")
    )
    both = inner.join(tops, "key", "left").join(on, "key", "left")
    for c in ("children", "leaves", "saved"):
        both = both.withColumn(c, F.coalesce(c, F.lit(0)) + F.coalesce(f"more_{c}", F.lit(0)))
    both = both.drop("more_children", "more_leaves", "more_saved")
    return both.groupBy("head").applyInArrow(_fold, _NODE_DDL + ", key string")


def prefix_trie(turns: DataFrame, convs: DataFrame, limit: int | None = None, block: int = BLOCK, levels: int = LEVELS) -> DataFrame:
    """Nodes of the trie over `turns` (conv_id, depth, id, words, total) of all `convs` (conv_id, total).

    conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves (childless
    nodes of the subtree), saved_tokens (words of last turns times members but one, over the
    subtree), ends_sha256 (digest of the ids of members that end there).

    Defined cases: a null role or text is empty; turns of one number follow by role and text, null
    numbers first; equal rows are turns each; rows without a conv_id belong to no conversation; a
    conversation without turns is a member of the root; no conversations, no nodes; other
    columns are ignored.
    """
    count, least = convs.agg(F.count(F.lit(1)), F.min("conv_id")).first()
    limit = limit or max(LEAST_LIMIT, count // CONTAINERS)
    rows, by_head = blocks(turns, block)
    root = convs.groupBy().agg(F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("least")).filter("n > 0").select(
        F.lit(ROOT).alias("head"), F.lit(0).cast("long").alias("level"), "n", "least"
    )
    later = rows.filter("level > 0").join(by_head.withColumnsRenamed({"n": "head_convs", "least": "head_min"}), ["head", "level"])
    rows = rows.filter("level = 0").withColumns({"head_convs": F.lit(count), "head_min": F.lit(least).cast("long")}).unionByName(later)
    # The head that a row goes on to, and whether others go there too.
    onward = later.select("conv_id", (F.col("level") - 1).alias("level"), F.col("head").alias("next"), F.col("head_convs").alias("next_convs"))
    rows = stored(rows.join(onward, ["conv_id", "level"], "left"), "trie-rows")

    below = None
    nodes, deepest = [], by_head.filter("n > 1").agg(F.max("level")).first()[0] or 0
    for level in range(deepest, -1, -1):
        here = (F.col("level") == level) & (F.col("head_convs") > 1)
        if level == 0:
            here = (F.col("level") == 0) | (F.col("head_convs") == 1)
        settled, bursts = burst(_with_next(rows.filter(here), below), limit, block, levels)
        swept = containers(settled, block)
        heads = (root if level == 0 else by_head.filter((F.col("level") == level) & (F.col("n") > 1))).withColumn("depth", F.col("level") * block)
        folded = stored(skeleton(heads, bursts, swept, settled), "trie-skeleton")
        ended = settled.filter((F.length("ids") == F.col("off") * ID) & F.col("last")).select(F.col("at").alias("key"), "conv_id")
        if level == 0:
            ended = ended.unionByName(convs.filter("total = 0").select(F.lit(ROOT).alias("key"), "conv_id"))
        own = folded.join(heads.filter("level > 0").select(F.col("head").alias("key")), "key", "left_anti")
        own = own.join(ends_at(ended), "key", "left").withColumn("ends_sha256", F.coalesce("ends", F.lit(_NOTHING)))
        nodes += [swept.select(*NODE), own.select(*NODE)]
        below = folded.select(F.col("key").alias("next"), "n_children", "n_leaves", "saved_tokens")
    out = nodes[0]
    for more in nodes[1:]:
        out = out.unionByName(more)
    return out


def _with_next(rows: DataFrame, below: DataFrame | None) -> DataFrame:
    """What lies below the next block: one chain if no other conversation goes there."""
    names = {"n_children": "next_children", "n_leaves": "next_leaves", "saved_tokens": "next_saved"}
    if below is None:
        known = rows.withColumns({n: F.lit(None).cast("long") for n in names.values()})
    else:
        known = rows.join(below.withColumnsRenamed(names), "next", "left")
    alone = F.col("next_convs") == 1
    values = {"next_children": 1, "next_leaves": 1, "next_saved": 0}
    return known.withColumns({n: F.when(alone, F.lit(v)).otherwise(F.col(n)).cast("long") for n, v in values.items()}).drop("next", "next_convs")
