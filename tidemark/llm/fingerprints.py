"""Document fingerprints: one-permutation MinHash with optimal densification, packed bits.

The shingles of a text are hashed once. The top bits of a hash name its bin, the smallest
hash of a bin stands for it. An empty bin copies a non-empty one, which a fixed sequence of
probes per bin finds, so equal bins of two texts copy alike. Of every bin the low bits are
kept; they agree by chance once in 2^bits, and the likeness is corrected for that.

Everything is expressions on one row: no explode, no shuffle.
"""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import stored

SPACE = "\x20\x09\x0a\x0b\x0c\x0d"
SHINGLE = 5
BINS = 128
BITS = 8
# Hashes have 63 bits, so that they sort as they are binned; the lowest bit marks them as hashes.
_HASH_BITS = 63
# Probes written out; longer searches, in texts of a few shingles, go on with the next line.
_PROBES = 10
# Slices of the key's order, at most, and rows of a slice until there are so many.
SLICES = 1 << 16
SLICE_ROWS = 4000


def probe_order(bins: int, seed: int = 41) -> tuple[list[int], list[int]]:
    """Start and odd step of every bin's probes.

    The number of bins is a power of two, so start + step * attempt meets every bin.
    """
    rng = random.Random(seed)
    return [rng.randrange(bins) for _ in range(bins)], [rng.randrange(bins) | 1 for _ in range(bins)]


def with_fingerprint(df: DataFrame, text: str, name: str, bins: int = BINS, bits: int = BITS) -> DataFrame:
    """Adds `name`, the fingerprint as an array of `bins` numbers below 2^`bits`.

    A shingle is five consecutive words, in lower case; fewer words are one shingle, and a
    null text or one without words has the empty shingle.
    """
    if bins & (bins - 1) or bits > 31:
        raise ValueError("bins has to be a power of two and bits at most 31")
    w, h, d = (f"_{k}_{name}" for k in ("words", "hashes", "dense"))
    trimmed = F.btrim(F.lower(F.coalesce(F.col(text), F.lit(""))), F.lit(SPACE))
    last = F.greatest(F.lit(0), F.size(w) - F.lit(SHINGLE))

    def shingle(i: Column) -> Column:
        # get() is null beyond the end and xxhash64 passes nulls over, so short texts need no case.
        hashed = F.xxhash64(*[F.get(F.col(w), i + k) for k in range(SHINGLE)])
        return F.shiftrightunsigned(hashed, 1).bitwiseOR(F.lit(1))

    # A mark per bin is sorted in before the bin's hashes; the smallest hash then follows its mark.
    marks = F.array(*[F.lit(b << (_HASH_BITS + 1 - bins.bit_length())) for b in range(bins)])
    is_hash = lambda x: x.bitwiseAND(F.lit(1)) == 1
    after_mark = F.zip_with(
        F.col(h), F.slice(F.col(h), 2, F.size(h)),
        lambda x, y: F.when(~is_hash(x), F.when(is_hash(y), y).otherwise(-1)),
    )
    starts, steps = (F.array(*map(F.lit, x)) for x in probe_order(bins))
    everything = F.sequence(F.lit(0), F.lit(bins - 1))

    def fill(x: Column, i: Column) -> Column:
        def asked(attempt) -> Column:
            at = (F.get(starts, i) + F.get(steps, i) * attempt).bitwiseAND(F.lit(bins - 1))
            return F.nullif(F.get(F.col(d), at), F.lit(-1))

        rest = F.filter(F.transform(everything, asked), lambda y: y.isNotNull())
        filled = F.coalesce(*[asked(F.lit(a)) for a in range(_PROBES)], F.get(rest, F.lit(0)))
        return F.when(x >= 0, x).otherwise(filled)

    def kept(x: Column, i: Column) -> Column:
        return F.shiftright(fill(x, i), 1).bitwiseAND(F.lit((1 << bits) - 1)).cast("int")

    return (
        df.withColumn(w, F.split(trimmed, r"[\x20\x09-\x0D]+"))
        .withColumn(h, F.sort_array(F.concat(F.transform(F.sequence(F.lit(0), last), shingle), marks)))
        .withColumn(d, F.filter(after_mark, lambda x: x.isNotNull()))
        .withColumn(name, F.transform(F.col(d), kept))
        .drop(w, h, d)
    )


def packed(fingerprint: Column, bits: int = BITS) -> Column:
    """The fingerprint as a string of hexadecimal digits."""
    digits = (bits + 3) // 4
    return F.concat_ws("", F.transform(fingerprint, lambda x: F.lpad(F.lower(F.hex(x)), digits, "0")))


def likeness(a: Column, b: Column, bins: int = BINS, bits: int = BITS) -> Column:
    """Estimated Jaccard similarity of two fingerprints, corrected for chance agreement."""
    share = F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda same: same)) / F.lit(float(bins))
    chance = 2.0**-bits
    return F.greatest(F.lit(0.0), (share - F.lit(chance)) / F.lit(1 - chance))


def _constant(values: list, kind: str) -> Column:
    """An array that Spark folds to a constant; as many literals would be slow to analyse."""
    if not values:
        return F.array().cast(f"array<{kind}>")
    return F.split(F.lit(",".join(map(str, values))), ",").cast(f"array<{kind}>")


def ordered_slices(docs: DataFrame, key: str, rows: int = SLICE_ROWS) -> Column:
    """Slice of the key's order a row is in, from approximate quantiles: about `rows` each.

    There are at most SLICES, and the driver gets their bounds; beyond, slices grow. A row finds
    its slice by halving. A null key is in the first slice.
    """
    n = docs.count()
    slices = min(SLICES, max(1, -(-n // rows)))
    if slices == 1:
        return F.lit(0)
    cuts = [i / slices for i in range(1, slices)]
    found = docs.agg(F.percentile_approx(key, _constant(cuts, "double"), F.lit(max(10_000, 20 * slices))).alias("b"))
    bounds = _constant(sorted(set(found.first()["b"] or [])), "bigint")
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(slices.bit_length()))])
    return F.aggregate(
        steps, F.lit(0), lambda at, step: F.when(F.get(bounds, at + step - 1) <= F.col(key), at + step).otherwise(at)
    )


def with_next(docs: DataFrame, columns: dict[str, str], order: list[str], slice_: str) -> DataFrame:
    """Adds the next row's value of `columns` (name: source) inside the slice; null at its end."""
    w = Window.partitionBy(slice_).orderBy(*order)
    for name, source in columns.items():
        docs = docs.withColumn(name, F.lead(source).over(w))
    return docs


def compare_with_edits(docs: DataFrame, bins: int = BINS, bits: int = BITS) -> DataFrame:
    """Fingerprints of texts and of their edits: doc_id, n_chars, edited_sha256, fingerprint,
    edited_fingerprint, near_edited, near_next.

    The edit puts the first code points of the next text (ascending doc_id, then text; after
    the last row the first) in place of the last quarter. Rows are put in order by slices of
    the key; the row at a slice's end gets its next text through a join on the slice.

    Defined cases: a null text is empty; a null doc_id comes first; equal rows follow each
    other; a single row is its own next; an empty table gives an empty result.
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    sliced = rows.withColumn("_slice", ordered_slices(rows.select("doc_id"), "doc_id"))
    keyed = with_fingerprint(sliced, "text", "_own", bins, bits)
    keyed = with_next(keyed, {"_next": "text", "_next_own": "_own"}, ["doc_id", "text"], "_slice")

    # First row of every slice: at most one per slice, found by key and then read whole.
    no_id = F.max(F.col("doc_id").isNull())
    starts = sliced.groupBy("_slice").agg(F.when(~no_id, F.min("doc_id")).alias("_start"))
    starts = stored(starts, "fingerprint-starts").withColumnRenamed("_slice", "_at")
    at_start = (F.col("_slice") == F.col("_at")) & F.col("doc_id").eqNullSafe(F.col("_start"))
    firsts = sliced.join(starts, at_start).groupBy("_slice").agg(F.min("text").alias("_head"))
    ring = Window.orderBy("_slice")
    prior = F.coalesce(F.lag("_slice").over(ring), F.max("_slice").over(Window.partitionBy()))
    firsts = stored(firsts.select(prior.alias("_slice"), "_head"), "fingerprint-heads")
    heads = with_fingerprint(firsts, "_head", "_head_own", bins, bits)
    joined = (
        keyed.join(heads, "_slice", "left")
        .withColumn("_next_own", F.coalesce("_next_own", "_head_own"))
        .withColumn("_next", F.coalesce("_next", "_head"))
    )
    n = F.length("text")
    cut = F.floor(n / 4).cast("int")
    edited = F.concat(F.left("text", n - cut), F.left("_next", cut))
    joined = joined.withColumn("_edited", edited)
    joined = with_fingerprint(joined, "_edited", "_edited_own", bins, bits)
    return joined.select(
        "doc_id",
        n.cast("long").alias("n_chars"),
        F.sha2("_edited", 256).alias("edited_sha256"),
        packed(F.col("_own"), bits).alias("fingerprint"),
        packed(F.col("_edited_own"), bits).alias("edited_fingerprint"),
        likeness(F.col("_own"), F.col("_edited_own"), bins, bits).alias("near_edited"),
        likeness(F.col("_own"), F.col("_next_own"), bins, bits).alias("near_next"),
    )
