"""Mix sources to target weights: capped water-filling, then seeded repetitions.

Every source has a weight and a size. A budget of words is dealt out in proportion to the
weights; a source whose share exceeds `max_epochs` times its size stops there, and what it
cannot take is dealt again among the others until no share is above its cap. The share of a
source is then drawn from its documents: whole repetitions of every document, and for the
rest one more repetition of documents in a seeded random order until the share is reached.
The document at the edge gives only its first words.

Everything is aggregates, joins and windows. Documents meet in a window only inside the one
slice of the seeded order in which their source's share ends, about 1/SLICES of the source.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import stored

WORD = r"[^\x20\x09-\x0D]+"
# Slices of the seeded order for which sizes are summed; the order has 52 bits.
SLICES = 1 << 12
_ORDER_BITS = 52


def word_count(text: Column) -> Column:
    """Number of words; 0 for a null text."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def water_fill(
    sources: DataFrame, weight: str, size: str, budget_share: float, max_epochs: int
) -> DataFrame:
    """Adds `target`, the words each source gives, to a table with one row per source.

    Sources are sorted by the level of water at which they are full (cap / weight). Source i
    stays below its cap exactly if the level reached with all sources up to i - 1 full is
    below its own; from there on all have the same level. One window over one row per source.
    """
    cap = F.col(size) * F.lit(max_epochs)
    full = F.struct((cap / F.col(weight)).alias("level"), F.col("_rank"))
    upto = Window.orderBy("_full").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    filled = (
        sources.withColumn("_cap", cap)
        .withColumn("_full", full)
        .withColumn("_caps_before", F.coalesce(F.sum("_cap").over(upto), F.lit(0)))
        .withColumn("_weights_before", F.coalesce(F.sum(weight).over(upto), F.lit(0)))
        .withColumn("_weights", F.sum(weight).over(everything))
        .withColumn("_budget", F.sum(size).over(everything) * F.lit(budget_share))
        .withColumn("_left", F.col("_budget") - F.col("_caps_before"))
        .withColumn("_open", F.col("_weights") - F.col("_weights_before"))
        .withColumn("_below", F.col("_left") < F.col("_cap") / F.col(weight) * F.col("_open"))
    )
    first_open = F.min(F.when(F.col("_below"), F.col("_full"))).over(everything)
    edge = filled.withColumn("_edge", first_open)
    left = F.max(F.when(F.col("_full") == F.col("_edge"), F.col("_left"))).over(everything)
    open_ = F.max(F.when(F.col("_full") == F.col("_edge"), F.col("_open"))).over(everything)
    level = edge.withColumn("_level_left", left).withColumn("_level_open", open_)
    target = F.when(
        F.col("_full") >= F.col("_edge"),
        F.least(
            F.col("_level_left") * F.col(weight) / F.col("_level_open"), F.col("_cap").cast("double")
        ),
    ).otherwise(F.col("_cap").cast("double"))
    drop = [c for c in level.columns if c.startswith("_") and c != "_rank"]
    return level.withColumn("target", target).drop(*drop)


def source_weights(sizes: DataFrame, weights: Sequence[int]) -> DataFrame:
    """One row per source: its size and its weight, dealt in turn by code point, null last."""
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    position = F.row_number().over(order)
    cycle = F.array(*[F.lit(w) for w in weights])
    return by_source.withColumn("_rank", position).withColumn(
        "weight", F.get(cycle, (F.col("_rank") - 1) % F.lit(len(weights)))
    )


def seeded_order(doc_id: Column, seed: int) -> Column:
    """A reproducible number of 52 bits per document."""
    digest = F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(f":{seed}")))
    return F.conv(F.substring(digest, 1, _ORDER_BITS // 4), 16, 10).cast("long")


def mix(
    docs: DataFrame,
    weights: Sequence[int] = (5, 2, 1),
    budget_share: float = 1.5,
    max_epochs: int = 2,
    seed: int = 17,
    carry: Sequence[str] = (),
) -> DataFrame:
    """Words taken of every document: doc_id, source, size, source_size, target, taken.

    Columns named in `carry` stay with their rows; they are not shuffled by it, but for rows at
    the edge of their source's share.

    Defined cases: a null text has size 0 and gives nothing; a null source is a source of its
    own, last in order; an empty table gives an empty result; a source of size 0 has target
    0; equal rows count each, and which of them stands at the edge is arbitrary but alike;
    documents of one order number follow by doc_id and size. Other columns are ignored. The
    words taken of a source are its target rounded to the nearest whole number.
    """
    rows = docs.select(
        "doc_id",
        "source",
        *carry,
        word_count(F.col("text")).alias("size"),
        seeded_order(F.col("doc_id"), seed).alias("_order"),
    )
    sized = stored(rows.drop(*carry), "mix-sizes")
    plan = (
        water_fill(source_weights(sized, weights), "weight", "source_size", budget_share, max_epochs)
        .withColumn("_words", F.floor(F.col("target") + 0.5))
        .withColumn(
            "_whole",
            F.when(F.col("source_size") > 0, F.floor(F.col("_words") / F.col("source_size"))).otherwise(0),
        )
        .withColumn("_rest", F.col("_words") - F.col("_whole") * F.col("source_size"))
    )
    plan = stored(plan.drop("_rank", "_words", "weight"), "mix-plan")

    slice_ = F.shiftright(F.col("_order"), _ORDER_BITS - SLICES.bit_length() + 1)
    sized = sized.withColumn("_slice", slice_)
    summed = sized.groupBy("source", "_slice").agg(F.sum("size").alias("_sum"))
    before = Window.partitionBy("source").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    summed = summed.withColumn("_before", F.coalesce(F.sum("_sum").over(before), F.lit(0)))
    same = F.col("p.source").eqNullSafe(F.col("s.source"))
    left = F.col("_rest") - F.col("_before")
    edges = (
        summed.alias("s").join(plan.alias("p"), same)
        .filter((left > 0) & (left < F.col("_sum")))
        .select(F.col("s.source").alias("_source"), F.col("_slice").alias("_edge"), left.alias("_in_edge"))
    )
    plan = (
        plan.join(edges, F.col("source").eqNullSafe(F.col("_source")), "left")
        .withColumn("_edge", F.coalesce("_edge", F.when(F.col("_rest") > 0, F.lit(SLICES)).otherwise(-1)))
        .drop("_source")
    )
    # Where no slice is split, the rest ends between two slices.
    between = (
        summed.alias("s").join(plan.alias("p"), same)
        .filter((F.col("_edge") == SLICES) & (F.col("_before") + F.col("_sum") == F.col("_rest")))
        .groupBy(F.col("s.source").alias("_source"))
        .agg(F.max("_slice").alias("_last"))
    )
    plan = stored(
        plan.join(between, F.col("source").eqNullSafe(F.col("_source")), "left")
        .withColumn("_edge", F.coalesce(F.col("_last") + 1, F.col("_edge")))
        .select(F.col("source").alias("_of"), "source_size", "target", "_whole", "_edge", "_in_edge"),
        "mix-edges",
    )
    final = rows.withColumn("_slice", slice_) if carry else sized
    joined = final.join(plan, F.col("source").eqNullSafe(F.col("_of")))
    inside = joined.filter((F.col("_slice") == F.col("_edge")) & F.col("_in_edge").isNotNull())
    run = Window.partitionBy("source").orderBy("_order", "doc_id", "size")
    run = run.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    part = F.least(F.col("size"), F.col("_in_edge") - (F.sum("size").over(run) - F.col("size")))
    inside = inside.withColumn("_extra", F.greatest(F.lit(0), part))
    outside = joined.filter(
        (F.col("_slice") != F.col("_edge")) | F.col("_in_edge").isNull()
    ).withColumn("_extra", F.when(F.col("_slice") < F.col("_edge"), F.col("size")).otherwise(0))
    return outside.unionByName(inside).select(
        "doc_id",
        "source",
        *carry,
        "size",
        "source_size",
        "target",
        (F.col("_whole") * F.col("size") + F.col("_extra")).cast("long").alias("taken"),
    )


def oracle(weights=(5, 2, 1), budget_share=1.5, max_epochs=2, seed=17, docs="documents") -> str:
    """The same rows in DuckDB SQL, over a table or subquery with doc_id, source and text."""
    cycle = ", ".join(str(w) for w in weights)
    return f"""
WITH sized AS (
  SELECT doc_id, source,
         CAST(coalesce(len(regexp_extract_all(text, '{WORD}')), 0) AS BIGINT) AS size,
         CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':{seed}'), 1, 13) AS BIGINT) AS u
  FROM {docs} AS d
), by_source AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source
), weighted AS (
  SELECT *, list_extract([{cycle}], 1 + (rank - 1) % {len(weights)}) AS weight
  FROM (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS rank FROM by_source)
), levels AS (
  SELECT *, {max_epochs} * source_size AS cap, {max_epochs} * source_size / CAST(weight AS DOUBLE) AS full_at
  FROM weighted
), upto AS (
  SELECT *, CAST(coalesce(sum(cap) OVER w, 0) AS DOUBLE) AS caps_before,
         sum(weight) OVER () - coalesce(sum(weight) OVER w, 0) AS open,
         sum(source_size) OVER () * {budget_share} AS budget
  FROM levels WINDOW w AS (ORDER BY full_at, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), edge AS (
  SELECT full_at AS edge_at, rank AS edge_rank, budget - caps_before AS edge_left, open AS edge_open
  FROM upto WHERE budget - caps_before < full_at * open ORDER BY full_at, rank LIMIT 1
), targets AS (
  SELECT source, source_size,
         CASE WHEN edge_at IS NOT NULL AND (full_at > edge_at OR (full_at = edge_at AND rank >= edge_rank))
              THEN least(edge_left * weight / edge_open, CAST(cap AS DOUBLE))
              ELSE CAST(cap AS DOUBLE) END AS target
  FROM upto LEFT JOIN edge ON true
), plan AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(floor(target + 0.5) / source_size) AS BIGINT) ELSE 0 END AS whole,
         CAST(floor(target + 0.5) AS BIGINT) AS words
  FROM targets
), run AS (
  SELECT s.doc_id, s.source, s.size, p.source_size, p.target, p.whole,
         p.words - p.whole * p.source_size AS rest,
         sum(s.size) OVER (PARTITION BY s.source ORDER BY s.u, s.doc_id, s.size ROWS UNBOUNDED PRECEDING) - s.size AS before
  FROM sized AS s JOIN plan AS p ON s.source IS NOT DISTINCT FROM p.source
)
SELECT doc_id, source, size, source_size, target,
       CAST(whole * size + greatest(0, least(size, rest - before)) AS BIGINT) AS taken
FROM run
"""
