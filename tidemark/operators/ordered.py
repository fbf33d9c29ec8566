"""Order-dependent operators that stay parallel inside one key.

A window over `partitionBy(key)` handles a whole key in one task. When one key may hold
a large part of all rows that task is the job. The operators here work in two levels:
all rows are range-sorted by key and order into parts of about equal size, wherever a key
begins or ends, the window runs inside a part, and the little that crosses the edge of a part
(last value, running total) travels through one summary row per key and part.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.keyed import join_null_safe
from tidemark.session import cut

PART = "_part"
# monotonically_increasing_id() keeps the row number in the lower 33 bits.
_ROW_BITS = 33


def split(df: DataFrame, keys: Sequence[str], order: Sequence[str], parts: int | None = None) -> DataFrame:
    """Adds PART, the number of the part a row is in; it does not decrease along key and order.

    Parts are cut by a sample of the rows, so they hold about as many rows each, whatever the keys
    and times are. Written out, as every part is read several times. `parts` is their number; by
    default Spark joins small ones.
    """
    columns = [*keys, *order]
    ranged = df.repartitionByRange(parts, *columns) if parts else df.repartitionByRange(*columns)
    return cut(ranged.withColumn(PART, F.spark_partition_id()))


def _in_parts(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> tuple[DataFrame, bool]:
    """The rows with PART, and whether it was added here."""
    return (df, False) if PART in df.columns else (split(df, keys, order), True)


def _crossing(edges: DataFrame, keys: Sequence[str], after: bool = False) -> DataFrame:
    """The summary rows of a key that has a neighbouring part, hinted as small.

    Parts follow key and order, so an edge between two parts cuts at most one key: these are no
    more rows than parts, and the rows of the parts need not be shuffled to meet them.
    """
    w = Window.partitionBy(*keys).orderBy(PART)
    step = F.lead if after else F.lag
    return F.broadcast(edges.withColumn("_has", step(PART).over(w).isNotNull()).filter("_has").drop("_has"))


def _edges(df: DataFrame, keys: Sequence[str], value: str, order: Sequence[str], after: bool):
    """Per key and part, the nearest value in the neighbouring part that has the key, if one has."""
    pick = F.min_by if after else F.max_by
    edge = df.groupBy(*keys, PART).agg(pick(F.col(value), F.struct(*order)).alias("_edge"))
    w = Window.partitionBy(*keys).orderBy(PART)
    step = F.lead if after else F.lag
    return _crossing(edge.select(*keys, PART, step("_edge").over(w).alias("_carried")), keys, after)


def _neighbour(df, keys, value, order, name, after):
    keys, order = list(keys), list(order)
    tagged, added = _in_parts(df, keys, order)
    w = Window.partitionBy(*keys, PART).orderBy(*order)
    step = F.lead if after else F.lag
    local = tagged.withColumn("_local", step(F.col(value)).over(w)).withColumn(
        "_inside", step(F.lit(True)).over(w)
    )
    edges = _edges(tagged, keys, value, order, after)
    near = F.when(F.col("_inside"), F.col("_local")).otherwise(F.col("_carried"))
    joined = join_null_safe(local, edges, [*keys, PART]).withColumn(name, near)
    return joined.drop("_local", "_inside", "_carried", *([PART] if added else []))


def previous_value(df: DataFrame, keys: Sequence[str], value: str, order: Sequence[str], name: str) -> DataFrame:
    """lag(value) per key. Rows that `split` has cut already keep their parts."""
    return _neighbour(df, keys, value, order, name, after=False)


def next_value(df: DataFrame, keys: Sequence[str], value: str, order: Sequence[str], name: str) -> DataFrame:
    """lead(value) per key. Rows that `split` has cut already keep their parts."""
    return _neighbour(df, keys, value, order, name, after=True)


# Aggregates that a part's rows and the parts before it add up to: function, and how two are joined.
_AGGREGATES = {
    "sum": (F.sum, lambda a, b: F.coalesce(a + b, a, b)),
    "max": (F.max, F.greatest),
    "xor": (F.bit_xor, lambda a, b: F.coalesce(a.bitwiseXOR(b), a, b)),
}


def running(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], values: Mapping[str, tuple[str, str]]
) -> DataFrame:
    """Aggregates from the start of the key to the current row; null while all values are null.

    `values` maps a new column to the column it sums up and one of sum, max and xor. Rows that
    `split` has cut already keep their parts.
    """
    keys, order = list(keys), list(order)
    tagged, added = _in_parts(df, keys, order)
    inside = Window.partitionBy(*keys, PART).orderBy(*order)
    inside = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = Window.partitionBy(*keys).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    totals, offsets, local, both = [], [], {}, {}
    for name, (value, kind) in values.items():
        aggregate, join = _AGGREGATES[kind]
        totals.append(aggregate(value).alias(f"_of_part_{name}"))
        offsets.append(aggregate(f"_of_part_{name}").over(before).alias(f"_before_{name}"))
        local[f"_inside_{name}"] = aggregate(value).over(inside)
        both[name] = join(F.col(f"_inside_{name}"), F.col(f"_before_{name}"))
    edges = _crossing(tagged.groupBy(*keys, PART).agg(*totals).select(*keys, PART, *offsets), keys)
    joined = join_null_safe(tagged.withColumns(local), edges, [*keys, PART]).withColumns(both)
    used = [f"_{k}_{name}" for name in values for k in ("inside", "before")]
    return joined.drop(*used, *([PART] if added else []))


def running_total(df: DataFrame, keys: Sequence[str], value: str, order: Sequence[str], name: str) -> DataFrame:
    """sum(value) from the start of the key to the current row."""
    return running(df, keys, order, {name: (value, "sum")})


def running_max(df: DataFrame, keys: Sequence[str], value: str, order: Sequence[str], name: str) -> DataFrame:
    """max(value) from the start of the key to the current row."""
    return running(df, keys, order, {name: (value, "max")})


def rank_rows(
    df: DataFrame, order: Sequence[Column], name: str, within: Sequence[str] = ()
) -> DataFrame:
    """1, 2, 3 … along `order`, over all rows or inside each `within` group.

    The rows are range-sorted once and written out with their position, so the rank
    comes from per-partition offsets. Neither all rows nor one big group meet in a
    single task. `order` should end in a unique column.
    """
    within = list(within)
    positioned = cut(
        df.orderBy(*within, *order).withColumn("_at", F.monotonically_increasing_id())
    )
    positioned = positioned.withColumn(
        "_part", F.shiftright(F.col("_at"), _ROW_BITS).cast("int")
    ).withColumn("_row", F.col("_at").bitwiseAND(F.lit((1 << _ROW_BITS) - 1)))

    # One row per sort partition, at most spark.sql.shuffle.partitions of them.
    sizes = positioned.groupBy("_part").agg((F.max("_row") + 1).alias("_size"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        "_part", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_offset")
    )
    ranked = positioned.join(F.broadcast(offsets), "_part").withColumn(
        name, F.col("_offset") + F.col("_row") + 1
    )
    ranked = ranked.drop("_at", "_part", "_row", "_offset")
    if not within:
        return ranked
    group = [f"_within{i}" for i in range(len(within))]
    starts = ranked.groupBy(*[F.col(k).alias(g) for k, g in zip(within, group)]).agg(
        (F.min(name) - 1).alias("_start")
    )
    same = [F.col(k).eqNullSafe(F.col(g)) for k, g in zip(within, group)]
    joined = ranked.join(starts, same, "left")
    return joined.withColumn(name, F.col(name) - F.col("_start")).drop("_start", *group)


def deciles(df: DataFrame, rank: str, name: str, parts: int = 10) -> DataFrame:
    """Equal-frequency group 1 … parts of a 1-based rank, with linear quantile edges."""
    total = df.agg(F.count(F.lit(1)).alias("n")).scalar()
    place = F.ceil((F.col(rank) - 1) * F.lit(parts) / F.nullif(total - 1, F.lit(0)))
    return df.withColumn(name, F.greatest(F.lit(1), F.coalesce(place, F.lit(1))).cast("int"))
