"""Operators about rows that share a key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Order = Column | str


def top_per_key(
    df: DataFrame, keys: Sequence[str], order: Sequence[Order], n: int, rank: str | None = None
) -> DataFrame:
    """The `n` first rows per key.

    Catalyst turns the filter into a group limit that runs before the shuffle as well,
    so each task ships at most `n` rows of a key, however many rows the key has.
    """
    name = rank or "_position"
    w = Window.partitionBy(*keys).orderBy(*order)
    kept = df.withColumn(name, F.row_number().over(w)).filter(F.col(name) <= n)
    return kept if rank else kept.drop(name)


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Order]) -> DataFrame:
    return top_per_key(df, keys, order, 1)


def join_null_safe(df: DataFrame, other: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """Join on `keys` where a null key matches a null key; the keys of `df` are kept."""
    renamed = other.withColumnsRenamed({k: f"_other_{k}" for k in keys})
    same = [F.col(k).eqNullSafe(F.col(f"_other_{k}")) for k in keys]
    return df.join(renamed, same, how).drop(*[f"_other_{k}" for k in keys])


def with_group_size(df: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    """Row count of the group on every row.

    Counted with a pre-aggregation and joined back: a window would pull the whole
    group into one task.
    """
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias(name))
    return join_null_safe(df, sizes, keys)


def mode_per_key(df: DataFrame, keys: Sequence[str], col: str, name: str) -> DataFrame:
    """Most frequent non-null value per key; the smallest of equally frequent ones."""
    counts = (
        df.filter(F.col(col).isNotNull()).groupBy(*keys, col).agg(F.count(F.lit(1)).alias("_n"))
    )
    best = first_per_key(counts, keys, [F.desc("_n"), F.asc(col)])
    return best.select(*keys, F.col(col).alias(name))


def pending(candidates: DataFrame, loaded: DataFrame, key: str | Sequence[str]) -> DataFrame:
    """Candidates whose key has not been loaded yet."""
    keys = [key] if isinstance(key, str) else list(key)
    return candidates.join(loaded.select(*keys).distinct(), keys, "left_anti")


def upserted(existing: DataFrame, incoming: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Existing rows without those `incoming` replaces, plus the incoming rows."""
    kept = existing.join(incoming.select(*keys).distinct(), list(keys), "left_anti")
    return kept.unionByName(incoming, allowMissingColumns=True)


def latest_version(changes: DataFrame, keys: Sequence[str], version: str) -> DataFrame:
    """State of a keyed change log: the row of the highest version per key."""
    return first_per_key(changes, keys, [F.desc(version)]).drop(version)


def append_evolving(older: DataFrame, newer: DataFrame) -> DataFrame:
    """Append rows whose columns may have grown or shrunk; absent ones are null."""
    return older.unionByName(newer, allowMissingColumns=True)
