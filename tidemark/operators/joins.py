"""Join shapes the plans share.

None of them forces a broadcast: Spark broadcasts a side only after checking its size,
and adaptive execution splits skewed join keys.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def lookup(df: DataFrame, dim: DataFrame, key: str, columns: dict[str, str], dim_key: str | None = None):
    """Left join that attaches `columns` (dimension name -> new name) of the row with the key."""
    dim_key = dim_key or key
    side = dim.select(
        F.col(dim_key).alias("_lookup"), *[F.col(c).alias(a) for c, a in columns.items()]
    )
    return df.join(side, F.col(key) == F.col("_lookup"), "left").drop("_lookup")


def outer_merge(frames: Sequence[DataFrame], key: str) -> DataFrame:
    """Full outer join on one coalesced key; each input has one row per key."""
    return reduce(lambda left, right: left.join(right, key, "full"), frames)


def with_parent(df: DataFrame, key: str, parent: str, label: str, name: str) -> DataFrame:
    """Attach the parent row's label."""
    parents = df.select(F.col(key).alias("_parent"), F.col(label).alias(name))
    return df.join(parents, F.col(parent) == F.col("_parent"), "left").drop("_parent")


def membership(df: DataFrame, members: DataFrame, key: str, name: str) -> DataFrame:
    """Whether the row's key is among the members, as a boolean column."""
    marks = members.select(key).distinct().withColumn(name, F.lit(True))
    return df.join(marks, key, "left").withColumn(name, F.coalesce(F.col(name), F.lit(False)))


def within_time(
    left: DataFrame, right: DataFrame, key: str, start: str, end: str, bound: str
) -> tuple[DataFrame, DataFrame, Column]:
    """Aliased sides and the condition `key equal, start <= end <= start + bound`."""
    a, b = left.alias("a"), right.alias("b")
    condition = F.expr(
        f"a.{key} = b.{key} AND b.{end} >= a.{start} AND b.{end} <= a.{start} + INTERVAL {bound}"
    )
    return a, b, condition
