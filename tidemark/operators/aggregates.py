"""Aggregations used across the plans."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.session import cut


def pivot_max(axis: str, values: Mapping[str, object], measures: Mapping[str, str]) -> list[Column]:
    """max(measure) for each axis value, as columns of one aggregation.

    `values` maps a name pattern with `{}` to the axis value it stands for; `measures`
    maps the name that fills the pattern to the source column.
    """
    out = []
    for pattern, value in values.items():
        for label, source in measures.items():
            hit = F.when(F.col(axis) == F.lit(value), F.col(source))
            out.append(F.max(hit).alias(pattern.format(label)))
    return out


def weighted_mean(value: Column | str, weight: Column | str) -> Column:
    value = F.col(value) if isinstance(value, str) else value
    weight = F.col(weight) if isinstance(weight, str) else weight
    return F.sum(value * weight) / F.nullif(F.sum(weight).cast("double"), F.lit(0.0))


def percent_true(condition: Column, digits: int = 1) -> Column:
    return F.round(F.lit(100.0) * F.avg(F.when(condition, 1).otherwise(0)), digits)


def share_of_total(df: DataFrame, keys: Sequence[str], count: str, share: str, digits: int = 1):
    """Rows per group and their percentage of all rows.

    The groups are written out and their total is a scalar, so no task holds all groups.
    """
    groups = cut(df.groupBy(*keys).agg(F.count(F.lit(1)).alias(count)))
    total = groups.agg(F.sum(count)).scalar()
    return groups.withColumn(share, F.round(100.0 * F.col(count) / total, digits))


def vector_mean(
    df: DataFrame, keys: Sequence[str], vector: str, weight: Column, dim: int, name: str
) -> DataFrame:
    """Weighted sum of fixed-length vectors per key, scaled to length one.

    One sum per component keeps it a plain hash aggregate with map-side partial sums.
    Keys whose sum is the zero vector have no direction and drop out.
    """
    parts = [F.sum(F.col(vector)[i].cast("double") * weight).alias(f"_c{i}") for i in range(dim)]
    names = [f"_c{i}" for i in range(dim)]
    square = sum((F.col(c) * F.col(c) for c in names[1:]), F.col(names[0]) * F.col(names[0]))
    summed = df.groupBy(*keys).agg(*parts).withColumn("_length", F.sqrt(square)).filter("_length > 0")
    return summed.select(*keys, F.array(*[F.col(c) / F.col("_length") for c in names]).alias(name))


def scale_column(df: DataFrame, col: str, name: str, constant: float = 0.5) -> DataFrame:
    """Min-max scaling of a column over the whole table."""
    low, high = df.agg(F.min(col)).scalar(), df.agg(F.max(col)).scalar()
    value = F.when(high > low, (F.col(col) - low) / (high - low)).otherwise(F.lit(constant))
    return df.withColumn(name, value)
