"""Readers: registered tables, CSV with inferred types, nested JSON."""

from __future__ import annotations

from collections.abc import Mapping
from pathlib import PurePosixPath

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def source(spark: SparkSession, base: str, name: str) -> DataFrame:
    """A registered Parquet table below `base`."""
    return spark.read.parquet(str(PurePosixPath(base) / f"{name}.parquet"))


def scan_csv(spark: SparkSession, path: str, schema: StructType | None = None) -> DataFrame:
    """CSV with header, stamped with the load time. Types come from the whole file if not given."""
    reader = spark.read.option("header", True)
    if schema is None:
        reader = reader.option("inferSchema", True).option("samplingRatio", 1.0)
    else:
        reader = reader.schema(schema)
    return reader.csv(path).withColumn("ingested_at", F.current_timestamp())


def flatten_json(
    df: DataFrame, payload: str, schema: StructType | str, fields: Mapping[str, Column],
    items: str | None = None, rank: str | None = None,
) -> DataFrame:
    """Parse a JSON text column and project it flat.

    With `items`, the array at that path becomes one row per element (as `item`) and
    `rank` names its 1-based position. `fields` are expressions over `doc` / `item`.
    """
    parsed = df.withColumn("doc", F.from_json(payload, schema))
    out = list(c.alias(n) for n, c in fields.items())
    if items is None:
        return parsed.select(*out)
    exploded = parsed.select("*", F.posexplode(f"doc.{items}").alias("_pos", "item"))
    if rank is not None:
        out.insert(0, (F.col("_pos") + 1).alias(rank))
    return exploded.select(*out)


def first_item(items: Column | str, field: str) -> Column:
    """A field of the first array element, null for an empty array."""
    items = F.col(items) if isinstance(items, str) else items
    return F.try_element_at(items, F.lit(1))[field]


def coordinate(xy: Column | str, axis: int) -> Column:
    """x (0) or y (1) of an [x, y] array; null unless both are there."""
    xy = F.col(xy) if isinstance(xy, str) else xy
    return F.when(F.size(xy) >= 2, F.try_element_at(xy, F.lit(axis + 1)))
