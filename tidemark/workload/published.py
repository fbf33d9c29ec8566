"""Tables that several queries read, written once per application.

In production these are tables that earlier jobs publish. Here the first query that needs one
writes it to the shared folder, and later queries of the same application and data read it. The
query that stands for a table itself always computes it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from tidemark.session import scratch_path

_WRITTEN: dict[tuple[str, str, str], tuple[str, StructType]] = {}


def published(spark: SparkSession, sf: str, name: str, build: Callable[[], DataFrame]) -> DataFrame:
    """The table `name` over the data in `sf`, built if this application has not written it yet."""
    key = (spark.sparkContext.applicationId, sf, name)
    if key not in _WRITTEN:
        table = build()
        path = scratch_path(spark, f"published-{name}")
        table.write.parquet(path)
        _WRITTEN[key] = (path, table.schema)
    path, schema = _WRITTEN[key]
    return spark.read.schema(schema).parquet(path)
