"""Writers: full replace, slice replace, keyed upsert, layer materialisation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.keyed import first_per_key, upserted
from tidemark.session import cut


def write_full(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(path)


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """A stored table with the columns of all its partitions; absent ones are null."""
    return spark.read.option("mergeSchema", "true").parquet(path)


def read_if_exists(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return read_table(spark, path)
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def replace_slice(df: DataFrame, path: str, key: str | Sequence[str]) -> None:
    """Replace the slices of `key` that occur in `df`; other slices stay as they are."""
    keys = [key] if isinstance(key, str) else list(key)
    (
        df.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(*keys)
        .parquet(path)
    )


def upsert(df: DataFrame, path: str, keys: Sequence[str], partition: str, order: Sequence = ()) -> None:
    """Insert `df` or replace the stored rows with the same keys.

    The table is partitioned by `partition`, which has to follow from the keys (a day of
    the key timestamp, a hash bucket of the key), so an upsert reads and rewrites only
    the partitions its rows fall in. `order` picks among incoming rows of one key. Columns
    may come and go: rows keep what they were stored with, and have null in other columns.
    """
    spark = df.sparkSession
    incoming = first_per_key(df, keys, order) if order else df
    existing = read_if_exists(spark, path)
    if existing is None:
        write_full(incoming, path, [partition])
        return
    incoming = cut(incoming)
    # Partition values, not rows: as literals they prune the scan to the touched partitions.
    touched = [r[0] for r in incoming.select(partition).distinct().collect()]
    hit = F.col(partition).isin([v for v in touched if v is not None])
    if None in touched:
        hit = hit | F.col(partition).isNull()
    # Written out first: the partitions are read and then overwritten.
    merged = cut(upserted(existing.filter(hit), incoming, keys))
    replace_slice(merged, path, partition)


def key_bucket(key: str, buckets: int) -> F.Column:
    """A partition column for keys without a natural one."""
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def materialize(df: DataFrame, name: str, kind: str = "view", **upsert_options) -> DataFrame:
    """Publish a model as a view, as a table, or incrementally into a path.

    `incremental` takes the path as `name` and the options of `upsert`.
    """
    spark = df.sparkSession
    if kind == "view":
        df.createOrReplaceTempView(name)
        return spark.table(name)
    if kind == "table":
        df.write.mode("overwrite").saveAsTable(name)
        return spark.table(name)
    if kind == "incremental":
        upsert(df, name, **upsert_options)
        return read_table(spark, name)
    raise ValueError(f"unknown kind {kind!r}")
