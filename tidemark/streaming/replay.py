"""A stored table replayed as a stream in order of arrival."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.session import scratch_path, stored


def replay(df: DataFrame, arrival: Column, label: str, slices: int = 6, files: int = 2) -> DataFrame:
    """`df` as a stream of `slices` batches, each the rows that arrive in an equal span of time.

    A batch has `files` files, so it is read by several tasks. Arrival may differ from the event
    time of a row; that is the disorder and lateness of the stream.
    """
    path = scratch_path(df.sparkSession, label)
    at = F.unix_micros(arrival.cast("timestamp"))
    rows = stored(df.withColumn("_arrival", at), f"{label}-rows")
    first, last = (rows.agg(f("_arrival")).scalar() for f in (F.min, F.max))
    share = (F.col("_arrival") - first) / F.greatest(F.lit(1), last - first + 1)
    placed = stored(rows.withColumn("_slice", F.floor(share * slices).cast("int")).drop("_arrival"), f"{label}-slices")
    # The file source reads files in order of their modification time, so slices are written in turn.
    for number in range(slices):
        batch = placed.filter(F.col("_slice") == number).drop("_slice")
        batch.repartition(files).write.mode("append").parquet(path)
    reader = df.sparkSession.readStream.schema(df.schema).option("maxFilesPerTrigger", files)
    return reader.parquet(path)
