"""Structured Streaming sources, operators and sinks.

Every operator takes a streaming or a batch DataFrame. Event-time columns have to be
`timestamp`; the watermark is the time a late row may still arrive in.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from tidemark.operators.keyed import first_per_key, latest_version
from tidemark.plans import market, payments
from tidemark.session import scratch_path


def read_json_stream(
    spark: SparkSession, fmt: str, options: Mapping[str, str], schema: StructType | str,
    path: str | None = None,
) -> DataFrame:
    """JSON messages as a stream: `kafka` (value column) or a folder of text files."""
    reader = spark.readStream.format(fmt).options(**options)
    raw = reader.load(path) if path else reader.load()
    extra = ["topic"] if "topic" in raw.columns else []
    value = F.col("value").cast("string")
    parsed = raw.select(*extra, F.from_json(value, schema).alias("m"))
    return parsed.select(*extra, "m.*")


def pace(max_messages: int = 100, idle_seconds: int = 1, fmt: str = "kafka"):
    """Source options and trigger for small batches: so many messages or so long a wait."""
    limit = "maxOffsetsPerTrigger" if fmt == "kafka" else "maxFilesPerTrigger"
    return {limit: str(max_messages)}, {"processingTime": f"{idle_seconds} seconds"}


def append_stream(
    df: DataFrame, path: str, checkpoint: str, trigger: Mapping | None = None
) -> StreamingQuery:
    """Append to a Parquet table with the arrival time; offsets commit after the write."""
    stamped = df.withColumn("consumed_at", F.current_timestamp())
    return (
        stamped.writeStream.format("parquet").outputMode("append")
        .option("checkpointLocation", checkpoint).option("path", path)
        .trigger(**(trigger or {"availableNow": True})).start()
    )


def route(df: DataFrame, sinks: Mapping[str, str], checkpoint: str, topic: str = "topic",
          shape: Mapping[str, Callable[[DataFrame], DataFrame]] | None = None) -> StreamingQuery:
    """Send each topic of one stream to its own table.

    A batch is written below its own batch number and overwritten on a retry.
    """
    shape = shape or {}

    def write(batch: DataFrame, batch_id: int) -> None:
        batch = batch.withColumn("consumed_at", F.current_timestamp()).persist()
        for name, path in sinks.items():
            rows = batch.filter(F.col(topic) == name).drop(topic)
            rows = shape[name](rows) if name in shape else rows
            rows.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")
        batch.unpersist()

    return (
        df.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )


def change_log(
    df: DataFrame, path: str, checkpoint: str, keys: Sequence[str] = (), every: int = 8, trigger: Mapping | None = None
) -> StreamingQuery:
    """Write the updated groups of each batch as one version of a keyed change log.

    After `every` batches the versions are folded into a snapshot with one row per key, and what
    an older snapshot already holds is removed. Reading costs one snapshot and at most `every`
    versions, however long the stream runs. A repeated batch overwrites what it wrote.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/versions/version={batch_id}")
        if keys and (batch_id + 1) % every == 0:
            fold_log(batch.sparkSession, path, keys, batch_id)

    return (
        df.writeStream.outputMode("update").foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True})).start()
    )


def fold_log(spark: SparkSession, path: str, keys: Sequence[str], upto: int) -> None:
    """Fold the versions up to a number into a snapshot; drop what the snapshot before it replaced."""
    before = [n for n in finished(spark, f"{path}/snapshots", "snapshot") if n < upto]
    state = _log_since(spark, path, before[-1] if before else None, upto)
    folded = first_per_key(state, keys, [F.desc("version")])
    folded.write.mode("overwrite").parquet(f"{path}/snapshots/snapshot={upto}")
    if before:
        # Readers that opened the snapshot before this one still find it and the versions after it.
        remove(spark, [f"{path}/snapshots/snapshot={n}" for n in before[:-1]])
        old = [n for n in finished(spark, f"{path}/versions", "version") if n <= before[-1]]
        remove(spark, [f"{path}/versions/version={n}" for n in old])


def _log_since(spark: SparkSession, path: str, snapshot: int | None, upto: int | None = None) -> DataFrame:
    """Rows of a snapshot and of the versions after it, with their version."""
    numbers = finished(spark, f"{path}/versions", "version")
    newer = [n for n in numbers if (snapshot is None or n > snapshot) and (upto is None or n <= upto)]
    parts = [spark.read.parquet(f"{path}/snapshots/snapshot={snapshot}")] if snapshot is not None else []
    if newer or not parts:
        versions = spark.read.option("basePath", f"{path}/versions")
        parts.append(versions.parquet(*[f"{path}/versions/version={n}" for n in newer]))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def finished(spark: SparkSession, folder: str, name: str) -> list[int]:
    """Numbers n of the subfolders name=n that a job has written whole, ascending."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(at):
        return []
    found = []
    for status in fs.listStatus(at):
        key, _, number = status.getPath().getName().partition("=")
        done = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(status.getPath(), "_SUCCESS")
        if key == name and number.isdigit() and fs.exists(done):
            found.append(int(number))
    return sorted(found)


def remove(spark: SparkSession, folders: Sequence[str]) -> None:
    """Delete folders of a log that newer ones have replaced."""
    for folder in folders:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def read_log(spark: SparkSession, path: str, keys: Sequence[str]) -> DataFrame:
    """Current state of a change log: its newest snapshot and the versions after it."""
    snapshots = finished(spark, f"{path}/snapshots", "snapshot")
    return latest_version(_log_since(spark, path, snapshots[-1] if snapshots else None), keys, "version")


def run_log(df: DataFrame, keys: Sequence[str], label: str, every: int = 8) -> DataFrame:
    """Drain an update-mode stream into a change log and return its final state."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    change_log(df, path, path + "-state", keys, every).awaitTermination()
    return read_log(spark, path, keys)


def until_idle(query: StreamingQuery, idle_seconds: float, poll: float = 0.1) -> list[dict]:
    """Wait until a running query has met no new rows for so long, stop it, and return its batches.

    A batch is its progress: batchId, numInputRows and so on; only batches with rows count.
    """
    batches: dict[int, dict] = {}
    quiet_since = time.monotonic()
    while query.isActive:
        for progress in query.recentProgress:
            if progress["numInputRows"] and progress["batchId"] not in batches:
                batches[progress["batchId"]] = progress
                quiet_since = time.monotonic()
        status = query.status
        if status["isTriggerActive"] and status["isDataAvailable"]:
            quiet_since = time.monotonic()
        if time.monotonic() - quiet_since > idle_seconds and query.lastProgress is not None:
            query.stop()
        time.sleep(poll)
    if query.exception() is not None:
        raise query.exception()
    return [batches[n] for n in sorted(batches)]


def run_append(df: DataFrame, label: str) -> DataFrame:
    """Drain an append-mode stream into a table and return it."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    query = (
        df.writeStream.format("parquet").outputMode("append").option("path", path)
        .option("checkpointLocation", path + "-state").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return spark.read.parquet(path)


def live_prices(trades: DataFrame) -> DataFrame:
    """Latest price, trade count and volume per symbol since the start."""
    newest = F.struct("trade_time", "trade_id")
    return trades.groupBy("symbol").agg(
        F.max_by("price", newest).alias("price"),
        F.max("trade_time").alias("updated_at"),
        F.count(F.lit(1)).alias("total_trades"),
        F.round(F.sum("quantity"), 6).alias("total_volume"),
    )


def newest_trades(trades: DataFrame, n: int = 40) -> DataFrame:
    """The newest trades with their value, newest first."""
    shown = trades.select(
        "trade_id", "symbol", "price", "quantity",
        F.round(F.col("price") * F.col("quantity"), 2).alias("notional"),
        "buyer_maker", "trade_time",
    )
    return shown.orderBy(F.desc("trade_time"), F.desc("trade_id")).limit(n)


def live_snapshot(trades: DataFrame, prices_path: str, tape_path: str, checkpoint: str, n: int = 40):
    """Two queries that keep the price board and the tape of newest trades current."""
    board = change_log(live_prices(trades), prices_path, checkpoint + "/prices", ["symbol"])

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        newest = newest_trades(batch, n)
        if batch_id > 0:
            before = spark.read.parquet(f"{tape_path}/batch={batch_id - 1}")
            newest = newest.unionByName(before).orderBy(F.desc("trade_time"), F.desc("trade_id")).limit(n)
        newest.write.mode("overwrite").parquet(f"{tape_path}/batch={batch_id}")
        # A batch is repeated at most from the one before it, so that one stays.
        remove(spark, [f"{tape_path}/batch={b}" for b in finished(spark, tape_path, "batch") if b < batch_id - 1])

    tape = (
        trades.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint + "/tape")
        .trigger(availableNow=True).start()
    )
    return board, tape


def dedupe_stream(df: DataFrame, key: str, ts: str, delay: str) -> DataFrame:
    """First arrival per id; a repetition later than `delay` is out of scope."""
    if df.isStreaming:
        return df.withWatermark(ts, delay).dropDuplicatesWithinWatermark([key])
    return first_per_key(df, [key], [F.asc(ts)])


def resolve_stream(
    requests: DataFrame, rejections: DataFrame, grace: str, delay: str = "5 minutes"
) -> DataFrame:
    """Final payment states: a request joined to a rejection within the grace time.

    `delay` is how far messages may be out of order; results come out that much later.

    Streaming emits a request as rejected when the rejection arrives and as accepted
    when the watermark has passed its grace time. Pending payments and rejections after
    the grace time do not come out; `resolve.resolve_log` has them.
    """
    req = requests.withWatermark("requested_at", delay).alias("q")
    rej = rejections.select(
        F.col("payment_id").alias("rejected_id"), "rejected_at"
    ).withWatermark("rejected_at", delay)
    condition = F.expr(
        "q.payment_id = rejected_id AND rejected_at >= requested_at "
        f"AND rejected_at <= requested_at + INTERVAL {grace}"
    )
    status = F.when(F.col("rejected_id").isNotNull(), "rejected").otherwise("accepted")
    return req.join(rej, condition, "left_outer").select(
        "payment_id", "amount", "requested_at", "rejected_at", status.alias("status")
    )


def candle_stream(trades: DataFrame, width: str, delay: str) -> DataFrame:
    """OHLCV candles per symbol and time window; trades later than `delay` are dropped."""
    late = trades.withWatermark("trade_time", delay) if trades.isStreaming else trades
    valued = late.withColumn("notional_value", F.col("price") * F.col("quantity"))
    candles = valued.groupBy("symbol", F.window("trade_time", width)).agg(*market.ohlcv())
    return candles.withColumn("candle_open_time", F.col("window.start")).drop("window")


def bucket_stream(status: DataFrame, width: str, delay: str) -> DataFrame:
    """Counts and amounts per status and time window; payments later than `delay` are dropped."""
    late = status.withWatermark("requested_at", delay) if status.isStreaming else status
    grouped = late.groupBy(F.window("requested_at", width)).agg(*payments.status_totals())
    return grouped.withColumn("request_bucket", F.col("window.start")).drop("window")


def session_stream(events: DataFrame, key: str, ts: str, gap: str, delay: str) -> DataFrame:
    """Sessions by inactivity gap with their event count."""
    late = events.withWatermark(ts, delay) if events.isStreaming else events
    grouped = late.groupBy(key, F.session_window(ts, gap)).agg(
        F.min(ts).alias("session_start"),
        F.max(ts).alias("session_end"),
        F.count(F.lit(1)).alias("num_events"),
    )
    return grouped.drop("session_window")
