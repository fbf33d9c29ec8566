from datetime import timedelta

from pyspark.sql import functions as F

from tidemark.plans import market
from tidemark.streaming import resolve, streams
from tidemark.streaming.replay import replay


def files(spark, folder, *batches, schema):
    for i, batch in enumerate(batches):
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(str(folder))
    return spark.readStream.schema(spark.read.parquet(str(folder)).schema).option("maxFilesPerTrigger", 1).parquet(str(folder))


TRADES = "trade_id long, symbol string, price double, quantity double, trade_time string"


def trades(spark, folder):
    first = [(1, "B", 10.0, 1.0, "2024-01-01 10:00:00"), (2, "B", 12.0, 1.0, "2024-01-01 10:00:59"), (3, "B", 9.0, 2.0, "2024-01-01 10:01:00")]
    second = [(4, "B", 8.0, 1.0, "2024-01-01 10:00:59"), (5, "B", 7.0, 1.0, "2024-01-01 10:05:00")]
    stream = files(spark, folder, first, second, schema=TRADES)
    return stream.withColumn("trade_time", F.col("trade_time").cast("timestamp"))


def test_candles_over_batches_equal_batch_candles(spark, tmp_path, rows):
    """A trade on the minute opens its candle; equal times go by id; minutes without trades have no candle."""
    stream = streams.run_log(streams.candle_stream(trades(spark, tmp_path), "1 minute", "1 hour"), ["symbol", "candle_open_time"], "t")
    batch = spark.read.parquet(str(tmp_path)).withColumn("trade_time", F.col("trade_time").cast("timestamp"))
    batch = market.candles(batch.withColumn("notional_value", F.col("price") * F.col("quantity")))
    cols = ["candle_open_time", "open", "high", "low", "close", "volume", "notional_volume", "trade_count"]
    got = rows(stream, *cols)
    assert got == rows(batch, *cols)
    assert [(r[1], r[4]) for r in got] == [(10.0, 8.0), (9.0, 9.0), (7.0, 7.0)]


def test_rollup_equals_direct_candles(spark, tmp_path, rows):
    trades(spark, tmp_path)
    batch = spark.read.parquet(str(tmp_path)).withColumn("trade_time", F.col("trade_time").cast("timestamp"))
    batch = batch.withColumn("notional_value", F.col("price") * F.col("quantity"))
    cols = ["symbol", "candle_open_time", "open", "high", "low", "close", "volume", "trade_count"]
    assert rows(market.rollup_candles(market.candles(batch)), *cols) == rows(market.candles(batch, "hour"), *cols)


def test_tape_keeps_the_newest_over_batches(spark, tmp_path):
    stream = trades(spark, tmp_path / "in").withColumn("buyer_maker", F.lit(True))
    out = str(tmp_path / "out")
    for q in streams.live_snapshot(stream, out + "/board", out + "/tape", out + "/state", n=2):
        q.awaitTermination()
    rows = spark.read.parquet(out + "/tape")
    last = rows.agg(F.max("batch")).first()[0]
    assert sorted(r["trade_id"] for r in rows.filter(F.col("batch") == last).collect()) == [3, 5]
    board = streams.read_log(spark, out + "/board", ["symbol"]).first()
    assert (board["price"], board["total_trades"], board["total_volume"]) == (7.0, 5, 6.0)


def test_redelivery_across_batches_is_dropped(spark, tmp_path):
    schema = "payment_id string, consumed_at string"
    stream = files(spark, tmp_path, [("a", "2024-01-01 10:00:00"), ("b", "2024-01-01 10:00:30")], [("a", "2024-01-01 10:01:00")], schema=schema)
    stream = stream.withColumn("consumed_at", F.col("consumed_at").cast("timestamp"))
    out = streams.run_append(streams.dedupe_stream(stream, "payment_id", "consumed_at", "10 minutes"), "t")
    assert sorted(r["payment_id"] for r in out.collect()) == ["a", "b"]


def test_rejection_before_its_request(spark, tmp_path):
    """The rejection's file arrives first; the request still ends up rejected. Late ones are accepted."""
    req = files(spark, tmp_path / "q", [("x", 1.0, "2024-01-01 10:30:00")],
                [("p", 1.0, "2024-01-01 10:31:00"), ("end", 1.0, "2024-01-01 12:00:00")],
                schema="payment_id string, amount double, requested_at string")
    rej = files(spark, tmp_path / "r", [("p", "2024-01-01 10:35:00")], [("end2", "2024-01-01 12:00:00")],
                schema="payment_id string, rejected_at string")
    req = req.withColumn("requested_at", F.col("requested_at").cast("timestamp"))
    rej = rej.withColumn("rejected_at", F.col("rejected_at").cast("timestamp"))
    out = streams.run_append(streams.resolve_stream(req, rej, "10 MINUTES"), "t")
    assert {r["payment_id"]: r["status"] for r in out.collect()} == {"x": "accepted", "p": "rejected"}


def payment_log(spark, folder, requests, rejections, **how):
    """Runs the state machine over batches given as lists of (id, time) on one day; log rows in order of batches."""
    folder.mkdir()
    req = files(spark, folder / "q", *[[(i, float(len(i)), f"2024-01-01 {t}") for i, t in b] for b in requests],
                schema="payment_id string, amount double, requested_at string")
    rej = files(spark, folder / "r", *[[(i, f"2024-01-01 {t}") for i, t in b] for b in rejections], schema="payment_id string, rejected_at string")
    req = req.withColumn("requested_at", F.col("requested_at").cast("timestamp"))
    rej = rej.withColumn("rejected_at", F.col("rejected_at").cast("timestamp"))
    with resolve.rocks_db(spark):
        return streams.run_append(resolve.resolve_log(req, rej, timedelta(minutes=10), **how), "t")


def test_states_of_a_payment(spark, tmp_path):
    """p is accepted after its grace time and rejected later; e's rejection comes before its request; the newest is pending."""
    log = payment_log(
        spark, tmp_path / "a",
        [[("x", "10:00:00"), ("p", "10:01:00"), ("x", "10:00:00")], [("e", "10:04:30"), ("mid", "12:00:00")], [("end", "13:00:00")]],
        [[("e", "10:05:00")], [("mid", "12:01:00")], [("p", "12:59:00"), ("p", "12:59:30")]])
    seen = {}
    for r in log.collect():
        seen.setdefault(r["payment_id"], []).append(r["status"])
    assert {k: sorted(v) for k, v in seen.items()} == {
        "x": ["accepted", "pending"], "p": ["accepted", "pending", "rejected"], "e": ["rejected"],
        "end": ["pending"], "mid": sorted(seen["mid"])}
    states = {r["payment_id"]: (r["status"], r["was_accepted"]) for r in resolve.payment_states(log).collect()}
    assert states == {"x": ("accepted", True), "p": ("rejected", True), "e": ("rejected", False),
                      "mid": ("rejected", False), "end": ("pending", False)}
    assert {r["payment_id"]: str(r["rejected_at"]) for r in log.filter("status = 'rejected'").collect()}["p"].endswith("12:59:00")
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass").endswith("HDFSBackedStateStoreProvider")


def test_state_expires(spark, tmp_path):
    """An hour after its grace time a payment is forgotten: a rejection then finds nothing. Orphans come out as unmatched."""
    log = payment_log(
        spark, tmp_path / "a",
        [[("p", "10:00:00")], [("q", "12:00:00")], [("r", "14:00:00")], [("s", "16:00:00")], [("end", "18:00:00")]],
        [[("orphan", "10:00:00")], [("none", "12:00:00")], [("none", "12:01:00")], [("p", "15:59:00")], [("none2", "18:00:00")]],
        keep=timedelta(hours=1))
    got = sorted((r["payment_id"], r["status"]) for r in log.filter("payment_id IN ('p', 'orphan')").collect())
    assert got == [("orphan", "unmatched"), ("p", "accepted"), ("p", "pending"), ("p", "unmatched")]


def test_payments_of_one_bucket(spark, tmp_path):
    """Payments that share a bucket keep their own states, whatever their number is."""
    ids = [f"p{i}" for i in range(60)]
    late = [i for i in ids if int(i[1:]) % 3 == 0]
    log = payment_log(
        spark, tmp_path / "a", [[(i, "10:00:00") for i in ids], [("mid", "12:00:00")], [("end", "13:00:00")]],
        [[("p1", "10:05:00"), ("orphan", "10:00:00")], [("mid2", "12:00:00")], [(i, "12:59:00") for i in late]], buckets=2)
    states = {r["payment_id"]: (r["status"], r["was_accepted"]) for r in resolve.payment_states(log).collect()}
    assert {i: states[i] for i in ids} == {
        i: ("rejected", True) if i in late else ("rejected", False) if i == "p1" else ("accepted", True) for i in ids}
    assert states["end"] == ("pending", False) and "orphan" not in states


def counts(spark, folder, batches):
    for batch in batches:
        spark.createDataFrame([(k,) for k in batch], "k string").coalesce(1).write.mode("append").parquet(str(folder))
    stream = spark.readStream.schema("k string").option("maxFilesPerTrigger", 1).parquet(str(folder))
    return stream.groupBy("k").agg(F.count(F.lit(1)).alias("n"))


def test_log_is_folded_and_restarts(spark, tmp_path):
    """Folders do not pile up with batches, and a run that goes on in the middle gives the same state."""
    log, state = str(tmp_path / "log"), str(tmp_path / "state")
    streams.change_log(counts(spark, tmp_path / "in", ["ab", "b", "bc"]), log, state, ["k"], every=2).awaitTermination()
    assert streams.finished(spark, log + "/snapshots", "snapshot") == [1]
    streams.change_log(counts(spark, tmp_path / "in", ["c", "a", "d", "d"]), log, state, ["k"], every=2).awaitTermination()
    assert {r["k"]: r["n"] for r in streams.read_log(spark, log, ["k"]).collect()} == {"a": 2, "b": 3, "c": 2, "d": 2}
    assert streams.finished(spark, log + "/snapshots", "snapshot") == [3, 5]
    assert streams.finished(spark, log + "/versions", "version") == [4, 5, 6]
    # A batch that is repeated after it was folded changes nothing.
    streams.fold_log(spark, log, ["k"], 5)
    assert {r["k"]: r["n"] for r in streams.read_log(spark, log, ["k"]).collect()} == {"a": 2, "b": 3, "c": 2, "d": 2}


def test_running_query_stops_when_idle(spark, tmp_path):
    grouped = counts(spark, tmp_path / "in", ["aab", "b", "c"])
    log = str(tmp_path / "log")
    _, trigger = streams.pace(1, 1, fmt="file")
    batches = streams.until_idle(streams.change_log(grouped, log, log + "-state", ["k"], trigger=trigger), 4)
    assert [b["numInputRows"] for b in batches] == [3, 1, 1]
    assert {r["k"]: r["n"] for r in streams.read_log(spark, log, ["k"]).collect()} == {"a": 2, "b": 2, "c": 1}


def test_replay_orders_batches_by_arrival(spark):
    """Rows come in the slice of their arrival, and rows later than the delay are dropped by a window."""
    rows = [(i, f"2024-01-01 {i // 60:02}:{i % 60:02}:00") for i in range(600)]
    df = spark.createDataFrame(rows, "i int, at string").withColumn("at", F.col("at").cast("timestamp"))
    late = F.col("i") < 3
    stream = replay(df, F.when(late, F.lit("2024-01-01 09:59:00")).otherwise(F.col("at")), "t", slices=5)
    seen = []
    query = stream.writeStream.foreachBatch(lambda b, n: seen.append(sorted(r["i"] for r in b.collect()))).trigger(availableNow=True).start()
    query.awaitTermination()
    assert len(seen) == 5 and seen[0][0] == 3 and seen[-1][:3] == [0, 1, 2]
    assert [max(b) for b in seen] == sorted(max(b) for b in seen)
    stream = replay(df, F.when(late, F.lit("2024-01-01 09:59:00")).otherwise(F.col("at")), "t", slices=5)
    windows = streams.run_append(stream.withWatermark("at", "10 minutes").groupBy(F.window("at", "1 hour")).count(), "t")
    assert sorted(r["count"] for r in windows.collect()) == [57] + [60] * 8


def test_pace_names_the_limit_of_the_source():
    assert streams.pace() == ({"maxOffsetsPerTrigger": "100"}, {"processingTime": "1 seconds"})
    assert "maxFilesPerTrigger" in streams.pace(5, fmt="file")[0]
