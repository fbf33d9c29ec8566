"""Queries that run as streams over the given tables and are compared with their batch meaning."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import functions as F

from tidemark.plans import market, payments
from tidemark.session import scratch_path
from tidemark.sources import feeds, sinks
from tidemark.sources.tables import source
from tidemark.streaming import resolve, streams
from tidemark.streaming.replay import replay
from tidemark.workload import adapters as ad
from tidemark.workload.marts import AMOUNTS, BUCKET_SQL, CANDLE_SQL, ntz
from tidemark.workload.registry import piece, query


def as_stream(df, label: str, files: int = 4):
    """Write a table as several files and read them back as a stream, two files per batch."""
    path = scratch_path(df.sparkSession, label)
    df.repartition(files).write.parquet(path)
    return df.sparkSession.readStream.schema(df.schema).option("maxFilesPerTrigger", 2).parquet(path)


def zoned(df, *cols):
    """Event times as timestamps with zone, which watermarks need."""
    return df.withColumns({c: F.col(c).cast("timestamp") for c in cols})


# Replayed streams: 30 days of events in six slices. Rows arrive up to an hour after their time, within
# the delay that the queries allow; a few of the first ten days arrive last, and are dropped.
DELAY = "1 hour"
LATE_SQL = "event_id % 97 = 0 AND ts < (SELECT min(ts) FROM events) + INTERVAL 10 DAY"
piece("late_events", f"SELECT event_id FROM events WHERE {LATE_SQL}")
piece("trades_in_time", "SELECT * FROM trades WHERE trade_id NOT IN (SELECT event_id FROM late_events)")


def arrival(spark, sf, key, ts):
    """When a row arrives, from the id and the time of its event."""
    events = source(spark, sf, "events")
    first, last = (events.agg(f("ts")).scalar().cast("timestamp") for f in (F.min, F.max))
    key, ts = key.cast("long"), ts.cast("timestamp")
    late = (key % 97 == 0) & (ts < first + F.expr("INTERVAL 10 DAYS"))
    return F.when(late, last).otherwise(ts + F.make_dt_interval(secs=key * 7919 % 3600))


def replayed_trades(spark, sf):
    trades = zoned(ad.raw_trades(spark, sf), "trade_time", "event_time").drop("consumed_at")
    return replay(trades, arrival(spark, sf, F.col("trade_id"), F.col("trade_time")), "trades")


def trade_stream(spark, sf):
    trades = zoned(ad.raw_trades(spark, sf), "trade_time", "event_time").drop("consumed_at")
    return as_stream(trades, "trades")


def json_trades(spark, sf):
    """The trades as JSON text files, read as a message stream."""
    path = scratch_path(spark, "messages")
    trades = ad.raw_trades(spark, sf).drop("consumed_at")
    micros = {"timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}
    trades.select(F.to_json(F.struct(*trades.columns), micros).alias("value")).write.text(path)
    return streams.read_json_stream(spark, "text", {}, feeds.TRADE_MESSAGE, path)


TRADES_SQL = "SELECT * EXCLUDE (notional_value) FROM trades"


@query("s8_json_stream", TRADES_SQL)
def s8(spark, sf):
    return ntz(streams.run_append(json_trades(spark, sf), "s8"), "trade_time", "event_time")


@query("s9_append_stream", TRADES_SQL)
def s9(spark, sf):
    path = scratch_path(spark, "s9")
    streams.append_stream(json_trades(spark, sf), path, path + "-state").awaitTermination()
    rows = spark.read.parquet(path).filter(F.col("consumed_at").isNotNull())
    return ntz(rows.drop("consumed_at"), "trade_time", "event_time")


@query("s10_route", """
SELECT 'requests' AS topic, payment_id, amount FROM raw_requests UNION ALL SELECT 'rejected', payment_id, NULL FROM raw_rejections""")
def s10(spark, sf):
    asked = ad.raw_requests(spark, sf).select(F.lit("requests").alias("topic"), "payment_id", "amount")
    refused = ad.raw_rejections(spark, sf).select(
        F.lit("rejected").alias("topic"), "payment_id", F.lit(None).cast("double").alias("amount"))
    path = scratch_path(spark, "s10")
    sinks_by_topic = {name: f"{path}/{name}" for name in ("requests", "rejected")}
    streams.route(as_stream(asked.unionByName(refused), "topics"), sinks_by_topic, path + "/state",
                  shape={"rejected": lambda rows: rows.drop("amount")}).awaitTermination()
    left, right = (spark.read.parquet(p).drop("batch", "consumed_at") for p in sinks_by_topic.values())
    return left.withColumn("topic", F.lit("requests")).unionByName(
        right.withColumn("topic", F.lit("rejected")), allowMissingColumns=True)


BOARD_SQL = """
SELECT symbol, arg_max(price, trade_time) AS price, max(trade_time) AS updated_at, count(*) AS total_trades, sum(quantity) AS total_volume
FROM trades GROUP BY 1"""


@query("s11_live_board", BOARD_SQL)
def s11(spark, sf):
    path = scratch_path(spark, "s11")
    board, tape = streams.live_snapshot(trade_stream(spark, sf), path + "/board", path + "/tape", path + "/state")
    board.awaitTermination()
    tape.awaitTermination()
    return ntz(streams.read_log(spark, path + "/board", ["symbol"]), "updated_at")


@query("s11_live_tape", """
SELECT trade_id, symbol, price, quantity, round(price * quantity, 2) AS notional, buyer_maker, trade_time FROM trades
ORDER BY trade_time DESC, trade_id DESC LIMIT 40""")
def s11_tape(spark, sf):
    path = scratch_path(spark, "s11")
    board, tape = streams.live_snapshot(trade_stream(spark, sf), path + "/board", path + "/tape", path + "/state")
    board.awaitTermination()
    tape.awaitTermination()
    rows = spark.read.parquet(path + "/tape")
    newest = rows.agg(F.max("batch")).scalar()
    return ntz(rows.filter(F.col("batch") == newest).drop("batch"), "trade_time")


# Payments of the first ten days whose request is delivered once more 17 days on, long after the delay.
FAR_SQL = "CAST(payment_id AS BIGINT) % 50 = 0 AND requested_at < (SELECT min(ts) FROM events) + INTERVAL 10 DAY"


@query("r1_dedupe_stream", f"""
SELECT payment_id, amount, requested_at, count(*) AS came_out FROM (
 SELECT payment_id, amount, requested_at FROM requests
 UNION ALL SELECT payment_id, amount, requested_at FROM requests WHERE {FAR_SQL})
WHERE CAST(payment_id AS BIGINT) NOT IN (SELECT event_id FROM late_events) GROUP BY 1, 2, 3""")
def r1(spark, sf):
    raw = zoned(ad.raw_requests(spark, sf), "requested_at", "consumed_at")
    first = source(spark, sf, "events").agg(F.min("ts")).scalar().cast("timestamp")
    event, ten_days = F.col("payment_id").cast("long"), F.expr("INTERVAL 10 DAYS")
    in_time = ~((event % 97 == 0) & (F.col("requested_at") < first + ten_days))
    far = raw.filter(in_time & (event % 50 == 0) & (F.col("requested_at") < first + ten_days) & (F.col("consumed_at") == F.col("requested_at")))
    raw = raw.unionByName(far.withColumn("consumed_at", F.col("consumed_at") + F.expr("INTERVAL 17 DAYS")))
    # A repetition within the delay is dropped; one that comes after it counts as new.
    once = streams.dedupe_stream(replay(raw, arrival(spark, sf, event, F.col("consumed_at")), "r1"), "payment_id", "consumed_at", DELAY)
    out = streams.run_append(once.drop("consumed_at"), "r1-out")
    return ntz(out.groupBy("payment_id", "amount", "requested_at").agg(F.count(F.lit(1)).alias("came_out")), "requested_at")


# Rejections of the adapter, within the grace time, and others that come 16 days after acceptance.
KEEP_DAYS = 20
piece("all_rejections", f"""
SELECT payment_id, rejected_at FROM raw_rejections
UNION ALL SELECT CAST(event_id AS VARCHAR), ts + INTERVAL 16 DAY FROM ev WHERE k % 7 = 3 AND ts + INTERVAL 16 DAY <= {ad.CLOCK_SQL}""")
piece("payments_in_time", "SELECT * FROM requests WHERE CAST(payment_id AS BIGINT) NOT IN (SELECT event_id FROM late_events)")
piece("stream_end", """
SELECT epoch_ms(greatest((SELECT max(requested_at) FROM payments_in_time), (SELECT max(rejected_at) FROM all_rejections))) - 3600000 AS ms""")


@query("r2_resolve_stream", f"""
SELECT coalesce(q.payment_id, j.payment_id) AS payment_id, amount, requested_at, rejected_at,
 CASE WHEN q.payment_id IS NULL THEN 'unmatched' WHEN j.payment_id IS NOT NULL THEN 'rejected'
      WHEN epoch_ms(requested_at) + {ad.GRACE} * 60000 <= ms THEN 'accepted' ELSE 'pending' END AS status,
 q.payment_id IS NOT NULL AND epoch_ms(requested_at) + {ad.GRACE} * 60000 <= ms
  AND (j.payment_id IS NULL OR rejected_at >= requested_at + INTERVAL 16 DAY) AS was_accepted
FROM payments_in_time q FULL JOIN all_rejections j USING (payment_id), stream_end
WHERE q.payment_id IS NOT NULL OR epoch_ms(rejected_at) + {KEEP_DAYS} * 86400000 <= ms""")
def r2(spark, sf):
    ad_requests = zoned(ad.raw_requests(spark, sf), "requested_at").drop("consumed_at")
    late = ad.ev(spark, sf).filter("k % 7 = 3").select(
        F.col("event_id").cast("string").alias("payment_id"), (F.col("ts") + F.expr("INTERVAL 16 DAYS")).alias("rejected_at"))
    refused = ad.raw_rejections(spark, sf).drop("consumed_at").unionByName(late.filter(F.col("rejected_at") <= ad.clock(spark, sf)))
    refused = zoned(refused, "rejected_at")
    # One replay of both, so that both streams are cut at the same times.
    both = ad_requests.withColumn("rejected_at", F.lit(None).cast("timestamp")).unionByName(
        refused.withColumns({"amount": F.lit(None).cast("double"), "requested_at": F.lit(None).cast("timestamp")}))
    event = F.col("payment_id").cast("long")
    come = F.when(F.col("rejected_at").isNull(), arrival(spark, sf, event, F.col("requested_at"))).otherwise(
        F.col("rejected_at") + F.make_dt_interval(secs=event * 31 % 3600))
    stream = replay(both, come, "r2")
    log = resolve.resolve_log(
        stream.filter("rejected_at IS NULL").drop("rejected_at"), stream.filter("rejected_at IS NOT NULL").select("payment_id", "rejected_at"),
        timedelta(minutes=ad.GRACE), timedelta(days=KEEP_DAYS), DELAY)
    with resolve.rocks_db(spark):
        states = resolve.payment_states(streams.run_append(log, "r2-out"))
    return ntz(states, "requested_at", "rejected_at")


# An earlier evaluation, ten days before the newest event.
EARLIER_SQL = f"({ad.CLOCK_SQL} - INTERVAL 10 DAY)"
piece("status_then", f"""
SELECT payment_id, amount, requested_at, CASE WHEN rejected_at <= {EARLIER_SQL} THEN rejected_at END AS rejected_at,
 CASE WHEN rejected_at <= {EARLIER_SQL} THEN 'rejected'
      WHEN {EARLIER_SQL} >= requested_at + INTERVAL {ad.GRACE} MINUTE THEN 'accepted' ELSE 'pending' END AS status
FROM pay_status WHERE requested_at <= {EARLIER_SQL}""")


piece("status_again", f"""
SELECT payment_id, amount, requested_at, rejected_at, status FROM pay_status
WHERE requested_at > (SELECT max(requested_at) FROM status_then) - INTERVAL {ad.LOOK_BACK} MINUTE""")


@query("r3_lookback_upsert", """
SELECT * FROM status_again UNION ALL
SELECT * FROM status_then t WHERE NOT EXISTS (FROM status_again a WHERE a.payment_id = t.payment_id)""")
def r3(spark, sf):
    requests = payments.stage_requests(ad.raw_requests(spark, sf))
    rejections = payments.stage_rejections(ad.raw_rejections(spark, sf))
    now = ad.clock(spark, sf).cast("timestamp")
    then = now - F.expr("INTERVAL 10 DAYS")
    path = scratch_path(spark, "r3")

    def save(status):
        keyed = status.drop("status_evaluated_at").withColumn("day", F.to_date("requested_at"))
        sinks.upsert(keyed, path, ["payment_id"], "day")

    save(payments.payment_status(
        requests.filter(F.col("requested_at") <= then), rejections.filter(F.col("rejected_at") <= then), then, ad.GRACE))
    stored = spark.read.parquet(path)
    recent = payments.look_back(requests, stored, "requested_at", "requested_at", ad.LOOK_BACK)
    late = payments.look_back(rejections, stored, "rejected_at", "requested_at", ad.LOOK_BACK)
    save(payments.payment_status(recent, late, now, ad.GRACE))
    return ntz(spark.read.parquet(path).drop("day"), "requested_at", "rejected_at")


@query("r4_bucket_stream", BUCKET_SQL.replace(
    "FROM pay_status", "FROM pay_status WHERE CAST(payment_id AS BIGINT) NOT IN (SELECT event_id FROM late_events)"))
def r4(spark, sf):
    status = payments.payment_status(
        payments.stage_requests(ad.raw_requests(spark, sf)), payments.stage_rejections(ad.raw_rejections(spark, sf)),
        ad.clock(spark, sf).cast("timestamp"), ad.GRACE).drop("status_evaluated_at")
    come = arrival(spark, sf, F.col("payment_id"), F.col("requested_at"))
    buckets = streams.bucket_stream(replay(status, come, "r4"), "5 minutes", DELAY)
    out = ntz(streams.run_log(buckets, ["request_bucket"], "r4-out", every=2), "request_bucket")
    return out.withColumns({c: F.round(c, 2) for c in AMOUNTS})


@query("r5_candle_stream", CANDLE_SQL.format(unit="minute").replace("FROM trades", "FROM trades_in_time"))
def r5(spark, sf):
    candles = streams.candle_stream(replayed_trades(spark, sf), "1 minute", DELAY)
    out = ntz(streams.run_log(candles, ["symbol", "candle_open_time"], "r5-out", every=2), "candle_open_time")
    return out.withColumn("notional_volume", F.round("notional_volume", 2))


@query("r6_incremental_candles", CANDLE_SQL.format(unit="hour"))
def r6(spark, sf):
    trades = market.stage_trades(ad.raw_trades(spark, sf))
    path = scratch_path(spark, "r6")

    def save(candles):
        keyed = candles.withColumn("day", F.to_date("candle_open_time"))
        sinks.upsert(keyed, path, ["symbol", "candle_open_time"], "day")

    # The first run ends in the middle of an hour in the middle of the data; the second one completes it.
    first, last = (trades.agg(f("trade_time")).scalar() for f in (F.min, F.max))
    half = F.date_trunc("hour", first + (last - first) / 2) + F.expr("INTERVAL 31 MINUTES")
    save(market.candles(trades.filter(F.col("trade_time") < half), "hour"))
    newer = market.since_last_bucket(trades, spark.read.parquet(path), "trade_time")
    save(market.candles(newer, "hour"))
    out = ntz(spark.read.parquet(path).drop("day"), "candle_open_time")
    return out.withColumn("notional_volume", F.round("notional_volume", 2))


@query("m1_ohlcv_1m_incremental", CANDLE_SQL.format(unit="minute"))
def m1_incremental(spark, sf):
    """Minute candles in three runs; each recomputes the newest minute and adds what came after it."""
    trades = market.stage_trades(ad.raw_trades(spark, sf))
    first, last = (trades.agg(f("trade_time")).scalar() for f in (F.min, F.max))
    path = scratch_path(spark, "m1")
    for share in (0.3, 0.31, 1.0):
        so_far = trades.filter(F.col("trade_time") <= first + (last - first) * share)
        stored = sinks.read_if_exists(spark, path)
        newer = so_far if stored is None else market.since_last_bucket(so_far, stored, "trade_time")
        candles = market.candles(newer, "minute").withColumn("day", F.to_date("candle_open_time"))
        sinks.upsert(candles, path, ["symbol", "candle_open_time"], "day")
    out = ntz(sinks.read_table(spark, path).drop("day"), "candle_open_time")
    return out.withColumn("notional_volume", F.round("notional_volume", 2))


piece("settled_from", f"""
SELECT time_bucket(INTERVAL 5 MINUTE, max(time_bucket(INTERVAL 5 MINUTE, requested_at)) - INTERVAL {ad.LOOK_BACK} MINUTE) AS edge FROM status_then""")
piece("status_seen", """
SELECT payment_id, amount, requested_at, status FROM status_then WHERE requested_at < (SELECT edge FROM settled_from)
UNION ALL SELECT payment_id, amount, requested_at, status FROM pay_status WHERE requested_at >= (SELECT edge FROM settled_from)""")


@query("m4_payments_incremental", BUCKET_SQL.replace("FROM pay_status", "FROM status_seen"))
def m4_incremental(spark, sf):
    """Counts as of ten days ago, then a refresh: buckets before the look-back keep what they had."""
    requests = payments.stage_requests(ad.raw_requests(spark, sf))
    rejections = payments.stage_rejections(ad.raw_rejections(spark, sf))
    now = ad.clock(spark, sf).cast("timestamp")
    path = scratch_path(spark, "m4")

    def save(status):
        buckets = payments.payments_by_minute(status, 5).withColumn("day", F.to_date("request_bucket"))
        sinks.upsert(buckets, path, ["request_bucket"], "day")

    then = now - F.expr("INTERVAL 10 DAYS")
    save(payments.payment_status(
        requests.filter(F.col("requested_at") <= then), rejections.filter(F.col("rejected_at") <= then), then, ad.GRACE))
    status = payments.payment_status(requests, rejections, now, ad.GRACE)
    save(payments.unsettled(status, sinks.read_table(spark, path), 5, ad.LOOK_BACK))
    out = ntz(sinks.read_table(spark, path).drop("day", "refreshed_at"), "request_bucket")
    return out.withColumns({c: F.round(c, 2) for c in AMOUNTS})


def _user_sessions(gap):
    return f"""
SELECT user_id, min(ts) AS session_start, max(ts) AS session_end, count(*) AS num_events FROM (
 SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS n FROM (
  SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= {gap} THEN 0 ELSE 1 END AS s FROM events))
GROUP BY user_id, n"""


@query("r7_sessionize", _user_sessions("INTERVAL 30 MINUTE"))
def r7(spark, sf):
    from tidemark.operators.sessions import sessionize
    rows = sessionize(
        source(spark, sf, "events").withColumn("who", F.col("user_id").cast("string")), "who", "ts", "event_id")
    return rows.groupBy("user_id", "session_id").agg(
        F.min("ts").alias("session_start"), F.max("ts").alias("session_end"), F.count(F.lit(1)).alias("num_events")
    ).drop("session_id")


@query("r7_session_stream", f"""
SELECT * FROM ({_user_sessions("INTERVAL 12 HOUR").replace("FROM events", f"FROM events WHERE NOT ({LATE_SQL})")})
WHERE session_end + INTERVAL 13 HOUR <= (SELECT max(ts) FROM events)""")
def r7_stream(spark, sf):
    events = zoned(source(spark, sf, "events"), "ts")
    stream = replay(events, arrival(spark, sf, F.col("event_id"), F.col("ts")), "r7")
    sessions = streams.session_stream(stream, "user_id", "ts", "12 hours", DELAY)
    return ntz(streams.run_append(sessions, "r7-out"), "session_start", "session_end")


@query("r8_running_state", BOARD_SQL)
def r8(spark, sf):
    return ntz(streams.run_log(streams.live_prices(replayed_trades(spark, sf)), ["symbol"], "r8", every=3), "updated_at")


@query("r9_micro_batches", """
SELECT symbol, count(*) AS trades, 5 AS batches, CAST((SELECT count(*) FROM trades) AS BIGINT) AS rows_in_batches FROM trades GROUP BY 1""")
def r9(spark, sf):
    options, trigger = streams.pace(1, fmt="file")
    path = scratch_path(spark, "r9")
    trades = ad.raw_trades(spark, sf).select("symbol", "trade_id")
    trades.repartition(5).write.parquet(path)
    stream = spark.readStream.schema(trades.schema).options(**options).parquet(path)
    counted = stream.groupBy("symbol").agg(F.count(F.lit(1)).alias("trades"))
    log = path + "-log"
    batches = streams.until_idle(
        streams.change_log(counted, log, log + "-state", ["symbol"], every=2, trigger=trigger), idle_seconds=5)
    return streams.read_log(spark, log, ["symbol"]).withColumns({
        "batches": F.lit(len(batches)), "rows_in_batches": F.lit(sum(b["numInputRows"] for b in batches)).cast("long")})
