from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tidemark.plans import payments

CLOCK = "2026-01-01 12:00:00"


def at(clock):
    return f"2026-01-01 {clock}"


@pytest.fixture(scope="module")
def feeds(spark):
    requests = [("p_rejected_old", 10.0, at("11:00:00")), ("p_accepted_old", 20.0, at("11:00:00")),
                ("p_accepted_boundary", 30.0, at("11:50:00")), ("p_pending_boundary", 40.0, at("11:50:01")),
                ("p_pending_recent", 50.0, at("11:55:00")), ("p_rejected_in_grace", 60.0, at("11:55:00"))]
    rejections = [("p_rejected_old", at("11:05:00")), ("p_rejected_in_grace", at("11:56:00")),
                  ("p_without_request", at("11:56:00"))]
    req = spark.createDataFrame(requests, "payment_id string, amount double, requested_at string")
    rej = spark.createDataFrame(rejections, "payment_id string, rejected_at string")
    return (req.withColumn("requested_at", F.col("requested_at").cast("timestamp")),
            rej.withColumn("rejected_at", F.col("rejected_at").cast("timestamp")))


def test_outcomes_around_the_grace_boundary(feeds):
    out = payments.payment_status(*feeds, F.lit(CLOCK).cast("timestamp"), 10)
    assert {r["payment_id"]: r["status"] for r in out.collect()} == {
        "p_rejected_old": "rejected", "p_accepted_old": "accepted", "p_accepted_boundary": "accepted",
        "p_pending_boundary": "pending", "p_pending_recent": "pending", "p_rejected_in_grace": "rejected"}


def test_buckets(feeds):
    status = payments.payment_status(*feeds, F.lit(CLOCK).cast("timestamp"), 10)
    out = payments.payments_by_minute(status, 5)
    got = {r["request_bucket"].strftime("%H:%M"): r for r in out.collect()}
    assert sorted(got) == ["11:00", "11:50", "11:55"]
    assert (got["11:50"]["payments_total"], got["11:50"]["payments_pending"]) == (2, 1)
    assert got["11:00"]["amount_pending"] is None and got["11:00"]["amount_total"] == 30.0


def test_first_delivery_wins(spark):
    raw = spark.createDataFrame(
        [("p", 1.0, at("11:00:00"), at("11:02:00")), ("p", 2.0, at("11:00:00"), at("11:01:00"))],
        "payment_id string, amount double, requested_at string, consumed_at string")
    assert [r["amount"] for r in payments.stage_requests(raw).collect()] == [2.0]


def test_look_back_window(spark):
    rows = spark.createDataFrame([(1, datetime(2026, 1, 1, 11, 40)), (2, datetime(2026, 1, 1, 11, 41))], "id int, t timestamp")
    target = spark.createDataFrame([(datetime(2026, 1, 1, 12, 0),)], "t timestamp")
    assert [r["id"] for r in payments.look_back(rows, target, "t", "t", 20).collect()] == [2]
    assert payments.look_back(rows, target.limit(0), "t", "t", 20).count() == 2


@pytest.mark.parametrize("minutes", [1, 5, 7, 45, 1440, 2000])
def test_buckets_of_any_width_start_as_in_sql(spark, minutes):
    import duckdb

    from tidemark.functions.timeparts import bucket_start
    times = [datetime(1999, 12, 31, 23, 59), datetime(2000, 1, 3), datetime(2024, 2, 29, 12, 34, 56)]
    df = spark.createDataFrame([(t,) for t in times], "t timestamp_ntz")
    got = [r[0] for r in df.select("t", bucket_start("t", minutes).alias("b")).orderBy("t").select("b").collect()]
    want = [duckdb.sql(f"SELECT time_bucket(INTERVAL {minutes} MINUTE, TIMESTAMP '{t}')").fetchall()[0][0] for t in times]
    assert got == want
