"""Payment outcomes with late rejections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.timeparts import bucket_start
from tidemark.operators.conform import conform
from tidemark.operators.keyed import first_per_key

STATUSES = ("accepted", "rejected", "pending")


def stage_requests(raw: DataFrame) -> DataFrame:
    """First delivery per payment."""
    first = first_per_key(raw, ["payment_id"], [F.asc("consumed_at")])
    return conform(first, {
        "payment_id": "payment_id",
        "amount": "amount",
        "requested_at": ("requested_at", "timestamp"),
        "consumed_at": ("consumed_at", "timestamp"),
    })


def stage_rejections(raw: DataFrame) -> DataFrame:
    first = first_per_key(raw, ["payment_id"], [F.asc("consumed_at")])
    return conform(first, {
        "payment_id": "payment_id",
        "rejected_at": ("rejected_at", "timestamp"),
        "consumed_at": ("consumed_at", "timestamp"),
    })


def payment_status(
    requests: DataFrame, rejections: DataFrame, now: Column | None = None, grace_minutes: int = 10
) -> DataFrame:
    """Rejected once a rejection exists, accepted once the grace time is over, else pending."""
    now = F.current_timestamp() if now is None else now
    marks = rejections.select("payment_id", "rejected_at", F.lit(True).alias("_rejected"))
    over = now >= F.col("requested_at") + F.expr(f"INTERVAL {grace_minutes} MINUTES")
    status = F.when(F.col("_rejected"), "rejected").when(over, "accepted").otherwise("pending")
    return requests.join(marks, "payment_id", "left").select(
        "payment_id", "amount", "requested_at", "rejected_at",
        status.alias("status"), now.alias("status_evaluated_at"),
    )


def look_back(rows: DataFrame, target: DataFrame, ts: str, target_ts: str, minutes: int) -> DataFrame:
    """Rows newer than the target's newest minus the look-back; all of them for an empty target."""
    edge = target.agg(F.max(target_ts) - F.expr(f"INTERVAL {minutes} MINUTES")).scalar()
    return rows.filter(edge.isNull() | (F.col(ts) > edge))


def status_totals() -> list[Column]:
    """Count and amount of all payments and of each status."""
    counts = [F.count(F.lit(1)).alias("payments_total")]
    amounts = [F.sum("amount").alias("amount_total")]
    for name in STATUSES:
        hit = F.col("status") == name
        counts.append(F.count_if(hit).alias(f"payments_{name}"))
        amounts.append(F.sum(F.when(hit, F.col("amount"))).alias(f"amount_{name}"))
    return counts + amounts


def payments_by_minute(status: DataFrame, minutes: int = 1) -> DataFrame:
    """Counts and amounts per status in fixed-width buckets."""
    bucket = bucket_start("requested_at", minutes).alias("request_bucket")
    return status.groupBy(bucket).agg(*status_totals()).withColumn("refreshed_at", F.current_timestamp())


def unsettled(status: DataFrame, buckets: DataFrame, minutes: int, look_back_minutes: int) -> DataFrame:
    """Payments whose buckets a refresh recomputes: whole ones, from the look-back before the newest on.

    All payments for an empty target.
    """
    back = -(-look_back_minutes // minutes) * minutes
    edge = buckets.agg(F.max("request_bucket") - F.expr(f"INTERVAL {back} MINUTES")).scalar()
    return status.filter(edge.isNull() | (F.col("requested_at") >= edge))
