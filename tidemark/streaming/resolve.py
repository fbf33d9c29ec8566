"""Payment outcomes from two streams by one keyed state machine with event-time timers.

Payments are kept in buckets of their id: a bucket is read and written once per batch, and has one
timer, so the calls of a batch grow with the buckets and not with the payments.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from contextlib import contextmanager
from datetime import timedelta

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidemark.operators.keyed import first_per_key

_STATE = "payments binary, timer long"
_CHANGE = "payment_id string, amount double, requested_at long, rejected_at long, status string"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_NONE = (None, None, None, None, None)
BUCKETS = 1024  # fixed for the life of a query's state


class Resolver(StatefulProcessor):
    """States of payments: pending, accepted when the grace time is over, rejected at any time.

    One value and one timer per bucket, at the first time something is due in it. A payment's due
    time is the end of its grace time, then the end of what is kept. A rejection may come before its
    request. Times are microseconds; timers fire once the watermark has passed them.
    """

    def __init__(self, grace: timedelta, keep: timedelta):
        self.grace, self.keep = (t // timedelta(milliseconds=1) for t in (grace, keep))

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.bucket = handle.getValueState("bucket", _STATE)

    def _load(self) -> tuple[dict, int | None]:
        """The bucket's payments, id -> (amount, requested_at, rejected_at, status, due), and its timer."""
        found = self.bucket.get()
        return (pickle.loads(found[0]), found[1]) if found else ({}, None)

    def _save(self, payments: dict, timer: int | None, fired: int | None = None) -> None:
        if timer is not None and timer == fired:
            timer = None
        at = None
        if payments:
            # Timers before the watermark fire: one millisecond less is at the watermark too.
            at = min(p[4] for p in payments.values()) - 1
            at = at + 1 if at == fired else at
        if at != timer:
            if timer is not None:
                self.handle.deleteTimer(timer)
            if at is not None:
                self.handle.registerTimer(at)
        if payments:
            self.bucket.update((pickle.dumps(payments, pickle.HIGHEST_PROTOCOL), at))
        else:
            self.bucket.clear()

    def _settled(self, name, payment: tuple, mark: int) -> tuple[tuple | None, Row | None]:
        """What is left of a payment with a request at the watermark, and its change if there is one."""
        amount, requested_at, rejected_at, status, _ = payment
        due = requested_at // 1000 + self.grace
        change = None
        if status == "pending" and due <= mark:
            status = "accepted"
            change = Row(payment_id=name, amount=amount, requested_at=requested_at, rejected_at=None, status=status)
        if due + self.keep <= mark:
            return None, change
        return (amount, requested_at, rejected_at, status, due if status == "pending" else due + self.keep), change

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        payments, timer = self._load()
        mark = timerValues.getCurrentWatermarkInMs()
        before = {}
        for row in rows:
            name, at = row["payment_id"], row["at"]
            if at is None:
                continue
            if name not in before:
                # Timers fire after the rows of a batch; what is due already is done first.
                payment = payments.get(name, _NONE)
                if payment[1] is not None:
                    payment, change = self._settled(name, payment, mark)
                    if change:
                        yield change
                before[name] = payments[name] = payment or _NONE
            amount, requested_at, rejected_at, status, due = payments[name]
            # Repeated deliveries change nothing; of several rejections the earliest counts.
            if row["is_request"] and requested_at is None:
                payments[name] = (row["amount"], at, rejected_at, status, due)
            elif not row["is_request"] and (rejected_at is None or at < rejected_at):
                payments[name] = (amount, requested_at, at, status, at // 1000 + self.keep if due is None else due)
        for name, (_, _, old_rejected, old, _) in before.items():
            amount, requested_at, rejected_at, status, due = payments[name]
            if requested_at is None:
                continue
            status = "rejected" if rejected_at is not None else status or "pending"
            due = requested_at // 1000 + self.grace + (0 if status == "pending" else self.keep)
            payments[name] = (amount, requested_at, rejected_at, status, due)
            if status != old or rejected_at != old_rejected:
                yield Row(payment_id=name, amount=amount, requested_at=requested_at, rejected_at=rejected_at, status=status)
        self._save(payments, timer)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        payments, timer = self._load()
        mark = timerValues.getCurrentWatermarkInMs()
        for name in [n for n, p in payments.items() if p[4] <= mark]:
            payment = payments.pop(name)
            amount, requested_at, rejected_at, _, _ = payment
            if requested_at is None:
                yield Row(payment_id=name, amount=None, requested_at=None, rejected_at=rejected_at, status="unmatched")
                continue
            left, change = self._settled(name, payment, mark)
            if change:
                yield change
            if left:
                payments[name] = left
        self._save(payments, timer, expiredTimerInfo.getExpiryTimeInMs())

    def close(self) -> None:
        pass


@contextmanager
def rocks_db(spark: SparkSession):
    """The state store that timers need, for the queries started inside."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, _ROCKS)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_PROVIDER)
        else:
            spark.conf.set(_PROVIDER, before)


def resolve_log(
    requests: DataFrame, rejections: DataFrame, grace: timedelta, keep: timedelta = timedelta(days=7), delay: str = "5 minutes",
    buckets: int = BUCKETS,
) -> DataFrame:
    """Change log of payment states by payment_id, for append mode; `payment_states` reads it.

    A request is pending on arrival, accepted when the watermark has passed its grace time, and
    rejected when its rejection arrives, before or after that. Rows may be out of order by
    `delay`; later ones are dropped. The state of a payment goes `keep` after its grace time, so a
    rejection that comes later finds nothing. A rejection without a request is kept for `keep` and
    then comes out as `unmatched`. A bucket's open payments are in memory together, so `buckets` should
    grow with them. Start the query inside `rocks_db`.
    """
    asked = requests.select("payment_id", "amount", F.col("requested_at").alias("_at"), F.lit(True).alias("is_request"))
    refused = rejections.select(
        "payment_id", F.lit(None).cast("double").alias("amount"), F.col("rejected_at").alias("_at"), F.lit(False).alias("is_request")
    )
    both = asked.unionByName(refused).withWatermark("_at", delay).withColumn("at", F.unix_micros("_at"))
    placed = both.withColumn("bucket", F.pmod(F.xxhash64("payment_id"), F.lit(buckets)))
    log = placed.groupBy("bucket").transformWithState(
        statefulProcessor=Resolver(grace, keep), outputStructType=_CHANGE, outputMode="Append", timeMode="EventTime"
    )
    return log.withColumns({c: F.timestamp_micros(c) for c in ("requested_at", "rejected_at")})


def payment_states(log: DataFrame) -> DataFrame:
    """Current state per payment of a log, and whether it was accepted on the way.

    States only go from pending over accepted to rejected, and of rejections the earliest counts.
    """
    step = F.when(F.col("status") == "rejected", 2).when(F.col("status") == "accepted", 1).otherwise(0)
    last = first_per_key(log.withColumn("_step", step), ["payment_id"], [F.desc("_step"), F.asc("rejected_at")]).drop("_step")
    accepted = log.filter("status = 'accepted'").select("payment_id").distinct().withColumn("_accepted", F.lit(True))
    joined = last.join(accepted, "payment_id", "left")
    return joined.withColumn("was_accepted", F.coalesce("_accepted", F.lit(False))).drop("_accepted")
