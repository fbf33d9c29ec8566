"""Sessions from gaps between a visitor's events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.ordered import PART, previous_value, running_total, split


def sessionize(
    df: DataFrame, key: str, ts: str, event: str, gap: str = "30 minutes", parts: int | None = None
) -> DataFrame:
    """Add `session_id`: a new session starts where the gap is longer than `gap`.

    Equal timestamps are ordered by `event`. All visitors' histories are worked on in `parts` of
    about equal size, one visitor's in as many as it needs.
    """
    order = [ts, event]
    seen = previous_value(split(df, [key], order, parts), [key], ts, order, "_last")
    starts = F.col("_last").isNull() | (F.col(ts) - F.col("_last") > F.expr(f"INTERVAL {gap}"))
    marked = seen.withColumn("_starts", F.when(starts, 1).otherwise(0))
    numbered = running_total(marked, [key], "_starts", order, "_number")
    # The number is padded to five places and keeps all its digits beyond them.
    text = F.col("_number").cast("string")
    padded = F.when(F.length(text) < 5, F.lpad(text, 5, "0")).otherwise(text)
    return numbered.withColumn("session_id", F.concat(F.col(key), F.lit("-s"), padded)).drop(
        "_last", "_starts", "_number", PART
    )
