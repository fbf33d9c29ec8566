"""Profile of the raw retail feeds."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.aggregates import percent_true


def row_counts(tables: Mapping[str, DataFrame]) -> DataFrame:
    counts = [
        df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("table"), "rows")
        for name, df in tables.items()
    ]
    return reduce(DataFrame.unionByName, counts)


def identification_rate(events: DataFrame) -> DataFrame:
    """Sessions in which the customer became known."""
    known = F.max(F.when(F.col("customer_id").isNotNull(), 1).otherwise(0))
    per_session = events.groupBy("_true_session_id").agg(known.alias("identified"))
    return per_session.agg(
        F.count(F.lit(1)).alias("sessions"),
        F.sum("identified").alias("identified_sessions"),
        F.round(100.0 * F.sum("identified") / F.count(F.lit(1)), 1).alias("identified_pct"),
    )


def category_by_month(events: DataFrame, categories: Sequence[str]) -> DataFrame:
    counts = [F.count_if(F.col("category_id") == c).alias(c) for c in categories]
    rows = events.filter(F.col("category_id").isNotNull())
    month = F.date_format("event_at", "yyyy-MM").alias("month")
    return rows.groupBy(month).agg(*counts, F.count(F.lit(1)).alias("all_events"))


def top_filter_sizes(events: DataFrame, n: int = 8) -> DataFrame:
    rows = events.filter((F.col("page_type") == "plp") & F.col("filter_size").isNotNull())
    counted = rows.groupBy("filter_size").agg(F.count(F.lit(1)).alias("plp_views"))
    return counted.orderBy(F.desc("plp_views"), "filter_size").limit(n)


def return_rate(lines: DataFrame) -> DataFrame:
    return lines.groupBy("category_id").agg(
        F.count(F.lit(1)).alias("lines"), percent_true(F.col("is_returned")).alias("return_pct")
    )


def channel_share(first_party: DataFrame, marketplace: DataFrame) -> DataFrame:
    counts = row_counts({"first_party": first_party, "marketplace": marketplace})
    own = F.max(F.when(F.col("table") == "first_party", F.col("rows"))).alias("first_party")
    theirs = F.max(F.when(F.col("table") == "marketplace", F.col("rows"))).alias("marketplace")
    one = counts.agg(own, theirs)
    total = F.nullif(F.col("first_party") + F.col("marketplace"), F.lit(0))
    return one.withColumn("marketplace_share", F.round(100.0 * F.col("marketplace") / total, 1))
