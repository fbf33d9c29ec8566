"""Trade staging and OHLCV candles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.conform import conform


def stage_trades(raw: DataFrame) -> DataFrame:
    return conform(raw, {
        "trade_id": "trade_id",
        "symbol": "symbol",
        "price": "price",
        "quantity": "quantity",
        "notional_value": F.col("price") * F.col("quantity"),
        "buyer_maker": "buyer_maker",
        "trade_time": ("trade_time", "timestamp"),
        "event_time": ("event_time", "timestamp"),
        "consumed_at": ("consumed_at", "timestamp"),
    })


def ohlcv() -> list[Column]:
    """Aggregates of one candle; equal times are ordered by trade id."""
    at = F.struct("trade_time", "trade_id")
    return [
        F.min_by("price", at).alias("open"),
        F.max("price").alias("high"),
        F.min("price").alias("low"),
        F.max_by("price", at).alias("close"),
        F.sum("quantity").alias("volume"),
        F.sum("notional_value").alias("notional_volume"),
        F.count(F.lit(1)).alias("trade_count"),
    ]


def candles(trades: DataFrame, unit: str = "minute") -> DataFrame:
    """One candle per symbol and minute (or hour)."""
    opened = F.date_trunc(unit, "trade_time").cast(trades.schema["trade_time"].dataType)
    return trades.groupBy("symbol", opened.alias("candle_open_time")).agg(*ohlcv())


def rollup_candles(fine: DataFrame, unit: str = "hour") -> DataFrame:
    """Coarser candles from finer ones, without going back to the trades."""
    opened = F.date_trunc(unit, "candle_open_time").cast(fine.schema["candle_open_time"].dataType)
    return fine.groupBy("symbol", opened.alias("_opened")).agg(
        F.min_by("open", "candle_open_time").alias("open"),
        F.max("high").alias("high"),
        F.min("low").alias("low"),
        F.max_by("close", "candle_open_time").alias("close"),
        F.sum("volume").alias("volume"),
        F.sum("notional_volume").alias("notional_volume"),
        F.sum("trade_count").alias("trade_count"),
    ).withColumnRenamed("_opened", "candle_open_time")


def since_last_bucket(rows: DataFrame, target: DataFrame, ts: str, opened: str = "candle_open_time"):
    """Rows that can change the target: from the start of its newest bucket on.

    The newest bucket is recomputed whole. An empty target takes everything.
    """
    newest = target.agg(F.max(opened)).scalar()
    return rows.filter(newest.isNull() | (F.col(ts) >= newest))
