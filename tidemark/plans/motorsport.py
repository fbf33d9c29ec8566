"""Motorsport timing feeds: staging."""

from __future__ import annotations

from pyspark.sql import DataFrame

from tidemark.operators.conform import conform

# Per feed, the raw text timestamp columns and the names they get.
TIMES = {
    "drivers": {},
    "laps": {"date_start": "lap_start_at"},
    "meetings": {"date_start": "meeting_start_at", "date_end": "meeting_end_at"},
    "pit": {"date": "pit_at"},
    "sessions": {"date_start": "session_start_at", "date_end": "session_end_at"},
    "stints": {},
    "weather": {"date": "observed_at"},
}


def stage_timing(raw: DataFrame, feed: str) -> DataFrame:
    """Pass a timing feed through with its timestamps typed and named."""
    times = TIMES[feed] | {"ingested_at": "ingested_at"}
    spec = {
        times.get(c, c): (c, "timestamp_ntz") if c in times else c for c in raw.columns
    }
    return conform(raw, spec)
