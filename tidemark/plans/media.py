"""Media listening: staging and marts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.timeparts import partial_date
from tidemark.operators.aggregates import pivot_max
from tidemark.operators.conform import conform

PERIODS = ("short_term", "medium_term", "long_term")


def _minutes():
    return F.round(F.col("duration_ms") / 60000.0, 2)


def stage_recently_played(raw: DataFrame) -> DataFrame:
    played = F.col("played_at").cast("timestamp_ntz")
    kept = ["track_id", "track_name", "artist_ids", "artist_names", "album_id", "album_name",
            "duration_ms"]
    rest = ["explicit", "popularity", "spotify_url", "context_type", "context_uri"]
    return conform(raw, {
        "played_at": played,
        "played_date": F.date_trunc("day", played).cast("timestamp_ntz"),
        "played_hour": F.hour(played),
        **{c: c for c in kept},
        "duration_minutes": _minutes(),
        **{c: c for c in rest},
        "ingested_at": ("ingested_at", "timestamp_ntz"),
    })


def stage_top_artists(raw: DataFrame) -> DataFrame:
    kept = ["rank", "time_range", "popularity", "followers", "genres", "spotify_url", "image_url"]
    return conform(raw, {
        "artist_id": "id", "artist_name": "name", **{c: c for c in kept},
        "ingested_at": ("ingested_at", "timestamp_ntz"),
    })


def stage_top_tracks(raw: DataFrame) -> DataFrame:
    kept = ["rank", "time_range", "artist_ids", "artist_names", "album_id", "album_name"]
    rest = ["explicit", "popularity", "spotify_url", "preview_url"]
    return conform(raw, {
        "track_id": "id", "track_name": "name", **{c: c for c in kept},
        "album_release_date": partial_date("album_release_date"),
        "duration_ms": "duration_ms",
        "duration_minutes": _minutes(),
        **{c: c for c in rest},
        "ingested_at": ("ingested_at", "timestamp_ntz"),
    })


def _by_period(ranked: DataFrame, keys: list[str], maxima: list[str]) -> DataFrame:
    ranks = pivot_max("time_range", {"{}_" + p: p for p in PERIODS}, {"rank": "rank"})
    return ranked.groupBy(*keys).agg(*[F.max(c).alias(c) for c in maxima], *ranks)


def top_artists_by_period(artists: DataFrame) -> DataFrame:
    keys = ["artist_id", "artist_name", "genres", "spotify_url"]
    return _by_period(artists, keys, ["popularity", "followers", "image_url", "ingested_at"])


def top_tracks_by_period(tracks: DataFrame) -> DataFrame:
    keys = ["track_id", "track_name", "artist_names", "album_name", "album_release_date",
            "duration_minutes", "explicit", "spotify_url"]
    return _by_period(tracks, keys, ["popularity", "ingested_at"])


def best_first(ranked: DataFrame, rank: str, *ties: str, missing: int = 999) -> DataFrame:
    """Sort by rank, rows without a rank last."""
    return ranked.orderBy(F.coalesce(F.col(rank), F.lit(missing)), *ties)


def plays_by_hour(plays: DataFrame) -> DataFrame:
    """Plays and distinct tracks for each of the 24 hours, hours without plays as zero."""
    spine = plays.sparkSession.range(24).select(F.col("id").cast("int").alias("hour"))
    counted = plays.groupBy(F.col("played_hour").alias("hour")).agg(
        F.count(F.lit(1)).alias("plays"), F.count_distinct("track_id").alias("unique_tracks")
    )
    zero = {n: F.coalesce(n, F.lit(0).cast("bigint")) for n in ("plays", "unique_tracks")}
    return spine.join(counted, "hour", "left").withColumns(zero)


def newest_plays(plays: DataFrame, n: int = 50) -> DataFrame:
    """The `n` newest plays, ties by track."""
    return plays.orderBy(F.desc("played_at"), "track_id").limit(n)
