"""Football match events: staging and marts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.scalars import zero_if_null
from tidemark.functions.timeparts import clock_seconds
from tidemark.operators.conform import conform

# Counted event types and the name of their count.
COUNTED = {"Shot": "total_shots", "Pass": "total_passes", "Dribble": "total_dribbles",
           "Pressure": "total_pressures", "Carry": "total_carries"}


def _same(*names: str) -> dict[str, str]:
    return {n: n for n in names}


LOADED = {"ingested_at": ("ingested_at", "timestamp_ntz")}


def stage_competitions(raw: DataFrame) -> DataFrame:
    names = _same("competition_id", "competition_name", "country_name", "competition_gender",
                  "competition_youth", "competition_international", "season_id", "season_name",
                  "match_available_360")
    return conform(raw, names | LOADED)


def stage_matches(raw: DataFrame) -> DataFrame:
    """Available matches with result and goal difference; kick-off is seconds since midnight."""
    home, away = F.col("home_score"), F.col("away_score")
    result = F.when(home > away, "home_win").when(home < away, "away_win").otherwise("draw")
    return conform(
        raw.filter(F.col("match_status") == "available"),
        {
            "match_id": "match_id",
            "match_date": ("match_date", "date"),
            "kick_off": clock_seconds("kick_off"),
            **_same("competition_id", "competition_name", "season_id", "season_name",
                    "home_team_name", "away_team_name", "home_score", "away_score"),
            "goal_difference": home - away,
            "match_result": result,
            **_same("match_status", "match_week", "competition_stage", "stadium_name",
                    "referee_name"),
            **LOADED,
        },
    )


def stage_events(raw: DataFrame) -> DataFrame:
    """Events with the match clock in seconds; the event time is seconds into the period."""
    return conform(raw, {
        **_same("event_id", "match_id", "event_index", "period"),
        "event_time": clock_seconds("timestamp"),
        **_same("minute", "second"),
        "seconds_elapsed": F.col("minute") * 60 + F.col("second"),
        **_same("event_type", "possession", "possession_team", "play_pattern", "team",
                "player_id", "player_name", "location_x", "location_y", "duration"),
        **LOADED,
    })


def stage_lineups(raw: DataFrame) -> DataFrame:
    names = _same("match_id", "team_name", "player_id", "player_name", "player_nickname",
                  "jersey_number", "country_name")
    return conform(raw, names | LOADED)


def _counts() -> list:
    kinds = [F.count_if(F.col("event_type") == kind).alias(n) for kind, n in COUNTED.items()]
    return [F.count(F.lit(1)).alias("total_events"), *kinds]


def match_summary(matches: DataFrame, events: DataFrame) -> DataFrame:
    """Match context with event counts; matches without events count zero."""
    counts = events.groupBy("match_id").agg(*_counts())
    names = ["total_events", *COUNTED.values()]
    kept = matches.drop("kick_off", "match_status", "referee_name")
    return kept.join(counts, "match_id", "left").withColumns({n: zero_if_null(n) for n in names})


def player_stats(events: DataFrame, lineups: DataFrame) -> DataFrame:
    """Event counts per player and team with line-up appearances."""
    acts = events.filter(F.col("player_id").isNotNull())
    acts = acts.groupBy("player_id", "player_name", "team").agg(
        F.count_distinct("match_id").alias("matches_in_events"),
        *_counts(),
        F.round(F.sum(F.coalesce("duration", F.lit(0.0))) / 60.0, 2).alias("total_duration_minutes"),
    )
    named = lineups.groupBy("player_id", F.col("team_name").alias("team")).agg(
        F.count_distinct("match_id").alias("lineup_appearances"),
        F.max("country_name").alias("country_name"),
    )
    joined = acts.join(named, ["player_id", "team"], "left")
    return joined.withColumn("lineup_appearances", zero_if_null("lineup_appearances"))
