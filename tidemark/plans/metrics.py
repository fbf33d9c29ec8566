"""Named metrics over the marts."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_KINDS = {"sum": F.sum, "avg": F.avg, "max": F.max, "min": F.min}


@dataclass(frozen=True)
class Cube:
    """Dimensions and measures of one mart; a measure is (kind, column or expression)."""

    dimensions: tuple[str, ...]
    measures: dict[str, tuple[str, Column | str] | None] = field(default_factory=dict)


def _measures(*pairs: tuple[str, str]) -> dict:
    """Measures named after their kind and column, plus a count."""
    return {"count": None} | {f"{kind}_{column}": (kind, column) for kind, column in pairs}


def home_win_rate() -> tuple[str, Column]:
    return "avg", F.when(F.col("home_team_won"), 1.0).otherwise(0.0)


def cubes() -> dict[str, Cube]:
    return {
        "nba_game_results": Cube(
            ("game_id", "game_date", "game_type", "home_team_name", "away_team_name", "arena_name",
             "home_team_won"),
            _measures(("avg", "point_margin"), ("avg", "home_score"), ("avg", "away_score"))
            | {"home_win_rate": home_win_rate()},
        ),
        "nba_player_season_stats": Cube(
            ("person_id", "first_name", "last_name", "season_start_year", "season_label",
             "game_type", "primary_team_id"),
            _measures(
                ("sum", "games_played"),
                ("sum", "total_points"),
                ("max", "total_points"),
                ("sum", "total_rebounds"),
                ("sum", "total_assists"),
                ("sum", "total_steals"),
                ("sum", "total_blocks"),
                ("sum", "total_turnovers"),
                ("avg", "points_per_game"),
                ("max", "points_per_game"),
                ("avg", "rebounds_per_game"),
                ("avg", "assists_per_game"),
                ("avg", "field_goal_pct"),
                ("avg", "three_point_pct"),
                ("avg", "free_throw_pct"),
            ),
        ),
        "nba_team_dim": Cube(
            ("team_id", "current_full_name", "current_league", "has_relocated_or_renamed"),
            _measures(),
        ),
        "spotify_top_artists": Cube(
            ("artist_id", "artist_name", "genres", "rank_short_term", "rank_medium_term",
             "rank_long_term"),
            _measures(("avg", "popularity"), ("max", "followers")),
        ),
        "spotify_top_tracks": Cube(
            ("track_id", "track_name", "artist_names", "album_name", "explicit", "rank_short_term",
             "rank_medium_term", "rank_long_term"),
            _measures(("avg", "popularity"), ("max", "popularity")),
        ),
    }


def metric_query(
    df: DataFrame, cube: Cube, dimensions: Sequence[str], measures: Sequence[str],
    filters: Sequence[Column] = (),
) -> DataFrame:
    """Group a mart by some of its dimensions and compute some of its measures."""
    unknown = [d for d in dimensions if d not in cube.dimensions]
    unknown += [m for m in measures if m not in cube.measures]
    if unknown:
        raise KeyError(f"not in the cube: {', '.join(unknown)}")
    for condition in filters:
        df = df.filter(condition)
    aggs = []
    for name in measures:
        spec = cube.measures[name]
        value = F.count(F.lit(1)) if spec is None else _KINDS[spec[0]](spec[1])
        aggs.append(value.alias(name))
    return df.groupBy(*dimensions).agg(*aggs)
