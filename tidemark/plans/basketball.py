"""Basketball box scores: staging and marts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.scalars import ratio
from tidemark.functions.timeparts import season_label, season_start
from tidemark.operators.aggregates import pivot_max, weighted_mean
from tidemark.operators.conform import conform_wide
from tidemark.operators.keyed import mode_per_key

# Raw names the snake-case rule does not cover, and 0/1 columns.
RENAMES = {
    "hometeamId": "home_team_id", "hometeamCity": "home_team_city", "hometeamName": "home_team_name",
    "awayteamId": "away_team_id", "awayteamCity": "away_team_city", "awayteamName": "away_team_name",
    "opponentteamId": "opponent_team_id", "opponentteamCity": "opponent_team_city",
    "opponentteamName": "opponent_team_name", "playerteamId": "player_team_id",
    "playerteamCity": "player_team_city", "playerteamName": "player_team_name",
    "winner": "winner_team_id", "numMinutes": "minutes_played", "gameDateTimeEst": "game_datetime_est",
}
GAME_FLAGS = {"home": "is_home", "win": "is_win"}
ADVANCED_FLAGS = GAME_FLAGS | {"doubleDouble": "is_double_double", "tripleDouble": "is_triple_double"}
PLAYER_FLAGS = {
    "guard": "is_guard", "forward": "is_forward", "center": "is_center",
    "dleagueFlag": "is_dleague", "nbaFlag": "is_nba", "gamesPlayedFlag": "has_games_played",
}
CASTS = {
    "gameDate": "date", "birthDate": "date",
    "gameDateTimeEst": "timestamp_ntz", "ingested_at": "timestamp_ntz",
}


def stage_games(raw: DataFrame) -> DataFrame:
    games = conform_wide(raw, RENAMES, casts=CASTS)
    return games.withColumn("home_team_won", F.col("winner_team_id") == F.col("home_team_id"))


def stage_players(raw: DataFrame) -> DataFrame:
    return conform_wide(raw, RENAMES, PLAYER_FLAGS, CASTS)


def stage_player_box(raw: DataFrame) -> DataFrame:
    """Player box scores, traditional or advanced; minutes come as text."""
    return conform_wide(raw, RENAMES, ADVANCED_FLAGS, CASTS, numbers=["numMinutes"])


def stage_team_box(raw: DataFrame) -> DataFrame:
    """Team box scores, traditional or advanced."""
    return conform_wide(raw, RENAMES, GAME_FLAGS, CASTS)


def stage_histories(raw: DataFrame) -> DataFrame:
    return conform_wide(raw, RENAMES, casts=CASTS)


def game_results(games: DataFrame, team_box: DataFrame) -> DataFrame:
    """One row per game with both teams' box score side by side."""
    measures = ["field_goals_made", "field_goals_attempted", "three_pointers_made",
                "rebounds_total", "assists", "turnovers", "points_in_the_paint"]
    sides = pivot_max(
        "is_home", {"home_{}": True, "away_{}": False}, {m: m for m in measures}
    )
    box = team_box.groupBy("game_id").agg(*sides)
    kept = ["game_id", "game_date", "game_datetime_est", "game_type", "home_team_id",
            "home_team_name", "away_team_id", "away_team_name", "home_score", "away_score",
            "home_team_won", "attendance", "arena_name", "ingested_at"]
    margin = (F.col("home_score") - F.col("away_score")).alias("point_margin")
    return games.select(*kept, margin).join(box, "game_id", "left")


def _totals() -> list:
    names = {
        "points": "points", "rebounds": "rebounds_total", "assists": "assists",
        "steals": "steals", "blocks": "blocks", "turnovers": "turnovers",
        "field_goals_made": "field_goals_made",
        "field_goals_attempted": "field_goals_attempted",
        "three_pointers_made": "three_pointers_made",
        "three_pointers_attempted": "three_pointers_attempted",
        "free_throws_made": "free_throws_made",
        "free_throws_attempted": "free_throws_attempted",
    }
    return [F.sum(source).alias(f"total_{name}") for name, source in names.items()]


def _rates(prefix: str = "") -> dict:
    return {
        "points_per_game": ratio("total_points", "games_played", 1),
        "rebounds_per_game": ratio("total_rebounds", "games_played", 1),
        "assists_per_game": ratio("total_assists", "games_played", 1),
        f"{prefix}field_goal_pct": ratio("total_field_goals_made", "total_field_goals_attempted", 3),
        f"{prefix}three_point_pct": ratio(
            "total_three_pointers_made", "total_three_pointers_attempted", 3),
        f"{prefix}free_throw_pct": ratio("total_free_throws_made", "total_free_throws_attempted", 3),
    }


_ATTEMPTS = [f"total_{shot}_{what}" for shot in ("field_goals", "three_pointers", "free_throws")
             for what in ("made", "attempted")]


def _played(box: DataFrame) -> DataFrame:
    return box.filter(F.col("person_id").isNotNull() & F.col("minutes_played").isNotNull())


def player_career_stats(box: DataFrame, players: DataFrame) -> DataFrame:
    """Career totals and per-game rates over the games a player took part in."""
    career = _played(box).groupBy("person_id").agg(
        F.count_distinct("game_id").alias("games_played"),
        F.min("game_date").alias("first_game_date"),
        F.max("game_date").alias("last_game_date"),
        *_totals(),
    )
    career = career.withColumns(_rates("career_")).drop(*_ATTEMPTS)
    bio = players.select("person_id", "first_name", "last_name", "is_guard", "is_forward",
                         "is_center", "draft_year", "height_inches")
    return career.join(bio, "person_id", "left")


def player_season_stats(box: DataFrame, players: DataFrame) -> DataFrame:
    """Per player, season and game type; a traded player keeps one row with the main team."""
    keys = ["person_id", "season_start_year", "game_type"]
    games = _played(box).filter(F.col("game_date").isNotNull() & F.col("game_type").isNotNull())
    games = games.withColumn("season_start_year", season_start("game_date"))
    totals = games.groupBy(*keys).agg(F.count_distinct("game_id").alias("games_played"), *_totals())
    teams = mode_per_key(games, keys, "player_team_id", "primary_team_id")
    names = players.select("person_id", "first_name", "last_name")
    return (
        totals.withColumns({"season_label": season_label("season_start_year"), **_rates()})
        .drop(*_ATTEMPTS)
        .join(teams, keys, "left")
        .join(names, "person_id", "left")
    )


def player_advanced_career(box: DataFrame, players: DataFrame) -> DataFrame:
    """Minutes-weighted efficiency over games with recorded minutes and ratings."""
    minutes = F.col("minutes_played").cast("double")
    games = box.filter(
        F.col("person_id").isNotNull() & (minutes > 0) & F.col("offensive_rating").isNotNull()
    )

    def weighted(col, digits):
        return F.round(weighted_mean(col, minutes), digits)

    played = F.count_distinct("game_id")
    career = games.groupBy("person_id").agg(
        played.alias("games_with_advanced"),
        F.round(F.sum(minutes) / F.nullif(played, F.lit(0)), 1).alias("minutes_per_game"),
        F.count_if("is_double_double").alias("double_doubles"),
        F.count_if("is_triple_double").alias("triple_doubles"),
        weighted("usage_percentage", 3).alias("usage_pct"),
        weighted("true_shooting_percentage", 3).alias("true_shooting_pct"),
        weighted("effective_field_goal_percentage", 3).alias("effective_field_goal_pct"),
        weighted("offensive_rating", 1).alias("offensive_rating"),
        weighted("defensive_rating", 1).alias("defensive_rating"),
        weighted("net_rating", 1).alias("net_rating"),
        weighted("assist_percentage", 3).alias("assist_pct"),
        weighted("rebound_percentage", 3).alias("rebound_pct"),
        weighted("player_impact_estimate", 3).alias("player_impact_estimate"),
    )
    bio = players.select("person_id", "first_name", "last_name", "is_guard", "is_forward", "is_center")
    return career.join(bio, "person_id", "left")


def team_season_summary(team_box: DataFrame) -> DataFrame:
    """Win/loss record and scoring averages per team and regular season."""
    won, home = F.col("is_win"), F.col("is_home")
    season = (
        team_box.filter(F.col("game_type") == "Regular Season")
        .groupBy("team_id", season_start("game_date").alias("season_start_year"))
        .agg(
            F.count(F.lit(1)).alias("games_played"),
            F.count_if(won).alias("wins"),
            F.count_if(~won).alias("losses"),
            F.count_if(home & won).alias("home_wins"),
            F.count_if(~home & won).alias("away_wins"),
            F.sum("team_score").alias("_for"),
            F.sum("opponent_score").alias("_against"),
        )
    )
    return season.select(
        "team_id", "season_start_year",
        season_label("season_start_year").alias("season_label"),
        "games_played", "wins", "losses", "home_wins", "away_wins",
        ratio("wins", F.col("wins") + F.col("losses"), 3).alias("win_pct"),
        ratio("_for", "games_played", 1).alias("points_for_per_game"),
        ratio("_against", "games_played", 1).alias("points_against_per_game"),
        ratio(F.col("_for") - F.col("_against"), "games_played", 1).alias("point_margin_per_game"),
    )


# Published mean -> (source column, digits).
PROFILE = {
    "offensive_rating": ("offensive_rating", 1),
    "defensive_rating": ("defensive_rating", 1),
    "net_rating": ("net_rating", 1),
    "pace": ("pace", 1),
    "effective_field_goal_pct": ("effective_field_goal_percentage", 3),
    "true_shooting_pct": ("true_shooting_percentage", 3),
    "assist_pct": ("assist_percentage", 3),
    "rebound_pct": ("rebound_percentage", 3),
    "turnover_pct": ("team_turnover_percentage", 3),
    "three_point_attempt_rate": ("percent_field_goal_attempts_3_point", 3),
    "points_in_paint_share": ("percent_points_in_paint", 3),
    "fast_break_points_share": ("percent_points_fast_break", 3),
}


def team_advanced_profile(team_box: DataFrame) -> DataFrame:
    """Mean efficiency per team and regular season."""
    means = [F.round(F.avg(c), digits).alias(name) for name, (c, digits) in PROFILE.items()]
    season = season_start("game_datetime_est").alias("season_start_year")
    grouped = team_box.filter(F.col("game_type") == "Regular Season").groupBy("team_id", season)
    profile = grouped.agg(F.count(F.lit(1)).alias("games_played"), *means)
    return profile.withColumn("season_label", season_label("season_start_year"))


def team_dim(histories: DataFrame) -> DataFrame:
    """Current identity of a franchise with its history rolled up, in one aggregation."""
    era = F.struct("season_founded", "team_city", "team_name", "team_abbrev",
                   "season_active_till", "league")
    teams = histories.groupBy("team_id").agg(
        F.max_by(era, F.struct("season_founded", "season_active_till")).alias("e"),
        F.min("season_founded").alias("franchise_first_season"),
        F.count(F.lit(1)).alias("franchise_era_count"),
    )
    return teams.select(
        "team_id",
        F.col("e.team_city").alias("current_team_city"),
        F.col("e.team_name").alias("current_team_name"),
        F.concat("e.team_city", F.lit(" "), "e.team_name").alias("current_full_name"),
        F.col("e.team_abbrev").alias("current_team_abbrev"),
        F.col("e.league").alias("current_league"),
        F.col("e.season_founded").alias("current_era_season_founded"),
        F.col("e.season_active_till").alias("current_era_active_till"),
        "franchise_first_season", "franchise_era_count",
        (F.col("franchise_era_count") > 1).alias("has_relocated_or_renamed"),
    )


# Parts per shuffle partition in which the games of a pair of teams are told apart.
FINER = 16


def team_head_to_head(team_box: DataFrame) -> DataFrame:
    """Record of every ordered pair of teams in competitive games.

    Nearly every row is a game of its own, so the groups that count games are as many as rows: they
    are made in many small parts, and only sums of a pair of teams leave a part.
    """
    won = F.col("is_win")
    parts = FINER * int(team_box.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    games = team_box.filter(
        F.col("game_type").isin("Regular Season", "Playoffs") & F.col("opponent_team_id").isNotNull()
    ).select("team_id", "opponent_team_id", "game_id", "is_win", "team_score", "opponent_score", "game_date")
    games = games.repartition(parts, "team_id", "opponent_team_id", "game_id")
    return games.groupBy("team_id", "opponent_team_id").agg(
        F.count_distinct("game_id").alias("games_played"),
        F.count_if(won).alias("wins"),
        F.count_if(~won).alias("losses"),
        F.round(F.count_if(won) / F.nullif(F.count("is_win"), F.lit(0)), 3).alias("win_pct"),
        F.round(F.avg("team_score"), 1).alias("avg_points_for"),
        F.round(F.avg("opponent_score"), 1).alias("avg_points_against"),
        F.round(F.avg(F.col("team_score") - F.col("opponent_score")), 1).alias("avg_point_margin"),
        F.min("game_date").alias("first_meeting_date"),
        F.max("game_date").alias("last_meeting_date"),
    )
