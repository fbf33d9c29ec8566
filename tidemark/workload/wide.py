"""The extended box scores: wide feeds whose columns are renamed by a rule, checked by name."""

from __future__ import annotations

from tidemark.plans import basketball as nba
from tidemark.sources.tables import source
from tidemark.workload.registry import query

# Measures of the feeds and the names they get, those of both feeds first.
SHARED = {
    "assists": "assists", "steals": "steals", "blocks": "blocks", "blocksAgainst": "blocks_against",
    "fieldGoalsMade": "field_goals_made", "fieldGoalsAttempted": "field_goals_attempted",
    "fieldGoalsPercentage": "field_goals_percentage",
    "threePointersMade": "three_pointers_made", "threePointersAttempted": "three_pointers_attempted",
    "threePointersPercentage": "three_pointers_percentage",
    "freeThrowsMade": "free_throws_made", "freeThrowsAttempted": "free_throws_attempted",
    "freeThrowsPercentage": "free_throws_percentage",
    "reboundsOffensive": "rebounds_offensive", "reboundsDefensive": "rebounds_defensive", "reboundsTotal": "rebounds_total",
    "foulsPersonal": "fouls_personal", "turnovers": "turnovers", "plusMinusPoints": "plus_minus_points",
    "estimatedOffensiveRating": "estimated_offensive_rating", "offensiveRating": "offensive_rating",
    "estimatedDefensiveRating": "estimated_defensive_rating", "defensiveRating": "defensive_rating",
    "estimatedNetRating": "estimated_net_rating", "netRating": "net_rating",
    "assistPercentage": "assist_percentage", "assistToTurnoverRatio": "assist_to_turnover_ratio", "assistRatio": "assist_ratio",
    "offensiveReboundPercentage": "offensive_rebound_percentage",
    "defensiveReboundPercentage": "defensive_rebound_percentage", "reboundPercentage": "rebound_percentage",
    "teamTurnoverPercentage": "team_turnover_percentage",
    "effectiveFieldGoalPercentage": "effective_field_goal_percentage", "trueShootingPercentage": "true_shooting_percentage",
    "estimatedPace": "estimated_pace", "pace": "pace", "pacePer40": "pace_per_40",
    "playerImpactEstimate": "player_impact_estimate", "possessions": "possessions",
    "pointsOffTurnovers": "points_off_turnovers", "pointsSecondChance": "points_second_chance",
    "pointsFastBreak": "points_fast_break",
    "opponentPointsOffTurnovers": "opponent_points_off_turnovers",
    "opponentPointsSecondChance": "opponent_points_second_chance",
    "opponentPointsFastBreak": "opponent_points_fast_break", "opponentPointsInPaint": "opponent_points_in_paint",
    "percentFieldGoalAttempts2Point": "percent_field_goal_attempts_2_point",
    "percentFieldGoalAttempts3Point": "percent_field_goal_attempts_3_point",
    "percentPoints2Point": "percent_points_2_point", "percentPoints2PointMidRange": "percent_points_2_point_mid_range",
    "percentPoints3Point": "percent_points_3_point", "percentPointsFastBreak": "percent_points_fast_break",
    "percentPointsFreeThrow": "percent_points_free_throw", "percentPointsOffTurnovers": "percent_points_off_turnovers",
    "percentPointsInPaint": "percent_points_in_paint",
    "percentAssisted2PointMade": "percent_assisted_2_point_made", "percentUnassisted2PointMade": "percent_unassisted_2_point_made",
    "percentAssisted3PointMade": "percent_assisted_3_point_made", "percentUnassisted3PointMade": "percent_unassisted_3_point_made",
    "percentAssistedFieldGoalsMade": "percent_assisted_field_goals_made",
    "percentUnassistedFieldGoalsMade": "percent_unassisted_field_goals_made",
}
PLAYER = {
    "points": "points", "foulsAgainst": "fouls_against", "spWorkOffensiveRating": "sp_work_offensive_rating",
    "spWorkDefensiveRating": "sp_work_defensive_rating", "spWorkNetRating": "sp_work_net_rating", "spWorkPace": "sp_work_pace",
    "estimatedTurnoverPercentage": "estimated_turnover_percentage",
    "usagePercentage": "usage_percentage", "estimatedUsagePercentage": "estimated_usage_percentage",
    "pointsInPaint": "points_in_paint",
    "percentTeamFieldGoalsMade": "percent_team_field_goals_made", "percentTeamFieldGoalsAttempted": "percent_team_field_goals_attempted",
    "percentTeamThreePointersMade": "percent_team_three_pointers_made",
    "percentTeamThreePointersAttempted": "percent_team_three_pointers_attempted",
    "percentTeamFreeThrowsMade": "percent_team_free_throws_made", "percentTeamFreeThrowsAttempted": "percent_team_free_throws_attempted",
    "percentTeamOffensiveRebounds": "percent_team_offensive_rebounds", "percentTeamDefensiveRebounds": "percent_team_defensive_rebounds",
    "percentTeamRebounds": "percent_team_rebounds", "percentTeamAssists": "percent_team_assists",
    "percentTeamTurnovers": "percent_team_turnovers", "percentTeamSteals": "percent_team_steals",
    "percentTeamBlocks": "percent_team_blocks", "percentTeamBlocksAgainst": "percent_team_blocks_against",
    "percentTeamFoulsPersonal": "percent_team_fouls_personal", "percentTeamFoulsDrawn": "percent_team_fouls_drawn",
    "percentTeamPoints": "percent_team_points",
}
TEAM = {
    "seed": "seed", "teamScore": "team_score", "opponentScore": "opponent_score", "reboundsTeam": "rebounds_team",
    "personalFoulsDrawn": "personal_fouls_drawn", "turnoversTeam": "turnovers_team",
    "q1Points": "q1_points", "q2Points": "q2_points", "q3Points": "q3_points", "q4Points": "q4_points",
    "ot1Points": "ot1_points", "ot2Points": "ot2_points", "otAllPoints": "ot_all_points",
    "benchPoints": "bench_points", "biggestLead": "biggest_lead", "biggestScoringRun": "biggest_scoring_run",
    "leadChanges": "lead_changes", "pointsFromTurnovers": "points_from_turnovers", "pointsInThePaint": "points_in_the_paint",
    "timesTied": "times_tied", "timeoutsRemaining": "timeouts_remaining", "seasonWins": "season_wins", "seasonLosses": "season_losses",
    "freeThrowAttemptRate": "free_throw_attempt_rate",
    "opponentEffectiveFieldGoalPercentage": "opponent_effective_field_goal_percentage",
    "opponentFreeThrowAttemptRate": "opponent_free_throw_attempt_rate",
    "opponentTurnoverPercentage": "opponent_turnover_percentage",
    "opponentOffensiveReboundPercentage": "opponent_offensive_rebound_percentage",
}
# Texts of a game, and of either side of it.
TEXTS = {"gameType": "game_type", "gameLabel": "game_label", "gameSubLabel": "game_sub_label"}
PLAYER_TEXTS = {
    "firstName": "first_name", "lastName": "last_name", "playerteamCity": "player_team_city", "playerteamName": "player_team_name",
    "opponentteamCity": "opponent_team_city", "opponentteamName": "opponent_team_name",
    "startingPosition": "starting_position", "comment": "comment",
}
TEAM_TEXTS = {
    "teamCity": "team_city", "teamName": "team_name", "opponentTeamCity": "opponent_team_city", "opponentTeamName": "opponent_team_name",
}
# Raw column: final name, and where its value comes from in order lines, which means the same in both engines.
IDS = {"gameId": ("game_id", "l_orderkey"), "seriesGameNumber": ("series_game_number", "l_linenumber")}
PLAYER_IDS = {
    "personId": ("person_id", "l_partkey"), "playerteamId": ("player_team_id", "l_suppkey"),
    "opponentteamId": ("opponent_team_id", "l_suppkey"),
}
TEAM_IDS = {"teamId": ("team_id", "l_suppkey"), "opponentTeamId": ("opponent_team_id", "l_partkey")}


def _value(i: int) -> str:
    return f"CAST((l_partkey + {i}) % 100 AS DOUBLE) / 8"


def _sql(ids, texts, measures, more):
    out = [f"{src} AS {name}" for name, src in {**IDS, **ids}.values()]
    out += [f"l_returnflag || '{i}' AS {name}" for i, name in enumerate({**TEXTS, **texts}.values())]
    out += [f"{_value(i)} AS {name}" for i, name in enumerate({**SHARED, **measures}.values())]
    out += ["l_shipdate AS game_datetime_est", "l_shipdate AS ingested_at", "l_linenumber % 2 = 1 AS is_home", "l_linenumber % 3 = 1 AS is_win", *more]
    return f"SELECT {', '.join(out)} FROM lineitem"


def _raw(spark, sf, ids, texts, measures, more):
    when = "date_format(l_shipdate, \"yyyy-MM-dd'T'HH:mm:ss\")"
    out = [f"{src} AS {raw}" for raw, (_, src) in {**IDS, **ids}.items()]
    out += [f"concat(l_returnflag, '{i}') AS {raw}" for i, raw in enumerate({**TEXTS, **texts})]
    out += [f"{_value(i)} AS {raw}" for i, raw in enumerate({**SHARED, **measures})]
    out += [f"{when} AS gameDateTimeEst", f"{when} AS ingested_at", "l_linenumber % 2 AS home", "IF(l_linenumber % 3 = 1, 1, 0) AS win", *more]
    return source(spark, sf, "lineitem").selectExpr(*out)


@query("m17_stage_player_box_extended", _sql(PLAYER_IDS, PLAYER_TEXTS, PLAYER, [
    "CASE WHEN l_linenumber > 2 THEN l_quantity END AS minutes_played",
    "l_quantity >= 30 AS is_double_double", "l_quantity >= 45 AS is_triple_double"]))
def player_box_extended(spark, sf):
    return nba.stage_player_box(_raw(spark, sf, PLAYER_IDS, PLAYER_TEXTS, PLAYER, [
        "CASE WHEN l_linenumber = 1 THEN NULL WHEN l_linenumber = 2 THEN 'DNP' ELSE string(l_quantity) END AS numMinutes",
        "IF(l_quantity >= 30, 1, 0) AS doubleDouble", "IF(l_quantity >= 45, 1, 0) AS tripleDouble"]))


@query("m17_stage_team_box_extended", _sql(TEAM_IDS, TEAM_TEXTS, TEAM, ["240 AS minutes_played"]))
def team_box_extended(spark, sf):
    return nba.stage_team_box(_raw(spark, sf, TEAM_IDS, TEAM_TEXTS, TEAM, ["240 AS numMinutes"]))
