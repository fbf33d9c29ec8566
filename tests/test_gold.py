import pytest
from pyspark.sql import functions as F

from tidemark.functions.scalars import map_values, snake
from tidemark.functions.timeparts import partial_date
from tidemark.plans import basketball, football, gold, media, retail


def test_scd2_versions(spark, rows):
    data = [("c1", 1, "2024-01-01"), ("c1", 2, "2024-01-01"), ("c1", 3, "2024-02-01"), ("c2", 1, "2024-01-05")]
    df = spark.createDataFrame(data, "customer_id string, version_number int, effective_at string")
    df = df.withColumn("effective_at", F.col("effective_at").cast("timestamp_ntz"))
    for per_slice in (1, 2, 365):
        out = gold.dim_customer(df, per_slice)
        got = [(r["customer_id"], r["version_number"], str(r["valid_to"])[:10], r["is_current"])
               for r in out.orderBy("customer_id", "version_number").collect()]
        assert got == [("c1", 1, "2024-01-01", False), ("c1", 2, "2024-02-01", False),
                       ("c1", 3, "None", True), ("c2", 1, "None", True)]
    assert out.select("customer_sk").distinct().count() == 4


def test_engagement_web_only_mail_only_both(spark):
    summary = spark.createDataFrame(
        [("w", 5, 2, 1, True, "2024-01-01"), ("b", 1, 1, 0, False, "2024-01-02"), (None, 9, 9, 9, True, "2024-01-03")],
        "customer_id_extended string, num_events int, num_page_views int, num_searches int, is_converted boolean, session_start string")
    mails = spark.createDataFrame([("m", "open"), ("b", "sent"), ("b", "open")], "customer_id string, event_type string")
    got = {r["customer_id"]: r for r in gold.customer_engagement(summary, mails).collect()}
    assert set(got) == {"w", "m", "b"}
    assert (got["w"]["emails_sent"], got["w"]["email_open_rate"]) == (0, None)
    assert (got["m"]["n_sessions"], got["m"]["email_open_rate"], got["m"]["email_click_to_open_rate"]) == (0, None, 0.0)
    assert got["b"]["email_open_rate"] == 1.0


def test_marketplace_states_guest_and_unknown(spark):
    data = [("o1", None, "SHIPPED"), ("o2", "c", "REFUSED"), ("o3", "c", "SHIPPING"), ("o4", "c", "NEW")]
    raw = spark.createDataFrame(data, "mirakl_order_id string, customer_ref string, order_state string")
    for c in ("created_date", "shop_id", "shop_name", "total_price", "currency_iso_code", "commission_rate",
              "commission_amount", "ingested_at"):
        raw = raw.withColumn(c, F.lit(None).cast("string"))
    got = {r["order_id"]: (r["order_status"], r["is_guest"]) for r in retail.marketplace_orders(raw).collect()}
    assert got == {"o1": ("completed", True), "o2": ("cancelled", False), "o3": ("in_progress", False), "o4": ("unknown", False)}


def test_line_without_product_keeps_null_category(spark):
    own = spark.createDataFrame([], "line_id string, order_id string, variant_id string, category_id string, quantity int, "
                                    "unit_price double, line_amount double, is_returned boolean, return_reason string")
    shop = spark.createDataFrame([("l1", "o", "v1", 1, 1.0, 1.0, False, None), ("l2", "o", "vx", 1, 1.0, 1.0, False, None)],
                                 "line_id string, order_id string, variant_id string, quantity int, unit_price double, "
                                 "line_amount double, is_returned boolean, return_reason string")
    products = spark.createDataFrame([("v1", "cat")], "variant_id string, category_id string")
    got = {r["line_id"]: r["category_id"] for r in gold.fact_order_line(own, shop, products).collect()}
    assert got == {"l1": "cat", "l2": None}


@pytest.mark.parametrize("raw,want", [
    ("gameDateTimeEst", "game_date_time_est"), ("pacePer40", "pace_per_40"), ("spWorkPace", "sp_work_pace"),
    ("percentFieldGoalAttempts2Point", "percent_field_goal_attempts_2_point"), ("q1Points", "q1_points"),
    ("percentPoints2PointMidRange", "percent_points_2_point_mid_range"), ("ot2Points", "ot2_points"),
    ("otAllPoints", "ot_all_points"), ("percentUnassisted3PointMade", "percent_unassisted_3_point_made"),
    ("bodyWeightLbs", "body_weight_lbs"), ("pointsInThePaint", "points_in_the_paint"), ("comment", "comment"),
])
def test_snake(raw, want):
    assert snake(raw) == want


def test_box_score_names_and_flags(spark):
    raw = spark.createDataFrame(
        [(1, 2, 3, 1, None, "12.5", "2024-01-02", 0), (1, 2, 3, 0, 1, "DNP", "2024-01-02", 1)],
        "gameId int, playerteamId int, opponentteamId int, home int, win int, numMinutes string, gameDate string, doubleDouble int")
    out = basketball.stage_player_box(raw)
    assert out.columns == ["game_id", "player_team_id", "opponent_team_id", "is_home", "is_win", "minutes_played",
                           "game_date", "is_double_double"]
    got = [(r["is_home"], r["is_win"], r["minutes_played"]) for r in out.collect()]
    assert got == [(True, None, 12.5), (False, True, None)]


def test_season_traded_player_and_zero_attempts(spark):
    base = dict(person_id=1, minutes_played=10.0, game_type="Playoffs", points=10, rebounds_total=1, assists=1, steals=1,
                blocks=1, turnovers=1, field_goals_made=0, field_goals_attempted=0, three_pointers_made=1,
                three_pointers_attempted=3, free_throws_made=0, free_throws_attempted=0)
    games = [{**base, "game_id": i, "player_team_id": t, "game_date": d} for i, (t, d) in enumerate(
        [(9, "2024-06-30"), (4, "2024-01-01"), (9, "2024-02-01"), (4, "2024-02-02"), (7, "2024-07-01")])]
    box = spark.createDataFrame(games).withColumn("game_date", F.col("game_date").cast("date"))
    players = spark.createDataFrame([(1, "A", "B")], "person_id int, first_name string, last_name string")
    got = {r["season_label"]: r for r in basketball.player_season_stats(box, players).collect()}
    assert set(got) == {"2023-24", "2024-25"}
    assert got["2023-24"]["primary_team_id"] == 4 and got["2024-25"]["primary_team_id"] == 7
    assert got["2023-24"]["field_goal_pct"] is None and got["2023-24"]["three_point_pct"] == 0.333


def test_team_dim_eras(spark):
    eras = [(1, "Old", "X", "OX", 1950, 1960, "A"), (1, "New", "Y", "NY", 1961, None, "A"), (2, "Solo", "Z", "SZ", 1970, None, "A")]
    df = spark.createDataFrame(eras, "team_id int, team_city string, team_name string, team_abbrev string, "
                                     "season_founded int, season_active_till int, league string")
    got = {r["team_id"]: (r["current_full_name"], r["franchise_first_season"], r["franchise_era_count"], r["has_relocated_or_renamed"])
           for r in basketball.team_dim(df).collect()}
    assert got == {1: ("New Y", 1950, 2, True), 2: ("Solo Z", 1970, 1, False)}


def test_partial_dates(spark):
    df = spark.createDataFrame([("1999",), ("1999-05",), ("1999-05-07",)], "t string")
    assert [str(r[0]) for r in df.select(partial_date("t")).collect()] == ["1999-01-01", "1999-05-01", "1999-05-07"]


def test_unavailable_matches_are_left_out(spark):
    data = [(1, 2, 1, "available"), (2, 1, 1, "available"), (3, 0, 1, "deleted")]
    raw = spark.createDataFrame(data, "match_id int, home_score int, away_score int, match_status string")
    names = ["match_date", "kick_off", "competition_id", "competition_name", "season_id", "season_name", "home_team_name",
             "away_team_name", "match_week", "competition_stage", "stadium_name", "referee_name", "ingested_at"]
    raw = raw.withColumns({n: F.lit(None).cast("string") for n in names}).withColumn("kick_off", F.lit("15:30"))
    got = {r["match_id"]: (r["match_result"], r["kick_off"]) for r in football.stage_matches(raw).collect()}
    assert got == {1: ("home_win", 55800.0), 2: ("draw", 55800.0)}


def test_missing_rank_sorts_last(spark):
    df = spark.createDataFrame([("a", None), ("b", 2), ("c", 1)], "id string, rank int")
    assert [r["id"] for r in media.best_first(df, "rank").collect()] == ["c", "b", "a"]


def test_vocabulary_default(spark):
    df = spark.createDataFrame([("x",), ("z",), (None,)], "v string")
    assert [r[0] for r in df.select(map_values("v", {"good": ["x"]}, "unknown")).collect()] == ["good", "unknown", "unknown"]


def test_hours_without_plays_are_zero(spark):
    from tidemark.plans import media

    plays = spark.createDataFrame([(3, "a"), (3, "a"), (23, "b")], "played_hour int, track_id string")
    got = {r["hour"]: (r["plays"], r["unique_tracks"]) for r in media.plays_by_hour(plays).collect()}
    assert len(got) == 24 and got[3] == (2, 1) and got[23] == (1, 1) and got[0] == (0, 0)
