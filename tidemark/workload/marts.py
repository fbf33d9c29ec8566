"""Queries for sources, sinks, market, payments, sports and media."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import keyed
from tidemark.plans import basketball as nba
from tidemark.plans import football, market, media, metrics, motorsport, payments
from tidemark.session import scratch_path
from tidemark.sources import feeds, sinks
from tidemark.sources.tables import scan_csv, source
from tidemark.workload import adapters as ad
from tidemark.workload.registry import piece, query, rounded as R

NTZ = "timestamp_ntz"


def ntz(df, *cols):
    return df.withColumns({c: F.col(c).cast(NTZ) for c in cols})


# --- sources and sinks -------------------------------------------------------


@query("s1_csv_scan", "SELECT p_partkey, p_name, p_size, p_retailprice FROM part")
def s1(spark, sf):
    path = scratch_path(spark, "csv")
    source(spark, sf, "part").select("p_partkey", "p_name", "p_size", "p_retailprice").write.option(
        "header", True).csv(path)
    return scan_csv(spark, path).drop("ingested_at")


@query("s2_nested_json", """
SELECT CAST(l_orderkey AS INTEGER) AS match_id, l_returnflag AS team_name, CAST(l_suppkey AS INTEGER) AS player_id,
       'P' || l_suppkey AS player_name, l_linestatus AS country_name FROM lineitem""")
def s2(spark, sf):
    # One line-up document per order and flag, with its players as a nested list.
    player = F.struct(
        F.col("l_suppkey").alias("player_id"), F.concat(F.lit("P"), "l_suppkey").alias("player_name"),
        F.struct(F.col("l_linestatus").alias("name")).alias("country"))
    docs = source(spark, sf, "lineitem").groupBy("l_orderkey", "l_returnflag").agg(
        F.collect_list(player).alias("players"))
    payload = F.to_json(F.struct(
        F.col("l_orderkey").alias("match_id"), F.col("l_returnflag").alias("team_name"), "players"))
    path = scratch_path(spark, "json")
    docs.select(payload.alias("payload")).write.text(path)
    raw = spark.read.text(path).withColumnRenamed("value", "payload")
    return feeds.lineups(raw).drop("ingested_at", "player_nickname", "jersey_number")


@query("s3_table_scan", "SELECT * FROM nation")
def s3(spark, sf):
    return source(spark, sf, "nation")


@query("s4_full_replace", "SELECT s_suppkey, s_name FROM supplier WHERE s_acctbal > 0")
def s4(spark, sf):
    path, rows = scratch_path(spark, "full"), source(spark, sf, "supplier").select("s_suppkey", "s_name", "s_acctbal")
    sinks.write_full(rows, path)
    sinks.write_full(rows.filter("s_acctbal > 0").drop("s_acctbal"), path)
    return spark.read.parquet(path)


@query("s5_replace_slice", """
SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 0.0 ELSE o_totalprice END AS o_totalprice, o_orderstatus FROM orders
WHERE o_orderstatus <> 'P' OR o_orderkey % 2 = 0""")
def s5(spark, sf):
    path = scratch_path(spark, "slice")
    rows = source(spark, sf, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus")
    sinks.replace_slice(rows, path, "o_orderstatus")
    again = rows.filter("o_orderstatus = 'P' AND o_orderkey % 2 = 0").withColumn("o_totalprice", F.lit(0.0))
    sinks.replace_slice(again, path, "o_orderstatus")
    return spark.read.parquet(path)


@query("s6_upsert", """
SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN -1.0 ELSE o_totalprice END AS amount, CAST(o_orderkey % 8 AS INTEGER) AS bucket
FROM orders""")
def s6(spark, sf):
    path, key = scratch_path(spark, "upsert"), F.col("o_orderkey")
    rows = source(spark, sf, "orders").select(
        key, F.col("o_totalprice").alias("amount"), (key % 8).cast("int").alias("bucket"))
    sinks.upsert(rows.filter(key % 5 != 0), path, ["o_orderkey"], "bucket")
    changed = rows.filter((key % 5 == 0) | (key % 3 == 0)).withColumn(
        "amount", F.when(key % 3 == 0, -1.0).otherwise(F.col("amount")))
    sinks.upsert(changed, path, ["o_orderkey"], "bucket")
    return sinks.read_table(spark, path)


@query("s7_pending", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def s7(spark, sf):
    loaded = source(spark, sf, "orders").filter("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    return keyed.pending(source(spark, sf, "customer").select("c_custkey"), loaded, "c_custkey")


@query("s12_parse_ticks", """
SELECT event_id AS trade_id, event_type AS symbol, value AS price, CAST(k AS DOUBLE) AS quantity, k % 2 = 0 AS buyer_maker,
       make_timestamp((epoch_us(ts) // 1000) * 1000) AS trade_time, make_timestamp((epoch_us(ts) // 1000 + 5) * 1000) AS event_time
FROM ev WHERE k % 10 <> 3""")
def s12(spark, sf):
    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    kind = F.when(F.col("k") % 10 == 3, "depthUpdate").otherwise("trade")
    # JSON keys differ by case only, so the text is assembled rather than taken from a struct.
    text = F.format_string(
        '{"e":"%s","t":%d,"s":"%s","p":"%s","q":"%s","m":%s,"T":%d,"E":%d}', kind, "event_id", "event_type",
        F.col("value").cast("string"), F.col("k").cast("string"), (F.col("k") % 2 == 0).cast("string"), ms, ms + 5)
    path = scratch_path(spark, "ticks")
    ad.ev(spark, sf).select(text.alias("value")).write.text(path)
    return ntz(feeds.parse_ticks(spark.read.text(path)), "trade_time", "event_time")


@query("s13_schema_evolution", """
SELECT o_orderkey, o_orderstatus, CASE WHEN o_orderkey % 2 = 1 THEN o_totalprice END AS o_totalprice FROM orders""")
def s13(spark, sf):
    rows = source(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    rows = rows.withColumn("bucket", (F.col("o_orderkey") % 3).cast("int"))
    path = scratch_path(spark, "evolving")
    sinks.upsert(rows.filter("o_orderkey % 2 = 0").drop("o_totalprice"), path, ["o_orderkey"], "bucket")
    # Two more batches into the same partitions, of which only the first has the new column.
    sinks.upsert(rows.filter("o_orderkey % 2 = 1"), path, ["o_orderkey"], "bucket")
    sinks.upsert(rows.filter("o_orderkey % 4 = 0").drop("o_totalprice"), path, ["o_orderkey"], "bucket")
    return sinks.read_table(spark, path).drop("bucket")


@query("s14_materialize", "SELECT c_custkey, c_mktsegment, CAST(c_custkey % 4 AS INTEGER) AS bucket FROM customer")
def s14(spark, sf):
    rows = source(spark, sf, "customer").select(
        "c_custkey", "c_mktsegment", (F.col("c_custkey") % 4).cast("int").alias("bucket"))
    view = sinks.materialize(rows, "tidemark_customers")
    path = scratch_path(spark, "incremental")
    sinks.materialize(view.filter("c_custkey < 100"), path, "incremental", keys=["c_custkey"], partition="bucket")
    return sinks.materialize(view, path, "incremental", keys=["c_custkey"], partition="bucket")


# --- market and payments -----------------------------------------------------

CANDLE_SQL = """
SELECT symbol, date_trunc('{unit}', trade_time) AS candle_open_time, arg_min(price, trade_time) AS open, max(price) AS high,
       min(price) AS low, arg_max(price, trade_time) AS close, sum(quantity) AS volume,
       round(sum(notional_value), 2) AS notional_volume, count(*) AS trade_count
FROM trades GROUP BY ALL"""


def _shown(candles):
    return ntz(candles, "candle_open_time").withColumn("notional_volume", F.round("notional_volume", 2))


@query("m1_ohlcv_1m", CANDLE_SQL.format(unit="minute"))
def m1(spark, sf):
    return _shown(market.candles(market.stage_trades(ad.raw_trades(spark, sf))))


@query("m2_ohlcv_1h", CANDLE_SQL.format(unit="hour"))
def m2(spark, sf):
    return _shown(market.rollup_candles(market.candles(market.stage_trades(ad.raw_trades(spark, sf)))))


def _status(spark, sf):
    return payments.payment_status(
        payments.stage_requests(ad.raw_requests(spark, sf)),
        payments.stage_rejections(ad.raw_rejections(spark, sf)), ad.clock(spark, sf).cast("timestamp"), ad.GRACE)


@query("m3_payment_status", f"""
SELECT payment_id, amount, requested_at, rejected_at, status, {ad.CLOCK_SQL} AS status_evaluated_at FROM pay_status""")
def m3(spark, sf):
    return ntz(_status(spark, sf), "requested_at", "rejected_at", "status_evaluated_at")


BUCKET_SQL = """
SELECT time_bucket(INTERVAL 5 MINUTE, requested_at) AS request_bucket, count(*) AS payments_total,
       count(*) FILTER (WHERE status = 'accepted') AS payments_accepted, count(*) FILTER (WHERE status = 'rejected') AS payments_rejected,
       count(*) FILTER (WHERE status = 'pending') AS payments_pending, round(sum(amount), 2) AS amount_total,
       round(sum(amount) FILTER (WHERE status = 'accepted'), 2) AS amount_accepted,
       round(sum(amount) FILTER (WHERE status = 'rejected'), 2) AS amount_rejected,
       round(sum(amount) FILTER (WHERE status = 'pending'), 2) AS amount_pending
FROM pay_status GROUP BY 1"""
AMOUNTS = ["amount_total", "amount_accepted", "amount_rejected", "amount_pending"]


@query("m4_payments_by_minute", BUCKET_SQL)
def m4(spark, sf):
    buckets = payments.payments_by_minute(_status(spark, sf), 5).drop("refreshed_at")
    return ntz(buckets, "request_bucket").withColumns({c: F.round(c, 2) for c in AMOUNTS})


# --- basketball --------------------------------------------------------------

SIDES = ["field_goals_made", "field_goals_attempted", "three_pointers_made", "rebounds_total", "assists",
         "turnovers", "points_in_the_paint"]


def _side_sql():
    out = []
    for side, cond in (("home", "is_home"), ("away", "NOT is_home")):
        for m in SIDES:
            col = "attempted" if m.endswith("attempted") else "made"
            out.append(f"max(CASE WHEN {cond} THEN {col} END) AS {side}_{m}")
    return ", ".join(out)


@query("m5_game_results", f"""
SELECT g.*, home_score - away_score AS point_margin, s.* EXCLUDE (game_id)
FROM games g LEFT JOIN (SELECT game_id, {_side_sql()} FROM box GROUP BY 1) s ON g.game_id = s.game_id""")
def m5(spark, sf):
    games = nba.stage_games(ad.raw_games(spark, sf))
    return nba.game_results(games, nba.stage_team_box(ad.raw_team_box(spark, sf)))


TOTALS_SQL = """count(DISTINCT game_id) AS games_played, CAST(sum(points) AS BIGINT) AS total_points,
 CAST(sum(made) AS BIGINT) AS m, CAST(sum(attempted) AS BIGINT) AS a"""
RATES_SQL = f"""games_played, total_points, m AS total_rebounds, m AS total_assists, m AS total_steals, m AS total_blocks,
 m AS total_turnovers, {R("CAST(total_points AS DOUBLE) / games_played", 1)} AS points_per_game,
 {R("CAST(m AS DOUBLE) / games_played", 1)} AS rebounds_per_game, {R("CAST(m AS DOUBLE) / games_played", 1)} AS assists_per_game"""
PCT = R("CAST(m AS DOUBLE) / nullif(a, 0)", 3)


@query("m6_player_career", f"""
SELECT person_id, first_name, last_name, is_guard, is_forward, is_center, draft_year, height_inches, first_game_date, last_game_date,
 {RATES_SQL}, {PCT} AS career_field_goal_pct, {PCT} AS career_three_point_pct, {PCT} AS career_free_throw_pct
FROM (SELECT person_id, min(game_date) AS first_game_date, max(game_date) AS last_game_date, {TOTALS_SQL}
      FROM box WHERE minutes IS NOT NULL GROUP BY 1) LEFT JOIN players USING (person_id)""")
def m6(spark, sf):
    return nba.player_career_stats(
        nba.stage_player_box(ad.raw_player_box(spark, sf)), nba.stage_players(ad.raw_players(spark, sf)))


SEASON = "CAST(CASE WHEN month({0}) >= 7 THEN year({0}) ELSE year({0}) - 1 END AS INTEGER)"
piece("seasons", f"""
SELECT *, {SEASON.format("game_date")} AS season_start_year FROM box""")
LABEL = "season_start_year || '-' || right(CAST(season_start_year + 1 AS VARCHAR), 2) AS season_label"


@query("m7_player_season", f"""
SELECT person_id, first_name, last_name, season_start_year, {LABEL}, game_type, primary_team_id,
 {RATES_SQL}, {PCT} AS field_goal_pct, {PCT} AS three_point_pct, {PCT} AS free_throw_pct
FROM (SELECT person_id, season_start_year, game_type, {TOTALS_SQL} FROM seasons WHERE minutes IS NOT NULL GROUP BY ALL)
LEFT JOIN (SELECT person_id, season_start_year, game_type, player_team_id AS primary_team_id FROM (
  SELECT person_id, season_start_year, game_type, player_team_id, count(*) AS n FROM seasons WHERE minutes IS NOT NULL GROUP BY ALL)
  QUALIFY row_number() OVER (PARTITION BY person_id, season_start_year, game_type ORDER BY n DESC, player_team_id) = 1)
USING (person_id, season_start_year, game_type) LEFT JOIN players USING (person_id)""")
def m7(spark, sf):
    return nba.player_season_stats(
        nba.stage_player_box(ad.raw_player_box(spark, sf)), nba.stage_players(ad.raw_players(spark, sf)))


def _wmean(col, digits):
    return R(f"sum({col} * minutes) / nullif(sum(minutes), 0)", digits)


@query("m8_player_advanced", f"""
SELECT person_id, any_value(first_name) AS first_name, any_value(last_name) AS last_name, any_value(is_guard) AS is_guard,
 any_value(is_forward) AS is_forward, any_value(is_center) AS is_center, count(DISTINCT game_id) AS games_with_advanced,
 {R("sum(minutes) / count(DISTINCT game_id)", 1)} AS minutes_per_game, count(*) FILTER (WHERE team_score >= 30) AS double_doubles,
 count(*) FILTER (WHERE team_score >= 45) AS triple_doubles, {_wmean("pct", 3)} AS usage_pct, {_wmean("pct", 3)} AS true_shooting_pct,
 {_wmean("pct", 3)} AS effective_field_goal_pct, {_wmean("rating", 1)} AS offensive_rating, {_wmean("rating", 1)} AS defensive_rating,
 {_wmean("rating", 1)} AS net_rating, {_wmean("pct", 3)} AS assist_pct, {_wmean("pct", 3)} AS rebound_pct,
 {_wmean("pct", 3)} AS player_impact_estimate
FROM box LEFT JOIN players USING (person_id) WHERE minutes > 0 GROUP BY 1""")
def m8(spark, sf):
    return nba.player_advanced_career(
        nba.stage_player_box(ad.raw_player_box(spark, sf)), nba.stage_players(ad.raw_players(spark, sf)))


@query("m9_team_season", f"""
SELECT team_id, season_start_year, {LABEL}, count(*) AS games_played, count(*) FILTER (WHERE is_win) AS wins,
 count(*) FILTER (WHERE NOT is_win) AS losses, count(*) FILTER (WHERE is_home AND is_win) AS home_wins,
 count(*) FILTER (WHERE NOT is_home AND is_win) AS away_wins,
 {R("CAST(count(*) FILTER (WHERE is_win) AS DOUBLE) / nullif(count(is_win), 0)", 3)} AS win_pct,
 {R("CAST(sum(team_score) AS DOUBLE) / count(*)", 1)} AS points_for_per_game,
 {R("CAST(sum(opponent_score) AS DOUBLE) / count(*)", 1)} AS points_against_per_game,
 {R("CAST(sum(team_score - opponent_score) AS DOUBLE) / count(*)", 1)} AS point_margin_per_game
FROM seasons WHERE game_type = 'Regular Season' GROUP BY team_id, season_start_year""")
def m9(spark, sf):
    return nba.team_season_summary(nba.stage_team_box(ad.raw_team_box(spark, sf)))


def _means():
    out = []
    for name, (col, digits) in nba.PROFILE.items():
        src = "rating" if digits == 1 else "pct"
        out.append(f"{R(f'avg({src})', digits)} AS {name}")
    return ", ".join(out)


@query("m10_team_profile", f"""
SELECT team_id, season_start_year, {LABEL}, count(*) AS games_played, {_means()}
FROM seasons WHERE game_type = 'Regular Season' GROUP BY team_id, season_start_year""")
def m10(spark, sf):
    return nba.team_advanced_profile(nba.stage_team_box(ad.raw_team_box(spark, sf)))


piece("eras", f"""
SELECT o_custkey AS team_id, o_orderpriority AS city, o_orderstatus AS name,
 date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) * {ad.SHIFT} + o_orderkey % {ad.SHIFT} AS founded FROM orders""")
DIM_SQL = """
SELECT team_id, city AS current_team_city, name AS current_team_name, city || ' ' || name AS current_full_name,
 left(city, 1) AS current_team_abbrev, 'A' AS current_league, founded AS current_era_season_founded,
 founded + 10 AS current_era_active_till, min(founded) OVER (PARTITION BY team_id) AS franchise_first_season,
 count(*) OVER (PARTITION BY team_id) AS franchise_era_count, count(*) OVER (PARTITION BY team_id) > 1 AS has_relocated_or_renamed
FROM eras QUALIFY row_number() OVER (PARTITION BY team_id ORDER BY founded DESC) = 1"""


@query("m11_team_dim", DIM_SQL)
def m11(spark, sf):
    return nba.team_dim(nba.stage_histories(ad.raw_histories(spark, sf)))


@query("m12_head_to_head", f"""
SELECT team_id, opponent_team_id, count(DISTINCT game_id) AS games_played, count(*) FILTER (WHERE is_win) AS wins,
 count(*) FILTER (WHERE NOT is_win) AS losses,
 {R("CAST(count(*) FILTER (WHERE is_win) AS DOUBLE) / nullif(count(is_win), 0)", 3)} AS win_pct,
 {R("CAST(sum(team_score) AS DOUBLE) / count(*)", 1)} AS avg_points_for, {R("CAST(sum(opponent_score) AS DOUBLE) / count(*)", 1)} AS avg_points_against,
 {R("CAST(sum(team_score - opponent_score) AS DOUBLE) / count(*)", 1)} AS avg_point_margin,
 min(game_date) AS first_meeting_date, max(game_date) AS last_meeting_date
FROM box WHERE game_type IN ('Regular Season', 'Playoffs') GROUP BY team_id, opponent_team_id""")
def m12(spark, sf):
    return nba.team_head_to_head(nba.stage_team_box(ad.raw_team_box(spark, sf)))


# --- media -------------------------------------------------------------------

RANKS = ", ".join(f"max(CASE WHEN time_range = '{p}' THEN rank END) AS rank_{p}" for p in media.PERIODS)


@query("m13_top_artists", f"""
SELECT CAST(user_id AS VARCHAR) AS artist_id, 'Artist ' || user_id AS artist_name, 'g' || user_id % 5 AS genres, 'u/' || user_id AS spotify_url,
 max(k) AS popularity, max(k) * 1000 AS followers, 'i/' || user_id AS image_url, max(ts) AS ingested_at, {RANKS} FROM ranked_media GROUP BY user_id""")
def m13(spark, sf):
    return media.top_artists_by_period(media.stage_top_artists(ad.raw_top_artists(spark, sf)))


@query("m14_top_tracks", f"""
SELECT CAST(user_id AS VARCHAR) AS track_id, 'Track ' || user_id AS track_name, 'Artist ' || user_id % 9 AS artist_names, 'Album ' || user_id % 11 AS album_name,
 CASE user_id % 3 WHEN 0 THEN DATE '1999-01-01' WHEN 1 THEN DATE '1999-05-01' ELSE DATE '1999-05-07' END AS album_release_date,
 {R("(user_id * 1000 + 90000) / 60000.0", 2)} AS duration_minutes, user_id % 2 = 0 AS explicit, 'u/' || user_id AS spotify_url,
 max(k) AS popularity, max(ts) AS ingested_at, {RANKS} FROM ranked_media GROUP BY user_id""")
def m14(spark, sf):
    return media.top_tracks_by_period(media.stage_top_tracks(ad.raw_top_tracks(spark, sf)))


@query("m33_newest_plays", """
SELECT ts AS played_at, CAST(user_id AS VARCHAR) AS track_id, 'Track ' || user_id AS track_name
FROM events ORDER BY ts DESC, track_id LIMIT 50""")
def m33_newest(spark, sf):
    return media.newest_plays(media.stage_recently_played(ad.raw_plays(spark, sf))).select(
        "played_at", "track_id", "track_name")


@query("m33_plays_by_hour", """
SELECT CAST(h AS INTEGER) AS hour, count(e.event_id) AS plays, count(DISTINCT e.user_id) AS unique_tracks
FROM range(24) s(h) LEFT JOIN events e ON hour(e.ts) = s.h GROUP BY 1""")
def m33(spark, sf):
    return media.plays_by_hour(media.stage_recently_played(ad.raw_plays(spark, sf)))


# --- football ----------------------------------------------------------------

COUNTS = "count(*) AS total_events, " + ", ".join(
    f"count(*) FILTER (WHERE event_type = '{kind}') AS {name}" for kind, name in football.COUNTED.items())
ZEROED = ", ".join(f"coalesce({n}, 0) AS {n}" for n in ["total_events", *football.COUNTED.values()])


@query("m15_match_summary", f"""
SELECT m.* EXCLUDE (kick_off, match_status, referee_name), {ZEROED}
FROM matches m LEFT JOIN (SELECT match_id, {COUNTS} FROM acts GROUP BY 1) e ON m.match_id = e.match_id""")
def m15(spark, sf):
    return football.match_summary(
        football.stage_matches(ad.raw_matches(spark, sf)), football.stage_events(ad.raw_match_events(spark, sf)))


@query("m16_player_stats", f"""
SELECT a.*, country_name, coalesce(lineup_appearances, 0) AS lineup_appearances FROM (
 SELECT player_id, player_name, team, count(DISTINCT match_id) AS matches_in_events, {COUNTS},
  {R("sum(duration) / 60.0", 2)} AS total_duration_minutes FROM acts WHERE player_id IS NOT NULL GROUP BY ALL) a
LEFT JOIN (SELECT l_suppkey AS player_id, l_returnflag AS team, count(DISTINCT l_orderkey) AS lineup_appearances, max(l_linestatus) AS country_name
 FROM lineitem GROUP BY ALL) b ON a.player_id = b.player_id AND a.team = b.team""")
def m16(spark, sf):
    return football.player_stats(
        football.stage_events(ad.raw_match_events(spark, sf)), football.stage_lineups(ad.raw_lineups(spark, sf)))


# --- staging -----------------------------------------------------------------


@query("m17_stage_trades", "SELECT *, trade_time AS consumed_at FROM trades")
def m17_trades(spark, sf):
    staged = market.stage_trades(ad.raw_trades(spark, sf))
    return ntz(staged, "trade_time", "event_time", "consumed_at")


@query("m17_stage_requests", "SELECT * FROM requests")
def m17_requests(spark, sf):
    return ntz(payments.stage_requests(ad.raw_requests(spark, sf)), "requested_at", "consumed_at")


@query("m17_stage_rejections", "SELECT *, rejected_at AS consumed_at FROM raw_rejections")
def m17_rejections(spark, sf):
    return ntz(payments.stage_rejections(ad.raw_rejections(spark, sf)), "rejected_at", "consumed_at")


@query("m17_stage_games", "SELECT *, CASE WHEN home_team_won THEN home_team_id ELSE away_team_id END AS winner_team_id FROM games")
def m17_games(spark, sf):
    return nba.stage_games(ad.raw_games(spark, sf))


@query("m17_stage_team_box", """
SELECT game_id, team_id, opponent_team_id, game_date, game_at AS game_datetime_est, game_type, is_home, is_win, team_score, opponent_score,
 made AS three_pointers_made, attempted AS free_throws_attempted, rating AS offensive_rating, pct AS percent_field_goal_attempts_3_point,
 made AS points_in_the_paint, 240 AS minutes_played FROM box""")
def m17_team_box(spark, sf):
    return nba.stage_team_box(ad.raw_team_box(spark, sf)).select(
        "game_id", "team_id", "opponent_team_id", "game_date", "game_datetime_est", "game_type", "is_home", "is_win",
        "team_score", "opponent_score", "three_pointers_made", "free_throws_attempted", "offensive_rating",
        "percent_field_goal_attempts_3_point", "points_in_the_paint", "minutes_played")


@query("m17_stage_player_box", """
SELECT game_id, person_id, player_team_id, game_type, minutes AS minutes_played, points, team_score >= 30 AS is_double_double, pct AS usage_percentage FROM box""")
def m17_player_box(spark, sf):
    return nba.stage_player_box(ad.raw_player_box(spark, sf)).select(
        "game_id", "person_id", "player_team_id", "game_type", "minutes_played", "points", "is_double_double",
        "usage_percentage")


@query("m17_stage_players", "SELECT * EXCLUDE (height_inches), DATE '1990-05-01' AS birth_date FROM players")
def m17_players(spark, sf):
    return nba.stage_players(ad.raw_players(spark, sf)).drop("height_inches", "ingested_at")


@query("m17_stage_histories", "SELECT team_id, city AS team_city, name AS team_name, founded AS season_founded, founded + 10 AS season_active_till FROM eras")
def m17_histories(spark, sf):
    return nba.stage_histories(ad.raw_histories(spark, sf)).drop("team_abbrev", "league", "ingested_at")


@query("m17_stage_matches", "SELECT * FROM matches")
def m17_matches(spark, sf):
    return football.stage_matches(ad.raw_matches(spark, sf))


@query("m17_stage_match_events", """
SELECT match_id, 62.5::DOUBLE AS event_time, minute, second, minute * 60 + second AS seconds_elapsed, event_type, team, player_id, duration FROM acts""")
def m17_events(spark, sf):
    return football.stage_events(ad.raw_match_events(spark, sf)).select(
        "match_id", "event_time", "minute", "second", "seconds_elapsed", "event_type", "team", "player_id", "duration")


@query("m17_stage_lineups", "SELECT l_orderkey AS match_id, l_returnflag AS team_name, l_suppkey AS player_id, l_suppkey % 99 AS jersey_number FROM lineitem")
def m17_lineups(spark, sf):
    return football.stage_lineups(ad.raw_lineups(spark, sf)).select("match_id", "team_name", "player_id", "jersey_number")


@query("m17_stage_competitions", "SELECT o_custkey % 9 AS competition_id, 'Cup ' || (o_custkey % 9) AS competition_name, year(o_orderdate) AS season_id, o_orderkey % 2 = 0 AS competition_youth FROM orders")
def m17_competitions(spark, sf):
    cust, none = F.col("o_custkey"), F.lit(None).cast("string")
    raw = source(spark, sf, "orders").select(
        (cust % 9).alias("competition_id"), ad.tag("Cup ", cust % 9).alias("competition_name"),
        none.alias("country_name"), none.alias("competition_gender"),
        (F.col("o_orderkey") % 2 == 0).alias("competition_youth"), F.lit(True).alias("competition_international"),
        F.year("o_orderdate").alias("season_id"), none.alias("season_name"),
        F.lit(False).alias("match_available_360"), F.lit("2024-01-01").alias("ingested_at"))
    return football.stage_competitions(raw).select(
        "competition_id", "competition_name", "season_id", "competition_youth")


@query("m17_stage_recently_played", f"""
SELECT ts AS played_at, date_trunc('day', ts)::TIMESTAMP AS played_date, CAST(hour(ts) AS INTEGER) AS played_hour, CAST(user_id AS VARCHAR) AS track_id,
 {R("(user_id * 1000 + 90000) / 60000.0", 2)} AS duration_minutes, 'p/' || k AS context_uri FROM ev""")
def m17_plays(spark, sf):
    return media.stage_recently_played(ad.raw_plays(spark, sf)).select(
        "played_at", "played_date", "played_hour", "track_id", "duration_minutes", "context_uri")


@query("m17_stage_top_artists", "SELECT CAST(user_id AS VARCHAR) AS artist_id, rank, time_range, k AS popularity, ts AS ingested_at FROM ranked_media")
def m17_artists(spark, sf):
    return media.stage_top_artists(ad.raw_top_artists(spark, sf)).select(
        "artist_id", "rank", "time_range", "popularity", "ingested_at")


@query("m17_stage_top_tracks", """
SELECT CAST(user_id AS VARCHAR) AS track_id, rank, time_range,
 CASE user_id % 3 WHEN 0 THEN DATE '1999-01-01' WHEN 1 THEN DATE '1999-05-01' ELSE DATE '1999-05-07' END AS album_release_date FROM ranked_media""")
def m17_tracks(spark, sf):
    return media.stage_top_tracks(ad.raw_top_tracks(spark, sf)).select(
        "track_id", "rank", "time_range", "album_release_date")


# Columns a timing feed carries besides its timestamps, read off the order lines.
TIMING = {
    "drivers": {"meeting_key": "l_orderkey", "session_key": "l_partkey", "driver_number": "l_suppkey"},
    "laps": {"session_key": "l_orderkey", "driver_number": "l_suppkey", "lap_number": "l_linenumber",
             "lap_duration": "l_quantity"},
    "meetings": {"meeting_key": "l_orderkey", "year": "l_linenumber"},
    "pit": {"session_key": "l_orderkey", "lap_number": "l_linenumber", "pit_duration": "l_tax"},
    "sessions": {"session_key": "l_orderkey", "session_type": "l_returnflag"},
    "stints": {"session_key": "l_orderkey", "stint_number": "l_linenumber", "compound": "l_returnflag"},
    "weather": {"session_key": "l_orderkey", "air_temperature": "l_quantity", "rainfall": "l_linenumber"},
}


def _timing(feed: str) -> None:
    kept = ", ".join(f"{src} AS {name}" for name, src in TIMING[feed].items())
    stamps = [*motorsport.TIMES[feed].values(), "ingested_at"]
    sql = f"SELECT {kept}, {', '.join(f'l_shipdate AS {s}' for s in stamps)} FROM lineitem"

    @query(f"m17_stage_{feed}", sql)
    def run(spark, sf):
        text = F.date_format("l_shipdate", "yyyy-MM-dd'T'HH:mm:ss")
        raw = source(spark, sf, "lineitem").select(
            *[F.col(src).alias(name) for name, src in TIMING[feed].items()],
            *[text.alias(c) for c in [*motorsport.TIMES[feed], "ingested_at"]])
        return motorsport.stage_timing(raw, feed)


for _feed in TIMING:
    _timing(_feed)


# --- metrics -----------------------------------------------------------------


@query("c1_metric_query", """
SELECT season_start_year, game_type, count(*) AS count, CAST(sum(p) AS BIGINT) AS sum_total_points, max(p) AS max_total_points FROM (
 SELECT person_id, season_start_year, game_type, CAST(sum(points) AS BIGINT) AS p FROM seasons WHERE minutes IS NOT NULL GROUP BY ALL)
WHERE season_start_year >= 1996 GROUP BY ALL""")
def c1(spark, sf):
    stats = m7(spark, sf)
    return metrics.metric_query(
        stats, metrics.cubes()["nba_player_season_stats"], ["season_start_year", "game_type"],
        ["count", "sum_total_points", "max_total_points"], [F.col("season_start_year") >= 1996])


@query("c2_derived_measure", """
SELECT home_team_name, count(*) AS count, round(avg(CASE WHEN home_team_won THEN 1.0 ELSE 0.0 END), 9) AS home_win_rate,
 round(avg(home_score - away_score), 9) AS avg_point_margin FROM games GROUP BY 1""")
def c2(spark, sf):
    out = metrics.metric_query(
        m5(spark, sf), metrics.cubes()["nba_game_results"], ["home_team_name"],
        ["count", "home_win_rate", "avg_point_margin"])
    return out.withColumns({c: F.round(c, 9) for c in ("home_win_rate", "avg_point_margin")})


@query("c1_team_metrics", f"SELECT has_relocated_or_renamed, count(*) AS count FROM ({DIM_SQL}) GROUP BY 1")
def c1_teams(spark, sf):
    return metrics.metric_query(
        m11(spark, sf), metrics.cubes()["nba_team_dim"], ["has_relocated_or_renamed"], ["count"])


@query("c1_track_metrics", """
SELECT album_name, explicit, count(*) AS count, max(p) AS max_popularity, round(avg(p), 6) AS avg_popularity FROM (
 SELECT user_id, 'Album ' || user_id % 11 AS album_name, user_id % 2 = 0 AS explicit, max(k) AS p FROM ranked_media GROUP BY ALL) GROUP BY 1, 2""")
def c1_tracks(spark, sf):
    out = metrics.metric_query(
        m14(spark, sf), metrics.cubes()["spotify_top_tracks"], ["album_name", "explicit"],
        ["count", "max_popularity", "avg_popularity"])
    return out.withColumn("avg_popularity", F.round("avg_popularity", 6))


@query("c1_media_metrics", """
SELECT genres, count(*) AS count, max(f) AS max_followers FROM (
 SELECT user_id, 'g' || user_id % 5 AS genres, max(k) * 1000 AS f FROM ranked_media GROUP BY ALL) GROUP BY 1""")
def c1_media(spark, sf):
    return metrics.metric_query(
        m13(spark, sf), metrics.cubes()["spotify_top_artists"], ["genres"], ["count", "max_followers"])
