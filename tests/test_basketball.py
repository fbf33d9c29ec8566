from pyspark.sql import functions as F

from tidemark.plans import basketball


def test_games_of_two_teams_are_counted_in_small_parts(spark):
    """The parts that tell games apart are finer than a shuffle's, and games that come twice count once."""
    data = [(1, 2, g, g % 2 == 0, 3, 1, "2024-01-01", "Playoffs") for g in (1, 2, 2, 3)] + [
        (1, None, 9, True, 1, 1, "2024-01-02", "Playoffs"), (1, 2, 7, True, 9, 9, "2024-01-03", "Preseason"),
        (2, 1, 1, None, 1, 3, "2024-01-04", "Regular Season")]
    df = spark.createDataFrame(
        data, "team_id int, opponent_team_id int, game_id long, is_win boolean, team_score long, opponent_score long, game_date string, game_type string")
    out = basketball.team_head_to_head(df.withColumn("game_date", F.col("game_date").cast("date")))
    got = {r["team_id"]: (r["games_played"], r["wins"], r["losses"], r["win_pct"], r["avg_point_margin"]) for r in out.collect()}
    assert got == {1: (3, 2, 2, 0.5, 2.0), 2: (1, 0, 0, None, -2.0)}
    parts = basketball.FINER * int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert f", {parts})" in out._jdf.queryExecution().executedPlan().toString()
