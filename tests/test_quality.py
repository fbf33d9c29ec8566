from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark.plans import metrics, quality


def result(df):
    return {r["check"]: (r["failures"], r["status"]) for r in df.collect()}


def test_row_checks_and_severity(spark):
    df = spark.createDataFrame([(1, "a"), (None, "b"), (None, None)], "id int, v string")
    out = quality.row_checks(df, not_null=["id", "v"], accepted={"v": ["a"]}, warn=["not_null:id"])
    assert result(out) == {"not_null:id": (2, "warn"), "not_null:v": (1, "error"), "accepted_values:v": (1, "error")}


def test_unique_ignores_null_keys(spark):
    df = spark.createDataFrame([(1, 1), (1, 1), (2, None), (2, None)], "a int, b int")
    assert result(quality.unique_check(df, ["a", "b"])) == {"unique:a,b": (1, "error")}


def test_orphans(spark):
    df = spark.createDataFrame([(1,), (2,), (None,)], "p int")
    parents = spark.createDataFrame([(1,)], "id int")
    assert result(quality.reference_check(df, "p", parents, "id")) == {"relationships:p": (1, "error")}


def test_anomalies(spark):
    start = datetime(2024, 1, 1)
    loads = [(start + timedelta(hours=h, minutes=m),) for h in range(48) for m in range(3 + h % 2)]
    loads += [(start + timedelta(hours=48, minutes=m),) for m in range(50)] + [(start + timedelta(hours=60),)]
    df = spark.createDataFrame(loads, "ts timestamp")
    volume = quality.volume_anomalies(df, "ts").filter("status = 'warn'").orderBy("hour").collect()
    assert [(r["hour"], r["row_count"]) for r in volume] == [(start + timedelta(hours=48), 50)]
    fresh = quality.freshness_anomalies(df, "ts").filter("status = 'warn'").orderBy("hour").collect()
    # Hour 48 ends freshly loaded, hour 49 is only mildly late; from hour 50 on it shows.
    assert fresh[0]["hour"] == start + timedelta(hours=50)


def test_metric_query_checks_names(spark):
    df = spark.createDataFrame([("A", True, 3), ("A", False, 1)], "home_team_name string, home_team_won boolean, point_margin int")
    cube = metrics.cubes()["nba_game_results"]
    row = metrics.metric_query(df, cube, ["home_team_name"], ["count", "home_win_rate"], [F.col("point_margin") > 0]).first()
    assert (row["count"], row["home_win_rate"]) == (2, 0.5)
    with pytest.raises(KeyError):
        metrics.metric_query(df, cube, ["nothing"], ["count"])
