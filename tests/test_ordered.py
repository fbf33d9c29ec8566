import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.operators import ordered
from tidemark.operators.keyed import with_group_size
from tidemark.operators.sessions import sessionize


@pytest.fixture(scope="module")
def history(spark):
    """300 rows; one key holds most of them, times repeat, some values are null."""
    rng = np.random.default_rng(3)
    key = np.where(rng.random(300) < 0.6, "hot", rng.choice(list("abcdef"), 300))
    pdf = pd.DataFrame({
        "key": key, "ts": pd.Timestamp("2024-01-01") + pd.to_timedelta(rng.integers(0, 9000, 300), "min"),
        "id": np.arange(300), "n": rng.integers(1, 9, 300),
    })
    df = spark.createDataFrame(pdf).withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    return pdf.sort_values(["key", "ts", "id"]), df


@pytest.mark.parametrize("parts", [None, 1, 7, 50])
def test_neighbours_cross_part_edges(history, parts):
    pdf, df = history
    df = ordered.split(df, ["key"], ["ts", "id"], parts)
    out = ordered.previous_value(df, ["key"], "id", ["ts", "id"], "before")
    out = ordered.next_value(out, ["key"], "id", ["ts", "id"], "after")
    got = {r["id"]: (r["before"], r["after"]) for r in out.collect()}
    groups = pdf.groupby("key")["id"]
    for i, b, a in zip(pdf["id"], groups.shift(1), groups.shift(-1)):
        assert got[i] == (None if pd.isna(b) else b, None if pd.isna(a) else a)


def test_running_total(history):
    pdf, df = history
    for rows in (df, ordered.split(df, ["key"], ["ts", "id"], 20)):
        out = ordered.running_total(rows, ["key"], "n", ["ts", "id"], "total")
        out = ordered.running_max(out, ["key"], "n", ["ts", "id"], "most")
        got = {r["id"]: (r["total"], r["most"]) for r in out.collect()}
        groups = pdf.groupby("key")["n"]
        assert got == dict(zip(pdf["id"], zip(groups.cumsum(), groups.cummax())))
        assert set(out.columns) - {ordered.PART} == {*df.columns, "total", "most"}


def test_one_visitor_of_one_day_takes_several_tasks(spark):
    """All rows have one key and one day; parts are cut by rows, and sessions cross their edges."""
    rows = [("v", i, f"e{i:04}") for i in range(2000)]
    df = spark.createDataFrame(rows, "who string, s int, id string").withColumn(
        "ts", F.lit("2024-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(secs=F.col("s") * 40))
    sizes = [r["count"] for r in ordered.split(df, ["who"], ["ts", "id"], 8).groupBy(ordered.PART).count().collect()]
    assert len(sizes) == 8 and max(sizes) < 500
    one = sessionize(df, "who", "ts", "id", "1 minute", parts=8)
    assert {r["session_id"] for r in one.collect()} == {"v-s00001"}
    many = sessionize(df, "who", "ts", "id", "30 seconds", parts=8).orderBy("id")
    assert [r["session_id"] for r in many.collect()] == [f"v-s{i + 1:05}" for i in range(2000)]


def test_rank_overall_and_within(history):
    pdf, df = history
    order = [F.desc("n"), F.asc("id")]
    out = ordered.rank_rows(df, order, "overall")
    out = ordered.rank_rows(out, order, "inside", within=["key"])
    got = {r["id"]: (r["overall"], r["inside"]) for r in out.collect()}
    s = pdf.sort_values(["n", "id"], ascending=[False, True])
    want = dict(zip(s["id"], zip(range(1, 301), s.groupby("key").cumcount() + 1)))
    assert got == want


def test_rank_within_null_group(spark):
    df = spark.createDataFrame([(None, 1), (None, 2), ("a", 3)], "g string, id int")
    out = ordered.rank_rows(df, [F.asc("id")], "r", within=["g"])
    assert sorted((r["id"], r["r"]) for r in out.collect()) == [(1, 1), (2, 2), (3, 1)]


@pytest.mark.parametrize("n", [1, 7, 10, 103])
def test_deciles_match_quantile_cut(spark, n):
    df = spark.range(n).withColumn("rank", F.col("id") + 1)
    got = [r["d"] for r in ordered.deciles(df, "rank", "d").orderBy("rank").collect()]
    ranks = pd.Series(range(1, n + 1))
    want = [1] if n == 1 else (pd.qcut(ranks, 10, labels=False) + 1).tolist()
    assert got == want


def test_session_edges(spark, rows):
    """A gap of exactly 30 minutes stays, one second more starts anew, equal times go by id."""
    data = [("a", "10:00:00", "e1"), ("a", "10:30:00", "e2"), ("a", "11:00:01", "e3"),
            ("a", "11:00:01", "e4"), ("b", "10:00:00", "e5")]
    df = spark.createDataFrame(data, "who string, t string, id string").withColumn(
        "ts", F.concat(F.lit("2024-01-01 "), "t").cast("timestamp_ntz"))
    got = rows(sessionize(df, "who", "ts", "id"), "id", "session_id")
    assert got == [("e1", "a-s00001"), ("e2", "a-s00001"), ("e3", "a-s00002"), ("e4", "a-s00002"),
                   ("e5", "b-s00001")]


def test_sessions_are_gaps_plus_one(history):
    pdf, df = history
    gap = pd.Timedelta("12h")
    want = (pdf.groupby("key")["ts"].diff() > gap).groupby(pdf["key"]).sum() + 1
    out = sessionize(df, "key", "ts", "id", "12 hours").groupBy("key").agg(
        F.count_distinct("session_id").alias("n"))
    assert {r["key"]: r["n"] for r in out.collect()} == want.to_dict()


def test_null_keys_times_and_values_match_plain_windows(spark):
    """The two-level operators agree with one window per key where keys, times and values are null."""
    from pyspark.sql import Window

    rng = np.random.default_rng(9)
    rows = [
        (None if rng.random() < 0.4 else "k", None if rng.random() < 0.1 else int(rng.integers(0, 6)), i,
         None if rng.random() < 0.4 else int(rng.integers(1, 9)))
        for i in range(120)
    ]
    df = spark.createDataFrame(rows, "key string, day int, id int, n long")
    w = Window.partitionBy("key").orderBy("day", "id")
    want = df.withColumn("before", F.lag("n").over(w)).withColumn("after", F.lead("n").over(w)).withColumn(
        "total", F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn(
        "size", F.count(F.lit(1)).over(Window.partitionBy("key")))
    order = ["day", "id"]
    got = ordered.previous_value(ordered.split(df, ["key"], order, 9), ["key"], "n", order, "before")
    got = ordered.next_value(got, ["key"], "n", order, "after")
    got = ordered.running_total(got, ["key"], "n", order, "total")
    got = with_group_size(got, ["key"], "size")
    names = ["id", "before", "after", "total", "size"]
    assert sorted(map(tuple, got.select(names).collect())) == sorted(map(tuple, want.select(names).collect()))


def test_only_keys_that_cross_parts_carry_a_summary(spark):
    """However many keys there are, an edge between parts cuts one: summaries that are joined are no more than parts."""
    df = spark.range(2000).select(F.concat(F.lit("k"), F.col("id") % 500).alias("key"), F.col("id").alias("at"), F.lit(1).alias("one"))
    parts = ordered.split(df, ["key"], ["at"], 6)
    for after in (False, True):
        edges = ordered._edges(parts, ["key"], "at", ["at"], after)
        assert edges.count() <= 5
    for out in (ordered.previous_value(parts, ["key"], "at", ["at"], "x"), ordered.running_total(parts, ["key"], "one", ["at"], "x")):
        assert "Broadcast" in out._jdf.queryExecution().executedPlan().toString()
    want = {(f"k{i % 500}", i): (i - 500 if i >= 500 else None, i + 500 if i < 1500 else None, i // 500 + 1) for i in range(2000)}
    got = {n: {(r["key"], r["at"]): r["x"] for r in f.collect()} for n, f in (
        ("before", ordered.previous_value(parts, ["key"], "at", ["at"], "x")), ("after", ordered.next_value(parts, ["key"], "at", ["at"], "x")),
        ("sum", ordered.running_total(parts, ["key"], "one", ["at"], "x")))}
    assert {k: (got["before"][k], got["after"][k], got["sum"][k]) for k in want} == want
