import json

from pyspark.sql import functions as F

from tidemark.operators.keyed import append_evolving, pending
from tidemark.sources import feeds, sinks
from tidemark.sources.tables import scan_csv


def test_csv_types_come_from_the_whole_file(spark, tmp_path):
    (tmp_path / "t.csv").write_text("id,score,name\n" + "1,2,x\n" * 500 + "2,2.5,y\n")
    df = scan_csv(spark, str(tmp_path / "t.csv"))
    assert dict(df.dtypes) == {"id": "int", "score": "double", "name": "string", "ingested_at": "timestamp"}


def test_top_artists_flatten(spark):
    item = {"id": "a", "name": "A", "popularity": 5, "followers": {"total": 7}, "genres": ["x", "y"],
            "external_urls": {"spotify": "u"}, "images": [{"url": "i1"}, {"url": "i2"}]}
    bare = {**item, "id": "b", "genres": [], "images": []}
    raw = spark.createDataFrame([("short_term", json.dumps({"items": [item, bare]}))], "time_range string, payload string")
    got = [r.asDict() for r in feeds.top_artists(raw).drop("ingested_at").orderBy("rank").collect()]
    assert got[0] == {"rank": 1, "id": "a", "name": "A", "time_range": "short_term", "popularity": 5,
                      "followers": 7, "genres": "x, y", "spotify_url": "u", "image_url": "i1"}
    assert (got[1]["rank"], got[1]["genres"], got[1]["image_url"]) == (2, "", None)


def test_tracks_and_plays_flatten(spark):
    track = {"id": "t", "name": "T", "artists": [{"id": "1", "name": "X"}, {"id": "2", "name": "Y"}],
             "album": {"id": "al", "name": "AL", "release_date": "1999-05"}, "duration_ms": 1000,
             "explicit": True, "popularity": 3, "external_urls": {"spotify": "u"}}
    raw = spark.createDataFrame([("long_term", json.dumps({"items": [track]}))], "time_range string, payload string")
    row = feeds.top_tracks(raw).first()
    assert (row["artist_names"], row["album_release_date"], row["preview_url"]) == ("X, Y", "1999-05", None)
    play = {"played_at": "2024-01-01T10:00:00Z", "track": track, "context": None}
    raw = spark.createDataFrame([(json.dumps({"items": [play]}),)], "payload string")
    row = feeds.recent_plays(raw).first()
    assert (row["track_id"], row["context_type"], row["played_at"].hour) == ("t", None, 10)


def test_match_event_location(spark):
    docs = [{"id": "1", "match_id": 1, "type": "Pass", "location": [1.5, 2.5]},
            {"id": "2", "match_id": 1, "type": "Half Start"}, {"id": "3", "match_id": 1, "location": [9.0]}]
    raw = spark.createDataFrame([(json.dumps(d),) for d in docs], "payload string")
    got = {r["event_id"]: (r["location_x"], r["location_y"]) for r in feeds.match_events(raw).collect()}
    assert got == {"1": (1.5, 2.5), "2": (None, None), "3": (None, None)}


def test_ticks_keep_trades_only(spark):
    tick = {"e": "trade", "t": 1, "s": "BTC", "p": "10.5", "q": "2", "m": True, "T": 1700000000123, "E": 1700000000124}
    raw = spark.createDataFrame([(json.dumps(tick),), (json.dumps({"e": "ping"}),)], "value string")
    got = feeds.parse_ticks(raw).collect()
    assert len(got) == 1 and got[0]["price"] == 10.5 and got[0]["trade_time"].microsecond == 123000


def test_upsert_is_idempotent_and_touches_its_partitions(spark, tmp_path, rows):
    path = str(tmp_path / "t")
    old = spark.createDataFrame([(1, "a", 0), (2, "b", 0), (3, "c", 1)], "id int, v string, p int")
    sinks.upsert(old, path, ["id"], "p")
    untouched = {f.name: f.stat().st_mtime_ns for f in (tmp_path / "t" / "p=1").glob("*.parquet")}
    new = spark.createDataFrame([(2, "B", 0), (4, "d", 2)], "id int, v string, p int")
    for _ in range(2):
        sinks.upsert(new, path, ["id"], "p")
        got = rows(spark.read.parquet(path), "id", "v", "p")
        assert got == [(1, "a", 0), (2, "B", 0), (3, "c", 1), (4, "d", 2)]
    assert untouched == {f.name: f.stat().st_mtime_ns for f in (tmp_path / "t" / "p=1").glob("*.parquet")}


def test_upsert_takes_the_latest_of_repeated_keys(spark, tmp_path, rows):
    new = spark.createDataFrame([(1, 1, 0), (1, 2, 0)], "id int, v int, p int")
    sinks.upsert(new, str(tmp_path / "t"), ["id"], "p", [F.desc("v")])
    assert rows(spark.read.parquet(str(tmp_path / "t")), "id", "v") == [(1, 2)]


def test_replace_slice_keeps_other_slices(spark, tmp_path, rows):
    path = str(tmp_path / "t")
    sinks.replace_slice(spark.createDataFrame([(1, "x"), (2, "y")], "v int, k string"), path, "k")
    sinks.replace_slice(spark.createDataFrame([(9, "x")], "v int, k string"), path, "k")
    assert rows(spark.read.parquet(path), "v", "k") == [(2, "y"), (9, "x")]


def test_pending_and_evolving(spark, rows):
    want = spark.createDataFrame([(1,), (2,)], "id int")
    loaded = spark.createDataFrame([(1, "x"), (1, "y")], "id int, v string")
    assert rows(pending(want, loaded, "id")) == [(2,)]
    assert rows(append_evolving(want, loaded), "id", "v") == [(1, "x"), (1, "y"), (1, None), (2, None)]


def test_materialize_table(spark):
    sinks.materialize(spark.range(3), "tidemark_test_table", "table")
    assert spark.table("tidemark_test_table").count() == 3
    spark.sql("DROP TABLE tidemark_test_table")


def test_upsert_keeps_columns_that_come_later(spark, tmp_path):
    path = str(tmp_path / "evolving")
    sinks.upsert(spark.createDataFrame([(1, 0, "a")], "id int, d int, x string"), path, ["id"], "d")
    sinks.upsert(spark.createDataFrame([(2, 0, "b", "new")], "id int, d int, x string, y string"), path, ["id"], "d")
    third = spark.createDataFrame([(3, 0, "c", "later")], "id int, d int, x string, y string")
    df = sinks.materialize(third, path, "incremental", keys=["id"], partition="d")
    got = sorted((r["id"], r["x"], r["y"]) for r in df.collect())
    assert got == [(1, "a", None), (2, "b", "new"), (3, "c", "later")]
