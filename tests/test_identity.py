import pytest
from pyspark.sql import functions as F

from tidemark.plans import identity

SCHEMA = ("event_id string, anonymous_id string, customer_id string, event_type string, event_at string, "
          "ip_address string, user_agent string")


@pytest.fixture(scope="module")
def clicks(spark):
    data = [
        # one cookie with two customers of equal confidence; c1 has more signals
        ("e1", "two", "c1", "login", "10:00", "i1", "u1"), ("e2", "two", "c1", "login", "10:01", "i1", "u1"),
        ("e3", "two", "c2", "login", "10:02", "i1", "u1"),
        # signals of each strength
        ("e4", "mail", "c3", "email_click", "10:00", "i2", "u2"), ("e5", "mail", "c3", "purchase", "10:01", "i2", "u2"),
        ("e6", "shop", "c4", "purchase", "10:00", "i3", "u3"),
        # same address and agent as c3; same address only as c4; nothing in common
        ("e7", "print", None, "page_view", "10:00", "i2", "u2"),
        ("e8", "address", None, "page_view", "10:00", "i3", "u9"), ("e9", "address", None, "page_view", "10:00", "i3", "u8"),
        ("e10", "nobody", None, "page_view", "10:00", "i8", "u8"), ("e11", "blank", None, "search", "10:00", None, None),
    ]
    df = spark.createDataFrame(data, SCHEMA)
    return df.withColumn("event_at", F.concat(F.lit("2024-01-01 "), "event_at").cast("timestamp_ntz"))



def test_bridge_tiers(clicks, rows):
    out = identity.bridge(clicks)
    assert rows(out, "anonymous_id", "customer_id", "link_method", "confidence", "n_signals") == [
        ("address", "c4", "shared_ip", 0.35, 2), ("mail", "c3", "email_click_encoded", 0.99, 2),
        ("print", "c3", "device_fingerprint", 0.55, 1), ("shop", "c4", "checkout_email", 0.98, 1),
        ("two", "c1", "login", 1.0, 2), ("two", "c2", "login", 1.0, 1)]


def test_graph_resolution(clicks, rows):
    sessions = clicks.select("anonymous_id").distinct().select(
        F.col("anonymous_id").alias("session_id"), "anonymous_id", F.lit(None).cast("timestamp").alias("session_start"),
        F.lit(1).alias("num_events"), F.lit(False).alias("is_converted"), F.lit("c3").alias("_true_customer_id"))
    graph = identity.graph(sessions, identity.bridge(clicks))
    got = {r["anonymous_id"]: (r["customer_id_strict"], r["customer_id_extended"], r["resolution_tier"])
           for r in graph.collect()}
    assert got["two"] == ("c1", "c1", "deterministic")
    assert got["print"] == (None, "c3", "probabilistic")
    assert got["nobody"] == got["blank"] == (None, None, "unresolved")


def test_session_takes_earliest_known_value(spark):
    data = [("s", "a", "e1", None, "10:00"), ("s", "a", "e2", "tablet", "10:01"), ("s", "a", "e3", "phone", "10:02")]
    df = spark.createDataFrame(data, "session_id string, anonymous_id string, event_id string, device_type string, event_at string")
    for c in ("traffic_source", "_true_customer_id", "_true_session_id", "customer_id"):
        df = df.withColumn(c, F.lit(None).cast("string"))
    row = identity.sessions(df.withColumn("event_type", F.lit("search"))).first()
    assert (row["device_type"], row["is_identified"], row["num_searches"]) == ("tablet", False, 3)
