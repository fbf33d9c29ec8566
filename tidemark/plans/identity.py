"""Which customer is behind a cookie: sessions, tiered links, resolution, evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.aggregates import share_of_total
from tidemark.operators.keyed import first_per_key
from tidemark.operators.links import best_shared
from tidemark.session import cut

# Link methods with their confidence.
CONFIDENCE = {
    "login": 1.00,
    "email_click_encoded": 0.99,
    "checkout_email": 0.98,
    "device_fingerprint": 0.55,
    "shared_ip": 0.35,
}
LOGIN_EVENTS = ("login", "loyalty_signup")


def sessions(events: DataFrame) -> DataFrame:
    """One row per session with its funnel counts and the customer seen inside it.

    Device, source and true ids come out if the events have them.
    """
    kind = F.col("event_type")
    first = F.struct("event_at", "event_id")

    def earliest(col: str):
        # The earliest known value; rows without one must not win.
        return F.min_by(col, F.when(F.col(col).isNotNull(), first)).alias(col)

    return events.groupBy("session_id", "anonymous_id").agg(
        F.min("event_at").alias("session_start"),
        F.max("event_at").alias("session_end"),
        F.count(F.lit(1)).alias("num_events"),
        F.count_if(kind == "page_view").alias("num_page_views"),
        F.count_if(kind == "search").alias("num_searches"),
        F.count_if(kind == "add_to_cart").alias("num_add_to_cart"),
        F.count_if(kind == "purchase").alias("num_purchases"),
        F.max("customer_id").alias("session_customer_id"),
        (F.count("customer_id") > 0).alias("is_identified"),
        (F.count_if(kind == "purchase") > 0).alias("is_converted"),
        *[earliest(c) for c in ("device_type", "traffic_source", "_true_customer_id",
                                "_true_session_id") if c in events.columns],
    )


def deterministic_links(events: DataFrame) -> DataFrame:
    """Links from events that carried the customer id; the strongest signal names the method."""
    kind = F.col("event_type")
    method = (
        F.when(F.bool_or(kind.isin(*LOGIN_EVENTS)), "login")
        .when(F.bool_or(kind == "email_click"), "email_click_encoded")
        .otherwise("checkout_email")
    )
    return (
        events.filter(F.col("customer_id").isNotNull())
        .groupBy("anonymous_id", "customer_id")
        .agg(
            method.alias("link_method"),
            F.min("event_at").alias("linked_at"),
            F.count(F.lit(1)).alias("n_signals"),
        )
    )


def bridge(events: DataFrame) -> DataFrame:
    """Cookie to customer links in a deterministic and a probabilistic tier.

    A cookie without a signal of its own takes the customer with whom it shares most
    device fingerprints (address and agent), else most addresses.
    """
    known = deterministic_links(events)
    # What each cookie was seen with; everything below needs only these few columns.
    seen = cut(events.groupBy("anonymous_id", "ip_address", "user_agent").agg(
        F.max("customer_id").isNotNull().alias("_signal")
    ))
    linked = known.select("anonymous_id", "customer_id")
    unknown = seen.join(linked.select("anonymous_id").distinct(), "anonymous_id", "left_anti")
    of_customer = cut(
        seen.join(linked, "anonymous_id").select("customer_id", "ip_address", "user_agent").distinct()
    )

    both = F.struct("ip_address", "user_agent").alias("print")
    complete = F.col("ip_address").isNotNull() & F.col("user_agent").isNotNull()
    by_print = cut(best_shared(
        unknown.filter(complete).select("anonymous_id", both),
        of_customer.filter(complete).select("customer_id", both),
        "anonymous_id", "customer_id", "print",
    ))
    left_over = unknown.join(by_print, "anonymous_id", "left_anti").filter(
        F.col("ip_address").isNotNull()
    )
    by_address = _best_by_address(left_over, of_customer)

    def tier(links: DataFrame, method: str) -> DataFrame:
        return links.select(
            "anonymous_id", "customer_id", F.lit(method).alias("link_method"),
            F.lit("probabilistic").alias("confidence_tier"),
            F.lit(None).cast(events.schema["event_at"].dataType).alias("linked_at"),
            F.col("strength").alias("n_signals"),
        )

    links = known.withColumn("confidence_tier", F.lit("deterministic"))
    links = links.unionByName(tier(by_print, "device_fingerprint"))
    links = links.unionByName(tier(by_address, "shared_ip"))
    confidence = F.coalesce(
        *[F.when(F.col("link_method") == m, F.lit(c)) for m, c in CONFIDENCE.items()]
    )
    return links.withColumn("confidence", confidence)


def _best_by_address(sightings: DataFrame, of_customer: DataFrame) -> DataFrame:
    """Best customer by shared addresses; an address used with n agents counts n times."""
    mine = sightings.groupBy("anonymous_id", "ip_address").agg(F.count(F.lit(1)).alias("agents"))
    theirs = (
        of_customer.filter(F.col("ip_address").isNotNull())
        .select("customer_id", "ip_address").distinct()
    )
    return best_shared(
        mine, theirs, "anonymous_id", "customer_id", "ip_address", "agents"
    )


def best_links(links: DataFrame) -> DataFrame:
    """Per cookie the best deterministic and the best probabilistic link, side by side."""
    best = first_per_key(
        links, ["anonymous_id", "confidence_tier"],
        [F.desc("confidence"), F.desc("n_signals"), F.asc("customer_id")],
    )
    sure = F.col("confidence_tier") == "deterministic"
    out = []
    for col in ("customer_id", "link_method", "confidence"):
        out.append(F.max(F.when(sure, F.col(col))).alias(f"det_{col}"))
        out.append(F.max(F.when(~sure, F.col(col))).alias(f"prob_{col}"))
    return best.groupBy("anonymous_id").agg(*out)


def graph(session_rows: DataFrame, links: DataFrame) -> DataFrame:
    """Resolve each session with a strict (sure links) and an extended (any link) customer."""
    tier = (
        F.when(F.col("det_customer_id").isNotNull(), "deterministic")
        .when(F.col("prob_customer_id").isNotNull(), "probabilistic")
        .otherwise("unresolved")
    )

    def either(col: str):
        return F.coalesce(f"det_{col}", f"prob_{col}")

    return session_rows.join(best_links(links), "anonymous_id", "left").select(
        "session_id", "anonymous_id", "session_start", "num_events", "is_converted",
        F.col("det_customer_id").alias("customer_id_strict"),
        either("customer_id").alias("customer_id_extended"),
        tier.alias("resolution_tier"),
        either("link_method").alias("resolution_method"),
        either("confidence").alias("resolution_confidence"),
        *[c for c in ("_true_customer_id",) if c in session_rows.columns],
    )


def link_precision(links: DataFrame, events: DataFrame) -> DataFrame:
    """Share of right links per tier and method against the hidden true customer."""
    truth = events.select("anonymous_id", F.col("_true_customer_id").alias("_truth")).distinct()
    right = F.count_if(F.col("customer_id") == F.col("_truth"))
    return links.join(truth, "anonymous_id").groupBy("confidence_tier", "link_method").agg(
        F.count(F.lit(1)).alias("links"),
        right.alias("correct"),
        F.round(100.0 * right / F.count(F.lit(1)), 1).alias("precision_pct"),
    )


def link_composition(links: DataFrame) -> DataFrame:
    return links.groupBy("confidence_tier", "link_method").agg(
        F.count(F.lit(1)).alias("links"), F.round(F.avg("confidence"), 2).alias("conf")
    )


def coverage(resolved: DataFrame) -> DataFrame:
    return share_of_total(resolved, ["resolution_tier"], "sessions", "pct")


def precision_recall(resolved: DataFrame) -> DataFrame:
    """Precision and recall of the strict and the extended key, one row each, in one pass."""
    truth = F.col("_true_customer_id")
    aggs = [F.count_if(truth.like("C%")).alias("known")]
    for key in ("strict", "extended"):
        col = F.col(f"customer_id_{key}")
        aggs += [F.count(col).alias(f"{key}_n"), F.count_if(col == truth).alias(f"{key}_ok")]
    one = resolved.agg(*aggs)
    rows = F.array(*[
        F.struct(F.lit(label).alias("key"), F.col(f"{k}_n").alias("resolved"),
                 F.col(f"{k}_ok").alias("correct"))
        for k, label in (("strict", "strict (deterministic)"), ("extended", "extended (det+prob)"))
    ])
    flat = one.select("known", F.inline(rows))
    return flat.select(
        "key", "resolved", "correct",
        F.round(100.0 * F.col("correct") / F.nullif("resolved", F.lit(0)), 1).alias("precision_pct"),
        F.round(100.0 * F.col("correct") / F.nullif("known", F.lit(0)), 1).alias("recall_pct"),
    )
