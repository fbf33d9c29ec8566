"""Point-in-time features and the purchase propensity model."""

from __future__ import annotations

from datetime import datetime

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.scalars import zero_if_null
from tidemark.functions.timeparts import elapsed_days
from tidemark.operators.joins import membership, outer_merge
from tidemark.operators.ordered import deciles, rank_rows, running_total, split as in_parts
from tidemark.session import cut

# Model inputs and the recency of customers without any event.
FEATURES = [
    "n_sessions", "n_events", "n_page_views", "n_searches", "n_add_to_cart", "n_orders",
    "total_spend", "avg_order_value", "has_prior_order", "recency_days", "order_recency_days",
    "emails_opened", "emails_clicked", "loyalty_member", "is_gold", "is_petite",
]
NEVER_DAYS = 999


def _paid(orders: DataFrame) -> DataFrame:
    return orders.filter(F.col("customer_id").isNotNull() & (F.col("order_status") != "cancelled"))


def features_asof(
    events: DataFrame, orders: DataFrame, emails: DataFrame, customers: DataFrame, cutoff: datetime
) -> DataFrame:
    """One row per customer from data strictly before the cutoff."""
    at = F.lit(cutoff).cast("timestamp_ntz")
    kind = F.col("event_type")
    web = (
        events.filter(F.col("customer_id_extended").isNotNull() & (F.col("event_at") < at))
        .groupBy(F.col("customer_id_extended").alias("customer_id"))
        .agg(
            F.count_distinct("session_id").alias("n_sessions"),
            F.count(F.lit(1)).alias("n_events"),
            F.count_if(kind == "page_view").alias("n_page_views"),
            F.count_if(kind == "search").alias("n_searches"),
            F.count_if(kind == "add_to_cart").alias("n_add_to_cart"),
            F.max("event_at").alias("last_event_at"),
        )
    )
    bought = _paid(orders).filter(F.col("order_at") < at).groupBy("customer_id").agg(
        F.count(F.lit(1)).alias("n_orders"),
        F.sum("net_amount").alias("total_spend"),
        F.max("order_at").alias("last_order_at"),
    )
    mail = emails.filter(F.col("event_at") < at).groupBy("customer_id").agg(
        F.count_if(kind == "open").alias("emails_opened"),
        F.count_if(kind == "click").alias("emails_clicked"),
    )
    attributes = customers.filter("is_current").select(
        "customer_id", "loyalty_member", "loyalty_tier", "brand_line_affinity"
    )
    merged = outer_merge([web, bought, mail], "customer_id").join(attributes, "customer_id", "left")
    counts = ["n_sessions", "n_events", "n_page_views", "n_searches", "n_add_to_cart", "n_orders",
              "emails_opened", "emails_clicked"]
    filled = merged.withColumns({c: zero_if_null(c) for c in counts}).withColumn(
        "total_spend", zero_if_null("total_spend", "double")
    )

    def recency(col: str) -> Column:
        return F.coalesce(elapsed_days(col, at), F.lit(NEVER_DAYS).cast("bigint"))

    def as_int(condition: Column) -> Column:
        return F.coalesce(condition, F.lit(False)).cast("int")

    return filled.withColumns({
        "has_prior_order": as_int(F.col("n_orders") > 0),
        "recency_days": recency("last_event_at"),
        "order_recency_days": recency("last_order_at"),
        "avg_order_value": F.coalesce(
            F.col("total_spend") / F.nullif("n_orders", F.lit(0)), F.lit(0.0)),
        "loyalty_member": as_int(F.col("loyalty_member")),
        "is_gold": as_int(F.col("loyalty_tier") == "Gold"),
        "is_petite": as_int(F.col("brand_line_affinity") == "Petite"),
    })


def label(features: DataFrame, orders: DataFrame, cutoff: datetime) -> DataFrame:
    """1 for customers who bought at or after the cutoff."""
    buyers = _paid(orders).filter(F.col("order_at") >= F.lit(cutoff).cast("timestamp_ntz"))
    marked = membership(features, buyers, "customer_id", "_bought")
    return marked.withColumn("label", F.col("_bought").cast("int")).drop("_bought")


def split(labelled: DataFrame, test_share: float = 0.25, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """Stratified training and test rows: the same share of each label, picked by hash."""
    order = [F.xxhash64(F.lit(seed), F.col("customer_id")), F.asc("customer_id")]
    ranked = rank_rows(labelled, order, "_rank", within=["label"])
    sizes = labelled.groupBy("label").agg(F.round(F.count(F.lit(1)) * test_share).alias("_tests"))
    marked = cut(ranked.join(sizes, "label"))
    test = F.col("_rank") <= F.col("_tests")
    return tuple(marked.filter(c).drop("_rank", "_tests") for c in (~test, test))


def fit(train: DataFrame) -> PipelineModel:
    """Balanced, L2-regularised logistic regression on standardised features."""
    train = cut(train)
    total = train.count()
    sizes = train.groupBy("label").agg(F.count(F.lit(1)).alias("_n"))
    # Each class weighs half of all rows; the weights add up to the number of rows.
    weighted = train.join(sizes, "label").withColumn("weight", F.lit(total) / (2 * F.col("_n")))
    stages = [
        VectorAssembler(inputCols=FEATURES, outputCol="raw"),
        StandardScaler(inputCol="raw", outputCol="features", withMean=True, withStd=True),
        LogisticRegression(weightCol="weight", regParam=1.0 / total, elasticNetParam=0.0,
                           standardization=False, maxIter=1000, tol=1e-8),
    ]
    return Pipeline(stages=stages).fit(weighted)


def predict(model: PipelineModel, features: DataFrame) -> DataFrame:
    scored = model.transform(features)
    return scored.withColumn("purchase_propensity", vector_to_array("probability")[1])


def drivers(model: PipelineModel) -> list[tuple[str, float]]:
    """Features with their coefficient, the strongest first."""
    pairs = zip(FEATURES, model.stages[-1].coefficients.toArray().tolist())
    return sorted(pairs, key=lambda p: -abs(p[1]))


def average_precision(scored: DataFrame, score: str, truth: str) -> Column:
    """Step-wise area under the precision-recall curve, as a scalar.

    Rows with one score form one step. Running counts come from parts of the sorted steps.
    """
    steps = scored.groupBy((-F.col(score)).alias("_minus")).agg(
        F.sum(truth).alias("_hits"), F.count(F.lit(1)).alias("_n")
    )
    steps = in_parts(steps, [], ["_minus"])
    running = running_total(steps, [], "_hits", ["_minus"], "_h")
    running = running_total(running, [], "_n", ["_minus"], "_seen")
    precision = F.col("_h") / F.col("_seen")
    return running.agg(F.sum(precision * F.col("_hits")) / F.sum("_hits")).scalar()


def evaluate(test: DataFrame) -> DataFrame:
    """ROC-AUC, average precision, base rate and lift of the best decile, one row."""
    test = cut(test.select("customer_id", "label", "purchase_propensity"))
    roc = BinaryClassificationEvaluator(
        rawPredictionCol="purchase_propensity", labelCol="label", numBins=0
    ).evaluate(test)
    # Ranked upwards, so that decile 10 holds the highest scores.
    ranked = rank_rows(test, [F.asc("purchase_propensity"), F.asc("customer_id")], "_rank")
    best = deciles(ranked, "_rank", "decile").filter("decile = 10").agg(F.avg("label")).scalar()
    base = test.agg(F.avg("label")).scalar()
    one = test.agg(F.count(F.lit(1)).alias("n_test"))
    return one.select(
        "n_test", F.lit(roc).alias("roc_auc"),
        average_precision(test, "purchase_propensity", "label").alias("pr_auc"),
        base.alias("base_rate"), best.alias("top_decile_rate"),
        (best / F.greatest(base, F.lit(1e-9))).alias("lift"),
    )


def score(model: PipelineModel, features: DataFrame) -> DataFrame:
    """Propensity and decile (10 = most likely) of every customer."""
    scored = predict(model, features).select("customer_id", "purchase_propensity", "has_prior_order")
    ranked = rank_rows(scored, [F.asc("purchase_propensity"), F.asc("customer_id")], "_rank")
    return deciles(ranked, "_rank", "propensity_decile").drop("_rank")
