"""URL filter: rules first, then logistic regression on hashed character n-grams.

Host and path of a URL are cut into character n-grams, hashed into a fixed number of
features, and a logistic regression trained on a small table of labelled URLs gives the
verdict where no rule decides. All of it is DataFrame functions and Spark's own regression.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.session import stored

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


def host_of(url: Column) -> Column:
    """After the first `://` up to `/`, `?`, `#` or the end, A-Z in lower case; else empty."""
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host, up to `?`, `#` or the end; empty without `://`."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def matching_rule(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """Struct (rule, verdict) of the longest rule that fits, else null.

    A rule fits its host and every subdomain, if the path starts with the rule's. The list
    of rules is a short parameter and becomes one CASE expression, longest rule first.
    """
    found = None
    for rule in sorted(rules, key=lambda r: (-len(r.name), r.name)):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        value = F.struct(F.lit(rule.name).alias("rule"), F.lit(rule.verdict).alias("verdict"))
        found = F.when(fits, value) if found is None else found.when(fits, value)
    return found if found is not None else F.lit(None).cast("struct<rule:string,verdict:string>")


def grams(host: Column, path: Column, sizes: Sequence[int] = (2, 3, 4)) -> Column:
    """Character n-grams of the bracketed host and path, tagged with the part they are from."""
    parts = []
    for tag, text in (("h", F.concat(F.lit("^"), host, F.lit("$"))), ("p", F.concat(F.lit("^"), path, F.lit("$")))):
        for n in sizes:
            parts.append(_tagged_grams(tag, text, n))
    return F.concat(*parts)


def _tagged_grams(tag: str, text: Column, n: int) -> Column:
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(text) - F.lit(n - 1)))
    return F.transform(starts, lambda i: F.concat(F.lit(tag), F.substring(text, i, F.lit(n))))


@dataclass(frozen=True)
class Trained:
    """A trained filter. `model` is null if the labelled table holds one verdict or none."""

    hashing: HashingTF
    model: object
    default: str


def train(
    labelled: DataFrame, features: int = 1 << 14, regularization: float = 1e-3, iterations: int = 60
) -> Trained:
    """Fit the regression on a small table (host, path, verdict allow or block)."""
    hashing = HashingTF(inputCol="_grams", outputCol="_features", numFeatures=features, binary=True)
    rows = labelled.select(
        grams(F.col("host"), F.col("path")).alias("_grams"),
        (F.col("verdict") == "block").cast("double").alias("_label"),
    )
    seen = {r["_label"] for r in rows.select("_label").distinct().collect()}
    if seen != {0.0, 1.0}:
        return Trained(hashing, None, "block" if seen == {1.0} else "allow")
    regression = LogisticRegression(
        featuresCol="_features", labelCol="_label", regParam=regularization, maxIter=iterations,
        standardization=False, tol=1e-7, probabilityCol="_probability", rawPredictionCol="_raw",
        predictionCol="_prediction",
    )
    return Trained(hashing, regression.fit(hashing.transform(rows)), "allow")


def score(urls: DataFrame, trained: Trained, threshold: float = 0.5) -> DataFrame:
    """Adds `block_probability` and `method_verdict` to rows with host and path."""
    if trained.model is None:
        probability = F.lit(1.0 if trained.default == "block" else 0.0)
        return urls.withColumn("block_probability", probability).withColumn(
            "method_verdict", F.lit(trained.default)
        )
    rows = trained.hashing.transform(urls.withColumn("_grams", grams(F.col("host"), F.col("path"))))
    rows = trained.model.transform(rows).withColumn(
        "block_probability", F.get(vector_to_array("_probability"), F.lit(1))
    )
    verdict = F.when(F.col("block_probability") >= threshold, "block").otherwise("allow")
    return rows.drop("_grams", "_features", "_raw", "_probability", "_prediction").withColumn(
        "method_verdict", verdict
    )


def filter_urls(pages: DataFrame, rules: Sequence[Rule], sample: int = 4000) -> DataFrame:
    """Host, path, rule and verdict of every page: page_id, host, path, rule, verdict, block_probability.

    The labelled table is made of URLs that a rule decides: at most `sample` of them, those
    of the smallest hash of host and path, each distinct one once.

    Defined cases: a null URL or one without `://` has an empty host and path and is judged by
    the method; without labelled URLs the method allows; equal rows each give a row; other
    columns are ignored.
    """
    parts = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    found = parts.withColumn("_found", matching_rule(F.col("host"), F.col("path"), rules))
    labelled = (
        found.filter(F.col("_found").isNotNull())
        .groupBy("host", "path")
        .agg(F.first("_found.verdict").alias("verdict"))
        .orderBy(F.xxhash64("host", "path"), "host", "path")
        .limit(sample)
    )
    judged = score(found, train(stored(labelled, "url-labels")))
    return judged.select(
        "page_id",
        "host",
        "path",
        F.col("_found.rule").alias("rule"),
        F.coalesce("_found.verdict", "method_verdict").alias("verdict"),
        "block_probability",
    )
