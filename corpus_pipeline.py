"""A corpus pipeline of four operators: toxicity filter, near-duplicate removal, mixing, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before kept. All but the
last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import mixing, packing, partenum, toxicity
from tidemark.llm.queries import read, tokenizer_path, tuned
from tidemark.session import scratch_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not take for toxic; it is trained on the stage's own input.

    A null doc_id or text is judged like any other; repeated rows are judged alike; without toxic
    examples nothing goes.
    """
    tuned(spark)
    classifier = toxicity.train(docs, read(spark, sf_dir, "labels"))
    return keep_clean(docs, classifier)


def keep_clean(docs: DataFrame, classifier: toxicity.Classifier) -> DataFrame:
    """The columns of documents go through the scoring task, so nothing is joined."""
    judged = toxicity.score(docs.select(*COLUMNS), classifier, COLUMNS)
    return judged.filter(F.col("predicted") == 0).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: that with the smallest doc_id.

    Texts without words are in no group and stay, as do rows without a doc_id. Rows that repeat
    a doc_id and its text count once; other texts of the same doc_id stay or go with it.
    """
    tuned(spark)
    groups = partenum.jaccard_components(docs)
    # Documents that go are fewer than those that stay, and their ids are all that is moved.
    gone = groups.filter(F.col("doc_id") != F.col("component_id")).select("doc_id").distinct()
    docs = docs.select(*COLUMNS)
    kept = docs.filter(F.col("doc_id").isNotNull()).join(gone, "doc_id", "left_anti")
    nameless = docs.filter(F.col("doc_id").isNull())
    return kept.dropDuplicates(["doc_id", "text"]).select(*COLUMNS).unionByName(nameless)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: whole, and once more in part where it says so.

    The part of a text is its first words, up to the end of the last one. A document of which
    nothing is taken goes, except one without words, which has nothing to take and stays. A null
    text is one without words and stays null; a null source is a source of its own; repeated rows
    are taken each; no documents give none.
    """
    tuned(spark)
    mixed = mixing.mix(docs, carry=["text", "lang", "n_chars"])
    whole = F.when(F.col("size") > 0, F.floor(F.col("taken") / F.col("size"))).otherwise(1).cast("int")
    rest = F.when(F.col("size") > 0, F.col("taken") - whole * F.col("size")).otherwise(0).cast("int")
    # Pieces end with a word and begin with the white space before it.
    pieces = F.split("text", r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])")
    head = F.array_join(F.slice(pieces, F.lit(1), rest), "")
    texts = F.when(whole > 0, F.array_repeat(F.col("text"), whole)).otherwise(F.array().cast("array<string>"))
    texts = F.when(rest > 0, F.concat(texts, F.array(head))).otherwise(texts)
    out = mixed.withColumn("text", F.explode(texts))
    return out.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.lit(0))).select(*COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all texts in sequences of at most 2048 tokens.

    A null or empty text is its end token alone, a null doc_id stays null, and repeated rows are
    packed each; no documents give no pieces.
    """
    tuned(spark)
    return packing.pack(docs, tokenizer_path())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

# The classifier and the tokenizer cannot be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to documents; each result is written as Parquet and read again."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = scratch_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
