"""Text and customer embeddings, and nearest neighbours."""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.feature import (
    IDF, CountVectorizer, ElementwiseProduct, Normalizer, RegexTokenizer, StopWordsRemover,
)
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from tidemark.functions import vectors
from tidemark.operators.aggregates import vector_mean
from tidemark.operators.keyed import top_per_key
from tidemark.session import cut

TERMS = 400
DIM = 32


def term_weights(df: DataFrame, key: str, text: str, terms: int = TERMS) -> DataFrame:
    """Unit-length tf-idf vectors over the `terms` most frequent words: (key, row)."""
    words = RegexTokenizer(
        inputCol=text, outputCol="_words", pattern=r"(?U)\b\w\w+\b", gaps=False, toLowercase=True
    ).transform(df.select(key, text).filter(F.col(text).isNotNull()))
    kept = StopWordsRemover(inputCol="_words", outputCol="_kept").transform(words)
    counter = CountVectorizer(inputCol="_kept", outputCol="_tf", vocabSize=terms, minDF=1.0)
    counts = cut(counter.fit(kept).transform(kept).select(key, "_tf"))
    spread = IDF(inputCol="_tf", outputCol="_idf").fit(counts)
    # One weight per vocabulary word; Spark's own idf lacks the added one.
    idf = [math.log((1 + spread.numDocs) / (1 + n)) + 1 for n in spread.docFreq]
    scaled = ElementwiseProduct(
        scalingVec=Vectors.dense(idf), inputCol="_tf", outputCol="_scaled").transform(counts)
    return Normalizer(p=2.0, inputCol="_scaled", outputCol="row").transform(scaled).select(key, "row")


def _partial_gram(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    total = None
    for pdf in batches:
        x = np.stack(pdf["row"].to_numpy())
        total = x.T @ x if total is None else total + x.T @ x
    if total is not None:
        yield pd.DataFrame({"i": np.arange(len(total)), "values": list(total)})


def right_singular_vectors(rows: DataFrame, dim: int) -> np.ndarray:
    """Top right singular vectors of the row matrix, from its terms-by-terms product.

    Each task sums its own rows; only that square of fixed size reaches the driver.
    """
    dense = rows.select(vector_to_array("row").alias("row"))
    partial = dense.mapInPandas(_partial_gram, "i int, values array<double>")
    summed = partial.groupBy("i").agg(Summarizer.sum(array_to_vector("values")).alias("values"))
    gram = np.array([r["values"].toArray() for r in summed.orderBy("i").collect()])
    _, basis = np.linalg.eigh((gram + gram.T) / 2)
    basis = basis[:, ::-1][:, :dim]
    # Eigenvectors have no sign of their own: make the largest component positive.
    peak = np.abs(basis).argmax(axis=0)
    return basis * np.sign(basis[peak, np.arange(basis.shape[1])])


def embed_text(df: DataFrame, key: str, text: str, terms: int = TERMS, dim: int = DIM) -> DataFrame:
    """Unit-length latent vectors of texts: tf-idf rows projected on their main directions."""
    rows = cut(term_weights(df, key, text, terms))
    basis = right_singular_vectors(rows, dim)

    @F.pandas_udf("array<double>")
    def project(row: pd.Series) -> pd.Series:
        out = np.stack(row.to_numpy()) @ basis
        length = np.linalg.norm(out, axis=1, keepdims=True)
        return pd.Series(list(np.divide(out, length, out=np.zeros_like(out), where=length > 0)))

    return rows.select(key, project(vector_to_array("row")).alias("embedding"))


def embed_customers(browsed: DataFrame, products: DataFrame, dim: int = DIM) -> DataFrame:
    """Mean of the embeddings of browsed product groups, weighted by how often, at length one."""
    counts = browsed.groupBy("customer_id", "product_group_id").agg(F.count(F.lit(1)).alias("weight"))
    joined = counts.join(products.select("product_group_id", "embedding"), "product_group_id")
    return vector_mean(joined, ["customer_id"], "embedding", F.col("weight"), dim, "embedding")


def nearest(df: DataFrame, key: str, vector: str, seed: Column, seed_key: Column, k: int = 5) -> DataFrame:
    """The k rows closest to one seed vector by cosine, without the seed itself."""
    rows = df.filter(F.col(key) != seed_key).withColumn("_seed", seed)
    scored = rows.select(key, vectors.cosine(vector, "_seed").alias("cos"))
    return scored.orderBy(F.desc("cos"), key).limit(k)


# Rows of a block of seeds and of a block of items at most, which one task compares, some seeds at a time.
SEED_BLOCK, ITEM_BLOCK, AT_A_TIME = 32_768, 32_768, 512


def nearest_for_all(
    seeds: DataFrame, items: DataFrame, key: str, vector: str, k: int = 5,
    seed_block: int = SEED_BLOCK, item_block: int = ITEM_BLOCK,
) -> DataFrame:
    """The k items closest to every seed by cosine: seed, rank, key, cos. A seed does not find its own key.

    Exact: blocks of seeds meet blocks of items, a pair of blocks in one task, which keeps k
    items per seed. A vector is shuffled once per block of the other side, single floats as such, so
    blocks are as large as they may be once all tasks have a pair. Vectors that are null or zero take
    no part; ties go to the smaller key.
    """
    tasks = 2 * int(seeds.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def blocked(df: DataFrame, size: int) -> tuple[DataFrame, int]:
        usable = F.exists(vector, lambda x: x != 0)
        single = df.schema[vector].dataType == ArrayType(FloatType(), df.schema[vector].dataType.containsNull)
        v = F.col(vector) if single else F.col(vector).cast("array<double>")
        rows = cut(df.select(F.col(key).cast("long").alias("id"), v.alias("v")).filter(usable))
        n = rows.count()
        blocks = max(1, -(-n // size), min(math.isqrt(tasks), n // 1024))
        return rows.withColumn("own", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")), blocks

    left, n = blocked(seeds, seed_block)
    right, m = blocked(items, item_block)
    # Each side goes to all blocks of the other one.
    left = left.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(m - 1)))).select("id", "v", F.col("own").alias("i"), F.col("other").alias("j"))
    right = right.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).select("id", "v", F.col("other").alias("i"), F.col("own").alias("j"))

    def compare(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        out = {"seed": [], key: [], "cos": []}
        if len(a) and len(b):
            x, y = (np.stack(df["v"].to_numpy()).astype(np.float64) for df in (a, b))
            ids = b["id"].to_numpy()
            x, y = (v / np.linalg.norm(v, axis=1, keepdims=True) for v in (x, y))
            rows = itertools.chain.from_iterable(x[at:at + AT_A_TIME] @ y.T for at in range(0, len(x), AT_A_TIME))
            for name, row in zip(a["id"], rows):
                row = np.where(ids == name, -np.inf, row)
                some = min(k, len(row))
                least = np.partition(row, len(row) - some)[len(row) - some]
                # Rounded like the order of the result, so that ties are ties in all blocks.
                near = np.flatnonzero((row >= least - 1e-9) & (ids != name))
                best = near[np.lexsort((ids[near], -row[near].round(12)))][:k]
                out["seed"] += [name] * len(best)
                out[key] += ids[best].tolist()
                out["cos"] += row[best].tolist()
        return pd.DataFrame(out)

    found = left.groupBy("i", "j").cogroup(right.groupBy("i", "j")).applyInPandas(compare, f"seed long, {key} long, cos double")
    return top_per_key(found, ["seed"], [F.desc(F.round("cos", 12)), F.asc(key)], k, rank="rank")
