"""Dense vectors as array<double> columns, without leaving the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.scalars import _c


def dot(a: Column | str, b: Column | str) -> Column:
    products = F.zip_with(_c(a), _c(b), lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda total, x: total + x)


def norm(a: Column | str) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column | str, b: Column | str) -> Column:
    return dot(a, b) / F.nullif(norm(a) * norm(b), F.lit(0.0))


def unit(a: Column | str) -> Column:
    """The vector divided by its length; null for the zero vector."""
    a = _c(a)
    # The one-element array binds the length, which would be computed for each component.
    lengths = F.array(F.nullif(norm(a), F.lit(0.0)))
    scaled = F.transform(lengths, lambda n: F.when(
        n.isNotNull(), F.transform(a, lambda x: x.cast("double") / n)))
    return scaled[0]
