"""Scalar column expressions: flags, vocabularies, guarded rates, keys, text."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the token a null key part turns into before hashing.
NULL_KEY_TOKEN = "_dbt_utils_surrogate_key_null_"


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def flag(col: Column | str) -> Column:
    """0/1 number to boolean; null stays null."""
    return _c(col) == F.lit(1)


def number(col: Column | str) -> Column:
    """Text to double; text that is no number becomes null."""
    return _c(col).try_cast("double")


def map_values(col: Column | str, vocabulary: dict[str, list[str]], default: str) -> Column:
    """Translate source words into canonical words, anything else into `default`."""
    out = None
    for canonical, words in vocabulary.items():
        hit = _c(col).isin(words)
        out = F.when(hit, canonical) if out is None else out.when(hit, canonical)
    return out.otherwise(default)


def ratio(num: Column | str, den: Column | str, digits: int | None = None) -> Column:
    """num / den as double, null where the denominator is zero."""
    value = _c(num).cast("double") / F.nullif(_c(den).cast("double"), F.lit(0.0))
    return value if digits is None else F.round(value, digits)


def zero_if_null(col: Column | str, like: str = "bigint") -> Column:
    return F.coalesce(_c(col), F.lit(0).cast(like))


def surrogate_key(*cols: Column | str) -> Column:
    """md5 over the dash-joined key parts."""
    parts = [F.coalesce(_c(c).cast("string"), F.lit(NULL_KEY_TOKEN)) for c in cols]
    return F.md5(F.concat_ws("-", *parts))


def min_max(value: Column, low: Column, high: Column, constant: float) -> Column:
    """Scale to [0, 1]; a constant series becomes `constant`."""
    return F.when(high > low, (value - low) / (high - low)).otherwise(F.lit(constant))


def words(col: Column | str) -> Column:
    """Lower-case words of a query, split on blanks, without empty ones."""
    return F.filter(F.split(F.lower(_c(col)), r"\s+"), lambda w: w != "")


def overlap(tokens: Column, text: Column) -> Column:
    """How many of the tokens occur anywhere inside the text."""
    return F.size(F.filter(tokens, lambda t: text.contains(t)))


def joined(items: Column | str, field: str | None = None) -> Column:
    """Array to comma-joined text, taking one field where the items are structs."""
    items = _c(items)
    if field is not None:
        items = F.transform(items, lambda x: x[field])
    return F.array_join(items, ", ")


def snake(name: str) -> str:
    """camelCase to snake_case; digits are words of their own, q1/ot2 prefixes stay whole."""
    parts = re.findall(r"(?:^(?:q|ot)\d)|[A-Z]?[a-z]+|\d+|[A-Z]+(?![a-z])", name)
    return "_".join(p.lower() for p in parts)
