"""Conforming projections: rename, cast, pass through, drop."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.scalars import flag, number, snake

# What a conform spec may say about a column: "src", ("src", "type") or an expression.
Rule = Column | str | tuple[str, str]


def conform(df: DataFrame, spec: Mapping[str, Rule]) -> DataFrame:
    """Project `df` onto the columns of `spec`, in the order of the spec."""
    out = []
    for name, rule in spec.items():
        if isinstance(rule, tuple):
            column = F.col(rule[0]).cast(rule[1])
        else:
            column = F.col(rule) if isinstance(rule, str) else rule
        out.append(column.alias(name))
    return df.select(*out)


def conform_wide(
    df: DataFrame,
    renames: Mapping[str, str] | None = None,
    flags: Mapping[str, str] | None = None,
    casts: Mapping[str, str] | None = None,
    numbers: Iterable[str] = (),
) -> DataFrame:
    """Snake-case every column of a wide feed, with exceptions.

    `renames` and `flags` map raw to final names (flags become booleans), `casts`
    map raw names to types, and text columns in `numbers` become doubles or null.
    """
    renames, flags, casts = renames or {}, flags or {}, casts or {}
    out = []
    for raw in df.columns:
        column = F.col(raw)
        if raw in casts:
            column = column.cast(casts[raw])
        if raw in numbers:
            column = number(raw)
        if raw in flags:
            column = flag(raw)
        out.append(column.alias(flags.get(raw) or renames.get(raw) or snake(raw)))
    return df.select(*out)


def production_view(df: DataFrame, private: Iterable[str]) -> DataFrame:
    """Drop personal and evaluation-only columns before a table is published."""
    return df.drop(*private)
