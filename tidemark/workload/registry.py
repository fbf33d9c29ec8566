"""Registry of checked queries: a Spark callable and, where SQL can say it, its oracle."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.session import tune

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

# Named pieces of oracle SQL; a piece may use other pieces by name.
PIECES: dict[str, str] = {}


def piece(name: str, sql: str) -> None:
    PIECES[name] = sql.strip()


def with_pieces(sql: str) -> str:
    """Prepend the pieces a statement uses, in dependency order."""
    order: list[str] = []

    def visit(text: str, own: str = "") -> None:
        for word in re.findall(r"\b[a-z_][a-z0-9_]*\b", text):
            if word in PIECES and word != own and word not in order:
                visit(PIECES[word], word)
                if word not in order:
                    order.append(word)

    visit(sql)
    if not order:
        return sql
    return "WITH " + ",\n".join(f"{n} AS ({PIECES[n]})" for n in order) + "\n" + sql


def query(name: str, sql: str | None = None):
    """Register a query, and its oracle if there is one."""

    def register(fn: Callable[[SparkSession, str], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(tune(spark), sf_dir)

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = with_pieces(sql.strip())
        return fn

    return register


def rounded(expr: str, digits: int) -> str:
    """Oracle text: round half up on the decimal value, as Spark rounds doubles."""
    return f"CAST(round(CAST({expr} AS DECIMAL(38,10)), {digits}) AS DOUBLE)"
