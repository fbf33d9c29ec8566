"""Small tables with everything that is odd; test modules import the fixtures they use."""

import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng, n, letters="abcdefg"):
    return " ".join("".join(rng.choices(letters, k=rng.randint(2, 6))) for _ in range(n))


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls in every column, empty and very long texts, ties, repeated and similar rows."""
    rng = random.Random(7)
    base = words(rng, 60)
    near = base.split()
    near[30] = "changed"
    rows = [
        (1, base, "en", "a", 1),
        (2, " ".join(near), "en", "a", None),
        (3, base.upper(), None, "b", 1),
        (3, base.upper(), None, "b", 1),
        (4, None, "en", None, None),
        (5, "", "de", "a", 0),
        (6, " \t\n\x0b\x0c\r ", "de", "b", 7),
        (7, "one two three", "en", None, 13),
        (8, "one\ttwo\nthree", "en", "b", 13),
        (9, "größe über café   naïve <|endoftext|> x", "fr", "c", 40),
        (10, words(rng, 20_000), "en", "a", None),
        (None, words(rng, 12), "en", "c", 5),
        (-11, "x", "es", "", 1),
    ]
    return rows + [(100 + i, words(rng, rng.randint(1, 80)), "en", rng.choice("abc"), 3) for i in range(25)]


CLASHES = ("size", "score", "node", "component", "chunk", "place", "fold", "_slice", "_order", "bucket", "slab", "key")


@pytest.fixture(scope="session")
def odd_docs(spark, odd_rows):
    """The rows with extra columns whose names an operator might use itself."""
    df = spark.createDataFrame(odd_rows, DOCS)
    for name in CLASHES:
        df = df.selectExpr("*", f"'other' AS `{name}`")
    return df


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)
