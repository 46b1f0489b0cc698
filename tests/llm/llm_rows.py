"""Rows that every operator over documents has to stand: NULLs, empty and long texts, repeats, clashing columns."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

#: Names that operators use inside.
CLASHING = ("text_key", "node", "place", "row", "id", "part", "_part", "bucket", "spans", "rest", "order", "size", "n", "score")


def prose(seed: int, words: int) -> str:
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdeghilmnorstu") for _ in range(rng.randint(2, 8))) for _ in range(words))


def messy_rows() -> list[tuple]:
    base, other = prose(1, 120), prose(2, 90)
    near = base.split(" ")
    near[60] = "changed"
    return [
        (1, base, "en", "a", 5),
        (2, base, "en", "a", None),
        (2, base, "en", "a", None),
        (3, " ".join(near), None, "b", 7),
        (4, None, "en", "b", 0),
        (5, "", "en", None, 0),
        (6, " \t\n ", "en", None, 3),
        (7, "one two", "en", "c", 7),
        (8, "One  TWO", "en", "c", 8),
        (9, prose(3, 30_000), "en", "a", 9),
        (10, other + " " + base, "en", "a", 9),
        (None, base, "en", "a", 9),
        (None, None, None, None, None),
        (11, "wörter ünd " * 400, "de", "d", 1),
        (12, "same " * 3000, "en", "d", 1),
        (13, "same " * 2000 + other, "en", "d", 1),
        (10, "another text under a used number", "en", "a", 9),
    ]


def key(row):
    return tuple((x is not None, x if x is not None else 0) for x in row)


def ordered(df, *columns):
    return sorted((tuple(r) for r in (df.select(*columns) if columns else df).collect()), key=key)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="session")
def documents(spark):
    return spark.createDataFrame(messy_rows(), "doc_id long, text string, lang string, source string, n_chars long")


@pytest.fixture(scope="session")
def clashing(documents):
    return documents.withColumns({name: F.lit("x") for name in CLASHING})


@pytest.fixture(scope="session")
def empty(documents):
    return documents.limit(0)
