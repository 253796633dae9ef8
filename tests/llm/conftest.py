"""Small inputs with the hazards that every operator must take: nulls, empty and long texts, ties, clashes."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import types as T

SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
    T.StructField("size", T.StringType()), T.StructField("n_words", T.StringType()), T.StructField("spans", T.StringType()),
])


@pytest.fixture(scope="session")
def odd_rows() -> list[tuple]:
    rng = random.Random(4)
    words = ["the", "of", "und", "le", "señal", "über", "table", "corn", "x", "river", "stone", "7", "a."]

    def text(n: int) -> str:
        return " ".join(rng.choice(words) + rng.choice(["", "", "", ".", ",", "\n"]) for _ in range(n))

    shared = text(90)
    rows = [(i, text(rng.randint(0, 60)), rng.choice(["en", "de", None]), rng.choice(["a", "b", None]), 1) for i in range(40)]
    rows += [(50, None, "en", "a", 0), (51, "", None, None, 0), (52, " \n\t", "de", "b", 3), (53, "!!! ###", "de", "b", 7)]
    rows += [(60, shared, "en", "a", 1), (61, shared, "en", "a", 1), (62, shared + " end", "en", "b", 1), (63, text(5) + shared + text(5), "en", "b", 1)]
    rows += [(70, text(3000), "en", "a", 1), (71, "z" * 5000, "en", "c", 1)]
    rows += [rows[3], rows[3], (None, "a lonely text of some words without a number", "en", None, 1), (None, None, None, None, None)]
    return [(*r, "clash", None, "clash") for r in rows]


@pytest.fixture()
def odd(spark, odd_rows):
    return spark.createDataFrame(odd_rows, SCHEMA)


@pytest.fixture()
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
