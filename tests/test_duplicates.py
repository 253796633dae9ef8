"""Distinct rows by a bitmap of repeated hashes, against a plain comparison of rows."""

import pytest
from pyspark.sql import functions as F

import tabwise as tw
from tabwise.operators.duplicates import distinct_table

LONG = "a long text " * 20


def _rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.mark.parametrize(("most_rows", "bits"), [(8192, 32), (1, 1), (2, 400)])
def test_equals_a_comparison_of_rows(spark, most_rows, bits):
    df = spark.range(6000).select(
        F.concat(F.lit(LONG), (F.col("id") % 4500).cast("string")).alias("text"),
        F.when(F.col("id") % 3 > 0, F.col("id") % 7).alias("a.b"),
        F.when(F.col("id") % 2 > 0, F.lit(LONG)).alias("x `y"),
    )
    got = distinct_table(df, most_rows, bits)
    assert got.columns == df.columns
    assert _rows(got) == _rows(df.dropDuplicates())


def test_gaps_zeros_and_hot_rows(spark):
    nan, same = float("nan"), [(LONG, None, 1.0, [1])] * 300
    rows = [(None, LONG, 1.0, [1]), (LONG, None, -0.0, [1]), (LONG, None, 0.0, [1]), (LONG, None, nan, None)]
    df = spark.createDataFrame([*same, *rows, *rows[:1], rows[3], (None, None, None, None)] * 2,
                               "a string, b string, c double, d array<int>")
    assert distinct_table(df).count() == 5
    assert distinct_table(df.select("d")).count() == 2


def test_nothing_repeats_and_nothing_there(spark):
    df = spark.range(50).select(F.concat(F.lit(LONG), F.col("id").cast("string")).alias("t"))
    assert _rows(distinct_table(df)) == _rows(df)
    assert distinct_table(df.filter("false")).count() == 0
    assert distinct_table(df.select()).count() == df.select().dropDuplicates().count()


def test_texts_are_not_shuffled_with_the_main_table(spark):
    """The rows without an equal one pass no exchange that carries a text."""
    df = spark.range(4000).select(F.concat(F.lit(LONG), (F.col("id") % 3990).cast("string")).alias("t"))
    shuffled = distinct_table(df)._jdf.queryExecution().executedPlan().toString()
    alone = shuffled.split("Union", 1)[1].split("HashAggregate", 1)[0]
    assert "Exchange hashpartitioning" not in alone and "BroadcastHashJoin" in alone


def test_cleaning_of_long_texts(spark):
    rows = [(i % 5, f"{LONG}{i % 5}") for i in range(20)] + [(9, "short"), (9, "short ")]
    cleaned, audit = tw.clean(spark.createDataFrame(rows, "n int, note string"))
    assert (cleaned.count(), audit.duplicates_removed) == (6, 16)
