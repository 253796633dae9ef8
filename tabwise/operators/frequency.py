"""Exact value counts of text columns in long form: one pre-aggregated shuffle for all columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row, functions as F

from tabwise.functions.text import LONG_TEXT, grouping_key
from tabwise.operators.frames import column, local_frame, long_form, tuned

# Digests of 65 characters that may be broadcast; more of them are joined by a shuffle.
FEW_WINNERS = 10_000


def value_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """``(column_name, value, n)``; a long text is represented by its digest. Tasks count before
    the shuffle, so a hot value sends one row per task."""
    cells = {c: grouping_key(_text(c)) for c in columns}
    counted = (
        long_form(df, cells, numbered=True)
        .groupBy("column_number", "value")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    name = F.get(F.array(*[F.lit(c) for c in columns]), F.col("column_number"))
    return counted.select(name.alias("column_name"), "value", "n")


def distinct_counts(df: DataFrame, columns: list[str]) -> dict[str, int]:
    """Exact number of distinct non-null values of each column."""
    if not columns:
        return {}
    with tuned(df):
        counted = value_counts(df, columns).groupBy("column_name")
        rows = counted.agg(F.count(F.lit(1)).alias("n")).collect()
    return dict.fromkeys(columns, 0) | {r["column_name"]: r["n"] for r in rows}


def smallest_modes(df: DataFrame, columns: list[str]) -> dict[str, str]:
    """The most frequent value of each column, the smallest of them on a tie.

    Counted by digest, so that no long text is shuffled for its count. Per column one row comes back:
    the greatest count, the smallest short value with it and how many long ones have it.
    """
    if not columns:
        return {}
    with tuned(df):
        counted = value_counts(df, columns)
        long = F.length("value") > LONG_TEXT
        ties = counted.groupBy("column_name", "n").agg(
            F.min(F.when(~long, F.col("value"))).alias("value"),
            F.count_if(long).alias("longs"),
        )
        best = F.max_by(F.struct("n", "value", "longs"), "n").alias("best")
        rows = ties.groupBy("column_name").agg(best).select("column_name", "best.*").collect()
        found = {r["column_name"]: r["value"] for r in rows}
        for c, text in _long_winners(df, counted, {r["column_name"]: r for r in rows if r["longs"]}):
            found[c] = text if found[c] is None else min(found[c], text)
    return found


def _long_winners(
    df: DataFrame, counted: DataFrame, tied: dict[str, Row]
) -> list[tuple[str, str]]:
    """The smallest of the long texts of each column that have the column's greatest count."""
    single = [c for c, r in tied.items() if r["n"] == 1]
    shared = {c: r["n"] for c, r in tied.items() if r["n"] > 1}
    found: list[tuple[str, str]] = []
    if single:  # every value is a winner, so the smallest is that of the column
        least = [
            F.min(F.when(F.length(_text(c)) > LONG_TEXT, _text(c))).alias(f"c{i}")
            for i, c in enumerate(single)
        ]
        found += zip(single, df.agg(*least).first(), strict=True)
    if shared:
        greatest = local_frame(df.sparkSession, list(shared.items()), "column_name string, n bigint")
        wanted = counted.join(F.broadcast(greatest), ["column_name", "n"]).select(
            "column_name", F.col("value").alias("digest")
        )
        if sum(tied[c]["longs"] for c in shared) <= FEW_WINNERS:
            wanted = F.broadcast(wanted)
        texts = long_form(df, {c: F.when(F.length(_text(c)) > LONG_TEXT, _text(c)) for c in shared})
        winners = texts.withColumn("digest", grouping_key(F.col("value"))).join(
            wanted, ["column_name", "digest"], "left_semi"
        )
        least = winners.groupBy("column_name").agg(F.min("value").alias("text"))
        found += [(r["column_name"], r["text"]) for r in least.collect()]
    return found


def _text(name: str) -> Column:
    return column(name).cast("string")
