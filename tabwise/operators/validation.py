"""Structural checks of a table: shape, missing cells, duplicates, constants, identifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tabwise.functions.text import grouping_key
from tabwise.operators.frames import (
    as_double, column, is_numeric, kinds, local_frame, tuned,
)
from tabwise.operators.frequency import distinct_counts
from tabwise.operators.profile import profile
from tabwise.plans import vocabulary as v
from tabwise.plans.measures import TableProfile

_COLUMN_SCHEMA = (
    "column_name string, position int, data_type string, null_count bigint, fully_empty boolean, "
    "constant boolean, distinct_count bigint, potential_id boolean, high_cardinality boolean"
)


def distinct_rows(df: DataFrame) -> int:
    """Number of different rows (NULL equals NULL). Long texts take part as digests, so that the
    shuffle does not carry them; tasks drop their own repeats first."""
    compact = [_comparable(df, c, k) for c, k in kinds(df).items()]
    with tuned(df):
        return df.select(*compact).distinct().count() if compact else 0


def _comparable(df: DataFrame, name: str, kind: str) -> Column:
    if kind == "text":
        return grouping_key(column(name)).alias(name)
    if kind == "double":
        return as_double(df, name).alias(name)
    return column(name)


def table_summary(df: DataFrame, measured: TableProfile | None = None) -> DataFrame:
    """One row: rows, columns, missing cells in all, duplicate rows beyond the first."""
    measured = measured or profile(df, columns=[])
    rows = measured.rows
    duplicates = rows - distinct_rows(df) if rows else 0
    return local_frame(
        df.sparkSession,
        [(rows, len(df.columns), sum(measured.nulls.values()), duplicates)],
        "total_rows bigint, total_columns int, missing_values_total bigint, duplicate_rows bigint",
    )


def validate(df: DataFrame, measured: TableProfile | None = None) -> DataFrame:
    """One row per column. ``distinct_count`` is filled for text columns, where rules need it.

    A numeric column is constant when its minimum is its maximum, so only text is counted.
    """
    by_kind = kinds(df)
    if measured is None or not set(by_kind) <= set(measured.nulls):
        measured = profile(df)
    n = measured.rows
    distinct = distinct_counts(df, [c for c, k in by_kind.items() if k == "text"]) if n else {}
    ordered = [c for c, k in by_kind.items() if k == "datetime"]
    same = _single_valued(df, ordered) if n else {}
    types = dict(df.dtypes)
    rows = []
    for i, (name, kind) in enumerate(by_kind.items()):
        nulls = measured.nulls[name] if n else 0
        values = distinct.get(name)
        if is_numeric(kind):
            single = name not in measured.numeric or (
                measured.numeric[name].low == measured.numeric[name].high
            )
        elif kind == "text":
            single = (values or 0) <= 1
        else:
            single = same.get(name, nulls == n)
        constant = n > 0 and (nulls == n or (nulls == 0 and single))
        id_name = v.matches(v.VALIDATION_IDENTIFIER, name.strip().lower())
        unique_text = n > 5 and values == n
        many = values is not None and values > 5 and (values > 50 or (n > 10 and values / n > 0.5))
        rows.append(
            (
                name, i, types[name], nulls, nulls == n, constant, values,
                n > 0 and (id_name or unique_text), many and not id_name,
            )
        )
    return local_frame(df.sparkSession, rows, _COLUMN_SCHEMA)


def _single_valued(df: DataFrame, columns: list[str]) -> dict[str, bool]:
    if not columns:
        return {}
    same = [
        F.min(column(c)).eqNullSafe(F.max(column(c))).alias(f"same{i}")
        for i, c in enumerate(columns)
    ]
    row = df.agg(*same).first()
    return {c: row[f"same{i}"] for i, c in enumerate(columns)}
