"""One aggregate over the whole table that validation, statistics, key figures and charts share."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, functions as F

from tabwise.operators.frames import as_double, column, is_numeric, kinds, long_form
from tabwise.plans.measures import NumericStats, TableProfile

# Stands for the table itself among the columns that are counted.
_ROWS = ""


def profile(df: DataFrame, columns: list[str] | None = None, nulls: bool = True) -> TableProfile:
    """Null counts of every column and moments of the numeric ones (all, or ``columns``): one job.

    Cells are aggregated in long form, grouped by column: generated code and buffers do not grow
    with the width of the table, a task sends one row per column, and columns are merged on
    several executors. With ``nulls=False`` the scan reads the measured columns only.
    """
    numeric = [c for c, k in kinds(df).items() if is_numeric(k)]
    measured = numeric if columns is None else [c for c in numeric if c in set(columns)]
    cells = {c: as_double(df, c) for c in measured}
    for c in df.columns if nulls else []:
        if c not in cells:
            present = as_double(df, c) if c in numeric else column(c)
            cells[c] = F.when(present.isNotNull(), F.lit(0.0))
    cells[_ROWS] = F.lit(0.0)

    wanted = [F.count("value").alias("count")]
    if measured:
        # Whole parts add up without rounding (to 2^53), and the rest is small: a plain sum of doubles
        # depends on the order of the rows and is off by cents from some ten million rows on.
        whole, value = F.rint("value"), F.col("value")
        wanted += [
            F.sum(whole).alias("whole"),
            F.sum(F.when(whole == value, 0.0).otherwise(value - whole)).alias("rest"),
            F.stddev_samp("value").alias("std"),
            F.min("value").alias("low"),
            F.max("value").alias("high"),
            F.skewness("value").alias("skewness"),
        ]
    long = long_form(df, cells, numbered=True)
    names = list(cells)
    found = {
        names[r["column_number"]]: r for r in long.groupBy("column_number").agg(*wanted).collect()
    }
    rows = found[_ROWS]["count"] if _ROWS in found else 0
    stats = {}
    for c in measured:
        if c in found:
            r = found[c]
            total = r["whole"] + r["rest"]
            stats[c] = NumericStats(
                count=r["count"],
                total=total,
                mean=total / r["count"],
                std=r["std"] or 0.0,
                low=r["low"],
                high=r["high"],
                skewness=_sample_skewness(r["skewness"], r["count"]),
            )
    missing = {
        c: rows - (found[c]["count"] if c in found else 0) for c in df.columns if c in cells
    }
    return TableProfile(rows, missing, stats)


def _sample_skewness(population: float | None, n: int) -> float:
    """Bias-corrected skewness; 0 for fewer than three values or no variance."""
    if n <= 2 or population is None or math.isnan(population):
        return 0.0
    return population * math.sqrt(n * (n - 1)) / (n - 2)
