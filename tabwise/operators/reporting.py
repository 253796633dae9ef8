"""Cleaning report and dataset summary as small tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tabwise.operators.cleaning import Audit
from tabwise.operators.frames import local_frame


def cleaning_report(spark: SparkSession, audit: Audit) -> dict[str, DataFrame]:
    """Tables ``metrics``, ``conversions``, ``imputation`` and ``actions``."""
    a = audit
    before_after = [
        ("Total Rows", a.original_rows, a.cleaned_rows),
        ("Total Columns", a.original_columns, a.cleaned_columns),
        ("Duplicate Rows", a.duplicates_removed, 0),
        ("Missing / Null Values", a.missing_before, a.missing_after),
    ]
    metrics = [(i, m, x, y, y - x) for i, (m, x, y) in enumerate(before_after, start=1)]
    conversions = [
        ("Numeric Conversions", a.to_numeric),
        ("Datetime Conversions", a.to_datetime),
        ("Percentage Conversions", a.percentages),
        ("Currency Conversions", [f"{c} ({s})" for c, s in a.currencies.items()]),
        ("Preserved ID Columns", a.identifiers),
    ]
    imputed = a.imputed or {"All Columns": "No missing values required imputation"}
    actions = a.actions or [
        "Dataset was already pristine. No destructive modifications applied."
    ]
    return {
        "metrics": local_frame(
            spark,
            metrics,
            "position int, metric string, value_before bigint, value_after bigint, "
            "net_change bigint",
        ),
        "conversions": local_frame(
            spark,
            [(i, k, ", ".join(c) or "None") for i, (k, c) in enumerate(conversions, start=1)],
            "position int, category string, details string",
        ),
        "imputation": local_frame(
            spark,
            [(i, c, m) for i, (c, m) in enumerate(imputed.items(), start=1)],
            "position int, column_name string, method string",
        ),
        "actions": local_frame(
            spark, list(enumerate(actions, start=1)), "position int, action string"
        ),
    }


def report_lines(spark: SparkSession, audit: Audit) -> DataFrame:
    """The four report tables as one long table ``(section, position, item, detail…)``."""
    parts = cleaning_report(spark, audit)
    lines = [
        ("metrics", r["position"], r["metric"], str(r["value_before"]), str(r["value_after"]),
         str(r["net_change"]))
        for r in parts["metrics"].collect()
    ]
    for name in ("conversions", "imputation", "actions"):
        for row in parts[name].collect():
            position, item, detail = (*row, None)[:3]
            lines.append((name, position, item, detail, None, None))
    return local_frame(
        spark,
        lines,
        "section string, position int, item string, detail string, value_after string, "
        "net_change string",
    )


def dataset_summary(spark: SparkSession, audit: Audit) -> DataFrame:
    """One row: size of the cleaned table, duplicates removed, missing cells that were filled."""
    filled = max(0, audit.missing_before - audit.missing_after)
    return local_frame(
        spark,
        [(audit.cleaned_rows, audit.cleaned_columns, audit.duplicates_removed, filled)],
        "total_rows bigint, total_columns int, duplicate_rows bigint, missing_values_cleaned bigint",
    )
