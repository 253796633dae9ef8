"""The report bundle: five tables written below one folder, and the check of a written bundle."""

from __future__ import annotations

from typing import TYPE_CHECKING

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from tabwise.functions.display import export_safe
from tabwise.operators.frames import column, kinds, leading_rows, local_frame

if TYPE_CHECKING:
    from tabwise.analysis import Report

# The tables of a bundle.
TABLES = ["dashboard", "cleaned_data", "cleaning_report", "original_data", "chart_data"]


def output_values(df: DataFrame, nested_as_json: bool = False) -> DataFrame:
    """Cells as an output table stores them: no NaN, no zoned timestamps."""
    by_kind, types = kinds(df), dict(df.dtypes)
    return df.select(
        *[
            (
                F.to_json(column(c))
                if nested_as_json and by_kind[c] == "nested"
                else export_safe(column(c), types[c])
            ).alias(c)
            for c in df.columns
        ]
    )


def original_preview(
    df: DataFrame, rows: int | None = None, order_by: str | None = None, max_rows: int | None = None
) -> tuple[DataFrame, str]:
    """The whole table, unless ``max_rows`` asks for its first rows, with a title that says which."""
    rows = df.count() if rows is None else rows
    if max_rows is None or rows <= max_rows:
        return df, f"Original Data — {rows:,} rows"
    title = f"Original Data Preview — first {max_rows:,} of {rows:,} rows"
    return leading_rows(df, max_rows, order_by), title


def cleaned_export(
    df: DataFrame, rows: int | None = None, max_rows: int | None = None, order_by: str | None = None
) -> tuple[DataFrame, str]:
    """The cleaned table, whole unless ``max_rows`` asks for its first rows, with a title."""
    rows = df.count() if rows is None else rows
    if max_rows is None or rows <= max_rows:
        return df, f"Cleaned Data — {rows:,} rows"
    title = f"Cleaned Data — first {max_rows:,} of {rows:,} rows"
    return leading_rows(df, max_rows, order_by), title


def write_report(
    report: Report, path: str, fmt: str = "parquet", max_cleaned_rows: int | None = None,
    max_original_rows: int | None = None,
) -> str:
    """Write the five tables of a report, one folder each; limits are options."""
    original, original_title = original_preview(
        report.raw, report.audit.original_rows, report.order_by, max_original_rows
    )
    cleaned, cleaned_title = cleaned_export(
        report.cleaned, report.audit.cleaned_rows, max_cleaned_rows
    )
    titles = {"original_data": original_title, "cleaned_data": cleaned_title}
    tables = {
        "dashboard": report.dashboard(titles),
        "cleaned_data": cleaned,
        "cleaning_report": report.cleaning_lines(),
        "original_data": original,
        "chart_data": report.chart_tables,
    }
    for name in TABLES:
        table = output_values(tables[name], nested_as_json=fmt == "csv")
        writer = table.write.mode("overwrite").format(fmt)
        if fmt == "csv":
            writer = writer.option("header", True)
        if name == "chart_data":
            writer = writer.partitionBy("chart_id")
        writer.save(f"{path}/{name}")
    return path


def check_report(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """One row: whether all tables are there and the two data tables have rows, with counts."""
    counts: dict[str, int] = {}
    for name in TABLES:
        try:
            reader = spark.read.format(fmt)
            if fmt == "csv":
                reader = reader.option("header", True)
            counts[name] = reader.load(f"{path}/{name}").count()
        except AnalysisException as problem:
            absent = ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA")
            if not any(code in str(problem) for code in absent):
                raise
    missing = [t for t in TABLES if t not in counts]
    error = None
    if len(missing) == len(TABLES):
        error = f"Output does not exist: {path}"
    elif missing:
        error = f"Missing required tables: {', '.join(missing)}"
    else:
        for name, words in (("original_data", "Original"), ("cleaned_data", "Cleaned")):
            if error is None and not counts[name]:
                error = f"{words} Data table has no data rows."
    row = (
        error is None, error, ", ".join(counts),
        counts.get("original_data", 0), counts.get("cleaned_data", 0),
    )
    return local_frame(
        spark,
        [row],
        "valid boolean, error string, tables string, original_rows bigint, cleaned_rows bigint",
    )
