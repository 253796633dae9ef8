"""The whole analysis of one table: validate, find roles, clean, describe, choose, report."""

from __future__ import annotations

import time
import warnings
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import TypeVar

from pyspark.sql import DataFrame, SparkSession

from tabwise.functions.text import collapse_spaces
from tabwise.operators import charts, eda, kpi, reporting, validation
from tabwise.operators.cleaning import (
    NUMBER_RATIO, Audit, cleaned_head, finish_cleaning, normalise_names, plan_cleaning,
)
from tabwise.operators.frames import at_once, local_frame, nan_to_null, tuned, written
from tabwise.operators.profile import profile
from tabwise.operators.roles import infer_roles, roles_frame
from tabwise.plans.charts import ChartSpec
from tabwise.plans.measures import TableProfile
from tabwise.plans.roles import ColumnRole
from tabwise.sources.audit import Limits, audit_files
from tabwise.sources.bundle import write_report
from tabwise.sources.load import load_table, table_format
from tabwise.sources.ranking import rank_tables

Result = TypeVar("Result")

_DASHBOARD_SCHEMA = (
    "section string, position int, label string, value double, text string, role string, "
    "number_format string"
)


@dataclass
class Report:
    """Everything one analysis found. Tables are DataFrames; ``raw`` has normalised names."""

    raw: DataFrame
    cleaned: DataFrame
    audit: Audit
    order_by: str | None
    raw_roles: list[ColumnRole]
    roles: list[ColumnRole]
    summary: DataFrame | None
    validation: DataFrame | None
    eda: dict[str, DataFrame]
    kpis: DataFrame
    charts: list[ChartSpec]
    chart_tables: DataFrame
    warnings: list[str] = field(default_factory=list)
    seconds: float = 0.0

    @property
    def spark(self) -> SparkSession:
        return self.raw.sparkSession

    def roles_table(self) -> DataFrame:
        return roles_frame(self.cleaned, self.roles)

    def cleaning_lines(self) -> DataFrame:
        return reporting.report_lines(self.spark, self.audit)

    def dataset_summary(self) -> DataFrame:
        return reporting.dataset_summary(self.spark, self.audit)

    def dashboard(self, titles: dict[str, str] | None = None) -> DataFrame:
        """Key figures, dataset summary, charts and table titles as one long table."""
        rows = [
            ("kpi", k["rank"], k["label"], k["value"], k["formatted_value"], k["role"],
             k["number_format"])
            for k in self.kpis.orderBy("rank").collect()
        ]
        labels = ["Total Rows", "Total Columns", "Duplicate Rows Removed", "Missing Values Cleaned"]
        for i, (label, n) in enumerate(zip(labels, self.dataset_summary().first()), start=1):
            rows.append(("summary", i, label, float(n), f"{n:,}", "count", "#,##0"))
        for i, spec in enumerate(self.charts, start=1):
            rows.append(("chart", i, spec.title, None, spec.description, spec.chart_type, None))
        for i, (table, title) in enumerate((titles or {}).items(), start=1):
            rows.append(("table", i, table, None, title, None, None))
        return local_frame(self.spark, rows, _DASHBOARD_SCHEMA)


def analyze(
    spark: SparkSession,
    df: DataFrame,
    order_by: str | None = None,
    out: str | None = None,
    min_parse_ratio: float = NUMBER_RATIO,
    fmt: str = "parquet",
    scan: DataFrame | None = None,
    role_sample: int | None = None,
) -> Report:
    """Analyse a table and, with ``out``, write the report bundle.

    The number of Spark jobs does not depend on the number of rows or columns (but for very wide
    correlation matrices). ``order_by`` names the column whose order defines "first rows"; without
    it that is scan order. ``scan`` may hold the same rows in a form that is cheaper to read in
    full. Roles are decided by all values of a column; ``role_sample`` limits that to the first ones.
    A failing optional stage is noted in ``warnings`` and left out.
    """
    notes: list[str] = []
    started = time.perf_counter()

    def attempt(stage: str, run: Callable[[], Result], otherwise: Result) -> Result:
        try:
            return run()
        except Exception as problem:  # noqa: BLE001 - the stage is optional, the reason is kept
            notes.append(f"{stage}: {type(problem).__name__}: {problem}")
            warnings.warn(notes[-1], stacklevel=3)
            return otherwise

    raw = nan_to_null(normalise_names(df))
    whole = raw if scan is None else nan_to_null(normalise_names(scan))
    order_by = collapse_spaces(order_by) if order_by else None

    with tuned(whole):
        report = _run(raw, whole, order_by, min_parse_ratio, role_sample, attempt)
        report.warnings = notes
        if out is not None:
            write_report(report, out, fmt)
    report.seconds = time.perf_counter() - started
    return report


def _run(
    raw: DataFrame,
    whole: DataFrame,
    order_by: str | None,
    min_parse_ratio: float,
    role_sample: int | None,
    attempt: Callable,
) -> Report:
    spark = raw.sparkSession

    def checks() -> tuple[DataFrame | None, DataFrame | None]:
        first = profile(whole)
        return tuple(
            at_once(
                spark,
                lambda: attempt("summary", lambda: validation.table_summary(whole, first), None),
                lambda: attempt("validation", lambda: validation.validate(whole, first), None),
            )
        )

    def cleaning_chain() -> tuple:
        first = raw if role_sample else whole
        before = attempt("roles", lambda: infer_roles(first, role_sample, order_by), [])
        cleaning = plan_cleaning(raw, before, order_by, min_parse_ratio, whole)
        table, found = finish_cleaning(whole, cleaning)

        def cleaned_roles() -> list[ColumnRole]:
            if role_sample is None:
                return infer_roles(table, None)
            return infer_roles(cleaned_head(raw, cleaning, role_sample, order_by), role_sample)

        after = attempt("roles of the cleaned table", cleaned_roles, before)
        return before, after, table, found, cleaning.audit

    (summary, checked), (raw_roles, roles, cleaned, measured, audit) = at_once(
        spark, lambda: attempt("checks", checks, (None, None)), cleaning_chain
    )
    symbols = audit.currencies
    sections, figures, (specs, tables) = at_once(
        spark,
        lambda: attempt("statistics", lambda: describe(cleaned, roles, measured), {}),
        lambda: attempt(
            "key figures",
            lambda: kpi.select_kpis(cleaned, roles, measured=measured, symbols=symbols),
            kpi.select_kpis(cleaned, [], measured=measured),
        ),
        lambda: attempt("charts", lambda: _charts(cleaned, roles, measured), ([], None)),
    )
    return Report(
        raw=raw,
        cleaned=cleaned,
        audit=audit,
        order_by=order_by,
        raw_roles=raw_roles,
        roles=roles,
        summary=summary,
        validation=checked,
        eda=sections,
        kpis=figures,
        charts=specs,
        chart_tables=tables or charts.chart_tables(cleaned, []),
    )


def _charts(
    df: DataFrame, roles: list[ColumnRole], measured: TableProfile
) -> tuple[list[ChartSpec], DataFrame]:
    specs = charts.plan_charts(df, roles, measured=measured)
    return specs, charts.chart_tables(df, specs, measured=measured)


def describe(
    df: DataFrame, roles: list[ColumnRole], measured: TableProfile | None = None
) -> dict[str, DataFrame]:
    """All exploratory sections of a table, sharing one profile."""
    measured = measured or profile(df)
    statistics, categories, pairs, bins = at_once(
        df.sparkSession,
        lambda: eda.describe_numeric(df, roles, measured),
        lambda: eda.top_categories(df, measured.rows),
        lambda: eda.correlations(df, roles, measured),
        lambda: eda.histograms(df, roles, measured),
    )
    shape = [(measured.rows, len(df.columns))]
    return {
        "shape": local_frame(df.sparkSession, shape, "rows bigint, columns int"),
        "missing_summary": eda.missing_summary(df, measured),
        "numeric_statistics": statistics,
        "categorical_summaries": categories,
        "correlations": pairs,
        "distributions": bins,
    }


def analyze_path(
    spark: SparkSession,
    path: str,
    out: str | None = None,
    fmt: str | None = None,
    limits: Limits | None = None,
    csv: dict[str, object] | None = None,
    **options,
) -> Report:
    """Load a file or directory and analyse it. With ``limits`` the files are checked first;
    ``csv`` holds options of ``load_csv`` (``sep``, ``encoding``, ``multi_line``).

    Text formats are parsed once and kept as a columnar copy in the shared scratch folder, which
    the passes over the whole table read.
    """
    if limits is not None:
        refused = audit_files(spark, path, limits).filter("NOT valid").take(1)
        if refused:
            raise ValueError(refused[0]["error"])
    table, name = load_table(spark, path, fmt, **(csv or {}))
    scan = written(table) if table_format(path, fmt) in ("csv", "json") else None
    return analyze(spark, table, out=out, scan=scan, **options)


def analyze_tables(
    spark: SparkSession, tables: dict[str, DataFrame], **options
) -> tuple[str, Report]:
    """Choose the table that holds the data, like a sheet of a workbook, and analyse it."""
    best = rank_tables(tables).filter("selected").first()["table_name"]
    return best, analyze(spark, tables[best], **options)
