"""tabwise: automated analysis of one table, written as Spark DataFrame operators."""

from tabwise.analysis import Report, analyze, analyze_path, analyze_tables, describe
from tabwise.functions.display import format_kpi, number_format
from tabwise.operators.charts import ChartLimits, chart_data, chart_tables, select_charts
from tabwise.operators.cleaning import Audit, clean
from tabwise.operators.eda import (
    correlations, describe_numeric, histograms, missing_summary, top_categories,
)
from tabwise.operators.kpi import kpi_candidates, select_kpis
from tabwise.operators.reporting import cleaning_report, dataset_summary
from tabwise.operators.roles import detect_roles
from tabwise.operators.validation import table_summary, validate
from tabwise.sources.audit import Limits, audit_files
from tabwise.sources.bundle import check_report, write_report
from tabwise.sources.load import infer_types, load_csv, load_table
from tabwise.sources.ranking import rank_tables

__all__ = [
    "Audit", "ChartLimits", "Limits", "Report", "analyze", "analyze_path", "analyze_tables", "audit_files", "chart_data", "chart_tables",
    "check_report", "clean", "cleaning_report", "correlations", "dataset_summary", "describe",
    "describe_numeric", "detect_roles", "format_kpi", "histograms", "infer_types",
    "kpi_candidates", "load_csv", "load_table", "missing_summary", "number_format",
    "rank_tables", "select_charts", "select_kpis", "table_summary", "top_categories", "validate",
    "write_report",
]
