"""Registered queries: every operator over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

import tabwise as tw
from catalog.inputs import TABLES, messy_orders, table, wide_cells
from tabwise.functions import parse
from tabwise.operators import charts, cleaning, eda, reporting, roles as role_ops
from tabwise.operators.charts import ALL_ROWS, ChartLimits
from tabwise.operators.duplicates import distinct_table
from tabwise.operators.frames import kinds, local_frame, scratch_path, written
from tabwise.operators.frequency import distinct_counts
from tabwise.operators.samples import first_values
from tabwise.plans.charts import ChartSpec
from tabwise.plans.roles import ColumnRole
from tabwise.sources.bundle import cleaned_export, original_preview, output_values
from tabwise.sources.load import load_csv as load_delimited

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def over_tables(name: str, names: list[str], run: Callable[[DataFrame], DataFrame]) -> None:
    """Register one query per table."""
    for t in names:
        QUERIES[f"{name}_{t}"] = lambda spark, folder, t=t: run(table(spark, folder, t))


def rounded(df: DataFrame, **places: int) -> DataFrame:
    return df.withColumns({c: F.round(c, n) for c, n in places.items()})


def spec(kind: str, x: str, y: str | None, how: str) -> ChartSpec:
    return ChartSpec("chart_1", kind, "", x, y, how, "")


# --- sources and sinks -----------------------------------------------------------------------


def _as_csv(df: DataFrame, path: str) -> None:
    writer = df.write.option("header", True)
    writer.options(ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)


@query
def load_csv(spark: SparkSession, folder: str) -> DataFrame:
    path = scratch_path(spark, "messy.csv")
    _as_csv(messy_orders(spark, folder), path)
    loaded, _ = tw.load_table(spark, path)
    return cleaning.normalise_names(loaded)


@query
def load_csv_line_breaks(spark: SparkSession, folder: str) -> DataFrame:
    """Texts with line breaks and quotes in quoted cells."""
    path = scratch_path(spark, "texts.csv")
    docs = table(spark, folder, "documents").select("doc_id", "text", "lang", "source")
    options = {"header": True, "quoteAll": True, "escape": '"', "emptyValue": ""}
    docs.write.options(**options, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)
    loaded, _ = tw.load_table(spark, path)
    return loaded


@query
def load_csv_mixed(spark: SparkSession, folder: str) -> DataFrame:
    """Files of three delimiters, two encodings and two column orders."""
    root = scratch_path(spark, "mixed")
    place = F.concat(F.lit("Café "), F.col("o_orderpriority")).alias("place")
    orders = table(spark, folder, "orders").select("o_orderkey", place, "o_totalprice")
    for i, (sep, encoding) in enumerate([(",", "UTF-8"), (";", "ISO-8859-1"), ("\t", "UTF-8")]):
        part = orders.filter(F.col("o_orderkey") % 3 == i)
        part = part.select(*reversed(part.columns)) if i == 2 else part
        part.write.options(header=True, sep=sep, encoding=encoding).csv(f"{root}/{i}")
    return load_delimited(spark, [f"{root}/{i}" for i in range(3)])


@query
def infer_types(spark: SparkSession, folder: str) -> DataFrame:
    orders = table(spark, folder, "orders")
    return tw.infer_types(orders.select(*[F.col(c).cast("string").alias(c) for c in orders.columns]))


@query
def audit_files(spark: SparkSession, folder: str) -> DataFrame:
    names = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"]
    root = scratch_path(spark, "files")
    for name in names:
        _as_csv(table(spark, folder, name), f"{root}/{name}")
    files = tw.audit_files(spark, root).filter("path LIKE '%.csv'")
    return files.groupBy(F.regexp_extract("path", "/files/([^/]+)/", 1).alias("table_name")).agg(
        F.min("valid").alias("valid"),
        F.sum("rows").alias("rows"),
        F.max("columns").alias("columns"),
        F.max("encoding").alias("encoding"),
        F.max("delimiter").alias("delimiter"),
    )


@query
def rank_tables(spark: SparkSession, folder: str) -> DataFrame:
    ranked = tw.rank_tables({t: table(spark, folder, t) for t in TABLES})
    return rounded(ranked, score=3)


@query
def export_cleaned(spark: SparkSession, folder: str) -> DataFrame:
    rows, title = cleaned_export(table(spark, folder, "orders"))
    return rows.withColumn("title", F.lit(title))


@query
def preview_original(spark: SparkSession, folder: str) -> DataFrame:
    lines = table(spark, folder, "lineitem")
    parts = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    keyed = lines.withColumn("row_key", F.md5(F.concat_ws("|", *parts)))
    rows, title = original_preview(keyed, order_by="row_key")
    return rows.withColumn("title", F.lit(title))


@query
def output_cells(spark: SparkSession, folder: str) -> DataFrame:
    events = table(spark, folder, "events")
    gap = F.when(F.col("event_type") == "error", F.lit(float("nan"))).otherwise(F.col("value"))
    zoned = F.col("ts").cast("timestamp")
    return output_values(events.select("event_id", gap.alias("value"), zoned.alias("ts"), "event_type"))


@query
def report_bundle(spark: SparkSession, folder: str) -> DataFrame:
    path = scratch_path(spark, "report")
    tw.analyze(spark, messy_orders(spark, folder), out=path)
    return tw.check_report(spark, path)


# --- cleaning --------------------------------------------------------------------------------


def _marked(spark: SparkSession, folder: str) -> DataFrame:
    named = cleaning.normalise_names(messy_orders(spark, folder))
    return cleaning.missing_tokens_to_null(named)


@query
def clean_names(spark: SparkSession, folder: str) -> DataFrame:
    return cleaning.normalise_names(messy_orders(spark, folder))


@query
def clean_tokens(spark: SparkSession, folder: str) -> DataFrame:
    return _marked(spark, folder)


@query
def missing_before(spark: SparkSession, folder: str) -> DataFrame:
    counts = cleaning.count_missing(_marked(spark, folder))
    return local_frame(spark, list(counts.items()), "column_name string, null_count bigint")


@query
def keep_identifiers(spark: SparkSession, folder: str) -> DataFrame:
    events = table(spark, folder, "events")
    ids = cleaning.identifier_columns(events, role_ops.infer_roles(events))
    return cleaning.keep_identifiers(events, ids)


@query
def parse_percentages(spark: SparkSession, folder: str) -> DataFrame:
    marked = _marked(spark, folder).select("order_id", "share_pct")
    return rounded(cleaning.parse_percentages(marked, ["share_pct"]), share_pct=6)


@query
def rescale_percentages(spark: SparkSession, folder: str) -> DataFrame:
    lines = table(spark, folder, "lineitem")
    percent = lines.select("l_orderkey", (F.col("l_discount") * 100).alias("discount_pct"))
    audit = cleaning.plan_cleaning(percent)
    return rounded(audit.rows(percent), discount_pct=6)


@query
def parse_currencies(spark: SparkSession, folder: str) -> DataFrame:
    return cleaning.parse_currencies(_marked(spark, folder).select("order_id", "amount"), ["amount"])


@query
def parse_dates(spark: SparkSession, folder: str) -> DataFrame:
    """One date in seven spellings, chosen by the order's key."""
    orders = table(spark, folder, "orders")
    formats = [
        "yyyy-MM-dd HH:mm:ss", "yyyy/MM/dd", "yyyyMMdd", "M/d/yyyy", "d MMM yyyy", "MMMM d, yyyy",
    ]
    text: Column = F.date_format("o_orderdate", "yyyy-MM-dd")
    for i, f in enumerate(formats, start=1):
        text = F.when(F.col("o_orderkey") % 7 == i, F.date_format("o_orderdate", f)).otherwise(text)
    return orders.select("o_orderkey", parse.timestamp(text).alias("order_date"))


@query
def parse_datetimes(spark: SparkSession, folder: str) -> DataFrame:
    """Times of events with weekdays, clocks of 12 hours, zones and years of two digits."""
    events = table(spark, folder, "events").select("event_id", "ts")
    east = F.timestamp_add("MINUTE", F.lit(330), F.col("ts"))
    west = F.timestamp_add("MINUTE", F.lit(-480), F.col("ts"))
    texts = [
        F.date_format("ts", "EEE, d MMM yyyy HH:mm:ss 'GMT'"),
        F.date_format("ts", "MM/dd/yy h:mm:ss a"),
        F.date_format(east, "yyyy-MM-dd'T'HH:mm:ss'+05:30'"),
        F.date_format(west, "EEEE, MMMM d, yyyy h:mm:ss a '-0800'"),
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"),
        F.date_format("ts", "M-d-yy"),
        F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit(" o'clock")),
    ]
    text: Column = F.lit(None).cast("string")
    for i, t in enumerate(texts):
        text = F.when(F.col("event_id") % len(texts) == i, t).otherwise(text)
    return events.select("event_id", parse.timestamp(text).alias("event_time"))


@query
def parse_numbers(spark: SparkSession, folder: str) -> DataFrame:
    return cleaning.parse_numbers(_marked(spark, folder).select("order_id", "units"), ["units"])


@query
def imputation(spark: SparkSession, folder: str) -> DataFrame:
    audit = cleaning.plan_cleaning(messy_orders(spark, folder)).audit
    return reporting.cleaning_report(spark, audit)["imputation"]


@query
def clean_table(spark: SparkSession, folder: str) -> DataFrame:
    cleaned, _ = tw.clean(messy_orders(spark, folder))
    return rounded(cleaned, share_pct=6)


@query
def distinct_documents(spark: SparkSession, folder: str) -> DataFrame:
    return distinct_table(table(spark, folder, "documents").select("text", "lang", "source"))


@query
def cleaning_metrics(spark: SparkSession, folder: str) -> DataFrame:
    _, audit = tw.clean(messy_orders(spark, folder))
    return reporting.cleaning_report(spark, audit)["metrics"]


@query
def cleaning_conversions(spark: SparkSession, folder: str) -> DataFrame:
    audit = cleaning.plan_cleaning(messy_orders(spark, folder)).audit
    return reporting.cleaning_report(spark, audit)["conversions"]


@query
def cleaning_actions(spark: SparkSession, folder: str) -> DataFrame:
    _, audit = tw.clean(messy_orders(spark, folder))
    return reporting.cleaning_report(spark, audit)["actions"]


@query
def dataset_summary(spark: SparkSession, folder: str) -> DataFrame:
    _, audit = tw.clean(messy_orders(spark, folder))
    return tw.dataset_summary(spark, audit)


# --- roles -----------------------------------------------------------------------------------


@query
def first_values_orders(spark: SparkSession, folder: str) -> DataFrame:
    return first_values(table(spark, folder, "orders"), order_by="o_orderkey")


@query
def role_evidence(spark: SparkSession, folder: str) -> DataFrame:
    return role_ops.role_evidence(cleaning.normalise_names(messy_orders(spark, folder)))


@query
def roles_messy(spark: SparkSession, folder: str) -> DataFrame:
    return tw.detect_roles(cleaning.normalise_names(messy_orders(spark, folder)))


@query
def roles_cleaned(spark: SparkSession, folder: str) -> DataFrame:
    cleaned, _ = tw.clean(messy_orders(spark, folder))
    return tw.detect_roles(cleaned)


over_tables("roles", TABLES, tw.detect_roles)

# --- validation and statistics ---------------------------------------------------------------

over_tables("validate", ["customer", "orders", "lineitem", "documents", "events"], tw.validate)
over_tables("table_summary", ["orders", "lineitem", "documents", "pages"], tw.table_summary)


@query
def validate_messy(spark: SparkSession, folder: str) -> DataFrame:
    return tw.validate(_marked(spark, folder))


@query
def table_summary_messy(spark: SparkSession, folder: str) -> DataFrame:
    return tw.table_summary(_marked(spark, folder))


@query
def missing_summary(spark: SparkSession, folder: str) -> DataFrame:
    return tw.missing_summary(_marked(spark, folder))


def _with_gaps(spark: SparkSession, folder: str) -> DataFrame:
    """Line items with gaps in two columns that never lie in the same row."""
    lines = table(spark, folder, "lineitem")
    return lines.withColumns(
        {
            "l_tax": F.when(F.col("l_linenumber") != 3, F.col("l_tax")),
            "l_discount": F.when(F.col("l_linenumber") != 5, F.col("l_discount")),
        }
    )




def _described(df: DataFrame) -> DataFrame:
    return tw.describe_numeric(df, digits=6)


over_tables("describe", ["orders", "lineitem", "part", "events"], _described)
over_tables("top_categories", ["orders", "events", "documents", "conversations"], tw.top_categories)
over_tables("histograms", ["orders", "lineitem", "part", "labels"], tw.histograms)
over_tables("correlations", ["lineitem", "part"], tw.correlations)


@query
def correlations_with_gaps(spark: SparkSession, folder: str) -> DataFrame:
    return tw.correlations(_with_gaps(spark, folder))


@query
def correlations_wide(spark: SparkSession, folder: str) -> DataFrame:
    """A hundred derived measures, so thousands of pairs."""
    cells = [F.expr(cell).alias(name) for name, cell in wide_cells()]
    wide = table(spark, folder, "lineitem").repartition(spark.sparkContext.defaultParallelism).select(*cells)
    return tw.correlations(written(wide))


# --- key figures -----------------------------------------------------------------------------


def _candidates(df: DataFrame) -> DataFrame:
    return rounded(tw.kpi_candidates(df), value=2)


def _figures(df: DataFrame) -> DataFrame:
    return rounded(tw.select_kpis(df), value=2)


over_tables("kpi_candidates", ["lineitem", "orders"], _candidates)
over_tables("select_kpis", ["lineitem", "orders", "events", "part"], _figures)


@query
def select_kpis_cleaned(spark: SparkSession, folder: str) -> DataFrame:
    messy = cleaning.normalise_names(messy_orders(spark, folder))
    plan = cleaning.plan_cleaning(messy)
    cleaned, _ = cleaning.finish_cleaning(messy, plan)
    roles = role_ops.infer_roles(cleaned)
    return rounded(tw.select_kpis(cleaned, roles, symbols=plan.audit.currencies), value=2)


@query
def number_formats(spark: SparkSession, folder: str) -> DataFrame:
    roles = tw.detect_roles(table(spark, folder, "lineitem"))
    code = tw.number_format(F.col("role"), F.col("currency_symbol"))
    return roles.select("column_name", "role", code.alias("number_format"))


# --- charts ----------------------------------------------------------------------------------


@query
def category_sizes(spark: SparkSession, folder: str) -> DataFrame:
    part = table(spark, folder, "part")
    texts = [c for c, k in kinds(part).items() if k == "text"]
    counts = distinct_counts(part, texts)
    return local_frame(spark, list(counts.items()), "column_name string, distinct_count bigint")


over_tables("chart_specs", ["orders", "lineitem", "events", "part"], tw.select_charts)


def chart(
    name: str, source: str, chart_spec: ChartSpec, order_by: str | None = None, limits: ChartLimits = ALL_ROWS
) -> None:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        data = tw.chart_data(table(spark, folder, source), chart_spec, order_by, limits=limits)
        return rounded(data, value=2)

    QUERIES[f"chart_{name}"] = run


chart("line", "orders", spec("line", "o_orderdate", "o_totalprice", "sum"))
chart("line_mean", "events", spec("line", "ts", "value", "mean"))
chart("bar", "lineitem", spec("bar", "l_returnflag", "l_extendedprice", "sum"))
chart("bar_many", "part", spec("bar", "p_brand", "p_retailprice", "mean"))
chart("top10", "lineitem", spec("bar", "l_partkey", "l_extendedprice", "top10_sum"))
chart("pie", "events", spec("pie", "event_type", "value", "sum"))
chart("scatter", "orders", spec("scatter", "o_totalprice", "o_custkey", "raw"), "o_orderkey")
chart("histogram", "lineitem", spec("histogram", "l_extendedprice", None, "histogram"))
chart("pie_limited", "part", spec("pie", "p_brand", "p_retailprice", "sum"), limits=ChartLimits(slices=6))
chart("line_limited", "orders", spec("line", "o_orderdate", "o_totalprice", "sum"), limits=ChartLimits(days=30))
chart("no_data", "documents", spec("bar", "lang", "source", "sum"))


@query
def chart_line_text(spark: SparkSession, folder: str) -> DataFrame:
    """Dates kept as text, some of them unreadable."""
    typed = cleaning.parse_currencies(_marked(spark, folder), ["amount"])
    return rounded(tw.chart_data(typed, spec("line", "order_date", "amount", "sum")), value=2)


@query
def chart_ranges(spark: SparkSession, folder: str) -> DataFrame:
    orders = table(spark, folder, "orders")
    return charts.chart_ranges(tw.chart_tables(orders, charts.plan_charts(orders)))


@query
def analyze_dashboard(spark: SparkSession, folder: str) -> DataFrame:
    report = tw.analyze(spark, messy_orders(spark, folder))
    return rounded(report.dashboard(), value=2)
