"""Chart choice and chart tables. Every table is a small aggregate or a bounded sample."""

from __future__ import annotations

import math
from dataclasses import astuple, dataclass

from pyspark.sql import Column, DataFrame, functions as F

from tabwise.functions import parse
from tabwise.operators.eda import bin_edges, count_in_bins
from tabwise.operators.frames import (
    as_double, at_once, column, is_numeric, kinds, local_frame, top_n, written,
)
from tabwise.operators.frequency import distinct_counts
from tabwise.operators.profile import profile
from tabwise.operators.roles import as_roles
from tabwise.plans import charts as plan
from tabwise.plans.charts import ChartSpec
from tabwise.plans.measures import TableProfile
from tabwise.plans.roles import ColumnRole

SPEC_SCHEMA = (
    "chart_id string, chart_type string, title string, x_col string, y_col string, "
    "aggregation string, description string"
)
DATA_SCHEMA = "chart_id string, position int, category string, value double"

# Rows of a leaderboard, of a scatter sample and of a histogram.
TOP_BARS, POINTS, BINS = 10, 100, 8
SAMPLE_SEED = "42"
# Chart tables up to this size pass through the driver; larger ones are numbered where they are.
FEW_ROWS = 1000


@dataclass(frozen=True)
class ChartLimits:
    """The most rows of line, bar and pie tables: the last days, the largest bars, the largest slices and
    one row "Other" with the sum of the rest. None keeps all."""

    days: int | None = None
    bars: int | None = None
    slices: int | None = None


ALL_ROWS = ChartLimits()


def category_sizes(df: DataFrame, roles: list[ColumnRole]) -> dict[str, int]:
    """Distinct counts of the category columns, as far as the chart rules tell them apart.

    A column whose role evidence already shows more values than the middle limit has "many" for
    certain; only the others are counted over the whole table.
    """
    categories = [r for r in roles if r.role == "categorical"]
    many = plan.MIDDLE + 1
    sizes = {r.column_name: many if r.unique_count is None else r.unique_count for r in categories}
    open_columns = [c for c, n in sizes.items() if n <= plan.MIDDLE]
    return sizes | distinct_counts(df, open_columns)


def plan_charts(
    df: DataFrame,
    roles: list[ColumnRole] | DataFrame | None = None,
    k: int = 4,
    measured: TableProfile | None = None,
) -> list[ChartSpec]:
    """Up to ``k`` chart specifications as Python objects."""
    roles = as_roles(df, roles)
    measured = measured or profile(df, nulls=False)
    stats = measured.numeric
    varying = {c for c, s in stats.items() if s.low < s.high}
    columns = plan.group_columns(roles, category_sizes(df, roles), varying)
    return plan.choose_charts(roles, columns, lambda c: c in stats and stats[c].low >= 0, k)


def select_charts(
    df: DataFrame,
    roles: list[ColumnRole] | DataFrame | None = None,
    k: int = 4,
    measured: TableProfile | None = None,
) -> DataFrame:
    """Up to ``k`` chart specifications as a DataFrame."""
    return specs_frame(df, plan_charts(df, roles, k, measured))


def specs_frame(df: DataFrame, specs: list[ChartSpec]) -> DataFrame:
    return local_frame(df.sparkSession, [astuple(s) for s in specs], SPEC_SCHEMA)


def chart_data(
    df: DataFrame,
    spec: ChartSpec,
    order_by: str | None = None,
    measured: TableProfile | None = None,
    limits: ChartLimits = ALL_ROWS,
) -> DataFrame:
    """``(chart_id, position, category, value)`` of one chart; "No Data" where nothing is left."""
    if spec.x_col not in df.columns or (spec.y_col and spec.y_col not in df.columns):
        rows = []
    elif spec.chart_type == "histogram":
        rows = _histogram(df, spec, measured)
    elif spec.chart_type == "scatter":
        rows = [tuple(r) for r in _scatter(df, spec, order_by).collect()]
    else:
        table, order, most = {"line": _line, "bar": _bar, "pie": _pie}[spec.chart_type](df, spec, limits)
        first = table.orderBy(*order).limit(FEW_ROWS + 1 if most is None else most).collect()
        if len(first) > FEW_ROWS and most is None:
            return _numbered(table, order, spec.chart_id)
        rows = [(r["category"], r["value"]) for r in first]
        if spec.chart_type == "line":
            rows.sort()
        if spec.chart_type == "pie" and most is not None and len(rows) == most:
            rest = _rest(table, rows)
            rows += [("Other", rest)] if rest is not None else []
    rows = rows or [("No Data", 0.0)]
    numbered = [(spec.chart_id, i, c, float(x)) for i, (c, x) in enumerate(rows, start=1)]
    return local_frame(df.sparkSession, numbered, DATA_SCHEMA)


def _rest(table: DataFrame, rows: list[tuple]) -> float | None:
    """The sum of what is not among the first rows, None if there is nothing."""
    named = F.col("category").isin([c for c, _ in rows])
    rest = table.filter(~named).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("x")).first()
    return rest["x"] if rest["n"] else None


def _numbered(table: DataFrame, order: list[Column], chart_id: str) -> DataFrame:
    """All rows with their positions. The sorted rows are written with their part and place; the sizes of
    the parts, one number each, give the position, so no task holds all rows."""
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    parts = table.orderBy(*order).select(F.spark_partition_id().alias("part"), place.alias("place"), "category", "value")
    stored = written(parts)
    sizes = {r["part"]: r["n"] for r in stored.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect()}
    before, earlier = [], 0
    for part in sorted(sizes):
        before.append((part, earlier))
        earlier += sizes[part]
    offsets = local_frame(table.sparkSession, before, "part int, earlier bigint")
    position = (F.col("earlier") + F.col("place") + 1).cast("int")
    return stored.join(offsets, "part").select(F.lit(chart_id).alias("chart_id"), position.alias("position"), "category", "value")


def chart_tables(
    df: DataFrame,
    specs: list[ChartSpec],
    order_by: str | None = None,
    measured: TableProfile | None = None,
    limits: ChartLimits = ALL_ROWS,
) -> DataFrame:
    """The tables of all charts, one below the other."""
    spark = df.sparkSession
    found = at_once(spark, *[lambda spec=spec: chart_data(df, spec, order_by, measured, limits) for spec in specs])
    tables = local_frame(spark, [], DATA_SCHEMA)
    for part in found:
        tables = tables.unionByName(part)
    return tables


def chart_ranges(tables: DataFrame) -> DataFrame:
    """Number of rows per chart."""
    return tables.groupBy("chart_id").agg(F.count(F.lit(1)).alias("row_count"))


def _number(df: DataFrame, name: str) -> Column:
    kind = kinds(df)[name]
    if is_numeric(kind):
        return as_double(df, name)
    return parse.number(column(name)) if kind == "text" else F.lit(None).cast("double")


def _label(df: DataFrame, name: str, value: Column | None = None) -> Column:
    """A cell as plain text: whole numbers as they are, large doubles without an exponent."""
    kind = kinds(df)[name]
    if kind not in ("double", "text") or (kind == "text" and value is None):
        return column(name).cast("string")
    x = as_double(df, name) if value is None else value
    digits = F.regexp_replace(x.try_cast("decimal(38,10)").cast("string"), r"(\.\d+?)0*$", "$1")
    return F.when((F.abs(x) >= 1e7) & (F.abs(x) < 1e27), digits).otherwise(x.cast("string"))


def _grouped(df: DataFrame, key: Column, spec: ChartSpec, mean: bool) -> DataFrame:
    """Sum or mean of the measure per key, over rows that have both."""
    pairs = df.select(key.alias("category"), _number(df, spec.y_col).alias("y")).dropna()
    combined = F.avg("y") if mean else F.sum("y")
    return pairs.groupBy("category").agg(combined.alias("value"))


def _largest() -> list[Column]:
    return [F.desc("value"), F.asc("category")]


def _line(df: DataFrame, spec: ChartSpec, limits: ChartLimits) -> tuple[DataFrame, list[Column], int | None]:
    """A row per day; the order puts the last days first if they are limited."""
    moment = column(spec.x_col)
    if kinds(df)[spec.x_col] == "text":
        moment = parse.timestamp(moment)
    days = _grouped(df, F.date_format(moment, "yyyy-MM-dd"), spec, "mean" in spec.aggregation)
    return days, [F.asc("category") if limits.days is None else F.desc("category")], limits.days


def _bar(df: DataFrame, spec: ChartSpec, limits: ChartLimits) -> tuple[DataFrame, list[Column], int | None]:
    key = _label(df, spec.x_col)
    bars = TOP_BARS if "top10" in spec.aggregation else limits.bars
    return _grouped(df, key, spec, "mean" in spec.aggregation), _largest(), bars


def _pie(df: DataFrame, spec: ChartSpec, limits: ChartLimits) -> tuple[DataFrame, list[Column], int | None]:
    return _grouped(df, _label(df, spec.x_col), spec, False), _largest(), limits.slices


def _scatter(df: DataFrame, spec: ChartSpec, order_by: str | None) -> DataFrame:
    """All points, or a hundred chosen by a hash of the row's key, or of all its cells where no key is
    given: the same ones in every run and however the rows are partitioned."""
    x, y = _number(df, spec.x_col), _number(df, spec.y_col)
    if order_by is not None:
        draw = F.md5(F.concat(column(order_by).cast("string"), F.lit(SAMPLE_SEED)))
    else:
        cells = [column(c) for c, k in kinds(df).items() if k != "nested"]
        draw = F.xxhash64(*cells, F.lit(SAMPLE_SEED))
    label = _label(df, spec.x_col, x).alias("category")
    points = df.select(x.alias("x"), y.alias("value"), draw.alias("draw"), label).dropna()
    drawn = top_n(points, POINTS, F.struct("draw", "x", "value"))
    return drawn.orderBy("x", "value").select("category", "value")


def _histogram(df: DataFrame, spec: ChartSpec, measured: TableProfile | None) -> list[tuple]:
    name = spec.x_col
    numbers = df.select(_number(df, name).alias("x"))
    known = measured.numeric.get(name) if measured else None
    if known is None:
        known = profile(numbers, nulls=False).numeric.get("x")
    if known is None or not math.isfinite(known.high - known.low):
        return []
    edges = bin_edges(known.low, known.high, BINS)
    counts, _ = count_in_bins(numbers, {"x": edges})
    return [
        (f"{low:.1f}-{high:.1f}", n) for low, high, n in zip(edges, edges[1:], counts["x"])
    ]
