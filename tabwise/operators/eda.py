"""Exploratory statistics of a table, each section a long DataFrame."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from tabwise.functions.text import LONG_TEXT, grouping_key
from tabwise.operators.frames import (
    as_double, column, is_numeric, kinds, local_frame, long_form, tuned, top_n,
)
from tabwise.operators.frequency import value_counts
from tabwise.operators.profile import profile
from tabwise.operators.quantiles import exact_quantiles
from tabwise.operators.roles import as_roles, identifier_roles
from tabwise.plans.measures import NumericStats, TableProfile
from tabwise.plans.roles import ColumnRole

QUARTILES = [0.25, 0.5, 0.75]
TOP_VALUES = 10
MAX_BINS = 10
# Up to so many column pairs are sums of one aggregate; beyond, tasks add up whole matrices.
FEW_PAIRS = 300

Quartiles = dict[str, list[float]]


def numeric_columns(df: DataFrame, roles: list[ColumnRole] | DataFrame | None) -> list[str]:
    """Numeric columns that are not identifiers. Without roles only the identifiers are looked for."""
    roles = identifier_roles(df) if roles is None else as_roles(df, roles)
    ids = {r.column_name for r in roles if r.role == "identifier"}
    return [c for c, k in kinds(df).items() if is_numeric(k) and c not in ids]


def missing_summary(df: DataFrame, measured: TableProfile | None = None) -> DataFrame:
    """NULL cells per column, as count and percentage."""
    measured = measured or profile(df, columns=[])
    rows = [
        (c, i, measured.nulls[c], _share(measured.nulls[c], measured.rows))
        for i, c in enumerate(df.columns)
    ]
    return local_frame(
        df.sparkSession,
        rows,
        "column_name string, position int, null_count bigint, null_percentage double",
    )


def _share(part: int, whole: int) -> float:
    return round(part / whole * 100, 2) if whole else 0.0


def quartiles(df: DataFrame, stats: dict[str, NumericStats]) -> Quartiles:
    """Exact quartiles of the numeric columns; a boolean column has none."""
    chosen = {c: s for c, s in stats.items() if kinds(df)[c] != "boolean"}
    return exact_quantiles(
        df,
        QUARTILES,
        {c: s.count for c, s in chosen.items()},
        {c: (s.low, s.high) for c, s in chosen.items()},
    )


def describe_numeric(
    df: DataFrame,
    roles: list[ColumnRole] | DataFrame | None = None,
    measured: TableProfile | None = None,
    parts: Quartiles | None = None,
    digits: int = 3,
) -> DataFrame:
    """Count, mean, deviation, quartiles, limits and skewness of each numeric column."""
    names = numeric_columns(df, roles)
    measured = measured or profile(df, names, nulls=False)
    stats = {c: measured.numeric[c] for c in names if c in measured.numeric}
    parts = parts if parts is not None else quartiles(df, stats)
    rows = []
    for c, s in stats.items():
        if c in parts:
            shown = [s.mean, s.std, s.low, *parts[c], s.high, s.skewness]
            rows.append((c, s.count, *[round(x, digits) for x in shown]))
    return local_frame(
        df.sparkSession,
        rows,
        "column_name string, count bigint, mean double, std double, min double, q25 double, "
        "median double, q75 double, max double, skewness double",
    )


def top_categories(df: DataFrame, rows: int | None = None, k: int = TOP_VALUES) -> DataFrame:
    """The ``k`` most frequent values of each text column and its number of distinct values.

    Ties go to the smaller value (for texts over 64 characters: by digest). Only ``k`` rows per
    column and task are ranked. Digests are turned back into text for the winners alone.
    """
    spark = df.sparkSession
    names = [c for c, kind in kinds(df).items() if kind == "text"]
    schema = (
        "column_name string, unique_count bigint, rank int, value string, count bigint, "
        "percentage double"
    )
    if not names:
        return local_frame(spark, [], schema)
    rows = df.count() if rows is None else rows
    counted = value_counts(df, names)
    # Summing n as well keeps both uses of the counts identical, so that one shuffle serves them.
    unique = counted.groupBy("column_name").agg(
        F.count(F.lit(1)).alias("unique_count"), F.sum("n").alias("present")
    )
    order = F.struct((-F.col("n")).alias("n"), F.col("value"))
    ranked = top_n(counted, k, order, ["column_name"], levels=1)
    # One row per column on the broadcast side, so its size is that of the schema.
    with tuned(df):
        best = ranked.join(F.broadcast(unique), "column_name").collect()
    position = {c: i for i, c in enumerate(names)}
    best.sort(key=lambda r: (position[r["column_name"]], -r["n"], r["value"]))
    table, rank = [], {}
    for r in best:
        c = r["column_name"]
        rank[c] = rank.get(c, 0) + 1
        table.append((c, r["unique_count"], rank[c], r["value"], r["n"], _share(r["n"], rows)))
    result = local_frame(spark, table, schema)
    digested = [(c, value) for c, _, _, value, _, _ in table if len(value) > LONG_TEXT]
    return _with_texts(df, result, digested) if digested else result


def _with_texts(df: DataFrame, result: DataFrame, digested: list[tuple[str, str]]) -> DataFrame:
    """Replace the few digests in ``result`` (ten per column at most, hence the broadcast) by the
    texts they stand for."""
    spark = df.sparkSession
    columns = list(dict.fromkeys(c for c, _ in digested))
    wanted = F.broadcast(local_frame(spark, digested, "column_name string, digest string"))
    long_texts = long_form(
        df, {c: F.when(F.length(column(c)) > LONG_TEXT, column(c)) for c in columns}
    )
    texts = (
        long_texts.withColumn("digest", grouping_key(F.col("value")))
        .join(wanted, ["column_name", "digest"])
        .groupBy("column_name", "digest")
        .agg(F.min("value").alias("text"))
    )
    return (
        result.withColumnRenamed("value", "digest")
        .join(texts, ["column_name", "digest"], "left")
        .select(
            "column_name",
            "unique_count",
            "rank",
            F.coalesce("text", "digest").alias("value"),
            "count",
            "percentage",
        )
    )


def correlations(
    df: DataFrame,
    roles: list[ColumnRole] | DataFrame | None = None,
    measured: TableProfile | None = None,
) -> DataFrame:
    """Pearson correlation of every pair of varying numeric columns, over rows that have both."""
    names = numeric_columns(df, roles)
    few = len(names) * (len(names) - 1) // 2 <= FEW_PAIRS
    if measured is not None and set(names) <= set(measured.nulls):
        ranges = {c: (s.mean, s.low, s.high) for c, s in measured.numeric.items()}
    elif few:
        measured = profile(df, names)
        ranges = {c: (s.mean, s.low, s.high) for c, s in measured.numeric.items()}
    else:
        ranges = _ranges(df, names)
    varying = [c for c in names if c in ranges and ranges[c][1] < ranges[c][2]]
    pairs = [(a, b) for i, a in enumerate(varying) for b in varying[i + 1 :]]
    found = {}
    if pairs:
        found = _correlate(df, pairs, measured) if few else _co_moments(df, {c: ranges[c][0] for c in varying})
    rows = []
    if len(varying) >= 2:
        for a in varying:
            for b in varying:
                r = 1.0 if a == b else found.get((a, b), found.get((b, a)))
                rows.append((a, b, 0.0 if r is None or math.isnan(r) else round(r, 3)))
    return local_frame(
        df.sparkSession, rows, "column_a string, column_b string, correlation double"
    )


def _correlate(
    df: DataFrame, pairs: list[tuple[str, str]], measured: TableProfile
) -> dict[tuple[str, str], float | None]:
    """Correlations of column pairs from sums of products in one aggregate.

    Values are taken relative to the known column means, which keeps the sums exact enough. Where
    both columns have no gaps one product sum per pair is all that is missing. Otherwise the other
    sums are over the rows that have both values.
    """
    stats = measured.numeric
    off = {c: as_double(df, c) - F.lit(stats[c].mean) for c in dict.fromkeys(sum(pairs, ()))}
    wanted = []
    for i, (a, b) in enumerate(pairs):
        x, y = off[a], off[b]
        wanted.append(F.sum(x * y).alias(f"xy{i}"))
        if measured.nulls[a] or measured.nulls[b]:
            both_x, both_y = F.when(y.isNotNull(), x), F.when(x.isNotNull(), y)
            wanted += [
                F.count(x * y).alias(f"n{i}"),
                F.sum(both_x).alias(f"x{i}"),
                F.sum(both_y).alias(f"y{i}"),
                F.sum(both_x * both_x).alias(f"xx{i}"),
                F.sum(both_y * both_y).alias(f"yy{i}"),
            ]
    row = df.agg(*wanted).first().asDict()
    found = {}
    for i, (a, b) in enumerate(pairs):
        if f"n{i}" not in row:
            s, t = stats[a], stats[b]
            found[a, b] = _ratio(row[f"xy{i}"], (s.count - 1) * s.std * t.std)
        elif row[f"n{i}"]:
            found[a, b] = _shared_ratio(*(row[f"{k}{i}"] for k in ("n", "x", "y", "xx", "yy", "xy")))
    return found


def _shared_ratio(n: float, x: float, y: float, xx: float, yy: float, xy: float) -> float | None:
    """Correlation from sums over the rows that have both values."""
    # A column that is constant on the shared rows leaves rounding noise for a variance.
    spread = [q - p * p / n for p, q in ((x, xx), (y, yy))]
    if not all(v > 1e-12 * q for v, q in zip(spread, (xx, yy))):
        return None
    return _ratio(xy - x * y / n, math.sqrt(spread[0] * spread[1]))


def _values(df: DataFrame, names: list[str]) -> DataFrame:
    """The named columns for `_matrix`. Only what NumPy can't read is converted: an expression for each
    of many columns would make a method that the JVM doesn't compile."""
    exact = {f.name for f in df.schema.fields if isinstance(f.dataType, T.DecimalType)}
    return df.select(*[(as_double(df, c) if c in exact else column(c)).alias(f"c{i}") for i, c in enumerate(names)])


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    """A row per column of the batch; missing values are NaN."""
    x = np.empty((batch.num_columns, batch.num_rows))
    for i, c in enumerate(batch.columns):
        if pa.types.is_boolean(c.type):
            c = c.cast(pa.int8())
        x[i] = c.to_numpy(zero_copy_only=False)
    return x


def _ranges(df: DataFrame, names: list[str]) -> dict[str, tuple[float, float, float]]:
    """Mean, least and greatest value of each of many columns that has any, in one scan: a task sends a
    row per column."""
    m = len(names)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total = np.zeros(m, np.int64), np.zeros(m)
        low, high = np.full(m, np.inf), np.full(m, -np.inf)
        for batch in batches:
            x = _matrix(batch)
            gap = np.isnan(x)
            count += x.shape[1] - gap.sum(axis=1)
            total += np.where(gap, 0.0, x).sum(axis=1)
            low = np.fmin(low, np.fmin.reduce(x, axis=1, initial=np.inf))
            high = np.fmax(high, np.fmax.reduce(x, axis=1, initial=-np.inf))
        yield pa.RecordBatch.from_arrays(
            [pa.array(x) for x in (np.arange(m), count, total, low, high)], names=["a", "n", "total", "low", "high"]
        )

    parts = _values(df, names).mapInArrow(add, "a long, n long, total double, low double, high double").filter("n > 0")
    sums = [F.sum("n").alias("n"), F.sum("total").alias("total"), F.min("low").alias("low"), F.max("high").alias("high")]
    rows = parts.groupBy("a").agg(*sums).collect()
    return {names[r["a"]]: (r["total"] / r["n"], r["low"], r["high"]) for r in rows}


def _co_moments(df: DataFrame, means: dict[str, float]) -> dict[tuple[str, str], float | None]:
    """Correlations of all pairs of many columns in one scan.

    A task adds up four matrices over its rows: per pair of columns how many rows have both, and over
    these the sums of the first value, of its square and of the product. Values are taken relative to
    the known means. Matrices of tasks are added entry by entry.
    """
    names, m = list(means), len(means)
    offsets = np.array(list(means.values()))[:, None]

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((4, m, m))
        for batch in batches:
            with np.errstate(invalid="ignore"):
                x = _matrix(batch) - offsets
                gap = np.isnan(x)
                x[gap] = 0.0
                # over the rows of a column without gaps, the sums are those over all rows
                at = np.flatnonzero(gap.any(axis=1))
                there = (~gap[at]).astype(float)
                held = x.shape[1] - gap.sum(axis=1)
                both = np.minimum(held[:, None], held).astype(float)
                both[np.ix_(at, at)] = there @ there.T
                sums[0] += both
                for k, y in ((1, x), (2, x * x)):
                    over = np.repeat(y.sum(axis=1)[:, None], m, axis=1)
                    over[:, at] = y @ there.T
                    sums[k] += over
                sums[3] += x @ x.T
        a, b = np.divmod(np.arange(m * m), m)
        yield pa.RecordBatch.from_arrays(
            [pa.array(a), pa.array(b), *(pa.array(s.ravel()) for s in sums)], names=["a", "b", "n", "x", "xx", "xy"]
        )

    parts = _values(df, names).mapInArrow(add, "a long, b long, n double, x double, xx double, xy double")
    total = parts.groupBy("a", "b").agg(*[F.sum(k).alias(k) for k in ("n", "x", "xx", "xy")])
    sums = {(r["a"], r["b"]): r for r in total.collect()}
    found = {}
    for i in range(m):
        for j in range(i + 1, m):
            r, s = sums[i, j], sums[j, i]
            if r["n"]:
                found[names[i], names[j]] = _shared_ratio(r["n"], r["x"], s["x"], r["xx"], s["xx"], r["xy"])
    return found


def _ratio(part: float, whole: float) -> float | None:
    return max(-1.0, min(1.0, part / whole)) if whole else None


def bin_edges(low: float, high: float, bins: int) -> list[float]:
    """Edges of equal-width bins; one value alone gets a bin range of width one around it."""
    if low == high:
        low, high = low - 0.5, high + 0.5
    step = (high - low) / bins
    return [low + i * step for i in range(bins)] + [high]


def automatic_bins(s: NumericStats, quarter: list[float] | None, whole_numbers: bool) -> int:
    """Number of equal bins: the finer of Sturges' and a floored Freedman–Diaconis rule.

    Sturges' rule alone gives over ten bins beyond 512 values; only up to there is ``quarter``
    (the quartiles) looked at.
    """
    span = s.high - s.low
    width = span / (math.log2(s.count) + 1.0)
    if quarter is not None:
        spread_rule = 2.0 * (quarter[2] - quarter[0]) * s.count ** (-1.0 / 3.0)
        width = min(max(spread_rule, span / math.sqrt(s.count) / 2), width)
    if whole_numbers:
        width = max(width, 1.0)
    return math.ceil(span / width)


def count_in_bins(
    df: DataFrame, edges: dict[str, list[float]]
) -> tuple[dict[str, list[int]], dict[str, bool]]:
    """Values per bin of each column (last bin closed), all columns in one aggregate, and whether
    any value lies strictly between the outer edges."""
    if not edges:
        return {}, {}
    names, at, x = list(edges), F.col("column_number"), F.col("value")
    # The bin of a value is the number of inner edges that it reaches.
    place = F.lit(0)
    for b in range(1, max(map(len, edges.values())) - 1):
        inner = [e[b] if b < len(e) - 1 else None for e in edges.values()]
        reached = x >= F.get(F.array(*[F.lit(v).cast("double") for v in inner]), at)
        place = place + F.when(reached, 1).otherwise(0)
    low, high = (F.get(F.array(*[F.lit(e[k]) for e in edges.values()]), at) for k in (0, -1))
    rows = (
        long_form(df, {c: as_double(df, c) for c in names}, numbered=True)
        .groupBy("column_number", place.alias("bin"))
        .agg(F.count(F.lit(1)).alias("n"), F.max((x > low) & (x < high)).alias("inner"))
        .collect()
    )
    counts = {c: [0] * (len(e) - 1) for c, e in edges.items()}
    varied = dict.fromkeys(names, False)
    for r in rows:
        name = names[r["column_number"]]
        counts[name][r["bin"]] = r["n"]
        varied[name] = varied[name] or r["inner"]
    return counts, varied


def histograms(
    df: DataFrame,
    roles: list[ColumnRole] | DataFrame | None = None,
    measured: TableProfile | None = None,
    parts: Quartiles | None = None,
    most: int | None = None,
) -> DataFrame:
    """Up to ten equal bins for every numeric column (or the first ``most``) with over two distinct values."""
    by_kind = kinds(df)
    names = numeric_columns(df, roles)[:most]
    measured = measured or profile(df, names, nulls=False)
    stats = {
        c: measured.numeric[c]
        for c in names
        if c in measured.numeric
        and by_kind[c] != "boolean"
        and measured.numeric[c].count >= 5
        and 0 < measured.numeric[c].high - measured.numeric[c].low < math.inf
    }
    small = {c: s for c, s in stats.items() if s.count <= 512}
    if small and parts is None:
        parts = quartiles(df, small)
    edges = {}
    for c, s in stats.items():
        bins = automatic_bins(s, parts[c] if c in small else None, by_kind[c] == "integer")
        edges[c] = bin_edges(s.low, s.high, min(bins, MAX_BINS))
    counts, varied = count_in_bins(df, edges)
    rows = [
        (c, b, round(edges[c][b], 2), round(edges[c][b + 1], 2), n)
        for c, in_bin in counts.items()
        if varied[c]
        for b, n in enumerate(in_bin)
    ]
    return local_frame(
        df.sparkSession,
        rows,
        "column_name string, bin int, bin_left double, bin_right double, count bigint",
    )
