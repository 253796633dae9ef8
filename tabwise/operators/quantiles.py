"""Exact quantiles of many columns in two passes, without sorting or gathering any of them.

The exact ``percentile`` aggregate keeps every distinct value of a column in one task, so it does
not survive large data. Here a first pass keeps a quantile sketch of each column and task, whose
merged form gives a lower and an upper bound of the value at each wanted rank. The second pass
counts the values: those between the bounds each for itself, the others only by the gap between
bounds that they lie in. What is between the bounds, a few thousandths of the column at most, is
written once, and the ranks are closed in on there: one job counts it in equal slices and keeps
each slice's smallest and largest value; the slice with the rank is the next interval. A slice is
resolved when all its values are equal or the rank is its first or last. When few values are
left, a slice is a single value, which ends the search. All jobs are pre-aggregated counts, and
only gaps and slices reach the driver. Tables of few values need the last job only.
"""

from __future__ import annotations

import math
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from tabwise.operators.frames import as_double, long_form, written

SLICES = 1024
# Once the open intervals hold no more values than this in all, each value is its own slice.
FEW_VALUES = 50_000
# Size of a sketch (8 to 65,535). With 99% confidence its ranks are off by less than half of what the
# bounds leave on both sides; a rank that they miss all the same is searched for outside.
ACCURACY = 8_000
_LARGEST = 1.7976931348623157e308


@dataclass(frozen=True)
class Interval:
    """``size`` values of one column in [low, high]; ``skipped`` of its values lie below it."""

    low: float
    high: float
    skipped: int
    size: int
    by_magnitude: bool = False


def _finite(v: float) -> float:
    return max(-_LARGEST, min(_LARGEST, v))


def _scale(interval: Interval) -> tuple[float, float, bool]:
    """``(low, width, by_magnitude)`` of the axis on which an interval is cut into slices.

    Any non-decreasing axis gives right results; it only affects how many jobs are needed.
    """
    low, high = _finite(interval.low), _finite(interval.high)
    if interval.by_magnitude or math.isinf(high - low):
        low, high = (math.copysign(math.log1p(abs(v)), v) for v in (low, high))
        return low, high - low or 1.0, True
    return low, high - low or 1.0, False


def order_statistics(
    df: DataFrame,
    wanted: dict[str, list[int]],
    counts: dict[str, int],
    limits: dict[str, tuple[float, float]],
    slices: int = SLICES,
    few_values: int = FEW_VALUES,
    accuracy: int = ACCURACY,
) -> dict[str, dict[int, float]]:
    """Values at the 0-based ranks ``wanted``, given each column's non-null count, min and max."""
    found: dict[str, dict[int, float]] = {c: {} for c in wanted}
    open_ranks: dict[str, dict[int, Interval]] = {}
    for name, ranks in wanted.items():
        low, high = limits[name]
        whole = Interval(low, high, 0, counts[name])
        for r in set(ranks):
            if low == high:
                found[name][r] = low
            else:
                open_ranks.setdefault(name, {})[r] = whole
    if not open_ranks:
        return found
    names = list(open_ranks)
    cells = long_form(df, {c: as_double(df, c) for c in names}, numbered=True)
    if sum(counts[c] for c in names) > few_values:
        bounds = _bounds(cells, names, open_ranks, counts, accuracy)
        inside, gaps = _between(cells, names, bounds)
        for name, spans in gaps.items():
            ranks = open_ranks[name]
            for rank in list(ranks):
                ranks[rank] = next(i for i in spans if rank < i.skipped + i.size)
                if ranks[rank].low == ranks[rank].high:
                    found[name][rank] = ranks.pop(rank).low
        missed = {
            c: {r: i for r, i in ranks.items() if (i.low, i.high) not in bounds[c]}
            for c, ranks in open_ranks.items()
        }
        for name, ranks in missed.items():
            for rank in ranks:
                del open_ranks[name][rank]
        # Ranks that lie outside the bounds, which is rare.
        _close_in(cells.withColumn("n", F.lit(1)), names, missed, found, slices, few_values)
        cells = inside
    else:
        cells = cells.withColumn("n", F.lit(1))
    _close_in(cells, names, open_ranks, found, slices, few_values)
    return found


def _bounds(
    cells: DataFrame, names: list[str], ranks: dict[str, Iterable[int]], counts: dict[str, int], accuracy: int
) -> dict[str, list[tuple[float, float]]]:
    """Disjoint ascending ``(low, high)`` of each column that hold its wanted ranks: one job."""
    room, shares = 4.6 / accuracy**0.9, {}
    for c in names:
        places = [r / max(1, counts[c] - 1) for r in ranks[c]]
        shares[c] = [(max(0.0, p - room), min(1.0, p + room)) for p in places]
    asked = sorted({p for pairs in shares.values() for pair in pairs for p in pair})
    rows = (
        cells.groupBy("column_number")
        .agg(F.kll_sketch_agg_double("value", F.lit(accuracy)).alias("sketch"))
        .select(
            "column_number",
            F.kll_sketch_get_quantile_double("sketch", F.array(*map(F.lit, asked))).alias("values"),
        )
        .collect()
    )
    bounds: dict[str, list[tuple[float, float]]] = {}
    for row in rows:
        name = names[row["column_number"]]
        value = dict(zip(asked, row["values"], strict=True))
        merged: list[tuple[float, float]] = []
        for low, high in sorted((value[a], value[b]) for a, b in shares[name]):
            if merged and low <= merged[-1][1]:
                merged[-1] = (merged[-1][0], max(high, merged[-1][1]))
            else:
                merged.append((low, high))
        bounds[name] = merged
    return bounds


def _between(
    cells: DataFrame, names: list[str], bounds: dict[str, list[tuple[float, float]]]
) -> tuple[DataFrame, dict[str, list[Interval]]]:
    """``(column_number, value, n)`` of the values within bounds, written, and for each column the
    intervals in and between its bounds in ascending order: one job over the table.

    An interval has an odd number within bounds, an even one between them.
    """
    at, x = F.col("column_number"), F.col("value")
    zone, most = F.lit(0), max(len(b) for b in bounds.values())
    for turn in range(most):
        chosen = [bounds[c][min(turn, len(bounds[c]) - 1)] for c in names]
        low, high = (_constant([pair[i] for pair in chosen], at) for i in (0, 1))
        number = _constant([2 * min(turn, len(bounds[c]) - 1) + 1 for c in names], at)
        zone = F.when(x > high, number + 1).when(x >= low, number).otherwise(zone)
    counted = written(
        cells.withColumn("zone", zone)
        .groupBy("column_number", "zone", F.when(F.col("zone") % 2 == 1, x).alias("within"))
        .agg(F.count(F.lit(1)).alias("n"), F.min("value").alias("low"), F.max("value").alias("high"))
    )
    rows = (
        counted.groupBy("column_number", "zone")
        .agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"))
        .collect()
    )
    gaps: dict[str, list[Interval]] = {}
    for row in sorted(rows, key=lambda r: (r["column_number"], r["zone"])):
        name = names[row["column_number"]]
        spans = gaps.setdefault(name, [])
        before = spans[-1].skipped + spans[-1].size if spans else 0
        low, high = row["low"], row["high"]
        if row["zone"] % 2 and low < high:
            low, high = bounds[name][row["zone"] // 2]
        spans.append(Interval(low, high, before, row["n"]))
    inside = counted.filter("zone % 2 = 1").select("column_number", F.col("within").alias("value"), "n")
    return inside, gaps


def _close_in(
    cells: DataFrame,
    names: list[str],
    open_ranks: dict[str, dict[int, Interval]],
    found: dict[str, dict[int, float]],
    slices: int,
    few_values: int,
) -> None:
    """Find the open ranks among ``(column_number, value, n)`` cells, a job per round."""
    while any(open_ranks.values()):
        intervals = [
            (name, interval)
            for name, ranks in open_ranks.items()
            for interval in sorted(set(ranks.values()), key=lambda i: i.low)
        ]
        few = sum(interval.size for _, interval in intervals) <= few_values
        counted = _count_slices(cells, names, intervals, None if few else slices)
        for number, (name, interval) in enumerate(intervals):
            parts = counted[number]
            for rank in [r for r, i in open_ranks[name].items() if i == interval]:
                before = interval.skipped
                for n, low, high in parts:
                    if rank < before + n:
                        break
                    before += n
                if low == high or rank == before:
                    found[name][rank] = low
                elif rank == before + n - 1:
                    found[name][rank] = high
                else:
                    stuck = n > interval.size // 2
                    turned = stuck and not interval.by_magnitude
                    open_ranks[name][rank] = Interval(low, high, before, n, turned)
                    continue
                del open_ranks[name][rank]


def _constant(values: list, index: Column) -> Column:
    return F.get(F.array(*[F.lit(v) for v in values]), index)


def _part(intervals: list[Interval], slices: int) -> Column:
    """Slice number of ``value`` in its ``interval``."""
    at, x = F.col("interval"), F.col("value")
    scales = [_scale(i) for i in intervals]
    place = F.least(F.lit(_LARGEST), F.greatest(F.lit(-_LARGEST), x))
    if any(by_magnitude for _, _, by_magnitude in scales):
        magnitude = F.signum(place) * F.log1p(F.abs(place))
        place = F.when(_constant([m for _, _, m in scales], at), magnitude).otherwise(place)
    low = _constant([low for low, _, _ in scales], at)
    width = _constant([width for _, width, _ in scales], at)
    part = ((place - low) / width * F.lit(float(slices))).cast("int")
    return F.greatest(F.lit(0), F.least(F.lit(slices - 1), part))


def _count_slices(
    cells: DataFrame, names: list[str], intervals: list, slices: int | None
) -> dict[int, list[tuple]]:
    """Per interval the ordered ``(count, min, max)`` of its non-empty slices: one job.

    Without ``slices`` every distinct value is a slice.
    """
    by_column: dict[str, list[int]] = {}
    for number, (name, _) in enumerate(intervals):
        by_column.setdefault(name, []).append(number)

    at, x = F.col("column_number"), F.col("value")
    interval = F.lit(None).cast("int")
    for turn in range(max(len(numbers) for numbers in by_column.values())):
        chosen = [by_column[c][min(turn, len(by_column[c]) - 1)] if c in by_column else None for c in names]
        low = _constant([None if n is None else intervals[n][1].low for n in chosen], at)
        high = _constant([None if n is None else intervals[n][1].high for n in chosen], at)
        interval = F.when((x >= low) & (x <= high), _constant(chosen, at)).otherwise(interval)
    cells = cells.withColumn("interval", interval).filter("interval IS NOT NULL")

    part = x if slices is None else _part([i for _, i in intervals], slices)
    rows = (
        cells.withColumn("part", part)
        .groupBy("interval", "part")
        .agg(F.sum("n").alias("n"), F.min("value").alias("low"), F.max("value").alias("high"))
        .collect()
    )
    counted: dict[int, list[tuple]] = {}
    for row in sorted(rows, key=lambda r: (r["interval"], r["part"])):
        counted.setdefault(row["interval"], []).append((row["n"], row["low"], row["high"]))
    return counted


def exact_quantiles(
    df: DataFrame,
    probabilities: list[float],
    counts: dict[str, int],
    limits: dict[str, tuple[float, float]],
    slices: int = SLICES,
    few_values: int = FEW_VALUES,
    accuracy: int = ACCURACY,
) -> dict[str, list[float]]:
    """Linearly interpolated quantiles per column, from non-null counts and (min, max)."""
    wanted: dict[str, list[int]] = {}
    for name, n in counts.items():
        if n:
            places = [(n - 1) * p for p in probabilities]
            wanted[name] = [r for h in places for r in (math.floor(h), math.ceil(h))]
    values = order_statistics(df, wanted, counts, limits, slices, few_values, accuracy)
    result = {}
    for name, n in counts.items():
        if not n:
            continue
        result[name] = []
        for p in probabilities:
            h = (n - 1) * p
            low, high = values[name][math.floor(h)], values[name][math.ceil(h)]
            share = h - math.floor(h)
            # The same two-sided form numpy uses, so that equal inputs give equal digits.
            span = high - low
            result[name].append(high - span * (1 - share) if share >= 0.5 else low + span * share)
    return result
