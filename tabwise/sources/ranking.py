"""Which of several candidate tables holds the data: a score per table from all its cells."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from tabwise.functions.text import strip
from tabwise.operators.frames import column, first_rows, kinds, local_frame
from tabwise.plans import vocabulary as v

# Names a reader makes up for a column without a header.
_NO_HEADER = r"^(_c\d+|Unnamed: \d+|\s*)$"


def rank_tables(tables: dict[str, DataFrame]) -> DataFrame:
    """Score of every candidate, best first, with ``selected`` marking the winner.

    The header counts as the first row. Rows and filled cells of all tables are counted in one job.
    """
    if not tables:
        raise ValueError("No candidate tables.")
    names = list(tables)
    spark = tables[names[0]].sparkSession
    if len(names) == 1:
        rows = [(names[0], 0, None, None, None, None, 100.0)]
    else:
        counts = _filled_cells(tables)
        rows = [
            (name, i, *_score(name, df, *counts[name])) for i, (name, df) in enumerate(tables.items())
        ]
    winner = max(rows, key=lambda r: r[-1])[1]
    return local_frame(
        spark,
        [(*r, r[1] == winner) for r in sorted(rows, key=lambda r: -r[-1])],
        "table_name string, position int, rows bigint, active_columns int, "
        "non_empty_ratio double, header_detected boolean, score double, selected boolean",
    )


def _filled_cells(tables: dict[str, DataFrame]) -> dict[str, tuple[int, list[int]]]:
    """Rows of each candidate and filled cells of each of its columns, a row per table and task."""
    counted = []
    for name, df in tables.items():
        filled = [
            F.count_if(column(c).isNotNull() & (strip(column(c).cast("string")) != ""))
            if kind == "text" else F.count(column(c))
            for c, kind in kinds(df).items()
        ]
        cells = F.array(*filled) if filled else F.lit(None).cast("array<bigint>")
        counted.append(df.agg(F.count(F.lit(1)).alias("n"), cells.alias("cells")).withColumn("name", F.lit(name)))
    rows = reduce(DataFrame.unionByName, counted).collect()
    return {r["name"]: (r["n"], r["cells"] or []) for r in rows}


def _score(name: str, df: DataFrame, data_rows: int, cells: list[int]) -> tuple:
    titled = [c for c in df.columns if not re.match(_NO_HEADER, c)]
    rows = data_rows + 1
    per_column = [n + (c in titled) for c, n in zip(df.columns, cells, strict=True)]
    density = sum(per_column) / (rows * len(per_column)) if per_column else 0.0
    active = sum(1 for n in per_column if n)
    header = len(titled) >= 3 or _text_row(df)
    points = (
        _row_points(rows) + _column_points(active) + _density_points(density)
        + (25.0 if header else 0.0) + _name_points(name)
    )
    return rows, active, round(density, 3), header, round(points, 6)


def _text_row(df: DataFrame) -> bool:
    """Whether one of the first four data rows opens with three texts."""
    by_kind = kinds(df)
    for row in first_rows(df, 4).collect():
        values = [c for c in df.columns if row[c] is not None and str(row[c]).strip() != ""]
        if len(values) >= 3 and all(by_kind[c] == "text" for c in values[:3]):
            return True
    return False


def _row_points(rows: int) -> float:
    if rows <= 2:
        return -150.0
    if rows < 10:
        return rows * 2.0
    if rows < 100:
        return 30.0 + rows * 0.5
    return 80.0 + min(rows * 0.05, 50.0)


def _column_points(columns: int) -> float:
    if columns <= 1:
        return -100.0
    if columns == 2:
        return -20.0
    return 40.0 + columns * 1.5 if columns <= 30 else 50.0


def _density_points(density: float) -> float:
    if density < 0.15:
        return -60.0
    return density * 40.0 if density > 0.5 else 0.0


def _name_points(name: str) -> float:
    form = name.strip().lower()
    penalty = -75.0 if v.matches(v.PENALISED_TABLES, form) else 0.0
    return penalty + (35.0 if v.matches(v.FAVOURED_TABLES, form) else 0.0)
