"""First non-null values per column: the bounded sample that role detection looks at."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from tabwise.operators.frames import column, first_rows, kinds, long_form, top_n

# Leading rows read per wanted value; a column that is mostly NULL there is searched for in full.
_HEAD_FACTOR = 2


def first_values(
    df: DataFrame, n: int = 500, order_by: str | None = None, columns: list[str] | None = None
) -> DataFrame:
    """``(column_name, position, value)``: the first ``n`` non-null values of each column as text.

    Most columns are answered by a short head of the table. Only those with fewer than ``n``
    values in it are ranked over the whole table.
    """
    spark = df.sparkSession
    names = columns or [c for c, k in kinds(df).items() if k != "nested"]
    head_size = _HEAD_FACTOR * n
    keep = [column(c) for c in dict.fromkeys([*names, *([order_by] if order_by else [])])]
    head = first_rows(df.select(*keep), head_size, order_by).coalesce(1)
    row = F.monotonically_increasing_id().alias("row")
    counts = head.agg(
        F.count(F.lit(1)).alias("rows"), *[F.count(column(c)).alias(f"n{i}") for i, c in enumerate(names)]
    ).first()
    complete = counts["rows"] < head_size
    sparse = [c for i, c in enumerate(names) if not complete and counts[f"n{i}"] < n]

    parts = []
    full = [c for c in names if c not in sparse]
    if full:
        parts.append(long_form(head, {c: column(c).cast("string") for c in full}, row))
    if sparse:
        key = column(order_by) if order_by else F.monotonically_increasing_id()
        cells = long_form(df, {c: column(c).cast("string") for c in sparse}, key.alias("row"))
        parts.append(top_n(cells, n, F.col("row"), ["column_name"]))
    ranked = [
        part.withColumn(
            "position",
            F.row_number().over(Window.partitionBy("column_name").orderBy("row")).cast("bigint"),
        )
        .filter(F.col("position") <= n)
        .select("column_name", "position", "value")
        for part in parts
    ]
    result = ranked[0] if ranked else spark.createDataFrame(
        [], "column_name string, position bigint, value string"
    )
    for part in ranked[1:]:
        result = result.unionByName(part)
    return result
