"""Input tables of the registered queries: the given tables and messy text derived from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
]
MESSY_NAMES = [
    "order_id", " Customer  Name ", "amount", "share_pct", "order_date", "units", "status",
]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def messy_orders(spark: SparkSession, folder: str) -> DataFrame:
    """Orders as badly kept text: padding, missing-value words, symbols, repeated rows.

    Finished orders appear twice, so that a large share of the rows are copies.
    """
    orders = table(spark, folder, "orders")
    key = F.col("o_orderkey")

    def but(every: int, word: str | None, otherwise: Column) -> Column:
        return F.when(key % every == 0, F.lit(word)).otherwise(otherwise)

    whole = F.floor("o_totalprice").cast("bigint").cast("string")
    cells = [
        but(97, None, F.concat(F.lit("O-"), key.cast("string"))),
        but(13, "N/A", F.concat(F.lit("  Cust "), F.col("o_custkey").cast("string"), F.lit(" "))),
        but(11, "--", F.concat(F.lit("$"), whole)),
        but(17, "-", F.concat((key % 100).cast("string"), F.lit("%"))),
        but(29, "null", F.date_format("o_orderdate", "yyyy-MM-dd")),
        but(7, "n/a", (F.col("o_custkey") % 50).cast("string")),
        but(19, "?", F.col("o_orderstatus")),
    ]
    named = [c.alias(n) for c, n in zip(cells, MESSY_NAMES)]
    return orders.select(*named).unionByName(
        orders.filter(F.col("o_orderstatus") == "F").select(*named)
    )


_MESSY_CELLS = """
    CASE WHEN o_orderkey % 97 = 0 THEN NULL ELSE concat('O-', o_orderkey) END AS order_id,
    CASE WHEN o_orderkey % 13 = 0 THEN 'N/A' ELSE concat('  Cust ', o_custkey, ' ') END
        AS " Customer  Name ",
    CASE WHEN o_orderkey % 11 = 0 THEN '--'
        ELSE concat('$', CAST(floor(o_totalprice) AS BIGINT)) END AS amount,
    CASE WHEN o_orderkey % 17 = 0 THEN '-' ELSE concat(o_orderkey % 100, '%') END AS share_pct,
    CASE WHEN o_orderkey % 29 = 0 THEN 'null' ELSE strftime(o_orderdate, '%Y-%m-%d') END
        AS order_date,
    CASE WHEN o_orderkey % 7 = 0 THEN 'n/a' ELSE CAST(o_custkey % 50 AS VARCHAR) END AS units,
    CASE WHEN o_orderkey % 19 = 0 THEN '?' ELSE o_orderstatus END AS status"""

MESSY_SQL = f"""messy AS (
  SELECT {_MESSY_CELLS}, 0 AS copy, o_orderkey AS k FROM orders
  UNION ALL
  SELECT {_MESSY_CELLS}, 1 AS copy, o_orderkey AS k FROM orders WHERE o_orderstatus = 'F'
)"""

_TOKENS = "'', 'na', 'n/a', 'null', 'none', '-', '--', 'nan', 'undefined', '?', 'nil'"


def _marked(name: str) -> str:
    return f"""CASE WHEN lower(trim("{name}")) IN ({_TOKENS}) THEN NULL
      ELSE trim("{name}") END AS "{' '.join(name.split())}\""""


# Names and missing tokens repaired.
MARKED_SQL = f"""{MESSY_SQL},
marked AS (SELECT {', '.join(_marked(n) for n in MESSY_NAMES)}, copy, k FROM messy)"""

# Converted by column.
TYPED_SQL = f"""{MARKED_SQL},
typed AS (
  SELECT order_id, "Customer Name",
    TRY_CAST(replace(replace(amount, '$', ''), ',', '') AS DOUBLE) AS amount,
    TRY_CAST(replace(share_pct, '%', '') AS DOUBLE) / 100 AS share_pct,
    TRY_CAST(order_date AS TIMESTAMP) AS order_date,
    TRY_CAST(replace(units, ',', '') AS DOUBLE) AS units,
    status, copy, k
  FROM marked)"""


def _smallest_mode(name: str) -> str:
    return f"""(SELECT "{name}" FROM typed WHERE "{name}" IS NOT NULL
      GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)"""


FILL_SQL = f"""{TYPED_SQL},
fill AS (
  SELECT {_smallest_mode("Customer Name")} AS customer, {_smallest_mode("status")} AS status,
    {_smallest_mode("order_date")} AS order_date,
    (SELECT median(amount) FROM typed) AS amount, (SELECT median(share_pct) FROM typed) AS share_pct,
    (SELECT median(units) FROM typed) AS units)"""

FILLED_SQL = f"""{FILL_SQL},
filled AS (
  SELECT coalesce(t.order_id, 'Unknown') AS order_id,
    coalesce(t."Customer Name", f.customer) AS "Customer Name",
    coalesce(t.amount, f.amount) AS amount, coalesce(t.share_pct, f.share_pct) AS share_pct,
    coalesce(t.order_date, f.order_date) AS order_date, coalesce(t.units, f.units) AS units,
    coalesce(t.status, f.status) AS status
  FROM typed t, fill f)"""

CLEANED_SQL = f"{FILLED_SQL}, cleaned AS (SELECT DISTINCT * FROM filled)"

# Measures of the wide table.
WIDE = 100


def wide_cells() -> list[tuple[str, str]]:
    """Derived measures of line items, every fifth with gaps, as (name, SQL)."""
    cells = []
    for i in range(WIDE):
        value = f"CAST((l_partkey * {i + 3} + l_suppkey * {i % 9} + l_linenumber) % {11 + i} AS DOUBLE)"
        gap = f"CASE WHEN l_linenumber <> {i % 7 + 1} THEN {value} END" if i % 5 == 0 else value
        cells.append((f"v{i}", gap))
    return cells
