"""SQL counterparts of the registered queries, for any engine that speaks DuckDB's dialect."""

from __future__ import annotations

from catalog.inputs import (
    CLEANED_SQL, FILL_SQL, MARKED_SQL, MESSY_NAMES, MESSY_SQL, TABLES, TYPED_SQL, WIDE,
    wide_cells,
)
from tabwise.plans import vocabulary as v

ORACLES: dict[str, str] = {}

CLEAN_NAMES = [" ".join(n.split()) for n in MESSY_NAMES]

# Columns of the test tables by kind: w = whole number, d = double, t = text, m = moment, n = nested.
COLUMNS = {
    "region": "r_regionkey:w r_name:t",
    "nation": "n_nationkey:w n_name:t n_regionkey:w",
    "customer": "c_custkey:w c_name:t c_nationkey:w c_acctbal:d c_mktsegment:t",
    "supplier": "s_suppkey:w s_name:t s_nationkey:w s_acctbal:d",
    "part": "p_partkey:w p_name:t p_brand:t p_type:t p_size:w p_retailprice:d",
    "orders": "o_orderkey:w o_custkey:w o_orderstatus:t o_totalprice:d o_orderdate:m "
    "o_orderpriority:t",
    "lineitem": "l_orderkey:w l_partkey:w l_suppkey:w l_linenumber:w l_quantity:d "
    "l_extendedprice:d l_discount:d l_tax:d l_returnflag:t l_linestatus:t l_shipdate:m",
    "events": "event_id:w ts:m user_id:w event_type:t value:d props:t",
    "documents": "doc_id:w text:t lang:t source:t n_chars:w",
    "labels": "doc_id:w quality:w toxic:w",
    "pages": "page_id:w url:t html:t",
    "benchmark": "item_id:w text:t",
    "conversations": "conv_id:w turn:w role:t text:t",
    "embeddings": "vec_id:w embedding:n label:w",
}
TYPE_NAMES = {
    "r_regionkey": "int", "n_nationkey": "int", "n_regionkey": "int", "c_nationkey": "int",
    "s_nationkey": "int", "p_size": "int", "l_linenumber": "int", "quality": "int", "toxic": "int",
    "label": "int", "embedding": "array<float>",
}
KIND_TYPES = {"w": "bigint", "d": "double", "t": "string", "m": "timestamp_ntz"}


def columns_of(table: str) -> list[tuple[str, str]]:
    return [tuple(c.split(":")) for c in COLUMNS[table].split()]


def type_name(column: str, kind: str) -> str:
    return TYPE_NAMES.get(column) or KIND_TYPES[kind]


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def union(parts: list[str]) -> str:
    return "\nUNION ALL\n".join(parts)


NUMBER = r"(?i)^\s*[+-]?(\d+\.?\d*(e[+-]?\d+)?|\.\d+(e[+-]?\d+)?|inf|infinity)\s*$"
DATE = r"^\d{4}(-\d{1,2}(-\d{1,2}([ T]\d{1,2}:\d{1,2}(:\d{1,2}(\.\d{1,9})?)?)?)?)?$"
MESSY_KINDS = [(n, "t") for n in CLEAN_NAMES]

# --- sources and sinks -----------------------------------------------------------------------

_CSV_NULLS = "'', 'N/A', 'NA', 'NULL', 'NaN', 'None', 'n/a', 'nan', 'null'"


def _loaded(name: str) -> str:
    kept = f'CASE WHEN "{name}" IN ({_CSV_NULLS}) THEN NULL ELSE "{name}" END'
    return f"CAST({kept} AS DOUBLE) AS units" if name == "units" else (
        f'{kept} AS "{" ".join(name.split())}"'
    )


ORACLES["load_csv"] = f"WITH {MESSY_SQL} SELECT {', '.join(map(_loaded, MESSY_NAMES))} FROM messy"
ORACLES["load_csv_line_breaks"] = f"""
SELECT doc_id, {", ".join(f"CASE WHEN {c} NOT IN ({_CSV_NULLS}) THEN {c} END AS {c}" for c in ("text", "lang", "source"))}
FROM documents"""
ORACLES["load_csv_mixed"] = """
SELECT o_orderkey, concat('Café ', o_orderpriority) AS place, o_totalprice FROM orders"""
ORACLES["infer_types"] = """
SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice,
  CAST(o_orderdate AS VARCHAR) AS o_orderdate, o_orderpriority FROM orders"""
ORACLES["audit_files"] = union(
    [
        f"SELECT '{t}' AS table_name, true AS valid, count(*) AS rows, {len(columns_of(t))} AS columns,"
        f" 'utf-8' AS encoding, ',' AS delimiter FROM {t}"
        for t in ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"]
    ]
)


def _rank() -> str:
    parts = []
    for i, t in enumerate(TABLES):
        cells = " + ".join(
            rf"count({c}) FILTER (regexp_matches({c}, '\S'))" if kind == "t" else f"count({c})"
            for c, kind in columns_of(t)
        )
        wide = len(columns_of(t))
        form = v.matches(v.PENALISED_TABLES, t), v.matches(v.FAVOURED_TABLES, t)
        parts.append(
            f"SELECT '{t}' AS table_name, {i} AS position, (SELECT count(*) + 1 FROM {t}) AS rows, "
            f"{wide} AS active_columns, ({cells} + {wide}) / ((count(*) + 1) * {wide}) AS d, "
            f"{wide >= 3} AS header_detected, {-75 * form[0] + 35 * form[1]} AS named "
            f"FROM {t}"
        )
    return f"""
WITH parts AS ({union(parts)}),
scored AS (
  SELECT *, CASE WHEN rows <= 2 THEN -150 WHEN rows < 10 THEN 2 * rows
      WHEN rows < 100 THEN 30 + 0.5 * rows ELSE 80 + least(0.05 * rows, 50) END
    + CASE WHEN active_columns <= 1 THEN -100 WHEN active_columns = 2 THEN -20
      WHEN active_columns <= 30 THEN 40 + 1.5 * active_columns ELSE 50 END
    + CASE WHEN d < 0.15 THEN -60 WHEN d > 0.5 THEN 40 * d ELSE 0 END
    + CASE WHEN header_detected THEN 25 ELSE 0 END + named AS score
  FROM parts)
SELECT table_name, position, rows, active_columns, round(d, 3) AS non_empty_ratio, header_detected,
  CAST(round(score, 3) AS DOUBLE) AS score,
  row_number() OVER (ORDER BY score DESC, position) = 1 AS selected
FROM scored"""


ORACLES["rank_tables"] = _rank()
ORACLES["export_cleaned"] = """
SELECT o.*, format('Cleaned Data — {:,} rows', n) AS title
FROM orders o, (SELECT count(*) AS n FROM orders)"""
ORACLES["preview_original"] = """
SELECT k.*, md5(concat_ws('|', l_orderkey, l_linenumber, l_partkey, l_suppkey)) AS row_key,
  format('Original Data — {:,} rows', n) AS title
FROM lineitem k, (SELECT count(*) AS n FROM lineitem)"""
ORACLES["output_cells"] = """
SELECT event_id, CASE WHEN event_type = 'error' THEN NULL ELSE value END AS value,
  CAST(ts AS VARCHAR) AS ts, event_type FROM events"""
ORACLES["report_bundle"] = f"""
WITH {CLEANED_SQL}
SELECT true AS valid, CAST(NULL AS VARCHAR) AS error,
  'dashboard, cleaned_data, cleaning_report, original_data, chart_data' AS tables,
  (SELECT count(*) FROM messy) AS original_rows,
  (SELECT count(*) FROM cleaned) AS cleaned_rows"""

# --- cleaning --------------------------------------------------------------------------------

_RENAMED = ", ".join(f'"{n}" AS "{" ".join(n.split())}"' for n in MESSY_NAMES)
_NAMES = ", ".join(f'"{n}"' for n in CLEAN_NAMES)
ORACLES["clean_names"] = f"WITH {MESSY_SQL} SELECT {_RENAMED} FROM messy"
ORACLES["clean_tokens"] = f"WITH {MARKED_SQL} SELECT {_NAMES} FROM marked"
ORACLES["missing_before"] = f"WITH {MARKED_SQL} " + union(
    [
        f'SELECT {quoted(n)} AS column_name, count(*) - count("{n}") AS null_count FROM marked'
        for n in CLEAN_NAMES
    ]
)
ORACLES["keep_identifiers"] = """
SELECT CAST(event_id AS VARCHAR) AS event_id, ts, CAST(user_id AS VARCHAR) AS user_id, event_type,
  value, props FROM events"""
ORACLES["parse_percentages"] = f"""
WITH {TYPED_SQL} SELECT order_id, round(share_pct, 6) AS share_pct FROM typed"""
ORACLES["rescale_percentages"] = """
SELECT l_orderkey, round(l_discount * 100 / 100, 6) AS discount_pct FROM lineitem"""
ORACLES["parse_currencies"] = f"WITH {TYPED_SQL} SELECT order_id, amount FROM typed"
ORACLES["parse_dates"] = """
SELECT o_orderkey, CAST(strftime(o_orderdate, '%Y-%m-%d') AS TIMESTAMP) AS order_date FROM orders"""
ORACLES["parse_datetimes"] = """
SELECT event_id, CASE WHEN event_id % 7 = 6 THEN NULL WHEN event_id % 7 = 5 THEN date_trunc('day', ts)
  ELSE date_trunc('second', ts) END::TIMESTAMP AS event_time FROM events"""
ORACLES["parse_numbers"] = f"WITH {TYPED_SQL} SELECT order_id, units FROM typed"


def _median_text(name: str) -> str:
    return (
        f"(SELECT format('Imputed {{}} missing values with median ({{:.2f}})', "
        f"count(*) - count(t.{name}), any_value(f.{name})) FROM typed t, fill f)"
    )


def _mode_text(name: str, filler: str) -> str:
    return (
        f"(SELECT format('Imputed {{}} missing values with mode (''{{}}'')', "
        f'count(*) - count(t."{name}"), any_value(f.{filler})) FROM typed t, fill f)'
    )


ORACLES["imputation"] = f"""
WITH {FILL_SQL}
SELECT * FROM (VALUES
  (1, 'order_id', 'Filled with ''Unknown'' (ID column)'),
  (2, 'Customer Name', {_mode_text("Customer Name", "customer")}),
  (3, 'amount', {_median_text("amount")}),
  (4, 'share_pct', {_median_text("share_pct")}),
  (5, 'order_date', (SELECT format('Imputed {{}} missing dates with mode ({{}})',
      count(*) - count(t.order_date), any_value(CAST(f.order_date AS VARCHAR)))
      FROM typed t, fill f)),
  (6, 'units', {_median_text("units")}),
  (7, 'status', {_mode_text("status", "status")})
) AS t(position, column_name, method)"""
ORACLES["clean_table"] = f"""
WITH {CLEANED_SQL} SELECT * REPLACE (round(share_pct, 6) AS share_pct) FROM cleaned"""
ORACLES["distinct_documents"] = "SELECT DISTINCT text, lang, source FROM documents"
_GAPS = " + ".join(f'count(*) - count("{n}")' for n in CLEAN_NAMES)
ORACLES["cleaning_metrics"] = f"""
WITH {CLEANED_SQL},
c AS (SELECT (SELECT count(*) FROM messy) AS b, (SELECT count(*) FROM cleaned) AS a,
  (SELECT {_GAPS} FROM marked) AS gaps)
SELECT 1 AS position, 'Total Rows' AS metric, b AS value_before, a AS value_after,
  a - b AS net_change FROM c
UNION ALL SELECT 2, 'Total Columns', 7, 7, 0
UNION ALL SELECT 3, 'Duplicate Rows', b - a, 0, a - b FROM c
UNION ALL SELECT 4, 'Missing / Null Values', gaps, 0, -gaps FROM c"""
ORACLES["cleaning_conversions"] = f"""
WITH {TYPED_SQL}, c AS (SELECT count(amount) AS n FROM typed)
SELECT p.* FROM c, (VALUES (1, 'Numeric Conversions', 'units'),
  (2, 'Datetime Conversions', 'order_date'), (3, 'Percentage Conversions', 'share_pct'),
  (4, 'Currency Conversions', 'amount ($)'), (5, 'Preserved ID Columns', 'order_id'))
  AS p(position, category, details) WHERE n > 0"""
ORACLES["cleaning_actions"] = f"""
WITH {CLEANED_SQL},
c AS (SELECT (SELECT count(*) FROM messy) - (SELECT count(*) FROM cleaned) AS copies,
  (SELECT 100.0 * count(t.units) / count(m.units) FROM marked m, typed t
    WHERE m.k = t.k AND m.copy = t.copy) AS numeric_share)
SELECT 1 AS position, 'Preserved identifier columns as clean text: order_id' AS action
UNION ALL SELECT 2, 'Parsed currency column ''amount'' with symbol ''$''.'
UNION ALL SELECT 3, 'Converted percentage column ''share_pct'' from text to decimal ratio.'
UNION ALL SELECT 4, 'Coerced ''order_date'' to datetime timestamps.'
UNION ALL SELECT 5, format('Coerced ''units'' to numeric ({{:.1f}}% numeric-like).', numeric_share)
  FROM c
UNION ALL SELECT 6, format('Removed {{}} exact duplicate rows.', copies) FROM c"""
ORACLES["dataset_summary"] = f"""
WITH {CLEANED_SQL}
SELECT (SELECT count(*) FROM cleaned) AS total_rows, 7 AS total_columns,
  (SELECT count(*) FROM messy) - (SELECT count(*) FROM cleaned) AS duplicate_rows,
  (SELECT {_GAPS} FROM marked) AS missing_values_cleaned"""

# --- roles -----------------------------------------------------------------------------------

ORACLES["first_values_orders"] = union(
    [
        f"SELECT '{c}' AS column_name, row_number() OVER (ORDER BY o_orderkey) AS position, "
        f"CAST({c} AS VARCHAR) AS value FROM orders WHERE {c} IS NOT NULL "
        "QUALIFY row_number() OVER (ORDER BY o_orderkey) <= 500"
        for c, _ in columns_of("orders")
    ]
)


def _evidence(source: str, name: str, kind: str) -> str:
    """Evidence of all values of one column; ``n_values`` counts the different ones."""
    readable = "count(*) FILTER (WHERE regexp_matches(trim({}), '" + NUMBER + "'))"
    loose = readable.format("regexp_replace(v, '[,%₹$€£]', '', 'g')")
    percents, currencies = readable.format("replace(v, '%', '')"), readable.format("regexp_replace(v, '[,₹$€£]', '', 'g')")
    symbol = " ".join(f"WHEN {currencies} >= 0.8 * count(*) AND bool_or(contains(v, '{s}')) THEN '{s}'" for s in "₹$€£")
    tests = (
        f"""{loose} AS numbers, count(*) AS dated,
    count(*) FILTER (WHERE regexp_matches(trim(v), '{DATE}') AND TRY_CAST(trim(v) AS TIMESTAMP) IS NOT NULL)
      AS dates,
    count(*) FILTER (WHERE regexp_matches(trim(v), '^\\d{{1,4}}$')) AS short_integers,
    bool_or(contains(v, '%')) AND {percents} >= 0.8 * count(*) AS has_percent, CASE {symbol} END AS symbol"""
        if kind == "t"
        else """0 AS numbers, 0 AS dated, 0 AS dates, 0 AS short_integers, false AS has_percent,
    CAST(NULL AS VARCHAR) AS symbol"""
    )
    weak = "true" if any(w in v.name_form(name) for w in v.WEAK_IDENTIFIER) else "false"
    return f"""
  SELECT {quoted(name)} AS column_name, count(*) AS sampled,
    CASE WHEN count(DISTINCT v) <= {v.MANY_VALUES} THEN count(DISTINCT v) END AS "distinct", {tests},
    {weak} AND count(*) >= 10 AND count(DISTINCT v) >= 0.98 * count(*) AS nearly_unique
  FROM (SELECT CAST("{name}" AS VARCHAR) AS v FROM {source}) WHERE v IS NOT NULL HAVING count(*) > 0"""


def _has(patterns: list[str]) -> str:
    return f"regexp_matches(form, {quoted('|'.join(patterns))})"


def _roles(columns: list[tuple[str, str]], source: str, ctes: str = "") -> str:
    evidence = union([_evidence(source, n, k) for n, k in columns if k != "n"])
    listed = ", ".join(
        f"({quoted(n)}, {i}, '{k}', {quoted(type_name(n, k))})" for i, (n, k) in enumerate(columns)
    )
    return f"""
WITH {ctes + ", " if ctes else ""}evidence AS ({evidence}),
columns AS (SELECT *, replace(lower(trim(column_name)), ' ', '_') AS form
  FROM (VALUES {listed}) AS c(column_name, position, kind, data_type)),
facts AS (
  SELECT c.*, CASE WHEN sampled > 0 THEN "distinct" ELSE 0 END AS "distinct", symbol,
    nearly_unique, has_percent, kind IN ('w', 'd') OR coalesce(numbers >= 0.8 * sampled AND sampled > 0, false)
      AS looks_numeric,
    kind = 'm' OR coalesce(kind = 't' AND dated > 0 AND short_integers <= 0.8 * dated
      AND dates >= 0.75 * dated, false) AS looks_dated
  FROM columns c LEFT JOIN evidence e ON e.column_name = c.column_name),
decided AS (
  SELECT *, CASE WHEN kind = 'n' THEN 'skipped'
    WHEN {_has(v.IDENTIFIER)} OR nearly_unique THEN 'identifier'
    WHEN NOT {_has(v.DURATION)} AND looks_dated
      AND (kind = 'm' OR NOT looks_numeric OR {_has(v.DATETIME)}) THEN 'datetime'
    WHEN has_percent OR ({_has(v.PERCENTAGE)} AND looks_numeric) THEN 'percentage'
    WHEN symbol IS NOT NULL OR ({_has(v.CURRENCY)} AND looks_numeric) THEN 'currency'
    WHEN {_has(v.RATING)} AND looks_numeric THEN 'rating'
    WHEN {_has(v.COUNT)} AND looks_numeric THEN 'count'
    WHEN {_has(v.DURATION)} AND looks_numeric THEN 'measure'
    WHEN looks_numeric THEN 'numeric' ELSE 'categorical' END AS role
  FROM facts)
SELECT column_name, position, role, data_type,
  CASE WHEN role = 'currency' THEN symbol END AS currency_symbol,
  CASE WHEN role = 'currency' THEN CASE symbol WHEN '₹' THEN 'INR' WHEN '$' THEN 'USD'
    WHEN '€' THEN 'EUR' WHEN '£' THEN 'GBP' END END AS currency_code,
  role = 'measure' AS is_duration, "distinct" AS unique_count,
  CASE WHEN role = 'identifier' THEN looks_numeric
    ELSE role NOT IN ('datetime', 'categorical', 'skipped') END AS is_numeric
FROM decided"""


_NAMED_SQL = f"{MESSY_SQL}, named AS (SELECT {_RENAMED}, copy, k FROM messy)"
ORACLES["role_evidence"] = f"WITH {_NAMED_SQL} " + union([_evidence("named", n, "t") for n in CLEAN_NAMES])
ORACLES["roles_messy"] = _roles(MESSY_KINDS, "named", _NAMED_SQL)
_CLEANED_KINDS = [
    ("order_id", "t"), ("Customer Name", "t"), ("amount", "d"), ("share_pct", "d"),
    ("order_date", "m"), ("units", "d"), ("status", "t"),
]
ORACLES["roles_cleaned"] = _roles(_CLEANED_KINDS, "cleaned", CLEANED_SQL)
for _t in TABLES:
    ORACLES[f"roles_{_t}"] = _roles(columns_of(_t), _t)

# --- validation and statistics ---------------------------------------------------------------


def _validate(columns: list[tuple[str, str]], source: str, ctes: str = "") -> str:
    facts = union(
        [
            f"""SELECT {quoted(n)} AS column_name, {i} AS position,
      {quoted(type_name(n, k))} AS data_type, count(*) - count("{n}") AS null_count, count(*) AS rows,
      count(DISTINCT "{n}") AS n_values, {k == "t"} AS is_text, lower({quoted(n)}) AS form
      FROM {source}"""
            for i, (n, k) in enumerate(columns)
        ]
    )
    name = f"regexp_matches(form, {quoted('|'.join(v.VALIDATION_IDENTIFIER))})"
    return f"""
WITH {ctes + ", " if ctes else ""}facts AS ({facts})
SELECT column_name, position, data_type, null_count, null_count = rows AS fully_empty,
  n_values + CASE WHEN null_count > 0 THEN 1 ELSE 0 END <= 1 AS constant,
  CASE WHEN is_text THEN n_values END AS distinct_count,
  {name} OR (is_text AND rows > 5 AND n_values = rows) AS potential_id,
  is_text AND NOT {name} AND n_values > 5
    AND (n_values > 50 OR (rows > 10 AND n_values / rows > 0.5)) AS high_cardinality
FROM facts"""


def _summary(columns: list[tuple[str, str]], source: str, ctes: str = "") -> str:
    names = ", ".join(f'"{n}"' for n, _ in columns)
    gaps = " + ".join(f'count(*) - count("{n}")' for n, _ in columns)
    return f"""
{"WITH " + ctes if ctes else ""}
SELECT count(*) AS total_rows, {len(columns)} AS total_columns, {gaps} AS missing_values_total,
  count(*) - (SELECT count(*) FROM (SELECT DISTINCT {names} FROM {source})) AS duplicate_rows
FROM {source}"""


for _t in ["customer", "orders", "lineitem", "documents", "events"]:
    ORACLES[f"validate_{_t}"] = _validate(columns_of(_t), _t)
for _t in ["orders", "lineitem", "documents", "pages"]:
    ORACLES[f"table_summary_{_t}"] = _summary(columns_of(_t), _t)
ORACLES["validate_messy"] = _validate(MESSY_KINDS, "marked", MARKED_SQL)
ORACLES["table_summary_messy"] = _summary(MESSY_KINDS, "marked", MARKED_SQL)
ORACLES["missing_summary"] = f"WITH {MARKED_SQL} " + union(
    [
        f"""SELECT {quoted(n)} AS column_name, {i} AS position, count(*) - count("{n}") AS null_count,
  CAST(format('{{:.2f}}', (count(*) - count("{n}")) / count(*) * 100) AS DOUBLE) AS null_percentage
  FROM marked"""
        for i, n in enumerate(CLEAN_NAMES)
    ]
)


def _measured(table: str) -> list[tuple[str, str]]:
    """Numeric columns that are not identifiers by name."""
    return [
        (c, k) for c, k in columns_of(table) if k in "wd" and not v.matches(v.IDENTIFIER, c)
    ]


def _describe(table: str) -> str:
    return union(
        [
            f"""SELECT '{c}' AS column_name, count({c}) AS count, round(avg({c}), 6) AS mean,
  round(coalesce(stddev_samp({c}), 0), 6) AS std, round(CAST(min({c}) AS DOUBLE), 6) AS min,
  round(CAST(quantile_cont({c}, 0.25) AS DOUBLE), 6) AS q25,
  round(CAST(quantile_cont({c}, 0.5) AS DOUBLE), 6) AS median,
  round(CAST(quantile_cont({c}, 0.75) AS DOUBLE), 6) AS q75,
  round(CAST(max({c}) AS DOUBLE), 6) AS max, round(coalesce(skewness({c}), 0), 6) AS skewness
FROM {table}"""
            for c, _ in _measured(table)
        ]
    )


def _top(table: str) -> str:
    key = "CASE WHEN length({c}) > 64 THEN '#' || sha256({c}) ELSE {c} END"
    return union(
        [
            f"""SELECT '{c}' AS column_name, unique_count, CAST(rank AS INTEGER) AS rank, value, count,
  CAST(format('{{:.2f}}', count / (SELECT count(*) FROM {table}) * 100) AS DOUBLE) AS percentage
FROM (SELECT {c} AS value, count(*) AS count, count(*) OVER () AS unique_count,
    row_number() OVER (ORDER BY count(*) DESC, {key.format(c=c)}) AS rank
  FROM {table} WHERE {c} IS NOT NULL GROUP BY {c}) WHERE rank <= 10"""
            for c, k in columns_of(table)
            if k == "t"
        ]
    )


def _histograms(table: str) -> str:
    parts = []
    for c, k in _measured(table):
        whole = "greatest(width, 1)" if k == "w" else "width"
        parts.append(
            f"""SELECT '{c}' AS column_name, CAST(b AS INTEGER) AS bin, round(left_edge, 2) AS bin_left,
  round(right_edge, 2) AS bin_right, (SELECT count(*) FROM {table} WHERE {c} >= left_edge
    AND ({c} < right_edge OR (b = bins - 1 AND {c} <= right_edge))) AS count
FROM (SELECT b, bins, low + b * ((high - low) / bins) AS left_edge,
    CASE WHEN b = bins - 1 THEN high ELSE low + (b + 1) * ((high - low) / bins) END AS right_edge
  FROM (SELECT *, unnest(range(CAST(bins AS BIGINT))) AS b
    FROM (SELECT *, least(ceil((high - low) / {whole}), 10) AS bins
      FROM (SELECT *, least(greatest(2 * (q75 - q25) * pow(n, -1.0 / 3), (high - low) / sqrt(n) / 2),
          (high - low) / (log2(n) + 1)) AS width
        FROM (SELECT CAST(min({c}) AS DOUBLE) AS low, CAST(max({c}) AS DOUBLE) AS high,
            count({c}) AS n, count(DISTINCT {c}) AS n_values, quantile_cont({c}, 0.25) AS q25,
            quantile_cont({c}, 0.75) AS q75 FROM {table})
        WHERE n >= 5 AND n_values > 2))))"""
        )
    empty = (
        "SELECT '' AS column_name, 0 AS bin, 0.0::DOUBLE AS bin_left, 0.0::DOUBLE AS bin_right, "
        "0::BIGINT AS count WHERE false"
    )
    return union([*parts, empty])


def _correlations(columns: list[str], source: str, ctes: str = "") -> str:
    varying = union(
        [f"SELECT '{c}' AS c, count(DISTINCT {c}) > 1 AS varies FROM {source}" for c in columns]
    )
    pairs = union(
        [
            f"SELECT '{a}' AS column_a, '{b}' AS column_b, "
            + ("any_value(1.0::DOUBLE)" if a == b else f"corr({a}, {b})")
            + f" AS r FROM {source}"
            for a in columns
            for b in columns
        ]
    )
    return f"""
WITH {ctes + ", " if ctes else ""}varying AS ({varying}), pairs AS ({pairs})
SELECT column_a, column_b,
  CASE WHEN r IS NULL OR isnan(r) THEN 0.0 ELSE round(r, 3) END AS correlation
FROM pairs p JOIN varying a ON a.c = p.column_a AND a.varies JOIN varying b ON b.c = p.column_b
  AND b.varies"""


for _t in ["orders", "lineitem", "part", "events"]:
    ORACLES[f"describe_{_t}"] = _describe(_t)
for _t in ["orders", "events", "documents", "conversations"]:
    ORACLES[f"top_categories_{_t}"] = _top(_t)
for _t in ["orders", "lineitem", "part", "labels"]:
    ORACLES[f"histograms_{_t}"] = _histograms(_t)
for _t in ["lineitem", "part"]:
    ORACLES[f"correlations_{_t}"] = _correlations([c for c, _ in _measured(_t)], _t)
ORACLES["correlations_with_gaps"] = _correlations(
    [c for c, _ in _measured("lineitem")],
    "gaps",
    """gaps AS (SELECT * REPLACE (CASE WHEN l_linenumber <> 3 THEN l_tax END AS l_tax,
    CASE WHEN l_linenumber <> 5 THEN l_discount END AS l_discount) FROM lineitem)""",
)

def _wide_correlations() -> str:
    pairs = [(i, j) for i in range(WIDE) for j in range(i + 1, WIDE)]
    listed = ", ".join(f"corr(v{i}, v{j})" for i, j in pairs)
    names = [", ".join(f"'v{p[k]}'" for p in pairs) for k in (0, 1)]
    return f"""
WITH wide AS (SELECT {", ".join(f"{x} AS {n}" for n, x in wide_cells())} FROM lineitem),
pairs AS (SELECT unnest([{names[0]}]) AS a, unnest([{names[1]}]) AS b, unnest([{listed}]) AS r FROM wide),
rounded AS (SELECT a, b, CASE WHEN r IS NULL OR isnan(r) THEN 0.0 ELSE round(r, 3) END AS correlation FROM pairs)
SELECT a AS column_a, b AS column_b, correlation FROM rounded
UNION ALL SELECT b, a, correlation FROM rounded
UNION ALL SELECT 'v' || i, 'v' || i, 1.0 FROM range({WIDE}) AS t(i)"""


ORACLES["correlations_wide"] = _wide_correlations()

# --- key figures -----------------------------------------------------------------------------

# The role of each measure of the test tables, as the role queries give it.
_MEASURE_ROLES = {
    "lineitem": [
        ("l_orderkey", "numeric"), ("l_partkey", "numeric"), ("l_suppkey", "numeric"),
        ("l_linenumber", "numeric"), ("l_quantity", "count"), ("l_extendedprice", "currency"),
        ("l_discount", "count"), ("l_tax", "numeric"),
    ],
    "orders": [("o_orderkey", "numeric"), ("o_custkey", "numeric"), ("o_totalprice", "currency")],
    "events": [("value", "numeric")],
    "part": [("p_partkey", "numeric"), ("p_size", "numeric"), ("p_retailprice", "currency")],
}
_FIGURES = {
    "currency": [("sum", "Total", 90), ("avg", "Avg", 75)],
    "percentage": [("avg", "Avg", 85)],
    "count": [("sum", "Total", 78)],
    "numeric": [("avg", "Avg", 60)],
}


def _offered(measures: list[tuple[str, str]], source: str, symbol: str = "₹") -> str:
    parts = []
    for place, (c, role) in enumerate(measures):
        for turn, (function, word, priority) in enumerate(_FIGURES[role]):
            money = quoted(symbol) if role == "currency" else "NULL"
            label = f"{word} {v.title_case(c)}"
            how = "sum" if function == "sum" else "mean"
            parts.append(
                f"SELECT '{label}' AS label, CAST({function}({c}) AS DOUBLE) AS value, '{role}' AS role,"
                f" '{c}' AS column_name, '{how}' AS aggregation, {money} AS currency_symbol,"
                f" {priority} AS priority, {place} AS place, {turn} AS turn FROM {source}"
                f" HAVING count(DISTINCT {c}) > 1"
            )
    return union(parts)


def _select_kpis(offered: str, source: str, ctes: str = "") -> str:
    return f"""
WITH {ctes + ", " if ctes else ""}offered AS ({offered}),
ranked AS (SELECT *, row_number() OVER (PARTITION BY column_name ORDER BY priority DESC, turn) > 1
    AS repeated FROM offered),
chosen AS (
  SELECT 1 AS rank, 'Total Records' AS label, CAST(count(*) AS DOUBLE) AS value, 'count' AS role,
    CAST(NULL AS VARCHAR) AS column_name, 'count' AS aggregation,
    CAST(NULL AS VARCHAR) AS currency_symbol, CAST(NULL AS INTEGER) AS priority FROM {source}
  UNION ALL
  SELECT 1 + row_number() OVER (ORDER BY repeated, priority DESC, place, turn), label, value, role,
    column_name, aggregation, currency_symbol, priority FROM ranked)
SELECT * REPLACE (round(value, 2) AS value),
  CASE role WHEN 'percentage' THEN format('{{:.2f}}%', value * 100)
    WHEN 'currency' THEN currency_symbol || format('{{:,.2f}}', value)
    WHEN 'count' THEN format('{{:,}}', CAST(round_even(value, 0) AS BIGINT))
    ELSE CASE WHEN value = floor(value) THEN format('{{:,}}', CAST(value AS BIGINT))
      ELSE format('{{:,.2f}}', value) END END AS formatted_value,
  CASE role WHEN 'percentage' THEN '0.00%'
    WHEN 'currency' THEN '"' || currency_symbol || '"#,##0.00' WHEN 'count' THEN '#,##0'
    ELSE '#,##0.00' END AS number_format
FROM chosen WHERE rank <= 4"""


for _t in ["lineitem", "orders"]:
    ORACLES[f"kpi_candidates_{_t}"] = (
        "SELECT * EXCLUDE (place, turn) REPLACE (round(value, 2) AS value) "
        f"FROM ({_offered(_MEASURE_ROLES[_t], _t)})"
    )
for _t in ["lineitem", "orders", "events", "part"]:
    ORACLES[f"select_kpis_{_t}"] = _select_kpis(_offered(_MEASURE_ROLES[_t], _t), _t)
_CLEANED_MEASURES = [("amount", "currency"), ("share_pct", "percentage"), ("units", "count")]
ORACLES["select_kpis_cleaned"] = _select_kpis(
    _offered(_CLEANED_MEASURES, "cleaned", "$"), "cleaned", CLEANED_SQL
)
ORACLES["number_formats"] = f"""
SELECT column_name, role, CASE role WHEN 'currency' THEN '"₹"#,##0.00' WHEN 'count' THEN '#,##0'
  WHEN 'percentage' THEN '0.00%' ELSE '#,##0.00' END AS number_format
FROM ({ORACLES["roles_lineitem"]})"""

# --- charts ----------------------------------------------------------------------------------

ORACLES["category_sizes"] = union(
    [
        f"SELECT '{c}' AS column_name, count(DISTINCT {c}) AS distinct_count FROM part"
        for c, k in columns_of("part")
        if k == "t"
    ]
)


def _specs(source: str, rows: list[tuple]) -> str:
    """Expected charts, each with the condition on the data that the rules ask for."""
    parts = []
    for i, (kind, title, x, y, how, text, condition) in enumerate(rows, start=1):
        y_col = quoted(y) if y else "CAST(NULL AS VARCHAR)"
        parts.append(
            f"SELECT 'chart_{i}' AS chart_id, '{kind}' AS chart_type, {quoted(title)} AS title, "
            f"'{x}' AS x_col, {y_col} AS y_col, '{how}' AS aggregation, {quoted(text)} AS description "
            f"FROM {source} HAVING {condition}"
        )
    return union(parts)


ORACLES["chart_specs_orders"] = _specs(
    "orders",
    [
        ("line", "O Totalprice Over Time", "o_orderdate", "o_totalprice", "sum",
         "Time series trend of o_totalprice across o_orderdate.", "count(o_orderdate) > 0"),
        ("bar", "Total O Totalprice by O Orderstatus", "o_orderstatus", "o_totalprice", "sum",
         "Comparison of o_totalprice across o_orderstatus categories.",
         "count(DISTINCT o_orderstatus) BETWEEN 2 AND 6"),
        ("pie", "O Totalprice Distribution by O Orderpriority", "o_orderpriority", "o_totalprice",
         "sum", "Proportional share of o_totalprice across o_orderpriority segments.",
         "count(DISTINCT o_orderpriority) BETWEEN 2 AND 6 AND min(o_totalprice) >= 0"),
        ("scatter", "O Orderkey vs O Totalprice", "o_totalprice", "o_orderkey", "raw",
         "Correlation relationship between o_totalprice and o_orderkey.",
         "count(DISTINCT o_orderkey) > 1"),
    ],
)
ORACLES["chart_specs_lineitem"] = _specs(
    "lineitem",
    [
        ("line", "L Extendedprice Over Time", "l_shipdate", "l_extendedprice", "sum",
         "Time series trend of l_extendedprice across l_shipdate.", "count(l_shipdate) > 0"),
        ("bar", "Total L Extendedprice by L Returnflag", "l_returnflag", "l_extendedprice", "sum",
         "Comparison of l_extendedprice across l_returnflag categories.",
         "count(DISTINCT l_returnflag) BETWEEN 2 AND 6"),
        ("pie", "L Extendedprice Distribution by L Linestatus", "l_linestatus", "l_extendedprice",
         "sum", "Proportional share of l_extendedprice across l_linestatus segments.",
         "count(DISTINCT l_linestatus) BETWEEN 2 AND 6 AND min(l_extendedprice) >= 0"),
        ("scatter", "L Quantity vs L Extendedprice", "l_extendedprice", "l_quantity", "raw",
         "Correlation relationship between l_extendedprice and l_quantity.",
         "count(DISTINCT l_quantity) > 1"),
    ],
)
ORACLES["chart_specs_events"] = _specs(
    "events",
    [
        ("line", "Value Over Time", "ts", "value", "sum", "Time series trend of value across ts.",
         "count(ts) > 0"),
        ("bar", "Total Value by Event Type", "event_type", "value", "sum",
         "Comparison of value across event_type categories.",
         "count(DISTINCT event_type) BETWEEN 2 AND 6"),
        ("pie", "Value Distribution by Event Type", "event_type", "value", "sum",
         "Proportional share of value across event_type segments.", "min(value) >= 0"),
        ("bar", "Top 10 Propss by Value", "props", "value", "top10_sum",
         "Leaderboard ranking top 10 props performers by value.", "count(DISTINCT props) > 20"),
    ],
)
ORACLES["chart_specs_part"] = _specs(
    "part",
    [
        ("bar", "Total P Retailprice by P Type", "p_type", "p_retailprice", "sum",
         "Comparison of p_retailprice across p_type categories.",
         "count(DISTINCT p_type) BETWEEN 2 AND 6"),
        ("pie", "P Retailprice Distribution by P Type", "p_type", "p_retailprice", "sum",
         "Proportional share of p_retailprice across p_type segments.", "min(p_retailprice) >= 0"),
        ("bar", "Top 10 P Names by P Retailprice", "p_name", "p_retailprice", "top10_sum",
         "Leaderboard ranking top 10 p_name performers by p_retailprice.",
         "count(DISTINCT p_name) > 20"),
        ("scatter", "P Partkey vs P Retailprice", "p_retailprice", "p_partkey", "raw",
         "Correlation relationship between p_retailprice and p_partkey.",
         "count(DISTINCT p_partkey) > 1"),
    ],
)


def _chart(grouped: str, place: str, limit: int | None = None, cte: str = "") -> str:
    """Numbered rows of a chart table; ``grouped`` gives category and value."""
    return f"""
WITH {cte + ", " if cte else ""}grouped AS ({grouped}),
kept AS (SELECT * FROM grouped{f' ORDER BY {place} LIMIT {limit}' if limit else ''})
SELECT 'chart_1' AS chart_id, CAST(row_number() OVER (ORDER BY
    {place}) AS INTEGER) AS position,
  category, round(value, 2) AS value FROM kept"""


_DAY = "strftime({}, '%Y-%m-%d')"
_LARGEST = "value DESC, category"
ORACLES["chart_line"] = _chart(
    f"SELECT {_DAY.format('o_orderdate')} AS category, sum(o_totalprice) AS value FROM orders GROUP BY 1",
    "category",
)
ORACLES["chart_line_mean"] = _chart(
    f"SELECT {_DAY.format('ts')} AS category, avg(value) AS value FROM events GROUP BY 1",
    "category",
)
ORACLES["chart_line_text"] = _chart(
    f"""SELECT {_DAY.format('order_date')} AS category, sum(amount) AS value FROM typed
  WHERE order_date IS NOT NULL AND amount IS NOT NULL GROUP BY 1""",
    "category", cte=TYPED_SQL,
)
ORACLES["chart_bar"] = _chart(
    "SELECT l_returnflag AS category, sum(l_extendedprice) AS value FROM lineitem GROUP BY 1",
    _LARGEST,
)
ORACLES["chart_bar_many"] = _chart(
    "SELECT p_brand AS category, avg(p_retailprice) AS value FROM part GROUP BY 1", _LARGEST
)
ORACLES["chart_top10"] = _chart(
    """SELECT CAST(l_partkey AS VARCHAR) AS category, sum(l_extendedprice) AS value FROM lineitem
  GROUP BY 1""",
    _LARGEST, 10,
)
ORACLES["chart_pie"] = _chart(
    "SELECT event_type AS category, sum(value) AS value FROM events GROUP BY 1", _LARGEST
)
ORACLES["chart_scatter"] = """
WITH drawn AS (
  SELECT o_totalprice AS x, CAST(o_custkey AS DOUBLE) AS y FROM orders
  ORDER BY md5(concat(o_orderkey, '42')) LIMIT 100)
SELECT 'chart_1' AS chart_id, CAST(row_number() OVER (ORDER BY x, y) AS INTEGER) AS position,
  CAST(x AS VARCHAR) AS category, round(y, 2) AS value FROM drawn"""
ORACLES["chart_histogram"] = """
WITH ends AS (SELECT min(l_extendedprice) AS low, max(l_extendedprice) AS high FROM lineitem),
bins AS (SELECT b, low + b * ((high - low) / 8) AS left_edge,
    CASE WHEN b = 7 THEN high ELSE low + (b + 1) * ((high - low) / 8) END AS right_edge
  FROM (SELECT *, unnest(range(8)) AS b FROM ends))
SELECT 'chart_1' AS chart_id, CAST(b + 1 AS INTEGER) AS position,
  format('{:.1f}-{:.1f}', left_edge, right_edge) AS category,
  CAST((SELECT count(*) FROM lineitem WHERE l_extendedprice >= left_edge AND (l_extendedprice
    < right_edge OR (b = 7 AND l_extendedprice <= right_edge))) AS DOUBLE) AS value FROM bins"""
ORACLES["chart_no_data"] = """
SELECT 'chart_1' AS chart_id, 1 AS position, 'No Data' AS category, 0.0::DOUBLE AS value
FROM documents HAVING count(TRY_CAST(source AS DOUBLE)) = 0"""
ORACLES["chart_pie_limited"] = f"""
WITH grouped AS (SELECT p_brand AS category, sum(p_retailprice) AS value FROM part GROUP BY 1),
placed AS (SELECT *, row_number() OVER (ORDER BY {_LARGEST}) AS place FROM grouped)
SELECT 'chart_1' AS chart_id, CAST(least(place, 7) AS INTEGER) AS position,
  CASE WHEN place > 6 THEN 'Other' ELSE category END AS category, round(sum(value), 2) AS value
FROM placed GROUP BY ALL"""
ORACLES["chart_line_limited"] = _chart(
    f"SELECT {_DAY.format('o_orderdate')} AS category, sum(o_totalprice) AS value FROM orders GROUP BY 1 ORDER BY 1 DESC LIMIT 30",
    "category",
)
ORACLES["chart_ranges"] = """
SELECT 'chart_1' AS chart_id, count(DISTINCT CAST(o_orderdate AS DATE)) AS row_count FROM orders
UNION ALL SELECT 'chart_2', count(DISTINCT o_orderstatus) FROM orders
UNION ALL SELECT 'chart_3', count(DISTINCT o_orderpriority) FROM orders
UNION ALL SELECT 'chart_4', least((SELECT count(*) FROM orders), 100)"""


# --- whole analysis --------------------------------------------------------------------------

_CLEANED_CHARTS = _specs(
    "cleaned",
    [
        ("line", "Amount Over Time", "order_date", "amount", "sum",
         "Time series trend of amount across order_date.", "count(order_date) > 0"),
        ("bar", "Total Amount by Status", "status", "amount", "sum",
         "Comparison of amount across status categories.", "count(DISTINCT status) BETWEEN 2 AND 6"),
        ("pie", "Amount Distribution by Status", "status", "amount", "sum",
         "Proportional share of amount across status segments.", "min(amount) >= 0"),
        ("bar", "Top 10 Customer Names by Amount", "Customer Name", "amount", "top10_sum",
         "Leaderboard ranking top 10 Customer Name performers by amount.",
         'count(DISTINCT "Customer Name") > 20'),
    ],
)
ORACLES["analyze_dashboard"] = f"""
WITH {CLEANED_SQL},
figures AS ({_select_kpis(_offered(_CLEANED_MEASURES, "cleaned", "$"), "cleaned")}),
totals AS (SELECT (SELECT count(*) FROM cleaned) AS kept, (SELECT count(*) FROM messy) AS given,
  (SELECT {_GAPS} FROM marked) AS gaps),
summary AS (SELECT unnest([1, 2, 3, 4]) AS position, unnest(['Total Rows', 'Total Columns',
    'Duplicate Rows Removed', 'Missing Values Cleaned']) AS label,
  unnest([kept, 7, given - kept, gaps]) AS n FROM totals),
charts AS ({_CLEANED_CHARTS})
SELECT 'kpi' AS section, CAST(rank AS INTEGER) AS position, label, value, formatted_value AS text,
  role, number_format FROM figures
UNION ALL SELECT 'summary', position, label, CAST(n AS DOUBLE), format('{{:,}}', n), 'count', '#,##0'
FROM summary
UNION ALL SELECT 'chart', CAST(right(chart_id, 1) AS INTEGER), title, NULL, description, chart_type,
  NULL FROM charts"""
