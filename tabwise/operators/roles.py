"""Role detection: evidence of each column, from all of its values or a sample, then the role rules."""

from __future__ import annotations

from dataclasses import astuple

from pyspark.sql import Column, DataFrame, functions as F

from tabwise.functions import parse
from tabwise.functions.text import CURRENCY_CODES, LONG_TEXT, grouping_key, strip
from tabwise.operators.frames import at_once, column, is_numeric, kinds, local_frame, long_form
from tabwise.operators.frequency import distinct_counts
from tabwise.operators.samples import first_values
from tabwise.plans import vocabulary as v
from tabwise.plans.roles import (
    NEARLY_UNIQUE, ROLE_SCHEMA, ColumnRole, Evidence, decide_role, weak_identifier,
)

_EVIDENCE_SCHEMA = (
    "column_name string, sampled bigint, distinct bigint, numbers bigint, dated bigint, dates bigint, "
    "short_integers bigint, has_percent boolean, symbol string, nearly_unique boolean"
)


def role_evidence(
    df: DataFrame, sample_size: int | None = None, order_by: str | None = None
) -> DataFrame:
    """One row per column that has values: what all of them, or the first ``sample_size``, look like.

    Of a sample, ``symbol`` and ``has_percent`` look at the first 50, ``dated``, ``dates`` and
    ``short_integers`` at the first 30. Text parsing is only tried on text columns. For all values
    see `whole_evidence`.
    """
    if sample_size is None:
        return whole_evidence(df)
    texts = [c for c, k in kinds(df).items() if k == "text"]
    value, position = F.col("value"), F.col("position")
    is_text = F.col("column_name").isin(texts) if texts else F.lit(False)
    early = is_text & (position <= v.SYMBOL_SAMPLE)
    dated = is_text & (position <= v.DATE_SAMPLE)
    symbol = F.lit(None).cast("string")
    for s in reversed(CURRENCY_CODES):
        symbol = F.when(F.max(early & value.contains(s)), F.lit(s)).otherwise(symbol)
    return (
        first_values(df, sample_size, order_by)
        .groupBy("column_name")
        .agg(
            F.count(value).alias("sampled"),
            F.count_distinct(value).alias("distinct"),
            F.count_if(is_text & parse.loose_number(value).isNotNull()).alias("numbers"),
            F.count_if(dated).alias("dated"),
            F.count_if(dated & parse.timestamp(value).isNotNull()).alias("dates"),
            F.count_if(dated & strip(value).rlike(r"^\d{1,4}$")).alias("short_integers"),
            F.max(early & value.contains("%")).alias("has_percent"),
            symbol.alias("symbol"),
        )
    )


_SIGNS = ["%", *CURRENCY_CODES]
_TESTS = ["numbers", "dates", "short_integers", "percents", "currencies", *[f"sign{i}" for i in range(len(_SIGNS))]]


def _tests(text: Column) -> Column:
    """What a text can be read as, NULL for NULL.

    As functions of an array element the tests stay out of the generated method, which would be too
    large for the JVM to compile.
    """

    def read(value: Column) -> Column:
        numeric = F.when(value.rlike("[0-9]|(?i:inf)"), parse.loose_number(value).isNotNull())
        signed = value.rlike("[%₹$€£]")
        return F.struct(value.alias("text"), F.coalesce(numeric, F.lit(False)).alias("number"), signed.alias("signed"))

    def tried(seen: Column) -> Column:
        value, number = seen["text"], seen["number"]
        # Every spelling of a date has a year of four digits, and none is long.
        dated = F.when((F.length(value) <= LONG_TEXT) & value.rlike("[0-9]{4}"), parse.timestamp(value).isNotNull())
        results = [
            number, dated, value.rlike(r"^\d{1,4}$"),
            # What is a number without all signs is one without some if it has none of the others.
            number & ~value.rlike("[,₹$€£]"), number & ~value.contains("%"),
            *[seen["signed"] & value.contains(s) for s in _SIGNS],
        ]
        return F.struct(*[x.alias(t) for t, x in zip(_TESTS, results)])

    return F.when(text.isNotNull(), F.get(F.transform(F.transform(F.array(strip(text)), read), tried), F.lit(0)))


def whole_evidence(df: DataFrame, min_ratio: float = 0.80) -> DataFrame:
    """The evidence of all values of each column, without a shuffle of cells.

    One aggregate counts the values and keeps a sketch of the different ones; a task sends a row per
    column. Columns with few values are then counted by value, which tasks reduce to these, and only
    the values are tested; the cells of the other text columns are tested where they are read. Counted
    exactly is also what a weak identifier's name and the sketch together make worth it. ``distinct`` is
    NULL for more than ``MANY_VALUES``. A sign anywhere counts if ``min_ratio`` of the column's values can
    be read with it, as in cleaning; otherwise one ``%`` would make a column of texts a percentage.
    """
    by_kind = {c: k for c, k in kinds(df).items() if k != "nested"}
    names = list(by_kind)
    if not names:
        return local_frame(df.sparkSession, [], _EVIDENCE_SCHEMA)
    keys = {c: F.xxhash64(column(c)) for c in names}
    sketched = long_form(df, {c: F.when(column(c).isNotNull(), keys[c]) for c in names}, numbered=True)
    sketch = F.approx_count_distinct("value", 0.02).alias("about")
    seen = {
        names[r["column_number"]]: r
        for r in sketched.groupBy("column_number").agg(F.count("value").alias("n"), sketch).collect()
    }
    few = [c for c, r in seen.items() if r["about"] <= 2 * v.MANY_VALUES]
    many = [c for c in seen if c not in few and by_kind[c] == "text"]
    open_ids = [c for c, r in seen.items() if c not in few and weak_identifier(c) and r["about"] >= 0.9 * r["n"]]
    by_value, by_cell, exact = at_once(
        df.sparkSession,
        lambda: _tested_values(df, few, keys, by_kind),
        lambda: _tested_cells(df, many),
        lambda: distinct_counts(df, open_ids),
    )
    rows = []
    for c, r in seen.items():
        n, got = r["n"], by_value.get(c) or by_cell.get(c) or {}
        count = {t: got.get(t) or 0 for t in _TESTS}
        distinct = exact.get(c, got.get("distinct"))
        symbols = [s for i, s in enumerate(_SIGNS) if i and count[f"sign{i}"]]
        rows.append(
            (
                c, n, distinct if distinct is not None and distinct <= v.MANY_VALUES else None, count["numbers"],
                n if by_kind[c] == "text" else 0, count["dates"], count["short_integers"],
                count["sign0"] > 0 and count["percents"] >= min_ratio * n,
                symbols[0] if symbols and count["currencies"] >= min_ratio * n else None,
                weak_identifier(c) and distinct is not None and n >= 10 and distinct >= NEARLY_UNIQUE * n,
            )
        )
    return local_frame(df.sparkSession, rows, _EVIDENCE_SCHEMA)


def _tested_values(
    df: DataFrame, columns: list[str], keys: dict[str, Column], by_kind: dict[str, str]
) -> dict[str, dict[str, int]]:
    """Counts of the tests and ``distinct`` of columns with few values; only texts are tested."""
    if not columns:
        return {}
    nothing = F.lit(None).cast("string")
    entries = []
    for i, c in enumerate(columns):
        text = by_kind[c] == "text"
        key = F.when(column(c).isNotNull(), F.lit(0) if text else keys[c])
        value = grouping_key(column(c)) if text else nothing
        entries.append(F.struct(F.lit(i).alias("at"), key.cast("bigint").alias("key"), value.alias("value")))
    counted = (
        df.select(F.inline(F.array(*entries)))
        .filter("key IS NOT NULL")
        .groupBy("at", "key", "value")
        .agg(F.count(F.lit(1)).alias("n"))
        .select("at", "n", (F.length("value") > LONG_TEXT).alias("long"), _tests(F.col("value")).alias("t"))
    )
    sums = [F.sum(F.when(F.col(f"t.{t}"), F.col("n"))).alias(t) for t in _TESTS]
    distinct, long = F.count(F.lit(1)).alias("distinct"), F.max("long").alias("long")
    found = {columns[r["at"]]: r.asDict() for r in counted.groupBy("at").agg(distinct, long, *sums).collect()}
    # A long text takes part as its digest, which tells nothing about the text.
    for c, again in _tested_cells(df, [c for c, r in found.items() if r["long"]]).items():
        found[c].update(again)
    return found


def _tested_cells(df: DataFrame, columns: list[str]) -> dict[str, dict[str, int]]:
    """Counts of the tests of text columns with many values."""
    if not columns:
        return {}
    cells = long_form(df, {c: column(c) for c in columns}, numbered=True)
    tested = cells.select("column_number", _tests(F.col("value")).alias("t"))
    sums = [F.count_if(F.col(f"t.{t}")).alias(t) for t in _TESTS]
    rows = tested.groupBy("column_number").agg(*sums).collect()
    return {columns[r["column_number"]]: r.asDict() for r in rows}


def infer_roles(
    df: DataFrame, sample_size: int | None = None, order_by: str | None = None
) -> list[ColumnRole]:
    """Roles of all columns as Python objects, in column order."""
    found = {
        row["column_name"]: Evidence(**{k: x for k, x in row.asDict().items() if k != "column_name"})
        for row in role_evidence(df, sample_size, order_by).collect()
    }
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    return [
        decide_role(name, i, kind, types[name], found.get(name, Evidence()))
        for i, (name, kind) in enumerate(kinds(df).items())
    ]


def identifier_roles(df: DataFrame) -> list[ColumnRole]:
    """Roles of the numeric identifiers. Values are only looked at where the name leaves it open."""
    by_kind = {c: k for c, k in kinds(df).items() if is_numeric(k)}
    clear = [c for c in by_kind if v.matches(v.IDENTIFIER, v.name_form(c))]
    open_ids = [c for c in by_kind if c not in clear and weak_identifier(c)]
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    found = [decide_role(c, df.columns.index(c), by_kind[c], types[c], Evidence()) for c in clear]
    found += infer_roles(df.select(*map(column, open_ids))) if open_ids else []
    return [r for r in found if r.role == "identifier"]


def detect_roles(
    df: DataFrame, sample_size: int | None = None, order_by: str | None = None
) -> DataFrame:
    """Roles of all columns as a DataFrame."""
    return roles_frame(df, infer_roles(df, sample_size, order_by))


def roles_frame(df: DataFrame, roles: list[ColumnRole]) -> DataFrame:
    return local_frame(df.sparkSession, [astuple(r) for r in roles], ROLE_SCHEMA)


def as_roles(
    df: DataFrame, roles: list[ColumnRole] | DataFrame | None, order_by: str | None = None
) -> list[ColumnRole]:
    """Roles given as objects, as a roles DataFrame, or (None) detected now."""
    if roles is None:
        return infer_roles(df, order_by=order_by)
    if isinstance(roles, DataFrame):
        rows = roles.orderBy("position").collect()
        return [ColumnRole(**row.asDict()) for row in rows]
    return roles
