"""Which role a column plays, from its name, type and a small evidence row."""

from __future__ import annotations

from dataclasses import dataclass

from tabwise.functions.text import CURRENCY_CODES
from tabwise.plans import vocabulary as v

# Fixed value: share of different values from which on a column is nearly unique.
NEARLY_UNIQUE = 0.98


@dataclass(frozen=True)
class Evidence:
    """What the values of one column showed (counts of values); ``distinct`` is None for "many"."""

    sampled: int = 0
    distinct: int | None = 0
    numbers: int = 0
    dated: int = 0
    dates: int = 0
    short_integers: int = 0
    has_percent: bool = False
    symbol: str | None = None
    nearly_unique: bool | None = None

    def mostly_unique(self) -> bool:
        if self.nearly_unique is not None or self.distinct is None:
            return bool(self.nearly_unique)
        return self.sampled >= 10 and self.distinct / self.sampled >= NEARLY_UNIQUE


@dataclass(frozen=True)
class ColumnRole:
    column_name: str
    position: int
    role: str
    data_type: str
    currency_symbol: str | None
    currency_code: str | None
    is_duration: bool
    unique_count: int | None
    is_numeric: bool


ROLE_SCHEMA = (
    "column_name string, position int, role string, data_type string, currency_symbol string, "
    "currency_code string, is_duration boolean, unique_count bigint, is_numeric boolean"
)


def looks_numeric(kind: str, e: Evidence) -> bool:
    return kind in ("boolean", "integer", "double") or (
        e.sampled > 0 and e.numbers / e.sampled >= 0.80
    )


def looks_datetime(kind: str, e: Evidence) -> bool:
    if kind != "text" or not e.dated:
        return kind == "datetime" and e.sampled > 0
    return e.short_integers / e.dated <= 0.80 and e.dates / e.dated >= 0.75


def weak_identifier(name: str) -> bool:
    """Whether the name makes a nearly unique column an identifier."""
    return any(part in v.name_form(name) for part in v.WEAK_IDENTIFIER)


def decide_role(name: str, position: int, kind: str, data_type: str, e: Evidence) -> ColumnRole:
    """The first role whose test holds, in this order of precedence."""
    form = v.name_form(name)
    numeric = looks_numeric(kind, e)
    duration = v.matches(v.DURATION, form)
    weak_id = weak_identifier(name)
    dated = kind == "datetime" or (
        (v.matches(v.DATETIME, form) or not numeric) and looks_datetime(kind, e)
    )
    tests = {
        "skipped": kind == "nested",
        "identifier": v.matches(v.IDENTIFIER, form) or (weak_id and e.mostly_unique()),
        "datetime": dated and not duration,
        "percentage": e.has_percent or (numeric and v.matches(v.PERCENTAGE, form)),
        "currency": e.symbol is not None or (numeric and v.matches(v.CURRENCY, form)),
        "rating": numeric and v.matches(v.RATING, form),
        "count": numeric and v.matches(v.COUNT, form),
        "measure": numeric and duration,
        "numeric": numeric,
        "categorical": True,
    }
    role = next(r for r, holds in tests.items() if holds)
    symbol = e.symbol if role == "currency" else None
    if role != "identifier":
        numeric = role not in ("datetime", "categorical", "skipped")
    return ColumnRole(
        column_name=name,
        position=position,
        role=role,
        data_type=data_type,
        currency_symbol=symbol,
        currency_code=CURRENCY_CODES.get(symbol),
        is_duration=role == "measure",
        unique_count=e.distinct,
        is_numeric=numeric,
    )
