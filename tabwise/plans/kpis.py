"""Which key figures a table gets."""

from __future__ import annotations

from dataclasses import dataclass

from tabwise.functions.display import DEFAULT_SYMBOL
from tabwise.plans.measures import NumericStats
from tabwise.plans.roles import ColumnRole
from tabwise.plans.vocabulary import title_case

# Role -> the figures it offers as (aggregation, priority).
FIGURES = {
    "currency": [("sum", 90), ("mean", 75)],
    "percentage": [("mean", 85)],
    "rating": [("mean", 80)],
    "count": [("sum", 78)],
    "measure": [("mean", 70)],
    "numeric": [("mean", 60)],
}
# The words that open a figure's label.
LABELS = {"sum": "Total", "mean": "Avg"}


@dataclass(frozen=True)
class Kpi:
    label: str
    value: float
    role: str
    column_name: str | None
    aggregation: str
    currency_symbol: str | None
    priority: int | None


def candidates(
    roles: list[ColumnRole],
    stats: dict[str, NumericStats],
    symbols: dict[str, str] | None = None,
) -> list[Kpi]:
    """Figures offered by the columns that vary, in column order.

    ``symbols`` are currency symbols known from cleaning; a number column carries none itself.
    """
    offered = []
    for role in roles:
        s = stats.get(role.column_name)
        if s is None or s.low == s.high:
            continue
        money = role.role == "currency"
        known = role.currency_symbol or (symbols or {}).get(role.column_name)
        for aggregation, priority in FIGURES.get(role.role, []):
            offered.append(
                Kpi(
                    label=f"{LABELS[aggregation]} {title_case(role.column_name)}",
                    value=s.total if aggregation == "sum" else s.mean,
                    role="numeric" if role.role == "measure" else role.role,
                    column_name=role.column_name,
                    aggregation=aggregation,
                    currency_symbol=(known or DEFAULT_SYMBOL) if money else None,
                    priority=priority,
                )
            )
    return offered


def choose(rows: int, offered: list[Kpi], k: int = 4) -> list[Kpi]:
    """Total records, then the best figure of each column, then what is left, up to ``k``."""
    ranked = sorted(offered, key=lambda kpi: -kpi.priority)
    seen: set[str] = set()
    best, rest = [], []
    for kpi in ranked:
        (rest if kpi.column_name in seen else best).append(kpi)
        seen.add(kpi.column_name)
    total = Kpi("Total Records", float(rows), "count", None, "count", None, None)
    return [total, *best, *rest][:k]
