"""Key figures: one aggregate for all of them, then a choice on the driver."""

from __future__ import annotations

from dataclasses import astuple

from pyspark.sql import DataFrame, functions as F

from tabwise.functions.display import format_kpi, number_format
from tabwise.operators.frames import local_frame
from tabwise.operators.profile import profile
from tabwise.operators.roles import as_roles
from tabwise.plans import kpis
from tabwise.plans.measures import TableProfile
from tabwise.plans.roles import ColumnRole

_FIGURE_SCHEMA = (
    "label string, value double, role string, column_name string, aggregation string, "
    "currency_symbol string, priority int"
)


def _measured(df: DataFrame, roles: list[ColumnRole], measured: TableProfile | None) -> TableProfile:
    if measured is not None:
        return measured
    return profile(df, [r.column_name for r in roles if r.role in kpis.FIGURES], nulls=False)


def kpi_candidates(
    df: DataFrame,
    roles: list[ColumnRole] | DataFrame | None = None,
    measured: TableProfile | None = None,
    symbols: dict[str, str] | None = None,
) -> DataFrame:
    """Every figure the columns offer, with its priority."""
    roles = as_roles(df, roles)
    offered = kpis.candidates(roles, _measured(df, roles, measured).numeric, symbols)
    return local_frame(df.sparkSession, [astuple(k) for k in offered], _FIGURE_SCHEMA)


def select_kpis(
    df: DataFrame,
    roles: list[ColumnRole] | DataFrame | None = None,
    k: int = 4,
    measured: TableProfile | None = None,
    symbols: dict[str, str] | None = None,
) -> DataFrame:
    """Up to ``k`` figures in rank order, with display text and number format."""
    roles = as_roles(df, roles)
    found = _measured(df, roles, measured)
    chosen = kpis.choose(found.rows, kpis.candidates(roles, found.numeric, symbols), k)
    rows = [(i, *astuple(kpi)) for i, kpi in enumerate(chosen, start=1)]
    role, symbol = F.col("role"), F.col("currency_symbol")
    return local_frame(df.sparkSession, rows, f"rank int, {_FIGURE_SCHEMA}").withColumns(
        {
            "formatted_value": format_kpi(F.col("value"), role, symbol),
            "number_format": number_format(role, symbol),
        }
    )
