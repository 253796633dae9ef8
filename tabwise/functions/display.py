"""Display text and number formats of key figures, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

DEFAULT_SYMBOL = "₹"

# Role names that share one display style.
PERCENT_ROLES = ["percentage", "rate", "ratio", "efficiency"]
CURRENCY_ROLES = ["currency", "revenue", "profit", "sales", "cost"]
RATING_ROLES = ["rating", "score", "csat", "nps"]
COUNT_ROLES = ["count", "records", "orders", "quantity", "units", "calls"]


def _pattern(value: Column, pattern: str) -> Column:
    # DecimalFormat rounds the exact binary value half-even, which is the wanted rounding.
    return F.call_function("format_number", value, F.lit(pattern))


def format_kpi(value: Column, role: Column, symbol: Column) -> Column:
    """``72.00%``, ``₹1,250.00``, ``4.50``, ``1,450`` or a plain number, by role."""
    role = F.lower(role)
    number = value.cast("double")
    plain = F.when(number == F.floor(number), F.format_number(number, 0)).otherwise(
        F.format_number(number, 2)
    )
    return (
        F.when(number.isNull(), F.lit("N/A"))
        .when(role.isin(PERCENT_ROLES), F.concat(_pattern(number * 100, "0.00"), F.lit("%")))
        .when(
            role.isin(CURRENCY_ROLES),
            F.concat(F.coalesce(symbol, F.lit(DEFAULT_SYMBOL)), F.format_number(number, 2)),
        )
        .when(role.isin(RATING_ROLES), _pattern(number, "0.00"))
        .when(role.isin(COUNT_ROLES), F.format_number(F.rint(number), 0))
        .otherwise(plain)
    )


def number_format(role: Column, symbol: Column) -> Column:
    """Spreadsheet format code of a role."""
    role = F.lower(role)
    money = F.concat(
        F.lit('"'), F.coalesce(symbol, F.lit(DEFAULT_SYMBOL)), F.lit('"#,##0.00')
    )
    return (
        F.when(role.isin(PERCENT_ROLES), F.lit("0.00%"))
        .when(role.isin(CURRENCY_ROLES), money)
        .when(role.isin(RATING_ROLES), F.lit("0.00"))
        .when(role.isin(COUNT_ROLES), F.lit("#,##0"))
        .otherwise(F.lit("#,##0.00"))
    )


def export_safe(c: Column, data_type: str) -> Column:
    """Value as an output table stores it: NaN becomes NULL, zoned timestamps become text."""
    if data_type in ("double", "float"):
        return F.when(~F.isnan(c), c)
    if data_type == "timestamp":
        return c.cast("string")
    return c
