"""Driver rules for roles, key figures and charts."""

import pytest

from tabwise.plans import charts, kpis
from tabwise.plans.measures import NumericStats
from tabwise.plans.roles import ColumnRole, Evidence, decide_role

NUMBERS = Evidence(sampled=20, distinct=12, numbers=20, dated=20)
WORDS = Evidence(sampled=20, distinct=4, dated=20)


@pytest.mark.parametrize(
    ("name", "kind", "evidence", "role"),
    [
        ("Order ID", "integer", Evidence(sampled=5, distinct=5), "identifier"),
        ("Serial No", "text", Evidence(sampled=20, distinct=20, dated=20), "identifier"),
        ("Serial No", "text", WORDS, "categorical"),
        ("Phone Number", "text", Evidence(sampled=9, distinct=9, dated=9), "categorical"),
        ("order_date", "text", Evidence(sampled=9, distinct=9, dated=9, dates=9), "datetime"),
        ("started", "text", Evidence(sampled=8, distinct=8, dated=8, dates=6), "datetime"),
        ("started", "text", Evidence(sampled=8, distinct=8, dated=8, dates=5), "categorical"),
        ("year", "text", Evidence(8, 8, 8, 8, 8, 8), "numeric"),
        ("order_date", "text", Evidence(8, 8, 8, 8, 8, 8), "numeric"),
        ("call_time", "datetime", Evidence(sampled=8, distinct=8), "categorical"),
        ("created", "datetime", Evidence(), "datetime"),
        ("note", "text", Evidence(sampled=8, distinct=8, dated=8, has_percent=True), "percentage"),
        ("Efficiency in Percentage", "double", NUMBERS, "percentage"),
        ("Vibration_Hz", "double", NUMBERS, "percentage"),
        ("paid", "text", Evidence(sampled=8, distinct=8, dated=8, symbol="€"), "currency"),
        ("feedback_score", "integer", NUMBERS, "currency"),
        ("review score", "integer", NUMBERS, "rating"),
        ("Attended Calls", "integer", NUMBERS, "count"),
        ("Active Time", "double", NUMBERS, "measure"),
        ("Active With Cust", "double", NUMBERS, "measure"),
        ("flag", "boolean", Evidence(sampled=8, distinct=2), "numeric"),
        ("weight", "text", Evidence(sampled=10, distinct=9, numbers=8, dated=10), "numeric"),
        ("weight", "text", Evidence(sampled=10, distinct=9, numbers=7, dated=10), "categorical"),
        ("status", "text", WORDS, "categorical"),
        ("tags", "nested", Evidence(), "skipped"),
        ("empty", "text", Evidence(), "categorical"),
    ],
)
def test_role(name, kind, evidence, role):
    decided = decide_role(name, 0, kind, kind, evidence)
    assert decided.role == role
    assert decided.is_duration == (role == "measure")


def test_currency_code():
    seen = decide_role("x", 0, "text", "string", Evidence(sampled=1, distinct=1, symbol="£"))
    assert (seen.currency_symbol, seen.currency_code) == ("£", "GBP")


def column(name, role, unique=50, symbol=None):
    return ColumnRole(name, 0, role, "double", symbol, None, role == "measure", unique, True)


def stats(low=0.0, high=10.0):
    return NumericStats(10, 50.0, 5.0, 1.0, low, high, 0.0)


def test_figures_by_priority_one_per_column_first():
    roles = [column("a_qty", "count"), column("net_price", "currency", symbol="$"), column("x", "numeric")]
    chosen = kpis.choose(10, kpis.candidates(roles, {r.column_name: stats() for r in roles}))
    assert [(k.label, k.aggregation) for k in chosen] == [
        ("Total Records", "count"), ("Total Net Price", "sum"), ("Total A Qty", "sum"), ("Avg X", "mean"),
    ]
    assert chosen[1].currency_symbol == "$"


def test_figures_fill_up_with_second_picks():
    roles = [column("price", "currency")]
    chosen = kpis.choose(3, kpis.candidates(roles, {"price": stats()}))
    assert [k.label for k in chosen] == ["Total Records", "Total Price", "Avg Price"]


def test_constant_and_unmeasured_columns_offer_nothing():
    roles = [column("price", "currency"), column("name", "categorical"), column("id", "identifier")]
    assert kpis.candidates(roles, {"price": stats(4.0, 4.0)}) == []


def chosen_charts(roles, sizes, varying=None, not_negative=lambda c: True):
    names = {r.column_name for r in roles} if varying is None else varying
    columns = charts.group_columns(roles, sizes, names)
    return [(c.chart_type, c.x_col, c.y_col, c.aggregation) for c in charts.choose_charts(roles, columns, not_negative)]


def test_charts_of_a_sales_table():
    roles = [
        column("date", "datetime"), column("region", "categorical"), column("product", "categorical"),
        column("revenue", "currency"), column("units", "count"),
    ]
    assert chosen_charts(roles, {"region": 4, "product": 8}) == [
        ("line", "date", "revenue", "sum"),
        ("bar", "product", "revenue", "sum"),
        ("pie", "region", "revenue", "sum"),
        ("scatter", "revenue", "units", "raw"),
    ]


def test_ratings_are_averaged_and_negative_measures_get_no_pie():
    roles = [column("team", "categorical"), column("employee_id", "identifier"), column("rating", "rating")]
    assert chosen_charts(roles, {"team": 3}, not_negative=lambda c: False) == [
        ("bar", "team", "rating", "mean"),
        ("bar", "employee_id", "rating", "top10_mean"),
        ("histogram", "rating", None, "histogram"),
    ]


def test_second_middle_category_and_measure():
    roles = [column("a", "categorical"), column("b", "categorical"), column("price", "currency"), column("qty", "count")]
    assert chosen_charts(roles, {"a": 9, "b": 15}) == [
        ("bar", "a", "price", "sum"), ("scatter", "price", "qty", "raw"),
        ("histogram", "price", None, "histogram"), ("bar", "b", "qty", "sum"),
    ]


def test_no_measures_no_charts():
    roles = [column("a", "categorical"), column("n", "numeric")]
    assert chosen_charts(roles, {"a": 3}, varying=set()) == []
