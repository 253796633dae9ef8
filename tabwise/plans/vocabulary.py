"""The name patterns and limits that the decisions depend on."""

import re

# Regular expressions searched in a column name (lower case, spaces as "_").
DURATION = [
    "active.*time", "response.*time", "hold.*time", "call.*time", "wait.*time", "elapsed.*time",
    "time.*spent", "duration", "handle.*time", "tat", "turnaround.*time", "cycle.*time",
    "lead.*time", "active_with_cust", "talk_time", "wrap_up_time",
]
DATETIME = [
    "^date$", ".*_date$", "^dob$", "^timestamp$", "^created_?at$", "^updated_?at$",
    "^order_?date$", "^sale_?date$", "^purchase_?date$", "^ship_?date$", "^due_?date$", "datetime",
]
PERCENTAGE = [
    "percent", "percentage", "pct", "%", "rate$", "efficiency", "ratio", "margin_pct",
    "share_pct", "proportion",
]
CURRENCY = [
    "revenue", "profit", "sales", "price", "cost", "salary", "amount", "spend", "budget", "fee",
    "earning", "income", "mrr", "arr", "commission",
]
RATING = ["rating", "score", "csat", "nps", "stars", "feedback", "grade", "evaluation"]
COUNT = [
    "count", "quantity", "qty", "units", "orders", "calls", "attended", "visits", "clicks",
    "tickets", "items", "sessions", "views", "inventory",
]
IDENTIFIER = [
    "^id$", ".*_id$", "^code$", ".*_code$", "^uuid$", "^key$", "^sku$", "^barcode$",
    "^account_?no$", "^invoice_?no$", "^employee_?id$", "^customer_?id$", "^order_?id$",
    "^booking_?id$", "^transaction_?id$",
]
# Parts of a name that make an almost unique column an identifier.
WEAK_IDENTIFIER = ["identifier", "serial", "reference", "ref_no", "number"]
# The validation report's own identifier names (stripped, lower case).
VALIDATION_IDENTIFIER = [
    "^id$", ".*_id$", "^.*_code$", "^code$", "^uuid$", "^key$", "^num$", "^number$",
    "^employee.*", "^emp_.*", "^customer.*", "^order.*id.*", "^transaction.*id.*",
    "^invoice.*", "^ticket.*", "^account.*",
]
# Parts of a name that mark a numeric column as holding percent numbers.
PERCENT_NUMBER = ["percentage", "pct", "%"]
# Parts of an identifier's name that allow a ranking chart over it.
RANKABLE_IDENTIFIER = ["employee", "emp", "agent", "product", "item", "rep"]
# Table names that lose or gain points when candidate tables are ranked.
PENALISED_TABLES = [
    "dashboard", "summary", "report", "chart", "pivot", "notes?", "cover", "intro", "readme",
    "config", "metadata", "overview", "kpis?",
]
FAVOURED_TABLES = [
    "raw", "data", "records?", "transactions?", "details?", "sales", "orders?", "master",
    "table", "main",
]

# Of a sample of each column, how many values are looked at for signs and for dates.
SYMBOL_SAMPLE = 50
DATE_SAMPLE = 30
# Up to so many different values of a column are counted exactly; what has more has "many".
MANY_VALUES = 1000


def name_form(name: str) -> str:
    """The form of a column name that the patterns are searched in."""
    return name.strip().lower().replace(" ", "_")


def matches(patterns: list[str], text: str) -> bool:
    return any(re.search(p, text) for p in patterns)


def title_case(name: str) -> str:
    return name.replace("_", " ").title()
