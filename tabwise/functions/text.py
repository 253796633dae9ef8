"""Text expressions used by cleaning and role detection."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Every character that counts as white space when a cell is stripped (all lie below U+3001).
WHITESPACE = "".join(ch for ch in map(chr, range(0x3001)) if ch.isspace())

# Cell texts (stripped, lower case) that the cleaner reads as missing.
MISSING_TOKENS = ["", "na", "n/a", "null", "none", "-", "--", "nan", "undefined", "?", "nil"]

# White space at either end, as a regular expression.
PADDING = f"[{WHITESPACE}]*"

# Cell texts a CSV load reads as missing (exact spelling).
CSV_NULL_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]

# Recognised currency symbols in order of precedence, with their codes.
CURRENCY_CODES = {"₹": "INR", "$": "USD", "€": "EUR", "£": "GBP"}

# Texts longer than this are grouped by their SHA-256, so that counting distinct values of a
# long-text column shuffles 65 bytes per row and not the texts.
LONG_TEXT = 64


def strip(c: Column) -> Column:
    """Remove white space at both ends.

    Most cells begin and end with a printable ASCII character; comparing these two is cheaper than
    looking every end up in the whole set.
    """
    clean = _printable(c) & _printable(F.substring(c, -1, 1))
    return F.when(clean, c).otherwise(F.btrim(c, F.lit(WHITESPACE)))


def _printable(c: Column) -> Column:
    """Whether text begins with a character from ``!`` to ``~``."""
    return (c >= F.lit("!")) & (c < F.lit("\x7f"))


def token_to_null(stripped: Column) -> Column:
    """Stripped text, or NULL where it is a missing-value token.

    The argument is used three times, so strip in a projection of its own.
    """
    longer = F.length(stripped) > max(map(len, MISSING_TOKENS))
    return F.when(longer | ~F.lower(stripped).isin(MISSING_TOKENS), stripped)


def grouping_key(c: Column) -> Column:
    """The text itself, or ``#`` + SHA-256 for a long one (65 characters, so never ambiguous)."""
    return F.when(F.length(c) > LONG_TEXT, F.concat(F.lit("#"), F.sha2(c, 256))).otherwise(c)


def collapse_spaces(name: str) -> str:
    """Column-name form: stripped, runs of white space become one space, case kept."""
    return " ".join(name.split())
