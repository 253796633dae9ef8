"""Tolerant parsers. Each returns NULL for text it cannot read and never raises in ANSI mode.

They are written as chains in which every step uses the one before once: Spark substitutes
expressions into each other, so a step that is used twice would double the generated code.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from tabwise.functions.text import CURRENCY_CODES, PADDING, WHITESPACE

# try_cast also takes Java spellings ('1d', '1f', hex floats); the pattern keeps those as text.
_NUMBER = rf"(?i)^{PADDING}[+-]?(\d+\.?\d*(e[+-]?\d+)?|\.\d+(e[+-]?\d+)?|inf|infinity){PADDING}$"
_WHOLE = rf"^{PADDING}([+-]?\d+){PADDING}$"
_SYMBOLS = "".join(CURRENCY_CODES)

_CLOCK = r"( \d{1,2}:\d{1,2}(?::\d{1,2}(?:\.\d{1,9})?)?)?"
_ISO = r"^\d{4}(-\d{1,2}(-\d{1,2}([ T]\d{1,2}:\d{1,2}(:\d{1,2}(\.\d{1,9})?)?)?)?)?$"
# Spellings and their ISO form. With the year last the month comes first if that is possible.
_REWRITES = [
    (r"^(\d{4})(\d{2})(\d{2})$", "$1-$2-$3"),
    (rf"^(\d{{4}})/(\d{{1,2}})/(\d{{1,2}}){_CLOCK}$", "$1-$2-$3$4"),
    (rf"^(0?[1-9]|1[0-2])[/.-](\d{{1,2}})[/.-](\d{{4}}){_CLOCK}$", "$3-$1-$2$4"),
    (rf"^(\d{{1,2}})[/.-](\d{{1,2}})[/.-](\d{{4}}){_CLOCK}$", "$3-$2-$1$4"),
    (rf"^(\d{{1,2}})[ -]([A-Za-z]{{3,9}})[ -](\d{{4}}){_CLOCK}$", "$3-$2-$1$4"),
    (rf"^([A-Za-z]{{3,9}}) (\d{{1,2}}),? (\d{{4}}){_CLOCK}$", "$3-$1-$2$4"),
]
# Whether any of them is there: most text is no date, and the rewrites are dear.
_SPELLED = "|".join(pattern for pattern, _ in _REWRITES)
# The English month names and their short forms.
_MONTHS = [
    "jan(uary)?", "feb(ruary)?", "mar(ch)?", "apr(il)?", "may", "june?", "july?", "aug(ust)?",
    "sept?(ember)?", "oct(ober)?", "nov(ember)?", "dec(ember)?",
]

# Other spellings by their parts: weekday, day, clock of 12 or 24 hours, zone. A year of two digits
# follows strokes or dashes, so that version numbers stay text.
_DAY = (
    r"\d{4}[/-]\d{1,2}[/-]\d{1,2}|\d{1,2}[/-]\d{1,2}[/-]\d{2}|\d{1,2}[/.-]\d{1,2}[/.-]\d{4}"
    r"|\d{1,2}[ -][a-z]{3,9}[ -]\d{4}|[a-z]{3,9} \d{1,2},? \d{4}"
)
_PARTS = (
    r"(?i)^(?:(?:mon|tue|tues|wed|wednes|thu|thur|thurs|fri|sat|satur|sun)(?:day)?,? +)?"
    rf"({_DAY})(?:(?:T|,? +)(\d{{1,2}})(?::([0-5]\d))?(?::([0-5]\d(?:\.\d{{1,9}})?))?"
    r" *(?:([ap])\.?m\.?)?(?: *(z|utc|gmt|[+-]\d{2}:?[0-5]\d))?)?$"
)


def number(c: Column) -> Column:
    """Text to double. Only text of the right form is cast, for a failing cast is slow."""
    return F.when(c.rlike(_NUMBER), F.btrim(c, F.lit(WHITESPACE)).try_cast("double"))


def whole_number(c: Column) -> Column:
    """Text of digits to bigint. Text of another form is not cast, for a failing cast is slow."""
    return F.nullif(F.regexp_extract(c, _WHOLE, 1), F.lit("")).try_cast("bigint")


def _without(c: Column, characters: str) -> Column:
    for ch in characters:
        c = F.replace(c, F.lit(ch), F.lit(""))
    return c


def plain_number(c: Column) -> Column:
    """Text with thousands commas to double."""
    return number(_without(c, ","))


def percent_number(c: Column) -> Column:
    """``'25%'`` to 0.25. Commas are not removed."""
    return number(_without(c, "%")) / F.lit(100.0)


def currency_number(c: Column) -> Column:
    """``'₹1,500.00'`` to 1500.0."""
    return number(_without(c, _SYMBOLS + ","))


def loose_number(c: Column) -> Column:
    """Number test used by role detection: commas, percent and currency signs are ignored."""
    return number(_without(c, _SYMBOLS + ",%"))


def timestamp(c: Column) -> Column:
    """Text to ``timestamp_ntz``: ISO text directly, other spellings rewritten to it first, and
    spellings with a weekday, ``AM`` or ``PM``, a zone or a short year by their parts. A time with a
    zone becomes UTC; years of two digits lie from 1969 to 2068."""
    text = F.btrim(c, F.lit(WHITESPACE))
    iso = F.when(text.rlike(_ISO), text.try_cast("timestamp_ntz"))
    spelled = iso.when(text.rlike(_SPELLED), _other_spelling(text))
    return spelled.when(text.rlike(_PARTS), F.transform(F.array(text), _by_parts)[0])


def _by_parts(text: Column) -> Column:
    day, hour, minute, second, half, zone = (F.regexp_extract(text, _PARTS, i) for i in range(1, 7))
    for digits, century in (("[0-6][0-9]", 20), ("[7-9][0-9]", 19)):
        if century == 20:
            day = F.regexp_replace(day, r"^(?<d>\d{1,2}[/-]\d{1,2}[/-])69$", "${d}1969")
        day = F.regexp_replace(day, rf"^(?<d>\d{{1,2}}[/-]\d{{1,2}}[/-])(?<y>{digits})$", f"${{d}}{century}${{y}}")
    hours, halved = hour.try_cast("int"), half != ""
    # twelve o'clock is the hour 0 of its half; without a half there must be minutes
    hours = F.when(halved & hours.between(1, 12), hours % 12 + F.when(F.lower(half) == "p", 12).otherwise(0)).when(
        ~halved & (minute != "") & (hours < 24), hours
    )
    clock = hours * 3600 + F.coalesce(minute.try_cast("int"), F.lit(0)) * 60
    digits = F.regexp_replace(zone, "[^0-9]", "")
    ahead = F.substring(digits, 1, 2).try_cast("int") * 3600 + F.substring(digits, 3, 2).try_cast("int") * 60
    offset = F.when(zone.startswith("-"), -ahead).when(zone.startswith("+"), ahead).otherwise(0)
    micros = F.round(F.coalesce(second.try_cast("double"), F.lit(0.0)) * 1e6).cast("bigint")
    shift = (clock - offset).cast("bigint") * 1_000_000 + micros
    return F.timestamp_add("MICROSECOND", F.when(hour == "", F.lit(0).cast("bigint")).otherwise(shift), _other_spelling(day))


def _other_spelling(text: Column) -> Column:
    for pattern, iso in _REWRITES:
        text = F.regexp_replace(text, pattern, iso)
    numbered = text
    for i, name in enumerate(_MONTHS, start=1):
        numbered = F.regexp_replace(numbered, f"(?i)-{name}-", f"-{i}-")
    text = F.when(text.rlike("[A-Za-z]{3}"), numbered).otherwise(text)
    return F.regexp_extract(text, _ISO, 0).try_cast("timestamp_ntz")


def compact_date(c: Column) -> Column:
    """Eight-digit whole number (``20240105``) to ``timestamp_ntz``."""
    text = c.try_cast("bigint").cast("string")
    return F.regexp_replace(
        F.regexp_extract(text, _REWRITES[0][0], 0), _REWRITES[0][0], "$1-$2-$3"
    ).try_cast("timestamp_ntz")
