"""Personal data: format-preserving Feistel pseudonyms, in column expressions only.

Numbers and dates that pass their checks are permuted within their format by a keyed Feistel network: a
card number becomes another of its length and layout with a right check digit, a telephone number keeps
its country code and layout, an address of a network becomes another, a social security number and a date
stay valid ones. Equal values become equal pseudonyms in all documents, different ones of a format stay
different: every permutation is one-to-one on the strings of the format. Dates with strokes are two formats,
month first where that can be and else day first; a date in all layouts but the last stays one date.
An e-mail address becomes a keyed name at a reserved domain. What fails its check stays.

One expression looks for all kinds at once; the text between the matches is left as it is.

Defined results: a null text stays null with counts of 0; an empty text stays empty; repeated rows have
equal results; texts of any length are searched whole; other columns stay, but those with the names of
results are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "ssn", "phone", "date")
#: The order decides what a text that fits several kinds is taken for. An address begins where its
#: letters begin and the rest with a digit, + or (, so that most places of a text fail at once.
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+@(?:[A-Za-z0-9-]{1,63}\.)+[A-Za-z]{2,24}",
    "ip": r"(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9]|\.[0-9])",
    "card": r"(?<![0-9])(?:[0-9]{13,19}|[0-9]{4}(?:[ -][0-9]{4}){2,3}(?:[ -][0-9]{1,4})?|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5})(?![0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "phone": r"(?<![0-9])\+[0-9]{1,3}(?:[ .-][0-9]{2,6}){2,4}(?![0-9])|(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{2,4}\)[ .-]?|(?<![0-9])[0-9]{3}[ .-])[0-9]{3,4}[ .-][0-9]{3,4}(?![0-9])",
    "date": r"(?<![0-9])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}\.[0-9]{2}\.[0-9]{4}|[0-9]{2}/[0-9]{2}/[0-9]{4})(?![0-9])",
}
EVERY = f"(?:{PATTERNS['email']})|(?=[0-9+(])(?:" + "|".join(f"(?:{p})" for k, p in PATTERNS.items() if k != "email") + ")"
ROUNDS = 10
#: 1900-01-01 to 2099-12-31: 73,049 days, which is 319 times 229.
FIRST_DAY, DAYS = "1900-01-01", (319, 229)
#: A walk of steps through the days finds one after the 12th; 61 % are. No chain of others is nearly so long.
STEPS = 64


def _round(key: str, kind: str, i: Column, half: Column, size: Column) -> Column:
    """A keyed number below size, from one half."""
    text = F.concat_ws("|", F.lit(key), F.lit(kind), i.cast("string"), half.cast("string"), size.cast("string"))
    return F.pmod(F.conv(F.substring(F.sha2(text, 256), 1, 15), 16, 10).cast("long"), size)


def feistel(left: Column, right: Column, size_left: Column, size_right: Column, key: str, kind: str) -> Column:
    """struct(a, b): a permutation of the pairs below the two sizes, one half moved by the other in turn."""

    def step(s: Column, i: Column) -> Column:
        return F.when(i % 2 == 0, F.struct(
            F.pmod(s["a"] + _round(key, kind, i, s["b"], size_left), size_left).alias("a"), s["b"].alias("b"),
        )).otherwise(F.struct(
            s["a"].alias("a"), F.pmod(s["b"] + _round(key, kind, i, s["a"], size_right), size_right).alias("b"),
        ))

    start = F.struct(left.cast("long").alias("a"), right.cast("long").alias("b"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step)


def _power(n: Column) -> Column:
    return F.rpad(F.lit("1"), (n + 1).cast("int"), "0").cast("long")


def permute_digits(digits: Column, key: str, kind: str) -> Column:
    """Another string of as many digits, 2 to 36; one-to-one for each length."""
    n = F.length(digits)
    u = F.floor(n / 2).cast("int")
    v = n - u
    pair = feistel(F.substr(digits, F.lit(1), u), F.substr(digits, u + 1), _power(u), _power(v), key, kind)
    # the struct is made once and read twice
    return F.transform(F.array(pair), lambda p: F.concat(F.lpad(p["a"].cast("string"), u, "0"), F.lpad(p["b"].cast("string"), v, "0")))[0]


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn_sum(digits: Column) -> Column:
    """The sum whose last digit is 0 for a right number; the check digit is the last one."""
    n = F.length(digits)

    def one(i: Column) -> Column:
        d = F.substr(digits, i, F.lit(1)).cast("int")
        double = F.when(d * 2 > 9, d * 2 - 9).otherwise(d * 2)
        return F.when((n - i) % 2 == 1, double).otherwise(d)

    return F.aggregate(F.transform(F.sequence(F.lit(1), n), one), F.lit(0), lambda a, x: a + x)


def _in_layout(m: Column, digits: Column) -> Column:
    """The digits in the places of the digits of m."""
    def at(i: Column) -> Column:
        c = F.substr(m, i, F.lit(1))
        return F.when(c.rlike("[0-9]"), F.substr(digits, F.length(_digits(F.substr(m, F.lit(1), i))), F.lit(1))).otherwise(c)

    return F.array_join(F.transform(F.sequence(F.lit(1), F.length(m)), at), "")


def _once(value: Column, then) -> Column:
    """`then` of a value that it uses several times, computed once."""
    return F.transform(F.array(value), then)[0]


def _card(m: Column, key: str) -> Column:
    def made(body: Column) -> Column:
        check = F.pmod(F.lit(10) - F.pmod(luhn_sum(F.concat(body, F.lit("0"))), F.lit(10)), F.lit(10))
        return _in_layout(m, F.concat(body, check.cast("string")))

    return _once(_digits(m), lambda d: _once(permute_digits(F.substr(d, F.lit(1), F.length(d) - 1), key, "card"), made))


def _ip(m: Column, key: str) -> Column:
    parts = F.transform(F.split(m, r"\."), lambda x: x.cast("long"))
    pair = feistel(parts[0] * 256 + parts[1], parts[2] * 256 + parts[3], F.lit(65536), F.lit(65536), key, "ip")
    return _once(pair, lambda p: F.concat_ws(
        ".", *(x.cast("string") for x in (F.floor(p["a"] / 256), p["a"] % 256, F.floor(p["b"] / 256), p["b"] % 256))
    ))


def _ssn(m: Column, key: str) -> Column:
    """Areas 001 to 899 without 666 are 898 numbers, groups 01 to 99, serials 0001 to 9999: all stay valid."""
    area, group, serial = (F.substr(m, F.lit(a), F.lit(n)).cast("long") for a, n in ((1, 3), (5, 2), (8, 4)))
    place = area - 1 - F.when(area > 666, 1).otherwise(0)
    pair = feistel(place * 99 + group - 1, serial - 1, F.lit(898 * 99), F.lit(9999), key, "ssn")

    def made(p: Column) -> Column:
        a = F.floor(p["a"] / 99) + 1
        a = a + F.when(a >= 666, 1).otherwise(0)
        return F.concat_ws("-", F.lpad(a.cast("string"), 3, "0"), F.lpad((p["a"] % 99 + 1).cast("string"), 2, "0"), F.lpad((p["b"] + 1).cast("string"), 4, "0"))

    return _once(pair, made)


def _phone(m: Column, key: str) -> Column:
    """The country code stays, the rest is permuted as one number."""
    code = F.regexp_extract(m, r"^\+[0-9]{1,3}(?=[^0-9])", 0)
    rest = F.substr(m, F.length(code) + 1)
    return F.concat(code, _in_layout(rest, permute_digits(_digits(rest), key, "phone")))


def _day(m: Column) -> Column:
    """The date, where it is one; of a date with strokes the month may come first or second."""
    def ymd(y: tuple, mo: tuple, d: tuple) -> Column:
        return F.try_to_date(F.concat_ws("-", *(F.substr(m, F.lit(a), F.lit(n)) for a, n in (y, mo, d))), "yyyy-MM-dd")

    return F.when(m.rlike("^[0-9]{4}-"), ymd((1, 4), (6, 2), (9, 2))).when(m.contains("."), ymd((7, 4), (4, 2), (1, 2))).otherwise(
        F.coalesce(ymd((7, 4), (1, 2), (4, 2)), ymd((7, 4), (4, 2), (1, 2)))
    )


def _moved(n: Column, key: str) -> Column:
    """Another day, one-to-one."""
    pair = feistel(F.floor(n / DAYS[1]), n % DAYS[1], F.lit(DAYS[0]), F.lit(DAYS[1]), key, "date")
    return _once(pair, lambda p: p["a"] * DAYS[1] + p["b"])


def _of_day(n: Column) -> Column:
    return F.date_add(F.lit(FIRST_DAY).cast("date"), n.cast("int"))


def _late(n: Column, key: str) -> Column:
    """Another day after the 12th, one-to-one among them: a permutation's steps up to the next such day."""
    def step(seen: Column, _: Column) -> Column:
        done = seen["done"] | (F.dayofmonth(_of_day(seen["n"])) > 12)
        return F.when(done, F.struct(seen["n"].alias("n"), F.lit(True).alias("done"))).otherwise(
            F.struct(_moved(seen["n"], key).alias("n"), F.lit(False).alias("done"))
        )

    start = F.struct(_moved(n, key).alias("n"), F.lit(False).alias("done"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), start, step)["n"]


def _date(m: Column, key: str) -> Column:
    """Another date of the layout. With strokes, the month comes first where it can; the others, day first
    after the 12th, become others of their kind, so that no two dates become one string."""
    n = F.datediff(_day(m), F.lit(FIRST_DAY).cast("date")).cast("long")
    whole = _once(n, lambda x: _of_day(_moved(x, key)))
    late = _once(n, lambda x: _of_day(_late(x, key)))
    return (
        F.when(m.rlike("^[0-9]{4}-"), F.date_format(whole, "yyyy-MM-dd")).when(m.contains("."), F.date_format(whole, "dd.MM.yyyy"))
        .when(F.substr(m, F.lit(1), F.lit(2)) <= "12", F.date_format(whole, "MM/dd/yyyy")).otherwise(F.date_format(late, "dd/MM/yyyy"))
    )


def _kind(m: Column) -> Column:
    """The kind of a match, null where it fails the kind's check."""
    whole = {k: m.rlike(f"^(?:{p})$") for k, p in PATTERNS.items()}
    digits = _digits(m)
    octets = F.forall(F.split(m, r"\."), lambda x: x.cast("int") <= 255)
    area = F.substr(m, F.lit(1), F.lit(3))
    ssn = ~area.isin("000", "666") & (area < "900") & (F.substr(m, F.lit(5), F.lit(2)) != "00") & (F.substr(m, F.lit(8), F.lit(4)) != "0000")
    day = _day(m)
    in_range = F.coalesce(day.between(F.lit(FIRST_DAY).cast("date"), F.lit("2099-12-31").cast("date")), F.lit(False))
    return (
        F.when(whole["email"], "email")
        .when(whole["ip"], F.when(octets, "ip"))
        .when(whole["card"], F.when(F.length(digits).between(13, 19) & (F.pmod(luhn_sum(digits), F.lit(10)) == 0), "card"))
        .when(whole["ssn"], F.when(ssn, "ssn"))
        .when(whole["date"], F.when(in_range, "date"))
        .when(whole["phone"], F.when(F.length(digits).between(7, 15), "phone"))
    )


def pseudonym(m: Column, kind: Column, key: str) -> Column:
    email = F.concat(F.lit("user"), F.substring(F.sha2(F.concat_ws("|", F.lit(key), F.lit("email"), F.lower(m)), 256), 1, 16), F.lit("@example.invalid"))
    return (
        F.when(kind == "email", email).when(kind == "ip", _ip(m, key)).when(kind == "card", _card(m, key))
        .when(kind == "ssn", _ssn(m, key)).when(kind == "phone", _phone(m, key)).when(kind == "date", _date(m, key))
        .otherwise(m)
    )


def pseudonymise(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """docs with the text replaced by its pseudonymised form, and n_email, n_ip, … of what was replaced.

    key: the secret of the permutations; whoever knows it can turn them back.
    """
    names = docs.columns
    plain = docs.toDF(*(f"c{i}" for i in range(len(names))))
    body = F.col(f"c{names.index(text)}")
    # most texts have neither a digit nor an @, which is found out much faster
    found = plain.withColumn("m", F.when(body.rlike("[0-9@]"), F.regexp_extract_all(body, F.lit(EVERY), F.lit(0))))
    kinds = F.transform("m", lambda m: F.struct(m.alias("m"), _kind(m).alias("k")))
    found = found.withColumn("m", F.when(F.size("m") > 0, kinds))
    new = F.transform("m", lambda x: pseudonym(x["m"], x["k"], key))
    glued = F.array_join(F.flatten(F.zip_with(F.split(body, EVERY, -1), new, lambda gap, v: F.array(gap, F.coalesce(v, F.lit(""))))), "")

    def count(kind: str) -> Column:
        return F.coalesce(F.size(F.filter("m", lambda x: x["k"] == kind)), F.lit(0)).cast("long")

    counts = {f"n_{k}": count(k) for k in KINDS}
    any_kind = F.coalesce(F.exists("m", lambda x: x["k"].isNotNull()), F.lit(False))
    kept = [i for i, name in enumerate(names) if name not in counts]
    cols = [F.when(any_kind, glued).otherwise(body).alias("t") if names[i] == text else F.col(f"c{i}") for i in kept]
    return found.select(*cols, *(c.alias(n) for n, c in counts.items())).toDF(*(names[i] for i in kept), *counts)
