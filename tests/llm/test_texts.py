"""Operators on single documents: secrets, languages, lines, pseudonyms."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tabwise.llm import language_id, line_quality, pseudonyms, secret_scan

BASE = {
    "assign": re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A),
    "access": re.compile("AKIA[A-Z0-9]+"),
    "hex": re.compile("[0-9a-f]+"),
}


def base_spans(text: str | None) -> list[str]:
    found = []
    for order, (kind, pattern) in enumerate(BASE.items()):
        for m in pattern.finditer(text or ""):
            if len(m[2] if kind == "assign" else m[0]) >= {"assign": 8, "access": 16, "hex": 32}[kind]:
                found.append((m.start(), order, f"{kind}:{m.start()}:{m.end()}"))
    return [x for *_, x in sorted(found)]


def digest(spans: list[str]) -> str:
    return hashlib.sha256(",".join(spans).encode()).hexdigest()


def test_spans_equal_regular_expressions():
    rng = random.Random(1)
    parts = ["token", "=", "secret", ": ", '"', "'", " ", "abcdefgh", "AKIA", "AKIA0123456789AB", "é", "\n", "api_key", "apikey",
             "passwd", "deadbeef" * 4, "0123456789abcdef", "Token", "x", ".", "ghp_" + "a1B2" * 9, "eyJ", "-"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 40))) for _ in range(1500)] + [None, "", "f" * 70_000]
    got = secret_scan._columns(pa.array(texts, pa.string()), secret_scan.RULES)
    for text, want, spans in zip(texts, got[3].to_pylist(), got[4].to_pylist(), strict=True):
        base = base_spans(text)
        assert want == digest(base)
        assert [x for x in spans.split(",") if x.split(":")[0] in BASE] == base


def test_further_rules():
    text = "x ghp_" + "a1B2" * 9 + " xoxb-1234567890-abcdefgh é -----BEGIN RSA PRIVATE KEY----- sk_live_0123456789abcdef"
    spans = secret_scan._columns(pa.array([text]), secret_scan.RULES)[4][0].as_py()
    assert [x.split(":")[0] for x in spans.split(",")] == ["github", "slack", "pem", "stripe"]
    for kind, lo, hi in (x.split(":") for x in spans.split(",")):
        assert text[int(lo) : int(hi)][:3] in ("ghp", "xox", "---", "sk_"), kind


def test_secrets_of_odd_rows(odd, odd_rows, nothing):
    out = secret_scan.find_secrets(odd)
    assert out.columns.count("spans") == 1 and out.count() == len(odd_rows)
    for r in out.select("text", "base_sha256").collect():
        assert r[1] == digest(base_spans(r[0]))
    assert secret_scan.find_secrets(nothing).count() == 0


def test_redact(spark):
    docs = spark.createDataFrame([(1, 'a token = "12345678abc" z'), (2, None), (3, "clean é")], "doc_id long, text string")
    got = {r[0]: r[1] for r in secret_scan.redact(docs).collect()}
    assert got == {1: 'a [SECRET]" z', 2: None, 3: "clean é"}


@pytest.fixture(scope="module")
def languages(spark):
    rng = random.Random(2)
    parts = {"en": ["the", "and", "ing", "tion", "of"], "de": ["und", "sch", "ung", "ein", "ü"], "fr": ["eau", "que", "é", "oi", "le"]}
    rows = []
    for i in range(600):
        lang = rng.choice(list(parts))
        rows.append((i, " ".join("".join(rng.choice(parts[lang]) for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(3, 60))), lang))
    return language_id.held_out(spark.createDataFrame(rows, "doc_id long, text string, lang string"))


def test_language_accuracy_on_held_out_rows(languages):
    model = language_id.train(languages.filter("not held_out"))
    got = language_id.identify(languages.filter("held_out"), model)
    total, right, lost = got.agg(F.count("*"), F.sum((F.col("lang") == F.col("lang_pred")).cast("int")), F.sum(F.col("rejected").cast("int"))).first()
    assert right >= 0.97 * total and lost <= 0.02 * total
    assert got.filter("score < 0 or score > 1").count() == 0


def test_language_of_odd_rows(odd, odd_rows, nothing, languages):
    model = language_id.train(languages)
    got = language_id.identify(odd, model)
    assert got.count() == len(odd_rows)
    for r in got.select("text", "lang_pred", "score", "rejected").collect():
        if not any(c.isalpha() for c in r.text or ""):
            assert (r.lang_pred, r.score, r.rejected) == ("und", 0.0, True)
        else:
            assert r.lang_pred in model.langs
    assert language_id.identify(nothing, model).count() == 0
    untaught = language_id.train(nothing)
    assert {r.lang_pred for r in language_id.identify(odd, untaught).collect()} == {"und"}


def test_repeated_words_equal_counting():
    rng = random.Random(5)
    for _ in range(300):
        words = [rng.choice("abcdef"[: rng.randint(1, 6)]) for _ in range(rng.randint(0, 200))]
        windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
        seen = Counter(windows)
        marked = {i + j for i, w in enumerate(windows) if seen[w] > 1 for j in range(5)}
        assert line_quality.repeated_words(words) == len(marked)


def test_lines():
    good = "This is a plain sentence of words.\n" * 1 + "Another line that ends as it should!"
    junk = "a | b | c\nHome | News | Login\nall rights reserved.\nno end of sentence here"
    assert line_quality.measure(good)[6] is True
    got = line_quality.measure(good + "\n" + junk)
    assert got[7] == 4 and got[9] == good
    assert line_quality.measure(junk * 3)[6] is False


def test_lines_of_odd_rows(odd, odd_rows, nothing):
    got = line_quality.clean_lines(odd)
    assert got.count() == len(odd_rows) and got.columns.count("n_words") == 1
    for r in got.filter("text is null or trim(text) = ''").collect():
        assert (r.n_words, r.base_failed, r.kept) == (0, True, False)
    assert line_quality.clean_lines(nothing).count() == 0


def test_pseudonyms_keep_formats(spark):
    rows = [
        (1, "SSN 123-45-6789, born 1984-02-29 or 29.02.1984 or 02/29/1984, card 4111 1111 1111 1111"),
        (2, "again 123-45-6789; bad 4111 1111 1111 1112 and 999.1.1.1; call +1 (212) 555-0199 or mail Ann@example.com"),
        (3, "10.0.0.1 and 4111111111111111 and 2001-13-45"), (4, None), (5, ""), (6, "nothing here"),
    ]
    got = {r.doc_id: r for r in pseudonyms.pseudonymise(spark.createDataFrame(rows, "doc_id long, text string"), "tabwise").collect()}
    one, two, three = (got[i].text for i in (1, 2, 3))
    ssn = re.search(r"\d{3}-\d{2}-\d{4}", one)[0]
    assert ssn != "123-45-6789" and ssn in two
    iso, dotted, strokes = re.search(r"(\d{4}-\d\d-\d\d) or (\S+) or (\S+),", one).groups()
    assert iso != "1984-02-29" and dotted == ".".join(reversed(iso.split("-"))) and strokes == f"{iso[5:7]}/{iso[8:]}/{iso[:4]}"
    card = re.search(r"(\d{4} ){3}\d{4}", one)[0].replace(" ", "")
    total = sum(int(c) if i % 2 else (2 * int(c) - 9 * (int(c) > 4)) for i, c in enumerate(card))
    assert card in three and card != "4111111111111111" and total % 10 == 0
    assert "4111 1111 1111 1112" in two and "999.1.1.1" in two and "2001-13-45" in three
    assert re.search(r"\+1 \(\d{3}\) \d{3}-\d{4}", two) and "555-0199" not in two and "example.com" not in two
    assert got[4].text is None and got[5].text == "" and got[6].text == "nothing here"
    assert (got[1].n_date, got[1].n_card, got[2].n_phone, got[2].n_email, got[3].n_ip) == (3, 1, 1, 1, 1)


def test_digits_are_permuted(spark):
    numbers = spark.range(1000).select(F.lpad(F.col("id").cast("string"), 3, "0").alias("d"))
    out = numbers.select(pseudonyms.permute_digits(F.col("d"), "k", "t").alias("p"))
    assert out.distinct().count() == 1000 and out.filter("length(p) <> 3").count() == 0


def test_pseudonyms_of_odd_rows(odd, odd_rows, nothing):
    out = pseudonyms.pseudonymise(odd, "k")
    assert out.count() == len(odd_rows) and out.columns[:8] == odd.columns
    assert pseudonyms.pseudonymise(nothing, "k").count() == 0


def test_all_dates_with_strokes_stay_different(spark):
    """Every valid string of the layout: 73,049 with the month first and 44,249 with the day first."""
    days = spark.sql("SELECT explode(sequence(date'1900-01-01', date'2099-12-31')) AS d")
    strings = days.select(F.date_format("d", "MM/dd/yyyy").alias("s")).union(
        days.filter("dayofmonth(d) > 12").select(F.date_format("d", "dd/MM/yyyy"))
    )
    made = strings.repartition(8).select("s", pseudonyms._date(F.col("s"), "k").alias("p"))
    read = made.withColumn("valid", pseudonyms._day(F.col("p")).isNotNull())
    row = read.agg(F.count("*").alias("n"), F.count_distinct("p").alias("p"), F.min("valid").alias("valid"), F.count_if(F.col("s") == F.col("p")).alias("same")).first()
    assert (row.n, row.p, row.valid) == (117_298, 117_298, True) and row.same < 30


def test_telephone_numbers_with_short_area_codes(spark):
    rows = [(1, "ring +44 20 7946 0958 or +49 30 901820."), (2, "+44 20 7946 0958")]
    got = {r.doc_id: r for r in pseudonyms.pseudonymise(spark.createDataFrame(rows, "doc_id long, text string"), "k").collect()}
    british, german = re.fullmatch(r"ring (\+44 \d\d \d{4} \d{4}) or (\+49 \d\d \d{6})\.", got[1].text).groups()
    assert british != "+44 20 7946 0958" and german != "+49 30 901820" and got[2].text == british
    assert (got[1].n_phone, got[2].n_phone) == (2, 1)
