"""Periodic runs against a brute force over all periods."""

from __future__ import annotations

import random
import zlib
from hashlib import sha256

import numpy as np
import pytest

from tabwise.llm import periodic
from tabwise.llm.shingles import word_hashes


def brute_runs(s, least=6, exponent=4):
    out = []
    for q in range(1, len(s) // exponent + 1):
        i = 0
        while i + q < len(s):
            j = i
            while j + q < len(s) and s[j] == s[j + q]:
                j += 1
            n = j - i + q
            part = s[i : i + n]
            if n >= max(least, exponent * q) and not any(part[d:] == part[: n - d] for d in range(1, q)):
                out.append((i, n, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def sequences(count):
    rng = random.Random(7)
    for _ in range(count):
        n, kinds = rng.randint(0, 70), rng.randint(1, 4)
        s = [rng.randrange(kinds) for _ in range(n)]
        if n > 4 and rng.random() < 0.6:
            a, p = rng.randrange(n), rng.randint(1, 6)
            s = [s[i if i < a else min(n - 1, a + (i - a) % p)] for i in range(n)]
        yield s


@pytest.mark.parametrize(("least", "exponent"), [(6, 4), (2, 2), (4, 2), (6, 3), (9, 5)])
def test_runs_equal_brute_force(least, exponent):
    for s in sequences(300):
        want = brute_runs(s, least, exponent)
        assert periodic.runs_of(s, least, exponent) == want
        words = [b"%d" % x for x in s]
        raw = np.frombuffer(b" ".join(words), np.uint8)
        hashes, rows = word_hashes(raw, np.array([0, len(raw)]))
        spans = periodic.stretches(hashes, rows, least, exponent)
        assert (periodic.text_runs(words, spans, least, exponent) if spans else []) == want


def test_extensions_equal_direct_comparison():
    for s in sequences(60):
        s = [*(x + 1 for x in s), 0]
        extension = periodic.Extension(s)
        for a in range(0, len(s), 3):
            for b in range(a + 1, len(s), 2):
                n = 0
                while b + n < len(s) and s[a + n] == s[b + n]:
                    n += 1
                assert extension(np.array([a]), np.array([b]))[0] == n


def test_one_period_alone_is_no_run():
    with pytest.raises(ValueError):
        periodic.gram_length(6, 1)


def expected(doc_id, text):
    words = (text or "").encode().split()
    n = len(words)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = brute_runs(words)
    gone = {i for a, length, q in runs for i in range(a + q, a + length)}
    kept = b" ".join(w for i, w in enumerate(words) if i not in gone)
    best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else None
    longest = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    lines = "".join(f"{a},{length},{q}\n" for a, length, q in runs)
    return (doc_id, len(runs), *longest, sha256(lines.encode()).hexdigest(), sha256(kept).hexdigest(), n)


def by_text(rows):
    return sorted(rows, key=str)


def test_query_equals_brute_force_on_odd_rows(odd, odd_rows):
    extra = [(i, "la " * (i % 9) + "tra la " * (i % 7) + "end", None, None, 1, "", "", "") for i in range(100, 160)]
    docs = odd.unionByName(odd.sparkSession.createDataFrame(extra, odd.schema))
    got = periodic.digests(periodic.find_runs(periodic.plant_periods(docs))).collect()
    want = [expected(r[0], r[1]) for r in [*odd_rows, *extra]]
    assert sum(r[1] for r in want) > 20
    assert by_text(tuple(r) for r in got) == by_text(want)


def test_real_rows_and_long_period(spark):
    text = " ".join(f"w{i}" for i in range(900))
    docs = spark.createDataFrame([(1, " ".join([text] * 5)), (2, "x " * 7000), (3, None)], "doc_id long, text string")
    rows = {r.doc_id: r for r in periodic.find_runs(docs).collect()}
    assert [tuple(r) for r in rows[1].runs] == [(0, 4500, 900)]
    assert rows[1].collapsed_text == text
    assert [tuple(r) for r in rows[2].runs] == [(0, 7000, 1)]
    assert rows[2].collapsed_text == "x"
    assert (rows[3].n_words, rows[3].runs, rows[3].collapsed_text) == (0, [], "")


def test_empty_table(nothing):
    found = periodic.find_runs(nothing)
    assert found.count() == 0
    assert periodic.digests(found).columns[0] == "doc_id"
