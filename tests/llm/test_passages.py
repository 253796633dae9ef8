"""Passage removal against a brute force over all windows."""

from __future__ import annotations

import random
from collections import Counter
from hashlib import sha256

import numpy as np
import pytest

from tabwise.llm import passages


def brute(rows, window):
    texts = [(r[0], (r[1] or "").encode().split()) for r in rows]
    seen = Counter(tuple(w[p : p + window]) for _, w in texts for p in range(len(w) - window + 1))
    out = []
    for doc_id, words in texts:
        gone = set()
        for p in range(len(words) - window + 1):
            if seen[tuple(words[p : p + window])] > 1:
                gone.update(range(p, p + window))
        kept = b" ".join(w for i, w in enumerate(words) if i not in gone)
        starts = sorted(i for i in gone if i - 1 not in gone)
        ends = sorted(i + 1 for i in gone if i + 1 not in gone)
        out.append((doc_id, len(words), len(gone), list(zip(starts, ends, strict=True)), sha256(kept).hexdigest(), kept.decode()))
    return sorted(out, key=str)


def found(spark, docs, window, **options):
    rows = passages.remove_passages(spark, docs, window, **options).collect()
    return sorted(((r.doc_id, r.n_words, r.n_removed, [tuple(s) for s in r.spans], r.kept_sha256, r.kept_text) for r in rows), key=str)


def mosaic(seed, count=60):
    """Texts made of shared and own passages, at every shift against the blocks."""
    rng = random.Random(seed)
    shared = [[f"s{rng.randrange(40)}" for _ in range(rng.randint(2, 60))] for _ in range(12)]
    rows = []
    for i in range(count):
        words = []
        for _ in range(rng.randint(0, 6)):
            words += rng.choice(shared) if rng.random() < 0.6 else [f"own{rng.randrange(10**6)}" for _ in range(rng.randint(0, 25))]
        rows.append((i, rng.choice([" ", "\n", "  "]).join(words)))
    rows += [rows[3], rows[3], (900, rows[5][1]), (901, ""), (902, None), (None, rows[6][1]), (None, None)]
    rows.append((903, "la " * 400))
    return rows


@pytest.mark.parametrize(("window", "seed"), [(35, 1), (5, 2), (8, 3), (1, 4), (2, 5)])
def test_equals_brute_force(spark, window, seed):
    rows = mosaic(seed)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert found(spark, docs, window, bucket_bytes=4000, bucket_windows=300) == brute(rows, window)


def test_odd_rows(spark, odd, odd_rows):
    assert found(spark, odd, 35) == brute(odd_rows, 35)


def test_empty_table(spark, nothing):
    assert passages.remove_passages(spark, nothing).count() == 0


def test_every_repeat_has_an_anchor():
    window, block = 35, 18
    for n in (35, 36, 53, 54, 200):
        everything = passages.candidates(n, np.arange(n // block), window, block)
        assert everything.tolist() == list(range(n - window + 1))
        assert not len(passages.candidates(n, np.zeros(0, np.int64), window, block))
    assert passages.candidates(100, np.array([2]), window, block).tolist() == [p for p in range(66) if 18 < p <= 36 and p + 35 < 72]
