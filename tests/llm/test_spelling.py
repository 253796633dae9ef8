"""Spelling variants against a brute force over all pairs of words."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from tabwise.llm import spelling


def brute_words(rows, slip=31, least_length=7, least_count=2):
    total = Counter()
    for doc_id, text, *_ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{doc_id}:{run}".encode()) if doc_id is not None else 1
            if h % slip == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            total[run] += 1
    return {w: n for w, n in total.items() if len(w) >= least_length and n >= least_count}


def single_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_groups(words, ratio=10):
    near = {w: [x for x in words if abs(len(x) - len(w)) < 2 and single_edit(w, x)] for w in words}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= ratio * words[w] else None

    def root(w):
        return w if form[w] is None else root(form[w])

    return sorted((w, form[w], root(w), n, len(near[w]), words[form[w]] if form[w] else None) for w, n in words.items())


def slips(seed, count=250):
    """Words with edited copies, chains of them, and the letters of other words in another order."""
    rng = random.Random(seed)
    letters = "abcdeé"
    words = {}
    for _ in range(count // 5):
        w = "".join(rng.choice(letters) for _ in range(rng.randint(7, 9)))
        n = rng.choice([3, 40, 400, 4000])
        for _ in range(5):
            if len(w) >= 7:
                words[w] = max(words.get(w, 0), n)
            i = rng.randrange(len(w))
            edit = rng.randrange(4)
            w = [w[:i] + w[i + 1 :], w[:i] + rng.choice(letters) + w[i:], w[:i] + rng.choice(letters) + w[i + 1 :], w[:i] + w[i:][::-1]][edit]
            n = max(2, n // rng.choice([1, 9, 10, 11]))
    return words


@pytest.mark.parametrize(("seed", "shard"), [(1, 10_000), (2, 12), (3, 5)])
def test_groups_equal_brute_force(spark, seed, shard):
    words = slips(seed)
    table = spark.createDataFrame(list(words.items()), "word string, n long").repartition(3)
    got = sorted(tuple(r) for r in spelling.group_variants(spark, table, shard=shard).collect())
    want = brute_groups(words)
    assert any(r[1] and r[2] != r[1] for r in want)
    assert got == want


def test_query_equals_brute_force_on_odd_rows(spark, odd, odd_rows):
    rng = random.Random(3)
    words = ["wanderer", "wandering", "Wonderer", "Étranger", "étrangers", "stranger", "strangers", "wanderers"]
    more = [(i, " ".join(rng.choices(words, [90, 9, 9, 9, 2, 60, 1, 1], k=80)) + ".", None, None, 1, "", "", "") for i in range(300, 380)]
    docs = odd.unionByName(spark.createDataFrame(more, odd.schema))
    got = spelling.group_variants(spark, spelling.vocabulary(docs, slip=31))
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    want = brute_groups(brute_words([*odd_rows, *more]))
    assert any(r[1] for r in want)
    assert sorted(tuple(r) for r in got.collect()) == want


def test_real_words(spark):
    """Every word of the given documents that a plain neighbourhood of deletions links, and no other."""
    path = "/root/testdata/sf0.001/documents.parquet"
    docs = spark.read.parquet(path)
    words = brute_words([tuple(r) for r in docs.select("doc_id", "text").collect()])
    table = spelling.vocabulary(docs, slip=31)
    assert {r.word: r.n for r in table.collect()} == words
    assert sorted(tuple(r) for r in spelling.group_variants(spark, table, shard=300).collect()) == brute_groups(words)


def test_box_search_loses_nothing():
    rng = np.random.default_rng(5)
    words = rng.integers(97, 103, (600, 8)).astype(np.uint8)
    vectors = spelling.letter_counts(words)
    held = []
    tree = spelling.build(vectors, 40, held)
    assert sorted(np.concatenate(held).tolist()) == list(range(600))
    for radius in (0, 1, 2):
        reached = {(leaf, row) for leaf, rows in spelling.reach(tree, vectors, radius) for row in rows.tolist()}
        for leaf, rows in enumerate(held):
            apart = np.abs(vectors[:, None] - vectors[rows][None]).sum(axis=2).min(axis=1)
            assert all((leaf, row) in reached for row in np.flatnonzero(apart <= radius).tolist())


def test_empty_table(spark, nothing):
    assert spelling.group_variants(spark, spelling.vocabulary(nothing, slip=31)).count() == 0
