"""Operators on whole tables: mixing, repeats, archives, packing, near copies, vectors, the pipeline."""

from __future__ import annotations

import hashlib
import random
import time
import zlib
from array import array
from collections import Counter, defaultdict

import corpus_pipeline
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tabwise.llm import archive, mixing, near_texts, near_vectors, packing, queries, repeats
from tabwise.llm.common import Saved, components
from tokenizers import Tokenizer

BPE = public_tokenizers.path("byte_bpe_50k.json")


def words(text: str | None) -> list[str]:
    return [w for w in "".join(" " if c in "\t\n\x0b\x0c\r" else c for c in text or "").split(" ") if w]


# --- mixing


def water_level(sizes: dict, weights=(5, 2, 1), most=3) -> dict:
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    total, capped = sum(sizes.values()), set()
    while True:
        rest = total - sum(most * sizes[s] for s in capped)
        open_ = [s for s in names if s not in capped]
        share = {s: rest * weight[s] / sum(weight[t] for t in open_) for s in open_}
        over = {s for s in open_ if share[s] > most * sizes[s]}
        if not over:
            return {s: most * sizes[s] if s in capped else share[s] for s in names}
        capped |= over


def test_mix_meets_targets(spark):
    rng = random.Random(6)
    rows = [(i, "w " * rng.randint(1, 200), rng.choice(["a", "a", "a", "b", "c", "d", None]), 0) for i in range(900)]
    rows += [(2000, "w " * 5, "tiny", 0), (2001, None, "void", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, size int")
    got = mixing.mix(spark, docs).collect()
    again = mixing.mix(spark, docs.repartition(5)).collect()
    assert sorted((r.doc_id, r.taken) for r in got) == sorted((r.doc_id, r.taken) for r in again)
    sizes, taken, rated = Counter(), Counter(), defaultdict(list)
    for r in got:
        sizes[r.source] += r.size
        taken[r.source] += r.taken
        rated[r.source].append(r)
        assert 0 <= r.taken <= 3 * r.size
    want = water_level(dict(sizes))
    for r in got:
        assert r.target == pytest.approx(want[r.source]) and r.source_size == sizes[r.source]
    for s in ("a", "b", "c", "d", None):
        assert abs(taken[s] - want[s]) <= 201
        # the rates meet the constraint and are one tilt of the size
        assert sum(r.rate * r.size for r in rated[s]) == pytest.approx(want[s], rel=1e-5)
        tilts = [np.log(r.rate) / r.size for r in rated[s] if 0 < r.rate < 3]
        assert max(tilts, default=0) - min(tilts, default=0) < 1e-9
    assert (taken["tiny"], taken["void"]) == (15, 0)


def test_mix_of_odd_rows(spark, odd, odd_rows, nothing):
    got = mixing.mix(spark, odd)
    assert got.count() == len(odd_rows)
    assert [r.size for r in got.collect() if r.size < 0] == []
    assert mixing.take(spark, odd).columns == odd.columns
    assert mixing.take(spark, odd).count() == got.agg(F.sum("copies")).first()[0]
    assert mixing.mix(spark, nothing).count() == 0


# --- repeats


def removed(texts: list[bytes], window: int = 200) -> list[tuple]:
    seen = Counter(t[p : p + window] for t in texts for p in range(len(t) - window + 1))
    out = []
    for t in texts:
        gone = np.zeros(len(t), bool)
        for p in range(len(t) - window + 1):
            if seen[t[p : p + window]] > 1:
                gone[p : p + window] = True
        kept = bytes(b for b, g in zip(t, gone, strict=True) if not g)
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((len(t), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return out


def test_repeats_equal_brute_force(spark):
    rng = random.Random(3)
    vocabulary = ["".join(rng.choice("abcdefghijklmnopé") for _ in range(rng.randint(1, 8))) for _ in range(300)]

    def text(n: int) -> str:
        return " ".join(rng.choice(vocabulary) for _ in range(n))

    passages, texts = [text(60) for _ in range(5)], []
    for i in range(60):
        t = text(rng.randint(0, 60))
        for _ in range(rng.randint(0, 2)):
            p, a = rng.choice(passages), rng.randint(0, 120)
            t += p[a : a + rng.randint(150, 300)] + text(rng.randint(0, 20))
        if i % 10 == 0:
            t += "a" * rng.randint(150, 700)
        if i % 11 == 0:
            t += "ab" * rng.randint(80, 300)
        texts.append(t)
    texts += [texts[5][:200] + "X" + texts[5][201:] for _ in range(3)] + ["", None, texts[7], text(400)]
    rows = [(i, t, "clash") for i, t in enumerate(texts)]
    got = {r.doc_id: r for r in repeats.remove_repeats(spark, spark.createDataFrame(rows, "doc_id long, text string, n_bytes string")).collect()}
    for i, want in enumerate(removed([(t or "").encode() for t in texts])):
        assert (got[i].n_bytes, got[i].n_removed, got[i].n_spans, got[i].kept_sha256) == want


def test_repeats_of_odd_rows(spark, odd, odd_rows, nothing):
    got = repeats.remove_repeats(spark, odd).collect()
    want = removed([(r[1] or "").encode() for r in odd_rows])
    assert sorted((r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == sorted(want)
    assert repeats.remove_repeats(spark, nothing).count() == 0


# --- archives


def test_archives_round_trip(spark, tmp_path):
    rng = random.Random(8)
    html = ["<p>" + " ".join(rng.choice(["one", "two", "drei", "é"]) for _ in range(rng.randint(0, 400))) for _ in range(120)]
    rows = [(i, f"http://x/{i}", t, "clash") for i, t in enumerate(html)]
    rows += [(500, None, html[3], ""), (2, "u", html[2], ""), (501, "u", None, ""), (502, "a\nb", "", ""), (None, "u", html[9], ""), (503, "u", "long " * 50_000, "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, path string")
    files = archive.write_archives(spark, pages, f"file://{tmp_path}/out", sample_bytes=20_000, archive_bytes=30_000)
    got = sorted((r.page_id is None, r.page_id or 0, r.record_type, r.refers_to, r.payload_bytes, r.payload_digest) for r in archive.read_archives(files).collect())
    first: dict[str, int] = {}
    for i, _, t, _ in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        first.setdefault(t or "", i)
    want = []
    for i, _, t, _ in rows:
        body, lead = (t or "").encode(), first[t or ""]
        again = i != lead
        want.append((i is None, i or 0, "revisit" if again else "response", lead if again else None, len(body), archive._digest(body)))
    assert got == sorted(want)
    heads = [open(r.path.removeprefix("file://"), "rb").read(4) for r in files.collect()]
    assert any(h == archive._FRAME for h in heads) and len(heads) > 1
    assert archive.read_archives(archive.write_archives(spark, pages.limit(0))).count() == 0


# --- packing


@pytest.mark.parametrize("text", [
    "", " ", "a", " a", "a ", "a  b", "a\nb", "a \n b", "a\n\nb", "it's, don't. 's", "x y  z", "naïve, señor.\tüber  12 3.4,5", "é" * 50, "<|endoftext|> a",
    "one two\nthree. four, five.\r\nsix", "\n", " \n", "word.,word ,. ..", "…? ¿qué?", "a b  c",
])
def test_token_ids_equal_the_tokenizer(text):
    tokenizer = Tokenizer.from_file(BPE)
    tokenizer.encode_special_tokens = True
    assert list(array("I", bytes(packing.token_ids(text, BPE)))) == [*tokenizer.encode(text, add_special_tokens=False).ids, 2]


def test_plan_uses_every_piece_once():
    rng = random.Random(9)
    for _ in range(5):
        counts = dict(Counter(rng.choice([rng.randint(1, 1024), rng.randint(1, 60), 512, 1024]) for _ in range(600)))
        planned = packing.plan(counts)
        used = Counter()
        for held, n in planned:
            assert sum(held) <= 1024 and n > 0
            for x in held:
                used[x] += n
        assert used == Counter(counts)
        least = -(-sum(x * n for x, n in counts.items()) // 1024)
        assert sum(n for _, n in planned) <= 1.05 * least + 2


def lognormal_counts(seed: int, n: int) -> dict:
    rng = random.Random(seed)
    return dict(Counter(1 + int(rng.lognormvariate(6.0, 1.0)) % 1023 for _ in range(n)))


@pytest.mark.parametrize("n", [40, 900, 10000])
def test_configurations_are_solved_to_the_gap(n):
    counts = lognormal_counts(n, n)
    solution, bound = packing.solve(counts, gap=0.02)
    covered = Counter()
    for config, amount in solution:
        assert sum(config) <= 1024
        for x in config:
            covered[x] += amount
    assert all(covered[x] >= n * (1 - 1e-9) for x, n in counts.items())
    assert sum(amount for _, amount in solution) <= 1.02 * bound * (1 + 1e-9)
    assert sum(x * n for x, n in counts.items()) / 1024 <= bound <= sum(n for _, n in packing.best_fit(counts))


@pytest.mark.parametrize("counts", [lognormal_counts(1, 200), lognormal_counts(2, 10000), {600: 7}, {1: 5000, 1023: 4000}, {512: 3, 1024: 2}])
def test_plan_needs_no_more_sequences_than_best_fit(counts):
    planned = packing.plan(counts)
    used = Counter()
    for held, n in planned:
        for x in held:
            used[x] += n
    assert used == Counter(counts)
    assert sum(n for _, n in planned) <= sum(n for _, n in packing.best_fit(counts))


@pytest.mark.parametrize("n", [3000, 300_000])
def test_narrow_lengths_end_with_a_proven_bound(n):
    lengths = np.random.default_rng(n).integers(250, 521, n)
    counts = dict(Counter(lengths.tolist()))
    begun = time.process_time()
    solution, bound = packing.solve(counts)
    assert time.process_time() - begun < 20  # 3 s and 4 s measured
    covered = Counter()
    for config, amount in solution:
        assert sum(config) <= 1024
        for x in config:
            covered[x] += amount
    assert all(covered[x] >= k * (1 - 1e-9) for x, k in counts.items())
    assert lengths.sum() / 1024 <= bound <= sum(amount for _, amount in solution) <= 1.06 * bound
    planned = packing.plan(counts)
    assert sum(k for _, k in planned) <= sum(k for _, k in packing.best_fit(counts))


def test_best_configurations_of_long_lengths():
    rng = np.random.default_rng(2)
    for least in (8, 30, 200, 600, 1024):
        price = np.zeros(1025)
        price[least:] = rng.random(1025 - least) * (rng.random(1025 - least) < 0.3)
        price[1024] = 0.5
        worth, chosen = packing.best_configurations(price)
        plain = np.zeros(1025)
        for space in range(1, 1025):
            plain[space] = max(plain[space - 1], max(price[x] + plain[space - x] for x in range(1, space + 1)))
        assert np.allclose(worth, plain)
        for space in range(1025):
            spent, left = 0.0, space
            while left:
                spent += price[chosen[left]]
                left -= chosen[left]
            assert left == 0 and np.isclose(spent, worth[space])


def test_fast_and_plain_encoders_agree():
    """The rank encoder and the tokenizer, on joined tokens, on all kinds of characters and on long runs."""
    tokenizer, fast = packing._encoders(BPE)
    assert fast is not None
    rng = random.Random(12)
    tokens = [t for t in (fast.decode([i]) for i in range(50_000)) if packing._latin(t)]
    texts = ["".join(rng.choices(tokens, k=rng.randint(1, 6))) for _ in range(20_000)]
    texts += ["".join(chr(rng.randrange(256)) for _ in range(rng.randint(1, 8))) for _ in range(20_000)]
    texts += ["".join(rng.choice(" \n\t\x85\xa0\x1c\x0ba.1'sé") for _ in range(rng.randint(1, 9))) for _ in range(20_000)]
    texts += ["z" * 5000, "ab" * 3000, " " * 7000 + "x", "\n" * 3000, " " * 2_000_000 + "x y", "日本 語 and\u3000more \u2014 x  — y " * 3]
    for text, found in zip(texts, tokenizer.encode_batch(texts, add_special_tokens=False), strict=True):
        assert packing._ids(text, BPE) == found.ids


def test_packing_of_odd_rows(spark, odd, odd_rows, nothing):
    got = packing.pack(spark, odd, BPE).collect()
    tokenizer = Tokenizer.from_file(BPE)
    tokenizer.encode_special_tokens = True
    want = Counter()
    for r in odd_rows:
        ids = [*tokenizer.encode(r[1] or "", add_special_tokens=False).ids, 2]
        begin, stop, k = 0, len(ids) % 1024 or 1024, 0
        while begin < len(ids):
            want[r[0], k, begin, stop - begin, zlib.crc32(np.array(ids[begin:stop], "<u4").tobytes())] += 1
            begin, stop, k = stop, stop + 1024, k + 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    by = defaultdict(list)
    for r in got:
        by[r.sequence_id].append((r.offset, r.length))
    for held in by.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= 1024
    assert packing.pack(spark, nothing, BPE).count() == 0


# --- near copies


def groups(nodes: list, links: list[tuple]) -> dict:
    root = {n: n for n in nodes}

    def top(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in links:
        x, y = sorted((top(a), top(b)))
        root[y] = x
    return {n: top(n) for n in nodes}


def test_near_texts_equal_brute_force(spark):
    rng = random.Random(10)
    vocabulary = [f"w{i}" for i in range(2000)]
    rows: list[tuple] = []
    for _ in range(40):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(30, 150))]
        for _ in range(rng.choice([1, 1, 2, 4, 30])):
            copy = list(base)
            for _ in range(rng.randint(0, 4)):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            rows.append((len(rows), " ".join(copy), "clash"))
    rows += [(5000, "two words", ""), (5001, "two \n words", ""), (5002, "other words", ""), (5003, "", ""), (5004, None, ""), (5005, " ", ""), (None, "two words", "")]
    got = near_texts.join_near(spark, spark.createDataFrame(rows, "doc_id long, text string, digest string"), block=16).collect()
    sets = {}
    for i, t, _ in rows:
        w = words(t)
        if w and i is not None:
            sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}
    ids = sorted(sets)
    links = [(a, b) for x, a in enumerate(ids) for b in ids[x + 1 :] if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    degree = Counter(n for pair in links for n in pair)
    root = groups([r[0] for r in rows if r[0] is not None], links)
    assert len(got) == len(rows) and max(degree.values()) > 16
    for r in got:
        if r.doc_id is None:
            assert (r.n_links, r.class_id, r.kept) == (0, None, True)
        else:
            assert (r.doc_id, r.n_links, r.class_id, r.kept) == (r.doc_id, degree[r.doc_id], root[r.doc_id], root[r.doc_id] == r.doc_id)


def test_forest_nodes_are_the_shared_prefixes(spark):
    rng = random.Random(21)
    signed = [(i, bytes(x for _ in range(3 * 4) for x in (0, rng.choice([1, 1, 1, 2])))) for i in range(400)]
    signed += [(400 + i, signed[0][1]) for i in range(300)]
    table = spark.createDataFrame(signed, "node long, signature binary").repartition(7)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 50)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", False)
    try:
        edges = [tuple(r) for r in near_texts.forest(table, Saved(spark), trees=3, deepest=4, least=2).collect()]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert {e[2] for e in edges} == {2, 3, 4}
    for level in (2, 3, 4):
        first, wanted = {}, []
        for i, s in signed:
            for t in range(3):
                wanted.append((first.setdefault((t, s[8 * t : 8 * t + 2 * level]), i), i))
        nodes = [i for i, _ in signed]
        assert groups(nodes, [(a, b) for a, b, d in edges if d >= level]) == groups(nodes, wanted)


def test_near_texts_of_one_identifier(spark):
    rng = random.Random(31)
    bases = [[f"v{rng.randrange(900)}" for _ in range(80)] for _ in range(6)]
    near = [" ".join([*b[:40], "changed", *b[41:]]) for b in bases]
    texts = [" ".join(b) for b in bases]
    # 1: three texts, each with a near copy elsewhere; 2: near copies under one identifier; equal rows
    rows = [(1, texts[0]), (1, texts[1]), (1, texts[2]), (10, near[0]), (11, near[1]), (12, near[2]), (12, near[2])]
    rows += [(2, texts[3]), (2, near[3]), (3, texts[4]), (3, texts[4]), (4, texts[5]), (5, None), (5, ""), (5, None), (None, texts[0])]
    docs = spark.createDataFrame([(i, t, "clash") for i, t in rows], "doc_id long, text string, __words string")
    got = Counter((r.doc_id, r.class_id, r.n_links) for r in near_texts.join_near(spark, docs).collect())
    assert got == Counter([(1, 1, 1), (1, 1, 1), (1, 1, 2), (10, 1, 1), (11, 1, 1), (12, 1, 2), (12, 1, 2), (2, 2, 1), (2, 2, 1), (3, 3, 1), (3, 3, 1), (4, 4, 0), (5, 5, 0), (5, 5, 0), (5, 5, 0), (None, None, 0)])
    left = near_texts.drop_near(spark, docs)
    assert left.columns == docs.columns
    kept = Counter((r.doc_id, r.text) for r in left.collect())
    assert kept.pop((2, texts[3]), 0) + kept.pop((2, near[3]), 0) == 1
    assert kept == Counter([(1, texts[0]), (1, texts[1]), (1, texts[2]), (3, texts[4]), (4, texts[5]), (5, None), (5, ""), (5, None), (None, texts[0])])


def test_prefixes_are_shortened_for_less_similar_links(spark):
    assert [near_texts.prefix_length(s, 24, 8, 0.9999) for s in (0.8, 0.9, 0.99)] == [5, 8, 8]
    rng = random.Random(41)
    rows = []
    for _ in range(250):
        base = [f"u{rng.randrange(5000)}" for _ in range(100)]
        copy = list(base)
        copy[rng.randrange(4, 45)] = copy[rng.randrange(55, 95)] = "x"
        rows += [(len(rows), " ".join(base)), (len(rows) + 1, " ".join(copy))]
    sets = [{tuple(w[k : k + 5]) for k in range(96)} for w in (words(t) for _, t in rows)]
    linked = sum(len(sets[i] & sets[i + 1]) >= 0.8 * len(sets[i] | sets[i + 1]) for i in range(0, len(rows), 2))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert linked > 100
    assert near_texts.join_near(spark, docs).filter("n_links = 1").count() == 2 * linked


def test_near_texts_of_odd_rows(spark, odd, odd_rows, nothing):
    assert near_texts.join_near(spark, odd).count() == len(odd_rows)
    assert near_texts.join_near(spark, nothing).count() == 0


def test_near_vectors_equal_brute_force(spark):
    rng = np.random.default_rng(12)
    rows: list[tuple] = []
    for _ in range(60):
        base = rng.normal(size=24)
        for _ in range(int(rng.choice([1, 2, 3, 40]))):
            rows.append((len(rows), [float(x) for x in base + rng.normal(size=24) * 0.05]))
    rows += [(9000, rows[0][1]), (9001, rows[0][1]), (9002, None), (9003, []), (9004, [0.0] * 24), (9005, [float("nan")] * 24), (9006, [None, *rows[0][1][1:]]), (9007, rows[0][1][:20]), (None, rows[0][1]), (9008, [1e-300 * x for x in rows[0][1]])]
    table = spark.createDataFrame([(i, v, 0, "clash") for i, v in rows], "vec_id long, embedding array<double>, label int, bucket string")
    got = near_vectors.links(spark, table, block=16).collect()
    good = [(i, np.array(v)) for i, v in rows if i is not None and i not in range(9002, 9008)]
    unit = np.array([v / np.abs(v).max() for _, v in good])
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    near = unit @ unit.T >= 0.95
    ids = [i for i, _ in good]
    links = [(ids[a], ids[b]) for a in range(len(ids)) for b in range(a + 1, len(ids)) if near[a, b]]
    degree = Counter(n for pair in links for n in pair)
    assert len(got) == len(rows)
    found = sum(r.n_links for r in got)
    assert 0.98 * 2 * len(links) <= found <= 2 * len(links)
    root = groups([i for i, _ in rows if i is not None], links)
    exact = sum(r.n_links == degree[r.vec_id] and r.component_id == root[r.vec_id] for r in got if r.vec_id is not None)
    assert exact >= 0.95 * (len(rows) - 1)
    for r in got:
        assert r.vec_id is None or r.n_links <= degree[r.vec_id]
    assert near_vectors.links(spark, table.limit(0)).count() == 0


@pytest.mark.parametrize("width", [5, 6])
def test_near_vectors_of_wide_codes(spark, width):
    """Buckets as narrow as those of large tables: the tables added keep the links at the threshold."""
    rng = np.random.default_rng(width)
    x, z = rng.normal(size=(2, 1000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    z -= (z * x).sum(axis=1, keepdims=True) * x
    z /= np.linalg.norm(z, axis=1, keepdims=True)
    y = 0.9505 * x + np.sqrt(1 - 0.9505**2) * z
    tables = near_vectors.tables_for(64, width, 0.95)
    assert tables > near_vectors.TABLES
    p, q = (near_vectors.buckets(v, width, tables) for v in (x, y))
    assert ((p[:, :, :1] == q) | (q[:, :, :1] == p)).any(axis=(1, 2)).mean() >= 0.99
    rows = [(i, v.tolist()) for i, v in enumerate(np.concatenate([x[:20], y[:20]]))]
    got = near_vectors.links(spark, spark.createDataFrame(rows, "vec_id long, embedding array<double>"), width=width)
    assert got.filter("n_links = 1 and component_id = vec_id % 20").count() == 40


def test_near_vectors_that_share_an_identifier(spark):
    a, near, far = [1.0, 0.0, 0.0, 0.0], [1.0, 0.1, 0.0, 0.0], [0.0, 0.0, 1.0, 0.0]
    rows = [(1, a), (1, far), (2, near), (3, far), (3, a), (4, [0.0, 1.0, 0.0, 0.0]), (4, [0.0, 0.0, 0.0, 1.0])]
    got = near_vectors.links(spark, spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in got) == [
        (1, 1, 1, True), (1, 2, 1, True), (2, 2, 1, False), (3, 1, 1, False), (3, 2, 1, False), (4, 0, 4, True), (4, 0, 4, True)
    ]


def test_components(spark):
    rng = random.Random(13)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(400, 460)]
    edges = spark.createDataFrame(links, "a long, b long")
    got = {r.node: r.component for r in components(spark, edges, Saved(spark)).collect()}
    nodes = sorted({n for pair in links for n in pair})
    want = groups(nodes, links)
    assert got == {n: want[n] for n in nodes if any(n in p and p[0] != p[1] for p in links)}


# --- the pipeline


def test_pipeline_stage_by_stage(spark, tmp_path):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, sizes = docs.columns, [docs.count()]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs
        stage(spark, docs, folder).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        sizes.append(docs.count())
        if k < 4:
            assert docs.columns == columns
        if k == 1:
            near = near_texts.join_near(spark, before)
            assert sizes[-1] == near.filter("kept").count() == near.select("class_id").distinct().count()
        if k == 2:
            assert sizes[-1] == sizes[-2] and docs.filter("text like '%token = \"%'").count() == 0
        if k == 3:
            assert sizes[-1] == mixing.mix(spark, before).agg(F.sum("copies")).first()[0]
    assert docs.select("piece").filter("piece = 0").count() == sizes[-2]
    assert sizes[1] >= 0.99 * sizes[0]


def test_pipeline_takes_an_empty_table(spark, nothing):
    docs = nothing
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, "")
    assert docs.count() == 0


def test_every_operator_is_registered():
    assert [n for n in queries.QUERIES if n.startswith("op")] == sorted((n for n in queries.QUERIES if n.startswith("op")), key=lambda n: int(n[2:].split("_")[0]))
    assert len(queries.QUERIES) == 14 and set(queries.ORACLES) <= set(queries.QUERIES)
