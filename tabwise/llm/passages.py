"""Substring dedup by fixed-block anchors: remove the words of every passage that occurs twice.

A window of 35 words holds at least one whole block of 18 words that begins at a multiple of 18. The blocks
of all texts are the index; every rolling window of 18 words of every text probes it.

1. Equal texts become one text with a count; all its windows are repeated if the count is above one.
2. Tasks send the hashes of rolling windows, each once for some millions of words, and the blocks with their
   places to the bucket of the hash. A bucket's index counts its probes: a block that is found more often
   than by itself is an anchor.
3. Anchors are extended: the windows around them that have no whole block without an anchor are all that can
   be repeated. Their digests meet in buckets in the same way, and windows of equal digests are repeats: 64
   bits within a bucket that an independent hash chooses, so of N windows N / 2^46 are expected to be taken
   for others, whatever N. Consecutive ones make up the maximal exact repeats.
4. The words of the repeated windows go.

A hash that thousands of texts share is sent once by a task, with its places answered in the task itself,
so no bucket holds all places of a passage. Buckets grow in number, not in size.

Defined results: a null or empty text, or one without a word, has no words and an empty kept text; texts
shorter than the window lose nothing; overlaps and repeats within one text count; equal rows are repeats of
each other; texts of any length are taken whole; an empty table gives an empty table; extra columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .blocks import grouped
from .common import WORD, Saved, pick, utf8
from .shingles import mix, rows_in_blocks, word_hashes

WINDOW = 35
#: Words that a task hashes before it sends them, text bytes and windows of a bucket.
FLUSH, BUCKET_BYTES, BUCKET_WINDOWS = 1_000_000, 32 << 20, 1 << 19
MOST_TASKS = 20_000
_STEPS = np.random.default_rng(41).integers(1, 1 << 63, (2, 16), dtype=np.uint64) | np.uint64(1)
_SENT = "bucket int, once binary, more binary, rest binary, unit binary, place binary"
_PLACE = "u long, p int"


def rolling(words: np.ndarray, width: int, family: int = 0) -> np.ndarray:
    """Hashes of every `width` neighbouring word hashes, by doubling."""
    at, have, level = words, 1, 0
    while have < width:
        step = min(have, width - have)  # the last step may overlap
        at = at[: max(len(at) - step, 0)] * _STEPS[family, level] + at[step:]
        at, have, level = mix(at), have + step, level + 1
    return at


def bucket_of(hashes: np.ndarray, buckets: int) -> np.ndarray:
    return ((hashes >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int32)


def texts_of(batches: Iterator[pa.RecordBatch], most: int = FLUSH) -> Iterator[tuple[list[pa.RecordBatch], np.ndarray, np.ndarray]]:
    """(rows, word hashes, limits) of about `most` words at a time; batches hold the text in their second column."""
    rows, hashes, limits, n = [], [], [np.zeros(1, np.int64)], 0
    for batch in batches:
        for lo, hi, data, at in rows_in_blocks(batch.column(1)):
            words, ends = word_hashes(data, at)
            rows.append(batch.slice(lo, hi - lo))
            hashes.append(words)
            limits.append(ends[1:] + n)
            n += len(words)
            if n >= most:
                yield rows, np.concatenate(hashes), np.concatenate(limits)
                rows, hashes, limits, n = [], [], [np.zeros(1, np.int64)], 0
    if rows:
        yield rows, np.concatenate(hashes), np.concatenate(limits)


def _column(rows: list[pa.RecordBatch], name: str) -> np.ndarray:
    return np.concatenate([np.asarray(b.column(b.schema.get_field_index(name))) for b in rows])


def _split(buckets: int, of: np.ndarray, *arrays: np.ndarray) -> list[list[bytes]]:
    """The bytes of each array in each bucket, in the arrays' order."""
    order = np.argsort(of, kind="stable")
    cuts = np.searchsorted(of[order], np.arange(1, buckets))
    return [[x.tobytes() for x in np.split(a[order], cuts)] for a in arrays]


def sent(buckets: int, of: np.ndarray, rest: np.ndarray, counts: np.ndarray, owner: np.ndarray, unit: np.ndarray, place: np.ndarray) -> Iterator[pa.RecordBatch]:
    """What a task sends: each key once, whether it occurs once or more, and the places of keys that have one.

    `of` has the bucket of each distinct key, `rest` what tells the keys of a bucket apart; `owner` numbers the
    key of each place. Places of keys that occur more than once need no answer: they go on as they are, dealt
    by their text.
    """
    known, single = counts[owner] > 1, counts == 1
    once = _split(buckets, of[single], rest[single])[0]
    more = _split(buckets, of[~single], rest[~single])[0]
    asked = ~known
    columns = _split(buckets, of[owner[asked]], rest[owner[asked]], unit[asked], place[asked])
    rows = [list(range(buckets)), once, more, *columns]
    dealt = (unit[known] % buckets).astype(np.int32)
    units, places = _split(buckets, dealt, unit[known], place[known])
    some = [b for b in range(buckets) if units[b]]
    rows = [[*a, *b] for a, b in zip(rows, [some, *[[b""] * len(some)] * 3, [units[b] for b in some], [places[b] for b in some]], strict=True)]
    full = [i for i in range(len(rows[0])) if any(c[i] for c in rows[1:])]
    kinds = [pa.int32(), *[pa.binary()] * 5]
    for lo in range(0, len(full), 256):
        part = full[lo : lo + 256]
        yield pa.RecordBatch.from_arrays(
            [pa.array([c[i] for i in part], k) for c, k in zip(rows, kinds, strict=True)], names=["bucket", "once", "more", "rest", "unit", "place"]
        )


def _answers(kind: np.dtype) -> Callable[[tuple, pa.Table], pa.Table | None]:
    """The places of a bucket whose key occurs more than once."""

    def compute(_: tuple, g: pa.Table) -> pa.Table | None:
        def held(name: str, of: np.dtype, some: list[bool] | None = None) -> np.ndarray:
            raw = g[name].to_pylist()
            return np.frombuffer(b"".join(x for i, x in enumerate(raw) if some is None or some[i]), of)

        asked = [bool(x) for x in g["rest"].to_pylist()]
        known = [not x for x in asked]
        rest, unit, place = held("rest", kind), held("unit", np.int64, asked), held("place", np.int32, asked)
        index = np.unique(rest)
        seen = np.zeros(len(index) + 1, np.int64)
        for name, weight in (("once", 1), ("more", 2)):
            probes = held(name, kind)
            at = np.searchsorted(index, probes)
            at[at < len(index)] = np.where(index[at[at < len(index)]] == probes[at < len(index)], at[at < len(index)], len(index))
            seen += weight * np.bincount(at, minlength=len(index) + 1)
        hit = seen[np.searchsorted(index, rest)] > 1
        units = np.concatenate([unit[hit], held("unit", np.int64, known)])
        places = np.concatenate([place[hit], held("place", np.int32, known)])
        return pa.table({"u": units, "p": places}) if len(units) else None

    return compute


def _probe(block: int, buckets: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(u, text, c) -> rolling windows and blocks, by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, words, limits in texts_of(batches):
            size = np.diff(limits)
            row = np.repeat(np.arange(len(size)), size)
            place = np.arange(len(words)) - limits[:-1][row]
            grams = rolling(words, block)
            inside = place[: len(grams)] + block <= size[row[: len(grams)]]
            at = np.flatnonzero(inside)
            weight = np.minimum(_column(rows, "c"), 2)[row[at]]
            keys, of = np.unique(grams[at], return_inverse=True)
            counts = np.bincount(of, weight, len(keys)).astype(np.int64)
            begins = place[at] % block == 0
            unit = _column(rows, "u")[row[at]]
            rest = (keys & np.uint64(0xFFFFFFFF)).astype(np.uint32)
            yield from sent(buckets, bucket_of(keys, buckets), rest, counts, of[begins], unit[begins], (place[at] // block)[begins].astype(np.int32))

    return run


def candidates(n: int, anchors: np.ndarray, window: int, block: int) -> np.ndarray:
    """Where windows begin that hold no whole block but anchors, in a text of n words."""
    begins = np.arange(max(n - window + 1, 0))
    plain = np.ones(n // block + 1, np.int64)
    plain[anchors] = 0
    before = np.concatenate([[0], np.cumsum(plain)])
    return begins[before[(begins + window) // block] == before[-(-begins // block)]]


def _extend(window: int, block: int, buckets: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(u, text, c, anchors) -> digests of the windows that may be repeated, by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, words, limits in texts_of(batches):
            anchors = [x for b in rows for x in b.column(3).to_pylist()]
            at = [lo + candidates(int(hi - lo), np.array(a, np.int64), window, block) for lo, hi, a in zip(limits[:-1].tolist(), limits[1:].tolist(), anchors, strict=True)]
            row = np.repeat(np.arange(len(at)), [len(x) for x in at])
            at = np.concatenate(at)
            digest, bucket = rolling(words, window)[at], bucket_of(rolling(words, window, 1)[at], buckets)
            order = np.lexsort((digest, bucket))
            keys, held = digest[order], bucket[order]
            first = np.ones(len(at), bool)
            first[1:] = (keys[1:] != keys[:-1]) | (held[1:] != held[:-1])
            of = np.empty(len(at), np.int64)
            of[order] = np.cumsum(first) - 1
            copies = _column(rows, "c")[row]
            counts = np.bincount(of, np.minimum(copies, 2), int(first.sum())).astype(np.int64)
            alone = copies == 1  # all windows of a text with copies are repeated anyway
            unit = _column(rows, "u")[row]
            yield from sent(buckets, held[first], keys[first], counts, of[alone], unit[alone], (at - limits[:-1][row])[alone].astype(np.int32))

    return run


def _cut(texts: DataFrame, window: int, with_text: bool) -> DataFrame:
    """(key, text, c, ps) -> the words that stay."""
    schema = "key binary, n_words long, n_removed long, spans array<struct<start:long,end:long>>, kept_sha256 string"
    schema += ", kept_text string" if with_text else ""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, limits = utf8(batch.column(1))
            raw = data.tobytes()
            counts, removed, spans, digests, texts = [], [], [], [], []
            copies = batch.column(2).to_pylist()
            for i, places in enumerate(batch.column(3)):
                words = raw[int(limits[i]) : int(limits[i + 1])].split()
                n, edges = len(words), np.zeros(0, np.int64)
                if n >= window and copies[i] > 1:
                    edges, kept = np.array([0, n]), []
                elif places.is_valid:
                    step = np.zeros(n + 2, np.int32)
                    at = np.asarray(places.values)
                    np.add.at(step, at + 1, 1)
                    np.add.at(step, at + window + 1, -1)
                    gone = np.cumsum(step) > 0  # shifted by one, so that spans at the ends have edges
                    edges = np.flatnonzero(gone[1:] != gone[:-1])
                    kept = [words[x] for x in np.flatnonzero(~gone[1:-1]).tolist()] if n else []
                else:
                    kept = words
                body = b" ".join(kept)
                counts.append(n)
                removed.append(n - len(kept))
                spans.append([{"start": a, "end": b} for a, b in edges.reshape(-1, 2).tolist()])
                digests.append(sha256(body).hexdigest())
                texts.append(body)
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            out = [batch.column(0), pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, kind), pa.array(digests, pa.string())]
            if with_text:
                out.append(pa.array(texts, pa.binary()).cast(pa.string()))
            yield pa.RecordBatch.from_arrays(out, names=["key", "n_words", "n_removed", "spans", "kept_sha256", "kept_text"][: len(out)])

    return texts.mapInArrow(run, schema)


def _anchors(texts: DataFrame, saved: Saved, block: int, buckets: int) -> DataFrame:
    """(u, p): block p of the text u occurs elsewhere."""
    probes = texts.select("u", "text", "c").mapInArrow(_probe(block, buckets), _SENT)
    return saved(grouped(probes, ["bucket"], _answers(np.dtype(np.uint32)), _PLACE, min(buckets, MOST_TASKS)))


def _repeated(texts: DataFrame, anchors: DataFrame, saved: Saved, window: int, block: int, buckets: int) -> DataFrame:
    """(u, p): the window at word p of the text u, which has no copies, occurs elsewhere."""
    around = anchors.groupBy("u").agg(F.collect_list("p").alias("ps"))
    meet = texts.join(around, "u").select("u", "text", "c", "ps")
    dealt = meet.mapInArrow(_extend(window, block, buckets), _SENT)
    return saved(grouped(dealt, ["bucket"], _answers(np.dtype(np.uint64)), _PLACE, min(buckets, MOST_TASKS)))


def _key(text: Column) -> Column:
    return F.unhex(F.substring(F.sha2(F.coalesce(text, F.lit("")), 256), 1, 32))


def remove_passages(spark: SparkSession, docs: DataFrame, window: int = WINDOW, with_text: bool = True, bucket_bytes: int = BUCKET_BYTES, bucket_windows: int = BUCKET_WINDOWS) -> DataFrame:
    """(doc_id, n_words, n_removed, spans, kept_sha256[, kept_text]), a row for each row of docs.

    spans: the removed stretches as (first word, end word), the maximal unions of repeated windows.
    """
    saved, block = Saved(spark), (window + 1) // 2
    rows = pick(docs, "doc_id", "text").withColumn("key", _key(F.col("text")))
    texts = saved(
        rows.groupBy("key").agg(F.first(F.coalesce("text", F.lit(""))).alias("text"), F.count("*").alias("c"))
        .select(F.monotonically_increasing_id().alias("u"), "text", "c", "key", F.octet_length("text").cast("long").alias("bytes")),
        compression="zstd",
    )
    saved.free()
    total = texts.agg(F.sum("bytes").alias("b")).first()["b"] or 0
    anchors = _anchors(texts, saved, block, 1 + total // bucket_bytes)
    saved.free()
    windows = _repeated(texts, anchors, saved, window, block, 1 + anchors.count() * block // bucket_windows)
    saved.drop(anchors)
    saved.free()
    places = windows.groupBy("u").agg(F.collect_list("p").alias("ps"))
    cut = _cut(texts.join(places, "u", "left").select("key", "text", "c", "ps"), window, with_text)
    return rows.select("doc_id", "key").join(cut, "key").drop("key")


#: DuckDB SQL for (doc_id, n_words, n_removed, kept_sha256).
ORACLE = f"""
WITH texts AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '{WORD}') AS words FROM documents),
windows AS (SELECT r, unnest(range(1, len(words) - {WINDOW} + 2)) AS p, words FROM texts),
repeated AS (
  SELECT r, p FROM (SELECT r, p, sha256(array_to_string(words[p : p + {WINDOW - 1}], ' ')) AS k FROM windows)
  QUALIFY count(*) OVER (PARTITION BY k) > 1),
gone AS (SELECT DISTINCT r, p + unnest(range(0, {WINDOW})) AS i FROM repeated),
listed AS (SELECT r, doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS i FROM texts),
kept AS (
  SELECT r, count(*) AS n, string_agg(word, ' ' ORDER BY i) AS t FROM listed ANTI JOIN gone USING (r, i) GROUP BY r)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(len(words) - coalesce(n, 0) AS BIGINT) AS n_removed,
  sha256(coalesce(t, '')) AS kept_sha256
FROM texts LEFT JOIN kept USING (r)"""
