"""Suffix-array dedup by bucket-pointer refinement: remove what a 200-byte string repeats anywhere.

Every place of a text gets the bucket of its q-gram, q = 64, as a 64-bit identifier. Buckets are refined
as in a suffix sorter: the identifier of twice the length is made of the identifier of a place and that of
the place one length on, so 1, 2, 4, … bytes lead to 64, and the same step applied to the refined buckets
leads on to 200. Sorting all places through the cluster at every step would move many times the corpus,
so only those that can matter take part:

1. Of the q-grams of a 200-byte window the one of the smallest identifier names the window's bucket. Equal
   windows have equal smallest q-grams, so they meet. Consecutive windows mostly share a bucket; such a run
   is one row, with a digest of all bytes it spans.
2. Buckets with a single run hold no repeat. In a bucket whose runs are all equal, all windows repeat.
3. In the other buckets runs of equal bytes are one class, and a class of several runs repeats. The others
   are refined by the identifiers at later offsets: the windows of a run lie in four ranges, and those of
   a range have 166 bytes in common, whose identifier comes from the buckets at three offsets. Ranges that
   are equal in all their bytes repeat. Where ranges of one identifier differ, the windows of one of each
   sort get the digest of their full 200 bytes, and equal windows repeat.
4. The repeated window starts of a text are gathered and their bytes removed.

Runs are made twice rather than kept, and a bitmap of fixed size, of hashed bucket or text identifiers,
keeps out of the second pass and of the joins what surely has no part in them. A full bitmap would keep
nothing out; results do not depend on it.

Defined results: a null or empty text has no bytes, nothing removed; texts shorter than the window lose
nothing; overlaps and repeats within one text count; equal rows are repeats of each other; texts of any
length are taken whole; an empty table gives an empty table; extra columns are ignored. A cut through a
character of several bytes leaves it broken in kept_text, where it shows as the replacement character;
kept_sha256 is of the exact bytes.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b, sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Saved, pick, utf8
from .shingles import mix

WINDOW, GRAM, LONGEST_RUN = 200, 64, 256
_BYTE = np.random.default_rng(21).integers(1, 1 << 63, 256, dtype=np.uint64)
_STEP = np.random.default_rng(22).integers(1, 1 << 63, 64, dtype=np.uint64) | np.uint64(1)

RUNS = "m long, s long, k long, p int, n int, inner boolean, a int, e array<long>"
#: Ranges of a run's windows, and the bits of a bitmap (2 MB).
PARTS, BITS = 4, 1 << 24


def bitmap(df: DataFrame, name: str) -> np.ndarray:
    """Which remainders of the numbers occur, a bit for each."""
    at = F.pmod(F.col(name), F.lit(BITS)) + 1
    rows = df.select(at.alias("h")).groupBy(F.bitmap_bucket_number("h").alias("b")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("h")).alias("v")
    ).collect()
    out = np.zeros(BITS // 8, np.uint8)
    for r in rows:
        part = np.frombuffer(bytes(r["v"]), np.uint8)
        out[(r["b"] - 1) * len(part) : r["b"] * len(part)] = part
    return out


def has(bits: np.ndarray, numbers: np.ndarray) -> np.ndarray:
    h = numbers.astype(np.int64) % BITS
    return (bits[h >> 3] >> (h & 7).astype(np.uint8)) & 1 == 1


def ranges(window: int, gram: int) -> list[tuple[int, int, int]]:
    """(first, last, length): windows that begin so many bytes before the bucket's q-gram have in common
    the bytes from `first` before it, `length` long."""
    room = window - gram
    step = -(-room // PARTS)
    return [(f, min(f + step - (f + step < room), room), gram + room - step) for f in range(0, max(room, 1), max(step, 1))]


def buckets(data: np.ndarray, gram: int = GRAM) -> np.ndarray:
    """Bucket identifiers of the q-grams at every place, refined from bytes by doubling."""
    at, have, level = _BYTE[data], 1, 0
    while have < gram:
        step = min(have, gram - have)  # the last step may overlap
        longer = at[: len(at) - step] * _STEP[level]
        longer += at[step:]
        at, have, level = longer, have + step, level + 1
    return mix(at)


def extreme(at: np.ndarray, width: int, of: np.ufunc = np.minimum) -> np.ndarray:
    """The minimum (or maximum) of each `width` neighbours, by doubling."""
    have = 1
    while have < width:
        step = min(have, width - have)
        at = of(at[: len(at) - step], at[step:])
        have += step
    return at


def runs(body: np.ndarray, wanted: np.ndarray | None = None, mixed: np.ndarray | None = None, window: int = WINDOW, gram: int = GRAM, longest: int = LONGEST_RUN) -> tuple | None:
    """(bucket, digest, first window, windows, whether windows of it can be equal, place of the bucket's
    q-gram, whether ranges are given) as arrays, of the runs of one text, and identifiers of the ranges and
    then their digests, and which of these there are, a row for each run with ranges; with bitmaps, of the
    wanted buckets alone, and ranges of the mixed ones alone. None: no run."""
    if len(body) < window:
        return None
    ids = buckets(body, gram)
    width = window - gram + 1
    least = extreme(ids, width)
    begins = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
    ends = np.append(begins[1:], len(least))
    # a place is the smallest of some window if the largest minimum of the windows around is its own; the
    # places of a run follow each other, and where there are several, windows of the run can be equal
    room = np.zeros(width - 1, np.uint64)
    spots = np.flatnonzero(extreme(np.concatenate([room, least, room]), width, np.maximum) == ids)
    names = ids[spots]
    firsts = np.flatnonzero(np.concatenate([[True], names[1:] != names[:-1]]))
    inner, places = np.diff(np.append(firsts, len(spots))) > 1, spots[firsts]
    if wanted is not None:
        some = has(wanted, least[begins].view(np.int64))
        begins, ends, inner, places = begins[some], ends[some], inner[some], places[some]
        if not len(begins):
            return None
    keys = least[begins].view(np.int64)
    fine = has(mixed, keys) & ~inner if mixed is not None else np.zeros(len(keys), bool)
    codes, there = _codes(ids, begins[fine], ends[fine], places[fine], window, gram)
    # long runs in several rows
    rows = -(-(ends - begins) // longest)
    run = np.repeat(np.arange(len(begins)), rows)
    p = begins[run] + (np.arange(len(run)) - np.repeat(np.cumsum(rows) - rows, rows)) * longest
    n = np.minimum(p + longest, ends[run]) - p
    digest = _digest(ids, p, n + window - 1, gram).view(np.int64)
    # a run without a repeated q-gram is one row
    return keys[run], digest, p, n, inner[run], places[run], fine[run], codes, there


def _digest(ids: np.ndarray, begin: np.ndarray, span: np.ndarray, gram: int) -> np.ndarray:
    """Identifiers of the bytes from `begin` on, `span` long, by the q-grams that cover them."""
    digest = span.astype(np.uint64)
    for o in range(0, int(span.max(initial=0)), gram):
        digest = mix(digest * _STEP[-1] + ids[begin + np.minimum(o, span - gram)])
    return digest


def _codes(ids: np.ndarray, lo: np.ndarray, hi: np.ndarray, a: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Identifiers of the ranges of runs, then digests of all bytes of their windows, and which there are."""
    first, last, length = np.array(ranges(window, gram)).T
    lo, hi, a = lo[:, None], hi[:, None], a[:, None]
    begin, stop = np.maximum(lo, a - last), np.minimum(hi - 1, a - first)
    some = begin <= stop  # else the run has no window of this range
    there = np.hstack([some, some])
    at = np.hstack([a - first, begin])
    span = np.hstack([np.broadcast_to(length, some.shape), stop - begin + window])
    codes = np.zeros(there.shape, np.uint64)
    codes[there] = _digest(ids, at[there], span[there], gram)
    return codes.view(np.int64), there


def _key() -> Column:
    return F.xxhash64("doc_id", "text")


def _runs_of(docs: DataFrame, wanted: np.ndarray, mixed: np.ndarray, window: int, gram: int) -> DataFrame:
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.int32()]
    names = ["m", "s", "k", "p", "n", "inner", "a", "e"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, limits = utf8(batch.column(1))
            held, rows = [], 0
            for i, key in enumerate(batch.column(0).to_pylist()):
                found = runs(data[limits[i] : limits[i + 1]], wanted, mixed, window, gram)
                if found:
                    m, s, *rest = found
                    held.append((m, s, np.full(len(m), key, np.int64), *rest))
                    rows += len(m)
                if held and (rows >= 50_000 or i == len(batch) - 1):
                    *cols, fine, codes, there = (np.concatenate(c) for c in zip(*held, strict=True))
                    arrays = [pa.array(c).cast(t) for c, t in zip(cols, kinds, strict=True)]
                    ends = np.concatenate([[0], np.cumsum(fine * codes.shape[1])]).astype(np.int32)
                    values = pa.array(codes.ravel(), mask=~there.ravel())
                    lists = pa.ListArray.from_arrays(pa.array(ends), values, mask=pa.array(~fine))
                    yield pa.RecordBatch.from_arrays([*arrays, lists], names=names)
                    held, rows = [], 0

    return docs.select("k", "text").mapInArrow(run, RUNS)


def _all_runs(docs: DataFrame, window: int, gram: int) -> DataFrame:
    """(m, s, inner) of every run: what tells which buckets matter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, limits = utf8(batch.column(0))
            held, rows = [], 0
            for i in range(len(batch)):
                found = runs(data[limits[i] : limits[i + 1]], window=window, gram=gram)
                if found:
                    held.append((found[0], found[1], found[4]))
                    rows += len(found[0])
                if held and (rows >= 50_000 or i == len(batch) - 1):
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*held, strict=True)], names=["m", "s", "inner"])
                    held, rows = [], 0

    return docs.select("text").mapInArrow(run, "m long, s long, inner boolean")


def only(docs: DataFrame, bits: np.ndarray) -> DataFrame:
    """The rows whose k the bitmap has."""
    at = docs.columns.index("k")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(has(bits, np.asarray(batch.column(at)))))

    return docs.mapInArrow(run, docs.schema)


def _windows_of(rows: DataFrame, window: int) -> DataFrame:
    """(k, text, rs: list of (p, n, one)) -> (k, p, one, w1, w2) of every window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, limits = utf8(batch.column(1))
            for i, (k, listed) in enumerate(zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True)):
                body = data[limits[i] : limits[i + 1]].tobytes()
                rows = [(p, r["one"]) for r in listed for p in range(r["p"], r["p"] + r["n"])]
                if not rows:
                    continue
                ids = np.frombuffer(b"".join(blake2b(body[p : p + window], digest_size=16).digest() for p, _ in rows), np.int64).reshape(-1, 2)
                places, alone = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([k] * len(rows), pa.int64()), pa.array(places, pa.int32()), pa.array(alone, pa.bool_()), pa.array(ids[:, 0].copy()), pa.array(ids[:, 1].copy())],
                    names=["k", "p", "one", "w1", "w2"],
                )

    return rows.mapInArrow(run, "k long, p int, one boolean, w1 long, w2 long")


def repeated_windows(spark: SparkSession, docs: DataFrame, saved: Saved, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """(k, p, n): the windows from p to p + n - 1 of the text k are repeated."""
    held = saved(
        _all_runs(docs, window, gram).groupBy("m").agg(
            F.count("*").alias("c"), F.min("s").alias("lo"), F.max("s").alias("hi"), F.max("inner").alias("any_inner")
        ).filter("c > 1 or any_inner").select("m", (F.expr("lo <> hi") | F.col("any_inner")).alias("mixed"))
    )
    wanted, refine = bitmap(held, "m"), bitmap(held.filter("mixed"), "m")
    hit = saved(_runs_of(docs, wanted, refine, window, gram).join(held, "m"))
    saved.free()
    plain = hit.filter("not mixed").select("k", "p", "n")
    mixed = hit.filter("mixed")
    classes = saved(mixed.groupBy("m", "s").agg(
        F.count("*").alias("c"), F.min(F.struct("k", "p", "n", "a", "e")).alias("r"), F.max("inner").alias("inner")
    ).select("m", "s", "c", "inner", "r.*"))
    copied = mixed.join(classes.filter("c > 1").select("m", "s"), ["m", "s"]).select("k", "p", "n")
    # windows that may be equal within a run can also equal those of any class of their bucket
    loose = classes.groupBy("m").agg(F.max("inner").alias("i")).filter("i").select("m")
    whole = classes.join(loose, "m").select("k", "p", "n", (F.col("c") == 1).alias("one"))
    spread = ranges(window, gram)
    first, last = (F.element_at(F.array(*(F.lit(r[i]) for r in spread)), F.col("j") + 1) for i in (0, 1))
    begin = F.greatest(F.col("p"), F.col("a") - last)
    by_range = (
        classes.join(loose, "m", "left_anti").filter("e is not null")
        .select("m", "c", "k", "p", "n", "a", "e", F.posexplode(F.slice("e", 1, len(spread))).alias("j", "code")).filter("code is not null")
        .select("m", "c", "k", "j", "code", F.element_at("e", F.col("j") + 1 + len(spread)).alias("full"), begin.alias("p"),
                (F.least(F.col("p") + F.col("n") - 1, F.col("a") - first) - begin + 1).alias("n"))
    )
    sorts = saved(by_range.groupBy("m", "j", "code", "full").agg(F.sum("c").alias("t"), F.min(F.struct("k", "p", "n")).alias("r")))
    saved.free()
    equal = by_range.filter("c = 1").join(sorts.filter("t > 1").select("m", "j", "code", "full"), ["m", "j", "code", "full"]).select("k", "p", "n")
    meet = sorts.groupBy("m", "j", "code").agg(F.count("*").alias("x"), F.min("t").alias("y")).filter("x > 1 and y = 1").select("m", "j", "code")
    some = sorts.join(meet, ["m", "j", "code"]).select("r.k", "r.p", "r.n", (F.col("t") == 1).alias("one"))
    listed = saved(some.unionByName(whole).groupBy("k").agg(F.collect_list(F.struct("p", "n", "one")).alias("rs")))
    near = only(docs.select("k", "text"), bitmap(listed, "k")).join(listed, "k").select("k", "text", "rs")
    # a text that occurs in several equal rows gives its windows several times, but none of them is alone
    windows = saved(_windows_of(near, window))
    saved.free()
    twice = windows.groupBy("w1", "w2").agg(F.count("*").alias("x"), F.max("one").alias("y")).filter("x > 1 and y").select("w1", "w2")
    refined = windows.filter("one").join(twice, ["w1", "w2"]).select("k", "p", F.lit(1).alias("n"))
    return plain.unionByName(copied).unionByName(equal).unionByName(refined)


def _keep(length: int, p: np.ndarray, n: np.ndarray, window: int) -> tuple[np.ndarray, int]:
    """Which bytes stay, and the number of removed runs."""
    step = np.zeros(length + 1, np.int32)
    np.add.at(step, p, 1)
    np.add.at(step, p + n - 1 + window, -1)
    gone = np.cumsum(step[:-1]) > 0
    edges = np.count_nonzero(gone[1:] & ~gone[:-1]) + int(length > 0 and gone[0])
    return ~gone, edges


def remove_repeats(spark: SparkSession, docs: DataFrame, window: int = WINDOW, gram: int = GRAM, with_text: bool = True) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256[, kept_text]), a row for each row of docs."""
    saved = Saved(spark)
    rows = pick(docs, "doc_id", "text").withColumn("k", _key())
    starts = saved(repeated_windows(spark, rows, saved, window, gram).groupBy("k").agg(F.collect_list(F.struct("p", "n")).alias("rs")))
    saved.free()
    bits = bitmap(starts, "k")
    schema = T.StructType([
        rows.schema["doc_id"], *(T.StructField(x, T.LongType()) for x in ("n_bytes", "n_removed", "n_spans")),
        T.StructField("kept_sha256", T.StringType()), *([T.StructField("kept_text", T.StringType())] if with_text else []),
    ])
    kinds = [pa.int64()] * 3 + [pa.string()] * (1 + with_text)

    def result(doc_id: pa.Array, out: list[tuple]) -> pa.RecordBatch:
        cols = zip(*out, strict=True) if out else [()] * len(kinds)
        return pa.RecordBatch.from_arrays([doc_id, *(pa.array(c, t) for c, t in zip(cols, kinds, strict=True))], names=schema.names)

    def row(kept: bytes, n_bytes: int, spans: int) -> tuple:
        out = (n_bytes, n_bytes - len(kept), spans, sha256(kept).hexdigest())
        return (*out, kept.decode(errors="replace")) if with_text else out

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, limits = utf8(batch.column(1))
            lists = batch.column(2)
            at, flat = np.asarray(lists.offsets), lists.values
            p, n = (np.asarray(flat.field(i)) for i in (0, 1))
            out = []
            for i in range(len(batch)):
                body = data[limits[i] : limits[i + 1]]
                lo, hi = (int(at[i]), int(at[i + 1])) if lists[i].is_valid else (0, 0)
                stays, spans = _keep(len(body), p[lo:hi], n[lo:hi], window) if hi > lo else (slice(None), 0)
                out.append(row(body[stays].tobytes(), len(body), spans))
            yield result(batch.column(0), out)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Texts that surely have no repeat need no join."""
        for batch in batches:
            batch = batch.filter(pa.array(~has(bits, np.asarray(batch.column(2)))))
            data, limits = utf8(batch.column(1))
            bodies = [data[lo:hi].tobytes() for lo, hi in zip(limits[:-1].tolist(), limits[1:].tolist(), strict=True)]
            yield result(batch.column(0), [row(x, len(x), 0) for x in bodies])

    joined = only(rows, bits).join(starts, "k", "left").select("doc_id", "text", "rs")
    return joined.mapInArrow(cut, schema).unionByName(rows.mapInArrow(whole, schema))
