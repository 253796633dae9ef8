"""Embedding near-dedup: cross-polytope hashing after fast Hadamard rotations, multiprobe, verification.

A vector is rotated by three rounds of random signs and a fast Hadamard transform; its hash is the
coordinate of the largest size, with its sign. A table's bucket joins several such hashes, as many as
make the buckets outnumber the vectors; the more it joins, the more tables there are, by the share of random
pairs at the threshold that meet in one table. Every vector lies in one bucket of each table, its own, and
also looks into the buckets where its second-largest coordinates would put it. Buckets that hold a
vector's own place and another entry are compared in blocks, by matrix products in double precision.
A link is counted in the first bucket that shows it, so no pairs leave a task.

Defined results: null, zero and non-finite vectors, and vectors with a null or non-finite component,
link with nothing; vectors of different lengths are not compared; a null identifier links with nothing;
equal vectors are compared once and counted as often as they occur; rows that share an identifier are
vectors of their own, each with the links and the component of its own vector; an empty table gives an empty table; ties of coordinates go to the
first.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .blocks import grouped, labels
from .common import Saved, components, pick

TABLES, PROBES, BLOCK = 12, 7, 256
#: Share of the links at the threshold itself, the hardest ones, that the tables are to show.
RECALL = 0.999


@lru_cache(maxsize=16)
def _signs(dim: int, hashes: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed + dim).choice([-1.0, 1.0], (hashes, 3, dim))


def _hadamard(x: np.ndarray) -> np.ndarray:
    """Along the last axis, whose length is a power of two."""
    n, step = x.shape[-1], 1
    while step < n:
        y = x.reshape(*x.shape[:-1], n // (2 * step), 2, step)
        x = np.stack([y[..., 0, :] + y[..., 1, :], y[..., 0, :] - y[..., 1, :]], axis=-2).reshape(x.shape)
        step *= 2
    return x / np.sqrt(n)


def buckets(vectors: np.ndarray, width: int, tables: int = TABLES, probes: int = PROBES, seed: int = 5) -> np.ndarray:
    """(vectors, tables, probes): first the own bucket, then the likeliest other ones."""
    n, dim = vectors.shape
    size = 1 << max(dim - 1, 0).bit_length()
    padded = np.zeros((n, size))
    padded[:, :dim] = vectors
    out = np.empty((n, tables, probes), np.int64)
    signs = _signs(size, tables * width, seed)
    rows = np.arange(n)
    for t in range(tables):
        code = np.zeros(n, np.int64)
        gaps, changes = np.empty((n, width)), np.empty((n, width), np.int64)
        for k in range(width):
            x = padded
            for r in range(3):
                x = _hadamard(x * signs[t * width + k, r])
            a = np.abs(x)
            best = a.argmax(axis=1)
            top = a[rows, best].copy()
            a[rows, best] = -1
            second = a.argmax(axis=1)
            scale = (2 * size) ** k
            one = best + size * (x[rows, best] < 0)
            two = second + size * (x[rows, second] < 0)
            code += one * scale
            gaps[:, k] = top - a[rows, second]
            changes[:, k] = (two - one) * scale
        # all subsets of hashes that take their second coordinate, by the size given up
        subsets = np.arange(1 << width)
        member = (subsets[:, None] >> np.arange(width)) & 1
        cost = gaps @ member.T
        chosen = np.argsort(cost, axis=1, kind="stable")[:, :probes]
        moved = changes @ member.T
        codes = code[:, None] + np.take_along_axis(moved, chosen, axis=1)
        if codes.shape[1] < probes:
            codes = np.concatenate([codes, np.repeat(codes[:, :1], probes - codes.shape[1], axis=1)], axis=1)
        # one number space for all tables and lengths
        out[:, t] = (codes * tables + t) * 4099 + dim % 4099
    return out


def tables_for(dim: int, width: int, threshold: float, probes: int = PROBES, recall: float = RECALL, pairs: int = 1000) -> int:
    """So many tables show a pair of cosine `threshold` with probability `recall`: by random pairs, TABLES at least."""
    if not -1 < threshold < 1 or dim < 2:
        return TABLES
    rng = np.random.default_rng(dim)
    x, z = rng.normal(size=(2, pairs, dim))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    z -= (z * x).sum(axis=1, keepdims=True) * x
    z /= np.linalg.norm(z, axis=1, keepdims=True)
    a, b = (buckets(v, width, 4, probes) for v in (x, threshold * x + np.sqrt(1 - threshold**2) * z))
    met = ((a[:, :, :1] == b) | (b[:, :, :1] == a)).any(axis=2).mean()
    if met >= recall:
        return TABLES
    return max(TABLES, int(np.ceil(np.log(1 - recall) / np.log1p(-max(met, 0.02)))))


def _matrix(col: pa.Array) -> np.ndarray:
    flat = np.asarray(col.flatten(), np.float64)
    return flat.reshape(len(col), -1)


def _unit(x: np.ndarray) -> np.ndarray:
    # the largest component first, so that no square overflows or vanishes
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _by_length(col: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    lengths = np.diff(np.asarray(col.offsets))
    for n in np.unique(lengths):
        at = np.flatnonzero(lengths == n)
        yield at, _matrix(col.take(pa.array(at)))


def links(spark: SparkSession, vectors: DataFrame, threshold: float = 0.95, tables: int | None = None, probes: int = PROBES, block: int = BLOCK, width: int | None = None) -> DataFrame:
    """(vec_id, n_links, component_id, kept), a row for each row of (vec_id, embedding).

    The number of hashes joined (`width`, 6 at most) and of tables follow from the vectors if not given.
    """
    saved = Saved(spark)
    rows = pick(vectors, "vec_id", "embedding").withColumn("embedding", F.col("embedding").cast("array<double>"))
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    fine = F.col("vec_id").isNotNull() & (F.size("embedding") > 0) & ~bad & F.exists("embedding", lambda x: x != 0)
    valid = rows.filter(F.coalesce(fine, F.lit(False)))
    # equal vectors are one, with a weight
    digest = F.sha2(F.array_join(F.transform("embedding", lambda x: (x + 0.0).cast("string")), ","), 256)
    once = valid.groupBy(digest.alias("digest")).agg(F.min("vec_id").alias("vec_id"), F.first("embedding").alias("v"), F.count("*").alias("w"))
    single = saved(once.withColumn("id", F.monotonically_increasing_id()))  # unique, and fixed once written
    total, length = single.agg(F.count("*"), F.max(F.size("v"))).first()
    size = 2 * (1 << max((length or 1) - 1, 0).bit_length())
    if width is None:
        width = 1
        while size**width < 4 * total and width < 6:
            width += 1
    tables = tables or tables_for(length or 1, width, threshold, probes)

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = np.asarray(b.column(0))
            for at, x in _by_length(b.column(1)):
                found = buckets(_unit(x), width, tables, probes)
                own = np.zeros(found.shape, bool)
                own[:, :, 0] = True
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(ids[at], tables * probes)), pa.array(found.ravel()), pa.array(own.ravel())], names=["id", "bucket", "own"]
                )

    entries = saved(single.select("id", "v").mapInArrow(places, "id long, bucket long, own boolean").groupBy("id", "bucket").agg(F.max("own").alias("own")))
    # a bucket matters if it is some vector's own and holds an entry besides
    counts = entries.groupBy("bucket").agg(F.count("*").alias("m"), F.max("own").alias("any_own")).filter("m > 1 and any_own")
    blocks = F.ceil(F.col("m") / block).cast("int")
    held = entries.join(counts, "bucket").select(
        "bucket", "id", "own", blocks.alias("nb"), F.pmod(F.xxhash64("id", F.lit(3)), blocks).cast("int").alias("b")
    )
    pairs = held.join(single.select("id", "v", "w"), "id").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
    pairs = pairs.select(
        "bucket", F.least("b", "other").alias("i"), F.greatest("b", "other").alias("j"), "b", "id", "own", "v", "w"
    )

    def verify(key: tuple, g: pa.Table) -> pa.Table | None:
        ids, side, own = (np.asarray(g[c]) for c in ("id", "b", "own"))
        x = _unit(_matrix(g["v"].combine_chunks()))
        near = x @ x.T >= threshold
        near &= own[:, None] | own[None, :]
        np.fill_diagonal(near, False)
        if key[1] != key[2]:
            near &= side[:, None] != side[None, :]
        a, b = np.nonzero(near)
        if not len(a):
            return None
        # the first bucket that shows a pair counts it
        used = np.unique(a)
        spot = np.zeros(len(ids), np.int64)
        spot[used] = np.arange(len(used))
        codes = buckets(x[used], width, tables, probes)
        first = np.zeros(len(a), bool)
        for lo in range(0, len(a), 1 << 14):
            p, q = codes[spot[a[lo : lo + (1 << 14)]]], codes[spot[b[lo : lo + (1 << 14)]]]
            seen = np.where(q == p[:, :, :1], q, np.iinfo(np.int64).max).min(axis=2)
            seen = np.minimum(seen, np.where(p == q[:, :, :1], p, np.iinfo(np.int64).max).min(axis=2))
            first[lo : lo + (1 << 14)] = seen.min(axis=1) == key[0]
        weights = np.bincount(a[first], np.asarray(g["w"])[b[first]], minlength=len(ids)).astype(np.int64)
        root = labels(len(ids), a, b, ids)
        return pa.table({"id": ids[used], "links": weights[used], "root": root[used]})

    found = saved(grouped(pairs, ["bucket", "i", "j"], verify, "id long, links long, root long"))
    counted = found.groupBy("id").agg(F.sum("links").alias("links"))
    connected = components(spark, found.select(F.col("id").alias("a"), F.col("root").alias("b")), saved)
    vectors_of = single.select("digest", "vec_id", "id", "w").join(counted, "id", "left").join(connected, F.col("node") == F.col("id"), "left").select(
        "digest", "vec_id", (F.coalesce("links", F.lit(0)) + F.col("w") - 1).alias("n"), F.coalesce("component", "id").alias("component")
    )
    # partial minima go to the shuffle; the join is by a column that adaptive execution can split
    least = vectors_of.groupBy("component").agg(F.min("vec_id").alias("c"))
    classes = vectors_of.join(least, "component").select("digest", "n", "c")
    keyed = rows.select("vec_id", F.when(F.coalesce(fine, F.lit(False)), digest).alias("digest"))
    return keyed.join(classes, "digest", "left").select(
        "vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), F.coalesce("c", "vec_id").alias("component_id"),
        (F.col("vec_id") == F.coalesce("c", "vec_id")).alias("kept"),
    )
