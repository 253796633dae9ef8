"""N-gram Jaccard join: a MinHash LSH forest, then exact verification.

Texts are sets of five-word shingles. Each tree holds a label of MinHash values for every text, signed
to the deepest level, and its labels are sorted: texts that share the first d values are neighbours
there, the trie's nodes of depth d. Tasks sort even ranges of (tree, label, text), so that a node of any
size spans as many tasks as it needs, and link every text to the first one of the deepest node that it
shares with the text before; the ends of the ranges, two rows a task, are linked in the same way.

Prefixes are as long as the trees are deep at first. Texts that meet are put into clusters, and within a
cluster every pair is compared exactly, in blocks, by matrix products over the shingles; pairs never
leave a task. The least similar link verified then says how short prefixes must be for links like it to
meet in some tree with the target probability: matched prefixes are shortened to that, clusters that
grew are compared again but for the pairs compared before, until nothing is left to shorten. Without a
link, and at the latest, prefixes end at the length with which a pair of just the threshold meets as
surely. Texts of equal words are one text with a weight.

Defined results: a null text or one without a word, and a null identifier, link with nothing; a text of
one to four words has one shingle, all its words; a text of any length is read whole; rows that share
the identifier count as rows of their own in n_links, and different texts under one identifier keep
their own links; an empty table gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .blocks import grouped, labels
from .common import Saved, append, components, pick
from .shingles import shingled

WORDS = "__words"
THRESHOLD, TREES, DEEPEST, TARGET, BLOCK, MARGIN = 0.8, 24, 8, 0.9999, 256, 0.02


def prefix_length(similarity: float, trees: int, deepest: int, target: float) -> int:
    """The longest prefix with which a pair of that similarity meets in some tree as surely as wanted."""
    length = deepest
    while length > 1 and 1 - (1 - similarity**length) ** trees < target:
        length -= 1
    return length


def _multipliers(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(11)
    return rng.integers(0, 1 << 32, (n, 1), dtype=np.uint32) | np.uint32(1), rng.integers(0, 1 << 32, (n, 1), dtype=np.uint32)


def minhash(shingles: np.ndarray, a: np.ndarray, b: np.ndarray, chunk: int = 2048) -> np.ndarray:
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    least = np.full(len(a), np.iinfo(np.uint32).max, np.uint32)
    for lo in range(0, len(x), chunk):
        y = (x[lo : lo + chunk] ^ b) * a
        y ^= y >> np.uint32(15)
        np.minimum(least, (y * np.uint32(0x2C1B3C6D)).min(axis=1), out=least)
    return least


def signatures(docs: DataFrame, trees: int = TREES, deepest: int = DEEPEST) -> DataFrame:
    """(doc_id, digest, signature): the labels of all trees one after the other, two bytes a level."""
    kind = pick(docs, "doc_id").schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = _multipliers(trees * deepest)
        for batch in batches:
            digests, signed = [None] * len(batch), [None] * len(batch)
            for row, digest, shingles in shingled(batch.column(1)):
                if digest is not None:
                    digests[row] = digest
                    # least values are small numbers: their upper halves differ only after a product
                    signed[row] = ((minhash(shingles, a, b) * np.uint32(0x9E3779B1)) >> np.uint32(16)).astype(">u2").tobytes()
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(digests, pa.binary()), pa.array(signed, pa.binary())], names=["doc_id", "digest", "signature"]
            )

    return pick(docs, "doc_id", "text").mapInArrow(run, f"doc_id {kind}, digest binary, signature binary")


def _descend(deepest: int, least: int, ends: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Sorted (tree, label, node) -> (a, b, level): each node with the first of the deepest prefix shared.

    With `ends`, the first and the last row are returned besides, as (a, null, null, tree, label).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, firsts, last = None, np.zeros(deepest + 1, np.int64), None
        for batch in batches:
            n = len(batch)
            if not n:
                continue
            tree, node = np.asarray(batch.column(0)).astype(np.int64), np.asarray(batch.column(2))
            label = np.frombuffer(b"".join(batch.column(1).to_pylist()), ">u2").reshape(n, deepest)
            values = np.column_stack([tree, label]).astype(np.int64)
            above = np.vstack([before if before is not None else values[:1] - 1, values[:-1]])
            # values shared with the row before; -1 in another tree
            shared = np.cumprod(values == above, axis=1).sum(axis=1) - 1
            starts = np.empty((deepest + 1, n), np.int64)
            for level in range(least, deepest + 1):
                spot = np.maximum.accumulate(np.where(shared < level, np.arange(n), -1))
                starts[level] = np.where(spot < 0, firsts[level], node[spot])
                firsts[level] = starts[level, -1]
            at = np.flatnonzero(shared >= least)
            yield _rows(node[at], starts[shared[at], at], shared[at])
            if ends and before is None:
                yield _rows(node[:1], None, None, batch.slice(0, 1))
            before, last = values[-1:], batch.slice(n - 1, 1)
        if ends and last is not None:
            yield _rows(np.asarray(last.column(2)), None, None, last)

    return run


_EDGE = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("level", pa.int32()), ("tree", pa.int32()), ("label", pa.binary())])


def _rows(a: np.ndarray, b: np.ndarray | None, level: np.ndarray | None, end: pa.RecordBatch | None = None) -> pa.RecordBatch:
    n = len(a)
    return pa.RecordBatch.from_arrays([
        pa.array(a, pa.int64()),
        pa.nulls(n, pa.int64()) if b is None else pa.array(b, pa.int64()),
        pa.nulls(n, pa.int32()) if level is None else pa.array(level.astype(np.int32)),
        pa.nulls(n, pa.int32()) if end is None else end.column(0).cast(pa.int32()),
        pa.nulls(n, pa.binary()) if end is None else end.column(1).cast(pa.binary()),
    ], schema=_EDGE)


def forest(signed: DataFrame, saved: Saved, trees: int = TREES, deepest: int = DEEPEST, least: int = 1) -> DataFrame:
    """(a, b, level) of (node, signature): edges that connect, for every prefix length from `least` on,
    exactly the nodes of a trie node of that depth by the edges of that level or deeper."""
    order, schema = ["tree", "label", "node"], "a long, b long, level int, tree int, label binary"
    entries = signed.select("node", "signature", F.explode(F.sequence(F.lit(0), F.lit(trees - 1))).alias("tree")).select(
        "tree", F.expr(f"substring(signature, tree * {2 * deepest} + 1, {2 * deepest})").alias("label"), "node"
    )
    found = saved(entries.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_descend(deepest, least, True), schema))
    ends = found.filter("tree is not null").select("tree", "label", F.col("a").alias("node"))
    joints = ends.coalesce(1).sortWithinPartitions(*order).mapInArrow(_descend(deepest, least, False), schema)
    return found.filter("level is not null").select("a", "b", "level").unionByName(joints.select("a", "b", "level"))


def _with_shingles(rows: DataFrame) -> DataFrame:
    """(node, cluster, nb, b, w, p, digest, text) -> the same with the shingle set instead of the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            wanted = batch.column(6).to_pylist()
            at, sets = [], []
            for row, digest, shingles in shingled(batch.column(7)):
                if digest == wanted[row]:  # rows that share the identifier may have another text
                    at.append(row)
                    sets.append(np.unique(shingles).tobytes())
            part = batch.take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([*part.columns[:6], pa.array(sets, pa.binary())], names=["node", "cluster", "nb", "b", "w", "p", "s"])

    return rows.mapInArrow(run, "node long, cluster long, nb int, b int, w long, p long, s binary")


def shared_counts(sets: list[np.ndarray], chunk: int = 4096) -> np.ndarray:
    """How many elements each two sets share."""
    m = len(sets)
    sizes = [len(x) for x in sets]
    values, column = np.unique(np.concatenate(sets), return_inverse=True)
    row = np.repeat(np.arange(m), sizes)
    held = np.bincount(column, minlength=len(values)) > 1
    number = np.cumsum(held) - 1
    keep = held[column]
    row, column = row[keep], number[column[keep]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    out = np.zeros((m, m))
    for lo in range(0, int(held.sum()), chunk):
        a, b = np.searchsorted(column, [lo, lo + chunk])
        dense = np.zeros((m, int(column[b - 1]) - lo + 1), np.float32)
        dense[row[a:b], column[a:b] - lo] = 1
        out += dense @ dense.T
    np.fill_diagonal(out, sizes)
    return out


def _verify(threshold: float):
    def compare(key: tuple, g: pa.Table) -> pa.Table | None:
        nodes, keep = np.unique(np.asarray(g["node"]), return_index=True)
        if len(nodes) < 2:
            return None
        side, weight, earlier = (np.asarray(g[c])[keep] for c in ("b", "w", "p"))
        new = earlier[:, None] != earlier[None, :]
        if key[1] != key[2]:
            new &= side[:, None] != side[None, :]
        if not new.any():
            return None
        sets = [np.frombuffer(x, np.uint64) for x in g["s"].take(pa.array(keep)).to_pylist()]
        shared = shared_counts(sets)
        sizes = np.array([len(x) for x in sets])
        similar = shared / (sizes[:, None] + sizes[None, :] - shared)
        a, b = np.nonzero(new & (similar >= threshold))
        if not len(a):
            return None
        links = np.bincount(a, weight[b], minlength=len(nodes)).astype(np.int64)
        used = np.unique(a)
        least = np.full(len(used), similar[a, b].min())
        return pa.table({"node": nodes[used], "links": links[used], "root": labels(len(nodes), a, b, nodes)[used], "least": least})

    return compare


def _compare(spark: SparkSession, saved: Saved, single: DataFrame, texts: DataFrame, clusters: DataFrame, earlier: DataFrame | None, threshold: float, block: int) -> DataFrame:
    """(node, links, root, least) of the pairs of each cluster that no earlier cluster held."""
    # a node of no earlier cluster is one by itself
    alone = F.bitwise_not(F.col("node")).alias("p")
    if earlier is None:
        at = clusters.select("node", "cluster", alone)
    else:
        past = earlier.select("node", F.col("cluster").alias("past"))
        at = clusters.join(past, "node", "left").select("node", "cluster", F.coalesce("past", F.bitwise_not(F.col("node"))).alias("p"))
    sizes = at.groupBy("cluster").agg(F.ceil(F.count("*") / block).cast("int").alias("nb"), F.min("p").alias("x"), F.max("p").alias("y"))
    members = (
        at.join(sizes.filter("x <> y").drop("x", "y"), "cluster").join(single.select("node", "doc_id", "digest", "w"), "node")
        .select("node", "cluster", "nb", F.pmod(F.xxhash64("node", F.lit(3)), F.col("nb")).cast("int").alias("b"), "w", "p", "digest", "doc_id")
    )
    held = _with_shingles(members.join(texts, "doc_id").select(*(c for c in members.columns if c != "doc_id"), "text"))
    pairs = held.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("nb") - 1))).select(
        "cluster", F.least("b", "other").alias("i"), F.greatest("b", "other").alias("j"), "node", "b", "w", "p", "s"
    )
    return saved(grouped(pairs, ["cluster", "i", "j"], _verify(threshold), "node long, links long, root long, least double"))


def near_classes(
    spark: SparkSession, docs: DataFrame, threshold: float = THRESHOLD, trees: int = TREES, deepest: int = DEEPEST,
    target: float = TARGET, block: int = BLOCK, margin: float = MARGIN,
) -> tuple[DataFrame, DataFrame]:
    """A row for each row of docs with the digest of its words besides, and the doc_ids of several rows.

    `target`: the probability with which a link meets in some tree; `margin`: how much less similar than
    the least similar link found others may be, where prefixes longer than the threshold's are enough.
    """
    saved = Saved(spark)
    signed = saved(signatures(docs, trees, deepest))
    usable = signed.filter("digest is not null and doc_id is not null")
    shared = saved(usable.groupBy("doc_id").agg(F.count("*").alias("m")).filter("m > 1").select("doc_id"))
    once = usable.groupBy("digest").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("w"), F.first("signature").alias("signature"))
    single = saved(once.withColumn("node", F.monotonically_increasing_id()))  # unique, and fixed once written
    texts = pick(docs, "doc_id", "text").filter("doc_id is not null and text is not null")
    if not shared.isEmpty():  # equal rows under one identifier would come into a block together
        texts = texts.join(shared, "doc_id", "left_anti").unionByName(texts.join(shared, "doc_id", "left_semi").dropDuplicates())

    saved.free()
    shortest = prefix_length(threshold, trees, deepest, target)
    edges = forest(single.select("node", "signature"), saved, trees, deepest, shortest)
    saved.free()
    level, clusters, found = deepest, None, []
    while True:
        earlier = clusters
        clusters = components(spark, edges.filter(F.col("level") >= level).select("a", "b"), saved).withColumnRenamed("component", "cluster")
        saved.free()
        found.append(_compare(spark, saved, single, texts, clusters, earlier, threshold, block))
        saved.free()
        least = min((x for f in found if (x := f.agg(F.min("least")).first()[0]) is not None), default=threshold)
        wanted = prefix_length(max(threshold, least - margin), trees, deepest, target)
        if wanted >= level:
            break
        level = wanted

    linked = reduce(DataFrame.unionByName, found)
    counted = linked.groupBy("node").agg(F.sum("links").alias("links"))
    connected = components(spark, linked.select(F.col("node").alias("a"), F.col("root").alias("b")), saved)
    saved.free()
    texts_of = single.select("digest", "doc_id", "w", "node").join(counted, "node", "left").join(connected, "node", "left").select(
        "digest", (F.coalesce("links", F.lit(0)) + F.col("w") - 1).alias("n"), F.coalesce("component", "node").alias("c"), F.col("doc_id").alias("t")
    )
    firsts = texts_of.groupBy("c").agg(F.min(F.struct("t", "digest")).alias("first"))
    classes = texts_of.join(firsts, "c").select("digest", "n", "t", F.col("first.t").alias("class"), (F.col("digest") == F.col("first.digest")).alias("leads"))
    keyed = signed.select("doc_id", F.when(F.col("doc_id").isNotNull(), F.col("digest")).alias("digest"))
    rows = keyed.join(classes, "digest", "left").select(
        "doc_id", F.coalesce("class", "doc_id").alias("class_id"), F.coalesce("n", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("t", "doc_id").alias("text_class"),
        F.coalesce(F.col("leads") & (F.col("doc_id") == F.col("class")), F.lit(True)).alias("kept"), "digest",
    )
    return rows, shared


def join_near(spark: SparkSession, docs: DataFrame, **options: float) -> DataFrame:
    """(doc_id, class_id, n_links, text_class, kept), a row for each row of docs; options of `near_classes`.

    class_id: the smallest doc_id reachable by links; n_links: other rows at the threshold or above,
    equal texts included; text_class: the smallest doc_id of the same words; kept: the row has the
    smallest doc_id of its class and, of different texts under it, that of the smallest digest.
    """
    return near_classes(spark, docs, **options)[0].drop("digest")


def drop_near(spark: SparkSession, docs: DataFrame, **options: float) -> DataFrame:
    """The rows of docs without near copies: one row of each class, and all rows that link with nothing.

    Rows go by identifier; where several rows share it, by identifier and words, one row of each.
    """
    rows, shared = near_classes(spark, docs, **options)
    gone = rows.filter("not kept")
    out = docs.join(gone.select("doc_id").join(shared, "doc_id", "left_anti"), "doc_id", "left_anti")
    if shared.isEmpty():
        return out.select(*docs.columns)
    # rows without a word have no digest and no copies: they stay with those of identifiers of their own
    digests = append(docs.join(shared, "doc_id", "left_semi").select(*docs.columns), ["text"], [T.StructField(WORDS, T.BinaryType())], _digests)
    doubtful = digests.filter(F.col(WORDS).isNotNull()).join(gone.select("doc_id", F.col("digest").alias(WORDS)), ["doc_id", WORDS], "left_anti")
    lone = digests.filter(F.col(WORDS).isNull())
    rest = doubtful.dropDuplicates(["doc_id", WORDS]).select(*docs.columns).unionByName(lone.select(*docs.columns))
    return out.join(shared, "doc_id", "left_anti").select(*docs.columns).unionByName(rest)


def _digests(text: pa.Array) -> list[pa.Array]:
    out: list[bytes | None] = [None] * len(text)
    for row, digest, _ in shingled(text):
        out[row] = digest
    return [pa.array(out, pa.binary())]
