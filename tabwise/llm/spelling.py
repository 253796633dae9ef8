"""Spelling variant grouping: k-d trees over letter counts find the words one edit apart.

One inserted, deleted or replaced letter changes the vector of a word's letter counts by an L1 distance of at
most two, and of one where the lengths differ. So the words of each length lie in k-d trees over these
vectors. Every word searches the tree of its own length within distance two and that of the next length
within one; a subtree is left out if its box is farther away. At a leaf the distance itself is checked (two
count vectors share as many letters as their unary forms have ones in common, one matrix product), and of
the words left the order of the letters decides.

The upper part of a length's tree deals its words to shards of bounded size; a word is sent to the shards
whose boxes it reaches. Its splits come from a sample of at most about SAMPLE words and decide only how even
the shards are. A shard builds the rest of the tree, finds the pairs and returns a row for each word; pairs
never leave it. Links from a word to its form lead to a word at least ``ratio`` times as frequent, so a chain
is short and pointer doubling ends it.

Defined results: a null or empty text has no words; a null doc_id plants no slip; a word without a near word
has no form and is its own root; of near words of equal counts the smallest in code-point order is the form;
texts and words of any length are taken whole; repeated rows count like any others; an empty table gives an
empty table; extra columns are ignored.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .blocks import grouped
from .common import Saved, pick, text_of

LEAST_LENGTH, LEAST_COUNT, RATIO, SLIP = 7, 2, 10, 31
SAMPLE, SHARD, LEAF, MOST_TASKS = 100_000, 30_000, 96, 20_000
LETTERS = 26 + 64
#: The number of each letter by its Latin-1 byte: a to z, then U+00C0 to U+00FF.
_NUMBER = np.zeros(256, np.int64)
_NUMBER[ord("a") : ord("z") + 1] = np.arange(26)
_NUMBER[0xC0:] = 26 + np.arange(64)


# --- the vocabulary


def vocabulary(docs: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, slip: int | None = None, most: int = 300_000) -> DataFrame:
    """(word, n): the runs of letters of all texts, A to Z in lower case, long and frequent enough.

    With ``slip``, one run in so many, by the hash of its document and itself, loses a letter first.
    """
    letters = re.compile(rb"[a-z\xc0-\xff]{%d,}" % least_length)

    def batch_of(counts: Counter) -> pa.RecordBatch:
        words = pa.array([w.decode("latin-1") for w in counts], pa.string())
        return pa.RecordBatch.from_arrays([words, pa.array(counts.values(), pa.int64())], names=["word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), text_of(batch.column(1)), strict=True):
                found = Counter(letters.findall(text.encode("latin-1", "replace").lower()))
                if slip and doc_id is not None:
                    begun = zlib.crc32(f"{doc_id}:".encode())
                    for word, n in found.items():
                        h = zlib.crc32(word if word.isascii() else word.decode("latin-1").encode(), begun)
                        if h % slip == 0:
                            at = h % len(word)
                            word = word[:at] + word[at + 1 :]
                        if len(word) >= least_length:
                            total[word] += n
                else:
                    total.update(found)
                if len(total) >= most:
                    yield batch_of(total)
                    total = Counter()
        if total:
            yield batch_of(total)

    counted = pick(docs, "doc_id", "text").mapInArrow(run, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least_count)


# --- k-d trees


@dataclass
class Split:
    """Vectors with at most `cut` of the letter go left."""

    letter: int
    cut: int
    left: Split | int
    right: Split | int


def letter_counts(words: np.ndarray) -> np.ndarray:
    """(words, length) bytes -> (words, LETTERS)."""
    n, length = words.shape
    at = _NUMBER[words] + np.arange(n)[:, None] * LETTERS
    return np.bincount(at.ravel(), minlength=n * LETTERS).reshape(n, LETTERS)


def build(vectors: np.ndarray, leaves: int, held: list[np.ndarray]) -> Split | int:
    """A k-d tree with about that many leaves; `held` gets the rows of each. Equal vectors stay together."""

    def grow(rows: np.ndarray, leaves: int) -> Split | int:
        part = vectors[rows]
        if leaves > 1 and len(rows) > 1:
            letter = int(part.var(axis=0).argmax())
            values = part[:, letter]
            if values.min() < values.max():
                cut = min(int(np.partition(values, len(rows) // 2)[len(rows) // 2]), int(values.max()) - 1)
                below = values <= cut
                return Split(letter, cut, grow(rows[below], leaves // 2), grow(rows[~below], leaves - leaves // 2))
        held.append(rows)
        return len(held) - 1

    return grow(np.arange(len(vectors)), leaves)


def reach(tree: Split | int, vectors: np.ndarray, radius: int) -> Iterator[tuple[int, np.ndarray]]:
    """(leaf, rows) of the vectors that are within the L1 distance of the leaf's box."""
    todo = [(tree, np.arange(len(vectors)), np.zeros(len(vectors), np.int64), {})]
    while todo:
        node, rows, far, box = todo.pop()
        if not len(rows):
            continue
        if isinstance(node, int):
            yield node, rows
            continue
        x = vectors[rows, node.letter]
        low, high = box.get(node.letter, (0, None))
        before = np.maximum(low - x, 0) if high is None else np.maximum(np.maximum(low - x, x - high), 0)
        for side, lo, hi in ((node.left, low, node.cut), (node.right, node.cut + 1, high)):
            now = np.maximum(lo - x, 0) if hi is None else np.maximum(np.maximum(lo - x, x - hi), 0)
            apart = far - before + now
            some = apart <= radius
            todo.append((side, rows[some], apart[some], {**box, node.letter: (lo, hi)}))


def leaf_of(tree: Split | int, vectors: np.ndarray) -> np.ndarray:
    out = np.empty(len(vectors), np.int64)
    for leaf, rows in reach(tree, vectors, 0):
        out[rows] = leaf
    return out


# --- pairs of a shard


def unary(vectors: np.ndarray, most: np.ndarray) -> np.ndarray:
    """A one for each letter of a word, up to `most` of each: a product counts the letters two words share."""
    letter = np.repeat(np.arange(LETTERS), most)
    rank = np.arange(len(letter)) - np.repeat(np.cumsum(most) - most, most)
    return (vectors[:, letter] > rank).astype(np.float32)


def one_edit(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which rows of letters are exactly one edit apart; b's have the length of a's, or one letter more."""
    if a.shape[1] == b.shape[1]:
        return (a != b).sum(axis=1) == 1
    n = a.shape[1]
    front = np.logical_and.accumulate(a == b[:, :n], axis=1).sum(axis=1)
    back = np.logical_and.accumulate((a == b[:, 1:])[:, ::-1], axis=1).sum(axis=1)
    return front + back >= n


class Shard:
    """The words of one length that a shard holds, their classes of equal counts, and the tree over these."""

    def __init__(self, words: np.ndarray):
        self.words = words
        counts = letter_counts(words)
        self.vectors, of = np.unique(counts, axis=0, return_inverse=True)
        of = of.ravel()
        self.members = np.argsort(of, kind="stable")
        self.begin = np.searchsorted(of[self.members], np.arange(len(self.vectors) + 1))
        self.leaves: list[np.ndarray] = []
        self.tree = build(self.vectors, -(-len(self.vectors) // LEAF), self.leaves)
        self.most = self.vectors.max(axis=0)
        self.ones = unary(self.vectors, self.most)

    def near(self, words: np.ndarray, step: int = 8192, pairs: int = 1 << 19) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(number among `words`, number in the shard) of the words one edit apart."""
        n, length = words.shape
        shorter = self.words.shape[1] - length
        need = length - (shorter == 0)  # letters that words one edit apart share
        order = np.lexsort(np.sort(words, axis=1).T)
        vectors = letter_counts(words[order])
        begins = np.flatnonzero(np.concatenate([[True], (vectors[1:] != vectors[:-1]).any(axis=1)])) if n else np.zeros(0, np.int64)
        ends, vectors = np.append(begins[1:], n), vectors[begins]
        for lo in range(0, len(begins), step):
            part = vectors[lo : lo + step]
            ones = unary(part, self.most)
            for leaf, rows in reach(self.tree, part, 2 - shorter):
                classes = self.leaves[leaf]
                shared = ones[rows] @ self.ones[classes].T
                # words of equal letters are no single edit apart
                a, b = np.nonzero(shared == need if not shorter else shared >= need)
                a, b = rows[a] + lo, classes[b]
                size = (ends[a] - begins[a]) * (self.begin[b + 1] - self.begin[b])
                cuts = [0, *(np.flatnonzero(np.diff(np.cumsum(size) // pairs)) + 1).tolist(), len(size)]
                for x, y in zip(cuts[:-1], cuts[1:], strict=True):
                    yield from self._verified(words, order, begins, ends, a[x:y], b[x:y], size[x:y])

    def _verified(self, words, order, begins, ends, a, b, size) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        which = np.repeat(np.arange(len(a)), size)
        k = np.arange(len(which)) - np.repeat(np.cumsum(size) - size, size)
        wide = (self.begin[b + 1] - self.begin[b])[which]
        left, right = order[begins[a][which] + k // wide], self.members[self.begin[b][which] + k % wide]
        ok = one_edit(words[left], self.words[right])
        if ok.any():
            yield left[ok], right[ok]


def _letters(words: list[bytes], length: int) -> np.ndarray:
    return np.frombuffer(b"".join(words), np.uint8).reshape(len(words), length)


_FOUND = "word string, n_near long, n long, form string"


def _shard(_: tuple, g: pa.Table) -> pa.Table | None:
    """The near words of a shard's own words and of those that search it: how many, and the most frequent."""
    words = [w.encode("latin-1") for w in g["word"].to_pylist()]
    counts, own = np.asarray(g["n"]), np.asarray(g["own"])
    length = len(words[int(own.argmax())]) if own.any() else 0
    sizes = np.array([len(w) for w in words])
    held = np.flatnonzero(own)
    if not len(held):
        return None
    shard = Shard(_letters([words[i] for i in held.tolist()], length))
    one, other = [], []
    for size in (length, length - 1):
        asks = np.flatnonzero(sizes == size)
        if len(asks):
            for a, b in shard.near(_letters([words[i] for i in asks.tolist()], size)):
                one.append(asks[a])
                other.append(held[b])
                if size < length:  # words of different length are searched from the shorter one alone
                    one.append(held[b])
                    other.append(asks[a])
    if not one:
        return None
    one, other = np.concatenate(one), np.concatenate(other)
    rank = np.empty(len(words), np.int64)
    rank[sorted(range(len(words)), key=words.__getitem__)] = np.arange(len(words))
    order = np.lexsort((rank[other], -counts[other], one))
    one, other = one[order], other[order]
    first = np.flatnonzero(np.concatenate([[True], one[1:] != one[:-1]]))
    n_near = np.diff(np.append(first, len(one)))
    return pa.table({
        "word": g["word"].take(pa.array(one[first])), "n_near": n_near, "n": counts[other[first]],
        "form": g["word"].take(pa.array(other[first])),
    })


# --- all shards


@dataclass
class Top:
    """The upper part of the tree of one length; its leaves are shards, numbered from `first`."""

    tree: Split | int
    first: int


def plan_shards(sizes: dict[int, int], sample: list[str], shard: int = SHARD) -> tuple[dict[int, Top], int]:
    """The upper tree of each length that has words, and the number of shards."""
    by_length: dict[int, list[bytes]] = {length: [] for length in sizes}
    for w in sample:
        by_length[len(w)].append(w.encode("latin-1"))
    tops, shards = {}, 0
    for length in sorted(sizes):
        leaves: list[np.ndarray] = []
        tree = build(letter_counts(_letters(by_length[length], length)), -(-sizes[length] // shard), leaves)
        tops[length] = Top(tree, shards)
        shards += len(leaves)
    return tops, shards


def _route(tops: dict[int, Top]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = [w.encode("latin-1") for w in batch.column(0).to_pylist()]
            sizes = np.array([len(w) for w in words])
            for length in np.unique(sizes).tolist():
                rows = np.flatnonzero(sizes == length)
                vectors = letter_counts(_letters([words[i] for i in rows.tolist()], length))
                home = leaf_of(tops[length].tree, vectors)
                for size, radius in ((length, 2), (length + 1, 1)):
                    if size not in tops:
                        continue
                    for leaf, some in reach(tops[size].tree, vectors, radius):
                        part = batch.take(pa.array(rows[some]))
                        own = pa.array(home[some] == leaf) if size == length else pa.array(np.zeros(len(some), bool))
                        to = pa.array(np.full(len(some), tops[size].first + leaf, np.int32))
                        yield pa.RecordBatch.from_arrays([to, own, *part.columns], names=["shard", "own", "word", "n"])

    return run


def near_words(words: DataFrame, shard: int = SHARD, sample: int = SAMPLE) -> DataFrame:
    """(word, n) -> (word, n_near, n, form): of each word that has near words, how many, and the most frequent.

    ``words`` is read several times and must not change; words are of the letters of `vocabulary`.
    """
    sizes = {r["k"]: r["n"] for r in words.groupBy(F.length("word").alias("k")).agg(F.count("*").alias("n")).collect()}
    total = sum(sizes.values())
    some = words.filter(F.pmod(F.xxhash64("word"), F.lit(max(total, 1))) < sample)
    tops, shards = plan_shards(sizes, [r["word"] for r in some.select("word").collect()], shard)
    dealt = words.select("word", "n").mapInArrow(_route(tops), "shard int, own boolean, word string, n long")
    found = grouped(dealt, ["shard"], _shard, _FOUND, min(max(shards, 1), MOST_TASKS))
    best = F.min(F.struct((-F.col("n")).alias("n"), "form")).alias("b")
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best).select(
        "word", "n_near", (-F.col("b.n")).alias("n"), F.col("b.form").alias("form")
    )


def group_variants(spark: SparkSession, words: DataFrame, ratio: int = RATIO, shard: int = SHARD, sample: int = SAMPLE) -> DataFrame:
    """(word, n) -> (word, form, root, n, n_near, form_n), a row for each word."""
    saved = Saved(spark)
    words = saved(words.select("word", "n"))
    near = near_words(words, shard, sample).withColumnRenamed("n", "form_n")
    common = F.col("form_n") >= ratio * F.col("n")
    rows = saved(words.join(near, "word", "left").select(
        "word", F.when(common, F.col("form")).alias("form"), "n",
        F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(common, F.col("form_n")).alias("form_n"),
    ))
    links = rows.filter("form is not null").select("word", F.col("form").alias("root"))
    most = rows.agg(F.max("n").alias("n")).first()["n"] or 1
    steps = max(1, int(math.log(most, ratio)) + 1)  # no chain is longer
    for _ in range(math.ceil(math.log2(steps))):
        ahead = links.select(F.col("word").alias("root"), F.col("root").alias("next"))
        links = saved(links.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root")))
    return rows.join(links, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )
