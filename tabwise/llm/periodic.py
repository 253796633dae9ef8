"""Periodic run detection: suffix-tree LCE and Lyndon roots.

A run is a stretch of consecutive words whose smallest period is q, at least ``least`` words and
``exponent`` periods long, that neither neighbouring word extends. The words of a document become numbers.
Ukkonen's algorithm builds the suffix tree of that sequence and of its reversal; an Euler tour over the
leaves turns the longest common extension of two places into the depth of a lowest common ancestor, a range
minimum in constant time. Every run has a Lyndon root with regard to one of the two orders of the words, and
that root is the longest Lyndon word at its place, which ends at the next place of smaller (or, for the
reversed order, greater) suffix. So a sequence has at most two candidates a place; each is extended in both
directions, and those that turn out long enough are the runs.

Only words that can lie in a run go into the trees: every word of a run is covered by a short gram that
occurs again at the run's period, at most an ``exponent``-th of the stretch away. Other words are replaced,
a gap at a time, by a number of their own, which can be in no run. Grams are compared by hashes, which can
only let too many words in; the trees compare the words themselves.

Defined results: a null or empty text, or one without a word, has no runs and an empty collapsed text; a
text of any length is taken whole; overlapping runs of several periods are all reported, by start, then
period; repeated rows each get their result; an empty table gives an empty table; extra columns are kept,
and a column with the name of a result is replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WORD, append
from .shingles import mix, rows_in_blocks, word_hashes

LEAST, EXPONENT = 6, 4
RUN = T.StructType([T.StructField(x, T.LongType()) for x in ("start", "length", "period")])
FIELDS = [
    T.StructField("n_words", T.LongType()), T.StructField("runs", T.ArrayType(RUN)),
    T.StructField("collapsed_text", T.StringType()),
]
_STEPS = np.random.default_rng(31).integers(1, 1 << 63, 8, dtype=np.uint64) | np.uint64(1)


# --- which words can lie in a run


def gram_length(least: int, exponent: int) -> int:
    """The longest gram, up to 5 words, that has a twin inside every run that is long enough."""
    if exponent < 2:
        raise ValueError("a run has at least two periods")
    return max(1, min(5, *(max(least, exponent * q) - 2 * q + 1 for q in range(1, least + 2))))


def stretches(words: np.ndarray, rows: np.ndarray, least: int, exponent: int) -> list[tuple[int, int]]:
    """Places [begin, end) in the words of several texts, given by the rows' limits, that contain all runs."""
    k = gram_length(least, exponent)
    row = np.repeat(np.arange(len(rows) - 1), np.diff(rows))
    at = np.flatnonzero(np.arange(len(words)) + k <= rows[1:][row])
    if not len(at):
        return []
    grams = row[at].astype(np.uint64) * _STEPS[-1]
    for j in range(k):
        grams += words[at + j] * _STEPS[j]
    order = np.argsort(mix(grams), kind="stable")
    grams, places = grams[order], at[order]
    far = np.int64(len(words) + 1)
    step = np.where(grams[1:] == grams[:-1], places[1:] - places[:-1], far)
    nearest = np.minimum(np.concatenate([step, [far]]), np.concatenate([[far], step]))
    places, nearest = places[nearest < far], nearest[nearest < far]
    while len(places):
        edge = np.zeros(len(words) + 1, np.int32)
        np.add.at(edge, places, 1)
        np.add.at(edge, places + k, -1)
        inside = np.cumsum(edge[:-1]) > 0
        starts = inside.copy()
        starts[1:] &= ~inside[:-1] | (row[1:] != row[:-1])
        begin = np.flatnonzero(starts)
        number = np.cumsum(starts) - 1
        size = np.bincount(number[inside], minlength=len(begin))
        held = size[number[places]]
        stay = (held >= least) & (exponent * nearest <= held)
        if stay.all():
            return list(zip(begin.tolist(), (begin + size).tolist(), strict=True))
        places, nearest = places[stay], nearest[stay]
    return []


# --- suffix trees


def suffix_tree(s: list[int]) -> tuple[list[int], list[int], dict[int, int], int]:
    """Ukkonen's algorithm. The last number of s occurs once.

    (where each node's edge begins in s, where it ends, children by node * base + first number, base);
    node 0 is the root, the edge of a leaf ends with s.
    """
    n, base = len(s), max(s) + 1
    first, last, link, child = [0], [0], [0], {}
    node = edge = length = left = 0
    for i in range(n):
        c, waiting, left = s[i], 0, left + 1
        while left:
            if not length:
                edge = i
            key = node * base + s[edge]
            below = child.get(key)
            if below is None:
                child[key] = len(first)
                first.append(i)
                last.append(n)
                link.append(0)
                if waiting:
                    link[waiting] = node
                    waiting = 0
            else:
                begin, end = first[below], last[below]
                span = (end if end <= i else i + 1) - begin
                if length >= span:
                    edge, length, node = edge + span, length - span, below
                    continue
                if s[begin + length] == c:
                    length += 1
                    if waiting:
                        link[waiting] = node
                    break
                middle = len(first)
                child[key] = middle
                first += (begin, i)
                last += (begin + length, n)
                link += (0, 0)
                first[below] = begin + length
                child[middle * base + c] = middle + 1
                child[middle * base + s[begin + length]] = below
                if waiting:
                    link[waiting] = middle
                waiting = middle
            left -= 1
            if node:
                node = link[node]
            elif length:
                length, edge = length - 1, i - left + 1
    return first, last, child, base


class Extension:
    """Longest common extensions of any two places of s, whose last number occurs once."""

    def __init__(self, s: list[int]):
        first, last, child, base = suffix_tree(s)
        keys = np.fromiter(child, np.int64, len(child))
        order = np.argsort(keys)
        above = (keys // base)[order]
        nodes = np.fromiter(child.values(), np.int64, len(child))[order].tolist()
        limits = np.searchsorted(above, np.arange(len(first) + 1)).tolist()
        n = len(s)
        leaves, meet = [], []
        # the Euler tour, children by first number; a leaf notes the depth of the last branch before it
        todo = [(0, 0, 0)]
        while todo:
            node, depth, branch = todo.pop()
            lo, hi = limits[node], limits[node + 1]
            if lo == hi:
                leaves.append(n - depth)
                meet.append(branch)
                continue
            for x in range(hi - 1, lo, -1):
                below = nodes[x]
                todo.append((below, depth + last[below] - first[below], depth))
            below = nodes[lo]
            todo.append((below, depth + last[below] - first[below], branch))
        self.rank = np.empty(n, np.int64)
        self.rank[leaves] = np.arange(n)
        self.levels = [np.array(meet, np.int32)]
        while 2 << (len(self.levels) - 1) <= n:
            half, low = 1 << (len(self.levels) - 1), self.levels[-1]
            self.levels.append(np.minimum(low[: len(low) - half], low[half:]))

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """For different places a and b."""
        a, b = self.rank[a], self.rank[b]
        lo, hi = np.minimum(a, b) + 1, np.maximum(a, b) + 1
        level = np.frexp(hi - lo)[1] - 1
        out = np.empty(len(a), np.int64)
        for k in np.unique(level).tolist():
            some = level == k
            low = self.levels[k]
            out[some] = np.minimum(low[lo[some]], low[hi[some] - (1 << k)])
        return out


def lyndon_ends(rank: list[int]) -> tuple[list[int], list[int]]:
    """For each place where the longest Lyndon word ends that begins there, in both orders (the length: nowhere)."""
    n = len(rank)
    smaller, greater = [n] * n, [n] * n
    low: list[int] = []
    high: list[int] = []
    for i, r in enumerate(rank):
        while low and rank[low[-1]] > r:
            smaller[low.pop()] = i
        while high and rank[high[-1]] < r:
            greater[high.pop()] = i
        low.append(i)
        high.append(i)
    return smaller, greater


def runs_of(s: list[int], least: int = LEAST, exponent: int = EXPONENT) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of a sequence of numbers, by start, then period."""
    n = len(s)
    if n < max(least, 2):
        return []
    ahead = Extension([*(x + 1 for x in s), 0])
    back = Extension([*(x + 1 for x in reversed(s)), 0])
    begin = np.tile(np.arange(n), 2)
    end = np.concatenate([np.array(x[:n]) for x in lyndon_ends(ahead.rank.tolist())])
    period = end - begin
    some = (end <= n) & (exponent * period <= n)
    begin, end, period = begin[some], end[some], period[some]
    if not len(begin):
        return []
    right, left = np.zeros(len(begin), np.int64), np.zeros(len(begin), np.int64)
    inner, after = np.flatnonzero(end < n), np.flatnonzero(begin > 0)
    right[inner] = ahead(begin[inner], end[inner])
    left[after] = back(n - begin[after], n - end[after])
    length = left + period + right
    long = length >= np.maximum(least, exponent * period)
    found = np.unique(np.stack([(begin - left)[long], period[long], length[long]], axis=1), axis=0)
    return [(a, c, b) for a, b, c in found.tolist()]


def text_runs(words: list[bytes], spans: list[tuple[int, int]], least: int, exponent: int) -> list[tuple[int, int, int]]:
    """The runs of a text, which lie in the spans of its words."""
    ids: dict[bytes, int] = {}
    s: list[int] = []
    at: list[int] = []
    for k, (lo, hi) in enumerate(spans):
        if k:
            s.append(-k)  # stands for all words between two spans
            at.append(-1)
        s += [ids.setdefault(w, len(ids)) for w in words[lo:hi]]
        at += range(lo, hi)
    gaps = len(spans) - 1
    return [(at[a], n, q) for a, n, q in runs_of([x + gaps for x in s], least, exponent)]


# --- the operator


def find_runs(docs: DataFrame, least: int = LEAST, exponent: int = EXPONENT) -> DataFrame:
    """docs with n_words, runs (start, length, period; words numbered from 0) and collapsed_text.

    The collapsed text keeps a run's first period and leaves out the run's other words; kept words are
    joined by one space.
    """

    def compute(text: pa.Array) -> list[pa.Array]:
        counts, found, texts = [], [], []
        for row, stop, data, limits in rows_in_blocks(text):
            hashes, rows = word_hashes(data, limits)
            spans: dict[int, list[tuple[int, int]]] = {}
            for lo, hi in stretches(hashes, rows, least, exponent):
                i = int(np.searchsorted(rows, lo, side="right")) - 1
                spans.setdefault(i, []).append((lo - int(rows[i]), hi - int(rows[i])))
            body = data.tobytes()
            for i in range(stop - row):
                words = body[int(limits[i]) : int(limits[i + 1])].split()
                runs = text_runs(words, spans[i], least, exponent) if i in spans else []
                counts.append(len(words))
                found.append([{"start": a, "length": n, "period": q} for a, n, q in runs])
                if runs:
                    edge = np.zeros(len(words) + 1, np.int64)
                    for a, n, q in runs:
                        edge[a + q] += 1
                        edge[a + n] -= 1
                    gone = np.cumsum(edge[:-1]) > 0
                    words = [words[x] for x in np.flatnonzero(~gone).tolist()]
                texts.append(b" ".join(words))
        kind = pa.list_(pa.struct([(f.name, pa.int64()) for f in RUN.fields]))
        return [pa.array(counts, pa.int64()), pa.array(found, kind), pa.array(texts, pa.binary()).cast(pa.string())]

    return append(docs, ["text"], FIELDS, compute, step=500)


def plant_periods(docs: DataFrame) -> DataFrame:
    """docs in which one text of ten, by its doc_id, ends in a repeated stretch of its own words."""
    h = F.crc32(F.col("doc_id").cast("string"))
    words = F.regexp_extract_all("text", F.lit(WORD), F.lit(0))
    planted = docs.withColumn("h", h).withColumn("ws", F.when(F.col("h") % 10 == 0, words))
    g, n = F.floor(F.col("h") / 10), F.size("ws")
    planted = planted.withColumn("a", F.when(n > 0, g % n).cast("int"))
    planted = planted.withColumn("p", (1 + F.floor((n - F.col("a")) / (3 + g % 8))).cast("int"))

    def word(w: Column, i: Column) -> Column:
        return F.when(i < F.col("a"), w).otherwise(F.get("ws", (F.col("a") + (i - F.col("a")) % F.col("p")).cast("int")))

    text = F.when(F.col("a").isNotNull(), F.array_join(F.transform("ws", word), " ")).otherwise(F.col("text"))
    return planted.select(*(text.alias("text") if c == "text" else c for c in docs.columns))


def digests(found: DataFrame) -> DataFrame:
    """(doc_id, n_runs, the longest run and its exponent, digests of all runs and of the collapsed text)."""
    negated = F.transform("runs", lambda r: F.struct((-r["length"]).alias("l"), r["start"].alias("s"), r["period"].alias("q")))
    top = F.array_min(negated)
    lines = F.transform("runs", lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n")))
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), top["s"].alias("start"), (-top["l"]).alias("length"),
        top["q"].alias("period"), F.floor(F.lit(-1000) * top["l"] / top["q"]).cast("long").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed_text", 256).alias("collapsed_sha256"), "n_words",
    )
