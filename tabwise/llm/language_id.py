"""Language identification: averaged hashed subword embeddings, a linear softmax, calibrated rejection.

A text is lower-cased; its subwords are the byte trigrams and 4-grams of letters, with word limits as
blanks, hashed into buckets. The text's vector is the mean embedding of its subwords and the
languages' probabilities are a softmax of a linear map of it. Embeddings and map are trained together
by stochastic gradient descent. On rows kept back from training, a temperature and a weight of
evidence (few subwords count less) are fitted so that the probability is calibrated, and the
rejection limit is set: at most one true row in a thousand is lost.

Defined results: null text or text without a letter is `und` with score 0 and rejected; no labelled
row to learn from: every row is `und`; ties go to the first language in code-point order; texts of any
length are read whole; other columns stay, but those with the names of results are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import append, pick, utf8

UNDETERMINED = "und"
FIELDS = [
    T.StructField("lang_pred", T.StringType()),
    T.StructField("score", T.DoubleType()),
    T.StructField("rejected", T.BooleanType()),
]

# bytes as the subwords see them: letters stay, everything else is a blank
_FOLD = np.full(256, 32, np.uint8)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)
_ASCII_LETTER = np.zeros(256, bool)
_ASCII_LETTER[97:123] = _ASCII_LETTER[65:91] = True


@dataclass
class Model:
    """scores: of a bucket for each language, that is embedding times map; over the temperature.

    n subwords weigh n / (n + doubt); a probability below least is rejected.
    """

    langs: list[str]
    scores: np.ndarray
    bias: np.ndarray
    least: float
    doubt: float = 0.0

    @property
    def buckets(self) -> int:
        return self.scores.shape[1]


def subwords(data: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and buckets of the subwords: no blank inside, letters around or a blank at one end."""
    c = _FOLD[data].astype(np.uint32)
    places, found = [], []
    for n in (3, 4):
        if len(c) < n:
            continue
        m = len(c) - n + 1
        h = np.zeros(m, np.uint32)
        for i in range(n):
            h = (h ^ c[i : i + m]) * np.uint32(16777619)
        h ^= h >> np.uint32(15)
        inner = c[1 : 1 + m] != 32
        for i in range(2, n - 1):
            inner &= c[i : i + m] != 32
        at = np.flatnonzero(inner)
        places.append(at)
        found.append((h[at] + np.uint32(n)) % np.uint32(buckets))
    if not places:
        return np.zeros(0, np.int64), np.zeros(0, np.uint32)
    return np.concatenate(places), np.concatenate(found)


def _spaced(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased bytes with a blank around each row, so that no subword joins two rows."""
    text = pc.utf8_lower(pc.fill_null(text, ""))
    return utf8(pc.binary_join_element_wise(" ", text, " ", ""))


def _has_letter(text: pa.Array) -> np.ndarray:
    data, limits = utf8(text)
    seen = np.concatenate([[0], np.cumsum(_ASCII_LETTER[data])])
    out = seen[limits[1:]] > seen[limits[:-1]]
    for row in np.flatnonzero(~out & (np.diff(limits) > 0)):
        out[row] = any(ch.isalpha() for ch in text[int(row)].as_py())
    return out


def predict(text: pa.Array, model: Model, block: int = 1 << 19) -> list[pa.Array]:
    data, limits = _spaced(text)
    k, n = len(model.langs), len(text)
    sums, counts = np.zeros((k, n)), np.zeros(n)
    row = 0
    while row < n:  # rows in blocks of bounded size, one row at least
        stop = max(row + 1, int(np.searchsorted(limits, limits[row] + block, side="right")) - 1)
        part = data[limits[row] : limits[stop]]
        places, found = subwords(part, model.buckets)
        owner = np.searchsorted(limits[row : stop + 1] - limits[row], places, side="right") - 1
        counts[row:stop] = np.bincount(owner, minlength=stop - row)
        for j in range(k):
            sums[j, row:stop] = np.bincount(owner, model.scores[j][found], minlength=stop - row)
        row = stop
    known = _has_letter(text) & (k > 0)
    if not k:
        return [pa.array([UNDETERMINED] * n), pa.array(np.zeros(n)), pa.array(np.ones(n, bool))]
    z = (sums / np.maximum(counts, 1) + model.bias[:, None]) * (counts / np.maximum(counts + model.doubt, 1))
    z = np.exp(z - z.max(axis=0))
    z /= z.sum(axis=0)
    best = z.argmax(axis=0)
    score = np.where(known, z.max(axis=0), 0.0)
    names = [model.langs[b] if ok else UNDETERMINED for b, ok in zip(best.tolist(), known.tolist(), strict=True)]
    return [pa.array(names, pa.string()), pa.array(score), pa.array(~known | (score < model.least))]


def _bags(text: pa.Array, buckets: int) -> list[pa.Array]:
    """Of each row, its buckets and how often each occurs: bounded by the buckets, whatever the length."""
    data, limits = _spaced(text)
    ids, counts = [], []
    for lo, hi in zip(limits[:-1].tolist(), limits[1:].tolist(), strict=True):
        u, c = np.unique(subwords(data[lo:hi], buckets)[1], return_counts=True)
        ids.append(u.astype(np.int32))
        counts.append(c.astype(np.int32))
    return [pa.array(ids, pa.list_(pa.int32())), pa.array(counts, pa.list_(pa.int32()))]


def train(labelled: DataFrame, train_rows: int = 1600, buckets: int = 1 << 14, dim: int = 16, epochs: int = 4, seed: int = 7) -> Model:
    """Learn from the columns text and lang of a bounded sample.

    train_rows bounds the rows (about as many of each language, picked by a hash of the text); their
    whole texts are read, and only their bucket counts reach the driver. A quarter is kept back to
    calibrate.
    """
    rows = pick(labelled, "text", "lang").filter("text is not null and lang is not null")
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    langs = sorted(sizes)
    if not langs:
        return Model([], np.zeros((0, buckets), np.float32), np.zeros(0), 1.0)
    share = F.lit(0.0)
    for lang in langs:
        share = F.when(F.col("lang") == lang, train_rows / len(langs) / sizes[lang]).otherwise(share)
    draw = F.pmod(F.xxhash64("text", F.lit(seed)), F.lit(1 << 30))
    some = rows.withColumn("draw", draw).filter(F.col("draw") < share * (1 << 30))
    bag = append(
        some, ["text"], [T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("counts", T.ArrayType(T.IntegerType()))],
        lambda text: _bags(text, buckets),
    )
    once = bag.select("draw", "lang", "ids", "counts").dropDuplicates(["draw", "lang"])  # copies count once
    got = once.orderBy("draw", "lang", F.size("ids")).limit(2 * train_rows).toArrow()
    examples = [
        (langs.index(lang), np.asarray(i.values), np.asarray(c.values).astype(np.float32))
        for lang, i, c in zip(got["lang"].to_pylist(), got["ids"], got["counts"], strict=True)
        if len(i)
    ]
    return fit(langs, examples, buckets, dim, epochs, seed)


def fit(langs: list[str], examples: list[tuple[int, np.ndarray, np.ndarray]], buckets: int, dim: int, epochs: int, seed: int) -> Model:
    rng = np.random.default_rng(seed)
    k = len(langs)

    def short(x: tuple[int, np.ndarray, np.ndarray]) -> tuple[int, np.ndarray, np.ndarray]:
        """A few subwords of a text: what a short text of that language looks like."""
        n = int(2 ** rng.uniform(0, 7))
        i, c = np.unique(rng.choice(x[1], n, p=x[2] / x[2].sum()), return_counts=True)
        return x[0], i, c.astype(np.float32)

    order = rng.permutation(len(examples))
    back = [examples[i] for i in order[: len(order) // 4]]
    learn = [examples[i] for i in order[len(order) // 4 :]]
    emb = rng.uniform(-1, 1, (buckets, dim)) / dim
    out, bias = np.zeros((k, dim)), np.zeros(k)
    steps, done = 2 * epochs * max(len(learn), 1), 0
    for _ in range(epochs):
        for i in rng.permutation(len(learn)):
            for y, ids, counts in (learn[i], short(learn[i])):
                rate = 0.5 * (1 - done / steps)
                done += 1
                part = (counts / counts.sum())[:, None]
                h = (emb[ids] * part).sum(axis=0)
                z = out @ h + bias
                g = np.exp(z - z.max())
                g /= g.sum()
                g[y] -= 1
                back_h = out.T @ g
                out -= rate * np.outer(g, h)
                bias -= rate * 0.01 * g
                # the mean gives each subword a small share of the step; scaled up, it moves in earnest
                emb[ids] -= rate * np.minimum(part * 100, 1) * back_h
    scores = out @ emb.T
    held = back + [short(x) for x in back]
    z = np.array([(scores[:, i] * (c / c.sum())).sum(axis=1) + bias for _, i, c in held]).reshape(len(held), k)
    y = np.array([x[0] for x in held], int)

    size = np.array([x[2].sum() for x in held])

    def probabilities(t: float, doubt: float) -> np.ndarray:
        e = (z - z.max(axis=1, keepdims=True)) * (size / np.maximum(size + doubt, 1))[:, None] / t
        e = np.exp(e)
        return e / e.sum(axis=1, keepdims=True)

    def loss(x: tuple[float, float]) -> float:
        return float(-np.log(np.maximum(probabilities(*x)[np.arange(len(y)), y], 1e-12)).mean())

    best_t, doubt, least = 1.0, 0.0, 0.5 if k > 1 else 0.0
    if len(held) and k > 1:
        best_t, doubt = min(((t, d) for t in np.geomspace(0.1, 5, 40) for d in (0, 1, 2, 5, 10, 20)), key=loss)
        p = probabilities(best_t, doubt)[: len(back)]
        right = p.argmax(axis=1) == y[: len(back)]
        if right.any():
            least = min(least, float(np.quantile(p.max(axis=1)[right], 0.001)))
    return Model(langs, (scores / best_t).astype(np.float32), bias / best_t, least, float(doubt))


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """docs with lang_pred, score and rejected, from the whole text alone."""
    return append(docs, ["text"], FIELDS, lambda text: predict(text, model))


def held_out(docs: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """docs with held_out: whether crc32 of the identifier as text leaves 2 when divided by 4; null: not."""
    return docs.withColumn("held_out", F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False)))
