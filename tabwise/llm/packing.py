"""Best-fit packing: a configuration linear program over the length histogram, rounded.

Documents become token ids and are cut only where they are longer than a sequence. What decides the
packing is the histogram of piece lengths, at most as many numbers as a sequence has tokens. A
configuration is a multiset of lengths that fits a sequence; the linear program asks for the least
number of configurations that cover the histogram. Multiplicative weights solve it to a stated gap: each
length has a price, a knapsack by dynamic programming finds the configurations of the highest price, and
the prices of the lengths that they cover fall by small steps. The sum of all rounds is rounded down to
whole sequences, what remains is packed best fit in decreasing length. Where rounding costs more than the
program gains (few pieces of each length), or best fit of all pieces needs no more sequences than the
tokens fill, best fit is the plan. Pieces are numbered within
their length, in salted groups, and look their sequence and offset up in the plan.

Defined results: null or empty text is its end mark alone; equal rows are packed like any others; an
empty table gives an empty table; a text of any length is cut whole, its first piece being the short
one; which sequence numbers occur is not defined.
"""

from __future__ import annotations

import json
import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import lru_cache
from itertools import groupby

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from .common import Saved, append, pick, text_of

END, CAPACITY = 2, 1024

# --- tokens

#: A blank before anything but white space always begins a token of the byte-level vocabulary.
_CUT = re.compile(r" (?=\S)")
#: White space of this length is more than the rank encoder takes; shorter texts need not be searched for it.
_BLANKS, _LONG = re.compile(r"\s{50000}"), 50_000


def _bytes_of(token: str) -> bytes:
    """The bytes that a byte-level token stands for: printable Latin-1 is itself, other bytes follow U+0100."""
    return bytes(_BYTE_OF[c] for c in token)


_PLAIN = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
_BYTE_OF = {chr(b): b for b in _PLAIN} | {chr(0x100 + i): b for i, b in enumerate(b for b in range(256) if b not in _PLAIN)}


@lru_cache(maxsize=2)
def _encoders(path: str) -> tuple[Tokenizer, tiktoken.Encoding | None]:
    """The tokenizer of the file, and one of the same ids that takes merges by rank and is faster.

    There is none if the file is no byte-level vocabulary whose ids follow the order of its merges.
    """
    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True  # the marks' names in a text are ordinary text
    spec = json.loads(tokenizer.to_str())
    model, before = spec["model"], spec["pre_tokenizer"] or {}
    vocab, merges = model.get("vocab", {}), model.get("merges", [])
    pairs = [m if isinstance(m, list) else m.split(" ") for m in merges] if model["type"] == "BPE" else []
    order = [vocab.get("".join(m), -1) for m in pairs]
    same = (
        before.get("type") == "ByteLevel" and before.get("use_regex") and not before.get("add_prefix_space")
        and not spec["normalizer"] and not any(model.get(x) for x in ("dropout", "continuing_subword_prefix", "end_of_word_suffix"))
        and order == list(range(len(vocab) - len(order), len(vocab))) and set("".join(vocab)) <= set(_BYTE_OF)
    )
    if not same:
        return tokenizer, None
    ranks = {_bytes_of(token): i for token, i in vocab.items()}
    return tokenizer, tiktoken.Encoding(path, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def _latin(text: str) -> bool:
    """Both encoders agree on the kinds of these characters, whatever their tables of others."""
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


def _ids(text: str, path: str) -> list[int]:
    tokenizer, fast = _encoders(path)
    if fast is None or (len(text) >= _LONG and _BLANKS.search(text)):
        return tokenizer.encode(text, add_special_tokens=False).ids
    if _latin(text):
        return fast.encode_ordinary(text)
    out, blank = [], ""
    for latin, words in groupby(_CUT.split(text), _latin):
        part = blank + " ".join(words)
        out += fast.encode_ordinary(part) if latin else tokenizer.encode(part, add_special_tokens=False).ids
        blank = " "
    return out


def token_ids(text: str, path: str, end: int = END) -> bytes:
    """The text's ids and the end mark, little-endian unsigned 32-bit."""
    return np.array([*_ids(text, path), end], "<u4").tobytes()


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]) of the whole texts."""
    schema = T.StructType([
        pick(docs, "doc_id").schema[0], T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()),
        T.StructField("length", T.LongType()), T.StructField("ids_crc32", T.LongType()),
        *([T.StructField("ids", T.BinaryType())] if with_ids else []),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[tuple] = []
            for i, text in enumerate(text_of(b.column(1))):
                ids = memoryview(token_ids(text, path))
                n = len(ids) // 4
                begin, stop, k = 0, n % capacity or capacity, 0
                while begin < n:
                    part = ids[4 * begin : 4 * stop]
                    rows.append((i, k, begin, stop - begin, zlib.crc32(part), bytes(part) if with_ids else b""))
                    begin, stop, k = stop, stop + capacity, k + 1
            at, *cols = zip(*rows, strict=True) if rows else ((),) * 6
            kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()][: 4 + with_ids]
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(at, pa.int64())), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=False))], names=schema.names
            )

    return pick(docs, "doc_id", "text").mapInArrow(run, schema)


# --- the plan: a few numbers for each length


def best_configurations(price: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every space up to the capacity the highest price of lengths that fit, and the last of these lengths.

    An unbounded knapsack; ``price`` has an entry for every length from 0 to the capacity, 0 where there is none.
    """
    capacity = len(price) - 1
    lengths = np.flatnonzero(price)
    least = int(lengths[0]) if len(lengths) else capacity + 1
    worth, chosen = np.zeros(capacity + 1), np.arange(capacity + 1)
    if least < 8:
        falling = price[::-1].copy()
        for space in range(1, capacity + 1):
            total = worth[:space] + falling[capacity - space : capacity]
            rest = int(total.argmax())
            worth[space], chosen[space] = total[rest], space - rest
        return worth, chosen
    for space in range(least, capacity + 1, least):  # a piece leaves only spaces that are done
        spaces = np.arange(space, min(space + least, capacity + 1))
        fits = lengths[lengths <= spaces[-1]]
        rest = spaces[:, None] - fits
        total = np.where(rest >= 0, price[fits] + worth[np.maximum(rest, 0)], -1.0)
        best = total.argmax(axis=1)
        worth[spaces], chosen[spaces] = total[np.arange(len(spaces)), best], fits[best]
    return worth, chosen


def solve(counts: dict[int, int], capacity: int = CAPACITY, gap: float = 0.01, step: float = 0.2, most: int = 1600) -> tuple[list[tuple[tuple[int, ...], float]], float]:
    """Configurations with how often each is used, fractional, and a lower bound, by multiplicative weights.

    A price starts as the length's share of a sequence, which is the right dual where nothing is wasted.
    A round takes, of the dearest configurations that begin with each length, those near the dearest of
    all, in proportion to what their scarcest length allows, and scaled so that no length gains more than
    ``step``. Every price is the share times exp(-gain), also of lengths that are covered already; prices
    near 0 count as 0. The sum of the rounds, divided by the least gain, covers every piece. Prices
    divided by the worth of the dearest configuration are a dual; it is evaluated for each round and for
    their mean, and gives a lower bound next to all tokens over the capacity. Ends when the sum is within
    ``gap`` of the best bound: the sum of all rounds, or that of a later stretch, which has no share in the
    first prices. A stretch is twice as long as the one before and has smaller steps, so any gap would be
    reached, but slowly where pieces have few lengths and much is wasted: after ``most`` rounds it is the best
    sum so far, with the bound that proves how far from the least it can be.
    """
    lengths = np.array(sorted(counts), np.int64)
    need, share = np.zeros(capacity + 1), np.arange(capacity + 1) / capacity
    need[lengths] = [counts[int(x)] for x in lengths]
    gain, every = np.zeros(len(lengths)), defaultdict(float)
    bound, rounds, spent, left = float((need * share).sum()), 400, 0.0, most
    kept: tuple[float, dict, float] = (np.inf, {}, 1.0)
    while True:
        near, stretch, before, began, mean = 0.05 * step, defaultdict(float), spent, gain.copy(), np.zeros(capacity + 1)
        for k in range(1, rounds + 1):
            factor = np.exp(gain.min() - gain)
            price = np.zeros(capacity + 1)
            price[lengths] = np.where(factor > near, share[lengths] * factor, 0.0)
            worth, chosen = best_configurations(price)
            bound = max(bound, float((price * need).sum() / worth[capacity]))
            mean += price / worth[capacity]
            if k % 50 == 0:
                bound = max(bound, float((mean * need).sum() / best_configurations(mean)[0][capacity]))
            first = lengths[(price[lengths] > 0) & (price[lengths] + worth[capacity - lengths] >= (1 - near) * worth[capacity])]
            held, space = [first], capacity - first
            while (space > 0).any():
                held.append(np.where(price[chosen[space]] > 0, chosen[space], 0))
                space = space - chosen[space]
            rows = -np.sort(-np.stack(held, 1), axis=1)
            number = np.repeat(np.arange(len(rows)), rows.shape[1])
            keys, times = np.unique((number * (capacity + 1) + rows.ravel())[rows.ravel() > 0], return_counts=True)
            of, length = keys // (capacity + 1), keys % (capacity + 1)
            amounts = np.minimum.reduceat(need[length] / times, np.searchsorted(of, np.arange(len(rows))))
            more = np.bincount(length, amounts[of] * times, capacity + 1)[lengths] / need[lengths]
            scale = step / more.max()
            gain += more * scale
            for config, size, amount in zip(rows.tolist(), (rows > 0).sum(axis=1).tolist(), (amounts * scale).tolist(), strict=True):
                every[tuple(config[:size])] += amount
                stretch[tuple(config[:size])] += amount
            spent += float(amounts.sum()) * scale
            for used, total, covered in ((every, spent, gain), (stretch, spent - before, gain - began)):
                least = float(covered.min())
                if least > 0 and total <= (1 + gap) * bound * least:
                    return [(config, amount / least) for config, amount in used.items()], bound
            left -= 1
            if not left:
                break
        for used, total, covered in ((every, spent, gain), (stretch, spent - before, gain - began)):
            least = float(covered.min())
            if least > 0 and total / least < kept[0]:
                kept = (total / least, dict(used), least)
        if not left and kept[1]:
            return [(config, amount / kept[2]) for config, amount in kept[1].items()], bound
        left = left or rounds  # not every length has its turn yet
        rounds, step = 2 * rounds, 0.85 * step


def best_fit(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """Best fit in decreasing length, equal sequences together: work grows with the lengths, not the pieces."""
    open_: dict[int, Counter] = defaultdict(Counter)  # free space -> what such sequences hold -> how many
    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            space = min((s for s, held in open_.items() if s >= length and held), default=None)
            if space is None:
                each = capacity // length
                if full := left // each:
                    open_[capacity - each * length][(length,) * each] += full
                if rest := left % each:
                    open_[capacity - rest * length][(length,) * rest] += 1
                break
            held, n = next(iter(open_[space].items()))
            n = min(n, left)
            open_[space][held] -= n
            if not open_[space][held]:
                del open_[space][held]
            open_[space - length][held + (length,)] += n
            left -= n
    return [(held, n) for by in open_.values() for held, n in by.items() if n]


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """(lengths of a sequence, how many such sequences): all pieces of the histogram, each once."""
    left, out = dict(counts), []
    full = left.pop(capacity, 0)
    whole = [((capacity,), full)] if full else []
    if not left:
        return whole
    plain = best_fit(left, capacity)
    if sum(n for _, n in plain) == -(-sum(x * n for x, n in left.items()) // capacity):
        return whole + plain  # no plan has fewer
    solution, _ = solve(left, capacity)
    for config, amount in sorted(solution, key=lambda x: (-x[1], x[0])):
        times = Counter(config)
        n = min([int(amount + 1e-6), *(left[x] // k for x, k in times.items())])
        if n > 0:
            out.append((config, n))
            for x, k in times.items():
                left[x] -= n * k
    out += best_fit({x: n for x, n in left.items() if n}, capacity)
    return whole + min(out, plain, key=lambda x: sum(n for _, n in x))


def _lookup(planned: list[tuple[tuple[int, ...], int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted keys (length, first number), and the sequence and offset of that piece."""
    rows, next_of, sequence = [], Counter(), 0
    for held, n in planned:
        offset = 0
        for x in held:
            rows.append(((x << 48) + next_of[x], sequence, offset))
            next_of[x] += n
            offset += x
        sequence += n
    rows.sort()
    table = np.array(rows, np.int64).reshape(-1, 3)
    return table[:, 0], table[:, 1], table[:, 2]


def place(spark: SparkSession, cut: DataFrame, saved: Saved, capacity: int = CAPACITY) -> DataFrame:
    """The pieces (doc_id, piece, length, …), a table that does not change, with sequence_id and offset."""
    counts = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}
    keys, sequences, offsets = _lookup(plan(counts, capacity))
    total = sum(counts.values())
    salts = min(max(16, total // 100_000), 100_000)
    salted = cut.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "start"), F.lit(salts)))
    groups = salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
    before = groups.select(
        "length", "salt", (F.sum("n").over(Window.partitionBy("length").orderBy("salt")) - F.col("n")).alias("before")
    )
    order = Window.partitionBy("length", "salt").orderBy(*cut.columns)
    numbered = salted.withColumn("k", F.row_number().over(order)).join(before, ["length", "salt"])
    numbered = numbered.select(*cut.columns, (F.col("before") + F.col("k") - 1).alias("number"))

    def find(length: pa.Array, number: pa.Array) -> list[pa.Array]:
        key = (np.asarray(length) << 48) + np.asarray(number)
        at = np.searchsorted(keys, key, side="right") - 1
        return [pa.array(sequences[at] + key - keys[at]), pa.array(offsets[at])]

    fields = [T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())]
    return append(numbered, ["length", "number"], fields, find).drop("number")


def pack(spark: SparkSession, docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset), a row for each piece."""
    saved = Saved(spark)
    return place(spark, saved(pieces(docs, path, capacity)), saved, capacity)
