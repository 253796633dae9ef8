"""CSV records from lines: quoted line breaks without reading a file in one task.

Files are split at line ends, so a task does not know whether its first line lies inside quotes. It follows
the quotes for both cases. Which case holds for a split follows from the splits before it, one small row
each. With that, a second scan puts the records of a split together where they are read; only the pieces of
records that go over the end of a split, two a split at most, are shuffled. A quote opens a cell only where
the cell begins, so that a single one inside a cell (an inch mark) changes nothing.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from tabwise.operators.frames import written

QUOTE = '"'
_SPLITS = "file string, block long, to0 long, to1 long, ends boolean"
_RECORDS = pa.schema(
    [("value", pa.binary()), ("header", pa.bool_()), ("file", pa.string()), ("origin", pa.int64()), ("block", pa.int64())]
)


def lines_of(lines: DataFrame) -> DataFrame:
    """``(value, file, block)`` of a text scan: the line, its file and where its split begins."""
    return lines.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))


def odd_quotes(value: Column) -> Column:
    """Whether a line has an odd number of quotes; without such a line no quoted cell has a line break."""
    return (F.length(value) - F.length(F.replace(value, F.lit(QUOTE), F.lit("")))) % 2 == 1


def state_after(line: bytes, inside: int, sep: bytes) -> int:
    """Whether a quoted cell goes on after a line that begins inside of one, or not."""
    at = 0
    while True:
        if inside:
            end = line.find(b'"', at)
            if end < 0:
                return 1
            if line[end + 1 : end + 2] == b'"':  # a quote of the cell's text
                at = end + 2
                continue
            at, inside = end + 1, 0
        elif line[at : at + 1] == b'"':
            at, inside = at + 1, 1
            continue
        end = line.find(sep, at)
        if end < 0:
            return 0
        at = end + 1


def _by_split(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[str, int], pa.RecordBatch]]:
    """The batches of (value, file, block, ...) in parts of one split each."""
    for batch in batches:
        names, blocks = batch.column(1).dictionary_encode().indices.to_numpy(), np.asarray(batch.column(2))
        change = np.flatnonzero((names[1:] != names[:-1]) | (blocks[1:] != blocks[:-1])) + 1
        for lo, hi in zip([0, *change.tolist()], [*change.tolist(), len(batch)], strict=True):
            if lo < hi:
                yield (batch.column(1)[lo].as_py(), int(blocks[lo])), batch.slice(lo, hi - lo)


def _quoted(values: pa.Array) -> np.ndarray:
    """The numbers of the lines with a quote; the state changes at no other."""
    return np.flatnonzero(np.asarray(pc.fill_null(pc.count_substring(values, QUOTE.encode()), 0)))


def _ends(sep: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Per split the states at its end, if it begins outside or inside of a quoted cell, and whether a cell
    that goes on into the split ends in it."""
    mark = sep.encode()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, states, ends = None, [0, 1], False
        for here, part in _by_split(batches):
            if here != at:
                if at is not None:
                    yield row(at, states, ends)
                at, states, ends = here, [0, 1], False
            for line in part.column(0).take(pa.array(_quoted(part.column(0)))).to_pylist():
                same = states[0] == states[1]
                states[1] = state_after(line, states[1], mark)
                states[0] = states[1] if same else state_after(line, states[0], mark)
                ends = ends or not states[1]
        if at is not None:
            yield row(at, states, ends)

    def row(at: tuple[str, int], states: list[int], ends: bool) -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist(
            [{"file": at[0], "block": at[1], "to0": states[0], "to1": states[1], "ends": ends}],
            pa.schema([("file", pa.string()), ("block", pa.int64()), ("to0", pa.int64()), ("to1", pa.int64()), ("ends", pa.bool_())]),
        )

    return run


def _inside(splits: DataFrame) -> DataFrame:
    """``(file, block, origin)`` of the splits that begin inside of a quoted cell; its record begins in the
    split ``origin``."""
    listed = splits.groupBy("file").agg(F.sort_array(F.collect_list(F.struct("block", "to0", "to1", "ends"))).alias("s"))
    begin = F.struct(
        F.lit(None).cast("long").alias("origin"),
        F.array().cast("array<struct<block:bigint,origin:bigint>>").alias("out"),
    )

    def step(seen: Column, split: Column) -> Column:
        outside = seen["origin"].isNull()
        here = F.struct(split["block"].alias("block"), seen["origin"].alias("origin"))
        goes_on = F.when(outside, split["to0"]).otherwise(split["to1"]) == 1
        origin = F.when(outside | split["ends"], split["block"]).otherwise(seen["origin"])
        return F.struct(
            F.when(goes_on, origin).alias("origin"),
            F.when(outside, seen["out"]).otherwise(F.concat(seen["out"], F.array(here))).alias("out"),
        )

    return listed.select("file", F.inline(F.aggregate("s", begin, step)["out"]))


def _put_together(sep: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The records that lie in one split, and the pieces of others with the split where their record begins."""
    mark = sep.encode()

    def made(values: pa.Array | list[bytes], header: list[bool] | np.ndarray, piece: tuple | None = None) -> pa.RecordBatch:
        n = len(values)
        file, origin, block = piece or (None, None, None)
        return pa.RecordBatch.from_arrays(
            [
                values if isinstance(values, pa.Array) else pa.array(values, pa.binary()), pa.array(header, pa.bool_()),
                pa.array([file] * n, pa.string()), pa.array([origin] * n, pa.int64()), pa.array([block] * n, pa.int64()),
            ],
            schema=_RECORDS,
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, begun, leads, origin = None, [], False, None
        state, first = 0, True
        for here, part in _by_split(batches):
            if here != at:
                if begun:
                    yield made([b"\n".join(begun)], [leads], (at[0], at[1] if origin is None else origin, at[1]))
                origin = part.column(3)[0].as_py()
                at, begun, leads, state, first = here, [], False, int(origin is not None), True
            values, n = part.column(0), len(part)
            quoted = _quoted(values)
            known = [state]
            for line in values.take(pa.array(quoted)).to_pylist():
                known.append(state := state_after(line, known[-1], mark))
            # a state holds until the next line with a quote
            after = np.array(known)[np.searchsorted(quoted, np.arange(n), side="right")]
            before = np.concatenate([known[:1], after[:-1]])
            header = np.zeros(n, bool)
            header[0] = first and here[1] == 0
            first = False
            single = (before == 0) & (after == 0) & (np.asarray(pc.binary_length(values)) > 0)
            yield made(values.filter(pa.array(single)), header[single])
            several = np.flatnonzero((before == 1) | (after == 1))
            records, heads = [], []
            for i, line in zip(several.tolist(), values.take(pa.array(several)).to_pylist(), strict=True):
                begun.append(line)
                leads = leads or bool(header[i])
                if not after[i]:
                    if origin is None:
                        records.append(b"\n".join(begun))
                        heads.append(leads)
                    else:
                        yield made([b"\n".join(begun)], [leads], (at[0], origin, at[1]))
                    begun, leads, origin = [], False, None
            if records:
                yield made(records, heads)
        if begun:
            yield made([b"\n".join(begun)], [leads], (at[0], at[1] if origin is None else origin, at[1]))

    return run


def records(lines: DataFrame, sep: str) -> DataFrame:
    """``(value, header)``: the records of the files of a text scan, line breaks in quotes as ``\\n``; the
    first record of each file is a header. No order. Empty lines are no records. The records are written
    once, and the result is a scan of them."""
    each = lines_of(lines)
    marked = each.select(F.when(F.contains("value", F.lit(QUOTE)), F.col("value")).cast("binary").alias("value"), "file", "block")
    inside = _inside(marked.mapInArrow(_ends(sep), _SPLITS))
    # at most a row a split, and none for the first one of a file
    placed = each.join(F.broadcast(inside), ["file", "block"], "left")
    placed = placed.select(F.col("value").cast("binary").alias("value"), "file", "block", "origin")
    found = written(placed.mapInArrow(_put_together(sep), "value binary, header boolean, file string, origin long, block long"))
    pieces = F.sort_array(F.collect_list(F.struct("block", F.col("value").cast("string").alias("v"))))
    joined = found.filter("origin IS NOT NULL").groupBy("file", "origin").agg(
        F.array_join(F.transform(pieces, lambda p: p["v"]), "\n").cast("binary").alias("value"), F.max("header").alias("header")
    )
    return found.filter("origin IS NULL").select("value", "header").unionByName(joined.select("value", "header"))
