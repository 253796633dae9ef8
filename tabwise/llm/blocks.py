"""Blocks: groups of bounded size that a task takes whole, one after the other."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def grouped(df: DataFrame, keys: list[str], compute: Callable[[tuple, pa.Table], pa.Table | None], schema: str, tasks: int | None = None) -> DataFrame:
    """`compute(key, rows)` of each group of (integer) keys; groups must be of bounded size.

    With `tasks`, the first key, a number from 0, is dealt to that many tasks in turn.

    Rows are dealt and sorted by the keys and stream through the task: a task holds one batch and the
    group that goes on into the next, and small groups cost no call of their own into Spark.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None
        for b in batches:
            now = pa.Table.from_batches([b])
            rest = yield from parts(pa.concat_tables([rest, now]) if rest is not None else now, False)
        if rest is not None:
            yield from parts(rest, True)

    def parts(table: pa.Table, last: bool) -> Iterator[pa.RecordBatch]:
        table = table.combine_chunks()
        cols = [np.asarray(table[k]) for k in keys]
        change = np.zeros(max(len(table) - 1, 0), bool)
        for c in cols:
            change |= c[1:] != c[:-1]
        cuts = [0, *(np.flatnonzero(change) + 1).tolist(), len(table)]
        stop = len(cuts) - 1 if last else len(cuts) - 2
        made = []
        for lo, hi in zip(cuts[:stop], cuts[1 : stop + 1], strict=True):
            if hi > lo and (out := compute(tuple(int(c[lo]) for c in cols), table.slice(lo, hi - lo))) is not None:
                made.append(out)
        if made:
            yield from pa.concat_tables(made).combine_chunks().to_batches()
        return None if last else table.slice(cuts[stop])

    dealt = df.repartition(*keys) if tasks is None else df.repartitionById(tasks, F.col(keys[0]) % tasks)
    return dealt.sortWithinPartitions(*keys).mapInArrow(run, schema)


def labels(n: int, a: np.ndarray, b: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """For each of n nodes, the smallest of the ids that the links a-b (given both ways) connect it to."""
    out = ids.copy()
    order = np.argsort(a, kind="stable")
    a, b = a[order], b[order]
    starts = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]]))
    nodes = a[starts]
    while True:
        least = np.minimum.reduceat(out[b], starts)
        if not (least < out[nodes]).any():
            return out
        out[nodes] = np.minimum(out[nodes], least)
