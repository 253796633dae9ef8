"""Helpers that several operators share: scratch tables, column choice, Arrow passes, components."""

from __future__ import annotations

import gc
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A word of every operator here: a run of anything but the ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def scratch(spark: SparkSession) -> str:
    """A new folder name below the shared folder named by spark.checkpoint.dir.

    Only a local session without that setting gets a folder of its own.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = f"/tmp/tabwise-llm-{spark.conf.get('spark.app.id', 'local')}"
    return f"{root.rstrip('/')}/llm-{uuid.uuid4().hex}"


class Saved:
    """Tables written to the shared folder, so that later steps don't depend on lost executors."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, {}

    def __call__(self, df: DataFrame, **options: str) -> DataFrame:
        path = scratch(self.spark)
        df.write.options(**options).parquet(path)
        back = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(back)] = (path, back)
        return back

    def free(self) -> None:
        """Let go of finished steps: their plans on the driver, whose heap otherwise grows to its limit from
        step to step, and with them the shuffle files, which Spark removes when the plans are collected."""
        gc.collect()
        pa.default_memory_pool().release_unused()
        self.spark._jvm.System.gc()

    def drop(self, *frames: DataFrame) -> None:
        """Delete tables that nothing reads any more."""
        for df in frames:
            path, _ = self.paths.pop(id(df), (None, None))
            if path:
                where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
                where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)


def pick(df: DataFrame, *names: str) -> DataFrame:
    """The named columns; other columns may repeat or resemble these names."""
    at = [df.columns.index(name) for name in names]
    plain = df.toDF(*(f"c{i}" for i in range(len(df.columns))))
    return plain.select(*(F.col(f"c{i}").alias(name) for i, name in zip(at, names, strict=True)))


_RELEASE: list[Callable[[], None]] = []


def on_release(free: Callable[[], None]) -> None:
    """Call `free` in this worker when a pass of `append` begins in it."""
    _RELEASE.append(free)


def release() -> None:
    """Let go of what passes that have ended keep in this worker from one of their tasks to the next."""
    for free in _RELEASE:
        free()


def append(df: DataFrame, needs: list[str], fields: list[T.StructField], compute: Callable[..., list[pa.Array]], step: int = 2000) -> DataFrame:
    """All columns of df and those that `compute` makes of the needed ones, an Arrow batch at a time.

    A column of df that has the name of a new one is replaced.
    """
    at = [df.columns.index(name) for name in needs]
    plain = df.toDF(*(f"c{i}" for i in range(len(df.columns))))
    new = [T.StructField(f"x{i}", f.dataType) for i, f in enumerate(fields)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for whole in batches:
            for lo in range(0, whole.num_rows, step):  # smaller batches, less memory for what `compute` makes
                b = whole.slice(lo, step)
                made = compute(*(b.column(i) for i in at))
                yield pa.RecordBatch.from_arrays([*b.columns, *made], names=[*b.schema.names, *(f.name for f in new)])

    out = plain.mapInArrow(run, T.StructType([*plain.schema.fields, *new]))
    names = {f.name for f in fields}
    keep = [i for i, name in enumerate(df.columns) if name not in names]
    return out.select(*(f"c{i}" for i in keep), *(f.name for f in new)).toDF(
        *(df.columns[i] for i in keep), *(f.name for f in fields)
    )


def utf8(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text column and the limits of its rows; null counts as empty."""
    col = pc.fill_null(col, "")
    if not pa.types.is_large_string(col.type):
        col = col.cast(pa.large_string())
    n = len(col)
    _, offsets, data = col.buffers()
    if n == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    offsets = np.frombuffer(offsets, np.int64)[col.offset : col.offset + n + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def text_of(col: pa.Array) -> list[str]:
    return pc.fill_null(col, "").to_pylist()


def components(spark: SparkSession, edges: DataFrame, saved: Saved, most_rounds: int = 60) -> DataFrame:
    """(node, component) of an undirected graph given as (a, b): the smallest node reachable.

    Alternates large-star and small-star steps. Before each round, tasks replace the edges of a block by a
    star around the smallest node of each component there, so that the rows of a node are no more than the
    blocks that hold it; a large step is a grouped minimum over partial sums and a join by the node, which
    brings the links of a hub, two numbers each, to one task. Every round is written to the shared folder,
    and the driver lets go of its plans. Nodes without an edge are not returned. No edges: no rows.
    """
    now = saved(contracted(edges))
    before = None
    for _ in range(most_rounds):
        large = _star(now, larger=True)
        small = saved(_star(large, larger=False))
        state = small.agg(
            F.count("*").alias("n"), F.sum(F.hash("lo", "hi").cast("long")).alias("h"),
            F.bit_xor(F.xxhash64("lo", "hi")).alias("x"),
        ).first()
        saved.drop(now)
        large = now = None
        saved.free()
        if state == before:
            break
        before, now = state, saved(contracted(small.toDF("a", "b")))
        saved.drop(small)
    else:
        raise RuntimeError(f"components are not stable after {most_rounds} rounds")
    out = saved(small.select(F.col("hi").alias("node"), F.col("lo").alias("component")).unionByName(
        small.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct()
    ))
    saved.drop(small)
    return out


def contracted(edges: DataFrame, block: int = 1 << 20) -> DataFrame:
    """(a, b) -> (lo, hi): in each block of a task, the smallest node of each component with the others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += len(batch)
            if n >= block:
                yield stars(held)
                held, n = [], 0
        if n:
            yield stars(held)

    def stars(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(held)
        nodes, at = np.unique(np.concatenate([np.asarray(table["a"]), np.asarray(table["b"])]), return_inverse=True)
        up = smallest(len(nodes), at[: len(table)], at[len(table) :])
        others = np.flatnonzero(up != np.arange(len(nodes)))
        return pa.RecordBatch.from_arrays([pa.array(nodes[up[others]]), pa.array(nodes[others])], names=["lo", "hi"])

    return edges.filter("a <> b").select(F.col("a").cast("long"), F.col("b").cast("long")).mapInArrow(run, "lo long, hi long")


def smallest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of the nodes 0 to n - 1, the smallest node that the links a-b connect it to."""
    up = np.arange(n)
    while len(a):
        a, b = up[a], up[b]
        apart = a != b
        a, b = a[apart], b[apart]
        np.minimum.at(up, np.maximum(a, b), np.minimum(a, b))
        while (up[up] != up).any():
            up = up[up]
    return up


def _star(edges: DataFrame, larger: bool) -> DataFrame:
    """One step: link neighbours to the smallest node around; large: the larger neighbours only."""
    if not larger:
        around = Window.partitionBy("hi").orderBy("lo")
        seen = edges.select("lo", "hi", F.first("lo").over(around).alias("m"), F.lag("lo").over(around).alias("last"))
        # the first row links the node itself, the others its further neighbours
        return seen.filter("last is null or last <> lo").select(F.col("m").alias("lo"), F.expr("if(last is null, hi, lo)").alias("hi"))
    both = edges.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(edges.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    # the node itself stays linked to its minimum
    return both.join(least, "u").select(F.col("m").alias("lo"), F.expr("case when v > u then v when v = m then u end").alias("hi")).filter("hi is not null")
