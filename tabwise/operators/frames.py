"""Shared building blocks: column kinds, long form, bounded heads and written tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager
from typing import TypeVar

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.util import inheritable_thread_target

Result = TypeVar("Result")

# Groups that share the work of the first of two top-n levels.
_TOP_GROUPS = 1024
# Stored data per shuffle partition (it takes two to four times that in a shuffle), and a bound
# that keeps the bookkeeping of a shuffle small on the driver.
PARTITION_BYTES = 64 * 1024 * 1024
MOST_PARTITIONS = 30_000
# From this many partitions on a table is large.
LARGE_PARTITIONS = 64
# Tables of more columns are wide: a method for all of them is too large for the JVM to compile.
WIDE_COLUMNS = 40
# Largest method, in bytes of byte code, that the JVM compiles.
COMPILED_BYTES = 8000
_PARTITIONS = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
_METHOD_LIMIT = "spark.sql.codegen.hugeMethodLimit"


def kind(data_type: T.DataType) -> str:
    """``boolean``, ``integer``, ``double``, ``datetime``, ``text`` or ``nested``."""
    if isinstance(data_type, T.BooleanType):
        return "boolean"
    if isinstance(data_type, T.IntegralType):
        return "integer"
    if isinstance(data_type, T.NumericType):
        return "double"
    if isinstance(data_type, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return "datetime"
    if isinstance(data_type, (T.StringType, T.CharType, T.VarcharType)):
        return "text"
    return "nested"


def kinds(df: DataFrame) -> dict[str, str]:
    return {f.name: kind(f.dataType) for f in df.schema.fields}


def is_numeric(k: str) -> bool:
    """Booleans count as numeric, as in the data-frame libraries this mirrors."""
    return k in ("boolean", "integer", "double")


def column(name: str) -> Column:
    """Column by its literal name (dots and back-ticks in names are safe)."""
    return F.col("`" + name.replace("`", "``") + "`")


def as_double(df: DataFrame, name: str) -> Column:
    """Numeric column as double with NaN read as NULL."""
    c = column(name)
    field = df.schema[name].dataType
    if isinstance(field, (T.DoubleType, T.FloatType)):
        c = F.when(~F.isnan(c), c)
    elif isinstance(field, T.BooleanType):
        c = c.cast("int")
    return c.cast("double")


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN and NULL are one kind of missing. Plans without floating columns are left alone."""
    floating = [
        f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))
    ]
    if not floating:
        return df
    return df.withColumns({c: F.when(~F.isnan(column(c)), column(c)) for c in floating})


def local_frame(spark: SparkSession, rows: Sequence[tuple], schema: str | T.StructType) -> DataFrame:
    """DataFrame of a few result rows (bounded by the number of columns, never by the data).

    Arrow data becomes a local relation, which is shown or collected without a Spark job.
    """
    fields = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    plain = not any(kind(f.dataType) == "nested" for f in fields)
    if not plain or any(isinstance(f.dataType, T.TimestampType) for f in fields):
        return spark.createDataFrame(list(rows), fields).coalesce(1)
    arrow = to_arrow_schema(fields)
    columns = list(zip(*rows)) or [()] * len(fields)
    arrays = [pa.array(c, type=f.type) for c, f in zip(columns, arrow)]
    return spark.createDataFrame(pa.Table.from_arrays(arrays, schema=arrow), fields)


def long_form(
    df: DataFrame, cells: dict[str, Column], *carried: Column, numbered: bool = False
) -> DataFrame:
    """Rows ``(carried…, column_name, value)`` of the non-null cells; ``cells`` share a type.

    ``numbered`` gives ``column_number`` (the place in ``cells``) in place of the name.
    """
    label = "column_number" if numbered else "column_name"
    entries = [
        F.struct(F.lit(i if numbered else name).alias(label), c.alias("value"))
        for i, (name, c) in enumerate(cells.items())
    ]
    return df.select(*carried, F.inline(F.array(*entries))).filter("value IS NOT NULL")


def top_n(
    df: DataFrame, n: int, order: Column, within: Sequence[str] = (), levels: int = 2
) -> DataFrame:
    """The first ``n`` rows by ``order`` (per ``within`` group), in two levels.

    A task keeps ``n`` rows per group, so ranking all of them at once would send (tasks × n)
    rows to one place. The first level ranks inside many small groups of tasks, the second
    ranks what these keep. One level is enough for a small ``n`` after a shuffle.
    """
    salt, rank = "__salt", "__rank"
    groups = [column(c) for c in within]
    salted = df.withColumn(salt, F.spark_partition_id() % F.lit(_TOP_GROUPS))
    first = Window.partitionBy(*groups, salt).orderBy(order)
    kept = df
    if levels > 1:
        kept = salted.withColumn(rank, F.row_number().over(first)).filter(column(rank) <= n)
        kept = kept.drop(salt, rank)
    if not groups:
        return kept.orderBy(order).limit(n)
    second = Window.partitionBy(*groups).orderBy(order)
    return kept.withColumn(rank, F.row_number().over(second)).filter(column(rank) <= n).drop(rank)


def first_rows(df: DataFrame, n: int, order_by: str | None = None) -> DataFrame:
    """The first ``n`` rows, by ``order_by`` or else in scan order, as a small DataFrame.

    Scan order reads the leading partitions only. With a key, one scan of that column alone finds
    the n-th smallest key, which then goes down to the scan as a filter.
    """
    if order_by is not None:
        key = column(order_by)
        keys = top_n(df.select(key.alias("key")), n, F.col("key"))
        cutoff = keys.agg(F.max("key").alias("cutoff")).first()["cutoff"]
        wanted = key.isNull() if cutoff is None else key.isNull() | (key <= F.lit(cutoff))
        df = top_n(df.filter(wanted), n, key)
    return local_frame(df.sparkSession, df.take(n), df.schema)


def leading_rows(df: DataFrame, n: int, order_by: str | None = None) -> DataFrame:
    """Like ``first_rows``, but left distributed, for a larger ``n``."""
    return df.limit(n) if order_by is None else top_n(df, n, column(order_by))


@contextmanager
def tuned(df: DataFrame) -> Iterator[None]:
    """Session settings that a pass over the whole table needs, restored afterwards.

    Shuffles start with enough partitions for the size of the table: adaptive execution merges
    small partitions but never splits a large one of an aggregate. On large tables generated
    methods stay below the size up to which the JVM compiles them, or long projections would be
    interpreted; on small ones that takes longer to set up than it saves. Settings that go
    further already are kept.
    """
    conf = df.sparkSession.conf
    size = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    partitions = min(int(str(size)) // PARTITION_BYTES, MOST_PARTITIONS)
    wanted = {}
    if partitions > int(conf.get(_PARTITIONS, None) or conf.get("spark.sql.shuffle.partitions")):
        wanted[_PARTITIONS] = str(partitions)
    method_limit = int(conf.get(_METHOD_LIMIT, None) or COMPILED_BYTES + 1)
    if partitions > LARGE_PARTITIONS and method_limit > COMPILED_BYTES:
        wanted[_METHOD_LIMIT] = str(COMPILED_BYTES)
    before = {name: conf.get(name, None) for name in wanted}
    for name, value in wanted.items():
        conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            if value is None:
                conf.unset(name)
            else:
                conf.set(name, value)


@contextmanager
def compiled(df: DataFrame) -> Iterator[None]:
    """Generated methods of a pass over a wide table stay below the size up to which the JVM compiles
    them; the setting is restored afterwards, and one that goes further is kept."""
    conf = df.sparkSession.conf
    before = conf.get(_METHOD_LIMIT, None)
    if len(df.columns) <= WIDE_COLUMNS or int(before or COMPILED_BYTES + 1) <= COMPILED_BYTES:
        yield
        return
    conf.set(_METHOD_LIMIT, str(COMPILED_BYTES))
    try:
        yield
    finally:
        if before is None:
            conf.unset(_METHOD_LIMIT)
        else:
            conf.set(_METHOD_LIMIT, before)


def scratch_path(spark: SparkSession, name: str) -> str:
    """New folder under the shared ``spark.checkpoint.dir``. A local session may have none set;
    on a cluster every executor must reach the folder, so there it has to be named."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("Set spark.checkpoint.dir to a folder that all executors share.")
        base = tempfile.mkdtemp(prefix="tabwise-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/tabwise-{uuid.uuid4().hex}/{name}"


def written(df: DataFrame, path: str | None = None) -> DataFrame:
    """Write the table once and read it back: later passes are plain, column-pruned scans that
    survive the loss of executors. Names Parquet refuses are kept by position."""
    spark = df.sparkSession
    path = path or scratch_path(spark, "table")
    names = df.columns
    with compiled(df):
        df.toDF(*[f"c{i}" for i in range(len(names))]).write.parquet(path)
    return spark.read.parquet(path).toDF(*names)


def at_once(spark: SparkSession, *tasks: Callable[[], Result]) -> list[Result]:
    """Results of independent tasks whose Spark jobs run side by side, so that the last tasks of
    one job do not leave the cluster idle. The first error is raised."""
    with ThreadPoolExecutor(max_workers=max(1, len(tasks))) as pool:
        futures = [pool.submit(inheritable_thread_target(spark)(task)) for task in tasks]
        return [f.result() for f in futures]
