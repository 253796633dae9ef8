"""Check of input files: type, size, readability and bounds, one row per file."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tabwise.functions.text import strip
from tabwise.operators.frames import local_frame
from tabwise.sources.load import DELIMITERS, header_columns


@dataclass(frozen=True)
class Limits:
    """The largest accepted file; None sets no limit."""

    file_bytes: int | None = None
    rows: int | None = None
    columns: int | None = None
    suffixes: tuple[str, ...] = ("csv",)


AUDIT_SCHEMA = (
    "path string, valid boolean, file_type string, rows bigint, columns bigint, encoding string, "
    "delimiter string, error string"
)


def audit_files(spark: SparkSession, path: str, limits: Limits = Limits()) -> DataFrame:
    """Verdict on every file under ``path`` (a file, directory or glob).

    Sizes come from the file listing. Contents are read once, as lines, of files within the size
    limit only; per file there is one pre-aggregated row, however the lines are spread over tasks.
    """
    try:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    except AnalysisException as missing:
        if "PATH_NOT_FOUND" not in str(missing):
            raise
        error = f"File not found: {path}"
        rows = [(path, False, "unknown", 0, 0, None, None, error)]
        return local_frame(spark, rows, AUDIT_SCHEMA)
    # The scan leaves out empty files, which the listing behind it knows.
    names = local_frame(spark, [(name,) for name in files.inputFiles()], "path string")
    names = names.select(_same_form(F.col("path")).alias("path"))
    sizes = files.select(
        _same_form(F.col("_metadata.file_path")).alias("path"),
        F.col("_metadata.file_size").alias("bytes"),
    )
    listed = names.join(sizes, "path", "left").fillna(0, ["bytes"])
    contents = _contents(spark, path, limits)
    return _verdicts(listed.join(contents, "path", "left"), limits)


def _same_form(path: Column) -> Column:
    """Local paths are listed as ``file:/a`` and read as ``file:///a``."""
    return F.regexp_replace(path, "^file:/+", "file:///")


def _contents(spark: SparkSession, path: str, limits: Limits) -> DataFrame:
    lines = spark.read.option("recursiveFileLookup", True).text(path)
    size = F.col("_metadata.file_size")
    place = F.struct(F.col("_metadata.file_block_start"), F.monotonically_increasing_id())
    wanted = (size > 0) & _file_type(F.col("_metadata.file_path")).isin(*limits.suffixes)
    if limits.file_bytes is not None:
        wanted &= size <= limits.file_bytes
    return (
        lines.filter(wanted)
        .select(
            _same_form(F.col("_metadata.file_path")).alias("path"), "value", place.alias("place")
        )
        .groupBy("path")
        .agg(
            F.min_by("value", "place").alias("header"),
            F.count_if(strip(F.col("value")) != "").alias("filled"),
            F.min(F.is_valid_utf8("value")).alias("utf8"),
        )
    )


def _suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./]*)$", 1))


def _file_type(path: Column) -> Column:
    return F.replace(_suffix(path), F.lit("."), F.lit(""))


def _verdicts(files: DataFrame, limits: Limits) -> DataFrame:
    suffix, file_type = _suffix(F.col("path")), _file_type(F.col("path"))
    counts = {d: header_columns(F.col("header"), d) for d in DELIMITERS}
    columns = F.greatest(*counts.values())
    delimiter: Column = F.lit(DELIMITERS[-1])
    for d in reversed(DELIMITERS[:-1]):
        delimiter = F.when(counts[d] == columns, F.lit(d)).otherwise(delimiter)
    rows = F.greatest(F.col("filled") - 1, F.lit(0)).cast("bigint")
    megabytes = F.format_number(F.col("bytes") / F.lit(1024.0 * 1024.0), 2)
    supported = file_type.isin(*limits.suffixes)
    none = 2**63 - 1
    most_bytes, most_rows, most_columns = (
        none if most is None else most for most in (limits.file_bytes, limits.rows, limits.columns)
    )
    largest = most_bytes // (1024 * 1024)
    names = " and ".join(f".{s}" for s in limits.suffixes)
    error = (
        F.when(F.col("bytes") == 0, F.lit("The file is empty (0 bytes)."))
        .when(
            F.col("bytes") > most_bytes,
            F.concat(
                F.lit("File size ("), megabytes,
                F.lit(f" MB) exceeds maximum allowed size of {largest} MB."),
            ),
        )
        .when(
            ~supported,
            F.concat(
                F.lit("Unsupported file type '"), suffix, F.lit(f"'. Only {names} is supported.")
            ),
        )
        .when(
            columns > most_columns,
            F.concat(
                F.lit("CSV has "), columns.cast("string"),
                F.lit(f" columns, exceeding the maximum limit of {most_columns}."),
            ),
        )
        .when(
            rows > most_rows,
            F.concat(
                F.lit("CSV has "), rows.cast("string"),
                F.lit(f" rows, exceeding the maximum limit of {most_rows}."),
            ),
        )
    )
    read = (F.col("bytes") > 0) & (F.col("bytes") <= most_bytes)
    counted = read & supported
    return files.select(
        "path",
        error.isNull().alias("valid"),
        F.when(read, file_type).otherwise(F.lit("unknown")).alias("file_type"),
        F.when(counted, rows).otherwise(F.lit(0)).cast("bigint").alias("rows"),
        F.when(counted, columns).otherwise(F.lit(0)).cast("bigint").alias("columns"),
        F.when(counted & F.col("utf8"), F.lit("utf-8"))
        .when(counted, F.lit("latin1"))
        .alias("encoding"),
        F.when(counted, delimiter).alias("delimiter"),
        error.alias("error"),
    )
