"""Loading tables. Text files get the types that their values allow; dates stay text."""

from __future__ import annotations

import csv
import io
import os
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tabwise.functions import parse
from tabwise.functions.text import CSV_NULL_TOKENS
from tabwise.operators.frames import column, kinds, long_form
from tabwise.sources.records import lines_of, odd_quotes, records

# Delimiters looked for in a header line, in order of precedence.
DELIMITERS = [",", ";", "\t"]
# Cell texts that make a column boolean when it holds nothing else.
TRUE_FALSE = ["True", "TRUE", "true", "False", "FALSE", "false"]
CSV_NAME = "CSV Data"

# Stands for the table itself among the columns that are counted.
_ROWS = ""

_FORMATS = {".csv": "csv", ".parquet": "parquet", ".json": "json", ".orc": "orc"}


def header_columns(line: Column, delimiter: str) -> Column:
    """Number of fields a header line has with a delimiter (quotes are not looked at)."""
    return F.length(line) - F.length(F.replace(line, F.lit(delimiter), F.lit(""))) + 1


def sniff_delimiter(header: str) -> str:
    """The delimiter that splits the header most often; the earlier one on a tie."""
    return max(DELIMITERS, key=lambda d: len(header.split(d)))


def infer_types(df: DataFrame) -> DataFrame:
    """Give all-text columns the types their values allow: one aggregate, then one projection.

    The usual null tokens become NULL. A column is whole number, double or boolean only if every
    value is; whole numbers with gaps are double; anything else stays text.
    """
    texts = [c for c, k in kinds(df).items() if k == "text"]
    if not texts:
        return df
    value = F.col("value")
    rows = (
        long_form(df, {_ROWS: F.lit("")} | {c: _known(column(c)) for c in texts})
        .groupBy("column_name")
        .agg(
            F.count(value).alias("values"),
            F.count(parse.number(value)).alias("numbers"),
            F.count(parse.whole_number(value)).alias("wholes"),
            F.count_if(value.isin(TRUE_FALSE)).alias("booleans"),
        )
        .collect()
    )
    found = {r["column_name"]: r for r in rows}
    total = found[_ROWS]["values"] if rows else 0
    typed = {}
    for c in texts:
        x, seen = _known(column(c)), found.get(c)
        if seen is None or seen["numbers"] == seen["values"]:
            typed[c] = parse.number(x)
        elif seen["booleans"] == total:
            typed[c] = x.cast("boolean")
        else:
            typed[c] = x
        if seen is not None and seen["wholes"] == total:
            typed[c] = parse.whole_number(x)
    return df.withColumns(typed)


def _known(c: Column) -> Column:
    return F.when(~c.isin(CSV_NULL_TOKENS), c)


def load_csv(
    spark: SparkSession,
    path: str | Sequence[str],
    sep: str | None = None,
    encoding: str | None = None,
    multi_line: bool | None = None,
) -> DataFrame:
    """CSV files with headers, typed by their values.

    Each file has its own header and, unless given, delimiter (the one that splits the header most
    often) and encoding (UTF-8, or Latin-1 if a line of the file is not valid UTF-8): files that are
    alike are read together, and columns are matched by name. Files are split over tasks, also where
    quoted cells hold line breaks, which are then ``\\n``; ``multi_line=False`` reads such lines as
    records of their own.
    """
    try:
        lines = spark.read.text(path)
    except AnalysisException as missing:
        if "PATH_NOT_FOUND" in str(missing):
            raise FileNotFoundError(f"CSV file not found: {path}") from missing
        raise
    kinds_of_files = _file_kinds(lines, sep, encoding, multi_line)
    if not kinds_of_files:
        raise ValueError(f"No data in '{path}'")
    parts = []
    for kind in kinds_of_files:
        where = path if len(kinds_of_files) == 1 else kind["files"]
        options = {"sep": kind["sep"], "quote": '"', "escape": '"', "encoding": kind["encoding"]}
        if kind["broken_lines"]:
            parts.append(_read_records(spark.read.text(where), options))
        else:
            parts.append(spark.read.options(**options, header=True, inferSchema=False).csv(where))
    table = parts[0]
    for part in parts[1:]:
        table = table.unionByName(part, allowMissingColumns=True)
    return infer_types(table)


def _file_headers(lines: DataFrame) -> DataFrame:
    """Per file of a text scan: a hash of the header and its fields by delimiter, and what all lines say."""
    value = F.col("value")
    # the first line of a file has the least number in its first split; whatever is kept of it is a number,
    # as texts among the aggregates would have all lines sorted by file
    first = F.when(F.col("block") == 0, F.monotonically_increasing_id())

    def of_header(x: Column) -> Column:
        return F.min_by(F.when(F.col("block") == 0, x), "first")

    return (
        lines_of(lines)
        .withColumn("first", first)
        .groupBy("file")
        .agg(
            of_header(F.xxhash64(value)).alias("header"), F.bool_and(F.is_valid_utf8(value)).alias("valid"),
            F.max(odd_quotes(value)).alias("broken_lines"),
            *[of_header(header_columns(value, d)).alias(f"split{i}") for i, d in enumerate(DELIMITERS)],
        )
    )


def _file_kinds(lines: DataFrame, sep: str | None, encoding: str | None, multi_line: bool | None) -> list[dict]:
    """The kinds of files of a text scan: delimiter, encoding, whether quoted line breaks are likely, and,
    where there are several kinds, their files. One pass over the lines."""
    files = _file_headers(lines)
    splits = [F.col(f"split{i}") for i in range(len(DELIMITERS))]
    sniffed = F.lit(DELIMITERS[-1])
    for i in reversed(range(len(DELIMITERS) - 1)):
        most = F.greatest(*splits[i:])
        sniffed = F.when(splits[i] == most, F.lit(DELIMITERS[i])).otherwise(sniffed)
    charset = F.when(F.col("valid"), F.lit("UTF-8")).otherwise(F.lit("ISO-8859-1"))
    each = files.select(
        "file",
        (F.lit(sep) if sep else sniffed).alias("sep"),
        (F.lit(encoding) if encoding else charset).alias("encoding"),
        (F.col("broken_lines") if multi_line is None else F.lit(multi_line)).alias("broken_lines"),
        "header",
    )
    same = ["sep", "encoding", "broken_lines", "header"]
    found = each.groupBy(*same).agg(F.min("file").alias("first")).orderBy("first").collect()
    if len(found) < 2:
        return [r.asDict() for r in found]
    listed = each.groupBy(*same).agg(F.min("file").alias("first"), F.collect_list("file").alias("files"))
    return [r.asDict() for r in listed.orderBy("first").collect()]


def _read_records(lines: DataFrame, options: dict[str, str]) -> DataFrame:
    """The records of files with equal headers as columns of text."""
    charset = options["encoding"]
    text = F.col("value").cast("string") if charset == "UTF-8" else F.decode("value", charset)
    found = records(lines, options["sep"]).select(text.alias("value"), "header")
    header = found.filter("header").first()["value"]
    names = next(csv.reader(io.StringIO(header), delimiter=options["sep"]))
    parsing = {k: x for k, x in options.items() if k != "encoding"}
    cells = F.from_csv("value", ", ".join(f"c{i} string" for i in range(len(names))), parsing)
    return found.filter("NOT header").select(cells.alias("r")).select("r.*").toDF(*names)


def table_format(path: str, fmt: str | None = None) -> str:
    """The format given, or the one that the suffix of the path stands for."""
    suffix = os.path.splitext(path.rstrip("/"))[1].lower()
    fmt = fmt or _FORMATS.get(suffix)
    if fmt not in _FORMATS.values():
        known = ", ".join(_FORMATS)
        raise ValueError(f"Unsupported file format '{suffix}'. Must be one of {known}")
    return fmt


def load_table(
    spark: SparkSession, path: str, fmt: str | None = None, **csv_options
) -> tuple[DataFrame, str]:
    """``(table, name)`` of a file or directory; the format follows from the suffix. Options of
    ``load_csv`` (``sep``, ``encoding``, ``multi_line``) are passed on."""
    fmt = table_format(path, fmt)
    if fmt == "csv":
        return load_csv(spark, path, **csv_options), CSV_NAME
    table = spark.read.format(fmt).load(path)
    base, suffix = os.path.splitext(os.path.basename(path.rstrip("/")))
    return table, base if suffix.lower() in _FORMATS else base + suffix
