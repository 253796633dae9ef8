"""Distinct rows of tables with long texts, without sending the texts of all rows through a shuffle.

One pass counts the rows by a 64-bit hash of all their cells; only these numbers are shuffled. The
hashes that occur more than once become a bitmap. Rows whose bit is not set have no equal row and
stay where they are; the others are compared as wholes, each task dropping its own repeats first.
The bitmap grows with the number of repeated hashes up to a bound that every executor can hold.
Beyond it more rows than needed are compared; the result is the same.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from tabwise.operators.frames import column, kinds, written

# Bits of one row of the bitmap (4 KB, fixed in Spark), the most rows (32 MB), bits per repeated hash.
ROW_BITS = 32_768
MOST_ROWS = 8192
BITS_PER_HASH = 32

_HASH, _PLACE, _BITS = "__hash", "__place", "__bits"


def distinct_table(df: DataFrame, most_rows: int = MOST_ROWS, bits_per_hash: int = BITS_PER_HASH) -> DataFrame:
    """One of each set of equal rows (NULL equals NULL, NaN equals NaN, -0.0 equals 0.0).

    Reads ``df`` three times, so it should be a scan or a narrow projection of one.
    """
    if not df.columns:
        return df.dropDuplicates()
    counted = df.select(_row_hash(df).alias(_HASH)).groupBy(_HASH).count().filter("count > 1")
    repeated = written(counted.select(_HASH))
    hashes = repeated.count()
    if not hashes:
        return df
    rows = min(most_rows, max(1, -(-hashes * bits_per_hash // ROW_BITS)))
    # Places count from 1, as the bitmap functions do.
    place = F.pmod(F.col(_HASH), F.lit(rows * ROW_BITS)) + 1
    bitmap = (
        repeated.select(place.alias(_PLACE))
        .groupBy(F.bitmap_bucket_number(_PLACE).alias("row"))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position(_PLACE)).alias(_BITS))
    )
    bitmap = written(bitmap).toDF("__row", _BITS)
    placed = df.withColumn(_HASH, _row_hash(df)).withColumn(_PLACE, place).drop(_HASH)
    # At most ``most_rows`` rows of 4 KB, hence the broadcast.
    marked = placed.join(
        F.broadcast(bitmap), F.bitmap_bucket_number(F.col(_PLACE)) == F.col("__row"), "left"
    )
    shared = F.coalesce(_is_set(F.col(_BITS), F.bitmap_bit_position(F.col(_PLACE))), F.lit(False))
    names = [column(c) for c in df.columns]
    alone = marked.filter(~shared).select(*names)
    return alone.unionByName(marked.filter(shared).select(*names).dropDuplicates())


def _row_hash(df: DataFrame) -> Column:
    """A hash that equal rows share. Maps have no hash and are left to the comparison."""
    by_kind = kinds(df)
    cells = []
    for f in df.schema.fields:
        c = column(f.name)
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            cells.append(c + F.lit(0.0))  # one zero
        elif by_kind[f.name] != "nested":
            cells.append(c)
    # NULL leaves the hash as it is, so the places of the gaps are part of it.
    gaps = [column(c).isNull() for c in df.columns]
    return F.xxhash64(*cells, *gaps)


def _is_set(bits: Column, position: Column) -> Column:
    """Whether the bit at ``position`` is set; the lowest bit of a byte comes first."""
    position = position.cast("int")
    byte = F.substring(bits, F.floor(position / 8).cast("int") + 1, F.lit(1))
    return F.getbit(F.conv(F.hex(byte), 16, 10).cast("bigint"), F.pmod(position, F.lit(8))) == 1
