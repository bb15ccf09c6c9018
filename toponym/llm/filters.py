"""Semi- and anti-joins of wide rows with a list of keys that shuffle few of the wide rows.

A bitmap of fixed size (BITS, so 4 MB whatever the data) is broadcast as a table and says of a key whether it may be in the list. Rows that it
excludes are decided where they are; only the others are joined exactly. A full bitmap excludes nothing and costs only speed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

#: Bits of the bitmap; a multiple of the 32,768 bits of one built-in bitmap.
BITS = 1 << 25


def may_be_in(rows: DataFrame, keys: DataFrame, key: str, name: str = "may") -> DataFrame:
    """rows with a boolean column: false only where rows[key] is null or not among keys[key]. Runs a job over keys."""
    bit = lambda: F.pmod(F.xxhash64(F.col(key)), F.lit(BITS)) + 1  # noqa: E731  built-in bitmaps count from 1
    marks = keys.where(F.col(key).isNotNull()).select(bit().alias("__bit"))
    parts = written(marks.groupBy(F.bitmap_bucket_number("__bit").alias("__part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("__bit")).alias("__map")))
    at = F.bitmap_bit_position(bit())
    byte = F.conv(F.hex(F.substring("__map", (F.shiftright(at, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    # at most BITS / 32768 rows of 4 KB
    found = rows.join(F.broadcast(parts), F.bitmap_bucket_number(bit()) == F.col("__part"), "left")
    return found.withColumn(name, F.coalesce(F.getbit(byte, (at % 8).cast("int")) == 1, F.lit(False)) & F.col(key).isNotNull()).drop("__part", "__map")


def semi_join(rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """The rows whose key is among keys[key]."""
    return may_be_in(rows, keys, key, "__may").where("__may").join(keys.select(key), key, "left_semi").select(*rows.columns)


def anti_join(rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """The rows whose key is null or not among keys[key]."""
    marked = may_be_in(rows, keys, key, "__may")
    return marked.where(~F.col("__may")).select(*rows.columns).unionByName(marked.where("__may").join(keys.select(key), key, "left_anti").select(*rows.columns))
