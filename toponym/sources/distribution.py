"""Distributions of a version's columns as mergeable sketches: distinct values, histogram bounds and common values, gathered at import and merged over versions without reading rows.

Each column of a version has one row. Its sketches have a fixed size, whatever the table's: HyperLogLog over the values as text, a KLL sketch of whole numbers, and a sketch of
frequent values. Tasks sketch their own rows; what is shuffled is one row for each task.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Logarithm of the HyperLogLog registers: a standard error of about 1.6 % of the distinct values, none worth naming up to some hundreds.
REGISTERS = 12
#: Size of a KLL sketch: ranks are within 1.4 % of the rows.
KLL = 200
#: Values that are tracked as frequent. Counts are exact up to that number of distinct values, else within 3.5 / 1024 of the rows.
TRACKED = 1000
#: Texts of more bytes are counted as distinct values, but are not among the common ones, so that a sketch stays small.
WIDEST = 1024


def _whole(kind: T.DataType) -> bool:
    return isinstance(kind, T.IntegralType)


def sketched(rows: DataFrame, table: str, columns: list[str]) -> DataFrame:
    """One row for each column of a table: (table_name, column_name, n_rows, nulls, values_sketch, bounds_sketch, common_sketch); columns that are no whole numbers have no bounds."""
    made = []
    for c in columns:
        text = F.col(f"`{c}`").cast("string")
        short = F.when(F.octet_length(text) <= WIDEST, text)
        bounds = F.kll_sketch_agg_bigint(F.col(f"`{c}`").cast("long"), KLL) if _whole(rows.schema[c].dataType) else F.lit(None).cast("binary")
        made.append(F.struct(F.lit(c).alias("column_name"), F.count_if(text.isNull()).alias("nulls"), F.hll_sketch_agg(text, REGISTERS).alias("values_sketch"), bounds.alias("bounds_sketch"), F.call_function("approx_top_k_accumulate", short, F.lit(TRACKED)).alias("common_sketch")))
    one = rows.agg(F.count(F.lit(1)).alias("n_rows"), F.array(*made).alias("all"))
    return one.select(F.lit(table).alias("table_name"), "n_rows", F.explode("all").alias("c")).select("table_name", "c.column_name", "n_rows", *(f"c.{x}" for x in ("nulls", "values_sketch", "bounds_sketch", "common_sketch")))


def write(tables: dict[str, tuple[DataFrame, list[str]]], path: str) -> None:
    """Writes the sketches of tables, each with its columns, in one job of one pass over each table."""
    reduce(DataFrame.unionByName, (sketched(rows, name, columns) for name, (rows, columns) in tables.items())).coalesce(1).write.parquet(path)


def distribution(sketches: DataFrame, parts: int = 10, common: int = 10) -> DataFrame:
    """(table_name, column_name, n_rows, nulls, n_distinct, bounds, common) of sketches, those of the same column merged.

    n_distinct: nulls do not count. bounds: parts + 1 values from the lowest to the highest, between which about equally many rows lie; null for columns that are no whole numbers or hold nothing. common: up to that many
    (value, n), the most frequent first, ties by value; nulls are not among them. The lowest and highest bound are exact; see the constants for the errors of the rest.
    """
    if not 1 <= common < TRACKED or parts < 1:
        raise ValueError(f"parts has to be 1 or more, and common 1 to {TRACKED - 1}")
    held = sketches.groupBy("table_name", "column_name").agg(
        F.sum("n_rows").alias("n_rows"), F.sum("nulls").alias("nulls"), F.hll_sketch_estimate(F.hll_union_agg("values_sketch")).alias("n_distinct"),
        F.kll_merge_agg_bigint("bounds_sketch").alias("b"), F.count("bounds_sketch").alias("has"), F.call_function("approx_top_k_combine", F.col("common_sketch"), F.lit(TRACKED)).alias("c"),
    )
    ranks = F.array(*(F.lit(i / parts) for i in range(parts + 1)))
    bounds = F.when((F.col("has") > 0) & (F.kll_sketch_get_n_bigint("b") > 0), F.kll_sketch_get_quantile_bigint("b", ranks))
    # one more than asked for, as nulls may be among the most frequent
    found = F.filter(F.call_function("approx_top_k_estimate", F.col("c"), F.lit(common + 1)), lambda x: x["item"].isNotNull())
    ordered = F.array_sort(F.transform(found, lambda x: F.struct((-x["count"]).alias("m"), x["item"].alias("value"))))
    most = F.transform(F.slice(ordered, 1, common), lambda x: F.struct(x["value"].alias("value"), (-x["m"]).alias("n")))
    return held.select("table_name", "column_name", "n_rows", "nulls", "n_distinct", bounds.alias("bounds"), most.alias("common"))
