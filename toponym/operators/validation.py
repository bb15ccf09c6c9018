"""Checks of a loaded version: row thresholds, broken references, repeated keys."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


#: Bitmaps of 32,768 keys (4 KB) of one dimension that are broadcast; a dimension with more is joined.
MAPS = 1024


def _number(key: Column, kind: T.DataType) -> Column:
    """A key as a number for a bitmap, one to one; null for a text that is not six digits."""
    return F.when(key.rlike("^[0-9]{6}$"), key).cast("long") if isinstance(kind, T.StringType) else key.cast("long")


def _bitmaps(references: dict[str, tuple[DataFrame, str]]) -> dict[str, list[tuple[int, bytearray]]]:
    """Column -> (number, bitmap) of the keys that its table has; a column whose table has too many bitmaps, or keys that are no numbers, is missing. One job."""
    parts = []
    for column, (table, key) in references.items():
        kind = table.schema[key].dataType
        if not isinstance(kind, T.StringType | T.IntegralType):
            continue
        n = _number(F.col(key), kind)
        odd = F.col(key).isNotNull() & n.isNull()
        maps = table.where(F.col(key).isNotNull()).select(F.when(~odd, F.bitmap_bucket_number(n)).alias("part"), F.coalesce(F.bitmap_bit_position(n), F.lit(0)).alias("bit"))
        parts.append(maps.groupBy("part").agg(F.bitmap_construct_agg("bit").alias("map")).limit(MAPS + 1).select(F.lit(column).alias("column"), "part", "map"))
    held: dict[str, list] = {c: [] for c, (t, k) in references.items() if isinstance(t.schema[k].dataType, T.StringType | T.IntegralType)}
    for r in reduce(DataFrame.unionByName, parts).collect() if parts else []:  # at most MAPS + 1 rows of 4 KB for each reference
        held[r["column"]].append((r["part"], r["map"]))
    return {c: maps for c, maps in held.items() if len(maps) <= MAPS and all(p is not None for p, _ in maps)}


def orphans(rows: DataFrame, references: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """Rows with a reference that is not null and not found; a row with several of them comes once.

    references: column -> (table, its key). Bitmaps of the keys of each table are broadcast, so that rows are tested in one narrow pass without a shuffle. A table whose keys need more than MAPS bitmaps, or are neither
    whole numbers nor texts of six digits, is joined by its distinct keys. Runs a job over the keys.
    """
    marked, broken, maps = rows, [], _bitmaps(references)
    for n, (column, (table, key)) in enumerate(references.items()):
        own = rows.schema[column].dataType
        if column in maps and type(own) in (type(table.schema[key].dataType), T.LongType, T.IntegerType) and isinstance(own, T.StringType) == isinstance(table.schema[key].dataType, T.StringType):
            value = _number(F.col(column), own)
            # a bitmap as numbers of 64 bits: one of them is read in place, where a binary would be copied for each row
            words = [np.frombuffer(m, "<i8") for _, m in maps[column]]
            table_of = pa.table({f"__part{n}": pa.array([p for p, _ in maps[column]], pa.int64()), f"__map{n}": pa.array(words, pa.list_(pa.int64()))})
            held = F.broadcast(rows.sparkSession.createDataFrame(table_of))
            marked = marked.join(held, F.bitmap_bucket_number(value) == F.col(f"__part{n}"), "left")
            at = F.bitmap_bit_position(value)
            bit = F.getbit(F.get(F.col(f"__map{n}"), F.shiftright(at, 6).cast("int")), (at % 64).cast("int"))
            broken.append(F.col(column).isNotNull() & ~F.coalesce(bit == 1, F.lit(False)))
        else:
            keys = table.select(F.col(key).alias(f"__key{n}")).where(F.col(f"__key{n}").isNotNull()).distinct()
            marked = marked.join(keys, F.col(column) == F.col(f"__key{n}"), "left")
            broken.append(F.col(column).isNotNull() & F.col(f"__key{n}").isNull())
    return marked.where(reduce(lambda a, b: a | b, broken)).select(*rows.columns)


def repeated_keys(rows: DataFrame, key: str) -> DataFrame:
    """Keys that occur more than once, with their count: (key, count)."""
    return rows.groupBy(key).count().where("count > 1")


def row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """(table_name, n_rows) of all tables in one job."""
    return reduce(DataFrame.unionByName, (rows.agg(F.lit(name).alias("table_name"), F.count("*").alias("n_rows")) for name, rows in tables.items()))


#: Row thresholds of a snapshot's tables. (Fixed values.)
MIN_ROWS = {"federal_subject": 80, "district": 1_000, "postal_code": 50_000, "main_city": 100_000, "city": 10_000, "street": 500_000, "address_range": 1_000_000}
#: References that are checked: name of the count -> table -> its columns, each with the table and key referred to.
REFERENCES = {
    "address_reference_orphans": ("address_range", {"postal_code": "postal_code", "id_subject": "federal_subject", "id_district": "district", "id_main_city": "main_city", "id_city": "city", "id_street": "street"}),
    "district_subject_orphans": ("district", {"id_subject": "federal_subject"}),
    "main_city_reference_orphans": ("main_city", {"id_subject": "federal_subject", "id_district": "district"}),
    "city_main_city_orphans": ("city", {"id_main_city": "main_city"}),
}


def validate(tables: dict[str, DataFrame], prefixes: dict[str, str], min_rows: dict[str, int] | None = None, counts: dict[str, int] | None = None) -> dict:
    """The validation record of a version: row counts, orphan counts, ok and errors. prefixes: table -> file prefix. counts: rows of the tables, where they are known; otherwise they are counted."""
    least, checks, errors = MIN_ROWS if min_rows is None else min_rows, {}, []
    counts = {r["table_name"]: r["n_rows"] for r in row_counts(tables).collect()} if counts is None else counts
    for name in tables:
        checks[f"rows_{prefixes[name]}"] = n = counts[name]
        if n < least[name]:
            errors.append(f"{prefixes[name]}: row count {n} below safety threshold {least[name]}")
    broken = lambda check, name, columns: orphans(tables[name], {c: (tables[to], c) for c, to in columns.items()}).agg(F.lit(check).alias("check"), F.count("*").alias("n"))
    found = {r["check"]: r["n"] for r in reduce(DataFrame.unionByName, (broken(check, *at) for check, at in REFERENCES.items())).collect()}
    for check, (name, _) in REFERENCES.items():
        checks[check] = n = found[check]
        if n:
            errors.append(f"{name} contains {n} rows with broken references")
    return checks | {"ok": not errors, "errors": errors}
