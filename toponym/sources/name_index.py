"""A persisted trigram index of names: for each trigram the ids that hold it, so that a search reads a few lists and no names.

A list is cut into rows of one block of BLOCK ids, with places within the block in order and, beside each, how many trigrams the name has; no row grows with the table. Rows are partitioned by
version, kind (a table's names or its key words) and a bucket of the trigram, and sorted by trigram, so that literal filters leave out partitions and then row groups. A second table has the number of
ids of each trigram.

A name is alike from THRESHOLD on only if it shares one of the query's n - ceil(0.3 n) + 1 rarest trigrams. Only their lists are read for candidates; the lists of the frequent ones are then read in the blocks where
candidates are, and count exactly what is shared, so similarity follows without the names.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.trigram import THRESHOLD, trigrams_of

#: Partitions of a kind's lists, and ids of a block.
BUCKETS = 32
BLOCK = 1 << 16


def _bucket(gram: Column) -> Column:
    return (F.crc32(gram.cast("binary")) % BUCKETS).cast("int")


def _lists_of_block(rows: pa.Table) -> pa.Table:
    """The lists of one block of a kind: at most BLOCK names, the trigrams of equal ones taken once."""
    rows = rows.filter(rows["name"].is_valid()).sort_by("id")
    coded = rows["name"].combine_chunks().dictionary_encode()
    own = [trigrams_of(name) for name in coded.dictionary.to_pylist()]
    sizes, number = np.array([len(g) for g in own], np.int64), {}
    flat = np.array([number.setdefault(g, len(number)) for grams in own for g in grams], np.int64)
    name = coded.indices.to_numpy()
    held = sizes[name]
    entry = np.repeat(np.arange(len(name)), held)
    gram = flat[np.repeat((np.cumsum(sizes) - sizes)[name] - (np.cumsum(held) - held), held) + np.arange(len(entry))]
    order = np.argsort(gram, kind="stable")
    offsets = pa.array(np.concatenate([[0], np.cumsum(np.bincount(gram, minlength=len(number)))]), pa.int32())
    of = lambda values: pa.ListArray.from_arrays(offsets, pa.array(values[entry[order]].astype(np.int32)))
    kind, block = (pa.repeat(rows[c][0] if len(rows) else pa.scalar(None, rows.schema.field(c).type), len(number)) for c in ("kind", "block"))
    return pa.table({"kind": kind, "gram": pa.array(list(number), pa.string()), "block": block, "places": of(rows["id"].to_numpy() & (BLOCK - 1)), "sizes": of(held)})


def postings(names: DataFrame) -> DataFrame:
    """(kind, bucket, gram, block, places, sizes) of the rows (kind, id, name), names as normal forms: null and blank names have no trigrams. Ids are unique within a kind.

    Names are dealt by kind and block, however few files hold them, and a block's lists are made where its names meet: what is shuffled is the names, not their trigrams.
    """
    placed = names.select("kind", F.col("id").cast("long").alias("id"), "name").withColumn("block", F.shiftright("id", 16))
    lists = placed.groupBy("kind", "block").applyInArrow(_lists_of_block, "kind string, gram string, block long, places array<int>, sizes array<int>")
    return lists.select("kind", _bucket(F.col("gram")).alias("bucket"), "gram", "block", "places", "sizes")


def write(names: DataFrame, path: str) -> None:
    """Writes the index of (kind, id, name) into the folder path: lists and frequencies."""
    spark = names.sparkSession
    lists = postings(names).repartition("kind", "bucket", "block").sortWithinPartitions("kind", "bucket", "gram", "block")
    lists.write.partitionBy("kind", "bucket").parquet(f"{path}/lists")
    held = spark.read.parquet(f"{path}/lists").groupBy("kind", "gram").agg(F.sum(F.size("places")).alias("held"))
    held.repartitionByRange("kind", "gram").sortWithinPartitions("kind", "gram").write.partitionBy("kind").parquet(f"{path}/frequencies")


@dataclass(frozen=True)
class NameIndex:
    """The index in a folder."""

    spark: SparkSession
    path: str

    def _lists(self, kind: str, grams: list[str]) -> DataFrame:
        buckets = sorted({zlib.crc32(g.encode()) % BUCKETS for g in grams})
        return self.spark.read.parquet(f"{self.path}/lists").where((F.col("kind") == kind) & F.col("bucket").isin(buckets) & F.col("gram").isin(grams))

    def _rare_first(self, kind: str, grams: list[str]) -> list[str]:
        """The trigrams that occur, rarest first: at most as many rows as the query has."""
        rows = self.spark.read.parquet(f"{self.path}/frequencies").where((F.col("kind") == kind) & F.col("gram").isin(grams)).select("gram", "held").collect()
        return [r["gram"] for r in sorted(rows, key=lambda r: (r["held"], r["gram"]))]

    def near(self, table: str, value: str) -> DataFrame:
        """(id, sim) of the names of a table that are like value, a normal form: sim is raised by the key word's similarity, which admits no name. Reads the frequencies of value's trigrams (a job)."""
        grams = trigrams_of(value)
        n, asked = len(grams), f"{table}.name"
        need = -(-3 * n // 10)  # shared trigrams of anything alike
        found = self._rare_first(asked, grams) if n else []
        # of the n trigrams those that do not occur count among the rarest
        rare, frequent = found[: max(n - need + 1 - (n - len(found)), 0)], found[max(n - need + 1 - (n - len(found)), 0) :]
        if not rare:
            return self.spark.createDataFrame([], "id long, sim float")
        first = self._lists(asked, rare)
        blocks = first.select("block").distinct()
        lists = [(first, 0), *((self._lists(kind, own).join(blocks, "block", "left_semi"), k) for kind, own, k in ((asked, frequent, 1), (f"{table}.word", grams, 2)) if own)]
        every = reduce(DataFrame.unionByName, (rows.select("block", F.lit(k).alias("of"), "places", "sizes") for rows, k in lists))
        return every.groupBy("block").applyInArrow(_near_of_block(n), "id long, sim float")


def _near_of_block(n: int):
    """The lists of a block as (id, sim) of the names that are like a value of n trigrams. of: 0 rare trigrams, which give candidates, 1 frequent ones, 2 those of the key words."""

    def counted(rows: pa.Table, of: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """How many of the lists hold each place, and the size of what is there."""
        rows = rows.filter(np.isin(rows["of"].to_numpy(), of))
        place = rows["places"].combine_chunks().flatten().to_numpy()
        size = np.zeros(BLOCK, np.int64)
        size[place] = rows["sizes"].combine_chunks().flatten().to_numpy()
        return np.bincount(place, minlength=BLOCK), size

    def near(rows: pa.Table) -> pa.Table:
        alike = lambda shared, size: (shared / (n + size - shared)).astype(np.float32)
        candidate, size = counted(rows, [0])
        shared, _ = counted(rows, [0, 1])
        own = alike(shared, size)
        found = np.flatnonzero((candidate > 0) & (size * 3 <= n * 10) & (n * 3 <= size * 10) & (own >= np.float32(THRESHOLD)))
        sim = np.maximum(own, alike(*counted(rows, [2])))[found]
        return pa.table({"id": rows["block"][0].as_py() * BLOCK + found, "sim": sim})

    return near


def names_of(tables: dict[str, tuple[DataFrame, str, Column, Column]]) -> DataFrame:
    """(kind, id, name) of tables: name -> (rows, key, normal form of the name, normal form of the key word)."""
    kinds = lambda name: ((f"{name}.name", 2), (f"{name}.word", 3))
    parts = [t[0].select(F.lit(kind).alias("kind"), F.col(t[1]).cast("long").alias("id"), t[at].alias("name")) for name, t in tables.items() for kind, at in kinds(name)]
    return reduce(DataFrame.unionByName, parts)
