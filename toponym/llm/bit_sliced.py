"""Exact top-k inner products over a bit-sliced index.

Every component of a vector becomes floor(scale * x). The index deals rows to blocks by a hash; in a block each attribute,
less the block's least value, is stored as bitmaps: one for each bit of its value, with one bit for each row. A query adds the slices that its own bits
select with bitmap arithmetic (carry-save adders), which gives the slices of all scores of the block. Rows are then chosen from
the most significant slice downward: while more rows than wanted have a one, only they stay; otherwise they are in and the search goes on among
the others. The rows still level after the last slice all have one score and are settled by the smaller id, so the choice is exact.

Each task pairs one block of rows with one block of queries; the blocks meet by a join on their numbers, and partial results are at most k rows for each query and
block. Nothing is broadcast.

Vectors that are null, empty, or hold null or non-finite components take no part, nor do null ids. Vectors meet only queries of
their own length. Rows with the id of a query are not its candidates; every other row is one, also if it repeats an id, or an id and its vector (of rows that
repeat both, k stand for all of them, as more cannot be results). Queries that share an id are one query, with the best of the results of all. An empty table, or fewer rows than k,
gives fewer results. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import released

#: Rows of an index block, and queries of a query block.
BLOCK = 16_384
QUERIES = 1024
BLOCKS = "dims int, block int, low long, least long, ids binary, slices binary, rest binary"


def quantised(vec: Column, scale: int = 256) -> Column:
    """floor(scale * component) as longs; null for vectors that take no part."""
    whole = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.when(vec.isNotNull() & (F.size(vec) > 0) & whole, F.transform(vec, lambda x: F.floor(x.cast("double") * scale)))


def _bitmaps(values: np.ndarray) -> np.ndarray:
    """Bitmaps [bit, word] of whole numbers that are not negative."""
    bits = max(1, int(values.max()).bit_length())
    values = np.pad(values.astype(np.uint64), (0, -len(values) % 64))
    return np.stack([np.packbits(((values >> np.uint64(b)) & np.uint64(1)).astype(np.uint8), bitorder="little").view(np.uint64) for b in range(bits)])


def _index(group: pd.DataFrame) -> pd.DataFrame:
    """One row per block: ids in order; slices of each attribute; slices of how far each row's sum is below the largest sum."""
    group = group.sort_values("id", kind="stable")
    values = np.stack(group["q"].to_list())
    low = int(values.min())
    over = values - low
    bits = max(1, int(over.max()).bit_length())
    maps = np.zeros((values.shape[1], bits, (len(values) + 63) // 64), np.uint64)
    for j in range(values.shape[1]):
        own = _bitmaps(over[:, j])
        maps[j, : len(own)] = own
    sums = over.sum(axis=1)
    return pd.DataFrame({"dims": [values.shape[1]], "block": [group["block"].iat[0]], "low": [low], "least": [int(sums.max())], "ids": [group["id"].to_numpy(np.int64).tobytes()], "slices": [maps.tobytes()], "rest": [_bitmaps(sums.max() - sums).tobytes()]})


def add_slices(addends: list[tuple[int, np.ndarray]], depth: int, words: int) -> np.ndarray:
    """The slices of a sum below 2 ** depth, from (weight, [slice, word]) addends: three slices of one weight become a sum and a carry until one is left."""
    waiting: list[list[np.ndarray]] = [[] for _ in range(depth + 1)]
    for weight, bitmaps in addends:
        waiting[weight].append(bitmaps)
    out = np.zeros((depth, words), np.uint64)
    for weight in range(depth):
        line = np.concatenate(waiting[weight]) if waiting[weight] else out[:0]
        while len(line) > 1:
            third = len(line) // 3
            if third:
                # all groups of three in one bitmap operation
                a, b, c = line[:third], line[third : 2 * third], line[2 * third : 3 * third]
                half = a ^ b
                waiting[weight + 1].append((a & b) | (half & c))
                half ^= c
                line = np.concatenate([half, line[3 * third :]]) if len(line) > 3 * third else half
            else:
                waiting[weight + 1].append(line[:1] & line[1:])
                line = line[:1] ^ line[1:]
        if len(line):
            out[weight] = line[0]
    return out


def choose(slices: np.ndarray, allowed: np.ndarray, k: int) -> np.ndarray:
    """Places of the k largest of the allowed rows, from the most significant slice downward; of level rows the first."""
    chosen, left, need = np.zeros_like(allowed), allowed.copy(), k
    for s in slices[::-1]:
        ones = left & s
        n = int(np.bitwise_count(ones).sum())
        if n > need:
            left = ones
            continue
        chosen |= ones
        left &= ~s
        need -= n
        if not need:
            break
    places = lambda m: np.flatnonzero(np.unpackbits(m.view(np.uint8), bitorder="little"))
    return np.concatenate([places(chosen), places(left)[:need]])


def score_slices(maps: np.ndarray, rest: np.ndarray, query: np.ndarray, low: int, least: int) -> tuple[np.ndarray, int]:
    """Slices of all scores of a block, less an offset that is the same for all rows.

    With row = low + u and query = base + v the score is v.u + base * sum(u) + low * sum(v) + base * low * dims; base is zero or
    negative, so base * sum(u) = -base * rest + base * least, where rest = least - sum(u).
    """
    base = min(0, int(query.min()))
    v = query - base
    bits, words = maps.shape[1:]
    addends = [(s + b, maps[(v >> s & 1).astype(bool), b]) for s in range(int(v.max()).bit_length()) for b in range(bits)]
    addends += [(s + b, rest[b : b + 1]) for s in range((-base).bit_length()) if -base >> s & 1 for b in range(len(rest))]
    most = int(v.sum()) * ((1 << bits) - 1) - base * ((1 << len(rest)) - 1)
    slices = add_slices(addends, max(1, most.bit_length()), words)
    return slices, base * least + low * int(v.sum()) + base * low * len(query)


def _search(k: int):
    """(query_id, vec_id, score): the best k of a block for each query of a query block."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids = np.frombuffer(row["ids"], np.int64)
                words = (len(ids) + 63) // 64
                rest = np.frombuffer(row["rest"], np.uint64).reshape(-1, words)
                maps = np.frombuffer(row["slices"], np.uint64).reshape(row["dims"], -1, words)
                out: list[list] = [[], [], []]
                for item in row["queries"]:
                    slices, offset = score_slices(maps, rest, np.array(item["q"], np.int64), row["low"], row["least"])
                    free = np.zeros(64 * words, np.uint8)
                    free[: len(ids)] = ids != item["id"]
                    at = choose(slices, np.packbits(free, bitorder="little").view(np.uint64), k)
                    bits = (slices[:, at // 64] >> (at % 64).astype(np.uint64)) & np.uint64(1)
                    # both parts may leave 64 bits though their sum does not: they are added modulo 2 ** 64
                    low = bits[:64] << np.arange(min(64, len(slices)), dtype=np.uint64)[:, None]
                    score = (low.sum(axis=0, dtype=np.uint64) + np.uint64(offset % (1 << 64))).view(np.int64)
                    for column, value in zip(out, ([item["id"]] * len(at), ids[at].tolist(), score.tolist()), strict=True):
                        column += value
                yield pa.record_batch([pa.array(c, pa.int64()) for c in out], names=["query_id", "vec_id", "score"])

    return released(search)


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, scale: int = 256, key: str = "vec_id", vec: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): for each row where is_query holds, its k best other rows. Runs a counting job. The key has to be a whole number."""
    rows = vectors.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("id"), quantised(F.col(vec), scale).alias("q"), is_query.alias("asks"))
    rows = rows.where("q is not null").groupBy("id", "q").agg(F.max(F.coalesce("asks", F.lit(False))).alias("asks"), F.count("*").alias("times"))
    rows = rows.select("id", "q", "asks", F.size("q").alias("dims"), F.explode(F.sequence(F.lit(1), F.least("times", F.lit(k)))).alias("copy")).withColumn("hash", F.xxhash64("id", "q", "copy"))
    sizes = rows.agg(F.count("*").alias("rows"), F.count_if("asks").alias("queries")).first()
    n_blocks, n_queries = -(-sizes["rows"] // BLOCK) or 1, -(-sizes["queries"] // QUERIES) or 1
    number = lambda n: F.pmod(F.xxhash64("hash", F.lit(n)), F.lit(n)).cast("int")
    index = rows.select("dims", number(n_blocks).alias("block"), "id", "q").groupBy("dims", "block").applyInPandas(_index, BLOCKS)
    index = index.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(n_queries - 1))))
    asked = rows.where("asks").select("dims", number(n_queries).alias("part"), F.struct("id", "q").alias("query")).groupBy("dims", "part").agg(F.collect_list("query").alias("queries"))
    asked = asked.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))))
    pairs = index.join(asked.hint("shuffle_hash"), ["dims", "block", "part"]).select("dims", "low", "least", "ids", "slices", "rest", "queries")
    found = pairs.mapInArrow(_search(k), "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
