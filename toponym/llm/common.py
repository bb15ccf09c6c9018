"""Helpers that several training-data operators share."""

from __future__ import annotations

import ctypes
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from ..sources.shared import shared_dir

__all__ = ["expand", "give_back", "hash_words", "mix", "released", "rolling", "shared_dir", "slices", "small_batches", "split_words", "written"]

#: Words are maximal runs of characters other than blank, tab, line feed, vertical tab, form feed and carriage return.
WORD_BREAK = r"[\x20\x09-\x0D]+"
#: Rows of an Arrow batch, and bytes.
BATCH_ROWS = 1000
BATCH_BYTES = 2 << 20
#: Bytes of text that one NumPy step handles at a time.
SLICE_BYTES = 4 << 20


def written(df: DataFrame, path: str | None = None) -> DataFrame:
    """df as a table in the shared folder, read again: lineage ends here and a lost executor costs nothing."""
    spark = df.sparkSession
    path = path or shared_dir(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of at most BATCH_ROWS rows and about BATCH_BYTES bytes for the session, unless it asks for less: rows hold whole texts or packed entries here, and each worker and
    the JVM hold a batch or two."""
    for name, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        name = f"spark.sql.execution.arrow.{name}"
        number, unit = re.fullmatch(r"(-?\d+)([kmgtp]?)i?b?", spark.conf.get(name).strip().lower()).groups()
        now = int(number) << 10 * " kmgtp".index(unit or " ")
        if now <= 0 or now > most:
            spark.conf.set(name, str(most))


def give_back() -> None:
    """Free memory of this process goes back to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim:
        trim(0)


def released(work: Callable) -> Callable:
    """A function over the batches of a task that gives free memory back at its end: workers are used again by other operators."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from work(batches)
        finally:
            give_back()

    return run


def slices(batches: Iterator[pa.RecordBatch], text: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of the batches, cut and put together so that the text column of each new batch holds about `limit` bytes; a longer single text stays whole."""

    def whole(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        # a copy: pyarrow's ascii_lower misreads arrays that begin inside another
        return pa.concat_batches(held) if len(held) > 1 else held[0].take(pa.array(np.arange(held[0].num_rows)))

    held, total = [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        size = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends = np.cumsum(size)
        at = np.flatnonzero(np.diff((ends + total) // limit)) + 1
        for lo, hi in zip([0, *at.tolist()], [*at.tolist(), batch.num_rows], strict=True):
            held.append(batch.slice(lo, hi - lo))
            total += int(ends[hi - 1] - (ends[lo - 1] if lo else 0))
            if total >= limit or hi < batch.num_rows:
                yield whole(held)
                held, total = [], 0
    if held:
        yield whole(held)


def split_words(texts: pa.Array, lower: bool = False) -> tuple[pa.Array, np.ndarray]:
    """All words of the texts in order, and where each text's words begin (one more entry than texts). Null: no words."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    if lower:
        texts = pc.ascii_lower(texts)
    lists = pc.split_pattern_regex(texts, WORD_BREAK)
    flat = lists.flatten()
    full = pc.not_equal(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)
    seen = np.concatenate([[0], np.cumsum(full)])
    starts = seen[lists.offsets.to_numpy() - lists.offsets[0].as_py()]
    return (flat if full.all() else flat.filter(pa.array(full))), starts


def hash_words(words: pa.Array) -> np.ndarray:
    """A 64-bit hash of each word; equal words have equal hashes in every task."""
    import pandas as pd  # here, as it takes 25 MB of each worker

    coded = pc.dictionary_encode(words)
    unique = pd.util.hash_array(coded.dictionary.to_numpy(zero_copy_only=False).astype(object), categorize=False)
    return unique[coded.indices.to_numpy()] if len(unique) else np.zeros(0, np.uint64)


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijection of 64-bit integers that scatters them (finaliser of splitmix64), different for each seed."""
    with np.errstate(over="ignore"):
        x = x + np.uint64((0x9E3779B97F4A7C15 * (seed + 1)) & 0xFFFFFFFFFFFFFFFF)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def rolling(h: np.ndarray, width: int) -> np.ndarray:
    """A hash of every `width` consecutive entries of h, len(h) - width + 1 of them."""
    n = len(h) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(width):
            out = mix(out ^ h[k : k + n], k) if width <= 8 else out * np.uint64(0x100000001B3) + h[k : k + n]
    return out if width <= 8 else mix(out)


def expand(starts: np.ndarray) -> np.ndarray:
    """For each entry of a flat array, the number of the list that it belongs to."""
    return np.repeat(np.arange(len(starts) - 1), np.diff(starts))
