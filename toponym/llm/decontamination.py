"""Benchmark decontamination by the q-gram lemma.

Texts and benchmark items are lower-cased and runs of blanks become one; all lengths and edits are of characters. An item of m characters that occurs in a text with at most e edits shares at
least m - q + 1 - e * q of its q-grams with the region, and all of them lie within e diagonals (place in the text less
place in the item) of each other. So shared q-grams are counted for each item in overlapping bands of diagonals, 2 * width wide and starting every
width > e: some band holds all q-grams of an occurrence. Bands that meet the bound give regions, which a banded alignment verifies and
measures. The edit budget of an item is rate * m, or less where the bound would fall below one q-gram. Q-grams are compared by a 64-bit hash; a false match costs work only.

A benchmark of at most BLOCK bytes is broadcast. A larger one is written to the shared folder in blocks of about that size, and each task reads one block after another for every
SLICE of its text, so that memory does not grow with the benchmark. Texts are read whole, in tasks, without a shuffle. Bands that touch are one region, for which the best place is
reported; occurrences of an item that overlap, or lie within a few characters of each other, may so count as one.

Null texts and items, and items shorter than q, match nothing. Repeated rows are treated each by itself; benchmark rows that repeat id and text are one item. An empty table, or
an empty benchmark, gives no match. Columns to carry along travel in one struct, so that names cannot clash. Of
alignments with equally few edits that with the earliest end is reported.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import released, shared_dir, slices, small_batches

#: Characters of a q-gram; a power of two.
Q = 8
#: Edits allowed per character of an item.
RATE = 0.1
#: Bytes of benchmark text that are held at once.
BLOCK = 4 << 20
#: Texts handled together, in bytes, as hashes and hits take some 50 times as much; more where there are several blocks, as each is read again for every slice.
SLICE = 1 << 19
WIDE_SLICE = 16 << 20
MATCH = "array<struct<item_id:{kind},start:int,past:int,edits:int>>"


def normalised(text: str) -> str:
    return " ".join(text.lower().split())


def characters(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def qgrams(data: np.ndarray) -> np.ndarray:
    """A hash of the q-gram that starts at each character."""
    x = data.astype(np.uint64)
    with np.errstate(over="ignore"):
        for width, factor in ((1, 0x9E3779B97F4A7C15), (2, 0xC2B2AE3D27D4EB4F), (4, 0x165667B19E3779F9)):
            x = x[:-width] * np.uint64(factor) + x[width:]
    return x


def _spread(x: np.ndarray, bits: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return ((x * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)).astype(np.int64)


@dataclass
class Items:
    """A block of benchmark items with the places of their q-grams."""

    ids: list
    texts: list[str]
    rate: float

    def __post_init__(self) -> None:
        self.size = np.array([len(t) for t in self.texts], np.int64)
        self.edits = np.minimum((self.size * self.rate).astype(np.int64), np.maximum((self.size - Q) // Q, 0))
        self.bound = self.size - Q + 1 - self.edits * Q
        self.width = self.edits + 1
        grams = [qgrams(characters(t)) if len(t) >= Q else np.zeros(0, np.uint64) for t in self.texts]
        flat = np.concatenate([np.zeros(0, np.uint64), *grams])
        item = np.repeat(np.arange(len(grams)), [len(g) for g in grams])
        place = np.concatenate([np.zeros(0, np.int64), *(np.arange(len(g)) for g in grams)])
        order = np.argsort(flat, kind="stable")
        self.grams, start, count = np.unique(flat[order], return_index=True, return_counts=True)
        self.start, self.count, self.item, self.place = start, count, item[order], place[order]
        self.bits = max(10, min(24, int(len(self.grams)).bit_length() + 4))
        self.table = np.zeros(1 << self.bits, bool)
        self.table[_spread(self.grams, self.bits)] = True


def regions(data: np.ndarray, starts: np.ndarray, items: Items) -> Iterator[tuple[int, int, int, int]]:
    """(text, item, first diagonal, last diagonal) of bands that meet an item's bound; data: texts joined, starts: where they begin."""
    if len(data) < Q or not len(items.grams):
        return
    grams = qgrams(data)
    at = np.flatnonzero(items.table[_spread(grams, items.bits)])
    text = np.searchsorted(starts, at, side="right") - 1
    inside = at + Q <= starts[text + 1]
    at, text = at[inside], text[inside]
    gram = np.minimum(np.searchsorted(items.grams, grams[at]), len(items.grams) - 1)
    same = items.grams[gram] == grams[at]
    at, text, gram = at[same], text[same], gram[same]
    if not len(at):
        return
    count = items.count[gram]
    many = np.repeat(np.arange(len(at)), count)
    entry = np.arange(len(many)) - np.repeat(np.cumsum(count) - count, count) + items.start[gram][many]
    item, text, at = items.item[entry], text[many], at[many]
    # diagonals count from -size of the item
    diagonal = at - starts[text] - items.place[entry] + items.size[item]
    band = diagonal // items.width[item]
    # a q-gram belongs to the band that starts at its own step and to the one that started a step before
    rows = np.concatenate([np.stack([text, item, band]), np.stack([text, item, band - 1])], axis=1)
    order = np.lexsort((rows[2], rows[1], rows[0]))
    rows = rows[:, order]
    head = np.flatnonzero(np.concatenate([[True], (rows[:, 1:] != rows[:, :-1]).any(axis=0)]))
    n = np.diff(np.append(head, rows.shape[1]))
    good = n >= items.bound[rows[1, head]]
    last: tuple[int, int, int] | None = None
    for t, i, b in rows[:, head[good]].T.tolist():
        lo = b * int(items.width[i]) - int(items.size[i])
        hi = lo + 2 * int(items.width[i]) - 1
        if last is not None and last[:2] == (t, i) and lo <= last[3] + 1:
            last = (t, i, last[2], hi)
            continue
        if last is not None:
            yield last
        last = (t, i, lo, hi)
    if last is not None:
        yield last


def aligned(item: np.ndarray, text: np.ndarray, lo: int, hi: int) -> tuple[int, int, int]:
    """(start, past, edits) of the place in text with the fewest edits to the item, among alignments that stay on diagonals lo to hi.

    The table is kept by diagonals: entry d of row i is the cost of the first i characters against the text up to i + lo + d.
    """
    width, far = hi - lo + 1, 1 << 20
    place = np.arange(width) + lo
    padded = np.full(len(item) + width, -1, np.int64)
    first, past = max(0, lo), min(len(text), len(item) + hi)
    if past > first:
        padded[first - lo : past - lo] = text[first:past]
    cost = np.where((place >= 0) & (place <= len(text)), 0, far)
    begin = place.copy()
    steps = np.arange(width)
    for i, letter in enumerate(item.tolist(), 1):
        end = place + i
        diagonal = cost + (padded[i - 1 : i - 1 + width] != letter)
        above = np.append(cost[1:] + 1, far)
        above_begin = np.append(begin[1:], 0)
        take = above < diagonal
        best, origin = np.where(take, above, diagonal), np.where(take, above_begin, begin)
        best[(end < 0) | (end > len(text))] = far
        # insertions: the least of best[k] - k to the left
        level = best - steps
        low = np.minimum.accumulate(level)
        source = np.maximum.accumulate(np.where(level == low, steps, 0))
        cost, begin = low + steps, origin[source]
    at = int(cost.argmin())
    return int(begin[at]), int(at + len(item) + lo), int(cost[at])


def find(texts: list[str | None], items: Items) -> list[list[tuple]]:
    """For each text its (item number, start, past, edits), places in characters of the normalised text."""
    plain = [normalised(t or "") for t in texts]
    starts = np.concatenate([[0], np.cumsum([len(t) for t in plain])]).astype(np.int64)
    data = characters("".join(plain))
    out: list[list[tuple]] = [[] for _ in texts]
    for t, i, lo, hi in regions(data, starts, items):
        own, item = plain[t], items.texts[i]
        # whole occurrences need no table; the rest is aligned
        exact = own.find(item, max(0, lo), max(0, hi) + len(item))
        place = (exact, exact + len(item), 0) if exact >= 0 else aligned(characters(item), data[starts[t] : starts[t + 1]], lo, hi)
        if place[2] <= items.edits[i]:
            out[t].append((i, *place))
    return out


def _best(found: list[dict]) -> list[dict]:
    """Of each item's places the one with the fewest edits, of those the first."""
    best: dict = {}
    for m in sorted(found, key=lambda m: (m["edits"], m["start"], m["past"])):
        best.setdefault(m["item_id"], m)
    return list(best.values())


def _blocks(benchmark: DataFrame, item: str, item_text: str):
    """A function that yields the blocks of a benchmark, each a list of (id, normalised text), and whether there is only one. Runs jobs over the benchmark."""
    spark = benchmark.sparkSession
    listed = benchmark.where(F.col(item_text).isNotNull()).select(F.col(item).alias("id"), F.col(item_text).alias("text")).distinct()
    total = listed.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    in_order = lambda rows: sorted(((i, normalised(t)) for i, t in rows), key=lambda x: (str(x[0]), x[1]))
    if total <= BLOCK:
        shared = spark.sparkContext.broadcast(in_order((r["id"], r["text"]) for r in listed.collect()))
        return (lambda: iter([shared.value])), True
    n = -(-2 * total // BLOCK)
    path = shared_dir(spark)
    listed.withColumn("block", F.pmod(F.xxhash64("id", "text"), F.lit(n))).repartition(n, "block").write.partitionBy("block").parquet(path)

    def read() -> Iterator[list[tuple]]:
        system, base = fs.FileSystem.from_uri(path) if ":" in path else (fs.LocalFileSystem(), path)
        for folder in system.get_file_info(fs.FileSelector(base)):
            if folder.base_name.startswith("block="):
                tables = [pq.read_table(x.path, filesystem=system, partitioning=None) for x in system.get_file_info(fs.FileSelector(folder.path)) if x.path.endswith(".parquet")]
                yield in_order(row for t in tables for row in zip(t.column("id").to_pylist(), t.column("text").to_pylist(), strict=True))

    return read, False


def matches(docs: DataFrame, benchmark: DataFrame, carry: list[str] | None = None, text: str = "text", item: str = "item_id", item_text: str = "text", rate: float = RATE, name: str = "matches", best: bool = False) -> DataFrame:
    """The carried columns (all, if None) and `name`: array<struct<item_id,start,past,edits>> of the items found in the text; best: one place for each item."""
    small_batches(docs.sparkSession)
    names = docs.columns if carry is None else carry
    kind = benchmark.schema[item].dataType.simpleString()
    blocks, single = _blocks(benchmark, item, item_text)
    # the text travels once, whether it is carried or not
    rows = docs.select(F.struct(F.lit(0).alias("none"), *(F.col(f"`{c}`").alias(f"c{n}") for n, c in enumerate(names) if c != text)).alias("row"), F.col(f"`{text}`").alias("text"))
    made = rows.limit(0).withColumn("found", F.lit(None).cast(MATCH.format(kind=kind))).schema
    kept = text in names
    held: dict = {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        kind = to_arrow_type(made["found"].dataType)

        def items() -> Iterator[Items]:
            if single and 0 in held:
                yield held[0]
                return
            for block in blocks():
                it = Items([i for i, _ in block], [t for _, t in block], rate)
                if single:
                    held[0] = it
                yield it

        for batch in slices(batches, "text", SLICE if single else WIDE_SLICE):
            texts = batch.column("text").to_pylist()
            found: list[list[dict]] = [[] for _ in texts]
            for it in items():
                for own, new in zip(found, find(texts, it), strict=True):
                    own += ({"item_id": it.ids[i], "start": a, "past": b, "edits": e} for i, a, b, e in new)
            found = [_best(x) if best and len(x) > 1 else x for x in found]
            yield pa.record_batch([batch.column("row"), batch.column("text") if kept else pa.nulls(len(texts), pa.string()), pa.array(found, kind)], names=["row", "text", "found"])

    out = rows.mapInArrow(released(run), made)
    return out.select(*(F.col("text" if c == text else f"row.c{n}").alias(c) for n, c in enumerate(names)), F.col("found").alias(name))


def contaminated(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", **options) -> DataFrame:
    """One row per row of docs and item found in it: key, item_id, start, past, edits, of the best place; documents without a match have none. No shuffle."""
    found = matches(docs, benchmark, carry=[key], best=True, name="__matches", **options)
    return found.select(F.col(key), F.explode("__matches").alias("__m")).select(F.col(key), "__m.*")
