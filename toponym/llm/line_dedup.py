"""Removal of lines that several documents hold, but for those of one document.

Three narrow passes over the texts and one small shuffle. The first pass sets hashes of lines in two Bloom filters, once seen and twice seen: a task's second sight of a hash goes to the second filter, and so does,
where tasks' filters meet, what both have once. The second filter misses no repeat; what it holds is suspected. The second pass sends a digest of each suspected line with at most `documents` ids of a task, whatever the number of
copies, and counting these confirms exactly which lines repeat and which document keeps them. The third pass drops lines.

Filters have a fixed size (a byte for each bit in a task, 2 x 64 MB; 8 MB broadcast), whatever the data. With more lines than they can tell apart more lines are suspected, up to all; that costs a shuffle of 24 bytes for each
line of a task, no wrong result. Confirmed lines up to MOST are broadcast; of more, the MOST most frequent are broadcast and the others, which are rare, are joined with the documents that hold them.
Lines are confirmed by 128-bit digests of their keys (BLAKE2b).

Cases: a null or empty text is one empty line. Texts are read whole, of any length, and one text is handled at a time at most beyond slices of some MB. A document is an id: rows that repeat an id are one document and
all keep, or all lose, a line. A null id counts as the smallest long. Repeated lines within one document do not count as repeats, and where that document keeps a line it keeps all of them. An empty table gives no rows. Further columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix, released, slices, small_batches, written
from .filters import may_be_in

#: What is stripped off both ends of a line for its key: blank, tab, line feed, vertical tab, form feed, carriage return.
BLANKS = " \t\n\x0b\x0c\r"
#: Bits of a filter's row when filters meet.
BLOCK = 1 << 16
#: Bits that a hash sets.
PROBES = 2
#: Confirmed lines that are broadcast.
MOST = 200_000
#: Entries that a task holds back to put equal ones together.
HELD = 200_000
_LEAST = -(1 << 63)


@dataclass(frozen=True)
class Rule:
    """Lines whose key has at least `characters` code points and is held by at least `documents` documents are repeats. Filters have `bits` bits, a multiple of BLOCK; their number changes no result."""

    characters: int = 20
    documents: int = 3
    bits: int = 1 << 26


def _lines(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All lines in order, and where each text's begin (one more entry than texts)."""
    lists = pc.split_pattern(pc.fill_null(texts.cast(pa.large_string()), ""), "\n")
    return lists.flatten(), lists.offsets.to_numpy() - lists.offsets[0].as_py()


def _keys(lines: pa.Array, least: int) -> tuple[pa.Array, np.ndarray]:
    """The keys of the lines that are long enough, and the places of those lines."""
    at = np.flatnonzero(pc.binary_length(lines).to_numpy(zero_copy_only=False) >= least)
    keys = pc.ascii_lower(pc.utf8_trim(lines.take(pa.array(at)), characters=BLANKS))
    long = pc.utf8_length(keys).to_numpy(zero_copy_only=False) >= least
    return keys.filter(pa.array(long)), at[long]


def _hashes(keys: pa.Array) -> np.ndarray:
    """A 64-bit hash of each key: a sum of its bytes by powers of an odd number, scattered. Equal keys have equal hashes in every task; it only has to suspect, not to tell apart."""
    if not len(keys):
        return np.zeros(0, np.uint64)
    keys = pa.concat_arrays([keys]).cast(pa.large_string())
    _, offsets, data = keys.buffers()
    ends = np.frombuffer(offsets, np.int64)[keys.offset : keys.offset + len(keys) + 1]
    size = np.diff(ends)
    held = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]].astype(np.uint64)
    place = np.arange(len(held)) - np.repeat(ends[:-1] - ends[0], size)
    powers = np.ones(int(size.max()), np.uint64)
    with np.errstate(over="ignore"):
        powers[1:] = 0x9E3779B97F4A7C15
        powers = np.cumprod(powers)
        sums = np.add.reduceat((held + np.uint64(1)) * powers[place], ends[:-1] - ends[0])
        return mix(sums + size.astype(np.uint64))


def _bits(hashes: np.ndarray, bits: int) -> list[np.ndarray]:
    return [(mix(hashes, k) % np.uint64(bits)).astype(np.int64) for k in range(1, PROBES + 1)]


def _packed(marks: np.ndarray) -> bytes:
    """A block's bits: their places, or all bits where that is shorter."""
    at = np.flatnonzero(marks)
    return at.astype(np.uint16).tobytes() if 2 * len(at) < BLOCK // 8 else np.packbits(marks).tobytes()


def _unpacked(data: bytes) -> np.ndarray:
    if len(data) == BLOCK // 8:
        return np.unpackbits(np.frombuffer(data, np.uint8))
    out = np.zeros(BLOCK, np.uint8)
    out[np.frombuffer(data, np.uint16)] = 1
    return out


def twice_seen(docs: DataFrame, rule: Rule) -> np.ndarray:
    """The filter of hashes that were seen twice, as bytes of bits: bits / 8 of them go to the driver, whatever the data."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once, twice = np.zeros(rule.bits, np.uint8), np.zeros(rule.bits, np.uint8)
        for batch in slices(batches, "text"):
            lines, starts = _lines(batch.column("text"))
            keys, at = _keys(lines, rule.characters)
            h, doc = _hashes(keys), np.searchsorted(starts, at, "right")
            own = np.unique(np.stack([h, doc.astype(np.uint64)]), axis=1)[0] if len(h) else h  # once for each text
            h, counts = np.unique(own, return_counts=True)
            bits = _bits(h, rule.bits)
            again = (counts > 1) | np.logical_and.reduce([once[b] == 1 for b in bits])
            for b in bits:
                once[b] = 1
                twice[b[again]] = 1
        for block in range(rule.bits // BLOCK):
            part = slice(block * BLOCK, (block + 1) * BLOCK)
            if once[part].any():
                yield pa.record_batch([pa.array([block], pa.int32()), pa.array([_packed(once[part])], pa.binary()), pa.array([_packed(twice[part])], pa.binary())], names=["block", "once", "twice"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come in order of blocks; one block is held."""
        now, once, twice = None, None, None
        told = lambda: pa.record_batch([pa.array([now], pa.int32()), pa.array([np.packbits(twice).tobytes()], pa.binary())], names=["block", "twice"])
        for batch in batches:
            for block, o, t in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                if block != now:
                    if now is not None:
                        yield told()
                    now, once, twice = block, np.zeros(BLOCK, np.uint8), np.zeros(BLOCK, np.uint8)
                o = _unpacked(o)
                twice |= _unpacked(t) | (once & o)
                once |= o
        if now is not None:
            yield told()

    # a filter is made for several input partitions, so that what is shuffled grows with the cores and not with the input
    few = docs.select("text").coalesce(4 * docs.sparkSession.sparkContext.defaultParallelism)
    blocks = few.mapInArrow(released(run), "block int, once binary, twice binary").repartition("block").sortWithinPartitions("block").mapInArrow(merge, "block int, twice binary")
    out = np.zeros(rule.bits // 8, np.uint8)
    for r in blocks.collect():  # at most bits / BLOCK rows of BLOCK / 8 bytes
        out[r["block"] * BLOCK // 8 : (r["block"] + 1) * BLOCK // 8] = np.frombuffer(r["twice"], np.uint8)
    return out


def _suspected(keys: pa.Array, twice: np.ndarray) -> np.ndarray:
    found = np.ones(len(keys), bool)
    for b in _bits(_hashes(keys), 8 * len(twice)):
        found &= (twice[b >> 3] >> (7 - (b & 7)).astype(np.uint8)) & 1 == 1
    return found


def _digest(key: str) -> bytes:
    return hashlib.blake2b(key.encode(), digest_size=16).digest()


def repeats(docs: DataFrame, twice, rule: Rule) -> DataFrame:
    """(digest, keeper, held) of the repeated lines: a digest of the key, the largest id that holds it, and how many ids it was counted by (at least rule.documents)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """At most rule.documents ids for each digest: as many as decide whether it repeats, and the largest."""
        held: dict[bytes, list[int]] = {}

        def told() -> pa.RecordBatch:
            out = pa.record_batch([pa.array([d for d, ids in held.items() for _ in ids], pa.binary()), pa.array([i for ids in held.values() for i in ids], pa.int64())], names=["digest", "id"])
            held.clear()
            return out

        for batch in slices(batches, "text"):
            lines, starts = _lines(batch.column("text"))
            keys, at = _keys(lines, rule.characters)
            found = _suspected(keys, twice.value)
            ids = pc.fill_null(batch.column("id"), _LEAST).to_numpy(zero_copy_only=False)
            owner = ids[np.searchsorted(starts, at[found], "right") - 1]
            for key, i in zip(keys.filter(pa.array(found)).to_pylist(), owner.tolist(), strict=True):
                known = held.setdefault(_digest(key), [])
                if i not in known:
                    known.append(i)
                    if len(known) > rule.documents:
                        known.remove(min(known))
            if len(held) > HELD:
                yield told()
        if held:
            yield told()

    found = docs.mapInArrow(released(run), "digest binary, id long").distinct()
    return found.groupBy("digest").agg(F.max("id").alias("keeper"), F.count("*").alias("held")).where(F.col("held") >= rule.documents)


def _rare_drops(docs: DataFrame, rare: DataFrame, twice, rule: Rule) -> DataFrame:
    """(id, gone): for each document the digests among rare that it loses."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            lines, starts = _lines(batch.column("text"))
            keys, at = _keys(lines, rule.characters)
            found = _suspected(keys, twice.value)
            owner = pc.fill_null(batch.column("id"), _LEAST).take(pa.array(np.searchsorted(starts, at[found], "right") - 1))
            yield pa.record_batch([pa.array(map(_digest, keys.filter(pa.array(found)).to_pylist()), pa.binary()), owner], names=["digest", "id"])

    held = docs.mapInArrow(released(run), "digest binary, id long").distinct()
    # a rare digest is in few documents; a document's list has at most its lines
    return held.join(rare, "digest").where("id <> keeper").groupBy("id").agg(F.collect_list("digest").alias("gone"))


def remove_lines(docs: DataFrame, rule: Rule = Rule(), key: str = "doc_id", text: str = "text", most: int = MOST, whole: bool = False) -> DataFrame:
    """(doc_id, n_lines, n_dropped, kept_sha256) of every row of docs, and with `whole` the text that is left, as `kept`."""
    spark = docs.sparkSession
    small_batches(spark)
    plain = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))
    twice = spark.sparkContext.broadcast(twice_seen(plain, rule))
    found = written(repeats(plain, twice, rule))
    few = found.orderBy(F.desc("held"), "digest").limit(most + 1).collect()
    often = spark.sparkContext.broadcast({r["digest"]: r["keeper"] for r in few[:most]})
    rows = plain.withColumn("gone", F.lit(None).cast("array<binary>"))
    if len(few) > most:
        last = few[most - 1] if most else None
        after = F.lit(True) if last is None else (F.col("held") < last["held"]) | ((F.col("held") == last["held"]) & (F.col("digest") > F.lit(bytes(last["digest"]))))
        drops = written(_rare_drops(plain, found.where(after), twice, rule))
        marked = may_be_in(plain.withColumn("id", F.coalesce("id", F.lit(_LEAST))), drops, "id", "__may")
        none = F.lit(None).cast("array<binary>")
        rows = marked.where("not __may").select("id", "text", none.alias("gone")).unionByName(marked.where("__may").join(drops, "id", "left").select("id", "text", "gone"))
        rows = rows.withColumn("id", F.nullif("id", F.lit(_LEAST)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            lines, starts = _lines(batch.column("text"))
            keys, at = _keys(lines, rule.characters)
            keeper, gone = often.value, [g and set(g) for g in batch.column("gone").to_pylist()]
            found = _suspected(keys, twice.value)
            keys, at = keys.filter(pa.array(found)), at[found]
            owner = np.searchsorted(starts, at, "right") - 1
            ids = pc.fill_null(batch.column("id"), _LEAST).to_numpy(zero_copy_only=False)
            kept = np.ones(len(lines), bool)
            for digest, place, row in zip(map(_digest, keys.to_pylist()), at.tolist(), owner.tolist(), strict=True):
                kept[place] = keeper.get(digest, ids[row]) == ids[row] and not (gone[row] and digest in gone[row])
            left = np.concatenate([[0], np.cumsum(kept)])[starts]
            texts = pc.binary_join(pa.ListArray.from_arrays(pa.array(left, pa.int32()), lines.filter(pa.array(kept))), pa.scalar("\n", pa.large_string()))
            columns = [batch.column("id"), pa.array(np.diff(starts), pa.int64()), pa.array(np.diff(starts) - np.diff(left), pa.int64()), pa.array([hashlib.sha256(t.as_buffer()).hexdigest() for t in texts])]
            names = ["id", "n_lines", "n_dropped", "kept_sha256"]
            yield pa.record_batch([*columns, *([texts.cast(pa.string())] if whole else [])], names=[*names, *(["kept"] if whole else [])])

    schema = "id long, n_lines long, n_dropped long, kept_sha256 string" + (", kept string" if whole else "")
    return rows.mapInArrow(released(run), schema).withColumnRenamed("id", key)
