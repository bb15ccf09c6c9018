"""Removal of repeated passages by fixed-block anchors.

Words are numbered within their document. Any passage of `window` words that occurs elsewhere holds, at either place, a whole
block of window / 2 words that starts at a multiple of that length. So the blocks at those multiples, which do not overlap, are indexed as
references, and every rolling window of block length probes them. A probe that meets a reference other than itself is a hit. Hits are
extended to the passages of `window` words around them, these are compared as wholes, and consecutive equal passages
join to maximal repeats. A passage whose words also start earlier (smaller key, or same document and smaller place) is a repeat, and
each word that a repeat covers is removed.

Entries travel as packed rows of (document, place, hash), a few bytes each. Of equal blocks, windows or passages within one slice of a task only the
first is sent on, in either exchange, so a passage that a third of all documents hold reaches its task once for each slice; the places of the others are hits, or repeats, as they stand. A text is shuffled only if
it has a hit. Blocks are compared by 32 bits beside their bucket (a false hit costs work only), passages by 64 bits beside an independent
bucket.

Null text: no words. Null keys sort before all others. Rows that repeat a key with another text are documents of their own, in an order by a hash of the text;
rows that repeat key and text are one document, returned as often as they occur. Texts shorter than the window keep
everything. An empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import expand, hash_words, mix, released, rolling, slices, small_batches, split_words, written
from .filters import may_be_in
from .packed import FIELDS, NAMES, pack, runs, unpack

#: Text of one slice; of equal passages in a slice one is sent.
SLICE = 8 << 20
ROW = f"bucket int, kind int, {FIELDS}"
RUNS = "key long, tie int, runs array<int>"


def _rows(found: list[list]) -> pa.RecordBatch:
    kinds = [pa.int32(), pa.int32(), *[pa.binary()] * 5]
    columns = list(zip(*found, strict=True)) if found else [[]] * 7
    return pa.record_batch([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names=["bucket", "kind", *NAMES])


def _sorted_docs(batch: pa.RecordBatch) -> pa.RecordBatch:
    order = np.lexsort((batch.column("tie").to_numpy(), batch.column("key").to_numpy()))
    return batch.take(pa.array(order))


def _dealt(bucket: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each bucket with the places of its entries, in their order."""
    order = np.argsort(bucket, kind="stable")
    cuts = np.flatnonzero(np.diff(bucket[order])) + 1
    for part in np.split(order, cuts):
        if len(part):
            yield int(bucket[part[0]]), part


def _probe(window: int, buckets: int):
    """Rows of kind 0 with the reference blocks of a slice, and of kind 1 with all rolling windows of block length, each different one once; of kind 2 with places whose window the
    slice holds several times, which are hits already."""
    block = window // 2

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", SLICE):
            words, starts = split_words(batch.column("text"))
            h = rolling(hash_words(words), block)
            if not len(h):
                continue
            doc = expand(starts)
            long_enough = np.diff(starts) >= window
            fits = (doc[: len(h)] == doc[block - 1 :]) & long_enough[doc[: len(h)]]
            at = np.flatnonzero(fits)
            h, doc = h[at], doc[at]
            place = at - starts[doc]
            keys, ties = batch.column("key").to_numpy(), batch.column("tie").to_numpy()
            found = []
            _, first, group, count = np.unique(h, return_index=True, return_inverse=True, return_counts=True)
            several = np.flatnonzero(count[group] > 1)
            if len(several):
                found.append([int(h[several[0]] % np.uint64(buckets)), 2, *pack(keys, ties, doc[several], place[several], None)])
            # a reference stands for all of its kind, and so does a probe
            fixed = place % block == 0
            fixed_at = np.flatnonzero(fixed)
            _, first_fixed = np.unique(group[fixed_at], return_index=True)
            for kind, at in ((1, np.sort(first)), (0, np.sort(fixed_at[first_fixed]))):
                bucket = ((h[at] >> np.uint64(32)) % np.uint64(buckets)).astype(np.int32)
                for b, part in _dealt(bucket.astype(np.uint16) if buckets <= 65536 else bucket):
                    own = at[part]
                    found.append([b, kind, *pack(keys, ties, doc[own], place[own], h[own].astype(np.uint32))])
            yield _rows(found)

    return released(probe)


def _hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, tie, place) of probes that meet a reference other than themselves, and of places that are hits already. Rows come by bucket, references first."""
    bucket, refs, index = None, [], None
    for batch in batches:
        for row in batch.to_pylist():
            if row["bucket"] != bucket:
                bucket, refs, index = row["bucket"], [], None
            key, tie, place = unpack(row)
            if row["kind"] == 2:
                yield pa.record_batch([pa.array(key), pa.array(tie), pa.array(place.astype(np.int32))], names=["key", "tie", "place"])
                continue
            h = np.frombuffer(row["hashes"], np.uint32)
            if row["kind"] == 0:
                refs.append((h, key, tie, place))
                continue
            if not refs:
                continue
            if index is None:
                all_h, *who = (np.concatenate(x) for x in zip(*refs, strict=True))
                values, first, count = np.unique(all_h, return_index=True, return_counts=True)
                index = values, count > 1, *(x[first] for x in who)
                refs = [None]
            values, several, r_key, r_tie, r_place = index
            i = np.minimum(np.searchsorted(values, h), len(values) - 1)
            hit = (values[i] == h) & (several[i] | (r_key[i] != key) | (r_tie[i] != tie) | (r_place[i] != place))
            if hit.any():
                yield pa.record_batch([pa.array(key[hit]), pa.array(tie[hit]), pa.array(place[hit].astype(np.int32))], names=["key", "tie", "place"])


def _extend(window: int, buckets: int):
    """Passages around the hits: of equal ones in a slice the first as entries of their bucket (kind 0), the others as repeats (kind 1)."""
    block = window // 2

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", SLICE):
            batch = _sorted_docs(batch)
            words, starts = split_words(batch.column("text"))
            if len(words) < window:
                continue
            h = hash_words(words)
            lists = batch.column("places")
            owner = expand(lists.offsets.to_numpy() - lists.offsets[0].as_py())
            hit = lists.flatten().to_numpy().astype(np.int64) + starts[owner]
            lo = np.maximum(hit - (window - block), starts[owner])
            hi = np.minimum(hit, starts[owner + 1] - window)
            good = hi >= lo
            open_ = np.bincount(lo[good], minlength=len(h) + 1) - np.bincount(hi[good] + 1, minlength=len(h) + 1)
            at = np.flatnonzero(np.cumsum(open_)[: len(h)] > 0)
            if not len(at):
                continue
            doc = expand(starts)[at]
            value, other = rolling(h, window)[at], rolling(mix(h, 5), window)[at]
            place = at - starts[doc]
            keys, ties = batch.column("key").to_numpy(), batch.column("tie").to_numpy()
            _, first, group = np.unique(value, return_index=True, return_inverse=True)
            is_first = np.zeros(len(at), bool)
            is_first[first] = True
            bucket = (other % np.uint64(buckets)).astype(np.int32)
            chosen = np.flatnonzero(is_first)
            found = [[b, 0, *pack(keys, ties, doc[chosen[p]], place[chosen[p]], value[chosen[p]])] for b, p in _dealt(bucket[chosen])]
            # rows that repeat key and text are one document: a passage at the first one's own place is not another
            rest = np.flatnonzero(~is_first)
            ahead = first[group[rest]]
            rest = rest[(keys[doc[rest]] != keys[doc[ahead]]) | (ties[doc[rest]] != ties[doc[ahead]]) | (place[rest] != place[ahead])]
            if len(rest):
                found.append([int(keys[doc[rest[0]]] % buckets), 1, *pack(keys, ties, doc[rest], place[rest], None)])
            yield _rows(found)

    return released(extend)


def _repeats(groups: int):
    """Rows of passages that have an equal one before them, dealt by a hash of their document. Rows come by bucket."""

    def dealt(key: np.ndarray, tie: np.ndarray, place: np.ndarray) -> Iterator[pa.RecordBatch]:
        if not len(key):
            return
        order = np.lexsort((place, tie, key))
        key, tie, place = key[order], tie[order], place[order]
        new = np.concatenate([[True], (key[1:] != key[:-1]) | (tie[1:] != tie[:-1])])
        doc = np.cumsum(new) - 1
        group = (mix(key.view(np.uint64)) % np.uint64(groups)).astype(np.int32)
        yield _rows([[g, 0, *pack(key[new], tie[new], doc[part], place[part], None)] for g, part in _dealt(group)])

    def settle(held: list[tuple]) -> Iterator[pa.RecordBatch]:
        if not held:
            return
        h, key, tie, place = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.lexsort((place, tie, key, h))
        h, key, tie, place = h[order], key[order], tie[order], place[order]
        head = np.concatenate([[True], h[1:] != h[:-1]])
        start = np.flatnonzero(head)[np.cumsum(head) - 1]
        late = (key != key[start]) | (tie != tie[start]) | (place != place[start])
        yield from dealt(key[late], tie[late], place[late])

    def repeats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, held = None, []
        for batch in batches:
            for row in batch.to_pylist():
                if row["bucket"] != bucket:
                    yield from settle(held)
                    bucket, held = row["bucket"], []
                key, tie, place = unpack(row)
                if row["kind"] == 1:
                    yield from dealt(key, tie, place)
                else:
                    held.append((np.frombuffer(row["hashes"], np.uint64), key, tie, place))
        yield from settle(held)

    return released(repeats)


def _gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, tie, runs) of each document, from rows that come by group."""

    def settle(held: list[tuple]) -> Iterator[pa.RecordBatch]:
        if held:
            key, tie, place = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.lexsort((place, tie, key))
            yield runs(key[order], tie[order], place[order])

    group, held = None, []
    for batch in batches:
        for row in batch.to_pylist():
            if row["bucket"] != group:
                yield from settle(held)
                group, held = row["bucket"], []
            held.append(unpack(row))
    yield from settle(held)


def _keep(window: int):
    """n_words, n_removed, and the kept words joined by one blank."""

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            words, starts = split_words(batch.column("text"))
            doc = expand(starts)
            lists = batch.column("runs")
            gone = np.zeros(len(words), bool)
            if lists.null_count < len(lists):
                owner = expand(lists.offsets.to_numpy() - lists.offsets[0].as_py())[::2]
                both = lists.flatten().to_numpy()
                lo = both[0::2] + starts[owner]
                hi = lo + both[1::2] + window - 1
                size = len(words) + 1
                gone = np.cumsum(np.bincount(lo, minlength=size) - np.bincount(hi, minlength=size))[:-1] > 0
            kept = words.filter(pa.array(~gone)).to_pylist()
            at = np.concatenate([[0], np.cumsum(np.bincount(doc[~gone], minlength=batch.num_rows))]).tolist()
            texts = [" ".join(kept[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]
            removed = np.diff(starts) - np.diff(at)
            digest = [hashlib.sha256(t.encode()).hexdigest() for t in texts]
            yield pa.record_batch([batch.column("id"), pa.array(np.diff(starts)), pa.array(removed), pa.array(digest), pa.array(texts, pa.large_string()).cast(pa.string())], names=["id", "n_words", "n_removed", "kept_sha256", "kept"])

    return released(keep)


def remove_repeats(docs: DataFrame, window: int = 20, key: str = "doc_id", text: str = "text", with_text: bool = False) -> DataFrame:
    """One row per row of docs: key, n_words, n_removed, kept_sha256 and, with_text, kept_text. window: even, 2 to 40 words. Runs jobs.

    The key has to be a whole number.
    """
    if window % 2 or not 2 <= window <= 40:
        raise ValueError("window has to be even, from 2 to 40")
    spark = docs.sparkSession
    small_batches(spark)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("id"), F.coalesce(F.col(key).cast("long"), F.lit(-(2**63))).alias("key"), F.shiftright(F.xxhash64(text), 32).cast("int").alias("tie"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    probes = rows.select("key", "tie", "text").mapInArrow(_probe(window, n), ROW)
    hits = probes.repartition(n, "bucket").sortWithinPartitions("bucket", "kind").mapInArrow(released(_hits), "key long, tie int, place int")
    hits = written(hits.groupBy("key", "tie").agg(F.collect_list("place").alias("places")))
    near = may_be_in(rows.select("key", "tie", "text"), hits, "key").where("may").drop("may").join(hits, ["key", "tie"])
    passages = near.mapInArrow(_extend(window, 4 * n), ROW)
    repeats = passages.repartition(n, "bucket").sortWithinPartitions("bucket").mapInArrow(_repeats(n), ROW)
    repeats = written(repeats.repartition(n, "bucket").sortWithinPartitions("bucket").mapInArrow(released(_gather), RUNS))
    marked = may_be_in(rows, repeats, "key")
    whole = marked.where(~F.col("may")).withColumn("runs", F.lit(None).cast("array<int>")).select("id", "text", "runs")
    cut = marked.where("may").join(repeats, ["key", "tie"], "left").select("id", "text", "runs")
    out = whole.unionByName(cut).mapInArrow(_keep(window), f"id {kind}, n_words long, n_removed long, kept_sha256 string, kept string")
    return out.select(F.col("id").alias(key), "n_words", "n_removed", "kept_sha256", *([F.col("kept").alias("kept_text")] if with_text else []))
