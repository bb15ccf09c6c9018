"""N-gram Jaccard join with filters by several global token orders.

Documents are sets of distinct word n-grams. Two link when 100 * |A and B| >= percent * |A or B|. If they do, then in every
global order of tokens they share one of the first n - ceil(percent * n / 100) + 1 tokens of each (their prefixes). Candidates
must share such a token in each of three orders:

* order 1 puts rare tokens before frequent ones, by the number of documents that hold them, counted over all data up to HEAVY (copies in several tasks count each), and by hash among
  equals. Tokens that no other document has need no index entry, and a document with a whole prefix of them has no partner at all;
* orders 2 and 3 are by other hashes of the token.

Candidates of order 1 are read from an inverted index. To keep a large group of copies or near copies from growing into all its
pairs, each index entry first compares its documents to one leader only; documents that link make components. A leader has then met all
others of its entry and leaves it; the next round compares the rest, as far as they are of different components, to another one, and a last step takes all
remaining pairs of different components. Pairs inside one component need no test, so no link between components is lost. Before a pair is formed, the
sizes of both sets, their tokens that nobody shares and 128 parity bits of each bound its similarity. Every candidate is verified on the whole sets.

For the counts each token travels as 32 bits beside its bucket and a small number of its document within a slice of a task, so what is shuffled grows with the tokens alone. Tokens of one
document that cannot be told apart so are counted, and its prefix allows for them.

Documents with equal sets are one node, so copies are never expanded. Results: key, n_shingles, component (the smallest key
that links reach). Null or blank texts have an empty set, n_shingles 0, and are linked with nothing, so each is its own component. Rows
that repeat a key are separate documents. A null key takes part; a component of null keys only has a null id. Ties cannot occur: components are a function of
the data. An empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import hash_words, mix, released, rolling, slices, small_batches, split_words, written
from .components import connected_components
from .filters import semi_join
from .packed import FIELDS, NAMES, pack, unpack

#: Leader rounds at most before the step over all remaining pairs, which comes as soon as a row has COMPARED others to be compared with on average.
ROUNDS = 6
COMPARED = 12
#: Nodes that a task remembers in order to send the tokens of copies once; it forgets them all when there are more.
REMEMBERED = 500_000
#: Document frequencies are told apart up to this one. A token that so many documents of one slice hold is not counted further, so
#: a token of a third of all documents does not gather in one task.
HEAVY = 64
#: Bits of the size of a set that travels with its node; what is above counts clashes.
SIZE_BITS = 32
#: Text of one slice.
SLICE = 4 << 20
ROW = f"bucket int, slice long, kind int, {FIELDS}"


@dataclass(frozen=True)
class Likeness:
    """Which sets link: n-grams of `width` words, `percent` of the union shared."""

    width: int = 3
    percent: int = 90

    def prefix(self, n):
        """Tokens of a set of n that at least one has to be shared of, in any order."""
        return n - (self.percent * n + 99) // 100 + 1


def shingle_sets(texts: pa.Array, width: int) -> Iterator[np.ndarray]:
    """Sorted distinct 64-bit hashes of each text's n-grams; fewer words than width: of the whole sequence."""
    words, starts = split_words(texts, lower=True)
    h = hash_words(words)
    grams = rolling(h, width)
    for lo, hi in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
        if hi - lo >= width:
            yield np.unique(grams[lo : hi - width + 1])
        elif hi > lo:
            yield rolling(mix(h[lo:hi], 100 + hi - lo), hi - lo)
        else:
            yield np.zeros(0, np.uint64)


def _identity(grams: np.ndarray) -> tuple[int, int]:
    """Two independent 64-bit hashes of a set."""
    with np.errstate(over="ignore"):
        return tuple(int(mix(np.array([mix(grams, k).sum(dtype=np.uint64) + np.uint64(len(grams))]), k).view(np.int64)[0]) for k in (11, 12))


def _parity(grams: np.ndarray) -> tuple[int, int]:
    """128 bits, each telling whether an odd number of the set's tokens falls on it: as many bits as differ between two sets, so many tokens at least are in one of them only."""
    bits = np.packbits((np.bincount(((grams * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(57)).astype(np.int64), minlength=128) & 1).astype(np.uint8))
    return tuple(bits.view(np.int64).tolist())


def _sketch(like: Likeness):
    """Rows (key, node, check, n, s0, s1)."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            nodes, checks, sizes, marks = [], [], [], [[], []]
            for grams in shingle_sets(batch.column(1), like.width):
                node, check = _identity(grams) if len(grams) else (None, None)
                nodes.append(node), checks.append(check), sizes.append(len(grams))
                for to, half in zip(marks, _parity(grams), strict=True):
                    to.append(half)
            yield pa.record_batch([batch.column(0), pa.array(nodes, pa.int64()), pa.array(checks, pa.int64()), pa.array(sizes, pa.int32()), *(pa.array(m, pa.int64()) for m in marks)], names=["key", "node", "check", "n", "s0", "s1"])

    return released(sketch)


def _rows(found: list[list]) -> pa.RecordBatch:
    kinds = [pa.int32(), pa.int64(), pa.int32(), *[pa.binary()] * 5]
    columns = list(zip(*found, strict=True)) if found else [[]] * 8
    return pa.record_batch([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names=["bucket", "slice", "kind", *NAMES])


def _parts(bucket: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each bucket with the places of its entries, in their order."""
    order = np.argsort(bucket, kind="stable")
    for part in np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1):
        if len(part):
            yield int(bucket[part[0]]), part


def _entries(doc: np.ndarray, place: np.ndarray, low: np.ndarray | None, what: np.ndarray | None = None) -> list:
    """A packed row of entries in the order of their documents' numbers; what: a number for each document."""
    new = np.concatenate([[True], doc[1:] != doc[:-1]])
    own = doc[new].astype(np.int64)
    return pack(own, np.zeros(len(own), np.int32) if what is None else what, np.cumsum(new) - 1, place, low)


def _with_clashes(size: np.ndarray, doc: np.ndarray, token: np.ndarray) -> np.ndarray:
    """Sizes with, above SIZE_BITS, how many tokens of each set may not be told from another one of it, as index tokens keep fewer bits. Both may be of any number."""
    # one sort finds the few that agree in half of their bits
    half = (doc.astype(np.uint64) << np.uint64(32)) | (token & np.uint64(0xFFFFFFFF))
    line = np.sort(half)
    may = np.isin(half, line[1:][line[1:] == line[:-1]])
    told = np.unique(np.stack([doc[may].astype(np.uint64), token[may]]), axis=1)[0].astype(np.int64)
    same = np.bincount(doc[may], minlength=len(size)) - np.bincount(told, minlength=len(size))
    return size.astype(np.int64) | (same.astype(np.int64) << SIZE_BITS)


def _tokens(like: Likeness, buckets: int, groups: int):
    """Of each slice of a task: its tokens, dealt by hash (kind 1); tokens that HEAVY of its documents hold once to their bucket (kind 0), and with those documents to the slice's group (kind 3);
    and its nodes with their sizes (kind 2) to that group."""

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        number = TaskContext.get().partitionId() << 24
        for batch in slices(batches, "text", SLICE):
            nodes, sets = [], []
            for grams in shingle_sets(batch.column(0), like.width):
                node = _identity(grams)[0] if len(grams) else None
                if node is not None and node not in seen:
                    seen.add(node)
                    nodes.append(node), sets.append(grams)
            if len(seen) > REMEMBERED:
                seen.clear()
            if not nodes:
                continue
            size = np.array([len(g) for g in sets], np.int32)
            flat, doc = np.concatenate(sets), np.repeat(np.arange(len(sets)), size)
            bucket = ((flat >> np.uint64(32)) % np.uint64(buckets)).astype(np.int32)
            low = flat.astype(np.uint32)
            token = (bucket.astype(np.uint64) << np.uint64(32)) | low
            values, count = np.unique(token, return_counts=True)
            heavy = values[count >= HEAVY]
            is_heavy = np.isin(token, heavy) if len(heavy) else np.zeros(len(token), bool)
            none = np.zeros(1, np.int64)
            found = [[int(b), number, 0, *_entries(np.zeros(len(p), np.int64), np.zeros(len(p), np.int64), heavy[p].astype(np.uint32))] for b, p in _parts((heavy >> np.uint64(32)).astype(np.int32))]
            light = np.flatnonzero(~is_heavy)
            found += [[b, number, 1, *_entries(doc[light[p]], np.zeros(len(p), np.int64), low[light[p]])] for b, p in _parts(bucket[light])]
            group = _group(number, groups)
            every = np.arange(len(nodes))
            # the nodes travel as the hashes of entries, one for each document, and their sizes after them
            found.append([group, number, 2, *_entries(every, none.repeat(len(nodes)), np.concatenate([np.array(nodes, np.int64), _with_clashes(size, doc, token)]))])
            at = np.flatnonzero(is_heavy)
            if len(at):
                found.append([group, number, 3, *_entries(doc[at], np.full(len(at), HEAVY), token[at])])
            yield _rows(found)
            number += 1

    return released(tokens)


def _group(number: int, groups: int) -> int:
    """Partition in which the documents of a slice are put together again."""
    return ((number >> 24) + (number & 0xFFFFFF) * 7919) % groups


def _shared(groups: int):
    """Of the tokens of a bucket those that several documents hold, with how many (at most HEAVY), back to the groups of their slices. Rows come by bucket."""

    def settle(bucket: int, heavy: list, held: list[tuple]) -> Iterator[pa.RecordBatch]:
        if not held:
            return
        number = np.repeat(np.arange(len(held)), [len(low) for _, low, _ in held])
        low, doc = np.concatenate([x for _, x, _ in held]), np.concatenate([x for _, _, x in held])
        _, of, count = np.unique(low, return_inverse=True, return_counts=True)
        level = np.minimum(count[of], HEAVY)
        if heavy:
            level[np.isin(low, np.concatenate(heavy))] = HEAVY
        # in the order of slices and documents still
        for part in np.split(np.flatnonzero(level > 1), np.flatnonzero(np.diff(number[level > 1])) + 1):
            if len(part):
                at = held[number[part[0]]][0]
                part = part[np.lexsort((level[part], doc[part]))]  # packed places must not fall within a document
                # the bucket, the upper half of its tokens, is the last number
                yield _rows([[_group(at, groups), at, 4, *_entries(doc[part], level[part], np.append(low[part], np.uint32(bucket)))]])

    def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, heavy, held = -1, [], []
        for batch in batches:
            passed = pc.greater_equal(batch.column("kind"), 2)
            if pc.any(passed).as_py():
                yield batch.filter(passed)
            for row in batch.filter(pc.invert(passed)).to_pylist():
                if row["bucket"] != now:
                    yield from settle(now, heavy, held)
                    now, heavy, held = row["bucket"], [], []
                low = np.frombuffer(row["hashes"], np.uint32)
                if row["kind"] == 0:
                    heavy.append(low)
                else:
                    held.append((row["slice"], low, unpack(row)[0]))
        yield from settle(now, heavy, held)

    return released(shared)


def _prefixes(like: Likeness):
    """(token, node, n, alone): the prefix tokens of order 1 that other documents hold too; alone: tokens of the node's own. Rows come by slice and kind."""

    def settle(nodes: np.ndarray, size: np.ndarray, held: list[tuple]) -> Iterator[pa.RecordBatch]:
        if not held:
            return
        doc, level, token = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.lexsort((token, level, doc))
        doc, level, token = doc[order], level[order], token[order]
        once = np.concatenate([[True], (token[1:] != token[:-1]) | (doc[1:] != doc[:-1])])
        doc, token = doc[once], token[once]
        first = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
        count = np.diff(np.append(first, len(doc)))
        place = np.arange(len(doc)) - np.repeat(first, count)
        # a token that stands for several of the set counts as shared, so that a prefix is never too short
        n = size[doc] & ((1 << SIZE_BITS) - 1)
        alone = np.maximum(n - (size[doc] >> SIZE_BITS) - np.repeat(count, count), 0)
        keep = place + alone < like.prefix(n)
        yield pa.record_batch([pa.array(token[keep].view(np.int64)), pa.array(nodes[doc[keep]]), pa.array(n[keep].astype(np.int32)), pa.array(alone[keep])], names=["token", "node", "n", "alone"])

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, nodes, size, held = None, None, None, []
        for batch in batches:
            for row in batch.to_pylist():
                if row["slice"] != now:
                    yield from settle(nodes, size, held)
                    now, held = row["slice"], []
                if row["kind"] == 2:  # comes first
                    nodes, size = np.split(np.frombuffer(row["hashes"], np.int64), 2)
                    continue
                doc, _, level = unpack(row)
                if row["kind"] == 3:
                    token = np.frombuffer(row["hashes"], np.uint64)
                else:
                    low = np.frombuffer(row["hashes"], np.uint32)
                    token = low[:-1].astype(np.uint64) | (np.uint64(low[-1]) << np.uint64(32))
                held.append((doc, level, token))
        yield from settle(nodes, size, held)

    return released(prefixes)


def _sets(like: Likeness):
    """Rows (node, n, grams, second, third): whole sets, and their prefixes in orders 2 and 3."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            nodes, sizes, grams, second, third = [], [], [], [], []
            for g in shingle_sets(batch.column(1), like.width):
                if not len(g):
                    continue
                p = like.prefix(len(g))
                nodes.append(_identity(g)[0]), sizes.append(len(g)), grams.append(g.view(np.int64))
                for k, to in ((2, second), (3, third)):
                    m = mix(g, k)
                    to.append((np.partition(m, p - 1)[:p] if p < len(m) else m).astype(np.uint32).view(np.int32))
            longs, ints = pa.list_(pa.int64()), pa.list_(pa.int32())
            yield pa.record_batch([pa.array(nodes, pa.int64()), pa.array(sizes, pa.int32()), pa.array(grams, longs), pa.array(second, ints), pa.array(third, ints)], names=["node", "n", "grams", "second", "third"])

    return released(sets)


def _near(like: Likeness, a: str, b: str) -> Column:
    """Sets can link by their sizes, by how many tokens they have that no other node holds, and by how many are in one of them only. a, b: endings of the columns' names."""
    both = F.col(f"n{a}") + F.col(f"n{b}")
    apart = F.bit_count(F.col(f"s0{a}").bitwiseXOR(F.col(f"s0{b}"))) + F.bit_count(F.col(f"s1{a}").bitwiseXOR(F.col(f"s1{b}")))
    most = F.least(F.col(f"n{a}") - F.col(f"alone{a}"), F.col(f"n{b}") - F.col(f"alone{b}"), F.floor((both - apart) / 2))
    return most * 100 >= (both - most) * like.percent


def _index(rows: DataFrame, like: Likeness) -> DataFrame:
    """(token, node, n, alone) for the prefix tokens of order 1 that more than one node has."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # entries go to the buckets of their tokens, and what is shared comes back by slice
    tokens = rows.select("text").mapInArrow(_tokens(like, 4 * n, n), ROW)
    shared = tokens.repartition(n, "bucket").sortWithinPartitions("bucket", "kind", "slice").mapInArrow(_shared(n), ROW)
    index = shared.repartition(n, "bucket").sortWithinPartitions("slice", "kind").mapInArrow(_prefixes(like), "token long, node long, n int, alone long")
    # a node that several tasks met has a row from each
    index = written(index.groupBy("token", "node").agg(F.min("n").alias("n"), F.min("alone").alias("alone")))
    crowded = index.groupBy("token").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low <> high").select("token")
    return index.join(crowded, "token", "left_semi")


def _verified(pairs: DataFrame, sets: DataFrame, like: Likeness) -> DataFrame:
    """The pairs (a, b) that share prefix tokens in orders 2 and 3 too and link by their whole sets."""
    side = lambda end, *more: sets.select(F.col("node").alias(end), *(F.col(c).alias(f"{c}_{end}") for c in more))
    few = pairs.join(side("a", "second", "third"), "a").join(side("b", "second", "third"), "b")
    few = few.where(F.arrays_overlap("second_a", "second_b") & F.arrays_overlap("third_a", "third_b")).select("a", "b")
    whole = few.join(side("a", "grams"), "a").join(side("b", "grams"), "b")
    inter = F.size(F.array_intersect("grams_a", "grams_b"))
    rows = whole.select("a", "b", inter.alias("inter"), (F.size("grams_a") + F.size("grams_b")).alias("both"))
    return rows.where(F.col("inter") * 100 >= (F.col("both") - F.col("inter")) * like.percent).select("a", "b")


#: What an index row knows of its node.
KNOWN = ("n", "alone", "s0", "s1", "comp")


def _components(index: DataFrame, sets_of: Callable[[DataFrame], DataFrame], like: Likeness) -> DataFrame | None:
    """(node, comp) of the nodes that have a link; None if none has. index: token, node and KNOWN, where comp is the node."""
    comps: DataFrame | None = None
    rows = index
    for turn in range(ROUNDS + 1):
        # the first leader has the fewest tokens of its own, later ones are drawn by a hash
        order = F.struct(F.col("alone"), F.col("node")) if not turn else F.struct(F.xxhash64("node", F.lit(turn)), F.col("node"))
        groups = rows.groupBy("token").agg(F.min(F.struct(order.alias("order"), F.struct("node", *KNOWN).alias("it"))).getField("it").alias("leader"), F.count("*").alias("size"), F.min("comp").alias("low"), F.max("comp").alias("high"))
        lead = groups.where("low <> high").select("token", "size", F.col("leader.node").alias("a"), *(F.col(f"leader.{c}").alias(f"{c}_a") for c in KNOWN))
        minor = rows.join(lead, "token").where("node <> a")
        last = False
        if turn:
            work = minor.agg(F.count("*").alias("rows"), F.sum("size").alias("pairs")).first()
            if not work["rows"]:
                break
            last = turn == ROUNDS or work["pairs"] <= COMPARED * work["rows"]
        if last:
            own = rows.join(lead.select("token"), "token", "left_semi")
            other = own.select("token", F.col("node").alias("a"), *(F.col(c).alias(f"{c}_a") for c in KNOWN))
            pairs = own.join(other, "token").where("node < a")
        else:
            pairs = minor
            rest = written(minor.select("token", "node", *KNOWN))
        pairs = pairs.where((F.col("comp") != F.col("comp_a")) & _near(like, "", "_a")).select(F.least("a", "node").alias("a"), F.greatest("a", "node").alias("b"))
        pairs = written(pairs.distinct())
        found = written(_verified(pairs, sets_of(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()), like))
        if not found.isEmpty():
            comps = written(_joined(comps, found))
        if last:
            break
        # all pairs with the leader of a token are settled, so it takes no part in the token's next rounds
        rows = rest if comps is None else rest.drop("comp").join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    return comps


def _joined(comps: DataFrame | None, links: DataFrame) -> DataFrame:
    """(node, comp) after new links: components as they were are the nodes between which the new ones are looked for."""
    if comps is None:
        return connected_components(links)
    own = links.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    every = own.withColumn("comp", F.col("node")).union(comps).groupBy("node").agg(F.min("comp").alias("comp"))
    side = lambda end: every.select(F.col("node").alias(end), F.col("comp").alias(f"comp_{end}"))
    between = written(links.join(side("a"), "a").join(side("b"), "b").select(F.col("comp_a").alias("a"), F.col("comp_b").alias("b")).where("a <> b").distinct())
    top = connected_components(between).select(F.col("node").alias("comp"), F.col("comp").alias("top"))
    return every.join(top, "comp", "left").select("node", F.coalesce("top", "comp").alias("comp"))


def jaccard_components(docs: DataFrame, like: Likeness = Likeness(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of docs: key, n_shingles, component. Runs jobs; intermediate tables go to the shared folder."""
    small_batches(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    sketch = written(rows.mapInArrow(_sketch(like), f"key {kind}, node long, check long, n int, s0 long, s1 long"))
    nodes = sketch.where("n > 0").groupBy("node").agg(F.min("key").alias("least"), F.min("check").alias("low"), F.max("check").alias("high"), F.min("s0").alias("s0"), F.min("s1").alias("s1"))
    # two different sets with one 64-bit hash must not become one node
    nodes = written(nodes.where(F.when(F.col("low") != F.col("high"), F.raise_error(F.lit("two sets have one hash"))).otherwise(F.lit(True)).cast("boolean")).drop("low", "high"))
    index = _index(rows, like)
    unkeyed = rows.where("key is null")  # cannot be asked for by key

    def sets_of(wanted: DataFrame) -> DataFrame:
        """The sets of some nodes, from one document of each."""
        keys = wanted.join(nodes, "node").where("least is not null").select(F.col("least").alias("key")).distinct()
        texts = semi_join(rows, written(keys), "key").unionByName(unkeyed)
        return texts.mapInArrow(_sets(like), "node long, n int, grams array<long>, second array<int>, third array<int>").dropDuplicates(["node"])

    comps = _components(written(index.join(nodes.drop("least"), "node").withColumn("comp", F.col("node"))), sets_of, like)
    out = sketch.select("key", "node", "n")
    if comps is None:
        joined = out.join(nodes.select("node", F.col("least").alias("component")), "node", "left")
    else:
        linked = nodes.select("node", "least").join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
        least = linked.groupBy("comp").agg(F.min("least").alias("component"))
        joined = out.join(linked.select("node", "comp").join(least, "comp").select("node", "component"), "node", "left")
    own = F.when(F.col("n") == 0, F.col("key")).otherwise(F.col("component"))
    return joined.select(F.col("key").alias(key), F.col("n").cast("long").alias("n_shingles"), own.alias("component_id"))
