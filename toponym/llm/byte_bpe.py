"""Byte-level BPE encoding and decoding with ranked merges folded by Spark's higher-order functions.

`bpe_ids` is the merge itself: a Column that folds over the bytes of a word. Its state is an array of binary pieces; each step joins the adjacent pair
whose concatenation has the lowest rank in a map, which is cut into buckets so that a look-up compares a few keys.
`decoded` concatenates the binary pieces of ids by a literal vocabulary.

`encode` applies it to a table and folds each distinct word once for every GROUP input partitions, however often and in however many texts it occurs:

* texts are cut into chunks of about `chunk_bytes`; of a chunk go out its distinct words, dealt by their hash, and its texts as packed places in the list of those words;
* the words of a bucket meet, equal ones become one row, Spark folds it, and its ids go back to the chunks that hold the word;
* a chunk's texts are put together from the ids of its words, and decoded from the pieces of those ids.

No more than a chunk, or the words of one bucket (their number falls with spark.sql.shuffle.partitions), is held by a task.

A fold takes time that grows with the square of a word's length. Words of more than LONG_WORD bytes (a pre-token has no blanks inside, so these are runs of letters,
digits or signs such as base64) are therefore merged by a heap of their pairs, in n log n, with the same ranks and the same order of merges.

Null text counts as empty (no ids, empty bytes). Ties: of pairs with equal rank the leftmost merges first. Repeated rows, and rows with a null or repeated key, are encoded each
by itself. Other columns of the input are not read, so clashing names cannot matter; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import give_back, released, slices, small_batches

#: Buckets of the literal rank map; a power of two.
BUCKETS = 1 << 16
#: Text that is cut into words and put together at a time, and text of one chunk.
SLICE = 1 << 20
CHUNK_BYTES = 32 << 20
#: Longer words are merged by a heap.
LONG_WORD = 256
#: Input partitions whose equal words are folded once.
GROUP = 4096
#: Words of slices that wait to be merged with the other words of their chunk, at least.
MERGED = 1 << 17
#: References to words that are packed at a time.
PACKED = 1 << 20
#: A rank above any other, for pairs that do not merge.
NEVER = 2**31 - 1
#: White space before a blank: then the blank does not begin a match of the usual patterns.
_RUN = "[\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000] "


def read_ranks(path: str) -> dict[bytes, int]:
    """The ranks of a file with a base64 token and its rank on each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def _rank_json(ranks: dict[bytes, int]) -> str:
    buckets: list[dict[str, int]] = [{} for _ in range(BUCKETS)]
    for token, rank in ranks.items():
        buckets[zlib.crc32(token) & (BUCKETS - 1)][token.hex().upper()] = rank
    return json.dumps(buckets)


def rank_map(ranks: dict[bytes, int]) -> Column:
    """array<map<string,int>>: the ranks by the hexadecimal form of their tokens, in the bucket that CRC-32 of the token gives."""
    return F.from_json(F.lit(_rank_json(ranks)), "array<map<string,int>>")


def rank_table(spark: SparkSession, ranks: dict[bytes, int]) -> Column:
    """`rank_map` as a scalar subquery over one row: a literal is written out in each text of a plan, several times for each step of the driver."""
    return spark.createDataFrame(pa.table({"ranks": [_rank_json(ranks)]})).select(F.from_json("ranks", "array<map<string,int>>")).scalar()


def vocabulary(ranks: dict[bytes, int]) -> Column:
    """array<binary>: the token of each rank."""
    return F.from_json(F.lit(json.dumps([base64.b64encode(t).decode() for t in tokens_of(ranks)])), "array<binary>")


def tokens_of(ranks: dict[bytes, int]) -> list[bytes]:
    """The token of each rank; empty where there is none."""
    tokens = [b""] * (max(ranks.values(), default=-1) + 1)
    for token, rank in ranks.items():
        tokens[rank] = token
    return tokens


def _let(value: Column, body) -> Column:
    """body(value), with value computed once."""
    return F.transform(F.array(value), body)[0]


def bpe_ids(word: Column, ranks: Column) -> Column:
    """The ids of a binary word: its own if it is a token, otherwise by merging from single bytes."""
    nothing = F.array().cast("array<int>")

    def look_up(table: Column):
        return lambda piece: F.element_at(F.get(table, F.crc32(piece).bitwiseAND(BUCKETS - 1).cast("int")), F.hex(piece))

    def merged(rank) -> Column:
        def pair(a: Column, b: Column) -> Column:
            return _let(F.concat(a, b), lambda both: F.coalesce(rank(both), F.lit(NEVER)))

        def step(acc: Column, _: Column) -> Column:
            pieces, pairs = acc["pieces"], acc["pairs"]

            def join(at: Column) -> Column:
                def put(both: Column) -> Column:
                    before = F.when(at > 1, F.array(pair(F.get(pieces, at - 2), both))).otherwise(nothing)
                    after = F.when(at < F.size(pairs), F.array(pair(both, F.get(pieces, at + 1)))).otherwise(nothing)
                    return F.struct(
                        F.concat(F.slice(pieces, 1, at - 1), F.array(both), F.slice(pieces, at + 2, F.size(pieces))).alias("pieces"),
                        F.concat(F.slice(pairs, 1, F.greatest(at - 2, F.lit(0))), before, after, F.slice(pairs, at + 2, F.size(pieces))).alias("pairs"),
                    )

                return _let(F.concat(F.get(pieces, at - 1), F.get(pieces, at)), put)

            return _let(F.array_min(pairs), lambda best: F.when(best < NEVER, _let(F.array_position(pairs, best).cast("int"), join)).otherwise(acc))

        n = F.octet_length(word)
        places = F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1)))
        pieces = F.transform(F.sequence(F.lit(1), n), lambda i: F.substring(word, i, F.lit(1)))
        pairs = F.when(n > 1, F.transform(places, lambda i: F.coalesce(rank(F.substring(word, i, F.lit(2))), F.lit(NEVER)))).otherwise(nothing)
        folded = F.aggregate(places, F.struct(pieces.alias("pieces"), pairs.alias("pairs")), step)
        return F.transform(folded["pieces"], rank)

    def ids(table: Column) -> Column:
        rank = look_up(table)
        return _let(rank(word), lambda own: F.when(F.octet_length(word) == 0, nothing).when(own.isNotNull(), F.array(own)).otherwise(merged(rank)))

    return _let(ranks, ids)


def decoded(ids: Column, vocab: Column) -> Column:
    """The bytes of ids: their binary pieces put together."""
    return _let(vocab, lambda v: F.aggregate(ids, F.lit(b""), lambda data, i: F.concat(data, F.get(v, i))))


def heap_ids(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of a word by the same merges as `bpe_ids`, for long words."""
    own = ranks.get(word)
    if own is not None or not word:
        return [own] if word else []
    end = [i + 1 for i in range(len(word))]  # of the piece that starts at i; 0: no piece starts there
    back = [i - 1 for i in range(len(word) + 1)]  # start of the piece before the one at i

    def rank(i: int) -> int | None:
        return ranks.get(word[i : end[end[i]]]) if end[i] < len(word) else None

    waiting = [(r, i, i + 2) for i in range(len(word) - 1) if (r := rank(i)) is not None]
    heapq.heapify(waiting)
    while waiting:
        _, i, past = heapq.heappop(waiting)
        j = end[i]
        # a pair that has changed meanwhile has an entry of its own
        if not j or j >= len(word) or end[j] != past:
            continue
        end[i], end[j] = past, 0
        back[past] = i
        for k in (back[i], i):
            if k >= 0 and (r := rank(k)) is not None:
                heapq.heappush(waiting, (r, k, end[end[k]]))
    out, i = [], 0
    while i < len(word):
        out.append(ranks[word[i : end[i]]])
        i = end[i]
    return out


def _packed(a: np.ndarray) -> bytes:
    """Whole numbers as compressed byte planes, after their number and width."""
    planes = a.view(np.uint8).reshape(len(a), a.itemsize).T.tobytes()
    return np.array([len(a), a.itemsize], np.int64).tobytes() + pa.Codec("zstd", 3).compress(planes, asbytes=True)


def _unpacked(data: bytes, kind: type) -> np.ndarray:
    n, size = np.frombuffer(data, np.int64, 2).tolist()
    if not n:
        return np.zeros(0, kind)
    planes = np.frombuffer(pa.Codec("zstd").decompress(data[16:], n * size, asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(size, n).T).view(kind).ravel()


def _gathered(starts: np.ndarray, counts: np.ndarray, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the entries of the chosen lists, one list after another, and where each list begins (one more entry than lists)."""
    own = counts[chosen]
    begin = np.concatenate([[0], np.cumsum(own)])
    return np.repeat(starts[chosen] - begin[:-1], own) + np.arange(begin[-1]), begin


def pre_tokens(texts: pa.Array, find, at_blanks: bool) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The distinct matches of the texts, the matches as places among those, and where each text's matches begin.

    at_blanks: every blank after something that is no white space begins a match, and matches before it do not depend on it. Texts are then cut at blanks, and
    matches are looked for once in each distinct part.
    """
    texts = texts.cast(pa.large_string())
    whole = np.ones(len(texts), bool) if not at_blanks else pc.match_substring_regex(texts, _RUN).to_numpy(zero_copy_only=False)
    cut = pc.split_pattern(pc.if_else(pa.array(whole), "", texts), " ")
    starts = cut.offsets.to_numpy() - cut.offsets[0].as_py()
    coded = pc.dictionary_encode(cut.flatten())
    segments = coded.indices.to_numpy().astype(np.int64)
    found = [find(" " + part) for part in coded.dictionary.to_pylist()]
    # the first part of a text has no blank before it; a text that is not cut is one part
    first = starts[:-1]
    own = texts.to_pylist() if whole.all() else [t if w else t.partition(" ")[0] for t, w in zip(texts.to_pylist(), whole.tolist(), strict=True)]
    known: dict[str, int] = {}
    segments[first] = [known.setdefault(part, len(known)) + len(found) for part in own]
    found += map(find, known)
    size = np.array([len(x) for x in found], np.int64)
    flat = pc.dictionary_encode(pa.array([w for x in found for w in x], pa.large_string()))
    at, begin = _gathered(np.cumsum(size) - size, size, segments)
    return flat.dictionary, flat.indices.to_numpy()[at], begin[starts]


def _rows(rows: list[tuple], key_type: pa.DataType) -> pa.RecordBatch:
    kinds = [pa.int32(), pa.int64(), pa.int32(), pa.list_(key_type), pa.binary(), pa.binary()]
    columns = list(zip(*rows, strict=True)) if rows else [()] * 6
    return pa.record_batch([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names=["part", "chunk", "kind", "keys", "a", "b"])


def _split(pattern: str, at_blanks: bool, chunk_bytes: int, parts: int, key_type: pa.DataType):
    """Rows of kind 0 with the distinct words of a chunk, dealt by their hash, and of kind 1 with its texts as places among those words."""

    def merged(words: pa.Array, new: list[list]) -> pa.Array:
        """The distinct words, with those of the new slices. The slices' codes become places among them."""
        both = pc.dictionary_encode(pa.concat_arrays([words, *(x[1] for x in new)]))
        place, lo = both.indices.to_numpy(), len(words)
        for x in new:
            n = len(x[1])
            x[1:3] = None, place[lo : lo + n][x[2]]
            lo += n
        return both.dictionary

    def chunk_rows(number: int, words: pa.Array, held: list[list]) -> Iterator[pa.RecordBatch]:
        """held: keys, nothing, words of the texts as places, and their number in each text, by slice: an array over a whole chunk would take most of what a task needs."""
        often = np.zeros(len(words), np.int64)
        for x in held:
            often += np.bincount(x[2], minlength=len(words))
        # frequent words get small numbers, which pack well
        order = np.argsort(-often, kind="stable")
        number_of = np.empty(len(words), np.int32)
        number_of[order] = np.arange(len(words))
        words = words.take(pa.array(order)).cast(pa.large_binary())
        dealt = np.array([zlib.crc32(w) % parts for w in words.to_pylist()], np.int32)
        by_part = np.argsort(dealt, kind="stable")
        for at in np.split(by_part, np.flatnonzero(np.diff(dealt[by_part])) + 1):
            if len(at):
                own = words.take(pa.array(at)).to_pylist()
                sizes = _packed(np.array([len(w) for w in own], np.int32))
                joined = b"".join(own)
                blob = np.array([len(sizes), len(joined)], np.int64).tobytes() + sizes + pa.Codec("zstd", 3).compress(joined, asbytes=True)
                yield _rows([(int(dealt[at[0]]), number, 0, None, _packed(at.astype(np.int32)), blob)], key_type)
        for keys, _, codes, sizes in held:
            yield _rows([(_target(number, parts), number, 1, keys.to_pylist(), _packed(sizes.astype(np.int64)), _packed(number_of[codes]))], key_type)

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = regex.compile(pattern).findall
        none = pa.array([], pa.large_string())
        number, words, held, size, new = TaskContext.get().partitionId() << 32, none, [], 0, 0
        for batch in slices(batches, "text", min(SLICE, chunk_bytes)):
            own, codes, starts = pre_tokens(batch.column(1), find, at_blanks)
            held.append([batch.column(0), own, codes, np.diff(starts)])
            size += batch.column(1).nbytes
            new += len(own)
            # at doubled sizes, so that all merges together take a few times the last one
            if new >= max(len(words), MERGED) or size >= chunk_bytes:
                words, new = merged(words, [x for x in held if x[1] is not None]), 0
            give_back()  # of the parts and tables of this slice, which are more than all that is held
            if size >= chunk_bytes:
                yield from chunk_rows(number, words, held)
                number, words, held, size = number + 1, none, [], 0
        if held:
            words = merged(words, [x for x in held if x[1] is not None])
            give_back()
            yield from chunk_rows(number, words, held)

    return released(split)


def _words_of(blob: bytes) -> list[bytes]:
    n_sizes, n_data = np.frombuffer(blob, np.int64, 2).tolist()
    sizes = _unpacked(blob[16 : 16 + n_sizes], np.int32)
    data = pa.Codec("zstd").decompress(blob[16 + n_sizes :], n_data, asbytes=True) if n_data else b""
    ends = np.cumsum(sizes)
    return [data[a:b] for a, b in zip((ends - sizes).tolist(), ends.tolist(), strict=True)]


_COLUMNS = "part int, chunk long, kind int, keys array<{kind}>, a binary, b binary"


def _distinct(shared, key_type: pa.DataType):
    """One row for each distinct word of a bucket with the chunks that hold it and its place there; ids of long words. Rows of texts pass. Rows come by part, kind and chunk."""
    names = ["part", "chunk", "kind", "keys", "a", "b", "word", "known", "chunks", "places"]

    def whole(first: list[pa.Array], more: list[pa.Array]) -> pa.RecordBatch:
        return pa.record_batch([*first, *more], names=names)

    def settle(held: list[tuple]) -> Iterator[pa.RecordBatch]:
        if not held:
            return
        chunk = np.repeat(np.array([c for c, _, _ in held], np.int64), [len(w) for _, _, w in held])
        place = np.concatenate([p for _, p, _ in held])
        coded = pc.dictionary_encode(pa.array([w for _, _, words in held for w in words], pa.large_binary()))
        order = np.argsort(coded.indices.to_numpy(), kind="stable")
        chunk, place = chunk[order], place[order]
        ends = np.cumsum(np.bincount(coded.indices.to_numpy(), minlength=len(coded.dictionary)))
        words = coded.dictionary.cast(pa.binary())
        for lo in range(0, len(words), 5000):
            hi = min(lo + 5000, len(words))
            a, b = (int(ends[lo - 1]) if lo else 0), int(ends[hi - 1])
            offsets = pa.array(np.concatenate([[a], ends[lo:hi]]) - a, pa.int32())
            own = words[lo:hi]
            known = pa.nulls(hi - lo, pa.list_(pa.int32()))
            long = pc.greater(pc.binary_length(own), LONG_WORD)
            if pc.any(long).as_py():
                known = pa.array([heap_ids(w, shared.value) if x else None for w, x in zip(own.to_pylist(), long.to_pylist(), strict=True)], pa.list_(pa.int32()))
                own = pc.if_else(long, pa.scalar(b"", pa.binary()), own)
            zero = np.zeros(hi - lo, np.int32)
            fixed = [pa.array(zero), pa.array(zero, pa.int64()), pa.array(zero), *(pa.nulls(hi - lo, k) for k in (pa.list_(key_type), pa.binary(), pa.binary()))]
            yield whole(fixed, [own, known, pa.ListArray.from_arrays(offsets, pa.array(chunk[a:b])), pa.ListArray.from_arrays(offsets, pa.array(place[a:b], pa.int32()))])

    def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            kind = batch.column("kind").to_numpy()
            for lo, hi in _runs(kind):
                part = batch.slice(lo, hi - lo)
                if kind[lo]:
                    n = hi - lo
                    yield whole(part.columns, [pa.nulls(n, pa.binary()), pa.nulls(n, pa.list_(pa.int32())), pa.nulls(n, pa.list_(pa.int64())), pa.nulls(n, pa.list_(pa.int32()))])
                    continue
                for row in part.to_pylist():
                    group = row["part"], (row["chunk"] >> 32) // GROUP
                    if group != now:
                        yield from settle(held)
                        now, held = group, []
                    held.append((row["chunk"], _unpacked(row["a"], np.int32), _words_of(row["b"])))
        yield from settle(held)

    return released(distinct)


def _runs(values: np.ndarray) -> Iterator[tuple[int, int]]:
    """Where runs of equal values begin and end."""
    cuts = (np.flatnonzero(np.diff(values)) + 1).tolist()
    return zip([0, *cuts], [*cuts, len(values)], strict=True) if len(values) else iter(())


def _back(parts: int, key_type: pa.DataType):
    """The ids of words, packed for each chunk that holds them. Rows of texts pass."""

    def settle(held: list[tuple]) -> Iterator[pa.RecordBatch]:
        if not held:
            return
        sizes, ids, counts, chunk, place = (np.concatenate(x) for x in zip(*held, strict=True))
        starts = np.cumsum(sizes) - sizes
        word = np.repeat(np.arange(len(sizes)), counts)
        order = np.argsort(chunk, kind="stable")
        rows = []
        for lo, hi in _runs(chunk[order]):
            own = order[lo:hi]
            at, _ = _gathered(starts, sizes, word[own])
            number = int(chunk[own[0]])
            places, lengths = _packed(place[own]), _packed(sizes[word[own]].astype(np.int32))
            rows.append((_target(number, parts), number, 0, None, np.int64(len(places)).tobytes() + places + lengths, _packed(ids[at])))
        yield _rows(rows, key_type)

    def back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            kind = batch.column("kind").to_numpy()
            for lo, hi in _runs(kind):
                part = batch.slice(lo, hi - lo)
                if kind[lo]:
                    yield part.select(["part", "chunk", "kind", "keys", "a", "b"])
                    continue
                # copies, as the batch's own memory goes back
                lists = part.column("ids"), part.column("chunks"), part.column("places")
                length = [pc.list_value_length(x).to_numpy(zero_copy_only=False).astype(np.int64) for x in lists[:2]]
                ids, chunk, place = (x.flatten().to_numpy(zero_copy_only=False).copy() for x in lists)
                held.append((length[0], ids, length[1], chunk, place))
                size += len(chunk)
                if size >= PACKED:
                    yield from settle(held)
                    held, size = [], 0
        yield from settle(held)

    return released(back)


def _target(chunk: int, parts: int) -> int:
    """Partition in which a chunk is put together: consecutive chunks of consecutive tasks in different ones."""
    return ((chunk >> 32) + (chunk & 0xFFFFFFFF) * 7919) % parts


def _assemble(tokens: list[bytes], whole: bool):
    """Texts put together from the ids of the words of their chunk. Rows come by chunk and kind."""

    def table(held: list[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        place, sizes, ids = (np.concatenate(x) for x in zip(*held, strict=True))
        starts, counts = np.zeros(len(place), np.int64), np.zeros(len(place), np.int64)
        starts[place], counts[place] = np.cumsum(sizes) - sizes, sizes
        return starts, counts, ids

    def texts(row: dict, starts: np.ndarray, counts: np.ndarray, ids: np.ndarray, numbers: pa.Array, pieces: pa.Array, key_type: pa.DataType) -> pa.RecordBatch:
        codes = _unpacked(row["b"], np.int32)
        ends = np.concatenate([[0], np.cumsum(_unpacked(row["a"], np.int64))])
        at, begin = _gathered(starts, counts, codes)
        own, cut = ids[at], begin[ends]
        n = np.diff(cut)
        digests = []
        for table, gap in ((numbers, 1), (pieces, 0)):
            joined = table.take(pa.array(own))
            offsets = np.frombuffer(joined.buffers()[1], np.int64)[joined.offset : joined.offset + len(joined) + 1]
            data, edges = memoryview(joined.buffers()[2] or b""), offsets[cut].tolist()
            digests.append([hashlib.sha256(data[a : max(a, b - gap)]).hexdigest() for a, b in zip(edges[:-1], edges[1:], strict=True)])
            if whole and not gap:
                decoded = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(n), [None, pa.py_buffer(np.array(edges, np.int64)), joined.buffers()[2] or pa.py_buffer(b"")]).cast(pa.binary())
        columns = [pa.array(row["keys"], key_type), pa.array(n), *map(pa.array, digests)]
        if whole:
            columns += [pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(own, pa.int32())), decoded]
        return pa.record_batch(columns, names=["key", "n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded"][: len(columns)])

    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers, pieces = pa.array([b"%d " % i for i in range(len(tokens))], pa.large_binary()), pa.array(tokens, pa.large_binary())
        now, held, made = None, [], None
        for batch in batches:
            key_type = batch.schema.field("keys").type.value_type
            for row in batch.to_pylist():
                if row["chunk"] != now:
                    now, held, made = row["chunk"], [], None
                if not row["kind"]:
                    past = 8 + int.from_bytes(row["a"][:8], "little")
                    held.append((_unpacked(row["a"][8:past], np.int32), _unpacked(row["a"][past:], np.int32), _unpacked(row["b"], np.int32)))
                    continue
                if made is None:
                    made, held = table(held) if held else (np.zeros(0, np.int64),) * 3, []
                yield texts(row, *made, numbers, pieces, key_type)

    return released(assemble)


def encode(docs: DataFrame, ranks: dict[bytes, int], pattern: str, key: str = "doc_id", text: str = "text", whole: bool = False, chunk_bytes: int = CHUNK_BYTES, at_blanks: bool = False) -> DataFrame:
    """One row per row of docs: key, n_tokens, ids_sha256 (of decimal ids joined by a blank), decoded_sha256 (of the decoded bytes).

    Texts are split by `pattern`, each match is merged separately, and there are no special tokens. whole: also ids
    (array<int>) and decoded (binary). at_blanks: see `pre_tokens`; it holds for the usual patterns, and saves time. All single bytes have to have ranks.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    if any(bytes([b]) not in ranks for b in range(256)):
        raise ValueError("a byte has no rank")
    spark = docs.sparkSession
    small_batches(spark)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    kind = docs.schema[key].dataType
    columns, key_type = _COLUMNS.format(kind=kind.simpleString()), to_arrow_type(kind)
    rows = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    parts = rows.mapInArrow(_split(pattern, at_blanks, chunk_bytes, n, key_type), columns)
    shared = spark.sparkContext.broadcast(ranks)  # as large as the vocabulary
    words = parts.repartitionById(n, F.col("part")).sortWithinPartitions("part", "kind", "chunk").mapInArrow(_distinct(shared, key_type), columns + ", word binary, known array<int>, chunks array<long>, places array<int>")
    # Spark refuses subqueries within higher-order functions as they are written; the two projections become one, so that no row carries the table
    coded = words.withColumn("ranks", rank_table(spark, ranks)).select("part", "chunk", "kind", "keys", "a", "b", F.coalesce("known", F.when(F.col("word").isNotNull(), bpe_ids(F.col("word"), F.col("ranks")))).alias("ids"), "chunks", "places")
    back = coded.mapInArrow(_back(n, key_type), columns)
    made = f"key {kind.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded binary" * whole
    out = back.repartitionById(n, F.col("part")).sortWithinPartitions("chunk", "kind").mapInArrow(_assemble(tokens_of(ranks), whole), made)
    give_back()  # of the text of the ranks, which the driver's Python holds no more
    return out.withColumnRenamed("key", key)
