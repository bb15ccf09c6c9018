"""Many (document, position, hash) entries in one row, as byte planes that compress well when shuffled."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: Columns of a packed row.
FIELDS = "keys binary, ties binary, counts binary, places binary, hashes binary"
NAMES = ["keys", "ties", "counts", "places", "hashes"]


def _planes(a: np.ndarray) -> bytes:
    """The first bytes of all numbers, then the second ones, and so on."""
    return a.view(np.uint8).reshape(len(a), a.itemsize).T.tobytes()


def _numbers(data: bytes, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(size, -1).T).view(kind).ravel()


def pack(keys: np.ndarray, ties: np.ndarray, doc: np.ndarray, place: np.ndarray, hashes: np.ndarray | None) -> list:
    """Entries in order of doc (a number into keys and ties) and place."""
    first = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]])) if len(doc) else np.zeros(0, np.int64)
    own = doc[first]
    step = place.astype(np.int64)
    step[1:] -= place[:-1]
    step[first] = place[first]
    counts = np.diff(np.append(first, len(doc))).astype(np.uint32)
    return [_planes(np.diff(keys[own], prepend=0).astype(np.int64)), ties[own].astype(np.int32).tobytes(), _planes(counts), _planes(step.astype(np.uint32)), None if hashes is None else hashes.tobytes()]


def unpack(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """key, tie and place of each entry."""
    counts = _numbers(row["counts"], np.uint32).astype(np.int64)
    step = _numbers(row["places"], np.uint32).astype(np.int64)
    total = np.cumsum(step)
    first = np.cumsum(counts) - counts
    place = total - np.repeat(total[first] - step[first], counts)
    keys = np.cumsum(_numbers(row["keys"], np.int64))
    return np.repeat(keys, counts), np.repeat(np.frombuffer(row["ties"], np.int32), counts), place


def runs(key: np.ndarray, tie: np.ndarray, place: np.ndarray) -> pa.RecordBatch:
    """One row (key, tie, runs) per document of entries in order; runs: first place and length of each row of consecutive places."""
    new = np.concatenate([[True], (key[1:] != key[:-1]) | (tie[1:] != tie[:-1])]) if len(key) else np.zeros(0, bool)
    start = np.flatnonzero(new | np.concatenate([[True], place[1:] != place[:-1] + 1])) if len(key) else np.zeros(0, np.int64)
    both = np.empty(2 * len(start), np.int32)
    both[0::2], both[1::2] = place[start], np.diff(np.append(start, len(key)))
    docs = np.flatnonzero(new)
    offsets = np.append(2 * np.searchsorted(start, docs), len(both)).astype(np.int32)
    return pa.record_batch([pa.array(key[docs], pa.int64()), pa.array(tie[docs], pa.int32()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(both))], names=["key", "tie", "runs"])
