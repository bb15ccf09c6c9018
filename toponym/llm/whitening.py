"""Whitening of embeddings by their first principal components, found by a matrix-free block Lanczos iteration.

The covariance is never formed. A pass over the rows multiplies it with a block of vectors: each task centres its vectors, multiplies them twice and gives one small matrix, and Spark adds the
matrices up. The driver holds the basis (dimensions x at most dimensions numbers) and nothing that grows with the rows. Each new block is made orthogonal to the whole basis twice;
directions that vanish are replaced by random ones orthogonal to it (a restart), until the residuals of the wanted pairs are at rounding level or the basis spans
the space. Residuals come from products that are kept, so testing them needs no pass.

Components are fitted on distinct vectors, so that copies do not weigh more. The total variance is the sum of exact integer deviations.

Cases: rows whose vector is null, empty, or holds null or non-finite entries take no part, nor do those of another length than most vectors have (of equally frequent lengths, the
longest). Rows that repeat an id, or a vector under several ids, each have their own results. Components without variance (less than FLAT of the largest) are left out, so
a table of one distinct vector, or an empty one, has no rows. Components of equal variance are any orthogonal directions of their plane. Entries beyond a long count as its ends; a deviation beyond a long is null. Further columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import released, written

#: Vectors of a block beyond the wanted components.
SPARE = 4
#: Residual, by the largest eigenvalue, at which a pair is taken.
RESIDUAL = 1e-14
#: Share of the largest eigenvalue under which a component has no variance.
FLAT = 1e-13
#: A direction whose length falls to this share of what it was has broken down.
BREAKDOWN = 1e-10
_LONG = 1 << 63


@dataclass(frozen=True)
class Components:
    """n distinct vectors with the sums of their dimensions; vectors (dimensions x components), eigenvalues, total variance, and passes over the rows."""

    n: int
    sums: list[int]
    vectors: np.ndarray
    values: np.ndarray
    total: float
    passes: int

    @property
    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums])


def quantised(rows: DataFrame, scale: int = 256, vector: str = "embedding") -> DataFrame:
    """The rows that take part, with the column `x`: floor(scale * entry) as longs. Runs a job for the length."""
    fit = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))
    whole = rows.where(F.col(vector).isNotNull() & (F.size(vector) > 0) & F.forall(vector, lambda c: F.coalesce(fit(c), F.lit(False))))
    lengths = whole.groupBy(F.size(vector).alias("k")).count().orderBy(F.desc("count"), F.desc("k")).limit(1).collect()
    if lengths:
        whole = whole.where(F.size(vector) == lengths[0]["k"])
    return whole.withColumn("x", F.transform(vector, lambda c: F.floor(c.cast("double") * scale).cast("long")))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _summed(rows: DataFrame, work: Callable[[np.ndarray], list[np.ndarray]], shapes: list[tuple[int, int]]) -> list[np.ndarray]:
    """The sums over all vectors x of rows of the matrices that work gives for an array of them: added up in each task, then by Spark, entry by entry."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [np.zeros(s) for s in shapes]
        for batch in batches:
            if batch.num_rows:
                for t, w in zip(total, work(_matrix(batch.column("x"))), strict=True):
                    t += w
        flat = np.concatenate([t.ravel() for t in total])
        width = 256
        at = np.arange(0, len(flat), width)
        yield pa.record_batch([pa.array(at, pa.int64()), pa.array([flat[i : i + width] for i in at], pa.list_(pa.float64()))], names=["at", "part"])

    parts = rows.select("x").mapInArrow(released(run), "at long, part array<double>").select("at", F.posexplode("part").alias("k", "v"))
    found = parts.groupBy((F.col("at") + F.col("k")).alias("i")).agg(F.sum("v").alias("v")).collect()  # one row for each entry of the matrices
    flat = np.zeros(sum(a * b for a, b in shapes))
    flat[[r["i"] for r in found]] = [r["v"] for r in found]
    out, at = [], 0
    for a, b in shapes:
        out.append(flat[at : at + a * b].reshape(a, b))
        at += a * b
    return out


def _moments(fit: DataFrame) -> tuple[int, list[int]]:
    """Number of vectors and exact sums of their dimensions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, high, low = 0, 0, 0
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column("x"))
                # halves of 32 bits, whose sums stay exact
                n, high, low = n + len(x), high + (x >> 32).sum(axis=0), low + (x & 0xFFFFFFFF).sum(axis=0)
        if n:
            yield pa.record_batch([pa.array(np.arange(len(high))), pa.array(np.full(len(high), n)), pa.array(high), pa.array(low)], names=["k", "n", "high", "low"])

    wide = [F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in ("high", "low")]
    rows = fit.select("x").mapInArrow(released(run), "k long, n long, high long, low long").groupBy("k").agg(F.sum("n").alias("n"), *wide).collect()  # one row for each dimension
    rows = sorted(rows, key=lambda r: r["k"])
    return (rows[0]["n"] if rows else 0), [(int(r["high"]) << 32) + int(r["low"]) for r in rows]


def _deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int]:
    """The exact sum over dimensions of (n x - sum) squared for each vector."""
    reach = n * int(max(abs(int(x.max())), abs(int(x.min())))) + max(map(abs, sums)) if x.size else 0
    if reach * reach * x.shape[1] < _LONG:
        apart = n * x - np.array(sums, np.int64)
        return (apart * apart).sum(axis=1).tolist()
    apart = n * x.astype(object) - np.array(sums, object)
    return (apart * apart).sum(axis=1).tolist()


def _total_variance(fit: DataFrame, n: int, sums: list[int]) -> float:
    """The trace of the covariance: exact deviations, added up exactly."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = sum(sum(_deviations(_matrix(b.column("x")), n, sums)) for b in batches if b.num_rows)
        yield pa.record_batch([pa.array([str(total)])], names=["total"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = sum(int(t) for b in batches for t in b.column("total").to_pylist())
        yield pa.record_batch([pa.array([str(total)])], names=["total"])

    tasks = fit.select("x").mapInArrow(released(run), "total string")
    # one number of any length for each task, added in two steps
    some = tasks.repartition(16).mapInArrow(add, "total string")
    total = sum(int(r["total"]) for r in some.collect())
    return total / n**3


def block_lanczos(times: Callable[[np.ndarray], np.ndarray], size: int, wanted: int, block: int, seed: int = 7) -> tuple[np.ndarray, np.ndarray, int]:
    """The `wanted` largest eigenvalues of a symmetric operator of `size` dimensions and their unit vectors, falling, and the number of calls of `times`.

    times(block of vectors) gives the operator's products with them.
    """
    random, wanted, block = np.random.default_rng(seed), min(wanted, size), min(block, size)

    def fresh(basis: np.ndarray, tried: np.ndarray) -> np.ndarray:
        """Orthonormal columns that are orthogonal to the basis: those of tried that have not broken down, then random ones."""
        out = np.zeros((size, 0))
        for k in range(min(block, size - basis.shape[1])):
            v = tried[:, k] if k < tried.shape[1] else random.standard_normal(size)
            while True:
                long = np.linalg.norm(v)
                for _ in range(2):
                    v = v - basis @ (basis.T @ v)
                    v = v - out @ (out.T @ v)
                if long > 0 and np.linalg.norm(v) > BREAKDOWN * max(long, scale):
                    break
                v = random.standard_normal(size) * max(scale, 1.0)
            out = np.column_stack([out, v / np.linalg.norm(v)])
        return out

    basis, products, scale, calls = np.zeros((size, 0)), np.zeros((size, 0)), 0.0, 0
    new = fresh(basis, random.standard_normal((size, block)))
    while True:
        made = times(new)
        calls += 1
        basis, products = np.column_stack([basis, new]), np.column_stack([products, made])
        small = basis.T @ products
        values, mixed = np.linalg.eigh((small + small.T) / 2)
        values, mixed = values[::-1][:wanted], mixed[:, ::-1][:, :wanted]
        scale = max(float(values[0]), 0.0)
        residuals = np.linalg.norm(products @ mixed - basis @ mixed * values, axis=0)
        if basis.shape[1] == size or (basis.shape[1] >= wanted + block and (residuals <= RESIDUAL * scale).all()):
            vectors = basis @ mixed
            return values, vectors / np.linalg.norm(vectors, axis=0), calls
        new = fresh(basis, made)


def components(fit: DataFrame, wanted: int) -> Components | None:
    """The first components of the distinct vectors `x` of fit, a table that is read once for each pass; None where nothing varies."""
    n, sums = _moments(fit)
    if not n:
        return None
    size, total = len(sums), _total_variance(fit, n, sums)
    mean = np.array([s / n for s in sums])
    if not total:
        return None

    def times(block: np.ndarray) -> np.ndarray:
        def work(x: np.ndarray) -> list[np.ndarray]:
            apart = x - mean
            return [apart.T @ (apart @ block)]

        return _summed(fit, work, [block.shape])[0] / n

    values, vectors, passes = block_lanczos(times, size, wanted, wanted + SPARE)
    held = values > FLAT * values[0]
    return Components(n, sums, vectors[:, held], values[held], total, passes)


def _whitened(x: np.ndarray, c: Components) -> np.ndarray:
    return (x - c.mean) @ c.vectors / np.sqrt(c.values)


def identity_error(fit: DataFrame, c: Components) -> float:
    """The largest absolute entry of the covariance of the whitened fit list, less the identity."""
    k = len(c.values)

    def work(x: np.ndarray) -> list[np.ndarray]:
        z = _whitened(x, c)  # already centred
        return [z.sum(axis=0, keepdims=True), z.T @ z]

    mean, square = _summed(fit, work, [(1, k), (k, k)])
    return float(np.abs(square / c.n - (mean / c.n).T @ (mean / c.n) - np.eye(k)).max())


def whiten(rows: DataFrame, wanted: int = 4, scale: int = 256, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(key, component, n, deviation, whitened, explained, identity_error) of every row that takes part and each component."""
    kept = quantised(rows.select(F.col(key).alias("key"), F.col(vector).alias("embedding")), scale).select("key", "x")
    fit = written(kept.select("x").distinct())
    c = components(fit, wanted)
    schema = "key long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if c is None:
        return kept.sparkSession.createDataFrame([], schema).withColumnRenamed("key", key)
    error, explained = identity_error(fit, c), c.values / c.total

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x, k = _matrix(batch.column("x")), len(c.values)
            deviation = pa.array([d if d < _LONG else None for d in _deviations(x, c.n, c.sums)], pa.int64())
            each = np.repeat(np.arange(len(x)), k)
            full = lambda v, kind: pa.array(np.full(len(each), v), kind)
            columns = [batch.column("key").take(pa.array(each)).cast(pa.int64()), pa.array(np.tile(np.arange(1, k + 1), len(x)), pa.int32()), full(c.n, pa.int64()), deviation.take(pa.array(each)),
                       pa.array(_whitened(x, c).ravel()), pa.array(np.tile(explained, len(x))), full(error, pa.float64())]
            yield pa.record_batch(columns, names=["key", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return kept.mapInArrow(released(run), schema).withColumnRenamed("key", key)
