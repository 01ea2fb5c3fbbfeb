"""Embedding whitening: a randomised range finder with power passes over all centred rows, Rayleigh-Ritz in what it finds, all dimensions if residuals fail."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skysift.llm.storage import materialize

#: Components that are returned, directions beyond them that the range finder takes, and its power passes before it gives way to all dimensions.
COMPONENTS, OVERSAMPLE, PASSES = 32, 16, 4
#: A component may miss its eigenvector's equation by this share of the largest eigenvalue.
RESIDUAL = 1e-13
#: x = floor(FACTOR * entry) + SHIFT.
FACTOR, SHIFT = 64, 1_000_000
#: x has to be a long: entries of this size or more take a vector out, as infinite ones do.
MOST = 2.0**62 / FACTOR
#: Rows that a kernel multiplies at a time.
TILE = 4096


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """vec_id, embedding in; vec_id, dims and x as bytes out, without vectors that are null, empty, or hold null, non-finite or too large entries."""
    for batch in batches:
        vectors = batch.column(1)
        size = np.array([n or 0 for n in vectors.value_lengths().to_pylist()], np.int64)
        v = vectors.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
        good = np.isfinite(v) & (np.abs(np.nan_to_num(v)) < MOST)
        bad = np.bincount(np.repeat(np.arange(len(size)), size)[~good], minlength=len(size))
        x = np.floor(FACTOR * np.where(good, v, 0.0)).astype(np.int64) + SHIFT
        end = np.cumsum(size)
        keep = np.flatnonzero((size > 0) & (bad == 0))
        rows = [x[end[i] - size[i] : end[i]].tobytes() for i in keep.tolist()]
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keep)), pa.array(size[keep].astype(np.int32)), pa.array(rows, pa.binary())], names=["vec_id", "dims", "x"])


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, np.ndarray]]:
    for batch in batches:
        for at in range(0, batch.num_rows, TILE):
            part = batch.slice(at, TILE)
            yield part.column("vec_id"), np.frombuffer(b"".join(part.column("x").to_pylist()), np.int64).reshape(part.num_rows, -1)


def _column_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each task's sums by dimension, in halves of 32 bits so that they are exact."""
    total: list[np.ndarray] = []
    for _, x in _blocks(batches):
        halves = [(x >> 32).sum(0), (x & 0xFFFFFFFF).sum(0)]
        total = [a + b for a, b in zip(total, halves)] if total else halves
    if total:
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total[0]), dtype=np.int32)), *map(pa.array, total)], names=["dim", "high", "low"])


def _deviations(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n * x - S, exact: 64-bit integers where all steps fit, else Python's."""
    most = max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0)))) * n + max(map(abs, sums))
    if most < 2**62:
        return x * n - np.array(sums, np.int64)
    return x.astype(object) * n - np.array(sums, object)


def _deviation(d: np.ndarray) -> np.ndarray:
    """Sums of squares, exact; one beyond a long is given as the largest long."""
    most = max(abs(int(d.max(initial=0))), abs(int(d.min(initial=0))))
    if most * most * d.shape[1] < 2**63:
        return (d.astype(np.int64) ** 2).sum(1)
    return np.array([min(int(s), 2**63 - 1) for s in (d.astype(object) ** 2).sum(1)], np.int64)


def _product(n: int, sums: list[int], basis: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Each task's part of V * basis, a row for each number of it; and its part of V's trace, at (-1, -1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, trace = np.zeros(basis.shape), 0.0
        for _, x in _blocks(batches):
            c = _deviations(x, n, sums).astype(np.float64) / n
            total += c.T @ (c @ basis) / n
            trace += float((c * c).sum()) / n
        i, j = np.divmod(np.arange(total.size), basis.shape[1])
        columns = [np.append(i, -1).astype(np.int32), np.append(j, -1).astype(np.int32), np.append(total.ravel(), trace)]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["i", "j", "v"])

    return run


def _moments(n: int, sums: list[int], basis: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Each task's sums of the whitened columns (at i = -1) and of their products."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = basis.shape[1]
        total = np.zeros((k + 1, k))
        for _, x in _blocks(batches):
            w = (_deviations(x, n, sums).astype(np.float64) / n) @ basis
            total += np.vstack([w.sum(0), w.T @ w])
        i, j = np.divmod(np.arange(total.size), k)
        yield pa.RecordBatch.from_arrays([pa.array((i - 1).astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(total.ravel())], names=["i", "j", "v"])

    return run


def _added(rows: DataFrame, kernel: Callable, shape: tuple[int, int]) -> tuple[np.ndarray, dict]:
    """The kernel's parts added up: a matrix of this shape, bounded by the dimensions of a vector, and what has other places."""
    out, rest = np.zeros(shape), {}
    for i, j, v in rows.mapInArrow(kernel, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect():
        if i < 0:
            rest[i, j] = v
        else:
            out[i, j] = v
    return out, rest


def components(rows: DataFrame, n: int, sums: list[int], most: int = COMPONENTS, oversample: int = OVERSAMPLE, passes: int = PASSES) -> tuple[np.ndarray, np.ndarray, float, bool]:
    """rows (x) -> (eigenvalues, falling; unit eigenvectors, one a column; trace of the covariance; whether all dimensions were needed).

    A random basis of most + oversample directions is multiplied by the covariance, pass by pass over all rows, and made orthonormal in between. After
    each pass Rayleigh-Ritz gives components in it; they are taken once all residuals are under RESIDUAL of the largest eigenvalue. If that does
    not come about in `passes`, as in flat spectra, the basis is filled up to all dimensions, in which Rayleigh-Ritz is exact."""
    d = len(sums)
    rng = np.random.default_rng(13)
    full = most + oversample >= d
    basis = np.eye(d) if full else np.linalg.qr(rng.normal(size=(d, most + oversample)))[0]
    while True:
        product, rest = _added(rows, _product(n, sums, basis), basis.shape)
        small = basis.T @ product
        value, turn = np.linalg.eigh((small + small.T) / 2)
        order = np.argsort(-value, kind="stable")[:most]
        value, turn = value[order], turn[:, order]
        vector = basis @ turn
        residual = np.sqrt(((product @ turn - vector * value) ** 2).sum(0)).max()
        if full or residual <= RESIDUAL * max(value[0], 0):
            break
        passes -= 1
        if passes > 0:
            basis = np.linalg.qr(product)[0]
        else:
            full = True
            basis = np.linalg.qr(np.hstack([vector, rng.normal(size=(d, d))]))[0][:, :d]
    trace = rest[-1, -1]
    keep = value > d * np.finfo(float).eps * max(value[0], 0)
    value, vector = value[keep], vector[:, keep]
    sign = np.sign(np.take_along_axis(vector, np.abs(vector).argmax(0)[None], 0)) if vector.size else 1.0
    return value, vector * sign, trace, full


def whiten(vectors: DataFrame, most: int = COMPONENTS, oversample: int = OVERSAMPLE, passes: int = PASSES) -> DataFrame:
    """vectors (vec_id, embedding, ...) -> (vec_id, component, n, deviation, whitened, explained, identity_error), a row for each vector and component.

    Every entry c becomes x = floor(64 c) + 1000000; the covariance V is over all vectors that take part, with divisor n. Null vectors, empty ones, and those
    that hold null or non-finite entries, or entries whose x is no long, take no part; of vectors of several lengths those of the most frequent one do (of
    several, the longest). Repeated rows, equal vectors and rows of null vec_id count each. Components whose variance is none, or lost in the
    rounding of the largest one's (one vector, equal vectors), can't be whitened and have no rows. A deviation beyond a long is given as the largest. An empty table gives an empty one; other columns,
    whatever their names, are not read. The driver holds matrices of the size of one vector squared; rows stay in their partitions."""
    kind = vectors.schema["vec_id"].dataType.simpleString()
    out = f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    rows = materialize(vectors.select("vec_id", F.col("embedding").cast("array<double>")).mapInArrow(_whole, f"vec_id {kind}, dims int, x binary"), "whole")
    lengths = rows.groupBy("dims").count().orderBy(F.desc("count"), F.desc("dims")).first()
    if lengths is None:
        return vectors.sparkSession.createDataFrame([], out)
    dims, n = lengths
    rows = rows.where(F.col("dims") == dims).select("vec_id", "x")
    parts = rows.mapInArrow(_column_sums, "dim int, high long, low long").groupBy("dim").agg(*(F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in ("high", "low")))
    sums = [int(r.high) * 2**32 + int(r.low) for r in parts.orderBy("dim").collect()]
    value, vector, trace, _ = components(rows, n, sums, most, oversample, passes)
    if not len(value):
        return vectors.sparkSession.createDataFrame([], out)
    basis, share = vector / np.sqrt(value), value / trace
    k = len(value)
    products, means = _added(rows, _moments(n, sums, basis), (k, k))
    mean = np.array([means[-1, j] for j in range(k)]) / n
    error = float(np.abs(products / n - np.outer(mean, mean) - np.eye(k)).max())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, x in _blocks(batches):
            d = _deviations(x, n, sums)
            w = (d.astype(np.float64) / n) @ basis
            m = len(x)
            each = pa.array(np.repeat(np.arange(m), k))
            columns = [ids.take(each), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, n)), pa.array(np.repeat(_deviation(d), k)), pa.array(w.ravel()), pa.array(np.tile(share, m)), pa.array(np.full(m * k, error))]
            yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(run, out)


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector whitened, up to 32 components."""
    return whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
