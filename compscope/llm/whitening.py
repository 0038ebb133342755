"""Whitening of embeddings from exact integer cross-products by bit-sliced scatter.

Components become integers x, and the smallest x of its dimension is subtracted from each, so that
few bits are left. A task turns rows into bit planes: for each dimension and bit one string of bits,
a bit per row, packed into 64-bit words. The sum of products of two dimensions is the sum over bit
pairs (p, q) of 2^(p+q) times the number of ones in the AND of two planes, and the sum of a dimension
comes from the ones of its own planes. Tasks hand on counts by p + q, which are small integers; they
are weighted and centred as whole numbers of any size on the driver, where the matrix has as many
entries as the vectors have dimensions, squared. Only then it becomes a covariance in double
precision and is split into eigenvectors.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import bounded_batches, finite, give_back

SCALE, SHIFT = 64, 1_000_000
# Components whose bit planes a task holds at once; partial sums per dimension.
BLOCK = 1 << 20
PARTS = 64
# Vectors of more dimensions are refused: the driver holds this number squared.
MAX_DIM = 1_024
# Components of this size do not fit a 64-bit integer when scaled.
LIMIT = float(1 << 55)


def integers(rows: np.ndarray) -> np.ndarray:
    """floor(64 c) + 1000000 of every component."""
    if len(rows) and np.abs(rows).max(initial=0.0) >= LIMIT:
        raise ValueError(f"a component is {LIMIT:.0f} or more: its scaled value is no 64-bit integer")
    return np.floor(SCALE * rows).astype(np.int64) + SHIFT


def matrix_of(column: pa.Array, dim: int) -> np.ndarray:
    """The rows of a list column of doubles."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False).reshape(-1, dim)


def bit_planes(y: np.ndarray, bits: int) -> np.ndarray:
    """Planes of non-negative ``y`` as words: [dimension, bit, word]; missing rows are zero."""
    n, dim = y.shape
    padded = np.zeros((dim, -(-n // 64) * 64), np.uint64)
    padded[:, :n] = y.T
    planes = [np.packbits(((padded >> np.uint64(p)) & np.uint64(1)).astype(np.uint8), axis=1) for p in range(bits)]
    return np.stack(planes, axis=1).view(np.uint64)


def scatter_counts(planes: np.ndarray, counts: np.ndarray) -> None:
    """Add to ``counts[a, b, s]``, b >= a, the ones in the ANDs of planes (a, p) and (b, s - p), and to
    ``counts[a, dim, p]`` the ones of plane (a, p)."""
    dim, bits, _ = planes.shape
    for a in range(dim):
        rest = planes[a:]
        for p in range(bits):
            ones = np.bitwise_count(rest & planes[a, p]).sum(axis=2, dtype=np.int64)
            counts[a, a:dim, p : p + bits] += ones
            counts[a, dim, p] += int(ones[0, p])


@dataclass
class Whitening:
    """Exact sums and the components of the integer vectors of ``n`` rows."""

    n: int
    low: np.ndarray
    sums: list[int]
    centred: list[list[int]]
    values: np.ndarray
    vectors: np.ndarray

    @property
    def trace(self) -> Fraction:
        return Fraction(sum(self.centred[d][d] for d in range(len(self.low))), self.n * self.n)

    def covariance(self) -> np.ndarray:
        square = self.n * self.n
        return np.array([[c / square for c in row] for row in self.centred]).reshape(len(self.low), -1)

    def kept(self, components: int) -> np.ndarray:
        """Which of the first components have a variance above the rounding errors of the matrix."""
        values = self.values[:components]
        least = max(1, len(self.low)) * np.finfo(float).eps * max(float(self.values[0]), 0.0) * 8 if len(self.values) else 0.0
        return values > least

    def identity_error(self, components: int) -> float | None:
        """Largest entry of the whitened covariance minus the identity; None without components."""
        good = self.kept(components)
        if not good.any():
            return None
        w = self.vectors[:, :components][:, good] / np.sqrt(self.values[:components][good])
        return float(np.abs(w.T @ self.covariance() @ w - np.eye(w.shape[1])).max())


def fit_whitening(rows: DataFrame, vector: str) -> Whitening | None:
    """Learn from all rows of ``vector array<double>``, without nulls, of one length. None without rows."""
    bounded_batches(rows.sparkSession)
    size = F.size(vector)
    seen = rows.agg(F.count("*").alias("n"), F.min(size).alias("a"), F.max(size).alias("b")).first()
    n, dim = seen["n"], seen["b"]
    if not n:
        return None
    if seen["a"] != dim:
        raise ValueError(f"vectors have {seen['a']} to {dim} components: no common covariance")
    if dim > MAX_DIM:
        raise ValueError(f"vectors of more than {MAX_DIM} components are not handled")

    def extremes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low = high = None
        for batch in batches:
            if batch.num_rows:
                x = integers(matrix_of(batch.column(0), dim))
                a, b = x.min(axis=0), x.max(axis=0)
                low, high = (a, b) if low is None else (np.minimum(low, a), np.maximum(high, b))
        if low is not None:
            yield pa.RecordBatch.from_arrays([pa.array(range(dim), pa.int32()), pa.array(low), pa.array(high)], ["d", "low", "high"])

    ends = rows.select(vector).mapInArrow(extremes, "d int, low bigint, high bigint")
    ends = ends.groupBy("d").agg(F.min("low").alias("low"), F.max("high").alias("high")).orderBy("d").collect()
    low = np.array([r["low"] for r in ends], np.int64)
    bits = max(1, max(r["high"] - r["low"] for r in ends).bit_length())
    counts = _scatter(rows, vector, dim, low, bits)

    weight = [1 << s for s in range(2 * bits - 1)]

    def weighted(c: np.ndarray) -> int:
        return sum(w * v for w, v in zip(weight, c.tolist()) if v)

    # y = x - low: covariances are those of x.
    part = [weighted(counts[a, dim]) for a in range(dim)]
    centred = [[0] * dim for _ in range(dim)]
    for a in range(dim):
        for b in range(a, dim):
            centred[a][b] = centred[b][a] = n * weighted(counts[a, b]) - part[a] * part[b]
    fitted = Whitening(n, low, [s + n * int(m) for s, m in zip(part, low)], centred, np.zeros(0), np.zeros((dim, 0)))
    values, vectors = np.linalg.eigh(fitted.covariance())
    fitted.values, fitted.vectors = values[::-1], vectors[:, ::-1]
    return fitted


def _scatter(rows: DataFrame, vector: str, dim: int, low: np.ndarray, bits: int) -> np.ndarray:
    """Counts by dimensions and p + q over all rows; a task hands on one row per dimension."""
    shape = (dim, dim + 1, 2 * bits - 1)

    def scatter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(shape, np.int64)
        waiting, held = [], 0

        def take() -> None:
            scatter_counts(bit_planes((np.concatenate(waiting) - low).view(np.uint64), bits), counts)

        for batch in batches:
            waiting.append(integers(matrix_of(batch.column(0), dim)))
            held += len(waiting[-1])
            if held * dim >= BLOCK:
                take()
                waiting, held = [], 0
        if held:
            take()
        give_back()
        if counts.any():
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(dim), pa.int32()), pa.array([c.astype("<i8").tobytes() for c in counts], pa.binary())], ["d", "counts"]
            )

    def add(key: tuple, groups: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape[1:], "<i8")
        for group in groups:
            for c in group.column("counts").to_pylist():
                total += np.frombuffer(c, "<i8").reshape(shape[1:])
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["d", "counts"])

    parts = rows.select(vector).mapInArrow(scatter, "d int, counts binary")
    parts = parts.withColumn("part", F.spark_partition_id() % PARTS)
    parts = parts.groupBy("d", "part").applyInArrow(add, "d int, counts binary").groupBy("d").applyInArrow(add, "d int, counts binary")
    counts = np.zeros(shape, np.int64)
    for row in parts.collect():  # a row per dimension
        counts[row.d] = np.frombuffer(row.counts, "<i8").reshape(shape[1:])
    return counts


def whiten(df: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", components: int = 32) -> DataFrame:
    """``<vec_id>, component, n, deviation, whitened, explained, identity_error``: for every vector its
    coordinates along the first ``components`` principal axes, scaled to unit variance.

    Vectors that are null or empty or hold null or non-finite components take no part; repeated rows
    and null ids do, row by row. An empty table gives no rows. Vectors of unlike lengths, of more than
    ``MAX_DIM`` components or with components of 2^55 or more are an error. ``deviation`` is the sum of
    (n x - S)^2 as an exact integer, null where it passes 64 bits. Components without variance (fewer
    vectors than dimensions, constant dimensions) have a null ``whitened``; if there is no variance at
    all, ``explained`` and ``identity_error`` are null too. Other columns are not read.
    """
    whole = F.transform(F.col(embedding), lambda x: x.cast("double"))
    rows = df.where(finite(F.col(embedding)) & (F.size(embedding) > 0)).select(df[vec_id].alias("_id"), whole.alias("_v"))
    fields = "component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
    model = fit_whitening(rows, "_v")
    if model is None:
        out = df.sparkSession.createDataFrame([], f"_id {df.schema[vec_id].dataType.simpleString()}, {fields}")
        return out.withColumnRenamed("_id", vec_id)
    n, dim, top = model.n, len(model.low), min(components, len(model.low))
    good = model.kept(top)
    axes = model.vectors[:, :top] / np.sqrt(np.where(good, model.values[:top], 1.0))
    low = model.low
    part = [s - n * int(m) for s, m in zip(model.sums, low)]  # sums of x - low
    mean = np.array([s / n for s in part])
    widest = max(part)

    def deviations(y: np.ndarray) -> list[int | None]:
        far = n * int(y.max(initial=0)) + widest  # no |n x - S| is larger
        if dim * far * far < 1 << 63:
            return np.square(n * y - np.array(part, np.int64)).sum(axis=1).tolist()
        exact = (sum((n * v - s) ** 2 for v, s in zip(row, part)) for row in y.tolist())
        return [d if d < 1 << 63 else None for d in exact]

    @F.arrow_udf("deviation bigint, whitened array<double>")
    def project(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            y = integers(matrix_of(batch, dim)) - low
            points = (y - mean) @ axes
            flat = pa.array(points.ravel(), mask=np.tile(~good, len(points)))
            lists = pa.ListArray.from_arrays(np.arange(0, top * len(points) + 1, top, dtype=np.int32), flat)
            yield pa.StructArray.from_arrays([pa.array(deviations(y), pa.int64()), lists], names=["deviation", "whitened"])
        give_back()

    trace, error = model.trace, model.identity_error(top)
    shares = [float(Fraction(float(e)) / trace) if trace else None for e in model.values[:top]]
    explained = F.array(*[F.lit(s).cast("double") for s in shares])
    bounded_batches(df.sparkSession)
    out = rows.select("_id", project("_v").alias("_p")).select(
        "_id", F.col("_p.deviation").alias("deviation"), F.posexplode("_p.whitened").alias("_c", "whitened")
    )
    return out.select(
        F.col("_id").alias(vec_id),
        (F.col("_c") + 1).alias("component"),
        F.lit(n).cast("bigint").alias("n"),
        "deviation",
        "whitened",
        F.get(explained, F.col("_c")).alias("explained"),
        F.lit(error).cast("double").alias("identity_error"),
    )
