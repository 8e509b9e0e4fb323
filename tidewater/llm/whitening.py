"""Embedding whitening from an exact integer scatter matrix.

Entries become whole numbers, a shift is subtracted, and every task sums them and their cross-products without rounding:
matrix products of digits small enough for doubles to hold exactly, carried on in Python's whole numbers. What tasks have
gathered is cut into digits of 40 bits and summed by Spark, so the sums have no largest size. The driver receives about
half as many numbers as the square of the number of dimensions, however many rows there are; it forms n * X'X - SS'
exactly, and only that is turned into doubles and decomposed.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.llm.common import map_batches, materialize, read_table

COMPONENTS = 8
SCALE, ADD = 1024.0, 100_000
DIGIT = 20  # bits of a digit in a matrix product: 2 ** (53 - 2 * DIGIT) rows are summed without rounding
LIMB = 40  # bits of a digit in Spark's sums: 2 ** 23 tasks fit a long


def usable(vectors: DataFrame, vector: str) -> DataFrame:
    """The rows whose vector is neither null nor holds null or non-finite entries."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.where(F.col(vector).isNotNull() & fine)


def shifted(column: pa.Array, scale: float = SCALE, width: int | None = None) -> np.ndarray:
    """floor(scale * x) of a list column, a row for each list, which zeros fill up; objects where 62 bits are too few."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lengths = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if not len(flat) or np.abs(flat).max() * scale < float(1 << 62):
        values = np.floor(flat * scale).astype(np.int64)
    else:
        values = np.array([int(c) * int(scale) if abs(c) >= 1 << 53 else int(np.floor(c * scale)) for c in flat.tolist()], object)
    out = np.zeros((len(lengths), max([width or 0, *lengths.tolist()])), values.dtype)
    rows = np.repeat(np.arange(len(lengths)), lengths)
    out[rows, np.arange(len(values)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = values
    return out


def cross_products(y: np.ndarray) -> np.ndarray:
    """y'y of whole numbers, exact."""
    if y.dtype == object:
        return y.T.dot(y)
    digits, sign, size = [], np.sign(y), np.abs(y)
    while size.any():
        digits.append((sign * (size & ((1 << DIGIT) - 1))).astype(np.float64))
        size = size >> DIGIT
    total = np.zeros((y.shape[1], y.shape[1]), object)  # of Python's own whole numbers
    rows = 1 << (53 - 2 * DIGIT)
    for at in range(0, len(y), rows):
        for i, a in enumerate(digits):
            for j, b in enumerate(digits):
                total += (a[at : at + rows].T @ b[at : at + rows]).astype(np.int64).astype(object) << (DIGIT * (i + j))
    return total


def sums_of_squares(d: np.ndarray) -> list[int]:
    """Sum of squares of each row of whole numbers, exact."""
    if not d.size:
        return [0] * len(d)
    if d.dtype == object:
        return [int(sum(x * x for x in row)) for row in d.tolist()]
    most = int(np.abs(d).max())
    if most * most * d.shape[1] < 1 << 63:
        return (d * d).sum(axis=1).tolist()
    size = np.abs(d)
    mask = (1 << 21) - 1
    parts = [size & mask, (size >> 21) & mask, size >> 42]
    out = np.zeros(len(d), object)
    for i, a in enumerate(parts):
        for j, b in enumerate(parts):
            out += (a * b).sum(axis=1).astype(object) << (21 * (i + j))
    return out.tolist()


def _limbs(value: int) -> Iterator[tuple[int, int]]:
    sign, size, k = (-1 if value < 0 else 1), abs(value), 0
    while size:
        yield k, sign * (size & ((1 << LIMB) - 1))
        size, k = size >> LIMB, k + 1


def _gather(scale: float):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums, products = 0, np.zeros(0, object), np.zeros((0, 0), object)
        for batch in batches:
            y = shifted(batch.column(0), scale)
            n += len(y)
            w, had = y.shape[1], len(sums)
            if w > had:
                old, sums, products = (sums, products), np.zeros(w, object), np.zeros((w, w), object)
                sums[:had], products[:had, :had] = old
            sums[:w] += y.astype(object).sum(axis=0) if y.dtype == object or len(y) and int(np.abs(y).max()) * len(y) >= 1 << 62 else y.sum(axis=0).astype(object)
            products[:w, :w] += cross_products(y)
        rows = [(-1, -1, k, v) for k, v in _limbs(n)]
        rows += [(i, -1, k, v) for i, s in enumerate(sums) for k, v in _limbs(int(s))]
        rows += [(i, j, k, v) for i in range(len(sums)) for j in range(i, len(sums)) for k, v in _limbs(int(products[i, j]))]
        if n:
            # a row of zeros for the last dimension tells the width even if all its entries are zero
            rows.append((len(sums) - 1, -1, 0, 0))
            cols = list(zip(*rows, strict=True))
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int32()) for c in cols[:3]), pa.array(cols[3], pa.int64())], ["i", "j", "limb", "v"])

    return task


@dataclass
class Whitening:
    """What is known of the fit list: sums are those of the shifted whole numbers; variances fall; axes are columns."""

    n: int
    sums: list[int]
    covariance: np.ndarray
    trace: float
    variances: np.ndarray
    axes: np.ndarray


def fit(vectors: DataFrame, vector: str, components: int = COMPONENTS, scale: float = SCALE) -> Whitening:
    """The exact scatter of usable vectors, and its leading components by numpy's eigh.

    Components whose variance is no more than what rounding leaves of zero (dimensions * 2**-52 of the largest) are left
    out. Vectors shorter than the longest count as ending in zeros.
    """
    parts = map_batches(vectors.select(vector), _gather(scale), "i int, j int, limb int, v long")
    n, sums, products = 0, defaultdict(int), defaultdict(int)
    for r in parts.groupBy("i", "j", "limb").agg(F.sum("v").alias("v")).collect():  # dimensions squared, whatever the rows
        value = r.v << (LIMB * r.limb)
        if r.i == r.j == -1:
            n += value
        elif r.j == -1:
            sums[r.i] += value
        else:
            products[r.i, r.j] += value
    width = max(sums, default=-1) + 1
    s = [sums[i] for i in range(width)]
    exact = lambda i, j: n * products[min(i, j), max(i, j)] - s[i] * s[j]
    v = np.array([[exact(i, j) / (n * n) for j in range(width)] for i in range(width)]).reshape(width, width)
    trace = sum(exact(i, i) for i in range(width)) / (n * n) if n else 0.0
    e, axes = np.linalg.eigh(v) if width else (np.zeros(0), np.zeros((0, 0)))
    e, axes = e[::-1][:components], axes[:, ::-1][:, :components]
    real = e > (e[0] if len(e) else 0.0) * width * np.finfo(float).eps
    return Whitening(n, s, v, trace, e[real], axes[:, real])


def _project(model: Whitening, scale: float):
    n, width = model.n, len(model.sums)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            y = shifted(batch.column(1), scale, width)
            largest = int(np.abs(y).max()) if y.size else 0
            small = y.dtype != object and n * largest + max(map(abs, model.sums), default=0) < 1 << 62
            if small:
                d = y * np.int64(n) - np.array(model.sums, np.int64)
                centred = d / n
            else:
                d = y.astype(object) * n - np.array(model.sums, object)
                centred = np.array([[x / n for x in row] for row in d.tolist()]).reshape(d.shape)
            far = sums_of_squares(d)
            w = centred @ model.axes / np.sqrt(model.variances)
            k = len(model.variances)
            values = pa.ListArray.from_arrays(pa.array(np.arange(0, (len(y) + 1) * k, k)[: len(y) + 1] if k else np.zeros(len(y) + 1), pa.int32()), pa.array(w.reshape(-1)))
            fits = pa.array([x if x < 1 << 63 else None for x in far], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), fits, pa.array(map(str, far), pa.string()), values], ["id", "deviation", "deviation_digits", "w"])

    return task


def whiten(vectors: DataFrame, ident: str, vector: str, components: int = COMPONENTS, scale: float = SCALE) -> DataFrame:
    """(id, component, n, deviation, deviation_digits, whitened, explained, identity_error) of usable vectors, all in the fit list.

    Every entry c is the whole number floor(scale * c) plus any shift: neither changes deviations, covariances or
    components. deviation is the exact sum over dimensions of (n * x - S) ** 2, null where that passes a long;
    deviation_digits always has its digits. Defined cases: rows that repeat are each in the list and in the result; a null
    id is an id; vectors shorter than the longest end in zeros; components without variance, so all of them for one
    vector or equal ones, have no rows; no usable vector gives no rows; other columns are ignored.
    """
    fine = usable(vectors, vector).select(F.col(ident).alias("id"), F.col(vector).cast("array<double>").alias("v"))
    model = fit(fine, "v", components, scale)
    kind = fine.schema["id"].dataType.simpleString()
    wide = materialize(map_batches(fine, _project(model, scale), f"id {kind}, deviation long, deviation_digits string, w array<double>"), "whitened")
    k = len(model.variances)
    at = [F.get("w", F.lit(i)) for i in range(k)]
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    error = None
    if k:
        found = wide.agg(*(F.covar_pop(at[i], at[j]).alias(f"c{i}_{j}") for i, j in pairs)).first()  # one row
        error = max(abs(found[f"c{i}_{j}"] - (i == j)) for i, j in pairs)
    share = F.array(*(F.lit(float(e / model.trace)) for e in model.variances)).cast("array<double>")
    each = wide.select("id", "deviation", "deviation_digits", F.posexplode("w").alias("pos", "whitened"))
    return each.select(
        "id", (F.col("pos") + 1).cast("int").alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "deviation_digits",
        "whitened", F.get(share, F.col("pos")).alias("explained"), F.lit(error).cast("double").alias("identity_error"),
    )


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(read_table(spark, sf_dir, "embeddings"), "vec_id", "embedding").withColumnRenamed("id", "vec_id")
