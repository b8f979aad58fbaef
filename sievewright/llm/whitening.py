"""Embedding whitening: exact scatter from bit planes, components by eigh, whitened coordinates."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sievewright.llm.common import batch_of

#: Fixed-point steps of a unit, and what is added so that usual entries count up from zero.
SCALE, OFFSET = 1024, 100_000
#: Rows whose bit planes are packed together.
BLOCK_ROWS = 8192
#: Bits of a limb of the exact sums.
_LIMB = 40


class Whitening(NamedTuple):
    """The fit of all vectors of one length; ``scales`` is 0 where a component has no spread."""

    n: int
    sums: np.ndarray  # of x, exact
    components: np.ndarray  # (length, count), unit columns by falling eigenvalue
    scales: np.ndarray  # 1 / sqrt(eigenvalue)
    explained: np.ndarray


def fixed_point(vectors: np.ndarray) -> np.ndarray:
    """floor(1024 * c) + 100000 as 64-bit integers; what is beyond 2**62 stays there."""
    return np.clip(np.floor(vectors * SCALE), -float(1 << 62), float(1 << 62)).astype(np.int64) + OFFSET


def scatter(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sums, cross-products) of integer rows x, exact, as arrays of Python integers.

    Each column is shifted by its least value and cut into bit planes, packed
    across rows into words; a pair of planes i and j that share c set bits adds
    c * 2**(i + j) to the product of their columns.  The shifts are put back at
    the end.
    """
    n, d = x.shape
    low = x.min(axis=0)
    u = (x - low).astype(np.uint64)  # differences up to 2**63 wrap to what they are
    widths = [int(v).bit_length() for v in u.max(axis=0)]
    column = np.repeat(np.arange(d), widths)
    bit = np.concatenate([np.arange(w) for w in widths]) if sum(widths) else np.zeros(0, np.int64)
    planes = np.zeros((len(column), -(-n // 64) * 8), np.uint8)
    for k, (c, b) in enumerate(zip(column, bit, strict=True)):
        planes[k, : -(-n // 8)] = np.packbits((u[:, c] >> np.uint64(b)) & np.uint64(1) != 0)
    words = planes.view(np.uint64)
    weight = np.array([1 << int(b) for b in bit], object)
    first = np.searchsorted(column, np.arange(d))
    sums = np.zeros(d, object)
    product = np.zeros((d, d), object)
    narrow = 2 * max(widths, default=0) + n.bit_length() < 62  # sums of a block fit 64 bits
    if narrow:
        weight = weight.astype(np.int64)
    for k in range(len(column)):
        c = column[k]
        shared = np.bitwise_count(words[k] & words[first[c] :]).sum(axis=1, dtype=np.int64)
        heads = np.unique(first[c:][np.array(widths[c:]) > 0])
        each = np.add.reduceat(shared * weight[first[c] :], heads - first[c])
        product[c, column[heads]] += each.astype(object) * int(weight[k])
        sums[c] += int(np.bitwise_count(words[k]).sum(dtype=np.int64)) * int(weight[k])
    upper = np.triu(product)
    product = upper + np.triu(product, 1).T
    low = low.astype(object)
    return sums + n * low, product + np.outer(low, sums) + np.outer(sums, low) + n * np.outer(low, low)


def _rows(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, matrix) of the usable vectors of each length; null, null entries and non-finite ones are left out."""
    lengths = np.asarray(column.value_lengths().fill_null(-1))
    flat = column.flatten()
    values = np.asarray(flat.fill_null(float("nan")), np.float64)
    starts = np.cumsum(np.maximum(lengths, 0)) - np.maximum(lengths, 0)
    for length in np.unique(lengths[lengths > 0]):
        at = np.flatnonzero(lengths == length)
        for i in range(0, len(at), BLOCK_ROWS):
            part = at[i : i + BLOCK_ROWS]
            matrix = values[starts[part][:, None] + np.arange(length)]
            good = np.isfinite(matrix).all(axis=1)
            if good.any():
                yield part[good], matrix[good]


_SUMS = T.StructType().add("length", "integer").add("i", "integer").add("j", "integer").add("hi", "long").add("mid", "long").add("lo", "long")
_SUMS_ARROW = pa.schema([("length", pa.int32()), ("i", pa.int32()), ("j", pa.int32()), ("hi", pa.int64()), ("mid", pa.int64()), ("lo", pa.int64())])


def _scatters(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's count (i = j = -1), sums (j = -1) and cross-products (i <= j), in limbs of 40 bits."""
    total: dict[int, list] = {}
    for batch in batches:
        for _, matrix in _rows(batch.column(0)):
            sums, product = scatter(fixed_point(matrix))
            own = total.setdefault(matrix.shape[1], [0, 0, 0])
            own[0], own[1], own[2] = own[0] + len(matrix), own[1] + sums, own[2] + product
    mask = (1 << _LIMB) - 1
    for length, (n, sums, product) in total.items():
        a, b = np.triu_indices(length)
        i = np.concatenate([[-1], np.arange(length), a])
        j = np.concatenate([[-1], np.full(length, -1), b])
        values = [n, *sums, *product[a, b]]
        yield batch_of(
            _SUMS_ARROW, length=np.full(len(i), length), i=i, j=j, hi=[v >> 2 * _LIMB for v in values], mid=[(v >> _LIMB) & mask for v in values], lo=[v & mask for v in values]
        )


def fit(vectors: DataFrame, vector_col: str = "embedding", components: int = 8) -> dict[int, Whitening]:
    """The whitening of all usable vectors, by vector length.

    Tasks send exact integer sums, added in Spark; to the driver come
    length * (length + 3) / 2 + 1 numbers for each length, whatever the rows.
    V = (n * C - S * S') / n**2 is formed in whole numbers, then rounded once.
    """
    column = F.col(vector_col).cast("array<double>").alias("v")
    parts = vectors.select(column).mapInArrow(_scatters, _SUMS)
    limbs = [F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in ("hi", "mid", "lo")]
    exact: dict[int, dict[tuple[int, int], int]] = {}
    for r in parts.groupBy("length", "i", "j").agg(*limbs).toLocalIterator():
        exact.setdefault(r.length, {})[r.i, r.j] = (int(r.hi) << 2 * _LIMB) + (int(r.mid) << _LIMB) + int(r.lo)
    out = {}
    for length, at in exact.items():
        n, sums = at[-1, -1], [at[i, -1] for i in range(length)]
        v = np.empty((length, length))
        for i in range(length):
            for j in range(i, length):
                v[i, j] = v[j, i] = (n * at[i, j] - sums[i] * sums[j]) / (n * n)
        values, axes = np.linalg.eigh(v)
        order = np.argsort(-values, kind="stable")[:components]
        e, axes = values[order], axes[:, order]
        axes = axes * np.where(axes[np.abs(axes).argmax(axis=0), np.arange(len(order))] < 0, -1.0, 1.0)
        spread = e > max(float(values.max()), 0.0) * length * np.finfo(float).eps
        scales = np.where(spread, 1 / np.sqrt(np.where(spread, e, 1.0)), 0.0)
        trace = float(np.trace(v))
        out[length] = Whitening(n, np.array(sums, object), axes, scales, np.where(spread, e, 0.0) / trace if trace > 0 else np.zeros(len(e)))
    return out


def _whitened(model: Whitening, matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(n * x - S exact, whitened coordinates) of rows."""
    x = fixed_point(matrix)
    most = max(abs(int(x.max())), abs(int(x.min()))) * model.n + max(map(abs, model.sums))
    if most < 1 << 62:
        centred = x * model.n - model.sums.astype(np.int64)
    else:
        centred = x.astype(object) * model.n - model.sums
    return centred, (centred / model.n).astype(np.float64) @ model.components * model.scales


_ERRORS = T.StructType().add("length", "integer").add("i", "integer").add("j", "integer").add("value", "double")
_ERRORS_ARROW = pa.schema([("length", pa.int32()), ("i", pa.int32()), ("j", pa.int32()), ("value", pa.float64())])


def identity_errors(vectors: DataFrame, models: dict[int, Whitening], vector_col: str = "embedding") -> dict[int, float]:
    """By vector length, the largest entry of |covariance of the whitened rows - identity|, measured over all of them.

    Each task sends its rows' scatter about their own mean and what that mean
    adds; components without spread are left out.
    """
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, list] = {}
        for batch in batches:
            for _, matrix in _rows(batch.column(0)):
                w = _whitened(models[matrix.shape[1]], matrix)[1]
                mean = w.mean(axis=0)
                own = total.setdefault(matrix.shape[1], [0.0, 0.0])
                own[0] += len(w) * mean
                own[1] += (w - mean).T @ (w - mean) + len(w) * np.outer(mean, mean)
        for length, (sums, product) in total.items():
            k = len(sums)
            i, j = np.divmod(np.arange(k * k), k)
            yield batch_of(_ERRORS_ARROW, length=np.full(k + k * k, length), i=np.r_[np.arange(k), i], j=np.r_[np.full(k, -1), j], value=np.r_[sums, product.ravel()])

    column = F.col(vector_col).cast("array<double>").alias("v")
    rows = vectors.select(column).mapInArrow(work, _ERRORS).groupBy("length", "i", "j").agg(F.sum("value").alias("value"))
    found: dict[int, dict[tuple[int, int], float]] = {}
    for r in rows.toLocalIterator():
        found.setdefault(r.length, {})[r.i, r.j] = r.value
    out = {}
    for length, at in found.items():
        model = models[length]
        live = np.flatnonzero(model.scales)
        mean = np.array([at[i, -1] for i in live]) / model.n
        cov = np.array([[at[i, j] for j in live] for i in live]).reshape(len(live), len(live)) / model.n - np.outer(mean, mean)
        out[length] = float(np.abs(cov - np.eye(len(live))).max(initial=0.0))
    return out


def whiten(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = 8) -> DataFrame:
    """Rows (<id>, component, n, deviation, distance2, whitened, explained, identity_error), ``components`` of each usable vector.

    Vectors that are null, empty, or hold null or non-finite entries are dropped.
    Entries become x = floor(1024 * c) + 100000; n, S and V are count, sums and
    covariance (divisor n) of all x; components are V's unit eigenvectors, from 1
    by falling eigenvalue e, the largest entry positive.  whitened is x - S/n on
    the component over sqrt(e), explained e / trace(V), identity_error measured
    over all rows.  deviation is the exact sum of (n * x - S)**2 over the
    dimensions, null where that is beyond 64 bits; distance2 is deviation / n**2.

    Vectors of different lengths are fits of their own.  A component without
    spread (fewer different vectors than components) has whitened null and
    explained 0.  Repeated and null ids keep their rows; an empty table gives none.
    """
    models = fit(vectors, vector_col, components)
    errors = identity_errors(vectors, models, vector_col)
    schema = T.StructType([vectors.schema[id_col]]).add("component", "integer").add("n", "long").add("deviation", "long").add("distance2", "double")
    schema = schema.add("whitened", "double").add("explained", "double").add("identity_error", "double")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, matrix in _rows(batch.column(1)):
                length = matrix.shape[1]
                model = models[length]
                centred, w = _whitened(model, matrix)
                as_float = centred.astype(np.float64)
                distance = (as_float * as_float).sum(axis=1)
                if centred.dtype != object and distance.max() < float(1 << 62):
                    deviation = pa.array((centred * centred).sum(axis=1))
                else:
                    exact = [sum(v * v for v in row) for row in centred.astype(object)]
                    deviation = pa.array([v if v < 1 << 63 else None for v in exact], pa.int64())
                k = w.shape[1]
                row = np.repeat(np.arange(len(at)), k)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array(at[row])),
                        pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(at))),
                        pa.array(np.full(len(row), model.n)),
                        deviation.take(pa.array(row)),
                        pa.array((distance / float(model.n) ** 2)[row]),
                        pa.array(w.ravel(), mask=np.tile(model.scales == 0, len(at))),
                        pa.array(np.tile(model.explained, len(at))),
                        pa.array(np.full(len(row), errors[length])),
                    ],
                    names=schema.fieldNames(),
                )

    return vectors.select(F.col(id_col), F.col(vector_col).cast("array<double>").alias("v")).mapInArrow(work, schema)
