"""Leading principal axes of wide, sparse vectors.

A block Krylov method: a random block of columns x (k + 10) numbers is multiplied with the
rows and back, and the axes are the Ritz vectors in the space that the blocks span.  A pass
sends, for each task, sums for the columns that its rows hold, in blocks of columns; the
driver keeps a few blocks of columns x (k + 10) numbers (16 MB each at 200,000 columns) and
never columns x columns.  Passes end when the residual of the wanted axes is ``TOLERANCE``
of the largest variance, or after ``PASSES``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

EXTRA = 10
PASSES, TOLERANCE = 60, 1e-9
#: Blocks of the space that are kept before it is cut back to the leading Ritz vectors.
KEPT = 5
_COLUMNS = 1 << 12


def sparse_rows(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, column and value of the entries of vectors (as their struct of type, size, indices, values)."""
    kind, indices, values = (column.field(n) for n in ("type", "indices", "values"))
    many = np.asarray(pc.fill_null(pc.list_value_length(values), 0))
    row = np.repeat(np.arange(len(column)), many)
    value = values.flatten().to_numpy(zero_copy_only=False)
    # A dense vector has no indices: its entries count up.
    dense = np.repeat(kind.to_numpy(zero_copy_only=False) == 1, many)
    at = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
    at[~dense] = indices.flatten().to_numpy(zero_copy_only=False)
    return row, at, value


def _times(row: np.ndarray, at: np.ndarray, value: np.ndarray, block: np.ndarray, rows: int) -> np.ndarray:
    return np.column_stack([np.bincount(row, value * b[at], rows) for b in block.T]) if block.shape[1] else np.zeros((rows, 0))


def _summed(parts: DataFrame, columns: int, width: int) -> np.ndarray:
    """Sums over all tasks of rows (place, data), a block of columns each."""

    def add(group: pa.Table) -> pa.Table:
        total = np.sum([np.frombuffer(x, float) for x in group["data"].to_pylist()], axis=0)
        return pa.table({"place": group["place"][:1], "data": pa.array([total.tobytes()], pa.binary())})

    got = parts.groupBy("place").applyInArrow(add, "place int, data binary").toArrow()
    out = np.zeros((columns, width))
    for place, data in zip(got["place"].to_pylist(), got["data"].to_pylist()):
        part = out[place * _COLUMNS:(place + 1) * _COLUMNS]
        part += np.frombuffer(data, float).reshape(-1, width)[:len(part)]
    return out


def _emit(total: np.ndarray) -> Iterator[pa.RecordBatch]:
    for place in range(-(-len(total) // _COLUMNS)):
        part = np.zeros((_COLUMNS, total.shape[1]))
        here = total[place * _COLUMNS:(place + 1) * _COLUMNS]
        part[:len(here)] = here
        if part.any():
            yield pa.record_batch({"place": pa.array([place], pa.int32()), "data": pa.array([part.tobytes()], pa.binary())})


def moments(vectors: DataFrame, columns: int) -> np.ndarray:
    """Sum and sum of squares of each column. ``vectors`` has the struct of the vector as its only column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((columns, 2))
        for batch in batches:
            _, at, value = sparse_rows(batch.column(0))
            total += np.column_stack([np.bincount(at, value, columns), np.bincount(at, value * value, columns)])
        yield from _emit(total)

    return _summed(vectors.mapInArrow(run, "place int, data binary"), columns, 2)


def scatter_times(vectors: DataFrame, block: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """The scatter matrix of the centred, scaled vectors times ``block``; one pass."""
    columns, width = block.shape
    scaled, shift = block * scale[:, None], (mean * scale) @ block

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((columns, width))
        for batch in batches:
            row, at, value = sparse_rows(batch.column(0))
            z = _times(row, at, value, scaled, len(batch)) - shift
            for k in range(width):
                total[:, k] += np.bincount(at, value * z[row, k], columns)
        yield from _emit(total)

    # The centred coordinates add up to zero, so the mean has no part in the way back.
    return _summed(vectors.mapInArrow(run, "place int, data binary"), columns, width) * scale[:, None]


def _orthogonal(block: np.ndarray, against: np.ndarray, floor: float) -> np.ndarray:
    """An orthonormal base of what ``block`` adds to ``against``."""
    for _ in range(2):
        block = block - against @ (against.T @ block)
    u, s, _ = np.linalg.svd(block, full_matrices=False)
    u = u[:, s > floor]
    u = u - against @ (against.T @ u)
    return np.linalg.qr(u)[0] if u.shape[1] else u


@dataclass
class Axes:
    mean: np.ndarray
    scale: np.ndarray
    axes: np.ndarray
    variances: np.ndarray
    passes: int

    def coordinates(self, vector: str, names: list[str]):
        """A column with a struct of the coordinates of a vector."""
        scaled, shift = self.axes * self.scale[:, None], (self.mean * self.scale) @ self.axes

        @F.arrow_udf("struct<" + ", ".join(f"{n}: double" for n in names) + ">")
        def run(x: pa.Array) -> pa.Array:
            z = _times(*sparse_rows(x), scaled, len(x)) - shift
            return pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(c)) for c in z.T], names=names)

        return run(F.unwrap_udt(vector))


def leading_axes(df: DataFrame, vector: str, k: int = 2, standardise: bool = False, seed: int = 42) -> Axes:
    """The ``k`` axes of the largest variance; missing ones (of fewer columns or rows) are zero.

    ``df`` is read once for each pass and should be written or cheap. An axis points to where its largest number is positive.
    """
    vectors = df.select(F.unwrap_udt(vector).alias("v"))
    row = vectors.agg(F.count(F.lit(1)), F.max(F.coalesce(F.col("v.size"), F.size("v.values")))).first()
    n, columns = int(row[0]), int(row[1] or 0)
    if not columns:
        return Axes(np.zeros(0), np.zeros(0), np.zeros((0, k)), np.zeros(k), 0)
    found = moments(vectors, columns) / n
    mean = found[:, 0]
    spread = np.sqrt(np.maximum(found[:, 1] - mean * mean, 0))
    spread[spread <= 1e-12 * np.sqrt(found[:, 1])] = 0  # a constant column
    scale = np.where(spread > 0, 1 / np.where(spread > 0, spread, 1), 0.0) if standardise else np.ones(columns)
    width = min(k + EXTRA, columns)
    base = np.zeros((columns, 0))
    image, new = base, np.linalg.qr(np.random.default_rng(seed).normal(size=(columns, width)))[0]
    for passes in range(1, PASSES + 1):
        image = np.hstack([image, scatter_times(vectors, new, mean, scale)])
        base = np.hstack([base, new])
        small = base.T @ image
        values, turn = np.linalg.eigh((small + small.T) / 2)
        turn, values = turn[:, ::-1][:, :width], values[::-1][:width]
        ritz, there = base @ turn, image @ turn
        rest = there - ritz * values
        if (np.linalg.norm(rest[:, :k], axis=0) <= TOLERANCE * max(values[0], 1e-300)).all():
            break
        new = _orthogonal(rest, base, TOLERANCE * 1e-3 * max(values[0], 1e-300))
        if not new.shape[1]:
            break
        if base.shape[1] >= KEPT * width:
            # The leading vectors and their images, by the same turn: no pass is needed.
            base, image = ritz, there
    axes = np.zeros((columns, k))
    axes[:, :min(k, width)] = ritz[:, :k] * (values[:k] > 0)
    axes *= np.where(np.take_along_axis(axes, np.abs(axes).argmax(axis=0)[None], 0) < 0, -1.0, 1.0)
    variances = np.zeros(k)
    variances[:min(k, width)] = np.maximum(values[:k], 0) / n
    return Axes(mean, scale, axes, variances, passes)
