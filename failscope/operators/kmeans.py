"""k-means from several starts in shared passes.

All starts read the same blocks at the same time.  Their first centres come from k-means++
over all rows: a pass draws the next centre of every start, each block offering the row that
wins a race of exponential clocks with rates as the squared distances, so the least clock
over all blocks is an exact draw.  Then each pass moves the centres of all live starts; one
whose centres moved less than the tolerance leaves.  A pass is one job: the sums of the
partitions are dealt by start and added, and the driver gets starts x k x columns numbers,
whatever the rows.  Blocks lie in as many partitions as there are cores, or in partitions of
``PARTITION_ROWS`` rows, so that the tasks of a job do not grow with the blocks.

The loop keeps numpy blocks of a written table in a persisted RDD; a lost block is read again.
A cluster that loses all its rows keeps its centre.  With fewer different rows than k some centres coincide.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from failscope.storage import drop, materialize

FEWEST_ROWS, PARTITION_ROWS, BLOCK_ROWS = 1 << 15, 1 << 18, 1 << 12


@dataclass
class Block:
    """Rows as (indptr, index, value); where all values are there (``width`` in each row) they form a matrix."""

    number: int
    width: int
    indptr: np.ndarray
    index: np.ndarray
    value: np.ndarray

    def __post_init__(self) -> None:
        self.n = len(self.indptr) - 1
        self.dense = self.value.reshape(self.n, self.width) if len(self.value) == self.n * self.width else None
        self.row = None if self.dense is not None else np.repeat(np.arange(self.n), np.diff(self.indptr))
        square = self.value ** 2
        self.square = square.reshape(self.n, -1).sum(axis=1) if self.dense is not None else np.bincount(self.row, square, self.n)

    def dots(self, points: np.ndarray) -> np.ndarray:
        """Products of all rows with all points."""
        if self.dense is not None:
            return self.dense @ points.T
        out, by_column = np.zeros((self.n, len(points))), np.ascontiguousarray(points.T)
        step = max(1, (1 << 22) // len(points))
        for i in range(0, len(self.value), step):
            row = self.row[i:i + step]
            first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
            out[row[first]] += np.add.reduceat(self.value[i:i + step, None] * by_column[self.index[i:i + step]], first, axis=0)
        return out

    def distances(self, points: np.ndarray) -> np.ndarray:
        return np.maximum(self.square[:, None] - 2 * self.dots(points) + (points ** 2).sum(axis=1), 0)

    def point(self, i: int) -> np.ndarray:
        out = np.zeros(self.width)
        out[self.index[self.indptr[i]:self.indptr[i + 1]]] = self.value[self.indptr[i]:self.indptr[i + 1]]
        return out

    def sums(self, label: np.ndarray, k: int) -> np.ndarray:
        """Sum of the rows of each label."""
        if self.dense is not None:
            return (label[None, :] == np.arange(k)[:, None]).astype(float) @ self.dense
        return np.bincount(label[self.row] * self.width + self.index, self.value, k * self.width).reshape(k, self.width)


@dataclass
class Centres:
    """The centres of the best start, its cost over the rows, and the cost of every start."""

    centres: np.ndarray
    cost: float
    costs: list[float]
    vector: str

    def clusterCenters(self) -> list[np.ndarray]:  # noqa: N802 (as Spark's models name it)
        return list(self.centres)

    def transform(self, df: DataFrame, vector: str | None = None, name: str = "cluster") -> DataFrame:
        """The number of the centre nearest to each row's vector (by default the column of the fit)."""
        centres = self.centres

        def run(index: pd.Series, value: pd.Series) -> pd.Series:
            return pd.Series(_block(0, centres.shape[1], index.tolist(), value.tolist()).distances(centres).argmin(axis=1).astype(np.int32))

        return df.withColumn(name, F.pandas_udf(run, "int")(*_parts(vector or self.vector)))


def _parts(vector: str) -> tuple[Column, Column]:
    parts = F.unwrap_udt(vector)
    return parts["indices"], parts["values"]


def _block(number: int, width: int, index: list, value: list) -> Block:
    value = [np.asarray(v, float) for v in value]
    index = [np.arange(len(v)) if i is None else np.asarray(i, np.int64) for i, v in zip(index, value)]
    # A sparse vector without entries gives an empty list of floats.
    join = lambda parts, kind: np.concatenate(parts).astype(kind) if parts else np.zeros(0, kind)
    return Block(number, width, np.r_[0, np.cumsum([len(v) for v in value])].astype(np.int64), join(index, np.int64), join(value, float))


def _blocks(df: DataFrame, vector: str):
    """The written rows and, over them, a persisted RDD of blocks, the number of columns."""
    index, value = _parts(vector)
    parts = F.unwrap_udt(vector)
    rows = materialize(df.where(F.col(vector).isNotNull()).select(
        index.alias("index"), value.alias("value"), F.coalesce(parts["size"], F.size(parts["values"])).alias("size")), "points")
    n, width = rows.agg(F.count(F.lit(1)), F.max("size")).first()
    if not n:
        raise ValueError("no rows to cluster")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, len(batch), BLOCK_ROWS):
                part = batch.slice(i, BLOCK_ROWS)
                b = _block(0, width, part.column(0).to_pylist(), part.column(1).to_pylist())
                yield pa.record_batch({name: pa.array([array.tobytes()]) for name, array in (("indptr", b.indptr), ("index", b.index), ("value", b.value))})

    # Dealt evenly, whatever repeats, and ordered, as draws go by a row's place in its block.
    cores = df.sparkSession.sparkContext.defaultParallelism
    partitions = max(1, min(-(-n // FEWEST_ROWS), max(cores, -(-n // PARTITION_ROWS))))
    dealt = rows.select("index", "value").repartition(partitions).sortWithinPartitions("index", "value")
    packed = dealt.mapInArrow(pack, "indptr binary, index binary, value binary")
    table = materialize(packed.select(F.monotonically_increasing_id().alias("number"), "*"), "blocks")
    drop(rows)
    blocks = table.rdd.map(lambda r: Block(
        r["number"], width, np.frombuffer(r["indptr"], np.int64), np.frombuffer(r["index"], np.int64), np.frombuffer(r["value"])))
    return table, blocks.persist(StorageLevel.MEMORY_AND_DISK), width


def _reduced(parts, add, starts: int) -> list:
    """What the partitions say of each start, put together among the tasks, in the order of the starts."""
    many = parts.getNumPartitions()
    return [x for _, x in sorted((parts.reduceByKey(add, min(starts, many)) if many > 1 else parts).collect(), key=lambda pair: pair[0])]


def _first_centres(blocks, k: int, seeds: Sequence[int]) -> np.ndarray:
    """Centres (start, k, column) by k-means++ over all rows."""
    chosen: np.ndarray | None = None
    for step in range(k):
        def offer(part, chosen=chosen, step=step):
            best = [(np.inf, None)] * len(seeds)
            for block in part:
                for s, seed in enumerate(seeds):
                    far = np.ones(block.n) if chosen is None else block.distances(chosen[s]).min(axis=1)
                    clock = np.random.default_rng([seed, step, block.number]).exponential(size=block.n)
                    with np.errstate(divide="ignore"):
                        clock = np.where(far > 0, clock / far, 1e300 * (1 + clock))
                    i = int(clock.argmin())
                    if clock[i] < best[s][0]:
                        best[s] = (clock[i], block.point(i))
            return list(enumerate(best))

        won = _reduced(blocks.mapPartitions(offer), lambda a, b: min(a, b, key=lambda o: o[0]), len(seeds))
        drawn = np.array([point for _, point in won])[:, None, :]
        chosen = drawn if chosen is None else np.concatenate([chosen, drawn], axis=1)
    return chosen


def fit(df: DataFrame, vector: str, k: int, seeds: Sequence[int], max_iter: int = 300, tolerance: float = 1e-4) -> Centres:
    """The best of the starts, each moved until no centre moves more than ``tolerance``, or ``max_iter`` times."""
    table, blocks, width = _blocks(df, vector)
    centres = _first_centres(blocks, k, seeds)
    costs, live = np.full(len(seeds), np.inf), np.arange(len(seeds))
    for moved in range(max_iter + 1):
        def step(part, points=centres[live]):
            sums, counts, cost = np.zeros(points.shape), np.zeros(points.shape[:2]), np.zeros(len(points))
            for block in part:
                far = block.distances(points.reshape(-1, width)).reshape(block.n, *points.shape[:2])
                label = far.argmin(axis=2)
                cost += far.min(axis=2).sum(axis=0)
                for s in range(len(points)):
                    sums[s] += block.sums(label[:, s], k)
                    counts[s] += np.bincount(label[:, s], minlength=k)
            return list(enumerate(zip(sums, counts, cost)))

        found = _reduced(blocks.mapPartitions(step), lambda a, b: tuple(x + y for x, y in zip(a, b)), len(live))
        sums, counts, cost = map(np.array, zip(*found))
        costs[live] = cost
        if moved == max_iter:
            break
        after = np.where(counts[:, :, None] > 0, sums / np.maximum(counts, 1)[:, :, None], centres[live])
        shift = np.sqrt(((after - centres[live]) ** 2).sum(axis=2)).max(axis=1)
        # A settled start keeps the centres whose cost is known.
        going = shift > tolerance
        centres[live[going]] = after[going]
        live = live[going]
        if not len(live):
            break
    blocks.unpersist()
    drop(table)
    best = int(costs.argmin())
    return Centres(centres[best], float(costs[best]), costs.tolist(), vector)
