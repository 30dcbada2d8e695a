"""Gradient-boosted trees by Newton steps on binned histograms.

Features are cut at their quantiles once (at most ``BINS`` bins) and the rows kept as blocks
of at most ``BLOCK_ROWS`` rows of one byte a feature, in a written table.  For each level of a
tree every block adds up the gradients of its rows by (node, feature, bin); the best split of
each (node, feature) is chosen from the sums of all blocks.  Leaves come from the sums of the
last level.  Columns are sampled for each tree, rows for each tree by a seed of their
block, leaves are shrunk by ``l2``.

Up to ``TASK_CELLS`` rows x features one task holds the blocks (a byte for each feature of
a row and some 40 bytes beside) and grows all trees, since a job for each level would wait for
Spark most of the time; the driver sees the trees alone.  Beyond, each level is one job over
persisted blocks: the sums are dealt by feature and added, and the driver sees the best split
of each (node, feature) alone, whatever the rows and bins.  Blocks lie in as many partitions
as there are cores, or in partitions of ``PART_ROWS`` rows, so that the tasks of a job do not
grow with the blocks.  A lost block is read again and its margins are computed again from the
trees; margins are written every ``WRITE`` rounds, so that lineage does not grow with the rounds.

Null and NaN features count as 0.  Without rows the model has no trees and scores 0.5.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from failscope.storage import drop, materialize

BINS, BLOCK_ROWS = 256, 1 << 14
PART_ROWS = 1 << 21
#: Rows x features up to which one task holds all blocks and grows all trees.
TASK_CELLS = 1 << 25
WRITE = 40
_LEAST_GAIN = 1e-6


@dataclass
class Tree:
    """Nodes in arrays; a row goes left where its feature is below the threshold (its bin at most ``bin``). A leaf's children are itself."""

    feature: np.ndarray
    bin: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    gain: np.ndarray

    def leaves(self, depth: int, goes_left) -> np.ndarray:
        """The leaf of each row; ``goes_left(nodes)`` decides for the node that each row is at."""
        at = 0
        for _ in range(depth):
            at = np.where(goes_left(at), self.left[at], self.right[at])
        return at

    def step(self, at: np.ndarray, bins: np.ndarray) -> np.ndarray:
        """The node after this one of each row; a leaf's rows stay. Right children follow the left ones."""
        place = (self.feature * bins.shape[1])[at]
        place += np.arange(bins.shape[1])
        last = np.where(self.left == np.arange(len(self.left)), 255, self.bin).astype(np.uint8)
        return self.left[at] + (bins.reshape(-1)[place] > last[at])

    def binned(self, depth: int, bins: np.ndarray) -> np.ndarray:
        at = np.zeros(bins.shape[1], np.int64)
        for _ in range(depth):
            at = self.step(at, bins)
        return at


@dataclass
class BoostedTrees:
    features: list[str]
    depth: int
    trees: list[Tree] = field(default_factory=list)

    def margin(self, x: np.ndarray) -> np.ndarray:
        rows, total = np.arange(len(x)), np.zeros(len(x))
        for tree in self.trees:
            total += tree.value[tree.leaves(self.depth, lambda at: x[rows, tree.feature[at]] < tree.threshold[at])]
        return total

    def score(self, df: DataFrame, name: str = "pred_prob") -> DataFrame:
        """The frame with the probability of the positive class."""

        def run(*columns: pd.Series) -> pd.Series:
            x = np.nan_to_num(np.column_stack([c.to_numpy(float, na_value=0.0) for c in columns]))
            return pd.Series(1 / (1 + np.exp(-self.margin(x))))

        run.__annotations__ = {"return": pd.Series, "columns": pd.Series}
        return df.withColumn(name, F.pandas_udf(run, "double")(*[F.col(f"`{c}`").cast("double") for c in self.features]))

    def importance(self) -> np.ndarray:
        """Mean gain of the splits by each feature, as shares."""
        gain, splits = np.zeros(len(self.features)), np.zeros(len(self.features))
        for tree in self.trees:
            inner = tree.left != np.arange(len(tree.left))
            np.add.at(gain, tree.feature[inner], tree.gain[inner])
            np.add.at(splits, tree.feature[inner], 1)
        mean = gain / np.maximum(splits, 1)
        return mean / mean.sum() if mean.sum() > 0 else mean

    def save(self, spark, path: str) -> None:
        names = list(Tree.__dataclass_fields__)
        parts = [pa.table({"tree": np.full(len(t.left), i, np.int64), "node": np.arange(len(t.left)), **{n: getattr(t, n) for n in names}})
                 for i, t in enumerate(self.trees)]
        shape = pa.schema([("tree", pa.int64()), ("node", pa.int64()), *[(n, pa.int64() if n in ("feature", "bin", "left", "right") else pa.float64()) for n in names]])
        nodes = pa.concat_tables([p.cast(shape) for p in parts]) if parts else shape.empty_table()
        spark.createDataFrame(nodes).write.mode("overwrite").parquet(f"{path}/nodes")
        spark.createDataFrame([(i, n, self.depth) for i, n in enumerate(self.features)], "place int, feature string, depth int").write.mode(
            "overwrite").parquet(f"{path}/features")

    @staticmethod
    def load(spark, path: str) -> BoostedTrees:
        features = spark.read.parquet(f"{path}/features").toArrow().sort_by("place")
        nodes = spark.read.parquet(f"{path}/nodes").toArrow().sort_by([("tree", "ascending"), ("node", "ascending")])
        tree, names = nodes["tree"].to_numpy(), list(Tree.__dataclass_fields__)
        cuts = np.flatnonzero(np.diff(tree)) + 1
        columns = [np.split(nodes[n].to_numpy(), cuts) if len(tree) else [] for n in names]
        return BoostedTrees(features["feature"].to_pylist(), features["depth"][0].as_py(), [Tree(*arrays) for arrays in zip(*columns)])


def cut_points(df: DataFrame, features: Sequence[str], bins: int = BINS) -> list[np.ndarray]:
    """Values at which each feature's bins end, from one pass; a feature of few values is cut between all of them."""
    steps = F.array(*[F.lit(i / bins) for i in range(1, bins)])
    found = df.agg(*[F.percentile_approx(c, steps, 10_000).alias(f"q{i}") for i, c in enumerate(features)],
                   *[F.min(c).alias(f"m{i}") for i, c in enumerate(features)]).first()
    return [np.setdiff1d(np.array(found[f"q{i}"] or [], float), [found[f"m{i}"]]) for i in range(len(features))]


def partitions_for(df: DataFrame, n: int, block_rows: int, part_rows: int = PART_ROWS) -> int:
    """One partition a core, fewer if there are fewer blocks, more beyond ``part_rows`` rows in each."""
    return max(1, min(-(-n // block_rows), max(df.sparkSession.sparkContext.defaultParallelism, -(-n // part_rows))))


def _blocks(df: DataFrame, features: Sequence[str], target: str, cuts: list[np.ndarray], n: int, block_rows: int) -> DataFrame:
    """Written rows (block, n, bins, label, margin): the rows dealt evenly, a byte for each feature of each row."""
    count = len(features)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def block(held: list[pa.RecordBatch]) -> pa.RecordBatch:
            table = pa.Table.from_batches(held)
            bins = np.array([np.searchsorted(cuts[i], table.column(i).to_numpy(), side="right") for i in range(count)], np.uint8)
            label = table.column(count).to_numpy().astype(np.uint8)
            return pa.record_batch({"n": pa.array([len(table)]), "bins": pa.array([bins.tobytes()]), "label": pa.array([label.tobytes()]),
                                    "margin": pa.array([np.zeros(len(table)).tobytes()])})

        held: list[pa.RecordBatch] = []
        for batch in batches:
            for i in range(0, len(batch), block_rows):
                part = batch.slice(i, block_rows)
                if held and sum(map(len, held)) + len(part) > block_rows:
                    yield block(held)
                    held = []
                held.append(part)
        if held:
            yield block(held)

    rows = df.select(*features, F.col(target).cast("int").alias("y")).repartition(partitions_for(df, n, block_rows)).sortWithinPartitions(*features, "y")
    packed = rows.mapInArrow(pack, "n bigint, bins binary, label binary, margin binary")
    return materialize(packed.select(F.monotonically_increasing_id().alias("block"), "*"), "blocks")


_SHAPE = "block bigint, n bigint, bins binary, label binary, margin binary"


def _read(table: DataFrame, features: int):
    """Blocks (number, bins by feature, labels, margins)."""
    return table.rdd.map(lambda r: (r.block, np.frombuffer(r.bins, np.uint8).reshape(features, r.n), np.frombuffer(r.label, np.uint8), np.frombuffer(r.margin)))


@dataclass
class Plan:
    """How trees are grown; a bin is cut off by each of a feature's ``cuts``."""

    cuts: list[np.ndarray]
    depth: int
    rate: float
    row_share: float
    column_share: float
    positive_weight: float
    l2: float
    least_weight: float
    bins: int
    seed: int

    def columns(self, number: int) -> np.ndarray:
        """The columns of a tree."""
        count = len(self.cuts)
        return np.sort(np.random.default_rng([self.seed, number]).choice(count, max(1, int(self.column_share * count)), replace=False))

    def gradients(self, number: int, key: int, y: np.ndarray, margin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Gradients and curvatures of a block for a tree, 0 for the rows that it does not draw."""
        p = 1 / (1 + np.exp(-margin))
        w = np.where(y == 1, self.positive_weight, 1.0)
        w[np.random.default_rng([self.seed, number, key]).random(len(y)) >= self.row_share] = 0
        return (p - y) * w, np.maximum(p * (1 - p), 1e-16) * w

    def cut(self, i: int, sums: np.ndarray, columns: np.ndarray, many: int) -> tuple[int, dict[str, np.ndarray]]:
        """The best splits by the i-th of the columns."""
        return i, _best_cuts(sums, many, len(self.cuts[columns[i]]), self.l2, self.least_weight)


def _sums(x: np.ndarray, g: np.ndarray, h: np.ndarray, at: np.ndarray, tree: Tree, nodes: np.ndarray, columns: np.ndarray, bins: int) -> np.ndarray:
    """Gradients and curvatures of a block by (node of the level, column, bin)."""
    many = len(nodes)
    # Rows that rest in a leaf are added up behind the others.
    place = np.full(len(tree.left), many)
    place[nodes] = np.arange(many)
    out, base, size = np.empty((len(columns), 2, many * bins)), (place * bins)[at], many * bins
    for i, c in enumerate(columns):
        cell = base + x[c]
        out[i, 0] = np.bincount(cell, g, size + bins)[:size]
        out[i, 1] = np.bincount(cell, h, size + bins)[:size]
    return out


def _best_cuts(sums: np.ndarray, nodes: int, cuts: int, l2: float, least_weight: float) -> dict[str, np.ndarray]:
    """For each node its sums over a column's bins and the best split by this column: gain, bin and the sums to its left."""
    by_node = sums.reshape(2, nodes, -1).transpose(1, 0, 2)  # node, (g, h), bin
    total = by_node.sum(axis=2)
    left = np.cumsum(by_node, axis=2)[..., :-1]
    right = total[..., None] - left
    part = lambda s: s[:, 0] ** 2 / (s[:, 1] + l2)
    gain = part(left) + part(right) - part(total)[:, None]
    allowed = (np.arange(left.shape[2]) < cuts) & (left[:, 1] >= least_weight) & (right[:, 1] >= least_weight)
    gain = np.where(allowed, gain, -np.inf)
    best, each = gain.argmax(axis=1), np.arange(nodes)
    return {"total": total, "gain": gain[each, best], "bin": best, "left": left[each, :, best]}


def _best_splits(found: Iterable[tuple[int, dict[str, np.ndarray]]]) -> dict[str, np.ndarray]:
    """For each node its sums and its best split over all columns, the first of equal ones."""
    by_column = [cuts for _, cuts in sorted(found, key=lambda pair: pair[0])]
    column = np.array([cuts["gain"] for cuts in by_column]).argmax(axis=0)
    each = np.arange(len(column))
    chosen = {name: np.array([cuts[name] for cuts in by_column])[column, each] for name in ("gain", "bin", "left")}
    return {"total": by_column[0]["total"], "column": column, **chosen}


def fit(df: DataFrame, features: Sequence[str], target: str, rounds: int = 400, depth: int = 6, rate: float = 0.05, row_share: float = 0.9,
        column_share: float = 0.8, positive_weight: float = 1.0, l2: float = 1.0, least_weight: float = 1.0, bins: int = BINS, seed: int = 42,
        block_rows: int = BLOCK_ROWS) -> BoostedTrees:
    """Trees for the 0/1 target by Newton steps on the logistic loss; rows without a target are left out."""
    if bins > 256:
        raise ValueError("a bin is a byte: 256 at most")
    clean = df.where(F.col(target).isNotNull()).select(
        *[F.coalesce(F.nanvl(F.col(f"`{c}`").cast("double"), F.lit(0.0)), F.lit(0.0)).alias(f"f{i}") for i, c in enumerate(features)], target)
    names, model = [f"f{i}" for i in range(len(features))], BoostedTrees(list(features), depth)
    clean = materialize(clean, "boosting-rows")
    n = clean.count()
    if not n or not features:
        return model
    cuts = cut_points(clean, names, bins)
    table = _blocks(clean, names, target, cuts, n, block_rows)
    drop(clean)
    plan = Plan(cuts, depth, rate, row_share, column_share, positive_weight, l2, least_weight, bins, seed)
    if n * len(features) <= TASK_CELLS:
        model.trees = _read(table, len(features)).coalesce(1).mapPartitions(lambda blocks: _in_a_task(blocks, rounds, plan)).collect()
    else:
        table = _by_jobs(table, rounds, plan, model.trees)
    drop(table)
    return model


def _in_a_task(blocks: Iterable[tuple], rounds: int, plan: Plan) -> Iterator[Tree]:
    """All trees over blocks that a single task holds."""
    held, margins = [], []
    for key, x, y, margin in sorted(blocks, key=lambda block: block[0]):
        held.append((key, x, y))
        margins.append(np.array(margin))
    for number in range(rounds):
        pulls = [plan.gradients(number, key, y, margin) for (key, _, y), margin in zip(held, margins)]
        at = [np.zeros(len(y), np.int64) for _, _, y in held]

        def found(tree: Tree, level: int, nodes: np.ndarray, columns: np.ndarray) -> dict[str, np.ndarray]:
            total = 0
            for i, (_, x, _) in enumerate(held):
                if level:
                    at[i] = tree.step(at[i], x)
                total = total + _sums(x, *pulls[i], at[i], tree, nodes, columns, plan.bins)
            return _best_splits(plan.cut(i, sums, columns, len(nodes)) for i, sums in enumerate(total))

        tree = _grow(found, number, plan)
        for i, (_, x, _) in enumerate(held):
            margins[i] += tree.value[tree.step(at[i], x)]
        yield tree


def _by_jobs(table: DataFrame, rounds: int, plan: Plan, trees: list[Tree]) -> DataFrame:
    """All trees, a job for each level; gives back the last written blocks.

    A tree is added to the margins by the first job of the next one, which keeps them.
    """
    count = len(plan.cuts)
    state, old = _read(table, count).persist(StorageLevel.MEMORY_AND_DISK), None
    for number in range(rounds):
        def found(tree: Tree, level: int, nodes: np.ndarray, columns: np.ndarray, state=state, number=number) -> dict[str, np.ndarray]:
            def job(blocks):
                total = 0
                for key, x, y, margin in blocks:
                    total = total + _sums(x, *plan.gradients(number, key, y, margin), tree.binned(level, x), tree, nodes, columns, plan.bins)
                return list(enumerate(total)) if not np.isscalar(total) else []

            parts = state.mapPartitions(job)
            if state.getNumPartitions() > 1:
                parts = parts.reduceByKey(np.add, min(len(columns), state.getNumPartitions()))
            return _best_splits(parts.map(lambda pair: plan.cut(*pair, columns, len(nodes))).collect())

        tree = _grow(found, number, plan)
        trees.append(tree)
        if old is not None:
            old.unpersist()
        old, state = state, state.map(lambda b, tree=tree: (*b[:3], b[3] + tree.value[tree.binned(plan.depth, b[1])]))
        if (number + 1) % WRITE:
            state = state.persist(StorageLevel.MEMORY_AND_DISK)
        else:
            rows = state.map(lambda b: (b[0], len(b[2]), b[1].tobytes(), b[2].tobytes(), b[3].tobytes()))
            written, table = table, materialize(table.sparkSession.createDataFrame(rows, _SHAPE), "blocks")
            old.unpersist()
            old, state = None, _read(table, count).persist(StorageLevel.MEMORY_AND_DISK)
            state.count()
            drop(written)
    for kept in (old, state):
        if kept is not None:
            kept.unpersist()
    return table


def _grow(found_by: Callable[..., dict[str, np.ndarray]], number: int, plan: Plan) -> Tree:
    """One tree; ``found_by(tree, level, nodes, columns)`` gives the best splits of a level's nodes."""
    size, columns = (1 << (plan.depth + 1)) - 1, plan.columns(number)
    tree = Tree(np.zeros(size, np.int64), np.zeros(size, np.int64), np.zeros(size), np.arange(size), np.arange(size), np.zeros(size), np.zeros(size))
    nodes, used = np.zeros(1, np.int64), 1
    for level in range(plan.depth):
        found = found_by(tree, level, nodes, columns)
        leaf = lambda s: -plan.rate * s[..., 0] / (s[..., 1] + plan.l2)
        if not level:
            tree.value[0] = leaf(found["total"])[0]
        split = np.flatnonzero(found["gain"] > _LEAST_GAIN)
        at = nodes[split]
        left = used + 2 * np.arange(len(split))
        tree.feature[at], tree.bin[at] = columns[found["column"][split]], found["bin"][split]
        tree.threshold[at] = [plan.cuts[f][b] for f, b in zip(tree.feature[at], tree.bin[at])]
        tree.left[at], tree.right[at], tree.gain[at] = left, left + 1, found["gain"][split]
        tree.value[left], tree.value[left + 1] = leaf(found["left"][split]), leaf(found["total"][split] - found["left"][split])
        nodes, used = np.concatenate([left, left + 1]), used + 2 * len(split)
        nodes.sort()
        if not len(nodes):
            break
    return Tree(*[getattr(tree, name)[:used] for name in Tree.__dataclass_fields__])
