"""Shared k-means passes against single fits, dense and sparse rows, odd inputs."""

import pickle

import numpy as np
import pytest
from pyspark import RDD
from pyspark.ml.clustering import KMeans
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from failscope.operators import kmeans as M


def frame(spark, vectors):
    return spark.createDataFrame([(i, v) for i, v in enumerate(vectors)], ["id", "v"])


def plain_cost(x, centres):
    return ((x[:, None, :] - centres[None]) ** 2).sum(axis=2).min(axis=1).sum()


def test_equals_single_fits(spark, monkeypatch):
    """No worse than ten single fits; a start alone gives what it gives among others, in any blocks; costs are those of the centres."""
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(c, 0.3, (60, 4)) for c in rng.uniform(-5, 5, (8, 4))])
    df = frame(spark, [Vectors.dense(r) for r in x])
    seeds = range(42, 52)
    model = M.fit(df, "v", 8, seeds)
    single = [KMeans(k=8, seed=s, maxIter=300, featuresCol="v").fit(df).summary.trainingCost for s in seeds]
    assert model.cost <= min(single) * (1 + 1e-6) and model.cost == min(model.costs) and len(model.costs) == 10
    assert abs(model.cost - plain_cost(x, model.centres)) < 1e-6 * model.cost
    for i in (0, 5):
        assert abs(M.fit(df, "v", 8, [42 + i]).cost - model.costs[i]) < 1e-9 * model.costs[i]
    got = {r.id: r.cluster for r in model.transform(df, "v").collect()}
    assert [got[i] for i in range(len(x))] == ((x[:, None, :] - model.centres[None]) ** 2).sum(axis=2).argmin(axis=1).tolist()
    # Settled centres are the means of their rows.
    for c in range(8):
        assert np.allclose(x[[got[i] == c for i in range(len(x))]].mean(axis=0), model.centres[c], atol=1e-3)


def test_sparse_rows_give_what_dense_rows_give(spark, monkeypatch):
    monkeypatch.setattr(M, "BLOCK_ROWS", 37)
    rng = np.random.default_rng(2)
    x = rng.random((200, 30)) * (rng.random((200, 30)) < 0.2)
    index = [np.flatnonzero(r).tolist() for r in x]
    value = [r[i].tolist() for r, i in zip(x, index)]
    points, label = rng.random((7, 30)), rng.integers(0, 7, 200)
    blocks = [M._block(0, 30, [None] * 200, list(x)), M._block(0, 30, index, value),
              M._block(0, 30, [i if k % 2 else None for k, i in enumerate(index)], [v if k % 2 else r for k, (v, r) in enumerate(zip(value, x))])]
    assert blocks[0].dense is not None and blocks[1].dense is None
    for block in blocks:
        assert np.allclose(block.distances(points), ((x[:, None, :] - points[None]) ** 2).sum(axis=2))
        assert np.allclose(block.sums(label, 7), [x[label == c].sum(axis=0) for c in range(7)])
        assert np.allclose(block.point(5), x[5])
    sparse = M.fit(frame(spark, [Vectors.sparse(30, i, v) for i, v in zip(index, value)]), "v", 4, [1, 2])
    assert abs(sparse.cost - plain_cost(x, sparse.centres)) < 1e-9 * sparse.cost
    again = M.fit(frame(spark, [Vectors.sparse(30, i, v) for i, v in zip(index, value)]), "v", 4, [1, 2])
    assert np.allclose(again.costs, sparse.costs)


def test_first_centres_are_drawn_by_squared_distance(spark):
    """Three heavy groups and one far row: k-means++ takes one of each nearly always."""
    x = [[0.0, 0.0]] * 300 + [[1.0, 0.0]] * 300 + [[0.0, 1.0]] * 300 + [[1000.0, 1000.0]]
    _, blocks, _ = M._blocks(frame(spark, [Vectors.dense(r) for r in x]).repartition(3), "v")
    first = M._first_centres(blocks, 4, range(20))
    assert all(len({tuple(p) for p in start}) == 4 for start in first)


def test_driver_gets_the_same_whatever_the_partitions(spark, monkeypatch):
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(c, 0.3, (100, 40)) for c in rng.uniform(-5, 5, (8, 40))])
    df, plain_collect, most = frame(spark, [Vectors.dense(r) for r in x]), RDD.collect, []

    def collect(self):
        found = plain_collect(self)
        most[-1] = max(most[-1], len(pickle.dumps(found)))
        return found

    monkeypatch.setattr(RDD, "collect", collect)
    costs = []
    for rows in (1 << 15, 40):
        monkeypatch.setattr(M, "FEWEST_ROWS", rows, raising=False)
        monkeypatch.setattr(M, "PARTITION_ROWS", rows)
        most.append(0)
        costs.append(M.fit(df, "v", 8, [1, 2, 3]).cost)
    assert most[1] < 1.2 * most[0] and 0 < max(most) < 1.5 * 3 * 8 * 40 * 8
    assert costs[1] < 1.5 * costs[0]


def test_odd_inputs(spark):
    same = frame(spark, [Vectors.dense([1.0, 2.0])] * 5 + [None])
    model = M.fit(same, "v", 3, [1])
    assert model.cost == 0 and model.transform(same.where("v IS NOT NULL"), "v").where(F.col("cluster").isNull()).count() == 0
    zero = frame(spark, [Vectors.sparse(4, [], []), Vectors.sparse(4, [2], [1.0])] * 3)
    assert M.fit(zero, "v", 2, [1, 2]).cost == 0
    with pytest.raises(ValueError):
        M.fit(same.where("id > 99"), "v", 2, [1])
