"""Boosted trees against a plain version that looks at every value, held-out ranking, odd inputs, saved models."""

import pickle

import numpy as np
import pytest
from pyspark import RDD
from pyspark.sql import functions as F

from failscope.operators import boosting as B


def plain(x, y, rounds, depth, rate, weight, l2=1.0, least=1.0):
    """Exact greedy Newton boosting without sampling: margins of the rows and a function for others."""
    w, margin, trees = np.where(y == 1, weight, 1.0), np.zeros(len(y)), []

    def grow(rows, level, g, h):
        G, H = g[rows].sum(), h[rows].sum()
        best = (1e-6, None)
        if level < depth:
            for f in range(x.shape[1]):
                values = np.unique(x[rows, f])
                for cut in values[1:]:
                    left = rows[x[rows, f] < cut]
                    a, b = g[left].sum(), h[left].sum()
                    if b >= least and H - b >= least:
                        gain = a * a / (b + l2) + (G - a) ** 2 / (H - b + l2) - G * G / (H + l2)
                        if gain > best[0] + 1e-9:
                            best = (gain, (f, cut))
        if best[1] is None:
            return -rate * G / (H + l2)
        f, cut = best[1]
        return f, cut, grow(rows[x[rows, f] < cut], level + 1, g, h), grow(rows[x[rows, f] >= cut], level + 1, g, h)

    def value(tree, row):
        while isinstance(tree, tuple):
            tree = tree[2] if row[tree[0]] < tree[1] else tree[3]
        return tree

    for _ in range(rounds):
        p = 1 / (1 + np.exp(-margin))
        trees.append(grow(np.arange(len(y)), 0, (p - y) * w, p * (1 - p) * w))
        margin += [value(trees[-1], row) for row in x]
    return lambda z: np.array([sum(value(t, row) for t in trees) for row in z])


def auc(y, s):
    order = np.argsort(s)
    rank = np.empty(len(s))
    rank[order] = np.arange(1, len(s) + 1)
    return (rank[y == 1].sum() - (y == 1).sum() * ((y == 1).sum() + 1) / 2) / ((y == 1).sum() * (y == 0).sum())


def sample(rng, n):
    x = np.column_stack([rng.integers(0, 40, n), rng.random(n).round(3), rng.integers(0, 3, n), rng.random(n)])
    p = 1 / (1 + np.exp(-(0.15 * (x[:, 0] - 20) + 2 * (x[:, 1] > 0.5) * (x[:, 2] == 1) - 0.5)))
    return x, (rng.random(n) < p).astype(int)


def frame(spark, x, y):
    return spark.createDataFrame([(i, *map(float, r), int(t)) for i, (r, t) in enumerate(zip(x, y))], "id long, a double, b double, `c.d` double, e double, y int")


FEATURES = ["a", "b", "c.d", "e"]


def scores(model, df):
    return np.array([r.pred_prob for r in model.score(df).orderBy("id").collect()])


def test_equals_the_plain_version_on_few_values(spark):
    """Every value has a bin of its own, so the trees are the exact greedy ones, in any number of blocks."""
    rng = np.random.default_rng(1)
    x, y = sample(rng, 300)
    x[:, 1], x[:, 3] = (x[:, 1] * 30).round(), (x[:, 3] * 50).round() + 0.25
    df = frame(spark, x, y)
    want = 1 / (1 + np.exp(-plain(x, y, 12, 3, 0.3, 2.0)(x)))
    for block_rows in (1 << 16, 50):
        model = B.fit(df, FEATURES, "y", rounds=12, depth=3, rate=0.3, row_share=1.0, column_share=1.0, positive_weight=2.0, block_rows=block_rows)
        assert np.allclose(scores(model, df), want, atol=1e-6)
        assert np.allclose(1 / (1 + np.exp(-model.margin(x))), want, atol=1e-6)


def test_ranks_held_out_rows_like_the_plain_version(spark):
    rng = np.random.default_rng(2)
    x, y = sample(rng, 2500)
    train, held = frame(spark, x[:1000], y[:1000]), frame(spark, x[1000:], y[1000:])
    model = B.fit(train, FEATURES, "y", rounds=40, depth=3, rate=0.1, bins=32)
    exact = plain(x[:1000], y[:1000], 40, 3, 0.1, 1.0)(x[1000:])
    ours = scores(model, held)
    assert auc(y[1000:], ours) > auc(y[1000:], exact) - 0.01 > 0.75
    assert abs(np.mean(ours) - np.mean(y[1000:])) < 0.05
    shares = dict(zip(FEATURES, model.importance()))
    assert abs(sum(shares.values()) - 1) < 1e-9 and shares["e"] < min(shares["a"], shares["b"], shares["c.d"])


def test_columns_are_sampled_by_tree_and_jobs_by_level(spark):
    rng = np.random.default_rng(3)
    x, y = sample(rng, 400)
    model = B.fit(frame(spark, x, y), FEATURES, "y", rounds=30, depth=4, column_share=0.5, bins=16)
    used = [set(t.feature[t.left != np.arange(len(t.left))].tolist()) for t in model.trees]
    assert max(map(len, used)) == 2 and set().union(*used) == {0, 1, 2, 3}
    again = B.fit(frame(spark, x, y).repartition(5), FEATURES, "y", rounds=3, depth=4, column_share=0.5, bins=16)
    assert len(again.trees) == 3


def test_driver_sees_the_best_splits_alone(spark, monkeypatch):
    """What a job sends is the same for many blocks as for one, and does not hold the bins."""
    rng = np.random.default_rng(6)
    x, y = sample(rng, 2000)
    df, plain_collect, most = frame(spark, x, y), RDD.collect, []

    def collect(self):
        found = plain_collect(self)
        most[-1] = max(most[-1], len(pickle.dumps(found)))
        return found

    monkeypatch.setattr(RDD, "collect", collect)
    for block_rows in (1 << 14, 50):
        most.append(0)
        B.fit(df, FEATURES, "y", rounds=2, depth=5, block_rows=block_rows)
    assert most[1] < 1.2 * most[0] and 0 < max(most) < 20_000
    assert B.partitions_for(df, 10_000_000, 1 << 14) == spark.sparkContext.defaultParallelism < B.partitions_for(df, 1 << 40, 1 << 14)
    assert B.partitions_for(df, 0, 1 << 14) == 1 and B.partitions_for(df, 20_000, 1 << 14) == 2


def test_one_task_grows_all_trees_of_few_rows(spark, monkeypatch):
    """Rounds start no jobs of their own up to TASK_CELLS; beyond, each level is a job that sends no bins. The trees are the same."""
    rng = np.random.default_rng(8)
    x, y = sample(rng, 1500)
    df, plain_collect, sent = frame(spark, x, y), RDD.collect, []

    def collect(self):
        found = plain_collect(self)
        sent[-1].append(len(pickle.dumps(found)))
        return found

    def fitted(cells, rounds):
        monkeypatch.setattr(B, "TASK_CELLS", cells)
        sent.append([])
        return B.fit(df, FEATURES, "y", rounds=rounds, depth=4, positive_weight=3.0, block_rows=200)

    monkeypatch.setattr(RDD, "collect", collect)
    monkeypatch.setattr(B, "WRITE", 3)
    few, many = fitted(1500 * len(FEATURES), 2), fitted(1500 * len(FEATURES), 8)
    assert list(map(len, sent)) == [1, 1] and len(few.trees) == 2 and max(t.left.size for t in many.trees) > 15
    by_jobs = fitted(1500 * len(FEATURES) - 1, 8)
    # A job for each level, one for each of two times that the margins are written.
    assert 8 < len(sent[-1]) <= 8 * 4 + 2 and max(sent[-1]) < 10_000
    for a, b in zip([*many.trees, *few.trees], [*by_jobs.trees, *many.trees]):
        assert all(np.allclose(getattr(a, name), getattr(b, name)) for name in ("feature", "bin", "threshold", "left", "right", "value", "gain"))
    none = B.fit(df.where("false"), FEATURES, "y", rounds=2)
    assert not none.trees


def test_saved_model_scores_alike(spark, tmp_path):
    rng = np.random.default_rng(4)
    x, y = sample(rng, 300)
    df = frame(spark, x, y)
    model = B.fit(df, FEATURES, "y", rounds=5, depth=6)
    model.save(spark, str(tmp_path / "m"))
    loaded = B.BoostedTrees.load(spark, str(tmp_path / "m"))
    assert loaded.features == FEATURES and np.allclose(scores(model, df), scores(loaded, df))


def test_odd_inputs(spark):
    df = spark.createDataFrame([(1, None, float("nan"), 1), (2, 3.0, 1.0, 0), (3, None, 1.0, None)], "id long, a double, b double, y int")
    model = B.fit(df, ["a", "b"], "y", rounds=3)
    assert scores(model, df).shape == (3,) and np.isfinite(scores(model, df)).all()
    nothing = B.fit(df.where("false"), ["a"], "y")
    assert not nothing.trees and scores(nothing, df).tolist() == [0.5] * 3 and nothing.importance().tolist() == [0.0]
    one = B.fit(df.where("y = 1"), ["a", "b"], "y", rounds=50, least_weight=0.0)
    assert (scores(one, df) > 0.5).all()
    many = spark.range(5000).select(F.col("id"), F.lit(7.0).alias("a"), (F.col("id") % 2).cast("int").alias("y"))
    assert np.allclose(scores(B.fit(many, ["a"], "y", rounds=2, block_rows=900), many), 0.5, atol=0.01)
    with pytest.raises(ValueError):
        B.fit(df, ["a"], "y", bins=300)
