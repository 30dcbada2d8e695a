"""Isolation forest (Liu, Ting, Zhou 2008) as Spark jobs, and anomaly flags.

Trees are grown one per group from about 256 sampled rows each; the node table
is bounded by the number of trees and the sample size, never by the data, so it
may be broadcast for scoring.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from failscope.constants import ANOMALY_NUMERIC
from failscope.functions.parse import message_snippet
from failscope.operators.ordered import global_row_number
from failscope.operators.quantiles import exact_quantiles
from failscope.operators.vectors import (
    assemble, load_model, load_scaling, principal_axes, save_model, save_scaling, scale, scaling, tfidf, tfidf_model,
)
from failscope.sources.columns import present
from failscope.storage import materialize, by_content

EULER = 0.5772156649015329
_SCALE = 1 << 30
_NODE = "tree int, node int, feature int, threshold double, below int, above int, path double"


def mean_path(n: int) -> float:
    """Mean path length of an unsuccessful search among ``n`` rows."""
    if n <= 1:
        return 0.0
    if n == 2:
        return 1.0
    return 2.0 * (math.log(n - 1.0) + EULER) - 2.0 * (n - 1.0) / n


def _dense(indices: Sequence, values: Sequence, width: int) -> np.ndarray:
    """Sparse (indices, values) and dense (None, values) vectors as one matrix, filled at once."""
    out = np.zeros((len(values), width))
    sizes = np.fromiter((len(v) for v in values), np.int64, len(values))
    if sizes.sum():
        columns = np.concatenate([np.arange(n) if at is None else np.asarray(at, np.int64) for at, n in zip(indices, sizes)])
        out[np.repeat(np.arange(len(values)), sizes), columns] = np.concatenate([np.asarray(v, float) for v in values])
    return out


def _grow(x: np.ndarray, rng: np.random.Generator, max_depth: int) -> list[tuple]:
    nodes: list[list] = [[-1, 0.0, -1, -1, 0.0]]
    todo = [(0, np.arange(len(x)), 0)]
    while todo:
        at, rows, depth = todo.pop()
        part = x[rows]
        low, high = part.min(axis=0), part.max(axis=0)
        varied = np.flatnonzero(high > low)
        if depth >= max_depth or len(rows) <= 1 or not len(varied):
            nodes[at][4] = depth + mean_path(len(rows))
            continue
        feature = int(rng.choice(varied))
        cut = float(rng.uniform(low[feature], high[feature]))
        if cut >= high[feature]:  # keep both sides non-empty
            cut = float(low[feature])
        side = part[:, feature] <= cut
        nodes[at][:4] = [feature, cut, len(nodes), len(nodes) + 1]
        todo += [(len(nodes), rows[side], depth + 1), (len(nodes) + 1, rows[~side], depth + 1)]
        nodes += [[-1, 0.0, -1, -1, 0.0], [-1, 0.0, -1, -1, 0.0]]
    return [tuple(n) for n in nodes]


@dataclass
class IsolationForest:
    nodes: pd.DataFrame
    sample: int

    def save(self, spark, path: str) -> None:
        spark.createDataFrame(self.nodes.assign(sample=self.sample), _NODE + ", sample int").write.mode(
            "overwrite").parquet(path)

    @staticmethod
    def load(spark, path: str) -> IsolationForest:
        # Bounded by trees x sample size (see the module text).
        table = spark.read.parquet(path).toPandas()
        return IsolationForest(table.drop(columns="sample"), int(table["sample"].iloc[0]))

    def score(self, df: DataFrame, vector: str, name: str = "anomaly_score") -> DataFrame:
        """Negative anomaly score in [-1, 0]: lower is more abnormal."""
        trees = self.nodes["tree"].nunique()
        longest = int(self.nodes.groupby("tree").size().max())
        tables = {}
        order = self.nodes["tree"].rank(method="dense").astype(int).to_numpy() - 1
        for column, empty in (("feature", -1), ("threshold", 0.0), ("below", 0), ("above", 0), ("path", 0.0)):
            grid = np.full((trees, longest), empty, dtype="float64" if column in ("threshold", "path") else "int64")
            grid[order, self.nodes["node"].to_numpy()] = self.nodes[column].to_numpy()
            tables[column] = grid
        used = np.unique(tables["feature"][tables["feature"] >= 0])
        shared = df.sparkSession.sparkContext.broadcast(tables)
        unit = mean_path(self.sample) or 1.0

        def isolation(indices: pd.Series, values: pd.Series, size: pd.Series) -> pd.Series:
            t = shared.value
            width = int(max(used.max(initial=0) + 1, size.max(), max((len(v) for v in values), default=0)))
            tree = np.arange(trees)[None, :]
            out = np.empty(len(values))
            for start in range(0, len(values), 1_000):
                part = slice(start, start + 1_000)
                x = _dense(indices.iloc[part].tolist(), values.iloc[part].tolist(), width)
                row = np.arange(len(x))[:, None]
                node = np.zeros((len(x), trees), dtype="int64")
                while True:
                    feature = t["feature"][tree, node]
                    inner = feature >= 0
                    if not inner.any():
                        break
                    below = x[row, np.where(inner, feature, 0)] <= t["threshold"][tree, node]
                    node = np.where(inner, np.where(below, t["below"][tree, node], t["above"][tree, node]), node)
                out[part] = -np.power(2.0, -t["path"][tree, node].mean(axis=1) / unit)
            return pd.Series(out)

        parts = F.unwrap_udt(vector)
        return df.withColumn(name, F.pandas_udf(isolation, "double")(
            parts["indices"], parts["values"], F.coalesce(parts["size"], F.lit(0))))


def isolation_forest(df: DataFrame, vector: str, row_id: str, trees: int = 300, sample: int = 256,
                     seed: int = 42) -> IsolationForest:
    """Grow the forest.

    A hash of the row id thins the rows to a pool of a few times what all trees
    need; each tree takes from the pool the rows with its own smallest hashes.
    """
    n, widest = df.agg(F.count(F.lit(1)), F.max(_width(vector))).first()
    want = trees * sample
    share = min(1.0, 2.0 * want / max(n, 1))
    draw = lambda *cols: F.pmod(F.xxhash64(*cols), F.lit(_SCALE))
    parts = F.unwrap_udt(vector)
    pool = df.filter(draw(F.col(row_id), F.lit(seed)) < F.lit(int(share * _SCALE))) if share < 1.0 else df
    pool = materialize(pool.select(F.col(row_id).alias("id"), parts["indices"].alias("indices"),
                                   parts["values"].alias("values")), "pool")
    share = min(1.0, 2.0 * sample / max(pool.count(), 1))
    picks = F.filter(F.sequence(F.lit(0), F.lit(trees - 1)),
                     lambda t: draw(F.col("id"), t, F.lit(seed + 1)) < F.lit(int(share * _SCALE)))
    drawn = pool.withColumn("tree", F.explode(picks)).withColumn("h", F.xxhash64("id", "tree", F.lit(seed + 2)))
    max_depth = max(1, math.ceil(math.log2(sample)))
    width = int(widest or 1)

    def grow(group: pd.DataFrame) -> pd.DataFrame:
        tree = int(group["tree"].iloc[0])
        kept = group.sort_values(["h", "id"]).head(sample)
        x = _dense(kept["indices"].tolist(), kept["values"].tolist(), width)
        nodes = _grow(x, np.random.default_rng([seed, tree]), max_depth)
        out = pd.DataFrame(nodes, columns=["feature", "threshold", "below", "above", "path"])
        out.insert(0, "node", np.arange(len(out)))
        out.insert(0, "tree", tree)
        return out

    # About 2 x sample rows per group; at most 2 x sample nodes per tree come back.
    nodes = drawn.groupBy("tree").applyInPandas(grow, _NODE).toPandas()
    return IsolationForest(nodes, min(sample, max(int(n), 1)))


def _width(vector: str) -> Column:
    parts = F.unwrap_udt(vector)
    return F.coalesce(parts["size"], F.size(parts["values"]))


def anomaly_flags(df: DataFrame, score: str = "anomaly_score", share: float = 0.05) -> DataFrame:
    """1 where the score is below its 5th percentile."""
    threshold = exact_quantiles(df, score, [share])[0]
    return df.withColumn("is_anomaly", F.coalesce((F.col(score) < F.lit(threshold)).cast("int"), F.lit(0)))


@dataclass
class AnomalyModel:
    """TF-IDF of the message, scaling of the numeric features, and the forest on both."""

    text: str
    words: PipelineModel
    scaling: dict[str, tuple[float, float]]
    forest: IsolationForest | None = None

    def vectors(self, df: DataFrame, output: str = "features") -> DataFrame:
        numeric = list(self.scaling)
        wide = tfidf(df, self.words, self.text, "__text")
        wide = scale(wide, numeric, "__z", self.scaling) if numeric else wide
        return assemble(wide, ["__text", *[f"{c}__z" for c in numeric]], output).select(*df.columns, output)

    def score(self, df: DataFrame) -> DataFrame:
        return self.forest.score(self.vectors(df, "__features"), "__features").drop("__features")

    def save(self, spark: SparkSession, path: str) -> None:
        save_model(self.words, f"{path}/words")
        save_scaling(spark, self.scaling, f"{path}/scaling")
        self.forest.save(spark, f"{path}/forest")

    @staticmethod
    def load(spark: SparkSession, path: str, text: str = "error_msg") -> AnomalyModel:
        return AnomalyModel(text, load_model(f"{path}/words"), load_scaling(spark, f"{path}/scaling"),
                            IsolationForest.load(spark, f"{path}/forest"))


def anomaly_features(df: DataFrame, text: str = "error_msg", max_features: int = 2000, bigrams: bool = True) -> AnomalyModel:
    """Fit the two feature blocks on the numeric features the frame has."""
    numeric = present(df, ANOMALY_NUMERIC)
    return AnomalyModel(text, tfidf_model(df, text, max_features, bigrams, "__text"),
                        scaling(df, numeric) if numeric else {})


def fit_anomaly_model(df: DataFrame, row_id: str, text: str = "error_msg", trees: int = 300, max_features: int = 2000,
                      bigrams: bool = True, seed: int = 42) -> AnomalyModel:
    model = anomaly_features(df, text, max_features, bigrams)
    model.forest = isolation_forest(model.vectors(df, "__features"), "__features", row_id, trees, seed=seed)
    return model


def detect_anomalies(df: DataFrame, row_id: str, order: Sequence[Column], text: str = "error_msg", trees: int = 300,
                     max_features: int = 2000, share: float = 0.05, seed: int = 42, dots: bool = True,
                     bigrams: bool = True, model: AnomalyModel | None = None) -> DataFrame:
    """Score, flag, running row number and message snippet of every row.

    The scores are offset so that the threshold is at 0.
    """
    rows = by_content(df)
    model = model or fit_anomaly_model(rows, row_id, text, trees, max_features, bigrams, seed)
    # Written once: the threshold and the row number would otherwise score again.
    scored = materialize(model.score(rows), "scores")
    threshold = exact_quantiles(scored, "anomaly_score", [share])[0]
    flagged = scored.withColumn("anomaly_score", F.col("anomaly_score") - F.lit(threshold)).withColumn(
        "is_anomaly", (F.col("anomaly_score") < 0).cast("int"))
    numbered = global_row_number(flagged, order, "LogID")
    return numbered.withColumn("MessageSnippet", message_snippet(F.col(text), dots))


def message_axes(df: DataFrame, text: str = "MessageSnippet", max_features: int = 300) -> DataFrame:
    """Two-dimensional view of the messages: standardised TF-IDF on its principal axes."""
    wide = tfidf(df, tfidf_model(df, text, max_features, bigrams=False, output="__text"), text, "__text")
    return principal_axes(wide, "__text", standardise=True).drop("__text")


def anomaly_points(df: DataFrame, axes: Sequence[str] = ("pca_1", "pca_2")) -> DataFrame:
    """Anomalies on the two axes with their ``dut | suite`` label."""
    return df.filter(F.col("is_anomaly") == 1).select(*axes, F.concat_ws(" | ", "dut", "suite").alias("label"))
