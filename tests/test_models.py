import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from failscope.operators import anomaly as A
from failscope.operators import classify as C
from failscope.operators import encode as N
from failscope.operators import vectors as X
from failscope.operators.cluster import best_kmeans, encode_messages
from failscope.storage import materialize

TEXTS = ["Port mismatch on port one", "port closed", "capture failed capture", "mismatch", "", None, "capture port one"]


def test_tfidf_against_brute_force(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "id int, t string")
    model = X.tfidf_model(df, "t", 1000)
    vocabulary = model.stages[-3].vocabulary
    got = {r.id: r.v for r in X.tfidf(df, model, "t").select("id", vector_to_array("tfidf").alias("v")).collect()}
    docs = []
    for text in TEXTS:
        words = [w for w in re.findall(r"\b\w\w+\b", (text or "").lower()) if w not in ("on",)]
        docs.append(Counter(words + [f"{a} {b}" for a, b in zip(words, words[1:])]))
    df_of = Counter(t for d in docs for t in d)
    assert set(vocabulary) == set(df_of)
    for i, doc in enumerate(docs):
        raw = np.array([doc[t] * (math.log((1 + len(docs)) / (1 + df_of[t])) + 1) for t in vocabulary])
        want = raw / np.linalg.norm(raw) if raw.any() else raw
        assert got[i] == pytest.approx(list(want))


def test_equal_messages_are_counted_not_repeated(spark, monkeypatch):
    """The vectors of counted rows are those of the rows; a forest sees each different row at most ``SHARES`` times, with all its weight."""
    many = [(t, "a" if (t or "").startswith("p") else "b") for i, t in enumerate(TEXTS) for _ in range(50 * (i + 1))]
    df = spark.createDataFrame(many, "t string, label string")
    counted = df.groupBy("t").agg(F.count("*").alias("n"))
    plain, ours = X.tfidf_model(df, "t", 1000), X.tfidf_model(counted, "t", 1000, rows="n")
    assert set(plain.stages[-3].vocabulary) == set(ours.stages[-3].vocabulary)
    entries = lambda m: [dict(zip(np.array(m.stages[-3].vocabulary)[r.tfidf.indices], r.tfidf.values)) for r in X.tfidf(counted, m, "t").orderBy("t").collect()]
    for a, b in zip(entries(plain), entries(ours)):
        assert a == pytest.approx(b)
    monkeypatch.setattr(C, "SHARES", 60)
    shares = C.bagged(df.groupBy("t", "label").agg(F.count("*").alias("n")), "n").groupBy("t", "n").agg(
        F.count("*").alias("shares"), F.sum("__weight").alias("weight"), (F.max("__weight") - F.min("__weight")).alias("spread")).collect()
    assert all(r.weight == r.n and r.shares == min(r.n, 60) and r.spread <= 1 for r in shares)
    seen = []
    fit = C.RandomForestClassifier.fit
    monkeypatch.setattr(C.RandomForestClassifier, "fit", lambda self, ready: seen.append(ready.count()) or fit(self, ready))
    model = C.status_classifier(df, "t", trees=20, depth=5, max_features=50)
    assert seen[0] <= 60 * 7 < len(many)
    got = C.classified(df, model, "t")
    assert got.count() == len(many) and got.where("predictedlabel <> actualstatus OR confidence IS NULL").count() == 0


def test_principal_axes_against_svd(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(60, 5)) * [5, 3, 1, 0.5, 0.1]
    df = spark.createDataFrame([(i, list(map(float, row))) for i, row in enumerate(x)], "id int, a array<double>")
    out = X.principal_axes(df.withColumn("v", array_to_vector("a")), "v").orderBy("id").collect()
    centred = x - x.mean(axis=0)
    want = centred @ np.linalg.svd(centred)[2][:2].T
    for k, name in enumerate(("pca_1", "pca_2")):
        assert np.abs([r[name] for r in out]) == pytest.approx(np.abs(want[:, k]))


def points(spark, n=2000):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(n, 3))
    x[:20] += 12
    return spark.createDataFrame([(i, list(map(float, row))) for i, row in enumerate(x)], "id int, a array<double>").withColumn(
        "v", array_to_vector("a"))


def test_isolation_forest_finds_outliers(spark, tmp_path):
    df = points(spark)
    forest = A.isolation_forest(df, "v", "id", trees=60)
    scored = materialize(forest.score(df, "v").select("id", "anomaly_score"))
    lowest = [r.id for r in scored.orderBy("anomaly_score").limit(20).collect()]
    assert set(lowest) == set(range(20))
    bounds = scored.agg(F.min("anomaly_score"), F.max("anomaly_score")).first()
    assert -1 <= bounds[0] < bounds[1] <= 0
    assert forest.nodes.groupby("tree").size().max() <= 2 * 256
    assert forest.nodes["tree"].nunique() == 60
    # Same data in another layout gives the same forest.
    again = A.isolation_forest(df.repartition(7), "v", "id", trees=60)
    assert again.nodes.sort_values(["tree", "node"]).reset_index(drop=True).equals(
        forest.nodes.sort_values(["tree", "node"]).reset_index(drop=True))
    forest.save(spark, str(tmp_path / "forest"))
    loaded = A.IsolationForest.load(spark, str(tmp_path / "forest"))
    a = {r.id: r.anomaly_score for r in loaded.score(df, "v").collect()}
    assert a == pytest.approx({r.id: r.anomaly_score for r in scored.collect()})


def test_isolation_forest_on_sparse_and_tiny_input(spark):
    df = spark.createDataFrame([(i, "port port" if i % 9 else "strange thing") for i in range(90)], "id int, error_msg string")
    ready = A.anomaly_features(df).vectors(df)
    forest = A.isolation_forest(ready, "features", "id", trees=30)
    out = materialize(forest.score(ready, "features").select("error_msg", "anomaly_score"))
    means = {r.error_msg: r.s for r in out.groupBy("error_msg").agg(F.avg("anomaly_score").alias("s")).collect()}
    assert means["strange thing"] < means["port port"]


def test_anomaly_model_round_trip_and_axes(spark, tmp_path):
    df = spark.createDataFrame([(i, f"port p{i % 7} mismatch", float(i % 5)) for i in range(60)],
                               "id int, error_msg string, execution_duration double")
    model = A.fit_anomaly_model(df, "id", trees=10, max_features=50)
    model.save(spark, str(tmp_path / "m"))
    again = A.AnomalyModel.load(spark, str(tmp_path / "m"))
    scores = lambda m: {r.id: r.anomaly_score for r in m.score(df).collect()}
    assert scores(again) == pytest.approx(scores(model))
    found = A.detect_anomalies(df, "id", [F.col("id")], model=again)
    assert found.count() == 60 and found.filter("is_anomaly = 1").count() <= 3
    axes = A.message_axes(found).agg(F.avg("pca_1"), F.avg("pca_2")).first()
    assert list(axes) == pytest.approx([0, 0], abs=1e-9)


def test_standardised_axes_against_svd(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(40, 4)) * [5, 3, 1, 2] + 7
    x[:, 0] += 2 * x[:, 1]
    df = spark.createDataFrame([(i, list(map(float, row))) for i, row in enumerate(x)], "id int, a array<double>")
    out = X.principal_axes(df.withColumn("v", array_to_vector("a")), "v", standardise=True).orderBy("id").collect()
    z = (x - x.mean(axis=0)) / x.std(axis=0)
    want = z @ np.linalg.svd(z)[2][:2].T
    for k, name in enumerate(("pca_1", "pca_2")):
        assert np.abs([r[name] for r in out]) == pytest.approx(np.abs(want[:, k]))


def test_mean_path():
    assert A.mean_path(1) == 0 and A.mean_path(2) == 1
    assert A.mean_path(256) == pytest.approx(10.2448, abs=1e-3)


def test_kmeans_keeps_the_lowest_cost(spark):
    df = points(spark, 300)
    model = best_kmeans(df, "v", k=2, seeds=[1, 2, 3])
    groups = {r.cluster: r.n for r in model.transform(df).groupBy("cluster").agg(F.count("*").alias("n")).collect()}
    assert sorted(groups.values()) == [20, 280]


def test_model_round_trip(spark, tmp_path):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "id int, t string")
    model = X.tfidf_model(df, "t", 100)
    X.save_model(model, str(tmp_path / "m"))
    again = X.load_model(str(tmp_path / "m"))
    rows = lambda m: [r.tfidf for r in X.tfidf(df, m, "t").orderBy("id").collect()]
    assert rows(again) == rows(model)


def test_encoder_hook(spark):
    df = spark.createDataFrame([(1, "ab"), (2, None)], "id int, t string")
    out = encode_messages(df, "t", lambda texts: [[len(t), 1.0] for t in texts]).orderBy("id").collect()
    assert [r.embedding for r in out] == [[2.0, 1.0], [0.0, 1.0]]


@pytest.mark.parametrize("n,fraction", [(1, 0.2), (2, 0.2), (13, 0.5), (400, 0.2)])
def test_split_is_exact_per_label(spark, n, fraction):
    df = spark.range(n).select("id", F.when(F.col("id") % 3 == 0, None).when(F.col("id") % 3 == 1, "a").otherwise("b").alias("y"))
    got = {r.y: (r.n, r.t) for r in N.stratified_split(df, "y", "id", fraction).groupBy("y").agg(
        F.count("*").alias("n"), F.sum("is_test").alias("t")).collect()}
    assert sum(v[0] for v in got.values()) == n
    for rows, test in got.values():
        assert test == math.floor(fraction * rows + 0.5)


def test_scaling_of_a_constant_column(spark):
    df = spark.createDataFrame([(1.0, 5), (3.0, 5)], "a double, b int")
    assert sorted((r.a_scaled, r.b_scaled) for r in X.scale(df, ["a", "b"]).collect()) == [(-1.0, 0.0), (1.0, 0.0)]
