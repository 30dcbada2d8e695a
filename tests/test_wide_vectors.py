"""Vectors too wide for the driver: vocabulary as a table, principal axes by blocks."""

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import functions as F

from failscope.operators import principal as P
from failscope.operators import terms
from failscope.operators import vectors as X
from failscope.operators.terms import tfidf_unbounded

TEXTS = ["Port mismatch on port one", "port closed", "capture failed capture", "mismatch", "", None, "capture port one", "mismatch"]


@pytest.mark.parametrize("bigrams", [False, True])
def test_unbounded_vocabulary_as_the_fitted_model(spark, bigrams):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "id int, t string").repartition(3)
    model = X.tfidf_model(df, "t", 1000, bigrams)
    entries = lambda out: sorted((r.id, sorted(np.round(r.tfidf.toArray()[r.tfidf.toArray() > 0], 9))) for r in out.collect())
    got = tfidf_unbounded(df, "t", bigrams=bigrams)
    assert got.columns == ["id", "t", "tfidf"] and entries(got) == entries(X.tfidf(df, model, "t"))
    # The most frequent terms, ties by the term: port (4 times), then capture before mismatch (3 times each).
    few = {r.id: r.tfidf for r in tfidf_unbounded(df, "t", 2, bigrams).collect()}
    assert all(v.size == 2 for v in few.values()) and few[2].toArray().tolist() == [0, 1] and few[1].toArray().tolist() == [1, 0]
    assert few[5].numNonzeros() == 0
    assert tfidf_unbounded(df.limit(0), "t").count() == 0


def test_blocks_hold_each_term_once(spark, monkeypatch):
    """Terms are counted where they are read: a block has a term once, however many rows have it; small blocks give the same vectors."""
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS * 5)], "id int, t string").coalesce(1)
    rows = df.withColumn(terms._ROW, F.monotonically_increasing_id())
    found = terms.term_blocks(rows, "t", False, ["on"]).collect()
    assert len(found) == 1 and sorted(found[0].terms) == ["capture", "closed", "failed", "mismatch", "one", "port"]
    assert dict(zip(found[0].terms, zip(found[0].total, found[0].having)))["port"] == (20, 15)
    entries = lambda out: sorted((r.id, r.tfidf.indices.tolist(), np.round(r.tfidf.values, 9).tolist()) for r in out.collect())
    whole = entries(tfidf_unbounded(df, "t"))
    monkeypatch.setattr(terms, "BLOCK_TERMS", 3)
    assert terms.term_blocks(rows, "t", False, ["on"]).count() > 10 and entries(tfidf_unbounded(df, "t")) == whole


def exact(x, standardise=False):
    z = x - x.mean(axis=0)
    z = z / np.where(x.std(axis=0) > 0, x.std(axis=0), 1) if standardise else z
    _, s, v = np.linalg.svd(z, full_matrices=False)
    return s[:2] ** 2 / len(x), z @ v[:2].T


@pytest.mark.parametrize("standardise", [False, True])
def test_axes_of_300_columns(spark, standardise):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(400, 300)) * (rng.random((400, 300)) < 0.1)
    x[:, 7] += 3 * x[:, 8]
    x[:, 9] = 0
    df = spark.createDataFrame([(i, list(map(float, r))) for i, r in enumerate(x)], "id int, a array<double>").withColumn("v", array_to_vector("a")).select("id", "v").cache()
    want, places = exact(x, standardise)
    found = P.leading_axes(df, "v", standardise=standardise)
    assert np.abs(found.variances / want - 1).max() < 1e-6
    got = np.array([[r.pca_1, r.pca_2] for r in X.principal_axes(df, "v", standardise).orderBy("id").collect()])
    assert np.abs(np.abs(got) - np.abs(places)).max() < 1e-4


def test_axes_of_200_000_columns(spark):
    """A strong common direction within sparse rows of many columns is found, without a matrix of columns x columns."""
    columns = 200_000

    @F.arrow_udf(VectorUDT())
    def vectors(i):
        import pyarrow as pa

        n = len(i)
        x = i.to_numpy()
        at = np.stack([(x * 7919) % 1000, 1000 + (x * 104729) % 99_000, 100_000 + (x * 15485863) % 99_999, np.full(n, columns - 1)], axis=1)
        value = np.stack([np.ones(n), np.ones(n), np.ones(n), 10.0 * (x % 2) + 3], axis=1)
        lists = lambda v, kind: pa.ListArray.from_arrays(pa.array(np.arange(0, 4 * n + 1, 4), pa.int32()), pa.array(v.ravel(), kind))
        return pa.StructArray.from_arrays([pa.array(np.zeros(n, np.int8)), pa.array(np.full(n, columns, np.int32)), lists(at, pa.int32()), lists(value, pa.float64())],
                                          names=["type", "size", "indices", "values"])

    df = spark.range(2000).select("id", vectors("id").alias("v"))
    out = X.principal_axes(df, "v").groupBy((F.col("id") % 2).alias("side")).agg(F.avg("pca_1").alias("m")).collect()
    means = {r.side: r.m for r in out}
    assert means[1] == pytest.approx(5, abs=0.01) and means[0] == pytest.approx(-5, abs=0.01)


def test_axes_of_tiny_inputs(spark):
    df = spark.createDataFrame([(1, [2.0]), (2, [4.0])], "id int, a array<double>").withColumn("v", array_to_vector("a"))
    got = [(r.pca_1, r.pca_2) for r in X.principal_axes(df, "v").orderBy("id").collect()]
    assert got == [(-1.0, 0.0), (1.0, 0.0)]
    assert X.principal_axes(df.limit(0), "v").count() == 0
    same = df.withColumn("v", array_to_vector(F.array(F.lit(3.0), F.lit(1.0))))
    assert [(r.pca_1, r.pca_2) for r in X.principal_axes(same, "v", True).collect()] == [(0.0, 0.0)] * 2
    assert same.select(vector_to_array("v")).count() == 2
