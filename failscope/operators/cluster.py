"""Failure clusters."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from failscope.operators.kmeans import Centres, fit
from failscope.operators.repair import with_status
from failscope.operators.vectors import tfidf, tfidf_model
from failscope.sources.columns import require

RESTARTS = tuple(range(42, 52))


def best_kmeans(df: DataFrame, vector: str, k: int = 10, seeds: Sequence[int] = RESTARTS, max_iter: int = 300,
                tolerance: float = 1e-4) -> Centres:
    """The centres with the lowest cost over several starts, each until its centres move less than ``tolerance``."""
    return fit(df, vector, k, seeds, max_iter, tolerance)


def encode_messages(df: DataFrame, text: str, encoder: Callable[[list[str]], Sequence[Sequence[float]]],
                    output: str = "embedding", batch: int = 32) -> DataFrame:
    """Embedding of each message by a user-given encoder, in batches inside the tasks."""
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            filled = texts.fillna("").tolist()
            parts = [encoder(filled[i:i + batch]) for i in range(0, len(filled), batch)]
            yield pd.Series([[float(x) for x in row] for part in parts for row in part])

    return df.withColumn(output, F.pandas_udf(run, "array<double>")(F.col(text)))


def cluster_failures(df: DataFrame, k: int = 10, seeds: Sequence[int] = RESTARTS, embedding: str | None = None,
                     max_features: int = 2000) -> DataFrame:
    """Cluster number on FAIL rows, -1 on all others.

    Uses the rows' embedding column when given, else TF-IDF vectors of ``error_msg``.
    """
    require(df, ["status", "error_msg"])
    rows = df.withColumn("status", F.upper(F.trim("status")))
    failures = with_status(rows, ["FAIL"])
    if failures.isEmpty():
        raise ValueError("no FAIL rows to cluster")
    if embedding is not None:
        vectorise = lambda part: part.withColumn("__v", array_to_vector(F.col(embedding).cast("array<double>")))
    else:
        text = tfidf_model(failures, "error_msg", max_features, bigrams=False, output="__v")
        vectorise = lambda part: tfidf(part, text, "error_msg", "__v")
    model = best_kmeans(vectorise(failures), "__v", k, seeds)
    scored = model.transform(vectorise(failures), "__v").select(*rows.columns, "cluster")
    others = rows.filter(~F.col("status").eqNullSafe("FAIL")).select(*rows.columns, F.lit(-1).alias("cluster"))
    return scored.unionByName(others)
