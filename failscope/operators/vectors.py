"""TF-IDF vectors, scaling and PCA as Spark ML stages."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import (
    IDF, CountVectorizer, CountVectorizerModel, ElementwiseProduct, NGram, Normalizer, RegexTokenizer, SQLTransformer, StopWordsRemover, VectorAssembler,
)
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from failscope import constants as K
from failscope.operators.principal import leading_axes
from failscope.storage import materialize


def term_stages(text: str, bigrams: bool = True, stop_words: Sequence[str] = K.SPARK_STOP_WORDS) -> tuple[list, str]:
    """Stages from a text to its terms, and the column that has these."""
    words = RegexTokenizer(inputCol=text, outputCol="__tokens", pattern=r"(?U)\b\w\w+\b", gaps=False)
    kept = StopWordsRemover(inputCol="__tokens", outputCol="__words", stopWords=list(stop_words))
    if not bigrams:
        return [words, kept], "__words"
    return [words, kept, NGram(n=2, inputCol="__words", outputCol="__pairs"),
            SQLTransformer(statement="SELECT *, concat(__words, __pairs) AS __terms FROM __THIS__")], "__terms"


def tfidf_model(df: DataFrame, text: str, max_features: int = 5000, bigrams: bool = True,
                output: str = "tfidf", stop_words: Sequence[str] = K.SPARK_STOP_WORDS, rows: str | None = None) -> PipelineModel:
    """Fitted smoothed TF-IDF with L2 norm; the vocabulary is kept on the driver.

    For a vocabulary without a bound see :func:`failscope.operators.terms.tfidf_unbounded`.
    ``rows`` may name a column that says how many equal rows a row stands for.

    Spark's IDF lacks the "+ 1" of the smoothed form, hence the term counts are
    multiplied with ``idf + 1``.
    """
    head, terms = term_stages(text, bigrams, stop_words)
    filled = F.coalesce(F.col(text), F.lit("")).alias(text)
    if rows is None:
        counter = CountVectorizer(inputCol=terms, outputCol="__tf", vocabSize=max_features)
        source = df.select(filled)
        counting = Pipeline(stages=[*head, counter]).fit(source)
        idf = IDF(inputCol="__tf", outputCol="__idf").fit(counting.transform(source).select("__tf")).idf.toArray()
    else:
        vocabulary, idf = _counted_vocabulary(PipelineModel(stages=head).transform(df.select(filled, rows)), terms, rows, max_features)
        counting = PipelineModel(stages=[*head, CountVectorizerModel.from_vocabulary(vocabulary, inputCol=terms, outputCol="__tf")])
    weigh = ElementwiseProduct(
        scalingVec=Vectors.dense([float(v) + 1.0 for v in idf]), inputCol="__tf", outputCol="__weighted")
    norm = Normalizer(p=2.0, inputCol="__weighted", outputCol=output)
    return PipelineModel(stages=[*counting.stages, weigh, norm])


def _counted_vocabulary(split: DataFrame, terms: str, rows: str, max_features: int) -> tuple[list[str], list[float]]:
    """The most frequent terms, ties by the term, and their idf; each row counts as ``rows`` rows."""
    many = split.agg(F.coalesce(F.sum(rows), F.lit(0))).first()[0]
    of_row = split.select(rows, F.explode(F.array_distinct(terms)).alias("term")).groupBy("term").agg(F.sum(rows).alias("rows"))
    found = split.select(rows, F.explode(terms).alias("term")).groupBy("term").agg(F.sum(rows).alias("n")).orderBy(F.desc("n"), "term").limit(max_features)
    # At most ``max_features`` terms.
    kept = found.join(of_row, "term").orderBy(F.desc("n"), "term").collect()
    return [r["term"] for r in kept], [math.log((many + 1) / (r["rows"] + 1)) for r in kept]


def tfidf(df: DataFrame, model: PipelineModel, text: str, output: str = "tfidf") -> DataFrame:
    out = model.transform(df.withColumn(text, F.coalesce(F.col(text), F.lit(""))))
    return out.select(*df.columns, output)


def scaling(df: DataFrame, columns: Sequence[str]) -> dict[str, tuple[float, float]]:
    """Mean and population deviation per column, one pass; a constant column is divided by 1."""
    row = df.agg(*[f for c in columns for f in (
        F.avg(F.coalesce(F.col(c).cast("double"), F.lit(0.0))).alias(f"{c}__m"),
        F.stddev_pop(F.coalesce(F.col(c).cast("double"), F.lit(0.0))).alias(f"{c}__s"))]).first()
    return {c: (row[f"{c}__m"] or 0.0, row[f"{c}__s"] or 1.0) for c in columns}


def scale(df: DataFrame, columns: Sequence[str], suffix: str = "_scaled",
          fitted: dict[str, tuple[float, float]] | None = None) -> DataFrame:
    fitted = fitted or scaling(df, columns)
    return df.withColumns({
        f"{c}{suffix}": (F.coalesce(F.col(c).cast("double"), F.lit(0.0)) - F.lit(m)) / F.lit(s)
        for c, (m, s) in fitted.items()})


def assemble(df: DataFrame, columns: Sequence[str], output: str = "features") -> DataFrame:
    """Several numeric or vector columns side by side in one vector."""
    return VectorAssembler(inputCols=list(columns), outputCol=output, handleInvalid="keep").transform(df)


def principal_axes(df: DataFrame, vector: str, standardise: bool = False,
                   outputs: tuple[str, str] = ("pca_1", "pca_2")) -> DataFrame:
    """Coordinates on the first two principal axes of the centred vectors.

    The vectors stay sparse: the mean is taken off their products. They may be wide, as only a few
    blocks of columns x 12 numbers are kept on the driver.
    """
    rows = materialize(df, "vectors")
    found = leading_axes(rows, vector, len(outputs), standardise)
    return rows.withColumn("__axes", found.coordinates(vector, list(outputs))).select(*df.columns, "__axes.*")


def save_scaling(spark: SparkSession, fitted: dict[str, tuple[float, float]], path: str) -> None:
    rows = [(c, float(m), float(s)) for c, (m, s) in fitted.items()]
    spark.createDataFrame(rows, "column string, mean double, deviation double").write.mode("overwrite").parquet(path)


def load_scaling(spark: SparkSession, path: str) -> dict[str, tuple[float, float]]:
    # One row per scaled column.
    return {r["column"]: (r["mean"], r["deviation"]) for r in spark.read.parquet(path).collect()}


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)
