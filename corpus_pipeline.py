"""From raw documents to a training mix: five stages, each by one corpus operator.

Each stage takes (spark, docs, sf_dir) and returns a frame that the caller writes as
Parquet and reads again as the next stage's ``docs``.  All but the last return the
columns of ``documents``; the last one adds the number of the copy.  Rows with null
columns, empty texts or repeated ids are handled as the operators say.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from failscope.llm import contamination, mixing, neardup, quality, suffixdup
from failscope.storage import materialize

#: The stages are models and similarity searches, which SQL cannot express.
ORACLE_SQL = None


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return quality.keep_good(docs, quality.fit(docs, _table(spark, sf_dir, "labels")))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, by shingles of five words."""
    return neardup.one_of_each(docs, shingle_words=5)


def repeats_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that repeat leave the texts; the documents stay, with their new length."""
    cut = suffixdup.strip(docs, suffixdup.intervals(docs))
    return cut.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else cut


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return contamination.without_leaks(docs, _table(spark, sf_dir, "benchmark"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix of the sources takes it."""
    return mixing.emitted(docs)


STAGES = [
    ("quality rules", quality_stage),
    ("MinHash near-dedup", near_dedup_stage),
    ("suffix-array dedup", repeats_stage),
    ("benchmark decontamination", decontamination_stage),
    ("source mixing", mixing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), "corpus")
    return STAGES[-1][1](spark, docs, sf_dir)
