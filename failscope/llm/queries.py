"""The registered queries of the subpackage and the SQL they are checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from failscope.llm import audit, contamination, importance, langid, mixing, neardup, perplexity, preference, quality, simhash, suffixdup, toxicity, urls

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def fold(parts: int, key: str = "doc_id") -> Column:
    return F.crc32(F.col(key).cast("string")) % parts


def held_out(judged: DataFrame, parts: int, part: int) -> DataFrame:
    """The rows, marked by the fold of their id; a null id is in no fold."""
    return judged.withColumn("held_out", F.coalesce(fold(parts) == part, F.lit(False)))


def op1_url_filters(spark: SparkSession, sf: str) -> DataFrame:
    """The URLs that the rules decide are the labelled table of the method."""
    pages = table(spark, sf, "pages")
    return urls.judge(pages, urls.labelled_by_rules(pages))


def op2_benchmark_decontamination(spark: SparkSession, sf: str) -> DataFrame:
    return contamination.leaks(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


def op3_quality_rules(spark: SparkSession, sf: str) -> DataFrame:
    documents = table(spark, sf, "documents")
    return quality.judge(documents, quality.fit(documents, table(spark, sf, "labels")))


def op4_suffix_array_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return suffixdup.dedup(table(spark, sf, "documents"))


def op5_minhash_near_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf, "documents"))


def op6_source_mixing(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.taken(table(spark, sf, "documents"))


def op7_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    documents = table(spark, sf, "documents")
    model = toxicity.learn(documents, table(spark, sf, "labels"), fold(5) != 0)
    return held_out(toxicity.score(documents, model), 5, 0)


def op8_lm_scoring(spark: SparkSession, sf: str) -> DataFrame:
    documents = table(spark, sf, "documents")
    return held_out(perplexity.perplexity(documents, fold(5) == 1), 5, 1)


def op9_language_id(spark: SparkSession, sf: str) -> DataFrame:
    documents = table(spark, sf, "documents")
    return held_out(langid.predict(documents, langid.learn(documents, fold(4) != 2)), 4, 2)


def op10_preference_chat(spark: SparkSession, sf: str) -> DataFrame:
    return preference.format_pairs(preference.replies_swapped(table(spark, sf, "conversations")))


def op11_importance_resampling(spark: SparkSession, sf: str) -> DataFrame:
    return importance.resample(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


def op12_filter_audit(spark: SparkSession, sf: str) -> DataFrame:
    return audit.audit(table(spark, sf, "documents"), table(spark, sf, "labels"))


def op13_simhash_near_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf, "documents"))


QUERIES: dict[str, Query] = {
    f.__name__: f for f in (
        op1_url_filters, op2_benchmark_decontamination, op3_quality_rules, op4_suffix_array_dedup, op5_minhash_near_dedup, op6_source_mixing, op7_toxicity, op8_lm_scoring, op9_language_id, op10_preference_chat,
        op11_importance_resampling, op12_filter_audit, op13_simhash_near_dedup)}
ORACLES: dict[str, str] = {
    "op1_url_filters": urls.SQL, "op6_source_mixing": mixing.SQL, "op10_preference_chat": preference.SQL, "op12_filter_audit": audit.SQL}
