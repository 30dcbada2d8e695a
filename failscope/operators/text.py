"""Keywords of failure clusters."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from failscope import constants as K
from failscope.functions.parse import tokens
from failscope.operators.dedupe import top_per_key, top_rows
from failscope.storage import materialize, sized, spread_small


def keyword_ranks(df: DataFrame, group: str, message: str, order: Column, top: int = 5,
                  stop_words: Sequence[str] | None = None, strip: bool = True) -> DataFrame:
    """(group, word, count, rank): most frequent words, ties by first appearance."""
    rows = spread_small(df.select(group, order.alias("__row"), message))
    words = rows.select(
        group, "__row", F.posexplode(tokens(F.col(message), stop_words, strip)).alias("__pos", "word"))
    place = F.struct("__row", "__pos")
    if dict(rows.dtypes)["__row"] in ("int", "bigint"):
        # One number for (row, position) can be aggregated by hash; a struct needs a sort.
        place = F.col("__row").cast("decimal(20,0)") * F.lit(1 << 31).cast("decimal(10,0)") + F.col("__pos")
    counted = words.groupBy(group, "word").agg(F.count(F.lit(1)).alias("count"), F.min(place).alias("__first"))
    best = top_per_key(counted, [group], [F.col("count").desc(), F.col("__first")], top)
    # At most ``top`` rows per group are left.
    listed = best.groupBy(group).agg(F.sort_array(F.collect_list(
        F.struct((-F.col("count")).alias("c"), F.col("__first").alias("f"), F.col("word").alias("w")))).alias("__all"))
    return listed.select(group, F.posexplode("__all").alias("__i", "__e")).select(
        group, F.col("__e.w").alias("word"), (-F.col("__e.c")).alias("count"), (F.col("__i") + 1).alias("rank"))


def top_keywords(df: DataFrame, group: str = "cluster", message: str = "error_msg", order: Column | None = None,
                 top: int = 5, stop_words: Sequence[str] | None = None, strip: bool = True) -> DataFrame:
    """(group, keywords array) for every group; a marker where no word is left."""
    ranks = keyword_ranks(df, group, message, order if order is not None else F.col("line_number"), top,
                          stop_words, strip)
    lists = ranks.groupBy(group).agg(F.sort_array(F.collect_list(F.struct("rank", "word"))).alias("__r"))
    groups = df.filter(F.col(group).isNotNull()).groupBy(group).agg(F.count(F.lit(1)).alias("__n"))
    return groups.join(lists, group, "left").select(
        group,
        F.coalesce(F.transform("__r", lambda r: r["word"]), F.array(F.lit(K.EMPTY_KEYWORDS))).alias("keywords"))


def attach_keywords(df: DataFrame, keywords: DataFrame, group: str = "cluster") -> DataFrame:
    """Keywords of the row's cluster; ``No keywords`` on rows that are no failure."""
    out = df.join(sized(keywords.select(group, "keywords")), group, "left")
    return out.select(*df.columns, F.when(F.col(group) == -1, F.array(F.lit(K.NO_KEYWORDS)))
                      .otherwise(F.coalesce("keywords", F.array().cast("array<string>"))).alias("keywords"))


def tfidf_weights(df: DataFrame, row_id: str, group: str, message: str, max_features: int = 3000,
                  stop_words: Sequence[str] = K.SPARK_STOP_WORDS) -> DataFrame:
    """(row, group, term, weight): smoothed TF-IDF, L2-normalised per row, over the most frequent terms."""
    # A small input may come as one row group, which one task would tokenise.
    docs = spread_small(df.select(row_id, group, F.coalesce(F.col(message), F.lit("")).alias("__text")))
    words = F.filter(F.regexp_extract_all(F.lower("__text"), F.lit(r"(?U)(\b\w\w+\b)"), F.lit(1)), lambda w: ~w.isin(list(stop_words)))
    # At most ``max_features`` terms. They are known before anything is dealt by row, so that the others stay where they are read.
    vocabulary = [r["term"] for r in top_rows(
        docs.select(F.explode(words).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("__all")),
        [F.col("__all").desc(), F.col("term")], max_features).collect()]
    found = docs.select(row_id, group, _counted(vocabulary)(words).alias("__found")).where(F.size("__found") > 0)
    # Dealt once by row, as numbers; an id that comes again adds to the row's counts.
    counts = found.repartition(row_id).select(row_id, group, F.inline("__found")).groupBy(row_id, group, "i").agg(F.sum("n").alias("tf"))
    listed = materialize(counts.groupBy(row_id).agg(F.collect_list(F.struct(F.col(group).alias("g"), "i", "tf")).alias("__terms")), "terms")
    documents = df.count()
    rows_of = {r["i"]: r["df"] for r in listed.select(F.explode("__terms.i").alias("i")).groupBy("i").agg(F.count(F.lit(1)).alias("df")).collect()}
    idf = _array([math.log((1 + documents) / (1 + rows_of.get(i, 0))) + 1 for i in range(len(vocabulary))], "double")
    weighted = listed.select(row_id, F.transform("__terms", lambda t: F.struct(
        t["g"].alias(group), t["i"].alias("i"), (t["tf"] * F.get(idf, t["i"])).alias("w"))).alias("__terms"))
    norm = F.sqrt(F.aggregate("__terms", F.lit(0.0), lambda a, t: a + t["w"] * t["w"]))
    return weighted.select(row_id, norm.alias("__norm"), F.inline("__terms")).select(
        row_id, group, F.get(_array(vocabulary, "string"), F.col("i")).alias("term"), (F.col("w") / F.col("__norm")).alias("weight"))


def _array(values: Sequence, kind: str) -> Column:
    return F.array(*[F.lit(v) for v in values]).cast(f"array<{kind}>")


def _counted(vocabulary: Sequence[str]):
    """Lists of words as lists of (i, n): how often the i-th word of the vocabulary is among them."""

    @F.arrow_udf("array<struct<i:int,n:int>>")
    def run(words: pa.Array) -> pa.Array:
        size, row = max(len(vocabulary), 1), np.repeat(np.arange(len(words)), pc.list_value_length(words).to_numpy())
        flat = words.flatten()
        at = pc.fill_null(pc.index_in(flat, value_set=pa.array(vocabulary, flat.type)), -1).to_numpy()
        key, n = np.unique((row * size + at)[at >= 0], return_counts=True)
        bounds = np.searchsorted(key, np.arange(len(words) + 1) * size)
        pairs = pa.StructArray.from_arrays([pa.array(key % size, pa.int32()), pa.array(n, pa.int32())], names=["i", "n"])
        return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pairs)

    return run


def tfidf_keywords(df: DataFrame, row_id: str, group: str, message: str, top: int = 5,
                   max_features: int = 3000) -> DataFrame:
    """Terms with the highest mean weight over the rows of each group."""
    weights = tfidf_weights(df, row_id, group, message, max_features)
    sizes = df.groupBy(group).agg(F.count(F.lit(1)).alias("__n"))
    means = weights.groupBy(group, "term").agg(F.sum("weight").alias("__s")).join(sizes, group).select(
        group, "term", (F.col("__s") / F.col("__n")).alias("mean_weight"))
    # Weights are compared at nine decimals, so the order of summation cannot decide a tie.
    rounded = means.withColumn("__r", F.round("mean_weight", 9))
    return top_per_key(rounded, [group], [F.col("__r").desc(), F.col("term")], top).drop("__r")


def cluster_examples(df: DataFrame, keywords: DataFrame, order: Column, group: str = "cluster",
                     message: str = "error_msg", label: str = "root_cause_label", k: int = 3) -> DataFrame:
    """Per cluster: most frequent label, keywords, first ``k`` messages joined by `` | ``."""
    labels = top_per_key(
        df.filter(F.col(label).isNotNull()).groupBy(group, label).agg(F.count(F.lit(1)).alias("__n")),
        [group], [F.col("__n").desc(), F.col(label)])
    first = top_per_key(df.select(group, F.col(message).alias("__m"), order.alias("__o")), [group], [F.col("__o")], k)
    # At most ``k`` rows per cluster are left.
    shown = first.groupBy(group).agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("__o", "__m"))), lambda r: r["__m"]),
                     " | ").alias("example_errors"))
    return labels.select(group, label).join(shown, group).join(keywords.select(group, "keywords"), group, "left").select(
        group, label, F.array_join("keywords", ", ").alias("keywords"), "example_errors")


def top_failure_clusters(df: DataFrame, top: int = 5, words: int = 6, group: str = "cluster",
                         label: str = "root_cause_label", message: str = "error_msg") -> DataFrame:
    """Clusters with most messages, with up to six of their distinct keywords in order."""
    counted = df.groupBy(group, label).agg(F.count(message).alias("failure_count"))
    best = top_rows(counted, [F.col("failure_count").desc(), F.col(group)], top)
    distinct = df.select(group, label, F.explode("keywords").alias("word")).distinct()
    # At most ``top`` rows.
    kept = distinct.join(F.broadcast(best.select(group, label)), [group, label], "left_semi")
    listed = top_per_key(kept, [group, label], [F.col("word")], words).groupBy(group, label).agg(
        F.array_join(F.sort_array(F.collect_list("word")), ", ").alias("keywords"))
    return best.join(listed, [group, label], "left").select(
        group, label, "failure_count", F.coalesce("keywords", F.lit("")).alias("keywords"))


def root_cause_keywords(df: DataFrame, label: str = "root_cause_label", top: int = 5) -> DataFrame:
    """Most frequent keywords over the rows of each root cause, ties by word."""
    counted = df.select(label, F.explode("keywords").alias("word")).groupBy(label, "word").agg(
        F.count(F.lit(1)).alias("__n"))
    best = top_per_key(counted, [label], [F.col("__n").desc(), F.col("word")], top)
    return best.groupBy(label).agg(F.array_join(F.transform(
        F.sort_array(F.collect_list(F.struct((-F.col("__n")).alias("n"), "word"))), lambda r: r["word"]),
        ", ").alias("top_keywords"))
