"""Failures to root causes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from failscope import constants as K
from failscope.functions import values as V
from failscope.operators import text as X
from failscope.operators.history import execution_duration, time_since_last_failure
from failscope.operators.joins import failure_frequency, label_clusters
from failscope.operators.repair import failures_only, with_status
from failscope.operators.trends import cluster_counts, cluster_counts_if_several, monthly_counts
from failscope.sources.columns import add_missing, require, row_order


def failure_features(logs: DataFrame, order: Sequence[Column] | None = None,
                     max_group_rows: int | None = None) -> DataFrame:
    """Failure counts, duration, time since the last failure, flags and buckets per row."""
    order = order or [F.col(c) for c in row_order(logs)]
    df = with_status(logs.withColumn("status", V.normal_status(F.col("status"))), K.STATUSES)
    df = df.withColumn("timestamp", F.col("timestamp").try_cast("timestamp"))
    df = failure_frequency(df, "suite", "failure_freq_suite")
    df = failure_frequency(df, "dut", "failure_freq_dut")
    df = execution_duration(df)
    df = time_since_last_failure(df, order, max_group_rows=max_group_rows)
    message = F.when(F.col("status") == "PASS", K.NO_ERROR).otherwise(F.coalesce("error_msg", F.lit(K.NO_ERROR)))
    return df.withColumns({
        "recent_failure_flag": V.flag(F.col("status") == "FAIL"),
        "config_hash": V.config_bucket(F.col("config")),
        "dut_version": F.coalesce("dut_version", F.lit(K.UNKNOWN)),
        "error_msg": message,
    })


def label_root_causes(df: DataFrame, order: Column | None = None, default: str = K.NORMAL,
                      stop_words: Sequence[str] | None = None, strip: bool = True) -> tuple[DataFrame, DataFrame]:
    """(labelled rows, examples per cluster) from rows with a cluster number."""
    require(df, ["cluster", "error_msg"])
    order = order if order is not None else F.struct(*[F.col(c) for c in row_order(df)])
    df = df.withColumn("error_msg", F.coalesce("error_msg", F.lit(K.NO_ERROR)))
    failures = df.filter(F.col("cluster") != -1)
    keywords = X.top_keywords(failures, "cluster", "error_msg", order, stop_words=stop_words, strip=strip)
    labelled = X.attach_keywords(label_clusters(df, default), keywords)
    examples = X.cluster_examples(label_clusters(failures, default), keywords, order)
    return labelled, examples


def correlation_tables(df: DataFrame) -> dict[str, DataFrame]:
    """Cluster counts alone and against DUT version, configuration, suite and month."""
    filled = add_missing(df, {c: K.UNKNOWN for c in ("cluster", "dut_version", "config", "run_date", "suite")})
    rows = failures_only(filled).withColumns({
        c: F.coalesce(F.col(c).cast("string"), F.lit(K.UNKNOWN)) for c in ("dut_version", "config", "suite")})
    summary = rows.groupBy("cluster").agg(F.count(F.lit(1)).alias("count")).orderBy(F.col("count").desc(), "cluster")
    return {
        "summary": summary,
        "by_dut_version": cluster_counts(rows, "dut_version"),
        "by_config": cluster_counts(rows, "config"),
        "by_suite": cluster_counts_if_several(rows, "suite"),
        "by_month": monthly_counts(
            rows.withColumn("run_date", F.col("run_date").try_cast("timestamp")), "run_date", "cluster"),
    }
