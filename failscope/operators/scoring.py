"""Priority scores, risk tiers and their exports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from failscope.constants import CLUSTER_CANDIDATES
from failscope.functions import values as V
from failscope.operators.dedupe import nulls_last
from failscope.operators.joins import attach
from failscope.operators.quantiles import exact_quantiles
from failscope.sources.columns import resolve


def add_weights(df: DataFrame, fail: str = "isFail") -> DataFrame:
    """Recency and cluster weight; 1 where the frame lacks their column."""
    if "time_since_last_failure" in df.columns:
        df = df.withColumn("recency_weight", V.recency_weight(F.col("time_since_last_failure")))
    else:
        df = df.withColumn("recency_weight", F.lit(1.0))
    cluster = resolve(df, CLUSTER_CANDIDATES)
    if cluster is None:
        return df.withColumn("cluster_weight", F.lit(1.0))
    df = attach(df, [cluster], cluster_fail_rate=F.avg(fail))
    return df.withColumn("cluster_fail_rate", F.coalesce("cluster_fail_rate", F.lit(0.0))).withColumn(
        "cluster_weight", V.cluster_weight(F.col("cluster_fail_rate")))


def prioritise(df: DataFrame, fail: str = "isFail", probability: str = "pred_prob", sort: bool = True) -> DataFrame:
    """Weights, priority score and tier of every scored row, highest first.

    The two thresholds need the scores first; give a written table, not a model
    transform, so that the model is not applied again for each pass.
    """
    scored = add_weights(df, fail).withColumn("priority_score", V.priority_score(
        F.col(probability), F.col("recency_weight"), F.col("cluster_weight")))
    high, medium = exact_quantiles(scored, "priority_score", [0.90, 0.60])
    out = scored.withColumn("priority_group", V.risk_tier(
        F.col("priority_score"), high, medium, ("HIGH RISK", "MEDIUM RISK", "LOW RISK")))
    return nulls_last(out, "priority_score", descending=True) if sort else out


def risk_scores(df: DataFrame, top_features: Sequence[str] = (), sort: bool = True) -> DataFrame:
    """Test case, probability, score, tier and the values of the strongest features."""
    if "predicted_probability" not in df.columns:
        if "pred_prob" not in df.columns:
            raise KeyError("expected 'pred_prob' or 'predicted_probability'")
        df = df.withColumn("predicted_probability", F.col("pred_prob"))
    if "priority_score" not in df.columns:
        df = df.withColumn("priority_score", F.col("predicted_probability"))
    high, medium = exact_quantiles(df, "priority_score", [0.90, 0.60])
    case = resolve(df, ["test_case", "test_case_id"], required=True)
    out = df.select(
        F.col(case).alias("test_case"), "predicted_probability", "priority_score",
        V.risk_tier(F.col("priority_score"), high, medium).alias("risk_level"),
        V.feature_summary(df, top_features).alias("top_features"))
    if not sort:
        return out
    return out.orderBy(F.col("priority_score").desc_nulls_last(), F.col("predicted_probability").desc_nulls_last())
