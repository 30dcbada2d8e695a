"""Labelled rows to a prioritised list of test cases."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from failscope import constants as K
from failscope.functions import parse as P
from failscope.functions import values as V
from failscope.operators import classify as C
from failscope.operators.boosting import BoostedTrees
from failscope.operators.dedupe import best_per_key, distinct_rows
from failscope.operators.encode import label_encode, stratified_split
from failscope.operators.evaluate import binary_metrics, top_k_capture
from failscope.operators.history import (
    failure_rates, offset_to_final_failure, past_failure_frequency, regression_group, schedule_cycle,
    test_case_history,
)
from failscope.operators.joins import join_available, many_to_one, null_safe_left_join
from failscope.operators.repair import coalesced_status, fill_constants
from failscope.operators.scoring import prioritise, risk_scores
from failscope.sources.columns import drop, keep, normalise_headers, rename, row_order
from failscope.storage import materialize

MERGE_KEYS = ("filename", "dut", "suite", "test_case")


def choose_label(df: DataFrame) -> DataFrame:
    """Label = status where the frame has any status at all, else the root cause."""
    if "status" in df.columns:
        any_status = df.agg(F.max(F.col("status").isNotNull()).alias("s")).scalar()
        other = F.col("root_cause_label") if "root_cause_label" in df.columns else F.lit(None).cast("string")
        return df.withColumn("label", F.when(any_status, F.upper("status")).otherwise(other))
    if "root_cause_label" in df.columns:
        return df.withColumn("label", F.col("root_cause_label"))
    raise KeyError("no status or root_cause_label column")


def training_rows(df: DataFrame, row_id: str, fraction: float = 0.2, seed: int = 42) -> DataFrame:
    """Meta, feature and label columns, filled, with ``is_test`` marking the stratified test part."""
    labelled = choose_label(normalise_headers(df))
    kept = keep(labelled, [row_id, *K.TRAINING_META, *K.TRAINING_FEATURES, "label"])
    joined = [c for c, t in kept.dtypes if t == "array<string>"]
    kept = kept.withColumns({c: F.array_join(c, ", ") for c in joined})
    filled = fill_constants(kept, {"cluster": -1, "root_cause_label": K.NORMAL})
    filled = filled.fillna(K.UNKNOWN)
    return stratified_split(filled, "label", row_id, fraction, seed)


def test_case_features(anomalies: DataFrame, classified: DataFrame, order: Sequence[str] | None = None,
                       max_group_rows: int | None = None) -> DataFrame:
    """Anomaly rows joined with their classification, and the failure history of each."""
    left, right = normalise_headers(anomalies), normalise_headers(classified)
    right = rename(right, {"test_case_id": "test_case", "predictedlabel": "predicted_label",
                           "actualstatus": "actual_status", "errormsg": "error_msg",
                           "logid": "log_id", "messagesnippet": "message_snippet"})
    left = rename(left, {"test_case_id": "test_case", "logid": "log_id", "messagesnippet": "message_snippet"})
    ties = [F.col(c) for c in right.columns if c not in MERGE_KEYS and c != "confidence"]
    right = best_per_key(distinct_rows(right), MERGE_KEYS, "confidence", ties)
    df = null_safe_left_join(distinct_rows(left), right, MERGE_KEYS, ("_anom", "_clf"))
    status = F.col("status") if "status" in df.columns else F.lit("")
    df = df.withColumn("actual_status", coalesced_status(F.col("actual_status"), status))
    df = df.withColumn("fail_flag", V.flag(F.col("actual_status") == "FAIL"))
    df = failure_rates(df, {"test_case": "failure_rate", "suite": "suite_fail_rate", "dut": "dut_fail_rate"})
    # Written once: the two orderings below would each run the joins again.
    df = materialize(regression_group(df), "cases")
    keys = [c for c in ("dut", "suite", "run_date", "timestamp") if c in df.columns]
    last = [F.col(c) for c in (order or row_order(df))]
    time = [x for c in keys for x in (F.col(c).isNull(), F.col(c))] + last
    df = schedule_cycle(df, time[4:], max_group_rows=max_group_rows)
    df = past_failure_frequency(df, time, max_group_rows=max_group_rows)
    return distinct_rows(drop(df, ["error_msg_anom", "error_msg_clf"]))


UNIFIED_COLUMNS = [
    "test_case_id", "executiontime", "past_failure_rate", "time_since_last_failure", "execution_frequency",
    "avg_duration", "keyword_fail", "clusterlabel", "rolling_anomaly_rate", "mean_anomaly_score", "exec_day",
    "exec_hour", "dut_version", "dut", "config", "regression_group", "schedule_cycle", "buildversion", "suite",
    "target",
]


def unified_training_table(logs: DataFrame, classified: DataFrame, clusters: DataFrame, anomalies: DataFrame,
                           order: Sequence[str] | None = None,
                           anomaly_keys: Sequence[str] = ("path", "filename", "test_case_id", "suite", "line_number"),
                           max_group_rows: int | None = None) -> DataFrame:
    """Logs with classification, cluster and anomaly columns, and features from their history.

    An anomaly row belongs to one log line, so the line number is among the
    keys where both sides have it; joining on the file alone would pair every
    line of a file with every other.
    """
    logs, classified, clusters, anomalies = map(normalise_headers, (logs, classified, clusters, anomalies))
    classified, anomalies = (rename(x, {"testcase": "test_case_id"}) for x in (classified, anomalies))
    order = order or row_order(logs)
    # The first row per key; rows without a position are compared as a whole.
    first = lambda df: [F.col(c) for c in row_order(df) if c in df.columns] + [F.struct(*sorted(
        c for c, t in df.dtypes if not t.startswith("map")))]
    keys = ["test_case_id", "suite"]
    df = many_to_one(logs, classified, keys, first(classified), ("", "_clf"))
    df = many_to_one(df, clusters, keys, first(clusters), ("", "_clu"))
    df = join_available(df, anomalies, anomaly_keys, ["anomaly_score", "is_anomaly", "messagesnippet"])
    by = [F.col(c) for c in order]
    score = F.col("anomaly_score") if "anomaly_score" in df.columns else F.lit(None).cast("double")
    anomaly = F.col("is_anomaly") if "is_anomaly" in df.columns else F.lit(None).cast("int")
    snippet = F.col("messagesnippet") if "messagesnippet" in df.columns else F.lit(None).cast("string")
    df = df.withColumns({
        "executiontime": F.col("timestamp").try_cast("timestamp"),
        "anomaly_score": F.coalesce(score, F.lit(0.0)),
        "is_anomaly": F.coalesce(anomaly, F.lit(0)),
        "is_fail": V.is_fail(F.col("status")),
        "keyword_fail": P.keyword_flag(snippet),
        "clusterlabel": F.coalesce(F.col("cluster"), F.lit(-1)) if "cluster" in df.columns else F.lit(-1),
        "target": V.is_fail(F.col("status")),
    })
    # Written once: the history and each encoded column would otherwise run the joins again.
    joined = df = materialize(df, "unified")
    df = offset_to_final_failure(df, by)
    df = test_case_history(df, by, max_group_rows=max_group_rows)
    df = df.withColumns({"exec_day": V.weekday(F.col("executiontime")), "exec_hour": F.hour("executiontime")})
    codes = ["dut_version", "dut", "config", "regression_group", "schedule_cycle", "buildversion", "suite"]
    kept = [*[c for c in UNIFIED_COLUMNS if c in df.columns], *[c for c in order if c not in UNIFIED_COLUMNS]]
    return label_encode(df.select(*kept), codes, codes_from=joined)


@dataclass
class RiskRun:
    model: BoostedTrees
    predictions: DataFrame
    metrics: DataFrame
    capture: DataFrame
    importance: DataFrame
    prioritised: DataFrame
    risk: DataFrame


def train_and_prioritise(df: DataFrame, row_id: str, rounds: int = 400, depth: int = 6, seed: int = 42,
                         encode_train_only: bool = False) -> RiskRun:
    """Train the failure model, evaluate it on the held-out part, and rank all rows.

    Categories are encoded over all rows, or, without the leak of held-out labels that this
    means, over the training rows only.
    """
    split = materialize(stratified_split(C.fail_target(df), "isFail", row_id, 0.2, seed), "risk-split")
    rows, features = C.risk_features(split, F.col("is_test") == 0 if encode_train_only else None)
    rows = materialize(rows, "risk-features")
    model = C.risk_model(rows.filter("is_test = 0"), features, rounds=rounds, depth=depth, seed=seed)
    scored = materialize(C.risk_scored(rows, model), "risk-scores")
    held_out = scored.filter("is_test = 1").withColumn("pred_label", V.flag(F.col("pred_prob") >= 0.5))
    importance = C.feature_importance(model, df.sparkSession)
    ranked = prioritise(scored)
    # At most ten feature names.
    strongest = [r.feature for r in importance.limit(10).collect()]
    return RiskRun(
        model=model,
        predictions=held_out.select(*features, F.col("isFail").alias("actual"), "pred_prob", "pred_label"),
        metrics=binary_metrics(held_out, "isFail", "pred_label"),
        capture=top_k_capture(held_out, "isFail", "pred_prob", row_id),
        importance=importance,
        prioritised=ranked,
        risk=risk_scores(ranked, strongest),
    )
