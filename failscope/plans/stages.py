"""The stages from raw logs to the prioritised list, one function each.

A stage reads the tables of earlier stages below ``base`` and writes its own as
parquet, so a lost job restarts at its stage and not at the raw logs.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from failscope.operators import anomaly as A
from failscope.operators import classify as C
from failscope.operators import evaluate as E
from failscope.operators import profile as R
from failscope.operators import trends as T
from failscope.operators.cluster import cluster_failures
from failscope.operators.text import root_cause_keywords, top_failure_clusters
from failscope.operators.vectors import save_model
from failscope.plans import logs as L
from failscope.plans import prioritise as P
from failscope.plans import root_cause as Q
from failscope.sources import archive
from failscope.sources.columns import file_key, resolve
from failscope.sources.logs import scan_lines
from failscope.sources.tables import read_optional, write_csv, write_table
from failscope.storage import materialize

Tables = dict[str, DataFrame]


def with_row_id(df: DataFrame) -> DataFrame:
    return df.withColumn("row_id", F.concat(F.col(file_key(df)), F.lit("#"), F.col("line_number")))


def _read(spark: SparkSession, base: str, name: str) -> DataFrame:
    found = read_optional(spark, f"{base}/{name}")
    if found is None:
        raise FileNotFoundError(f"{base}/{name}: run the stage that writes it first")
    return found


def extract(spark: SparkSession, base: str, source: str, **_) -> Tables:
    rows = archive.member_keys(archive.scan_archives(spark, source))
    archive.write_partitioned(rows, f"{base}/archive_lines")
    return {}


def standardise(spark: SparkSession, base: str, source: str, **_) -> Tables:
    return {"lines_simple": L.standardise(scan_lines(spark, source))}


def convert(spark: SparkSession, base: str, source: str, **_) -> Tables:
    return {"lines_keyword": L.convert(scan_lines(spark, source))}


def preprocess(spark: SparkSession, base: str, source: str, **_) -> Tables:
    """The log files below ``source``, or the extracted archive lines when none is given."""
    if source:
        lines = scan_lines(spark, source, ["log"])
    else:
        lines = _read(spark, base, "archive_lines").filter(F.col("filename").endswith(".log")).select(
            F.concat_ws("/", "archive", "member").alias("path"), "filename", "line_number", "raw_line")
    return {"logs": L.preprocess(lines)}


def profile(spark: SparkSession, base: str, **_) -> Tables:
    logs = _read(spark, base, "logs")
    return {
        "missing": R.missing_report(logs), "coverage": R.coverage_report(logs), "critical": R.critical_coverage(logs),
        "gaps": R.data_gaps(logs), "status_counts": R.value_counts(logs, "status"),
        "suite_counts": R.value_counts(logs, "suite", nulls=True), "top_reasons": R.top_failure_reasons(logs),
        "top_categories": R.top_failure_categories(logs), "daily_status": T.status_by_day(logs),
        "spikes": T.failure_spikes(logs, only=False),
    }


def features(spark: SparkSession, base: str, **_) -> Tables:
    return {"features": Q.failure_features(_read(spark, base, "logs"))}


def cluster(spark: SparkSession, base: str, k: int = 10, **_) -> Tables:
    return {"clusters": cluster_failures(_read(spark, base, "features"), k=k)}


def root_cause(spark: SparkSession, base: str, **_) -> Tables:
    labelled, examples = Q.label_root_causes(_read(spark, base, "clusters"))
    written = materialize(labelled, "labelled")
    failures = written.filter(F.col("cluster") != -1)
    return {
        "labelled": written, "root_cause_examples": examples,
        "root_cause_counts": R.value_counts(written, "root_cause_label"),
        "root_cause_share": T.share_of_total(failures, "root_cause_label"),
        "root_cause_keywords": root_cause_keywords(written), "top_clusters": top_failure_clusters(failures),
    }


def correlate(spark: SparkSession, base: str, **_) -> Tables:
    tables = Q.correlation_tables(_read(spark, base, "clusters"))
    return {f"cluster_{name}": df for name, df in tables.items()}


def classify(spark: SparkSession, base: str, trees: int = 300, depth: int = 30, **_) -> Tables:
    rows = materialize(P.training_rows(with_row_id(_read(spark, base, "labelled")), "row_id"), "training")
    model = C.status_classifier(rows.filter("is_test = 0"), trees=trees, depth=depth)
    save_model(model, f"{base}/status_model")
    out = materialize(C.classified(rows, model), "classified")
    held_out = C.classified(rows.filter("is_test = 1"), model)
    return {
        "training_rows": rows, "classified": out,
        "classification_report": E.class_report(held_out, "actualstatus", "predictedlabel"),
        "confusion": E.confusion_matrix(held_out, "actualstatus", "predictedlabel"),
    }


def anomalies(spark: SparkSession, base: str, trees: int = 300, **_) -> Tables:
    rows = with_row_id(_read(spark, base, "labelled"))
    model = A.fit_anomaly_model(rows, "row_id", trees=trees)
    model.save(spark, f"{base}/anomaly_model")
    scored = materialize(A.detect_anomalies(
        rows, "row_id", [F.col(file_key(rows)), F.col("line_number")], model=model), "anomalies")
    axes = A.message_axes(scored)
    return {
        "anomalies": scored,
        "anomalies_detected": scored.filter("is_anomaly = 1").select("LogID", "MessageSnippet", "anomaly_score", "is_anomaly",
                                                                     "test_case_id", "dut", "suite"),
        "score_histogram": T.histogram(scored, "anomaly_score", 50), "score_density": T.density_curve(scored, "anomaly_score"),
        "message_points": axes.select("row_id", "pca_1", "pca_2", "is_anomaly"), "anomaly_points": A.anomaly_points(axes),
    }


def test_cases(spark: SparkSession, base: str, **_) -> Tables:
    scored, classified = _read(spark, base, "anomalies"), _read(spark, base, "classified")
    unified = P.unified_training_table(_read(spark, base, "logs"), classified, _read(spark, base, "labelled"), scored)
    return {"testcases": P.test_case_features(scored, classified), "testcases_alt": unified}


def prioritise(spark: SparkSession, base: str, rounds: int = 400, depth: int = 6, **_) -> Tables:
    run = P.train_and_prioritise(_read(spark, base, "testcases"), "row_id", rounds=rounds, depth=depth)
    run.model.save(spark, f"{base}/risk_model")
    return {
        "prioritised": run.prioritised, "risk_scores": run.risk, "test_predictions": run.predictions,
        "risk_metrics": run.metrics, "topk": run.capture, "importance": run.importance,
        "roc": E.roc_points(run.predictions, "actual", "pred_prob"), "auc": E.roc_auc(run.predictions, "actual", "pred_prob"),
        "calibration": E.calibration_curve(run.predictions, "actual", "pred_prob"),
        "risk_confusion": E.confusion_matrix(run.predictions, "actual", "pred_label", [0, 1]),
    }


def dashboard(spark: SparkSession, base: str, **_) -> Tables:
    rows = _read(spark, base, "prioritised")
    case = resolve(rows, ["test_case", "test_case_id"], required=True)
    return {
        "probability_histogram": T.histogram(rows, "pred_prob", 40), "probability_density": T.density_curve(rows, "pred_prob"),
        "top_cases": T.top_mean(rows, case, "priority_score"), "risk_heat_map": T.risk_heat_map(rows, case, "dut", "priority_score"),
        "suite_trend": T.trend_by_bins(rows.withColumn("run_date", F.col("run_date").try_cast("timestamp")), "run_date", "suite",
                                       "priority_score"),
        "report_totals": R.report_totals(rows),
    }


STAGES: dict[str, Callable[..., Tables]] = {
    "extract": extract, "standardise": standardise, "convert": convert, "preprocess": preprocess, "profile": profile,
    "features": features, "cluster": cluster, "root-cause": root_cause, "correlate": correlate, "classify": classify,
    "anomalies": anomalies, "test-cases": test_cases, "prioritise": prioritise, "dashboard": dashboard,
}


def run(spark: SparkSession, stage: str, base: str, source: str = "", csv: bool = False, **options) -> list[str]:
    """Run one stage; returns the names of the tables it wrote below ``base``."""
    tables = STAGES[stage](spark, base.rstrip("/"), source=source, **options)
    for name, df in tables.items():
        write_table(df, f"{base}/{name}")
        if csv:
            flat = df.select(*[F.array_join(c, ", ").alias(c) if t == "array<string>" else F.col(c) for c, t in df.dtypes])
            write_csv(flat, f"{base}/csv/{name}")
    return list(tables)


