"""Log files to a prioritised list."""

import os

import pytest
from pyspark.sql import functions as F

from failscope.operators.anomaly import detect_anomalies
from failscope.operators.classify import classified, status_classifier
from failscope.operators.cluster import cluster_failures
from failscope.plans import logs as L
from failscope.plans import prioritise as P
from failscope.plans import root_cause as C
from failscope.sources.logs import scan_lines
from failscope.storage import materialize

HEADER = ["DUT NAME : Box", "DUT VERSION = unknown", "OS VERSION: L5", "CONFIGURATION: c", "Test Case: tc_1", "DUT NAME: Late"]
ONE = HEADER + ["Version: 7.1", "no result here", "10:00:01.500 # Result: PASSED all good", "# TEST CASE FAILED",
                "10:00:03.0 CLI ERROR: timeout on port", "10:00:04.0 # Result: ABORTED : no answer", "25:00:00.1 # Result: FAIL"]
TWO = ["# Result: FAIL", "nothing"]


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root = tmp_path_factory.mktemp("raw")
    os.makedirs(root / "2025-09-22/d1/ptp-oc")
    (root / "2025-09-22/d1/ptp-oc/x_ptp-oc_20250922.log").write_text("\n".join(ONE) + "\n")
    (root / "2025-09-22/d1/ptp-oc/plain.log").write_text("\n".join(TWO))
    return str(root)


@pytest.mark.parametrize("limit", [None, 2])
def test_preprocess(spark, folder, limit):
    rows = L.preprocess(scan_lines(spark, folder, ["log"]), limit).orderBy("line_number").collect()
    # The second file has no date anywhere, so its rows go.
    assert {r.filename for r in rows} == {"x_ptp-oc_20250922.log"}
    assert [(r.line_number, r.status, r.error_msg) for r in rows] == [
        (9, "PASS", "No Error"),
        (10, "FAIL", "# TEST CASE FAILED"),
        (12, "ABORT", "no answer"),
        (13, "FAIL", "# TEST CASE FAILED"),
    ]
    first = rows[0]
    assert (first.dut, first.dut_version, first.os_version, first.config, first.test_case_id, first.suite) == (
        "Box", "unknown", "L5", "c", "tc_1", "ptp-oc")
    assert [r.timestamp.strftime("%H:%M:%S") for r in rows] == ["10:00:01", "10:00:01", "10:00:04", "10:00:04"]
    assert {str(r.run_date) for r in rows} == {"2025-09-22"}


def test_header_stops_once_all_is_known(spark):
    lines = [(i + 1, line) for i, line in enumerate(HEADER)]
    df = spark.createDataFrame([("f", n, line) for n, line in lines], "filename string, line_number int, raw_line string")
    assert L.header_fields(df).first().dut_name == "Box"
    early = HEADER[:4] + [HEADER[5].replace("Late", "Early"), HEADER[4]]
    df = spark.createDataFrame([("f", i, line) for i, line in enumerate(early)], "filename string, line_number int, raw_line string")
    assert L.header_fields(df).first().dut_name == "Early"


def test_convert_and_standardise(spark, tmp_path):
    (tmp_path / "r/2025-01-01/generic_dut").mkdir(parents=True)
    text = "tc_1 starts\n2025-02-03 10:00:00 step passed config=abc\n\nlast failed\na - b - PASS\n"
    (tmp_path / "r/2025-01-01/generic_dut/ptp_x.txt").write_text(text)
    lines = scan_lines(spark, str(tmp_path / "r"))
    rows = L.convert(lines).orderBy("line_number").collect()
    assert [(r.line_number, r.run_date, r.status, r.config, r.dut, r.suite) for r in rows] == [
        (1, "2025-01-01", None, "PTP", "ptp_x", "ptp_x.txt"), (2, "2025-02-03", "PASS", "abc", "ptp_x", "ptp_x.txt"),
        (4, "2025-02-03", "FAIL", "PTP", "ptp_x", "ptp_x.txt"), (5, "2025-02-03", "PASS", "PTP", "ptp_x", "ptp_x.txt")]
    assert [r.error_msg for r in rows] == [None, None, "last failed", None]
    simple = L.standardise(lines).collect()
    assert sorted((r.timestamp or "", r.raw or "") for r in simple) == [
        ("", "2025-02-03 10:00:00 step passed config=abc"), ("", "last failed"), ("", "tc_1 starts"), ("a", "")]


@pytest.fixture(scope="module")
def logs(spark):
    """600 parsed rows with failures that depend on the test case."""
    i = F.col("id")
    return materialize(spark.range(600).select(
        F.concat(F.lit("f"), i % 12).alias("filename"), (i + 1).cast("int").alias("line_number"),
        F.concat(F.lit("D"), i % 3).alias("dut"), F.lit(None).cast("string").alias("dut_version"), F.lit("L").alias("os_version"),
        F.concat(F.lit("c"), i % 2).alias("config"), F.concat(F.lit("tc_"), i % 6).alias("test_case_id"),
        F.when(i % 6 < 3, "ptp").otherwise("sip").alias("suite"),
        (F.lit("2025-01-01").cast("timestamp") + F.make_interval(mins=i.cast("int"))).alias("timestamp"),
        F.lit("2025-01-01").cast("date").alias("run_date"),
        F.when(i % 6 == 0, "fail ").when((i % 6 == 1) & (i % 4 == 1), "ABORT").otherwise("PASS").alias("status"),
        F.when(i % 12 == 0, "DUT does not transmit message").when(i % 6 == 0, "Capture id does not exist")
        .when(i % 6 == 1, "run was aborted by user").alias("error_msg"), F.lit("x").alias("raw_line")), "logs")


def test_root_causes_and_priorities(spark, logs):
    features = materialize(C.failure_features(logs))
    assert features.count() == 600
    assert features.filter("status = 'FAIL' and failure_freq_suite = 100").count() == 100
    assert features.filter("failure_freq_suite = 0 and suite = 'sip'").count() == 300
    assert {r.dut_version for r in features.select("dut_version").distinct().collect()} == {"Unknown"}
    clusters = materialize(cluster_failures(features, k=2, seeds=[1]))
    assert clusters.filter("(cluster = -1) = (status = 'FAIL')").count() == 0
    by_message = clusters.filter("cluster >= 0").groupBy("cluster").agg(F.count_distinct("error_msg").alias("n")).collect()
    assert sorted(r.n for r in by_message) == [1, 1]
    labelled, examples = C.label_root_causes(clusters)
    labelled = materialize(labelled)
    assert {tuple(r.keywords) for r in labelled.filter("cluster = -1").select("keywords").distinct().collect()} == {("No keywords",)}
    assert examples.count() == 2
    tables = C.correlation_tables(clusters)
    assert tables["summary"].agg(F.sum("count")).first()[0] == 100
    assert tables["by_suite"].count() == 0 and tables["by_config"].count() > 0

    keyed = labelled.withColumn("row_id", F.concat("filename", F.lit("#"), "line_number"))
    training = materialize(P.training_rows(keyed, "row_id"))
    assert {r.label: r.n for r in training.filter("is_test = 1").groupBy("label").agg(F.count("*").alias("n")).collect()} == {
        "PASS": round(0.2 * training.filter("label = 'PASS'").count()),
        "FAIL": 20, "ABORT": round(0.2 * training.filter("label = 'ABORT'").count())}
    model = status_classifier(training.filter("is_test = 0"), trees=10, depth=6, max_features=50)
    rows = materialize(classified(training, model))
    assert rows.count() == 600
    assert rows.filter("predictedlabel = actualstatus").count() > 540
    anomalies = materialize(detect_anomalies(keyed, "row_id", [F.col("filename"), F.col("line_number")], trees=20, max_features=50))
    assert sorted(r.LogID for r in anomalies.select("LogID").collect()) == list(range(1, 601))

    cases = materialize(P.test_case_features(anomalies, rows))
    assert cases.count() == 600
    assert cases.filter("test_case = 'tc_0' and failure_rate < 1").count() == 0
    unified = P.unified_training_table(logs.withColumn("status", F.trim("status")), rows, labelled, anomalies)
    assert unified.count() == 600
    assert unified.filter("target = 1").count() == 100
    run = P.train_and_prioritise(cases.withColumn("id", F.concat("filename", F.lit("#"), "line_number")), "id", rounds=3, depth=3)
    assert run.metrics.first().recall == 1.0
    assert run.prioritised.count() == 600 and run.risk.filter("risk_level = 'HIGH'").count() <= 60
    assert run.capture.filter("pct = 20").first().captured == run.predictions.filter("actual = 1").count()
