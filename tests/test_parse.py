"""Single lines and names against the values the rules give."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from failscope.functions import parse as P


def one(spark, columns, **inputs):
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in inputs.items()])
    row = df.select(*[c.alias(n) for n, c in columns.items()]).first()
    return row.asDict()


@pytest.mark.parametrize("line,status,message", [
    ("18:06:38.055 # Result: ABORTED  DUT PTP port P1 is not in FAULTY state. .       #", "ABORT",
     "DUT PTP port P1 is not in FAULTY state. .       #"),
    ("17:04:38.174 CLI ERROR: Configuration failed for command: ptp v2tc priority1 128", "FAIL",
     "for command: ptp v2tc priority1 128"),
    ("# TEST CASE PASSED", "PASS", None),
    ("TEST CASE FAILED", "FAIL", "FAILED"),
    ("FAIL", "FAIL", None),
    ("x FAIL: fail", "FAIL", "fail"),
    ("a PASS: moved to FAIL", "PASS", "moved to FAIL"),
    ("bypassed", None, None),
    ("nothing", None, None),
])
def test_result_fields(spark, line, status, message):
    assert one(spark, P.result_fields(F.col("l")), l=line) == {"status": status, "error_msg": message}


@pytest.mark.parametrize("line,status", [
    ("bypassed", "PASS"), ("0 errors found", "FAIL"), ("connection timeout", "ABORT"), ("run interrupted", "ABORT"),
    ("exception occurred", "FAIL"), ("successfully completed", "PASS"), ("pass then fail", "FAIL"), ("hello", None),
    ("17:04:38.174 CLI ERROR: Configuration failed", "FAIL"),
])
def test_keyword_status(spark, line, status):
    assert one(spark, {"s": P.keyword_status(F.col("l"))}, l=line) == {"s": status}


def test_line_fields(spark):
    line = "2025-09-22 10:11:12 tc_conf_1 DUT v1.2.3 config: dual-stack"
    assert one(spark, P.line_fields(F.col("l")), l=line) == {
        "timestamp": "2025-09-22 10:11:12", "test_case_id": "tc_conf_1", "dut_version": "v1.2.3", "config": "dual-stack"}


def test_simple_line(spark):
    assert one(spark, P.simple_line(F.col("l")), l="tcA - tcB - PASS") == {
        "timestamp": "tcA", "testcase": "tcB", "status": "PASS", "raw": None}
    assert one(spark, P.simple_line(F.col("l")), l="other")["raw"] == "other"


@pytest.mark.parametrize("line,stamp", [
    ("18:06:38.055 x", dt.datetime(2025, 9, 22, 18, 6, 38, 55000)), ("25:61:00.1 x", None), (" x", None),
    ("10:00:00.1234567 x", None),
])
def test_clock(spark, line, stamp):
    columns = {"t": P.clock_timestamp(F.col("l"), F.to_date(F.lit("2025-09-22")))}
    assert one(spark, columns, l=line) == {"t": stamp}


@pytest.mark.parametrize("name,want", [
    ("tc_conf_1_ptp-oc_AS_20250922.log", (dt.date(2025, 9, 22), "ptp-oc", "AS", "tc_conf_1_ptp-oc_AS_20250922.log", "DUT_Auto")),
    ("run_x_20259999.log", (None, None, None, "default_tc", "DUT_Auto")),
    ("plain.log", (None, None, None, "default_tc", "DUT_Auto")),
    ("a_DUT7_x.log", (None, None, None, "default_tc", "DUT7")),
])
def test_file_names(spark, name, want):
    n = F.col("n")
    got = one(spark, {
        "d": P.date_from_name(n), "s": P.suite_from_name(n), "v": P.version_from_name(n), "t": P.test_case_from_name(n),
        "u": P.dut_from_name(n)}, n=name)
    assert tuple(got.values()) == want


def test_tokens(spark):
    line = "DUT does not transmit PDELAY_REQ message on     #"
    assert one(spark, {"t": P.tokens(F.col("l"))}, l=line)["t"] == [
        "dut", "does", "not", "transmit", "pdelay_req", "message"]


def test_unicode_classes(spark):
    line = "Test Case FAILED"
    assert one(spark, P.result_fields(F.col("l")), l=line)["status"] == "FAIL"


@pytest.mark.parametrize("base,date,suite", [
    ("tc_conf_ptp_20250922", "2025-09-22", "ptp"), ("20259999_x", "unknown_date", "unknown_suite"),
    ("a_b_123456789", "unknown_date", "123456789"),
])
def test_archive_names(spark, base, date, suite):
    assert one(spark, {"d": P.archive_date(F.col("b")), "s": P.archive_suite(F.col("b"))}, b=base) == {"d": date, "s": suite}
