"""Small cases in which pandas habits and SQL habits give different results."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from failscope.functions.values import weekday
from failscope.operators import evaluate as E
from failscope.operators import history as H
from failscope.operators import joins as J
from failscope.operators import repair as R
from failscope.operators import text as X
from failscope.operators import trends as T

DAY = [dt.datetime(2025, 1, d, 10) for d in (3, 4, 5)]


def test_backward_fill_stays_in_the_file(spark):
    df = spark.createDataFrame([("a", 1, None), ("b", 1, None), ("b", 2, 5)], "f string, n int, v int")
    out = R.fill_both_ways(df, ["f"], [F.col("n")], ["v"])
    assert sorted(map(tuple, out.collect()), key=str) == [("a", 1, None), ("b", 1, 5), ("b", 2, 5)]


def test_null_keys_match_in_joins(spark):
    left = spark.createDataFrame([("a", 1), (None, 2)], "k string, x int")
    right = spark.createDataFrame([("a", 3), (None, 4)], "k string, y int")
    out = J.null_safe_left_join(left, right, ["k"])
    assert sorted((r.x, r.y) for r in out.collect()) == [(1, 3), (2, 4)]


def test_null_keys_have_no_rate(spark):
    df = spark.createDataFrame([("a", 1), ("a", 0), (None, 1)], "t string, fail_flag int")
    out = H.failure_rates(df, {"t": "rate", "absent": "none"})
    assert sorted((r.rate, r.none) for r in out.collect() if r.t) == [(0.5, 0.0), (0.5, 0.0)]
    assert [r.rate for r in out.collect() if r.t is None] == [None]


def test_failure_rate_is_over_the_day_total(spark):
    df = spark.createDataFrame([(DAY[0], s) for s in ("FAIL", "PASS", "PASS", "PASS")], "run_date timestamp, status string")
    assert T.daily_rates(df).first().failure_rate == 0.25


def test_aggregates_of_large_inputs_are_written_first(spark, monkeypatch):
    """With every input taken for large the results stay the same and the join is broadcast by size."""
    from failscope import storage

    monkeypatch.setattr(storage, "SMALL_INPUT", 0)
    df = spark.createDataFrame([("a", 1), ("a", 0), (None, 1)], "t string, fail_flag int")
    out = H.failure_rates(df, {"t": "rate"})
    assert sorted((r.t or "", r.rate) for r in out.collect()) == [("", None), ("a", 0.5), ("a", 0.5)]
    assert "BroadcastHashJoin" in out._jdf.queryExecution().executedPlan().toString()


def test_history_of_three_days(spark):
    rows = [("d", "t", s, ts, i, int(s == "FAIL")) for i, (s, ts) in enumerate(zip(("FAIL", "PASS", "FAIL"), DAY))]
    df = spark.createDataFrame(rows, "dut string, test_case_id string, status string, timestamp timestamp, i int, is_fail int")
    order = [F.col("i")]
    since = H.time_since_last_failure(df, order).orderBy("i")
    assert [r.time_since_last_failure for r in since.collect()] == [0.0, 0.0, 172800.0]
    final = H.offset_to_final_failure(df.withColumn("executiontime", F.col("timestamp")), order).orderBy("i")
    assert [r.time_since_last_failure for r in final.collect()] == [-172800.0, 0.0, 0.0]
    past = H.test_case_history(df, order).orderBy("i")
    assert [(r.past_failure_rate, r.execution_frequency, r.avg_duration) for r in past.collect()] == [
        (0.0, 0, 0.0), (1.0, 1, 0.0), (0.5, 2, 0.0)]


def test_undated_failure_counts_as_no_failure_time(spark):
    rows = [("d", "t", "FAIL", ts, i) for i, ts in enumerate((DAY[0], None, DAY[1]))]
    df = spark.createDataFrame(rows, "dut string, test_case_id string, status string, timestamp timestamp, i int")
    out = H.time_since_last_failure(df, [F.col("i")]).orderBy("i")
    assert [r.time_since_last_failure for r in out.collect()] == [0.0, 0.0, 86400.0]


def test_seven_day_bins_start_on_the_first_date(spark):
    days = [dt.datetime(2025, 1, 3, 10), dt.datetime(2025, 1, 5), dt.datetime(2025, 1, 20)]
    df = spark.createDataFrame([(d, "s", 1.0) for d in days], "d timestamp, suite string, x double")
    got = sorted(r.bin_start for r in T.trend_by_bins(df, "d", "suite", "x").collect())
    assert got == [dt.date(2025, 1, 3), dt.date(2025, 1, 17)]


def test_six_percent_of_a_hundred_is_six(spark):
    df = spark.range(100).select("id", (F.col("id") % 4 == 0).cast("int").alias("y"), (F.col("id") / 100).alias("s"))
    cuts = {r.pct: r.k for r in E.top_k_capture(df, "y", "s", "id").collect()}
    assert [cuts[p] for p in (1, 6, 14, 15, 18, 20)] == [1, 6, 14, 15, 18, 20]
    full = E.top_k_capture(df, "y", "s", "id", percents=[100], max_group_rows=13).first()
    assert (full.k, full.captured, full.captured_pct) == (100, 25, 100.0)


def test_keywords_are_not_fused(spark):
    df = spark.createDataFrame([("L", ["does", "not"])] * 2, "root_cause_label string, keywords array<string>")
    assert X.root_cause_keywords(df).first().top_keywords == "does, not"


def test_most_frequent_label_is_the_smallest_of_a_tie(spark):
    df = spark.createDataFrame([(0, x, "m", i) for i, x in enumerate("baba")], "cluster int, root_cause_label string, error_msg string, i int")
    words = X.top_keywords(df, "cluster", "error_msg", F.col("i"))
    row = X.cluster_examples(df, words, F.col("i")).first()
    assert (row.root_cause_label, row.keywords, row.example_errors) == ("a", "<no_keywords>", "m | m | m")


def test_keyword_ties_keep_the_first_seen(spark):
    df = spark.createDataFrame([(0, "zeta alpha", 1), (0, "alpha zeta beta", 2)], "cluster int, error_msg string, i int")
    assert X.top_keywords(df, "cluster", "error_msg", F.col("i")).first().keywords == ["zeta", "alpha", "beta"]


def test_monday_is_zero(spark):
    assert spark.range(1).select(weekday(F.lit("2025-01-06").cast("date")).alias("d")).first().d == 0


def test_duplicate_right_rows_are_an_error_unless_reduced(spark):
    left = spark.createDataFrame([("a", 1)], "k string, x int")
    right = spark.createDataFrame([("a", 3), ("a", 2)], "k string, y int")
    with pytest.raises(ValueError):
        J.many_to_one(left, right, ["k"])
    assert J.many_to_one(left, right, ["k"], [F.col("y")]).first().y == 2


def test_context_reason_stays_in_the_file(spark):
    rows = [("a", 1, "PASS", None, "an error here"), ("b", 1, "FAIL", None, "plain"), ("b", 2, "PASS", "", "x timeout"),
            ("c", 1, "FAIL", "", "plain")]
    df = spark.createDataFrame(rows, "filename string, line_number int, status string, error_msg string, raw_line string")
    got = {(r.filename, r.line_number): r.error_msg for r in R.reason_from_context(df).collect()}
    assert got == {("a", 1): "Failure reason not found", ("b", 1): "x timeout", ("b", 2): "", ("c", 1): "Failure reason not found"}


def test_histogram_of_a_constant_and_of_nothing(spark):
    df = spark.createDataFrame([(2.0,), (2.0,)], "x double")
    rows = T.histogram(df, "x", 4).collect()
    assert sum(r["count"] for r in rows) == 2 and len(rows) == 4
    assert T.histogram(df.filter("x > 5"), "x", 4).count() == 0
    assert T.density_curve(df, "x").count() == 0
