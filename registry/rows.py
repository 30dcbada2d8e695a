"""Repair, joins, history and de-duplication."""

from __future__ import annotations

from pyspark.sql import functions as F

from failscope import constants as K
from failscope.operators import dedupe as G
from failscope.operators import history as H
from failscope.operators import joins as J
from failscope.operators import repair as R
from failscope.operators.encode import target_encode, target_encode_fitted
from failscope.operators.ordered import global_row_number
from failscope.operators.scoring import add_weights
from failscope.operators.text import attach_keywords, top_keywords
from registry.base import ev_sql, logs_ev, query, r, stamp, table
from registry.parsing import _FIRST_SUITE, _STOPS

CONTEXT = "error|fail|reason|exception|invalid|timeout|abort|crash|assert|not\\s+transmit"


@query("c01_status_filter", ev_sql("SELECT event_id, status FROM ev WHERE status IN ('FAIL', 'ABORT')"))
def _(spark, sf):
    return R.with_status(logs_ev(spark, sf), ["FAIL", "ABORT"]).select("event_id", "status")


_GAPS = """g AS (SELECT *, CASE WHEN event_id % 3 <> 0 THEN status END AS s, CASE WHEN event_id % 5 <> 0 THEN error_msg END AS m FROM ev)"""


@query("c02_status_or_message", ev_sql("SELECT event_id, s AS status, m AS error_msg FROM g WHERE s IS NOT NULL OR m IS NOT NULL", _GAPS))
def _(spark, sf):
    rows = logs_ev(spark, sf).select(
        "event_id", F.when(F.col("event_id") % 3 != 0, F.col("status")).alias("status"),
        F.when(F.col("event_id") % 5 != 0, F.col("error_msg")).alias("error_msg"))
    return R.with_status_or_message(rows)


@query("c03_failures_only", ev_sql("SELECT event_id, cluster FROM ev WHERE cluster >= 0"))
def _(spark, sf):
    return R.failures_only(logs_ev(spark, sf)).select("event_id", "cluster")


@query("c04_anomalies_only", ev_sql("SELECT event_id, left(error_msg, 150) || '...' AS snippet, dut FROM ev WHERE value < 2"))
def _(spark, sf):
    df = logs_ev(spark, sf).withColumn("is_anomaly", (F.col("value") < 2).cast("int"))
    return R.anomalies_only(df, ["event_id", F.concat(F.left("error_msg", F.lit(150)), F.lit("...")).alias("snippet"), "dut"])


@query("c05_constant_fill", ev_sql("""
SELECT event_id, coalesce(c, -1) AS cluster, coalesce(l, 'Normal') AS root_cause_label, coalesce(error_msg, 'Unknown') AS error_msg FROM
(SELECT event_id, error_msg, CASE WHEN cluster >= 0 THEN cluster END AS c, CASE WHEN event_id % 2 = 0 THEN dut END AS l FROM ev)"""))
def _(spark, sf):
    rows = logs_ev(spark, sf).select(
        "event_id", "error_msg", F.when(F.col("cluster") >= 0, F.col("cluster")).alias("cluster"),
        F.when(F.col("event_id") % 2 == 0, F.col("dut")).alias("root_cause_label"))
    return R.fill_constants(rows, {"event_id": 0, "cluster": -1, "root_cause_label": K.NORMAL}, K.UNKNOWN)


@query("c06_fill_both_ways", ev_sql("""
SELECT event_id, strftime(coalesce(last_value(t IGNORE NULLS) OVER w, first_value(t IGNORE NULLS) OVER v), '%Y-%m-%d %H:%M:%S.%f') AS stamp
FROM (SELECT *, CASE WHEN event_id % 4 = 0 THEN "timestamp" END AS t FROM ev)
WINDOW w AS (PARTITION BY filename ORDER BY line_number ROWS UNBOUNDED PRECEDING),
 v AS (PARTITION BY filename ORDER BY line_number ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"""))
def _(spark, sf):
    rows = logs_ev(spark, sf).select(
        "event_id", "filename", "line_number", F.when(F.col("event_id") % 4 == 0, F.col("timestamp")).alias("t"))
    return R.fill_both_ways(rows, ["filename"], [F.col("line_number")], ["t"]).select("event_id", stamp("t").alias("stamp"))


@query("c07_suite_fill", ev_sql("""
SELECT event_id, coalesce(last_value(s IGNORE NULLS) OVER w, first_value(s IGNORE NULLS) OVER v) AS suite
FROM (SELECT *, CASE WHEN event_id % 6 = 0 THEN suite || event_id END AS s FROM ev)
WINDOW w AS (PARTITION BY dut, test_case_id ORDER BY filename, line_number ROWS UNBOUNDED PRECEDING),
 v AS (PARTITION BY dut, test_case_id ORDER BY filename, line_number ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"""))
def _(spark, sf):
    rows = logs_ev(spark, sf).select(
        "event_id", "dut", "test_case_id", "filename", "line_number",
        F.when(F.col("event_id") % 6 == 0, F.concat("suite", "event_id")).alias("suite"))
    out = R.fill_both_ways(rows, ["dut", "test_case_id"], [F.col("filename"), F.col("line_number")], ["suite"])
    return out.select("event_id", "suite")


_MESSY = """m AS (SELECT *, CASE event_id % 3 WHEN 0 THEN 'No Error' WHEN 1 THEN 'no error' ELSE error_msg END AS msg FROM ev)"""


@query("c08_conditional_overwrite", ev_sql("""
SELECT event_id, CASE WHEN status = 'PASS' THEN 'No Error' WHEN lower(msg) = 'no error' THEN NULL ELSE msg END AS error_msg FROM m""", _MESSY))
def _(spark, sf):
    kind = F.col("event_id") % 3
    rows = logs_ev(spark, sf).withColumn("error_msg", F.when(kind == 0, "No Error").when(kind == 1, "no error").otherwise(F.col("error_msg")))
    return R.pass_and_fail_messages(rows).select("event_id", "error_msg")


@query("c09_context_repair", ev_sql(f"""
SELECT event_id, CASE WHEN status IN ('FAIL', 'ABORT') AND coalesce(error_msg, '') = ''
  THEN coalesce(first_value(CASE WHEN regexp_matches(raw_line, '(?i)({CONTEXT})') THEN trim(raw_line) END IGNORE NULLS) OVER
   (PARTITION BY filename ORDER BY line_number ROWS BETWEEN 10 PRECEDING AND 10 FOLLOWING), 'Failure reason not found')
  ELSE coalesce(error_msg, 'Failure reason not found') END AS error_msg FROM ev"""))
def _(spark, sf):
    rows = logs_ev(spark, sf).select("event_id", "filename", "line_number", "status", "error_msg", "raw_line")
    return R.reason_from_context(rows).select("event_id", "error_msg")


@query("c10_date_backstop", ev_sql("""
SELECT event_id, CAST(d AS VARCHAR) AS run_date FROM (SELECT event_id, coalesce(CASE WHEN event_id % 2 = 0 THEN run_date END,
  CASE WHEN event_id % 3 <> 0 THEN run_date END) AS d FROM ev) WHERE d IS NOT NULL"""))
def _(spark, sf):
    name = F.when(F.col("event_id") % 3 != 0, F.col("filename")).otherwise("plain.log")
    rows = logs_ev(spark, sf).select(
        "event_id", name.alias("filename"), F.when(F.col("event_id") % 2 == 0, F.col("run_date")).alias("run_date"))
    return R.date_backstop(rows).select("event_id", F.col("run_date").cast("string").alias("run_date"))


@query("c10_suite_backstop", ev_sql(f"SELECT event_id, coalesce(CASE WHEN event_id % 2 = 0 THEN 'given' END, {_FIRST_SUITE}) AS suite FROM ev"))
def _(spark, sf):
    rows = logs_ev(spark, sf).select(
        "event_id", "filename", F.when(F.col("event_id") % 2 == 0, "given").alias("suite"))
    return R.suite_backstop(rows).select("event_id", "suite")


@query("c11_label_coalesce", ev_sql("""
SELECT event_id, upper(coalesce(CASE WHEN event_id % 2 = 0 THEN lower(status) END, CASE WHEN event_id % 3 = 0 THEN 'Pass' END, '')) AS actual_status FROM ev"""))
def _(spark, sf):
    return logs_ev(spark, sf).select("event_id", R.coalesced_status(
        F.when(F.col("event_id") % 2 == 0, F.lower("status")),
        F.when(F.col("event_id") % 3 == 0, F.lit("Pass"))).alias("actual_status"))


for _key, _name, _id in (("suite", "failure_freq_suite", "d01_suite_failure_count"), ("dut", "failure_freq_dut", "d02_dut_failure_count")):
    @query(_id, ev_sql(f"""
SELECT event_id, coalesce(n, 0) AS {_name} FROM ev LEFT JOIN
(SELECT {_key}, count(*) AS n FROM ev WHERE status = 'FAIL' AND {_key} <> 'rtp' GROUP BY 1) USING ({_key})"""))
    def _(spark, sf, key=_key, name=_name):
        # One suite is made to have no failures, so that the 0 is reached.
        rows = logs_ev(spark, sf).withColumn("status", F.when(F.col(key) == "rtp", "PASS").otherwise(F.col("status")))
        return J.failure_frequency(rows, key, name).select("event_id", name)


@query("d03_null_safe_join", """
WITH a AS (SELECT event_id, nullif(user_id % 50, 0) AS k1, nullif(user_id % 3, 1) AS k2, value AS v FROM events),
b AS (SELECT nullif(user_id % 50, 0) AS k1, nullif(user_id % 3, 1) AS k2, count(*) AS v FROM events GROUP BY 1, 2)
SELECT event_id, a.k1, a.k2, a.v AS v_anom, b.v AS v_clf FROM a LEFT JOIN b ON a.k1 IS NOT DISTINCT FROM b.k1 AND a.k2 IS NOT DISTINCT FROM b.k2 AND b.v > 1""")
def _(spark, sf):
    e = table(spark, sf, "events")
    keyed = e.select("event_id", F.nullif(F.col("user_id") % 50, F.lit(0)).alias("k1"),
                     F.nullif(F.col("user_id") % 3, F.lit(1)).alias("k2"), F.col("value").alias("v"))
    right = keyed.groupBy("k1", "k2").agg(F.count("*").alias("v")).filter("v > 1")
    return J.null_safe_left_join(keyed, right, ["k1", "k2"], ("_anom", "_clf"))


@query("d04_many_to_one_join", ev_sql("""
SELECT e.event_id, c.event_id AS first_id, c.dut AS dut_clf FROM ev e LEFT JOIN
(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY test_case_id, suite ORDER BY event_id) AS i FROM ev WHERE user_id % 10 <> 3) WHERE i = 1) c
ON e.test_case_id = c.test_case_id AND e.suite = c.suite"""))
def _(spark, sf):
    logs = logs_ev(spark, sf).select("event_id", "test_case_id", "suite", "dut", "user_id")
    right = logs.filter(F.col("user_id") % 10 != 3).select(
        "test_case_id", "suite", "dut", F.col("event_id").alias("first_id"))
    out = J.many_to_one(logs, right, ["test_case_id", "suite"], [F.col("first_id")], ("", "_clf"))
    return out.select("event_id", "first_id", "dut_clf")


@query("d05_join_on_available_keys", """
SELECT o_orderkey, o_orderdate::DATE::VARCHAR AS day, l_quantity FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey""")
def _(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", F.to_date("o_orderdate").cast("string").alias("day"))
    lines = table(spark, sf, "lineitem").withColumnRenamed("l_orderkey", "o_orderkey")
    return J.join_available(orders, lines, ["o_orderkey", "absent"], ["l_quantity", "absent2"])


def _keyword_sql(relation: str, group: str, text: str, order: str, stops: str = _STOPS, top: int = 5) -> str:
    """CTEs ending in ``kw(group, keywords)``: top words by count, then first appearance."""
    return rf"""
w AS (SELECT {group} AS g, {order} AS o, i, trim(p[i], '.,:;#') AS word FROM
  (SELECT {group}, {order}, regexp_split_to_array(lower({text}), '[\s\p{{Z}}\x{{85}}]+') AS p FROM {relation}), unnest(generate_series(1, len(p))) AS u(i)),
k AS (SELECT g, word, count(*) AS n, min(o * 1000000 + i) AS f FROM w WHERE length(word) > 2 AND word NOT IN ({stops}) GROUP BY 1, 2),
kr AS (SELECT g, word, n, row_number() OVER (PARTITION BY g ORDER BY n DESC, f) AS rk FROM k),
kw AS (SELECT g, string_agg(word, ', ' ORDER BY rk) AS keywords FROM kr WHERE rk <= {top} GROUP BY g)"""


@query("d06_keyword_lookup", ev_sql("""
SELECT event_id, CASE WHEN cluster = -1 THEN 'No keywords' ELSE coalesce(keywords, '<no_keywords>') END AS keywords
FROM ev LEFT JOIN kw ON g = cluster""", "f AS (SELECT * FROM ev WHERE cluster <> -1 AND error_msg IS NOT NULL), " + _keyword_sql("f", "cluster", "error_msg", "event_id")))
def _(spark, sf):
    logs = logs_ev(spark, sf)
    keywords = top_keywords(R.failures_only(logs), "cluster", "error_msg", F.col("event_id"))
    return attach_keywords(logs, keywords).select("event_id", F.array_join("keywords", ", ").alias("keywords"))


@query("d07_write_back", ev_sql("""
SELECT e.event_id, coalesce(f.cluster, -1) AS cluster FROM ev e LEFT JOIN (SELECT event_id, CAST(event_id % 10 AS INTEGER) AS cluster FROM ev WHERE status = 'FAIL') f USING (event_id)"""))
def _(spark, sf):
    logs = logs_ev(spark, sf).select("event_id", "status")
    scored = R.with_status(logs, ["FAIL"]).withColumn("cluster", (F.col("event_id") % 10).cast("int"))
    return J.write_back(logs.select("event_id"), scored, "event_id", "cluster", -1)


@query("f01_failure_rates", ev_sql("""
SELECT event_id, round(avg(fail_flag) OVER (PARTITION BY test_case), 6) AS failure_rate,
 round(avg(fail_flag) OVER (PARTITION BY suite), 6) AS suite_fail_rate,
 CASE WHEN dut IS NOT NULL THEN round(avg(fail_flag) OVER (PARTITION BY dut), 6) END AS dut_fail_rate FROM k""",
 "k AS (SELECT event_id, fail_flag, test_case_id AS test_case, suite, nullif(dut, 'DUT3') AS dut FROM ev)"))
def _(spark, sf):
    rows = logs_ev(spark, sf).select(
        "event_id", "fail_flag", F.col("test_case_id").alias("test_case"), "suite", F.nullif("dut", F.lit("DUT3")).alias("dut"))
    out = H.failure_rates(rows, {"test_case": "failure_rate", "suite": "suite_fail_rate", "dut": "dut_fail_rate"})
    return out.select("event_id", *[r(c).alias(c) for c in ("failure_rate", "suite_fail_rate", "dut_fail_rate")])


@query("f02_regression_group", ev_sql("""
SELECT event_id, CAST(sum(fail_flag) OVER (PARTITION BY test_case_id) AS BIGINT) AS regression_group FROM ev"""))
def _(spark, sf):
    rows = logs_ev(spark, sf).withColumn("test_case", F.col("test_case_id"))
    return H.regression_group(rows).select("event_id", "regression_group")


@query("f03_schedule_cycle", ev_sql("""
SELECT event_id, CASE WHEN dut IS NOT NULL THEN row_number() OVER (PARTITION BY dut, suite ORDER BY run_date, t NULLS LAST, event_id) END AS schedule_cycle
FROM (SELECT *, CASE WHEN event_id % 9 <> 0 THEN "timestamp" END AS t FROM (SELECT * REPLACE (nullif(dut, 'DUT3') AS dut) FROM ev))"""))
def _(spark, sf):
    rows = logs_ev(spark, sf).select(
        "event_id", F.nullif("dut", F.lit("DUT3")).alias("dut"), "suite", "run_date",
        F.when(F.col("event_id") % 9 != 0, F.col("timestamp")).alias("timestamp"))
    order = [F.col("run_date"), F.col("timestamp").isNull(), F.col("timestamp"), F.col("event_id")]
    return H.schedule_cycle(rows, order).select("event_id", "schedule_cycle")


@query("f04_past_failure_frequency", ev_sql("""
SELECT event_id, CAST(coalesce(sum(fail_flag) OVER (PARTITION BY test_case_id ORDER BY dut, suite, run_date, "timestamp", event_id
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS past_failure_frequency FROM ev"""))
def _(spark, sf):
    rows = logs_ev(spark, sf).withColumn("test_case", F.col("test_case_id"))
    order = [F.col(c) for c in ("dut", "suite", "run_date", "timestamp", "event_id")]
    return H.past_failure_frequency(rows, order).select("event_id", "past_failure_frequency")


@query("f05_time_since_last_failure", ev_sql("""
SELECT event_id, round(coalesce(CASE WHEN status = 'FAIL' AND t IS NOT NULL THEN (epoch_us(t) - epoch_us(
  last_value(CASE WHEN status = 'FAIL' THEN t END IGNORE NULLS) OVER (PARTITION BY dut, test_case_id ORDER BY event_id
   ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))) / 1e6 END, 0), 6) AS time_since_last_failure
FROM (SELECT *, CASE WHEN event_id % 7 <> 0 THEN "timestamp" END AS t FROM ev)"""))
def _(spark, sf):
    rows = logs_ev(spark, sf).withColumn("timestamp", F.when(F.col("event_id") % 7 != 0, F.col("timestamp")))
    out = H.time_since_last_failure(rows, [F.col("event_id")])
    return out.select("event_id", r("time_since_last_failure").alias("time_since_last_failure"))


_HISTORY = """h AS (SELECT *, CAST(value < 10 AS INTEGER) AS is_anomaly FROM ev)"""


def _history(spark, sf):
    rows = logs_ev(spark, sf).select(
        "event_id", "test_case_id", "status", F.col("fail_flag").alias("is_fail"), F.sqrt("value").alias("execution_duration"),
        (F.col("value") < 10).cast("int").alias("is_anomaly"), F.sqrt("pred_prob").alias("anomaly_score"),
        F.col("timestamp").alias("executiontime"))
    return H.test_case_history(rows, [F.col("event_id")])


@query("f06_past_failure_rate", ev_sql("""
SELECT event_id, round(coalesce(avg(fail_flag) OVER (PARTITION BY test_case_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 6) AS past_failure_rate FROM ev"""))
def _(spark, sf):
    return _history(spark, sf).select("event_id", r("past_failure_rate").alias("past_failure_rate"))


@query("f07_offset_to_final_failure", ev_sql("""
SELECT event_id, round(CASE WHEN status = 'FAIL' THEN (epoch_us("timestamp") - epoch_us(last_value(CASE WHEN status = 'FAIL' THEN "timestamp" END IGNORE NULLS)
  OVER (PARTITION BY test_case_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))) / 1e6 ELSE 0 END, 6) AS time_since_last_failure FROM ev"""))
def _(spark, sf):
    rows = logs_ev(spark, sf).withColumnsRenamed({"fail_flag": "is_fail", "timestamp": "executiontime"})
    out = H.offset_to_final_failure(rows, [F.col("event_id")])
    return out.select("event_id", r("time_since_last_failure").alias("time_since_last_failure"))


@query("f08_execution_frequency", ev_sql("""
SELECT event_id, row_number() OVER (PARTITION BY test_case_id ORDER BY event_id) - 1 AS execution_frequency FROM ev"""))
def _(spark, sf):
    return _history(spark, sf).select("event_id", "execution_frequency")


@query("f09_expanding_mean_duration", ev_sql("""
SELECT event_id, round(avg(sqrt(value)) OVER (PARTITION BY test_case_id ORDER BY event_id ROWS UNBOUNDED PRECEDING), 6) AS avg_duration FROM ev"""))
def _(spark, sf):
    return _history(spark, sf).select("event_id", r("avg_duration").alias("avg_duration"))


@query("f10_anomaly_history", ev_sql("""
SELECT event_id, round(coalesce(avg(is_anomaly) OVER (PARTITION BY test_case_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 6) AS rolling_anomaly_rate,
 round(avg(sqrt(pred_prob)) OVER (PARTITION BY test_case_id ORDER BY event_id ROWS UNBOUNDED PRECEDING), 6) AS mean_anomaly_score FROM h""", _HISTORY))
def _(spark, sf):
    return _history(spark, sf).select(
        "event_id", r("rolling_anomaly_rate").alias("rolling_anomaly_rate"), r("mean_anomaly_score").alias("mean_anomaly_score"))


@query("f11_row_number", """
SELECT event_id, row_number() OVER (ORDER BY value, event_id) AS "LogID" FROM events""")
def _(spark, sf):
    rows = table(spark, sf, "events").select("event_id", "value")
    return global_row_number(rows, [F.col("value"), F.col("event_id")], "LogID").select("event_id", "LogID")


@query("f12_target_encoding", ev_sql("""
SELECT event_id, round(avg(fail_flag) OVER (PARTITION BY test_case_id), 6) AS test_case_id_te,
 round(CASE WHEN dut = 'DUT3' THEN 0 ELSE avg(fail_flag) OVER (PARTITION BY dut) END, 6) AS dut_te FROM ev"""))
def _(spark, sf):
    rows = logs_ev(spark, sf).select(
        "event_id", "test_case_id", F.nullif("dut", F.lit("DUT3")).alias("dut"), F.col("fail_flag").alias("isFail"))
    out = target_encode(rows, ["test_case_id", "dut"])
    return out.select("event_id", r("test_case_id_te").alias("test_case_id_te"), r("dut_te").alias("dut_te"))


@query("f12_target_encoding_train_only", ev_sql("""
SELECT event_id, round(coalesce(avg(CASE WHEN event_id % 5 <> 0 THEN fail_flag END) OVER (PARTITION BY filename), 0), 6) AS filename_te FROM ev"""))
def _(spark, sf):
    rows = logs_ev(spark, sf).select("event_id", "filename", F.col("fail_flag").alias("isFail"))
    out = target_encode_fitted(rows, F.col("event_id") % 5 != 0, ["filename"])
    return out.select("event_id", r("filename_te").alias("filename_te"))


@query("f13_cluster_failure_rate", ev_sql("""
SELECT event_id, round(1 + 2 * avg(fail_flag) OVER (PARTITION BY cluster), 6) AS cluster_weight,
  round(avg(fail_flag) OVER (PARTITION BY cluster), 6) AS cluster_fail_rate FROM (SELECT * REPLACE (user_id % 10 AS cluster) FROM ev)"""))
def _(spark, sf):
    rows = logs_ev(spark, sf).select("event_id", (F.col("user_id") % 10).alias("cluster"), F.col("fail_flag").alias("isFail"))
    out = add_weights(rows)
    return out.select("event_id", r("cluster_weight").alias("cluster_weight"), r("cluster_fail_rate").alias("cluster_fail_rate"))


@query("g01_full_row_dedupe", "SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem")
def _(spark, sf):
    return G.distinct_rows(table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber"))


@query("g02_best_per_key", """
SELECT l_orderkey, l_linenumber, l_quantity, l_partkey, l_suppkey, l_extendedprice FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber
  ORDER BY nullif(l_quantity, 50) DESC NULLS LAST, l_partkey, l_suppkey, l_extendedprice) AS i FROM lineitem) WHERE i = 1""")
def _(spark, sf):
    rows = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_quantity", "l_partkey", "l_suppkey", "l_extendedprice",
        F.nullif("l_quantity", F.lit(50.0)).alias("confidence"))
    ties = [F.col(c) for c in ("l_partkey", "l_suppkey", "l_extendedprice")]
    return G.best_per_key(rows, ["l_orderkey", "l_linenumber"], "confidence", ties).drop("confidence")


@query("g03_first_per_key", ev_sql("""
SELECT test_case_id, suite, min(event_id) AS event_id FROM ev GROUP BY 1, 2"""))
def _(spark, sf):
    rows = logs_ev(spark, sf).select("test_case_id", "suite", "event_id")
    return G.top_per_key(rows, ["test_case_id", "suite"], [F.col("event_id")])


@query("g04_multi_key_sort", "SELECT c_custkey, c_mktsegment, c_acctbal FROM customer")
def _(spark, sf):
    rows = table(spark, sf, "customer").select("c_custkey", "c_mktsegment", "c_acctbal")
    return G.nulls_last(rows, "c_mktsegment", "c_acctbal", "c_custkey")


@query("g05_top_k", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
def _(spark, sf):
    rows = table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    return G.top_rows(rows, [F.col("o_totalprice").desc(), F.col("o_orderkey")], 10)


@query("g06_union", """
SELECT 'train' AS part, o_orderkey, o_orderstatus FROM orders WHERE o_orderkey % 5 <> 0
UNION ALL SELECT 'test', o_orderkey, o_orderstatus FROM orders WHERE o_orderkey % 5 = 0""")
def _(spark, sf):
    orders = table(spark, sf, "orders")
    is_test = F.col("o_orderkey") % 5 == 0
    train = orders.filter(~is_test).select(F.lit("train").alias("part"), "o_orderkey", "o_orderstatus")
    test = orders.filter(is_test).select("o_orderstatus", "o_orderkey", F.lit("test").alias("part"))
    return G.stack(train, test)
