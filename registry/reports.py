"""Profiles, trends, keywords: the aggregate reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from failscope import constants as K
from failscope.operators import profile as P
from failscope.operators import text as X
from failscope.operators import trends as T
from failscope.operators.joins import label_clusters
from failscope.operators.quantiles import exact_quantiles
from failscope.operators.repair import failures_only
from failscope.storage import literal_table
from registry.base import ev_sql, logs_ev, query, r, table
from registry.parsing import _LABELS, _STOPS2
from registry.rows import _keyword_sql


def _gaps(spark, sf):
    """Events as log rows with missing values and repeats; ids are left out so that rows repeat."""
    i = F.col("event_id")
    return logs_ev(spark, sf).select(
        F.when(i % 3 != 0, F.col("error_msg")).alias("error_msg"), "test_case_id", F.nullif("dut", F.lit("DUT3")).alias("dut"),
        "suite", F.when(i % 7 != 0, "Linux").alias("os_version"), F.lit("v1").alias("dut_version"), "status")


_GAPS = """x AS (SELECT CASE WHEN event_id % 3 <> 0 THEN error_msg END AS error_msg, test_case_id, nullif(dut, 'DUT3') AS dut, suite,
  CASE WHEN event_id % 7 <> 0 THEN 'Linux' END AS os_version, 'v1' AS dut_version, status FROM ev)"""
_GAP_COLUMNS = ["error_msg", "test_case_id", "dut", "suite", "os_version", "dut_version", "status"]


@query("e01_value_counts", ev_sql("SELECT dut, count(*) AS count FROM x WHERE dut IS NOT NULL GROUP BY 1", _GAPS))
def _(spark, sf):
    return P.value_counts(_gaps(spark, sf), "dut")


@query("e02_value_counts_with_null", ev_sql("SELECT dut, count(*) AS count FROM x GROUP BY 1", _GAPS))
def _(spark, sf):
    return P.value_counts(_gaps(spark, sf), "dut", nulls=True)


@query("e03_executions_per_day", "SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS run_date, count(*) AS executions FROM events GROUP BY 1")
def _(spark, sf):
    return P.executions_per_day(table(spark, sf, "events"), "ts").withColumn("run_date", F.col("run_date").cast("string"))


@query("e04_top_failure_reasons", ev_sql("""
SELECT error_msg, count(*) AS count FROM ev WHERE status IN ('FAIL', 'ABORT') AND error_msg IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10"""))
def _(spark, sf):
    return P.top_failure_reasons(logs_ev(spark, sf))


@query("e04_top_failure_categories", ev_sql("""
SELECT coalesce(error_msg, 'Unknown Error') AS error_category, count(*) AS count FROM ev WHERE status = 'FAIL' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10"""))
def _(spark, sf):
    return P.top_failure_categories(logs_ev(spark, sf))


def _report_sql(columns: str) -> str:
    each = " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", count(*) - count({c}) AS missing_count, round(100.0 * (count(*) - count({c})) / count(*), 6) AS missing_pct, "
        f"count({c}) AS non_null_count, round(100.0 * count({c}) / count(*), 6) AS coverage_pct FROM x" for c in _GAP_COLUMNS)
    return ev_sql(f"SELECT {columns} FROM ({each})", _GAPS)


@query("e05_missing_report", _report_sql('"column", missing_count, missing_pct'))
def _(spark, sf):
    return P.missing_report(_gaps(spark, sf)).withColumn("missing_pct", r("missing_pct"))


@query("e06_coverage_report", _report_sql('"column", non_null_count, coverage_pct'))
def _(spark, sf):
    return P.coverage_report(_gaps(spark, sf)).withColumn("coverage_pct", r("coverage_pct"))


@query("e07_critical_coverage", _report_sql('"column", non_null_count, coverage_pct')
       + " WHERE \"column\" IN (" + ", ".join(f"'{c}'" for c in K.CRITICAL_FIELDS) + ")")
def _(spark, sf):
    return P.critical_coverage(_gaps(spark, sf)).withColumn("coverage_pct", r("coverage_pct"))


_DUPLICATES = "(SELECT count(*) FROM x) - (SELECT count(*) FROM (SELECT DISTINCT * FROM x))"


@query("e08_duplicate_rows", ev_sql(f"SELECT {_DUPLICATES} AS duplicate_rows", _GAPS))
def _(spark, sf):
    return P.duplicate_rows(_gaps(spark, sf))


@query("e09_data_gaps", ev_sql(f"""
SELECT gap, rows, CASE gap WHEN 'os_version' THEN 'OS version is missing, its extraction should be improved'
  WHEN 'error_msg' THEN 'rows without an error message' WHEN 'duplicate_rows' THEN 'repeated rows, consider removing them' END AS message
FROM (SELECT 'dut_version' AS gap, count(*) - count(dut_version) AS rows FROM x UNION ALL SELECT 'os_version', count(*) - count(os_version) FROM x
 UNION ALL SELECT 'error_msg', count(*) - count(error_msg) FROM x UNION ALL SELECT 'duplicate_rows', {_DUPLICATES}) WHERE rows > 0""", _GAPS))
def _(spark, sf):
    return P.data_gaps(_gaps(spark, sf))


@query("e10_status_by_day", ev_sql("""
SELECT CAST(run_date AS VARCHAR) AS run_date, count(*) FILTER (status = 'PASS') AS "PASS", count(*) FILTER (status = 'FAIL') AS "FAIL",
 count(*) FILTER (status = 'ABORT') AS "ABORT" FROM ev GROUP BY 1"""))
def _(spark, sf):
    return T.status_by_day(logs_ev(spark, sf)).withColumn("run_date", F.col("run_date").cast("string"))


@query("e11_daily_pass_rate", ev_sql("""
SELECT CAST(run_date AS VARCHAR) AS run_date, round(avg(CAST(status = 'PASS' AS INTEGER)), 6) AS pass_rate FROM ev GROUP BY 1"""))
def _(spark, sf):
    return T.daily_rates(logs_ev(spark, sf)).select(
        F.col("run_date").cast("string").alias("run_date"), r("pass_rate").alias("pass_rate"))


_SPIKES = """d AS (SELECT run_date, count(*) AS total, avg(fail_flag) AS failure_rate FROM ev GROUP BY 1),
t AS (SELECT avg(failure_rate) + 2 * stddev_samp(failure_rate) AS threshold FROM d)"""


@query("e12_failure_spikes", ev_sql("""
SELECT CAST(run_date AS VARCHAR) AS run_date, round(failure_rate, 6) AS failure_rate FROM d, t WHERE failure_rate > threshold""", _SPIKES))
def _(spark, sf):
    return T.failure_spikes(logs_ev(spark, sf)).select(
        F.col("run_date").cast("string").alias("run_date"), r("failure_rate").alias("failure_rate"))


@query("e12_daily_rates_with_spikes", ev_sql("""
SELECT CAST(run_date AS VARCHAR) AS run_date, total, round(failure_rate, 6) AS failure_rate, round(threshold, 6) AS threshold,
 CAST(failure_rate > threshold AS INTEGER) AS is_spike FROM d, t""", _SPIKES))
def _(spark, sf):
    from failscope.functions import parse

    # The status comes from the parsed line, not from the event.
    logs = logs_ev(spark, sf)
    parsed = logs.select("run_date", F.inline(parse.result_rows(F.col("raw_line"))))
    return T.failure_spikes(parsed, only=False).select(
        F.col("run_date").cast("string").alias("run_date"), "total", r("failure_rate").alias("failure_rate"),
        r("threshold").alias("threshold"), F.col("is_spike").cast("int").alias("is_spike"))


for _id, _by in (("e13_cluster_by_dut_version", "dut"), ("e14_cluster_by_config", "event_type"), ("e15_cluster_by_suite", "suite")):
    @query(_id, ev_sql(f"SELECT {_by}, cluster, count(*) AS count FROM ev WHERE cluster >= 0 GROUP BY 1, 2"))
    def _(spark, sf, by=_by):
        rows = failures_only(logs_ev(spark, sf))
        return T.cluster_counts_if_several(rows, by) if by == "suite" else T.cluster_counts(rows, by)


@query("e16_monthly_trend", """
SELECT strftime(date_trunc('month', o_orderdate), '%Y-%m') AS month, count(*) FILTER (o_orderstatus = 'F') AS "F",
 count(*) FILTER (o_orderstatus = 'O') AS "O", count(*) FILTER (o_orderstatus = 'P') AS "P" FROM orders GROUP BY 1""")
def _(spark, sf):
    return T.monthly_counts(table(spark, sf, "orders"), "o_orderdate", "o_orderstatus", ["F", "O", "P"]).withColumn(
        "month", F.date_format("month", "yyyy-MM"))


_TOP_WORDS = "SELECT g AS source, word, n AS count, CAST(rk AS INTEGER) AS rank FROM kr WHERE rk <= 5"


@query("e17_top_keywords", "WITH " + _keyword_sql("documents", "source", "text", "doc_id").strip() + _TOP_WORDS)
def _(spark, sf):
    return X.keyword_ranks(table(spark, sf, "documents"), "source", "text", F.col("doc_id"))


@query("e17_top_keywords_plain", "WITH " + _keyword_sql("documents", "lang", "text", "doc_id", _STOPS2, 5).strip().replace(
    "trim(p[i], '.,:;#')", "p[i]") + " SELECT g AS lang, keywords FROM kw")
def _(spark, sf):
    keywords = X.top_keywords(table(spark, sf, "documents"), "lang", "text", F.col("doc_id"),
                              stop_words=K.NOTEBOOK_STOP_WORDS, strip=False)
    return keywords.select("lang", F.array_join("keywords", ", ").alias("keywords"))


_TFIDF = r"""
WITH w AS (SELECT doc_id, source, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_\p{M}]{2,}')) AS term FROM documents),
s AS (SELECT * FROM w WHERE term NOT IN (STOPS)),
c AS (SELECT doc_id, source, term, count(*) AS tf FROM s GROUP BY ALL),
v AS (SELECT term, sum(tf) AS a, count(*) AS df FROM c GROUP BY 1 ORDER BY a DESC, term LIMIT 3000),
x AS (SELECT doc_id, source, term, tf * (ln((1 + (SELECT count(*) FROM documents)) / (1 + df)) + 1) AS w FROM c JOIN v USING (term)),
n AS (SELECT doc_id, sqrt(sum(w * w)) AS norm FROM x GROUP BY 1),
m AS (SELECT source, term, sum(w / norm) AS total FROM x JOIN n USING (doc_id) GROUP BY ALL),
z AS (SELECT source, count(*) AS docs FROM documents GROUP BY 1),
q AS (SELECT source, term, total / docs AS mean_weight FROM m JOIN z USING (source)),
k AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY round(mean_weight, 9) DESC, term) AS i FROM q)
SELECT source, term, round(mean_weight, 5) AS mean_weight FROM k WHERE i <= 5"""


@query("e18_tfidf_keywords", _TFIDF.replace(
    "STOPS", ", ".join("'" + w.replace("'", "''") + "'" for w in K.SPARK_STOP_WORDS)))
def _(spark, sf):
    out = X.tfidf_keywords(table(spark, sf, "documents"), "doc_id", "source", "text")
    return out.withColumn("mean_weight", r("mean_weight", 5))


_FAILS = "f AS (SELECT * FROM ev LEFT JOIN " + _LABELS + " ON cluster = k WHERE cluster <> -1 AND error_msg IS NOT NULL), " + _keyword_sql(
    "f", "cluster", "error_msg", "event_id")


def _labelled_failures(spark, sf):
    return label_clusters(failures_only(logs_ev(spark, sf)).filter("error_msg is not null"), K.NORMAL)


@query("e19_cluster_examples", ev_sql("""
SELECT cluster, max(v) AS root_cause_label, max(keywords) AS keywords, string_agg(error_msg, ' | ' ORDER BY event_id) AS example_errors
FROM (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY event_id) AS i FROM f) JOIN kw ON g = cluster WHERE i <= 3 GROUP BY cluster""", _FAILS))
def _(spark, sf):
    rows = _labelled_failures(spark, sf)
    keywords = X.top_keywords(rows, "cluster", "error_msg", F.col("event_id"))
    return X.cluster_examples(rows, keywords, F.col("event_id"))


@query("e19_modal_label", """
SELECT l_suppkey, l_returnflag AS label FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY n DESC, l_returnflag) AS i
 FROM (SELECT l_suppkey, l_returnflag, count(*) AS n FROM lineitem GROUP BY 1, 2)) WHERE i = 1""")
def _(spark, sf):
    rows = table(spark, sf, "lineitem").select(
        "l_suppkey", F.col("l_returnflag").alias("label"), F.col("l_linestatus").alias("m"), "l_orderkey")
    keywords = rows.groupBy("l_suppkey").agg(F.array(F.lit("x")).alias("keywords"))
    return X.cluster_examples(rows, keywords, F.col("l_orderkey"), "l_suppkey", "m", "label").select("l_suppkey", "label")


@query("e20_top_failure_clusters", ev_sql("""
SELECT cluster, v AS root_cause_label, n AS failure_count, (SELECT string_agg(word, ', ' ORDER BY word) FROM
  (SELECT word FROM kr WHERE kr.g = t.cluster AND rk <= 5 ORDER BY word LIMIT 6)) AS keywords
FROM (SELECT cluster, v, count(error_msg) AS n FROM f GROUP BY 1, 2 ORDER BY n DESC, cluster LIMIT 5) t""", _FAILS))
def _(spark, sf):
    rows = _labelled_failures(spark, sf)
    keywords = X.top_keywords(rows, "cluster", "error_msg", F.col("event_id"))
    return X.top_failure_clusters(X.attach_keywords(rows, keywords))


@query("e21_root_cause_keywords", ev_sql("""
SELECT v AS root_cause_label, string_agg(word, ', ' ORDER BY c DESC, word) AS top_keywords FROM
 (SELECT *, row_number() OVER (PARTITION BY v ORDER BY c DESC, word) AS i FROM
  (SELECT v, word, count(*) AS c FROM f JOIN kr ON g = cluster WHERE rk <= 5 GROUP BY 1, 2)) WHERE i <= 5 GROUP BY 1""", _FAILS))
def _(spark, sf):
    rows = _labelled_failures(spark, sf)
    keywords = X.top_keywords(rows, "cluster", "error_msg", F.col("event_id"))
    return X.root_cause_keywords(X.attach_keywords(rows, keywords))


@query("e22_quantiles", """
SELECT CAST(unnest([0.9, 0.6, 0.05]) AS DOUBLE) AS p, round(unnest(quantile_cont(l_extendedprice, [0.9, 0.6, 0.05])), 4) AS value FROM lineitem""")
def _(spark, sf):
    probs = [0.9, 0.6, 0.05]
    found = exact_quantiles(table(spark, sf, "lineitem"), "l_extendedprice", probs)
    return literal_table(spark, ["p", "value"], list(zip(probs, found))).withColumn("value", r("value", 4))


@query("e23_top_mean_priority", ev_sql("""
SELECT filename, round(avg(sqrt(pred_prob * value)), 6) AS mean_score FROM ev GROUP BY 1 ORDER BY avg(sqrt(pred_prob * value)) DESC, 1 LIMIT 10"""))
def _(spark, sf):
    rows = logs_ev(spark, sf).withColumn("priority_score", F.sqrt(F.col("pred_prob") * F.col("value")))
    return T.top_mean(rows, "filename", "priority_score").withColumn("mean_score", r("mean_score"))


_HEAT = """c AS (SELECT filename, dut, avg(sqrt(pred_prob * value)) AS m FROM ev GROUP BY 1, 2),
b AS (SELECT filename FROM c GROUP BY 1 ORDER BY max(m) DESC, 1 LIMIT 40)"""


@query("e24_risk_heat_map", ev_sql("SELECT filename, dut, round(m, 6) AS mean_score FROM c JOIN b USING (filename)", _HEAT))
def _(spark, sf):
    rows = logs_ev(spark, sf).withColumn("s", F.sqrt(F.col("pred_prob") * F.col("value")))
    return T.risk_heat_map(rows, "filename", "dut", "s").withColumn("mean_score", r("mean_score"))


@query("e24_risk_heat_map_wide", ev_sql("SELECT filename, " + ", ".join(
    f"round(coalesce(max(m) FILTER (dut = 'DUT{i}'), 0), 6) AS \"DUT{i}\"" for i in range(7)) + " FROM c JOIN b USING (filename) GROUP BY 1", _HEAT))
def _(spark, sf):
    rows = logs_ev(spark, sf).withColumn("s", F.sqrt(F.col("pred_prob") * F.col("value")))
    duts = [f"DUT{i}" for i in range(7)]
    return T.risk_heat_map(rows, "filename", "dut", "s", duts).select("filename", *[r(d).alias(d) for d in duts])


@query("e25_suite_trend", ev_sql("""
SELECT CAST(CAST(a + CAST(floor(date_diff('day', a, run_date) / 7) * 7 AS INTEGER) AS DATE) AS VARCHAR) AS bin_start, suite,
 round(avg(value), 5) AS mean_score FROM (SELECT run_date, suite, sqrt(value) AS value, (SELECT min(run_date) FROM ev) AS a FROM ev) GROUP BY 1, 2"""))
def _(spark, sf):
    rows = logs_ev(spark, sf).withColumn("s", F.sqrt("value"))
    out = T.trend_by_bins(rows, "run_date", "suite", "s")
    return out.select(F.col("bin_start").cast("string").alias("bin_start"), "suite", r("mean_score", 5).alias("mean_score"))


@query("e26_histogram", """
WITH s AS (SELECT min(value) AS lo, max(value) AS hi FROM events),
b AS (SELECT least(CAST(floor((value - lo) / (hi - lo) * 40) AS INTEGER), 39) + 1 AS bin, count(*) AS n FROM events, s GROUP BY 1)
SELECT CAST(i AS INTEGER) AS bin, round(lo + (i - 1) * (hi - lo) / 40, 6) AS low, round(lo + i * (hi - lo) / 40, 6) AS high, coalesce(n, 0) AS count
FROM generate_series(1, 40) AS u(i) LEFT JOIN b ON bin = i, s""")
def _(spark, sf):
    out = T.histogram(table(spark, sf, "events"), "value")
    return out.select("bin", r("low").alias("low"), r("high").alias("high"), "count")


@query("e27_density_curve", """
WITH s AS (SELECT min(value) AS lo, max(value) AS hi, count(value) AS n, stddev_samp(value) * pow(count(value), -0.2) AS h FROM events),
p AS (SELECT i, lo + i * (hi - lo) / 49 AS x FROM s, generate_series(0, 49) AS u(i))
SELECT CAST(i AS INTEGER) AS point, round(x, 6) AS x, round(sum(exp(-0.5 * pow((x - value) / h, 2))) / (max(n) * max(h) * sqrt(2 * pi())), 6) AS density
FROM p, s, events GROUP BY i, x""")
def _(spark, sf):
    out = T.density_curve(table(spark, sf, "events"), "value", points=50)
    return out.select("point", r("x").alias("x"), r("density").alias("density"))


@query("e28_share_of_total", ev_sql(f"""
SELECT v AS root_cause_label, count(*) AS count, round(100.0 * count(*) / sum(count(*)) OVER (), 6) AS share_pct FROM ev JOIN {_LABELS} ON cluster = k GROUP BY 1"""))
def _(spark, sf):
    rows = label_clusters(failures_only(logs_ev(spark, sf)), K.NORMAL)
    return T.share_of_total(rows, "root_cause_label").withColumn("share_pct", r("share_pct"))


@query("e29_report_totals", ev_sql("SELECT count(*) AS total_rows, CAST(sum(fail_flag) AS BIGINT) AS failures FROM ev"))
def _(spark, sf):
    return P.report_totals(logs_ev(spark, sf), "fail_flag")

