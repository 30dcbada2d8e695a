"""Sources, columns and line parsing."""

from __future__ import annotations

from pyspark.sql import functions as F

from failscope import constants as K
from failscope.functions import parse as P
from failscope.functions import values as V
from failscope.operators.dedupe import stack, top_rows
from failscope.operators.joins import label_clusters
from failscope.operators.quantiles import exact_quantiles

from failscope.plans.logs import carry_run_date, header_fields, with_fallbacks
from failscope.plans.prioritise import choose_label
from failscope.sources.archive import member_keys
from failscope.sources.columns import add_missing, describe_columns, drop, keep, normalise_headers, rename
from failscope.sources.logs import explode_lines, path_columns
from registry.base import ev_sql, logs_ev, query, r, stamp, table


@query("a02_archive_member_keys", """
WITH m AS (SELECT event_id, CASE event_id % 4
    WHEN 0 THEN 'tc_' || (user_id % 10) || '_ptp-oc_' || strftime(ts, '%Y%m%d') || '.log'
    WHEN 1 THEN 'log.txt' WHEN 2 THEN 'a_b_c_20249999.log'
    ELSE strftime(ts, '%Y%m%d') || '_x.log' END AS filename FROM events),
b AS (SELECT *, regexp_replace(filename, '\\.[^.]*$', '') AS base FROM m),
t AS (SELECT *, string_split(base, '_') AS parts FROM b)
SELECT event_id, filename,
  coalesce(strftime(try_strptime(list_filter(parts, lambda p: regexp_full_match(p, '[0-9]{8}'))[1], '%Y%m%d'), '%Y-%m-%d'), 'unknown_date') AS run_date,
  coalesce(parts[3], 'unknown_suite') AS suite FROM t
""")
def _(spark, sf):
    day = F.date_format("ts", "yyyyMMdd")
    kind = F.col("event_id") % 4
    name = (
        F.when(kind == 0, F.concat(F.lit("tc_"), F.col("user_id") % 10, F.lit("_ptp-oc_"), day, F.lit(".log")))
        .when(kind == 1, "log.txt").when(kind == 2, "a_b_c_20249999.log").otherwise(F.concat(day, F.lit("_x.log"))))
    return member_keys(table(spark, sf, "events").select("event_id", name.alias("filename")))


@query("a05_line_explode", r"""
WITH s AS (SELECT doc_id, regexp_split_to_array(text, '\r\n|\r|\n') AS p FROM documents),
t AS (SELECT doc_id, CASE WHEN p[-1] = '' THEN p[1:len(p) - 1] ELSE p END AS p FROM s)
SELECT doc_id, CAST(i AS INTEGER) AS line_number, regexp_replace(p[i], '^\s+|\s+$', '', 'g') AS raw_line
FROM t, unnest(generate_series(1, len(p))) AS u(i)
""")
def _(spark, sf):
    return explode_lines(table(spark, sf, "documents").select("doc_id", "text"), "text")


@query("a05_line_explode_no_blank", r"""
WITH s AS (SELECT doc_id, regexp_split_to_array(text, '\r\n|\r|\n') AS p FROM documents),
t AS (SELECT doc_id, CAST(i AS INTEGER) AS line_number, regexp_replace(p[i], '^\s+|\s+$', '', 'g') AS raw_line
  FROM s, unnest(generate_series(1, len(p))) AS u(i))
SELECT doc_id, count(*) AS lines, CAST(sum(line_number) AS BIGINT) AS number_sum FROM t WHERE raw_line <> '' GROUP BY doc_id
""")
def _(spark, sf):
    lines = explode_lines(table(spark, sf, "documents").select("doc_id", "text"), "text", keep_blank=False)
    return lines.groupBy("doc_id").agg(F.count("*").alias("lines"), F.sum("line_number").cast("bigint").alias("number_sum"))


@query("a06_path_columns", r"""
WITH p AS (SELECT page_id, regexp_replace(url, '^https?://', '') AS path FROM pages),
t AS (SELECT *, string_split(path, '/') AS parts, string_split(path, '/')[-1] AS filename FROM p),
s AS (SELECT *, CASE WHEN regexp_matches(filename, '[^.]\.[^.]*$') THEN regexp_replace(filename, '\.[^.]*$', '') ELSE filename END AS stem FROM t)
SELECT page_id, path, CASE WHEN lower(parts[1]) NOT IN ('', 'unknown_date') THEN parts[1] END AS run_date,
  CASE WHEN coalesce(lower(parts[2]), '') IN ('', 'generic_dut', 'unknown_dut') THEN stem ELSE parts[2] END AS dut,
  coalesce(parts[3], stem) AS suite, filename FROM s
""")
def _(spark, sf):
    return path_columns(table(spark, sf, "pages").select(
        "page_id", F.regexp_replace("url", "^https?://", "").alias("path")))


@query("a11_header_normalisation", "SELECT o_orderkey, o_custkey, o_orderstatus FROM orders")
def _(spark, sf):
    messy = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus").toDF(
        " O_OrderKey ", "O_CUSTKEY", "o_orderstatus ")
    return normalise_headers(messy)


@query("a12_rename", """SELECT o_orderkey AS log_id, o_custkey AS test_case, o_orderstatus AS actual_status FROM orders""")
def _(spark, sf):
    return rename(table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus"), {
        "o_orderkey": "log_id", "o_custkey": "test_case", "o_orderstatus": "actual_status", "absent": "x"})


@query("a14_placeholder_columns", """
SELECT c_custkey, c_mktsegment AS suite, 'Unknown' AS dut_version, 'N/A' AS filename FROM customer""")
def _(spark, sf):
    df = table(spark, sf, "customer").select("c_custkey", F.col("c_mktsegment").alias("suite"))
    return add_missing(df, {"dut_version": K.UNKNOWN, "filename": "N/A", "suite": "never"})


@query("a16_preview", """
(SELECT 'head' AS part, o_orderkey, o_custkey FROM orders ORDER BY o_orderkey LIMIT 5)
UNION ALL (SELECT 'tail', o_orderkey, o_custkey FROM orders ORDER BY o_orderkey DESC LIMIT 5)""")
def _(spark, sf):
    df = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    head = top_rows(df, [F.col("o_orderkey")], 5).select(F.lit("head").alias("part"), "*")
    tail = top_rows(df, [F.col("o_orderkey").desc()], 5).select(F.lit("tail").alias("part"), "*")
    return stack(head, tail)


@query("a16_shape_and_types", """
SELECT column_name AS "column", CAST(position AS INTEGER) AS position, rows FROM
 (SELECT unnest(['c_custkey','c_name','c_nationkey','c_acctbal','c_mktsegment']) AS column_name, unnest([0,1,2,3,4]) AS position),
 (SELECT count(*) AS rows FROM customer)""")
def _(spark, sf):
    df = table(spark, sf, "customer")
    return describe_columns(df).select("column", "position").withColumn(
        "rows", df.agg(F.count("*").alias("n")).scalar())


_B1 = """l AS (SELECT event_id, CASE WHEN event_id % 5 = 0 THEN raw_line
  ELSE strftime("timestamp", '%Y-%m-%d') || ' - ' || test_case_id || '  -  ' || status || ' x' END AS line FROM ev)"""


@query("b01_simple_line", ev_sql(r"""
SELECT event_id, nullif(regexp_extract(line, '^(\S+)\s+-\s+(\S+)\s+-\s+(\S+)', 1), '') AS "timestamp",
 nullif(regexp_extract(line, '^(\S+)\s+-\s+(\S+)\s+-\s+(\S+)', 2), '') AS testcase,
 nullif(regexp_extract(line, '^(\S+)\s+-\s+(\S+)\s+-\s+(\S+)', 3), '') AS status,
 CASE WHEN NOT regexp_matches(line, '^(\S+)\s+-\s+(\S+)\s+-\s+(\S+)') THEN line END AS raw FROM l""", _B1))
def _(spark, sf):
    line = F.when(F.col("event_id") % 5 == 0, F.col("raw_line")).otherwise(F.concat_ws(
        "", F.date_format("timestamp", "yyyy-MM-dd"), F.lit(" - "), "test_case_id", F.lit("  -  "), "status", F.lit(" x")))
    rows = logs_ev(spark, sf).select("event_id", line.alias("line"))
    return rows.select("event_id", *[c.alias(n) for n, c in P.simple_line(F.col("line")).items()])


# Made-up phrases so that every rule is reached; chosen by the event's id.
PHRASES = ["Step passed", "bypass FAIL", "0 errors found", "run aborted", "stopped by user", "Exception occurred",
           "connection timeout", "run interrupted", "process terminated", "Successfully completed", "nothing here"]
_PHRASE_LIST = ", ".join(f"'{p}'" for p in PHRASES)
_STATUS_SQL = """CASE WHEN contains(l, 'pass') AND NOT contains(l, 'fail') THEN 'PASS'
  WHEN contains(l, 'fail') OR contains(l, 'error') OR contains(l, 'failed') THEN 'FAIL'
  WHEN contains(l, 'abort') OR contains(l, 'aborted') OR contains(l, 'stopped') THEN 'ABORT'
  WHEN contains(l, 'test failed') OR contains(l, 'step failed') OR contains(l, 'execution failed')
    OR contains(l, 'unexpected error') OR contains(l, 'exception occurred') THEN 'FAIL'
  WHEN contains(l, 'timeout') OR contains(l, 'interrupted') OR contains(l, 'terminated') OR contains(l, 'stopped unexpectedly') THEN 'ABORT'
  WHEN contains(l, 'successfully completed') OR contains(l, 'execution passed') OR contains(l, 'step passed') THEN 'PASS' END"""


def _phrase():
    return F.element_at(F.array(*[F.lit(p) for p in PHRASES]), (F.col("event_id") % 11 + 1).cast("int"))


@query("b02_keyword_status", ev_sql(f"SELECT event_id, {_STATUS_SQL} AS status FROM l",
       f"l AS (SELECT event_id, lower(([{_PHRASE_LIST}])[event_id % 11 + 1] || ' ' || dut) AS l FROM ev)"))
def _(spark, sf):
    line = F.concat(_phrase(), F.lit(" "), F.col("dut"))
    return logs_ev(spark, sf).select("event_id", P.keyword_status(line).alias("status"))


@query("b02_keyword_status_documents", f"""
WITH d AS (SELECT doc_id, source, lower(text) AS l FROM documents)
SELECT source, {_STATUS_SQL} AS status, count(*) AS documents FROM d GROUP BY ALL""")
def _(spark, sf):
    return table(spark, sf, "documents").groupBy("source", P.keyword_status(F.col("text")).alias("status")).agg(
        F.count("*").alias("documents"))


@query("b03_line_fields", ev_sql(r"""
SELECT event_id, nullif(regexp_extract(line, '\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}', 0), '') AS "timestamp",
 nullif(regexp_extract(line, '(?i)(tc[_\-]?\S+)', 1), '') AS test_case_id,
 nullif(regexp_extract(line, '(?i)DUT[_\s]?(v?\d+(\.\d+)*)', 1), '') AS dut_version,
 nullif(regexp_extract(line, '(?i)config[:=]\s*([a-zA-Z0-9_\-\.]+)', 1), '') AS config FROM l""", """
l AS (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN raw_line ELSE
  strftime("timestamp", '%Y-%m-%d %H:%M:%S') || ' ' || upper(test_case_id) || ' dut v1.' || (user_id % 7) || '.3 '
  || CASE WHEN event_id % 2 = 0 THEN 'Config: ' || suite ELSE dut END END AS line FROM ev)"""))
def _(spark, sf):
    line = F.when(F.col("event_id") % 3 == 0, F.col("raw_line")).otherwise(F.concat(
        F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss"), F.lit(" "), F.upper("test_case_id"), F.lit(" dut v1."),
        F.col("user_id") % 7, F.lit(".3 "),
        F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("Config: "), "suite")).otherwise(F.col("dut"))))
    rows = logs_ev(spark, sf).select("event_id", line.alias("line"))
    return rows.select("event_id", *[c.alias(n) for n, c in P.line_fields(F.col("line")).items()])


@query("b04_protocol_from_name", ev_sql("""
SELECT event_id, CASE WHEN contains(f, 'dtmf') THEN 'DTMF' WHEN contains(f, 'ptp') THEN 'PTP' WHEN contains(f, 'ipv6') THEN 'IPv6'
 WHEN contains(f, 'ipv4') THEN 'IPv4' WHEN contains(f, 'sip') THEN 'SIP' WHEN contains(f, 'lacp') THEN 'LACP'
 WHEN contains(f, 'tcp') THEN 'TCP' WHEN contains(f, 'udp') THEN 'UDP' WHEN contains(f, 'sct') THEN 'SCTP' END AS config
FROM (SELECT event_id, lower(filename) AS f FROM ev)"""))
def _(spark, sf):
    return logs_ev(spark, sf).select("event_id", P.protocol_from_name(F.upper("filename")).alias("config"))


@query("b05_run_date_carry", """
WITH l AS (SELECT event_id, 'f' || (user_id % 10) AS path,
  CASE WHEN event_id % 3 = 0 THEN strftime(ts, '%Y-%m-%d %H:%M:%S') WHEN event_id % 5 = 0 THEN '2024-99-99 00:00:00' END AS t,
  CASE WHEN user_id % 2 = 0 THEN '2023-12-31' END AS dir_date FROM events)
SELECT event_id, path, coalesce(strftime(last_value(CAST(try_cast(t AS TIMESTAMP) AS DATE) IGNORE NULLS)
  OVER (PARTITION BY path ORDER BY event_id ROWS UNBOUNDED PRECEDING), '%Y-%m-%d'), dir_date) AS run_date FROM l""")
def _(spark, sf):
    rows = table(spark, sf, "events").select(
        "event_id", F.concat(F.lit("f"), F.col("user_id") % 10).alias("path"), F.col("event_id").alias("line_number"),
        F.when(F.col("event_id") % 3 == 0, F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
        .when(F.col("event_id") % 5 == 0, "2024-99-99 00:00:00").alias("timestamp"),
        F.when(F.col("user_id") % 2 == 0, "2023-12-31").alias("run_date"))
    return carry_run_date(rows).select("event_id", "path", "run_date")


@query("b06_error_text", ev_sql("SELECT event_id, CASE WHEN status IN ('FAIL','ABORT') THEN raw_line END AS error_msg FROM ev"))
def _(spark, sf):
    return logs_ev(spark, sf).select("event_id", P.error_text(F.col("status"), F.col("raw_line")).alias("error_msg"))


def _header_lines(spark, sf):
    """Events as header lines: which key a line has depends on its id."""
    kind, user = F.col("event_id") % 11, F.col("user_id")
    text = (
        F.when(kind == 0, F.concat(F.lit("DUT NAME : dut"), user)).when(kind == 1, F.concat(F.lit("dut version=v"), user))
        .when(kind == 2, F.concat(F.lit("OS VERSION: os"), user)).when(kind == 3, F.concat(F.lit("Configuration: c "), user))
        .when(kind == 4, F.concat(F.lit("Test Case: tc_"), user)).when(kind == 5, F.concat(F.lit("version: "), user))
        .otherwise("nothing"))
    name = F.concat(F.lit("run_DUT"), user % 40, F.lit("_"), F.when(user % 3 == 0, "AS_20240101").otherwise("x"), F.lit(".log"))
    return table(spark, sf, "events").select(
        name.alias("filename"), F.col("event_id").alias("line_number"), text.alias("raw_line"))


_HEADER_SQL = """
WITH l AS (SELECT 'run_DUT' || (user_id % 40) || '_' || CASE WHEN user_id % 3 = 0 THEN 'AS_20240101' ELSE 'x' END || '.log' AS filename,
  event_id AS n,
  CASE WHEN event_id % 11 = 0 THEN 'dut' || user_id END AS dut_name,
  CASE WHEN event_id % 11 = 1 THEN 'v' || user_id END AS dut_version,
  CASE WHEN event_id % 11 = 2 THEN 'os' || user_id END AS os_version,
  CASE WHEN event_id % 11 = 3 THEN 'c ' || user_id END AS config,
  CASE WHEN event_id % 11 = 4 THEN 'tc_' || user_id END AS test_case,
  CASE WHEN event_id % 11 = 1 THEN 'v' || user_id WHEN event_id % 11 = 2 THEN 'os' || user_id
       WHEN event_id % 11 = 5 THEN '' || user_id END AS version_line FROM events),
c AS (SELECT filename, arg_min(version_line, n) FILTER (version_line IS NOT NULL) AS version_line,
  CASE WHEN count(dut_name) > 0 AND count(dut_version) > 0 AND count(os_version) > 0 AND count(config) > 0 AND count(test_case) > 0
   THEN greatest(min(n) FILTER (dut_name IS NOT NULL), min(n) FILTER (dut_version IS NOT NULL), min(n) FILTER (os_version IS NOT NULL),
     min(n) FILTER (config IS NOT NULL), min(n) FILTER (test_case IS NOT NULL)) ELSE 9000000000000000000 END AS cutoff
  FROM l GROUP BY filename),
h AS (SELECT c.filename, any_value(c.version_line) AS version_line,
  arg_max(dut_name, n) FILTER (dut_name IS NOT NULL AND n <= cutoff) AS dut_name,
  arg_max(dut_version, n) FILTER (dut_version IS NOT NULL AND n <= cutoff) AS dut_version,
  arg_max(os_version, n) FILTER (os_version IS NOT NULL AND n <= cutoff) AS os_version,
  arg_max(config, n) FILTER (config IS NOT NULL AND n <= cutoff) AS config,
  arg_max(test_case, n) FILTER (test_case IS NOT NULL AND n <= cutoff) AS test_case
  FROM c JOIN l USING (filename) GROUP BY c.filename)
"""


@query("b07_header_scan", _HEADER_SQL + "SELECT * FROM h")
def _(spark, sf):
    return header_fields(_header_lines(spark, sf))


@query("b08_header_fallbacks", _HEADER_SQL + r"""
SELECT filename, coalesce(dut_name, nullif(regexp_extract(filename, '(?i)(DUT[^\W_]+)', 1), ''), 'DUT_Auto') AS dut,
 coalesce(dut_version, upper(nullif(regexp_extract(filename, '(?i)_(AS|TEC|IP|BC|OC|V\d+)[-_]?\d{8}', 1), '')), version_line, 'Generic_v1.0') AS dut_version,
 coalesce(os_version, 'Linux') AS os_version, coalesce(config, 'Standard_Config') AS config,
 coalesce(test_case, nullif(regexp_extract(filename, '(tc_[a-zA-Z0-9_\-\.]+)', 1), ''), 'default_tc') AS test_case_id FROM h""")
def _(spark, sf):
    return with_fallbacks(header_fields(_header_lines(spark, sf)))


@query("b09_dut_version_inference", ev_sql(r"""
SELECT event_id, coalesce(upper(nullif(regexp_extract(name, '(?i)_(AS|TEC|IP|BC|OC|V\d+)[-_]?\d{8}', 1), '')),
  nullif(regexp_extract(line, '(?i)version\s*[:=]\s*([A-Za-z0-9\.\-_]+)', 1), ''), 'Generic_v1.0') AS dut_version FROM l""", """
l AS (SELECT event_id, CASE event_id % 3 WHEN 0 THEN lower(filename) WHEN 1 THEN 'x_v' || (user_id % 9) || '-20240101.log' ELSE 'plain.log' END AS name,
  CASE WHEN event_id % 2 = 0 THEN 'Version = ' || dut ELSE raw_line END AS line FROM ev)"""))
def _(spark, sf):
    kind = F.col("event_id") % 3
    name = F.when(kind == 0, F.lower("filename")).when(
        kind == 1, F.concat(F.lit("x_v"), F.col("user_id") % 9, F.lit("-20240101.log"))).otherwise("plain.log")
    line = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("Version = "), "dut")).otherwise(F.col("raw_line"))
    return logs_ev(spark, sf).select("event_id", F.coalesce(
        P.version_from_name(name), P.version_from_line(line), F.lit(K.DEFAULT_DUT_VERSION)).alias("dut_version"))


@query("b10_clock_timestamp", ev_sql(r"""
SELECT event_id, strftime(try_strptime(d || ' ' || regexp_extract(line, '^(\d{2}:\d{2}:\d{2}\.\d+)', 1), '%Y-%m-%d %H:%M:%S.%f'), '%Y-%m-%d %H:%M:%S.%f') AS stamp,
  CASE WHEN regexp_matches(line, '^\d{2}:\d{2}:\d{2}\.\d+') THEN d END AS run_date FROM l""", r"""
l AS (SELECT event_id, strftime(try_strptime(regexp_extract(filename, '(\d{8})', 1), '%Y%m%d'), '%Y-%m-%d') AS d,
  CASE event_id % 7 WHEN 0 THEN '25:61:00.1 x' WHEN 1 THEN 'x ' || raw_line ELSE raw_line END AS line FROM ev)"""))
def _(spark, sf):
    line = F.when(F.col("event_id") % 7 == 0, "25:61:00.1 x").when(
        F.col("event_id") % 7 == 1, F.concat(F.lit("x "), "raw_line")).otherwise(F.col("raw_line"))
    rows = logs_ev(spark, sf).select("event_id", line.alias("l"), P.date_from_name(F.col("filename")).alias("d"))
    return rows.select("event_id", stamp(P.clock_timestamp(F.col("l"), F.col("d"))).alias("stamp"),
                       F.date_format(P.clock_run_date(F.col("l"), F.col("d")), "yyyy-MM-dd").alias("run_date"))


_P1 = r"(?i)#\s*Result\s*[:\-]?\s*(PASSED|FAILED|ABORTED|PASS|FAIL|ABORT)\b\s*[:\-]?\s*(.*)"
_P2 = r"(?i)#\s*TEST\s*CASE\s*(PASSED|FAILED|ABORTED|PASS|FAIL|ABORT)\b\s*[:\-]?\s*(.*)"
_P3 = r"(?i)\b(TEST\s*CASE\s*)?(PASSED|FAILED|ABORTED|PASS|FAIL|ABORT)\b\s*[:\-]?\s*(.*)"


@query("b11_result_parser", ev_sql(f"""
SELECT event_id,
  regexp_replace(upper(list_filter(g, lambda x: upper(x) IN ('PASSED','FAILED','ABORTED','PASS','FAIL','ABORT'))[-1]), '^(PASS|FAIL|ABORT)ED$', '\\1') AS status,
  CASE WHEN len(g) > 1 THEN trim(g[-1]) END AS error_msg
FROM (SELECT event_id, list_filter(CASE
   WHEN regexp_matches(line, '{_P1}') THEN [regexp_extract(line, '{_P1}', 1), regexp_extract(line, '{_P1}', 2)]
   WHEN regexp_matches(line, '{_P2}') THEN [regexp_extract(line, '{_P2}', 1), regexp_extract(line, '{_P2}', 2)]
   WHEN regexp_matches(line, '{_P3}') THEN [regexp_extract(line, '{_P3}', 1), regexp_extract(line, '{_P3}', 2), regexp_extract(line, '{_P3}', 3)]
   END, lambda x: x <> '') AS g FROM l)""", """
l AS (SELECT event_id, CASE event_id % 8 WHEN 0 THEN '# TEST CASE PASSED' WHEN 1 THEN 'TEST CASE FAILED' WHEN 2 THEN 'x FAIL: fail'
  WHEN 3 THEN 'a PASS: moved to ' || dut WHEN 4 THEN 'bypassed ' || dut ELSE raw_line END AS line FROM ev)"""))
def _(spark, sf):
    kind = F.col("event_id") % 8
    line = (F.when(kind == 0, "# TEST CASE PASSED").when(kind == 1, "TEST CASE FAILED").when(kind == 2, "x FAIL: fail")
            .when(kind == 3, F.concat(F.lit("a PASS: moved to "), "dut")).when(kind == 4, F.concat(F.lit("bypassed "), "dut"))
            .otherwise(F.col("raw_line")))
    rows = logs_ev(spark, sf).select("event_id", line.alias("line"))
    return rows.select("event_id", F.inline(P.result_rows(F.col("line"))))


_FIRST_SUITE = "CASE " + " ".join(f"WHEN contains(lower(filename), '{s}') THEN '{s}'" for s in K.SUITES) + " END"


@query("b12_suite_inference", ev_sql(f"SELECT event_id, {_FIRST_SUITE} AS suite FROM ev"))
def _(spark, sf):
    return logs_ev(spark, sf).select("event_id", P.suite_from_name(F.upper("filename")).alias("suite"))


@query("b13_date_from_name", ev_sql(r"""
SELECT event_id, strftime(try_strptime(nullif(regexp_extract(f, '(\d{8})', 1), ''), '%Y%m%d'), '%Y-%m-%d') AS run_date FROM
(SELECT event_id, CASE event_id % 3 WHEN 0 THEN filename WHEN 1 THEN 'run_x_20259999.log' ELSE 'plain' || dut END AS f FROM ev)"""))
def _(spark, sf):
    name = F.when(F.col("event_id") % 3 == 0, F.col("filename")).when(
        F.col("event_id") % 3 == 1, "run_x_20259999.log").otherwise(F.concat(F.lit("plain"), "dut"))
    return logs_ev(spark, sf).select("event_id", F.date_format(P.date_from_name(name), "yyyy-MM-dd").alias("run_date"))


_MESSAGES = ["No LICENSE left", "DTMF RTP packets are not received", "x: No such file or directory",
             "Execution terminated now", "sipp gave an ERROR", "sipp only"]


@query("b14_error_category", f"""
WITH m AS (SELECT event_id, CASE WHEN event_id % 8 = 7 THEN NULL WHEN event_id % 8 = 6 THEN repeat('long ' || user_id || ' ', 30)
  ELSE ([{", ".join(f"'{m}'" for m in _MESSAGES)}])[event_id % 8 + 1] END AS msg FROM events)
SELECT event_id, CASE WHEN msg IS NULL THEN 'Unknown Error' WHEN contains(lower(msg), 'license') THEN 'License Error'
 WHEN contains(lower(msg), 'dtmf rtp packets are not received') THEN 'DTMF RTP Packet Loss'
 WHEN contains(lower(msg), 'no such file or directory') THEN 'Missing File'
 WHEN contains(lower(msg), 'execution terminated') THEN 'Execution Terminated'
 WHEN contains(lower(msg), 'sipp') AND contains(lower(msg), 'error') THEN 'SIPP Error'
 ELSE left(msg, 100) END AS error_category FROM m""")
def _(spark, sf):
    kind = F.col("event_id") % 8
    known = F.element_at(F.array(*[F.lit(m) for m in _MESSAGES]), F.least(kind + 1, F.lit(6)).cast("int"))
    msg = F.when(kind < 6, known).when(kind == 6, F.repeat(F.concat(F.lit("long "), F.col("user_id"), F.lit(" ")), F.lit(30)))
    return table(spark, sf, "events").select("event_id", P.error_category(msg).alias("error_category"))


@query("b15_message_snippet", "SELECT doc_id, left(text, 150) || '...' AS snippet FROM documents")
def _(spark, sf):
    return table(spark, sf, "documents").select("doc_id", P.message_snippet(F.col("text")).alias("snippet"))


@query("b16_keyword_flag", """
SELECT doc_id, CAST(regexp_matches(text, '(?i)fail|error|exception|abort') AS INTEGER) AS keyword_fail FROM documents""")
def _(spark, sf):
    return table(spark, sf, "documents").select("doc_id", P.keyword_flag(F.col("text")).alias("keyword_fail"))


_STOPS = ", ".join(f"'{w}'" for w in K.KEYWORD_STOP_WORDS)
_STOPS2 = ", ".join(f"'{w}'" for w in K.NOTEBOOK_STOP_WORDS)


@query("b17_tokenise", rf"""
SELECT doc_id, array_to_string(list_filter(list_transform(regexp_split_to_array(lower(text), '[\s\p{{Z}}\x{{85}}]+'), lambda w: trim(w, '.,:;#')),
  lambda w: length(w) > 2 AND w NOT IN ({_STOPS})), ' ') AS tokens FROM documents""")
def _(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.array_join(P.tokens(F.col("text")), " ").alias("tokens"))


@query("b17_tokenise_plain", rf"""
SELECT doc_id, array_to_string(list_filter(regexp_split_to_array(lower(text), '[\s\p{{Z}}\x{{85}}]+'),
  lambda w: length(w) > 2 AND w NOT IN ({_STOPS2})), ' ') AS tokens FROM documents""")
def _(spark, sf):
    words = P.tokens(F.col("text"), K.NOTEBOOK_STOP_WORDS, strip=False)
    return table(spark, sf, "documents").select("doc_id", F.array_join(words, " ").alias("tokens"))


@query("b18_status_normalisation", """
SELECT o_orderkey, upper(trim('  ' || lower(o_orderpriority) || ' ')) AS status,
  CAST(o_orderstatus = 'F' AS INTEGER) AS is_fail FROM orders""")
def _(spark, sf):
    messy = F.concat(F.lit("  "), F.lower("o_orderpriority"), F.lit(" "))
    target = V.is_fail(F.when(F.col("o_orderstatus") == "F", "Fail"))
    return table(spark, sf, "orders").select("o_orderkey", V.normal_status(messy).alias("status"), target.alias("is_fail"))


@query("b19_timestamp_coercion", """
WITH t AS (SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') WHEN 1 THEN strftime(o_orderdate, '%Y-%m-%d')
  WHEN 2 THEN 'not a date' ELSE '2024-13-45' END AS x FROM orders)
SELECT o_orderkey, strftime(try_cast(x AS TIMESTAMP), '%Y-%m-%d %H:%M:%S.%f') AS stamp FROM t""")
def _(spark, sf):
    kind = F.col("o_orderkey") % 4
    text = (F.when(kind == 0, F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss"))
            .when(kind == 1, F.date_format("o_orderdate", "yyyy-MM-dd")).when(kind == 2, "not a date").otherwise("2024-13-45"))
    return table(spark, sf, "orders").select("o_orderkey", stamp(V.to_timestamp_or_null(text)).alias("stamp"))


@query("b20_number_coercion", """
SELECT event_id, coalesce(try_cast(CASE WHEN event_id % 3 = 0 THEN 'n/a' WHEN event_id % 3 = 1 THEN CAST(value AS VARCHAR) END AS DOUBLE), 0) AS x FROM events""")
def _(spark, sf):
    text = F.when(F.col("event_id") % 3 == 0, "n/a").when(F.col("event_id") % 3 == 1, F.col("value").cast("string"))
    return table(spark, sf, "events").select("event_id", V.to_number_or_zero(text).alias("x"))


@query("b21_config_bucket", ev_sql(
    "SELECT event_id, CAST(('0x' || substr(md5(suite), 1, 15))::BIGINT % 100000000 AS BIGINT) AS config_hash FROM ev"))
def _(spark, sf):
    return logs_ev(spark, sf).select("event_id", V.config_bucket(F.col("suite")).alias("config_hash"))


@query("b22_execution_duration", ev_sql("""
SELECT event_id, round((epoch_us(max("timestamp") OVER w) - epoch_us(min("timestamp") OVER w)) / 1e6, 6) AS execution_duration
FROM ev WINDOW w AS (PARTITION BY filename, test_case_id)"""))
def _(spark, sf):
    from failscope.operators.history import execution_duration

    return execution_duration(logs_ev(spark, sf)).select("event_id", r("execution_duration").alias("execution_duration"))


@query("b23_weekday_hour", """
SELECT event_id, CAST(isodow(ts) - 1 AS INTEGER) AS exec_day, CAST(hour(ts) AS INTEGER) AS exec_hour FROM events""")
def _(spark, sf):
    return table(spark, sf, "events").select(
        "event_id", V.weekday(F.col("ts")).alias("exec_day"), F.hour("ts").alias("exec_hour"))


_LABELS = "(VALUES " + ", ".join(f"({k}, '{v}')" for k, v in K.ROOT_CAUSES.items()) + ") AS d(k, v)"


@query("b24_cluster_labels", ev_sql(f"""
SELECT event_id, coalesce(v, 'Normal') AS root_cause_label FROM ev LEFT JOIN {_LABELS} ON cluster = k"""))
def _(spark, sf):
    return label_clusters(logs_ev(spark, sf), K.NORMAL).select("event_id", "root_cause_label")


@query("b24_cluster_labels_uncategorised", f"""
SELECT vec_id, coalesce(v, 'Uncategorized') AS root_cause_label FROM embeddings LEFT JOIN {_LABELS} ON label + 3 = k""")
def _(spark, sf):
    df = table(spark, sf, "embeddings").select("vec_id", (F.col("label") + 3).alias("cluster"))
    return label_clusters(df, K.UNCATEGORIZED).select("vec_id", "root_cause_label")


@query("b25_binary_flags", ev_sql("""
SELECT event_id, CAST(status = 'FAIL' AS INTEGER) AS recent_failure_flag, CAST(pred_prob < 0.6 AS INTEGER) AS lowconfidenceflag,
  CAST(coalesce(error_msg = 'msg error k0', false) AS INTEGER) AS known FROM ev"""))
def _(spark, sf):
    return logs_ev(spark, sf).select(
        "event_id", V.flag(F.col("status") == "FAIL").alias("recent_failure_flag"),
        V.flag(F.col("pred_prob") < 0.6).alias("lowconfidenceflag"),
        V.flag(F.col("error_msg") == "msg error k0").alias("known"))


@query("b26_feature_summary", """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, 'l_linenumber:' || l_linenumber || ';l_partkey:' || l_partkey || ';l_suppkey:' || l_suppkey AS top_features FROM lineitem""")
def _(spark, sf):
    df = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    names = ["l_linenumber", "absent", "l_partkey", "l_suppkey", "absent2", "l_orderkey"]
    return df.withColumn("top_features", V.feature_summary(df, names))


@query("b26_feature_summary_rounded", """
SELECT event_id, 'value:' || CAST(round(value, 4) AS VARCHAR) AS top_features FROM events""")
def _(spark, sf):
    df = table(spark, sf, "events").select("event_id", "value")
    return df.select("event_id", V.feature_summary(df, ["value"]).alias("top_features"))


@query("b27_label_choice", ev_sql(f"""
SELECT event_id, CASE WHEN (SELECT count(status) FROM ev) > 0 THEN upper(status) ELSE coalesce(v, 'Normal') END AS label
FROM ev LEFT JOIN {_LABELS} ON cluster = k"""))
def _(spark, sf):
    return choose_label(label_clusters(logs_ev(spark, sf), K.NORMAL)).select("event_id", "label")


@query("b27_label_choice_without_status", ev_sql(f"""
SELECT event_id, coalesce(v, 'Normal') AS label FROM ev LEFT JOIN {_LABELS} ON cluster = k"""))
def _(spark, sf):
    df = label_clusters(logs_ev(spark, sf), K.NORMAL).withColumn("status", F.lit(None).cast("string"))
    return choose_label(df).select("event_id", "label")


@query("b28_recency_weight", """
SELECT event_id, round(1 + 5 * exp(-least(greatest(value * 20 - 100, 0), 1000) / 30.0), 6) AS recency_weight FROM events""")
def _(spark, sf):
    return table(spark, sf, "events").select(
        "event_id", r(V.recency_weight(F.col("value") * 20 - 100)).alias("recency_weight"))


@query("b29_cluster_weight", """
SELECT event_id, round(1 + 2 * least(greatest(value / 50 - 0.2, 0), 1), 6) AS cluster_weight FROM events""")
def _(spark, sf):
    return table(spark, sf, "events").select("event_id", r(V.cluster_weight(F.col("value") / 50 - 0.2)).alias("cluster_weight"))


@query("b30_priority_score", ev_sql("SELECT event_id, round(pred_prob * value * 1.5, 6) AS priority_score FROM ev"))
def _(spark, sf):
    return logs_ev(spark, sf).select(
        "event_id", r(V.priority_score(F.col("pred_prob"), F.col("value"), F.lit(1.5))).alias("priority_score"))


@query("b31_risk_tier", """
WITH q AS (SELECT quantile_cont(value, 0.9) AS h, quantile_cont(value, 0.6) AS m FROM events)
SELECT event_id, CASE WHEN value > (SELECT h FROM q) THEN 'HIGH' WHEN value > (SELECT m FROM q) THEN 'MEDIUM' ELSE 'LOW' END AS risk_level FROM events""")
def _(spark, sf):
    df = table(spark, sf, "events").select("event_id", "value")
    high, medium = exact_quantiles(df, "value", [0.9, 0.6])
    return df.select("event_id", V.risk_tier(F.col("value"), high, medium).alias("risk_level"))


@query("b32_column_subset", "SELECT o_orderkey, o_orderstatus FROM orders")
def _(spark, sf):
    df = table(spark, sf, "orders")
    return drop(keep(df, ["o_orderkey", "absent", "o_orderstatus", "o_custkey"]), ["o_custkey", "absent"])


