"""Registered queries and the SQL they are checked against.

``logs_ev`` stands in for parsed test logs: it is derived from the whole
``events`` table by the same definition in Spark and in SQL.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from failscope import constants as K

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"{name} registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql.strip()
        return fn

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def r(column: Column | str, digits: int = 6) -> Column:
    return F.round(F.col(column) if isinstance(column, str) else column, digits)


def stamp(column: Column | str) -> Column:
    return F.date_format(column, "yyyy-MM-dd HH:mm:ss.SSSSSS")


def logs_ev(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    case = F.concat(F.lit("tc_"), F.col("user_id") % 10)
    suite = F.element_at(F.array(*[F.lit(s) for s in K.SUITES]), (F.col("user_id") % 10 + 1).cast("int"))
    status = F.when(F.col("event_type") == "error", "FAIL").when(F.col("event_type") == "signup", "ABORT").otherwise("PASS")
    word = F.when(F.col("event_type") == "error", "FAILED").when(F.col("event_type") == "signup", "ABORTED").otherwise("PASSED")
    message = F.concat(F.lit("msg "), "event_type", F.lit(" k"), F.col("event_id") % 13)
    text = F.when(F.col("event_id") % 4 == 0, "").otherwise(F.concat(F.lit(" - "), message))
    return e.select(
        "event_id", "user_id", "event_type", "value", F.col("ts").alias("timestamp"),
        F.to_date("ts").alias("run_date"),
        status.alias("status"),
        case.alias("test_case_id"),
        F.concat(F.lit("DUT"), F.col("user_id") % 7).alias("dut"),
        suite.alias("suite"),
        F.concat(case, F.lit("_"), suite, F.lit("_AS_"), F.date_format("ts", "yyyyMMdd"), F.lit(".log")).alias("filename"),
        F.col("event_id").alias("line_number"),
        F.when(F.col("event_id") % 4 != 0, message).alias("error_msg"),
        F.concat(F.date_format("ts", "HH:mm:ss.SSSSSS"), F.lit(" # Result: "), word, text).alias("raw_line"),
        F.when(status == "FAIL", (F.col("event_id") % 10).cast("int")).otherwise(F.lit(-1)).alias("cluster"),
        ((F.col("event_id") * 37 % 1000) / 1000.0).alias("pred_prob"),
        (status == "FAIL").cast("int").alias("fail_flag"),
    )


_SUITE_LIST = ", ".join(f"'{s}'" for s in K.SUITES)
EV = f"""
ev AS (
  SELECT event_id, user_id, event_type, value, ts AS "timestamp", CAST(ts AS DATE) AS run_date,
    CASE event_type WHEN 'error' THEN 'FAIL' WHEN 'signup' THEN 'ABORT' ELSE 'PASS' END AS status,
    'tc_' || (user_id % 10) AS test_case_id,
    'DUT' || (user_id % 7) AS dut,
    ([{_SUITE_LIST}])[user_id % 10 + 1] AS suite,
    'tc_' || (user_id % 10) || '_' || ([{_SUITE_LIST}])[user_id % 10 + 1] || '_AS_'
      || strftime(ts, '%Y%m%d') || '.log' AS filename,
    event_id AS line_number,
    CASE WHEN event_id % 4 <> 0 THEN 'msg ' || event_type || ' k' || (event_id % 13) END AS error_msg,
    strftime(ts, '%H:%M:%S.%f') || ' # Result: '
      || CASE event_type WHEN 'error' THEN 'FAILED' WHEN 'signup' THEN 'ABORTED' ELSE 'PASSED' END
      || CASE WHEN event_id % 4 = 0 THEN '' ELSE ' - msg ' || event_type || ' k' || (event_id % 13) END AS raw_line,
    CAST(CASE WHEN event_type = 'error' THEN event_id % 10 ELSE -1 END AS INTEGER) AS cluster,
    (event_id * 37 % 1000) / 1000.0 AS pred_prob,
    CAST(event_type = 'error' AS INTEGER) AS fail_flag
  FROM events)
"""


def ev_sql(body: str, more: str = "") -> str:
    return f"WITH {EV.strip()}{(', ' + more.strip()) if more else ''} {body.strip()}"
