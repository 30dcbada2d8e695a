"""Counts and data-quality reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from failscope.constants import CRITICAL_FIELDS
from failscope.functions.parse import error_category
from failscope.operators.dedupe import top_rows
from failscope.operators.repair import with_status


GAP_MEANING = {
    "dut_version": "DUT version is missing, models should not rely on it",
    "os_version": "OS version is missing, its extraction should be improved",
    "error_msg": "rows without an error message",
    "duplicate_rows": "repeated rows, consider removing them",
}


def value_counts(df: DataFrame, column: str, nulls: bool = False, name: str = "count") -> DataFrame:
    """Rows per value, most frequent first, ties by value."""
    source = df if nulls else df.filter(F.col(column).isNotNull())
    return source.groupBy(column).agg(F.count(F.lit(1)).alias(name)).orderBy(
        F.col(name).desc(), F.col(column).asc_nulls_last())


def executions_per_day(df: DataFrame, timestamp: str) -> DataFrame:
    return df.filter(F.col(timestamp).isNotNull()).groupBy(F.to_date(timestamp).alias("run_date")).agg(
        F.count(F.lit(1)).alias("executions"))


def top_failure_reasons(df: DataFrame, k: int = 10) -> DataFrame:
    """Most frequent messages of FAIL and ABORT rows."""
    counted = with_status(df, ["FAIL", "ABORT"]).filter("error_msg is not null").groupBy("error_msg").agg(
        F.count(F.lit(1)).alias("count"))
    return top_rows(counted, [F.col("count").desc(), F.col("error_msg")], k)


def top_failure_categories(df: DataFrame, k: int = 10) -> DataFrame:
    categories = with_status(df, ["FAIL"]).select(error_category(F.col("error_msg")).alias("error_category"))
    counted = categories.groupBy("error_category").agg(F.count(F.lit(1)).alias("count"))
    return top_rows(counted, [F.col("count").desc(), F.col("error_category")], k)


def column_report(df: DataFrame) -> DataFrame:
    """Missing and present count and percentage of every column, in one pass."""
    names = df.columns
    counts = df.agg(F.count(F.lit(1)).alias("__rows"), *[F.count(F.col(f"`{c}`")).alias(c) for c in names])
    long = counts.unpivot(["__rows"], names, "column", "non_null")
    share = F.lit(100.0) / F.col("__rows")
    return long.select(
        "column",
        (F.col("__rows") - F.col("non_null")).alias("missing_count"),
        ((F.col("__rows") - F.col("non_null")) * share).alias("missing_pct"),
        F.col("non_null").alias("non_null_count"),
        (F.col("non_null") * share).alias("coverage_pct"),
    )


def missing_report(df: DataFrame) -> DataFrame:
    return column_report(df).select("column", "missing_count", "missing_pct").orderBy(
        F.col("missing_pct").desc(), "column")


def coverage_report(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    report = column_report(df).select("column", "non_null_count", "coverage_pct")
    if columns is not None:
        report = report.filter(F.col("column").isin(list(columns)))
    return report.orderBy("coverage_pct", "column")


def critical_coverage(df: DataFrame) -> DataFrame:
    return coverage_report(df, CRITICAL_FIELDS)


def duplicate_rows(df: DataFrame) -> DataFrame:
    """Number of rows that repeat an earlier one; nulls count as equal."""
    return df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("__n")).agg(
        F.coalesce(F.sum(F.col("__n") - 1), F.lit(0)).alias("duplicate_rows"))


def data_gaps(df: DataFrame) -> DataFrame:
    """The quality rules that are broken, with the number of rows at fault and what it means."""
    watched = [c for c in ("dut_version", "os_version", "error_msg") if c in df.columns]
    report = column_report(df.select(*watched)).select(
        F.col("column").alias("gap"), F.col("missing_count").alias("rows"))
    repeated = duplicate_rows(df).select(F.lit("duplicate_rows").alias("gap"), F.col("duplicate_rows").alias("rows"))
    meaning = F.lit("")
    for gap, text in GAP_MEANING.items():
        meaning = F.when(F.col("gap") == gap, text).otherwise(meaning)
    return report.unionByName(repeated).filter("rows > 0").withColumn("message", meaning)


def report_totals(df: DataFrame, fail: str = "isFail") -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("total_rows"), F.coalesce(F.sum(fail), F.lit(0)).alias("failures"))
