"""Filters and missing-value repair."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from failscope import constants as K
from failscope.functions.parse import date_from_name, suite_from_name
from failscope.operators.ordered import first_in_frame, last_seen, next_seen, running
from failscope.sources.columns import file_key


def with_status(df: DataFrame, statuses: Sequence[str], column: str = "status") -> DataFrame:
    return df.filter(F.col(column).isin(list(statuses)))


def with_status_or_message(df: DataFrame) -> DataFrame:
    return df.filter(F.col("status").isNotNull() | F.col("error_msg").isNotNull())


def failures_only(df: DataFrame, cluster: str = "cluster") -> DataFrame:
    """Rows of a real cluster; text that is no number is dropped too."""
    return df.filter(F.col(cluster).try_cast("double") >= 0)


def anomalies_only(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    found = df.filter(F.col("is_anomaly") == 1)
    return found.select(*columns) if columns else found


def fill_constants(df: DataFrame, values: Mapping[str, object] | None = None, rest: str | None = None) -> DataFrame:
    """Per-column constants first, then ``rest`` in every column still null.

    A column of another type becomes a string only if ``rest`` is to be put in it.
    """
    out = df.fillna(dict(values)) if values else df
    if rest is None:
        return out
    return out.select(*[F.coalesce(F.col(c).cast("string"), F.lit(rest)).alias(c)
                        if c not in (values or {}) else F.col(c) for c in out.columns])


def fill_both_ways(df: DataFrame, keys: Sequence[str], order: Sequence[Column], columns: Sequence[str],
                   max_group_rows: int | None = None) -> DataFrame:
    """Forward, then backward fill inside each group.

    The backward fill stays inside the group too; filling across groups would
    give one file the dates of another.
    """
    fills = {}
    for c in columns:
        fills[f"__f_{c}"] = last_seen(F.col(c))
        fills[f"__b_{c}"] = next_seen(F.col(c))
    out = running(df, keys, order, max_group_rows, **fills)
    return out.withColumns({c: F.coalesce(f"__f_{c}", f"__b_{c}") for c in columns}).drop(*fills)


def pass_and_fail_messages(df: DataFrame) -> DataFrame:
    """PASS says ``No Error``; FAIL and ABORT never do."""
    message = F.col("error_msg")
    return df.withColumn(
        "error_msg",
        F.when(F.col("status") == "PASS", K.NO_ERROR)
        .when(F.col("status").isin("FAIL", "ABORT") & (F.lower(message) == "no error"), F.lit(None).cast("string"))
        .otherwise(message))


def reason_from_context(df: DataFrame, reach: int = 10, max_group_rows: int | None = None) -> DataFrame:
    """Empty FAIL / ABORT messages get the earliest telling line within ``reach`` rows of the file."""
    line = F.when(F.col("raw_line").rlike(K.CONTEXT_KEYWORDS), F.trim("raw_line"))
    out = first_in_frame(df, [file_key(df)], [F.col("line_number")], reach, line, "__near", max_group_rows)
    needs = F.col("status").isin("FAIL", "ABORT") & (F.coalesce("error_msg", F.lit("")) == "")
    return out.withColumn(
        "error_msg",
        F.when(needs, F.coalesce("__near", F.lit(K.REASON_NOT_FOUND)))
        .otherwise(F.coalesce("error_msg", F.lit(K.REASON_NOT_FOUND)))).drop("__near")


def date_backstop(df: DataFrame) -> DataFrame:
    """Missing run dates from the file name; rows that still have none go."""
    return df.withColumn("run_date", F.coalesce("run_date", date_from_name(F.col("filename")))).filter(
        "run_date is not null")


def suite_backstop(df: DataFrame) -> DataFrame:
    return df.withColumn("suite", F.coalesce("suite", suite_from_name(F.col("filename"))))


def coalesced_status(first: Column, second: Column) -> Column:
    return F.upper(F.coalesce(first, second, F.lit("")))
