"""Features from the history of a test case, device or suite.

``order`` must identify a row (see ``ordered``).  Rows with a null key get null,
as the key then names no history.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from failscope.functions.values import seconds_between
from failscope.operators.joins import attach
from failscope.operators.ordered import Running, last_seen, running, running_count, running_mean, running_sum


def _known(keys: Sequence[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])


def _running_known(df: DataFrame, keys: Sequence[str], order: Sequence[Column], max_group_rows: int | None,
                   **columns: Running) -> DataFrame:
    out = running(df, keys, order, max_group_rows, **columns)
    return out.withColumns({n: F.when(_known(keys), F.col(n)) for n in columns})


def failure_rates(df: DataFrame, names: dict[str, str], fail: str = "fail_flag") -> DataFrame:
    """Mean of the fail flag per key, for ``{key: name}``; 0 where the frame lacks the key."""
    source = df
    for key, name in names.items():
        if key in source.columns:
            df = attach(df, [key], source, **{name: F.avg(fail)})
        else:
            df = df.withColumn(name, F.lit(0.0))
    return df


def regression_group(df: DataFrame, key: str = "test_case", fail: str = "fail_flag") -> DataFrame:
    return attach(df, [key], regression_group=F.sum(fail))


def schedule_cycle(df: DataFrame, order: Sequence[Column], keys: Sequence[str] = ("dut", "suite"),
                   max_group_rows: int | None = None) -> DataFrame:
    """1-based position within (dut, suite)."""
    return _running_known(df, keys, order, max_group_rows, schedule_cycle=running_count())


def past_failure_frequency(df: DataFrame, order: Sequence[Column], key: str = "test_case", fail: str = "fail_flag",
                           max_group_rows: int | None = None) -> DataFrame:
    """Failures of the test case before this row."""
    return _running_known(df, [key], order, max_group_rows,
                          past_failure_frequency=running_sum(F.col(fail).cast("bigint"), inclusive=False))


def time_since_last_failure(df: DataFrame, order: Sequence[Column], keys: Sequence[str] = ("dut", "test_case_id"),
                            timestamp: str = "timestamp", max_group_rows: int | None = None) -> DataFrame:
    """Seconds from the previous FAIL to this FAIL; 0 on first, other or undated rows."""
    failed_at = F.when((F.col("status") == "FAIL") & F.col(timestamp).isNotNull(), F.col(timestamp))
    out = _running_known(df, keys, order, max_group_rows, __previous=last_seen(failed_at, inclusive=False))
    since = F.when(failed_at.isNotNull(), seconds_between(F.col(timestamp), F.col("__previous")))
    return out.withColumn("time_since_last_failure", F.coalesce(since, F.lit(0.0))).drop("__previous")


def offset_to_final_failure(df: DataFrame, order: Sequence[Column], key: str = "test_case_id", fail: str = "is_fail",
                            timestamp: str = "executiontime") -> DataFrame:
    """Seconds to the last dated failure of the test case (never positive), on FAIL rows; 0 elsewhere."""
    failed = (F.col(fail) == 1) & F.col(timestamp).isNotNull()
    final = F.max_by(F.col(timestamp), F.when(failed, F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)])))
    out = attach(df, [key], __final=final)
    offset = F.when(F.col(fail) == 1, seconds_between(F.col(timestamp), F.col("__final")))
    return out.withColumn("time_since_last_failure", F.coalesce(offset, F.lit(0.0))).drop("__final")


def test_case_history(df: DataFrame, order: Sequence[Column], key: str = "test_case_id", fail: str = "is_fail",
                      max_group_rows: int | None = None) -> DataFrame:
    """Past failure rate, execution count, mean duration, anomaly history: one pass per test case."""
    columns = {
        "past_failure_rate": running_mean(F.col(fail), inclusive=False),
        "execution_frequency": running_count(inclusive=False),
    }
    if "execution_duration" in df.columns:
        columns["avg_duration"] = running_mean(F.col("execution_duration"))
    if "is_anomaly" in df.columns:
        columns["rolling_anomaly_rate"] = running_mean(F.col("is_anomaly"), inclusive=False)
    if "anomaly_score" in df.columns:
        columns["mean_anomaly_score"] = running_mean(F.col("anomaly_score"))
    out = _running_known(df, [key], order, max_group_rows, **columns)
    out = out.withColumns({
        n: F.coalesce(n, F.lit(0.0)) for n in ("past_failure_rate", "rolling_anomaly_rate") if n in columns})
    missing = {n: F.lit(0.0) for n in ("avg_duration", "rolling_anomaly_rate", "mean_anomaly_score")
               if n not in columns}
    return out.withColumns(missing)


def execution_duration(df: DataFrame, keys: Sequence[str] = ("filename", "test_case_id"),
                       timestamp: str = "timestamp") -> DataFrame:
    """Seconds between the first and last line of a test in a file.

    Undated tests get a stable 10..60 from their key, since the reference draws
    the value at random.
    """
    span = seconds_between(F.max(timestamp), F.min(timestamp))
    drawn = (F.lit(10) + F.pmod(F.xxhash64(*keys), F.lit(51))).cast("double")
    out = attach(df, keys, execution_duration=span)
    return out.withColumn("execution_duration", F.coalesce("execution_duration", drawn))
