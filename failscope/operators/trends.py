"""Aggregates over time, clusters and scores: the tables behind the charts."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from failscope.constants import STATUSES
from failscope.operators.dedupe import top_rows


def status_by_day(df: DataFrame, day: str = "run_date", statuses: Sequence[str] = STATUSES) -> DataFrame:
    """Rows per day and status, one column per status, 0 where there are none."""
    counted = df.filter(F.col(day).isNotNull()).groupBy(day).agg(
        *[F.count_if(F.col("status") == s).alias(s) for s in statuses],
        F.count("status").alias("total"))
    return counted.filter("total > 0").drop("total")


def daily_rates(df: DataFrame, day: str = "run_date") -> DataFrame:
    """Pass and failure share of the rows with a status, per day."""
    return df.filter(F.col(day).isNotNull() & F.col("status").isNotNull()).groupBy(day).agg(
        F.count(F.lit(1)).alias("total"),
        F.avg((F.col("status") == "PASS").cast("double")).alias("pass_rate"),
        F.avg((F.col("status") == "FAIL").cast("double")).alias("failure_rate"))


def failure_spikes(df: DataFrame, day: str = "run_date", deviations: float = 2.0, only: bool = True) -> DataFrame:
    """Days whose failure rate exceeds the mean over days by two sample deviations."""
    rates = daily_rates(df, day)
    threshold = rates.agg((F.avg("failure_rate") + deviations * F.stddev_samp("failure_rate")).alias("t")).scalar()
    out = rates.withColumn("threshold", threshold).withColumn(
        "is_spike", F.coalesce(F.col("failure_rate") > F.col("threshold"), F.lit(False)))
    return out.filter("is_spike") if only else out


def cluster_counts(df: DataFrame, by: str, cluster: str = "cluster") -> DataFrame:
    return df.groupBy(by, cluster).agg(F.count(F.lit(1)).alias("count"))


def cluster_counts_if_several(df: DataFrame, by: str = "suite", cluster: str = "cluster") -> DataFrame:
    """Cluster counts, empty when the column has a single value."""
    counted = cluster_counts(df, by, cluster)
    several = counted.agg(F.count_distinct(by).alias("n")).scalar()
    return counted.filter(several > 1)


def monthly_counts(df: DataFrame, date: str, column: str, values: Sequence[object] | None = None) -> DataFrame:
    """Rows per month, one column per value, 0 where there are none.

    Without ``values`` they are those of the dated rows, in order; each is a column of
    the result, so they are few.
    """
    if values is None:
        found = df.filter(F.col(date).isNotNull() & F.col(column).isNotNull()).select(column).distinct()
        values = sorted(row[0] for row in found.collect())
    month = F.trunc(F.col(date).cast("date"), "month").alias("month")
    return df.filter(F.col(date).isNotNull()).groupBy(month).agg(
        *[F.count_if(F.col(column) == v).alias(str(v)) for v in values])


def top_mean(df: DataFrame, key: str, value: str, k: int = 10, name: str = "mean_score") -> DataFrame:
    means = df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.avg(value).alias(name))
    return top_rows(means, [F.col(name).desc_nulls_last(), F.col(key)], k)


def risk_heat_map(df: DataFrame, row: str, column: str, value: str, columns: Sequence[str] | None = None,
                  rows: int = 40) -> DataFrame:
    """Mean value per (row, column) for the rows with the highest cell; 0 where a listed column has no value.

    Long form without ``columns``; with them one column each.
    """
    cells = df.filter(F.col(row).isNotNull() & F.col(column).isNotNull()).groupBy(row, column).agg(
        F.avg(value).alias("mean_score"))
    best = top_rows(cells.groupBy(row).agg(F.max("mean_score").alias("__max")),
                    [F.col("__max").desc_nulls_last(), F.col(row)], rows)
    # At most ``rows`` rows.
    kept = cells.join(F.broadcast(best.select(row)), row, "left_semi")
    if columns is None:
        return kept
    return kept.groupBy(row).agg(*[
        F.coalesce(F.max(F.when(F.col(column) == c, F.col("mean_score"))), F.lit(0.0)).alias(str(c))
        for c in columns])


def trend_by_bins(df: DataFrame, date: str, key: str, value: str, days: int = 7) -> DataFrame:
    """Mean value per key in bins of ``days`` days that start on the earliest date."""
    day = F.col(date).cast("date")
    dated = df.filter(day.isNotNull() & F.col(key).isNotNull())
    start = dated.agg(F.min(day).alias("d")).scalar()
    binned = dated.withColumn("__start", start)
    bin_start = F.date_add("__start", (F.floor(F.date_diff(day, F.col("__start")) / days) * days).cast("int"))
    return binned.groupBy(bin_start.alias("bin_start"), key).agg(F.avg(value).alias("mean_score"))


def _range_of(df: DataFrame, column: str):
    value = F.col(column).cast("double")
    return df.filter(value.isNotNull() & ~F.isnan(value)).agg(
        F.min(value).alias("low"), F.max(value).alias("high"), F.count(value).alias("n"),
        F.stddev_samp(value).alias("std")).first()


def histogram(df: DataFrame, column: str, bins: int = 40) -> DataFrame:
    """Equal-width bins over the value range, empty ones included; the last is closed."""
    spark = df.sparkSession
    edges = _range_of(df, column)
    empty = spark.range(1, bins + 1).select(F.col("id").cast("int").alias("bin"))
    if not edges.n:
        return empty.limit(0).select("bin", *[F.lit(0.0).alias(c) for c in ("low", "high")],
                                     F.lit(0).cast("bigint").alias("count"))
    low, high = (edges.low, edges.high) if edges.high > edges.low else (edges.low - 0.5, edges.high + 0.5)
    width = (high - low) / bins
    value = F.col(column).cast("double")
    number = F.least(F.width_bucket(value, F.lit(low), F.lit(high), F.lit(bins)).cast("int"), F.lit(bins))
    counted = df.filter(value.isNotNull() & ~F.isnan(value)).groupBy(number.alias("bin")).agg(
        F.count(F.lit(1)).alias("count"))
    # One row per bin.
    return empty.join(F.broadcast(counted), "bin", "left").select(
        "bin",
        (F.lit(low) + (F.col("bin") - 1) * F.lit(width)).alias("low"),
        (F.lit(low) + F.col("bin") * F.lit(width)).alias("high"),
        F.coalesce("count", F.lit(0)).alias("count"))


def density_curve(df: DataFrame, column: str, points: int = 200) -> DataFrame:
    """Gaussian kernel density over the value range, Scott bandwidth.

    Every task adds its rows to one array of ``points`` sums, so only those sums
    are shuffled.
    """
    spark = df.sparkSession
    stats = _range_of(df, column)
    if not stats.n or stats.n < 2 or not stats.std:
        return spark.createDataFrame([], "point int, x double, density double")
    grid = np.linspace(stats.low, stats.high, points)
    width = stats.std * stats.n ** (-0.2)
    scale = 1.0 / (stats.n * width * math.sqrt(2.0 * math.pi))

    def add_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(points)
        for batch in batches:
            values = batch["v"].to_numpy()
            for i in range(0, len(values), 2_000):
                u = (grid[None, :] - values[i:i + 2_000, None]) / width
                total += np.exp(-0.5 * u * u).sum(axis=0)
        yield pd.DataFrame({"point": np.arange(points, dtype="int32"), "part": total})

    value = F.col(column).cast("double")
    parts = df.select(value.alias("v")).filter(F.col("v").isNotNull() & ~F.isnan("v")).mapInPandas(
        add_up, "point int, part double")
    step = (stats.high - stats.low) / (points - 1)
    return parts.groupBy("point").agg((F.sum("part") * F.lit(scale)).alias("density")).select(
        "point", (F.lit(float(stats.low)) + F.col("point") * F.lit(step)).alias("x"), "density")


def share_of_total(df: DataFrame, column: str) -> DataFrame:
    """Rows per value and their percentage of all rows with a value."""
    counted = df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("count"))
    total = counted.agg(F.sum("count").alias("t")).scalar()
    return counted.withColumn("share_pct", F.col("count") * F.lit(100.0) / total)
