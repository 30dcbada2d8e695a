"""Column functions on parsed values: coercion, flags, weights, features."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def normal_status(status: Column) -> Column:
    return F.upper(F.trim(status))


def is_fail(status: Column) -> Column:
    """1 for a FAIL status in any case, else 0 (also for null)."""
    return F.coalesce((F.lower(status) == "fail").cast("int"), F.lit(0))


def flag(condition: Column) -> Column:
    return F.coalesce(condition.cast("int"), F.lit(0))


def to_timestamp_or_null(text: Column) -> Column:
    return text.try_cast("timestamp")


def to_number_or_zero(text: Column) -> Column:
    """Number, with 0 for null, text that is no number, and NaN."""
    return F.coalesce(F.nanvl(text.try_cast("double"), F.lit(0.0)), F.lit(0.0))


def config_bucket(config: Column) -> Column:
    """Stable bucket in [0, 10^8); the reference's depends on the process."""
    digits = F.substring(F.md5(F.coalesce(config, F.lit("nan"))), 1, 15)
    return F.conv(digits, 16, 10).cast("bigint") % 100_000_000


def seconds_between(later: Column, earlier: Column) -> Column:
    micros = F.unix_micros(later.cast("timestamp")) - F.unix_micros(earlier.cast("timestamp"))
    return micros / F.lit(1_000_000.0)


def weekday(ts: Column) -> Column:
    """Monday = 0."""
    return F.weekday(ts)


def recency_weight(seconds: Column) -> Column:
    clipped = F.least(F.greatest(to_number_or_zero(seconds), F.lit(0.0)), F.lit(1000.0))
    return F.lit(1.0) + F.lit(5.0) * F.exp(-clipped / F.lit(30.0))


def cluster_weight(rate: Column) -> Column:
    clipped = F.least(F.greatest(F.coalesce(rate, F.lit(0.0)), F.lit(0.0)), F.lit(1.0))
    return F.lit(1.0) + F.lit(2.0) * clipped


def priority_score(probability: Column, recency: Column, cluster: Column) -> Column:
    return probability * recency * cluster


def risk_tier(score: Column, high: float | Column, medium: float | Column,
              names: Sequence[str] = ("HIGH", "MEDIUM", "LOW")) -> Column:
    """Strictly above the two thresholds."""
    high = high if isinstance(high, Column) else F.lit(high)
    medium = medium if isinstance(medium, Column) else F.lit(medium)
    return F.when(score > high, names[0]).when(score > medium, names[1]).otherwise(names[2])


def feature_summary(df: DataFrame, features: Sequence[str], top: int = 5) -> Column:
    """``name:value`` of the first ``top`` features the frame has, joined by ``;``."""
    present = [f for f in list(features)[:top] if f in df.columns]
    if not present:
        return F.lit("")
    return F.concat_ws(";", *[F.concat(F.lit(f"{f}:"), F.coalesce(_shown(df, f), F.lit("nan"))) for f in present])


def _shown(df: DataFrame, name: str) -> Column:
    if dict(df.dtypes)[name] in ("double", "float"):
        return F.round(F.col(name), 4).cast("string")
    return F.col(name).cast("string")
