"""Sorting, limits, de-duplication, union."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def distinct_rows(df: DataFrame) -> DataFrame:
    return df.dropDuplicates()


def top_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int = 1) -> DataFrame:
    """First ``k`` rows per key; null is a key of its own.

    Spark keeps at most ``k`` rows per key in every map task before the shuffle
    (WindowGroupLimit), so a hot key is no large group.
    """
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("__rank", rank).filter(F.col("__rank") <= k).drop("__rank")


def best_per_key(df: DataFrame, keys: Sequence[str], score: str, ties: Sequence[Column]) -> DataFrame:
    """Row with the highest score per key, nulls last, ties by ``ties``."""
    return top_per_key(df, keys, [F.col(score).desc_nulls_last(), *ties])


def nulls_last(df: DataFrame, *names: str, descending: bool = False) -> DataFrame:
    cols = [F.col(n).desc_nulls_last() if descending else F.col(n).asc_nulls_last() for n in names]
    return df.orderBy(*cols)


def top_rows(df: DataFrame, order: Sequence[Column], k: int) -> DataFrame:
    return df.orderBy(*order).limit(k)


def stack(*frames: DataFrame) -> DataFrame:
    """All rows of all frames, columns by name."""
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame, allowMissingColumns=True)
    return out
