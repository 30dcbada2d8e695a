"""Splits, class weights, label and target encoding."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from failscope.constants import UNKNOWN
from failscope.operators.joins import attach
from failscope.operators.ordered import running, running_count
from failscope.storage import sized


def stratified_split(df: DataFrame, label: str, row_id: str, fraction: float = 0.2, seed: int = 42,
                     name: str = "is_test") -> DataFrame:
    """Mark exactly ``round(fraction * n)`` rows of every label as test rows.

    A row belongs to the test set when the MD5 of its id is among the smallest
    of its label.  The cut is found without ordering a label's rows: a
    histogram of the first 16 bits names the bin in which it falls, and only
    that bin (one row in 65,536) is ordered.
    """
    key = F.md5(F.concat(F.col(row_id).cast("string"), F.lit(str(seed))))
    hashed = df.withColumns({"__hash": key, "__bin": F.substring(key, 1, 4)})
    bins = hashed.groupBy(label, "__bin").agg(F.count(F.lit(1)).alias("__n"))
    up_to = Window.partitionBy(label).orderBy("__bin").rowsBetween(Window.unboundedPreceding, 0)
    # At most 65,536 bins per label.
    cut_bins = bins.select(
        label, "__bin", "__n", F.sum("__n").over(up_to).alias("__upto"),
        F.round(F.lit(fraction) * F.sum("__n").over(Window.partitionBy(label))).cast("bigint").alias("__want"),
    ).filter((F.col("__want") > F.col("__upto") - F.col("__n")) & (F.col("__want") <= F.col("__upto"))).select(
        F.col(label).alias("__label"), F.col("__bin").alias("__cut_bin"),
        (F.col("__want") - (F.col("__upto") - F.col("__n"))).alias("__nth"))
    in_bin = hashed.select(F.col(label).alias("__l"), "__bin", "__hash", F.col(row_id).alias("__id")).join(
        sized(cut_bins), F.col("__l").eqNullSafe(F.col("__label")) & (F.col("__bin") == F.col("__cut_bin")))
    nth = F.row_number().over(Window.partitionBy("__label").orderBy("__hash", "__id"))
    cuts = in_bin.withColumn("__i", nth).filter("__i = __nth").select(
        "__label", F.col("__hash").alias("__cut_hash"), F.col("__id").alias("__cut_id"))
    chosen = (F.col("__hash") < F.col("__cut_hash")) | (
        (F.col("__hash") == F.col("__cut_hash")) & (F.col(row_id) <= F.col("__cut_id")))
    return hashed.join(sized(cuts), F.col(label).eqNullSafe(F.col("__label")), "left").select(
        *df.columns, F.coalesce(chosen.cast("int"), F.lit(0)).alias(name))


def class_weight(df: DataFrame, target: str = "isFail") -> DataFrame:
    """max(1, negatives / positives), one row."""
    negative, positive = F.count_if(F.col(target) == 0), F.count_if(F.col(target) == 1)
    return df.agg(F.greatest(F.lit(1.0), negative / F.greatest(F.lit(1), positive)).alias("scale_pos_weight"))


def weight_column(df: DataFrame, target: str = "isFail", name: str = "weight") -> DataFrame:
    weight = class_weight(df, target).scalar()
    return df.withColumn(name, F.when(F.col(target) == 1, weight).otherwise(F.lit(1.0)))


def label_codes(df: DataFrame, columns: Sequence[str], max_group_rows: int | None = None) -> DataFrame:
    """(column, value, code): position of each value among the sorted values of its column."""
    pairs = df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.coalesce(F.col(c).cast("string"), F.lit(UNKNOWN)).alias("value"))
        for c in columns])).alias("p")).select("p.*").distinct()
    return running(pairs, ["column"], [F.col("value")], max_group_rows,
                   code=running_count(inclusive=False))


def label_encode(df: DataFrame, columns: Sequence[str], max_group_rows: int | None = None,
                 codes_from: DataFrame | None = None) -> DataFrame:
    """Replace each column by the ordinal of its value; null counts as ``Unknown``.

    ``codes_from`` may name an earlier frame that holds the same values.
    """
    columns = [c for c in columns if c in df.columns]
    if not columns:
        return df
    codes = sized(label_codes(df if codes_from is None else codes_from, columns, max_group_rows))
    out = df
    for c in columns:
        of_column = codes.filter(F.col("column") == c).select(
            F.col("value").alias("__value"), F.col("code").cast("int").alias("__code"))
        joined = out.join(of_column, F.coalesce(F.col(c).cast("string"), F.lit(UNKNOWN)) == F.col("__value"), "left")
        out = joined.select(*[F.col("__code").alias(c) if n == c else F.col(n) for n in out.columns])
    return out


def target_encode(df: DataFrame, columns: Sequence[str], target: str = "isFail") -> DataFrame:
    """Mean target per category over all rows, as ``<column>_te``; 0 for a null category."""
    source = df
    for c in columns:
        name = f"{c}_te"
        df = attach(df, [c], source, **{name: F.avg(target)}).withColumn(name, F.coalesce(name, F.lit(0.0)))
    return df


def target_encode_fitted(df: DataFrame, train: Column, columns: Sequence[str], target: str = "isFail") -> DataFrame:
    """As above, from the training rows only; a category unseen in training gets 0."""
    source = df
    for c in columns:
        name = f"{c}_te"
        df = attach(df, [c], source, **{name: F.avg(F.when(train, F.col(target)))}).withColumn(
            name, F.coalesce(name, F.lit(0.0)))
    return df
