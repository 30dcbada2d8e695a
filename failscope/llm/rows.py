"""Bringing decisions about texts back to whole rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from failscope.storage import materialize


def text_hash(name: str = "th") -> Column:
    return F.xxhash64(F.coalesce("text", F.lit(""))).alias(name)


def matched(documents: DataFrame, decided: DataFrame, key: str = "doc_id") -> DataFrame:
    """row (all columns of the document) and the columns of ``decided`` (key, th, ...).

    ``decided`` has a row for each wanted document row.  Rows that agree in id and text
    are matched by their number ``nth`` in the order of a hash of all their columns, so that a task
    that runs again numbers them alike.
    """
    decided = materialize(decided, "decided")
    rows = documents.select(F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("row"), F.col(key).alias("id"), text_hash("t"))
    if decided.groupBy("key", "th").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty():
        rows, decided = rows.withColumn("nr", F.lit(1)), decided.withColumn("nth", F.lit(1))
        same = F.lit(True)
    else:
        rows = rows.withColumn("all", F.xxhash64(F.to_json("row"))).withColumn("nr", F.row_number().over(Window.partitionBy("id", "t").orderBy("all")))
        decided = decided.withColumn("nth", F.row_number().over(Window.partitionBy("key", "th").orderBy(F.xxhash64(*[F.col(f"`{c}`") for c in decided.columns]))))
        same = F.col("nr") == F.col("nth")
    return rows.join(decided, F.col("id").eqNullSafe(F.col("key")) & (F.col("t") == F.col("th")) & same).drop("id", "t", "nr", "all")
