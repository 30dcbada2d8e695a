"""Stage tables: typed CSV and parquet in and out, optional inputs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from failscope.sources.quoted import read_quoted_csv


def read_csv(spark: SparkSession, path: str, schema: StructType | str | None = None,
             line_breaks_in_quotes: bool = False) -> DataFrame:
    """CSV with a header and doubled quotes.

    Give a schema for large inputs: without one Spark reads the files once more
    to infer the types.  Allow line breaks inside quotes only where they occur:
    files are then read twice, to find the quotes that are open at each split.
    """
    if line_breaks_in_quotes:
        return read_quoted_csv(spark, path, schema)
    reader = spark.read.options(header=True, quote='"', escape='"')
    if schema is None:
        return reader.option("inferSchema", True).csv(path)
    return reader.schema(schema).option("enforceSchema", True).csv(path)


def write_csv(df: DataFrame, path: str) -> None:
    # White space at the ends of a field belongs to it.
    df.write.mode("overwrite").options(header=True, quote='"', escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)


def write_table(df: DataFrame, path: str) -> None:
    """Parquet, the hand-over format between stages."""
    df.write.mode("overwrite").parquet(path)


def exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def first_existing(spark: SparkSession, paths: Sequence[str]) -> str:
    for path in paths:
        if exists(spark, path):
            return path
    raise FileNotFoundError(f"none of {list(paths)} exists")


def read_table(spark: SparkSession, path: str, schema: StructType | str | None = None) -> DataFrame:
    """Parquet, or CSV when the path ends in ``.csv``."""
    return read_csv(spark, path, schema) if path.rstrip("/").endswith(".csv") else spark.read.parquet(path)


def read_optional(spark: SparkSession, path: str, schema: StructType | str | None = None) -> DataFrame | None:
    return read_table(spark, path, schema) if exists(spark, path) else None
