"""The line parsers on a stream of log lines.

The parsers keep no state, so a stream needs no watermark and no state store.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from failscope.functions import parse as P
from failscope.sources.logs import clean_bytes, trim_line


def read_line_stream(spark: SparkSession, root: str, files_per_trigger: int = 1000) -> DataFrame:
    """(filename, raw_line) of the lines of new files below ``root``."""
    text = spark.readStream.option("maxFilesPerTrigger", files_per_trigger).option(
        "recursiveFileLookup", "true").text(root)
    return text.select(
        F.element_at(F.split("_metadata.file_path", "/"), -1).alias("filename"),
        trim_line(clean_bytes(F.col("value"))).alias("raw_line"))


def parse_line_stream(lines: DataFrame) -> DataFrame:
    """Clock, status, reason and suite of each line that has a status."""
    line = F.col("raw_line")
    parsed = lines.select(
        "filename",
        P.clock_timestamp(line, P.date_from_name(F.col("filename"))).alias("timestamp"),
        P.suite_from_name(F.col("filename")).alias("suite"),
        "raw_line",
        F.inline(P.result_rows(line)))
    return parsed.filter("status is not null")
