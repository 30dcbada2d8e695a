"""Log files as rows: one row per line, with its 1-based number in the file.

Files are read with the splittable text source, so one file of any size is read
by many tasks.  A task numbers the lines of its block; the block's first number
is the sum of the line counts of the earlier blocks of the file.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from failscope.functions.parse import file_stem
from failscope.storage import materialize, sized, spread_small

LINE_BREAK = r"\r\n|\r|\n"
BAD_CHARACTER = "�"


def clean_bytes(text: Column) -> Column:
    """Drop the replacement characters that stand for undecodable bytes."""
    return F.regexp_replace(text, BAD_CHARACTER, "")


def trim_line(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def scan_lines(spark: SparkSession, root: str, suffixes: Sequence[str] = ("log", "txt")) -> DataFrame:
    """(path, filename, line_number, raw_line) of every line below ``root``."""
    pattern = "*.{%s}" % ",".join(suffixes)
    text = spark.read.text(root, recursiveFileLookup=True, pathGlobFilter=pattern).select(
        F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("seq"),
        clean_bytes(F.col("value")).alias("value"),
    )
    # The sequence is only meaningful within one reading of the files.
    text = materialize(text, "lines")
    blocks = text.groupBy("path", "block").agg(F.min("seq").alias("first_seq"), F.count(F.lit(1)).alias("lines"))
    earlier = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("before", F.coalesce(F.sum("lines").over(earlier), F.lit(0))).drop("lines")
    path = relative_path(spark, F.col("path"), root)
    return text.join(sized(blocks), ["path", "block"]).select(
        path.alias("path"),
        F.element_at(F.split(path, "/"), -1).alias("filename"),
        (F.col("seq") - F.col("first_seq") + F.col("before") + 1).alias("line_number"),
        trim_line(F.col("value")).alias("raw_line"),
    )


def relative_path(spark: SparkSession, path: Column, root: str) -> Column:
    """Path below ``root``, URL escapes resolved."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(root)
    system = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    prefix = system.makeQualified(folder).toUri().getPath().rstrip("/") + "/"
    decoded = F.url_decode(F.regexp_replace(path, r"\+", "%2B"))
    return F.substring(decoded, F.instr(decoded, prefix) + len(prefix), F.length(decoded))


def explode_lines(df: DataFrame, text: str, keep_blank: bool = True) -> DataFrame:
    """One row per line of a text column: ``line_number`` from 1 and ``raw_line``."""
    parts = F.split(F.col(text), LINE_BREAK)
    # A final line break ends the last line; it does not start an empty one.
    parts = F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)
    others = [c for c in df.columns if c != text]
    out = spread_small(df).select(*others, F.posexplode(parts).alias("__pos", "__line")).select(
        *others, (F.col("__pos") + 1).alias("line_number"), trim_line(F.col("__line")).alias("raw_line"))
    return out if keep_blank else out.filter("raw_line <> ''")


def path_columns(df: DataFrame, path: str = "path", fallback_to_stem: bool = True) -> DataFrame:
    """``run_date``, ``dut``, ``suite``, ``filename`` from ``run_date/dut/suite/file``.

    With ``fallback_to_stem``: ``unknown_date`` becomes null, and a generic or
    missing DUT (or a missing suite) becomes the file stem.  Without it the
    missing parts become ``generic_dut`` and ``unknown_suite``.
    """
    parts = F.split(F.col(path), "/")
    filename = F.element_at(parts, -1)
    stem = file_stem(filename)
    run_date, dut, suite = (F.get(parts, F.lit(i)) for i in range(3))
    if fallback_to_stem:
        run_date = F.when(~F.lower(run_date).isin("", "unknown_date"), run_date)
        dut = F.when(F.coalesce(F.lower(dut), F.lit("")).isin("", "generic_dut", "unknown_dut"), stem).otherwise(dut)
        suite = F.coalesce(suite, stem)
    else:
        dut, suite = F.coalesce(dut, F.lit("generic_dut")), F.coalesce(suite, F.lit("unknown_suite"))
    return df.withColumns({"run_date": run_date, "dut": dut, "suite": suite, "filename": filename})
