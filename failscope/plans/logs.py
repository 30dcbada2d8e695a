"""Raw log lines to typed, repaired rows.

Input of all plans: ``path``, ``filename``, ``line_number``, ``raw_line`` (see
``sources.logs`` and ``sources.archive``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from failscope import constants as K
from failscope.functions import parse as P
from failscope.operators.dedupe import distinct_rows
from failscope.operators.ordered import last_seen, running
from failscope.operators.repair import (
    date_backstop, fill_both_ways, pass_and_fail_messages, reason_from_context, suite_backstop,
    with_status_or_message,
)
from failscope.sources.columns import file_key, row_order
from failscope.sources.logs import path_columns
from failscope.storage import materialize, sized

def standardise(lines: DataFrame) -> DataFrame:
    """``timestamp - testcase - status`` lines; other lines are kept as ``raw``."""
    rows = path_columns(lines.filter("raw_line <> ''"), fallback_to_stem=False)
    return rows.select(
        *[c.alias(n) for n, c in P.simple_line(F.col("raw_line")).items()], "run_date", "dut", "suite", "filename")


def carry_run_date(df: DataFrame, key: str = "path", timestamp: str = "timestamp", start: str = "run_date",
                   max_group_rows: int | None = None) -> DataFrame:
    """Date of the latest time stamp seen so far in the file, else the date it started with."""
    seen = F.to_date(F.col(timestamp).try_cast("timestamp"))
    out = running(df, [key], [F.col("line_number")], max_group_rows, __seen=last_seen(seen))
    return out.withColumn(start, F.coalesce(F.date_format("__seen", "yyyy-MM-dd"), F.col(start))).drop("__seen")


def convert(lines: DataFrame, max_group_rows: int | None = None) -> DataFrame:
    """Status by keywords, first time stamp / test case / version / configuration per line."""
    rows = path_columns(lines.filter("raw_line <> ''"))
    line = F.col("raw_line")
    fields = P.line_fields(line)
    parsed = rows.withColumns({
        **fields,
        "config": F.coalesce(fields["config"], P.protocol_from_name(F.col("filename"))),
        "status": P.keyword_status(line),
    }).withColumn("error_msg", P.error_text(F.col("status"), line))
    dated = carry_run_date(parsed, max_group_rows=max_group_rows)
    return distinct_rows(dated.select(
        "run_date", "dut", "suite", "filename", "line_number", "timestamp", "test_case_id", "status", "error_msg",
        "dut_version", "config", "raw_line"))


def header_fields(lines: DataFrame) -> DataFrame:
    """Header values per file: the last match of each key up to the line at which all keys are known.

    Both steps are aggregates with map-side partial results, so a file of any
    size is spread over many tasks.
    """
    key, names = [c for c in ("path", "filename") if c in lines.columns], list(K.HEADER_PATTERNS)
    line, number = F.col("raw_line"), F.col("line_number")
    # Few lines name a key at all; only those are worth the patterns, and the sort that text minima need.
    # They are written once, for the three aggregates below.
    hits = materialize(lines.filter(line.rlike(K.HEADER_HINT)).select(
        *key, "line_number", *[F.trim(P.group_or_null(line, p)).alias(n) for n, p in K.HEADER_PATTERNS.items()],
        P.version_from_line(line).alias("version_line")), "header-lines")
    known = hits.groupBy(*key).agg(
        *[F.min(F.when(F.col(n).isNotNull(), number)).alias(f"__{n}") for n in names],
        F.min_by("version_line", F.when(F.col("version_line").isNotNull(), number)).alias("version_line"))
    firsts = [F.col(f"__{n}") for n in names]
    all_known = sum((c.isNull().cast("int") for c in firsts), F.lit(0)) == 0
    cutoff = known.select(*key, "version_line",
                          F.when(all_known, F.greatest(*firsts)).otherwise(F.lit(2**62)).alias("__cutoff"))
    before = hits.drop("version_line").join(cutoff.select(*key, "__cutoff"), key).filter(number <= F.col("__cutoff"))
    last = before.groupBy(*key).agg(*[
        F.max_by(n, F.when(F.col(n).isNotNull(), number)).alias(n) for n in names])
    files = lines.select(*key).distinct()
    return files.join(sized(cutoff.select(*key, "version_line").join(last, key)), key, "left")


def with_fallbacks(headers: DataFrame) -> DataFrame:
    """Header values with the fallbacks from the file name, the first version line, and constants."""
    name = F.col("filename")
    version = F.when(~F.lower("dut_version").startswith("unknown"), F.col("dut_version"))
    return headers.select(
        *[c for c in ("path", "filename") if c in headers.columns],
        F.coalesce("dut_name", P.dut_from_name(name)).alias("dut"),
        F.coalesce(version, P.version_from_name(name), "version_line", F.lit(K.DEFAULT_DUT_VERSION)).alias("dut_version"),
        F.coalesce("os_version", F.lit(K.DEFAULT_OS)).alias("os_version"),
        F.coalesce("config", F.lit(K.DEFAULT_CONFIG)).alias("config"),
        F.coalesce("test_case", P.test_case_from_name(name)).alias("test_case_id"),
    )


def parse_results(lines: DataFrame) -> DataFrame:
    """Clock, status, reason and suite of every line."""
    line, date = F.col("raw_line"), P.date_from_name(F.col("filename"))
    return lines.select(
        *[c for c in ("path", "filename") if c in lines.columns], "line_number",
        P.clock_timestamp(line, date).alias("timestamp"),
        P.clock_run_date(line, date).alias("run_date"),
        P.suite_from_name(F.col("filename")).alias("suite"),
        "raw_line",
        F.inline(P.result_rows(line)),
    )


def repair(rows: DataFrame, max_group_rows: int | None = None) -> DataFrame:
    """Fill time stamps, dates and suites; set messages; drop undated rows."""
    file = file_key(rows)
    order = [F.col(c) for c in row_order(rows)]
    out = fill_both_ways(rows, [file], [F.col("line_number")], ["timestamp", "run_date"], max_group_rows)
    out = out.withColumn("run_date", F.coalesce("run_date", P.date_from_name(F.col("filename"))))
    out = fill_both_ways(suite_backstop(out), ["dut", "test_case_id"], order, ["suite"], max_group_rows)
    out = reason_from_context(pass_and_fail_messages(out), max_group_rows=max_group_rows)
    return date_backstop(out)


def preprocess(lines: DataFrame, max_group_rows: int | None = None) -> DataFrame:
    """The main table: header values, parsed results, repaired.

    The parsed rows are written once, as the repair steps look at them several
    times and the patterns are the expensive part.
    """
    parsed = with_status_or_message(parse_results(lines))
    headers = with_fallbacks(header_fields(lines))
    joined = parsed.join(sized(headers), [c for c in ("path", "filename") if c in lines.columns], "left")
    rows = materialize(joined, "parsed")
    return repair(rows, max_group_rows).select(
        "filename", "dut", "dut_version", "os_version", "config", "test_case_id", "line_number", "timestamp",
        "run_date", "status", "error_msg", "suite", "raw_line", *[c for c in ("path",) if c in rows.columns])
