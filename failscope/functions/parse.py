"""Column functions that turn one log line (or file name) into typed values.

Every function is a stateless expression, so it works the same on a batch and
on a streaming frame.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from failscope import constants as K


def group_or_null(text: Column, pattern: str, group: int = 1) -> Column:
    """First match of ``pattern``; null where Spark gives the empty string."""
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def simple_line(line: Column) -> dict[str, Column]:
    """``timestamp - testcase - status`` at the start of a line; otherwise ``raw`` holds the line."""
    hit = line.rlike(K.SIMPLE_LINE)
    return {
        "timestamp": group_or_null(line, K.SIMPLE_LINE, 1),
        "testcase": group_or_null(line, K.SIMPLE_LINE, 2),
        "status": group_or_null(line, K.SIMPLE_LINE, 3),
        "raw": F.when(~hit, line),
    }


def _has(text: Column, *words: str) -> Column:
    return reduce(lambda a, b: a | b, [text.contains(w) for w in words])


def keyword_status(line: Column) -> Column:
    """PASS / FAIL / ABORT by the words in the line; the order of the rules is the semantics."""
    low = F.lower(line)
    return (
        F.when(_has(low, "pass") & ~_has(low, "fail"), "PASS")
        .when(_has(low, "fail", "error"), "FAIL")
        .when(_has(low, "abort", "stopped"), "ABORT")
        .when(_has(low, "exception occurred"), "FAIL")
        .when(_has(low, "timeout", "interrupted", "terminated"), "ABORT")
        .when(_has(low, "successfully completed"), "PASS")
    )


def line_fields(line: Column) -> dict[str, Column]:
    """First time stamp, test case, DUT version and configuration in a line."""
    return {
        "timestamp": group_or_null(line, K.LINE_TIMESTAMP, 0),
        "test_case_id": group_or_null(line, K.LINE_TEST_CASE),
        "dut_version": group_or_null(line, K.LINE_DUT_VERSION),
        "config": group_or_null(line, K.LINE_CONFIG),
    }


def protocol_from_name(filename: Column) -> Column:
    low = F.lower(filename)
    out = F.lit(None).cast("string")
    for token, protocol in reversed(K.PROTOCOLS):
        out = F.when(low.contains(token), protocol).otherwise(out)
    return out


def error_text(status: Column, line: Column) -> Column:
    return F.when(status.isin("FAIL", "ABORT"), line)


def suite_from_name(filename: Column) -> Column:
    """First listed suite that occurs in the file name."""
    low = F.lower(filename)
    out = F.lit(None).cast("string")
    for suite in reversed(K.SUITES):
        out = F.when(low.contains(suite), suite).otherwise(out)
    return out


def date_from_name(filename: Column) -> Column:
    """First run of eight digits as a date; null when it is none."""
    return F.try_to_date(group_or_null(filename, K.NAME_DATE), "yyyyMMdd")


def dut_from_name(filename: Column) -> Column:
    return F.coalesce(group_or_null(filename, K.NAME_DUT), F.lit(K.DEFAULT_DUT))


def test_case_from_name(filename: Column) -> Column:
    return F.coalesce(group_or_null(filename, K.NAME_TEST_CASE), F.lit(K.DEFAULT_TEST_CASE))


def version_from_name(filename: Column) -> Column:
    return F.upper(group_or_null(filename, K.NAME_VERSION_TAG))


def version_from_line(line: Column) -> Column:
    return F.trim(group_or_null(line, K.LINE_VERSION))


def clock_timestamp(line: Column, file_date: Column) -> Column:
    """File date + leading ``HH:MM:SS.f`` (one to six decimals); null when either is missing or invalid."""
    clock = group_or_null(line, K.CLOCK)
    decimals = F.length(F.substring_index(clock, ".", -1))
    text = F.concat(F.date_format(file_date, "yyyy-MM-dd"), F.lit(" "), clock)
    return F.when(decimals <= 6, text.try_cast("timestamp"))


def clock_run_date(line: Column, file_date: Column) -> Column:
    """The file date on lines that start with a clock, valid or not."""
    return F.when(line.rlike(K.CLOCK), file_date)


def result_rows(line: Column) -> Column:
    """Array with one (status, error_msg) struct, to be used with ``inline``.

    The first of three patterns that matches decides.  Of its groups that
    captured something, the last one that is a status word gives the status,
    and with more than one group the last is the reason.

    Each pattern runs once: it replaces the line by its groups, separated by a
    line break, which no line contains.  ``inline`` keeps later filters from
    running the patterns a second time.
    """
    def captured(patterns: list[tuple[str, int]]) -> Column:
        (pattern, n), rest = patterns[0], patterns[1:]
        groups = F.regexp_replace(line, rf"(?iUs)^.*?{pattern}\z", "\n".join(f"${i}" for i in range(1, n + 1)))
        return _let(groups, lambda g: F.when(g.contains("\n"), F.filter(F.split(g, "\n"), lambda x: x != ""))
                    .otherwise(captured(rest) if rest else F.lit(None).cast("array<string>")))

    def fields(groups: Column) -> Column:
        word = F.upper(F.try_element_at(F.filter(groups, lambda g: F.upper(g).isin(K.STATUS_WORDS)), F.lit(-1)))
        return F.struct(
            F.when(word.endswith("ED"), F.left(word, F.length(word) - 2)).otherwise(word).alias("status"),
            F.when(F.size(groups) > 1, F.trim(F.try_element_at(groups, F.lit(-1)))).alias("error_msg"))

    # Most lines have none of the words; skip the patterns for them.
    groups = F.when(line.rlike("(?iu)pass|fail|abort"), captured(K.RESULT_PATTERNS))
    return F.transform(F.array(groups), fields)


def _let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def result_fields(line: Column) -> dict[str, Column]:
    """Status and reason of a line, see :func:`result_rows`."""
    row = F.get(result_rows(line), F.lit(0))
    return {"status": row["status"], "error_msg": row["error_msg"]}


def error_category(message: Column) -> Column:
    low = F.lower(message)
    return (
        F.when(message.isNull(), "Unknown Error")
        .when(low.contains("license"), "License Error")
        .when(low.contains("dtmf rtp packets are not received"), "DTMF RTP Packet Loss")
        .when(low.contains("no such file or directory"), "Missing File")
        .when(low.contains("execution terminated"), "Execution Terminated")
        .when(low.contains("sipp") & low.contains("error"), "SIPP Error")
        .otherwise(F.left(message, F.lit(100)))
    )


def message_snippet(message: Column, dots: bool = True) -> Column:
    short = F.left(message, F.lit(150))
    return F.concat(short, F.lit("...")) if dots else short


def keyword_flag(message: Column) -> Column:
    return F.coalesce(message, F.lit("")).rlike(K.SNIPPET_KEYWORDS).cast("int")


def tokens(message: Column, stop_words: list[str] | None = None, strip: bool = True) -> Column:
    """Lower-case words of more than two letters, without stop words, in text order."""
    words = F.split(F.lower(message), r"(?U)\s+")
    if strip:
        words = F.transform(words, lambda w: F.btrim(w, F.lit(".,:;#")))
    stop = stop_words if stop_words is not None else K.KEYWORD_STOP_WORDS
    return F.filter(words, lambda w: (F.length(w) > 2) & ~w.isin(stop))


def archive_date(base: Column) -> Column:
    """First eight-digit ``_`` token as ``yyyy-MM-dd``, else ``unknown_date``."""
    token = F.get(F.filter(F.split(base, "_"), lambda t: t.rlike("^[0-9]{8}$")), F.lit(0))
    return F.coalesce(F.date_format(F.try_to_date(token, "yyyyMMdd"), "yyyy-MM-dd"), F.lit("unknown_date"))


def archive_suite(base: Column) -> Column:
    """Third ``_`` token, else ``unknown_suite``."""
    return F.coalesce(F.get(F.split(base, "_"), F.lit(2)), F.lit("unknown_suite"))


def file_stem(filename: Column) -> Column:
    """File name without its last extension; a leading dot is part of the name."""
    return F.regexp_replace(filename, r"(?<=[^.])\.[^.]*$", "")
