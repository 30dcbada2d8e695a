"""Sources and sinks: rows of the given tables, written below the run's folder and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from failscope.operators import vectors as X
from failscope.sources import columns as C
from failscope.sources import tables as T
from failscope.sources.archive import member_keys, scan_archives, write_archives, write_partitioned
from failscope.sources.logs import scan_lines
from failscope.storage import run_dir
from registry.base import ev_sql, logs_ev, query, r, table


def _place(spark, name: str) -> str:
    return f"{run_dir(spark)}/{name}-{uuid.uuid4().hex}"


@query("a01_archive_scan", ev_sql("""
SELECT suite || '.tar.gz' AS archive, filename AS member, filename, row_number() OVER (PARTITION BY suite, filename ORDER BY event_id) AS line_number,
 trim(raw_line) AS raw_line FROM ev"""))
def _(spark, sf):
    """One archive for each suite, written by the tasks and scanned line by line."""
    path = _place(spark, "archives")
    write_archives(logs_ev(spark, sf).select("event_id", "suite", "filename", "raw_line"), path, "suite", "filename", ["event_id"], "raw_line")
    return scan_archives(spark, path).withColumn("archive", F.element_at(F.split("archive", "/"), -1))


@query("a03_partitioned_layout", ev_sql("""
SELECT strftime("timestamp", '%Y-%m-%d') AS run_date, suite, count(*) AS lines, sum(event_id)::BIGINT AS ids FROM ev GROUP BY 1, 2"""))
def _(spark, sf):
    path = _place(spark, "layout")
    write_partitioned(member_keys(logs_ev(spark, sf).select("event_id", "filename", "line_number", "raw_line")), path)
    # The folders' names are the columns; each folder is one date and suite.
    back = spark.read.option("basePath", path).parquet(path)
    return back.groupBy(F.date_format("run_date", "yyyy-MM-dd").alias("run_date"), "suite").agg(
        F.count("*").alias("lines"), F.sum("event_id").alias("ids"))


@query("a04_log_scan", ev_sql("""
SELECT 'c=' || test_case_id AS folder, row_number() OVER (PARTITION BY test_case_id ORDER BY event_id) AS line_number, raw_line FROM ev"""))
def _(spark, sf):
    path = _place(spark, "logs")
    rows = logs_ev(spark, sf).select("event_id", F.col("test_case_id").alias("c"), "raw_line")
    rows.repartition("c").sortWithinPartitions("c", "event_id").select("c", "raw_line").write.partitionBy("c").text(path)
    lines = scan_lines(spark, path, ["txt"])
    return lines.select(F.element_at(F.split("path", "/"), 1).alias("folder"), F.col("line_number").cast("bigint").alias("line_number"), "raw_line")


_CSV = ev_sql("""SELECT event_id, coalesce(error_msg, '') || ', "' || suite || '"' AS note, round(value, 6) AS value, fail_flag FROM ev""")


def _notes(spark, sf):
    return logs_ev(spark, sf).select(
        "event_id", F.concat(F.coalesce("error_msg", F.lit("")), F.lit(', "'), "suite", F.lit('"')).alias("note"), r("value").alias("value"), "fail_flag")


@query("a07_csv_inferred", _CSV)
def _(spark, sf):
    path = _place(spark, "rows") + ".csv"
    T.write_csv(_notes(spark, sf), path)
    return T.read_csv(spark, path)


@query("a07_csv_quoted_breaks", ev_sql("""SELECT event_id, coalesce(error_msg, '') || chr(13) || chr(10) || '"' || suite || '",' || chr(10) || chr(10) || event_id AS note,
 round(value, 6) AS value, fail_flag FROM ev"""))
def _(spark, sf):
    """Line breaks and quotes inside quoted fields; every split of the files is read by a task of its own."""
    path = _place(spark, "quoted") + ".csv"
    note = F.concat(F.coalesce("error_msg", F.lit("")), F.lit('\r\n"'), "suite", F.lit('",\n\n'), "event_id")
    T.write_csv(logs_ev(spark, sf).select("event_id", note.alias("note"), r("value").alias("value"), "fail_flag"), path)
    return T.read_csv(spark, path, line_breaks_in_quotes=True)


@query("a08_csv_overwritten", _CSV)
def _(spark, sf):
    """Written twice; only the second writing counts."""
    path = _place(spark, "rows") + ".csv"
    T.write_csv(_notes(spark, sf).limit(1), path)
    T.write_csv(_notes(spark, sf), path)
    return T.read_table(spark, path, "event_id bigint, note string, value double, fail_flag int")


@query("a09_first_existing", ev_sql("SELECT event_id, suite, TRUE AS other_is_absent FROM ev"))
def _(spark, sf):
    path, absent = _place(spark, "second"), _place(spark, "first")
    T.write_table(logs_ev(spark, sf).select("event_id", "suite"), path)
    found = T.read_table(spark, T.first_existing(spark, [absent, path]))
    return found.withColumn("other_is_absent", F.lit(T.read_optional(spark, absent) is None))


@query("a10_saved_scaling", """
SELECT event_id, round((value - (SELECT avg(value) FROM events)) / (SELECT stddev_pop(value) FROM events), 6) AS value_scaled FROM events""")
def _(spark, sf):
    path, rows = _place(spark, "scaling"), table(spark, sf, "events").select("event_id", "value")
    X.save_scaling(spark, X.scaling(rows, ["value"]), path)
    return X.scale(rows, ["value"], fitted=X.load_scaling(spark, path)).select("event_id", r("value_scaled").alias("value_scaled"))


@query("a10_saved_model", ev_sql("SELECT event_id, TRUE AS same FROM ev"))
def _(spark, sf):
    """The vectors of a saved and loaded model are those of the fitted one."""
    path, rows = _place(spark, "words"), logs_ev(spark, sf).select("event_id", "error_msg")
    model = X.tfidf_model(rows, "error_msg", bigrams=False)
    X.save_model(model, path)
    both = X.tfidf(X.tfidf(rows, model, "error_msg").withColumnRenamed("tfidf", "a"), X.load_model(path), "error_msg")
    return both.select("event_id", (F.unwrap_udt("a") == F.unwrap_udt("tfidf")).alias("same"))


@query("a13_resolved_column", "SELECT event_id, event_type AS kind FROM events")
def _(spark, sf):
    rows = table(spark, sf, "events")
    return rows.select("event_id", F.col(C.resolve(rows, ["Kind", "EVENT_TYPE", "value"], ignore_case=True)).alias("kind"))


@query("a15_required_columns", "SELECT event_id, TRUE AS missing_refused, TRUE AS empty_refused FROM events")
def _(spark, sf):
    def refused(df, names) -> bool:
        try:
            C.require(df, names, rows=True)
        except ValueError:
            return True
        return False

    rows = C.require(table(spark, sf, "events"), ["event_id"], rows=True)
    return rows.select("event_id", F.lit(refused(rows, ["absent"])).alias("missing_refused"),
                       F.lit(refused(rows.filter("event_id IS NULL"), ["event_id"])).alias("empty_refused"))
