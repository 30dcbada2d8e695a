"""Every registered query against its SQL, and under other partition counts."""

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from check_queries import compare, connect, rows_of

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


# The corpus operators without SQL have tests of their own.
CHECKED = sorted(n for n in queries() if n in oracle_sql() or not n.startswith(("op", "pipeline")))


@pytest.mark.parametrize("name", CHECKED)
def test_query_matches_sql(spark, con, name):
    result, n = compare(spark, con, SF, queries()[name], oracle_sql().get(name))
    # At this size no day may stand out.
    empty_allowed = name == "e12_failure_spikes"
    assert result in ("ok", "rows only") or (empty_allowed and result == "ok EMPTY")


@pytest.mark.parametrize("name", ["c09_context_repair", "f04_past_failure_frequency", "h19_roc_points", "h11_stratified_split",
                                  "e18_tfidf_keywords", "h21_top_k_capture"])
def test_result_does_not_depend_on_partitions(spark, name):
    before, results = spark.conf.get("spark.sql.shuffle.partitions"), []
    try:
        for n in ("1", "4", "16"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            df = queries()[name](spark, SF)
            results.append(rows_of(df.columns, df.collect()))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert results[0] == results[1] == results[2]


def test_entry_has_rows(spark):
    assert entry(spark).count() > 0


def test_every_sql_has_a_query():
    assert set(oracle_sql()) <= set(queries())


@pytest.mark.parametrize("name", [
    "b05_run_date_carry", "c06_fill_both_ways", "c07_suite_fill", "c09_context_repair", "f03_schedule_cycle",
    "f04_past_failure_frequency", "f05_time_since_last_failure", "f06_past_failure_rate", "f10_anomaly_history",
    "f01_failure_rates", "f11_row_number", "h14_label_encoding", "h19_roc_auc", "h21_top_k_capture", "h24_prioritised",
    "h26_unified_training_table", "h26_test_case_features"])
def test_query_with_every_group_taken_for_hot(spark, con, monkeypatch, name):
    """The ways for large groups and large inputs give the same results."""
    from failscope import storage
    from failscope.operators import ordered, quantiles

    monkeypatch.setattr(ordered, "MAX_GROUP_ROWS", 40)
    monkeypatch.setattr(storage, "SMALL_INPUT", 0)
    monkeypatch.setattr(quantiles, "SMALL", 20)
    result, _ = compare(spark, con, SF, queries()[name], oracle_sql()[name])
    assert result == "ok"
