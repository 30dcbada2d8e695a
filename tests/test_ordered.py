"""Running columns: plain, chunked and brute force must agree."""

import random

import pytest
from pyspark.sql import functions as F

from failscope.operators.ordered import (
    first_in_frame, global_row_number, last_seen, next_seen, running, running_count, running_mean, running_sum,
)


@pytest.fixture(scope="module")
def rows():
    """400 rows, half of them in one key, one key null, values with gaps."""
    rng = random.Random(5)
    keys = ["hot"] * 6 + ["a", "b", "c", None, "d", "e"]
    return [(rng.choice(keys), i * 7919 % 400, rng.choice([None, 1.0, 2.5, 4.0]), i) for i in range(400)]


@pytest.fixture(scope="module")
def frame(spark, rows):
    return spark.createDataFrame(rows, "k string, o int, v double, id int").repartition(5)


NAMES = ("n", "before", "total", "past", "mean", "last", "earlier", "ahead")


def columns():
    v = F.col("v")
    return dict(zip(NAMES, (
        running_count(), running_count(inclusive=False), running_sum(v), running_mean(v, inclusive=False),
        running_mean(v), last_seen(v), last_seen(v, inclusive=False), next_seen(v))))


def expected(rows, keyed=True):
    out, groups = {}, {}
    for r in sorted(rows, key=lambda r: r[1]):
        groups.setdefault(r[0] if keyed else 0, []).append(r)
    for group in groups.values():
        for i, r in enumerate(group):
            seen = [x[2] for x in group[:i + 1] if x[2] is not None]
            prior = [x[2] for x in group[:i] if x[2] is not None]
            coming = [x[2] for x in group[i:] if x[2] is not None]
            out[r[3]] = (
                i + 1, i, sum(seen), sum(prior) / len(prior) if prior else None, sum(seen) / len(seen) if seen else None,
                seen[-1] if seen else None, prior[-1] if prior else None, coming[0] if coming else None)
    return out


def same(got, want):
    assert got.keys() == want.keys()
    for i in want:
        assert [x if x is None else pytest.approx(x) for x in want[i]] == list(got[i]), i


def found(df):
    return {r.id: tuple(r[c] for c in NAMES) for r in df.collect()}


@pytest.mark.parametrize("limit", [1_000, 60, 7])
def test_running_per_key(frame, rows, limit):
    same(found(running(frame, ["k"], [F.col("o")], limit, **columns())), expected(rows))


@pytest.mark.parametrize("limit", [1_000, 60, 7])
def test_running_global(frame, rows, limit):
    same(found(running(frame, [], [F.col("o")], limit, **columns())), expected(rows, keyed=False))


def test_descending_order_and_nulls_last(spark):
    df = spark.createDataFrame([(1, 3.0), (2, None), (3, 9.0), (4, 9.0)], "id int, s double")
    out = global_row_number(df, [F.col("s").isNull(), -F.col("s"), F.col("id")], "n", 2)
    assert {r.id: r.n for r in out.collect()} == {3: 1, 4: 2, 1: 3, 2: 4}


@pytest.mark.parametrize("limit", [1_000, 60, 9])
def test_first_in_frame(frame, rows, limit):
    got = {r.id: r.near for r in first_in_frame(frame, ["k"], [F.col("o")], 3, F.col("v"), "near", limit).collect()}
    groups, want = {}, {}
    for r in sorted(rows, key=lambda r: r[1]):
        groups.setdefault(r[0], []).append(r)
    for group in groups.values():
        for i, r in enumerate(group):
            near = [x[2] for x in group[max(0, i - 3):i + 4] if x[2] is not None]
            want[r[3]] = near[0] if near else None
    assert got == want


def test_carried_totals_are_at_most_two_rows_per_chunk(spark):
    df = spark.range(1000).select((F.col("id") % 50).alias("k"), F.col("id").alias("o"))
    out = running(df, ["k"], [F.col("o")], 10, n=running_count())
    assert out.filter("n <> cast(o / 50 as int) + 1").count() == 0
    assert out.count() == 1000
