import random

import numpy as np
import pytest

from failscope.operators.quantiles import exact_quantiles

PROBS = [0.0, 0.05, 0.6, 0.9, 0.999, 1.0]


def check(spark, values, small):
    df = spark.createDataFrame([(v,) for v in values], "x double").repartition(4)
    clean = [v for v in values if v is not None and v == v]
    got = exact_quantiles(df, "x", PROBS, small)
    assert got == pytest.approx(list(np.quantile(clean, PROBS)), rel=1e-12, abs=1e-12)


@pytest.mark.parametrize("small", [None, 50])
def test_spread_values(spark, small):
    rng = random.Random(1)
    check(spark, [rng.lognormvariate(0, 8) for _ in range(3000)] + [None, float("nan")], small)


@pytest.mark.parametrize("small", [None, 20])
def test_one_value_holds_a_third(spark, small):
    rng = random.Random(2)
    check(spark, [7.0] * 1000 + [rng.random() * 20 for _ in range(2000)], small)


def test_edges_of_a_long_run_of_equal_values(spark):
    """The wanted rank lies just below a value that holds a third of the rows."""
    values = [float(i) for i in range(3000)] + [3000.0] * 3000 + [4000.0 + i for i in range(3000)]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    for rank in (2990, 2999, 3000, 5999, 6000, 6005):
        assert exact_quantiles(df, "x", [rank / 8999], 3) == pytest.approx([values[rank]], abs=1e-6)


def test_small_example_and_empty(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (4.0,)], "x double")
    assert exact_quantiles(df, "x", [0.9, 0.05]) == pytest.approx([3.7, 1.15])
    assert exact_quantiles(df.filter("x > 9"), "x", [0.5]) == [None]
