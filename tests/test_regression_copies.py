"""Quantile regression on rows that occur many times, which change no line."""

import random

import pytest

from brinkline.operators.quantile_regression import QuantileRegressor, fit_by_key


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(11)
    return [(float(x), round(3 * x + rng.expovariate(0.2), 2)) for x in (rng.randint(0, 400) / 7 for _ in range(3_000))]


def test_copies_leave_the_line(spark, rows):
    one = spark.createDataFrame(rows, "x double, y double")
    many = spark.range(20).crossJoin(one).drop("id")
    a, b = (QuantileRegressor(0.95, near=200).fit(df, ["x"], "y") for df in (one, many))
    assert a.exact and b.exact
    assert (b.coef[0], b.intercept) == (pytest.approx(a.coef[0], abs=1e-6), pytest.approx(a.intercept, abs=1e-5))
    for model, times in ((a, 1), (b, 20)):
        r = [y - model.intercept - model.coef[0] * x for x, y in rows for _ in range(times)]
        assert sum(v > 1e-7 for v in r) <= 0.05 * len(r) <= sum(v > -1e-7 for v in r)


def test_a_far_least_is_not_called_exact_before_it_is_reached(spark, rows):
    """Few passes and few near rows leave the least far outside of the rows that are solved first."""
    model = QuantileRegressor(0.95, passes=2, near=20).fit(spark.createDataFrame(rows, "x double, y double"), ["x"], "y")
    r = [y - model.intercept - model.coef[0] * x for x, y in rows]
    assert not model.exact or sum(v > 1e-7 for v in r) <= 0.05 * len(r) <= sum(v > -1e-7 for v in r)


def test_copies_leave_the_lines_of_keys(spark, rows):
    one = spark.createDataFrame([(i % 7, *r) for i, r in enumerate(rows)], "k int, x double, y double")
    a, b = ({r.k: r.coefficients for r in fit_by_key(df, ["k"], ["x"], "y", 0.87).collect()} for df in (one, spark.range(30).crossJoin(one).drop("id")))
    for k in a:
        assert b[k] == pytest.approx(a[k], abs=1e-5)
