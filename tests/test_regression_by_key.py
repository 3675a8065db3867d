"""Quantile regression of many keys at once: exact lines, long keys by shared passes, covariates joined on time."""

import random
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from brinkline.operators.quantile_regression import fit_by_key, threshold_by_key, with_covariates


def loss(x, y, beta, q):
    r = y - beta[0] - x @ np.array(beta[1:])
    return float(np.maximum(q * r, (q - 1) * r).sum())


def series(spark, n=60, seed=1):
    rng = random.Random(seed)
    rows = [(k, i, i / 7 + (k or 0), rng.gauss(0, 1), 3.0 * (k or 1) + 0.2 * i + rng.gauss(0, 2 + i / 30)) for k in (None, 1, 2) for i in range(n)]
    return rows, spark.createDataFrame(rows, "k int, i int, a double, b double, y double").repartition(4)


@pytest.mark.parametrize("local", [10**6, 10])
def test_lines_are_the_best_ones(spark, local):
    rows, df = series(spark)
    for features in (["a"], ["a", "b"]):
        got = {r.k: r for r in fit_by_key(df, ["k"], features, "y", 0.77, local_rows=local, near=20).collect()}
        assert set(got) == {None, 1, 2}
        for k, r in got.items():
            mine = [q for q in rows if q[0] == k]
            x, y = np.array([q[2 : 2 + len(features)] for q in mine]), np.array([q[4] for q in mine])
            full = np.column_stack([np.ones(len(x)), x])
            best = min(loss(x, y, np.linalg.solve(full[list(c)], y[list(c)]), 0.77) for c in combinations(range(len(x)), full.shape[1]))
            assert r.exact and r.n == 60 and loss(x, y, r.coefficients, 0.77) == pytest.approx(best, rel=1e-9)


def test_long_keys_agree_with_short_ones(spark):
    rng = np.random.default_rng(3)
    rows = [(int(k), float(x), float(2 * x + k + (1 + x) * e)) for k, x, e in zip(rng.integers(0, 3, 6000), rng.random(6000), rng.normal(size=6000), strict=True)]
    df = spark.createDataFrame(rows, "k int, x double, y double").repartition(6)
    a = {r.k: r for r in fit_by_key(df, ["k"], ["x"], "y", 0.9).collect()}
    b = {r.k: r for r in fit_by_key(df, ["k"], ["x"], "y", 0.9, local_rows=100, near=200).collect()}
    for k in a:
        assert b[k].exact and b[k].coefficients == pytest.approx(a[k].coefficients, abs=1e-9) and a[k].n == b[k].n


def test_missing_values_flat_features_and_bad_levels(spark):
    rows = [(1, 1.0, 2.0), (1, 2.0, None), (1, None, 3.0), (1, 3.0, float("nan")), (1, 4.0, 8.0), (2, 5.0, 1.0), (3, None, 1.0), (4, 7.0, 1.0), (4, 7.0, 1.0), (4, 7.0, 9.0)]
    df = spark.createDataFrame([(*r, -1.0) for r in rows], "k int, x double, value double, threshold double")
    got = {r.k: r for r in fit_by_key(df, ["k"], ["x"], "value", 0.5).collect()}
    assert set(got) == {1, 2, 4} and got[1].coefficients == pytest.approx([0.0, 2.0]) and got[1].n == 2
    told = sorted(((r.k, r.x, r.threshold, r.exceeds) for r in threshold_by_key(df, ["k"], ["x"], 0.5).collect()), key=str)
    assert len(told) == 10 and [t for k, x, t, _ in told if k == 1 and x == 2.0] == [pytest.approx(4.0)] and [t for k, *_, t, _ in told if k == 3] == [None]
    assert [t for k, _, t, _ in told if k == 2] == [pytest.approx(1.0)] and [t for k, _, t, _ in told if k == 4] == [pytest.approx(1.0)] * 3
    assert fit_by_key(df.where("false"), ["k"], ["x"], "value", 0.5).collect() == []
    with pytest.raises(ValueError, match="quantile"):
        fit_by_key(df, ["k"], ["x"], "value", 1.0)


def test_covariates_meet_rows_by_time(spark):
    rows = spark.createDataFrame([(1, "a", 9.0), (2, "b", 9.0), (3, None, 9.0), (1, "a", 9.0)], "t int, k string, z double")
    side = spark.createDataFrame([(3, None, 30.0), (1, "a", 10.0), (7, "b", 70.0)], "t int, k string, z double")
    got = sorted(((r.t, r.k, r.z) for r in with_covariates(rows, side, ["t", "k"], ["z"]).collect()), key=str)
    assert got == [(1, "a", 10.0), (1, "a", 10.0), (2, "b", None), (3, None, 30.0)]
    with pytest.raises(ValueError, match="several"):
        with_covariates(rows, side.union(side), ["t", "k"], ["z"])
    shuffled = with_covariates(rows, side.orderBy(F.desc("t")), ["t", "k"], ["z"])
    assert sorted((tuple(r) for r in shuffled.collect()), key=str) == sorted((tuple(r) for r in with_covariates(rows, side, ["t", "k"], ["z"]).collect()), key=str)
