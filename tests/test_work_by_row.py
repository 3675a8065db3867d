"""Folds inside rows: what a step names is computed before the fold, not at every step."""

import math

import pytest
from pyspark.sql import functions as F

from brinkline.functions import distributions
from brinkline.operators import quadrature as Q


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString().lower()


def test_shortfall_computes_its_level_once(spark):
    q = F.col("id") / 50.0
    m = distributions.Frechet(2.0, 1.5, 0.3)
    df = spark.range(1, 50).select("id", m.expected_shortfall(q).alias("v"))
    assert plan(df).count("power(") <= 5
    for r in df.where("id in (5, 25, 45)").collect():
        alpha, n = r.id / 50, 200_000  # substitution u = 1 - (1 - alpha) s^4 flattens the tail
        s = [(i + 0.5) / n for i in range(n)]
        want = sum(4 * v**3 * (2 + 5 * ((-math.log1p(-(1 - alpha) * v**4)) ** -0.3 - 1)) for v in s) / n
        assert r.v == pytest.approx(want, rel=1e-5)


def test_halton_points_of_rows_are_constants(spark):
    f = lambda x, y, z: F.exp(-x - 0.5 * y) * F.cos(z)
    lo, hi, n = [0.0, 0.5, -1.0], [F.col("id") + 1.0, F.lit(2.0), F.lit(1.0)], 300
    df = spark.range(3).select("id", Q.box_integral(f, lo, hi, n).alias("v"))
    assert "floor(" not in plan(df)
    for r in df.collect():
        assert r.v == pytest.approx(Q.integral_over(spark, lambda x, y, z: f(x, y, z), lo, [r.id + 1.0, 2.0, 1.0], n), rel=1e-12)
