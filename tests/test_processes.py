import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from brinkline.functions import distributions
from brinkline.operators import blocks, decluster, processes, quantile_regression, spatial
from brinkline.sources import simulate


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def test_expected_count_of_known_renewals(spark):
    assert processes.Renewal(processes.ExponentialGap(0.5)).expected_count(spark, 20.0) == pytest.approx(10.0, rel=1e-2)
    rng = np.random.default_rng(1)
    gaps = 3 * rng.weibull(1.7, (40_000, 30))
    want = (gaps.cumsum(1) < 12).sum(1).mean()
    assert processes.Renewal(processes.WeibullGap(1.7, 3.0)).expected_count(spark, 12.0) == pytest.approx(want, rel=2e-2)


def test_hawkes_with_ties_gaps_and_empty_sequences(spark):
    rng = random.Random(4)
    times = {1: sorted([rng.random() * 300 for _ in range(80)] + [7.0, 7.0, 7.0]), 2: [0.0, 250.0, 250.0], 4: [1e4]}
    events = spark.createDataFrame([(k, t) for k, v in times.items() for t in v], "k long, t double")
    asked = spark.createDataFrame([(k, t) for k in (1, 2, 3, 4) for t in (0.0, 7.0, 7.5, 120.0, 300.0, 10_001.0)], "k long, t double")
    mu, alpha, beta = 0.3, 0.4, 0.7
    model = processes.ExponentialHawkes(mu, alpha, beta)
    for r in model.cumulative_intensity(events, model.intensity(events, asked, ["k"]), ["k"]).collect():
        past = [s for s in times.get(r.k, []) if s < r.t]
        assert r.rate == pytest.approx(mu + alpha * sum(math.exp(-beta * (r.t - s)) for s in past), abs=1e-9)
        assert r.compensator == pytest.approx(mu * r.t + alpha / beta * sum(1 - math.exp(-beta * (r.t - s)) for s in past), abs=1e-8)
    windows = spark.createDataFrame([(k, 260.0) for k in (1, 2, 3)], "k long, t1 double")
    general = processes.GeneralHawkes(mu, lambda d: alpha * F.exp(-beta * d), lambda d: alpha / beta * (1 - F.exp(-beta * d)), 60.0)
    a, b = ({r.k: (r.n, r.log_lik) for r in m.log_prob(events, windows, ["k"]).collect()} for m in (model, general))
    assert a[3] == (0, pytest.approx(-mu * 260)) and a[2][0] == 3
    for k in a:
        assert a[k] == pytest.approx(b[k], abs=1e-6)


def test_thinning_follows_the_retention_and_not_the_partitions(spark):
    rows = spark.range(40_000).withColumn("t", F.col("id") / 40_000)
    kept = [sorted(r.id for r in simulate.thinned(rows.repartition(n), F.col("t"), ["id"], 3).collect()) for n in (1, 9)]
    assert kept[0] == kept[1] and abs(len(kept[0]) - 20_000) < 400
    with pytest.raises(TypeError):
        distributions.uniform_of("id", seed=1.5)


def test_draws_by_key_have_the_distribution(spark):
    m = distributions.Weibull(1.0, 2.0, -0.4)
    rows = spark.range(20_000).select(m.cdf(m.sample_by("id", seed=5)).alias("u")).toPandas().u.sort_values().to_numpy()
    assert np.abs(rows - (np.arange(20_000) + 0.5) / 20_000).max() < 0.015


def test_mean_excess_agrees_with_quadrature(spark):
    for xi in (-1.3, -0.4, 0.0, 0.3, 0.8):
        m = distributions.GeneralizedExtremeValue(1.0, 2.0, xi)
        for u in (-6.0, -1.0, 0.5, 2.0):
            q = np.linspace(0, 1, 400_001)
            if not 1 + xi * (u - 1) / 2 > 0:
                continue
            tau = math.exp(-(u - 1) / 2) if xi == 0 else (1 + xi * (u - 1) / 2) ** (-1 / xi)
            s = tau * np.exp(-40 * (1 - q))  # log-spaced tails
            x = 1 - 2 * np.log(s) if xi == 0 else 1 + 2 / xi * (s**-xi - 1)
            f = x * np.exp(-s) * s * 40
            want = float(((f[1:] + f[:-1]) / 2 * np.diff(q)).sum()) / -math.expm1(-tau) - u
            if xi < 0.8:
                assert value(spark, m.conditional_excess_mean(u)) == pytest.approx(want, rel=2e-3, abs=2e-3), (xi, u)
    assert math.isnan(value(spark, distributions.GeneralizedExtremeValue(0.0, 1.0, 1.0).conditional_excess_mean(1.0)))


def best_line(x, y, q):
    lines = [((y[j] - y[i]) / (x[j] - x[i]), i) for i in range(len(x)) for j in range(i) if x[i] != x[j]]
    return min(np.maximum(q * (y - (y[i] + s * (x - x[i]))), (q - 1) * (y - (y[i] + s * (x - x[i])))).mean() for s, i in lines)


@pytest.mark.parametrize("near", [2_000, 20])
def test_quantile_lines_are_the_best_ones(spark, near):
    rng = np.random.default_rng(2)
    x, y = np.r_[rng.normal(size=70), 1.0, 1.0], np.r_[rng.standard_cauchy(70), 5.0, 5.0]
    rows = spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y)] + [(None, 1.0), (1.0, float("nan"))], "x double, y double")
    for q in (0.1, 0.5, 0.9):
        m = quantile_regression.QuantileRegressor(q, near=near).fit(rows, ["x"], "y")
        r = y - m.intercept - m.coef[0] * x
        assert np.maximum(q * r, (q - 1) * r).mean() == pytest.approx(best_line(x, y, q), rel=1e-6)
    flat = quantile_regression.QuantileRegressor(0.5, alpha=100.0).fit(rows, ["x"], "y")
    assert abs(flat.coef[0]) < 1e-3
    with pytest.raises(ValueError):
        quantile_regression.QuantileRegressor(0.5).fit(rows.limit(0), ["x"], "y")


def test_spatiotemporal_hawkes_in_the_plane(spark):
    rng = np.random.default_rng(5)
    pts = [(float(a), float(b), float(t)) for a, b, t in zip(rng.random(120) * 30, rng.random(120) * 20, np.sort(rng.random(120) * 50))] + [(3.0, 3.0, 10.0), (3.0, 3.0, 10.0)]
    m = spatial.SpatioTemporalHawkes(0.01, 0.5, 1.5, 2.0, spatial.Box((0.0, 0.0), (30.0, 20.0)), 0.0, 50.0)
    events = spark.createDataFrame(pts, "x double, y double, t double")
    got = m.log_prob(events, ["x", "y"]).first()
    erf = lambda v: math.erf(v / (2 * math.sqrt(2)))
    logs = sum(math.log(0.01 + sum(0.5 * 1.5 * math.exp(-1.5 * (t - s)) * math.exp(-((a - c) ** 2 + (b - d) ** 2) / 8) / (2 * math.pi * 4) for c, d, s in pts if s < t)) for a, b, t in pts)
    mass = 0.01 * 600 * 50 + 0.5 * sum((1 - math.exp(-1.5 * (50 - t))) * 0.25 * (erf(30 - a) - erf(-a)) * (erf(20 - b) - erf(-b)) for a, b, t in pts)
    assert got.n == len(pts) and got.sum_log_rate == pytest.approx(logs, abs=1e-6) and got.compensator == pytest.approx(mass, abs=1e-6)


def test_boxes_and_fields(spark):
    box = spatial.Box.of_size(2, 3, 4)
    assert (box.n_dims, box.volume, box.sides) == (3, 24.0, (2.0, 3.0, 4.0))
    assert box.integral(spark, lambda x, y, z: x * y + z, 24) == pytest.approx(2 * 4.5 * 4 + 6 * 8, rel=1e-9)
    with pytest.raises(ValueError):
        spatial.Box((0.0,), (0.0,))
    places = spark.range(2000).select(*[c.alias(n) for c, n in zip(box.uniform("id", seed=1), "xyz")])
    assert places.where(~box.contains(F.col("x"), F.col("y"), F.col("z"))).count() == 0


def test_separation_in_long_chains_equals_the_greedy_choice(spark):
    rng = random.Random(9)
    rows = [(1, i, rng.choice([1.0, 2.0, 3.0, 4.0, 5.0])) for i in range(3000)]
    df = spark.createDataFrame([(*r, 1.5) for r in rows], "k long, i long, value double, threshold double")
    got = {r.ix for r in decluster.separated_peaks(df, 6, ["k"], ["i"]).collect()}
    v = [r[2] for r in rows]
    peaks = [i for i in range(3000) if v[i] > 1.5 and (i == 0 or v[i] > v[i - 1]) and (i == 2999 or v[i] > v[i + 1])]
    kept = []
    for i in sorted(peaks, key=lambda i: (-v[i], -i)):
        if all(abs(i - j) >= 6 for j in kept):
            kept.append(i)
    assert got == set(kept)


def test_padded_blocks_of_few_values(spark):
    df = spark.createDataFrame([("a", 1, 5.0), ("a", 1, 7.0), ("b", 2, float("nan"))], "k string, b long, value double")
    got = sorted((r.k, r.rank, r.value) for r in blocks.padded_r_largest(df, 3, ["k"], "b", ["value"]).collect())
    assert [(k, n) for k, n, _ in got] == [(k, n) for k in "ab" for n in (1, 2, 3)] and [x for *_, x in got] == [7.0, 5.0, None, None, None, None]
