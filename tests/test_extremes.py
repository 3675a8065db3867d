import math
import random

import pytest
from pyspark.sql import functions as F

from brinkline.functions import evt
from brinkline.functions.distributions import Frechet, GeneralizedPareto, Weibull
from brinkline.functions.special import erf, lgamma
from brinkline.operators import blocks, decluster, point_process, thresholds


def value(spark, c):
    return spark.range(1).select(c.alias("v")).first().v


def series(spark, *runs):
    rows = [(site, i, float(v)) for site, values in enumerate(runs) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "site int, ix0 int, value double").withColumn("threshold", F.lit(0.5))


def zeros(n, **at):
    out = [0.0] * n
    for k, v in at.items():
        out[int(k[1:])] = v
    return out


def test_special_functions(spark):
    for x in (0.05, 0.5, 1.0, 3.7, 30.0):
        assert value(spark, lgamma(x)) == pytest.approx(math.lgamma(x), abs=1e-12)
        assert value(spark, erf(x)) == pytest.approx(math.erf(x), abs=1e-12)


def test_closed_forms(spark):
    assert value(spark, evt.gev_return_level(100, 0.0, 1.0, 0.1)) == pytest.approx(5.840976, abs=1e-6)
    assert value(spark, evt.gev_return_level(100, 0.0, 1.0, 0.0)) == pytest.approx(4.600149, abs=1e-6)
    assert value(spark, evt.gpd_return_level(100, 1.0, 0.2)) == pytest.approx(7.559432, abs=1e-6)
    assert value(spark, evt.gpd_mean(2.0, 0.3)) == pytest.approx(2.857143, abs=1e-6)
    assert value(spark, evt.gev_mean(0.0, 1.0, 1.0)) == math.inf and value(spark, evt.gpd_mean(1.0, 1.0)) == math.inf
    assert value(spark, evt.gpd_log_prob(-0.5, 1.0, 0.2)) == -math.inf
    assert value(spark, evt.gpd_cdf(1 / 0.3, 1.0, -0.3)) == pytest.approx(1.0)
    assert value(spark, evt.gev_skewness(0.0, 1.0, -0.2)) == pytest.approx(0.254110, abs=1e-5)


@pytest.mark.parametrize("xi", [-0.4, 0.0, 0.3])
def test_quantile_inverts_distribution(spark, xi):
    for q in (0.05, 0.5, 0.95):
        assert value(spark, evt.gev_cdf(evt.gev_icdf(q, 1.0, 2.0, xi), 1.0, 2.0, xi)) == pytest.approx(q, abs=1e-9)
        assert value(spark, evt.gpd_cdf(evt.gpd_icdf(q, 2.0, xi), 2.0, xi)) == pytest.approx(q, abs=1e-9)


def test_distribution_objects(spark):
    with pytest.raises(ValueError):
        Frechet(0.0, 1.0, -0.1)
    with pytest.raises(ValueError):
        Weibull(0.0, 1.0, 0.1)
    d = GeneralizedPareto(2.0, 0.1)
    assert value(spark, d.hazard(1.0)) == pytest.approx(1 / 2.1)


def test_r_largest_fixed_blocks(spark):
    rows = series(spark, range(1, 21), range(101, 121))
    found = blocks.r_largest(blocks.fixed_blocks(rows, 10, ["site"], ["ix0"]), 3, ["site"], "block", ["ix0"])
    assert sorted((r.site, r.block, r["rank"], r.value) for r in found.collect() if r.block == 0) == [(0, 0, 1, 10.0), (0, 0, 2, 9.0), (0, 0, 3, 8.0), (1, 0, 1, 110.0), (1, 0, 2, 109.0), (1, 0, 3, 108.0)]


def test_separated_peaks(spark):
    got = lambda rows, k: sorted((r.site, r.value) for r in decluster.separated_peaks(rows, k, ["site"], ["ix0"]).collect())
    assert got(series(spark, zeros(40, i10=5.0, i25=4.0, i30=3.0)), 10) == [(0, 4.0), (0, 5.0)]
    assert got(series(spark, zeros(20, i5=3.0, i8=2.0, i11=4.0)), 10) == [(0, 4.0)]
    assert got(series(spark, [5, 1, 1, 1, 1, 1, 1, 4]), 3) == [(0, 4.0), (0, 5.0)]
    assert got(series(spark, zeros(30, i5=5.0, i20=3.0), zeros(30, i10=4.0, i14=2.0)), 10) == [(0, 3.0), (0, 5.0), (1, 4.0)]


def test_separated_peaks_against_plain_loop(spark):
    rng = random.Random(3)
    values = [rng.choice([0.0, rng.random() * 10]) for _ in range(400)]
    got = sorted(r.ix for r in decluster.separated_peaks(series(spark, values), 7, ["site"], ["ix0"]).collect())
    peak = [i for i, v in enumerate(values) if v > 0.5 and all(v > values[j] for j in (i - 1, i + 1) if 0 <= j < len(values))]
    kept = []
    for i in sorted(peak, key=lambda i: (values[i], i), reverse=True):
        if all(abs(i - j) >= 7 for j in kept):
            kept.append(i)
    assert got == sorted(kept)


def test_runs_and_extremal_index(spark):
    rows = series(spark, zeros(8, i2=3.0, i3=4.0), zeros(8, i5=5.0, i6=6.0))
    assert sorted((r.site, r.last_ix, r.cluster) for r in decluster.runs(rows, ["site"], ["ix0"]).collect()) == [(0, 3, 4.0), (1, 6, 6.0)]
    rows = series(spark, zeros(8, i1=1.0, i4=1.0), zeros(8, i2=1.0, i3=1.0), zeros(8))
    assert sorted((r.site, r.theta) for r in decluster.extremal_index(rows, ["site"], ["ix0"]).collect() if r.site < 2) == [(0, 1.0), (1, 0.5)]


def test_nan_counts_as_missing(spark):
    rows = spark.createDataFrame([(1, float("nan")), (1, 2.0), (1, None)], "k int, value double")
    assert thresholds.threshold(rows, ["k"], "max").first().threshold == 2.0


def test_hawkes_and_renewal_vectors(spark):
    e = spark.createDataFrame([(0, t) for t in (0.5, 1.8, 2.7, 3.9, 4.5)], "k int, t double")
    found = point_process.renewal_log_likelihood(e, ["k"], 5.0, *point_process.weibull_gap(1.0, 0.5)).first()
    assert found.log_lik == pytest.approx(5 * math.log(2) - 10)
    h = point_process.hawkes_log_likelihood(spark.createDataFrame([(0, t) for t in (1.0, 2.0, 3.0)], "k int, t double"), ["k"], 0.5, 0.3, 1.0, 5.0).first()
    assert h.compensator == pytest.approx(3.338969, abs=1e-6)


def test_residuals_and_ks(spark):
    e = spark.createDataFrame([(0, t) for t in (0.5, 1.0, 2.5, 3.0)], "k int, t double")
    got = [r.residual for r in point_process.residuals(e, ["k"], lambda t: 2.0 * t).orderBy("t").collect()]
    assert got == [1.0, 1.0, 3.0, 1.0]
    same = spark.createDataFrame([(0, 5.0)] * 4, "k int, residual double")
    assert point_process.ks_exponential(same, ["k"]).first().ks == pytest.approx(0.993262, abs=1e-6)


def test_empty_sequences_keep_a_likelihood(spark):
    windows = spark.createDataFrame([(0, 0.0, 5.0)], "k int, t0 double, t1 double")
    none = spark.createDataFrame([], "k int, t double")
    assert point_process.hpp_log_likelihood(none, windows, ["k"], 2.0).first().log_lik == -10.0
