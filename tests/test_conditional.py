"""Poisson tails, quadrature, histories and thinned processes against direct computation and closed forms."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from brinkline.functions.special import log_poisson_cdf, log_poisson_sf, poisson_cdf
from brinkline.operators import processes as P
from brinkline.operators import quadrature as Q
from brinkline.operators import spatial as S
from brinkline.operators.history import History, history_at, marks_log_prob, with_history
from brinkline.operators.thinning import Thinned


def tail(k, m, above):
    """The sum from the largest term on, in extended precision."""
    first, t, s, i = (k + 1 if above else k), np.longdouble(1), np.longdouble(1), 1
    while t > 1e-22 * s:
        t *= np.longdouble(m) / (first + i) if above else np.longdouble(max(first - i + 1, 0)) / np.longdouble(m)
        s, i = s + t, i + 1
    b = np.longdouble(first)
    series = np.longdouble(math.lgamma(first + 1)) if first < 10 else b * np.log(b) - b + 0.5 * np.log(2 * np.longdouble(np.pi) * b) + 1 / (12 * b) - 1 / (360 * b**3) + 1 / (1260 * b**5)
    return float(b * np.log(np.longdouble(m)) - np.longdouble(m) - series + np.log(s))


def test_poisson_tails_of_any_mean(spark):
    rows = [(float(k), float(m)) for m in (0.5, 1, 30, 700, 1000, 9990, 10001, 1e5, 1e6, 2e7) for z in (-8, -3, -0.1, 0, 1, 3, 8, 30) if (k := round(m + z * math.sqrt(m))) >= 0]
    rows += [(2000.0, 1000.0), (1e6, 1e5), (20000.0, 1e6), (0.0, 5000.0), (-1.0, 3.0), (4.0, 0.0), (2.7, 2.0)]
    k, m = F.col("k"), F.col("m")
    for r in spark.createDataFrame(rows, "k double, m double").select("k", "m", log_poisson_cdf(k, m).alias("c"), log_poisson_sf(k, m).alias("s")).collect():
        if r.k < 0:
            assert (r.c, r.s) == (-math.inf, 0.0)
        elif r.m == 0:
            assert (r.c, r.s) == (0.0, -math.inf)
        elif math.floor(r.k) + 1 >= r.m:
            want = tail(math.floor(r.k), r.m, True)
            assert r.s == pytest.approx(want, rel=1e-9) and r.c == pytest.approx(math.log1p(-math.exp(want)), rel=1e-9, abs=1e-300)
        else:
            want = tail(math.floor(r.k), r.m, False)
            assert r.c == pytest.approx(want, rel=1e-9) and r.s == pytest.approx(math.log1p(-math.exp(want)), rel=1e-9, abs=1e-300)
    assert spark.range(1).select(poisson_cdf(F.lit(1000), 1000.0).alias("p")).first().p == pytest.approx(0.508409, abs=1e-6)


def test_rules_on_polynomials_and_halton_points(spark):
    one = spark.range(1)
    cube = lambda x: x * x * x - 2.0 * x
    got = one.select(Q.simpson(cube, F.lit(1.0), F.lit(4.0), 3).alias("s"), Q.trapezoid(lambda x: 3.0 * x, F.lit(1.0), F.lit(4.0), 2).alias("t"), Q.trapezoid(cube, F.lit(2.0), F.lit(2.0), 50).alias("z")).first()
    assert (got.s, got.t, got.z) == (pytest.approx(255 / 4 - 15), pytest.approx(22.5), 0.0)
    for bad in (1, 2, 4):
        with pytest.raises(ValueError, match="nodes"):
            Q.simpson(cube, F.lit(0.0), F.lit(1.0), bad)
    assert Q.primes(8) == [2, 3, 5, 7, 11, 13, 17, 19]
    rows = Q.halton_points(spark, [0.0, 0.0], [1.0, 1.0], 9, ["x", "y"]).orderBy("node").collect()
    assert [r.x for r in rows] == [1 / 2, 1 / 4, 3 / 4, 1 / 8, 5 / 8, 3 / 8, 7 / 8, 1 / 16, 9 / 16]
    assert [r.y for r in rows] == pytest.approx([1 / 3, 2 / 3, 1 / 9, 4 / 9, 7 / 9, 2 / 9, 5 / 9, 8 / 9, 1 / 27])


@pytest.mark.parametrize("d", [1, 2, 3, 4])
def test_halton_integrals_close_in(spark, d):
    f = lambda *x: F.exp(-sum(x[1:], x[0]))
    want = (1 - math.exp(-2)) ** d
    few, many = (Q.integral_over(spark, f, [0.0] * d, [2.0] * d, n) for n in (256, 8192))
    assert abs(many - want) < 2e-3 * want and abs(many - want) < abs(few - want)
    box = S.Box((0.0,) * d, (2.0,) * d)
    assert box.integral(spark, f, points=8192) == pytest.approx(many)
    folded = spark.range(2).select(Q.box_integral(f, [0.0] * d, [F.lit(2.0)] * d, 256).alias("v")).collect()
    assert [r.v for r in folded] == [pytest.approx(few)] * 2
    flat = S.InhomogeneousSpatial(lambda *x: 0.0 * x[0] + math.log(3.0), box, points=64)
    assert flat.expected(spark) == pytest.approx(3.0 * 2**d)


def sequences(spark, seed=3, n=400, keys=6):
    rng = random.Random(seed)
    rows = [(rng.choice([None, *range(keys)]) if i % 9 else 0, i, round(rng.random() * 40, rng.choice([0, 3])), rng.choice([None, 1.0, 2.5, -3.0])) for i in range(n)]
    return rows, spark.createDataFrame(rows, "k long, id long, t double, m double")


@pytest.mark.parametrize("chunk", [10**6, 37])
def test_histories_equal_a_walk(spark, chunk):
    rows, df = sequences(spark)
    got = {r.id: r for r in with_history(df.withColumn("n_before", F.lit(7)), ["k"], ["t", "id"], "m", chunk).collect()}
    past = {}
    for k, i, t, m in sorted(rows, key=lambda r: (r[2], r[1])):
        seen = past.setdefault(k, [])
        r = got[i]
        assert (r.n_before, r.last_t, r.last_mark) == (len(seen), *(seen[-1] if seen else (None, None)))
        assert r.mark_sum == pytest.approx(sum(x or 0 for _, x in seen))
        seen.append((t, m))
    asked = spark.createDataFrame([(k, t / 2, "x") for k in [None, *range(7)] for t in range(90)] + [(1, 0.5, "twice")], "k long, t double, x string")
    found = history_at(df, asked, ["k"], ["t", "id"], "m", chunk).collect()
    assert len(found) == asked.count()
    for r in found:
        seen = [(t, i, m) for k, i, t, m in rows if k == r.k and t < r.t]
        last = max(seen)[::2] if seen else (None, None)
        assert (r.n_before, r.last_t, r.last_mark) == (len(seen), *last) and r.mark_sum == pytest.approx(sum(m or 0 for *_, m in seen))


def test_marks_that_don_t_look_back_are_a_plain_sum(spark):
    rows, df = sequences(spark)
    normal = lambda t, m, past: -0.5 * m * m - 0.5 * math.log(2 * math.pi)
    for r in marks_log_prob(df, ["k"], normal, "m", ["t", "id"]).collect():
        marks = [m for k, _, _, m in rows if k == r.k and m is not None]
        assert r.mark_ll == pytest.approx(sum(-0.5 * m * m - 0.5 * math.log(2 * math.pi) for m in marks))
    assert marks_log_prob(df.where("false"), ["k"], normal, "m").collect() == []


def kept(p):
    return lambda t, m, past: F.lit(float(p))


@pytest.mark.parametrize("base", [P.HomogeneousPoisson(0.4), P.InhomogeneousPoisson(lambda t: 0.01 * t - 1.0, 41, "simpson"), P.ExponentialHawkes(0.3, 0.4, 0.9)])
def test_constant_retention_has_a_closed_form(spark, base):
    _, df = sequences(spark, keys=3)
    df = df.where("k is not null and t < 30")
    windows = spark.createDataFrame([(k, 0.0, 30.0) for k in (0, 1, 2, 77)], "k long, t0 double, t1 double")
    alone = {r.k: r for r in (base.log_prob(df, windows, ["k"]) if isinstance(base, P.Poisson) else base.log_prob(df, windows.drop("t0"), ["k"])).collect()}
    ends = windows.select("k", F.col("t1").alias("t"))
    mass = {r.k: r.compensator for r in (ends.withColumn("compensator", base.cumulative(F.lit(0.0), F.col("t"))) if isinstance(base, P.Poisson) else base.cumulative_intensity(df, ends, ["k"])).collect()}
    for r in Thinned(base, kept(1.0), nodes=8).log_prob(df, windows, ["k"], ["t", "id"]).collect():
        assert r.log_lik == pytest.approx(alone[r.k].log_lik) and r.discarded == 0 and r.n == alone[r.k].n
    found = Thinned(base, kept(0.4), nodes=12, in_gaps=True).log_prob(df, windows, ["k"], ["t", "id"]).collect()
    assert sorted(r.k for r in found) == [0, 1, 2, 77]
    for r in found:
        assert r.log_lik == pytest.approx(alone[r.k].log_lik + r.n * math.log(0.4) + 0.6 * mass[r.k], rel=1e-6)


def test_retention_is_held_to_probabilities(spark):
    _, df = sequences(spark, keys=2)
    windows = spark.createDataFrame([(0, 0.0, 40.0)], "k long, t0 double, t1 double")
    one, wild = (Thinned(P.HomogeneousPoisson(0.4), kept(p), nodes=5).log_prob(df.where("k = 0"), windows, ["k"], ["t", "id"]).first() for p in (1.0, 3.0))
    assert one.log_lik == wild.log_lik
    tired = Thinned(P.HomogeneousPoisson(2.0), lambda t, m, past: 1.0 / (1.0 + past.n), nodes=9)
    asked = spark.createDataFrame([(0, 40.0)], "k long, t double")
    n = df.where("k = 0 and t < 40").count()
    assert tired.intensity(df, asked, ["k"], ["t", "id"]).first().rate == pytest.approx(2.0 / (1 + n))
    assert History.of().n is not None
