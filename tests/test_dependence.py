"""Pairs of sites and fits by key against direct computation."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from brinkline.operators import dependence, estimation


def data(spark, seed=2):
    rng = random.Random(seed)
    sites = [(i, rng.uniform(-9, 9), rng.uniform(-9, 9)) for i in range(40)] + [(90, None, 1.0), (91, 0.0, 0.0)]
    rows = [(s, t, float(rng.choice([rng.randint(1, 5), rng.gauss(0, 3)]))) for s, *_ in sites[:40] for t in range(12) if rng.random() < 0.9] + [(0, 50, None), (1, 50, float("nan"))]
    return sites, rows, spark.createDataFrame(sites, "s int, x double, y double"), spark.createDataFrame(rows, "s int, t int, v double")


@pytest.mark.parametrize("reach", [2.5, 40.0])
def test_every_near_pair_once(spark, reach):
    sites, _, table, _ = data(spark)
    got = sorted((r.a, r.b, round(r.distance, 9)) for r in dependence.near_pairs(table, "s", reach).collect())
    known = [s for s in sites if s[1] is not None]
    assert got == sorted((a, b, round(math.hypot(p - u, q - v), 9)) for a, p, q in known for b, u, v in known if a < b and math.hypot(p - u, q - v) <= reach)


@pytest.mark.parametrize("chunk", [10**6, 17])
def test_madogram_variogram_and_joint_exceedances(spark, chunk):
    sites, rows, table, df = data(spark)
    good = [(s, t, v) for s, t, v in rows if v is not None and not math.isnan(v)]
    by = {}
    for s, t, v in good:
        by.setdefault(s, {})[t] = v
    u = {s: {t: sum(w <= v for w in of.values()) / (len(of) + 1) for t, v in of.items()} for s, of in by.items()}
    place = {s: (x, y) for s, x, y in sites if x is not None}
    bins = {}
    for a in u:
        for b in u:
            h = math.hypot(*(p - q for p, q in zip(place[a], place[b], strict=True)))
            if a < b and h <= 6:
                bins.setdefault(math.floor(h / 1.5), []).extend((u[a][t], u[b][t], by[a][t], by[b][t]) for t in u[a].keys() & u[b].keys())
    got = {r.bin: r for r in dependence.madogram(df, table, "s", "t", "v", 6.0, 1.5, chunk).collect()}
    wild = {r.bin: r for r in dependence.variogram(df, table, "s", "t", "v", 6.0, 1.5).collect()}
    both = {r.bin: r for r in dependence.joint_exceedances(df, table, "s", "t", "v", 6.0, 1.5, 0.6, chunk).collect()}
    assert set(got) == set(wild) == set(both) == set(bins)
    for k, pairs in bins.items():
        p = np.array(pairs)
        nu = 0.5 * np.abs(p[:, 0] - p[:, 1]).mean()
        assert got[k].n == len(p) and got[k].nu == pytest.approx(nu) and got[k].theta == pytest.approx((1 + 2 * nu) / (1 - 2 * nu))
        assert wild[k].gamma == pytest.approx(0.5 * ((p[:, 2] - p[:, 3]) ** 2).mean())
        high = p[:, :2] > 0.6
        assert both[k].chi == pytest.approx(high.all(1).sum() / (high.sum() / 2))


def test_equal_series_depend_completely(spark):
    df = spark.createDataFrame([(s, t, float(t * t)) for s in (1, 2) for t in range(9)], "s int, t int, v double")
    table = spark.createDataFrame([(1, 0.0, 0.0), (2, 0.0, 1.0)], "s int, x double, y double")
    one = dependence.madogram(df, table, "s", "t", "v", 2.0, 2.0).first()
    assert (one.nu, one.theta, one.pairs, one.n) == (0.0, 1.0, 1, 9)
    assert dependence.madogram(df.where("false"), table, "s", "t", "v", 2.0, 2.0).collect() == []


@pytest.mark.parametrize("chunk", [10**6, 400])
def test_fits_find_the_parameters(spark, chunk):
    rng = np.random.default_rng(1)
    u = rng.random(6000)
    gev = {(1.0, 2.0, 0.2): 1, (10.0, 0.5, -0.3): 2}
    rows = [(k, float(loc + s / x * ((-math.log(v)) ** -x - 1))) for (loc, s, x), k in gev.items() for v in u] + [(3, 5.0)] * 4 + [(4, 1.0), (4, 2.0), (None, 1.0), (None, 2.0), (None, 9.0), (5, None)]
    df = spark.createDataFrame(rows, "k int, value double")
    got = {r.k: r for r in estimation.fit_gev(df, ["k"], chunk_rows=chunk).collect()}
    for (loc, s, x), k in gev.items():
        assert (got[k].loc, got[k].scale, got[k].shape) == (pytest.approx(loc, abs=0.1), pytest.approx(s, rel=0.05), pytest.approx(x, abs=0.04)) and got[k].n == 6000
    assert got[3].scale is None and got[4].scale is None and got[None].scale > 0 and 5 not in got
    over = [(k, float(7 + s / x * ((1 - v) ** -x - 1)), 7.0) for k, s, x in ((1, 2.0, 0.2), (2, 3.0, -0.4)) for v in u] + [(1, 6.0, 7.0), (2, 7.0, 7.0)]
    found = {r.k: r for r in estimation.fit_gpd(spark.createDataFrame(over, "k int, value double, threshold double"), ["k"], chunk_rows=chunk).collect()}
    assert (found[1].scale, found[1].shape) == (pytest.approx(2.0, rel=0.07), pytest.approx(0.2, abs=0.05)) and (found[2].scale, found[2].shape) == (pytest.approx(3.0, rel=0.05), pytest.approx(-0.4, abs=0.05)) and found[1].n == 6000
    x = sorted(float(v) for v in u[:50])
    m = estimation.weighted_moments(spark.createDataFrame([(1, v) for v in x], "k int, value double"), ["k"]).first()
    assert m.b2 == pytest.approx(sum(i * (i - 1) / 49 / 48 * v for i, v in enumerate(x)) / 50) and F.lit(1) is not None
