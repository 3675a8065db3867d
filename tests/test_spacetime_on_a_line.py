"""Space-time self-excitation on a line: sums by cell against direct sums, in one chunk and in many, without pairs of rows."""

import random

import numpy as np
import pytest

from brinkline.operators.spatial import Box, SpatioTemporalHawkes


@pytest.mark.parametrize("chunk", [10**6, 40])
def test_rates_are_those_of_direct_sums(spark, chunk):
    rng = random.Random(3)
    events = [(rng.uniform(-40, 60), rng.choice([rng.uniform(-5, 90), float(rng.randint(0, 20))])) for _ in range(300)]
    events += events[:9]
    asked = [*events, *[(rng.uniform(-60, 90), rng.uniform(-9, 150)) for _ in range(60)], (500.0, 10.0)]
    model = SpatioTemporalHawkes(0.01, 0.6, 0.8, 4.0, Box((-40.0,), (60.0,)), 0.0, 90.0)
    e, q = (spark.createDataFrame(v, "x double, t double") for v in (events, asked))
    got = {(r.x, r.t): r.rate for r in model._on_a_line(e, q, "x", chunk).collect()}
    assert set(got) == set(asked)
    y, s = np.array(events).T
    for (x, t), rate in got.items():
        past = s < t
        want = 0.01 + (0.6 * 0.8 * np.exp(-0.8 * (t - s[past]) - (x - y[past]) ** 2 / 32) / (4 * np.sqrt(2 * np.pi))).sum()
        assert rate == pytest.approx(want, rel=1e-11, abs=1e-14)


def test_no_pairs_are_formed(spark):
    e = spark.range(50).selectExpr("cast(id as double) x", "cast(id as double) t")
    plan = SpatioTemporalHawkes(0.01, 0.6, 0.8, 4.0, Box((0.0,), (60.0,)), 0.0, 90.0).intensity(e, e, ["x"])._jdf.queryExecution().optimizedPlan().toString()
    assert "b_x" not in plan
