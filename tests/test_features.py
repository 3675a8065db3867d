"""Climatology, anomalies and spells against direct computation."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from brinkline.operators import features


def test_climatology_goes_around_the_turn_of_the_year(spark):
    rng = random.Random(1)
    rows = [(rng.choice([None, 1]), dt.date(2019, 1, 1) + dt.timedelta(days=rng.randrange(1500)), rng.choice([None, float("nan"), rng.gauss(5, 2)])) for _ in range(400)] + [(1, None, 3.0)]
    df = spark.createDataFrame(rows, "k int, d date, value double")
    good = [(k, d.timetuple().tm_yday, v) for k, d, v in rows if d and v is not None and v == v]
    want = {}
    for k in (None, 1):
        for day in range(1, 367):
            near = [v for q, e, v in good if q == k and min(abs(e - day), 366 - abs(e - day)) <= 4]
            if near:
                want[k, day] = (len(near), sum(near) / len(near))
    got = {(r.k, r.day): (r.n, r.normal) for r in features.climatology(df, ["k"], "d", half_width=4).collect()}
    assert set(got) == set(want) and all(got[q][0] == want[q][0] and got[q][1] == pytest.approx(want[q][1]) for q in want)
    found = features.anomalies(df.withColumn("normal", F.lit(0.0)), ["k"], "d", half_width=4).collect()
    assert len(found) == len(rows)
    for r in found:
        if r.d is None:
            assert r.normal is None
        elif r.value is not None and r.value == r.value:
            assert r.anomaly == pytest.approx(r.value - want[r.k, r.d.timetuple().tm_yday][1])
    with pytest.raises(ValueError, match="wider"):
        features.climatology(df, ["k"], "d", half_width=183)


@pytest.mark.parametrize("chunk", [10**6, 13])
def test_spells_equal_a_walk(spark, chunk):
    rng = random.Random(2)
    rows = [(k, i, rng.choice([True, True, False, None])) for k in (None, 1, 2) for i in range(60)] + [(3, i, False) for i in range(5)] + [(4, i, True) for i in range(40)]
    df = spark.createDataFrame(rows, "k int, i int, c boolean").repartition(4)
    want = []
    for k in (None, 1, 2, 3, 4):
        first = None
        mine = [bool(c) for q, _, c in rows if q == k]
        for i, c in enumerate([*mine, False]):
            if c and first is None:
                first = i
            if not c and first is not None:
                want.append((k, first, i - 1, i - first))
                first = None
    got = [tuple(r) for r in features.spells(df, ["k"], ["i"], F.col("c"), chunk).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    told = {r.k: (r.spells, r.longest) for r in features.spell_summary(df, ["k"], ["i"], F.col("c"), chunk).collect()}
    assert told == {k: (len(m), max(m, default=0)) for k in (None, 1, 2, 3, 4) for m in [[n for q, *_, n in want if q == k]]}
