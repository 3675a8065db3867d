"""Chunks and segments give what one window a key gives."""

import random

import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from brinkline.operators import blocks, decluster, positions, thresholds

ORDER = ["t", "id"]


@pytest.fixture(scope="module")
def rows(spark):
    """A key with most of the rows, a NULL key, ties in t and in value, NaN and NULL values."""
    rng = random.Random(5)
    out = []
    for i in range(1500):
        key = rng.choice(["hot"] * 6 + ["a", "b", None])
        value = rng.choice([None, float("nan"), 1.0] + [round(rng.random() * 10, 1)] * 9)
        out.append((key, rng.randrange(900), i, value, f"x{i}"))
    out.append(("single", 1, 5000, 7.0, "y"))
    out.append(("nothing", 1, 5001, None, "z"))
    return spark.createDataFrame(out, "k string, t int, id int, value double, other string").withColumn("threshold", F.lit(6.0)).repartition(5).persist()


def listed(df):
    return sorted(map(repr, (tuple(r[c] for c in sorted(df.columns)) for r in df.collect())))


def test_running_sums(rows):
    terms = {"n": F.lit(1), "above": (F.col("value") > 6).cast("long")}
    whole = positions.running_sums(rows, ["k"], ORDER, terms)
    assert listed(positions.running_sums(rows, ["k"], ORDER, terms, 300)) == listed(whole)
    assert whole.where("k = 'hot'").agg(F.max("n")).first()[0] == rows.where("k = 'hot'").count()


def test_running_sums_without_keys(rows):
    assert listed(positions.numbered(rows, [], ORDER, chunk_rows=300)) == listed(positions.numbered(rows, [], ORDER))


def test_empty_table(rows):
    assert positions.numbered(rows.limit(0), ["k"], ORDER).count() == 0
    assert thresholds.ranked_quantile(rows.limit(0), ["k"], 0.9).count() == 0


@pytest.mark.parametrize("n", [1, 7])
def test_operators_by_chunks(rows, n):
    keys = ["k"]
    chunks = {"chunk_rows": 400}
    cut = chunks | {"segment_rows": n}
    for f, small in (
        (lambda **a: decluster.runs(rows, keys, ORDER, "max", **a), chunks),
        (lambda **a: decluster.extremal_index(rows, keys, ORDER, **a), chunks),
        (lambda **a: decluster.run_rows(rows, keys, ORDER, **a), chunks),
        (lambda **a: blocks.fixed_blocks(rows, 8, keys, ORDER, **a), chunks),
        (lambda **a: decluster.peaks(rows, keys, ORDER, **a), cut),
        (lambda **a: decluster.separated_peaks(rows, 9, keys, ORDER, **a), cut),
        (lambda **a: thresholds.rolling_threshold(rows, 6, keys, ORDER, 0.8, min_count=3, centred=True, **a), cut),
        (lambda **a: thresholds.rolling_threshold(rows, 5, keys, ORDER, **a), cut),
        (lambda **a: blocks.sliding_block_maxima(rows, 4, keys, ORDER, stride=3, **a), cut),
    ):
        if n == 7 or small is cut:  # only segments differ
            assert listed(f(**small)) == listed(f())


@pytest.mark.parametrize("n", [1, 5])
def test_frames_reach_over_segments(rows, n):
    numbered = positions.numbered(rows, ["k"], ORDER)
    cut = positions.segments(numbered, 3, 2, length=n)
    by = W.partitionBy("k", "brinkline_segment").orderBy("ix").rowsBetween(-3, 2)
    got = positions.own_rows(cut.withColumn("s", F.concat_ws(" ", F.collect_list("id").over(by))))
    along = W.partitionBy("k").orderBy("ix").rowsBetween(-3, 2)
    assert listed(got) == listed(numbered.withColumn("s", F.concat_ws(" ", F.collect_list("id").over(along))))


@pytest.mark.parametrize("q", [0.1, 1.0])
def test_quantiles_by_chunks(rows, q):
    want = {r.k: r.threshold for r in thresholds.threshold(rows, ["k"], "quantile", q).collect()}
    got = {r.k: r.threshold for r in thresholds.threshold(rows, ["k"], "quantile", q, chunk_rows=60).collect()}
    assert got.keys() == want.keys() and got["nothing"] is None and want["nothing"] is None
    for k in want.keys() - {"nothing"}:
        assert got[k] == pytest.approx(want[k], abs=1e-12)
