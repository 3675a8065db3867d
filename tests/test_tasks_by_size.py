"""What a task holds doesn't grow with the table: work is dealt over a task for so many rows."""

import math
import random

import pytest
from pyspark.sql import functions as F

from brinkline.operators import positions
from brinkline.operators import processes as P


def most_of_a_task(df):
    return df.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]


@pytest.fixture
def small_tasks(monkeypatch):
    monkeypatch.setattr(positions, "TASK_ROWS", 200)


def test_small_tables_stay_and_large_ones_are_dealt(spark):
    df = spark.range(1_000).coalesce(1)
    assert positions.dealt_by_size(df, ["id"], 1_000, 1_000) is df
    assert most_of_a_task(positions.dealt_by_size(df, ["id"], 1_000, 50)) < 100


def test_decayed_sums_deal_queries_and_count_no_event_without_a_time(spark, small_tasks):
    rng, beta = random.Random(5), 0.05
    events = [(k, rng.random() * 900) for k in range(40) for _ in range(30)] + [(3, None), (None, 5.0), (4, 160.0), (4, 160.0)]
    queries = [(k, t, f"{k}-{i}") for k in range(42) for i, t in enumerate((0.0, 160.0, 160.0, 555.5, 880.0, 4_000.0) * 8)]
    found = P.decayed_sums(spark.createDataFrame(events, "k long, t double"), spark.createDataFrame([*queries, (None, 9.0, "x"), (1, None, "y")], "k int, t double, own string"), ["k"], beta)
    assert found.columns == ["k", "t", "own", "n", "decayed"] and dict(found.dtypes)["k"] == "int"
    got = {r.own: r for r in found.collect()}
    assert len(got) == len(queries) == found.count()
    assert most_of_a_task(found) < len(queries) / 4  # no more than that with as many tasks as the session shuffles into
    for k, t, own in queries:
        past = [s for q, s in events if q == k and s is not None and s < t]
        assert got[own].n == len(past) and got[own].decayed == pytest.approx(sum(math.exp(-beta * (t - s)) for s in past), abs=1e-9)
