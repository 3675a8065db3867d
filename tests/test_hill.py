import math
import random

import pytest

from brinkline.operators import thresholds
from brinkline.plans import catalogue


def test_every_requested_k_below_n(spark):
    rng = random.Random(6)
    xs = {"a": [rng.paretovariate(2) for _ in range(60)], "b": [rng.paretovariate(3) for _ in range(4)]}
    rows = spark.createDataFrame([(s, x) for s, v in xs.items() for x in v], "site string, value double")
    for wanted in (None, [1, 3, 30, 59, 60, 500]):
        got = {(r.site, r.k): r.hill for r in thresholds.hill(rows, ["site"], wanted).collect()}
        want = {}
        for s, v in xs.items():
            top = sorted(v, reverse=True)
            for k in range(1, len(v)):
                if wanted is None or k in wanted:
                    want[s, k] = k / sum(math.log(x / top[k]) for x in top[:k])
        assert got == pytest.approx(want)


def test_query_agrees_with_its_sql(spark):
    import duckdb

    at = "/root/testdata/sf0.001"
    got = {(r[0], r[1]): r[2] for r in catalogue.QUERIES["hill_estimates"](spark, at).collect()}
    sql = catalogue.ORACLE_SQL["hill_estimates"].replace("FROM lineitem", f"FROM read_parquet('{at}/lineitem.parquet')")
    want = {(r[0], r[1]): float(r[2]) for r in duckdb.sql(sql).fetchall()}
    assert got == pytest.approx(want, abs=2e-6) and got
