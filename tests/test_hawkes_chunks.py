import math
import random

import pytest

from brinkline.operators import point_process


def test_chunks_give_the_whole_fold(spark, monkeypatch):
    rng = random.Random(8)
    rows = [("hot", rng.random() * 50) for _ in range(900)] + [("hot", 25.0)] * 200 + [(None, rng.random() * 50) for _ in range(100)] + [("cold", 3.0), ("cold", None), ("none", None)]
    longest = []
    write = point_process.materialize

    def watched(df, root, name):
        out = write(df, root, name)
        longest.append(out.selectExpr("max(size(ts))").first()[0])
        return out

    monkeypatch.setattr(point_process, "materialize", watched)
    mu, alpha, beta, t1 = 0.05, 0.1, 0.5, 60.0
    got = {r.k: r for r in point_process.hawkes_log_likelihood(spark.createDataFrame(rows, "k string, t double"), ["k"], mu, alpha, beta, t1, chunk_rows=100).collect()}
    assert set(got) == {"hot", None, "cold", "none"} and max(longest) <= 300
    for key, r in got.items():
        ts = sorted(t for k, t in rows if k == key and t is not None)
        a, ll, last = 0.0, 0.0, None
        for t in ts:
            a = 0.0 if last is None else math.exp(-beta * (t - last)) * (1 + a)
            ll, last = ll + math.log(mu + alpha * a), t
        compensator = mu * t1 + alpha / beta * sum(1 - math.exp(-beta * (t1 - t)) for t in ts)
        assert r.n == len(ts) and r.sum_log_rate == pytest.approx(ll, abs=1e-8) and r.compensator == pytest.approx(compensator, abs=1e-8)
        assert r.log_lik == pytest.approx(ll - compensator, abs=1e-8)
