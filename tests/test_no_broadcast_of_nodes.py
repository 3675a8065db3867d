"""Tables of nodes, whose size Spark underrates, go to no driver."""

from pyspark.sql import functions as F

from brinkline.operators import processes as P
from brinkline.operators.thinning import Thinned


def test_thinned_likelihoods_broadcast_nothing(spark):
    events = spark.range(90).selectExpr("id % 3 k", "cast(id as double) t", "1.0 m")
    windows = spark.range(3).selectExpr("id k", "0.0 t0", "100.0 t1")
    for base in (P.HomogeneousPoisson(0.1), P.ExponentialHawkes(0.1, 0.2, 0.5)):
        df = Thinned(base, lambda t, m, past: F.exp(-past.n / 100.0), nodes=20).log_prob(events, windows, ["k"], ["t"], "m")
        assert df.count() == 3
        assert "BroadcastExchange" not in df._jdf.queryExecution().sparkPlan().toString()
        assert "BroadcastHashJoin" not in df._jdf.queryExecution().sparkPlan().toString()
