"""Marks of 0, whose logarithm is -inf, are neither left out of a likelihood nor forgotten by the next event."""

import math

from pyspark.sql import functions as F

from brinkline.operators.history import History, marks_log_prob
from brinkline.plans.conditional import following


def test_zero_marks_count_as_in_the_sql(spark):
    rows = spark.createDataFrame([(1, 1.0, 2.0), (1, 2.0, 0.0), (1, 3.0, 4.0), (2, 1.0, 2.0)], "k int, t double, m double")
    got = {r.k: r for r in marks_log_prob(rows, ["k"], following, "m").collect()}
    assert math.isnan(got[1].mark_ll) and math.isfinite(got[2].mark_ll) and got[1].n == 3
    past = History(F.lit(1), F.lit(2.0), F.lit(0.0), F.lit(2.0))
    assert spark.range(1).select(following(F.lit(3.0), F.lit(4.0), past).alias("v")).first().v == -math.inf
