"""Registered queries of the temporal, spatial and space-time processes."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from brinkline.operators import processes as P
from brinkline.operators import spatial as S
from brinkline.plans.catalogue import HOURS, T, dealt, hours, query, r6, spread, table

EVENTS = f"e AS (SELECT user_id, event_id, {T} AS t FROM events)"
USERS = "w AS (SELECT c_custkey - 1 AS user_id FROM customer)"
ASKED = "q AS (SELECT c_custkey - 1 AS user_id, 90.0 * i AS t FROM customer, range(1, 9) r(i))"


def users(spark, sf_dir):
    """Customers as sequences: those without events count too."""
    return table(spark, sf_dir, "customer").select((F.col("c_custkey") - 1).cast("long").alias("user_id"))


def windows(spark, sf_dir, t0=0.0, t1=HOURS):
    return users(spark, sf_dir).withColumn("t0", F.lit(t0)).withColumn("t1", F.lit(t1))


def asked(spark, sf_dir):
    return dealt(users(spark, sf_dir)).withColumn("t", F.explode(F.array(*[F.lit(90.0 * i) for i in range(1, 9)])))


def sequences(spark, sf_dir):
    return hours(spark, sf_dir).select("user_id", "t")


@query(f"""WITH a AS (SELECT s_suppkey, 0.05 + s_suppkey / 1000.0 AS r, 1 + s_nationkey::DOUBLE AS t FROM supplier), b AS (SELECT *, r * (t + 2) AS m FROM a)
SELECT s_suppkey, round(r, 6) AS intensity, round(r, 6) AS hazard, round(r * t, 6) AS cumulative, round(exp(-r * (t - 0.5)), 6) AS survival, round(r * (t - 0.5), 6) AS cumulative_hazard, round(ln(r) - r * t, 6) AS gap_log_prob, round(1 / r, 6) AS residual_life,
round(-ln(1 - 0.3) / r, 6) AS return_period, round(m, 6) AS expected, round(ln(1 - exp(-m) * (1 + m + m * m / 2 + m * m * m / 6)), 4) AS over_three FROM b""")
def hpp_methods(spark, sf_dir):
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", (0.05 + F.col("s_suppkey") / 1000.0).alias("r"), (1 + F.col("s_nationkey").cast("double")).alias("t"))
    m, t = P.HomogeneousPoisson(F.col("r")), F.col("t")
    cols = {"intensity": r6(m.intensity(t)), "hazard": r6(m.hazard(t)), "cumulative": r6(m.cumulative_intensity(t)), "survival": r6(m.survival(t, 0.5)), "cumulative_hazard": r6(m.cumulative_hazard(t, 0.5)), "gap_log_prob": r6(m.inter_event_log_prob(t)), "residual_life": r6(m.mean_residual_life()), "return_period": r6(m.return_period(0.3)), "expected": r6(m.predict_count(1.0, t + 3.0)), "over_three": F.round(m.exceedance_log_prob(3.0, 1.0, t + 3.0), 4)}
    return rows.select("s_suppkey", *[c.alias(n) for n, c in cols.items()])


@query(f"WITH {EVENTS}, {USERS} SELECT w.user_id, count(t) AS n, round(count(t) * ln(0.1) - 60, 6) AS log_lik FROM w LEFT JOIN e ON e.user_id = w.user_id AND t >= 100 AND t < 700 GROUP BY 1")
def hpp_window_log_likelihood(spark, sf_dir):
    found = P.HomogeneousPoisson(0.1).log_prob(sequences(spark, sf_dir), windows(spark, sf_dir, 100.0, 700.0), ["user_id"])
    return found.select("user_id", "n", r6("log_lik").alias("log_lik"))


WAVE = P.InhomogeneousPoisson(lambda t: -2.5 + 0.5 * F.sin(t / 100.0), 100)
RATE = "exp(-2.5 + 0.5 * sin(({}) / 100))"


def _mass(lo, hi):
    step = f"(({hi}) - ({lo})) / 99"
    return f"{step} * (list_sum(list_transform(range(1, 99), lambda i: {RATE.format(f'{lo} + i * {step}')})) + ({RATE.format(lo)} + {RATE.format(hi)}) / 2)"


@query(f"WITH {EVENTS}, {USERS}, m AS (SELECT {_mass('50', '650')} AS m) SELECT w.user_id, count(t) AS n, round(coalesce(sum(-2.5 + 0.5 * sin(t / 100)), 0) - max(m), 6) AS log_lik FROM w LEFT JOIN e ON e.user_id = w.user_id AND t >= 50 AND t < 650, m GROUP BY 1")
def ipp_log_likelihood(spark, sf_dir):
    found = WAVE.log_prob(sequences(spark, sf_dir), windows(spark, sf_dir, 50.0, 650.0), ["user_id"])
    return found.select("user_id", "n", r6("log_lik").alias("log_lik"))


@query(f"WITH {EVENTS} SELECT user_id, round(t, 6) AS t, count(*) OVER (PARTITION BY user_id ORDER BY t) AS n, round({_mass('0', 't')}, 5) AS compensator FROM e")
def ipp_compensator_curve(spark, sf_dir):
    return WAVE.compensator_curve(sequences(spark, sf_dir), ["user_id"]).select("user_id", r6("t").alias("t"), "n", F.round("compensator", 5).alias("compensator"))


@query(f"""WITH a AS (SELECT s_suppkey, 10 + s_nationkey::DOUBLE AS t FROM supplier), b AS (SELECT *, {_mass('5', 't')} AS m, {RATE.format('t')} AS r FROM a)
SELECT s_suppkey, round(r, 6) AS intensity, round(r, 6) AS hazard, round(exp(-m), 6) AS survival, round(m, 6) AS cumulative_hazard, round(ln(r) - m, 6) AS gap_log_prob, round(m, 6) AS expected, round(ln(1 - exp(-m) * (1 + m)), 5) AS over_one FROM b""")
def ipp_methods(spark, sf_dir):
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", (10 + F.col("s_nationkey").cast("double")).alias("t"))
    t = F.col("t")
    cols = {"intensity": r6(WAVE.intensity(t)), "hazard": r6(WAVE.hazard(t)), "survival": r6(WAVE.survival(t, 5.0)), "cumulative_hazard": r6(WAVE.cumulative_hazard(t, 5.0)), "gap_log_prob": r6(WAVE.inter_event_log_prob(t, 5.0)), "expected": r6(WAVE.predict_count(5.0, t)), "over_one": F.round(WAVE.exceedance_log_prob(1.0, 5.0, t), 5)}
    return rows.select("s_suppkey", *[c.alias(n) for n, c in cols.items()])


@query(f"WITH {EVENTS}, g AS (SELECT user_id, {_mass('0', 't')} AS c, t FROM e), r AS (SELECT user_id, c - coalesce(lag(c) OVER (PARTITION BY user_id ORDER BY t), 0) AS r FROM g), k AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY r) AS i, count(*) OVER (PARTITION BY user_id) AS n FROM r) SELECT user_id, n, round(max(greatest(i / n - 1 + exp(-r), 1 - exp(-r) - (i - 1) / n)), 5) AS ks FROM k GROUP BY 1, 2")
def ipp_goodness_of_fit(spark, sf_dir):
    return WAVE.goodness_of_fit(sequences(spark, sf_dir), ["user_id"]).select("user_id", "n", F.round("ks", 5).alias("ks"))


STEPS = P.PiecewisePoisson((0.0, 240.0, 480.0, 720.0), (0.05, 0.1, 0.2))


@query(f"WITH {EVENTS}, {USERS} SELECT w.user_id, count(t) AS n, round(coalesce(sum(CASE WHEN t < 240 THEN ln(0.05) WHEN t < 480 THEN ln(0.1) WHEN t >= 480 THEN ln(0.2) END), 0) - (140 * 0.05 + 24 + 100 * 0.2), 6) AS log_lik FROM w LEFT JOIN e ON e.user_id = w.user_id AND t >= 100 AND t < 580 GROUP BY 1")
def piecewise_window_log_likelihood(spark, sf_dir):
    return STEPS.log_prob(sequences(spark, sf_dir), windows(spark, sf_dir, 100.0, 580.0), ["user_id"]).select("user_id", "n", r6("log_lik").alias("log_lik"))


GAP = P.Renewal(P.WeibullGap(0.8, 60.0))


@query("""WITH a AS (SELECT s_suppkey, 1 + s_nationkey::DOUBLE AS t FROM supplier), b AS (SELECT *, pow(t / 60, 0.8) AS h FROM a)
SELECT s_suppkey, round(0.8 / 60 * pow(t / 60, -0.2), 6) AS hazard, round(h, 6) AS cumulative_hazard, round(exp(-h), 6) AS survival, round(ln(0.8 / 60) - 0.2 * ln(t / 60) - h, 6) AS gap_log_prob FROM b""")
def renewal_methods(spark, sf_dir):
    t = F.col("t")
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", (1 + F.col("s_nationkey").cast("double")).alias("t"))
    return rows.select("s_suppkey", r6(GAP.hazard(t)).alias("hazard"), r6(GAP.cumulative_hazard(t)).alias("cumulative_hazard"), r6(GAP.survival(t)).alias("survival"), r6(GAP.inter_event_log_prob(t)).alias("gap_log_prob"))


@query(f"""WITH {EVENTS}, {USERS}, i AS (SELECT w.user_id, t, t - coalesce(lag(t) OVER (PARTITION BY w.user_id ORDER BY t), 60) AS g FROM w LEFT JOIN e ON e.user_id = w.user_id AND t >= 60 AND t < 700)
SELECT user_id, count(t) AS n, round(coalesce(sum(CASE WHEN t IS NOT NULL THEN ln(0.8 / 60) - 0.2 * ln(greatest(g, 1e-30) / 60) - pow(g / 60, 0.8) END), 0) - pow((700 - coalesce(max(t), 60)) / 60, 0.8), 5) AS log_lik FROM i GROUP BY 1""")
def renewal_window_log_likelihood(spark, sf_dir):
    return GAP.log_prob(sequences(spark, sf_dir), windows(spark, sf_dir, 60.0, 700.0), ["user_id"]).select("user_id", "n", F.round("log_lik", 5).alias("log_lik"))


@query(f"WITH {EVENTS}, {ASKED}, l AS (SELECT q.user_id, q.t, q.t - coalesce(max(e.t), 0) AS g FROM q LEFT JOIN e ON e.user_id = q.user_id AND e.t < q.t GROUP BY 1, 2) SELECT user_id, t::DOUBLE AS t, round(0.8 / 60 * pow(g / 60, -0.2), 6) AS rate FROM l")
def renewal_intensities(spark, sf_dir):
    return GAP.intensity(sequences(spark, sf_dir), asked(spark, sf_dir), ["user_id"]).select("user_id", "t", r6("rate").alias("rate"))


@query(f"WITH {EVENTS}, g AS (SELECT user_id, t, pow((t - coalesce(lag(t) OVER (PARTITION BY user_id ORDER BY t), 0)) / 60, 0.8) AS r FROM e) SELECT user_id, round(t, 6) AS t, count(*) OVER w AS n, round(sum(r) OVER w, 5) AS compensator FROM g WINDOW w AS (PARTITION BY user_id ORDER BY t)")
def renewal_compensator_curve(spark, sf_dir):
    return GAP.compensator_curve(sequences(spark, sf_dir), ["user_id"]).select("user_id", r6("t").alias("t"), "n", F.round("compensator", 5).alias("compensator"))


EXCITED = P.ExponentialHawkes(0.02, 0.01, 0.05)
PAST = f"{EVENTS}, {ASKED}, p AS (SELECT q.user_id, q.t, count(e.t) AS n, coalesce(sum(exp(-0.05 * (q.t - e.t))), 0) AS d FROM q LEFT JOIN e ON e.user_id = q.user_id AND e.t < q.t GROUP BY 1, 2)"


@query(f"WITH {PAST} SELECT user_id, t::DOUBLE AS t, round(0.02 + 0.01 * d, 6) AS rate FROM p")
def hawkes_intensities(spark, sf_dir):
    return EXCITED.intensity(sequences(spark, sf_dir), asked(spark, sf_dir), ["user_id"]).select("user_id", "t", r6("rate").alias("rate"))


@query(f"WITH {PAST} SELECT user_id, t::DOUBLE AS t, round(0.02 * t + 0.2 * (n - d), 6) AS compensator FROM p")
def hawkes_cumulative_intensities(spark, sf_dir):
    return EXCITED.cumulative_intensity(sequences(spark, sf_dir), asked(spark, sf_dir), ["user_id"]).select("user_id", "t", r6("compensator").alias("compensator"))


OWN = f"{EVENTS}, o AS (SELECT a.user_id, a.event_id, a.t, count(b.t) AS n, coalesce(sum(exp(-0.05 * (a.t - b.t))), 0) AS d FROM e a LEFT JOIN e b ON a.user_id = b.user_id AND b.t < a.t GROUP BY 1, 2, 3)"


@query(f"WITH {OWN}, {USERS}, s AS (SELECT user_id, count(*) AS n, sum(ln(0.02 + 0.01 * d)) AS ll, sum(1 - exp(-0.05 * (600 - t))) AS k FROM o WHERE t < 600 GROUP BY 1) SELECT w.user_id, coalesce(n, 0) AS n, round(coalesce(ll, 0) - 12 - 0.2 * coalesce(k, 0), 5) AS log_lik FROM w LEFT JOIN s USING (user_id)")
def hawkes_window_log_likelihood(spark, sf_dir):
    found = EXCITED.log_prob(sequences(spark, sf_dir), users(spark, sf_dir).withColumn("t1", F.lit(600.0)), ["user_id"])
    return found.select("user_id", "n", F.round("log_lik", 5).alias("log_lik"))


@query(f"WITH {OWN}, c AS (SELECT user_id, t, 0.02 * t + 0.2 * (n - d) AS c FROM o), r AS (SELECT user_id, c - coalesce(lag(c) OVER (PARTITION BY user_id ORDER BY t), 0) AS r FROM c), k AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY r) AS i, count(*) OVER (PARTITION BY user_id) AS n FROM r) SELECT user_id, n, round(max(greatest(i / n - 1 + exp(-r), 1 - exp(-r) - (i - 1) / n)), 5) AS ks FROM k GROUP BY 1, 2")
def hawkes_goodness_of_fit(spark, sf_dir):
    return EXCITED.goodness_of_fit(sequences(spark, sf_dir), ["user_id"]).select("user_id", "n", F.round("ks", 5).alias("ks"))


@query(f"WITH {OWN}, m AS (SELECT user_id, t, max(0.02 + 0.01 * d) + 0.01 * count(*) AS most FROM o GROUP BY 1, 2) SELECT user_id, round(max(most), 6) AS most FROM m GROUP BY 1")
def hawkes_lambda_max(spark, sf_dir):
    return EXCITED.lambda_max(sequences(spark, sf_dir), ["user_id"]).select("user_id", r6("most").alias("most"))


TRIANGLE = P.GeneralHawkes(0.02, lambda d: 0.01 * (1 - d / 48.0), lambda d: 0.01 * (d - d * d / 96.0), 48.0)
BAND = f"{EVENTS}, {ASKED}, p AS (SELECT q.user_id, q.t, coalesce(sum(CASE WHEN q.t - e.t <= 48 THEN 0.01 * (1 - (q.t - e.t) / 48) END), 0) AS r, coalesce(sum(CASE WHEN e.t IS NOT NULL THEN 0.01 * (least(q.t - e.t, 48) - pow(least(q.t - e.t, 48), 2) / 96) END), 0) AS c FROM q LEFT JOIN e ON e.user_id = q.user_id AND e.t < q.t GROUP BY 1, 2)"


@query(f"WITH {BAND} SELECT user_id, t::DOUBLE AS t, round(0.02 + r, 6) AS rate, round(0.02 * t + c, 6) AS compensator FROM p")
def general_hawkes_at_times(spark, sf_dir):
    e, q = sequences(spark, sf_dir), asked(spark, sf_dir)
    both = TRIANGLE.cumulative_intensity(e, TRIANGLE.intensity(e, q, ["user_id"]), ["user_id"])
    return both.select("user_id", "t", r6("rate").alias("rate"), r6("compensator").alias("compensator"))


@query(f"""WITH {EVENTS}, {USERS}, o AS (SELECT a.user_id, a.event_id, a.t, 0.02 + coalesce(sum(0.01 * (1 - (a.t - b.t) / 48)), 0) AS r FROM e a LEFT JOIN e b ON a.user_id = b.user_id AND b.t < a.t AND a.t - b.t <= 48 WHERE a.t < 600 GROUP BY 1, 2, 3),
s AS (SELECT user_id, count(*) AS n, sum(ln(r) - 0.01 * (least(600 - t, 48) - pow(least(600 - t, 48), 2) / 96)) AS s FROM o GROUP BY 1) SELECT w.user_id, coalesce(n, 0) AS n, round(coalesce(s, 0) - 12, 5) AS log_lik FROM w LEFT JOIN s USING (user_id)""")
def general_hawkes_log_likelihood(spark, sf_dir):
    found = TRIANGLE.log_prob(sequences(spark, sf_dir), users(spark, sf_dir).withColumn("t1", F.lit(600.0)), ["user_id"])
    return found.select("user_id", "n", F.round("log_lik", 5).alias("log_lik"))


# space: order lines as points by quantity and discount, a supplier's lines a pattern

PLANE = S.Box((0.0, 0.0), (40.0, 0.08))
LINES = "p AS (SELECT l_suppkey AS k, l_quantity::DOUBLE AS x, l_discount::DOUBLE AS y, l_partkey::DOUBLE AS m FROM lineitem)"


def lines(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("k"), F.col("l_quantity").cast("double").alias("x"), F.col("l_discount").cast("double").alias("y"), F.col("l_partkey").cast("double").alias("m"))


def suppliers(spark, sf_dir):
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"))


@query(f"WITH {LINES} SELECT s_suppkey AS k, count(p.k) AS n, round(count(p.k) * ln(120.0) - 384, 5) AS log_lik, round(count(p.k) * ln(384.0) - 384 - lgamma(count(p.k) + 1), 5) AS count_log_prob FROM supplier LEFT JOIN p ON p.k = s_suppkey AND x >= 0 AND x < 40 AND y >= 0 AND y < 0.08 GROUP BY 1")
def hpp_spatial_log_likelihood(spark, sf_dir):
    found = S.HomogeneousSpatial(120.0, PLANE).log_prob(lines(spark, sf_dir), suppliers(spark, sf_dir), ["k"], ["x", "y"])
    return found.select("k", "n", F.round("log_lik", 5).alias("log_lik"), F.round("count_log_prob", 5).alias("count_log_prob"))


SLOPE = S.InhomogeneousSpatial(lambda x, y: 4.0 + 0.02 * x - 3.0 * y, PLANE, 64)
GRID = "g AS (SELECT sum(exp(4 + 0.02 * (i + 0.5) * 40 / 64 - 3 * (j + 0.5) * 0.08 / 64)) * 3.2 / 4096 AS m FROM range(64) a(i), range(64) b(j))"


@query(f"WITH {LINES}, {GRID} SELECT s_suppkey AS k, count(p.k) AS n, round(coalesce(sum(4 + 0.02 * x - 3 * y), 0) - max(g.m), 5) AS log_lik FROM supplier LEFT JOIN p ON p.k = s_suppkey AND x >= 0 AND x < 40 AND y >= 0 AND y < 0.08, g GROUP BY 1")
def ipp_spatial_log_likelihood(spark, sf_dir):
    return SLOPE.log_prob(lines(spark, sf_dir), suppliers(spark, sf_dir), ["k"], ["x", "y"]).select("k", "n", F.round("log_lik", 5).alias("log_lik"))


@query(f"WITH {LINES}, {GRID} SELECT k, round(sum(-ln(0.5) - abs(m - 100 * x) / 0.5), 3) AS mark_ll, round(sum(4 + 0.02 * x - 3 * y - ln(0.5) - abs(p.m - 100 * x) / 0.5), 3) AS with_ground FROM p GROUP BY 1")
def spatial_marks_log_likelihood(spark, sf_dir):
    density = -math.log(0.5) - F.abs(F.col("m") - 100 * F.col("x")) / 0.5
    p = lines(spark, sf_dir)
    ground = p.groupBy("k").agg(F.sum(SLOPE.log_intensity(F.col("x"), F.col("y"))).alias("g"))
    return S.spatial_marks_log_prob(p, ["k"], density).join(ground, "k").select("k", F.round("mark_ll", 3).alias("mark_ll"), F.round(F.col("mark_ll") + F.col("g"), 3).alias("with_ground"))


@query("""SELECT i::DOUBLE / 10 AS r, round(2 * i / 10.0, 6) AS k1, round(pi() * pow(i / 10.0, 2), 6) AS k2, round(4.0 / 3 * pi() * pow(i / 10.0, 3), 6) AS k3, round(i / 10.0, 6) AS l2, round(i / 10.0, 6) AS l4, 1.0::DOUBLE AS g,
round(0.5 / sqrt(120.0), 6) AS nearest, 120.0 * 10 * 0.02 AS expected FROM (SELECT p_partkey % 50 + 1 AS i FROM part) t""")
def spatial_randomness(spark, sf_dir):
    r, m = F.col("r"), S.HomogeneousSpatial(120.0, PLANE)
    mean, _ = m.predict_count(S.Box((5.0, 0.01), (15.0, 0.03)))
    cols = {"k1": r6(S.ripleys_k(r, 1)), "k2": r6(S.ripleys_k(r, 2)), "k3": r6(S.ripleys_k(r, 3)), "l2": r6(S.l_function(r, 2)), "l4": r6(S.l_function(r, 4)), "g": S.pair_correlation(r, 2), "nearest": F.round(F.lit(m.nearest_neighbor_distance()), 6), "expected": F.round(F.lit(mean), 6)}
    return spread(spark, sf_dir, 1, 51).select((F.col("id") / 10.0).alias("r")).select("r", *[c.alias(n) for n, c in cols.items()])


# space and time: events by value and hour, an event type a pattern

FIELD = S.span_box(S.Box((0.0,), (200.0,)), 0.0, 720.0)
DRIFT = S.InhomogeneousSpatial(lambda x, t: -3.0 - 0.01 * x + 0.001 * t, FIELD, 48)
SPOTS = f"p AS (SELECT event_type AS k, value AS x, {T} AS t FROM events), c AS (SELECT * FROM p WHERE x >= 0 AND x < 200 AND t >= 0 AND t < 720)"


def spots(spark, sf_dir):
    return hours(spark, sf_dir).select(F.col("event_type").alias("k"), F.col("value").alias("x"), "t")


@query(f"WITH {SPOTS}, g AS (SELECT sum(exp(-3 - 0.01 * (i + 0.5) * 200 / 48 + 0.001 * (j + 0.5) * 15)) * 144000 / 2304 AS m FROM range(48) a(i), range(48) b(j)) SELECT k, count(*) AS n, round(sum(-3 - 0.01 * x + 0.001 * t) - max(m), 4) AS log_lik, round(count(*) * ln(0.01) - 1440, 4) AS constant FROM c, g GROUP BY 1")
def spatiotemporal_log_likelihood(spark, sf_dir):
    p = spots(spark, sf_dir)
    found = DRIFT.log_prob(p, p, ["k"], ["x", "t"])
    flat = S.HomogeneousSpatial(0.01, FIELD).log_prob(p, p, ["k"], ["x", "t"]).select("k", F.round("log_lik", 4).alias("constant"))
    return found.join(flat, "k").select("k", "n", F.round("log_lik", 4).alias("log_lik"), "constant")


CELLS = """u AS (SELECT i * 6 + j AS cell, (SELECT sum(exp(-3 - 0.01 * (i + (a + 0.5) / 8) * 50 + 0.001 * (j + (b + 0.5) / 8) * 120)) * 6000 / 64 FROM range(8) q(a), range(8) r(b)) AS expected FROM range(4) s(i), range(6) v(j)),
n AS (SELECT least(floor(x / 50), 3)::BIGINT * 6 + least(floor(t / 120), 5)::BIGINT AS cell, count(*) AS n FROM c GROUP BY 1), f AS (SELECT cell, coalesce(n, 0) AS n, expected, (coalesce(n, 0) - expected) / sqrt(expected) AS pearson FROM u LEFT JOIN n USING (cell))"""


@query(f"WITH {SPOTS}, {CELLS} SELECT cell, n, round(expected, 5) AS expected, round(pearson, 5) AS pearson FROM f")
def spatiotemporal_pearson_residuals(spark, sf_dir):
    return DRIFT.cells(spots(spark, sf_dir), ["x", "t"], [4, 6]).select("cell", "n", F.round("expected", 5).alias("expected"), F.round("pearson", 5).alias("pearson"))


@query(f"WITH {SPOTS}, {CELLS} SELECT round(sum(pearson * pearson), 3) AS chi_square, count(*) AS cells FROM f")
def spatiotemporal_chi_square(spark, sf_dir):
    return DRIFT.chi_square(spots(spark, sf_dir), ["x", "t"], [4, 6]).select(F.round("chi_square", 3).alias("chi_square"), "cells")


@query("""WITH q AS (SELECT s_suppkey AS k, s_nationkey * 25.0 AS t, s_nationkey * 7.0 AS x FROM supplier)
SELECT k, round((SELECT sum(exp(-3 - 0.01 * (i + 0.5) * 200 / 48 + 0.001 * q.t)) * 200 / 48 FROM range(48) r(i)), 6) AS in_time, round((SELECT sum(exp(-3 - 0.01 * q.x + 0.001 * (i + 0.5) * 15)) * 15 FROM range(48) r(i)), 6) AS in_space FROM q""")
def spatiotemporal_marginals(spark, sf_dir):
    q = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), (F.col("s_nationkey") * 25.0).alias("t"), (F.col("s_nationkey") * 7.0).alias("x"))
    time = DRIFT.marginal_temporal_intensity(spark, q).withColumnRenamed("rate", "in_time")
    return DRIFT.marginal_spatial_intensity(time, ["x"]).select("k", r6("in_time").alias("in_time"), r6("rate").alias("in_space"))


@query("SELECT i AS node, round((i + 0.5) * 12.5, 6) AS x, round(exp(-3 - 0.01 * (i + 0.5) * 12.5 + 0.36), 6) AS rate FROM range(16) t(i)")
def spatiotemporal_surface(spark, sf_dir):
    return DRIFT.surface_at(spark, 360.0, 16, ["x"]).select("node", r6("x").alias("x"), r6("rate").alias("rate"))


CLUSTERED = S.SpatioTemporalHawkes(0.002, 0.3, 2.0, 10.0, S.Box((0.0,), (200.0,)), 0.0, 720.0)
SPREAD = f"""{SPOTS}, o AS (SELECT x, t, row_number() OVER () AS i FROM c), r AS (SELECT a.i, 0.002 + coalesce(sum(0.3 * 2 * exp(-2 * (a.t - b.t)) * exp(-pow(a.x - b.x, 2) / 200) / (10 * sqrt(2 * pi()))), 0) AS rate FROM o a LEFT JOIN o b ON b.t < a.t AND a.t - b.t < 18.5 AND abs(a.x - b.x) < 90 GROUP BY 1)"""


@query(f"WITH {SPREAD}, s AS (SELECT x, t, round(rate, 6) AS rate FROM r JOIN o USING (i)) SELECT round(x, 6) AS x, round(t, 6) AS t, rate FROM s")
def spatiotemporal_hawkes_intensities(spark, sf_dir):
    p = spots(spark, sf_dir).where(FIELD.contains(F.col("x"), F.col("t"))).select("x", "t")
    return CLUSTERED.intensity(p, p, ["x"]).select(r6("x").alias("x"), r6("t").alias("t"), r6("rate").alias("rate"))


@query(f"WITH {SPREAD} SELECT count(*) AS n, round(sum(ln(rate)), 3) AS sum_log_rate, round(0.002 * 144000 + 0.3 * (SELECT sum(1 - exp(-2 * (720 - t))) FROM o), 3) AS compensator FROM r")
def spatiotemporal_hawkes_log_likelihood(spark, sf_dir):
    p = spots(spark, sf_dir).where(FIELD.contains(F.col("x"), F.col("t"))).select("x", "t")
    return CLUSTERED.log_prob(p, ["x"], boundary=False).select("n", F.round("sum_log_rate", 3).alias("sum_log_rate"), F.round("compensator", 3).alias("compensator"))
