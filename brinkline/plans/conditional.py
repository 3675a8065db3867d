"""Registered queries of quadrature, of what depends on a sequence's history, and of thinned processes."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from brinkline.functions.special import log_poisson_cdf, log_poisson_sf, safe_ln
from brinkline.operators import processes as P
from brinkline.operators import quadrature as Q
from brinkline.operators import spatial as S
from brinkline.operators.history import History, history_at, marked_log_prob, marks_log_prob, with_history
from brinkline.operators.thinning import Thinned
from brinkline.plans.catalogue import HOURS, T, dealt, hours, query, r6, table
from brinkline.plans.models import ASKED, EVENTS, RATE, USERS, WAVE, asked, windows
from brinkline.plans.models import _mass as mass

MARKED = f"e AS (SELECT user_id, event_id, {T} AS t, value AS m FROM events)"
PAST = """h AS (SELECT *, row_number() OVER o - 1 AS n, lag(t) OVER o AS lt, lag(m) OVER o AS lm, coalesce(sum(m) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s
FROM e WINDOW o AS (PARTITION BY user_id ORDER BY t, event_id))"""


def marked(spark, sf_dir):
    return hours(spark, sf_dir).select("user_id", "event_id", "t", F.col("value").alias("m"))


@query("""WITH a AS (SELECT s_suppkey, pow(10, s_suppkey % 7) AS m, (s_nationkey - 12) / 3.0 AS z FROM supplier), b AS (SELECT *, greatest(floor(m + z * sqrt(m)), 0)::BIGINT AS k, (10 * sqrt(m) + 100)::BIGINT AS w FROM a),
c AS (SELECT *, list_sum(list_transform(range(greatest(k - w, 0), k + 1), lambda j: exp(j * ln(m) - m - lgamma(j + 1)))) AS p, list_sum(list_transform(range(k + 1, k + w), lambda j: exp(j * ln(m) - m - lgamma(j + 1)))) AS q FROM b)
SELECT s_suppkey, k, round(CASE WHEN k + 1 < m THEN ln(p) ELSE ln(1 - q) END, 4) AS log_cdf, round(CASE WHEN k + 1 >= m THEN ln(q) ELSE ln(1 - p) END, 4) AS log_sf FROM c""")
def poisson_tails(spark, sf_dir):
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", F.pow(F.lit(10.0), F.col("s_suppkey") % 7).alias("m"), ((F.col("s_nationkey") - 12) / 3.0).alias("z"))
    k = F.greatest(F.floor(F.col("m") + F.col("z") * F.sqrt("m")), F.lit(0)).cast("long")
    return rows.select("s_suppkey", k.alias("k"), F.round(log_poisson_cdf(k, F.col("m")), 4).alias("log_cdf"), F.round(log_poisson_sf(k, F.col("m")), 4).alias("log_sf"))


_STEP = "((5 + n) / 100)"
_SIMPSON = f"{_STEP} / 3 * (list_sum(list_transform(range(1, 100), lambda i: CASE WHEN i % 2 = 1 THEN 4 ELSE 2 END * {RATE.format(f'5 + i * {_STEP}')})) + {RATE.format('5')} + {RATE.format('10 + n')})"


@query(f"WITH a AS (SELECT s_suppkey, s_nationkey::DOUBLE AS n FROM supplier) SELECT s_suppkey, round({mass('5', '(10 + n)')}, 9) AS trapezoid, round({_SIMPSON}, 9) AS simpson FROM a")
def interval_rules(spark, sf_dir):
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", (10 + F.col("s_nationkey").cast("double")).alias("hi"))
    rate, lo = WAVE.intensity, F.lit(5.0)
    return rows.select("s_suppkey", F.round(Q.trapezoid(rate, lo, F.col("hi"), 100), 9).alias("trapezoid"), F.round(Q.simpson(rate, lo, F.col("hi"), 101), 9).alias("simpson"))


def inverse_sql(i: str, base: int, most: int) -> str:
    digits = 1 + int(math.log(most, base) + 1e-9)
    return "(" + " + ".join(f"({i} // {base**k}) % {base} / {base ** (k + 1)}.0" for k in range(digits)) + ")"


_X, _Y, _Z = (inverse_sql("i", p, 512) for p in (2, 3, 5))


@query(f"""WITH a AS (SELECT s_suppkey, 1 + s_nationkey / 10.0 AS b, 1 + (s_suppkey % 7) / 3.0 AS c FROM supplier)
SELECT s_suppkey, round(b * c / 512 * list_sum(list_transform(range(1, 513), lambda i: exp(-b * {_X} - 0.5 * c * {_Y}))), 7) AS plane,
round(b * c * 2 / 512 * list_sum(list_transform(range(1, 513), lambda i: exp(-b * {_X} - 0.5 * c * {_Y}) * cos(2 * {_Z} - 1))), 7) AS space FROM a""")
def halton_box_integrals(spark, sf_dir):
    rows = dealt(table(spark, sf_dir, "supplier")).select("s_suppkey", (1 + F.col("s_nationkey") / 10.0).alias("b"), (1 + (F.col("s_suppkey") % 7) / 3.0).alias("c"))
    plane = Q.box_integral(lambda x, y: F.exp(-x - 0.5 * y), [0.0, 0.0], [F.col("b"), F.col("c")], 512)
    space = Q.box_integral(lambda x, y, z: F.exp(-x - 0.5 * y) * F.cos(z), [0.0, 0.0, -1.0], [F.col("b"), F.col("c"), 1.0], 512)
    return rows.select("s_suppkey", F.round(plane, 7).alias("plane"), F.round(space, 7).alias("space"))


CUBE = S.Box((0.0, 0.0, 0.0), (51.0, 0.11, 0.09))
BLOCK = S.InhomogeneousSpatial(lambda q, d, x: 9.0 + 0.01 * q - 2.0 * d + 3.0 * x, CUBE, points=4096)
_U = [inverse_sql("i", p, 4096) for p in (2, 3, 5)]


@query(f"""WITH m AS (SELECT 51 * 0.11 * 0.09 / 4096 * sum(exp(9 + 0.01 * 51 * {_U[0]} - 2 * 0.11 * {_U[1]} + 3 * 0.09 * {_U[2]})) AS m FROM range(1, 4097) r(i))
SELECT l_returnflag, count(*) AS n, round(sum(9 + 0.01 * l_quantity - 2 * l_discount + 3 * l_tax) - max(m), 3) AS log_lik, round(max(m), 6) AS expected FROM lineitem, m WHERE l_quantity < 51 AND l_discount < 0.11 AND l_tax < 0.09 GROUP BY 1""")
def halton_pattern_log_likelihood(spark, sf_dir):
    points = table(spark, sf_dir, "lineitem").select("l_returnflag", "l_quantity", "l_discount", "l_tax")
    found = BLOCK.log_prob(points, points.select("l_returnflag"), ["l_returnflag"], ["l_quantity", "l_discount", "l_tax"])
    return found.select("l_returnflag", "n", F.round("log_lik", 3).alias("log_lik"), F.round(F.lit(BLOCK.expected(spark)), 6).alias("expected"))


@query(f"WITH {MARKED}, {PAST} SELECT event_id, n AS n_before, round(lt, 6) AS last_t, round(lm, 6) AS last_mark, round(s, 3) AS mark_sum, round(t - coalesce(lt, 0), 6) AS since FROM h")
def event_history(spark, sf_dir):
    past = History.of()
    rows = with_history(marked(spark, sf_dir), ["user_id"], ["t", "event_id"], "m")
    return rows.select("event_id", past.n.alias("n_before"), r6(past.last_t).alias("last_t"), r6(past.last_mark).alias("last_mark"), F.round(past.mark_sum, 3).alias("mark_sum"), r6(past.time_since_last(F.col("t"))).alias("since"))


@query(f"""WITH {MARKED}, {ASKED}, c AS (SELECT q.user_id, q.t, count(e.t) AS n, sum(e.m) AS s, arg_max(e.t, (e.t, e.event_id)) AS lt, arg_max(e.m, (e.t, e.event_id)) AS lm FROM q LEFT JOIN e ON e.user_id = q.user_id AND e.t < q.t GROUP BY 1, 2)
SELECT user_id, t::DOUBLE AS t, n AS n_before, round(lt, 6) AS last_t, round(lm, 6) AS last_mark, round(coalesce(s, 0), 3) AS mark_sum FROM c""")
def history_at_times(spark, sf_dir):
    found = history_at(marked(spark, sf_dir), asked(spark, sf_dir), ["user_id"], ["t", "event_id"], "m")
    return found.select("user_id", "t", "n_before", r6("last_t").alias("last_t"), r6("last_mark").alias("last_mark"), F.round("mark_sum", 3).alias("mark_sum"))


def following(t, mark, past: History):
    """ln m is normal around half of the last ln m, the wider the longer ago that was; marks of 0 have a ln of -inf and count."""
    centre = F.coalesce(0.5 * safe_ln(past.last_mark), F.lit(1.0)) + 0.001 * past.mean_mark()
    width = 1.0 + 0.01 * past.time_since_last(t)
    z = (safe_ln(mark) - centre) / width
    return -0.5 * z * z - safe_ln(width * mark) - 0.5 * math.log(2 * math.pi)


_WIDTH, _CENTRE = "(1 + 0.01 * (t - coalesce(lt, 0)))", "(coalesce(0.5 * ln(lm), 1.0) + 0.001 * CASE WHEN n > 0 THEN s / n ELSE 0 END)"
_DENSITY = f"(-0.5 * pow((ln(m) - {_CENTRE}) / {_WIDTH}, 2) - ln({_WIDTH} * m) - 0.5 * ln(2 * pi()))"


@query(f"WITH {MARKED}, {PAST} SELECT user_id, count(*) AS n, round(sum({_DENSITY}), 5) AS mark_ll FROM h GROUP BY 1")
def history_marks_log_prob(spark, sf_dir):
    return marks_log_prob(marked(spark, sf_dir), ["user_id"], following, "m", ["t", "event_id"]).select("user_id", "n", F.round("mark_ll", 5).alias("mark_ll"))


@query(f"WITH {MARKED}, {PAST}, {USERS} SELECT w.user_id, count(t) AS n, round(coalesce(sum({_DENSITY}), 0) + count(t) * ln(0.1) - 72, 5) AS log_lik FROM w LEFT JOIN h ON h.user_id = w.user_id GROUP BY 1")
def history_marked_process(spark, sf_dir):
    events = marked(spark, sf_dir)
    ground = P.HomogeneousPoisson(0.1).log_prob(events, windows(spark, sf_dir), ["user_id"])
    return marked_log_prob(ground, events, ["user_id"], following, "m", ["t", "event_id"]).select("user_id", "n", F.round("log_lik", 5).alias("log_lik"))


def rested(t, mark, past: History):
    """Less likely to be kept right behind an event."""
    return 1.0 - 0.5 * F.exp(-past.time_since_last(t, -1000.0) / 20.0)


_KEEP = "(1 - 0.5 * exp(-({t} - coalesce(lt, -1000)) / 20))"


@query(f"""WITH {EVENTS}, {USERS}, h AS (SELECT *, lag(t) OVER (PARTITION BY user_id ORDER BY t, event_id) AS lt FROM e), i AS (SELECT * FROM h WHERE t >= 50 AND t < 650),
b AS (SELECT w.user_id, count(t) AS n, coalesce(sum(-2.5 + 0.5 * sin(t / 100)), 0) AS ll, coalesce(sum(ln({_KEEP.format(t='t')})), 0) AS keep FROM w LEFT JOIN i ON i.user_id = w.user_id GROUP BY 1),
g AS (SELECT user_id, 50 + i * 600 / 99.0 AS t, CASE WHEN i IN (0, 99) THEN 0.5 ELSE 1 END * 600 / 99.0 AS step FROM w, range(0, 100) r(i)),
a AS (SELECT g.user_id, g.t, any_value(step) AS step, max(e.t) AS lt FROM g LEFT JOIN e ON e.user_id = g.user_id AND e.t < g.t GROUP BY 1, 2),
d AS (SELECT user_id, sum(step * (1 - {_KEEP.format(t='t')}) * {RATE.format('t')}) AS d FROM a GROUP BY 1), m AS (SELECT {mass('50', '650')} AS m)
SELECT b.user_id, n, round(keep, 5) AS log_retention, round(d, 5) AS discarded, round(ll - m + keep + d, 5) AS log_lik FROM b JOIN d ON d.user_id = b.user_id, m""")
def thinned_poisson_log_prob(spark, sf_dir):
    model = Thinned(WAVE, rested)
    found = model.log_prob(marked(spark, sf_dir), windows(spark, sf_dir, 50.0, 650.0), ["user_id"], ["t", "event_id"])
    return found.select("user_id", "n", *[F.round(c, 5).alias(c) for c in ("log_retention", "discarded", "log_lik")])


EXCITED = P.ExponentialHawkes(0.05, 0.2, 0.5)
_FADE = "exp(-0.5 * ({t} - e.t))"


@query(f"""WITH {MARKED}, {USERS},
i AS (SELECT x.user_id, x.event_id, x.t, x.m, 0.05 + 0.2 * coalesce(sum({_FADE.format(t='x.t')}), 0) AS rate FROM e x LEFT JOIN e ON e.user_id = x.user_id AND e.t < x.t GROUP BY 1, 2, 3, 4),
b AS (SELECT w.user_id, count(t) AS n, coalesce(sum(ln(rate) - 0.4 * (1 - exp(-0.5 * ({HOURS} - t)))), 0) - 0.05 * {HOURS} AS ll, coalesce(sum(ln(exp(-m / 500))), 0) AS keep FROM w LEFT JOIN i ON i.user_id = w.user_id GROUP BY 1),
g AS (SELECT user_id, i * {HOURS} / 59 AS t, CASE WHEN i IN (0, 59) THEN 0.5 ELSE 1 END * {HOURS} / 59 AS step FROM w, range(0, 60) r(i)),
a AS (SELECT g.user_id, g.t, any_value(step) AS step, 0.05 + 0.2 * coalesce(sum({_FADE.format(t='g.t')}), 0) AS rate, CASE WHEN count(e.t) > 0 THEN exp(-sum(e.m) / count(e.t) / 500) ELSE 0.9 END AS p FROM g LEFT JOIN e ON e.user_id = g.user_id AND e.t < g.t GROUP BY 1, 2),
d AS (SELECT user_id, sum(step * (1 - p) * rate) AS d FROM a GROUP BY 1)
SELECT b.user_id, n, round(keep, 5) AS log_retention, round(d, 5) AS discarded, round(ll + keep + d, 5) AS log_lik FROM b JOIN d ON d.user_id = b.user_id""")
def thinned_hawkes_log_prob(spark, sf_dir):
    by_mark = lambda t, m, past: F.exp(-m / 500.0)
    at_mean = lambda t, m, past: F.when(past.n > 0, F.exp(-past.mean_mark() / 500.0)).otherwise(0.9)
    found = Thinned(EXCITED, by_mark, at_mean, nodes=60).log_prob(marked(spark, sf_dir), windows(spark, sf_dir), ["user_id"], ["t", "event_id"], "m")
    return found.select("user_id", "n", *[F.round(c, 5).alias(c) for c in ("log_retention", "discarded", "log_lik")])
