"""Registered queries of masks, polygons and grids, and of the intervals estimator."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from brinkline.operators import decluster, dependence, estimation, features, masks, raster, thresholds
from brinkline.operators.positions import dealt_by_size
from brinkline.operators.quantile_regression import threshold_by_key, with_covariates
from brinkline.plans.catalogue import ISLANDS, T, exceeding, hours, query, r6, table

CORNERS = "c AS (SELECT r_regionkey, j, 50.123 + (20 + 2 * r_regionkey) * (CASE WHEN j % 2 = 0 THEN 1 ELSE 0.45 END) * cos(2 * pi() * j / (6 + 2 * r_regionkey) + 0.1) AS x, 25.4567 + (12 + r_regionkey) * (CASE WHEN j % 2 = 0 THEN 1 ELSE 0.45 END) * sin(2 * pi() * j / (6 + 2 * r_regionkey) + 0.1) AS y FROM region, range(0, 6 + 2 * r_regionkey) r(j))"
EDGES = "d AS (SELECT a.r_regionkey, a.x AS x1, a.y AS y1, b.x AS x2, b.y AS y2 FROM c a JOIN c b ON b.r_regionkey = a.r_regionkey AND b.j = (a.j + 1) % (6 + 2 * a.r_regionkey))"


@query(f"""WITH {CORNERS}, {EDGES}, p AS (SELECT DISTINCT l_extendedprice / 1000 AS px, l_quantity AS py FROM lineitem),
i AS (SELECT r_regionkey, px, py FROM p, d WHERE (y1 > py) <> (y2 > py) AND px < x1 + (py - y1) / (y2 - y1) * (x2 - x1) GROUP BY 1, 2, 3 HAVING count(*) % 2 = 1)
SELECT r_regionkey, count(*) AS n, round(sum(px), 3) AS sum_x, sum(py)::DOUBLE AS sum_y, min(px) AS low_x, max(py) AS high_y FROM i GROUP BY 1""")
def polygon_masks(spark, sf_dir):
    """Stars around the middle of the line items' plane of price and quantity, one a region."""
    n = 6 + 2 * F.col("r_regionkey")
    corners = table(spark, sf_dir, "region").select("r_regionkey", F.explode(F.sequence(F.lit(0).cast("long"), n - 1)).alias("j"))
    inner, angle = F.when(F.col("j") % 2 == 0, 1.0).otherwise(0.45), 2 * math.pi * F.col("j") / n + 0.1
    corners = corners.select("r_regionkey", "j", (50.123 + (20 + 2 * F.col("r_regionkey")) * inner * F.cos(angle)).alias("x"), (25.4567 + (12 + F.col("r_regionkey")) * inner * F.sin(angle)).alias("y"))
    items = table(spark, sf_dir, "lineitem").select((F.col("l_extendedprice") / 1000).alias("px"), F.col("l_quantity").alias("py"))
    points = dealt_by_size(items, ["px", "py"], items.count()).distinct()
    found = masks.in_polygons(points, masks.polygon_edges(corners, "r_regionkey", "j"), ["px", "py"], "r_regionkey", 2.0, "px", "py")
    return found.groupBy("r_regionkey").agg(F.count("*").alias("n"), F.round(F.sum("px"), 3).alias("sum_x"), F.sum("py").alias("sum_y"), F.min("px").alias("low_x"), F.max("py").alias("high_y"))


_GAPPY = "g AS (SELECT event_id, user_id, date_trunc('day', ts) AS d, month(ts) AS month, event_type, CASE WHEN event_id % 7 IN (0, 3) THEN NULL ELSE value END AS v FROM events)"


def gappy(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.select("event_id", "user_id", "ts", "event_type", F.when(~(F.col("event_id") % 7).isin([0, 3]), F.col("value")).alias("v"))


@query(f"""WITH {_GAPPY}, k AS (SELECT user_id, d, count(v) / count(*) >= 0.7 AS covered FROM g GROUP BY 1, 2)
SELECT event_id, covered, round(CASE WHEN covered AND event_type IN ('click', 'view', 'purchase') AND month IN (12, 1, 2) AND v BETWEEN 5 AND 300 THEN v END, 6) AS v FROM g JOIN k USING (user_id, d)""")
def combined_masks(spark, sf_dir):
    rows = masks.coverage_mask(gappy(spark, sf_dir), ["user_id"], F.date_trunc("day", "ts"), 0.7, "v")
    mask = masks.combine_masks(F.col("covered"), masks.quality_mask(F.col("event_type"), ["click", "view", "purchase"]), masks.seasonal_mask(F.col("ts"), ["DJF"]), masks.band_mask(F.col("v"), 5.0, 300.0))
    return masks.apply_mask(rows, mask, ["v"]).select("event_id", "covered", r6("v").alias("v"))


@query(f"""WITH {_GAPPY}, k AS (SELECT user_id, d, count(v) AS n, count(v) / count(*) >= 0.7 AS ok FROM g GROUP BY 1, 2)
SELECT user_id, count(*) FILTER (ok) AS n_valid_blocks, count(*) AS n_blocks, round(count(*) FILTER (ok) / count(*), 9) AS valid_fraction, sum(n)::BIGINT AS n_valid FROM k GROUP BY 1""")
def coverage_by_user(spark, sf_dir):
    found = masks.coverage_summary(gappy(spark, sf_dir), ["user_id"], F.date_trunc("day", "ts"), 0.7, "v")
    return found.withColumn("valid_fraction", F.round("valid_fraction", 9))


ROWS, COLS = 50, 11
_BINS = "b AS (SELECT l_returnflag AS k, floor(l_quantity)::BIGINT - 1 AS r, round(l_discount * 100)::BIGINT AS c, avg(l_extendedprice) / 1000 AS v FROM lineitem GROUP BY 1, 2, 3)"
_GRID = f"{_BINS}, s AS (SELECT k, i AS r, j AS c FROM (SELECT DISTINCT k FROM b), range(0, {ROWS}) a(i), range(0, {COLS}) q(j)), g AS (SELECT s.k, s.r, s.c, coalesce(v, 0) AS v FROM s LEFT JOIN b ON b.k = s.k AND b.r = s.r AND b.c = s.c)"


def grid(spark, sf_dir, whole=True):
    items = table(spark, sf_dir, "lineitem").withColumnRenamed("l_returnflag", "k")
    cells = raster.binned(items, ["k"], F.floor("l_quantity") - 1, F.round(F.col("l_discount") * 100), F.avg("l_extendedprice") / 1000)
    return raster.dense(cells, ["k"], ROWS, COLS).withColumn("value", F.coalesce("value", F.lit(0.0))) if whole else cells


_AXIS = "CASE WHEN {a}.v IS NOT NULL AND {b}.v IS NOT NULL THEN ({a}.v - {b}.v) / 2 WHEN {a}.v IS NOT NULL THEN {a}.v - h.v ELSE h.v - {b}.v END / 0.5"


@query(f"""WITH {_BINS}, f AS (SELECT * FROM b WHERE (r * 7 + c) % 13 <> 0),
x AS (SELECT h.k, h.r, h.c, {_AXIS.format(a="s", b="n")} AS dy, {_AXIS.format(a="e", b="w")} AS dx FROM f h LEFT JOIN f s ON s.k = h.k AND s.r = h.r + 1 AND s.c = h.c LEFT JOIN f n ON n.k = h.k AND n.r = h.r - 1 AND n.c = h.c
LEFT JOIN f e ON e.k = h.k AND e.r = h.r AND e.c = h.c + 1 LEFT JOIN f w ON w.k = h.k AND w.r = h.r AND w.c = h.c - 1)
SELECT k, r, c, round(degrees(atan(sqrt(dx * dx + dy * dy))), 6) AS slope, round(sin(atan2(-dx, dy)), 6) AS aspect_sin, round(cos(atan2(-dx, dy)), 6) AS aspect_cos FROM x""")
def raster_slope(spark, sf_dir):
    cells = grid(spark, sf_dir, whole=False).where((F.col("row") * 7 + F.col("col")) % 13 != 0)
    found = raster.slope_and_aspect(cells, ["k"], 0.5, tile=16)
    trig = [r6(f(F.radians("aspect"))).alias(n) for f, n in ((F.sin, "aspect_sin"), (F.cos, "aspect_cos"))]
    return found.select("k", F.col("row").alias("r"), F.col("col").alias("c"), r6("slope").alias("slope"), *trig)


def _mirror(at: str, n: int) -> str:
    return f"CASE WHEN {at} < 0 THEN -1 - ({at}) WHEN {at} >= {n} THEN {2 * n - 1} - ({at}) ELSE {at} END"


@query(f"""WITH {_GRID}, w AS (SELECT o, exp(-0.5 * o * o) / sum(exp(-0.5 * o * o)) OVER () AS w FROM range(-4, 5) t(o)),
y AS (SELECT t.k, t.r, t.c, sum(w * g.v) AS m, sum(w * g.v * g.v) AS q FROM g t, w JOIN g ON g.k = t.k AND g.c = t.c AND g.r = {_mirror("t.r + o", ROWS)} GROUP BY 1, 2, 3),
x AS (SELECT t.k, t.r, t.c, sum(w * y.m) AS m, sum(w * y.q) AS q FROM g t, w JOIN y ON y.k = t.k AND y.r = t.r AND y.c = {_mirror("t.c + o", COLS)} GROUP BY 1, 2, 3)
SELECT k, r, c, round(sqrt(greatest(q - m * m, 0)), 5) AS roughness FROM x""")
def raster_roughness(spark, sf_dir):
    found = raster.roughness(grid(spark, sf_dir), ["k"], ROWS, COLS, sigma=1.0, tile=16)
    return found.select("k", F.col("row").alias("r"), F.col("col").alias("c"), F.round("roughness", 5).alias("roughness"))


@query(f"""WITH {_GRID}, o AS (SELECT * FROM g WHERE v <= 12) SELECT g.k, g.r, g.c, round(0.1 * min(CASE WHEN g.v <= 12 THEN 0 ELSE sqrt((g.r - o.r) * (g.r - o.r) + (g.c - o.c) * (g.c - o.c)) END), 6) AS distance
FROM g LEFT JOIN o ON o.k = g.k GROUP BY 1, 2, 3""")
def raster_distance(spark, sf_dir):
    found = raster.distance_to_open(grid(spark, sf_dir), ["k"], F.col("value") > 12, 0.1)
    return found.select("k", F.col("row").alias("r"), F.col("col").alias("c"), r6("distance").alias("distance"))


def _intervals(rows: str, key: str) -> str:
    """CTEs from exceedances (key, ix, value): gaps z, estimates t, wider-than counts and run lengths l."""
    return f"""z AS (SELECT {key}, ix, value, ix - lag(ix) OVER (PARTITION BY {key} ORDER BY ix) AS gap FROM {rows}),
m AS (SELECT {key}, count(*) AS n, least(CASE WHEN max(gap) <= 2 THEN 2 * pow(sum(gap), 2) / (count(gap) * sum(gap * gap)) ELSE 2 * pow(sum(gap - 1), 2) / (count(gap) * sum((gap - 1) * (gap - 2))) END, 1) AS theta, count(gap) AS k FROM z GROUP BY 1),
t AS (SELECT {key}, n, CASE WHEN k > 0 THEN theta END AS theta, floor(theta * n)::BIGINT + 1 AS wanted FROM m),
o AS (SELECT {key}, gap, row_number() OVER (PARTITION BY {key} ORDER BY gap DESC) AS i FROM z WHERE gap IS NOT NULL),
l AS (SELECT t.{key}, n, theta, coalesce(max(CASE WHEN i = wanted THEN gap END), 0) AS run_length FROM t LEFT JOIN o ON o.{key} = t.{key} GROUP BY 1, 2, 3)"""


_BY_USER = "q AS (SELECT user_id, quantile_cont(value, 0.8) AS threshold FROM events GROUP BY 1), e AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS ix FROM events), x AS (SELECT e.* FROM e JOIN q USING (user_id) WHERE value > threshold)"


@query(f"""WITH {_BY_USER}, {_intervals("x", "user_id")}, c AS (SELECT z.user_id, count(*) FILTER (gap > run_length) + 1 AS clusters FROM z JOIN l ON l.user_id = z.user_id WHERE theta IS NOT NULL GROUP BY 1)
SELECT u.user_id, coalesce(n, 0) AS exceedances, round(theta, 6) AS theta, clusters, CASE WHEN theta IS NOT NULL THEN run_length END AS run_length FROM (SELECT DISTINCT user_id FROM events) u LEFT JOIN l ON l.user_id = u.user_id LEFT JOIN c ON c.user_id = u.user_id""")
def intervals_by_user(spark, sf_dir):
    rows = thresholds.with_threshold(table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "value"), ["user_id"], q=0.8)
    return decluster.intervals_index(rows, ["user_id"], ["ts", "event_id"]).select("user_id", "exceedances", r6("theta").alias("theta"), "clusters", "run_length")


@query(f"""WITH {ISLANDS}, {_intervals("x", "event_type")}, p AS (SELECT z.*, sum(CASE WHEN gap IS NULL OR gap > run_length THEN 1 ELSE 0 END) OVER (PARTITION BY z.event_type ORDER BY ix) AS i FROM z JOIN l ON l.event_type = z.event_type)
SELECT event_type, min(ix) AS first_ix, max(ix) AS last_ix, count(*) AS n, round(max(value), 6) AS cluster FROM p GROUP BY event_type, i""")
def intervals_clusters(spark, sf_dir):
    found = decluster.intervals_clusters(exceeding(spark, sf_dir), ["event_type"], ["ts", "event_id"])
    return found.select("event_type", "first_ix", "last_ix", "n", r6("cluster").alias("cluster"))


def _best_lines(rows: str, key: str, q: float) -> str:
    """The line of least loss by key among those through two rows (key, x, y), where the optimum lies."""
    loss = f"sum(greatest({q} * (p.y - a - b * p.x), ({q} - 1) * (p.y - a - b * p.x)))"
    return f"""s AS (SELECT i.{key}, (j.y - i.y) / (j.x - i.x) AS b, i.y - i.x * (j.y - i.y) / (j.x - i.x) AS a FROM {rows} i JOIN {rows} j ON j.{key} = i.{key} AND j.x > i.x),
o AS (SELECT s.{key}, a, b, {loss} AS loss FROM s JOIN {rows} p ON p.{key} = s.{key} GROUP BY 1, 2, 3), f AS (SELECT {key}, arg_min(a, loss) AS a, arg_min(b, loss) AS b FROM o GROUP BY 1)"""


@query(f"WITH p AS (SELECT user_id, event_id, {T} AS x, value AS y FROM events), {_best_lines('p', 'user_id', 0.87)} SELECT event_id, round(a + b * x, 3) AS threshold, y > a + b * x + 1e-9 AS exceeds FROM p LEFT JOIN f ON f.user_id = p.user_id")
def regression_threshold_by_user(spark, sf_dir):
    """A line in time for every user; rows on the line don't exceed it."""
    rows = hours(spark, sf_dir).select("user_id", "event_id", F.col("t").alias("hour"), "value")
    found = threshold_by_key(rows, ["user_id"], ["hour"], 0.87, flat=False)
    return found.select("event_id", F.round("threshold", 3).alias("threshold"), (F.col("value") > F.col("threshold") + 1e-9).alias("exceeds"))


@query(f"""WITH c AS (SELECT date_trunc('day', ts) AS d, avg(value) AS x FROM events WHERE day(ts) % 5 <> 0 GROUP BY 1), r AS (SELECT user_id, event_id, value AS y, x FROM events LEFT JOIN c ON c.d = date_trunc('day', ts)),
p AS (SELECT * FROM r WHERE x IS NOT NULL), {_best_lines('p', 'user_id', 0.83)} SELECT event_id, round(x, 6) AS covariate, round(a + b * x, 3) AS threshold FROM r LEFT JOIN f ON f.user_id = r.user_id""")
def regression_threshold_covariate(spark, sf_dir):
    """The day's mean over all users as covariate, missing on every fifth day."""
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", "value", F.date_trunc("day", "ts").alias("d"), "ts")
    side = rows.where(F.dayofmonth("ts") % 5 != 0).groupBy("d").agg(F.avg("value").alias("level"))
    found = threshold_by_key(with_covariates(rows, side, ["d"], ["level"]), ["user_id"], ["level"], 0.83, flat=False)
    return found.select("event_id", r6("level").alias("covariate"), F.round("threshold", 3).alias("threshold"))


_SITES = "s AS (SELECT s_suppkey AS k, s_nationkey::DOUBLE AS x, s_acctbal / 500 AS y FROM supplier), m AS (SELECT l_suppkey AS k, year(l_shipdate) AS t, max(l_extendedprice) AS z FROM lineitem GROUP BY 1, 2)"
_RANKS = "n AS (SELECT k, count(*) AS n FROM m GROUP BY 1), u AS (SELECT a.k, a.t, count(*) / (any_value(n) + 1) AS u FROM m a JOIN m b ON b.k = a.k AND b.z <= a.z JOIN n ON n.k = a.k GROUP BY 1, 2)"
_PAIRS = "p AS (SELECT a.k AS a, b.k AS b, sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) AS h FROM s a JOIN s b ON a.k < b.k WHERE sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) <= 7)"
_BINS_OF = "SELECT floor(h / 1.7)::BIGINT AS bin, round(sum(h) / count(*), 6) AS distance, count(*) AS pairs, sum(n)::BIGINT AS n"


def yearly(spark, sf_dir):
    """Yearly maxima by supplier, and where suppliers are in the plane of nation and balance."""
    items = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("k"), F.year("l_shipdate").alias("t")).agg(F.max("l_extendedprice").alias("z"))
    sites = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_nationkey").cast("double").alias("x"), (F.col("s_acctbal") / 500).alias("y"))
    return items, sites


@query(f"WITH {_SITES}, {_RANKS}, {_PAIRS}, j AS (SELECT a, b, h, count(*) AS n, sum(abs(x.u - y.u)) AS d FROM p JOIN u x ON x.k = a JOIN u y ON y.k = b AND y.t = x.t GROUP BY 1, 2, 3), g AS ({_BINS_OF}, 0.5 * sum(d) / sum(n) AS nu FROM j GROUP BY 1) SELECT bin, distance, pairs, n, round(nu, 6) AS nu, round((1 + 2 * nu) / (1 - 2 * nu), 5) AS theta FROM g")
def site_madogram(spark, sf_dir):
    items, sites = yearly(spark, sf_dir)
    found = dependence.madogram(items, sites, "k", "t", "z", 7.0, 1.7)
    return found.select("bin", r6("distance").alias("distance"), "pairs", "n", r6("nu").alias("nu"), F.round("theta", 5).alias("theta"))


@query(f"WITH {_SITES}, {_PAIRS}, j AS (SELECT a, b, h, count(*) AS n, sum(pow(ln(x.z) - ln(y.z), 2)) AS d FROM p JOIN m x ON x.k = a JOIN m y ON y.k = b AND y.t = x.t GROUP BY 1, 2, 3) {_BINS_OF}, round(0.5 * sum(d) / sum(n), 6) AS gamma FROM j GROUP BY 1")
def site_variogram(spark, sf_dir):
    items, sites = yearly(spark, sf_dir)
    found = dependence.variogram(items, sites, "k", "t", "z", 7.0, 1.7, F.log)
    return found.select("bin", r6("distance").alias("distance"), "pairs", "n", r6("gamma").alias("gamma"))


@query(f"""WITH {_SITES}, {_RANKS}, {_PAIRS}, j AS (SELECT a, b, h, count(*) AS n, sum(CASE WHEN x.u > 0.7 AND y.u > 0.7 THEN 1 ELSE 0 END) AS c, sum((x.u > 0.7)::INT + (y.u > 0.7)::INT) AS o FROM p JOIN u x ON x.k = a JOIN u y ON y.k = b AND y.t = x.t GROUP BY 1, 2, 3),
g AS ({_BINS_OF}, sum(c) / sum(n) AS c, sum(o) / (2 * sum(n)) AS o FROM j GROUP BY 1) SELECT bin, distance, pairs, n, round(CASE WHEN o > 0 THEN c / o END, 6) AS chi, round(CASE WHEN c > 0 AND c < 1 THEN 2 * ln(o) / ln(c) - 1 END, 6) AS chi_bar FROM g""")
def site_joint_exceedances(spark, sf_dir):
    items, sites = yearly(spark, sf_dir)
    found = dependence.joint_exceedances(items, sites, "k", "t", "z", 7.0, 1.7, 0.7)
    return found.select("bin", r6("distance").alias("distance"), "pairs", "n", r6("chi").alias("chi"), r6("chi_bar").alias("chi_bar"))


_MOMENTS = "AS (SELECT k, n, avg(x) AS b0, avg(i / (n - 1) * x) AS b1, avg(i / (n - 1) * ((i - 1) / (n - 2)) * x) AS b2 FROM (SELECT k, x, row_number() OVER (PARTITION BY k ORDER BY x) - 1 AS i, count(*) OVER (PARTITION BY k) AS n FROM {rows}) WHERE n > 2 GROUP BY 1, 2)"


@query(f"""WITH y AS (SELECT l_suppkey AS k, max(l_extendedprice) AS x FROM lineitem GROUP BY l_suppkey, date_trunc('month', l_shipdate)), m {_MOMENTS.format(rows="y")},
c AS (SELECT *, (2 * b1 - b0) / (3 * b2 - b0) - ln(2) / ln(3) AS c FROM m), q AS (SELECT *, 7.8590 * c + 2.9554 * c * c AS q FROM c), s AS (SELECT *, (2 * b1 - b0) * q / (gamma(1 + q) * (1 - pow(2, -q))) AS scale FROM q)
SELECT k AS l_suppkey, n, round(b0 + scale * (gamma(1 + q) - 1) / q, 2) AS loc, round(scale, 2) AS scale, round(-q, 6) AS shape FROM s""")
def gev_fit_by_supplier(spark, sf_dir):
    """Monthly maxima of every supplier."""
    items = table(spark, sf_dir, "lineitem").groupBy("l_suppkey", F.date_trunc("month", "l_shipdate").alias("month")).agg(F.max("l_extendedprice").alias("value"))
    found = estimation.fit_gev(items, ["l_suppkey"])
    return found.select("l_suppkey", "n", F.round("loc", 2).alias("loc"), F.round("scale", 2).alias("scale"), r6("shape").alias("shape"))


@query(f"""WITH u AS (SELECT l_suppkey AS k, quantile_cont(l_extendedprice, 0.9) AS u FROM lineitem GROUP BY 1), y AS (SELECT l_suppkey AS k, l_extendedprice - u AS x FROM lineitem JOIN u ON u.k = l_suppkey WHERE l_extendedprice > u), m {_MOMENTS.format(rows="y")}
SELECT k AS l_suppkey, n, round(2 * b0 * (b0 - b1) / (2 * b1 - b0), 2) AS scale, round(2 - b0 / (2 * b1 - b0), 5) AS shape FROM m""")
def gpd_fit_by_supplier(spark, sf_dir):
    rows = thresholds.with_threshold(table(spark, sf_dir, "lineitem").select("l_suppkey", F.col("l_extendedprice").alias("value")), ["l_suppkey"], q=0.9)
    found = estimation.fit_gpd(rows, ["l_suppkey"])
    return found.select("l_suppkey", "n", F.round("scale", 2).alias("scale"), F.round("shape", 5).alias("shape"))


_NORMAL = """v AS (SELECT o_orderpriority AS k, dayofyear(o_orderdate) AS d, sum(o_totalprice) AS s, count(*) AS n FROM orders GROUP BY 1, 2),
c AS (SELECT k, (d + i - 1 + 366) % 366 + 1 AS d, sum(n) AS n, sum(s) / sum(n) AS normal FROM v, range(-10, 11) r(i) GROUP BY 1, 2)"""


@query(f"WITH {_NORMAL} SELECT k AS o_orderpriority, d::INT AS day, n::BIGINT AS n, round(ln(normal), 9) AS log_normal FROM c")
def climatology_by_priority(spark, sf_dir):
    found = features.climatology(table(spark, sf_dir, "orders"), ["o_orderpriority"], "o_orderdate", "o_totalprice", 10)
    return found.select("o_orderpriority", F.col("day").cast("int").alias("day"), "n", F.round(F.log("normal"), 9).alias("log_normal"))


@query(f"WITH {_NORMAL} SELECT o_orderkey, round((o_totalprice - normal) / normal, 9) AS anomaly FROM orders LEFT JOIN c ON c.k = o_orderpriority AND c.d = dayofyear(o_orderdate)")
def order_anomalies(spark, sf_dir):
    """Anomalies as shares of the normal."""
    found = features.anomalies(table(spark, sf_dir, "orders"), ["o_orderpriority"], "o_orderdate", "o_totalprice", 10)
    return found.select("o_orderkey", F.round(F.col("anomaly") / F.col("normal"), 9).alias("anomaly"))


_SPELL = "e AS (SELECT user_id, value > 60 AS met, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS ix FROM events), x AS (SELECT *, ix - row_number() OVER (PARTITION BY user_id ORDER BY ix) AS run FROM e WHERE met), s AS (SELECT user_id, min(ix) AS first_ix, max(ix) AS last_ix, count(*) AS length FROM x GROUP BY user_id, run)"


@query(f"WITH {_SPELL} SELECT * FROM s")
def value_spells(spark, sf_dir):
    return features.spells(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], F.col("value") > 60)


@query(f"WITH {_SPELL} SELECT u.user_id, count(length) AS spells, coalesce(max(length), 0) AS longest, round(avg(length), 6) AS mean_length FROM (SELECT DISTINCT user_id FROM events) u LEFT JOIN s ON s.user_id = u.user_id GROUP BY 1")
def spells_by_user(spark, sf_dir):
    found = features.spell_summary(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], F.col("value") > 60)
    return found.select("user_id", "spells", "longest", r6("mean_length").alias("mean_length"))
