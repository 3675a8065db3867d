"""Registered queries over the star-schema tables, each beside its DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from brinkline.functions import distributions, evt
from brinkline.functions.special import erf, lgamma
from brinkline.operators import blocks, decluster, point_process, thresholds
from brinkline.sources import simulate

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
HOURS = 720.0


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(rows: DataFrame) -> DataFrame:
    """Rows of a small file dealt to all cores, for work that is long by row."""
    return rows.repartition(rows.sparkSession.sparkContext.defaultParallelism)


def spread(spark: SparkSession, sf_dir: str, lo: int, hi: int) -> DataFrame:
    """The parts' keys, dealt over the whole numbers from ``lo`` up to ``hi``, as id."""
    return table(spark, sf_dir, "part").select((F.col("p_partkey") % (hi - lo) + lo).alias("id"))


def r6(c: Column | str) -> Column:
    return F.round(c, 6)


def hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events with t, hours since 2024-01-01."""
    e = table(spark, sf_dir, "events")
    return e.withColumn("t", (F.unix_micros(F.col("ts").cast("timestamp")) - F.lit(1704067200000000)) / 3.6e9)


T = "(epoch_us(ts) - 1704067200000000) / 3.6e9"
ISLANDS = """
e AS (SELECT event_type, ts, event_id, value, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS ix FROM events),
u AS (SELECT event_type, quantile_cont(value, 0.95) AS threshold FROM events GROUP BY 1),
x AS (SELECT e.*, threshold FROM e JOIN u USING (event_type) WHERE value > threshold),
i AS (SELECT *, ix - row_number() OVER (PARTITION BY event_type ORDER BY ix) AS run FROM x),
r AS (SELECT event_type, run, max(ix) AS last_ix, count(*) AS n, max(value) AS mx, avg(value) AS mean, sum(value) AS sm, min(value) AS mn FROM i GROUP BY 1, 2)
"""


def exceeding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return thresholds.with_threshold(table(spark, sf_dir, "events").select("event_type", "ts", "event_id", "value"), ["event_type"])


@query(f"WITH {ISLANDS} SELECT u.event_type, round(threshold, 6) AS threshold, sum(n)::BIGINT AS exceedances, count(*) AS runs, round(count(*) / sum(n), 6) AS theta, round(max(mx), 6) AS largest, round(max(threshold) + 50 / 0.2 * (pow(1 / 100.0, -0.2) - 1), 6) AS level_100 FROM r JOIN u USING (event_type) GROUP BY u.event_type, threshold")
def extremes_summary(spark, sf_dir):
    rows = exceeding(spark, sf_dir)
    theta = decluster.extremal_index(rows, ["event_type"], ["ts", "event_id"])
    tops = rows.groupBy("event_type").agg(F.max("threshold").alias("threshold"), F.max("value").alias("largest"))
    level = F.col("threshold") + evt.gpd_return_level(100, 50.0, 0.2)
    return theta.join(tops, "event_type").select("event_type", r6("threshold").alias("threshold"), "exceedances", "runs", r6("theta").alias("theta"), r6("largest").alias("largest"), r6(level).alias("level_100"))


def _block(name: str, source: str, unit: str, time: str, value: str, least: int):
    sql = f"SELECT date_trunc('{unit}', {time})::TIMESTAMP AS block, CASE WHEN count({value}) >= {least} THEN max({value}) END AS maximum, count({value}) AS n FROM {source} GROUP BY 1"

    def run(spark, sf_dir):
        found = blocks.temporal_block_maxima(table(spark, sf_dir, source), unit, [], time, value, least)
        return found.withColumn("block", F.col("block").cast("timestamp_ntz"))

    run.__name__ = name
    query(sql)(run)


_block("block_maxima_day", "events", "day", "ts", "value", 1)
_block("block_maxima_month", "orders", "month", "o_orderdate", "o_totalprice", 20)
_block("block_maxima_year", "lineitem", "year", "l_shipdate", "l_extendedprice", 100)


@query("WITH s AS (SELECT user_id, event_id, row_number() OVER w - 1 AS ix, CASE WHEN count(value) OVER f >= 5 THEN max(value) OVER f END AS maximum FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id), f AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)) SELECT user_id, event_id, maximum FROM s WHERE ix % 3 = 0")
def sliding_maxima(spark, sf_dir):
    return blocks.sliding_block_maxima(table(spark, sf_dir, "events"), 5, ["user_id"], ["ts", "event_id"], stride=3).select("user_id", "event_id", "maximum")


@query("WITH x AS (SELECT vec_id, unnest(embedding) AS value, generate_subscripts(embedding, 1) - 1 AS dim FROM embeddings) SELECT vec_id, dim // 10 AS tile, round(max(value::DOUBLE), 6) AS maximum FROM x WHERE dim < 60 GROUP BY 1, 2")
def tile_maxima(spark, sf_dir):
    cells = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("dim", "value")).withColumn("value", F.col("value").cast("double"))
    found = blocks.tile_maxima(cells, {"dim": 10}, {"dim": 64}, ["vec_id"])
    return found.select("vec_id", F.col("dim_tile").alias("tile"), r6("maximum").alias("maximum"))


@query("WITH x AS (SELECT l_suppkey, year(l_shipdate) AS y, l_extendedprice, l_orderkey, l_linenumber, l_quantity, row_number() OVER (PARTITION BY l_suppkey, year(l_shipdate) ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) AS rank FROM lineitem) SELECT l_suppkey, y, rank, l_extendedprice FROM x WHERE rank <= 3")
def r_largest_calendar(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").withColumn("y", F.year("l_shipdate").cast("long"))
    return blocks.r_largest(rows, 3, ["l_suppkey"], "y", ["l_orderkey", "l_linenumber"], "l_extendedprice").select("l_suppkey", "y", F.col("rank").cast("long").alias("rank"), "l_extendedprice")


@query("WITH x AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS ix, count(*) OVER (PARTITION BY user_id) AS n FROM events), y AS (SELECT *, ix // 10 AS block FROM x WHERE ix < n // 10 * 10), z AS (SELECT *, row_number() OVER (PARTITION BY user_id, block ORDER BY value DESC, event_id) AS rank FROM y) SELECT user_id, block, rank, value FROM z WHERE rank <= 2")
def r_largest_fixed(spark, sf_dir):
    rows = blocks.fixed_blocks(table(spark, sf_dir, "events"), 10, ["user_id"], ["ts", "event_id"])
    return blocks.r_largest(rows, 2, ["user_id"], "block", ["event_id"]).select("user_id", "block", F.col("rank").cast("long").alias("rank"), "value")


def _threshold(kind: str, sql: str):
    def run(spark, sf_dir):
        rows = table(spark, sf_dir, "orders").withColumn("month", F.month("o_orderdate").cast("long"))
        return thresholds.threshold(rows, ["month"], kind, 0.9, "o_totalprice").select("month", r6("threshold").alias("threshold"))

    run.__name__ = f"threshold_month_{kind}"
    query(f"SELECT month(o_orderdate) AS month, round({sql}, 6) AS threshold FROM orders GROUP BY 1")(run)


for _kind, _sql in {"quantile": "quantile_cont(o_totalprice, 0.9)", "mean": "avg(o_totalprice)", "median": "quantile_cont(o_totalprice, 0.5)", "max": "max(o_totalprice)", "min": "min(o_totalprice)"}.items():
    _threshold(_kind, _sql)


@query("SELECT CASE WHEN month(o_orderdate) IN (12, 1, 2) THEN 'DJF' WHEN month(o_orderdate) <= 5 THEN 'MAM' WHEN month(o_orderdate) <= 8 THEN 'JJA' ELSE 'SON' END AS season, round(quantile_cont(o_totalprice, 0.95), 6) AS threshold, count(*) AS n FROM orders GROUP BY 1")
def threshold_season(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").withColumn("season", thresholds.season(F.col("o_orderdate")))
    n = rows.groupBy("season").agg(F.count("*").alias("n"))
    return thresholds.threshold(rows, ["season"], "quantile", 0.95, "o_totalprice").join(n, "season").select("season", r6("threshold").alias("threshold"), "n")


@query("SELECT user_id, event_id, round(quantile_cont(value, 0.9) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 9 PRECEDING AND CURRENT ROW), 6) AS threshold FROM events")
def threshold_rolling(spark, sf_dir):
    return thresholds.rolling_threshold(table(spark, sf_dir, "events"), 10, ["user_id"], ["ts", "event_id"], 0.9).select("user_id", "event_id", r6("threshold").alias("threshold"))


def _runs(reducer: str, column: str):
    def run(spark, sf_dir):
        found = decluster.runs(exceeding(spark, sf_dir), ["event_type"], ["ts", "event_id"], reducer)
        return found.select("event_type", "last_ix", "n", r6("cluster").alias("cluster"))

    run.__name__ = f"runs_{reducer}"
    query(f"WITH {ISLANDS} SELECT event_type, last_ix, n, round({column}, 6) AS cluster FROM r")(run)


for _kind, _sql in {"max": "mx", "mean": "mean", "sum": "sm", "min": "mn"}.items():
    _runs(_kind, _sql)


@query("""WITH RECURSIVE e AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS ix FROM events), u AS (SELECT event_type, quantile_cont(value, 0.95) AS threshold FROM events GROUP BY 1),
n AS (SELECT *, lag(value) OVER o AS before, lead(value) OVER o AS after FROM e WINDOW o AS (PARTITION BY event_type ORDER BY ix)),
r AS (SELECT n.event_type, ix, value, false AS kept FROM n JOIN u USING (event_type) WHERE value > threshold AND value > coalesce(before, -1) AND value > coalesce(after, -1) UNION ALL SELECT * FROM (
WITH l AS (SELECT * FROM r WHERE NOT kept), t AS (SELECT l.* FROM l WHERE NOT EXISTS (SELECT 1 FROM l h WHERE h.event_type = l.event_type AND abs(h.ix - l.ix) < 25 AND (h.value > l.value OR h.value = l.value AND h.ix > l.ix)))
SELECT event_type, ix, value, true FROM t UNION ALL SELECT l.event_type, l.ix, l.value, false FROM l WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.event_type = l.event_type AND abs(t.ix - l.ix) < 25))) SELECT event_type, ix, value FROM r WHERE kept""")
def separation_peaks(spark, sf_dir):
    return decluster.separated_peaks(exceeding(spark, sf_dir), 25, ["event_type"], ["ts", "event_id"]).select("event_type", "ix", "value")


GRID = "(SELECT DISTINCT l_quantity AS x FROM lineitem)"


def _grid(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(F.col("l_quantity").cast("double").alias("x")).distinct()


def _family(name: str, xi: float):
    t = f"(1 + {xi} * (x - 20) / 8.0)"
    q = "(x / 51.0)"
    sql = f"""SELECT x, CASE WHEN {t} > 0 THEN round(-ln(8.0) - {1 + 1 / xi} * ln(greatest({t}, 1e-300)) - pow(greatest({t}, 1e-300), {-1 / xi}), 6) END AS log_prob,
      CASE WHEN {t} > 0 THEN round(exp(-pow(greatest({t}, 1e-300), {-1 / xi})), 6) ELSE {0.0 if xi > 0 else 1.0} END AS cdf,
      round(20 + 8.0 / {xi} * (pow(-ln({q}), {-xi}) - 1), 6) AS icdf, round(20 + 8.0 / {xi} * (pow(-ln(1 - 1 / (x + 1)), {-xi}) - 1), 6) AS return_level,
      round(20 + 8.0 / {xi} * (gamma({1 - xi}) - 1), 6) AS mean FROM {GRID}"""

    def run(spark, sf_dir):
        x, p = F.col("x"), (20.0, 8.0, xi)
        lp = evt.gev_log_prob(x, *p)
        return _grid(spark, sf_dir).select("x", F.when(lp > float("-inf"), r6(lp)).alias("log_prob"), r6(evt.gev_cdf(x, *p)).alias("cdf"), r6(evt.gev_icdf(x / 51.0, *p)).alias("icdf"), r6(evt.gev_return_level(x + 1.0, *p)).alias("return_level"), r6(evt.gev_mean(*p)).alias("mean"))

    run.__name__ = name
    query(sql)(run)


_family("frechet_functions", 0.2)
_family("weibull_functions", -0.3)


@query(f"SELECT x, round(-ln(8.0) - (x - 20) / 8.0 - exp(-(x - 20) / 8.0), 6) AS log_prob, round(exp(-exp(-(x - 20) / 8.0)), 6) AS cdf, round(20 - 8.0 * ln(-ln(x / 51.0)), 6) AS icdf, round(20 + 8.0 * 0.5772156649015329::DOUBLE, 6) AS mean FROM {GRID}")
def gumbel_functions(spark, sf_dir):
    x = F.col("x")
    return _grid(spark, sf_dir).select("x", r6(evt.gumbel_log_prob(x, 20.0, 8.0)).alias("log_prob"), r6(evt.gev_cdf(x, 20.0, 8.0, 0.0)).alias("cdf"), r6(evt.gumbel_icdf(x / 51.0, 20.0, 8.0)).alias("icdf"), r6(evt.gumbel_mean(20.0, 8.0)).alias("mean"))


@query(f"SELECT x, round(-ln(8.0) - 6 * ln(1 + 0.2 * x / 8.0), 6) AS log_prob, round(1 - pow(1 + 0.2 * x / 8.0, -5), 6) AS cdf, round(pow(1 + 0.2 * x / 8.0, -5), 6) AS survival, round(1 / (8.0 + 0.2 * x), 6) AS hazard, round(5 * ln(1 + 0.2 * x / 8.0), 6) AS cumulative_hazard, round((8 + 0.2 * x) / 0.8, 6) AS mean_excess, round(40 * (pow(1 - x / 51.0, -0.2) - 1), 6) AS icdf FROM {GRID}")
def gpd_functions(spark, sf_dir):
    x, p = F.col("x"), (8.0, 0.2)
    cols = {"log_prob": evt.gpd_log_prob(x, *p), "cdf": evt.gpd_cdf(x, *p), "survival": evt.gpd_survival(x, *p), "hazard": evt.gpd_hazard(x, *p), "cumulative_hazard": evt.gpd_cumulative_hazard(x, *p), "mean_excess": evt.gpd_mean_excess(x, *p), "icdf": evt.gpd_icdf(x / 51.0, *p)}
    return _grid(spark, sf_dir).select("x", *[r6(c).alias(k) for k, c in cols.items()])


@query("WITH g AS (SELECT i / 100.0 AS xi FROM (SELECT p_partkey % 70 - 40 AS i FROM part) t WHERE i <> 0), m AS (SELECT xi, gamma(1 - xi) AS g1, gamma(1 - 2 * xi) AS g2, gamma(1 - 3 * xi) AS g3 FROM g) SELECT round(xi, 2) AS xi, round(3 + 2 / xi * (g1 - 1), 5) AS mean, round(4 / (xi * xi) * (g2 - g1 * g1), 5) AS variance, round(sign(xi) * (g3 - 3 * g2 * g1 + 2 * g1 * g1 * g1) / pow(g2 - g1 * g1, 1.5), 5) AS skewness, round(3 + 2 / xi * (pow(1 + xi, -xi) - 1), 5) AS mode, round(ln(2) + 0.5772156649015329 * (1 + xi) + 1, 5) AS entropy FROM m")
def gev_moments(spark, sf_dir):
    rows = spread(spark, sf_dir, -40, 30).where("id <> 0").select((F.col("id") / 100.0).alias("xi"))
    p = (3.0, 2.0, F.col("xi"))
    cols = {"mean": evt.gev_mean(*p), "variance": evt.gev_variance(*p), "skewness": evt.gev_skewness(*p), "mode": evt.gev_mode(*p), "entropy": evt.gev_entropy(*p)}
    return rows.select(F.round("xi", 2).alias("xi"), *[F.round(c, 5).alias(k) for k, c in cols.items()])


@query("SELECT i AS k, round(lgamma(i / 7.0), 6) AS lgamma FROM (SELECT p_partkey % 199 + 1 AS i FROM part) t")
def special_functions(spark, sf_dir):
    return spread(spark, sf_dir, 1, 200).select(F.col("id").alias("k"), r6(lgamma(F.col("id") / 7.0)).alias("lgamma"))


@query("""WITH x AS (SELECT (p_partkey % 121 - 60) / 10.0 AS x FROM part) SELECT x, round(CASE WHEN x = 0 THEN 0 ELSE sign(x) * least(2 / sqrt(pi()) * exp(-x * x) * list_sum(list_transform(range(0, 160),
lambda n: exp(2 * n * ln(2) + (2 * n + 1) * ln(greatest(abs(x), 1e-9)) + lgamma(n + 1) - lgamma(2 * n + 2)))), 1) END, 6) AS erf FROM x""")
def error_function(spark, sf_dir):
    return spread(spark, sf_dir, -60, 61).select((F.col("id") / 10.0).alias("x"), r6(erf(F.col("id") / 10.0)).alias("erf"))


@query("WITH r AS (SELECT l_suppkey, l_extendedprice AS x, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey) AS k FROM lineitem), h AS (SELECT l_suppkey, k, x, avg(ln(x)) OVER (PARTITION BY l_suppkey ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS m FROM r WHERE k <= 21), n AS (SELECT l_suppkey, k, m, lead(ln(x)) OVER (PARTITION BY l_suppkey ORDER BY k) AS nx FROM h) SELECT l_suppkey, k, round(CASE WHEN m > nx THEN 1 / (m - nx) ELSE 'inf'::DOUBLE END, 4) AS hill FROM n WHERE nx IS NOT NULL")
def hill_estimates(spark, sf_dir):
    found = thresholds.hill(table(spark, sf_dir, "lineitem"), ["l_suppkey"], list(range(1, 21)), "l_extendedprice", ("l_orderkey", "l_linenumber", "l_partkey"))
    return found.select("l_suppkey", "k", F.round("hill", 4).alias("hill"))


@query("WITH u AS (SELECT 50.0 * i::DOUBLE AS u FROM range(0, 8) t(i)), e AS (SELECT u, count(*) AS n, avg(value - u) AS m, var_samp(value - u) AS v FROM u JOIN events ON value > u GROUP BY u) SELECT u, n, round(m, 6) AS mean_excess, round(0.5 * (1 - m * m / v), 6) AS shape, round(0.5 * m * (m * m / v + 1), 6) AS scale FROM e")
def threshold_stability(spark, sf_dir):
    levels = F.broadcast(spark.range(8).select((50.0 * F.col("id")).alias("u")))
    over = table(spark, sf_dir, "events").join(levels, F.col("value") > F.col("u")).groupBy("u").agg(F.count("*").alias("n"), F.avg(F.col("value") - F.col("u")).alias("m"), F.var_samp(F.col("value") - F.col("u")).alias("v"))
    ratio = F.col("m") * F.col("m") / F.col("v")
    return over.select("u", "n", r6("m").alias("mean_excess"), r6(0.5 * (1 - ratio)).alias("shape"), r6(0.5 * F.col("m") * (ratio + 1)).alias("scale"))


@query(f"SELECT user_id, count(*) AS n, round(count(*) / {HOURS}, 6) AS rate_hat, round(count(*) * ln(0.1) - 0.1 * {HOURS}, 6) AS log_lik FROM events WHERE {T} >= 0 AND {T} < {HOURS} GROUP BY 1")
def hpp_log_likelihood(spark, sf_dir):
    e = hours(spark, sf_dir).select("user_id", "t")
    windows = e.select("user_id").distinct().withColumn("t0", F.lit(0.0)).withColumn("t1", F.lit(HOURS))
    return point_process.hpp_log_likelihood(e, windows, ["user_id"], 0.1).select("user_id", F.col("n").cast("long").alias("n"), r6("rate_hat").alias("rate_hat"), r6("log_lik").alias("log_lik"))


@query(f"SELECT user_id, count(*) AS n, round(sum(ln(CASE WHEN {T} < 240 THEN 0.05 WHEN {T} < 480 THEN 0.1 ELSE 0.2 END)) - 84, 6) AS log_lik FROM events GROUP BY 1")
def ipp_piecewise_log_likelihood(spark, sf_dir):
    found = point_process.piecewise_log_likelihood(hours(spark, sf_dir), [(0.0, 240.0, 0.05), (240.0, 480.0, 0.1), (480.0, 720.0, 0.2)], ["user_id"])
    return found.select("user_id", "n", r6("log_lik").alias("log_lik"))


@query(f"WITH e AS (SELECT user_id, {T} AS t FROM events), g AS (SELECT user_id, t, t - coalesce(lag(t) OVER (PARTITION BY user_id ORDER BY t), 0) AS g FROM e) SELECT user_id, count(*) AS n, round(sum(ln(0.8 / 10) - 0.2 * ln(greatest(g, 1e-30) / 10) - pow(g / 10, 0.8)) - pow(({HOURS} - max(t)) / 10, 0.8), 6) AS log_lik FROM g GROUP BY 1")
def renewal_weibull_log_likelihood(spark, sf_dir):
    return point_process.renewal_log_likelihood(hours(spark, sf_dir), ["user_id"], HOURS, *point_process.weibull_gap(0.8, 10.0)).select("user_id", "n", r6("log_lik").alias("log_lik"))


HAWKES = f"e AS (SELECT user_id, {T} AS t FROM events), p AS (SELECT a.user_id, a.t, 0.05 + 0.1 * coalesce(sum(exp(-0.5 * (a.t - b.t))), 0) AS rate FROM e a LEFT JOIN e b ON a.user_id = b.user_id AND b.t < a.t GROUP BY 1, 2)"


@query(f"WITH {HAWKES}, c AS (SELECT user_id, 0.05 * {HOURS} + 0.2 * sum(1 - exp(-0.5 * ({HOURS} - t))) AS c FROM e GROUP BY 1) SELECT p.user_id, count(*) AS n, round(sum(ln(rate)), 6) AS sum_log_rate, round(max(c), 6) AS compensator, round(sum(ln(rate)) - max(c), 6) AS log_lik FROM p JOIN c USING (user_id) GROUP BY 1")
def hawkes_log_likelihood(spark, sf_dir):
    found = point_process.hawkes_log_likelihood(hours(spark, sf_dir), ["user_id"], 0.05, 0.1, 0.5, HOURS)
    return found.select("user_id", F.col("n").cast("long").alias("n"), *[r6(c).alias(c) for c in ("sum_log_rate", "compensator", "log_lik")])


@query(f"WITH e AS (SELECT user_id, event_id, {T} AS t FROM events) SELECT a.user_id, round(a.t, 6) AS t, round(0.05 + coalesce(sum(0.1 * (1 - (a.t - b.t) / 24)), 0), 6) AS rate FROM e a LEFT JOIN e b ON a.user_id = b.user_id AND b.t < a.t AND a.t - b.t <= 24 GROUP BY a.user_id, a.t, a.event_id")
def kernel_intensities(spark, sf_dir):
    found = point_process.kernel_intensities(hours(spark, sf_dir).select("user_id", "t"), ["user_id"], 0.05, lambda d: 0.1 * (1 - d / 24.0), 24.0)
    return found.select("user_id", r6("t").alias("t"), r6("rate").alias("rate"))


RESIDUAL = f"e AS (SELECT user_id, {T} AS t FROM events), g AS (SELECT user_id, 0.1 * (t - coalesce(lag(t) OVER (PARTITION BY user_id ORDER BY t), 0)) AS r FROM e), k AS (SELECT user_id, r, row_number() OVER (PARTITION BY user_id ORDER BY r) AS i, count(*) OVER (PARTITION BY user_id) AS n FROM g)"


@query(f"WITH {RESIDUAL} SELECT user_id, n, round(max(greatest(i / n - (1 - exp(-r)), (1 - exp(-r)) - (i - 1) / n)), 6) AS ks FROM k GROUP BY user_id, n")
def residual_ks(spark, sf_dir):
    rows = point_process.residuals(hours(spark, sf_dir).select("user_id", "t"), ["user_id"], lambda t: 0.1 * t)
    return point_process.ks_exponential(rows, ["user_id"]).select("user_id", "n", r6("ks").alias("ks"))


@query(f"WITH {RESIDUAL} SELECT user_id, i, round(r, 6) AS empirical, round(-ln(1 - (i - 0.5) / n), 6) AS theoretical FROM k")
def residual_qq(spark, sf_dir):
    rows = point_process.residuals(hours(spark, sf_dir).select("user_id", "t"), ["user_id"], lambda t: 0.1 * t)
    return point_process.qq_exponential(rows, ["user_id"]).select("user_id", F.col("i").cast("long").alias("i"), r6("empirical").alias("empirical"), r6("theoretical").alias("theoretical"))


@query(f"SELECT user_id, round(count(*) * ln(0.1) - 0.1 * {HOURS} + sum(-ln(40.0) - (value - 60) / 40 - exp(-(value - 60) / 40)), 6) AS log_lik FROM events WHERE {T} < {HOURS} GROUP BY 1")
def marked_log_likelihood(spark, sf_dir):
    e = hours(spark, sf_dir).select("user_id", "t", "value").where(F.col("t") < HOURS)
    windows = e.select("user_id").distinct().withColumn("t0", F.lit(0.0)).withColumn("t1", F.lit(HOURS))
    ground = point_process.hpp_log_likelihood(e.select("user_id", "t"), windows, ["user_id"], 0.1)
    return point_process.marked_log_likelihood(ground, e, ["user_id"], evt.gumbel_log_prob(F.col("value"), 60.0, 40.0)).select("user_id", r6("log_lik").alias("log_lik"))


@query(f"SELECT user_id, count(*) AS n, round(sum(ln(0.4 * 0.2)) - 0.2 * 0.4 * {HOURS}, 6) AS log_lik FROM events GROUP BY 1")
def thinned_log_likelihood(spark, sf_dir):
    return point_process.thinned_log_likelihood(hours(spark, sf_dir), ["user_id"], 0.2, F.lit(0.4), 0.4 * HOURS).select("user_id", "n", r6("log_lik").alias("log_lik"))


@query("WITH c AS (SELECT least(floor((l_quantity - 0) / 6.0), 8)::BIGINT * 6 + least(floor(l_discount / 0.02), 5)::BIGINT AS cell FROM lineitem WHERE l_quantity >= 0 AND l_quantity < 54 AND l_discount >= 0 AND l_discount < 0.12), n AS (SELECT cell, count(*) AS n FROM c GROUP BY 1) SELECT i AS cell, coalesce(n, 0) AS n, round((coalesce(n, 0) - 1000.0) / sqrt(1000.0), 6) AS pearson FROM range(54) t(i) LEFT JOIN n ON n.cell = i")
def pearson_residuals(spark, sf_dir):
    points = table(spark, sf_dir, "lineitem").select(F.col("l_quantity").cast("double").alias("l_quantity"), F.col("l_discount").cast("double").alias("l_discount"))
    cells = point_process.cell_counts(points, ["l_quantity", "l_discount"], [0.0, 0.0], [54.0, 0.12], [9, 6])
    return point_process.pearson_residuals(cells, 1000.0).select("cell", "n", r6("pearson").alias("pearson"))


@query()
def sampled_poisson(spark, sf_dir):
    """Events thinned to a rate that falls with the hour, by a hash of their ids."""
    e = hours(spark, sf_dir)
    return simulate.thinned(e, F.exp(-F.col("t") / HOURS), ["event_id"], 7).select("event_id", "user_id", r6("t").alias("t"))


@query()
def simulated_extremes(spark, sf_dir):
    """An annual maximum for each supplier and order year, drawn by inverse distribution function from a trend of the location."""
    seen = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    rows = seen.select("l_suppkey", F.year("o_orderdate").alias("year")).distinct()
    model = distributions.GeneralizedExtremeValue(30.0 + 0.02 * (F.col("year") - 1992), 4.0, 0.1)
    return simulate.drawn(rows, model, ["l_suppkey", "year"], "maximum", 11).select("l_suppkey", "year", r6("maximum").alias("maximum"))
