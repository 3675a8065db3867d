"""Point-process likelihoods, intensities, compensators and diagnostics.

Events are rows (keys, t, optional mark or coordinates); windows are constants or a table (keys, t0, t1), and are
joined from the left so that empty sequences keep their likelihood.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from brinkline.operators.history import NAMES, with_history
from brinkline.operators.positions import CHUNK_ROWS, numbered, same_keys
from brinkline.plans.shared import materialize, shared_root

FLOOR = 1e-30


def hpp_log_likelihood(events: DataFrame, windows: DataFrame, keys: list[str], rate: float) -> DataFrame:
    """n ln(rate) - rate (t1 - t0), the rate's estimate n / (t1 - t0) with the events counted in [t0, t1)."""
    inside = windows.join(events, keys, "left").groupBy(*keys, "t0", "t1").agg(F.sum(((F.col("t") >= F.col("t0")) & (F.col("t") < F.col("t1"))).cast("int")).alias("n"))
    n = F.coalesce("n", F.lit(0))
    span = F.col("t1") - F.col("t0")
    return inside.select(*keys, n.alias("n"), (n / span).alias("rate_hat"), (n * math.log(rate) - rate * span).alias("log_lik"))


def piecewise_log_likelihood(events: DataFrame, pieces: list[tuple[float, float, float]], keys: list[str]) -> DataFrame:
    """Inhomogeneous likelihood of a piecewise-constant rate (lo, hi, rate); an edge belongs to the right piece, times outside to the nearest."""
    rate = F.lit(pieces[-1][2])
    for lo, hi, r in reversed(pieces[:-1]):
        rate = F.when(F.col("t") < hi, r).otherwise(rate)
    integral = sum((hi - lo) * r for lo, hi, r in pieces)
    return events.groupBy(*keys).agg(F.count("*").alias("n"), (F.sum(F.log(rate)) - integral).alias("log_lik"))


def gaps(events: DataFrame, keys: list[str], t0: float = 0.0, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """``events`` with gap, the time since the event before, or since ``t0``; keys may be longer than a task."""
    rows = with_history(events.drop("gap"), keys, ["t"], chunk_rows=chunk_rows)
    return rows.withColumn("gap", F.col("t") - F.coalesce("last_t", F.lit(t0))).drop(*NAMES)


def renewal_log_likelihood(events: DataFrame, keys: list[str], t1: float, log_density: Callable[[Column], Column], log_survival: Callable[[Column], Column]) -> DataFrame:
    """Sum of the gaps' log densities and the log survival of the last open gap; events from ``t1`` on are outside."""
    rows = gaps(events.where(F.col("t") < t1), keys).groupBy(*keys).agg(F.sum(log_density(F.col("gap"))).alias("ll"), F.max("t").alias("last"), F.count("*").alias("n"))
    return rows.select(*keys, "n", (F.col("ll") + log_survival(F.lit(t1) - F.col("last"))).alias("log_lik"))


def weibull_gap(shape: float, scale: float) -> tuple[Callable[[Column], Column], Callable[[Column], Column]]:
    density = lambda g: math.log(shape / scale) + (shape - 1) * F.log(F.greatest(g, F.lit(FLOOR)) / scale) - F.pow(g / scale, F.lit(shape))
    return density, lambda g: -F.pow(g / scale, F.lit(shape))


def hawkes_log_likelihood(events: DataFrame, keys: list[str], mu: float, alpha: float, beta: float, t1: float, chunk_rows: int = 200_000) -> DataFrame:
    """Self-exciting process with kernel alpha exp(-beta dt): an O(n) fold over each sequence's sorted times.

    Rows are ranged by key and time into chunks of about ``chunk_rows``, so that a task folds a chunk, not a key. Each
    chunk leaves its last time and its decayed sum, from which the state that the next one starts with is added up.
    """
    total = events.count()
    parts = max(1, -(-total // chunk_rows))
    # equal times may be cut anywhere: the third column keeps many of them from being one chunk
    ranged = events.select(*keys, "t").repartitionByRange(parts, *keys, "t", F.rand(0)) if parts > 1 else events.select(*keys, "t")
    pieces = ranged.withColumn("chunk", F.spark_partition_id() if parts > 1 else F.lit(0)).groupBy(*keys, "chunk").agg(F.array_sort(F.collect_list("t")).alias("ts"), F.max("t").alias("last"))
    if parts > 1:
        pieces = materialize(pieces, shared_root(events.sparkSession), "chunks")
        ends = pieces.select(*keys, "chunk", "last", F.aggregate("ts", F.lit(0.0), lambda x, t: x + F.exp(-beta * (F.col("last") - t))).alias("sum"))
        before = W.partitionBy(*keys).orderBy("chunk").rowsBetween(W.unboundedPreceding, -1)
        earlier = ends.withColumn("p", F.max("last").over(before)).withColumn("ends", F.collect_list(F.when(F.col("last").isNotNull(), F.struct("last", "sum"))).over(before)).where("p is not null")
        carried = earlier.select(*[F.col(k).alias(f"carried_{k}") for k in keys], F.col("chunk").alias("carried_chunk"), "p", F.aggregate("ends", F.lit(0.0), lambda x, e: x + e["sum"] * F.exp(-beta * (F.col("p") - e["last"]))).alias("v"))
        same = F.col("chunk") == F.col("carried_chunk")
        for k in keys:
            same = same & F.col(k).eqNullSafe(F.col(f"carried_{k}"))
        pieces = pieces.join(carried, same, "left").select(*keys, "ts", "p", "v")
    else:
        pieces = pieces.select(*keys, "ts", F.lit(None).cast("double").alias("p"), F.lit(None).cast("double").alias("v"))
    # v: the decayed count of the events up to p
    start = F.struct(F.col("p").cast("double").alias("p"), F.coalesce("v", F.lit(0.0)).alias("v"), F.lit(0.0).alias("ll"))

    def step(s: Column, t: Column) -> Column:
        a = F.when(s["p"].isNotNull(), F.exp(-beta * (t - s["p"])) * s["v"]).otherwise(0.0)
        return F.struct(t.cast("double").alias("p"), (1.0 + a).alias("v"), (s["ll"] + F.log(F.greatest(mu + alpha * a, F.lit(FLOOR)))).alias("ll"))

    kernel = F.aggregate("ts", F.lit(0.0), lambda x, t: x + (1.0 - F.exp(-beta * (t1 - t))))
    folded = pieces.select(*keys, F.size("ts").alias("n"), F.aggregate("ts", start, step, lambda s: s["ll"]).alias("ll"), kernel.alias("kernel"))
    both = folded.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum("ll").alias("sum_log_rate"), (mu * t1 + alpha / beta * F.sum("kernel")).alias("compensator"))
    return both.withColumn("log_lik", F.col("sum_log_rate") - F.col("compensator"))


def kernel_intensities(events: DataFrame, keys: list[str], mu: float, kernel: Callable[[Column], Column], reach: float) -> DataFrame:
    """A row for each event with its intensity under any kernel of finite reach: a band join on time buckets of that width.

    Strictly earlier events count, each as often as it occurs; events of one time stay apart and have equal rates.
    """
    times = events.groupBy(*keys, "t").agg(F.count("*").alias("m"))
    bucket = lambda c: F.floor(F.col(c) / reach)
    side = times.select(*keys, F.col("t").alias("s"), F.col("m").alias("ms")).withColumn("b", F.explode(F.array(bucket("s"), bucket("s") + 1)))
    near = times.withColumn("b", bucket("t")).join(side, [*keys, "b"], "left")
    weight = F.when((F.col("s") < F.col("t")) & (F.col("t") - F.col("s") <= reach), kernel(F.col("t") - F.col("s")) * F.col("ms")).otherwise(0.0)
    rates = near.groupBy(*keys, "t", "m").agg((mu + F.sum(weight)).alias("rate"))
    return rates.withColumn("i", F.explode(F.sequence(F.lit(1).cast("long"), F.col("m")))).drop("i", "m")


def residuals(events: DataFrame, keys: list[str], cumulative: Callable[[Column], Column], chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Time-rescaling residuals: differences of the compensator between successive events, the first from 0."""
    rows = with_history(events.drop("residual"), keys, ["t"], chunk_rows=chunk_rows)
    return rows.withColumn("residual", cumulative(F.col("t")) - cumulative(F.coalesce("last_t", F.lit(0.0)))).drop(*NAMES)


def _ranked(rows: DataFrame, keys: list[str], residual: str, chunk_rows: int) -> DataFrame:
    """(keys, residual) with i, the rank from 1, and n, the key's rows."""
    asked = rows.select(*keys, residual)
    ranked = numbered(asked, keys, [residual], "i", chunk_rows).withColumn("i", F.col("i") + 1)
    counts = asked.groupBy(*[F.col(k).alias(f"brinkline_{k}") for k in keys]).agg(F.count("*").alias("n"))
    found = ranked.join(counts, same_keys(ranked, counts, {k: f"brinkline_{k}" for k in keys}))
    return found.drop(*[f"brinkline_{k}" for k in keys])


def ks_exponential(rows: DataFrame, keys: list[str], residual: str = "residual", chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Two-sided Kolmogorov-Smirnov distance of the residuals from the unit exponential."""
    cdf = 1.0 - F.exp(-F.col(residual))
    return _ranked(rows, keys, residual, chunk_rows).groupBy(*keys).agg(F.max(F.greatest(F.col("i") / F.col("n") - cdf, cdf - (F.col("i") - 1) / F.col("n"))).alias("ks"), F.count("*").alias("n"))


def qq_exponential(rows: DataFrame, keys: list[str], residual: str = "residual", chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Sorted residuals beside unit exponential quantiles at (i - 1/2) / n."""
    ranked = _ranked(rows, keys, residual, chunk_rows)
    return ranked.select(*keys, "i", F.col(residual).alias("empirical"), (-F.log(1.0 - (F.col("i") - 0.5) / F.col("n"))).alias("theoretical"))


def marked_log_likelihood(ground: DataFrame, events: DataFrame, keys: list[str], mark_log_prob: Column) -> DataFrame:
    """Ground log-likelihood plus the marks' log densities."""
    marks = events.groupBy(*keys).agg(F.sum(mark_log_prob).alias("mark_ll"))
    return ground.join(marks, keys, "left").withColumn("log_lik", F.col("log_lik") + F.coalesce("mark_ll", F.lit(0.0)))


def thinned_log_likelihood(events: DataFrame, keys: list[str], rate: float, retention: Column, retained_integral: float) -> DataFrame:
    """Sum of ln(p rate) minus the integral of p rate (the sign that the model needs)."""
    return events.groupBy(*keys).agg(F.count("*").alias("n"), (F.sum(F.log(retention * rate)) - rate * retained_integral).alias("log_lik"))


def cell_counts(points: DataFrame, coordinates: list[str], lo: list[float], hi: list[float], bins: list[int]) -> DataFrame:
    """Counts of a box's cells, empty ones too, numbered in row-major order."""
    inside = points
    for c, a, b in zip(coordinates, lo, hi, strict=True):
        inside = inside.where((F.col(c) >= a) & (F.col(c) < b))
    cell = F.lit(0).cast("long")
    for c, a, b, n in zip(coordinates, lo, hi, bins, strict=True):
        cell = cell * n + F.least(F.floor((F.col(c) - a) / ((b - a) / n)), F.lit(n - 1))
    spine = points.sparkSession.range(math.prod(bins)).withColumnRenamed("id", "cell")
    return spine.join(inside.groupBy(cell.alias("cell")).agg(F.count("*").alias("n")), "cell", "left").select("cell", F.coalesce("n", F.lit(0)).alias("n"))


def pearson_residuals(cells: DataFrame, expected: float) -> DataFrame:
    """(n - expected) / sqrt(expected) of every cell under a constant rate."""
    return cells.withColumn("pearson", (F.col("n") - expected) / math.sqrt(expected))
