"""Temporal point processes: objects that hold a model and give Column expressions and plans over event tables.

Events are rows (keys, t); windows are rows (keys, t0, t1) and are joined from the left, so empty sequences keep their
likelihood. Times equal to t1 are outside. Quadratures are folds inside a row; what a time needs of earlier events
comes from sums by time bucket, so that no task holds a sequence.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from brinkline.functions.special import INF, col, log_poisson_sf
from brinkline.operators import point_process
from brinkline.operators.history import NAMES, history_at, with_history
from brinkline.operators.positions import dealt_by_size, running_sums
from brinkline.operators.quadrature import simpson, trapezoid
from brinkline.sources.simulate import thinned

FLOOR = 1e-30


def in_windows(events: DataFrame, windows: DataFrame, keys: list[str]) -> DataFrame:
    """Every window with its events: rows (keys, t0, t1, t), t null where a window has none."""
    inside = windows.join(events.select(*keys, "t").hint("merge"), keys, "left")
    return inside.withColumn("t", F.when((F.col("t") >= F.col("t0")) & (F.col("t") < F.col("t1")), F.col("t")))


def _counted(events: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, t, n) of every event: n counts the key's events up to and with its time."""
    times = running_sums(events.groupBy(*keys, "t").agg(F.count("*").alias("brinkline_m")), keys, ["t"], {"n": F.col("brinkline_m")})
    return times.withColumn("brinkline_i", F.explode(F.sequence(F.lit(1).cast("long"), F.col("brinkline_m")))).select(*keys, "t", "n")


class Poisson:
    """What all Poisson processes share; a subclass gives ``log_intensity`` and ``cumulative``."""

    def log_intensity(self, t: Column) -> Column:
        raise NotImplementedError

    def cumulative(self, lo: Column, hi: Column) -> Column:
        raise NotImplementedError

    def intensity(self, t) -> Column:
        return F.exp(self.log_intensity(col(t)))

    def cumulative_intensity(self, t) -> Column:
        return self.cumulative(F.lit(0.0), col(t))

    def survival(self, t, given=0.0) -> Column:
        """Probability of no event in (given, t]."""
        return F.exp(-self.cumulative(col(given), col(t)))

    hazard = intensity

    def cumulative_hazard(self, t, given=0.0) -> Column:
        return self.cumulative(col(given), col(t))

    def inter_event_log_prob(self, t, given=0.0) -> Column:
        """Log density of the first event behind ``given`` at ``t``."""
        return F.when(col(t) >= col(given), self.log_intensity(col(t)) - self.cumulative(col(given), col(t))).otherwise(-INF)

    def predict_count(self, start, end) -> Column:
        return self.cumulative(col(start), col(end))

    def exceedance_log_prob(self, k, start, end) -> Column:
        """Log probability of more than ``k`` events."""
        return log_poisson_sf(k, self.predict_count(start, end))

    def log_prob(self, events: DataFrame, windows: DataFrame, keys: list[str]) -> DataFrame:
        """(keys, t0, t1, n, log_lik) of every window."""
        rows = in_windows(events, windows, keys).groupBy(*keys, "t0", "t1").agg(F.count("t").alias("n"), F.coalesce(F.sum(F.when(F.col("t").isNotNull(), self.log_intensity(F.col("t")))), F.lit(0.0)).alias("ll"))
        return rows.select(*keys, "t0", "t1", "n", (F.col("ll") - self.cumulative(F.col("t0"), F.col("t1"))).alias("log_lik"))

    def residuals(self, events: DataFrame, keys: list[str]) -> DataFrame:
        return point_process.residuals(events, keys, self.cumulative_intensity)

    def goodness_of_fit(self, events: DataFrame, keys: list[str]) -> DataFrame:
        return point_process.ks_exponential(self.residuals(events, keys), keys)

    def compensator_curve(self, events: DataFrame, keys: list[str]) -> DataFrame:
        """(keys, t, n, compensator): events counted up to each event's time beside what the model expects by then."""
        return _counted(events, keys).withColumn("compensator", self.cumulative_intensity(F.col("t")))


@dataclass(frozen=True)
class HomogeneousPoisson(Poisson):
    rate: Column | float = 1.0

    def log_intensity(self, t: Column) -> Column:
        return F.log(col(self.rate)) + 0.0 * t

    def cumulative(self, lo: Column, hi: Column) -> Column:
        return col(self.rate) * (hi - lo)

    def mean_residual_life(self) -> Column:
        return 1.0 / col(self.rate)

    def return_period(self, probability) -> Column:
        """How long a window must be for an event in it to have this probability."""
        return -F.log1p(-col(probability)) / col(self.rate)


@dataclass(frozen=True)
class InhomogeneousPoisson(Poisson):
    """Any log intensity, integrated by quadrature: ``trapezoid`` or, on an odd number of nodes, ``simpson``."""

    log_rate: Callable[[Column], Column]
    nodes: int = 100
    rule: str = "trapezoid"

    def log_intensity(self, t: Column) -> Column:
        return self.log_rate(t)

    def cumulative(self, lo: Column, hi: Column) -> Column:
        rule = {"trapezoid": trapezoid, "simpson": simpson}[self.rule]
        return rule(lambda t: F.exp(self.log_rate(t)), lo, hi, self.nodes)

    def sample(self, candidates: DataFrame, most: float, ids: list[str], seed: int = 0) -> DataFrame:
        """Thins candidate events of the constant rate ``most`` down to this process."""
        return thinned(candidates, self.intensity(F.col("t")) / most, ids, seed)


@dataclass(frozen=True)
class PiecewisePoisson(Poisson):
    """Constant rates between edges; an edge belongs to the right piece, times outside to the nearest one, but no mass lies outside."""

    edges: tuple[float, ...]
    rates: tuple[float, ...]

    def __post_init__(self):
        if len(self.edges) != len(self.rates) + 1 or list(self.edges) != sorted(self.edges):
            raise ValueError("one rate between each two ascending edges")

    def log_intensity(self, t: Column) -> Column:
        out = F.lit(float(np.log(self.rates[-1])))
        for edge, rate in reversed(list(zip(self.edges[1:-1], self.rates[:-1], strict=True))):
            out = F.when(t < edge, float(np.log(rate))).otherwise(out)
        return out

    def cumulative(self, lo: Column, hi: Column) -> Column:
        part = lambda a, b: F.greatest(F.least(hi, F.lit(b)) - F.greatest(lo, F.lit(a)), F.lit(0.0))
        return sum((part(float(a), float(b)) * float(r) for a, b, r in zip(self.edges, self.edges[1:], self.rates, strict=False)), F.lit(0.0))

    def max_intensity(self) -> float:
        return max(self.rates)

    def rate_at(self, t: float) -> float:
        return self.rates[min(max(bisect_right(self.edges, t) - 1, 0), len(self.rates) - 1)]


@dataclass(frozen=True)
class ExponentialGap:
    rate: Column | float = 1.0

    def log_prob(self, x) -> Column:
        return F.when(col(x) >= 0, F.log(col(self.rate)) - col(self.rate) * col(x)).otherwise(-INF)

    def survival(self, x) -> Column:
        return F.when(col(x) > 0, F.exp(-col(self.rate) * col(x))).otherwise(1.0)


@dataclass(frozen=True)
class WeibullGap:
    shape: float = 1.0
    scale: float = 1.0

    def log_prob(self, x) -> Column:
        z = F.greatest(col(x), F.lit(FLOOR)) / float(self.scale)
        return F.when(col(x) >= 0, float(np.log(self.shape / self.scale)) + (self.shape - 1) * F.log(z) - F.pow(z, F.lit(float(self.shape)))).otherwise(-INF)

    def survival(self, x) -> Column:
        return F.when(col(x) > 0, F.exp(-F.pow(F.greatest(col(x), F.lit(0.0)) / float(self.scale), F.lit(float(self.shape))))).otherwise(1.0)


@dataclass(frozen=True)
class Renewal:
    """Independent gaps; ``gap`` is anything with ``log_prob`` and ``survival`` columns, such as the extreme-value distributions."""

    gap: object

    def inter_event_log_prob(self, tau) -> Column:
        return self.gap.log_prob(col(tau))

    def survival(self, tau) -> Column:
        return self.gap.survival(col(tau))

    def cumulative_hazard(self, tau) -> Column:
        return -F.log(F.greatest(self.survival(tau), F.lit(FLOOR)))

    def hazard(self, tau) -> Column:
        return F.exp(self.inter_event_log_prob(tau) + self.cumulative_hazard(tau))

    def log_prob(self, events: DataFrame, windows: DataFrame, keys: list[str]) -> DataFrame:
        """(keys, t0, t1, n, log_lik): log densities of the gaps from t0 on, and the survival of the one still open at t1."""
        rows = in_windows(events, windows, keys)
        gaps = with_history(rows, [*keys, "t0", "t1"], ["t"]).withColumn("gap", F.col("t") - F.coalesce("last_t", F.col("t0")))
        found = gaps.groupBy(*keys, "t0", "t1").agg(F.count("t").alias("n"), F.sum(F.when(F.col("t").isNotNull(), self.inter_event_log_prob(F.col("gap")))).alias("ll"), F.max("t").alias("last"))
        return found.select(*keys, "t0", "t1", "n", (F.coalesce("ll", F.lit(0.0)) - self.cumulative_hazard(F.col("t1") - F.coalesce("last", F.col("t0")))).alias("log_lik"))

    def intensity(self, events: DataFrame, queries: DataFrame, keys: list[str]) -> DataFrame:
        """``queries`` (keys, t, ...) with rate: the hazard of the time since the last event strictly before t, or since 0."""
        last = as_of(events, queries, keys)
        return last.withColumn("rate", self.hazard(F.col("t") - F.coalesce("last_t", F.lit(0.0)))).drop("last_t")

    def residuals(self, events: DataFrame, keys: list[str]) -> DataFrame:
        gaps = point_process.gaps(events, keys)
        return gaps.withColumn("residual", self.cumulative_hazard(F.col("gap"))).drop("gap")

    def goodness_of_fit(self, events: DataFrame, keys: list[str]) -> DataFrame:
        return point_process.ks_exponential(self.residuals(events, keys), keys)

    def compensator_curve(self, events: DataFrame, keys: list[str]) -> DataFrame:
        at_once = self.residuals(events, keys).groupBy(*keys, "t").agg(F.count("*").alias("brinkline_m"), F.sum("residual").alias("brinkline_r"))
        rows = running_sums(at_once, keys, ["t"], {"n": F.col("brinkline_m"), "compensator": F.col("brinkline_r")})
        return rows.withColumn("brinkline_i", F.explode(F.sequence(F.lit(1).cast("long"), F.col("brinkline_m")))).select(*keys, "t", "n", "compensator")

    def expected_count(self, spark: SparkSession, t: float, nodes: int = 200) -> float:
        """E[N(t)] by the renewal equation m = F + f * m, solved forwards on a grid of ``nodes`` points."""
        grid = spark.range(nodes).select("id", (F.col("id") * (t / (nodes - 1))).alias("x"))
        rows = grid.select("id", F.exp(self.inter_event_log_prob(F.col("x"))).alias("f"), (1.0 - self.survival(F.col("x"))).alias("p")).orderBy("id").collect()
        p = np.array([r.p for r in rows])
        m = np.zeros(nodes)
        for i in range(1, nodes):  # m(x_i) = F(x_i) + integral of m(x_i - s) dF(s), with m averaged over each step
            step = np.diff(p[: i + 1])
            before = m[i - 1 :: -1] if i > 1 else m[:1]
            ahead = np.r_[0.0, m[i - 1 : 0 : -1]] if i > 1 else np.zeros(1)
            known = p[i] + 0.5 * float((step * (before[: len(step)] + ahead[: len(step)])).sum())
            m[i] = known / (1.0 - 0.5 * step[0])
        return float(m[-1])


def as_of(events: DataFrame, queries: DataFrame, keys: list[str]) -> DataFrame:
    """``queries`` with last_t, the time of their key's last event strictly before their own t; null if there is none."""
    found = history_at(events.select(*keys, F.col("t").cast("double").alias("t")), queries.drop("last_t"), keys)
    return found.drop("n_before", "last_mark", "mark_sum")


def decayed_sums(events: DataFrame, queries: DataFrame, keys: list[str], beta: float) -> DataFrame:
    """``queries`` (keys, t, ...) with n, the events strictly before t, and decayed, the sum of exp(-beta (t - s)) over them.

    Times are cut into buckets of 8 / beta. Inside one, powers taken from its start stay small, so a running sum does;
    earlier buckets come by their totals, of which all beyond the fifth have decayed below double precision. Queries go
    through the windows whole, so none is looked up again; those with a NULL key or time have no row.
    """
    width, bucket = 8.0 / beta, [*keys, "b"]
    at = F.col("t").cast("double").alias("t")
    rows = queries.select(*keys, at, F.struct("*").alias("ask")).unionByName(events.select(*keys, at), allowMissingColumns=True)
    rows = rows.where(reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in [*keys, "t"]])).withColumn("b", F.floor(F.col("t") / width))
    rows = rows.withColumn("w", F.when(F.col("ask").isNull(), F.exp(beta * (F.col("t") - F.col("b") * width))))
    total = queries.count() + events.count()
    before = W.partitionBy(*bucket).orderBy("t", F.col("ask").isNull()).rowsBetween(W.unboundedPreceding, -1)
    inside = dealt_by_size(rows, bucket, total).withColumn("own", F.coalesce(F.sum("w").over(before), F.lit(0.0))).withColumn("own_n", F.count("w").over(before)).where(F.col("ask").isNotNull())
    totals = dealt_by_size(rows.select(*bucket, "w"), bucket, total).groupBy(*bucket).agg(F.sum("w").alias("total"), F.count("w").alias("m"))
    earlier = W.partitionBy(*keys).orderBy("b")
    fades = [F.coalesce(F.sum("total").over(earlier.rangeBetween(-j, -j)), F.lit(0.0)) * float(np.exp(-8.0 * j)) for j in range(1, 6)]
    ahead = F.coalesce(F.sum("m").over(earlier.rangeBetween(W.unboundedPreceding, -1)), F.lit(0))
    steps = dealt_by_size(totals, keys, total).select(*bucket, sum(fades, F.lit(0.0)).alias("carried"), ahead.alias("ahead"))
    found = inside.join(steps.hint("merge"), bucket)
    fade = F.exp(-beta * (F.col("t") - F.col("b") * width))
    return found.select("ask.*", (F.col("own_n") + F.col("ahead")).alias("n"), (fade * (F.col("own") + F.col("carried"))).alias("decayed"))


@dataclass(frozen=True)
class ExponentialHawkes:
    """Intensity mu + alpha sum exp(-beta (t - s)) over strictly earlier events s."""

    mu: float
    alpha: float
    beta: float

    def intensity(self, events: DataFrame, queries: DataFrame, keys: list[str]) -> DataFrame:
        """``queries`` (keys, t, ...) with rate."""
        return decayed_sums(events, queries, keys, self.beta).withColumn("rate", self.mu + self.alpha * F.col("decayed")).drop("n", "decayed")

    hazard = intensity

    def cumulative_intensity(self, events: DataFrame, queries: DataFrame, keys: list[str]) -> DataFrame:
        """``queries`` (keys, t, ...) with compensator, the integral of the intensity from 0 to t."""
        whole = self.mu * F.col("t") + self.alpha / self.beta * (F.col("n") - F.col("decayed"))
        return decayed_sums(events, queries, keys, self.beta).withColumn("compensator", whole).drop("n", "decayed")

    def lambda_max(self, events: DataFrame, keys: list[str]) -> DataFrame:
        """(keys, most): the highest intensity right behind an event, which bounds it everywhere."""
        rates = self.intensity(events, events.select(*keys, "t").distinct(), keys)
        ties = events.groupBy(*keys, "t").count()
        return rates.join(ties, [*keys, "t"]).groupBy(*keys).agg(F.max(F.col("rate") + self.alpha * F.col("count")).alias("most"))

    def log_prob(self, events: DataFrame, windows: DataFrame, keys: list[str]) -> DataFrame:
        """(keys, t1, n, log_lik) over windows (keys, t1) that start at 0."""
        inside = windows.join(events.select(*keys, "t").hint("merge"), keys, "left").where("t is null or t < t1")
        logs = self.intensity(events, events.select(*keys, "t"), keys).groupBy(*keys, "t").agg(F.count("*").alias("m"), F.sum(F.log(F.greatest("rate", F.lit(FLOOR)))).alias("ll"))
        sums = inside.select(*keys, "t1", "t").distinct().join(logs.hint("merge"), [*keys, "t"]).groupBy(*keys, "t1").agg(F.sum("m").alias("n"), F.sum("ll").alias("ll"), F.sum(F.col("m") * (1.0 - F.exp(-self.beta * (F.col("t1") - F.col("t"))))).alias("kernel"))
        all_ = windows.join(sums.hint("merge"), [*keys, "t1"], "left")
        none = F.lit(0.0)
        return all_.select(*keys, "t1", F.coalesce("n", F.lit(0)).alias("n"), (F.coalesce("ll", none) - self.mu * F.col("t1") - self.alpha / self.beta * F.coalesce("kernel", none)).alias("log_lik"))

    def residuals(self, events: DataFrame, keys: list[str]) -> DataFrame:
        at = self.cumulative_intensity(events, events.select(*keys, "t"), keys)
        rows = with_history(at, keys, ["t"], "compensator")
        return rows.withColumn("residual", F.col("compensator") - F.coalesce("last_mark", F.lit(0.0))).drop("compensator", *NAMES)

    def goodness_of_fit(self, events: DataFrame, keys: list[str]) -> DataFrame:
        return point_process.ks_exponential(self.residuals(events, keys), keys)

    def compensator_curve(self, events: DataFrame, keys: list[str]) -> DataFrame:
        return self.cumulative_intensity(events, _counted(events, keys), keys)


@dataclass(frozen=True)
class GeneralHawkes:
    """Intensity mu + sum of kernel(t - s) over earlier events no further back than ``reach``; ``integral`` is the kernel's integral from 0."""

    mu: float
    kernel: Callable[[Column], Column]
    integral: Callable[[Column], Column]
    reach: float

    def _near(self, events: DataFrame, queries: DataFrame, keys: list[str], f: Callable[[Column], Column]) -> DataFrame:
        """Distinct query times (keys, t) with near, the sum of f over earlier events in reach: a band join on buckets of that width."""
        at = lambda c: F.floor(F.col(c) / self.reach)
        side = events.groupBy(*keys, F.col("t").cast("double").alias("s")).agg(F.count("*").alias("m")).withColumn("b", F.explode(F.array(at("s"), at("s") + 1)))
        asked = queries.select(*keys, F.col("t").cast("double").alias("t")).distinct().withColumn("b", at("t"))
        gap = F.col("t") - F.col("s")
        weight = F.when((F.col("s") < F.col("t")) & (gap <= self.reach), f(gap) * F.col("m")).otherwise(0.0)
        return asked.join(side, [*keys, "b"], "left").groupBy(*keys, "t").agg(F.sum(weight).alias("near"), F.coalesce(F.sum(F.when((F.col("s") < F.col("t")) & (gap <= self.reach), F.col("m"))), F.lit(0)).alias("near_n"))

    def intensity(self, events: DataFrame, queries: DataFrame, keys: list[str]) -> DataFrame:
        return queries.join(self._near(events, queries, keys, self.kernel), [*keys, "t"]).withColumn("rate", self.mu + F.col("near")).drop("near", "near_n")

    def cumulative_intensity(self, events: DataFrame, queries: DataFrame, keys: list[str]) -> DataFrame:
        """``queries`` with compensator: kernels in reach in part, those further back whole."""
        near = self._near(events, queries, keys, self.integral)
        asked = queries.select(*keys, F.col("t").cast("double").alias("t")).distinct()
        counts = history_at(events.select(*keys, F.col("t").cast("double").alias("t")), asked, keys).select(*keys, "t", F.col("n_before").alias("n"))
        whole = self.mu * F.col("t") + F.col("near") + (F.col("n") - F.col("near_n")) * self.integral(F.lit(float(self.reach)))
        return queries.join(near, [*keys, "t"]).join(counts, [*keys, "t"]).withColumn("compensator", whole).drop("near", "near_n", "n")

    def log_prob(self, events: DataFrame, windows: DataFrame, keys: list[str]) -> DataFrame:
        """(keys, t1, n, log_lik) over windows (keys, t1) that start at 0."""
        logs = self.intensity(events, events.select(*keys, "t"), keys).select(*keys, "t", F.log(F.greatest("rate", F.lit(FLOOR))).alias("ll"))
        gap = F.least(F.col("t1") - F.col("t"), F.lit(float(self.reach)))
        there = F.col("t").isNotNull() & (F.col("t") < F.col("t1"))
        sums = windows.join(logs, keys, "left").groupBy(*keys, "t1").agg(F.count(F.when(there, 1)).alias("n"), F.coalesce(F.sum(F.when(there, F.col("ll") - self.integral(gap))), F.lit(0.0)).alias("s"))
        return sums.select(*keys, "t1", "n", (F.col("s") - self.mu * F.col("t1")).alias("log_lik"))

    def residuals(self, events: DataFrame, keys: list[str]) -> DataFrame:
        at = self.cumulative_intensity(events, events.select(*keys, "t"), keys)
        rows = with_history(at, keys, ["t"], "compensator")
        return rows.withColumn("residual", F.col("compensator") - F.coalesce("last_mark", F.lit(0.0))).drop("compensator", *NAMES)

    def goodness_of_fit(self, events: DataFrame, keys: list[str]) -> DataFrame:
        return point_process.ks_exponential(self.residuals(events, keys), keys)
