"""Thinned processes over any base: each event of a base process is kept with a probability that may depend on time, mark and history.

The log-likelihood of the events that were kept is the sum of ln(p lambda) less the integral of p lambda. That integral
is the base's own compensator less the integral of (1 - p) lambda, so p = 1 gives the base exactly; the rest is taken
at nodes, a row each, which look up the base's intensity and the history before them by joins.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brinkline.operators.history import History, history_at, with_history
from brinkline.operators.processes import FLOOR, Poisson

Retention = Callable[[Column, Column, History], Column]


def uniform_nodes(windows: DataFrame, nodes: int) -> DataFrame:
    """``windows`` (..., t0, t1) with a row for each of ``nodes`` evenly spaced times t and its trapezoid weight w."""
    if nodes < 2:
        raise ValueError("two nodes or more")
    step = (F.col("t1") - F.col("t0")) / float(nodes - 1)
    rows = windows.withColumn("brinkline_i", F.explode(F.sequence(F.lit(0), F.lit(nodes - 1))))
    i = F.col("brinkline_i")
    half = F.when((i == 0) | (i == nodes - 1), 0.5).otherwise(1.0)
    return rows.withColumn("t", F.col("t0") + step * i).withColumn("w", step * half).drop("brinkline_i")


def gap_nodes(windows: DataFrame, events: DataFrame, keys: list[str], nodes: int) -> DataFrame:
    """``windows`` with Gauss-Legendre nodes in each gap between the events, where intensities are smooth."""
    x, w = np.polynomial.legendre.leggauss(nodes)
    names = [c for c in windows.columns if c not in keys]
    inside = windows.join(events.select(*keys, F.col("t").cast("double").alias("t")).distinct(), keys).where((F.col("t") > F.col("t0")) & (F.col("t") < F.col("t1")))
    ends = inside.select(*keys, *names, "t").union(windows.select(*keys, *names, F.col("t1").cast("double")))
    gaps = with_history(ends, [*keys, *names], ["t"]).select(*keys, *names, F.coalesce("last_t", "t0").alias("a"), F.col("t").alias("b"))
    at = F.explode(F.array(*[F.struct(F.lit(0.5 * (float(p) + 1.0)).alias("x"), F.lit(0.5 * float(q)).alias("q")) for p, q in zip(x, w, strict=True)]))
    rows = gaps.where("b > a").withColumn("brinkline_p", at)
    side = F.col("b") - F.col("a")
    return rows.select(*keys, *names, (F.col("a") + side * F.col("brinkline_p.x")).alias("t"), (side * F.col("brinkline_p.q")).alias("w"))


@dataclass(frozen=True)
class Thinned:
    """``base`` with each event kept at probability ``retention(t, mark, history)``, held to [0, 1].

    At nodes there is no mark, so ``mean_retention(t, mark, history)``, the mean over marks, stands in there where it is
    given; a retention that doesn't look at marks needs none.
    """

    base: object
    retention: Retention
    mean_retention: Retention | None = None
    nodes: int = 100
    in_gaps: bool = False

    def intensity(self, events: DataFrame, queries: DataFrame, keys: list[str], order: list[str] | None = None, mark: str | None = None) -> DataFrame:
        """``queries`` (keys, t, ...) with base_rate, keep (the mean retention) and rate, their product."""
        kept = queries.drop("base_rate", "keep", "rate")
        found = self._rates(events, history_at(events, kept, keys, order, mark), keys)
        keep = self._held((self.mean_retention or self.retention)(F.col("t"), F.lit(None).cast("double"), History.of()))
        return found.withColumn("keep", keep).select(*kept.columns, "base_rate", "keep", (F.col("base_rate") * F.col("keep")).alias("rate"))

    def retention_log_prob(self, events: DataFrame, keys: list[str], order: list[str] | None = None, mark: str | None = None) -> DataFrame:
        """(keys, log_retention): the sum of ln p over the events, each with the history before it."""
        rows = self._events(events, keys, order, mark)
        return rows.groupBy(*keys).agg(F.sum("ln_keep").alias("log_retention"))

    def discarded(self, events: DataFrame, windows: DataFrame, keys: list[str], order: list[str] | None = None, mark: str | None = None) -> DataFrame:
        """(keys, t0, t1, discarded): the integral of (1 - p) times the base's intensity."""
        asked = windows.select(*keys, "t0", "t1")
        rows = gap_nodes(asked, events, keys, self.nodes) if self.in_gaps else uniform_nodes(asked, self.nodes)
        found = self.intensity(events, rows, keys, order, mark)
        return found.groupBy(*keys, "t0", "t1").agg(F.sum(F.col("w") * (1.0 - F.col("keep")) * F.col("base_rate")).alias("discarded"))

    def log_prob(self, events: DataFrame, windows: DataFrame, keys: list[str], order: list[str] | None = None, mark: str | None = None) -> DataFrame:
        """(keys, t0, t1, n, base_log_lik, log_retention, discarded, log_lik) of every window (keys, t0, t1).

        Windows of self-exciting bases start at 0, as those do. Every event must be one that was kept.
        """
        asked = windows.select(*keys, "t0", "t1")
        ground = self.base.log_prob(events, asked if isinstance(self.base, Poisson) else asked.drop("t0"), keys).withColumnRenamed("log_lik", "base_log_lik")
        on = [*keys, "t0", "t1"] if isinstance(self.base, Poisson) else [*keys, "t1"]
        rows = self._events(events, keys, order, mark).select(*keys, "t", "ln_keep")
        there = (F.col("t") >= F.col("t0")) & (F.col("t") < F.col("t1"))
        logs = asked.join(rows.hint("merge"), keys, "left").groupBy(*keys, "t0", "t1").agg(F.coalesce(F.sum(F.when(there, F.col("ln_keep"))), F.lit(0.0)).alias("log_retention"))
        lost = self.discarded(events, windows, keys, order, mark)
        found = asked.join(ground.hint("merge"), on).join(logs.hint("merge"), [*keys, "t0", "t1"]).join(lost.hint("merge"), [*keys, "t0", "t1"])
        whole = F.col("base_log_lik") + F.col("log_retention") + F.col("discarded")
        return found.select(*keys, "t0", "t1", "n", "base_log_lik", "log_retention", "discarded", whole.alias("log_lik"))

    def _held(self, p: Column) -> Column:
        return F.greatest(F.least(p, F.lit(1.0)), F.lit(0.0))

    def _events(self, events: DataFrame, keys: list[str], order: list[str] | None, mark: str | None) -> DataFrame:
        rows = with_history(events, keys, order, mark)
        p = self.retention(F.col("t"), F.col(mark) if mark else F.lit(None).cast("double"), History.of())
        return rows.withColumn("ln_keep", F.log(F.greatest(self._held(p), F.lit(FLOOR))))

    def _rates(self, events: DataFrame, queries: DataFrame, keys: list[str]) -> DataFrame:
        if isinstance(self.base, Poisson):
            return queries.withColumn("base_rate", self.base.intensity(F.col("t")))
        return self.base.intensity(events, queries, keys).withColumnRenamed("rate", "base_rate")
