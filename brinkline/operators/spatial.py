"""Point processes in space and in space and time, over boxes.

Points are rows (keys, coordinates, optionally t). Quadratures over a box run on a grid of cell middles, a row a node;
neighbours come by joins on buckets, so that no operator compares all pairs.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brinkline.functions.special import col, erf, lgamma
from brinkline.operators.processes import FLOOR
from brinkline.operators.quadrature import halton_points, integral_over
from brinkline.plans.shared import materialize, shared_root

TERMS = 20
CHUNK_POINTS = 200_000


def unit_ball_volume(n_dims: int) -> float:
    return math.pi ** (n_dims / 2) / math.gamma(n_dims / 2 + 1)


def ripleys_k(r, n_dims: int) -> Column:
    """Ripley's K of complete randomness: the volume of a ball."""
    return unit_ball_volume(n_dims) * F.pow(col(r), F.lit(float(n_dims)))


def l_function(r, n_dims: int) -> Column:
    """K brought back to a distance: the distance itself under complete randomness."""
    return F.pow(ripleys_k(r, n_dims) / unit_ball_volume(n_dims), F.lit(1.0 / n_dims))


def pair_correlation(r, n_dims: int) -> Column:
    return 1.0 + 0.0 * col(r)


@dataclass(frozen=True)
class Box:
    """A box by its lower and upper corner; a point on an upper face is outside."""

    lo: tuple[float, ...]
    hi: tuple[float, ...]

    def __post_init__(self):
        if len(self.lo) != len(self.hi) or not all(a < b for a, b in zip(self.lo, self.hi, strict=True)):
            raise ValueError("every side of a box is positive")

    @classmethod
    def of_size(cls, *sides: float) -> Box:
        return cls((0.0,) * len(sides), tuple(map(float, sides)))

    @property
    def n_dims(self) -> int:
        return len(self.lo)

    @property
    def sides(self) -> tuple[float, ...]:
        return tuple(b - a for a, b in zip(self.lo, self.hi, strict=True))

    @property
    def volume(self) -> float:
        return math.prod(self.sides)

    def contains(self, *coordinates: Column) -> Column:
        out = F.lit(True)
        for c, a, b in zip(coordinates, self.lo, self.hi, strict=True):
            out = out & (c >= float(a)) & (c < float(b))
        return out

    def uniform(self, *keys, seed: int = 0) -> list[Column]:
        """A place for each row that follows from its keys alone."""
        from brinkline.functions.distributions import uniform_of

        return [float(a) + float(s) * uniform_of(*keys, F.lit(i), seed=seed) for i, (a, s) in enumerate(zip(self.lo, self.sides, strict=True))]

    def grid(self, spark: SparkSession, nodes: int, names: list[str]) -> DataFrame:
        """Middles of nodes^n_dims equal cells, a row each: ``names`` and node."""
        rows = spark.range(nodes**self.n_dims).withColumnRenamed("id", "node")
        index = [F.floor(F.col("node") / nodes**i) % nodes for i in range(self.n_dims)]
        return rows.select("node", *[(float(a) + (k + 0.5) * (s / nodes)).alias(n) for k, a, s, n in zip(index, self.lo, self.sides, names, strict=True)])

    def halton(self, spark: SparkSession, n: int, names: list[str]) -> DataFrame:
        """The first ``n`` Halton points of the box, a row each: ``names`` and node."""
        return halton_points(spark, list(self.lo), list(self.hi), n, names)

    def integral(self, spark: SparkSession, f: Callable[..., Column], nodes: int = 64, points: int = 0) -> float:
        """Integral of ``f`` over the box: one aggregation over the grid, or over ``points`` Halton points, one number to the driver.

        A grid has ``nodes`` to the power of the dimensions; from three on points are the way.
        """
        if points:
            return integral_over(spark, f, list(self.lo), list(self.hi), points)
        names = [f"x{i}" for i in range(self.n_dims)]
        total = self.grid(spark, nodes, names).agg(F.sum(f(*[F.col(n) for n in names])).alias("s")).first().s
        return float(total) * self.volume / nodes**self.n_dims


def span_box(box: Box, t0: float, t1: float) -> Box:
    """Space and time as one box, time last."""
    return Box((*box.lo, t0), (*box.hi, t1))


@dataclass(frozen=True)
class HomogeneousSpatial:
    """A constant rate over a box; in space and time with a box from ``span_box``."""

    rate: float
    box: Box

    def intensity(self) -> Column:
        return F.lit(float(self.rate))

    def _counts(self, points: DataFrame, sequences: DataFrame, keys: list[str], coordinates: list[str]) -> DataFrame:
        inside = points.where(self.box.contains(*[F.col(c) for c in coordinates])).groupBy(*keys).agg(F.count("*").alias("n"))
        return sequences.select(*keys).distinct().join(inside, keys, "left").select(*keys, F.coalesce("n", F.lit(0)).alias("n"))

    def log_prob(self, points: DataFrame, sequences: DataFrame, keys: list[str], coordinates: list[str]) -> DataFrame:
        """(keys, n, log_lik, count_log_prob) for every key of ``sequences``, those without points too."""
        expected = self.rate * self.box.volume
        n = F.col("n")
        return self._counts(points, sequences, keys, coordinates).select(*keys, "n", (n * math.log(self.rate) - expected).alias("log_lik"), (n * math.log(expected) - expected - lgamma(n + 1.0)).alias("count_log_prob"))

    def predict_count(self, part: Box) -> tuple[float, float]:
        """(mean, variance) of the points in a part of the box."""
        return self.rate * part.volume, self.rate * part.volume

    def nearest_neighbor_distance(self) -> float:
        """Mean distance to the nearest point, edges aside."""
        d = self.box.n_dims
        return math.gamma(1 + 1 / d) / (self.rate * unit_ball_volume(d)) ** (1 / d)


@dataclass(frozen=True)
class InhomogeneousSpatial:
    """Any log intensity of the coordinates over a box; in space and time the last coordinate is the time."""

    log_intensity: Callable[..., Column]
    box: Box
    nodes: int = 64
    points: int = 0

    def intensity(self, *coordinates) -> Column:
        return F.exp(self.log_intensity(*map(col, coordinates)))

    def expected(self, spark: SparkSession, part: Box | None = None) -> float:
        return (part or self.box).integral(spark, self.intensity, self.nodes, self.points)

    def log_prob(self, points: DataFrame, sequences: DataFrame, keys: list[str], coordinates: list[str]) -> DataFrame:
        """(keys, n, log_lik) for every key of ``sequences``."""
        whole = self.expected(points.sparkSession)
        at = [F.col(c) for c in coordinates]
        inside = points.where(self.box.contains(*at)).groupBy(*keys).agg(F.count("*").alias("n"), F.sum(self.log_intensity(*at)).alias("ll"))
        rows = sequences.select(*keys).distinct().join(inside, keys, "left")
        return rows.select(*keys, F.coalesce("n", F.lit(0)).alias("n"), (F.coalesce("ll", F.lit(0.0)) - whole).alias("log_lik"))

    def predict_count(self, spark: SparkSession, part: Box) -> tuple[float, float]:
        mean = self.expected(spark, part)
        return mean, mean

    def marginal_temporal_intensity(self, spark: SparkSession, times: DataFrame) -> DataFrame:
        """``times`` (t) with rate: the intensity integrated over space, a fold of the space grid in each row."""
        d, n = self.box.n_dims - 1, self.nodes
        place = lambda i: [float(self.box.lo[k]) + (F.floor(i / n**k) % n + 0.5) * (self.box.sides[k] / n) for k in range(d)]
        total = F.aggregate(F.sequence(F.lit(0), F.lit(n**d - 1)), F.lit(0.0), lambda s, i: s + self.intensity(*place(i), F.col("t")))
        return times.withColumn("rate", total * (math.prod(self.box.sides[:d]) / n**d))

    def marginal_spatial_intensity(self, places: DataFrame, coordinates: list[str]) -> DataFrame:
        """``places`` with rate: the intensity integrated over time."""
        n, side, lo = self.nodes, self.box.sides[-1], float(self.box.lo[-1])
        at = [F.col(c) for c in coordinates]
        total = F.aggregate(F.sequence(F.lit(0), F.lit(n - 1)), F.lit(0.0), lambda s, i: s + self.intensity(*at, lo + (i.cast("double") + 0.5) * (side / n)))
        return places.withColumn("rate", total * (side / n))

    def surface_at(self, spark: SparkSession, t: float, nodes: int, names: list[str]) -> DataFrame:
        """The intensity on a grid of space at one time: (node, names, rate)."""
        space = Box(self.box.lo[:-1], self.box.hi[:-1])
        grid = space.grid(spark, nodes, names)
        return grid.withColumn("rate", self.intensity(*[F.col(n) for n in names], F.lit(float(t))))

    def cells(self, points: DataFrame, coordinates: list[str], bins: list[int], nodes: int = 8) -> DataFrame:
        """(cell, n, expected, pearson) of the box's cells in row-major order, empty ones too."""
        spark, d = points.sparkSession, self.box.n_dims
        steps = [s / b for s, b in zip(self.box.sides, bins, strict=True)]
        cell = F.lit(0).cast("long")
        for c, a, step, b in zip(coordinates, self.box.lo, steps, bins, strict=True):
            cell = cell * b + F.least(F.floor((F.col(c) - float(a)) / step), F.lit(b - 1))
        counts = points.where(self.box.contains(*[F.col(c) for c in coordinates])).groupBy(cell.alias("cell")).agg(F.count("*").alias("n"))
        spine = spark.range(math.prod(bins)).withColumnRenamed("id", "cell")
        index, rest = [], F.col("cell")
        for b in reversed(bins):
            index.insert(0, rest % b)
            rest = F.floor(rest / b)
        start = [float(a) + k * step for a, k, step in zip(self.box.lo, index, steps, strict=True)]
        at = lambda i: [s + (F.floor(i / nodes**k) % nodes + 0.5) * (step / nodes) for k, (s, step) in enumerate(zip(start, steps, strict=True))]
        mass = F.aggregate(F.sequence(F.lit(0), F.lit(nodes**d - 1)), F.lit(0.0), lambda s, i: s + self.intensity(*at(i))) * (math.prod(steps) / nodes**d)
        rows = spine.withColumn("expected", mass).join(counts, "cell", "left").withColumn("n", F.coalesce("n", F.lit(0)))
        return rows.select("cell", "n", "expected", ((F.col("n") - F.col("expected")) / F.sqrt("expected")).alias("pearson"))

    def chi_square(self, points: DataFrame, coordinates: list[str], bins: list[int], nodes: int = 8) -> DataFrame:
        """(chi_square, cells): the sum of squared Pearson residuals."""
        return self.cells(points, coordinates, bins, nodes).agg(F.sum(F.col("pearson") * F.col("pearson")).alias("chi_square"), F.count("*").alias("cells"))


def spatial_marks_log_prob(points: DataFrame, keys: list[str], log_density: Column) -> DataFrame:
    """(keys, mark_ll): the sum of the marks' log densities, which may depend on the place."""
    return points.groupBy(*keys).agg(F.sum(log_density).alias("mark_ll"))


@dataclass(frozen=True)
class SpatioTemporalHawkes:
    """mu + alpha sum of beta exp(-beta (t - s)) times a normal density of the distance, over strictly earlier events.

    Events further back than ``memory`` decay times, or further away than ``spread`` standard deviations, count as
    nothing: 37 and 9 leave less than 1e-16 of a kernel. What is left meets by a join on buckets of time and place.
    """

    mu: float
    alpha: float
    beta: float
    sigma: float
    box: Box
    t0: float
    t1: float
    memory: float = 37.0
    spread: float = 9.0

    def lambda_max(self, n: Column) -> Column:
        """A bound on the intensity behind ``n`` events."""
        return self.mu + n * (self.alpha * self.beta * (2 * math.pi) ** (-self.box.n_dims / 2) / self.sigma**self.box.n_dims)

    def intensity(self, events: DataFrame, queries: DataFrame, coordinates: list[str]) -> DataFrame:
        """``queries`` (coordinates, t, ...) with rate.

        On a line the rate comes from moments of the events by cell of place, see ``_on_a_line``; with more coordinates
        from pairs, which in dense buckets are many.
        """
        if len(coordinates) == 1:
            return queries.join(self._on_a_line(events, queries, coordinates[0]), [*coordinates, "t"])
        wide, far = self.memory / self.beta, self.spread * self.sigma
        slot = lambda c, w: F.floor(c / w)
        sides = [F.floor(F.col(c) / far) for c in coordinates]
        asked = queries.select(*coordinates, F.col("t").cast("double").alias("t")).distinct()
        asked = asked.withColumn("bt", slot(F.col("t"), wide))
        for c, b in zip(coordinates, sides, strict=True):
            asked = asked.withColumn(f"b_{c}", b)
        past = events.groupBy(*[F.col(c).alias(f"e_{c}") for c in coordinates], F.col("t").cast("double").alias("s")).agg(F.count("*").alias("m"))
        past = past.withColumn("bt", F.explode(F.array(slot(F.col("s"), wide), slot(F.col("s"), wide) + 1)))
        for c in coordinates:
            at = F.floor(F.col(f"e_{c}") / far)
            past = past.withColumn(f"b_{c}", F.explode(F.array(at - 1, at, at + 1)))
        square = sum(((F.col(c) - F.col(f"e_{c}")) * (F.col(c) - F.col(f"e_{c}")) for c in coordinates), F.lit(0.0))
        d = len(coordinates)
        peak = self.alpha * self.beta * (2 * math.pi) ** (-d / 2) / self.sigma**d
        gap = F.col("t") - F.col("s")
        weight = F.when((gap > 0) & (gap <= wide) & (square <= far * far), F.col("m") * peak * F.exp(-self.beta * gap - square / (2 * self.sigma**2))).otherwise(0.0)
        rates = asked.join(past, ["bt", *[f"b_{c}" for c in coordinates]], "left").groupBy(*coordinates, "t").agg((self.mu + F.sum(weight)).alias("rate"))
        return queries.join(rates, [*coordinates, "t"])

    def _on_a_line(self, events: DataFrame, queries: DataFrame, place: str, chunk_rows: int = CHUNK_POINTS) -> DataFrame:
        """(place, t, rate) of the distinct queries, in time proportional to the rows.

        A normal density around y is a series in the offset of y from the middle of a cell sigma wide: Hermite functions
        of the query's place times powers of the offset, of which ``TERMS`` leave less than 1e-15. Powers are summed by
        cell and decay with time. Rows are ranged by time into chunks, where equal times stay together; a chunk gets the
        sums of those before it, no more than a row a cell.
        """
        wide, beta = self.memory / self.beta, self.beta
        at = [F.col(place).cast("double").alias("x"), F.col("t").cast("double").alias("t")]
        rows = events.select(*at, F.lit(1).alias("m"), F.lit(0).alias("ask")).union(queries.select(*at, F.lit(0), F.lit(1)))
        rows = rows.where("x is not null and t is not null").groupBy("x", "t").agg(F.sum("m").cast("double").alias("m"), F.max("ask").alias("ask"))
        rows = materialize(rows, shared_root(events.sparkSession), "points")
        chunks = max(1, -(-rows.count() // chunk_rows))
        rows = materialize(rows.repartitionByRange(chunks, "t").withColumn("chunk", F.spark_partition_id()), shared_root(events.sparkSession), "chunks")
        spans = rows.groupBy("chunk").agg(F.min("t").alias("first"), F.max("t").alias("last"))
        cell = F.floor(F.col("x") / self.sigma)
        offset = F.col("x") / self.sigma - F.col("cell") - 0.5
        old = rows.where("m > 0").join(F.broadcast(spans), "chunk").withColumn("cell", cell).withColumn("w", F.col("m") * F.exp(-beta * (F.col("last") - F.col("t"))))
        names = [f"s{k}" for k in range(TERMS)]
        sums = old.groupBy("chunk", "cell", "last").agg(*[F.sum(F.col("w") * F.pow(offset, F.lit(float(k))) / float(math.factorial(k))).alias(n) for k, n in enumerate(names)])
        later = spans.select(F.col("chunk").alias("to"), F.col("first"))
        met = sums.join(F.broadcast(later), (F.col("to") > F.col("chunk")) & (F.col("first") - F.col("last") <= wide))
        fade = F.exp(-beta * (F.col("first") - F.col("last")))
        carried = met.groupBy(F.col("to").alias("chunk"), "cell", "first").agg(*[F.sum(F.col(n) * fade).alias(n) for n in names])
        mu, sigma, peak, far = self.mu, self.sigma, self.alpha * beta / (math.sqrt(2 * math.pi) * self.sigma), self.spread + 0.5

        def rates(points: pd.DataFrame, before: pd.DataFrame) -> pd.DataFrame:
            points = points.sort_values("t", kind="stable")
            x, t, m = (points[c].to_numpy() for c in ("x", "t", "m"))
            cells = np.floor(x / sigma).astype(np.int64)
            shift = x / sigma - cells - 0.5
            powers = np.cumprod(np.column_stack([m, *[shift / k for k in range(1, TERMS)]]), axis=1)
            state = {int(c): v for c, v in zip(before["cell"], before[names].to_numpy(), strict=True)}
            out, ref, width = np.zeros(len(t)), float(before["first"].iloc[0]) if len(before) else 0.0, 8.0 / beta
            slots = np.floor(t / width)
            starts = np.flatnonzero(np.r_[True, slots[1:] != slots[:-1]]) if len(t) else []
            for lo, hi in zip(starts, np.r_[starts[1:], len(t)], strict=True):
                begin = float(slots[lo]) * width
                scale = math.exp(max(-beta * (begin - ref), -745.0))
                state, ref = {c: v * scale for c, v in state.items() if scale}, begin
                now, there, u = t[lo:hi], cells[lo:hi], x[lo:hi] / sigma
                grown = powers[lo:hi] * np.exp(beta * (now - begin))[:, None]
                total = np.zeros(hi - lo)
                for c in {*state, *np.unique(there[m[lo:hi] > 0]).tolist()}:
                    own = np.flatnonzero((there == c) & (m[lo:hi] > 0))
                    upto = np.vstack([np.zeros(TERMS), np.cumsum(grown[own], axis=0)]) + state.get(c, 0.0)
                    near = np.flatnonzero(np.abs(u - c - 0.5) <= far)
                    v = u[near] - c - 0.5
                    sums = upto[np.searchsorted(now[own], now[near], "left")]
                    one, two, acc = np.ones(len(near)), v, sums[:, 0].copy()
                    for k in range(1, TERMS):
                        acc += sums[:, k] * two
                        one, two = two, v * two - k * one
                    total[near] += acc * np.exp(-0.5 * v * v)
                    state[c] = upto[-1]
                out[lo:hi] = total * np.exp(-beta * (now - begin))
            done = pd.DataFrame({place: x, "t": t, "rate": mu + peak * out})
            return done[points["ask"].to_numpy() == 1]

        return rows.groupBy("chunk").cogroup(carried.groupBy("chunk")).applyInPandas(rates, f"`{place}` double, t double, rate double")

    def compensator(self, events: DataFrame, coordinates: list[str], boundary: bool = True) -> Column:
        """An aggregate over events: the integral of the intensity over the box from t0 to t1."""
        inside = F.lit(1.0)
        if boundary:
            for c, a, b in zip(coordinates, self.box.lo, self.box.hi, strict=True):
                scale = self.sigma * math.sqrt(2)
                inside = inside * 0.5 * (erf((float(b) - F.col(c)) / scale) - erf((float(a) - F.col(c)) / scale))
        ahead = F.greatest(self.t1 - F.col("t"), F.lit(0.0))
        return self.mu * self.box.volume * (self.t1 - self.t0) + self.alpha * F.coalesce(F.sum((1.0 - F.exp(-self.beta * ahead)) * inside), F.lit(0.0))

    def log_prob(self, events: DataFrame, coordinates: list[str], boundary: bool = True) -> DataFrame:
        """(n, sum_log_rate, compensator, log_lik) of one sequence."""
        rows = self.intensity(events, events, coordinates)
        found = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.log(F.greatest("rate", F.lit(FLOOR)))), F.lit(0.0)).alias("sum_log_rate"), self.compensator(events, coordinates, boundary).alias("compensator"))
        return found.withColumn("log_lik", F.col("sum_log_rate") - F.col("compensator"))
