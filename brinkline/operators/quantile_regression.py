"""Linear quantile regression, fitted by passes over the rows that return one small matrix each.

The passes lead close to the optimum, which runs through as many rows as there are coefficients. Rows away from the
line keep their side, so that their loss is linear there: one sum stands for all of them, and the rows next to the line,
a bounded number, are solved exactly with it. That no other row changed its side proves the result.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brinkline.operators.positions import same_keys
from brinkline.plans.shared import materialize, shared_root


def _vertex(x: np.ndarray, y: np.ndarray, quantile: float, pull: np.ndarray, beta: np.ndarray, steps: int = 500, weights: np.ndarray | None = None) -> tuple[np.ndarray, bool]:
    """Coefficients that minimise the pinball loss of a few rows plus ``pull`` times the coefficients, from ``beta`` on.

    Goes from one line through d rows to the next: lets go of one row, moves along the edge that falls most steeply to
    where the slope turns, and takes the row that lies there. Equal rows are one row of their number's weight: a copy of a row on
    the line would otherwise lie a rounding error beside it and end the way there. The second result is false where the
    loss still falls beyond the last of these rows: then the least lies among rows that ``pull`` stands for.
    """
    d = x.shape[1]
    rows, place = np.unique(np.column_stack([x, y]), axis=0, return_inverse=True)
    m = np.bincount(place.ravel(), weights, len(rows)).astype(float)
    x, y = rows[:, :d], rows[:, d]
    basis: list[int] = []
    for i in np.argsort(np.abs(y - x @ beta)):
        if np.linalg.matrix_rank(x[[*basis, int(i)]]) > len(basis):
            basis.append(int(i))
        if len(basis) == d:
            break
    if len(basis) < d:
        return beta, False
    best, inside = None, True
    for _ in range(steps):
        inverse = np.linalg.inv(x[basis])
        beta = inverse @ y[basis]
        r = y - x @ beta
        r[basis] = 0.0
        loss = float((m * np.maximum(quantile * r, (quantile - 1) * r)).sum() + pull @ beta)
        if best is not None and loss >= best[0] - 1e-12 * abs(best[0]):
            return best[1], inside
        best, inside = (loss, beta), True
        move = None
        for k in range(d):
            for sign in (1.0, -1.0):
                way = sign * inverse[:, k]
                along = x @ way  # a residual falls by this along the way
                others = np.abs(r) > 1e-12
                slope = float(-(m * (quantile - (r < 0)) * along)[others].sum() + pull @ way + (m * np.maximum(-quantile * along, (1 - quantile) * along))[~others].sum())
                if slope < -1e-9 and (move is None or slope < move[0]):
                    move = (slope, k, along, others)
        if move is None:
            return beta, True
        slope, k, along, others = move
        reach = np.full(len(r), np.inf)
        some = others & (np.abs(along) > 1e-14)
        reach[some] = r[some] / along[some]
        ahead = np.flatnonzero(np.isfinite(reach) & (reach > 0))
        if not len(ahead):
            return beta, False
        ahead = ahead[np.argsort(reach[ahead], kind="stable")]
        slopes = slope + np.cumsum(m[ahead] * np.abs(along[ahead]))  # the rows passed change their side
        turned = np.flatnonzero(slopes >= 0)
        inside = len(turned) > 0
        basis[k] = int(ahead[turned[0] if inside else -1])
    return best[1], False


@dataclass
class QuantileRegressor:
    """Coefficients that minimise the pinball loss at ``quantile``, plus ``alpha`` times their absolute sum over the rows' number.

    Majorise-minimise: the loss of a residual r is bounded by a parabola of weight 1 / (eps + |r|), so a pass solves
    weighted normal equations, whose few cells are one aggregation; eps is lowered from pass to pass. Without a penalty
    the result is then made exact with about ``near`` rows at a time on the driver; ``exact`` tells whether it was.
    """

    quantile: float = 0.5
    alpha: float = 0.0
    passes: int = 25
    near: int = 2_000
    tolerance: float = 1e-9
    coef: list[float] = field(default_factory=list)
    intercept: float = 0.0
    exact: bool = False

    def fit(self, rows: DataFrame, features: list[str], target: str) -> QuantileRegressor:
        """Rows with a null or NaN in a used column are left out; without rows an error is raised."""
        if not 0 < self.quantile < 1:
            raise ValueError("a quantile lies between 0 and 1")
        used = [*features, target]
        kept = rows.select(*[F.col(c).cast("double").alias(c) for c in used])
        for c in used:
            kept = kept.where(F.col(c).isNotNull() & ~F.isnan(c))
        kept = materialize(kept.groupBy(*used).agg(F.count("*").alias("brinkline_m")), shared_root(rows.sparkSession), "regression")
        m = F.col("brinkline_m")  # equal rows are one row of this weight
        stats = kept.agg(F.sum(m).alias("n"), F.count("*").alias("rows"), *[F.avg(c).alias(f"m_{c}") for c in used], *[F.stddev_pop(c).alias(f"s_{c}") for c in used]).first()
        if not stats.n:
            raise ValueError("no rows to fit")
        mean, scale = ({c: float(stats[f"{k}_{c}"]) for c in used} for k in ("m", "s"))
        unit = {c: scale[c] or 1.0 for c in used}
        x = [F.lit(1.0), *[(F.col(c) - mean[c]) / unit[c] for c in features]]
        y = (F.col(target) - mean[target]) / unit[target]
        d = len(x)
        beta, eps, loss = np.zeros(d), 1.0, np.inf
        beta[0] = (float(kept.select(F.percentile_approx(target, F.lit(self.quantile)).alias("q")).first().q) - mean[target]) / unit[target]
        for k in range(self.passes):
            r = y - sum((x[i] * float(beta[i]) for i in range(d)), F.lit(0.0))
            w = m / (float(eps) + F.abs(r))
            cells = [F.sum(w * x[i] * x[j]).alias(f"g{i}_{j}") for i in range(d) for j in range(i, d)]
            found = kept.agg(*cells, *[F.sum(w * x[i] * y).alias(f"y{i}") for i in range(d)], *[F.sum(m * x[i]).alias(f"x{i}") for i in range(d)], (F.sum(m * F.greatest(self.quantile * r, (self.quantile - 1.0) * r)) / float(stats.n)).alias("loss")).first()
            gram = np.array([[found[f"g{min(i, j)}_{max(i, j)}"] for j in range(d)] for i in range(d)])
            right = np.array([found[f"y{i}"] + (2 * self.quantile - 1) * found[f"x{i}"] for i in range(d)])
            penalty = np.diag([0.0, *[2 * self.alpha * stats.n / (eps + abs(b)) for b in beta[1:]]])
            if loss - found.loss < self.tolerance and eps <= 1e-8:
                break
            loss, beta = found.loss, np.linalg.lstsq(gram + penalty, right, rcond=None)[0]
            eps = max(1e-9, eps * 0.7)
        self.exact, near = False, self.near
        for _ in range(40 if not self.alpha else 0):
            r = y - sum((x[i] * float(beta[i]) for i in range(d)), F.lit(0.0))
            cut = kept.agg(F.percentile_approx(F.abs(r), F.lit(min(1.0, near / stats.rows)), F.lit(10_000)).alias("c")).first().c
            away = F.abs(r) > float(cut)
            side = F.lit(self.quantile) - (r < 0).cast("double")
            pull = kept.where(away).agg(*[F.sum(-m * side * x[i]).alias(f"p{i}") for i in range(d)]).first()
            rows_ = kept.where(~away).select(*[c.alias(f"x{i}") for i, c in enumerate(x)], y.alias("y"), m.alias("m")).limit(20 * self.near + 1).collect()
            if len(rows_) > 20 * self.near:  # too many rows equally near: the passes' result stays
                break
            a, b = np.array([[q[f"x{i}"] for i in range(d)] for q in rows_]), np.array([q.y for q in rows_])
            found, inside = _vertex(a, b, self.quantile, np.array([pull[f"p{i}"] or 0.0 for i in range(d)]), beta, weights=np.array([q.m for q in rows_]))
            now = y - sum((x[i] * float(found[i]) for i in range(d)), F.lit(0.0))
            moved = kept.where(away & (F.signum(now) != F.signum(r))).limit(1).count()
            if inside and not moved:
                beta, self.exact = found, True
                break
            # the least is further away than these rows: as far that way as the loss of all rows falls
            steps = [0.0, *[0.5**k for k in range(30)]]
            tried = [y - sum((x[i] * float(beta[i] + t * (found[i] - beta[i])) for i in range(d)), F.lit(0.0)) for t in steps]
            losses = kept.agg(*[F.sum(m * F.greatest(self.quantile * r, (self.quantile - 1.0) * r)) for r in tried]).first()
            beta, near = beta + steps[int(np.argmin(losses))] * (found - beta), min(2 * near, 10 * self.near)
        self.coef = [float(beta[i + 1] * unit[target] / unit[c]) for i, c in enumerate(features)]
        self.intercept = float(mean[target] + beta[0] * unit[target] - sum(b * mean[c] for b, c in zip(self.coef, features, strict=True)))
        return self

    def predict(self, *features: Column | str) -> Column:
        columns = [F.col(c) if isinstance(c, str) else c for c in features]
        return F.lit(self.intercept) + sum((F.lit(b) * c for b, c in zip(self.coef, columns, strict=True)), F.lit(0.0))


def with_covariates(rows: DataFrame, covariates: DataFrame, on: list[str], names: list[str]) -> DataFrame:
    """``rows`` with the covariates ``names`` of their key and time, NULL where there are none; rows stay as they are.

    ``covariates`` have one row for each value of ``on`` (more are an error), in any order; NULL meets NULL.
    """
    if covariates.groupBy(*on).count().where("count > 1").limit(1).count():
        raise ValueError("covariates have several rows for one place")
    side = covariates.select(*[F.col(c).alias(f"brinkline_{c}") for c in on], *names)
    kept = rows.drop(*names)
    found = kept.join(side, same_keys(kept, side, {c: f"brinkline_{c}" for c in on}), "left")
    return found.select(*[kept[c] for c in kept.columns], *names)


def _weighted(x: np.ndarray, y: np.ndarray, quantile: float, beta: np.ndarray, eps: float) -> tuple[np.ndarray, np.ndarray]:
    """Normal equations of the parabolas that bound the losses at ``beta``."""
    w = 1.0 / (eps + np.abs(y - x @ beta))
    return (x * w[:, None]).T @ x, x.T @ (w * y) + (2 * quantile - 1) * x.sum(0)


def _independent(x: np.ndarray) -> list[int]:
    """Columns that aren't sums of those before them."""
    found: list[int] = []
    for i in range(x.shape[1]):
        if np.linalg.matrix_rank(x[:, [*found, i]]) > len(found):
            found.append(i)
    return found


def _exact(x: np.ndarray, y: np.ndarray, quantile: float, pull: np.ndarray, beta: np.ndarray) -> tuple[np.ndarray, bool]:
    """``_vertex`` for columns that may depend on each other: those that do get a coefficient of 0."""
    use, out = _independent(x), np.zeros(x.shape[1])
    out[use], inside = _vertex(x[:, use], y, quantile, pull[use], beta[use])
    return out, inside


def _local_fit(x: np.ndarray, y: np.ndarray, quantile: float, passes: int) -> np.ndarray:
    beta, eps = np.zeros(x.shape[1]), 1.0
    beta[0] = np.quantile(y, quantile)
    for _ in range(passes):
        gram, right = _weighted(x, y, quantile, beta, eps)
        beta, eps = np.linalg.lstsq(gram, right, rcond=None)[0], max(1e-9, eps * 0.6)
    return _exact(x, y, quantile, np.zeros(x.shape[1]), beta)[0]


def fit_by_key(rows: DataFrame, keys: list[str], features: list[str], target: str, quantile: float, local_rows: int = 50_000, near: int = 2_000, passes: int = 30) -> DataFrame:
    """(keys, n, coefficients, exact, flat): the line of each key, intercept first, all keys in one go.

    Rows with a null or NaN in a used column are left out; keys without others have no row here. A key of up to
    ``local_rows`` rows is one call's work. Longer ones share passes over all their rows that leave one small matrix a
    key; then the rows next to a key's line, about ``near``, are solved exactly with one sum for all others. ``exact``
    is false where a row changed its side in that, or more than ten times ``near`` rows lie equally near. ``flat`` is true
    where one of the features never changes in the key, so that its coefficient of 0 is a choice.
    """
    if not 0 < quantile < 1:
        raise ValueError("a quantile lies between 0 and 1")
    spark, root = rows.sparkSession, shared_root(rows.sparkSession)
    held, d = [f"brinkline_{k}" for k in keys], len(features) + 1
    xs = [f"x{i}" for i in range(1, d)]
    kept = rows.select(*[F.col(k).alias(h) for k, h in zip(keys, held, strict=True)], *[F.col(c).cast("double").alias(x) for c, x in zip(features, xs, strict=True)], F.col(target).cast("double").alias("y"))
    for c in [*xs, "y"]:
        kept = kept.where(F.col(c).isNotNull() & ~F.isnan(c))
    kept = materialize(kept, root, "rows")
    columns = [*xs, "y"]
    stats = kept.groupBy(*held).agg(F.count("*").alias("n"), *[F.avg(c).alias(f"mean_{c}") for c in columns], *[F.stddev_pop(c).alias(f"unit_{c}") for c in columns], F.percentile_approx("y", F.lit(quantile)).alias("start"), reduce(lambda a, b: a | b, [F.min(x) == F.max(x) for x in xs], F.lit(False)).alias("flat"))
    stats = materialize(stats.withColumns({f"unit_{c}": F.when(F.col(f"unit_{c}") > 0, F.col(f"unit_{c}")).otherwise(1.0) for c in columns}), root, "stats")
    about = [F.col(h).alias(f"stats_{h}") for h in held]

    def scaled(some: DataFrame) -> DataFrame:
        """Rows (keys, x, y) of these keys in units of their own."""
        side = some.select(*about, *[f"{k}_{c}" for k in ("mean", "unit") for c in columns])
        met = kept.join(side, same_keys(kept, side, {h: f"stats_{h}" for h in held}))
        z = [((F.col(c) - F.col(f"mean_{c}")) / F.col(f"unit_{c}")).alias(c) for c in columns]
        return met.select(*held, *z)

    key_fields = [f for f in kept.schema.fields if f.name in held]
    found_schema = T.StructType([*key_fields, *T._parse_datatype_string("beta array<double>, exact boolean").fields])

    def local(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(columns)
        x = np.column_stack([np.ones(len(pdf)), *[pdf[c].to_numpy() for c in xs]])
        out = pdf[held].iloc[:1].copy()
        out["beta"], out["exact"] = [_local_fit(x, pdf["y"].to_numpy(), quantile, passes).tolist()], True
        return out

    found = scaled(stats.where(F.col("n") <= local_rows)).groupBy(*held).applyInPandas(local, found_schema)
    long = stats.where(F.col("n") > local_rows)
    if long.limit(1).count():
        found = found.union(_long_fits(scaled(long), long, held, xs, quantile, near, passes, root))
    found = materialize(found, root, "fits")
    side = found.select(*[F.col(h).alias(f"fit_{h}") for h in held], "beta", "exact")
    met = stats.join(side, same_keys(stats, side, {h: f"fit_{h}" for h in held}))
    slopes = [F.col("beta")[i] * F.col("unit_y") / F.col(f"unit_{x}") for i, x in enumerate(xs, 1)]
    intercept = F.col("mean_y") + F.col("beta")[0] * F.col("unit_y")
    for slope, x in zip(slopes, xs, strict=True):
        intercept = intercept - slope * F.col(f"mean_{x}")
    return met.select(*[F.col(h).alias(k) for k, h in zip(keys, held, strict=True)], "n", F.array(intercept, *slopes).alias("coefficients"), "exact", "flat")


def _long_fits(rows: DataFrame, stats: DataFrame, held: list[str], xs: list[str], quantile: float, near: int, passes: int, root: str) -> DataFrame:
    """(keys, beta, exact) of keys too long for a call, by passes that share their rows."""
    d, rows = len(xs) + 1, materialize(rows, root, "long-rows")
    x = [F.lit(1.0), *map(F.col, xs)]
    first = (F.col("start") - F.col("mean_y")) / F.col("unit_y")
    betas = materialize(stats.select(*held, F.array(first, *[F.lit(0.0)] * (d - 1)).alias("beta")), root, "beta-0")
    fields = [f for f in rows.schema.fields if f.name in held]

    def beside(table: DataFrame, rows: DataFrame = rows) -> DataFrame:
        side = table.select(*[F.col(h).alias(f"b_{h}") for h in held], *[c for c in table.columns if c not in held])
        return rows.join(side, same_keys(rows, side, {h: f"b_{h}" for h in held})).drop(*[f"b_{h}" for h in held])

    def residual(beta: str = "beta") -> Column:
        return F.col("y") - sum((F.col(beta)[i] * x[i] for i in range(d)), F.lit(0.0))

    def solve(batches):
        for pdf in batches:
            out = pdf[held].copy()
            gram = [[pdf[f"g{min(i, j)}_{max(i, j)}"].to_numpy() for j in range(d)] for i in range(d)]
            right = [pdf[f"r{i}"].to_numpy() for i in range(d)]
            out["beta"] = [np.linalg.lstsq(np.array([[gram[i][j][k] for j in range(d)] for i in range(d)]), np.array([right[i][k] for i in range(d)]), rcond=None)[0].tolist() for k in range(len(pdf))]
            yield out

    eps = 1.0
    for k in range(passes):
        w = 1.0 / (eps + F.abs(residual()))
        cells = [F.sum(w * x[i] * x[j]).alias(f"g{i}_{j}") for i in range(d) for j in range(i, d)]
        right = [(F.sum(w * x[i] * F.col("y")) + (2 * quantile - 1) * F.sum(x[i])).alias(f"r{i}") for i in range(d)]
        matrices = beside(betas).groupBy(*held).agg(*cells, *right)
        schema = T.StructType([*fields, T.StructField("beta", T.ArrayType(T.DoubleType()))])
        betas, eps = materialize(matrices.mapInPandas(solve, schema), root, f"beta-{k + 1}"), max(1e-9, eps * 0.6)
    # the rows next to each line, and one sum for all others
    at = beside(betas).withColumn("r", residual())
    levels = F.array(*[F.lit(0.5**j) for j in range(31)])
    ranked = at.groupBy(*held).agg(F.percentile_approx(F.abs("r"), levels, F.lit(10_000)).alias("q"), F.count("*").alias("m"))
    level = F.greatest(F.least(F.floor(F.log2(F.col("m") / near)), F.lit(30)), F.lit(0)).cast("int")
    cuts = ranked.select(*held, F.col("q")[level].alias("cut"))
    at = materialize(beside(cuts, at).withColumn("away", F.abs("r") > F.col("cut")), root, "sided")
    side = F.lit(quantile) - (F.col("r") < 0).cast("double")
    pulls = at.groupBy(*held, "beta").agg(F.array(*[F.coalesce(F.sum(F.when(F.col("away"), -side * x[i])), F.lit(0.0)) for i in range(d)]).alias("pull"), F.count(F.when(~F.col("away"), 1)).alias("m"))
    close = beside(pulls.drop("beta"), at.where(~F.col("away"))).where(F.col("m") <= 10 * near)

    def exactly(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([*xs, "y"])
        a = np.column_stack([np.ones(len(pdf)), *[pdf[c].to_numpy() for c in xs]])
        out = pdf[held].iloc[:1].copy()
        line, inside = _exact(a, pdf["y"].to_numpy(), quantile, np.array(pdf["pull"].iloc[0]), np.array(pdf["beta"].iloc[0]))
        out["better"] = [line.tolist()]
        return out if inside else out.iloc[:0]

    better = close.groupBy(*held).applyInPandas(exactly, T.StructType([*fields, T.StructField("better", T.ArrayType(T.DoubleType()))]))
    better = materialize(better, root, "better")
    moved = beside(better, at).where(F.col("away") & (F.signum(residual("better")) != F.signum("r"))).select(*held).distinct().withColumn("moved", F.lit(True))
    told = betas
    for side, name in ((better, "better"), (moved, "moved")):
        side = side.select(*[F.col(h).alias(f"{name}_{h}") for h in held], name)
        told = told.join(side, same_keys(told, side, {h: f"{name}_{h}" for h in held}), "left")
    return told.select(*held, F.coalesce("better", "beta").alias("beta"), (F.col("better").isNotNull() & F.col("moved").isNull()).alias("exact"))


def threshold_by_key(rows: DataFrame, keys: list[str], features: list[str], quantile: float = 0.95, value: str = "value", flat: bool = True, **options) -> DataFrame:
    """``rows`` with threshold, the fitted quantile of ``value`` given the features of its key, and exceeds.

    NULL where a feature is missing or the key has no line; thresholds are given for rows without a value too. Without
    ``flat``, keys in which a feature never changes have no line, as no two of their rows tell one.
    """
    fits = fit_by_key(rows, keys, features, value, quantile, **options)
    fits = (fits if flat else fits.where(~F.col("flat"))).select(*[F.col(k).alias(f"fit_{k}") for k in keys], "coefficients")
    kept = rows.drop("threshold", "exceeds")
    met = kept.join(fits, same_keys(kept, fits, {k: f"fit_{k}" for k in keys}), "left")
    line = F.col("coefficients")[0]
    for i, c in enumerate(features, 1):
        line = line + F.col("coefficients")[i] * kept[c]
    done = met.select(*[kept[c] for c in kept.columns], line.alias("threshold"))
    return done.withColumn("exceeds", F.col(value) > F.col("threshold"))


def years_of(time: Column) -> Column:
    """A timestamp as years since 1970, a feature of trends."""
    return F.unix_micros(time.cast("timestamp")) / 3.15576e13


def regression_threshold(rows: DataFrame, features: list[str], quantile: float = 0.95, value: str = "value") -> DataFrame:
    """``rows`` with threshold, the fitted quantile of ``value`` given the features, and exceeds."""
    model = QuantileRegressor(quantile).fit(rows, features, value)
    done = rows.withColumn("threshold", model.predict(*features))
    return done.withColumn("exceeds", F.col(value) > F.col("threshold"))
