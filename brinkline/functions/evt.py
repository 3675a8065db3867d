"""Extreme-value distributions as Column expressions; every parameter may be a column or a number.

The generalised extreme-value family covers Fréchet (shape > 0) and Weibull (shape < 0); near shape 0 the Gumbel and
exponential limits are used. Dead branches are guarded, because ANSI arithmetic raises on division by zero.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from brinkline.functions.special import EULER, INF, NAN, col, gamma, let, log_gamma_complex, safe_ln

CUTOFF = 1e-7


def _flat(shape: Column) -> Column:
    return F.abs(shape) < CUTOFF


def _guarded(shape: Column) -> Column:
    return F.when(_flat(shape), F.lit(1.0)).otherwise(shape)


def gev_log_prob(x, loc, scale, shape) -> Column:
    x, loc, scale, shape = map(col, (x, loc, scale, shape))
    z, xi = (x - loc) / scale, _guarded(shape)
    t = 1.0 + xi * z
    inside = F.when(t > 0, t).otherwise(1.0)
    general = -F.log(scale) - (1.0 + 1.0 / xi) * F.log(inside) - F.pow(inside, -1.0 / xi)
    return F.when(_flat(shape), gumbel_log_prob(x, loc, scale)).when(t > 0, general).otherwise(-INF)


def gev_cdf(x, loc, scale, shape) -> Column:
    x, loc, scale, shape = map(col, (x, loc, scale, shape))
    xi = _guarded(shape)
    t = 1.0 + xi * (x - loc) / scale
    inside = F.when(t > 0, t).otherwise(1.0)
    return F.when(_flat(shape), gumbel_cdf(x, loc, scale)).when(t > 0, F.exp(-F.pow(inside, -1.0 / xi))).otherwise(F.when(shape > 0, 0.0).otherwise(1.0))


def gev_survival(x, loc, scale, shape) -> Column:
    x, loc, scale, shape = map(col, (x, loc, scale, shape))
    xi = _guarded(shape)
    t = 1.0 + xi * (x - loc) / scale
    inside = F.when(t > 0, t).otherwise(1.0)
    return F.when(_flat(shape), -F.expm1(-F.exp(-(x - loc) / scale))).when(t > 0, -F.expm1(-F.pow(inside, -1.0 / xi))).otherwise(F.when(shape > 0, 1.0).otherwise(0.0))


def gev_icdf(q, loc, scale, shape) -> Column:
    q, loc, scale, shape = map(col, (q, loc, scale, shape))
    xi = _guarded(shape)
    return F.when(_flat(shape), gumbel_icdf(q, loc, scale)).otherwise(loc + scale / xi * (F.pow(-safe_ln(q), -xi) - 1.0))


def gev_mean(loc, scale, shape) -> Column:
    loc, scale, shape = map(col, (loc, scale, shape))
    xi = _guarded(shape)
    below = F.when(xi < 1, 1.0 - xi).otherwise(0.5)
    return F.when(_flat(shape), loc + EULER * scale).when(shape < 1, loc + scale / xi * (gamma(below) - 1.0)).otherwise(INF)


def _g(k: int, xi: Column) -> Column:
    return gamma(F.when(1.0 - k * xi > 0, 1.0 - k * xi).otherwise(0.5))


def gev_variance(loc, scale, shape) -> Column:
    scale, shape = col(scale), col(shape)
    xi = _guarded(shape)
    value = scale * scale / (xi * xi) * (_g(2, xi) - _g(1, xi) * _g(1, xi))
    return F.when(_flat(shape), scale * scale * (math.pi**2 / 6)).when(shape < 0.5, value).otherwise(INF)


def gev_skewness(loc, scale, shape) -> Column:
    """With the sign of the shape, so that it runs through the Gumbel value at shape 0."""
    shape = col(shape)
    xi = _guarded(shape)
    g1, g2, g3 = _g(1, xi), _g(2, xi), _g(3, xi)
    spread = F.when(g2 - g1 * g1 > 0, g2 - g1 * g1).otherwise(1.0)
    value = F.signum(xi) * (g3 - 3.0 * g2 * g1 + 2.0 * g1 * g1 * g1) / F.pow(spread, F.lit(1.5))
    return F.when(_flat(shape), F.lit(1.1395470994046486)).when(shape < 1 / 3, value).otherwise(INF)


def gev_mode(loc, scale, shape) -> Column:
    loc, scale, shape = map(col, (loc, scale, shape))
    xi = _guarded(shape)
    inner = loc + scale / xi * (F.pow(F.when(1.0 + xi > 0, 1.0 + xi).otherwise(1.0), -xi) - 1.0)
    return F.when(_flat(shape), loc).when(shape <= -1, loc - scale / xi).otherwise(inner)


def gev_median(loc, scale, shape) -> Column:
    return gev_icdf(0.5, loc, scale, shape)


def gev_entropy(loc, scale, shape) -> Column:
    return F.log(col(scale)) + EULER * col(shape) + (EULER + 1.0)


def gev_kurtosis(loc, scale, shape) -> Column:
    """Excess kurtosis; infinite from shape 1 / 4 on."""
    shape = col(shape)
    xi = _guarded(shape)
    g1, g2, g3, g4 = (_g(k, xi) for k in (1, 2, 3, 4))
    spread = F.when(g2 - g1 * g1 > 0, g2 - g1 * g1).otherwise(1.0)
    value = (g4 - 4.0 * g1 * g3 + 6.0 * g1 * g1 * g2 - 3.0 * g1 * g1 * g1 * g1) / (spread * spread) - 3.0
    return F.when(_flat(shape), F.lit(2.4)).when(shape < 0.25, value).otherwise(INF)


def gev_log_survival(x, loc, scale, shape) -> Column:
    return safe_ln(gev_survival(x, loc, scale, shape))


def gev_tail_index(loc, scale, shape) -> Column:
    """1 / shape for heavy tails, infinite for others."""
    shape = col(shape)
    return F.when(shape > 0, 1.0 / F.when(shape > 0, shape).otherwise(1.0)).otherwise(INF)


def gev_mean_excess(u, loc, scale, shape, terms: int = 160) -> Column:
    """E[X - u | X > u]: NaN for shape >= 1 and where nothing lies above ``u``.

    With tau = -ln F(u), the quantile function integrates over (0, tau) to incomplete gamma functions, summed here as
    series. Beyond tau = 40 nothing lies below ``u`` to double precision, and whole gamma functions take their place.
    """
    u, loc, scale, shape = map(col, (u, loc, scale, shape))
    given = F.struct(u.alias("u"), loc.alias("loc"), scale.alias("scale"), shape.alias("shape"))
    # folds evaluate what they name at every step, so what they name is computed before them
    return let(given, lambda g: _mean_excess(g["u"], g["loc"], g["scale"], g["shape"], terms))


def _mean_excess(u: Column, loc: Column, scale: Column, shape: Column, terms: int) -> Column:
    xi = _guarded(shape)
    t = 1.0 + xi * (u - loc) / scale
    inside = F.when(t > 0, t).otherwise(1.0)
    tau = F.when(_flat(shape), F.exp(-(u - loc) / scale)).when(t > 0, F.pow(inside, -1.0 / xi)).otherwise(F.when(shape > 0, 1e6).otherwise(0.0))

    def of(given: Column) -> Column:
        tau, a, xi = given["tau"], given["a"], given["xi"]
        all_ = tau > 40.0
        return let(F.when(all_, 40.0).when(tau > 0, tau).otherwise(1.0), lambda x: summed(x, tau, a, xi, all_))

    def summed(x: Column, tau: Column, a: Column, xi: Column, all_: Column) -> Column:
        start = F.struct((1.0 / a).alias("t"), F.lit(0.0).alias("s"))
        # lower incomplete gamma: x^a e^-x sum of x^n / (a (a + 1) ... (a + n))
        rising = F.aggregate(F.sequence(F.lit(1), F.lit(terms + 1)), start, lambda b, n: F.struct((b["t"] * (x / (a + n))).alias("t"), (b["s"] + b["t"]).alias("s")), lambda b: b["s"])
        lower = F.when(all_, gamma(a)).otherwise(F.pow(x, a) * F.exp(-x) * rising)
        # integral of (1 - e^-t) / t: e^-x sum of x^n / n! times the n-th harmonic number
        zero = F.struct(F.lit(1.0).alias("t"), F.lit(0.0).alias("h"), F.lit(0.0).alias("s"))
        harmonic = F.aggregate(F.sequence(F.lit(1), F.lit(terms)), zero, lambda b, n: F.struct((b["t"] * x / n).alias("t"), (b["h"] + 1.0 / n).alias("h"), (b["s"] + b["t"] * x / n * (b["h"] + 1.0 / n)).alias("s")), lambda b: b["s"])
        ein = F.when(all_, F.log(x) + EULER).otherwise(F.exp(-x) * harmonic)
        over = F.when(all_, 1.0).otherwise(-F.expm1(-x))
        flat = loc * over + scale * (F.when(all_, F.lit(EULER)).otherwise(ein - F.log(x) * over))
        whole = F.when(_flat(shape), flat).otherwise(loc * over + scale / xi * (lower - over))
        return F.when((shape >= 1) | (tau <= 0), NAN).otherwise(whole / over - u)

    return let(F.struct(tau.alias("tau"), F.when(shape < 1, 1.0 - xi).otherwise(1.0).alias("a"), xi.alias("xi")), of)


def gev_percentile_residual_life(t, share, loc, scale, shape) -> Column:
    """What is added to ``t`` until the given share of those beyond it has ended."""
    return gev_icdf(1.0 - (1.0 - col(share)) * gev_survival(t, loc, scale, shape), loc, scale, shape) - col(t)


def gumbel_moment_generating(t, loc, scale) -> Column:
    """E[exp(t X)]; infinite from t = 1 / scale on."""
    t, loc, scale = map(col, (t, loc, scale))
    below = 1.0 - scale * t
    return F.when(below > 0, F.exp(loc * t) * gamma(F.when(below > 0, below).otherwise(1.0))).otherwise(INF)


def gumbel_characteristic(t, loc, scale) -> Column:
    """E[exp(i t X)] as (re, im): exp(i loc t) Gamma(1 - i scale t), by the Lanczos series in complex numbers."""
    t, loc, scale = map(col, (t, loc, scale))
    lr, li = log_gamma_complex(F.lit(1.0), -scale * t)
    size, angle = F.exp(lr), li + loc * t
    return F.struct((size * F.cos(angle)).alias("re"), (size * F.sin(angle)).alias("im"))


def gumbel_paper(x, loc, scale) -> Column:
    """Coordinates (x, y) on probability paper, F kept within [1e-15, 1 - 1e-15]."""
    p = F.greatest(F.least(gumbel_cdf(x, loc, scale), F.lit(1.0 - 1e-15)), F.lit(1e-15))
    return F.struct(col(x).alias("x"), (-F.log(-F.log(p))).alias("y"))


def gev_hazard(x, loc, scale, shape) -> Column:
    s = gev_survival(x, loc, scale, shape)
    return F.when(s > 0, F.exp(gev_log_prob(x, loc, scale, shape)) / F.when(s > 0, s).otherwise(1.0)).otherwise(INF)


def gev_cumulative_hazard(x, loc, scale, shape) -> Column:
    return -safe_ln(gev_survival(x, loc, scale, shape))


def gev_return_level(period, loc, scale, shape) -> Column:
    return gev_icdf(1.0 - 1.0 / col(period), loc, scale, shape)


def gev_return_period(x, loc, scale, shape) -> Column:
    s = gev_survival(x, loc, scale, shape)
    return F.when(s > 0, 1.0 / F.when(s > 0, s).otherwise(1.0)).otherwise(INF)


def gumbel_log_prob(x, loc, scale) -> Column:
    z = (col(x) - col(loc)) / col(scale)
    return -F.log(col(scale)) - z - F.exp(-z)


def gumbel_cdf(x, loc, scale) -> Column:
    return F.exp(-F.exp(-(col(x) - col(loc)) / col(scale)))


def gumbel_icdf(q, loc, scale) -> Column:
    return col(loc) - col(scale) * safe_ln(-safe_ln(col(q)))


def gumbel_mean(loc, scale) -> Column:
    return col(loc) + EULER * col(scale)


def gumbel_return_level(period, loc, scale) -> Column:
    return gumbel_icdf(1.0 - 1.0 / col(period), loc, scale)


# Fréchet and Weibull functions are the family's, told apart by the sign of the shape alone.
frechet_log_prob = weibull_log_prob = gev_log_prob
frechet_cdf = weibull_cdf = gev_cdf
frechet_icdf = weibull_icdf = gev_icdf
frechet_mean = weibull_mean = gev_mean
frechet_return_level = weibull_return_level = gev_return_level


def gpd_log_prob(x, scale, shape) -> Column:
    x, scale, shape = map(col, (x, scale, shape))
    xi = _guarded(shape)
    t = 1.0 + xi * x / scale
    inside = F.when(t > 0, t).otherwise(1.0)
    value = F.when(_flat(shape), -F.log(scale) - x / scale).otherwise(-F.log(scale) - (1.0 + 1.0 / xi) * F.log(inside))
    return F.when((x >= 0) & (_flat(shape) | (t > 0)), value).otherwise(-INF)


def gpd_survival(x, scale, shape) -> Column:
    x, scale, shape = map(col, (x, scale, shape))
    xi = _guarded(shape)
    t = 1.0 + xi * x / scale
    inside = F.when(t > 0, t).otherwise(1.0)
    value = F.when(_flat(shape), F.exp(-x / scale)).when(t > 0, F.pow(inside, -1.0 / xi)).otherwise(0.0)
    return F.when(x < 0, 1.0).otherwise(value)


def gpd_cdf(x, scale, shape) -> Column:
    return 1.0 - gpd_survival(x, scale, shape)


def gpd_icdf(q, scale, shape) -> Column:
    q, scale, shape = map(col, (q, scale, shape))
    xi = _guarded(shape)
    return F.when(_flat(shape), -scale * safe_ln(1.0 - q)).otherwise(scale / xi * (F.pow(1.0 - q, -xi) - 1.0))


def gpd_mean(scale, shape) -> Column:
    scale, shape = col(scale), col(shape)
    return F.when(shape < 1, scale / F.when(shape < 1, 1.0 - shape).otherwise(1.0)).otherwise(INF)


def gpd_variance(scale, shape) -> Column:
    scale, shape = col(scale), col(shape)
    ok = shape < 0.5
    return F.when(ok, scale * scale / F.when(ok, (1.0 - shape) * (1.0 - shape) * (1.0 - 2.0 * shape)).otherwise(1.0)).otherwise(INF)


def gpd_hazard(x, scale, shape) -> Column:
    s = gpd_survival(x, scale, shape)
    return F.when(s > 0, F.exp(gpd_log_prob(x, scale, shape)) / F.when(s > 0, s).otherwise(1.0)).otherwise(INF)


def gpd_cumulative_hazard(x, scale, shape) -> Column:
    return -safe_ln(gpd_survival(x, scale, shape))


def gpd_mean_excess(u, scale, shape) -> Column:
    """E[X - u | X > u]; infinite for shape >= 1, NaN beyond a finite end."""
    u, scale, shape = map(col, (u, scale, shape))
    over = scale + shape * u
    return F.when(shape >= 1, INF).when(over <= 0, NAN).otherwise(over / F.when(shape < 1, 1.0 - shape).otherwise(1.0))


def gpd_return_level(period, scale, shape) -> Column:
    return gpd_icdf(1.0 - 1.0 / col(period), scale, shape)


def gpd_entropy(scale, shape) -> Column:
    return F.log(col(scale)) + col(shape) + 1.0


def gpd_skewness(scale, shape) -> Column:
    """Infinite from shape 1 / 3 on."""
    xi = col(shape)
    ok = xi < 1 / 3
    safe = F.when(ok, xi).otherwise(0.0)
    return F.when(ok, 2.0 * (1.0 + safe) * F.sqrt(1.0 - 2.0 * safe) / (1.0 - 3.0 * safe)).otherwise(INF)


def gpd_kurtosis(scale, shape) -> Column:
    """Excess kurtosis; infinite from shape 1 / 4 on."""
    xi = col(shape)
    ok = xi < 0.25
    safe = F.when(ok, xi).otherwise(0.0)
    return F.when(ok, 3.0 * (1.0 - 2.0 * safe) * (2.0 * safe * safe + safe + 3.0) / ((1.0 - 3.0 * safe) * (1.0 - 4.0 * safe)) - 3.0).otherwise(INF)


def gpd_tail_index(scale, shape) -> Column:
    return gev_tail_index(0.0, scale, shape)
