"""Special functions as Column expressions; Spark SQL has no log-gamma and no error function."""

from __future__ import annotations

import math
from collections.abc import Callable
from fractions import Fraction

from pyspark.sql import Column
from pyspark.sql import functions as F

EULER = 0.5772156649015329
INF, NAN = float("inf"), float("nan")
# Lanczos coefficients for g = 7.
_LANCZOS = (0.99999999999980993, 676.5203681218851, -1259.1392167224028, 771.32342877765313, -176.61502916214059, 12.507343278686905, -0.13857109526572012, 9.9843695780195716e-6, 1.5056327351493116e-7)


def col(x: Column | float) -> Column:
    return x if isinstance(x, Column) else F.lit(float(x))


def safe_ln(x: Column) -> Column:
    """ln with -inf at 0 and NULL below; Spark's own is NULL at 0 too."""
    return F.when(x > 0, F.log(x)).when(x == 0, F.lit(-INF))


def lgamma(x: Column | float) -> Column:
    """log Gamma for x > 0."""
    y = col(x) - 1.0
    series = F.lit(_LANCZOS[0])
    for i, c in enumerate(_LANCZOS[1:], 1):
        series = series + c / (y + float(i))
    t = y + 7.5
    return 0.5 * math.log(2 * math.pi) + (y + 0.5) * F.log(t) - t + F.log(series)


def gamma(x: Column | float) -> Column:
    return F.exp(lgamma(x))


def log_gamma_complex(re: Column | float, im: Column | float) -> tuple[Column, Column]:
    """(re, im) of log Gamma for a positive real part."""
    a, b = col(re) - 1.0, col(im)
    sr, si = F.lit(_LANCZOS[0]), F.lit(0.0)
    for i, c in enumerate(_LANCZOS[1:], 1):
        size = (a + float(i)) * (a + float(i)) + b * b
        sr, si = sr + c * (a + float(i)) / size, si - c * b / size
    t = a + 7.5
    lr, li = 0.5 * F.log(t * t + b * b), F.atan2(b, t)
    real = 0.5 * math.log(2 * math.pi) + (a + 0.5) * lr - b * li - t + 0.5 * F.log(sr * sr + si * si)
    return real, (a + 0.5) * li + b * lr - b + F.atan2(si, sr)


def let(x: Column, f: Callable[[Column], Column]) -> Column:
    """f(x) with x computed once, however often ``f`` names it; expressions stay small that way."""
    return F.transform(F.array(x), f)[0]


def log1mexp(x: Column) -> Column:
    """ln(1 - exp(x)) for x <= 0."""
    return let(x, lambda x: F.when(x > -math.log(2), safe_ln(-F.expm1(x))).otherwise(F.log1p(-F.exp(x))))


def _eta_series(order: int = 12) -> tuple[list[float], list[float]]:
    """Power series in eta of C0 = 1 / mu - 1 / eta and C1 = 1 / eta^3 - 1 / mu^3 - 1 / mu^2 - 1 / (12 mu), where eta^2 / 2 = mu - ln(1 + mu)."""
    n = order + 5
    a = [Fraction(0), Fraction(1)]  # mu = sum of a_k eta^k, from mu mu' = eta (1 + mu)
    for k in range(2, n):
        a.append((2 * a[k - 1] / (k + 1) - sum((a[i] * a[k + 1 - i] for i in range(2, k)), Fraction(0))) / 2)
    inverse = [Fraction(1)]  # eta / mu
    for k in range(1, n - 1):
        inverse.append(-sum((a[i + 1] * inverse[k - i] for i in range(1, k + 1)), Fraction(0)))
    times = lambda x, y: [sum((x[i] * y[k - i] for i in range(k + 1)), Fraction(0)) for k in range(n - 1)]
    square = times(inverse, inverse)
    cube = times(square, inverse)
    first = [float(inverse[k + 1]) for k in range(order)]
    second = [float(-cube[k + 3] - square[k + 2] - inverse[k + 1] / 12) for k in range(order)]
    return first, second


_C0, _C1 = _eta_series()


def _polynomial(coefficients: list[float], x: Column) -> Column:
    out = F.lit(coefficients[-1])
    for c in reversed(coefficients[:-1]):
        out = out * x + c
    return out


def erfcx(z: Column) -> Column:
    """exp(z^2) erfc(z) for z >= 0: by the error function below 2, by a continued fraction from there on."""

    def of(z: Column) -> Column:
        fraction = F.aggregate(F.sequence(F.lit(60), F.lit(1), F.lit(-1)), z, lambda x, k: z + 0.5 * k / x)
        return F.when(z < 2.0, F.exp(z * z) * (1.0 - erf(z))).otherwise(1.0 / (math.sqrt(math.pi) * fraction))

    return let(z, of)


def _poisson_sums(k: Column, m: Column, above: bool) -> Column:
    """ln P(N > k) or ln P(N <= k) on the side away from the mean: terms from the largest on, in logs."""
    first = k + 1.0 if above else k
    ratio = (lambda i: m / (first + i)) if above else (lambda i: F.greatest(first - i + 1.0, F.lit(0.0)) / m)
    # terms fall at least as fast as exp(-i^2 / (2 (first + i)))
    n = F.ceil(60.0 + 9.0 * F.sqrt(first + 1.0)).cast("int")
    start = F.struct(F.lit(1.0).alias("t"), F.lit(1.0).alias("s"))
    step = lambda b, i: F.struct((b["t"] * ratio(i.cast("double"))).alias("t"), (b["s"] + b["t"] * ratio(i.cast("double"))).alias("s"))
    total = F.aggregate(F.sequence(F.lit(1), n), start, step, lambda b: b["s"])
    return first * F.log(m) - m - lgamma(first + 1.0) + F.log(total)


def _poisson_expansion(k: Column, m: Column, above: bool) -> Column:
    """The same by Temme's uniform expansion, to 1e-13 and better for k from 10,000 on."""
    a = k + 1.0

    def of(mu: Column) -> Column:
        return let(F.greatest(mu - F.log1p(mu), F.lit(0.0)), lambda half: let(F.signum(mu) * F.sqrt(2.0 * half), lambda eta: ended(mu, half, eta)))

    def ended(mu: Column, half: Column, eta: Column) -> Column:
        c0 = F.when(F.abs(eta) < 0.2, _polynomial(_C0, eta)).otherwise(1.0 / mu - 1.0 / eta)
        c1 = F.when(F.abs(eta) < 0.2, _polynomial(_C1, eta)).otherwise(1.0 / F.pow(eta, F.lit(3.0)) - 1.0 / F.pow(mu, F.lit(3.0)) - 1.0 / (mu * mu) - 1.0 / (12.0 * mu))
        rest = (c0 + c1 / a) / F.sqrt(2.0 * math.pi * a)
        body = 0.5 * erfcx(F.sqrt(a * half))
        return -a * half + F.log(body - rest if above else body + rest)

    return let(m / a - 1.0, of)


def _poisson_far(k: Column, m: Column, above: bool) -> Column:
    return F.when(k < 10_000, _poisson_sums(k, m, above)).otherwise(_poisson_expansion(k, m, above))


def _log_poisson(k: Column | float, mean: Column | float, above: bool) -> Column:
    """The probability above or up to ``k``, from the side away from the mean."""
    outside = (0.0, -INF) if above else (-INF, 0.0)  # k below 0; mean 0

    def of(x: Column) -> Column:
        k, m = x["k"], x["m"]
        right = k + 1.0 >= m
        far = F.when(right, _poisson_far(k, m, True)).otherwise(_poisson_far(k, m, False))
        found = let(F.least(far, F.lit(0.0)), lambda far: F.when(right if above else ~right, far).otherwise(log1mexp(far)))
        return F.when(k < 0, outside[0]).when(m == 0, outside[1]).otherwise(found)

    return let(F.struct(F.floor(col(k)).cast("double").alias("k"), col(mean).cast("double").alias("m")), of)


def log_poisson_sf(k: Column | float, mean: Column | float) -> Column:
    """ln P(N > k) of a Poisson count of any mean; what lies far out keeps its relative precision."""
    return _log_poisson(k, mean, True)


def log_poisson_cdf(k: Column | float, mean: Column | float) -> Column:
    """ln P(N <= k)."""
    return _log_poisson(k, mean, False)


def poisson_cdf(k: Column | float, mean: Column | float) -> Column:
    """P(N <= k) of a Poisson count of any mean; 0 below 0."""
    return F.exp(log_poisson_cdf(k, mean))


def erf(x: Column | float) -> Column:
    """Error function by its confluent series; 1 beyond |x| = 6 to double precision."""
    x = col(x)
    start = F.struct(x.alias("t"), x.alias("s"))
    step = lambda a, n: F.struct((a["t"] * 2.0 * x * x / (2.0 * n + 1.0)).alias("t"), (a["s"] + a["t"] * 2.0 * x * x / (2.0 * n + 1.0)).alias("s"))
    total = F.aggregate(F.sequence(F.lit(1), F.lit(119)), start, step, lambda a: a["s"])
    return F.when(F.abs(x) > 6.0, F.signum(x)).otherwise(total * 2.0 / math.sqrt(math.pi) * F.exp(-x * x))
