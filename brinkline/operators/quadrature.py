"""Quadrature rules as Columns and rows: trapezoid and Simpson over intervals, Halton points over boxes.

A rule over a row's own interval or box is a fold inside the row, so that many rows need no shuffle; an integral over
one box is one aggregation over a row a point.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brinkline.functions.special import col

MOST_CONSTANT = 16_384  # points of a rule that a plan holds as constants


def trapezoid(f: Callable[[Column], Column], lo: Column, hi: Column, nodes: int) -> Column:
    """Integral of ``f`` from ``lo`` to ``hi`` on evenly spaced nodes, the ends included."""
    if nodes < 2:
        raise ValueError("two nodes or more")
    step = (hi - lo) / float(nodes - 1)
    ends = 0.5 * (f(lo) + f(hi))
    if nodes == 2:
        return step * ends
    inner = F.aggregate(F.sequence(F.lit(1), F.lit(nodes - 2)), F.lit(0.0), lambda s, i: s + f(lo + step * i.cast("double")))
    return step * (inner + ends)


def simpson(f: Callable[[Column], Column], lo: Column, hi: Column, nodes: int) -> Column:
    """The same by parabolas through three nodes at a time; ``nodes`` is odd."""
    if nodes < 3 or nodes % 2 == 0:
        raise ValueError("an odd number of nodes, three or more")
    step = (hi - lo) / float(nodes - 1)
    weight = lambda i: F.when(i % 2 == 1, 4.0).otherwise(2.0)
    inner = F.aggregate(F.sequence(F.lit(1), F.lit(nodes - 2)), F.lit(0.0), lambda s, i: s + weight(i) * f(lo + step * i.cast("double")))
    return step / 3.0 * (inner + f(lo) + f(hi))


def primes(n: int) -> list[int]:
    """The first ``n`` primes."""
    out, k = [], 2
    while len(out) < n:
        if all(k % p for p in out if p * p <= k):
            out.append(k)
        k += 1
    return out


def radical_inverse(i: Column, base: int, most: int) -> Column:
    """The digits of ``i`` (0 to ``most``) in ``base``, mirrored at the point: a number in [0, 1)."""
    out, power = F.lit(0.0), 1
    while power <= max(most, 1):
        out = out + (F.floor(i / power) % base).cast("double") / float(power * base)
        power *= base
    return out


def _inverses(base: int, n: int) -> Column:
    """The radical inverses of 1 to ``n`` as one constant array, by the same sums."""
    found = []
    for i in range(1, n + 1):
        out, power = 0.0, 1
        while power <= n:
            out += float(i // power % base) / float(power * base)
            power *= base
        found.append(out)
    return F.split(F.lit(",".join(map(repr, found))), ",").cast("array<double>")


def halton(i: Column, n_dims: int, most: int) -> list[Column]:
    """Coordinates of the ``i``-th Halton point (from 1) of the unit cube, a prime base a side."""
    return [radical_inverse(i, p, most) for p in primes(n_dims)]


def halton_points(spark: SparkSession, lo: list[float], hi: list[float], n: int, names: list[str]) -> DataFrame:
    """(node, names): the first ``n`` Halton points of a box, a row each."""
    rows = spark.range(1, n + 1).withColumnRenamed("id", "node")
    unit = halton(F.col("node"), len(lo), n)
    return rows.select("node", *[(float(a) + u * float(b - a)).alias(c) for u, a, b, c in zip(unit, lo, hi, names, strict=True)])


def box_integral(f: Callable[..., Column], lo: list[Column | float], hi: list[Column | float], n: int) -> Column:
    """Integral of ``f`` over each row's own box, at ``n`` Halton points folded in the row."""
    lo, hi = [col(a) for a in lo], [col(b) for b in hi]
    unit = [_inverses(p, n) for p in primes(len(lo))] if n <= MOST_CONSTANT else None

    def at(i: Column) -> list[Column]:
        return [a + u * (b - a) for u, a, b in zip([c[i - 1] for c in unit] if unit else halton(i, len(lo), n), lo, hi, strict=True)]

    total = F.aggregate(F.sequence(F.lit(1), F.lit(n)), F.lit(0.0), lambda s, i: s + f(*at(i)))
    volume = F.lit(1.0)
    for a, b in zip(lo, hi, strict=True):
        volume = volume * (b - a)
    return total * volume / float(n)


def integral_over(spark: SparkSession, f: Callable[..., Column], lo: list[float], hi: list[float], n: int) -> float:
    """Integral of ``f`` over one box: one aggregation over ``n`` Halton points, one number to the driver."""
    names = [f"x{i}" for i in range(len(lo))]
    total = halton_points(spark, lo, hi, n, names).agg(F.sum(f(*[F.col(c) for c in names])).alias("s")).first().s
    return float(total) * math.prod(b - a for a, b in zip(lo, hi, strict=True)) / n
