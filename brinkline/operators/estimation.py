"""Parameters of extreme-value distributions by key from probability-weighted moments, all keys in one job.

The moments weight each value by its rank, which is counted along the key in chunks; fits are Columns of three sums.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brinkline.functions.special import gamma
from brinkline.operators.blocks import clean
from brinkline.operators.positions import CHUNK_ROWS, numbered, same_keys


def weighted_moments(df: DataFrame, keys: list[str], value: str = "value", chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """(keys, n, b0, b1, b2): unbiased moments E[X F(X)^r] of each key; b1 needs two values and b2 three, else NULL. NULL and NaN are left out."""
    rows = clean(df, value).where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("brinkline_x"))
    ranked = numbered(rows, keys, ["brinkline_x"], "brinkline_i", chunk_rows)
    counts = rows.groupBy(*[F.col(k).alias(f"brinkline_{k}") for k in keys]).agg(F.count("*").alias("n"))
    met = ranked.join(counts, same_keys(ranked, counts, {k: f"brinkline_{k}" for k in keys}))
    x, i, n = F.col("brinkline_x"), F.col("brinkline_i"), F.col("n")
    one = F.when(n > 1, i / (n - 1) * x)
    two = F.when(n > 2, i / (n - 1) * ((i - 1) / (n - 2)) * x)
    found = met.groupBy(*keys, "n").agg(F.avg(x).alias("b0"), F.avg(one).alias("b1"), F.avg(two).alias("b2"))
    return found.select(*keys, "n", "b0", "b1", "b2")


def fit_gev(df: DataFrame, keys: list[str], value: str = "value", chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """(keys, n, loc, scale, shape) of generalized extreme-value distributions; the shape by the usual quadratic approximation, 0 within 1e-6.

    NULL parameters with fewer than three values, or where all are equal.
    """
    m = weighted_moments(df, keys, value, chunk_rows)
    low, high = 2.0 * F.col("b1") - F.col("b0"), 3.0 * F.col("b2") - F.col("b0")
    c = low / high - math.log(2) / math.log(3)
    rows = m.withColumn("brinkline_low", low).withColumn("brinkline_k", F.when((F.col("brinkline_low") > 0) & (high > 0), 7.8590 * c + 2.9554 * c * c))
    flat = F.abs("brinkline_k") < 1e-6
    k = F.when(flat, F.lit(1.0)).otherwise(F.col("brinkline_k"))
    g = gamma(1.0 + k)
    scale = F.when(flat, F.col("brinkline_low") / math.log(2)).otherwise(F.col("brinkline_low") * k / (g * (1.0 - F.pow(F.lit(2.0), -k))))
    rows = rows.withColumn("scale", F.when(F.col("brinkline_k").isNotNull(), scale))
    loc = F.when(flat, F.col("b0") - 0.5772156649015329 * F.col("scale")).otherwise(F.col("b0") + F.col("scale") * (g - 1.0) / k)
    return rows.select(*keys, "n", loc.alias("loc"), "scale", F.when(flat, F.lit(0.0)).otherwise(-F.col("brinkline_k")).alias("shape"))


def fit_gpd(df: DataFrame, keys: list[str], value: str = "value", threshold: str = "threshold", chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """(keys, n, scale, shape) of generalized Pareto distributions of the excesses over the threshold (strictly above)."""
    over = clean(df, value).where(F.col(value) > F.col(threshold)).select(*keys, (F.col(value) - F.col(threshold)).alias("brinkline_excess"))
    m = weighted_moments(over, keys, "brinkline_excess", chunk_rows)
    mean, tail = F.col("b0"), F.col("b0") - F.col("b1")
    rest = F.when(mean - 2.0 * tail > 0, mean - 2.0 * tail)
    return m.select(*keys, "n", (2.0 * mean * tail / rest).alias("scale"), (2.0 - mean / rest).alias("shape"))
