"""Temporal features by key: climatology by day of the year, anomalies from it, spells of a condition."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brinkline.operators.blocks import clean
from brinkline.operators.positions import CHUNK_ROWS, running_sums, same_keys


def climatology(df: DataFrame, keys: list[str], time: str, value: str = "value", half_width: int = 15, days: int = 366) -> DataFrame:
    """(keys, day, n, normal): mean and count of the values up to ``half_width`` days of the year away, around the turn of the year.

    ``day`` runs from 1 to ``days``; days without a value in reach are left out. NULL and NaN values, and NULL times, don't count.
    """
    if not 0 <= 2 * half_width < days:
        raise ValueError("the window is wider than the year")
    rows = clean(df, value).where(F.col(value).isNotNull() & F.col(time).isNotNull())
    daily = rows.groupBy(*keys, F.dayofyear(time).alias("brinkline_day")).agg(F.count("*").alias("n"), F.sum(value).alias("brinkline_sum"))
    near = F.explode(F.sequence(F.lit(-half_width), F.lit(half_width)))
    spread = daily.withColumn("brinkline_step", near).withColumn("day", F.pmod(F.col("brinkline_day") + F.col("brinkline_step") - 1, F.lit(days)) + 1)
    found = spread.groupBy(*keys, "day").agg(F.sum("n").alias("n"), F.sum("brinkline_sum").alias("brinkline_sum"))
    return found.select(*keys, "day", "n", (F.col("brinkline_sum") / F.col("n")).alias("normal"))


def anomalies(df: DataFrame, keys: list[str], time: str, value: str = "value", half_width: int = 15, days: int = 366) -> DataFrame:
    """``df`` with normal, its day's climatology, and anomaly, the value's distance from it; rows stay."""
    kept = df.drop("normal", "anomaly")
    normals = climatology(df, keys, time, value, half_width, days).select(*[F.col(k).alias(f"brinkline_{k}") for k in keys], F.col("day").alias("brinkline_day"), "normal")
    here = same_keys(kept, normals, {k: f"brinkline_{k}" for k in keys}) & (F.dayofyear(kept[time]) == normals["brinkline_day"])
    met = kept.join(normals, here, "left").select(*[kept[c] for c in kept.columns], "normal")
    return met.withColumn("anomaly", F.col(value) - F.col("normal"))


def spells(df: DataFrame, keys: list[str], order: list[str], condition: Column, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """(keys, first_ix, last_ix, length) of each longest run of rows where the condition is true; NULL ends a run."""
    met = F.coalesce(condition, F.lit(False))
    rows = df.select(*keys, *[c for c in order if c not in keys], met.alias("brinkline_met"))
    rows = running_sums(rows, keys, order, {"brinkline_row": F.lit(1), "brinkline_rank": F.col("brinkline_met").cast("long")}, chunk_rows)
    # rows of a run share the difference of position and rank
    runs = rows.where("brinkline_met").groupBy(*keys, (F.col("brinkline_row") - F.col("brinkline_rank")).alias("brinkline_run"))
    found = runs.agg((F.min("brinkline_row") - 1).alias("first_ix"), (F.max("brinkline_row") - 1).alias("last_ix"), F.count("*").alias("length"))
    return found.drop("brinkline_run")


def spell_summary(df: DataFrame, keys: list[str], order: list[str], condition: Column, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """(keys, spells, longest, mean_length) of every key, those without a spell too."""
    found = spells(df, keys, order, condition, chunk_rows).groupBy(*[F.col(k).alias(f"brinkline_{k}") for k in keys])
    found = found.agg(F.count("*").alias("spells"), F.max("length").alias("longest"), F.avg("length").alias("mean_length"))
    every = df.select(*keys).distinct()
    met = every.join(found, same_keys(every, found, {k: f"brinkline_{k}" for k in keys}), "left")
    return met.select(*keys, F.coalesce("spells", F.lit(0)).alias("spells"), F.coalesce("longest", F.lit(0)).alias("longest"), "mean_length")
