"""Runs and separation declustering, extremal index."""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from brinkline.operators.blocks import clean
from brinkline.operators.history import with_history
from brinkline.operators.positions import CHUNK_ROWS, numbered, own_rows, running_sums, same_keys, segments
from brinkline.plans.shared import materialize, shared_root

_REDUCERS = {"max": F.max, "mean": F.avg, "sum": F.sum, "min": F.min}


def runs(df: DataFrame, keys: list[str], order: list[str], reducer: str = "max", value: str = "value", threshold: str = "threshold", chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """One row a run of consecutive exceedances (strictly above): keys, last_ix, n, cluster (the reduced value)."""
    above = F.col(value) > F.col(threshold)
    rows = clean(df, value).select(*keys, *[c for c in order if c not in keys], *[c for c in (value, threshold) if c not in [*keys, *order]])
    rows = running_sums(rows, keys, order, {"brinkline_row": F.lit(1), "brinkline_rank": above.cast("long")}, chunk_rows).where(above)
    # consecutive exceedances share the difference of position and rank
    rows = rows.withColumn("brinkline_run", F.col("brinkline_row") - F.col("brinkline_rank"))
    return rows.groupBy(*keys, "brinkline_run").agg((F.max("brinkline_row") - 1).alias("last_ix"), F.count("*").alias("n"), _REDUCERS[reducer](value).alias("cluster")).drop("brinkline_run")


def extremal_index(df: DataFrame, keys: list[str], order: list[str], value: str = "value", threshold: str = "threshold", chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Runs over exceedances of each key; NULL where nothing exceeds."""
    found = runs(df, keys, order, "max", value, threshold, chunk_rows).groupBy(*keys).agg(F.sum("n").alias("exceedances"), F.count("*").alias("runs"))
    every = df.select(*keys).distinct()
    return every.join(found, keys, "left").select(*keys, F.coalesce("exceedances", F.lit(0)).alias("exceedances"), F.coalesce("runs", F.lit(0)).alias("runs"), (F.col("runs") / F.col("exceedances")).alias("theta"))


def exceedance_gaps(df: DataFrame, keys: list[str], order: list[str], value: str = "value", threshold: str = "threshold", chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """The exceedances (strictly above) with ix, their position, and gap, positions since the exceedance before (null for the first)."""
    rows = numbered(clean(df, value), keys, order, chunk_rows=chunk_rows).where(F.col(value) > F.col(threshold))
    found = with_history(rows.withColumn("t", F.col("ix")), keys, ["t"], chunk_rows=chunk_rows)
    return found.withColumn("gap", F.col("ix") - F.col("last_t")).drop("t", "n_before", "last_t", "last_mark", "mark_sum")


def intervals_index(df: DataFrame, keys: list[str], order: list[str], value: str = "value", threshold: str = "threshold", chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """(keys, exceedances, theta, clusters, run_length) by the intervals estimator, from the moments of the gaps between exceedances.

    ``run_length`` is the widest gap inside a cluster: the gaps wider than it part ``clusters`` clusters, about theta
    times the exceedances (fewer where gaps are equal). NULL theta with fewer than two exceedances.
    """
    here = [F.col(k).alias(f"brinkline_{k}") for k in keys]
    rows = materialize(exceedance_gaps(df, keys, order, value, threshold, chunk_rows).select(*here, F.col("gap").cast("double").alias("gap")), shared_root(df.sparkSession), "gaps")
    held, g = [f"brinkline_{k}" for k in keys], F.col("gap")
    # a gap of one joins neighbours; where gaps are all short, their own moments serve
    short = 2.0 * F.sum(g) * F.sum(g) / (F.count(g) * F.sum(g * g))
    long = 2.0 * F.sum(g - 1.0) * F.sum(g - 1.0) / (F.count(g) * F.sum((g - 1.0) * (g - 2.0)))
    theta = F.when(F.count(g) > 0, F.least(F.when(F.max(g) <= 2, short).otherwise(long), F.lit(1.0)))
    moments = rows.groupBy(*held).agg(F.count("*").alias("exceedances"), theta.alias("theta"))
    moments = moments.withColumn("wanted", F.floor(F.col("theta") * F.col("exceedances")) + 1)
    # how many gaps are as wide as each width or wider
    widths = rows.where("gap is not null").groupBy(*held, "gap").agg(F.count("*").alias("m")).withColumn("narrow", -g)
    wider = running_sums(widths, held, ["narrow"], {"upto": F.col("m")}, chunk_rows)
    asked = moments.select(*[F.col(h).alias(f"asked_{h}") for h in held], "wanted")
    met = wider.join(asked, same_keys(wider, asked, {h: f"asked_{h}" for h in held}))
    length = F.coalesce(F.max(F.when(F.col("upto") >= F.col("wanted"), F.col("gap"))), F.lit(0.0))
    found = met.groupBy(*[f"asked_{h}" for h in held]).agg(length.cast("long").alias("run_length"), (F.coalesce(F.sum(F.when(F.col("upto") < F.col("wanted"), F.col("m"))), F.lit(0)) + 1).alias("clusters"))
    told = moments.join(found, same_keys(moments, found, {h: f"asked_{h}" for h in held}), "left").select(*held, "exceedances", "theta", "clusters", "run_length")
    every = df.select(*keys).distinct()
    done = every.join(told, same_keys(every, told, dict(zip(keys, held, strict=True))), "left")
    return done.select(*[every[k] for k in keys], F.coalesce("exceedances", F.lit(0)).alias("exceedances"), "theta", "clusters", "run_length")


def intervals_clusters(df: DataFrame, keys: list[str], order: list[str], value: str = "value", threshold: str = "threshold", reducer: str = "max", chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """One row a cluster: keys, first_ix, last_ix, n, cluster (the reduced value); a gap wider than the key's ``run_length`` parts two."""
    rows = exceedance_gaps(df, keys, order, value, threshold, chunk_rows)
    lengths = intervals_index(df, keys, order, value, threshold, chunk_rows).select(*[F.col(k).alias(f"brinkline_{k}") for k in keys], "run_length")
    begins = F.coalesce(F.col("gap") > F.col("run_length"), F.lit(True)).cast("long")
    told = rows.join(lengths, same_keys(rows, lengths, {k: f"brinkline_{k}" for k in keys})).withColumn("brinkline_begins", begins).drop(*[f"brinkline_{k}" for k in keys])
    told = running_sums(told, keys, ["ix"], {"brinkline_cluster": F.col("brinkline_begins")}, chunk_rows)
    found = told.groupBy(*keys, "brinkline_cluster").agg(F.min("ix").alias("first_ix"), F.max("ix").alias("last_ix"), F.count("*").alias("n"), _REDUCERS[reducer](value).alias("cluster"))
    return found.drop("brinkline_cluster")


def peaks(df: DataFrame, keys: list[str], order: list[str], value: str = "value", threshold: str = "threshold", chunk_rows: int = CHUNK_ROWS, segment_rows: int = CHUNK_ROWS) -> DataFrame:
    """Exceedances strictly above both neighbours; a missing neighbour is no constraint."""
    along = W.partitionBy(*keys, "brinkline_segment").orderBy("ix")
    rows = segments(numbered(clean(df, value), keys, order, chunk_rows=chunk_rows), 1, 1, length=segment_rows)
    rows = rows.withColumn("before", F.lag(value).over(along)).withColumn("after", F.lead(value).over(along))
    above = lambda n: F.col(n).isNull() | (F.col(value) > F.col(n))
    return own_rows(rows.where((F.col(value) > F.col(threshold)) & above("before") & above("after")), "before", "after")


def separated_peaks(df: DataFrame, min_separation: int, keys: list[str], order: list[str], value: str = "value", threshold: str = "threshold", chunk_rows: int = CHUNK_ROWS, segment_rows: int = CHUNK_ROWS) -> DataFrame:
    """Peaks kept greedily by height, at least ``min_separation`` positions apart; of equal ones the later goes first.

    The greedy choice only looks ``min_separation`` positions away, so a key's peaks are cut into independent chains
    where the gap to the next peak is that wide; 64 neighbouring chains, not a key, are what a call holds.
    """
    # written once: few rows, which are counted, numbered and cut behind the windows that found them
    kept = materialize(peaks(df, keys, order, value, threshold, chunk_rows, segment_rows), shared_root(df.sparkSession), "peaks")
    along = W.partitionBy(*keys, "brinkline_segment").orderBy("ix")
    # a peak that sees none within min_separation positions before it begins a chain
    far = F.coalesce(F.col("ix") - F.lag("ix").over(along) >= min_separation, F.lit(True))
    rows = own_rows(segments(kept, min_separation, 0, length=segment_rows).withColumn("begins", far))
    rows = running_sums(rows, keys, ["ix"], {"chain": F.col("begins").cast("long")}, chunk_rows).drop("begins")
    rows = rows.withColumn("chain", F.floor(F.col("chain") / 64))

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([value, "ix"], ascending=[False, False])
        taken: list[int] = []
        keep = []
        for i in pdf["ix"].tolist():
            k = bisect_left(taken, i)  # only the nearest kept positions can be too close
            keep.append((not k or i - taken[k - 1] >= min_separation) and (k == len(taken) or taken[k] - i >= min_separation))
            if keep[-1]:
                taken.insert(k, i)
        return pdf[np.array(keep, bool)].drop(columns="chain")

    return rows.groupBy(*keys, "chain").applyInPandas(choose, kept.schema)


def declustered_maxima(df: DataFrame, keys: list[str], order: list[str], method: str = "runs", min_separation: int = 1, value: str = "value", threshold: str = "threshold") -> DataFrame:
    """Cluster maxima by either method; ``runs`` takes no separation."""
    if method == "runs":
        return runs(df, keys, order, "max", value, threshold).select(*keys, F.col("last_ix").alias("ix"), F.col("cluster").alias("maximum"))
    return separated_peaks(df, min_separation, keys, order, value, threshold).select(*keys, "ix", F.col(value).alias("maximum"))


def run_rows(df: DataFrame, keys: list[str], order: list[str], reducer: str = "max", value: str = "value", threshold: str = "threshold", chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Every row of ``df`` with ix and cluster: the reduced value of a run on the run's last row, NULL on all others."""
    rows = numbered(clean(df, value), keys, order, chunk_rows=chunk_rows)
    found = runs(df, keys, order, reducer, value, threshold, chunk_rows).select(*[F.col(k).alias(f"run_{k}") for k in keys], F.col("last_ix"), "cluster")
    same = rows["ix"] == found["last_ix"]
    for k in keys:
        same = same & rows[k].eqNullSafe(found[f"run_{k}"])
    return rows.join(found, same, "left").select(*[rows[c] for c in rows.columns], "cluster")
