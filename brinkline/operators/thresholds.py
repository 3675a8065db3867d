"""Thresholds: exact interpolated quantiles, globally, by calendar group, by season and over rolling rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from brinkline.operators.blocks import clean
from brinkline.operators.positions import CHUNK_ROWS, numbered, own_rows, running_sums, same_keys, segments
from brinkline.plans.shared import materialize, shared_root


def statistic(kind: str, value: str, q: float = 0.95) -> Column:
    return {"quantile": F.percentile(value, F.lit(q)), "mean": F.avg(value), "median": F.percentile(value, F.lit(0.5)), "max": F.max(value), "min": F.min(value)}[kind]


def season(time: Column) -> Column:
    m = F.month(time)
    return F.when(m.isin(12, 1, 2), "DJF").when(m <= 5, "MAM").when(m <= 8, "JJA").otherwise("SON")


def ranked_quantile(df: DataFrame, keys: list[str], q: float, value: str = "value", chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """(keys, threshold): exact interpolated quantiles where a key has too many different values for one buffer.

    Values are counted first, so copies travel once; the counts are summed along each key's order in chunks, and the two
    values around the wanted position are those whose ranks hold it. NULL where a key has no value.
    """
    counts = df.groupBy(*keys, F.col(value).cast("double").alias("brinkline_v")).agg(F.count(value).alias("brinkline_n"))
    counts = materialize(counts, shared_root(df.sparkSession), "counts")
    totals = counts.groupBy(*[F.col(k).alias(f"brinkline_key_{k}") for k in keys]).agg(F.sum("brinkline_n").alias("brinkline_total"))
    rows = running_sums(counts, keys, ["brinkline_v"], {"brinkline_upto": F.col("brinkline_n")}, chunk_rows)
    rows = rows.join(totals, same_keys(rows, totals, {k: f"brinkline_key_{k}" for k in keys}))
    place = (F.col("brinkline_total") - 1) * q
    held = lambda i: F.max(F.when((F.col("brinkline_upto") - F.col("brinkline_n") <= i) & (i < F.col("brinkline_upto")), F.col("brinkline_v")))
    found = rows.groupBy(*keys).agg(held(F.floor(place)).alias("lower"), held(F.ceil(place)).alias("upper"), F.max(place - F.floor(place)).alias("part"))
    return found.select(*keys, (F.col("lower") * (1 - F.col("part")) + F.col("upper") * F.col("part")).alias("threshold"))


def threshold(df: DataFrame, keys: list[str], kind: str = "quantile", q: float = 0.95, value: str = "value", chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """One threshold for each key; quantiles of tables of more than ``chunk_rows`` rows by ranks, others in a buffer a key."""
    if kind in ("quantile", "median") and df.count() > chunk_rows:
        return ranked_quantile(clean(df, value), keys, q if kind == "quantile" else 0.5, value, chunk_rows)
    return clean(df, value).groupBy(*keys).agg(statistic(kind, value, q).alias("threshold"))


def with_threshold(df: DataFrame, keys: list[str], kind: str = "quantile", q: float = 0.95, value: str = "value", chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Rows with their key's threshold: the thresholds are aggregated first and joined back, so no window holds a whole key."""
    rows = clean(df, value)
    return rows.join(threshold(rows, keys, kind, q, value, chunk_rows), keys, "left")


def rolling_threshold(df: DataFrame, size: int, keys: list[str], order: list[str], q: float = 0.95, value: str = "value", min_count: int = 1, centred: bool = False, chunk_rows: int = CHUNK_ROWS, segment_rows: int = CHUNK_ROWS) -> DataFrame:
    """Quantile of the last ``size`` rows, or of those around each row; partial windows count unless ``min_count`` says otherwise.

    A centred window of even size reaches one row further back than ahead.
    """
    ahead = (size - 1) // 2 if centred else 0
    frame = W.partitionBy(*keys, "brinkline_segment").orderBy("brinkline_ix").rowsBetween(ahead + 1 - size, ahead)
    rows = segments(numbered(clean(df, value), keys, order, "brinkline_ix", chunk_rows), size - 1 - ahead, ahead, "brinkline_ix", segment_rows)
    rows = rows.withColumn("brinkline_threshold", F.when(F.count(value).over(frame) >= min_count, F.percentile(value, F.lit(q)).over(frame)))
    return own_rows(rows, "brinkline_ix").withColumn("threshold", F.col("brinkline_threshold")).drop("brinkline_threshold")


def constant_threshold(df: DataFrame, threshold: float, value: str = "value") -> DataFrame:
    return clean(df, value).withColumn("threshold", F.lit(float(threshold)))


def hill(rows: DataFrame, keys: list[str], k_values: list[int] | None = None, value: str = "value", ties: tuple[str, ...] = ()) -> DataFrame:
    """(keys, k, hill, mean_log_ratio): the tail index by the k largest values, for every requested k below the series' length; all of them without ``k_values``.

    hill is one over the mean log ratio of the k largest values to the next one, infinite where that mean is 0.
    """
    w = W.partitionBy(*keys)
    ranked = clean(rows, value).where(F.col(value).isNotNull()).withColumn("k", F.row_number().over(w.orderBy(F.desc(value), *ties)))
    if k_values is not None:
        ranked = ranked.where(F.col("k") <= max(k_values, default=0) + 1)
    along = w.orderBy("k")
    ranked = ranked.withColumn("m", F.avg(F.log(value)).over(along.rowsBetween(W.unboundedPreceding, 0))).withColumn("nx", F.lead(F.log(value)).over(along)).where("nx IS NOT NULL")
    if k_values is not None:
        ranked = ranked.where(F.col("k").isin(*k_values))
    ratio = F.col("m") - F.col("nx")
    index = F.when(ratio > 0, 1.0 / F.when(ratio > 0, ratio).otherwise(1.0)).otherwise(F.lit(float("inf")))
    return ranked.select(*keys, F.col("k").cast("long").alias("k"), index.alias("hill"), ratio.alias("mean_log_ratio"))
