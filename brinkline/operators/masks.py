"""Masks over rows: boolean Columns and tables that say which values count; masked values become NULL.

Points are told inside or outside polygons by counting the edges that a ray to the right crosses; edges are filed by
the horizontal bands they pass through, so that a point meets only the edges of its own band.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MONTHS = {"DJF": (12, 1, 2), "MAM": (3, 4, 5), "JJA": (6, 7, 8), "SON": (9, 10, 11)}
MOST_BROADCAST = 200_000


def present(value: Column | str) -> Column:
    """Neither NULL nor NaN."""
    c = F.col(value) if isinstance(value, str) else value
    return c.isNotNull() & ~F.isnan(c.cast("double"))


def combine_masks(*masks: Column) -> Column:
    """True where all masks are; a NULL mask counts as false."""
    return reduce(lambda a, b: a & b, [F.coalesce(m, F.lit(False)) for m in masks], F.lit(True))


def any_mask(*masks: Column) -> Column:
    return reduce(lambda a, b: a | b, [F.coalesce(m, F.lit(False)) for m in masks], F.lit(False))


def quality_mask(flag: Column, valid: list) -> Column:
    return F.coalesce(flag.isin(valid), F.lit(False))


def seasonal_mask(time: Column, seasons: list[str]) -> Column:
    """Months of the named seasons (DJF, MAM, JJA, SON)."""
    return F.month(time).isin([m for s in seasons for m in MONTHS[s]])


def land_sea_mask(fraction: Column, threshold: float = 50.0, land: bool = False) -> Column:
    """Sea where the land fraction is below the threshold; land elsewhere."""
    sea = fraction < threshold
    return ~sea if land else sea


def band_mask(height: Column, low: float | None = None, high: float | None = None) -> Column:
    """A band of heights, both ends included; an end left out is open."""
    return combine_masks(height.isNotNull(), *([height >= low] if low is not None else []), *([height <= high] if high is not None else []))


def bounding_box_mask(x: Column, y: Column, x0: float, x1: float, y0: float, y1: float) -> Column:
    return (x >= x0) & (x <= x1) & (y >= y0) & (y <= y1)


def distance_mask(x: Column, y: Column, x0: float, y0: float, radius: float) -> Column:
    """Nearer than ``radius`` to a place."""
    return (x - x0) * (x - x0) + (y - y0) * (y - y0) < radius * radius


def superellipse_mask(x: Column, y: Column, centre: tuple[float, float], axes: tuple[float, float], power: float = 2.0, turned: float = 0.0, stretch: float = 1.0) -> Column:
    """|u / a|^p + |v / b|^p <= 1 for the offsets (u, v) from the centre, the first times ``stretch``, turned by an angle in degrees."""
    c, s = math.cos(math.radians(turned)), math.sin(math.radians(turned))
    dx, dy = (x - centre[0]) * stretch, y - centre[1]
    u, v = dx * c - dy * s, dx * s + dy * c
    return F.pow(F.abs(u / axes[0]), F.lit(power)) + F.pow(F.abs(v / axes[1]), F.lit(power)) <= 1.0


def apply_mask(df: DataFrame, mask: Column, values: list[str]) -> DataFrame:
    """``values`` become NULL where the mask isn't true; rows stay."""
    ok = F.coalesce(mask, F.lit(False))
    return df.withColumns({v: F.when(ok, F.col(v)) for v in values})


def coverage(df: DataFrame, keys: list[str], block: Column, value: str = "value", expected: int | None = None) -> DataFrame:
    """(keys, block, n_valid, n, fraction) of each key's blocks; ``expected`` rows a block, or as many as there are."""
    rows = df.groupBy(*keys, block.alias("block")).agg(F.count(F.when(present(value), 1)).alias("n_valid"), F.count("*").alias("n"))
    return rows.withColumn("fraction", F.col("n_valid") / (F.lit(expected) if expected else F.col("n")))


def coverage_mask(df: DataFrame, keys: list[str], block: Column, least: float, value: str = "value", expected: int | None = None) -> DataFrame:
    """``df`` with covered: whether its key's block has at least the share ``least`` of valid values."""
    found = coverage(df, keys, block, value, expected).select(*[F.col(k).alias(f"brinkline_{k}") for k in keys], F.col("block").alias("brinkline_block"), (F.col("fraction") >= least).alias("covered"))
    rows = df.drop("covered").withColumn("brinkline_at", block)
    same = F.col("brinkline_at").eqNullSafe(F.col("brinkline_block"))
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"brinkline_{k}"))
    return rows.join(found, same).select(*[c for c in df.columns if c != "covered"], "covered")


def coverage_summary(df: DataFrame, keys: list[str], block: Column, least: float, value: str = "value", expected: int | None = None) -> DataFrame:
    """(keys, n_valid_blocks, n_blocks, valid_fraction, n_valid) of each key."""
    rows = coverage(df, keys, block, value, expected)
    ok = F.sum((F.col("fraction") >= least).cast("long"))
    return rows.groupBy(*keys).agg(ok.alias("n_valid_blocks"), F.count("*").alias("n_blocks"), (ok / F.count("*")).alias("valid_fraction"), F.sum("n_valid").alias("n_valid"))


def polygon_edges(corners: DataFrame, polygon: str, order: str, x: str = "x", y: str = "y") -> DataFrame:
    """(polygon, x1, y1, x2, y2) from the corners of polygons, a row each; the last corner leads back to the first."""
    rows = corners.groupBy(polygon).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")))).alias("c"))
    rows = rows.select(polygon, "c", F.posexplode("c").alias("i", "p"))
    q = F.col("c")[F.when(F.col("i") + 1 < F.size("c"), F.col("i") + 1).otherwise(0)]
    return rows.select(polygon, F.col("p.x").alias("x1"), F.col("p.y").alias("y1"), q["x"].alias("x2"), q["y"].alias("y2"))


def in_polygons(points: DataFrame, edges: DataFrame, ids: list[str], polygon: str, band: float, x: str = "x", y: str = "y") -> DataFrame:
    """(ids, polygon) of the points inside: those whose ray to the right crosses an odd number of the polygon's edges.

    ``edges`` as from ``polygon_edges``; several rings of one polygon cut holes into each other. ``ids`` tell points
    apart. A point on an edge is inside where the polygon lies to its right or above it, so that polygons that share an
    edge share no point. NULL coordinates are outside. ``band`` is the height of a band: edges are copied into each
    one that they pass through, and those of one polygon and band make one row. Each row of ``points`` is told by itself.
    """
    low, high = F.least("y1", "y2"), F.greatest("y1", "y2")
    filed = edges.where("y1 <> y2").withColumn("brinkline_band", F.explode(F.sequence(F.floor(low / band), F.floor(high / band))))
    at = points.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*ids, F.col(x).cast("double").alias("brinkline_x"), F.col(y).cast("double").alias("brinkline_y"))
    at = at.withColumn("brinkline_band", F.floor(F.col("brinkline_y") / band))
    few = filed.count() <= MOST_BROADCAST
    # the edges that a point may meet come as one row, so that no task has to gather a point's crossings again
    bands = filed.groupBy(polygon, "brinkline_band").agg(F.collect_list(F.struct("x1", "y1", "x2", "y2")).alias("brinkline_edges"))
    px, py = F.col("brinkline_x"), F.col("brinkline_y")

    def crossed(e: Column) -> Column:
        across = e["x1"] + (py - e["y1"]) / (e["y2"] - e["y1"]) * (e["x2"] - e["x1"])
        return ((e["y1"] > py) != (e["y2"] > py)) & (px < across)

    met = at.join(F.broadcast(bands) if few else bands, "brinkline_band")
    return met.where(F.size(F.filter("brinkline_edges", crossed)) % 2 == 1).select(*ids, polygon)
