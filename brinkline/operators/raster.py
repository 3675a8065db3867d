"""Grids as rows (keys, row, col, value): binning, moving windows, slope and aspect, distance to the nearest open cell.

Windows work on square tiles with copies of the cells at their edges, so that a task holds a tile. Distances come from
two passes, along rows and then along columns, each of which holds one line of the grid.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

TILE = 256


def binned(points: DataFrame, keys: list[str], row: Column, col: Column, value: Column) -> DataFrame:
    """(keys, row, col, value): an aggregate of the points of each cell."""
    return points.groupBy(*keys, row.cast("long").alias("row"), col.cast("long").alias("col")).agg(value.alias("value"))


def dense(cells: DataFrame, keys: list[str], rows: int, cols: int) -> DataFrame:
    """All ``rows`` times ``cols`` cells of each key, value NULL where there was none; cells outside the grid go."""
    every = cells.select(*keys).distinct().withColumn("row", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(rows - 1).cast("long"))))
    every = every.withColumn("col", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(cols - 1).cast("long"))))
    same = (F.col("e.row") == F.col("c.row")) & (F.col("e.col") == F.col("c.col"))
    for k in keys:
        same = same & F.col(f"e.{k}").eqNullSafe(F.col(f"c.{k}"))
    return every.alias("e").join(cells.alias("c"), same, "left").select("e.*", *[F.col(f"c.{c}") for c in cells.columns if c not in (*keys, "row", "col")])


def stencil(cells: DataFrame, keys: list[str], radius: int, f: Callable[[np.ndarray, tuple[int, int], tuple[int, int]], dict[str, np.ndarray]], names: list[str], tile: int = TILE) -> DataFrame:
    """``cells`` (keys, row, col, value) with columns ``names`` that ``f`` computes from each cell's surroundings.

    ``f`` gets the values of a tile and ``radius`` cells around it (NaN where there is none), the row and column of the
    array's first cell, and the offset of the tile in it; it returns arrays of the tile's shape. Cells occur once.
    """
    tile = max(tile, radius, 1)

    def places(c: str) -> Column:
        at, rest = F.floor(F.col(c) / tile), F.pmod(F.col(c), F.lit(tile))
        return F.array_compact(F.array(at, F.when(rest < radius, at - 1), F.when(rest >= tile - radius, at + 1)))

    rows = cells.select(*keys, "row", "col", F.col("value").cast("double").alias("value"))
    rows = rows.withColumn("tr", F.explode(places("row"))).withColumn("tc", F.explode(places("col")))
    kept = [f_ for f_ in cells.schema.fields if f_.name in keys]
    schema = T.StructType([*kept, *(T.StructField(n, T.LongType()) for n in ("row", "col")), T.StructField("value", T.DoubleType()), *(T.StructField(n, T.DoubleType()) for n in names)])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        r0, c0 = int(pdf["tr"].iloc[0]) * tile, int(pdf["tc"].iloc[0]) * tile
        whole = np.full((tile + 2 * radius, tile + 2 * radius), np.nan)
        whole[pdf["row"].to_numpy() - r0 + radius, pdf["col"].to_numpy() - c0 + radius] = pdf["value"].to_numpy(np.float64, na_value=np.nan)
        found = f(whole, (r0 - radius, c0 - radius), (radius, radius))
        own = pdf[(pdf["row"] // tile == r0 // tile) & (pdf["col"] // tile == c0 // tile)]
        out = own[[*keys, "row", "col", "value"]].copy()
        for n in names:
            out[n] = found[n][own["row"].to_numpy() - r0, own["col"].to_numpy() - c0]
        return out

    return rows.groupBy(*keys, "tr", "tc").applyInPandas(run, schema)


def _differences(whole: np.ndarray, axis: int) -> np.ndarray:
    """Central differences inside, one-sided ones next to a missing neighbour, for all but the outermost cells."""
    inner = tuple(slice(1, -1) for _ in range(2))
    ahead, behind = (tuple(slice(1 + d, whole.shape[a] - 1 + d) if a == axis else slice(1, -1) for a in range(2)) for d in (1, -1))
    here, up, down = whole[inner], whole[ahead], whole[behind]
    both = (up - down) / 2.0
    return np.where(np.isnan(both), np.where(np.isnan(up), here - down, up - here), both)


def slope_and_aspect(cells: DataFrame, keys: list[str], cell_size: float, tile: int = TILE) -> DataFrame:
    """``cells`` with slope (degrees) and aspect (degrees in [0, 360), from the gradient by row and by column).

    A cell with no neighbour along an axis has neither: both are NULL.
    """

    def f(whole, first, offset):
        down, right = (_differences(whole, axis) / cell_size for axis in (0, 1))
        slope = np.degrees(np.arctan(np.hypot(down, right)))
        return {"slope": slope, "aspect": (np.degrees(np.arctan2(-right, down)) + 360.0) % 360.0}

    return stencil(cells, keys, 1, f, ["slope", "aspect"], tile)


def roughness(cells: DataFrame, keys: list[str], rows: int, cols: int, sigma: float = 3.0, truncate: float = 4.0, tile: int = TILE) -> DataFrame:
    """``cells`` with roughness: the standard deviation of the values around a cell under a normal window of ``sigma`` cells.

    The window ends ``truncate`` deviations away; at the ends of the grid of ``rows`` by ``cols``, which has no missing
    cells and is larger than the window's radius, values are mirrored.
    """
    radius = int(truncate * sigma + 0.5)
    if radius > min(rows, cols):
        raise ValueError("the window is wider than the grid")
    weight = np.exp(-0.5 * (np.arange(-radius, radius + 1) / sigma) ** 2)
    weight /= weight.sum()

    def smooth(x: np.ndarray) -> np.ndarray:
        for axis in (0, 1):
            x = np.apply_along_axis(lambda line: np.convolve(line, weight, "valid"), axis, x)
        return x

    def f(whole, first, offset):
        inside = tuple(slice(max(0, -a), min(n, end - a)) for a, n, end in zip(first, whole.shape, (rows, cols), strict=True))
        part = whole[inside]
        ahead = [(s.start, n - s.stop) for s, n in zip(inside, whole.shape, strict=True)]
        full = np.pad(part, [(min(a, radius), min(b, radius)) for a, b in ahead], "symmetric")
        full = np.pad(full, [(a - min(a, radius), b - min(b, radius)) for a, b in ahead], constant_values=np.nan)
        mean = smooth(full)
        return {"roughness": np.sqrt(np.maximum(0.0, smooth(full * full) - mean * mean))}

    return stencil(cells, keys, radius, f, ["roughness"], tile)


def distance_to_open(cells: DataFrame, keys: list[str], masked: Column, unit: float = 1.0) -> DataFrame:
    """``cells`` (keys, row, col, ...) with distance: from a masked cell to the nearest cell that isn't, 0 for those.

    Exact, in cells times ``unit``; NULL where a key has no open cell. Cells that are missing count as neither.
    """
    along = W.partitionBy(*keys, "row").orderBy("col")
    open_at = F.when(~F.coalesce(masked, F.lit(False)), F.col("col"))
    before = F.last(open_at, ignorenulls=True).over(along.rowsBetween(W.unboundedPreceding, 0))
    behind = F.first(open_at, ignorenulls=True).over(along.rowsBetween(0, W.unboundedFollowing))
    near = F.least(F.col("col") - before, behind - F.col("col"))  # the null one of two is left out
    rows = cells.withColumn("distance", near.cast("double"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        at, g = pdf["row"].to_numpy(np.float64), pdf["distance"].to_numpy(np.float64, na_value=np.nan)
        order = np.argsort(at[~np.isnan(g)])
        foot, lift = at[~np.isnan(g)][order], g[~np.isnan(g)][order] ** 2
        if not len(foot):
            return pdf.assign(distance=np.nan)
        held, cut = [0], [-math.inf]  # the lower envelope of one parabola a row, and where each begins to be lowest
        for k in range(1, len(foot)):
            while True:
                j = held[-1]
                meet = (lift[k] + foot[k] ** 2 - lift[j] - foot[j] ** 2) / (2 * (foot[k] - foot[j]))
                if meet > cut[-1]:
                    break
                held.pop()
                cut.pop()
            held.append(k)
            cut.append(meet)
        which = np.array(held)[np.searchsorted(np.array(cut), at, "right") - 1]
        return pdf.assign(distance=np.sqrt((at - foot[which]) ** 2 + lift[which]) * unit)

    found = rows.groupBy(*keys, "col").applyInPandas(run, rows.schema)
    return found.withColumn("distance", F.when(~F.isnan("distance"), F.col("distance")))
