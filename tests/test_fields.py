"""Masks, polygons, grids and the intervals estimator against direct computation."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from brinkline.operators import decluster, masks, raster


def test_polygons_with_holes_and_shared_edges(spark, monkeypatch):
    squares = {"left": [[(0, 0), (2, 0), (2, 2), (0, 2)]], "right": [[(2, 0), (2, 2), (4, 2), (4, 0)]], "ring": [[(0, 3), (6, 3), (6, 9), (0, 9)], [(2, 5), (4, 5), (4, 7), (2, 7)]], "spike": [[(10, 0), (10.5, 40), (11, 0)]]}
    rings = [(f"{p}/{k}", i, float(x), float(y)) for p, parts in squares.items() for k, ring in enumerate(parts) for i, (x, y) in enumerate(ring)]
    corners = spark.createDataFrame(rings, "ring string, i int, x double, y double")
    edges = masks.polygon_edges(corners, "ring", "i").withColumn("name", F.split("ring", "/")[0])
    rng = random.Random(2)
    places = [(x / 2, y / 2) for x in range(-1, 24) for y in range(-1, 24)] + [(rng.uniform(-1, 12), rng.uniform(-1, 41)) for _ in range(300)]
    points = spark.createDataFrame([(i, x, y) for i, (x, y) in enumerate(places)] + [(-1, None, 1.0), (-2, 1.0, None)], "id int, x double, y double")

    def inside(x, y, parts):
        n = 0
        for ring in parts:
            for (x1, y1), (x2, y2) in zip(ring, [*ring[1:], ring[0]], strict=True):
                n += (y1 > y) != (y2 > y) and x < x1 + (y - y1) / (y2 - y1) * (x2 - x1)
        return n % 2 == 1

    want = {(i, p) for i, (x, y) in enumerate(places) for p, parts in squares.items() if inside(x, y, parts)}
    for band, most in ((1.0, 10**6), (0.3, 0), (100.0, 10**6)):
        monkeypatch.setattr(masks, "MOST_BROADCAST", most)
        assert {(r.id, r.name) for r in masks.in_polygons(points, edges, ["id"], "name", band).collect()} == want
    both = [i for i, p in want if p == "left" and (i, "right") in want]
    assert not both and all((i, "left") in want or (i, "right") in want for i, (x, y) in enumerate(places) if 0 <= x < 4 and 0 <= y < 2)


def test_masks_are_plain_columns(spark):
    rows = spark.createDataFrame([(1, "2020-01-05", 3.0, 0.0, 0.0, 1), (2, "2020-07-05", None, 3.0, 4.0, 2), (3, None, float("nan"), 6.0, 0.0, None)], "id int, d string, v double, x double, y double, q int").withColumn("d", F.to_date("d"))
    x, y = F.col("x"), F.col("y")
    told = {
        "winter": masks.seasonal_mask(F.col("d"), ["DJF"]), "good": masks.quality_mask(F.col("q"), [0, 1]), "sea": masks.land_sea_mask(x, 4.0), "land": masks.land_sea_mask(x, 4.0, land=True), "near": masks.distance_mask(x, y, 0.0, 0.0, 5.0),
        "box": masks.bounding_box_mask(x, y, 0.0, 3.0, 0.0, 4.0), "low": masks.band_mask(x, high=3.0), "there": masks.present("v"), "oval": masks.superellipse_mask(x, y, (0.0, 0.0), (4.5, 6.5), 4.0, 90.0), "any": masks.any_mask(F.col("q") == 2, F.col("d").isNull()), "none": masks.combine_masks(F.lit(None).cast("boolean")),
    }
    got = [list(map(bool, r)) for r in rows.orderBy("id").select(*told.values()).collect()]
    assert got == [[True, True, True, False, True, True, True, True, True, False, False], [False, False, True, False, False, True, True, False, True, True, False], [False, False, False, True, False, False, False, False, True, True, False]]
    held = masks.apply_mask(rows, F.col("q") == 1, ["v", "x"]).orderBy("id").collect()
    assert [(r.v, r.x, r.y) for r in held] == [(3.0, 0.0, 0.0), (None, None, 4.0), (None, None, 0.0)]
    found = masks.coverage(rows.withColumn("k", F.lit(None).cast("int")), ["k"], F.lit(1), "v", expected=6).first()
    assert (found.n_valid, found.n, found.fraction) == (1, 3, pytest.approx(1 / 6))
    assert {r.covered for r in masks.coverage_mask(rows.withColumn("k", F.lit(None).cast("int")), ["k"], F.lit(None).cast("int"), 0.3, "v").collect()} == {True}


def field(spark, n_rows=23, n_cols=17, seed=1):
    rng = np.random.default_rng(seed)
    values = rng.normal(size=(n_rows, n_cols)).cumsum(0)
    rows = [(None, r, c, float(values[r, c])) for r in range(n_rows) for c in range(n_cols)]
    return values, spark.createDataFrame(rows, "k int, row long, col long, value double")


@pytest.mark.parametrize("tile", [1, 5, 256])
def test_windows_do_not_depend_on_tiles(spark, tile):
    values, cells = field(spark)
    got = {(r.row, r.col): r for r in raster.slope_and_aspect(cells, ["k"], 2.0, tile).collect()}
    down, right = np.gradient(values, 2.0)
    assert len(got) == values.size
    for (i, j), r in got.items():
        assert r.slope == pytest.approx(math.degrees(math.atan(math.hypot(down[i, j], right[i, j]))))
        assert math.cos(math.radians(r.aspect) - math.atan2(-right[i, j], down[i, j])) == pytest.approx(1.0) and 0 <= r.aspect < 360
    rough = {(r.row, r.col): r.roughness for r in raster.roughness(cells, ["k"], *values.shape, sigma=1.2, tile=tile).collect()}
    weight = np.exp(-0.5 * (np.arange(-5, 6) / 1.2) ** 2)
    weight /= weight.sum()
    padded = np.pad(values, 5, "symmetric")
    for i, j in [(0, 0), (3, 9), (22, 16), (11, 0)]:
        part = padded[i : i + 11, j : j + 11]
        mean, square = weight @ part @ weight, weight @ (part * part) @ weight
        assert rough[i, j] == pytest.approx(math.sqrt(max(0, square - mean * mean)), abs=1e-9)


def test_cells_without_neighbours_and_windows_too_wide(spark):
    cells = spark.createDataFrame([(1, 5, 5, 2.0), (1, 5, 6, 4.0), (1, -9, -9, 1.0)], "k int, row long, col long, value double")
    assert all(r.slope is None and r.aspect is None for r in raster.slope_and_aspect(cells, ["k"], 1.0, 4).collect())
    with pytest.raises(ValueError, match="wider"):
        raster.roughness(cells, ["k"], 5, 50, sigma=3.0)
    full = raster.dense(cells, ["k"], 7, 7)
    assert full.count() == 49 and full.where("value is not null").count() == 2


@pytest.mark.parametrize("share", [0.02, 0.3, 0.9])
def test_distances_are_exact(spark, share):
    values, cells = field(spark, 19, 26, 3)
    open_ = np.random.default_rng(5).random(values.shape) < share
    cells = cells.withColumn("m", ~F.concat_ws(",", "row", "col").isin([f"{i},{j}" for i, j in np.argwhere(open_).tolist()])).union(spark.createDataFrame([(9, 0, 0, 1.0, True), (9, 0, 1, 1.0, None)], "k int, row long, col long, value double, m boolean"))
    at = np.argwhere(open_)
    for r in raster.distance_to_open(cells, ["k"], F.col("m"), 0.5).collect():
        want = 0.5 * np.sqrt(((at - [r.row, r.col]) ** 2).sum(1).min()) if r.k is None else (0.5 if r.m else 0.0)
        assert r.distance == pytest.approx(want)
    assert [r.distance for r in raster.distance_to_open(cells.where("k is null").limit(3), ["k"], F.lit(True)).collect()] == [None] * 3


def estimate(at):
    gaps = np.diff(at)
    n, k = len(at), len(gaps)
    if not k:
        return None, None, None
    theta = 2 * gaps.sum() ** 2 / (k * (gaps**2).sum()) if gaps.max() <= 2 else 2 * (gaps - 1).sum() ** 2 / (k * ((gaps - 1) * (gaps - 2)).sum())
    theta = min(1.0, float(theta))
    wanted = math.floor(theta * n) + 1
    length = int(np.sort(gaps)[::-1][wanted - 1]) if wanted <= k else 0
    return theta, length, int((gaps > length).sum()) + 1


@pytest.mark.parametrize("chunk", [10**6, 29])
def test_intervals_estimator(spark, chunk):
    rng = np.random.default_rng(7)
    high = {0: [], 1: [4], 2: [3, 4, 5], 3: [0, 2, 4, 6], 4: sorted(set(np.concatenate([c + np.arange(rng.integers(1, 5)) for c in rng.choice(300, 20, replace=False)]).tolist())), None: [1, 2, 50, 51, 90], 6: [0, 100]}
    rows = [(k, i, 2.0 if i in at else 1.0, 1.5) for k, at in high.items() for i in range(310)]
    df = spark.createDataFrame(rows, "k int, i int, value double, threshold double").repartition(5)
    got = {r.k: r for r in decluster.intervals_index(df, ["k"], ["i"], chunk_rows=chunk).collect()}
    assert set(got) == set(high)
    for k, at in high.items():
        theta, length, clusters = estimate(at)
        assert got[k].exceedances == len(at) and got[k].theta == (None if theta is None else pytest.approx(theta))
        if theta is not None:
            assert (got[k].run_length, got[k].clusters) == (length, clusters)
    found = decluster.intervals_clusters(df, ["k"], ["i"], chunk_rows=chunk).collect()
    for k, at in high.items():
        mine = sorted((r.first_ix, r.last_ix, r.n) for r in found if r.k == k)
        assert sum(n for *_, n in mine) == len(at) and len(mine) == (estimate(at)[2] or len(at))
        assert all(b[0] - a[1] > estimate(at)[1] for a, b in zip(mine, mine[1:], strict=False))
