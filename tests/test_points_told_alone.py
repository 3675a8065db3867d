"""Each point is told inside or outside where it stands; no task gathers crossings by point."""

from brinkline.operators import masks
from brinkline.plans import fields


def square(spark, *more):
    corners = [("a", 0, 0.0, 0.0), ("a", 1, 4.0, 0.0), ("a", 2, 4.0, 4.0), ("a", 3, 0.0, 4.0), *more]
    return masks.polygon_edges(spark.createDataFrame(corners, "g string, j int, x double, y double"), "g", "j")


def test_equal_rows_are_told_each(spark):
    points = spark.createDataFrame([(1, 1.0, 1.0), (1, 1.0, 1.0), (2, 5.0, 1.0), (3, 3.0, 3.5), (4, None, 1.0)], "id int, x double, y double")
    edges = square(spark, ("b", 0, 0.0, 0.0), ("b", 1, 2.0, 9.0), ("b", 2, 4.0, 0.0))
    got = sorted((r.id, r.g) for r in masks.in_polygons(points, edges, ["id"], "g", 0.5).collect())
    assert got == [(1, "a"), (1, "a"), (1, "b"), (1, "b"), (3, "a"), (3, "b")]


def test_points_meet_shuffled_edges_too(spark, monkeypatch):
    monkeypatch.setattr(masks, "MOST_BROADCAST", 0)
    points = spark.createDataFrame([(i, i / 10, i / 10) for i in range(80)], "id int, x double, y double")
    assert sorted(r.id for r in masks.in_polygons(points, square(spark), ["id"], "g", 0.5).collect()) == list(range(40))


def test_polygon_masks_groups_points_once(spark):
    """The exact distinct of the points, and the sums by region, are all that is gathered."""
    plan = fields.polygon_masks(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "brinkline_n" not in plan and plan.count("Aggregate [px") == 1
