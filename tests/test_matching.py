"""Matching of points and scores of polygons: equal to a loop, and no step taken twice."""

import numpy as np
import pytest

from arborlake.operators import matching, polygons, spatial_join
from arborlake.plans import evaluate


def loop(left, right, limit):
    """Pairs that the plain loop takes: points as (id, x, y)."""
    taken = []
    for a, x, y in sorted(left):
        for b, u, v in sorted(right):
            if np.hypot(x - u, y - v) <= limit and b not in [t[1] for t in taken]:
                taken.append((a, b))
                break
    return taken


def table(spark, points):
    return spark.createDataFrame([("a", *p) for p in points], "image_id string, point_id long, x double, y double")


@pytest.mark.parametrize("block", [5, 32])
def test_matching_by_blocks_equals_the_loop(spark, monkeypatch, block):
    """Small blocks leave open pairs to the next layouts; ids follow no order of place."""
    monkeypatch.setattr(matching, "BLOCK", block)
    rng = np.random.default_rng(block)
    left, right = ([(int(i), *map(float, p)) for i, p in zip(rng.permutation(150), rng.integers(-30, 30, (150, 2)) / 2)] for _ in "lr")
    pairs = spatial_join.distance_join(
        table(spark, left).selectExpr("image_id", "point_id as left_id", "x as lx", "y as ly"),
        table(spark, right).selectExpr("image_id", "point_id as right_id", "x as rx", "y as ry"), ["image_id"], 2.0)
    found = sorted((r.left_id, r.right_id) for r in matching.first_free_pairs(pairs, ["image_id"], 2.0).collect())
    assert found == sorted(loop(left, right, 2.0)) and len(found) > 50
    assert matching.proximity_match(table(spark, left), table(spark, right), limit=2.0).first().tp == len(found)


def test_a_long_chain_takes_a_block_at_a_time(spark, monkeypatch):
    """Every pair hangs on the one before it; rounds over single pairs would be 300."""
    passes, cut = [], matching.cut_lineage
    monkeypatch.setattr(matching, "cut_lineage", lambda df: (passes.append(1), cut(df))[1])
    points = [(i, float(i), 0.0) for i in range(300)]
    row = matching.proximity_match(table(spark, points), table(spark, points), limit=3.0).first()
    assert row.tp == 300 and row.localization_error == 0 and len(passes) < 30


def test_an_id_with_several_places_and_points_without_id(spark):
    left = [(1, 0.0, 0.0), (1, 500.0, 0.0), (2, 500.0, 1.0), (None, 0.0, 0.0)]
    right = [(7, 0.0, 0.0), (8, 500.0, 0.0)]
    row = matching.proximity_match(table(spark, left), table(spark, right)).first()
    assert row.tp == 2 and row.precision == 0.5 and row.recall == 1.0 and row.localization_error == 0.5


@pytest.mark.parametrize("eps", [0.1, 5.0])
def test_distance_join_equals_brute_force_on_borders(spark, eps):
    rng = np.random.default_rng(1)
    left, right = ([(i, *map(float, p)) for i, p in enumerate(rng.integers(-40, 40, (120, 2)) * eps / 4)] for _ in "lr")
    pairs = spatial_join.distance_join(spark.createDataFrame([(1, *p) for p in left], "k int, a int, lx double, ly double"),
                                       spark.createDataFrame([(1, *p) for p in right], "k long, b int, rx double, ry double"), ["k"], eps)
    found = [(r.a, r.b) for r in pairs.collect()]
    want = {(a, b) for a, x, y in left for b, u, v in right if np.sqrt((x - u) * (x - u) + (y - v) * (y - v)) <= eps}
    assert len(found) == len(set(found)) and set(found) == want


def test_a_right_point_is_copied_to_its_own_and_the_nearer_cells(spark):
    right = spark.createDataFrame([(1, 1, 3.0, 3.0)], "k int, b int, rx double, ry double")
    left = spark.createDataFrame([(1, 1, 3.0, 3.0)], "k int, a int, lx double, ly double")
    sides = []
    join = spatial_join.join_large
    spatial_join.join_large, before = (lambda df, side, on, how="inner": (sides.append(side), join(df, side, on, how))[1]), join
    try:
        assert spatial_join.distance_join(left, right, ["k"], 5.0).count() == 1
    finally:
        spatial_join.join_large = before
    assert sides[0].count() == 4


def test_measures_of_rings_are_taken_once(spark, tmp_path):
    ring = [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0)]
    rows = [(1, 1, ring), (1, 2, [(0.0, 0.0), (1.0, 1.0), (2.0, 2.0)]), (1, 3, None)]
    spark.createDataFrame(rows, "image_id int, poly_id int, ring array<struct<x: double, y: double>>").write.parquet(f"{tmp_path}/p")
    polys = spark.read.parquet(f"{tmp_path}/p")
    measured = polygons.polygon_moments(polys)
    assert [(r.poly_id, r.m00, r.cx, r.cy_px) for r in measured.collect()] == [(1, 16.0, 2.0, 2)]
    optimised = measured.select("cx", "cy")._jdf.queryExecution().optimizedPlan().toString()
    assert optimised.count("aggregate(") == 1
    assert polygons.overlap_area(polys.filter("poly_id < 3"), polys.filter("poly_id < 3")).select("left_id", "inter").collect() == [(1, 16.0)]


def test_triangles_and_crossing_rings(spark):
    rows = [(1, [(0.0, 0.0), (4.0, 0.0), (0.0, 4.0), (0.0, 4.0), (0.0, 0.0)]), (2, [(0.0, 0.0), (4.0, 4.0), (4.0, 0.0), (0.0, 3.0)])]
    polys = spark.createDataFrame(rows, "poly_id int, ring array<struct<x: double, y: double>>")
    good, bad = polygons.validate_polygons(polys)
    assert [r.poly_id for r in good.collect()] == [1] and [(r.poly_id, r.reason) for r in bad.collect()] == [(2, "self-crossing")]


def test_files_are_numbered_and_sides_counted_once(spark, monkeypatch):
    calls, keys = [], []
    count, overlap = matching.count_sides, polygons.overlap_area
    monkeypatch.setattr(matching, "count_sides", lambda *a: (calls.append(1), count(*a))[1])
    monkeypatch.setattr(evaluate, "overlap_area", lambda a, b, by: (keys.append(list(by)), overlap(a, b, by))[1])
    ring = [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0)]
    shapes = "pred_set string, file string, poly_id int, ring array<struct<x: double, y: double>>"
    pred = spark.createDataFrame([("s", "a", 1, ring), ("s", "a", 2, ring), ("s", "elsewhere", 3, ring), ("s", None, 4, ring)], shapes)
    truth = spark.createDataFrame([("s", "a", 1, ring), ("s", "b", 2, ring), ("s", "b", 3, ring[:2])], shapes)
    files = spark.createDataFrame([("s", "a", 1.0, 2.0), ("s", "a", 3.0, 4.0), ("s", "b", 1.0, 2.0), ("s", None, 1.0, 2.0)],
                                  "pred_set string, file string, latitude double, longitude double")
    rows = {(r.file, r.latitude): (r.pixel_iou, r.tree_iou, r.tp, r.fp, r.fn, r.n_pred, r.n_truth, r.status) for r in evaluate.evaluate_files(pred, truth, files).collect()}
    a = (1.0, 0.5, 1, 1, 0, 2, 1, "ok")
    assert rows == {("a", 1.0): a, ("a", 3.0): a, ("b", 1.0): (0.0, 0.0, 0, 0, 1, 0, 1, "rejected rings"), (None, 1.0): (0.0, 0.0, 0, 0, 0, 0, 0, "empty")}
    assert calls == [1] and keys == [["_file"]]
