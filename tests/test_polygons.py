import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from arborlake.functions import geometry as geo
from arborlake.operators import matching, polygons
from arborlake.operators.spatial_join import box_join, nearest_join

SCHEMA = "image_id int, poly_id long, ring array<struct<x: double, y: double>>"


def rings(spark, *rows):
    return spark.createDataFrame([(k, i, [(float(x), float(y)) for x, y in pts]) for k, i, pts in rows], SCHEMA)


def box(x, y, w, h):
    return [(x, y), (x + w, y), (x + w, y + h), (x, y + h)]


def test_overlap_of_concave_and_slanted_rings_in_both_directions(spark):
    ell = [(0, 0), (4, 0), (4, 2), (2, 2), (2, 4), (0, 4)]
    tri = [(0, 0), (4, 0), (0, 4)]
    for a in (ell, ell[::-1]):
        for b in (tri, tri[::-1]):
            out = polygons.overlap_area(rings(spark, (1, 1, a)), rings(spark, (1, 2, b))).first()
            assert out["inter"] == pytest.approx(8.0)  # the diagonal of the triangle runs through the notch corner
    same = polygons.overlap_area(rings(spark, (1, 1, ell)), rings(spark, (1, 2, ell))).first()
    assert same["inter"] == pytest.approx(12.0)


def test_overlap_far_from_the_origin_keeps_precision(spark):
    out = polygons.overlap_area(
        rings(spark, (1, 1, box(500000, 6700000, 10, 10))), rings(spark, (1, 2, box(500005, 6700005, 10, 10)))).first()
    assert out["inter"] == pytest.approx(25.0, abs=1e-6)


def test_touching_boxes_do_not_pair(spark):
    pairs = polygons.overlap_area(rings(spark, (1, 1, box(0, 0, 2, 2))), rings(spark, (1, 2, box(2, 0, 2, 2))))
    assert pairs.count() == 0


@pytest.mark.parametrize("seed", [1, 2])
def test_box_join_equals_brute_force_with_mixed_sizes(spark, seed):
    rng = np.random.default_rng(seed)

    def side(n):
        lo = rng.uniform(-50, 50, (n, 2))
        size = 4.0 ** rng.uniform(-1, 3, (n, 2))
        return [(i % 2, i, *map(float, (*lo[i], *(lo[i] + size[i])))) for i in range(n)]

    left, right = side(80), side(70)
    cols = "k int, {} int, min_x double, min_y double, max_x double, max_y double"
    got = box_join(spark.createDataFrame(left, cols.format("a")), spark.createDataFrame(right, cols.format("b")), ["k"])
    rows = [(r.a, r.b) for r in got.collect()]
    want = {(p[1], q[1]) for p in left for q in right
            if p[0] == q[0] and p[2] < q[4] and q[2] < p[4] and p[3] < q[5] and q[3] < p[5]}
    assert len(rows) == len(set(rows)) and set(rows) == want


def test_nearest_join_equals_brute_force_with_copies(spark):
    rng = np.random.default_rng(3)
    pts = [(1, i, float(x), float(y)) for i, (x, y) in enumerate(rng.integers(0, 60, (60, 2)))]
    cand = [(1, i, float(x), float(y)) for i, (x, y) in enumerate([*rng.integers(0, 60, (30, 2)), *[(5, 5)] * 40])]
    got = nearest_join(spark.createDataFrame(pts, "k int, point_id int, lx double, ly double"),
                       spark.createDataFrame(cand, "k int, candidate_id int, rx double, ry double"), ["k"], 12.0)
    want = {}
    for _, i, x, y in pts:
        d, j = min((round(np.hypot(x - cx, y - cy), 9), j) for _, j, cx, cy in cand)
        if d <= 12:
            want[i] = j
    assert {r.point_id: r.candidate_id for r in got.collect()} == want


def test_validate_reports_reasons(spark):
    rows = rings(spark, (1, 1, box(0, 0, 2, 2)), (1, 2, [(0, 0), (1, 1)]), (1, 3, [(0, 0), (1, 1), (2, 2)]),
                 (1, 4, [(0, 0), (4, 4), (4, 0), (0, 3)]))
    good, bad = polygons.validate_polygons(rows)
    assert [r.poly_id for r in good.collect()] == [1]
    assert {r.poly_id: r.reason for r in bad.collect()} == {2: "fewer than 3 points", 3: "zero area", 4: "self-crossing"}


def test_convex_hull_of_a_star(spark):
    star = [(0, 0), (5, 1), (10, 0), (9, 5), (10, 10), (5, 9), (0, 10), (1, 5)]
    out = polygons.convex_hull(rings(spark, (1, 1, star))).first()
    assert out["hull_area"] == 100.0 and out["hull_perimeter"] == 40.0 and len(out["hull"]) == 4


def test_hull_drops_collinear_points(spark):
    out = polygons.convex_hull(rings(spark, (1, 1, [(0, 0), (1, 0), (2, 0), (2, 2), (0, 2)]))).first()
    assert {(p.x, p.y) for p in out["hull"]} == {(0, 0), (2, 0), (2, 2), (0, 2)}


def test_close_ring_is_idempotent_and_drops_short_rings(spark):
    rows = rings(spark, (1, 1, box(0, 0, 1, 1)), (1, 2, [(0, 0), (1, 1)]))
    once = polygons.close_rings(rows)
    twice = polygons.close_rings(once)
    assert [len(r.ring) for r in once.collect()] == [5] == [len(r.ring) for r in twice.collect()]
    assert rows.filter("poly_id = 1").select(F.size(geo.open_ring(geo.close_ring(F.col("ring"))))).first()[0] == 4


def test_pixel_iou_first_truth_wins_and_unchosen_truth_counts_zero(spark):
    truth = rings(spark, (1, 5, box(0, 0, 4, 4)), (1, 6, box(0, 0, 4, 4)), (1, 7, box(20, 20, 2, 2)))
    pred = rings(spark, (1, 1, box(0, 0, 4, 4)), (1, 2, box(50, 50, 2, 2)))
    # ious 1 and 0 for the predictions, 0 for truths 6 and 7
    assert matching.object_pixel_iou(pred, truth).first()["pixel_iou"] == pytest.approx(0.25)
    assert matching.tree_iou_greedy(pred, truth).first()["tree_iou"] == pytest.approx(1 / 4)


def test_one_empty_side_scores_zero(spark):
    truth, pred = rings(spark, (1, 1, box(0, 0, 2, 2))), rings(spark, (2, 1, box(0, 0, 2, 2)))
    assert {r.image_id: r.pixel_iou for r in matching.object_pixel_iou(pred, truth).collect()} == {1: 0.0, 2: 0.0}
    out = {r.image_id: (r.tp, r.fp, r.fn) for r in matching.centroid_match(pred, truth).collect()}
    assert out == {1: (0, 0, 1), 2: (0, 1, 0)}


def test_greedy_and_optimal_differ_where_they_should(spark):
    # prediction 1 covers truth 10 best, but only truth 11 is left for it once prediction 2 takes 10
    truth = rings(spark, (1, 10, box(0, 0, 10, 10)), (1, 11, box(8, 0, 10, 10)))
    pred = rings(spark, (1, 1, box(4, 0, 10, 10)), (1, 2, box(0, 0, 10, 10)))
    assert matching.tree_iou_optimal(pred, truth).first()["tree_iou"] == pytest.approx(1.0)
    assert matching.tree_iou_greedy(pred, truth).first()["tree_iou"] == pytest.approx(1 / 3)


def test_best_assignment_equals_brute_force_with_copies(spark):
    from functools import lru_cache

    rng = np.random.default_rng(5)
    for trial in range(3):
        w = np.where(rng.random((4, 4)) < 0.7, rng.integers(1, 100, (4, 4)), 0) / 100
        l_copies, r_copies = rng.integers(1, 3, 4), rng.integers(1, 3, 4)
        rows = [(1, i, j, int(l_copies[i]), int(r_copies[j]), float(w[i, j])) for i in range(4) for j in range(4) if w[i, j] > 0]
        pairs = spark.createDataFrame(rows, "k int, left_id int, right_id int, left_copies long, right_copies long, iou double")
        out = matching.best_assignment(pairs, ["k"]).collect()
        got = sum(r.iou * r.units for r in out)
        big = w[np.ix_(np.repeat(range(4), l_copies), np.repeat(range(4), r_copies))]
        big = big if big.shape[0] <= big.shape[1] else big.T
        @lru_cache(None)
        def best(i, used):
            if i == big.shape[0]:
                return 0.0
            return max([best(i + 1, used)] + [big[i, j] + best(i + 1, used | 1 << j) for j in range(big.shape[1]) if not used >> j & 1])

        assert got == pytest.approx(best(0, 0))
        for end, copies in (("left_id", l_copies), ("right_id", r_copies)):
            used = {}
            for r in out:
                used[r[end]] = used.get(r[end], 0) + r.units
            assert all(n <= copies[i] for i, n in used.items())


def ring_of(points):
    return [{"x": float(x), "y": float(y)} for x, y in points]


def plain_crossing(points):
    """All pairs of edges that do not follow each other."""
    n = len(points)
    side = lambda p, q, r: np.sign((q[0] - p[0]) * (r[1] - p[1]) - (q[1] - p[1]) * (r[0] - p[0]))
    for i in range(n):
        for j in range(i + 2, n):
            if i == 0 and j == n - 1:
                continue
            a, b, c, d = points[i], points[(i + 1) % n], points[j], points[(j + 1) % n]
            boxes = all(min(a[k], b[k]) <= max(c[k], d[k]) and min(c[k], d[k]) <= max(a[k], b[k]) for k in (0, 1))
            if boxes and side(a, b, c) * side(a, b, d) <= 0 and side(c, d, a) * side(c, d, b) <= 0:
                return True
    return False


def test_sweep_finds_the_crossings_of_all_pairs(spark):
    rng = np.random.default_rng(5)
    rings = []
    for _ in range(150):
        n = int(rng.integers(4, 14))
        turn = np.sort(rng.random(n)) * 2 * np.pi
        points = np.stack([np.cos(turn), np.sin(turn)], axis=1) * (4 + 3 * rng.random((n, 1)))
        if rng.random() < 0.5:
            points[rng.integers(n)] = rng.integers(-6, 7, 2)
        points = np.round(points, 1)
        if len({tuple(p) for p in points.tolist()}) == n:
            rings.append([tuple(p) for p in points.tolist()])
    rows = spark.createDataFrame([(i, ring_of(r)) for i, r in enumerate(rings)], "i int, ring array<struct<x:double,y:double>>")
    got = {r.i: r.c for r in rows.select("i", geo.crosses_itself(F.col("ring")).alias("c")).collect()}
    want = {i: plain_crossing(r) for i, r in enumerate(rings)}
    assert got == want and 20 < sum(want.values()) < len(want) - 20


def test_a_ring_of_a_hundred_thousand_points_takes_seconds(spark):
    turn = np.linspace(0, 2 * np.pi, 100_000, endpoint=False)
    wave = 1000 + 5 * np.sin(400 * turn)
    points = np.stack([wave * np.cos(turn), wave * np.sin(turn)], axis=1)
    crossed = points.copy()
    crossed[[500, 60_000]] = crossed[[60_000, 500]]
    rows = spark.createDataFrame([(0, ring_of(points)), (1, ring_of(crossed))], "i int, ring array<struct<x:double,y:double>>")
    start = time.time()
    got = {r.i: r.c for r in rows.select("i", geo.crosses_itself(F.col("ring")).alias("c")).collect()}
    assert got == {0: False, 1: True} and time.time() - start < 120
