import numpy as np
import pytest
from pyspark.sql import functions as F

from arborlake.operators import components, labels, morphology, vectorize
from arborlake.operators.graph import components as graph_components
from arborlake.operators.graph import eps_clusters


def pixels(spark, mask, image=1):
    ys, xs = np.nonzero(mask)
    return spark.createDataFrame([(image, int(x), int(y)) for x, y in zip(xs, ys)], "image_id int, x int, y int")


def flood(mask, steps):
    label, n = np.zeros(mask.shape, int), 0
    for y, x in zip(*np.nonzero(mask)):
        if label[y, x]:
            continue
        n += 1
        todo = [(y, x)]
        while todo:
            a, b = todo.pop()
            if 0 <= a < mask.shape[0] and 0 <= b < mask.shape[1] and mask[a, b] and not label[a, b]:
                label[a, b] = n
                todo += [(a + dy, b + dx) for dx, dy in steps]
    return label


FOUR = [(1, 0), (-1, 0), (0, 1), (0, -1)]
EIGHT = FOUR + [(1, 1), (-1, -1), (1, -1), (-1, 1)]


@pytest.mark.parametrize("connectivity,steps", [(4, FOUR), (8, EIGHT)])
def test_components_across_blocks_and_shuffled_rows(spark, connectivity, steps):
    mask = np.random.default_rng(7).random((40, 40)) < 0.55
    label = flood(mask, steps)
    rows = pixels(spark, mask).orderBy(F.rand(1)).repartition(3)
    out = components.connected_components(rows, ["image_id"], connectivity, block=8).collect()
    first = {}
    for r in out:
        first.setdefault(r.component, set()).add(label[r.y, r.x])
        code = r.component
        assert label[code >> 32, code & 0xFFFFFFFF] == label[r.y, r.x]
    assert all(len(v) == 1 for v in first.values()) and len(first) == label.max() and len(out) == mask.sum()


def test_spiral_is_one_component(spark):
    mask = np.zeros((21, 21), bool)
    mask[::2] = True
    for i, y in enumerate(range(1, 21, 2)):
        mask[y, 20 if i % 2 == 0 else 0] = True
    out = components.connected_components(pixels(spark, mask), ["image_id"], 4, block=4)
    assert out.select("component").distinct().count() == 1


def test_graph_components_of_a_long_chain(spark):
    chain = spark.range(200).selectExpr("id as u", "id + 1 as v").orderBy(F.rand(3))
    other = spark.createDataFrame([(1000, 1005), (1005, 1001)], "u long, v long")
    out = {r.node: r.component for r in graph_components(chain.unionByName(other)).collect()}
    assert all(out[i] == 0 for i in range(201)) and {out[i] for i in (1000, 1001, 1005)} == {1000}


def test_eps_clusters_equal_brute_force(spark):
    rng = np.random.default_rng(11)
    pts = rng.random((150, 2)) * 6
    pts[:20] = pts[0]
    eps = 0.45
    parent = list(range(len(pts)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(pts)):
        for j in range(i):
            if np.hypot(*(pts[i] - pts[j])) <= eps:
                parent[max(find(i), find(j))] = min(find(i), find(j))
    df = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(pts)], "point_id int, x double, y double")
    got = {r.point_id: r.cluster for r in eps_clusters(df, eps).collect()}
    order = {}
    for i in range(len(pts)):
        order.setdefault(find(i), len(order))
    assert got == {i: order[find(i)] for i in range(len(pts))}


def test_buffer_mask_and_small_removal(spark):
    mask = np.zeros((8, 8), bool)
    mask[0, 0] = mask[1, 1] = True  # 8-connected to the border
    mask[3:6, 3:6] = True
    px = pixels(spark, mask)
    sizes = spark.createDataFrame([(1, 8, 8)], "image_id int, width int, height int")
    cut = {(r.x, r.y) for r in components.buffer_mask(px, sizes, ["image_id"]).collect()}
    assert cut == {(0, 0), (1, 1)}
    assert components.remove_small(px, ["image_id"], 2).count() == 9
    assert components.count_components(px, ["image_id"]).first()["num_trees"] == 3


def test_component_iou_counts(spark):
    rows = [(1, 0, 0, True, True), (1, 5, 5, True, False), (1, 8, 8, False, True), (2, 0, 0, False, False)]
    px = spark.createDataFrame(rows, "image_id int, x int, y int, pred boolean, truth boolean")
    assert {r.image_id: r.tree_iou for r in components.component_iou(px).collect()} == {1: pytest.approx(1 / 3), 2: 1.0}


def chamfer(mask):
    """Two-pass distance, the textbook way, on a mask with background around it."""
    a, b = labels.AXIAL, labels.DIAGONAL
    d = np.where(mask, np.inf, 0.0)
    h, w = mask.shape
    for order, steps in ((1, ((0, -1, a), (-1, 0, a), (-1, -1, b), (-1, 1, b))), (-1, ((0, 1, a), (1, 0, a), (1, 1, b), (1, -1, b)))):
        for y in range(h)[::order]:
            for x in range(w)[::order]:
                for dy, dx, c in steps:
                    if 0 <= y + dy < h and 0 <= x + dx < w:
                        d[y, x] = min(d[y, x], d[y + dy, x + dx] + c)
    return d


def test_instance_distance_equals_two_pass_chamfer(spark):
    rng = np.random.default_rng(2)
    mask = np.zeros((24, 24), bool)
    for _ in range(6):
        y, x = rng.integers(0, 16, 2)
        mask[y:y + rng.integers(3, 9), x:x + rng.integers(3, 9)] = True
    want = chamfer(mask)
    px = pixels(spark, mask).withColumn("poly_id", F.lit(1))
    sizes = spark.createDataFrame([(1, 24, 24)], "image_id int, width int, height int")
    out = labels.instance_distance(px, sizes).collect()
    assert len(out) == mask.sum()
    for r in out:
        assert r.dist == pytest.approx(want[r.y, r.x])


def test_rasterize_small_triangle(spark):
    ring = [(0.0, 0.0), (4.0, 0.0), (0.0, 4.0)]
    polys = spark.createDataFrame([(1, 1, ring)], "image_id int, poly_id int, ring array<struct<x: double, y: double>>")
    got = {(r.x, r.y) for r in labels.rasterize(polys).collect()}
    assert got == {(x, y) for x in range(5) for y in range(5) if x + y <= 4}


@pytest.mark.parametrize("block", [4, 256])
def test_ring_areas_give_back_pixels(spark, block):
    mask = np.random.default_rng(9).random((20, 20)) < 0.6
    out = vectorize.rings(pixels(spark, mask), ["image_id"], block=block)
    assert out.agg(F.sum("signed")).first()[0] == mask.sum()
    assert out.filter("signed > 0").count() == flood(mask, EIGHT).max()


def test_contour_of_a_block_has_four_corners(spark):
    mask = np.zeros((9, 9), bool)
    mask[2:5, 1:8] = True
    out = vectorize.contours(pixels(spark, mask)).first()
    assert {(p.x, p.y) for p in out.ring} == {(1, 2), (8, 2), (8, 5), (1, 5)} and out.area == 21


def test_diagonal_pixels_are_one_outline(spark):
    out = vectorize.contours(pixels(spark, np.eye(3, dtype=bool))).collect()
    assert len(out) == 1 and out[0].area == 3


@pytest.mark.parametrize("tile", [5, 64])
def test_seeded_regions_do_not_depend_on_tiles(spark, tile):
    rng = np.random.default_rng(4)
    value = rng.integers(1, 6, (17, 17)).astype(float)
    value[rng.random((17, 17)) < 0.2] = np.nan
    rows = [(1, int(x), int(y), float(value[y, x])) for y, x in zip(*np.nonzero(np.isfinite(value)))]
    px = spark.createDataFrame(rows, "image_id int, x int, y int, value double")
    seeds = [(r[1], r[2]) for r in rows[::37]]
    markers = spark.createDataFrame([(1, x, y, (y << 32) + x) for x, y in seeds], "image_id int, x int, y int, marker long")
    out = {(r.x, r.y): r.region for r in morphology.seeded_regions(px, markers, tile=tile).collect()}
    assert all(out[x, y] == (y << 32) + x for x, y in seeds)
    mask = np.isfinite(value)
    reach = flood(mask, FOUR)
    reached = {reach[y, x] for x, y in seeds}
    assert set(out) == {(x, y) for y, x in zip(*np.nonzero(mask)) if reach[y, x] in reached}
    want = test_seeded_regions_do_not_depend_on_tiles.__dict__.setdefault("first", out)
    assert out == want


def test_two_blobs_are_two_instances(spark):
    yy, xx = np.mgrid[:40, :60]
    mask = ((xx - 15) ** 2 + (yy - 20) ** 2 < 80) | ((xx - 32) ** 2 + (yy - 20) ** 2 < 80)
    px = pixels(spark, mask).withColumn("value", F.lit(0.9))
    sizes = spark.createDataFrame([(1, 60, 40)], "image_id int, width int, height int")
    out = morphology.segment_instances(px, sizes, min_pixels=10, min_distance=10, blur_sigma=4.0)
    assert out.select("region").distinct().count() == 2
    assert vectorize.fit_ellipses(out, sizes, 10, 1).count() == 2


def plain_distance(mask):
    """Chamfer distance by relaxing all neighbours until nothing changes; the image border is no outside."""
    d = np.where(mask, np.inf, 0.0)
    while True:
        padded = np.pad(d, 1, constant_values=np.inf)
        steps = [padded[1 + dy : padded.shape[0] - 1 + dy, 1 + dx : padded.shape[1] - 1 + dx] + (labels.DIAGONAL if dx and dy else labels.AXIAL)
                 for dy in (-1, 0, 1) for dx in (-1, 0, 1) if dx or dy]
        new = np.minimum(d, np.min(steps, axis=0))
        if np.allclose(new, d, atol=1e-9, equal_nan=True) and (np.isinf(new) == np.isinf(d)).all():
            return new
        d = new


@pytest.mark.parametrize("block", [5, 8, 256])
def test_distances_across_blocks_equal_relaxation(spark, monkeypatch, block):
    monkeypatch.setattr(labels, "BLOCK", block)
    rng = np.random.default_rng(9)
    masks = {1: np.ones((30, 26), bool), 2: rng.random((30, 26)) < 0.97, 3: np.zeros((30, 26), bool), 4: rng.random((30, 26)) < 0.5}
    masks[3][4:22, 3:25] = True
    masks[3][10, 9] = False
    rows = [(1, k, int(x), int(y)) for k, m in masks.items() for y, x in zip(*np.nonzero(m))]
    px = spark.createDataFrame(rows, "image_id int, poly_id long, x int, y int").repartition(5)
    sizes = spark.createDataFrame([(1, 26, 30)], "image_id int, width int, height int")
    got = {(r.poly_id, r.x, r.y): (r.dist, r.outline) for r in labels.instance_distance(px, sizes).collect()}
    assert len(got) == len(rows)
    for k, m in masks.items():
        want, framed = plain_distance(m), np.pad(m, 1)
        inner = framed[:-2, 1:-1] & framed[2:, 1:-1] & framed[1:-1, :-2] & framed[1:-1, 2:]
        for y, x in zip(*np.nonzero(m)):
            dist, outline = got[k, x, y]
            assert dist is None if np.isinf(want[y, x]) else dist == pytest.approx(want[y, x], abs=1e-9)
            assert outline == (not inner[y, x])
