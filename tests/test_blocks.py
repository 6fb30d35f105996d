import numpy as np
import pytest
from pyspark.sql import functions as F

from arborlake.operators import blocks, scoring, tiling
from arborlake.operators.components import window_marks
from arborlake.plans import create_patches, predict

TILE = "image_id string, width int, height int, tile_x int, tile_y int, bands array<array<double>>"


def tiled(images, side):
    """Tiles of images given as (name, bands x height x width); the last ones are smaller."""
    rows = []
    for name, image in images:
        for y in range(0, image.shape[1], side):
            for x in range(0, image.shape[2], side):
                part = image[:, y : y + side, x : x + side]
                rows.append((name, part.shape[2], part.shape[1], x, y, part.reshape(len(part), -1).tolist()))
    return rows


def meta_of(spark, images):
    return spark.createDataFrame([(n, i.shape[2], i.shape[1]) for n, i in images], "image_id string, width int, height int")


@pytest.fixture(scope="module")
def images():
    rng = np.random.default_rng(1)
    return [("a", rng.normal(size=(3, 37, 53))), ("b", rng.normal(size=(3, 20, 9))), ("tiny", rng.normal(size=(3, 4, 4)))]


@pytest.mark.parametrize("window,stride,pad_mode,side,tile", [(8, 4, "none", 16, 11), (8, 4, "multiple", 16, 64), (6, 6, "multiple", 12, 5), (5, 7, "none", 14, 10), (9, 1, "none", 4, 20)])
def test_windows_are_slices_of_the_image(spark, monkeypatch, images, window, stride, pad_mode, side, tile):
    monkeypatch.setattr(blocks, "SIDE", side)
    monkeypatch.setattr(blocks, "GROWTH", 9.0)  # small blocks, so that windows cross them
    meta = meta_of(spark, images)
    rows = spark.createDataFrame(tiled(images, tile), TILE).repartition(5)
    marks = [(n, x, y, float(x * 100 + y)) for n, i in images for y in range(0, i.shape[1], 3) for x in range(0, i.shape[2], 2)]
    pixels = spark.createDataFrame(marks, "image_id string, x int, y int, mark double")
    got = blocks.cut_windows(rows, meta, window, stride, pad_mode, pixels, ["mark"]).collect()
    grid = {(r.image_id, r.idx): (r.pixel_x, r.pixel_y) for r in tiling.window_grid(meta, window, stride, pad_mode).collect()}
    assert {(r.image_id, r.idx): (r.pixel_x, r.pixel_y) for r in got} == grid and len(got) == len(grid)
    whole = {}
    for name, image in images:
        extra = np.zeros((1, *image.shape[1:]))
        for n, x, y, v in marks:
            if n == name:
                extra[0, y, x] = v
        whole[name] = np.pad(np.concatenate([image, extra]), ((0, 0), (0, window), (0, window)))
    for r in got:
        want = whole[r.image_id][:, r.pixel_y : r.pixel_y + window, r.pixel_x : r.pixel_x + window].reshape(4, -1)
        assert np.array_equal(np.array([*r.bands, r.mark]), want)


@pytest.mark.parametrize("mode", ["sum", "mean"])
def test_stitched_map_equals_brute_force(spark, monkeypatch, images, mode):
    monkeypatch.setattr(blocks, "SIDE", 10)
    meta = meta_of(spark, images)
    rng = np.random.default_rng(2)
    window, rows = 8, []
    for r in tiling.window_grid(meta, window, 4, "multiple").collect():
        rows.append((r.image_id, r.pixel_x, r.pixel_y, rng.random(window * window).tolist()))
    scored = spark.createDataFrame(rows, "image_id string, pixel_x int, pixel_y int, scores array<double>")
    got = {(r.image_id, r.x, r.y): r.value for r in scoring.stitch(scored.repartition(6), meta, window, 0.5, mode).collect()}
    assert len(got) == sum(i.shape[1] * i.shape[2] for _, i in images)
    for name, image in images:
        total, n = np.zeros((80, 80)), np.zeros((80, 80))
        for own, x, y, s in rows:
            if own == name:
                s = np.array(s).reshape(window, window)
                total[y : y + window, x : x + window] += s
                n[y : y + window, x : x + window] += s >= 0.5 if mode == "sum" else 1
        want = np.clip(np.divide(total, n, out=np.zeros_like(total), where=n > 0), 0, 1)
        for y in range(image.shape[1]):
            for x in range(image.shape[2]):
                assert got[name, x, y] == pytest.approx(want[y, x])


@pytest.mark.parametrize("window,stride", [(256, 128), (256, 256), (256, 64), (512, 100), (3, 1), (64, 100)])
def test_rims_add_at_most_half(window, stride):
    b = blocks.Blocks(window, stride)
    assert (b.reach / b.side) ** 2 <= blocks.GROWTH and b.side % stride == 0
    assert b.side >= blocks.SIDE


def test_pieces_shuffle_at_most_half_more_than_the_image(spark, monkeypatch):
    monkeypatch.setattr(blocks, "SIDE", 32)
    image = np.arange(2 * 300 * 280, dtype=float).reshape(2, 300, 280)
    rows = spark.createDataFrame(tiled([("a", image)], 50), TILE)
    b = blocks.Blocks(16, 8)
    meta = meta_of(spark, [("a", image)]).withColumns({"blocks_x": F.lit(100), "blocks_y": F.lit(100)})
    moved = blocks.pieces(rows, meta.drop("width", "height"), b.side, b.reach).agg(F.sum(F.col("rows") * F.col("cols"))).first()[0]
    assert moved <= blocks.GROWTH * image.shape[1] * image.shape[2]


def test_holes_and_missing_values(spark):
    meta = spark.createDataFrame([("a", 4, 2), ("none", 4, 4)], "image_id string, width int, height int")
    rows = spark.createDataFrame([("a", 2, 2, 0, 0, [[1.0, None, 3.0, 4.0]])], TILE)
    got = {r.idx: r.bands[0] for r in blocks.cut_windows(rows, meta, 2, 2).collect()}
    assert got[1] == [0.0] * 4 and got[0][0] == 1.0 and np.isnan(got[0][1]) and set(got) == {0, 1}
    assert blocks.cut_windows(rows.limit(0), meta, 2, 2).collect() == []


def test_marks_of_a_window(spark):
    mask = np.array([[1, 0, 0, 0, 0], [0, 1, 0, 1, 0], [0, 0, 0, 1, 0], [0, 1, 0, 0, 0], [0, 0, 0, 0, 0]])
    row = spark.createDataFrame([(mask.ravel().tolist(),), ([0] * 25,)], "mask array<int>").select(window_marks(F.col("mask"), 5).alias("m")).collect()
    assert row[0].m.num_trees == 4 and row[1].m.num_trees == 0
    want = np.ones((5, 5), int)
    want[0, 0] = want[1, 1] = 0  # 8-connected with the border pixel
    assert row[0].m.buffer_mask == want.ravel().tolist() and row[1].m.buffer_mask == [1] * 25


def test_images_of_different_pixel_size_keep_their_own_least_area(spark):
    """One area in map units is 16 pixels of one image and 4 of the other."""
    image = np.zeros((1, 24, 24))
    image[0, 4:7, 4:7] = 1.0  # 9 pixels
    rows = spark.createDataFrame(tiled([("fine", image), ("coarse", image)], 12), TILE)
    place = [("fine", 24, 24, 0.5, 0.0, 0.0, 0.0, -0.5, 0.0), ("coarse", 24, 24, 1.0, 0.0, 0.0, 0.0, -1.0, 0.0)]
    meta = spark.createDataFrame(place, "image_id string, width int, height int, a double, b double, c double, d double, e double, f double")
    least = {r.image_id: r.min_pixels for r in predict.pixels_of_area(meta, 4.0).collect()}
    assert least == {"fine": 16, "coarse": 4}
    found = predict.predict_images(rows, meta, lambda: lambda batch: batch * 20 - 10, window=8, stride=4, crop=8, post_process=True, min_area=4.0, dilation_radius=1, erosion_radius=0, scale=False)
    assert {r.image_id for r in found.collect()} == {"coarse"}


def test_patch_table_across_blocks(spark, monkeypatch):
    monkeypatch.setattr(blocks, "SIDE", 8)
    monkeypatch.setattr(blocks, "GROWTH", 9.0)
    rng = np.random.default_rng(3)
    image = rng.integers(1, 200, size=(4, 24, 32)).astype(float)
    rows = spark.createDataFrame(tiled([("a", image)], 10), TILE)
    place = [("a", 24, 32, 1.0, 0.0, 300000.0, 0.0, -1.0, 6700024.0, 3067)]
    meta = spark.createDataFrame([("a", 32, 24, *place[0][3:])], "image_id string, width int, height int, a double, b double, c double, d double, e double, f double, epsg int")
    ring = [(300002.5, 6700021.5), (300009.5, 6700021.5), (300009.5, 6700014.5), (300002.5, 6700014.5)]
    polys = spark.createDataFrame([("a", 1, [{"x": x, "y": y} for x, y in ring])], "image_id string, poly_id long, ring array<struct<x:double,y:double>>")
    table, rejects = create_patches.build_patch_table(rows, meta, polys, create_patches.PatchParams(window=12, stride=4))
    got = {r.idx: r for r in table.collect()}
    assert len(got) == 6 * 4 and rejects.count() == 0
    for r in got.values():
        here = np.s_[r.pixel_y : r.pixel_y + 12, r.pixel_x : r.pixel_x + 12]
        assert [np.array_equal(np.array(b).reshape(12, 12), image[o][here]) for b, o in zip(r.bands, (3, 0, 1, 2))] == [True] * 4
        assert len(r.mask) == len(r.centroid) == len(r.hybrid) == len(r.buffer_mask) == 144
        assert r.num_trees == int(any(r.mask)) and r.patch_key == f"a_{r.idx}"
    inside = got[0]
    assert sum(inside.mask) == 64 and inside.num_trees == 1 and min(inside.buffer_mask) == 1
    cut = got[1]  # starts at x = 4, so the square is cut
    assert 0 < sum(cut.mask) < 64 and 144 - sum(cut.buffer_mask) == sum(cut.mask)
