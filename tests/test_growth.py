"""Steps whose memory and disk must not grow faster than the input."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from arborlake.operators import blocks, labels, morphology, polygons, raster, vectorize
from arborlake.operators.spatial_join import box_join
from arborlake.session import spread
from arborlake.sources import geojson, patches
from arborlake.sources import tiles as sources_tiles
from catalog import fixtures, load_all
from catalog.registry import QUERIES


load_all()


def plan(df) -> str:
    return df._jdf.queryExecution().toString()


def boxes(spark, name):
    return spark.range(200).selectExpr("1 as image_id", f"id as {name}", "id * 3.0D as min_x", "0.0D as min_y", "id * 3.0D + 4 as max_x", "2.0D as max_y")


def test_box_join_broadcasts_no_side_that_grows(spark):
    pairs = box_join(boxes(spark, "a"), boxes(spark, "b"), ["image_id"])
    assert "BroadcastHashJoin" not in plan(pairs)
    assert pairs.count() == 200 + 2 * 199


def test_scaled_tiles_broadcast_no_pixels(spark, tmp_path):
    rows = spark.range(6).selectExpr("id as vec_id", "array_repeat(cast(0.5 as float), 64) as embedding", "1 as label")
    rows.write.parquet(f"{tmp_path}/embeddings.parquet")
    out = QUERIES["scaled_tiles"](spark, str(tmp_path))
    assert "BroadcastHashJoin" not in plan(out)
    assert out.count() == 6 * 64


def test_peaks_and_floods_broadcast_no_side_that_grows(spark, monkeypatch):
    plans, cut = [], morphology.cut_lineage
    monkeypatch.setattr(morphology, "cut_lineage", lambda df: (plans.append(plan(df)), cut(df))[1])
    px = spark.range(400).selectExpr("1 as image_id", "cast(id % 20 as int) as x", "cast(id div 20 as int) as y", "cast(id * 7 % 11 as double) as value")
    peaks = morphology.spaced_peaks(px, 3)
    regions = morphology.seeded_regions(px, peaks, tile=8)
    assert regions.count() == 400
    assert not any("BroadcastHashJoin" in p for p in plans)


def square(x, y, side=4):
    return [(float(x), float(y)), (float(x + side), float(y)), (float(x + side), float(y + side)), (float(x), float(y + side))]


@pytest.fixture
def shapes(spark):
    rows = [(1, 1, square(250, 3)), (1, 2, square(254, 5)), (1, 3, square(20, 0)), (2, 4, square(2, 2)), (2, 5, square(2, 2))]
    polys = spark.createDataFrame(rows, "image_id int, poly_id int, ring array<struct<x: double, y: double>>")
    return polys, spark.createDataFrame([(1, 300, 12), (2, 9, 9)], "image_id int, width int, height int")


def brute_heat(sigma=2.0):
    out, reach = {}, int(8 * sigma)
    for image, wide, high, seeds in ((1, 300, 12, [(252, 5), (256, 7), (22, 2)]), (2, 9, 9, [(4, 4), (4, 4)])):
        for cx, cy in seeds:
            for y in range(max(0, cy - reach), min(high, cy + reach + 1)):
                for x in range(max(0, cx - reach), min(wide, cx + reach + 1)):
                    out[image, x, y] = out.get((image, x, y), 0.0) + np.exp(-((x - cx) ** 2 + (y - cy) ** 2) / (2 * sigma**2))
    return {k: min(1.0, v) for k, v in out.items()}


def test_heat_is_summed_in_blocks(spark, shapes):
    heat, want = labels.centroid_heat(*shapes), brute_heat()
    assert "Generate explode(sequence(greatest" not in plan(heat) and "MapInArrow" in plan(heat)
    got = {(r.image_id, r.x, r.y): r.heat for r in heat.collect()}
    assert got.keys() == want.keys()
    assert all(got[k] == pytest.approx(want[k], abs=1e-12) for k in want)


def test_channels_meet_in_blocks(spark, shapes):
    channels = labels.label_channels(*shapes)
    assert "MapInArrow" in plan(channels)
    got = {(r.image_id, r.x, r.y): r for r in channels.collect()}
    want = brute_heat()
    hybrid = {(r.image_id, r.x, r.y): r.hybrid for r in labels.hybrid_label(labels.instance_distance(labels.rasterize(*shapes), shapes[1])).collect()}
    assert got.keys() == want.keys() | hybrid.keys()
    for k, r in got.items():
        assert r.mask == (k in hybrid) and r.hybrid == pytest.approx(hybrid.get(k, 0.0)) and r.centroid == pytest.approx(want.get(k, 0.0), abs=1e-12)


def test_instances_of_many_sizes_settle_together(spark):
    rng, rows = np.random.default_rng(5), []
    for k in range(60):
        x, y, w, h = rng.integers(0, 40), rng.integers(0, 40), rng.integers(1, 30), rng.integers(1, 30)
        rows += [(1, k, int(i), int(j)) for i in range(x, min(50, x + w)) for j in range(y, min(50, y + h))]
    px = spark.createDataFrame(rows, "image_id int, poly_id int, x int, y int")
    sizes = spark.createDataFrame([(1, 50, 50)], "image_id int, width int, height int")
    got = {(r.poly_id, r.x, r.y): r.dist for r in labels.instance_distance(px, sizes).collect()}
    assert len(got) == len(rows)
    for k in range(60):
        mine = {(x, y) for _, p, x, y in rows if p == k}
        around = {(x + i, y + j) for x, y in mine for i in (-1, 0, 1) for j in (-1, 0, 1) if 0 <= x + i < 50 and 0 <= y + j < 50} - mine
        for x, y in list(mine)[:40]:
            far = [(max(abs(x - a), abs(y - b)), min(abs(x - a), abs(y - b))) for a, b in around]
            assert got[k, x, y] == pytest.approx(min(labels.AXIAL * (m - n) + labels.DIAGONAL * n for m, n in far))


def test_groups_go_on_across_batches():
    keys = np.sort(np.random.default_rng(1).integers(0, 30, 200))
    for size in (1, 3, 7, 200):
        parts = [pa.record_batch([pa.array(keys[i : i + size]), pa.array(np.arange(len(keys))[i : i + size])], ["k", "v"]) for i in range(0, 200, size)]
        found, rows = [], 0
        for table, starts in blocks.whole_groups(iter(parts), ["k"]):
            k = table.column("k").to_numpy()
            found += k[starts].tolist()
            rows += len(k)
            assert all(len(set(g)) == 1 for g in np.split(k, starts[1:]))
        assert rows == 200 and found == sorted(set(keys.tolist()))


def test_partitions_grow_with_the_rows(spark):
    assert spread(spark.range(3), "id", rows=9_500_000).rdd.getNumPartitions() == 10


def test_polygons_of_a_small_file_are_spread(spark, tmp_path):
    spark.range(40).selectExpr("id as p_partkey", "5 as p_size").write.parquet(f"{tmp_path}/part.parquet")
    assert fixtures.polygons(spark, str(tmp_path), "gt").rdd.getNumPartitions() == 4
    heat = labels.with_share(spark.createDataFrame([(1, 1, 2.0), (1, 1, 1.0)], "image_id int, poly_id int, dist double"), rows=2)
    assert sorted(r.share for r in heat.select(F.col("share")).collect()) == [0.5, 1.0]


def test_rings_of_one_square_need_no_pointer_rounds(spark, monkeypatch):
    """A comb that crosses many blocks, and rings of several images, are linked in squares of blocks."""
    monkeypatch.setattr(vectorize, "_join_far", lambda *_: pytest.fail("pointer rounds"))
    comb = spark.range(40 * 20).selectExpr("cast(id div 400 as int) as image_id", "cast(id % 40 as int) as x", "cast(id div 40 % 10 as int) as y")
    found = vectorize.rings(comb.filter("y = 0 or x % 2 = 0"), ["image_id"], block=4).collect()
    assert [(r.image_id, r.ring_id, r.signed, len(r.ring)) for r in sorted(found)] == [(i, 0, 40.0 + 20 * 9, 4 + 19 * 4 + 2) for i in (0, 1)]


def test_rings_beyond_a_square_start_at_their_smallest_segment(spark, monkeypatch):
    monkeypatch.setattr(vectorize, "SQUARE", 2)
    frame = spark.range(900).selectExpr("1 as image_id", "cast(id % 30 as int) as x", "cast(id div 30 as int) as y").filter("x in (0, 29) or y in (0, 29)")
    found = {r.signed: [(p.x, p.y) for p in r.ring] for r in vectorize.rings(frame, ["image_id"], block=4).collect()}
    assert found[900.0] == [(0, 0), (30, 0), (30, 30), (0, 30)] and found[-784.0][0] == (1, 1) and len(found) == 2


def test_rings_are_judged_once(spark):
    ring = "array<struct<x: double, y: double>>"
    polys = spark.createDataFrame([(1, 1, square(0, 0)), (1, 2, [(0.0, 0.0), (4.0, 4.0), (4.0, 0.0), (1.0, 5.0)]), (1, 3, None)], f"image_id int, poly_id int, ring {ring}")
    good, bad = polygons.validate_polygons(polys)
    assert not any("lambdafunction" in plan(side).lower() for side in (good, bad))
    assert [r.poly_id for r in good.collect()] == [1] and {r.poly_id: r.reason for r in bad.collect()} == {2: "self-crossing", 3: "no ring"}


def test_documents_of_many_images_are_written_by_many_tasks(spark, tmp_path):
    meta = spark.range(64).selectExpr("id as image_id", "3067 as epsg", *[f"1.0D as {c}" for c in "abcdef"])
    shapes = meta.selectExpr("image_id", "1 as poly_id", "array(struct(0.0D as x, 0.0D as y), struct(1.0D as x, 0.0D as y), struct(0.0D as x, 1.0D as y)) as ring")
    geojson.write_geojson(geojson.feature_collections(shapes, meta, empty=True), f"{tmp_path}/out")
    tasks = {f.name.split("-")[1] for f in (tmp_path / "out").glob("*/part-*")}
    assert len(tasks) >= 4


def test_images_of_a_store_are_written_by_many_tasks(spark, tmp_path):
    rows = spark.range(64).selectExpr("cast(id as string) as patch_key", "concat('i', id) as source_image", "array(1.0D) as image")
    patches.write_patches(rows, f"{tmp_path}/out")
    tasks = {f.name.split("-")[1] for f in (tmp_path / "out").glob("*/part-*")}
    assert len(tasks) >= 4 and patches.read_patches(spark, f"{tmp_path}/out").count() == 64


def test_blur_and_disks_shuffle_pixels_and_no_weighted_copies(spark):
    px = spark.range(300).selectExpr("cast(id % 2 as int) as image_id", "cast(id % 17 as int) as x", "cast(id div 17 as int) as y")
    sizes = spark.createDataFrame([(0, 18, 18), (1, 18, 18)], "image_id int, width int, height int")
    for out in (morphology.gaussian_blur(px, sizes, 1.5), morphology.erode(px, sizes, 1), morphology.dilate(px, sizes, 2)):
        assert "HashAggregate" not in plan(out) and "MapInArrow" in plan(out)


def test_blur_across_blocks(spark, monkeypatch):
    monkeypatch.setattr(morphology, "TILE", 5)
    px = spark.createDataFrame([(1, 4, 6), (1, 0, 0), (1, 11, 7)], "image_id int, x int, y int")
    found = np.zeros((8, 12))
    for r in morphology.gaussian_blur(px, spark.createDataFrame([(1, 12, 8)], "image_id int, width int, height int"), 1.0).collect():
        found[r.y, r.x] = r.value
    dense = np.zeros((8, 12))
    dense[6, 4] = dense[0, 0] = dense[7, 11] = 1
    kernel = np.exp(-0.5 * np.arange(-4.0, 5) ** 2)
    kernel /= kernel.sum()
    wide = np.pad(dense, 4, mode="symmetric")
    wide = sum(w * wide[:, i : i + 12] for i, w in enumerate(kernel))
    assert np.allclose(found, sum(w * wide[i : i + 8] for i, w in enumerate(kernel)))


def test_channels_reach_their_windows_without_a_row_a_pixel(spark, shapes):
    polys, sizes = shapes
    tiles = labels.label_tiles(polys, sizes)
    found = {}
    for t in tiles.collect():
        for i, values in enumerate(zip(*t.bands)):
            found[t.image_id, t.tile_x + i % t.width, t.tile_y + i // t.width] = values
    rows = {(r.image_id, r.x, r.y): (r.mask, r.centroid, r.hybrid) for r in labels.label_channels(polys, sizes).collect()}
    assert set(rows) <= set(found) and all(found[k] == rows.get(k, (0, 0, 0)) for k in found)
    whole = sizes.selectExpr("image_id", "width", "height", "array(array_repeat(7.0D, width * height)) as bands")
    names = ["mask", "centroid", "hybrid"]
    cut = blocks.cut_windows(whole, sizes, 8, 4, layers=tiles, values=names)
    assert "collect_list" not in plan(cut)
    old = blocks.cut_windows(whole, sizes, 8, 4, pixels=labels.label_channels(polys, sizes), values=names)
    assert sorted(cut.collect()) == sorted(old.collect())


def test_percentiles_of_tiles_take_counted_values(spark):
    tiles = spark.createDataFrame([(1, 2, 2, [[1.0, 1.0, 0.0, None], [2.0, float("nan"), 3.0, 3.0]]), (1, 2, 2, [[5.0, 1.0, 9.0, 9.0], [4.0, 4.0, -1.0, 4.0]]), (2, 2, 2, [[0.0] * 4, None])],
                                  "image_id int, width int, height int, bands array<array<double>>")
    counted = sources_tiles.count_values(tiles)
    assert counted.filter("band = 0 and value = 1").agg(F.sum("times")).first()[0] == 3
    new = sorted(raster.nonzero_percentiles(counted, ["image_id", "band"], (0.3, 0.9)).collect())
    assert new == sorted(raster.nonzero_percentiles(sources_tiles.explode_pixels(tiles), ["image_id", "band"], (0.3, 0.9)).collect())
