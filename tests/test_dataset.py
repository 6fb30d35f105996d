"""The dataset job: labels and tiles of many images without a row a pixel, by the same rules as the pixel tables."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from arborlake.functions import bands as B
from arborlake.operators import labels
from arborlake.plans.create_patches import PatchParams, normalised_tiles
from arborlake.session import spread
from catalog import load_all

load_all()

RING = "image_id int, poly_id int, ring array<struct<x: double, y: double>>"


def rings(spark):
    rng = np.random.default_rng(11)
    rows = []
    for k in range(60):
        cx, cy, n = rng.uniform(-8, 300), rng.uniform(-8, 80), int(rng.integers(3, 9))
        points = [(float(v[0]), float(v[1])) for v in np.stack([cx + rng.uniform(-14, 14, n), cy + rng.uniform(-14, 14, n)], 1)]
        rows.append((int(k % 2), k, points if k % 3 == 0 else [(float(int(x)), float(int(y))) for x, y in points]))
    rows += [(1, 3, rows[3][2]), (1, 3, [(280.0, 70.0), (290.0, 70.0), (290.0, 78.0)])]  # a key that comes again
    rows += [(0, None, [(250.0, 10.0), (262.0, 10.0), (262.0, 22.0), (250.0, 22.0)]), (0, 100, None), (0, 101, []), (7, 102, rows[0][2])]
    rows += [(0, 103, [(20.0, 20.0), (None, 22.0), (22.0, 30.0)]), (0, 104, [(40.0, 20.0), (None, 20.0), (None, 30.0), (40.0, 30.0)]), (0, 105, [(60.0, 20.0), None, (66.0, 30.0), (60.0, 30.0)])]
    rows += [(1, 106, [(5.0, 5.0)] * 4), (1, 107, [(12.0, 60.0), (9.0, 60.0), (30.0, 60.0)]), (2, 108, [(-1.0, -1.0), (4.0, -1.0), (4.0, 4.0), (-1.0, 4.0)])]
    return spark.createDataFrame(rows, RING), spark.createDataFrame([(0, 300, 80), (1, 300, 80), (2, 3, 3), (3, 9, 9)], "image_id int, width int, height int")


def channels(polys, sizes, width=2):
    return {(r.image_id, r.x, r.y): (r.mask, r.hybrid, r.centroid) for r in labels.label_channels(polys, sizes, width=width).collect()}


def test_labels_of_instances_as_wholes_equal_those_by_pixel(spark, monkeypatch):
    polys, sizes = rings(spark)
    width = 3
    distances = labels.instance_distance(labels.rasterize(polys, sizes), sizes)
    want = {(r.image_id, r.x, r.y): r.hybrid for r in labels.hybrid_label(distances, width).collect()}
    heat = {(r.image_id, r.x, r.y): r.heat for r in labels.centroid_heat(polys, sizes).collect()}
    with monkeypatch.context() as m:
        m.setattr(labels, "rasterize", None)  # no instance of these becomes a row a pixel
        got = channels(polys, sizes, width)
    assert got.keys() == want.keys() | heat.keys() and len(want) > 3000
    for k, (mask, hybrid, centroid) in got.items():
        assert mask == (k in want) and hybrid == pytest.approx(want.get(k, 0.0)) and centroid == pytest.approx(heat.get(k, 0.0), abs=1e-12)
    monkeypatch.setattr(labels, "AREA", 150)  # large ones go by pixel, and meet the others in their blocks
    by_pixel = channels(polys, sizes, width)
    assert by_pixel.keys() == got.keys()
    assert all(by_pixel[k] == pytest.approx(got[k]) for k in got)


ODD = [1.0, 0.0, 7.6, 255.0, 260.5, -3.0, -3.3e38, -math.inf, math.inf, math.nan, None, 9.0]


@pytest.mark.parametrize(("normalise", "stated"), [(None, True), ("channel", True), ("image", False)])
def test_tiles_are_normalised_as_by_column_expressions(spark, normalise, stated):
    rng = np.random.default_rng(2)
    plain = [[float(v) for v in rng.integers(1, 90, 12)] for _ in range(2)]
    rows = [(1, [ODD, plain[0]], 9.0), (1, [plain[0], None], None), (2, [ODD, plain[1]], math.nan), (3, [[5.0] * 12, [0.0] * 12], 7.0), (4, [[None] * 12, []], None)]
    tiles = spark.createDataFrame([(i, 4, 3, b, n) for i, b, n in rows], "image_id int, width int, height int, bands array<array<double>>, nodata double")
    tiles = tiles if stated else tiles.drop("nodata")
    params = PatchParams(band_order=(1, 0), normalise=normalise)
    missing = F.col("nodata") if stated else None
    masked = tiles.withColumn("bands", B.map_bands(B.reorder_bands(F.col("bands"), (1, 0)), lambda v: B.mask_nodata(v, missing)))
    limits = {}
    if normalise:  # an endless value would make an endless percentile
        tiles, masked = (t.withColumn("bands", B.map_bands(F.col("bands"), lambda v: F.when(v == math.inf, F.lit(80.0)).otherwise(v))) for t in (tiles, masked))
        cells = masked.select("image_id", F.posexplode("bands").alias("band", "values")).select("image_id", "band", F.explode("values").alias("v"))
        for image, band, v in cells.filter("v > 0 and not isnan(v)").collect():
            limits.setdefault((image, band if normalise == "channel" else None), []).append(v)
        limits = {k: np.percentile(v, (1, 99)) for k, v in limits.items()}

    def value(image, band, v):
        low, high = limits.get((image, band if normalise == "channel" else None), (0.0, 0.0))
        if normalise and low == high:
            return 0.0 if low == 0 else 255.0
        if v is None or math.isnan(v):
            return 0.0 if v is None else 255.0
        return float(int(min(max((v - low) / (high - low) * 255 if normalise else v, 0.0), 255.0)))

    want = sorted(str((r.image_id, [b and [value(r.image_id, i, v) for v in b] for i, b in enumerate(r.bands)])) for r in masked.collect())
    out = normalised_tiles(tiles, params)
    assert dict(out.dtypes)["bands"] == "array<array<double>>" and out.columns == tiles.columns
    assert "MapInArrow" in out._jdf.queryExecution().toString()
    assert sorted(str((r.image_id, r.bands)) for r in out.collect()) == want


def test_dense_tiles_of_one_small_file_are_many_tasks(spark, tmp_path):
    from catalog.jobs import _dense_tiles

    part = spark.range(300).selectExpr("id as p_partkey", "cast(id % 50 as int) as p_size")
    part.coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    rng = np.random.default_rng(4)
    vectors = {i: [float(v) for v in rng.normal(size=64)] for i in range(3)}
    spark.createDataFrame(list(vectors.items()), "vec_id long, embedding array<float>").coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    rows = _dense_tiles(spark, str(tmp_path))
    assert spread(rows.limit(0), "image_id").rdd.getNumPartitions() == rows.rdd.getNumPartitions()
    got = {(r.image_id, r.tile_x, r.tile_y): r for r in rows.collect()}
    assert len(got) == 12
    for (image, left, top), r in got.items():
        levels = [math.fmod(1000 + round(800 * float(np.float32(v))), 251) for v in vectors[image]]
        want = [[float(levels[((top + i // 72) * 144 + left + i % 72) * 7 + b * 31 & 63]) for i in range(72 * 72)] for b in range(4)]
        assert r.bands == want
