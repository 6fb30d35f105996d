import json

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

import __spark_entry__ as driver
from arborlake.functions import bands as B
from arborlake.functions import scores as S
from arborlake.operators import labels, ranking, raster, scoring, splits, tiling
from arborlake.operators.polygons import overlap_area
from arborlake.plans import create_patches, predict
from arborlake.sources import evaluation_csv, files, geojson, patches
from arborlake.sources import tiles as tiles_source

SF = "/root/testdata/sf0.001"


def doc(*features):
    return json.dumps({"type": "FeatureCollection", "features": [{"type": "Feature", "properties": {}, "geometry": g} for g in features]})


def test_label_reader_takes_both_types_and_strict_only_multipolygons(spark):
    ring = [[0, 0], [4, 0], [4, 4], [0, 0]]
    text = doc({"type": "Polygon", "coordinates": [ring, [[1, 1], [2, 1], [2, 2]]]}, None,
               {"type": "MultiPolygon", "coordinates": [[ring], [[[5, 5], [6, 6]]], [ring]]})
    docs = spark.createDataFrame([("f", text)], "path string, value string")
    both = geojson.read_geojson_labels(docs)
    assert [(r.ordinal, r.part, len(r.ring)) for r in both.orderBy("ordinal", "part").collect()] == [(0, 0, 4), (2, 0, 4), (2, 2, 4)]
    assert geojson.read_geojson_labels(docs, strict_multipolygon=True).count() == 2


def test_feature_collection_without_epsg_has_null_crs(spark):
    rows = spark.createDataFrame([(1, 7, [(0.0, 0.0), (1.0, 0.0), (1.0, 1.0)])], "image_id int, poly_id long, ring array<struct<x: double, y: double>>")
    meta = spark.createDataFrame([(1, None, 1.0, 0.0, 0.0, 0.0, -1.0, 0.0)], "image_id int, epsg int, a double, b double, c double, d double, e double, f double")
    lines = geojson.feature_collections(rows, meta).orderBy("line_no").collect()
    out = json.loads("\n".join(r["value"] for r in lines))
    assert out["crs"] is None and out["metadata"]["transform"] == [1.0, 0.0, 0.0, 0.0, -1.0, 0.0]
    assert out["features"][0]["geometry"]["coordinates"] == [[[0, 0], [1, 0], [1, 1], [0, 0]]]


def test_every_round_crown_is_painted(spark):
    """Crowns of a few pixels: truncated outlines repeat points and touch, and are filled all the same."""
    rng = np.random.default_rng(0)
    rows = []
    for i in range(200):
        x, y, r = 300000 + 20 * (i % 20) + rng.random(), 6700000 - 20 * (i // 20) - 10 + rng.random(), rng.uniform(0.4, 2.5)
        turn = np.linspace(0, 2 * np.pi, 24, endpoint=False)
        rows.append((1, i, [(float(x + 6 + r * np.cos(t)), float(y - 3 + r * np.sin(t))) for t in turn]))
    polys = spark.createDataFrame(rows, "image_id int, poly_id long, ring array<struct<x: double, y: double>>")
    meta = spark.createDataFrame([(1, 1700, 1000, 0.25, 0.0, 300000.0, 0.0, -0.25, 6700000.0)],
                                 "image_id int, width int, height int, a double, b double, c double, d double, e double, f double")
    rings = create_patches.ring_to_pixels(polys, meta).filter(F.size("ring") >= 3)
    assert labels.rasterize(rings, meta).select("poly_id").distinct().count() == 200


def test_parts_holes_and_rejects(spark):
    ring = lambda x, s: [[x, 0], [x + s, 0], [x + s, s], [x, s], [x, 0]]
    text = doc({"type": "MultiPolygon", "coordinates": [[ring(0, 4), ring(1, 2)], [ring(10, 1)], [[[0, 0], [1, 1]]]]}, None,
               {"type": "Polygon", "coordinates": [ring(0, 4)]})
    docs = spark.createDataFrame([("f", text), ("g", text[:50]), ("h", None)], "path string, value string")
    shapes = geojson.read_geojson_features(docs).orderBy("poly_id").collect()
    assert [(r.poly_id, [len(p) for p in r.geometry]) for r in shapes] == [(0, [2, 1]), (2, [1])]
    bad = {(r.path, r.poly_id, r.reason) for r in geojson.rejected_features(docs).collect()}
    assert bad == {("f", 1, "no usable ring"), ("g", None, "no feature collection"), ("h", None, "no feature collection")}
    pred = geojson.read_geojson_features(docs).filter("poly_id = 0")
    truth = geojson.read_geojson_features(docs).filter("poly_id = 2")
    pair = overlap_area(pred, truth, ["path"]).first()
    assert (pair.left_area, pair.right_area, pair.inter) == (pytest.approx(13), pytest.approx(16), pytest.approx(12))


def test_tiles_keep_their_place(spark, tmp_path):
    rows = [(1, 2, 1, [[1.0, 2.0]], 0, 0), (1, 2, 1, [[3.0, 4.0]], 2, 5)]
    spark.createDataFrame(rows, T.StructType(tiles_source.TILE_SCHEMA.fields[:6])).write.parquet(f"{tmp_path}/t")
    got = tiles_source.explode_pixels(tiles_source.read_raster_tiles(spark, f"{tmp_path}/t")).collect()
    assert {(r.x, r.y, r.value) for r in got} == {(0, 0, 1.0), (1, 0, 2.0), (2, 5, 3.0), (3, 5, 4.0)}


def test_values_that_are_no_numbers_stay_out(spark):
    px = spark.createDataFrame([(1, 0, x, 0, v) for x, v in enumerate([1.0, 2.0, 3.0, float("nan"), 0.0])], "image_id int, band int, x int, y int, value double")
    limits = raster.nonzero_percentiles(px).first()
    assert limits.p_high < 3.01
    assert {r.x: r.value for r in raster.stretch_uint8(px).collect()}[3] == 0


def test_stated_nodata_and_dtype_reach_the_jobs(spark):
    tiles = spark.createDataFrame([(1, 2, 1, [[7.0, 9.0], [255.0, 51.0]], 7.0, "uint8")], "image_id int, width int, height int, bands array<array<double>>, nodata double, dtype string")
    params = create_patches.PatchParams(band_order=(1, 0))
    got = {r.x: list(r.bands) for r in predict.pixel_vectors(create_patches.normalised_tiles(tiles, params)).collect()}
    assert got == {0: [255.0, 0.0], 1: [51.0, 9.0]}
    assert [list(b) for b in predict.model_tiles(tiles, (1, 0)).first().bands] == [[1.0, 0.2], [7 / 255, 9 / 255]]


def test_done_and_triples_go_by_root(spark):
    paths = ["/a/r1/Images/T1.tif", "/a/r2/Images/T1.tif", "/a/r1/Geojsons/T1.geojson", "/a/r2/Geojsons/T1.geojson", "/a/r1/Predictions/T1.geojson"]
    rows = spark.createDataFrame([(p,) for p in paths], "path string")
    done = files.skip_done(files.image_catalog(rows), rows.filter("path like '%Predictions%'"))
    assert [r.path for r in done.collect()] == ["/a/r2/Images/T1.tif"]
    assert [r.root for r in files.find_triples(rows).collect()] == ["/a/r1"]
    apart = spark.createDataFrame([("/out/r2/Predictions_b/T1.geojson",)], "path string")
    assert [r.image_path for r in files.find_triples(rows, apart).collect()] == ["/a/r2/Images/T1.tif"]


def test_bad_inputs_raise(spark):
    tiles = spark.createDataFrame([(1, [[1.0], [2.0]])], "image_id int, bands array<array<double>>")
    with pytest.raises(Exception, match="band order needs 4"):
        raster.check_bands(tiles, [3, 0]).collect()
    with pytest.raises(Exception, match="unsupported raster type complex64"):
        spark.range(1).select(B.scale_by_dtype(F.lit(1.0), F.lit("complex64"))).collect()
    for call in (lambda: B.activate(F.lit(0.0), "relu"), lambda: S.loss_by_name("other", *[F.lit(0.0)] * 3),
                 lambda: tiling.with_grid(tiles, 0, 4), lambda: scoring.stitch(tiles, tiles, 4, 1.5)):
        with pytest.raises(ValueError):
            call()


def test_map_bands_passes_values_only(spark):
    tile = spark.createDataFrame([(1, [[0.0, 1.0, 2.0]])], "image_id int, bands array<array<double>>")
    out = tile.select(B.map_bands(F.col("bands"), B.mask_nodata)).first()[0]
    assert out == [[0.0, 1.0, 2.0]]


def test_flat_band_stretch(spark):
    px = spark.createDataFrame([(1, 0, 0, 0, 0.0), (1, 0, 1, 0, 0.0), (1, 1, 0, 0, 7.0), (1, 1, 1, 0, 7.0)],
                               "image_id int, band int, x int, y int, value double")
    out = {(r.band, r.x): r.value for r in raster.stretch_uint8(px).collect()}
    assert out == {(0, 0): 0, (0, 1): 0, (1, 0): 255, (1, 1): 255}


@pytest.mark.parametrize("values", [np.arange(101.0), np.r_[np.zeros(500), 1e6, np.random.default_rng(1).random(300)]])
def test_exact_quantiles_match_linear_interpolation(spark, values):
    df = spark.createDataFrame([("k", float(v)) for v in values], "k string, v double").repartition(3)
    got = ranking.exact_quantiles(df, ["k"], "v", (0.01, 0.25, 0.5, 0.99)).first()["quantiles"]
    assert got == pytest.approx(list(np.percentile(values, [1, 25, 50, 99])))


def test_an_outlier_leaves_the_buckets_even(spark):
    """Rows of one bucket meet in one window: none has over a five hundredth of a group."""
    rows = spark.range(60_000).selectExpr("id % 2 as k", "case when id < 2 then 1e12 when id < 4 then -1e9 else rand(7) end as v")
    got = ranking.with_buckets(rows, ["k"], "v", 1000).groupBy("k", "_b").count().groupBy("k").agg(F.max("count").alias("most"), F.count("*").alias("n")).collect()
    assert len(got) == 2 and all(r.most <= 30_000 / 500 and r.n >= 500 for r in got)
    exact = ranking.exact_quantiles(rows.filter("k = 0"), ["k"], "v", (0.0, 0.5, 1.0)).first()["quantiles"]
    assert exact[0] == -1e9 and exact[2] == 1e12 and 0.45 < exact[1] < 0.55


def test_stitched_mean_can_only_pass_one_before_the_clamp(spark):
    meta = spark.createDataFrame([(1, 2, 1)], "image_id int, width int, height int")
    # two windows of side 2 over pixel 1: one score reaches the limit, both are summed
    rows = [(1, 0, 0, [0.1, 0.9, 0.0, 0.0]), (1, 1, 0, [0.4, 0.0, 0.0, 0.0])]
    scored = spark.createDataFrame(rows, "image_id int, pixel_x int, pixel_y int, scores array<double>")
    value = lambda mode: {r.x: r.value for r in scoring.stitch(scored, meta, 2, 0.5, mode).collect()}
    assert value("sum") == {0: 0.0, 1: 1.0}
    assert value("mean") == {0: pytest.approx(0.1), 1: pytest.approx(0.65)}


def test_windows_cover_as_stated(spark):
    meta = spark.createDataFrame([(1, 10, 7), (2, 3, 3)], "image_id int, width int, height int")
    plain = {(r.image_id, r.pixel_x, r.pixel_y) for r in tiling.window_grid(meta, 4, 3).collect()}
    assert plain == {(1, x, y) for x in (0, 3, 6) for y in (0, 3)}
    padded = tiling.window_grid(meta, 4, 4, "multiple").groupBy("image_id").count().collect()
    assert {r.image_id: r["count"] for r in padded} == {1: 6, 2: 1}


@pytest.mark.parametrize("trees,want", [
    # targets 70, 20, 10: each met exactly, the empty last cluster is left over
    ([70, 20, 10, 0], ["train", "val", "test", "leftover"]),
    # 60 and 20 go to train, then 10, 5 and 5 fill val up to its 20
    ([60, 20, 10, 5, 5], ["train", "train", "val", "val", "val"]),
])
def test_clusters_fill_splits_in_order_of_weight(spark, trees, want):
    rows = [(f"p{i}", "a", n, 60.0 + 5 * i, 20.0) for i, n in enumerate(trees)]
    df = spark.createDataFrame(rows, "patch_key string, source_image string, num_trees int, latitude double, longitude double")
    out = splits.split_by_cluster(splits.cluster_patches(splits.region_bins(df)), weight="trees")
    assert [r.split for r in out.orderBy("patch_key").collect()] == want


def test_samples_do_not_depend_on_partitions(spark):
    df = spark.range(500).selectExpr("concat('k', id) as patch_key", "cast(id % 5 as int) as num_trees")
    one = {r.patch_key for r in splits.balanced_sample(df.coalesce(1)).collect()}
    many = {r.patch_key for r in splits.balanced_sample(df.repartition(7)).collect()}
    assert one == many and len(one) == 200


def test_paths_with_any_key(spark):
    df = spark.createDataFrame([(f"/r/T{i}.geojson",) for i in range(60)], "truth_path string")
    keys = ["T1", "T22.", "T5"]
    few = {r.truth_path for r in files.filter_by_keys(df, keys).collect()}
    assert few == {f"/r/T{i}.geojson" for i in range(60) if any(k in f"/r/T{i}.geojson" for k in keys)}
    assert files.filter_by_keys(df, []).count() == 0
    assert files.filter_by_keys(df, ["", "x"]).count() == 60


def test_patch_store_refuses_to_overwrite_and_catalog_prunes(spark, tmp_path):
    rows = spark.createDataFrame([("a_0", "a", 1, 60.0, 20.0, 0, 0, [1.0])],
                                 "patch_key string, source_image string, num_trees int, latitude double, longitude double, pixel_x int, pixel_y int, image array<double>")
    path = str(tmp_path / "store")
    patches.write_patches(rows, path)
    with pytest.raises(Exception, match="ALREADY_EXISTS|already exists"):
        patches.write_patches(rows, path)
    plan = patches.patch_catalog(spark, path)._jdf.queryExecution().executedPlan().toString()
    assert "image:array" not in plan


def test_a_hot_image_is_written_by_as_many_tasks_as_it_has_shares(spark, tmp_path):
    rows = spark.range(3000).selectExpr("concat('k', id) as patch_key", "if(id < 2900, 'hot', concat('i', id % 10)) as source_image", "1 as num_trees",
                                        "60.0 as latitude", "20.0 as longitude", "0 as pixel_x", "0 as pixel_y")
    path = tmp_path / "store"
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    try:
        patches.write_patches(rows, str(path), rows_per_file=200)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", before)
    tasks = {f.name.split("-")[1] for f in (path / "source_image=hot").glob("part-*")}
    assert len(tasks) >= 8 and all(len(list((path / f"source_image=i{i}").glob("part-*"))) == 1 for i in range(10))
    assert patches.read_patches(spark, str(path)).count() == 3000


def test_eval_csv_keeps_nan_and_null(spark, tmp_path):
    values = {c: (1 if kind == "bigint" else "x" if kind == "string" else 0.5) for _, c, kind in evaluation_csv.COLUMNS}
    values |= {"centroid_error": float("nan"), "latitude": None}
    schema = ", ".join(f"{c} {kind}" for _, c, kind in evaluation_csv.COLUMNS)
    path = str(tmp_path / "e")
    evaluation_csv.write_eval_csv(spark.createDataFrame([tuple(values[c] for _, c, _ in evaluation_csv.COLUMNS)], schema), path)
    back = evaluation_csv.read_eval_csv(spark, path).first()
    assert np.isnan(back.centroid_error) and back.latitude is None and back.tp == 1


def test_literal_loss_sample(spark):
    rows = [(0.8, 1.0), (0.2, 0.0), (0.4, 0.0), (0.9, 1.0)]
    df = spark.createDataFrame(rows, "z double, t double")
    out = df.agg(S.hybrid_loss(F.col("z"), F.col("t")).alias("h"), S.dice_loss(F.col("z"), F.col("t")).alias("d")).first()
    z, t = np.array(rows).T
    p = 1 / (1 + np.exp(-z))
    bce = -(t * np.log(p) + (1 - t) * np.log(1 - p))
    focal = np.mean(0.25 * (1 - np.exp(-bce)) ** 2 * bce)
    dice = 1 - (2 * (p * t).sum()) / (p.sum() + t.sum())
    assert out.h == pytest.approx(0.5 * dice + 0.5 * focal + bce.mean(), abs=1e-7) and 0 < out.d < 1


@pytest.mark.parametrize("name", ["object_pixel_iou", "pixel_summary", "stretch_imagewise", "stitch", "prepare_splits"])
def test_against_oracle(spark, name):
    con = duckdb.connect()
    for t in ("lineitem", "part", "customer", "orders", "embeddings"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    cursor = con.execute(driver.oracle_sql()[name])
    heads = [d[0] for d in cursor.description]
    want = sorted(map(str, cursor.fetchall()))
    got = sorted(str(tuple(r)) for r in driver.queries()[name](spark, SF).select(heads).collect())
    assert got == want and got


def test_entry_has_rows(spark):
    assert driver.entry(spark).count() > 0
