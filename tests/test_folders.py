import json

import pytest
from pyspark.sql import functions as F

from arborlake.plans import folders
from arborlake.plans.create_patches import PatchParams
from arborlake.sources import geojson, patches
from arborlake.sources.tiles import TILE_SCHEMA

META = "image_id long, path string, width int, height int, a double, b double, c double, d double, e double, f double, epsg int"


def square(x, y, side):
    return [[x, y], [x + side, y], [x + side, y - side], [x, y - side], [x, y]]


def document(*rings):
    features = [{"type": "Feature", "properties": {}, "geometry": {"type": "Polygon", "coordinates": [r]}} for r in rings]
    return json.dumps({"type": "FeatureCollection", "crs": {"type": "name", "properties": {"name": "EPSG:3067"}}, "features": features})


def place(image, path):
    return (image, path, 16, 16, 1.0, 0.0, 300000.0, 0.0, -1.0, 6700016.0, 3067)


@pytest.fixture
def folder(spark, tmp_path):
    root = tmp_path / "data"
    (root / "Geojsons").mkdir(parents=True)
    names = {1: "one", 2: "two", 3: "broken", 4: "alone"}
    (root / "Geojsons/one.geojson").write_text(document(square(300002.5, 6700013.5, 4), square(300009.5, 6700013.5, 3)))
    (root / "Geojsons/two.geojson").write_text(document([[300002, 6700013], [300003, 6700013]], square(300004.5, 6700010.5, 5)))
    (root / "Geojsons/broken.geojson").write_text("{ not json")
    meta = [place(i, f"file:{root}/Images/{n}.tif") for i, n in names.items()]
    spark.createDataFrame(meta, META).write.parquet(f"{tmp_path}/meta")
    tiles = [(i, 16, 16, [[float(20 * b + i)] * 256 for b in range(4)], 0, 0, "uint8", None) for i in names]
    spark.createDataFrame(tiles, TILE_SCHEMA).write.parquet(f"{tmp_path}/tiles")
    return tmp_path


def test_dataset_from_files(spark, folder):
    rejects = folders.create_dataset(spark, f"{folder}/tiles", f"{folder}/meta", f"{folder}/data/Geojsons", f"{folder}/store", PatchParams(window=8, stride=8))
    stored = {r.patch_key: r for r in patches.read_patches(spark, f"{folder}/store").collect()}
    assert {k.split("_")[0] for k in stored} >= {"1", "2"} and len([k for k in stored if k.startswith("1_")]) == 4
    assert stored["1_0"].num_trees == 1 and sum(stored["1_0"].mask) == 25 and [b[0] for b in stored["1_0"].bands] == [61.0, 1.0, 21.0, 41.0]
    told = {(r.image_id, r.reason) for r in rejects.collect()}
    assert (4, "no labels") in told and any(i == 3 for i, _ in told)
    with pytest.raises(Exception, match="ALREADY_EXISTS|already exists"):
        folders.create_dataset(spark, f"{folder}/tiles", f"{folder}/meta", f"{folder}/data/Geojsons", f"{folder}/store", PatchParams(window=8, stride=8), limit=1)


def test_prediction_skips_what_is_done(spark, folder):
    build = lambda: lambda batch: (batch.mean(axis=1, keepdims=True) * 255 - 31.5) * 4  # noqa: E731  images 2 to 4 are bright
    run = lambda: folders.predict_folder(spark, f"{folder}/tiles", f"{folder}/meta", f"{folder}/out", build, window=8, stride=4, crop=8)
    assert {r.image for r in run().collect()} == {"one", "two", "broken", "alone"}
    texts = {r.image: json.loads(r.value) for r in spark.read.text(f"{folder}/out", wholetext=True).collect()}
    assert {k: len(v["features"]) for k, v in texts.items()} == {"one": 0, "two": 1, "broken": 1, "alone": 1}
    assert run().count() == 0
    more = [place(5, "file:/x/Images/five.tif")]
    spark.createDataFrame(more, META).write.mode("append").parquet(f"{folder}/meta")
    assert [r.image for r in run().collect()] == ["five"]
    spark.createDataFrame([place(6, "/a/six.tif"), place(7, "/b/six.tif")], META).write.mode("append").parquet(f"{folder}/meta")
    with pytest.raises(ValueError, match="six"):
        run()


def test_evaluation_writes_files_and_summary(spark, tmp_path):
    for name in ("Images", "Geojsons", "Predictions_a"):
        (tmp_path / "root" / name).mkdir(parents=True)
    (tmp_path / "root/Images/t.tif").write_text("pixels")
    (tmp_path / "root/Geojsons/t.geojson").write_text(document(square(300000, 6700010, 4), square(300010, 6700010, 4)))
    (tmp_path / "root/Predictions_a/t.geojson").write_text(document(square(300000, 6700010, 4)))
    summary = folders.evaluate_to_csv(spark, str(tmp_path / "root"), str(tmp_path / "out"), [3067])
    assert {r.metric: r["count"] for r in summary.collect()}["pixel_iou"] == 1
    rows = spark.read.option("header", True).csv(f"{tmp_path}/out/files").collect()
    assert len(rows) == 1 and len(rows[0]) == 15 and float(rows[0]["Pixel IoU"]) == pytest.approx(0.5)
    assert rows[0]["True Positives"] == "1" and rows[0]["False Negatives"] == "1"


def test_patches_are_scored_by_batches(spark):
    rows = [(f"p{i}", [[1.0 if j < i else -1.0 for j in range(4)]], [1, 1, 0, 0], [1] * 4) for i in range(4)]
    table = spark.createDataFrame(rows, "patch_key string, bands array<array<double>>, mask array<int>, buffer_mask array<int>")
    got = folders.evaluate_patches(table, lambda: lambda batch: batch * 9, 2, batch=4).first()
    assert got.batches == 1 and got.dice == pytest.approx((0 + 2 / 3 + 1 + 4 / 5) / 4)
    assert folders.evaluate_patches(table.filter(F.lit(False)), lambda: lambda batch: batch, 2).first().batches == 0


NAMES = ["007", "7", "1e3", "2020-01-01", "a b+c%d", "\u00e4=\u00f6", "x:y"]


def test_written_documents_go_by_the_names_of_their_folders(spark, tmp_path):
    lines = spark.createDataFrame([(n, i, v) for n in NAMES for i, v in ((1, "]}"), (0, f"[{n}"))], "image string, line_no long, value string")
    for part in (0, 1):
        geojson.write_geojson(lines.filter((F.length("image") % 2) == part), f"{tmp_path}/out/run={part}", key="image")
    got = {r.image: r.value for r in geojson.list_written(spark, f"{tmp_path}/out", "image").collect()}
    assert got == {n: f"[{n}\n]}}\n" for n in NAMES}
    listed = folders.predicted_images(spark, f"{tmp_path}/out")
    assert sorted(r.image for r in listed.collect()) == sorted(NAMES)  # none is read as a number or a date
    assert "PartitionFilters: []" in listed._jdf.queryExecution().toString()
    assert not list(tmp_path.glob("out/run=*/image=*/.*.crc"))  # one file a document
