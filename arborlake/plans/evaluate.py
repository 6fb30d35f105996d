"""Whole evaluation job: predicted and true polygons to per-file scores and their summary."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arborlake.functions.coords import reproject
from arborlake.functions.scores import precision_recall_f1
from arborlake.operators import matching, metrics
from arborlake.operators.polygons import overlap_area, shape_column, validate_polygons
from arborlake.session import cut_lineage, join_small
from arborlake.sources import files as files_source
from arborlake.sources import geojson

# The six summarised scores.
SCORES = ("pixel_iou", "tree_iou", "precision", "recall", "f1", "centroid_error")


def align_crs(pred: DataFrame, truth: DataFrame, by: Sequence[str], systems: Sequence[int]) -> DataFrame:
    """Truth shapes in the system of their file's predictions; unsupported pairs, and files whose predictions
    name several systems, raise."""
    one = F.when(F.min("epsg") == F.max("epsg"), F.min("epsg")).when(F.max("epsg").isNotNull(), F.raise_error(F.lit("predictions of one file name several systems")))
    target = pred.groupBy(*by).agg(one.cast("int").alias("target"))
    rows = truth.join(target, list(by), "left").withColumn("target", F.coalesce("target", "epsg"))
    same = F.col("epsg") == F.col("target")

    def moved(ring):
        return F.transform(ring, lambda p: reproject(p["x"], p["y"], F.col("epsg"), F.col("target"), systems))

    shapes = {"ring": F.when(same, F.col("ring")).otherwise(moved(F.col("ring")))} if "ring" in rows.columns else {}
    if "geometry" in rows.columns:
        parts = F.transform("geometry", lambda part: F.transform(part, moved))
        shapes["geometry"] = F.when(same, F.col("geometry")).otherwise(parts)
    # two steps: a new epsg in the same step would be what the lambdas see
    return rows.withColumns(shapes).withColumn("epsg", F.col("target")).drop("target")


def evaluate_files(pred: DataFrame, truth: DataFrame, files: DataFrame, by: Sequence[str] = ("pred_set", "file"),
                   overlap: float = 0.4, limit: float = 50.0) -> DataFrame:
    """One row per file of ``files`` (``by, latitude, longitude``), all sets and files in one job.

    Rings that are no polygons are left out of the scores; their file gets ``status`` 'rejected rings' beside
    its scores over the good rings, a file without any polygon 'empty'.
    """
    by = list(by)
    pred, bad_pred = validate_polygons(pred)
    truth, bad_truth = validate_polygons(truth)
    # one number a file: names that begin alike would be moved and compared at every step
    numbered = cut_lineage(files.select(*by).distinct().withColumn("_file", F.monotonically_increasing_id()))
    key = ["_file"]
    pred, truth = (cut_lineage(join_small(side, numbered, by).select(*key, "poly_id", shape_column(side))) for side in (pred, truth))
    rejected = bad_pred.select(*by).unionByName(bad_truth.select(*by)).groupBy(*by).agg(F.count("*").alias("rejected"))
    pairs = cut_lineage(overlap_area(pred, truth, key))
    counts, copies = cut_lineage(matching.count_sides(pred, truth, key)), cut_lineage(matching.count_copies(pred, key))
    rows = files.join(numbered, by, "left")
    for part in (
        matching.object_pixel_iou(pred, truth, key, pairs, counts, copies),
        matching.tree_iou_greedy(pred, truth, key, overlap, pairs, counts, copies),
        matching.centroid_match(pred, truth, key, limit, counts),
        counts,
    ):
        rows = rows.join(part, key, "left")
    rows = rows.join(rejected, by, "left")
    counts = ("tp", "fp", "fn", "n_pred", "n_truth", "rejected")
    rows = rows.withColumns({c: F.coalesce(c, F.lit(0)) for c in counts})
    rows = rows.withColumns({c: F.coalesce(c, F.lit(0.0)) for c in ("pixel_iou", "tree_iou")})
    rows = rows.withColumn("centroid_error", F.coalesce("centroid_error", F.lit(float("nan"))))
    precision, recall, f1 = precision_recall_f1(F.col("tp"), F.col("fp"), F.col("fn"))
    status = F.when(F.col("rejected") > 0, "rejected rings").when(F.col("n_pred") + F.col("n_truth") == 0, "empty").otherwise("ok")
    rows = rows.withColumns({"precision": precision, "recall": recall, "f1": f1, "status": status})
    return rows.select(*by, "pixel_iou", "tree_iou", "tp", "fp", "fn", "precision", "recall", "f1", "centroid_error",
                       "latitude", "longitude", "n_pred", "n_truth", "status")


def evaluate_documents(triples: DataFrame, documents: DataFrame, systems: Sequence[int], overlap: float = 0.4, limit: float = 50.0) -> DataFrame:
    """Scores of every (prediction set, file) from GeoJSON texts.

    ``triples`` carries ``pred_set, stem, pred_path, truth_path`` and may carry ``latitude, longitude``;
    ``documents`` has ``path, value``. Truth is brought into the system of its predictions. A file whose prediction
    or truth is missing or no feature collection keeps its row: ``status`` says which, its scores are null.
    """
    by = ["pred_set", "file"]
    files = triples.withColumn("file", F.col("stem"))
    files = files.withColumns({c: F.col(c) if c in triples.columns else F.lit(None).cast("double") for c in ("latitude", "longitude")})

    def side(path: str) -> DataFrame:
        rows = files.select(*by, F.col(path).alias("path")).join(documents, "path", "left")
        return rows.select(*by, "value")

    pred_docs, truth_docs = side("pred_path"), side("truth_path")
    pred, truth = geojson.read_geojson_features(pred_docs, by), geojson.read_geojson_features(truth_docs, by)

    def unreadable(docs: DataFrame, name: str) -> DataFrame:
        return geojson.rejected_features(docs, by).filter("poly_id is null").select(*by, F.lit(f"unreadable {name}").alias("failed"))

    failed = unreadable(pred_docs, "prediction").unionByName(unreadable(truth_docs, "truth")).groupBy(*by).agg(F.min("failed").alias("failed"))
    shapes = ("poly_id", "epsg", "geometry")
    truth = align_crs(pred.select(*by, *shapes), truth.select(*by, *shapes), by, systems)
    scored = evaluate_files(pred.select(*by, *shapes), truth, files.select(*by, "latitude", "longitude"), by, overlap, limit)
    rows = scored.join(failed, by, "left")
    values = {c: F.when(F.col("failed").isNull(), F.col(c)) for c in (*SCORES, "tp", "fp", "fn", "n_pred", "n_truth")}
    return rows.withColumns({**values, "status": F.coalesce("failed", "status")}).drop("failed")


def evaluate_folder(spark: SparkSession, root: str, systems: Sequence[int], pred_root: str | None = None, overlap: float = 0.4, limit: float = 50.0) -> DataFrame:
    """:func:`evaluate_documents` for all images, truths and predictions found below the roots."""
    listed = files_source.list_files(spark, root)
    apart = None if pred_root is None else files_source.list_files(spark, pred_root)
    triples = files_source.find_triples(listed, apart)
    documents = geojson.read_documents(spark, root)
    if pred_root is not None:
        documents = documents.unionByName(geojson.read_documents(spark, pred_root))
    return evaluate_documents(triples, documents, systems, overlap, limit)


def evaluate_summary(rows: DataFrame, by: Sequence[str] = ("pred_set",), confidence: float = 0.95, include_empty: bool = False) -> DataFrame:
    """Description and confidence interval of the six scores with total tp, fp, fn, per prediction set."""
    rows = rows.filter("not startswith(status, 'unreadable')")
    rows = cut_lineage(rows if include_empty else rows.filter("status <> 'empty'"))
    keys = [*by, "metric"]
    table = metrics.describe(rows, SCORES, by).join(metrics.confidence_interval(rows, SCORES, confidence, by), keys)
    return table.join(metrics.totals(rows, by), list(by))
