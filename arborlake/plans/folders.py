"""Whole jobs over folders: tiles and documents in, documents, patch stores and evaluation files out.

An image is a row of the metadata table: ``image_id, path, width, height, a..f, epsg``. Its pixels are rows of the
tile table; the path only names it.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

import numpy as np
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arborlake.operators import metrics, scoring
from arborlake.plans.create_patches import PatchParams, build_patch_table
from arborlake.plans.evaluate import evaluate_folder, evaluate_summary
from arborlake.plans.predict import predict_images
from arborlake.session import cut_lineage, join_small
from arborlake.sources import evaluation_csv, files, geojson
from arborlake.sources.patches import write_patches
from arborlake.sources.tiles import read_raster_tiles

Build = Callable[[], Callable[[np.ndarray], np.ndarray]]


def predicted_images(spark: SparkSession, out_path: str) -> DataFrame:
    """``image``: stems of the images whose documents lie under ``out_path``; only the listing is read."""
    try:
        listed = geojson.list_written(spark, out_path, "image")
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.range(0).select(F.col("id").cast("string").alias("image"))
    return listed.select("image").distinct()


def predict_folder(spark: SparkSession, tile_path: str, meta_path: str, out_path: str, build: Build, **options) -> DataFrame:
    """Predicts all images that have no document yet and writes one GeoJSON document each.

    Documents are named by the stem of the image's path, so two images of one stem raise. An image in which nothing
    is found gets a document without features and is done like any other. Returns the images of this run as
    ``image_id, image``; ``options`` are those of :func:`predict_images`.
    """
    named = spark.read.parquet(meta_path).withColumn("image", files.stem(F.col("path")))
    todo = cut_lineage(named.join(predicted_images(spark, out_path), "image", "left_anti"))
    twice = todo.groupBy("image").count().filter("count > 1").limit(3).collect()
    if twice:
        raise ValueError(f"several images are named {[r.image for r in twice]}")
    tiles = join_small(read_raster_tiles(spark, tile_path), todo.select("image_id"), "image_id")
    found = cut_lineage(predict_images(tiles, todo, build, **options))
    shapes = join_small(found, todo.select("image_id", "image"), "image_id").drop("image_id")
    lines = geojson.feature_collections(shapes, todo, key="image", empty=True)
    geojson.write_geojson(lines, f"{out_path}/run={uuid.uuid4().hex}", key="image")
    return todo.select("image_id", "image")


def create_dataset(spark: SparkSession, tile_path: str, meta_path: str, label_root: str, store_path: str,
                   params: PatchParams | None = None, limit: int | None = None) -> DataFrame:
    """Images with a label document to a patch store; what was left out comes back as ``image_id, poly_id, reason``.

    Left out are images without a label document or without tiles, broken documents and features, and rings of
    less than three points. ``limit`` takes the first images by path.
    """
    meta = spark.read.parquet(meta_path)
    documents = geojson.read_documents(spark, label_root)
    pairs, unpaired = files.pair_labels(meta.select("path").unionByName(documents.select("path")))
    pairs = cut_lineage(pairs if limit is None else files.limit_samples(pairs, limit, "image_path"))
    chosen = cut_lineage(meta.join(pairs, meta.path == pairs.image_path).drop("path", "image_path"))
    labelled = documents.join(chosen.select(F.col("label_path").alias("path"), "image_id"), "path")
    rings = geojson.read_geojson_labels(labelled, ["image_id"])
    polys = rings.withColumn("poly_id", F.shiftleft(F.col("ordinal").cast("long"), 20) + F.col("part")).select("image_id", "poly_id", "ring")
    tiles = join_small(read_raster_tiles(spark, tile_path), chosen.select("image_id"), "image_id")
    table, rejects = build_patch_table(tiles, chosen, cut_lineage(polys), params or PatchParams())
    write_patches(table, store_path)
    alone = meta.join(unpaired, meta.path == unpaired.image_path).select("image_id", F.lit(None).cast("long").alias("poly_id"), F.lit("no labels").alias("reason"))
    broken = geojson.rejected_features(labelled, ["image_id"]).select("image_id", F.col("poly_id").cast("long").alias("poly_id"), "reason")
    return cut_lineage(rejects.unionByName(alone).unionByName(broken))


def evaluate_to_csv(spark: SparkSession, root: str, out_path: str, systems: Sequence[int], **options) -> DataFrame:
    """Evaluates all prediction folders below ``root`` into ``files`` (the 14 columns as CSV, a folder per set) and
    ``summary`` (Parquet); returns the summary. ``options`` are those of :func:`evaluate_folder`."""
    rows = cut_lineage(evaluate_folder(spark, root, systems, **options))
    evaluation_csv.write_eval_csv(rows, f"{out_path}/files", ["pred_set"])
    evaluate_summary(rows).write.mode("errorifexists").parquet(f"{out_path}/summary")
    return spark.read.parquet(f"{out_path}/summary")


def evaluate_patches(patches: DataFrame, build: Build, window: int, crop: int | None = None, batch: int = 8, limit: float = 0.5) -> DataFrame:
    """Mean pixel scores of a model over labelled patches: per patch, then over full batches in shuffled order.

    ``patches``: ``patch_key, bands, mask, buffer_mask``; pixels outside the buffer do not count.
    """
    scored = scoring.score_patches(patches, build, window, crop or window, batch, keep=("patch_key", "mask", "buffer_mask"))
    zipped = F.arrays_zip("scores", "mask", "buffer_mask")
    pixels = scored.select("patch_key", F.explode(zipped).alias("p")).select("patch_key", "p.*")
    counts = metrics.confusion(pixels, F.col("scores") >= limit, F.col("mask") == 1, ["patch_key"], F.col("buffer_mask") == 1)
    values = ["iou", "f1", "masked_iou", "masked_f1", "dice"]
    return metrics.batch_mean(metrics.image_scores(counts).select("patch_key", *values), "patch_key", values, batch)
