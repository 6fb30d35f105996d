"""Patch store: Parquet partitioned by source image."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arborlake.session import cut_lineage, few_listers, join_small, spread

# Attribute columns of a patch.
ATTRIBUTES = ("patch_key", "source_image", "num_trees", "latitude", "longitude", "pixel_x", "pixel_y")


def write_patches(patches: DataFrame, path: str, codec: str = "gzip", rows_per_file: int = 2000) -> None:
    """Write patch rows; an existing store is an error.

    An image's patches are counted and dealt into as many shares as they fill files, so a small image is one file
    and a hot one is written by many tasks. Only keys are read for the counts.
    """
    shares = cut_lineage(
        patches.groupBy("source_image").agg(F.ceil(F.count("*") / rows_per_file).cast("long").alias("_shares"))
    )
    dealt = join_small(patches, shares, "source_image").withColumn("_share", F.pmod(F.xxhash64("patch_key"), F.col("_shares")))
    # a fixed number of tasks: many small files are few bytes but much work
    together = spread(dealt, "source_image", "_share").sortWithinPartitions("source_image", "patch_key").drop("_share", "_shares")
    (
        together.write.mode("errorifexists").partitionBy("source_image")
        .option("compression", codec).option("maxRecordsPerFile", rows_per_file).parquet(path)
    )


def read_patches(spark: SparkSession, path: str) -> DataFrame:
    """Whole patches: arrays and attributes."""
    return _listed(spark, path)


def _listed(spark: SparkSession, path: str) -> DataFrame:
    with few_listers(spark):
        return spark.read.parquet(path)


def patch_catalog(spark: SparkSession, path: str) -> DataFrame:
    """Attributes only: the scan never touches the arrays."""
    return _listed(spark, path).select(*ATTRIBUTES)


def catalog_by_image(catalog: DataFrame) -> DataFrame:
    """Patches and trees per image, combined map-side. The patches of an image stay rows of the catalogue."""
    return catalog.groupBy("source_image").agg(
        F.count("*").alias("patches"), F.sum("num_trees").alias("trees"), F.min("patch_key").alias("first_key")
    )
