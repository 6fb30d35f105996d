"""Whole dataset job: tiles and label polygons to labelled patches."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from arborlake.functions import bands as B
from arborlake.operators import labels, raster, tiling
from arborlake.operators.blocks import cut_windows
from arborlake.operators.components import window_marks
from arborlake.session import cut_lineage, join_small
from arborlake.sources.tiles import band_values, count_values, masked_values


@dataclass(frozen=True)
class PatchParams:
    band_order: tuple[int, ...] = (3, 0, 1, 2)
    window: int = 256
    stride: int = 256
    normalise: str | None = None  # None clips to 0..255, 'channel' and 'image' stretch
    sigma: float = 2.0
    boundary: int = 2
    systems: tuple[int, ...] = (3067,)


def normalised_tiles(tiles: DataFrame, params: PatchParams) -> DataFrame:
    """Tiles whose ``bands`` are uint8 values in the wanted band order.

    Tiles may carry ``nodata``, the value that stands for missing pixels of their image.
    """
    return _uint8_tiles(tiles, params).withColumn("bands", F.col("bands").cast("array<array<double>>"))


def _uint8_tiles(tiles: DataFrame, params: PatchParams) -> DataFrame:
    """:func:`normalised_tiles` in two bytes a value. Missing pixels, clipping and stretching go over all values of a
    batch of tiles at once."""
    ordered = B.reorder_bands(B.check_bands(F.col("bands"), params.band_order), params.band_order)
    rows = tiles.withColumn("bands", ordered.cast("array<array<double>>"))
    if "nodata" in tiles.columns:
        rows = rows.withColumn("nodata", F.col("nodata").cast("double"))
    limited = params.normalise is not None
    if limited:
        # counted once: quantiles read the counts several times
        counts = cut_lineage(count_values(rows, masked=True))
        limits = raster.nonzero_percentiles(counts, ["image_id", "band"] if params.normalise == "channel" else ["image_id"])
        if params.normalise == "image":
            limits = limits.withColumn("band", F.explode(F.sequence(F.lit(0), F.lit(len(params.band_order) - 1))))
        # one small row per image instead of a join on every pixel
        per_image = limits.groupBy("image_id").agg(F.map_from_entries(F.collect_list(F.struct("band", F.struct("p_low", "p_high")))).alias("limits"))
        rows = join_small(rows, cut_lineage(per_image), "image_id", "left")
        of = lambda name: F.array(*(F.coalesce(F.col("limits")[i][name], F.lit(0.0)) for i in range(len(params.band_order))))
        rows = rows.withColumns({"_low": of("p_low"), "_high": of("p_high")}).drop("limits")
    kept = [c for c in rows.columns if c not in ("_low", "_high")]
    schema = T.StructType([T.StructField("bands", T.ArrayType(T.ArrayType(T.ShortType()))) if c == "bands" else rows.schema[c] for c in kept])

    def scale(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bands, values, tile, _, sizes = band_values(batch)
            flat = masked_values(batch, values, np.repeat(tile, sizes))
            even = np.zeros(len(flat), bool)
            if limited:
                low, high = (np.repeat(batch.column(c).flatten().to_numpy(zero_copy_only=False), sizes) for c in ("_low", "_high"))
                even = high == low
                with np.errstate(all="ignore"):
                    flat = (flat - low) / np.where(even, 1.0, high - low) * 255
            # a missing value counts as 0, one that is not a number as the largest
            out = np.where(np.isnan(flat), np.where(values.is_valid().to_numpy(zero_copy_only=False), 255.0, 0.0), np.clip(flat, 0.0, 255.0))
            if limited:
                out = np.where(even, np.where(low == 0, 0.0, 255.0), out)
            inner = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)), pa.int32(), mask=np.append(bands.is_null().to_numpy(zero_copy_only=False), False)), pa.array(out.astype(np.int16)))
            many = pc.list_value_length(batch.column("bands")).to_numpy(zero_copy_only=False).astype(np.int64)
            nested = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(many)), pa.int32()), inner)
            yield pa.record_batch([nested if c == "bands" else batch.column(c) for c in kept], kept)

    return rows.mapInArrow(scale, schema)


def ring_to_pixels(polys: DataFrame, meta: DataFrame) -> DataFrame:
    """Map rings to truncated pixel rings by bounds and resolution."""
    from arborlake.functions.coords import geo_to_pixel
    from arborlake.sources.tiles import with_bounds

    place = with_bounds(meta).select("image_id", "min_x", "min_y", "res_x", "res_y", "height")
    rows = join_small(polys, place, "image_id")

    def to_pixel(p):
        col, row = geo_to_pixel(p["x"], p["y"], F.col("min_x"), F.col("min_y"), F.col("res_x"), F.col("res_y"), F.col("height"))
        return F.struct(col.cast("double").alias("x"), row.cast("double").alias("y"))

    return rows.withColumn("ring", F.transform("ring", to_pixel)).select("image_id", "poly_id", "ring")


def build_patch_table(tiles: DataFrame, meta: DataFrame, polys: DataFrame, params: PatchParams) -> tuple[DataFrame, DataFrame]:
    """(patches, rejects).

    ``patches``: key, image, tree count, centre, position, ``bands`` (C arrays), ``mask, centroid, hybrid,
    buffer_mask`` arrays. ``rejects``: images without tiles for their labels, and rings of less than three points.
    ``polys`` has rings in map coordinates; ``meta`` may state the ``nodata`` value of an image whose tiles do not.
    """
    window, stride = params.window, params.stride
    # truncation makes points repeat and edges touch; every ring with three points is filled all the same
    rings = ring_to_pixels(polys, meta)
    shapes = rings.filter(F.size("ring") >= 3)
    bad_rings = rings.filter("ring is null or size(ring) < 3").withColumn("reason", F.lit("fewer than 3 points"))
    channels = labels.label_tiles(cut_lineage(shapes), meta, params.sigma, params.boundary)
    if "nodata" in meta.columns:
        stated = join_small(tiles, meta.select("image_id", F.col("nodata").alias("_stated")), "image_id", "left")
        own = F.col("nodata") if "nodata" in tiles.columns else F.lit(None).cast("double")
        tiles = stated.withColumn("nodata", F.coalesce(own, F.col("_stated").cast("double"))).drop("_stated")
    patches = cut_windows(_uint8_tiles(tiles, params), meta, window, stride, layers=channels, values=("mask", "centroid", "hybrid"))
    marked = patches.withColumn("mask", F.col("mask").cast("array<int>")).withColumn("_marks", window_marks(F.col("mask"), window))
    table = tiling.placed(marked.select("*", "_marks.*").drop("_marks"), meta, window, list(params.systems))
    table = table.withColumn("source_image", F.col("image_id").cast("string"))
    missing = polys.select("image_id").distinct().join(tiles.select("image_id").distinct(), "image_id", "left_anti")
    rejects = bad_rings.select("image_id", "poly_id", "reason").unionByName(
        missing.select("image_id", F.lit(None).cast("bigint").alias("poly_id"), F.lit("no tiles").alias("reason")))
    return table, rejects
