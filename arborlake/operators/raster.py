"""Raster operators that need more than one pixel: percentiles, stretches, resampling, cropping.

Pixel tables carry ``image_id, band, x, y, value`` unless a ``by`` argument says otherwise.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arborlake.operators.ranking import exact_quantiles
from arborlake.session import cut_lineage, join_small


def check_bands(tiles: DataFrame, order: Sequence[int]) -> DataFrame:
    from arborlake.functions.bands import check_bands as checked

    return tiles.withColumn("bands", checked(F.col("bands"), order))


def nonzero_percentiles(pixels: DataFrame, by: Sequence[str] = ("image_id", "band"), probs: Sequence[float] = (0.01, 0.99)) -> DataFrame:
    """Percentiles of the values above zero: ``by, p_low, p_high``; groups without such values are left out.

    Missing and not-a-number values are no values. Rows with a column ``times`` stand for so many pixels.
    """
    weight = "times" if "times" in pixels.columns else None
    rows = exact_quantiles(pixels.filter("value > 0 and not isnan(value)"), by, "value", probs, weight=weight)
    return rows.select(*by, F.get("quantiles", F.lit(0)).alias("p_low"), F.get("quantiles", F.lit(len(probs) - 1)).alias("p_high"))


def stretch_uint8(pixels: DataFrame, by: str = "channel") -> DataFrame:
    """Percentile stretch to 0..255, per channel or per image.

    A flat group gives 0, or 255 when its percentile is above 0. A value that is not a number gives 0.
    """
    keys = {"channel": ["image_id", "band"], "image": ["image_id"]}[by]
    limits = cut_lineage(nonzero_percentiles(pixels, keys))
    rows = join_small(pixels, limits, keys, "left")
    low, high = F.coalesce("p_low", F.lit(0.0)), F.coalesce("p_high", F.lit(0.0))
    scaled = (F.col("value") - low) / (high - low) * 255
    flat = F.when(low == 0, F.lit(0)).otherwise(F.lit(255))
    out = F.when(high != low, F.least(F.greatest(scaled, F.lit(0.0)), F.lit(255.0)).cast("int")).otherwise(flat)
    return rows.withColumn("value", F.when(F.isnan(F.col("value").cast("double")), 0).otherwise(out)).select(pixels.columns)


def max_normalise(pixels: DataFrame) -> DataFrame:
    """value / largest value of the image * 255, truncated. The maximum is a map-side aggregate, not a window."""
    top = cut_lineage(pixels.groupBy("image_id").agg(F.max("value").alias("top")))
    rows = join_small(pixels, top, "image_id")
    return rows.withColumn("value", (F.col("value") / F.col("top") * 255).cast("int")).drop("top")


def resize(pixels: DataFrame, sizes: DataFrame, width: int, height: int, mode: str, by: Sequence[str] = ("image_id", "band")) -> DataFrame:
    """Resample to ``width`` x ``height``. ``sizes`` has ``image_id, width, height`` of the sources.

    Source pixels are sent to the target pixels they take part in, so the whole job is one aggregation by
    target pixel; nearest needs no aggregation at all. Pixel centres are half-way, corners are not aligned.
    """
    rows = join_small(pixels, sizes, "image_id")
    by = list(by)
    if mode == "nearest":
        # target t reads source floor(t * w / W): the targets of x are ceil(x W / w) .. ceil((x + 1) W / w) - 1
        def targets(axis: str, source: str, size: int) -> Column:
            first = F.ceil(F.col(axis) * size / F.col(source))
            last = F.ceil((F.col(axis) + 1) * size / F.col(source)) - 1
            return F.when(last >= first, F.sequence(first, last))

        rows = rows.withColumn("tx", F.explode(targets("x", "width", width))).withColumn("ty", F.explode(targets("y", "height", height)))
        return rows.select(*by, F.col("tx").cast("int").alias("x"), F.col("ty").cast("int").alias("y"), "value")
    if mode != "bilinear":
        raise ValueError(f"resize mode is 'nearest' or 'bilinear', not {mode!r}")

    def weighted(axis: str, source: str, size: int) -> Column:
        """Targets whose clamped sample position lies within one pixel of this source, with the weight."""
        ratio = F.col(source) / F.lit(float(size))
        low = F.when(F.col(axis) == 0, F.lit(0)).otherwise(
            F.greatest(F.floor((F.col(axis) - 0.5) / ratio - 0.5), F.lit(0)).cast("int"))
        high = F.when(F.col(axis) == F.col(source) - 1, F.lit(size - 1)).otherwise(
            F.least(F.ceil((F.col(axis) + 1.5) / ratio - 0.5), F.lit(size - 1)).cast("int"))

        def weight(t: Column) -> Column:
            at = F.least(F.greatest((t + 0.5) * ratio - 0.5, F.lit(0.0)), (F.col(source) - 1).cast("double"))
            return F.struct(t.alias("t"), F.greatest(F.lit(0.0), 1 - F.abs(at - F.col(axis))).alias("w"))

        return F.filter(F.transform(F.sequence(low, high), weight), lambda s: s["w"] > 0)

    rows = rows.withColumn("sx", F.explode(weighted("x", "width", width))).withColumn("sy", F.explode(weighted("y", "height", height)))
    rows = rows.select(*by, F.col("sx.t").alias("x"), F.col("sy.t").alias("y"), (F.col("value") * F.col("sx.w") * F.col("sy.w")).alias("part"))
    return rows.groupBy(*by, "x", "y").agg(F.sum("part").alias("value"))


def crop_or_pad_pixels(pixels: DataFrame, sizes: DataFrame, size: int) -> DataFrame:
    """Centred crop or shift of a sparse pixel table; padding stays implicit (missing pixels are zero)."""
    rows = join_small(pixels, sizes, "image_id")

    def shift(side: str) -> Column:
        return F.floor(F.greatest(F.lit(size) - F.col(side), F.lit(0)) / 2) - F.floor(F.greatest(F.col(side) - size, F.lit(0)) / 2)

    moved = rows.withColumn("x", (F.col("x") + shift("width")).cast("int")).withColumn("y", (F.col("y") + shift("height")).cast("int"))
    return moved.filter((F.col("x") >= 0) & (F.col("x") < size) & (F.col("y") >= 0) & (F.col("y") < size)).select(pixels.columns)
