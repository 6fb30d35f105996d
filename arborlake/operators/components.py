"""Connected pixels of sparse masks.

A mask is a table of its foreground pixels, ``by, x, y``. Fixed blocks of pixels are labelled on their own
(a block is a bounded group, so a hot image is many groups); only components that touch a block border
enter the distributed graph.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from arborlake.operators.graph import components
from arborlake.session import cut_lineage, join_large, join_small

BLOCK = 256  # block side in pixels: at most 65,536 pixels per group
_SHIFT = 32  # a pixel code is y * 2^32 + x, so codes sort in raster order
# The neighbours after a pixel in raster order.
_AHEAD = {4: ((1, 0), (0, 1)), 8: ((1, 0), (-1, 1), (0, 1), (1, 1))}


def pixel_code(x: Column, y: Column) -> Column:
    return F.shiftleft(y.cast("bigint"), _SHIFT) + x.cast("bigint")


def _roots(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Smallest member of each component of a small graph."""
    parent = np.arange(n)
    while True:
        a, b = parent[u], parent[v]
        if np.array_equal(a, b):
            return parent
        np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = parent[parent]
            if np.array_equal(up, parent):
                break
            parent = up


def _joined(x: np.ndarray, y: np.ndarray, connectivity: int) -> np.ndarray:
    """For pixels in raster order, the place of the first pixel of each one's component."""
    x0, y0 = x.min(), y.min()
    at = np.full((y.max() - y0 + 2, x.max() - x0 + 3), -1)
    at[y - y0, x - x0 + 1] = np.arange(len(x))
    u, v = [], []
    for dx, dy in _AHEAD[connectivity]:
        other = at[y - y0 + dy, x - x0 + 1 + dx]
        hit = other >= 0
        u.append(np.flatnonzero(hit))
        v.append(other[hit])
    return _roots(len(x), np.concatenate(u), np.concatenate(v))


def window_marks(mask: Column, window: int) -> Column:
    """Of a window's row-major mask: ``num_trees``, its 4-connected components, and ``buffer_mask``, 0 on pixels of
    8-connected components that touch the border of the window and 1 elsewhere."""

    @F.pandas_udf("num_trees int, buffer_mask array<int>")
    def mark(masks: pd.Series) -> pd.DataFrame:
        counts, buffers = [], []
        for flat in masks:
            y, x = np.divmod(np.flatnonzero(flat), window)
            buffer = np.ones(window * window, np.int32)
            if len(x):
                root = _joined(x, y, 8)
                edge = (x == 0) | (y == 0) | (x == window - 1) | (y == window - 1)
                cut = np.isin(root, root[edge])
                buffer[y[cut] * window + x[cut]] = 0
            counts.append(len(np.unique(_joined(x, y, 4))) if len(x) else 0)
            buffers.append(buffer)
        return pd.DataFrame({"num_trees": counts, "buffer_mask": buffers})

    return mark(mask)


def _label_block(connectivity: int):
    def run(pixels: pd.DataFrame) -> pd.DataFrame:
        pixels = pixels.sort_values(["y", "x"], kind="stable").reset_index(drop=True)
        x, y = pixels["x"].to_numpy(), pixels["y"].to_numpy()
        root = _joined(x, y, connectivity)
        pixels["root"] = (y[root].astype("int64") << _SHIFT) + x[root]
        return pixels

    return run


def connected_components(pixels: DataFrame, by: Sequence[str], connectivity: int = 8, block: int = BLOCK) -> DataFrame:
    """Adds ``component``: the code of the first pixel of the component in raster order. Pixels are distinct."""
    by = list(by)
    rows = pixels.select(*by, "x", "y").withColumns({
        "bx": F.floor(F.col("x") / block).cast("int"), "by_": F.floor(F.col("y") / block).cast("int"),
    })
    schema = rows.drop("bx", "by_").schema.add("root", T.LongType())
    columns = [f.name for f in schema]
    label = _label_block(connectivity)
    local = rows.groupBy(*by, "bx", "by_").applyInPandas(lambda pdf: label(pdf)[columns], schema)
    # both later uses read the labelled pixels; writing them once keeps Python out of the second pass
    local = cut_lineage(local)
    ahead = F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx, dy in _AHEAD[connectivity]])

    def cell(axis: str) -> Column:
        return F.floor(F.col(axis) / block)

    border = local.filter((F.col("x") % block).isin(0, block - 1) | (F.col("y") % block == block - 1) | (F.col("y") % block == 0))
    steps = border.withColumn("s", F.explode(ahead)).withColumns({"nx": F.col("x") + F.col("s.dx"), "ny": F.col("y") + F.col("s.dy")})
    crossing = steps.filter((cell("nx") != cell("x")) | (cell("ny") != cell("y")))
    left = crossing.select(*by, F.col("nx").alias("x"), F.col("ny").alias("y"), F.col("root").alias("u"))
    links = join_large(left, border.select(*by, "x", "y", F.col("root").alias("v")), [*by, "x", "y"]).select(*by, "u", "v")
    merged = components(links, by).select(*by, F.col("node").alias("root"), "component")
    joined = join_large(local, merged, [*by, "root"], "left")
    return joined.select(*by, "x", "y", F.coalesce("component", "root").alias("component"))


def number_components(labelled: DataFrame, by: Sequence[str], out: str = "region_id", rows_per_bucket: int = 64) -> DataFrame:
    """Dense 1-based ids in raster order. Components are counted per band of image rows, so the ranking of one
    hot image is spread over its bands."""
    by = list(by)
    roots = labelled.select(*by, "component").distinct()
    roots = roots.withColumn("_band", F.floor(F.shiftright("component", _SHIFT) / rows_per_bucket))
    sizes = roots.groupBy(*by, "_band").agg(F.count("*").alias("_size"))
    earlier = Window.partitionBy(*by).orderBy("_band").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(*by, "_band", F.coalesce(F.sum("_size").over(earlier), F.lit(0)).alias("_start"))
    inside = Window.partitionBy(*by, "_band").orderBy("component")
    ids = roots.withColumn("_n", F.row_number().over(inside)).join(starts, [*by, "_band"])
    ids = ids.select(*by, "component", (F.col("_start") + F.col("_n")).cast("int").alias(out))
    return join_large(labelled, ids, [*by, "component"])


def with_least(rows: DataFrame, min_size: float | DataFrame) -> DataFrame:
    """Adds ``least``: one number for all images, or ``min_pixels`` of a table with one row an image."""
    if isinstance(min_size, DataFrame):
        return join_small(rows, min_size.select("image_id", F.col("min_pixels").alias("least")), "image_id")
    return rows.withColumn("least", F.lit(float(min_size)))


def remove_small(pixels: DataFrame, by: Sequence[str], min_size: float | DataFrame, connectivity: int = 4) -> DataFrame:
    """Drop components with fewer than ``min_size`` pixels; a table has ``image_id, min_pixels``."""
    labelled = connected_components(pixels, by, connectivity)
    sizes = with_least(labelled.groupBy(*by, "component").agg(F.count("*").alias("size")), min_size).filter("size >= least")
    return join_large(labelled, sizes.select(*by, "component"), [*by, "component"], "left_semi").select(*by, "x", "y")


def count_components(pixels: DataFrame, by: Sequence[str], connectivity: int = 4) -> DataFrame:
    labelled = connected_components(pixels, by, connectivity)
    return labelled.select(*by, "component").distinct().groupBy(*by).agg(F.count("*").alias("num_trees"))


def buffer_mask(pixels: DataFrame, sizes: DataFrame, by: Sequence[str]) -> DataFrame:
    """Pixels of 8-connected components that touch the border of their patch: the places where the buffer
    mask is 0. ``sizes`` has ``by, width, height``; every other pixel is 1."""
    by = list(by)
    labelled = connected_components(pixels, by, 8).join(sizes, by)
    edge = (F.col("x") == 0) | (F.col("y") == 0) | (F.col("x") == F.col("width") - 1) | (F.col("y") == F.col("height") - 1)
    touching = labelled.filter(edge).select(*by, "component").distinct()
    return join_large(labelled, touching, [*by, "component"], "left_semi").select(*by, "x", "y")


def component_iou(pixels: DataFrame, by: Sequence[str] = ("image_id",)) -> DataFrame:
    """Component score per key from boolean ``pred`` and ``truth``: predicted components that touch truth are
    hits, the others false; true components without a predicted pixel are missed. 1 when both are empty."""
    by = list(by)
    pixels = cut_lineage(pixels.select(*by, "x", "y", "pred", "truth"))

    def hits(side: str, other: str, name: str) -> DataFrame:
        labelled = connected_components(pixels.filter(side), by, 4)
        touched = join_large(labelled, pixels.select(*by, "x", "y", F.col(other).cast("int").alias("t")), [*by, "x", "y"])
        per = touched.groupBy(*by, "component").agg(F.max("t").alias("hit"))
        return per.groupBy(*by).agg(F.sum("hit").alias(f"{name}_hit"), F.count("*").alias(f"{name}_n"))

    rows = pixels.select(*by).distinct().join(hits("pred", "truth", "p"), by, "left").join(hits("truth", "pred", "t"), by, "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    tp, fp, fn = zero("p_hit"), zero("p_n") - zero("p_hit"), zero("t_n") - zero("t_hit")
    return rows.select(*by, F.when(tp + fp + fn == 0, F.lit(1.0)).otherwise(tp / (tp + fp + fn)).alias("tree_iou"))
