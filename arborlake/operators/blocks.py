"""Images in square blocks: windows cut from tiles and overlapping windows summed up, without a row per pixel.

A block is the part of an image that some whole windows start in, with the rim that the last of them reach over.
Tiles are sliced inside their row into the pieces that each block needs, and pieces are what is shuffled. Blocks are
so large that their rims add at most half of the image. A block is a bounded group, so a hot image is many groups.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from arborlake.operators.tiling import with_grid
from arborlake.session import join_small

SIDE = 512  # least side of a block in pixels
GROWTH = 1.5  # pixels of blocks with rims to pixels of the image, at most
BATCH_BYTES = 16 << 20  # values handed on at a time
KEY = ["image_id", "block_y", "block_x"]


@dataclass(frozen=True)
class Blocks:
    """Blocks for windows of a side that start every ``stride`` pixels."""

    window: int
    stride: int

    @property
    def steps(self) -> int:
        """Windows that start along a block's side."""
        rim = max(0, self.window - self.stride)
        return max(1, math.ceil(rim / (self.stride * (math.sqrt(GROWTH) - 1))), math.ceil(SIDE / self.stride))

    @property
    def side(self) -> int:
        return self.steps * self.stride

    @property
    def reach(self) -> int:
        """Side with the rim."""
        return self.side + max(0, self.window - self.stride)


def _at(df: DataFrame, name: str) -> Column:
    return F.col(name) if name in df.columns else F.lit(0)


def _span(start: Column, size: Column, side: int, reach: int, blocks: Column) -> Column:
    """The blocks along one axis that hold some of a run of pixels."""
    first = F.greatest(F.ceil((start - reach + 1) / side), F.lit(0)).cast("int")
    last = F.least(F.floor((start + size - 1) / side), blocks - 1).cast("int")
    return F.explode(F.when(first <= last, F.sequence(first, last)))


def pieces(tiles: DataFrame, meta: DataFrame, side: int, reach: int) -> DataFrame:
    """Parts of tiles by block: ``image_id, block_y, block_x, y0, x0, rows, cols, bands``. Nothing is shuffled.

    ``tiles``: ``image_id, width, height, bands``, and ``tile_x, tile_y`` if they do not lie at 0. ``meta``: one row an
    image with ``blocks_x, blocks_y`` and what else the blocks need to know.
    """
    rows = tiles.select("image_id", F.col("width").alias("tw"), F.col("height").alias("th"), _at(tiles, "tile_x").alias("left"), _at(tiles, "tile_y").alias("top"), "bands")
    rows = join_small(rows, meta, "image_id")
    rows = rows.withColumn("block_x", _span(F.col("left"), F.col("tw"), side, reach, F.col("blocks_x")))
    rows = rows.withColumn("block_y", _span(F.col("top"), F.col("th"), side, reach, F.col("blocks_y")))
    rows = rows.withColumns({
        "x0": F.greatest("left", F.col("block_x") * side), "y0": F.greatest("top", F.col("block_y") * side),
        "x1": F.least(F.col("left") + F.col("tw"), F.col("block_x") * side + reach),
        "y1": F.least(F.col("top") + F.col("th"), F.col("block_y") * side + reach),
    })
    lines = F.sequence(F.col("y0") - F.col("top"), F.col("y1") - F.col("top") - 1)
    first, cols = F.col("x0") - F.col("left") + 1, F.col("x1") - F.col("x0")
    cut = F.transform("bands", lambda b: F.flatten(F.transform(lines, lambda y: F.slice(b, y * F.col("tw") + first, cols))))
    whole = (cols == F.col("tw")) & (F.col("y1") - F.col("y0") == F.col("th"))
    return rows.select(
        *KEY, "y0", "x0", (F.col("y1") - F.col("y0")).alias("rows"), cols.alias("cols"), F.when(whole, F.col("bands")).otherwise(cut).alias("bands"),
        *(c for c in meta.columns if c not in ("image_id", "blocks_x", "blocks_y")),
    )


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, list[dict]]]:
    """Consecutive rows of one block, across batches: numbers as such, lists as they are."""
    key, rows = None, []
    for batch in batches:
        names = batch.schema.names
        columns = [c if pa.types.is_list(c.type) else c.to_pylist() for c in batch.columns]
        for values in zip(*columns):
            row = dict(zip(names, values))
            new = tuple(row[k] for k in KEY)
            if new != key and rows:
                yield key, rows
                rows = []
            key = new
            rows.append(row)
    if rows:
        yield key, rows


def runs_by(batches: Iterator[pa.RecordBatch], keys: Sequence[str]) -> Iterator[pa.Table]:
    """Rows of one key after the other from sorted batches, as tables; a key may go on from one batch to the next."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        new = np.zeros(batch.num_rows, bool)
        for key in keys:
            column = batch.column(batch.schema.get_field_index(key))
            new[1:] |= pc.not_equal(column[1:], column[:-1]).to_numpy(zero_copy_only=False)
        starts = [0, *np.flatnonzero(new).tolist(), batch.num_rows]
        first = tuple(batch.column(batch.schema.get_field_index(k))[0].as_py() for k in keys)
        if held and first != last:
            yield pa.Table.from_batches(held)
            held = []
        for lo, hi in zip(starts, starts[1:]):
            if lo and held:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(lo, hi - lo))
        last = tuple(batch.column(batch.schema.get_field_index(k))[batch.num_rows - 1].as_py() for k in keys)
    if held:
        yield pa.Table.from_batches(held)


def whole_groups(batches: Iterator[pa.RecordBatch], keys: Sequence[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Sorted batches as tables of whole groups, each with the places where its groups start.

    The last group of a batch waits for the next one, so a table holds a batch and a group at most.
    """
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(batch.schema.get_field_index(k)) for k in keys]
        starts = np.append(0, np.flatnonzero(_changes(columns)) + 1)
        ends = tuple(c[batch.num_rows - 1].as_py() for c in columns)
        new = bool(held) and tuple(c[0].as_py() for c in columns) != last
        if new or len(starts) > 1:
            # all before the last group of this batch is whole
            table = pa.Table.from_batches([*held, batch.slice(0, starts[-1])], batch.schema)
            if table.num_rows:
                columns = [table.column(k).combine_chunks() for k in keys]
                yield table, np.append(0, np.flatnonzero(_changes(columns)) + 1)
            held = []
        held.append(batch.slice(starts[-1]))
        last = ends
    if held:
        yield pa.Table.from_batches(held), np.zeros(1, np.int64)


def _changes(columns: Sequence[pa.Array]) -> np.ndarray:
    """For every row but the first, whether some column differs from the row before; missing values are equal."""
    new = np.zeros(max(0, len(columns[0]) - 1), bool)
    for c in columns:
        differs = pc.fill_null(pc.not_equal(c[1:], c[:-1]), False).to_numpy(zero_copy_only=False)
        empty = c.is_null().to_numpy(zero_copy_only=False)
        new |= differs | (empty[1:] != empty[:-1])
    return new


def _values(lists: pa.Scalar) -> np.ndarray:
    """All numbers of a list of lists; missing ones are NaN."""
    return lists.values.flatten().to_numpy(zero_copy_only=False).astype(float)


def _nested(values: np.ndarray) -> pa.Array:
    """Rows of an array of two or three axes as lists, or lists of lists."""
    out = pa.array(values.ravel(), pa.float64(), from_pandas=False)
    for size in reversed(values.shape[1:]):
        out = pa.ListArray.from_arrays(pa.array(np.arange(0, len(out) + 1, max(1, size)), pa.int32()), out)
    return out


def _together(rows: DataFrame) -> DataFrame:
    return rows.repartition(*KEY).sortWithinPartitions(*KEY, "y0", "x0")


def cut_windows(tiles: DataFrame, meta: DataFrame, window: int, stride: int, pad_mode: str = "none",
                pixels: DataFrame | None = None, values: Sequence[str] = (), layers: DataFrame | None = None) -> DataFrame:
    """All windows of all images: ``image_id, idx, pixel_x, pixel_y, bands`` and one array a value column.

    ``bands`` holds one row-major array a band; pixels in no tile, padding too, are 0. ``pixels`` may bring more
    values of single pixels, ``image_id, x, y`` and ``values``; those without a row are 0. ``layers`` brings them as tiles,
    with a band for each of ``values``, and no row is made for a pixel. An image has windows
    where it has tiles. See :func:`arborlake.operators.tiling.window_grid` for the padding.
    """
    blocks, values = Blocks(window, stride), list(values)
    grid = with_grid(meta, window, stride, pad_mode).filter("grid_cols > 0 and grid_rows > 0").select(
        "image_id", "grid_cols", "grid_rows", F.ceil(F.col("grid_cols") / blocks.steps).cast("int").alias("blocks_x"),
        F.ceil(F.col("grid_rows") / blocks.steps).cast("int").alias("blocks_y"),
    )
    rows = pieces(tiles, grid, blocks.side, blocks.reach)
    if pixels is not None:
        marks = join_small(pixels.select("image_id", "x", "y", *values), grid, "image_id")
        one = F.lit(1)
        marks = marks.withColumn("block_x", _span(F.col("x"), one, blocks.side, blocks.reach, F.col("blocks_x")))
        marks = marks.withColumn("block_y", _span(F.col("y"), one, blocks.side, blocks.reach, F.col("blocks_y")))
        # at most one entry a pixel of the block
        entry = F.struct("y", "x", *(F.col(v).cast("double").alias(v) for v in values))
        marks = marks.groupBy(*KEY, "grid_cols", "grid_rows").agg(F.collect_list(entry).alias("marks"))
        rows = rows.unionByName(marks, allowMissingColumns=True)

    if layers is not None:
        rows = rows.unionByName(pieces(layers, grid, blocks.side, blocks.reach).withColumnRenamed("bands", "layers"), allowMissingColumns=True)
    marked, layered = pixels is not None, layers is not None

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (image, block_y, block_x), parts in _runs(batches):
            tiles_ = [p for p in parts if p["bands"].is_valid]
            if not tiles_:
                continue
            at_y, at_x = block_y * blocks.side, block_x * blocks.side
            down = min(blocks.steps, parts[0]["grid_rows"] - block_y * blocks.steps)
            across = min(blocks.steps, parts[0]["grid_cols"] - block_x * blocks.steps)
            bands = len(tiles_[0]["bands"].values)
            area = np.zeros((bands + len(values), (down - 1) * stride + window, (across - 1) * stride + window))
            for part in tiles_:
                y, x = part["y0"] - at_y, part["x0"] - at_x
                whole = _values(part["bands"]).reshape(bands, part["rows"], part["cols"])
                part_ = whole[:, : max(0, area.shape[1] - y), : max(0, area.shape[2] - x)]
                area[:bands, y : y + part_.shape[1], x : x + part_.shape[2]] = part_
            for part in parts if layered else ():
                if part["layers"].is_valid:
                    y, x = part["y0"] - at_y, part["x0"] - at_x
                    whole = _values(part["layers"]).reshape(len(values), part["rows"], part["cols"])
                    part_ = whole[:, : max(0, area.shape[1] - y), : max(0, area.shape[2] - x)]
                    area[bands:, y : y + part_.shape[1], x : x + part_.shape[2]] = part_
            for part in parts if marked else ():
                if part["marks"].is_valid:
                    fields = [f.to_numpy(zero_copy_only=False) for f in part["marks"].values.flatten()]
                    y, x = fields[0].astype(int) - at_y, fields[1].astype(int) - at_x
                    inside = (y < area.shape[1]) & (x < area.shape[2])
                    for band, value in enumerate(fields[2:], bands):
                        area[band, y[inside], x[inside]] = value[inside]
            starts = [(y, x) for y in range(down) for x in range(across)]
            many = max(1, BATCH_BYTES // (8 * area.shape[0] * window * window))
            for lo in range(0, len(starts), many):
                some = starts[lo : lo + many]
                cuts = np.stack([area[:, y * stride : y * stride + window, x * stride : x * stride + window] for y, x in some])
                cuts = cuts.reshape(len(some), area.shape[0], window * window)
                row, col = (np.array(some) + [block_y * blocks.steps, block_x * blocks.steps]).T
                columns = [pa.array([image] * len(some), kind), *(
                    pa.array(c.astype(np.int32)) for c in (row * parts[0]["grid_cols"] + col, col * stride, row * stride))]
                yield pa.record_batch([*columns, _nested(cuts[:, :bands]), *(_nested(cuts[:, bands + i]) for i in range(len(values)))], names)

    from pyspark.sql.pandas.types import to_arrow_type

    kind = to_arrow_type(rows.schema["image_id"].dataType)
    numbers = T.ArrayType(T.DoubleType())
    schema = T.StructType([T.StructField("image_id", rows.schema["image_id"].dataType)]
                          + [T.StructField(c, T.IntegerType()) for c in ("idx", "pixel_x", "pixel_y")]
                          + [T.StructField("bands", T.ArrayType(numbers))] + [T.StructField(v, numbers) for v in values])
    names = schema.names
    return _together(rows).mapInArrow(cut, schema)


def sum_windows(scored: DataFrame, meta: DataFrame, window: int, limit: float) -> DataFrame:
    """Per pixel in some window ``image_id, x, y, total, n, reached``: sum of the scores, windows, windows that reach the limit.

    ``scored``: ``image_id, pixel_x, pixel_y, scores``. Windows are sliced by blocks of the image, and sums go in the
    order of the windows, so they do not depend on partitions. Pixels outside the image are left out.
    """
    size = meta.select(
        "image_id", F.col("width").alias("image_w"), F.col("height").alias("image_h"),
        F.ceil(F.col("width") / SIDE).cast("int").alias("blocks_x"), F.ceil(F.col("height") / SIDE).cast("int").alias("blocks_y"),
    )
    side = F.lit(window)
    tiles = scored.select("image_id", side.alias("width"), side.alias("height"), F.col("pixel_x").alias("tile_x"), F.col("pixel_y").alias("tile_y"), F.array("scores").alias("bands"))
    rows = pieces(tiles, size, SIDE, SIDE)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (image, block_y, block_x), parts in _runs(batches):
            at_y, at_x = block_y * SIDE, block_x * SIDE
            high, wide = min(SIDE, parts[0]["image_h"] - at_y), min(SIDE, parts[0]["image_w"] - at_x)
            total, n, reached = np.zeros((high, wide)), np.zeros((high, wide), np.int32), np.zeros((high, wide), np.int32)
            for part in parts:
                y, x = part["y0"] - at_y, part["x0"] - at_x
                score = _values(part["bands"]).reshape(part["rows"], part["cols"])[: max(0, high - y), : max(0, wide - x)]
                here = np.s_[y : y + score.shape[0], x : x + score.shape[1]]
                total[here] += score
                n[here] += 1
                reached[here] += score >= limit
            y, x = np.nonzero(n)
            columns = [pa.array([image] * len(y), kind), pa.array((x + at_x).astype(np.int32)), pa.array((y + at_y).astype(np.int32))]
            yield pa.record_batch([*columns, pa.array(total[y, x]), pa.array(n[y, x]), pa.array(reached[y, x])], names)

    from pyspark.sql.pandas.types import to_arrow_type

    kind = to_arrow_type(rows.schema["image_id"].dataType)
    schema = T.StructType([
        T.StructField("image_id", rows.schema["image_id"].dataType), T.StructField("x", T.IntegerType()), T.StructField("y", T.IntegerType()),
        T.StructField("total", T.DoubleType()), T.StructField("n", T.IntegerType()), T.StructField("reached", T.IntegerType()),
    ])
    names = schema.names
    return _together(rows).mapInArrow(add, schema)
