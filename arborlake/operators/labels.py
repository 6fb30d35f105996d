"""Label rasters from polygons.

Polygons carry ``image_id, poly_id, ring`` with whole-pixel points. Filling works ring by ring inside one
row, so no shuffle happens before pixels of different polygons have to meet.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from arborlake.functions import geometry as geo
from arborlake.operators.blocks import runs_by, whole_groups
from arborlake.operators.components import buffer_mask, count_components  # noqa: F401  (label operators too)
from arborlake.operators.polygons import polygon_moments
from arborlake.session import cut_lineage, join_large, join_small, spread

# Weights of the 3x3 chamfer distance.
AXIAL = 0.955
DIAGONAL = 1.3693
BLOCK = 256  # side of the blocks in which distances are settled


def _row_pixels(near: Column, y: Column) -> Column:
    """Columns of the ring on row ``y``: pixel centres inside plus the pixels of the outline.

    ``near`` holds the edges that reach the row.
    """
    half_open = F.filter(near, lambda e: (F.least(e["y0"], e["y1"]) <= y) & (y < F.greatest(e["y0"], e["y1"])))
    crossings = F.array_sort(F.transform(half_open, lambda e: e["x0"] + (y - e["y0"]) * (e["x1"] - e["x0"]) / (e["y1"] - e["y0"])))

    def between(xs: Column) -> Column:
        pairs = F.when(F.size(xs) > 1, F.sequence(F.lit(0), F.size(xs) - 2, F.lit(2))).otherwise(F.array().cast("array<int>"))
        return F.flatten(F.transform(pairs, lambda i: geo.let(
            F.struct(F.ceil(F.get(xs, i)).cast("int").alias("a"), F.floor(F.get(xs, i + 1)).cast("int").alias("b")),
            lambda s: F.when(s["a"] <= s["b"], F.sequence(s["a"], s["b"])).otherwise(F.array().cast("array<int>")),
        )))

    def on_line(e: Column) -> Column:
        dx, dy = e["x1"] - e["x0"], e["y1"] - e["y0"]
        steep = F.array(F.floor(e["x0"] + (y - e["y0"]) * dx / dy + 0.5).cast("int"))
        xs = F.sequence(F.least(e["x0"], e["x1"]).cast("int"), F.greatest(e["x0"], e["x1"]).cast("int"))
        flat = F.filter(xs, lambda x: F.floor(e["y0"] + (x - e["x0"]) * dy / dx + 0.5) == y)
        return F.when((dx == 0) & (dy == 0), F.array(e["x0"].cast("int"))).when(F.abs(dy) > F.abs(dx), steep).otherwise(flat)

    return F.array_distinct(F.concat(geo.let(crossings, between), F.flatten(F.transform(near, on_line))))


def rasterize(polys: DataFrame, sizes: DataFrame | None = None) -> DataFrame:
    """Instance pixels ``image_id, poly_id, x, y``, clipped to ``image_id, width, height`` when given.

    Interior by pixel centre, together with the outline. Rings are spread over the tasks once; after that the
    rows of one polygon never leave its task.
    """
    rows = spread(polys, "image_id", "poly_id").withColumns({"edges": geo.edges(F.col("ring")), "box": geo.bounds(F.col("ring"))})
    rows = rows.select("image_id", "poly_id", "edges", F.explode(F.sequence(F.col("box.min_y").cast("int"), F.col("box.max_y").cast("int"))).alias("y"))
    near = F.filter("edges", lambda e: (F.least(e["y0"], e["y1"]) <= F.col("y")) & (F.col("y") <= F.greatest(e["y0"], e["y1"])))
    row = geo.let(near, lambda n: _row_pixels(n, F.col("y")))
    rows = rows.select("image_id", "poly_id", F.explode(row).alias("x"), "y")
    if sizes is None:
        return rows.filter((F.col("x") >= 0) & (F.col("y") >= 0))
    rows = join_small(rows, sizes.select("image_id", "width", "height"), "image_id")
    inside = (F.col("x") >= 0) & (F.col("y") >= 0) & (F.col("x") < F.col("width")) & (F.col("y") < F.col("height"))
    return rows.filter(inside).drop("width", "height")


def mask(instances: DataFrame) -> DataFrame:
    return instances.select("image_id", "x", "y").distinct()


def _heat_seeds(polys: DataFrame, sizes: DataFrame, radius: int) -> DataFrame:
    """Counted truncated centroids with the size of their image, in every block that their windows reach."""
    seeds = polygon_moments(polys).groupBy("image_id", "cx_px", "cy_px").agg(F.count("*").alias("n"))
    whole = sizes.select("image_id", F.col("width").cast("int").alias("width"), F.col("height").cast("int").alias("height"))
    seeds = join_small(seeds, whole, "image_id")

    def span(centre: str, side: str) -> Column:
        low = F.greatest(F.col(centre) - radius, F.lit(0))
        high = F.least(F.col(centre) + radius, F.col(side) - 1)
        return F.explode(F.when(low <= high, F.sequence(F.floor(low / BLOCK).cast("int"), F.floor(high / BLOCK).cast("int"))))

    rows = seeds.withColumn("bx", span("cx_px", "width")).withColumn("by", span("cy_px", "height"))
    return rows.select("image_id", "bx", "by", F.col("cx_px").alias("x"), F.col("cy_px").alias("y"), "n", "width", "height")


def _heat_block(seeds: pa.Table, kernel: np.ndarray, at_x: int, at_y: int) -> tuple[np.ndarray, np.ndarray]:
    """Sum of the kernels of one block's seeds, and the cells that some window reaches."""
    radius = len(kernel) // 2
    heat, reached = np.zeros((BLOCK, BLOCK)), np.zeros((BLOCK, BLOCK), bool)
    for x, y, n, width, height in zip(*(seeds.column(c).to_pylist() for c in ("x", "y", "n", "width", "height"))):
        x0, x1 = max(x - radius, 0, at_x), min(x + radius + 1, width, at_x + BLOCK)
        y0, y1 = max(y - radius, 0, at_y), min(y + radius + 1, height, at_y + BLOCK)
        here = np.s_[y0 - at_y : y1 - at_y, x0 - at_x : x1 - at_x]
        heat[here] += n * kernel[y0 - y + radius : y1 - y + radius, x0 - x + radius : x1 - x + radius]
        reached[here] = True
    return np.minimum(heat, 1.0), reached


def _heat_kernel(sigma: float) -> np.ndarray:
    """Gaussian weights; beyond eight sigma a term is below 1e-13."""
    steps = np.arange(-int(8 * sigma), int(8 * sigma) + 1)
    return np.exp(-(steps[:, None] ** 2.0 + steps**2.0) / (2.0 * sigma * sigma))


def centroid_heat(polys: DataFrame, sizes: DataFrame, sigma: float = 2.0) -> DataFrame:
    """Sum of Gaussians around truncated centroids, at most 1: ``image_id, x, y, heat``.

    Equal centroids are counted, and centroids are what is shuffled: the windows are summed block by block.
    """
    kernel, group = _heat_kernel(sigma), ["image_id", "bx", "by"]
    rows = _heat_seeds(polys, sizes, len(kernel) // 2)
    schema = T.StructType([
        T.StructField("image_id", rows.schema["image_id"].dataType), T.StructField("x", T.IntegerType()),
        T.StructField("y", T.IntegerType()), T.StructField("heat", T.DoubleType()),
    ])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in runs_by(batches, group):
            at_x, at_y = (table.column(c)[0].as_py() * BLOCK for c in ("bx", "by"))
            heat, reached = _heat_block(table, kernel, at_x, at_y)
            yield _cells(table, reached, at_x, at_y, [heat], schema.names)

    return spread(rows, *group).sortWithinPartitions(*group, "y", "x").mapInArrow(add, schema)


def _cells(table: pa.Table, some: np.ndarray, at_x: int, at_y: int, values: Sequence[np.ndarray], names: list[str]) -> pa.RecordBatch:
    """Rows ``image_id, x, y`` and ``values`` of the cells of a block where ``some`` holds."""
    y, x = np.nonzero(some)
    image = table.column("image_id")
    columns = [pa.array([image[0].as_py()] * len(y), image.type), pa.array((x + at_x).astype(np.int32)), pa.array((y + at_y).astype(np.int32))]
    return pa.record_batch([*columns, *(pa.array(v[y, x]) for v in values)], names)


def tree_count(polys: DataFrame) -> DataFrame:
    return polygon_moments(polys).groupBy("image_id").agg(F.count("*").alias("trees"))


CELLS = 1 << 21  # cells settled at once


def _sweep(d: np.ndarray) -> np.ndarray:
    """Chamfer distances over areas (their number, height, width): the least of the values and what leads there from
    any other cell of the area.

    One sweep down and one up, each row taking over from the one before and then along itself in both directions:
    two visits of every cell.
    """
    along = AXIAL * np.arange(d.shape[2])
    for order in (range(d.shape[1]), range(d.shape[1] - 1, -1, -1)):
        above = None
        for y in order:
            row = d[:, y]
            if above is not None:
                row = np.minimum(row, above + AXIAL)
                row[:, 1:] = np.minimum(row[:, 1:], above[:, :-1] + DIAGONAL)
                row[:, :-1] = np.minimum(row[:, :-1], above[:, 1:] + DIAGONAL)
            row = np.minimum(row, np.minimum.accumulate(row - along, axis=1) + along)
            back = row[:, ::-1]
            d[:, y] = above = np.minimum(row, (np.minimum.accumulate(back - along, axis=1) + along)[:, ::-1])
    return d


def _settle_blocks(starts: np.ndarray, cells: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distance and outline of the pixels of many instances, each in one block and its rim; ``starts`` are the places of
    their first pixels, ``cells`` the columns. ``dist``: distances so far, or infinity.

    Beyond the rim nothing is known of an instance, so its area ends there.
    """
    first = lambda c: cells[c][starts].astype(np.int64)

    def area(axis: str, block: np.ndarray, side: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        low, high = _around(cells[axis], starts, side)
        low = np.maximum(low, block * BLOCK - 1)
        return low, np.minimum(high, (block + 1) * BLOCK + 1) - low

    return _settle_areas(starts, cells["x"], cells["y"], cells["dist"], *area("x", first("bx"), first("width")), *area("y", first("by"), first("height")))


def _around(values: np.ndarray, starts: np.ndarray, side: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First cell and the cell behind the last one of each instance's bounds and a rim of one pixel, as far as the image goes."""
    return np.maximum(0, np.minimum.reduceat(values, starts) - 1), np.minimum(side, np.maximum.reduceat(values, starts) + 2)


def _settle_areas(starts: np.ndarray, x: np.ndarray, y: np.ndarray, known: np.ndarray, left: np.ndarray, wide: np.ndarray, top: np.ndarray,
                  high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distance and outline of the pixels of many instances, each in its area.

    Areas of like size are swept together, the smaller ones filled up with cells at infinity: no way between two cells
    of an area is shorter outside of it.
    """
    sizes = np.diff(np.append(starts, len(x)))
    owner = np.repeat(np.arange(len(starts)), sizes)
    at_x, at_y = x - left[owner], y - top[owner]
    dist, missing = np.empty(len(x)), np.empty(len(x), bool)
    # areas in order of their sides rounded up to a multiple of eight
    shape = -(-np.stack([high, wide]) // 8)
    order = np.lexsort(shape)
    edge = np.flatnonzero((np.diff(shape[:, order]) != 0).any(axis=0)) + 1
    for alike in np.split(order, edge):
        down, across = (int(v[alike].max()) for v in (high, wide))
        many = max(1, CELLS // ((down + 2) * (across + 2)))
        for lo in range(0, len(alike), many):
            some = alike[lo : lo + many]
            at = np.repeat(starts[some] - np.append(0, np.cumsum(sizes[some])[:-1]), sizes[some]) + np.arange(sizes[some].sum())
            no, row, col = np.repeat(np.arange(len(some)), sizes[some]), at_y[at], at_x[at]
            inside = np.zeros((len(some), down + 2, across + 2), bool)
            inside[no, row + 1, col + 1] = True
            whole = inside[:, :-2, 1:-1] & inside[:, 2:, 1:-1] & inside[:, 1:-1, :-2] & inside[:, 1:-1, 2:]
            beyond = (np.arange(down)[:, None] >= high[some, None, None]) | (np.arange(across) >= wide[some, None, None])
            d = np.where(beyond, np.inf, 0.0)
            d[no, row, col] = known[at]
            dist[at], missing[at] = _sweep(d)[no, row, col], ~whole[no, row, col]
    return dist, missing


def _settled(rows: DataFrame, keys: list[str]) -> DataFrame:
    """One round: blocks of instances with their rims, each settled on its own. ``moved`` tells what has changed."""
    group = [*keys, "bx", "by"]
    schema = T.StructType([rows.schema[c] for c in keys] + [
        T.StructField("x", T.IntegerType()), T.StructField("y", T.IntegerType()), T.StructField("width", T.IntegerType()),
        T.StructField("height", T.IntegerType()), T.StructField("dist", T.DoubleType()), T.StructField("outline", T.BooleanType()),
        T.StructField("moved", T.BooleanType()),
    ])

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts in whole_groups(batches, group):
            cells = {c: table.column(c).to_numpy() for c in ("x", "y", "bx", "by", "width", "height", "dist", "home")}
            far = cells["dist"] = np.where(np.isnan(cells["dist"]), np.inf, cells["dist"])
            dist, outline = _settle_blocks(starts, cells)
            home = cells["home"].astype(bool)
            kept = table.filter(pa.array(home))
            columns = [kept.column(c).combine_chunks() for c in (*keys, "x", "y", "width", "height")]
            moved = dist[home] < far[home]
            yield pa.record_batch([*columns, pa.array(dist[home]), pa.array(outline[home]), pa.array(moved)], schema.names)

    together = spread(rows, *group).sortWithinPartitions(*group)
    return cut_lineage(together.select(*keys, "bx", "by", "x", "y", "width", "height", "dist", "home").mapInArrow(settle, schema))


def _with_rims(rows: DataFrame) -> DataFrame:
    """Every pixel in its block and, where it lies on the border, in the rims of the neighbours."""
    def near(axis: str) -> Column:
        at = F.floor(F.col(axis) / BLOCK).cast("int")
        place = F.pmod(F.col(axis), F.lit(BLOCK))
        return F.when(place == 0, F.array(at, at - 1)).when(place == BLOCK - 1, F.array(at, at + 1)).otherwise(F.array(at))

    seen = rows.withColumn("bx", F.explode(near("x"))).withColumn("by", F.explode(near("y")))
    return seen.withColumn("home", (F.col("bx") == F.floor(F.col("x") / BLOCK)) & (F.col("by") == F.floor(F.col("y") / BLOCK)))


def instance_distance(instances: DataFrame, sizes: DataFrame, keys: Sequence[str] = ("image_id", "poly_id")) -> DataFrame:
    """Chamfer distance to the nearest pixel outside the instance: adds ``dist`` and ``outline``.

    An instance is settled block by block, in two sweeps over the block and a rim of one pixel: linear in the pixels.
    Only instances that reach into other blocks go on, taking the rims' distances over until none gets smaller; a
    distance crosses one block a round. Pixels beyond the image are not outside pixels; ``dist`` is null when the
    instance fills the image. ``outline`` marks pixels with a missing 4-neighbour.
    """
    keys = list(keys)
    cells = instances.select(*keys, F.col("x").cast("int").alias("x"), F.col("y").cast("int").alias("y"))
    placed = join_small(cells, sizes.select("image_id", F.col("width").cast("int").alias("width"), F.col("height").cast("int").alias("height")), "image_id")
    rows = placed.withColumn("dist", F.lit(float("nan")))
    done = _settled(_with_rims(rows), keys)
    blocks = done.select(*keys, F.floor(F.col("x") / BLOCK).alias("bx"), F.floor(F.col("y") / BLOCK).alias("by")).distinct()
    wide = cut_lineage(blocks.groupBy(*keys).count().filter("count > 1").select(*keys))
    out = done
    if not wide.isEmpty():
        out = done.join(wide, keys, "left_anti")
        open_ = done.join(wide, keys, "left_semi")
        on_border = F.pmod(F.col("x"), F.lit(BLOCK)).isin(0, BLOCK - 1) | F.pmod(F.col("y"), F.lit(BLOCK)).isin(0, BLOCK - 1)
        while True:
            now = _settled(_with_rims(open_.select(*keys, "x", "y", "width", "height", "dist")), keys)
            open_ = now
            if now.filter(F.col("moved") & on_border).isEmpty():
                break
        out = out.unionByName(open_)
    far = F.col("dist") == float("inf")
    # every label built on it reads it more than once
    return cut_lineage(out.select(*keys, "x", "y", F.when(~far, F.col("dist")).alias("dist"), "outline"))


def with_share(distances: DataFrame, keys: Sequence[str] = ("image_id", "poly_id"), rows: int = 0) -> DataFrame:
    """Adds ``share``: distance over the instance's largest distance. An aggregate and a join, so that a huge
    instance is not one task; both by one shuffle when the number of ``rows`` is given."""
    if rows:
        distances = spread(distances, *keys, rows=rows)
    tops = distances.groupBy(*keys).agg(F.max("dist").alias("top"))
    return join_large(distances, tops, list(keys)).withColumn("share", F.when(F.col("top") > 0, F.col("dist") / F.col("top"))).drop("top")


def normalised_distance(distances: DataFrame) -> DataFrame:
    """Largest share over the instances of a pixel: ``image_id, x, y, share``."""
    shares = _by_pixel(distances)
    return shares.groupBy("image_id", "x", "y").agg(F.coalesce(F.max("share"), F.lit(0.0)).alias("share"))


def _by_pixel(distances: DataFrame) -> DataFrame:
    """Shares with the rows of a pixel together. Partitions are counted, so memory of a task does not grow with the input."""
    rows = distances.count()
    return spread(with_share(distances, rows=rows), "image_id", "x", "y", rows=rows)


def boundary_band(distances: DataFrame, width: int = 2) -> DataFrame:
    """Pixels within ``width - 1`` steps of an outline, all instances merged: ``image_id, x, y``."""
    steps = F.array(*[F.lit(s) for s in range(1 - width, width)])
    outline = distances.filter("outline").select("image_id", "x", "y").distinct()
    near = outline.withColumn("dx", F.explode(steps)).withColumn("dy", F.explode(steps))
    return near.select("image_id", (F.col("x") + F.col("dx")).alias("x"), (F.col("y") + F.col("dy")).alias("y")).distinct()


def hybrid_label(distances: DataFrame, width: int = 2) -> DataFrame:
    """-1 on the boundary band, the normalised distance elsewhere in the mask: ``image_id, x, y, hybrid``."""
    inner = normalised_distance(distances)
    band = boundary_band(distances, width).withColumn("band", F.lit(True))
    rows = join_large(inner, band, ["image_id", "x", "y"], "left")
    return rows.select("image_id", "x", "y", F.when(F.col("band"), F.lit(-1.0)).otherwise(F.col("share")).alias("hybrid"))


def topo_label(distances: DataFrame) -> DataFrame:
    """Sum over trees of 255 * distance / largest distance, at most 255, truncated: ``image_id, x, y, topo``."""
    shares = _by_pixel(distances)
    value = F.coalesce(255.0 * F.col("share"), F.lit(0.0))
    # nine digits hide the order of the sum from the truncation
    rows = shares.groupBy("image_id", "x", "y").agg(F.round(F.sum(value), 9).alias("topo"))
    return rows.withColumn("topo", F.least("topo", F.lit(255.0)).cast("int"))


def label_channels(polys: DataFrame, sizes: DataFrame, sigma: float = 2.0, width: int = 2) -> DataFrame:
    """mask, centroid and hybrid in one sparse table; pixels left out are zero in all three."""
    values = ("mask int", "centroid double", "hybrid double")

    def rows(table: pa.Table, some: np.ndarray, at_x: int, at_y: int, channels: Sequence[np.ndarray], names: list[str]) -> pa.RecordBatch:
        return _cells(table, some, at_x, at_y, [channels[0].astype(np.int32), *channels[1:]], names)

    return _label_blocks(polys, sizes, sigma, width, f"x int, y int, {', '.join(values)}", rows)


def label_tiles(polys: DataFrame, sizes: DataFrame, sigma: float = 2.0, width: int = 2) -> DataFrame:
    """The same as tiles: ``image_id, tile_x, tile_y, width, height, bands``, the bands mask, centroid and hybrid. A tile
    is the part of a block that has pixels, so no row is made for a pixel."""

    def tile(table: pa.Table, some: np.ndarray, at_x: int, at_y: int, channels: Sequence[np.ndarray], names: list[str]) -> pa.RecordBatch:
        y, x = np.nonzero(some.any(axis=1))[0], np.nonzero(some.any(axis=0))[0]
        if not len(y):
            return pa.record_batch([table.column("image_id").combine_chunks().slice(0, 0), *(pa.array([], pa.int32()) for _ in range(4)),
                                    pa.array([], pa.list_(pa.list_(pa.float64())))], names)
        cut = np.stack([c[y[0] : y[-1] + 1, x[0] : x[-1] + 1] for c in channels])
        flat = pa.ListArray.from_arrays(pa.array(np.arange(4) * (cut.shape[1] * cut.shape[2]), pa.int32()), pa.array(cut.ravel()))
        numbers = (at_x + x[0], at_y + y[0], cut.shape[2], cut.shape[1])
        return pa.record_batch([table.column("image_id").combine_chunks().slice(0, 1), *(pa.array([int(n)], pa.int32()) for n in numbers),
                                pa.ListArray.from_arrays(pa.array([0, 3], pa.int32()), flat)], names)

    return _label_blocks(polys, sizes, sigma, width, "tile_x int, tile_y int, width int, height int, bands array<array<double>>", tile)


AREA = 1 << 16  # cells of an instance's bounds up to which it is worked on as a whole


def _runs(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All whole numbers of many ranges: the number of the range and the number itself. Ranges without an end are empty."""
    sizes = np.nan_to_num(np.maximum(last - first + 1, 0)).astype(np.int64)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    return owner, np.nan_to_num(first).astype(np.int64)[owner] + np.arange(len(owner)) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def _edges(rings: pa.Array) -> tuple[np.ndarray, ...]:
    """Edges of many rings as in :func:`geometry.edges`: number of the ring, x0, y0, x1, y1; what is missing is NaN."""
    sizes = pc.fill_null(pc.list_value_length(rings), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    points = rings.flatten()
    at = {points.type.field(i).name: c for i, c in enumerate(points.flatten())}
    x, y = (at[c].to_numpy(zero_copy_only=False).astype(float) for c in "xy")
    ends = np.cumsum(sizes)[sizes > 0]
    after = np.arange(1, len(x) + 1)
    after[ends - 1] = ends - sizes[sizes > 0]
    return np.repeat(np.arange(len(rings)), sizes), x, y, x[after], y[after]


def _filled(edges: tuple[np.ndarray, ...], width: np.ndarray, height: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pixels of many rings in their images by the rule of :func:`_row_pixels`: number of the ring, x and y, repeats included."""
    ring, x0, y0, x1, y1 = edges
    low, high = np.fmin(y0, y1), np.fmax(y0, y1)
    top = height[ring] - 1
    # inside: between the first and second crossing of a row, the third and fourth, and so on; missing ones come last
    e, y = _runs(np.maximum(np.ceil(low), 0), np.minimum(np.ceil(high) - 1, top))
    crossing = x0[e] + (y - y0[e]) * (x1[e] - x0[e]) / (y1[e] - y0[e])
    order = np.lexsort((crossing, y, ring[e]))
    of, row, crossing = ring[e][order], y[order], crossing[order]
    new = np.ones(len(of), bool)
    new[1:] = (np.diff(of) != 0) | (np.diff(row) != 0)
    place = np.arange(len(of)) - np.maximum.accumulate(np.where(new, np.arange(len(of)), 0))
    opens = np.flatnonzero((place[:-1] % 2 == 0) & ~new[1:])
    run, x = _runs(np.maximum(np.ceil(crossing[opens]), 0), np.minimum(np.floor(crossing[opens + 1]), width[of[opens]] - 1))
    found = [(of[opens[run]], x, row[opens[run]])]
    # the outline, a pixel a row on steep edges and a pixel a column on flat ones
    dx, dy = x1 - x0, y1 - y0
    whole = np.isfinite(dx) & np.isfinite(dy)
    point, steep = whole & (dx == 0) & (dy == 0) & (np.floor(y0) == y0), whole & (np.abs(dy) > np.abs(dx))
    flat = np.flatnonzero(whole & ~steep & ((dx != 0) | (dy != 0)))
    found.append((ring[point], np.trunc(x0[point]).astype(np.int64), y0[point].astype(np.int64)))
    steep = np.flatnonzero(steep)
    e, y = _runs(np.maximum(np.ceil(low[steep]), 0), np.minimum(np.floor(high[steep]), top[steep]))
    e = steep[e]
    found.append((ring[e], np.floor(x0[e] + (y - y0[e]) * dx[e] / dy[e] + 0.5).astype(np.int64), y))
    e, x = _runs(np.maximum(np.trunc(np.minimum(x0, x1)[flat]), 0), np.minimum(np.trunc(np.maximum(x0, x1)[flat]), width[ring[flat]] - 1))
    e = flat[e]
    y = np.floor(y0[e] + (x - x0[e]) * dy[e] / dx[e] + 0.5)
    near = (low[e] <= y) & (y <= high[e])
    found.append((ring[e][near], x[near], y[near].astype(np.int64)))
    of, x, y = (np.concatenate(c) for c in zip(*found))
    inside = (x >= 0) & (y >= 0) & (x < width[of]) & (y < height[of])
    # a row that an edge without any x reaches has no pixels
    lost = np.flatnonzero(np.isnan(x0) & np.isnan(x1))
    if len(lost):
        e, row = _runs(np.maximum(np.ceil(low[lost]), 0), np.minimum(np.floor(high[lost]), top[lost]))
        lines = np.int64(max(y.max(initial=0), row.max(initial=0)) + 1)
        inside &= ~np.isin(of * lines + y, ring[lost[e]] * lines + row)
    return of[inside], x[inside], y[inside]


def _parts(starts: np.ndarray, edges: tuple[np.ndarray, ...], rings: int) -> Iterator[tuple[int, int]]:
    """First and last but one of the groups of rings whose bounds together have about as many cells as are settled at once."""
    ring, x0, y0, _, _ = edges
    area = np.zeros(rings)
    at = np.flatnonzero(np.diff(ring, prepend=-1))
    if len(at):
        sides = [np.fmax.reduceat(v, at) - np.fmin.reduceat(v, at) + 3 for v in (x0, y0)]
        area[ring[at]] = np.nan_to_num(sides[0] * sides[1])
    part = np.cumsum(np.add.reduceat(area, starts)) // CELLS
    cuts = np.flatnonzero(np.diff(part)) + 1
    yield from zip([0, *cuts.tolist()], [*cuts.tolist(), len(starts)])


def _whole_instances(polys: DataFrame, sizes: DataFrame, rim: int) -> DataFrame:
    """Instances by block, each worked on as a whole: ``image_id, bx, by, cells, shares, edges``.

    ``cells`` are the instance's pixels in the block with their ``shares`` of its largest distance, ``edges`` its outline
    up to ``rim`` cells around the block, all as numbers in the block with its rim. All rings of a key are one instance;
    without an id it has an outline and no shares, as in :func:`with_share`.
    """
    keys = ["image_id", "poly_id"]
    whole = sizes.select("image_id", F.col("width").cast("double").alias("width"), F.col("height").cast("double").alias("height"))
    rows = join_small(polys.select(*keys, "ring"), whole, "image_id")
    numbers = T.ArrayType(T.IntegerType())
    schema = T.StructType([rows.schema["image_id"], T.StructField("bx", T.IntegerType()), T.StructField("by", T.IntegerType()),
                           T.StructField("cells", numbers), T.StructField("shares", T.ArrayType(T.DoubleType())), T.StructField("edges", numbers)])

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts in whole_groups(batches, keys):
            edges = _edges(table.column("ring").combine_chunks())
            for lo, hi in _parts(starts, edges, table.num_rows):
                first, last = starts[lo], starts[hi] if hi < len(starts) else table.num_rows
                some = (first <= edges[0]) & (edges[0] < last)
                part = table.slice(first, last - first)
                yield from _instance_blocks(part, starts[lo:hi] - first, (edges[0][some] - first, *(e[some] for e in edges[1:])), rim, schema.names)

    return spread(rows, *keys).sortWithinPartitions(*keys).mapInArrow(settle, schema)


def _instance_blocks(table: pa.Table, groups: np.ndarray, edges: tuple[np.ndarray, ...], rim: int, names: list[str]) -> Iterator[pa.RecordBatch]:
    """Rows of :func:`_whole_instances` of a table with a ring a row; ``groups`` are the places where instances start."""
    width, height = (np.nan_to_num(table.column(c).to_numpy()) for c in ("width", "height"))
    ring, x, y = _filled(edges, width, height)
    if not len(x):
        return
    owner = np.searchsorted(groups, ring, "right") - 1
    lines, columns = y.max() + 1, x.max() + 1
    code = np.unique((owner * lines + y) * columns + x)
    owner, y, x = code // (lines * columns), code // columns % lines, code % columns
    starts = np.flatnonzero(np.diff(owner, prepend=-1))
    at = groups[owner[starts]]
    left, right = _around(x, starts, width[at].astype(np.int64))
    top, bottom = _around(y, starts, height[at].astype(np.int64))
    dist, outline = _settle_areas(starts, x, y, np.full(len(x), np.inf), left, right - left, top, bottom - top)
    far = np.isinf(dist)
    largest = np.repeat(np.maximum.reduceat(np.where(far, 0.0, dist), starts), np.diff(np.append(starts, len(x))))
    share = np.divide(dist, largest, out=np.zeros(len(x)), where=~far & (largest > 0))
    named = table.column("poly_id").is_valid().to_numpy()[groups][owner]
    side, reach = BLOCK, BLOCK + 2 * rim
    place = lambda at, bx, by: (y[at] - by * side + rim) * reach + x[at] - bx * side + rim
    inner = np.flatnonzero(named)
    found = [(inner, x[inner] // side, y[inner] // side)]
    border = np.flatnonzero(outline)
    spans = [(np.maximum((v[border] - rim) // side, 0), (v[border] + rim) // side) for v in (x, y)]
    steps = [range(int((high - low).max(initial=0)) + 1) for low, high in spans]
    for bx, by in ((spans[0][0] + dx, spans[1][0] + dy) for dx in steps[0] for dy in steps[1]):
        seen = (bx <= spans[0][1]) & (by <= spans[1][1])
        found.append((border[seen], bx[seen], by[seen]))
    keys = [np.concatenate(c) for c in zip(*((owner[p], by, bx) for p, bx, by in found))]
    sides = [k.max(initial=0) + 1 for k in keys]
    block, no = np.unique((keys[0] * sides[1] + keys[1]) * sides[2] + keys[2], return_inverse=True)
    cut = len(inner)
    lists = []
    for rows, values in ((no[:cut], [place(*found[0]), share[inner]]), (no[cut:], [np.concatenate([place(*f) for f in found[1:]])])):
        order = np.argsort(rows, kind="stable")
        offsets = pa.array(np.append(0, np.cumsum(np.bincount(rows, minlength=len(block)))).astype(np.int32))
        lists += [pa.ListArray.from_arrays(offsets, pa.array(v[order] if v.dtype == float else v[order].astype(np.int32))) for v in values]
    image = table.column("image_id").take(pa.array(groups[block // (sides[1] * sides[2])])).combine_chunks()
    numbers = (pa.array(v.astype(np.int32)) for v in (block % sides[2], block // sides[2] % sides[1]))
    yield pa.record_batch([image, *numbers, *lists], names)


def _large_instances(polys: DataFrame, sizes: DataFrame, rim: int) -> DataFrame:
    """The same as :func:`_whole_instances` of instances of any size, a row a pixel and block."""
    distances = instance_distance(rasterize(polys, sizes), sizes)
    shares = with_share(distances).select("image_id", "x", "y", F.coalesce("share", F.lit(0.0)).alias("share"), "outline")
    nameless = distances.filter("poly_id is null").select("image_id", "x", "y", F.lit(None).cast("double").alias("share"), "outline")

    def span(axis: str) -> Column:
        near = F.when(F.col("outline"), F.lit(rim)).otherwise(F.lit(0))
        return F.explode(F.sequence(F.greatest(F.floor((F.col(axis) - near) / BLOCK), F.lit(0)).cast("int"), F.floor((F.col(axis) + near) / BLOCK).cast("int")))

    rows = shares.unionByName(nameless).withColumn("bx", span("x")).withColumn("by", span("y"))
    home = (F.floor(F.col("x") / BLOCK) == F.col("bx")) & (F.floor(F.col("y") / BLOCK) == F.col("by")) & F.col("share").isNotNull()
    cell = F.array(((F.col("y") - F.col("by") * BLOCK + rim) * (BLOCK + 2 * rim) + F.col("x") - F.col("bx") * BLOCK + rim).cast("int"))
    none = F.array().cast("array<int>")
    return rows.select("image_id", "bx", "by", F.when(home, cell).otherwise(none).alias("cells"),
                       F.when(home, F.array("share")).otherwise(F.array().cast("array<double>")).alias("shares"), F.when(F.col("outline"), cell).otherwise(none).alias("edges"))


def _instances(polys: DataFrame, sizes: DataFrame, rim: int) -> DataFrame:
    """Rows of :func:`_whole_instances`; instances with bounds of more than AREA cells go pixel by pixel, so none is one task."""
    box = geo.bounds(F.col("ring"))
    ends = [F.min("box.min_x"), F.max("box.max_x"), F.min("box.min_y"), F.max("box.max_y"), F.sum(F.size("ring"))]
    bounds = polys.select("image_id", "poly_id", "ring", box.alias("box")).groupBy("image_id", "poly_id").agg(*(e.alias(n) for e, n in zip(ends, "abcdn")))
    large = cut_lineage(bounds.filter(f"(b - a + 1) * (d - c + 1) > {AREA} or n > {AREA}").select("image_id", "poly_id"))
    if large.isEmpty():
        return _whole_instances(polys, sizes, rim)
    here, there = polys.alias("p"), large.alias("l")
    same = F.col("p.image_id").eqNullSafe(F.col("l.image_id")) & F.col("p.poly_id").eqNullSafe(F.col("l.poly_id"))
    few = _whole_instances(here.join(there, same, "left_anti"), sizes, rim)
    return few.unionByName(_large_instances(here.join(there, same, "left_semi"), sizes, rim))


def _hybrid_block(cells: np.ndarray, shares: np.ndarray, edges: np.ndarray, rim: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Pixels of some instance in a block, and the hybrid label there: -1 in the boundary band, else the largest share."""
    reach = BLOCK + 2 * rim
    core = np.s_[rim : rim + BLOCK, rim : rim + BLOCK]
    share, edge = np.full(reach * reach, -1.0), np.zeros(reach * reach, bool)
    np.maximum.at(share, cells, shares)
    edge[edges] = True
    share, edge = share.reshape(reach, reach)[core], edge.reshape(reach, reach)
    across, band = np.zeros((reach, BLOCK), bool), np.zeros((BLOCK, BLOCK), bool)
    for d in range(2 * width - 1):
        across |= edge[:, d : d + BLOCK]
    for d in range(2 * width - 1):
        band |= across[d : d + BLOCK]
    inside = share >= 0
    return inside, np.where(inside, np.where(band, -1.0, share), 0.0)


def _label_blocks(polys: DataFrame, sizes: DataFrame, sigma: float, width: int, columns: str, emit) -> DataFrame:
    """Instances, each filled and settled where its rings are, meet in blocks with their neighbours' outlines and the
    centroids: rings and lists by block are shuffled, not pixels of instances or of the heat."""
    kernel, group = _heat_kernel(sigma), ["image_id", "bx", "by"]
    rim = max(width - 1, 0)
    rows = _heat_seeds(polys, sizes, len(kernel) // 2).unionByName(_instances(polys, sizes, rim), allowMissingColumns=True)
    schema = T.StructType([T.StructField("image_id", rows.schema["image_id"].dataType), *T.StructType.fromDDL(columns).fields])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in runs_by(batches, group):
            at_x, at_y = (table.column(c)[0].as_py() * BLOCK for c in ("bx", "by"))
            heat, some = _heat_block(table.filter(table.column("n").is_valid()), kernel, at_x, at_y)
            inner = table.filter(table.column("n").is_null())
            lists = (inner.column(c).combine_chunks().flatten().to_numpy(zero_copy_only=False) for c in ("cells", "shares", "edges"))
            inside, hybrid = _hybrid_block(*lists, rim, width)
            yield emit(table, some | inside, at_x, at_y, [inside.astype(float), heat, hybrid], schema.names)

    return spread(rows, *group).sortWithinPartitions(*group, "y", "x").mapInArrow(join, schema)
