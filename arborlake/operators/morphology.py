"""Morphology, smoothing, peaks and seeded regions on sparse pixel tables ``by, x, y[, value]``.

``sizes`` carries ``image_id, width, height``. Window maxima, spaced peaks, disks and blurs are settled in blocks with a
rim, many blocks at once, and the seeded flood runs over many tiles at once.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from arborlake.functions.bands import threshold
from arborlake.operators.blocks import whole_groups
from arborlake.operators.components import remove_small, with_least
from arborlake.session import cut_lineage, join_large, join_small, spread

TILE = 256  # side of a flood tile: at most 65,536 pixels and their rim per group


def disk(radius: int) -> list[tuple[int, int]]:
    steps = range(-radius, radius + 1)
    return [(dx, dy) for dy in steps for dx in steps if dx * dx + dy * dy <= radius * radius]


CELLS = 1 << 20  # cells of blocks looked at together


def _sized(pixels: DataFrame, sizes: DataFrame) -> DataFrame:
    return join_small(pixels, sizes.select("image_id", F.col("width").cast("int").alias("width"), F.col("height").cast("int").alias("height")), "image_id")


def _areas(table: pa.Table, starts: np.ndarray, reach: int):
    """Blocks of like size together: the places of their rows, which of the blocks and where in its area each row lies, and
    the areas' first column and line and their sides. An area is what ``reach`` cells around the block's pixels hold of it."""
    x, y = (table.column(c).to_numpy().astype(np.int64) for c in ("x", "y"))
    first = lambda c: table.column(c).to_numpy()[starts].astype(np.int64)

    def area(values: np.ndarray, block: np.ndarray, side: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        low = np.maximum(np.maximum(0, np.minimum.reduceat(values, starts) - reach), block * TILE)
        return low, np.minimum(np.minimum(side, np.maximum.reduceat(values, starts) + reach + 1), (block + 1) * TILE) - low

    left, wide = area(x, first("bx"), first("width"))
    top, high = area(y, first("by_"), first("height"))
    sizes = np.diff(np.append(starts, len(x)))
    order = np.argsort(np.maximum(wide, high), kind="stable")
    lo = 0
    while lo < len(order):
        hi = len(order)
        while True:
            down, across = int(high[order[lo:hi]].max()), int(wide[order[lo:hi]].max())
            if hi - lo == 1 or (hi - lo) * (down + 2 * reach) * (across + 2 * reach) <= CELLS:
                break
            hi = lo + (hi - lo + 1) // 2
        some = order[lo:hi]
        at = np.repeat(starts[some] - np.append(0, np.cumsum(sizes[some])[:-1]), sizes[some]) + np.arange(sizes[some].sum())
        no = np.repeat(np.arange(len(some)), sizes[some])
        yield at, (no, y[at] - top[some][no] + reach, x[at] - left[some][no] + reach), some, left[some], top[some], down, across
        lo = hi


def _by_blocks(pixels: DataFrame, by: Sequence[str], reach: int, values: Sequence[str], solve) -> DataFrame:
    """Work on ``by, x, y, width, height`` and ``values`` in blocks that hold the pixels up to ``reach`` cells around them.

    ``solve`` gets arrays over blocks, lines and columns with a rim of ``reach`` cells: how many pixels a cell has, whether
    it lies in the image, and the sums of the values with the numbers of values that are not null. It returns the cells
    to keep, without the rim, and None or a column with its nulls. Pixels are what is shuffled, one to four times each, and
    partitions are counted, so the memory of a task does not grow with the input.
    """
    by = list(by)
    group = [*by, "width", "height", "bx", "by_"]
    kept = cut_lineage(pixels.filter("x is not null and y is not null").select(*by, "x", "y", "width", "height", *values))

    def span(axis: str, side: str) -> Column:
        low, high = F.greatest(F.col(axis) - reach, F.lit(0)), F.least(F.col(axis) + reach, F.col(side) - 1)
        return F.explode(F.when(low <= high, F.sequence(F.floor(low / TILE).cast("int"), F.floor(high / TILE).cast("int"))))

    rows = kept.withColumn("bx", span("x", "width")).withColumn("by_", span("y", "height"))
    schema = T.StructType([rows.schema[c] for c in by] + [T.StructField(c, T.IntegerType()) for c in ("x", "y")] + [T.StructField(c, T.DoubleType()) for c in values])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts in whole_groups(batches, group):
            width, height = (table.column(c).to_numpy()[starts] for c in ("width", "height"))
            keys = table.select(by).take(pa.array(starts)).combine_chunks()
            for at, cells, some, left, top, down, across in _areas(table, starts, reach):
                shape = (len(some), down + 2 * reach, across + 2 * reach)
                found = np.zeros(shape)
                np.add.at(found, cells, 1)
                col = left[:, None] - reach + np.arange(shape[2])
                line = top[:, None] - reach + np.arange(shape[1])
                inside = ((line >= 0) & (line < height[some][:, None]))[:, :, None] & ((col >= 0) & (col < width[some][:, None]))[:, None, :]
                sums = []
                for c in values:
                    column = table.column(c).combine_chunks().take(pa.array(at))
                    real = column.is_valid().to_numpy(zero_copy_only=False)
                    total, known = np.zeros(shape), np.zeros(shape)
                    np.add.at(total, tuple(i[real] for i in cells), column.drop_null().to_numpy())
                    np.add.at(known, tuple(i[real] for i in cells), 1)
                    sums.append((total, known))
                keep, out = solve(found, inside, *sums)
                core = np.s_[:, reach : reach + down, reach : reach + across]
                block_x, block_y = (table.column(c).to_numpy()[starts][some].astype(np.int64) for c in ("bx", "by_"))
                # areas are filled up to one size: what lies beyond a block belongs to another one
                own = (line[:, reach : reach + down] < (block_y + 1)[:, None] * TILE)[:, :, None] & (col[:, reach : reach + across] < (block_x + 1)[:, None] * TILE)[:, None, :]
                no, v, u = np.nonzero(keep & inside[core] & own)
                columns = [*(keys.column(c).combine_chunks().take(pa.array(some[no])) for c in by), pa.array((left[no] + u).astype(np.int32)), pa.array((top[no] + v).astype(np.int32))]
                if out is not None:
                    columns.append(pa.array(out[0][no, v, u], mask=out[1][no, v, u]))
                yield pa.record_batch(columns, schema.names)

    return spread(rows, *group, rows=kept.count()).sortWithinPartitions(*group).mapInArrow(run, schema)


def _over(values: np.ndarray, pairs: Sequence[tuple[int, int]], reach: int) -> np.ndarray:
    """Sums over the cells at the offsets, without the rim."""
    down, across = values.shape[1] - 2 * reach, values.shape[2] - 2 * reach
    total = np.zeros((len(values), down, across))
    for dx, dy in pairs:
        total += values[:, reach + dy : reach + dy + down, reach + dx : reach + dx + across]
    return total


def dilate(pixels: DataFrame, sizes: DataFrame, radius: int, by: Sequence[str] = ("image_id",)) -> DataFrame:
    """Pixels within the disk of a foreground pixel."""
    pairs = disk(radius)

    def solve(found: np.ndarray, inside: np.ndarray):
        return _over(found, pairs, radius) > 0, None

    return _by_blocks(_sized(pixels.select(*by, "x", "y"), sizes), by, radius, (), solve)


def erode(pixels: DataFrame, sizes: DataFrame, radius: int, by: Sequence[str] = ("image_id",)) -> DataFrame:
    """Pixels whose whole disk, as far as it lies in the image, is foreground."""
    pairs = disk(radius)

    def solve(found: np.ndarray, inside: np.ndarray):
        return _over(found, pairs, radius) == _over(inside, pairs, radius), None

    return _by_blocks(_sized(pixels.select(*by, "x", "y"), sizes), by, radius, (), solve)


def gaussian_blur(pixels: DataFrame, sizes: DataFrame, sigma: float, truncate: float = 4.0) -> DataFrame:
    """Smoothed ``value`` (1 for a mask), in double; edges are mirrored. Two one-dimensional passes inside blocks."""
    radius = int(truncate * sigma + 0.5)
    weights = [math.exp(-0.5 * (o / sigma) ** 2) for o in range(-radius, radius + 1)]
    total = sum(weights)
    weights = [w / total for w in weights]

    def mirrored(rows: DataFrame, axis: str, side: str) -> DataFrame:
        turns = (F.floor(F.lit(radius) / F.col(side)) + 1).cast("int")
        # a source pixel also stands at its mirror images beyond both edges
        images = F.flatten(F.transform(F.sequence(-turns, turns), lambda m: F.array(
            2 * m * F.col(side) + F.col(axis), 2 * m * F.col(side) - 1 - F.col(axis))))
        near = F.filter(images, lambda i: (i >= -radius) & (i < F.col(side) + radius))
        # a pixel without a place reaches the whole line, and adds no value to it
        rows = rows.withColumn("value", F.when(F.col(axis).isNotNull(), F.col("value")))
        return rows.withColumn(axis, F.explode(F.when(F.col(axis).isNotNull(), near).when(F.col(side) > 0, F.sequence(F.lit(0), F.col(side) - 1))))

    def pass_(values: np.ndarray, axis: int, scale: Sequence[float]) -> np.ndarray:
        size = values.shape[axis] - 2 * radius
        out = np.zeros([size if i == axis else n for i, n in enumerate(values.shape)])
        for o, w in enumerate(scale):
            out += w * np.take(values, np.arange(o, o + size), axis)
        return out

    def solve(found: np.ndarray, inside: np.ndarray, value: tuple[np.ndarray, np.ndarray]):
        flat = [1.0] * len(weights)
        near = lambda v, scale: pass_(pass_(v, 2, scale), 1, scale)
        return near(found, flat) > 0, (near(value[0], weights), near(value[1], flat) == 0)

    value = F.col("value").cast("double") if "value" in pixels.columns else F.lit(1.0)
    rows = _sized(pixels.select("image_id", F.col("x").cast("int").alias("x"), F.col("y").cast("int").alias("y"), value.alias("value")), sizes)
    return _by_blocks(mirrored(mirrored(rows, "x", "width"), "y", "height"), ["image_id"], radius, ["value"], solve)


def _alike(high: np.ndarray, wide: np.ndarray) -> Iterator[np.ndarray]:
    """Numbers of areas of like size, as many together as fill CELLS cells, or one."""
    order, lo = np.argsort(np.maximum(wide, high), kind="stable"), 0
    while lo < len(order):
        hi = len(order)
        while hi - lo > 1 and (hi - lo) * int(high[order[lo:hi]].max()) * int(wide[order[lo:hi]].max()) > CELLS:
            hi = lo + (hi - lo + 1) // 2
        yield order[lo:hi]
        lo = hi


def _members(starts: np.ndarray, n: int, some: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the rows of some groups, and which of these groups each row is in."""
    sizes = np.diff(np.append(starts, n))[some]
    return np.repeat(starts[some] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum()), np.repeat(np.arange(len(some)), sizes)


def _near_blocks(rows: DataFrame, by: list[str], reach: int, shift: int = 0) -> DataFrame:
    """Rows by block, sorted: every row in its own block, ``home``, and in those that it lies up to ``reach`` cells off.
    Blocks start ``shift`` cells off the image. Partitions are counted, so the memory of a task does not grow."""
    def span(axis: str) -> Column:
        low, high = (F.floor((F.col(axis) - shift + d) / TILE).cast("int") for d in (-reach, reach))
        return F.explode(F.sequence(low, high))

    own = lambda axis, at: F.floor((F.col(axis) - shift) / TILE) == F.col(at)
    placed = rows.withColumn("bx", span("x")).withColumn("by_", span("y")).withColumn("home", own("x", "bx") & own("y", "by_"))
    group = [*by, "bx", "by_"]
    return spread(placed, *group, rows=rows.count()).sortWithinPartitions(*group)


def _grids(table: pa.Table, starts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, tuple[int, int, int]]]:
    """Groups of like size as grids over the bounds of their rows: places of the rows, their cells, and the grids' shape."""
    x, y = (table.column(c).to_numpy().astype(np.int64) for c in ("x", "y"))
    left, top = np.minimum.reduceat(x, starts), np.minimum.reduceat(y, starts)
    wide, high = np.maximum.reduceat(x, starts) - left + 1, np.maximum.reduceat(y, starts) - top + 1
    for some in _alike(high, wide):
        at, no = _members(starts, len(x), some)
        shape = (len(some), int(high[some].max()), int(wide[some].max()))
        yield at, (no * shape[1] + y[at] - top[some][no]) * shape[2] + x[at] - left[some][no], shape


def _slide(values: np.ndarray, back: int, on: int, pick) -> np.ndarray:
    """``pick`` over the windows of grids that reach ``back`` cells before and ``on`` cells behind, on both axes."""
    for lines in (lambda v: v, lambda v: v.swapaxes(1, 2)):
        given, values = lines(values), values.copy()
        out = lines(values)
        for d in range(1, back + 1):
            out[:, :, d:] = pick(out[:, :, d:], given[:, :, :-d])
        for d in range(1, on + 1):
            out[:, :, :-d] = pick(out[:, :, :-d], given[:, :, d:])
    return values


def _placed(rows: DataFrame, by: Sequence[str]) -> DataFrame:
    """Rows with a key, a place and a value; no other meets a neighbour."""
    return rows.dropna(subset=[*by, "x", "y"]).filter(F.col("value").isNotNull())


def local_maxima(pixels: DataFrame, k: int, limit: float, by: Sequence[str] = ("image_id",)) -> DataFrame:
    """Pixels equal to the largest value of their k x k window and above ``limit``; plateaus give several.

    Windows slide over blocks with a rim, so a pixel is moved once, and again where it lies near other blocks.
    """
    by = list(by)
    rows = cut_lineage(_placed(pixels.select(*by, "x", "y", "value"), by).withColumn("level", F.col("value").cast("double")))
    group = [*by, "bx", "by_"]
    back, on = k // 2, k - k // 2 - 1
    schema = T.StructType([rows.schema[c] for c in (*by, "x", "y", "value")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts in whole_groups(batches, group):
            value, hit = table.column("level").to_numpy(), np.zeros(table.num_rows, bool)
            for at, cells, shape in _grids(table, starts):
                grid = np.full(shape, -np.inf)
                np.maximum.at(grid.reshape(-1), cells, value[at])  # not a number is the largest, as in a sort
                top = _slide(grid, back, on, np.maximum).reshape(-1)[cells]
                hit[at] = (value[at] == top) | np.isnan(value[at])
            hit &= ~(value <= limit) & table.column("home").to_numpy()
            yield from table.select(schema.names).filter(pa.array(hit)).combine_chunks().to_batches()

    return _near_blocks(rows, by, max(back, on)).mapInArrow(run, schema)


def spaced_peaks(pixels: DataFrame, min_distance: int, by: Sequence[str] = ("image_id",)) -> DataFrame:
    """Local maxima of ``value`` at least ``min_distance`` apart (larger of the two axis distances), strongest
    first, raster order on ties. Returns ``by, x, y, value, marker``; the marker is the pixel's code.

    A peak is kept when it beats all open peaks near it, and the peaks it covers are dropped, block by block until
    nothing in a block is left to decide. What hangs on peaks beyond a block goes on in blocks half a side further.
    """
    from arborlake.operators.components import pixel_code

    by = list(by)
    peaks = local_maxima(pixels, 2 * min_distance + 1, 0.0, by).withColumn("marker", pixel_code(F.col("x"), F.col("y")))
    peaks = cut_lineage(peaks)
    names, reach = peaks.columns, max(min_distance - 1, 0)
    open_peaks, kept, shift = peaks.withColumn("state", F.lit(_OPEN)), peaks.limit(0), 0
    while True:
        solved = cut_lineage(_settled_peaks(open_peaks, by, reach, shift))
        won = solved.filter(F.col("state") == _WON).select(names)
        kept = kept.unionByName(won)
        left = solved.filter(F.col("state") == _OPEN)
        if left.isEmpty():
            return kept
        edge = F.lit(False)
        for axis in ("x", "y"):
            place = F.pmod(F.col(axis) - shift, F.lit(TILE))
            edge = edge | (place < reach) | (place >= TILE - reach)
        open_peaks = left.unionByName(won.filter(edge).withColumn("state", F.lit(_KNOWN)))
        shift = TILE // 2 - shift


_OPEN, _WON, _KNOWN = 0, 1, 2  # a peak to decide, one just kept, one kept before that others have to give way to


def _settled_peaks(peaks: DataFrame, by: list[str], reach: int, shift: int) -> DataFrame:
    """One round: the peaks of every block that are kept now or still open, by ``state``."""
    group = [*by, "bx", "by_"]
    rows = peaks.withColumn("level", F.col("value").cast("double"))
    schema = peaks.schema
    names = [c for c in schema.names if c != "state"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts in whole_groups(batches, group):
            value, marker, state, home = (table.column(c).to_numpy() for c in ("level", "marker", "state", "home"))
            out = np.full(table.num_rows, -1, np.int32)
            for at, cells, shape in _grids(table, starts):
                rank = np.empty(len(at), np.int64)
                strength = np.where(np.isnan(value[at]), np.inf, value[at])
                rank[np.lexsort((marker[at], -strength, ~np.isnan(value[at])))] = np.arange(len(at))
                last, open_ = len(at), state[at] == _OPEN
                order = np.full(shape, last)
                flat = order.reshape(-1)
                np.minimum.at(flat, cells[open_], rank[open_])
                own, won = np.zeros(shape, bool), np.zeros(shape, bool)
                own.reshape(-1)[cells[home[at]]] = True
                new = np.zeros(shape, bool)
                new.reshape(-1)[cells[~open_]] = True
                while True:
                    order[_slide(new, reach, reach, np.logical_or)] = last  # what a kept peak covers is open no more
                    new = (order < last) & own & (order == _slide(order, reach, reach, np.minimum))
                    if not new.any():
                        break
                    won |= new
                mine = open_ & home[at]
                out[at] = np.where(mine & won.reshape(-1)[cells], _WON, np.where(mine & (flat[cells] < last), _OPEN, -1))
            some = pa.array(out >= 0)
            columns = [c.combine_chunks() for c in table.select(names).filter(some).columns]
            yield pa.record_batch([*columns, pa.array(out[out >= 0])], schema.names)

    return _near_blocks(rows, by, reach, shift).mapInArrow(run, schema)


_NONE = 2**62  # marker of a pixel no flood has reached
_BITS = 62  # of a level, a number of steps and a marker as one number


def _flood(level: np.ndarray, hops: np.ndarray, marker: np.ndarray, cost: np.ndarray, free: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """Settle tiles with their rims fixed, arrays over tiles, lines and columns. A free pixel follows the neighbour with
    the least (level, hops, marker). The three are one number each, so the least of neighbours is one step; None when
    these tiles have too many levels and markers for that."""
    known = marker != _NONE
    levels, at = np.unique(np.concatenate([level[known], cost[free]]), return_inverse=True)
    markers, names = np.unique(marker[known], return_inverse=True)
    if not len(markers):
        return level, hops, marker
    low = len(markers).bit_length()
    high = low + (int(hops[known].max()) + marker[0].size + 2).bit_length()
    if high + len(levels).bit_length() > _BITS:
        return None
    none = np.int64(1) << _BITS
    key, cost_ = np.full(level.shape, none), np.zeros(level.shape, np.int64)
    key[known] = (at[: known.sum()].astype(np.int64) << high) | (hops[known].astype(np.int64) << low) | names
    cost_[free] = at[known.sum() :]
    some, inner = np.arange(len(key)), np.s_[:, 1:-1, 1:-1]
    now, step, kept = key, np.int64(1) << low, np.int64((1 << low) - 1)
    costs, open_ = cost_[inner], free[inner]
    while True:
        best = np.minimum(np.minimum(now[:, :-2, 1:-1], now[:, 2:, 1:-1]), np.minimum(now[:, 1:-1, :-2], now[:, 1:-1, 2:]))
        new = np.where(costs > best >> high, (costs << high) | step | (best & kept), best + step)
        new = np.where(open_ & (best < none), new, now[inner])
        moved = (new != now[inner]).any(axis=(1, 2))
        now[inner] = new
        if not moved.any():
            break
        if 2 * moved.sum() < len(moved):  # tiles that stand still are done
            key[some] = now
            some, now, costs, open_ = some[moved], now[moved], costs[moved], open_[moved]
    key[some] = now
    got = key < none
    out = [np.full(level.shape, np.inf), np.zeros(level.shape, np.int64), np.full(level.shape, _NONE)]
    out[0][got], out[1][got], out[2][got] = levels[key[got] >> high], (key[got] & ((np.int64(1) << high) - 1)) >> low, markers[key[got] & kept]
    return out[0], out[1], out[2]


_STATE = ("level", "hops", "marker")


def _flood_tiles(cells: dict[str, np.ndarray], active: np.ndarray) -> None:
    """Settle the active ones of many tiles in place. ``cells`` has a row a pixel, by tile: ``tile`` its number, ``x, y`` in
    the tile with its rim, ``own``, ``cost``, ``seed`` whether it starts a flood, and the state."""
    todo = np.flatnonzero(active[cells["tile"]])
    if not len(todo):
        return
    tile, x, y = (cells[c][todo] for c in ("tile", "x", "y"))
    starts = np.flatnonzero(np.diff(tile, prepend=-1))
    ends = [(np.minimum.reduceat(v, starts), np.maximum.reduceat(v, starts)) for v in (x, y)]
    (left, wide), (top, high) = ((low - 1, high - low + 3) for low, high in ends)
    parts = list(_alike(high, wide))
    while parts:
        some = parts.pop()
        at, no = _members(starts, len(todo), some)
        rows, shape = todo[at], (len(some), int(high[some].max()), int(wide[some].max()))
        place = (no, y[at] - top[some][no], x[at] - left[some][no])

        def grid(values: np.ndarray, fill, kind) -> np.ndarray:
            out = np.full(shape, fill, kind)
            out[place] = values
            return out

        # rims and seeds keep their state
        free = grid(cells["own"][rows] & ~cells["seed"][rows], False, bool)
        done = _flood(grid(cells["level"][rows], np.inf, float), grid(cells["hops"][rows], 0, np.int64), grid(cells["marker"][rows], _NONE, np.int64),
                      grid(cells["cost"][rows], np.inf, float), free)
        if done is None:
            if len(some) == 1:
                raise ValueError("a tile has too many levels and markers for one number")
            parts += [some[: len(some) // 2], some[len(some) // 2 :]]
            continue
        own = cells["own"][rows]
        for c, values in zip(_STATE, done):
            cells[c][rows[own]] = values[place][own]


def seeded_regions(pixels: DataFrame, markers: DataFrame, by: Sequence[str] = ("image_id",), tile: int = TILE) -> DataFrame:
    """Flood the mask ``by, x, y, value`` from ``markers`` in order of -value: ``by, x, y, region``.

    A pixel is reached at the lowest level (largest cost on the way, at best), after the fewest steps on that
    level, from the smallest marker. Tiles settle on their own with the rim of their neighbours fixed and
    exchange rims until no rim changes, so a flood may cross any number of tiles and no task holds more
    than some. After the first round a tile is one row, and only tiles whose rim has changed are settled again.
    Pixels no marker reaches are left out.
    """
    by = list(by)
    rows = _placed(pixels, ()).filter(~F.isnan(F.col("value").cast("double")))
    rows = join_large(rows, markers.select(*by, "x", "y", F.col("marker").alias("seed")), [*by, "x", "y"], "left")
    rows = rows.select(
        *by, "x", "y", (-F.col("value")).cast("double").alias("cost"), F.col("seed").cast("bigint").alias("seed"),
        F.floor(F.col("x") / tile).cast("int").alias("tx"), F.floor(F.col("y") / tile).cast("int").alias("ty"),
    )
    group, reach = [*by, "tx", "ty"], tile + 2
    lists = {"cells": T.IntegerType(), "cost": T.DoubleType(), "seed": T.BooleanType(), "level": T.DoubleType(), "hops": T.LongType(), "marker": T.LongType()}
    schema = T.StructType([rows.schema[c] for c in group] + [T.StructField("own", T.BooleanType()), T.StructField("moved", T.BooleanType())]
                          + [T.StructField(c, T.ArrayType(t)) for c, t in lists.items()])

    def tiles(keys: pa.Table, cells: dict[str, np.ndarray], before: dict[str, np.ndarray] | None, number: int) -> Iterator[pa.RecordBatch]:
        """A row a tile with its own pixels and, for each neighbour, one with what it sees of them."""
        own = np.flatnonzero(cells["own"])
        tile_, x, y = (cells[c][own] for c in ("tile", "x", "y"))
        reached = cells["marker"][own] != _NONE
        changed = reached if before is None else np.any([cells[c][own] != before[c][own] for c in _STATE], axis=0)
        for dx, dy, edge in ((0, 0, None), (-1, 0, x == 1), (1, 0, x == tile), (0, -1, y == 1), (0, 1, y == tile)):
            seen = np.arange(len(own)) if edge is None else np.flatnonzero(edge & reached)
            sizes = np.bincount(tile_[seen], minlength=number)
            some = np.flatnonzero(sizes)
            if not len(some):
                continue
            moved = np.bincount(tile_[seen], changed[seen], number)[some] > 0
            at = [c.combine_chunks() for c in keys.take(pa.array(some)).columns]
            at[-2:] = [pa.array((at[i].to_numpy() + d).astype(np.int32)) for i, d in ((-2, dx), (-1, dy))]
            code = (y[seen] - dy * tile) * reach + x[seen] - dx * tile
            values = [code.astype(np.int32), *(cells[c][own[seen]] for c in ("cost", "seed", *_STATE))]
            offsets = pa.array(np.append(0, np.cumsum(sizes[some])).astype(np.int32))
            yield pa.record_batch([*at, pa.array(np.full(len(some), edge is None)), pa.array(moved & (edge is not None)),
                                   *(pa.ListArray.from_arrays(offsets, pa.array(v)) for v in values)], schema.names)

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts in whole_groups(batches, group):
            seed = table.column("seed")
            start = seed.is_valid().to_numpy()
            cost = table.column("cost").to_numpy()
            cells = {c: table.column(c).to_numpy().astype(np.int64) - table.column(f"t{c}").to_numpy().astype(np.int64) * tile + 1 for c in ("x", "y")}
            cells |= {"tile": np.repeat(np.arange(len(starts)), np.diff(np.append(starts, table.num_rows))), "own": np.ones(len(cost), bool), "cost": cost, "seed": start,
                      "level": np.where(start, cost, np.inf), "hops": np.zeros(len(cost), np.int64), "marker": seed.fill_null(_NONE).to_numpy().copy()}
            _flood_tiles(cells, np.ones(len(starts), bool))
            yield from tiles(table.select(group).take(pa.array(starts)), cells, None, len(starts))

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts in whole_groups(batches, group):
            number = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, table.num_rows)))
            own, moved = (table.column(c).to_numpy() for c in ("own", "moved"))
            sizes = pc.list_value_length(table.column("cells")).to_numpy()
            flat = {c: table.column(c).combine_chunks().flatten().to_numpy(zero_copy_only=False).copy() for c in lists}
            cells = {"tile": np.repeat(number, sizes), "own": np.repeat(own, sizes), "x": flat["cells"].astype(np.int64) % reach, "y": flat["cells"].astype(np.int64) // reach, **flat}
            before = {c: flat[c].copy() for c in _STATE}
            active = (np.bincount(number, moved, len(starts)) > 0) & (np.bincount(number, own, len(starts)) > 0)
            _flood_tiles(cells, active)
            yield from tiles(table.select(group).take(pa.array(starts)), cells, before, len(starts))

    settled = cut_lineage(spread(rows, *group).sortWithinPartitions(*group).mapInArrow(first, schema))
    while not settled.filter("moved").isEmpty():
        settled = cut_lineage(spread(settled, *group).sortWithinPartitions(*group).mapInArrow(again, schema))
    found = settled.filter("own").select(*group, F.inline(F.arrays_zip("cells", "marker"))).filter(F.col("marker") != _NONE)
    place = lambda t, cell: (F.col(t).cast("bigint") * tile + cell - 1)
    return found.select(*by, place("tx", F.col("cells") % reach).cast(rows.schema["x"].dataType).alias("x"),
                        place("ty", F.floor(F.col("cells") / reach)).cast(rows.schema["y"].dataType).alias("y"), F.col("marker").alias("region"))


def merge_small_regions(regions: DataFrame, sizes: DataFrame, min_size: float | DataFrame, radius: int) -> DataFrame:
    """Regions under ``min_size`` pixels (a number, or a table ``image_id, min_pixels``) take the region most frequent around them within ``radius``; one pass
    over the original labels, ties to the lowest id."""
    counts = regions.groupBy("image_id", "region").agg(F.count("*").alias("size"))
    small = with_least(counts, min_size).filter("size < least").select("image_id", "region")
    grown = dilate(join_large(regions, small, ["image_id", "region"], "left_semi"), sizes, radius, ["image_id", "region"])
    around = join_large(grown, regions.withColumnRenamed("region", "other"), ["image_id", "x", "y"]).filter("other <> region")
    votes = around.groupBy("image_id", "region", "other").agg(F.count("*").alias("n"))
    target = votes.groupBy("image_id", "region").agg(F.min(F.struct((-F.col("n")).alias("n"), "other")).alias("best"))
    merged = join_large(regions, target.select("image_id", "region", F.col("best.other").alias("target")), ["image_id", "region"], "left")
    return merged.select("image_id", "x", "y", F.coalesce("target", "region").alias("region"))


def segment_instances(scores: DataFrame, sizes: DataFrame, limit: float = 0.5, min_pixels: float | DataFrame = 20, blur_sigma: float = 1.0,
                      dilation_radius: int = 1, min_distance: int = 5) -> DataFrame:
    """Score map ``image_id, x, y, value`` to instance regions ``image_id, x, y, region``."""
    binary = scores.filter(threshold(F.col("value"), limit, inclusive=False)).select("image_id", "x", "y")
    binary = cut_lineage(remove_small(binary, ["image_id"], min_pixels))
    smooth = gaussian_blur(binary, sizes, blur_sigma)
    grown = dilate(binary, sizes, dilation_radius)
    field = join_large(grown, smooth, ["image_id", "x", "y"], "left").withColumn("value", F.coalesce("value", F.lit(0.0)))
    # twelve digits: equal heights stay equal whatever the order of the sums
    field = cut_lineage(field.withColumn("value", F.round("value", 12)))
    peaks = spaced_peaks(field, min_distance)
    regions = seeded_regions(field, peaks)
    return merge_small_regions(regions, sizes, min_pixels, dilation_radius)
