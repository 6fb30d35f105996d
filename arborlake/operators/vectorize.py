"""Pixels to polygons: outlines, region properties, ellipses."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from arborlake.functions import geometry as geo
from arborlake.functions.coords import pixel_to_geo
from arborlake.operators.blocks import whole_groups
from arborlake.operators.components import with_least
from arborlake.operators.morphology import erode
from arborlake.session import cut_lineage, join_large, join_small, spread

BLOCK = 256
SQUARE = 16  # blocks along the side of a square in which chains are joined
_EAST, _SOUTH, _WEST, _NORTH = 0, 1, 2, 3


def _straight_runs(pixels: DataFrame, by: list[str]) -> DataFrame:
    """Boundary of the pixel squares as maximal straight directed runs, foreground on the right.

    ``sx, sy`` is the start corner, ``ex, ey`` the end corner. A run never passes a corner where diagonal
    pixels touch, so turns can be chosen at its ends.
    """
    present = pixels.select(*by, "x", "y").withColumn("here", F.lit(True))
    sides = ((_EAST, 0, -1), (_SOUTH, 1, 0), (_WEST, 0, 1), (_NORTH, -1, 0))
    asked = present.drop("here").withColumn("s", F.explode(F.array(*[
        F.struct(F.lit(d).alias("dir"), F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for d, dx, dy in sides
    ])))
    asked = asked.select(*by, F.col("x").alias("px"), F.col("y").alias("py"), "s.dir",
                         (F.col("x") + F.col("s.dx")).alias("x"), (F.col("y") + F.col("s.dy")).alias("y"))
    edges = join_large(asked, present, [*by, "x", "y"], "left_anti")
    flat = F.col("dir").isin(_EAST, _WEST)
    # line: the raster line of the side; along: position on it
    edges = edges.select(*by, "dir", F.when(flat, F.col("py")).otherwise(F.col("px")).alias("line"),
                         F.when(flat, F.col("px")).otherwise(F.col("py")).alias("along"))
    order = Window.partitionBy(*by, "dir", "line").orderBy("along")
    runs = edges.withColumn("g", F.col("along") - F.row_number().over(order))
    runs = runs.groupBy(*by, "dir", "line", "g").agg(F.min("along").alias("a"), (F.max("along") + 1).alias("b"))
    d, line, a, b = F.col("dir"), F.col("line"), F.col("a"), F.col("b")
    return runs.select(
        *by, "dir",
        F.when(d == _EAST, a).when(d == _WEST, b).when(d == _SOUTH, line + 1).otherwise(line).alias("sx"),
        F.when(d == _EAST, line).when(d == _WEST, line + 1).when(d == _SOUTH, a).otherwise(b).alias("sy"),
        F.when(d == _EAST, b).when(d == _WEST, a).when(d == _SOUTH, line + 1).otherwise(line).alias("ex"),
        F.when(d == _EAST, line).when(d == _WEST, line + 1).when(d == _SOUTH, b).otherwise(a).alias("ey"),
    )


def _code(x: str, y: str) -> Column:
    """Corner code times four: room for the direction, raster order kept."""
    return F.shiftleft(F.col(y).cast("bigint"), 34) + F.shiftleft(F.col(x).cast("bigint"), 2)


def _linked_runs(runs: DataFrame, by: list[str], connectivity: int) -> DataFrame:
    """Adds ``seg`` and ``next``. Where diagonal pixels touch, 8-connectivity turns left, 4-connectivity right."""
    nodes = runs.withColumn("seg", _code("sx", "sy") + F.col("dir"))
    starts = nodes.select(*by, F.col("sx").alias("ex"), F.col("sy").alias("ey"), F.col("dir").alias("turned"), F.col("seg").alias("next"))
    left_turn = ((F.col("dir") + 3) % 4 == F.col("turned")).cast("int")
    rank = 1 - left_turn if connectivity == 8 else left_turn
    joined = join_large(nodes, starts, [*by, "ex", "ey"])
    picked = joined.groupBy(*by, "seg").agg(F.min(F.struct(rank.alias("r"), "next")).alias("n"), F.first("sx").alias("sx"), F.first("sy").alias("sy"))
    return picked.select(*by, "seg", F.col("n.next").alias("next"), "sx", "sy")


def _follow(seg: np.ndarray, after: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Head, place behind the head and whether the chain is closed, for the segments of many groups at once.

    Segments are sorted in their group; ``starts`` are the places of the groups. Open chains start where nothing in
    their group leads, rings at their smallest segment. Pointers are doubled, so a chain takes the log of its length.
    """
    n = len(seg)
    sizes = np.diff(np.append(starts, n))
    group = np.repeat(np.arange(len(starts)), sizes)
    codes, place = np.unique(np.concatenate([seg, after]), return_inverse=True)
    own, wanted = group * len(codes) + place[:n], group * len(codes) + place[n:]
    at = np.minimum(np.searchsorted(own, wanted), n - 1)
    hit = np.flatnonzero(own[at] == wanted)
    before = np.arange(n)
    before[at[hit]] = hit
    entered = np.zeros(n, bool)
    entered[at[hit]] = True
    rounds = int(sizes.max()).bit_length()
    jump, low = before, np.arange(n)
    for _ in range(rounds):
        low, jump = np.minimum(low, low[jump]), jump[jump]
    closed = entered[jump]
    first = closed & (low == np.arange(n))
    head = np.where(first, np.arange(n), before)
    behind = (entered & ~first).astype(np.int64)
    for _ in range(rounds):
        behind, head = behind + behind[head], head[head]
    return head, behind, closed


def _chains(linked: DataFrame, by: list[str]) -> DataFrame:
    """Runs of one block linked into closed rings (``next`` is null) and open chains: ``by, seg, next, points``."""
    group = [*by, "bx", "by_"]
    point = T.ArrayType(T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())]))
    schema = T.StructType([linked.schema[c] for c in by] + [
        T.StructField("seg", T.LongType()), T.StructField("next", T.LongType()), T.StructField("points", point)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts in whole_groups(batches, group):
            seg, after, x, y = (table.column(c).to_numpy() for c in ("seg", "next", "sx", "sy"))
            head, behind, closed = _follow(seg, after, starts)
            order = np.lexsort((behind, head))
            begin = np.flatnonzero(np.diff(head[order], prepend=-1))
            heads, last = head[order][begin], order[np.append(begin[1:], len(order)) - 1]
            xy = [pa.array(c[order].astype(float)) for c in (x, y)]
            points = pa.ListArray.from_arrays(pa.array(np.append(begin, len(order)), pa.int32()), pa.StructArray.from_arrays(xy, ["x", "y"]))
            kept = table.select(by).take(pa.array(heads)).combine_chunks()
            columns = [*(kept.column(c).combine_chunks() for c in by), pa.array(seg[heads]), pa.array(after[last], mask=closed[heads]), points]
            yield pa.record_batch(columns, schema.names)

    # chains of a block are few bytes but much work: a fixed number of tasks
    return spread(linked, *group).sortWithinPartitions(*group, "seg").mapInArrow(run, schema)


def rings(pixels: DataFrame, by: Sequence[str], connectivity: int = 8, block: int = BLOCK) -> DataFrame:
    """All boundary rings: ``by, ring_id, ring, signed``. Outer rings have positive area, holes negative.

    Runs are linked inside fixed blocks first; chains that leave a block are joined in squares of blocks, and only
    what leaves those by pointer doubling.
    """
    by = list(by)
    linked = _linked_runs(_straight_runs(pixels, by), by, connectivity)
    linked = linked.withColumns({"bx": F.floor(F.col("sx") / block).cast("int"), "by_": F.floor(F.col("sy") / block).cast("int")})
    chains = cut_lineage(_chains(linked, by))
    closed = chains.filter("next is null").select(*by, F.col("seg").alias("ring_id"), F.col("points").alias("ring"))
    opened = chains.filter("next is not null")
    if not opened.isEmpty():
        closed = closed.unionByName(_join_chains(opened, by, SQUARE * block))
    return closed.withColumn("signed", geo.signed_area(F.col("ring")))


def _join_near(chains: DataFrame, by: list[str], side: int) -> DataFrame:
    """Chains joined in squares of ``side``, without their points: ``by, seg, head, place, head_next, least``.

    ``head`` is the first chain of the joined one, ``place`` where a chain stands in it, ``head_next`` where it leads,
    null when it is closed, and ``least`` the smallest segment in it. A square holds no more than its blocks' border.
    """
    group = [*by, "bx", "by_"]
    first = F.get("points", F.lit(0))
    rows = chains.select(*by, F.floor(first["x"] / side).cast("int").alias("bx"), F.floor(first["y"] / side).cast("int").alias("by_"), "seg", "next")
    schema = T.StructType([rows.schema[c] for c in by] + [T.StructField(c, T.LongType()) for c in ("seg", "head", "place", "head_next", "least")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts in whole_groups(batches, group):
            seg, after = table.column("seg").to_numpy(), table.column("next").to_numpy()
            head, behind, closed = _follow(seg, after, starts)
            order = np.lexsort((behind, head))
            begin = np.flatnonzero(np.diff(head[order], prepend=-1))
            last, least = np.empty(len(seg), np.int64), np.empty(len(seg), np.int64)
            last[head[order][begin]] = after[order[np.append(begin[1:], len(order)) - 1]]
            least[head[order][begin]] = np.minimum.reduceat(seg[order], begin)
            columns = [*(table.column(c).combine_chunks() for c in by), pa.array(seg), pa.array(seg[head]), pa.array(behind),
                       pa.array(last[head], mask=closed), pa.array(least[head])]
            yield pa.record_batch(columns, schema.names)

    return cut_lineage(spread(rows, *group).sortWithinPartitions(*group, "seg").mapInArrow(run, schema))


def _join_chains(chains: DataFrame, by: list[str], side: int) -> DataFrame:
    """Rings from chains that cross blocks: in squares of ``side``, then in log(squares per ring) rounds."""
    near = _join_near(chains, by, side)
    placed = near.filter("head_next is null").select(*by, "seg", F.col("least").alias("ring_id"), F.lit(0).cast("bigint").alias("left"), "place")
    far = near.filter("head_next is not null")
    if not far.isEmpty():
        ranked = _join_far(far.filter("seg = head").select(*by, "seg", F.col("head_next").alias("next"), "least"), by)
        ranked = ranked.withColumnRenamed("seg", "head")
        placed = placed.unionByName(join_large(far, ranked, [*by, "head"]).select(*by, "seg", "ring_id", "left", "place"))
    parts = join_large(chains, placed, [*by, "seg"])
    entry = F.struct((-F.col("left")).alias("o"), "place", "seg", "points")
    listed = parts.groupBy(*by, "ring_id").agg(F.array_sort(F.collect_list(entry)).alias("p"))
    # a ring starts at its smallest segment
    at = F.array_position("p.seg", F.col("ring_id")).cast("int")
    turned = F.concat(F.slice("p", at, F.size("p")), F.slice("p", F.lit(1), at - 1))
    return listed.withColumn("p", turned).select(*by, "ring_id", F.flatten(F.transform("p", lambda s: s["points"])).alias("ring"))


def _join_far(chains: DataFrame, by: list[str]) -> DataFrame:
    """``by, seg, ring_id, left``: the ring of every chain by its smallest segment, and the chains that are left to go in it."""
    low = cut_lineage(chains.select(*by, "seg", F.col("next").alias("jump"), F.least("seg", "next").alias("first"), F.col("least").alias("ring_id")))
    while True:
        ahead = low.select(*by, F.col("seg").alias("jump"), F.col("jump").alias("jump2"), F.col("first").alias("first2"), F.col("ring_id").alias("id2"))
        step = join_large(low, ahead, [*by, "jump"]).select(
            *by, "seg", F.col("jump2").alias("jump"), F.least("first", "first2").alias("first"), F.least("ring_id", "id2").alias("ring_id"),
            ((F.col("first2") < F.col("first")) | (F.col("id2") < F.col("ring_id"))).alias("moved"))
        step = cut_lineage(step)
        done = step.filter("moved").isEmpty()
        low = step.drop("moved")
        if done:
            break
    heads = cut_lineage(join_large(chains.select(*by, "seg", "next"), low.select(*by, "seg", "first", "ring_id"), [*by, "seg"]))
    # steps left until the ring's first chain comes round again
    rank = cut_lineage(heads.select(*by, "seg", F.when(F.col("next") != F.col("first"), F.col("next")).alias("jump"), F.lit(1).cast("bigint").alias("left")))
    while not rank.filter("jump is not null").isEmpty():
        ahead = rank.select(*by, F.col("seg").alias("jump"), F.col("jump").alias("jump2"), F.col("left").alias("left2"))
        rank = cut_lineage(join_large(rank, ahead, [*by, "jump"], "left").select(
            *by, "seg", F.col("jump2").alias("jump"), (F.col("left") + F.coalesce("left2", F.lit(0))).alias("left")))
    return join_large(heads, rank.select(*by, "seg", "left"), [*by, "seg"]).select(*by, "seg", "ring_id", "left")


def drop_straight(ring: Column) -> Column:
    """Remove points on the straight line between their neighbours."""

    def clean(r: Column) -> Column:
        n = F.size(r)
        around = lambda i: (F.get(r, (i + n - 1) % n), F.get(r, (i + 1) % n))

        def bends(p: Column, i: Column) -> Column:
            a, b = around(i)
            return (p["x"] - a["x"]) * (b["y"] - a["y"]) != (p["y"] - a["y"]) * (b["x"] - a["x"])

        return F.filter(r, bends)

    return geo.let(ring, clean)


def contours(pixels: DataFrame, by: Sequence[str] = ("image_id",)) -> DataFrame:
    """Outer ring of every 8-connected component: ``by, component, ring, area``.

    ``component`` is the code of the component's first pixel in raster order. Rings follow pixel edges, so
    ring area less holes is the pixel count.
    """
    by = list(by)
    outer = rings(pixels, by).filter("signed > 0").withColumn("ring", drop_straight(F.col("ring")))
    first = F.array_min(F.transform("ring", lambda p: F.struct(p["y"].alias("y"), p["x"].alias("x"))))
    rows = outer.withColumn("first", first)
    code = F.shiftleft(F.col("first.y").cast("bigint"), 32) + F.col("first.x").cast("bigint")
    return rows.select(*by, code.alias("component"), "ring", F.col("signed").alias("area"))


def contours_from_labels(regions: DataFrame) -> DataFrame:
    """Largest outer ring per region: ``image_id, region, ring, area``."""
    outer = contours(regions, ["image_id", "region"])
    best = outer.groupBy("image_id", "region").agg(F.max(F.struct("area", (-F.col("component")).alias("o"), "ring")).alias("b"))
    return best.select("image_id", "region", "b.ring", "b.area")


def to_map(polys: DataFrame, meta: DataFrame) -> DataFrame:
    """Ring points through the affine map of their image."""
    rows = join_small(polys, meta.select("image_id", F.struct(*"abcdef").alias("t")), "image_id")

    def place(p: Column) -> Column:
        gx, gy = pixel_to_geo(p["x"], p["y"], lambda c: F.col(f"t.{c}"))
        return F.struct(gx.alias("x"), gy.alias("y"))

    return rows.withColumn("ring", F.transform("ring", place)).drop("t")


def region_props(regions: DataFrame, by: Sequence[str] = ("image_id", "region")) -> DataFrame:
    """Pixel count and first and second moment sums per region, map-side combined."""
    x, y = F.col("x").cast("bigint"), F.col("y").cast("bigint")
    return regions.groupBy(*by).agg(
        F.count("*").alias("area"), F.sum(x).alias("sx"), F.sum(y).alias("sy"),
        F.sum(x * x).alias("sxx"), F.sum(y * y).alias("syy"), F.sum(x * y).alias("sxy"),
    )


def fit_ellipses(regions: DataFrame, sizes: DataFrame, min_pixels: float | DataFrame = 20, erosion_radius: int = 1, tightness: float = 1.0) -> DataFrame:
    """Moment ellipse of every eroded region: centre, full axes in pixels, angle in degrees, half axes ``ra, rb``
    scaled by ``tightness``. Regions under ``min_pixels`` (a number, or a table by image) or with under 5 pixels after erosion are left out."""
    big = with_least(region_props(regions), min_pixels).filter("area >= least").select("image_id", "region")
    core = erode(regions.join(big, ["image_id", "region"], "left_semi"), sizes, erosion_radius, ["image_id", "region"])
    m = region_props(core).filter("area >= 5")
    n = F.col("area")
    m = m.withColumns({"x0": F.col("sx") / n, "y0": F.col("sy") / n})
    # a pixel is a unit square, not a point: its own variance is 1/12
    m = m.withColumns({
        "vx": F.col("sxx") / n - F.col("x0") * F.col("x0") + F.lit(1.0 / 12), "vy": F.col("syy") / n - F.col("y0") * F.col("y0") + F.lit(1.0 / 12),
        "vxy": F.col("sxy") / n - F.col("x0") * F.col("y0"),
    })
    m = m.withColumns({"mid": (F.col("vx") + F.col("vy")) / 2, "dev": F.sqrt(F.pow((F.col("vx") - F.col("vy")) / 2, 2) + F.pow(F.col("vxy"), 2))})
    m = m.withColumns({
        "axis_a": 4 * F.sqrt(F.col("mid") + F.col("dev")), "axis_b": 4 * F.sqrt(F.greatest(F.col("mid") - F.col("dev"), F.lit(0.0))),
        "angle_deg": F.degrees(F.atan2(2 * F.col("vxy"), F.col("vx") - F.col("vy")) / 2),
    })
    return m.select("image_id", "region", "area", "x0", "y0", "axis_a", "axis_b", "angle_deg",
                    (F.col("axis_a") / 2 * tightness).alias("ra"), (F.col("axis_b") / 2 * tightness).alias("rb"))


def ellipse_polygons(ellipses: DataFrame, meta: DataFrame, n: int = 100, min_area: float = 0.0, max_aspect: float = math.inf,
                     min_solidity: float = 0.0) -> DataFrame:
    """Closed ellipse rings of ``n`` points in map coordinates that pass the shape limits, with properties."""
    angle = F.radians("angle_deg")
    steps = F.sequence(F.lit(0), F.lit(n - 1))

    def point(i: Column) -> Column:
        t = i * F.lit(2.0 * math.pi / (n - 1))
        x = F.col("x0") + F.col("ra") * F.cos(t) * F.cos(angle) - F.col("rb") * F.sin(t) * F.sin(angle)
        y = F.col("y0") + F.col("ra") * F.cos(t) * F.sin(angle) + F.col("rb") * F.sin(t) * F.cos(angle)
        return F.struct(x.alias("x"), y.alias("y"))

    rows = to_map(ellipses.withColumn("ring", geo.close_ring(F.transform(steps, point))), meta)
    rows = join_small(rows, meta.select("image_id", *"abcdef"), "image_id")
    cx, cy = pixel_to_geo(F.col("x0"), F.col("y0"), F.col)
    rows = rows.withColumns({"map_area": geo.area(F.col("ring")), "cx": cx, "cy": cy})
    rows = rows.filter(geo.shape_passes(geo.open_ring(F.col("ring")), min_area, max_aspect, min_solidity))
    properties = F.struct(
        F.col("region").alias("region_label"), F.col("map_area").alias("area"), F.array("cx", "cy").alias("ellipse_center"),
        F.array("axis_a", "axis_b").alias("ellipse_axes"), F.col("angle_deg").alias("ellipse_angle_deg"),
    )
    return rows.select("image_id", "region", "ring", "map_area", properties.alias("properties"))
