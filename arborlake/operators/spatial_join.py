"""Spatial joins as equi-joins on grid cells.

Boxes use one grid per size class (cell side a power of four at least as long as the box), so a box
covers at most four cells of its own grid whatever the mix of sizes. A pair is looked up once, in the
grid of its larger box, and kept only in the cell that holds the larger lower-left corner: no distinct.
Hot cells are ordinary equi-join keys, which adaptive execution splits.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arborlake.session import cut_lineage, join_large

# 4^20 units are longer than any coordinate range, 4^-12 shorter than any box that counts; cell numbers stay exact
MIN_LEVEL, MAX_LEVEL = -12, 20
BOX = ("min_x", "min_y", "max_x", "max_y")


def _level() -> Column:
    side = F.greatest(F.col("max_x") - F.col("min_x"), F.col("max_y") - F.col("min_y"))
    level = F.ceil(F.log2(side) / 2).cast("int")
    return F.when(side <= 0, F.lit(MIN_LEVEL)).otherwise(F.greatest(F.least(level, F.lit(MAX_LEVEL)), F.lit(MIN_LEVEL)))


def _present_levels(df: DataFrame) -> list[int]:
    """Size classes that occur: a few dozen numbers at most, whatever the input."""
    return sorted(r["level"] for r in df.select("level").distinct().collect())


def _spread(df: DataFrame, own_turn: str, up_turn: str, other_levels: list[int], strict: bool, side: str) -> DataFrame:
    """One row per grid cell: in the own grid, and in the grids of larger boxes of the other side."""
    own = F.struct(F.lit(own_turn).alias("turn"), F.col("level").alias("grid"))
    up = F.filter(
        F.array(*[F.struct(F.lit(up_turn).alias("turn"), F.lit(n).alias("grid")) for n in other_levels]),
        lambda g: (g["grid"] > F.col("level")) if strict else (g["grid"] >= F.col("level")),
    )
    grids = F.concat(F.array(own), up) if other_levels else F.array(own)
    rows = df.withColumn("g", F.explode(grids)).select("*", "g.turn", "g.grid").drop("g", "level")
    size = F.pow(F.lit(4.0), F.col("grid"))
    xs = F.sequence(F.floor(F.col("min_x") / size), F.floor(F.col("max_x") / size))
    ys = F.sequence(F.floor(F.col("min_y") / size), F.floor(F.col("max_y") / size))
    rows = rows.withColumn("cell_x", F.explode(xs)).withColumn("cell_y", F.explode(ys))
    return rows.withColumnsRenamed({c: f"{side}_{c}" for c in BOX})


def _join_cells(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Sorted join on cells. Rows are told apart by a hash of the cell first: keys in order, such as long names that
    begin alike, would be compared as wholes at every step of the sort."""
    own, other = dict(left.dtypes), dict(right.dtypes)
    place = F.xxhash64(*[k for k in keys if own[k] == other[k]])
    return join_large(left.withColumn("_place", place), right.withColumn("_place", place), ["_place", *keys]).drop("_place")


def box_join(left: DataFrame, right: DataFrame, by: Sequence[str]) -> DataFrame:
    """Pairs of rows with equal ``by`` whose boxes overlap in more than a line.

    Both sides carry ``by`` and min_x, min_y, max_x, max_y. Other columns pass through and must differ
    in name; the box columns are dropped. Each side is materialised once and read twice.
    """
    by = list(by)
    left = cut_lineage(left.withColumn("level", _level()))
    right = cut_lineage(right.withColumn("level", _level()))
    # turn "l": the right box sets the grid (it is as large or larger); turn "r": the left box does
    left_rows = _spread(left, "r", "l", _present_levels(right), False, "l")
    right_rows = _spread(right, "l", "r", _present_levels(left), True, "r")
    pairs = _join_cells(left_rows, right_rows, [*by, "turn", "grid", "cell_x", "cell_y"])
    size = F.pow(F.lit(4.0), F.col("grid"))
    pairs = pairs.filter(
        (F.col("l_min_x") < F.col("r_max_x")) & (F.col("r_min_x") < F.col("l_max_x"))
        & (F.col("l_min_y") < F.col("r_max_y")) & (F.col("r_min_y") < F.col("l_max_y"))
        & (F.floor(F.greatest("l_min_x", "r_min_x") / size) == F.col("cell_x"))
        & (F.floor(F.greatest("l_min_y", "r_min_y") / size) == F.col("cell_y"))
    )
    return pairs.drop("turn", "grid", "cell_x", "cell_y", *[f"{s}_{c}" for s in "lr" for c in BOX])


def distance_join(left: DataFrame, right: DataFrame, by: Sequence[str], eps: float) -> DataFrame:
    """Pairs within ``eps`` of each other, with ``distance``.

    Sides carry ``by`` and (lx, ly) / (rx, ry). The left point goes to its own cell of side ``2 * eps``, the
    right point to the cells that its reach touches: two in each direction, three where it ends on a cell's border.
    """
    by, size, side = list(by), F.lit(float(eps)), F.lit(2 * float(eps))

    def reached(c: str) -> Column:
        # a hair more than half a cell, as the quotient is rounded
        return F.explode(F.sequence(F.floor(F.col(c) / side - 0.500001), F.floor(F.col(c) / side + 0.500001)))

    left = left.withColumn("cell_x", F.floor(F.col("lx") / side)).withColumn("cell_y", F.floor(F.col("ly") / side))
    right = right.withColumn("cell_x", reached("rx")).withColumn("cell_y", reached("ry"))
    dx, dy = F.col("lx") - F.col("rx"), F.col("ly") - F.col("ry")
    pairs = _join_cells(left, right, [*by, "cell_x", "cell_y"]).withColumn("distance", F.sqrt(dx * dx + dy * dy))
    return pairs.filter(F.col("distance") <= size).drop("cell_x", "cell_y")


def nearest_join(points: DataFrame, candidates: DataFrame, by: Sequence[str], limit: float, rounds: int = 3) -> DataFrame:
    """Nearest candidate of every point within ``limit``; ties go to the smallest ``candidate_id``.

    Points carry ``by, point_id, lx, ly``; candidates ``by, candidate_id, rx, ry``. Returns
    ``by, point_id, candidate_id, distance``; a point without a candidate in reach is left out.

    Copies collapse to one place each before the search. The search starts in small cells and goes to
    cells four times as long, up to ``limit``, for the places that are still open: a crowded spot is
    answered in its small cells, where few candidates are near, and only thin spots pay for the long reach.
    """
    by = list(by)
    places = cut_lineage(candidates.groupBy(*by, "rx", "ry").agg(F.min("candidate_id").alias("candidate_id")))
    open_places = cut_lineage(points.select(*by, "lx", "ly").distinct())
    found = None
    for step in range(rounds - 1, -1, -1):
        pairs = distance_join(open_places, places, by, float(limit) / 4**step)
        best = pairs.groupBy(*by, "lx", "ly").agg(F.min(F.struct("distance", "candidate_id")).alias("best"))
        best = cut_lineage(best)
        found = best if found is None else found.unionByName(best)
        if step:
            open_places = cut_lineage(join_large(open_places, best, [*by, "lx", "ly"], "left_anti"))
            if open_places.isEmpty():
                break
    return join_large(points, found, [*by, "lx", "ly"]).select(*by, "point_id", "best.candidate_id", "best.distance")
