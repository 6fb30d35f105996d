"""Connected components of an edge list and clusters of near points."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arborlake.operators.ranking import ordered_total
from arborlake.session import cut_lineage


def components(edges: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Smallest node of each component: ``by, node, component`` for every node that has an edge.

    Edges carry ``by, u, v``. Large-star and small-star steps alternate: every round replaces an edge by
    one to the smallest neighbour, which keeps the number of edges bounded and needs few rounds even for
    long chains. A hot node only meets minimum aggregates and joins that adaptive execution can split.
    Each round ends in a reliable checkpoint; the loop ends when the edges form stars.
    """
    by = list(by)
    down = edges.select(*by, F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct()
    down = cut_lineage(down)
    while not _is_star(down, by):
        down = cut_lineage(_small_star(_large_star(down, by), by))
    stars = down.select(*by, F.col("u").alias("node"), F.col("v").alias("component"))
    roots = down.select(*by, F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return stars.unionByName(roots)


def _large_star(down: DataFrame, by: list[str]) -> DataFrame:
    """Larger neighbours of a node move to the smallest of its neighbours and itself."""
    ways = down.unionByName(down.select(*by, F.col("v").alias("u"), F.col("u").alias("v")))
    low = ways.groupBy(*by, "u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    moved = ways.filter("v > u").join(low, [*by, "u"]).select(*by, F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.filter("u <> v").distinct()


def _small_star(down: DataFrame, by: list[str]) -> DataFrame:
    """Smaller neighbours of a node, and the node, move to the smallest of them."""
    low = down.groupBy(*by, "u").agg(F.min("v").alias("m"))
    moved = down.join(low, [*by, "u"]).select(*by, F.col("v").alias("u"), F.col("m").alias("v"))
    own = low.select(*by, "u", F.col("m").alias("v"))
    return moved.unionByName(own).filter("u <> v").distinct()


def _is_star(down: DataFrame, by: list[str]) -> bool:
    """No node has two parents, and no parent is a child."""
    ends = down.select(*by, F.col("u").alias("n"), F.lit(1).alias("child"), F.lit(0).alias("parent")).unionByName(
        down.select(*by, F.col("v").alias("n"), F.lit(0).alias("child"), F.lit(1).alias("parent"))
    )
    seen = ends.groupBy(*by, "n").agg(F.sum("child").alias("c"), F.max("parent").alias("p"))
    return seen.filter("c > 1 or (c = 1 and p = 1)").isEmpty()


def eps_clusters(points: DataFrame, eps: float = 0.5, refine: int = 8, levels: int = 3) -> DataFrame:
    """Components of the graph joining points at most ``eps`` apart, as density clustering with one sample does.

    Points carry ``point_id, x, y``; returns ``point_id, cluster`` with dense ids in order of first row.

    Points in one cell of side eps/sqrt(2) always belong together, so cells, not points, are the nodes. Two
    cells are joined when some pair of their points is near enough. That is answered on a finer grid: fine
    cells whose far corners are within ``eps`` prove it, fine cells whose near corners are not rule it out,
    and only the doubtful ones are split further; what is left is compared point by point.
    """
    side = float(eps) / (2.0**0.5) * 0.999999
    places = points.select("x", "y").distinct()
    grid = places.withColumns({"cx": F.floor(F.col("x") / side), "cy": F.floor(F.col("y") / side)})
    cells = grid.select("cx", "cy").distinct()
    reach = F.sequence(F.lit(-2), F.lit(2))
    around = (
        cells.withColumn("dx", F.explode(reach)).withColumn("dy", F.explode(reach))
        .filter("(dy > 0 or (dy = 0 and dx > 0))")
        .select("cx", "cy", (F.col("cx") + F.col("dx")).alias("ox"), (F.col("cy") + F.col("dy")).alias("oy"))
    )
    doubtful = cut_lineage(around.join(cells.withColumnsRenamed({"cx": "ox", "cy": "oy"}), ["ox", "oy"]))
    sure = doubtful.limit(0)
    size = side
    # the pairs of fine cells still in doubt, at first the coarse cells themselves
    open_pairs = doubtful.select(
        "cx", "cy", "ox", "oy", F.col("cx").alias("ax"), F.col("cy").alias("ay"), F.col("ox").alias("bx"), F.col("oy").alias("by")
    )
    for level in range(levels):
        if open_pairs.isEmpty():
            break
        coarse, size = size, size / refine
        parts = grid.select(
            F.floor(F.col("x") / coarse).alias("px"), F.floor(F.col("y") / coarse).alias("py"),
            F.floor(F.col("x") / size).alias("fx"), F.floor(F.col("y") / size).alias("fy"),
        ).distinct()
        a = parts.withColumnsRenamed({"px": "ax", "py": "ay", "fx": "afx", "fy": "afy"})
        b = parts.withColumnsRenamed({"px": "bx", "py": "by", "fx": "bfx", "fy": "bfy"})
        split = open_pairs.join(a, ["ax", "ay"]).join(b, ["bx", "by"])
        gap_x, gap_y = F.abs(F.col("afx") - F.col("bfx")), F.abs(F.col("afy") - F.col("bfy"))
        far = F.sqrt(F.pow(gap_x + 1, 2) + F.pow(gap_y + 1, 2)) * size
        near = F.sqrt(F.pow(F.greatest(gap_x - 1, F.lit(0)), 2) + F.pow(F.greatest(gap_y - 1, F.lit(0)), 2)) * size
        # a hair of slack on both sides leaves rounding doubts to the exact comparison
        split = cut_lineage(
            split.withColumns({"proved": far * 1.000001 <= eps, "possible": near * 0.999999 <= eps}).filter("possible")
            .select("cx", "cy", "ox", "oy", F.col("afx").alias("ax"), F.col("afy").alias("ay"),
                    F.col("bfx").alias("bx"), F.col("bfy").alias("by"), "proved")
        )
        proved = split.filter("proved").select("cx", "cy", "ox", "oy").distinct()
        sure = sure.unionByName(proved)
        open_pairs = cut_lineage(
            split.filter("not proved").drop("proved").join(proved, ["cx", "cy", "ox", "oy"], "left_anti")
        )
    fine = grid.select(F.floor(F.col("x") / size).alias("fx"), F.floor(F.col("y") / size).alias("fy"), "x", "y")
    a = fine.withColumnsRenamed({"fx": "ax", "fy": "ay", "x": "xa", "y": "ya"})
    b = fine.withColumnsRenamed({"fx": "bx", "fy": "by", "x": "xb", "y": "yb"})
    gap = F.sqrt(F.pow(F.col("xa") - F.col("xb"), 2) + F.pow(F.col("ya") - F.col("yb"), 2))
    checked = open_pairs.join(a, ["ax", "ay"]).join(b, ["bx", "by"]).filter(gap <= eps)
    linked = sure.unionByName(checked.select("cx", "cy", "ox", "oy")).distinct()
    node = lambda x, y: F.struct(F.col(x).alias("cx"), F.col(y).alias("cy"))
    groups = components(linked.select(node("cx", "cy").alias("u"), node("ox", "oy").alias("v")))
    cell_of = points.withColumn("node", F.struct(F.floor(F.col("x") / side).alias("cx"), F.floor(F.col("y") / side).alias("cy")))
    rooted = cell_of.join(groups, "node", "left").withColumn("root", F.coalesce("component", "node"))
    firsts = rooted.groupBy("root").agg(F.min("point_id").alias("first")).withColumn("one", F.lit(1))
    numbered = ordered_total(firsts, ["first"], "one", "cluster").select("root", F.col("cluster").cast("int").alias("cluster"))
    return rooted.join(numbered, "root").select("point_id", "cluster")
