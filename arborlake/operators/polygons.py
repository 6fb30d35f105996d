"""Polygon operators: edges, moments, exact overlap, validation, hulls."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arborlake.functions import geometry as geo
from arborlake.operators.spatial_join import box_join
from arborlake.session import cut_lineage, spread


def shape_column(polys: DataFrame) -> str:
    """``geometry`` (parts with holes) where the table has it, else ``ring``."""
    return "geometry" if "geometry" in polys.columns else "ring"


def geometry_of(polys: DataFrame) -> Column:
    return F.col("geometry") if shape_column(polys) == "geometry" else geo.one_part(F.col("ring"))


def polygon_edges(polys: DataFrame, keep: Sequence[str] = ("image_id", "poly_id")) -> DataFrame:
    """Directed edges in ring order."""
    rows = polys.select(*keep, F.posexplode(geo.edges(F.col("ring"))).alias("edge_no", "e"))
    return rows.select(*keep, "edge_no", "e.x0", "e.y0", "e.x1", "e.y1")


def polygon_moments(polys: DataFrame) -> DataFrame:
    """Adds m00, m10, m01, cx, cy and the truncated label centroid cx_px, cy_px; empty shapes are dropped.

    A ``geometry`` counts with all its parts, less its holes.
    """
    measured = geo.geometry_moments(F.col("geometry")) if shape_column(polys) == "geometry" else geo.moments(F.col("ring"))
    # filtered inside the row: a filter on the measures would be moved below them and take them twice
    rows = polys.select("*", F.inline(F.filter(F.array(measured), lambda m: m["m00"] > 0)))
    return rows.withColumns(
        {"cx_px": F.col("cx").cast("int"), "cy_px": F.col("cy").cast("int")}
    )


def with_box(polys: DataFrame) -> DataFrame:
    return polys.withColumn("b", geo.geometry_bounds(geometry_of(polys))).select("*", "b.*").drop("b")


def _lines(geometry: Column) -> Column:
    """Non-vertical edges left to right: xl, xr, yl, slope and the sign that makes exteriors count positive and
    holes negative, whatever direction their rings have."""

    def line(e: Column, sign: Column) -> Column:
        ahead = e["x0"] < e["x1"]
        return F.struct(
            F.least(e["x0"], e["x1"]).alias("xl"),
            F.greatest(e["x0"], e["x1"]).alias("xr"),
            F.when(ahead, e["y0"]).otherwise(e["y1"]).alias("yl"),
            ((e["y1"] - e["y0"]) / (e["x1"] - e["x0"])).alias("m"),
            F.when(ahead, -sign).otherwise(sign).alias("s"),
        )

    def of_ring(s: Column) -> Column:
        return geo.let(
            F.struct(
                F.filter(geo.edges(s["ring"]), lambda e: e["x0"] != e["x1"]).alias("e"),
                (s["sign"] * F.signum(geo.signed_area(s["ring"]))).alias("sign"),
            ),
            lambda v: F.transform(v["e"], lambda e: line(e, v["sign"])),
        )

    return F.flatten(F.transform(geo.signed_rings(geometry), of_ring))


def _under_both(lines: DataFrame) -> DataFrame:
    """Adds ``part``: signed integral of the lower of lines l and r over their common x range, above ``base``."""
    a, b = F.greatest("l.xl", "r.xl"), F.least("l.xr", "r.xr")

    def height(side: str, x: Column) -> Column:
        return F.col(f"{side}.yl") + F.col(f"{side}.m") * (x - F.col(f"{side}.xl")) - F.col("base")

    rows = lines.withColumns({"a": a, "b": b}).withColumns({
        "la": height("l", F.col("a")), "lb": height("l", F.col("b")),
        "ra": height("r", F.col("a")), "rb": height("r", F.col("b")),
    }).withColumns({"da": F.col("la") - F.col("ra"), "db": F.col("lb") - F.col("rb")})
    da, db, la, lb = F.col("da"), F.col("db"), F.col("la"), F.col("lb")
    low_a, low_b, span = F.least("la", "ra"), F.least("lb", "rb"), F.col("b") - F.col("a")
    at_cross = la + (lb - la) * da / (da - db)
    crossing = da / (da - db) * (low_a + at_cross) + db / (db - da) * (low_b + at_cross)
    area = span / 2 * F.when(da * db >= 0, low_a + low_b).otherwise(crossing)
    return rows.withColumn("part", F.col("l.s") * F.col("r.s") * area)


def overlap_area(left: DataFrame, right: DataFrame, by: Sequence[str] = ("image_id",)) -> DataFrame:
    """Exact area of every overlapping pair: ``by, left_id, right_id, left_area, right_area, inter``.

    Inputs carry ``by, poly_id`` and a simple ``ring``, or a ``geometry`` of parts and holes, which is then what
    counts. Copies of one shape under one key are matched once
    and expanded afterwards by :func:`expand_copies`; here ``left_id`` / ``right_id`` are the smallest ids.
    """
    by = list(by)

    def side(polys: DataFrame, name: str) -> DataFrame:
        # copies meet as partial minima; the measures are then taken on evenly spread rings
        shape = shape_column(polys)
        shapes = polys.groupBy(*by, shape).agg(F.min("poly_id").alias(f"{name}_id"))
        shapes = with_box(spread(shapes, *by, shape))
        geometry = geometry_of(shapes)
        measured = F.struct(
            geo.geometry_area(geometry).alias(f"{name}_area"), _lines(geometry).alias(f"{name}_lines"), F.col("min_y").alias(f"{name}_base"),
        )
        kept = [c for c in shapes.columns if c != shape]
        return shapes.select(*kept, F.inline(F.filter(F.array(measured), lambda m: m[f"{name}_area"] > 0)))

    pairs = box_join(side(left, "left"), side(right, "right"), by)
    lines = (
        pairs.withColumn("base", F.least("left_base", "right_base"))
        .withColumn("l", F.explode("left_lines")).drop("left_lines")
        .withColumn("r", F.explode("right_lines")).drop("right_lines")
        .filter((F.col("l.xl") < F.col("r.xr")) & (F.col("r.xl") < F.col("l.xr")))
    )
    return (
        _under_both(lines).groupBy(*by, "left_id", "right_id", "left_area", "right_area").agg(F.sum("part").alias("inter"))
    )


def iou(inter: Column, left_area: Column, right_area: Column) -> Column:
    union = left_area + right_area - inter
    return F.when(union > 0, inter / union).otherwise(F.lit(0.0))


def validate_polygons(polys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good, rejected): rejected rows carry ``reason``. Rings are not repaired silently.

    A ``geometry`` is rejected when one of its rings is. Every ring is judged once, in evenly filled tasks.
    """
    whole = shape_column(polys) == "geometry"
    # written, as both sides read it and a filter on the reason would be moved to before the rings are spread
    flagged = cut_lineage(spread(polys).withColumn("reason", geo.geometry_reject_reason(F.col("geometry")) if whole else geo.reject_reason(F.col("ring"))))
    good = flagged.filter(F.col("reason").isNull()).drop("reason")
    return good, flagged.filter(F.col("reason").isNotNull())


def convex_hull(polys: DataFrame) -> DataFrame:
    """Adds the hull ring, its area and its perimeter."""
    measured = geo.let(
        geo.convex_hull(F.col("ring")),
        lambda h: F.struct(h.alias("hull"), geo.area(h).alias("hull_area"), geo.perimeter(h).alias("hull_perimeter")),
    )
    return polys.withColumn("h", measured).select("*", "h.*").drop("h")


def shape_filter(polys: DataFrame, min_area: float, max_aspect: float, min_solidity: float) -> DataFrame:
    return polys.filter(geo.shape_passes(F.col("ring"), min_area, max_aspect, min_solidity))


def close_rings(polys: DataFrame) -> DataFrame:
    return polys.withColumn("ring", geo.close_ring(F.col("ring"))).filter(F.col("ring").isNotNull())


def first_feature_center(features: DataFrame, by: Sequence[str] = ("image_id",)) -> DataFrame:
    """Centroid and bounds of the first feature of every file."""
    first = features.groupBy(*by).agg(F.min_by("ring", "poly_id").alias("ring"), F.min("poly_id").alias("poly_id"))
    return with_box(polygon_moments(first)).select(*by, "poly_id", "cx", "cy", "min_x", "min_y", "max_x", "max_y")
