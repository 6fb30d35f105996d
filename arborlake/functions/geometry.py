"""Ring expressions on ``ARRAY<STRUCT<x: DOUBLE, y: DOUBLE>>``; one ring stays one row, nothing is shuffled."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, fn) -> Column:
    """``fn(value)`` with ``value`` computed once, however often ``fn`` mentions it."""
    return F.get(F.transform(F.array(value), fn), F.lit(0))


def as_ring(points: Column) -> Column:
    return F.transform(points, lambda p: F.struct(p["x"].cast("double").alias("x"), p["y"].cast("double").alias("y")))


def _is_closed(ring: Column) -> Column:
    return (F.size(ring) > 1) & (F.get(ring, F.lit(0)) == F.get(ring, F.size(ring) - 1))


def close_ring(ring: Column) -> Column:
    """Append the first point unless it is already the last; null below three points."""
    return let(
        ring,
        lambda r: F.when(F.size(r) < 3, F.lit(None)).when(_is_closed(r), r).otherwise(
            F.concat(r, F.slice(r, F.lit(1), F.lit(1)))
        ),
    )


def open_ring(ring: Column) -> Column:
    """Drop a repeated last point."""
    return let(ring, lambda r: F.when(_is_closed(r), F.slice(r, F.lit(1), F.size(r) - 1)).otherwise(r))


def without_repeats(ring: Column) -> Column:
    """The open ring without points that repeat the one before."""

    def changes(r: Column) -> Column:
        return F.filter(r, lambda p, i: (i == 0) | (p != F.get(r, i - 1)))

    return open_ring(let(ring, changes))


def edges(ring: Column) -> Column:
    """Directed edges x0,y0,x1,y1 of the ring, the last one back to the first point."""
    return let(
        ring,
        lambda r: F.zip_with(
            r,
            F.concat(F.slice(r, F.lit(2), F.size(r)), F.slice(r, F.lit(1), F.lit(1))),
            lambda a, b: F.struct(a["x"].alias("x0"), a["y"].alias("y0"), b["x"].alias("x1"), b["y"].alias("y1")),
        ),
    )


def _cross(e: Column, o: Column) -> Column:
    """Cross product of an edge's ends relative to ``o``: projected coordinates are large, differences are not."""
    return (e["x0"] - o["x"]) * (e["y1"] - o["y"]) - (e["x1"] - o["x"]) * (e["y0"] - o["y"])


def signed_area(ring: Column) -> Column:
    return let(
        ring,
        lambda r: F.aggregate(edges(r), F.lit(0.0), lambda acc, e: acc + _cross(e, F.get(r, F.lit(0)))) / F.lit(2.0),
    )


def area(ring: Column) -> Column:
    return F.abs(signed_area(ring))


def moments(ring: Column) -> Column:
    """Struct m00, m10, m01 (sign-normalised), centroid cx, cy; centroid null when m00 is 0."""

    def sums(o: Column, acc: Column, e: Column) -> Column:
        cross = _cross(e, o)
        return F.struct(
            (acc["a"] + cross).alias("a"),
            (acc["x"] + (e["x0"] + e["x1"] - 2 * o["x"]) * cross).alias("x"),
            (acc["y"] + (e["y0"] + e["y1"] - 2 * o["y"]) * cross).alias("y"),
        )

    def finish(o: Column, s: Column) -> Column:
        return let(
            F.struct(
                (F.abs(s["a"]) / 2).alias("m00"),
                F.when(s["a"] != 0, s["x"] / (3 * s["a"]) + o["x"]).alias("cx"),
                F.when(s["a"] != 0, s["y"] / (3 * s["a"]) + o["y"]).alias("cy"),
            ),
            lambda m: F.struct(
                m["m00"].alias("m00"),
                F.coalesce(m["m00"] * m["cx"], F.lit(0.0)).alias("m10"),
                F.coalesce(m["m00"] * m["cy"], F.lit(0.0)).alias("m01"),
                m["cx"].alias("cx"),
                m["cy"].alias("cy"),
            ),
        )

    zero = F.struct(F.lit(0.0).alias("a"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))

    def whole(r: Column) -> Column:
        o = F.get(r, F.lit(0))
        return F.aggregate(edges(r), zero, lambda acc, e: sums(o, acc, e), lambda s: finish(o, s))

    return let(ring, whole)


def bounds(ring: Column) -> Column:
    def box(r: Column) -> Column:
        xs, ys = F.transform(r, lambda p: p["x"]), F.transform(r, lambda p: p["y"])
        return F.struct(
            F.array_min(xs).alias("min_x"), F.array_min(ys).alias("min_y"),
            F.array_max(xs).alias("max_x"), F.array_max(ys).alias("max_y"),
        )

    return let(ring, box)


def perimeter(ring: Column) -> Column:
    return F.aggregate(
        edges(ring), F.lit(0.0),
        lambda acc, e: acc + F.hypot(e["x1"] - e["x0"], e["y1"] - e["y0"]),
    )


def _turn(a: Column, b: Column, c: Column) -> Column:
    return (b["x"] - a["x"]) * (c["y"] - a["y"]) - (b["y"] - a["y"]) * (c["x"] - a["x"])


def _half_hull(points: Column) -> Column:
    """Monotone chain. On a convex stack the points to keep are a prefix, so their number is a count."""

    def push(stack: Column, p: Column) -> Column:
        kept = F.filter(
            F.sequence(F.lit(1), F.size(stack)),
            lambda i: (i == 1) | (_turn(F.get(stack, i - 2), F.get(stack, i - 1), p) > 0),
        )
        grown = F.concat(F.slice(stack, F.lit(1), F.size(kept)), F.array(p))
        return F.when(F.size(stack) == 0, F.array(p)).otherwise(grown)

    empty = F.slice(points, F.lit(1), F.lit(0))
    return F.aggregate(points, empty, push)


def convex_hull(ring: Column) -> Column:
    """Hull as an open anticlockwise ring."""

    def join_halves(points: Column) -> Column:
        lower, upper = _half_hull(points), _half_hull(F.reverse(points))
        drop_last = lambda half: let(half, lambda h: F.slice(h, F.lit(1), F.size(h) - 1))
        return F.when(F.size(points) < 2, points).otherwise(F.concat(drop_last(lower), drop_last(upper)))

    return let(F.array_sort(F.array_distinct(ring)), join_halves)


def shape_passes(ring: Column, min_area: float, max_aspect: float, min_solidity: float) -> Column:
    """Area, hull perimeter / (4 sqrt(area)) and area / hull area within the limits."""

    def passes(m: Column) -> Column:
        aspect_ok = F.when(
            m["size"] > 0, m["perimeter"] / (F.lit(4.0) * F.sqrt(m["size"])) <= F.lit(float(max_aspect))
        ).otherwise(F.lit(False))
        solidity = F.when(m["hull_area"] > 0, m["size"] / m["hull_area"]).otherwise(F.lit(0.0))
        return (m["size"] >= F.lit(float(min_area))) & aspect_ok & (solidity >= F.lit(float(min_solidity)))

    def measure(r: Column) -> Column:
        return let(
            convex_hull(r),
            lambda hull: let(
                F.struct(area(r).alias("size"), perimeter(hull).alias("perimeter"), area(hull).alias("hull_area")), passes
            ),
        )

    return let(ring, measure)


def _up_to(sorted_: Column, value: Column, halves: Column) -> Column:
    """How many of the sorted numbers do not exceed a value, by halving."""

    def further(place: Column, step: Column) -> Column:
        return F.when((place + step <= F.size(sorted_)) & (F.get(sorted_, place + step - 1) <= value), place + step).otherwise(place)

    return F.aggregate(halves, F.lit(0), further)


def crosses_itself(ring: Column) -> Column:
    """True when two edges that do not follow each other share a point; repeated points count once."""
    return let(without_repeats(ring), _edges_cross)


def _edges_cross(ring: Column) -> Column:
    """:func:`crosses_itself` of a ring without repeated points; a triangle has no edges that do not follow each other.

    A sweep over the edges in order of their left ends: an edge is compared with those that begin before it ends,
    so the work follows the edges that lie above one another and not all pairs.
    """

    def side(e: Column, x: Column, y: Column) -> Column:
        return F.signum((e["x1"] - e["x0"]) * (y - e["y0"]) - (e["y1"] - e["y0"]) * (x - e["x0"]))

    def meet(a: Column, b: Column, n: Column) -> Column:
        e, f = a["e"], b["e"]
        first, last = F.least(a["i"], b["i"]), F.greatest(a["i"], b["i"])
        apart = (last > first + 1) & ~((first == 0) & (last == n - 1))
        above = (F.least(e["y0"], e["y1"]) <= F.greatest(f["y0"], f["y1"])) & (F.least(f["y0"], f["y1"]) <= F.greatest(e["y0"], e["y1"]))
        return (
            apart & above
            & (side(e, f["x0"], f["y0"]) * side(e, f["x1"], f["y1"]) <= 0)
            & (side(f, e["x0"], e["y0"]) * side(f, e["x1"], e["y1"]) <= 0)
        )

    def sweep(order: Column) -> Column:
        tables = F.struct(
            F.transform(order, lambda s: s["low"]).alias("lows"),
            F.transform(order, lambda s, at: F.struct(at.alias("at"), s.alias("s"))).alias("placed"),
            F.filter(F.array(*(F.lit(1 << i) for i in range(30, -1, -1))), lambda h: h <= F.size(order)).alias("halves"),
        )

        def any_met(t: Column) -> Column:
            def met(a: Column) -> Column:
                behind = _up_to(t["lows"], a["s"]["high"], t["halves"]) - a["at"] - 1
                return F.exists(F.slice(order, a["at"] + 2, behind), lambda b: meet(a["s"], b, F.size(order)))

            return F.exists(t["placed"], met)

        return let(tables, any_met)

    def spanned(e: Column, i: Column) -> Column:
        return F.struct(F.least(e["x0"], e["x1"]).alias("low"), F.greatest(e["x0"], e["x1"]).alias("high"), i.alias("i"), e.alias("e"))

    return (F.size(ring) > 3) & let(F.sort_array(F.transform(edges(ring), spanned)), sweep)


def one_part(ring: Column) -> Column:
    """A ring as a geometry: an array of parts, each an exterior ring and its holes."""
    return F.array(F.array(ring))


def signed_rings(geometry: Column) -> Column:
    """All rings of a geometry as structs ``sign, ring``: 1 for exteriors, -1 for holes."""
    return F.flatten(F.transform(geometry, lambda part: F.transform(
        part, lambda ring, i: F.struct(F.when(i == 0, 1.0).otherwise(-1.0).alias("sign"), ring.alias("ring")))))


def geometry_area(geometry: Column) -> Column:
    """Area of the parts less that of their holes."""
    return F.aggregate(signed_rings(geometry), F.lit(0.0), lambda total, s: total + s["sign"] * area(s["ring"]))


def geometry_moments(geometry: Column) -> Column:
    """Struct m00, m10, m01, cx, cy of a geometry; centroid null when m00 is 0."""
    zero = F.struct(F.lit(0.0).alias("a"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))

    def add(total: Column, s: Column) -> Column:
        return let(moments(s["ring"]), lambda m: F.struct(
            (total["a"] + s["sign"] * m["m00"]).alias("a"), (total["x"] + s["sign"] * m["m10"]).alias("x"),
            (total["y"] + s["sign"] * m["m01"]).alias("y")))

    return F.aggregate(signed_rings(geometry), zero, add, lambda t: F.struct(
        t["a"].alias("m00"), t["x"].alias("m10"), t["y"].alias("m01"),
        F.when(t["a"] != 0, t["x"] / t["a"]).alias("cx"), F.when(t["a"] != 0, t["y"] / t["a"]).alias("cy")))


def geometry_bounds(geometry: Column) -> Column:
    return bounds(F.flatten(F.flatten(geometry)))


def geometry_reject_reason(geometry: Column) -> Column:
    """The first reason why a ring of a geometry is no simple polygon; null for a good one."""
    reasons = F.filter(F.transform(signed_rings(geometry), lambda s: reject_reason(s["ring"])), lambda r: r.isNotNull())
    return F.when(geometry.isNull() | (F.size(geometry) == 0), F.lit("no ring")).otherwise(F.get(reasons, F.lit(0)))


def reject_reason(ring: Column) -> Column:
    """Why a ring is not a simple polygon; null for a good one."""
    return let(
        without_repeats(ring),
        lambda r: F.when(r.isNull(), F.lit("no ring"))
        .when(F.size(F.array_distinct(r)) < 3, F.lit("fewer than 3 points"))
        .when(area(r) == 0, F.lit("zero area"))
        .when(_edges_cross(r), F.lit("self-crossing")),
    )
