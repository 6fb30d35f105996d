"""Polygon operators and object matching."""

from pyspark.sql import functions as F

from arborlake.functions import geometry as geo
from arborlake.operators import matching, polygons
from catalog.fixtures import fx
from catalog.fixtures import polygons as polys
from catalog.registry import query


@query("polygon_edges", """
    select image_id, poly_id, cast(edge_no as int) as edge_no, x0, y0, x1, y1 from fx_gt_edges""")
def polygon_edges(spark, sf):
    return polygons.polygon_edges(polys(spark, sf, "gt"))


@query("polygon_moments", """
    select image_id, poly_id, area as m00, round(s10 * sign(signed), 4) as m10, round(s01 * sign(signed), 4) as m01,
           round(s10 / signed, 6) as cx, round(s01 / signed, 6) as cy,
           cast(trunc(round(s10 / signed, 9)) as int) as cx_px, cast(trunc(round(s01 / signed, 9)) as int) as cy_px
    from fx_gt_areas where area > 0""")
def polygon_moments(spark, sf):
    rows = polygons.polygon_moments(polys(spark, sf, "gt"))
    return rows.select(
        "image_id", "poly_id", "m00", F.round("m10", 4).alias("m10"), F.round("m01", 4).alias("m01"),
        F.round("cx", 6).alias("cx"), F.round("cy", 6).alias("cy"),
        F.round("cx", 9).cast("int").alias("cx_px"), F.round("cy", 9).cast("int").alias("cy_px"),
    )


_OVERLAP = """
    select o.image_id, o.pred_id as left_id, o.gt_id as right_id, round(o.inter, 6) as inter,
           round(round(o.inter / (p.area + g.area - o.inter), 9), 6) as iou
    from fx_overlaps o join fx_pred_areas p on p.poly_id = o.pred_id join fx_gt_areas g on g.poly_id = o.gt_id
    where round(o.inter, 9) > 0"""


@query("overlap_area", _OVERLAP.replace(",\n           round(round(o.inter / (p.area + g.area - o.inter), 9), 6) as iou", ""))
def overlap_area(spark, sf):
    rows = polygons.overlap_area(polys(spark, sf, "pred"), polys(spark, sf, "gt"))
    return rows.filter(F.round("inter", 9) > 0).select("image_id", "left_id", "right_id", F.round("inter", 6).alias("inter"))


@query("polygon_iou", _OVERLAP.replace("round(o.inter, 6) as inter,\n           ", ""))
def polygon_iou(spark, sf):
    rows = polygons.overlap_area(polys(spark, sf, "pred"), polys(spark, sf, "gt")).filter(F.round("inter", 9) > 0)
    value = polygons.iou(F.col("inter"), F.col("left_area"), F.col("right_area"))
    return rows.select("image_id", "left_id", "right_id", F.round(F.round(value, 9), 6).alias("iou"))


@query("spatial_box_join", """
    with p as (select image_id, poly_id, min(x) as x0, min(y) as y0, max(x) as x1, max(y) as y1 from fx_pred_vertices group by 1, 2),
         g as (select image_id, poly_id, min(x) as x0, min(y) as y0, max(x) as x1, max(y) as y1 from fx_gt_vertices group by 1, 2)
    select p.image_id, p.poly_id as pred_id, g.poly_id as gt_id from p join g on p.image_id = g.image_id
     and p.x0 < g.x1 and g.x0 < p.x1 and p.y0 < g.y1 and g.y0 < p.y1""")
def spatial_box_join(spark, sf):
    from arborlake.operators.spatial_join import box_join

    side = lambda w: polygons.with_box(polys(spark, sf, w)).drop("ring").withColumnRenamed("poly_id", f"{w}_id")
    return box_join(side("pred"), side("gt"), ["image_id"])


@query("convex_hull", """
    with v as (select distinct image_id, poly_id, x, y from fx_gt_vertices),
    side as (select a.image_id, a.poly_id, a.x as x0, a.y as y0, b.x as x1, b.y as y1,
                    min((b.x - a.x) * (c.y - a.y) - (b.y - a.y) * (c.x - a.x)) as low,
                    max(case when (b.x - a.x) * (c.y - a.y) = (b.y - a.y) * (c.x - a.x)
                         then (c.x - a.x) * (b.x - a.x) + (c.y - a.y) * (b.y - a.y) end) as reach
             from v a join v b on a.poly_id = b.poly_id and (a.x <> b.x or a.y <> b.y) join v c on c.poly_id = a.poly_id
             group by 1, 2, 3, 4, 5, 6)
    select image_id, poly_id, sum(x0 * y1 - x1 * y0) / 2 as hull_area,
           round(sum(sqrt((x1 - x0) * (x1 - x0) + (y1 - y0) * (y1 - y0))), 6) as hull_perimeter, count(*) as hull_points
    from (select *, row_number() over (partition by poly_id, x0, y0 order by (x1 - x0) * (x1 - x0) + (y1 - y0) * (y1 - y0) desc) as rn
          from side where low >= 0) where rn = 1 group by 1, 2""")
def convex_hull(spark, sf):
    rows = polygons.convex_hull(polys(spark, sf, "gt"))
    return rows.select("image_id", "poly_id", "hull_area", F.round("hull_perimeter", 6).alias("hull_perimeter"),
                       F.size("hull").cast("bigint").alias("hull_points"))


@query("shape_filter", """
    with v as (select distinct image_id, poly_id, x, y from fx_gt_vertices),
    side as (select a.image_id, a.poly_id, a.x as x0, a.y as y0, b.x as x1, b.y as y1,
                    min((b.x - a.x) * (c.y - a.y) - (b.y - a.y) * (c.x - a.x)) as low
             from v a join v b on a.poly_id = b.poly_id and (a.x <> b.x or a.y <> b.y) join v c on c.poly_id = a.poly_id
             group by 1, 2, 3, 4, 5, 6),
    hull as (select poly_id, sum(x0 * y1 - x1 * y0) / 2 as hull_area,
                    sum(sqrt((x1 - x0) * (x1 - x0) + (y1 - y0) * (y1 - y0))) as hull_perimeter
             from (select *, row_number() over (partition by poly_id, x0, y0 order by (x1 - x0) * (x1 - x0) + (y1 - y0) * (y1 - y0) desc) as rn
                   from side where low >= 0) where rn = 1 group by 1)
    select image_id, poly_id from fx_gt_areas join hull using (poly_id)
    where area >= 20 and hull_perimeter / (4 * sqrt(area)) <= 1.15 and area / hull_area >= 0.8""")
def shape_filter(spark, sf):
    return polygons.shape_filter(polys(spark, sf, "gt"), 20.0, 1.15, 0.8).select("image_id", "poly_id")


@query("close_rings", """
    select image_id, poly_id, cast(vertex_no as int) as vertex_no, x, y from fx_gt_vertices
    union all select image_id, poly_id, cast(nv as int), x, y from fx_gt_vertices where vertex_no = 0""")
def close_rings(spark, sf):
    rows = polygons.close_rings(polys(spark, sf, "gt"))
    return rows.select("image_id", "poly_id", F.posexplode("ring").alias("vertex_no", "p")).select(
        "image_id", "poly_id", "vertex_no", "p.x", "p.y"
    )


def _mixed(spark, sf):
    """Good rings, rings with two points, flat rings and bow ties."""
    rows = polys(spark, sf, "gt")
    p = lambda i: F.get("ring", F.lit(i))
    bow = F.array(p(0), p(2), p(1), p(3))
    return rows.withColumn(
        "ring",
        F.when(F.col("poly_id") % 7 == 0, F.slice("ring", 1, 2))
        .when(F.col("poly_id") % 7 == 1, F.array(p(0), p(1), p(0), p(1)))
        .when((F.col("poly_id") % 7 == 2) & (F.size("ring") == 4), bow)
        .when(F.col("poly_id") % 7 == 3, F.array(p(0), p(1), F.struct(
            (2 * p(1)["x"] - p(0)["x"]).alias("x"), (2 * p(1)["y"] - p(0)["y"]).alias("y"))))
        .otherwise(F.col("ring")),
    )


@query("validate_polygons", """
    select reason, count(*) as n, sum(poly_id)::bigint as id_sum from (
      select poly_id, case when poly_id % 7 in (0, 1) then 'fewer than 3 points' when poly_id % 7 = 3 then 'zero area'
        when poly_id % 7 = 2 and shape = 0 then 'zero area' else 'good' end as reason
      from fx_gt_poly) group by 1""")
def validate_polygons(spark, sf):
    good, bad = polygons.validate_polygons(_mixed(spark, sf))
    both = good.select("poly_id", F.lit("good").alias("reason")).unionByName(bad.select("poly_id", "reason"))
    return both.groupBy("reason").agg(F.count("*").alias("n"), F.sum("poly_id").alias("id_sum"))


@query("validate_bow_ties", """
    select poly_id, case when poly_id % 3 = 0 then 'self-crossing' else 'good' end as reason from fx_gt_poly where shape = 0""")
def validate_bow_ties(spark, sf):
    """Boxes with one side pulled across (their two loops differ in area), and boxes that say points twice."""
    boxes = polys(spark, sf, "gt").join(fx(spark, sf, "fx_gt_poly").filter("shape = 0").select("poly_id"), "poly_id")
    p = lambda i: F.get("ring", F.lit(i))
    pulled = F.struct((4 * p(2)["x"] - 3 * p(3)["x"]).alias("x"), (2 * p(2)["y"] - p(0)["y"]).alias("y"))
    ring = F.when(F.col("poly_id") % 3 == 0, F.array(p(0), pulled, p(1), p(3))).otherwise(F.array(p(0), p(0), p(1), p(2), p(2), p(2), p(3), p(0)))
    good, bad = polygons.validate_polygons(boxes.withColumn("ring", ring))
    return good.select("poly_id", F.lit("good").alias("reason")).unionByName(bad.select("poly_id", "reason"))


@query("box_join_degrees", """
    with g as (select image_id, poly_id, min(x) / 1e7 as x0, min(y) / 1e7 as y0, max(x) / 1e7 as x1, max(y) / 1e7 as y1 from fx_gt_vertices group by 1, 2)
    select p.image_id, p.poly_id as left_id, g.poly_id as right_id from g p join g on p.image_id = g.image_id
     and p.x0 < g.x1 and g.x0 < p.x1 and p.y0 < g.y1 and g.y0 < p.y1""")
def box_join_degrees(spark, sf):
    """Boxes of some ten-millionths of a unit, as degree coordinates give them."""
    from arborlake.operators.spatial_join import box_join

    small = lambda c: F.col(c) / 1e7
    boxes = polygons.with_box(polys(spark, sf, "gt")).drop("ring").withColumns({c: small(c) for c in ("min_x", "min_y", "max_x", "max_y")})
    return box_join(boxes.withColumnRenamed("poly_id", "left_id"), boxes.withColumnRenamed("poly_id", "right_id"), ["image_id"])


@query("first_feature_center", """
    with first as (select image_id, min(poly_id) as poly_id from fx_gt_poly group by 1)
    select f.image_id, f.poly_id, round(a.s10 / a.signed, 6) as cx, round(a.s01 / a.signed, 6) as cy,
           b.min_x, b.min_y, b.max_x, b.max_y
    from first f join fx_gt_areas a using (poly_id)
    join (select poly_id, min(x) as min_x, min(y) as min_y, max(x) as max_x, max(y) as max_y from fx_gt_vertices group by 1) b using (poly_id)""")
def first_feature_center(spark, sf):
    rows = polygons.first_feature_center(polys(spark, sf, "gt"))
    return rows.withColumns({"cx": F.round("cx", 6), "cy": F.round("cy", 6)})


_COUNTS = """
    n as (select image_id, sum(p)::double as np, sum(t)::double as nt from (
            select image_id, 1 as p, 0 as t from fx_pred_poly union all select image_id, 0, 1 from fx_gt_poly) group by 1)"""


@query("object_pixel_iou", f"""
    with {_COUNTS},
    best as (select o.image_id, o.pred_id, o.gt_id, round(o.inter / (p.area + g.area - o.inter), 12) as iou,
                    row_number() over (partition by o.pred_id order by round(o.inter / (p.area + g.area - o.inter), 12) desc, o.gt_id) as rn
             from fx_overlaps o join fx_pred_areas p on p.poly_id = o.pred_id join fx_gt_areas g on g.poly_id = o.gt_id
             where round(o.inter / (p.area + g.area - o.inter), 12) > 0),
    b as (select image_id, sum(iou) as total, count(distinct gt_id) as chosen from best where rn = 1 group by 1)
    select image_id, round(case when np = 0 or nt = 0 then 0 else coalesce(total, 0) / (np + nt - coalesce(chosen, 0)) end, 6) as pixel_iou
    from n left join b using (image_id)""")
def object_pixel_iou(spark, sf):
    rows = matching.object_pixel_iou(polys(spark, sf, "pred"), polys(spark, sf, "gt"))
    return rows.select("image_id", F.round("pixel_iou", 6).alias("pixel_iou"))


@query("tree_iou_greedy", f"""
    with {_COUNTS},
    best as (select o.image_id, o.gt_id, round(o.inter / p.area, 12) as cover,
                    row_number() over (partition by o.pred_id order by round(o.inter / p.area, 12) desc, o.gt_id) as rn
             from fx_overlaps o join fx_pred_areas p on p.poly_id = o.pred_id where round(o.inter / p.area, 12) > 0),
    b as (select image_id, count(distinct gt_id)::double as tp from best where rn = 1 and cover >= 0.4 group by 1)
    select image_id, round(case when np = 0 or nt = 0 then 0 else coalesce(tp, 0) / (np + nt - coalesce(tp, 0)) end, 6) as tree_iou
    from n left join b using (image_id)""")
def tree_iou_greedy(spark, sf):
    rows = matching.tree_iou_greedy(polys(spark, sf, "pred"), polys(spark, sf, "gt"))
    return rows.select("image_id", F.round("tree_iou", 6).alias("tree_iou"))


@query("tree_iou_optimal")
def tree_iou_optimal(spark, sf):
    rows = matching.tree_iou_optimal(polys(spark, sf, "pred"), polys(spark, sf, "gt"))
    return rows.select("image_id", F.round("tree_iou", 6).alias("tree_iou"))


_NEAR = """
    near as (select image_id, gt_id, pred_id, d from (
        select g.image_id, g.poly_id as gt_id, p.poly_id as pred_id,
               sqrt(power(g.s10 / g.signed - p.s10 / p.signed, 2) + power(g.s01 / g.signed - p.s01 / p.signed, 2)) as d,
               row_number() over (partition by g.poly_id order by
                 round(sqrt(power(g.s10 / g.signed - p.s10 / p.signed, 2) + power(g.s01 / g.signed - p.s01 / p.signed, 2)), 9), p.poly_id) as rn
        from fx_gt_areas g join fx_pred_areas p on g.image_id = p.image_id) where rn = 1 and d <= 9)"""


@query("centroid_match", f"""
    with {_COUNTS}, {_NEAR},
    won as (select image_id, d, row_number() over (partition by pred_id order by gt_id) as rn from near),
    b as (select image_id, count(*) as tp, sum(d) as total from won where rn = 1 group by 1)
    select image_id, coalesce(tp, 0) as tp, cast(np - coalesce(tp, 0) as bigint) as fp, cast(nt - coalesce(tp, 0) as bigint) as fn,
           round(case when coalesce(tp, 0) > 0 then total / tp else 'nan'::double end, 6) as centroid_error
    from n left join b using (image_id)""")
def centroid_match(spark, sf):
    rows = matching.centroid_match(polys(spark, sf, "pred"), polys(spark, sf, "gt"), limit=9.0)
    return rows.withColumn("centroid_error", F.round("centroid_error", 6))


@query("nearest_within", f"""
    with {_NEAR} select image_id, gt_id as point_id, pred_id as candidate_id, round(d, 6) as distance from near""")
def nearest_within(spark, sf):
    from arborlake.operators.spatial_join import nearest_join

    p = polygons.polygon_moments(polys(spark, sf, "pred")).selectExpr("image_id", "poly_id as candidate_id", "cx as rx", "cy as ry")
    t = polygons.polygon_moments(polys(spark, sf, "gt")).selectExpr("image_id", "poly_id as point_id", "cx as lx", "cy as ly")
    return nearest_join(t, p, ["image_id"], 9.0).withColumn("distance", F.round("distance", 6))
