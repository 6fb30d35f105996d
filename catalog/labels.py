"""Label rasters and connected pixels."""

from pyspark.sql import functions as F

from arborlake.operators import components, labels
from catalog.fixtures import fx, polygons
from catalog.registry import query

_SIZES = "select image_id, width, height from fx_meta"


def _sizes(spark, sf):
    return fx(spark, sf, "fx_meta").select("image_id", "width", "height")


def _instances(spark, sf, which="gt"):
    return labels.rasterize(polygons(spark, sf, which), _sizes(spark, sf))


# crossing-number fill of pixel centres, together with the pixels of every edge
_INST = """
    px as (select distinct image_id, poly_id, x, y from (
        select b.image_id, b.poly_id, cast(cx as int) as x, cast(cy as int) as y
        from (select image_id, poly_id, min(x) as x0, max(x) as x1, min(y) as y0, max(y) as y1 from fx_gt_vertices group by 1, 2) b,
             range(160) gx(cx), range(160) gy(cy)
        where cx between x0 and x1 and cy between y0 and y1 and (
          select count(*) filter (e.x0 + (cy - e.y0) * (e.x1 - e.x0) / (e.y1 - e.y0) <= cx) % 2 = 1
              or count(*) filter (e.x0 + (cy - e.y0) * (e.x1 - e.x0) / (e.y1 - e.y0) = cx) > 0
          from fx_gt_edges e where e.poly_id = b.poly_id and least(e.y0, e.y1) <= cy and cy < greatest(e.y0, e.y1))
        union all
        select image_id, poly_id, cast(case when abs(y1 - y0) > abs(x1 - x0) then floor(x0 + i * sign(y1 - y0) * (x1 - x0) / (y1 - y0) + 0.5)
                                       else x0 + i * sign(x1 - x0) end as int),
               cast(case when abs(y1 - y0) > abs(x1 - x0) then y0 + i * sign(y1 - y0)
                    when x1 = x0 then y0 else floor(y0 + i * sign(x1 - x0) * (y1 - y0) / (x1 - x0) + 0.5) end as int)
        from fx_gt_edges, range(40) r(i) where i <= greatest(abs(x1 - x0), abs(y1 - y0)))
      where x >= 0 and y >= 0 and x < 144 and y < 144)"""

# every instance pixel against the outside pixels around its instance
_DIST = _INST + """,
    ring as (select distinct p.image_id, p.poly_id, p.x + dx as x, p.y + dy as y
             from px p, range(-1, 2) a(dx), range(-1, 2) b(dy) where p.x + dx between 0 and 143 and p.y + dy between 0 and 143),
    outside as (select * from ring anti join px using (poly_id, x, y)),
    dist as (select p.image_id, p.poly_id, p.x, p.y, min(0.955::double * (greatest(abs(p.x - o.x), abs(p.y - o.y)) - least(abs(p.x - o.x), abs(p.y - o.y)))
                    + 1.3693::double * least(abs(p.x - o.x), abs(p.y - o.y))) as d
             from px p join outside o using (poly_id) group by 1, 2, 3, 4),
    share as (select image_id, poly_id, x, y, d / max(d) over (partition by poly_id) as s from dist),
    norm as (select image_id, x, y, max(s) as s from share group by 1, 2, 3),
    outline as (select distinct p.image_id, p.x, p.y from px p where (
        select count(*) from px q where q.poly_id = p.poly_id and abs(q.x - p.x) + abs(q.y - p.y) = 1) < 4),
    band as (select distinct image_id, x + dx as x, y + dy as y from outline, range(-1, 2) a(dx), range(-1, 2) b(dy)),
    hybrid as (select n.image_id, n.x, n.y, case when b.image_id is not null then -1 else s end as h
               from norm n left join band b on n.image_id = b.image_id and n.x = b.x and n.y = b.y)"""

_HEAT = """
    heat as (select image_id, x, y, least(1, sum(v)) as heat from (
        select a.image_id, cast(gx.x as int) as x, cast(gy.y as int) as y,
               exp(-(power(gx.x - trunc(round(s10 / signed, 9)), 2) + power(gy.y - trunc(round(s01 / signed, 9)), 2)) / 8) as v
        from fx_gt_areas a, range(144) gx(x), range(144) gy(y)
        where abs(gx.x - trunc(round(s10 / signed, 9))) <= 16 and abs(gy.y - trunc(round(s01 / signed, 9))) <= 16) group by 1, 2, 3)"""


@query("rasterize", f"with {_INST} select image_id, poly_id, x, y from px")
def rasterize(spark, sf):
    return _instances(spark, sf).select("image_id", "poly_id", "x", "y")


@query("mask_union", f"with {_INST} select image_id, count(*) as pixels, sum(x)::bigint as sx, sum(y)::bigint as sy from (select distinct image_id, x, y from px) group by 1")
def mask_union(spark, sf):
    rows = labels.mask(_instances(spark, sf))
    return rows.groupBy("image_id").agg(F.count("*").alias("pixels"), F.sum("x").alias("sx"), F.sum("y").alias("sy"))


@query("centroid_heat", f"with {_HEAT} select image_id, x, y, round(heat, 6) as heat from heat where heat > 1e-6")
def centroid_heat(spark, sf):
    rows = labels.centroid_heat(polygons(spark, sf, "gt"), _sizes(spark, sf)).filter("heat > 1e-6")
    return rows.withColumn("heat", F.round("heat", 6))


@query("tree_count", "select image_id, count(*) as trees from fx_gt_areas where area > 0 group by 1")
def tree_count(spark, sf):
    return labels.tree_count(polygons(spark, sf, "gt"))


def _distances(spark, sf):
    return labels.instance_distance(_instances(spark, sf), _sizes(spark, sf))


@query("instance_distance", f"with {_DIST} select image_id, poly_id, x, y, round(d, 6) as dist from dist")
def instance_distance(spark, sf):
    return _distances(spark, sf).select("image_id", "poly_id", "x", "y", F.round("dist", 6).alias("dist"))


@query("normalised_distance", f"with {_DIST} select image_id, x, y, round(s, 6) as share from norm")
def normalised_distance(spark, sf):
    return labels.normalised_distance(_distances(spark, sf)).withColumn("share", F.round("share", 6))


@query("boundary_band", f"with {_DIST} select image_id, cast(x as int) as x, cast(y as int) as y from band")
def boundary_band(spark, sf):
    return labels.boundary_band(_distances(spark, sf))


@query("hybrid_label", f"with {_DIST} select image_id, x, y, round(h, 6) as hybrid from hybrid")
def hybrid_label(spark, sf):
    return labels.hybrid_label(_distances(spark, sf)).withColumn("hybrid", F.round("hybrid", 6))


@query("topo_label", f"""
    with {_DIST} select image_id, x, y, cast(trunc(least(255, round(sum(255 * s), 9))) as int) as topo from share group by 1, 2, 3""")
def topo_label(spark, sf):
    return labels.topo_label(_distances(spark, sf))


@query("label_channels", f"""
    with {_DIST}, {_HEAT}
    select image_id, x, y, case when h is null then 0 else 1 end as mask, round(coalesce(heat, 0), 6) as centroid, round(coalesce(h, 0), 6) as hybrid
    from hybrid full join heat using (image_id, x, y) where h is not null or heat > 1e-6""")
def label_channels(spark, sf):
    rows = labels.label_channels(polygons(spark, sf, "gt"), _sizes(spark, sf)).filter("mask = 1 or centroid > 1e-6")
    return rows.withColumns({"centroid": F.round("centroid", 6), "hybrid": F.round("hybrid", 6)})


# connected pixels on a noisy mask: reachability by recursion

_MASK = "select image_id, x, y from fx_pixels where pred_pct >= 9"


def _noise(spark, sf):
    return fx(spark, sf, "fx_pixels").filter("pred_pct >= 9").select("image_id", "x", "y")


def _reach(source: str, near: str, name: str = "r") -> str:
    return f"""
    {name}_m as ({source}),
    {name}_step as (select a.image_id, a.y::bigint * 4294967296 + a.x as u, b.y::bigint * 4294967296 + b.x as v
             from {name}_m a join {name}_m b on a.image_id = b.image_id and {near}),
    {name}_all as (select image_id, y::bigint * 4294967296 + x as node, y::bigint * 4294967296 + x as seen from {name}_m
          union select r.image_id, r.node, s.v from {name}_all r join {name}_step s on s.image_id = r.image_id and s.u = r.seen),
    {name} as (select image_id, node, min(seen) as component from {name}_all group by 1, 2)"""


_FOUR = "abs(a.x - b.x) + abs(a.y - b.y) = 1"
_EIGHT = "abs(a.x - b.x) <= 1 and abs(a.y - b.y) <= 1 and (a.x <> b.x or a.y <> b.y)"


def _cc(name, connectivity, near, block):
    @query(name, f"""
        with recursive {_reach(_MASK, near)}
        select image_id, cast(node % 4294967296 as int) as x, cast(floor(node / 4294967296) as int) as y, component from r""")
    def run(spark, sf):
        return components.connected_components(_noise(spark, sf), ["image_id"], connectivity, block)

    return run


_cc("connected_components_4", 4, _FOUR, 256)
_cc("connected_components_8", 8, _EIGHT, 16)


@query("number_components", f"""
    with recursive {_reach(_MASK, _FOUR)}
    select image_id, component, cast(row_number() over (partition by image_id order by component) as int) as region_id
    from (select distinct image_id, component from r)""")
def number_components(spark, sf):
    labelled = components.connected_components(_noise(spark, sf), ["image_id"], 4)
    return components.number_components(labelled, ["image_id"]).select("image_id", "component", "region_id").distinct()


@query("remove_small", f"""
    with recursive {_reach(_MASK, _FOUR)}
    select image_id, cast(node % 4294967296 as int) as x, cast(floor(node / 4294967296) as int) as y from r
    where (image_id, component) in (select (image_id, component) from r group by image_id, component having count(*) >= 5)""")
def remove_small(spark, sf):
    return components.remove_small(_noise(spark, sf), ["image_id"], 5)


@query("count_trees", f"with recursive {_reach(_MASK, _FOUR)} select image_id, count(distinct component) as num_trees from r group by 1")
def count_trees(spark, sf):
    return components.count_components(_noise(spark, sf), ["image_id"], 4)


@query("buffer_mask", f"""
    with recursive {_reach(_MASK, _EIGHT)}
    select image_id, cast(node % 4294967296 as int) as x, cast(floor(node / 4294967296) as int) as y from r
    where (image_id, component) in (select (image_id, component) from r
      where node % 4294967296 in (0, 63) or floor(node / 4294967296) in (0, 63))""")
def buffer_mask(spark, sf):
    px = _noise(spark, sf)
    sizes = px.select("image_id").distinct().withColumns({"width": F.lit(64), "height": F.lit(64)})
    return components.buffer_mask(px, sizes, ["image_id"])


_TRUE = "select image_id, x, y from fx_pixels where truth_pct >= 7"


@query("component_iou", f"""
    with recursive {_reach(_MASK, _FOUR, "p")}, {_reach(_TRUE, _FOUR, "t")},
    ph as (select p.image_id, p.component, max(case when q.node is null then 0 else 1 end) as hit
           from p left join t q on q.image_id = p.image_id and q.node = p.node group by 1, 2),
    th as (select t.image_id, t.component, max(case when q.node is null then 0 else 1 end) as hit
           from t left join p q on q.image_id = t.image_id and q.node = t.node group by 1, 2),
    c as (select image_id, sum(tp) as tp, sum(fp) as fp, sum(fn) as fn from (
            select image_id, hit as tp, 1 - hit as fp, 0 as fn from ph union all select image_id, 0, 0, 1 - hit from th
            union all select distinct image_id, 0, 0, 0 from fx_pixels) group by 1)
    select image_id, round(case when tp + fp + fn = 0 then 1 else tp / (tp + fp + fn) end, 6) as tree_iou from c""")
def component_iou(spark, sf):
    px = fx(spark, sf, "fx_pixels").selectExpr("image_id", "x", "y", "pred_pct >= 9 as pred", "truth_pct >= 7 as truth")
    return components.component_iou(px).withColumn("tree_iou", F.round("tree_iou", 6))


@query("pixel_summary", f"""
    with recursive {_reach(_MASK, _FOUR, "p")}, {_reach(_TRUE, _FOUR, "t")},
    ph as (select p.image_id, p.component, max(case when q.node is null then 0 else 1 end) as hit
           from p left join t q on q.image_id = p.image_id and q.node = p.node group by 1, 2),
    th as (select t.image_id, t.component, max(case when q.node is null then 0 else 1 end) as hit
           from t left join p q on q.image_id = t.image_id and q.node = t.node group by 1, 2),
    c as (select image_id, sum(tp) as tp, sum(fp) as fp, sum(fn) as fn from (
            select image_id, hit as tp, 1 - hit as fp, 0 as fn from ph union all select image_id, 0, 0, 1 - hit from th
            union all select distinct image_id, 0, 0, 0 from fx_pixels) group by 1),
    k as (select image_id, count(*) filter (pred_pct >= 9 and truth_pct >= 7) as tp, count(*) filter (pred_pct >= 9 and truth_pct < 7) as fp,
                 count(*) filter (pred_pct < 9 and truth_pct >= 7) as fn, count(*) filter (pred_pct < 9 and truth_pct < 7) as tn from fx_pixels group by 1),
    per as (select k.image_id, (k.tp / (k.tp + k.fp + k.fn) + tn / (tn + k.fp + k.fn)) / 2 as mi,
                   (k.tp + k.fn) / (k.tp + k.fp + k.fn + tn) * (k.tp / (k.tp + k.fp + k.fn + 1e-10))
                   + (1 - (k.tp + k.fn) / (k.tp + k.fp + k.fn + tn)) * (tn / (tn + k.fp + k.fn + 1e-10)) as bi,
                   (k.tp::double * tn - k.fp::double * k.fn) / sqrt((k.tp + k.fp)::double * (k.tp + k.fn) * (tn + k.fp) * (tn + k.fn) + 1e-10) as mcc,
                   case when c.tp + c.fp + c.fn = 0 then 1 else c.tp / (c.tp + c.fp + c.fn) end as trees from k join c using (image_id)),
    s as (select sum(tp) as tp, sum(fp) as fp, sum(fn) as fn from k)
    select round(2 * tp / (2 * tp + fp + fn), 6) as mean_dice_score, round(tp / (tp + fp), 6) as mean_precision, round(tp / (tp + fn), 6) as mean_recall,
           round(5 * tp / (tp + fp) * (tp / (tp + fn)) / (4 * tp / (tp + fp) + tp / (tp + fn)), 6) as mean_f2_score,
           round(tp / (tp + fp + fn), 6) as mean_iou_pixels, round((select avg(trees) from per), 6) as mean_iou_trees,
           round((select avg(mi) from per), 6) as mean_iou, round((select avg(bi) from per), 6) as mean_balanced_iou,
           round((select avg(mcc) from per), 6) as mean_mcc from s""")
def pixel_summary(spark, sf):
    from arborlake.operators import metrics

    px = fx(spark, sf, "fx_pixels").selectExpr("image_id", "x", "y", "pred_pct >= 9 as pred", "truth_pct >= 7 as truth")
    counts = metrics.confusion(px, F.col("pred"), F.col("truth"), ["image_id"])
    out = metrics.pixel_summary(counts, components.component_iou(px))
    return out.select(*[F.round(c, 6).alias(c) for c in out.columns])
