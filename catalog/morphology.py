"""Morphology, peaks, regions and outlines."""

from pyspark.sql import functions as F

from arborlake.operators import morphology as M
from arborlake.operators import vectorize as V
from catalog.fixtures import fx, scores
from catalog.labels import _EIGHT, _MASK, _noise, _reach
from catalog.registry import query


def _sizes(px, side=64):
    return px.select("image_id").distinct().withColumns({"width": F.lit(side), "height": F.lit(side)})


_DISK2 = "dx * dx + dy * dy <= 4"


@query("dilate", f"""
    select distinct image_id, cast(x + dx as int) as x, cast(y + dy as int) as y from ({_MASK}), range(-2, 3) a(dx), range(-2, 3) b(dy)
    where {_DISK2} and x + dx between 0 and 63 and y + dy between 0 and 63""")
def dilate(spark, sf):
    px = _noise(spark, sf)
    return M.dilate(px, _sizes(px), 2)


_DENSE = "select image_id, x, y from fx_pixels where pred_pct >= 1"


@query("erode", f"""
    with m as ({_DENSE}), g as (select distinct image_id from m),
    miss as (select image_id, cx as x, cy as y from g, range(64) a(cx), range(64) b(cy) except select image_id, x, y from m)
    select image_id, x, y from m where not exists (select 1 from miss where miss.image_id = m.image_id
      and power(miss.x - m.x, 2) + power(miss.y - m.y, 2) <= 1)""")
def erode(spark, sf):
    px = fx(spark, sf, "fx_pixels").filter("pred_pct >= 1").select("image_id", "x", "y")
    return M.erode(px, _sizes(px), 1)


@query("gaussian_blur", f"""
    with k as (select o, exp(-0.5 * power(o / 1.5, 2)) / sum(exp(-0.5 * power(o / 1.5, 2))) over () as w from range(-6, 7) r(o)),
    m as ({_MASK}),
    row1 as (select image_id, tx, y, sum(w) as v from m, k, range(64) t(tx)
             where x = case when (tx + o + 128) % 128 < 64 then (tx + o + 128) % 128 else 127 - (tx + o + 128) % 128 end group by 1, 2, 3),
    blurred as (select image_id, tx as x, ty as y, sum(v * w) as value from row1, k, range(64) t(ty)
             where y = case when (ty + o + 128) % 128 < 64 then (ty + o + 128) % 128 else 127 - (ty + o + 128) % 128 end group by 1, 2, 3)
    select image_id, cast(x as int) as x, cast(y as int) as y, round(value, 6) as value from blurred""")
def gaussian_blur(spark, sf):
    px = _noise(spark, sf)
    rows = M.gaussian_blur(px, _sizes(px), 1.5)
    return rows.select("image_id", F.col("x").cast("int").alias("x"), F.col("y").cast("int").alias("y"), F.round("value", 6).alias("value"))


@query("local_maxima", """
    select image_id, x, y, logit as value from fx_scores s where logit > 1 and logit = (
      select max(logit) from fx_scores n where n.image_id = s.image_id and abs(n.x - s.x) <= 2 and abs(n.y - s.y) <= 2)""")
def local_maxima(spark, sf):
    return M.local_maxima(scores(spark, sf).select("image_id", "x", "y", F.col("logit").alias("value")), 5, 1.0)


@query("spaced_peaks", """
    with recursive c as (select image_id, x, y, pred_pct as v, y::bigint * 4294967296 + x as code from fx_pixels p
      where pred_pct > 0 and pred_pct = (select max(pred_pct) from fx_pixels n where n.image_id = p.image_id
        and abs(n.x - p.x) <= 3 and abs(n.y - p.y) <= 3)),
    o as (select *, row_number() over (partition by image_id order by v desc, code) as rn from c),
    walk as (select image_id, 0::bigint as rn, []::bigint[] as kept from (select distinct image_id from o)
      union all
      select w.image_id, o.rn, case when len(list_filter(w.kept, lambda k: abs(k % 4294967296 - o.x) < 3 and abs(floor(k / 4294967296) - o.y) < 3)) = 0
             then list_append(w.kept, o.code) else w.kept end from walk w join o on o.image_id = w.image_id and o.rn = w.rn + 1),
    last as (select image_id, unnest(kept) as code from (select *, row_number() over (partition by image_id order by rn desc) as z from walk) where z = 1)
    select image_id, cast(code % 4294967296 as int) as x, cast(floor(code / 4294967296) as int) as y from last""")
def spaced_peaks(spark, sf):
    px = fx(spark, sf, "fx_pixels").select("image_id", "x", "y", F.col("pred_pct").alias("value"))
    return M.spaced_peaks(px, 3).select("image_id", "x", "y")


def _regions(spark, sf, tile=32):
    px = fx(spark, sf, "fx_pixels").filter("pred_pct >= 4").select("image_id", "x", "y", F.col("pred_pct").cast("double").alias("value"))
    return M.seeded_regions(px, M.spaced_peaks(px, 4), tile=tile)


@query("seeded_regions")
def seeded_regions(spark, sf):
    return _regions(spark, sf)


_BLOCKS = "select image_id, x, y, cast(floor(y / 5) * 100 + floor(x / 7) as bigint) as region from fx_pixels where pred_pct >= 6"


@query("merge_small_regions", f"""
    with r as ({_BLOCKS}),
    small as (select image_id, region from r group by 1, 2 having count(*) < 9),
    grown as (select distinct image_id, region, x + dx as x, y + dy as y from r join small using (image_id, region), range(-1, 2) a(dx), range(-1, 2) b(dy)
              where dx * dx + dy * dy <= 1),
    votes as (select g.image_id, g.region, o.region as other, count(*) as n from grown g join r o on o.image_id = g.image_id and o.x = g.x and o.y = g.y
              where o.region <> g.region group by 1, 2, 3),
    best as (select *, row_number() over (partition by image_id, region order by n desc, other) as rn from votes)
    select r.image_id, r.x, r.y, coalesce(b.other, r.region) as region from r left join best b
      on b.image_id = r.image_id and b.region = r.region and b.rn = 1""")
def merge_small_regions(spark, sf):
    px = fx(spark, sf, "fx_pixels").filter("pred_pct >= 6").selectExpr("image_id", "x", "y", "floor(y / 5) * 100 + floor(x / 7) as region")
    return M.merge_small_regions(px, _sizes(px), 9, 1)


def _score_map(spark, sf):
    px = fx(spark, sf, "fx_pixels").select("image_id", "x", "y", (F.col("pred_pct") / 10).alias("value"))
    return px, _sizes(px)


@query("segment_instances")
def segment_instances(spark, sf):
    px, sizes = _score_map(spark, sf)
    return M.segment_instances(px, sizes, limit=0.55, min_pixels=6, min_distance=4)


def _outlines(source: str) -> str:
    """Filled 8-connected components of ``source`` (image_id, x, y) by a flood of what lies outside each of them:
    ``ext`` has the outside cells of a component's frame, ``turns`` the corners where its outer outline turns."""
    return f"""
    {_reach(source, _EIGHT)},
    c as (select image_id, component, node % 4294967296 as x, floor(node / 4294967296)::bigint as y from r),
    bb as (select image_id, component, min(x) - 1 as lx, max(x) + 1 as hx, min(y) - 1 as ly, max(y) + 1 as hy from c group by 1, 2),
    cols as (select *, unnest(generate_series(lx, hx)) as x from bb),
    cells as (select image_id, component, x, y from (select *, unnest(generate_series(ly, hy)) as y from cols) anti join c using (image_id, component, x, y)),
    ext as (select image_id, component, lx as x, ly as y from bb
            union select n.image_id, n.component, n.x, n.y from ext e join (values (1, 0), (-1, 0), (0, 1), (0, -1)) o(dx, dy) on true
                  join cells n on n.image_id = e.image_id and n.component = e.component and n.x = e.x + o.dx and n.y = e.y + o.dy),
    corners as (select image_id, component, x + ox as vx, y + oy as vy, count(*) as k, sum(abs((x + y) % 2)) as odd
                from ext, (values (0, 0), (0, 1), (1, 0), (1, 1)) o(ox, oy) group by 1, 2, 3, 4),
    turns as (select k.image_id, k.component, vx, vy, case when k = 2 then 2 else 1 end as visits from corners k join bb using (image_id, component)
              where vx between lx + 1 and hx and vy between ly + 1 and hy and (k in (1, 3) or k = 2 and odd <> 1))"""


@query("contours", f"""
    with recursive {_outlines(_MASK)}
    select image_id, component, cast(vx as double) as x, cast(vy as double) as y, cast(visits as bigint) as visits from turns""")
def contours(spark, sf):
    points = V.contours(_noise(spark, sf)).select("image_id", "component", F.explode("ring").alias("p"))
    return points.groupBy("image_id", "component", F.col("p.x").alias("x"), F.col("p.y").alias("y")).agg(F.count("*").alias("visits"))


@query("ring_vertices", f"""
    with m as ({_MASK}),
    corners as (select image_id, x + ox as vx, y + oy as vy, count(*) as k, sum(abs((x + y) % 2)) as odd
                from m, (values (0, 0), (0, 1), (1, 0), (1, 1)) o(ox, oy) group by 1, 2, 3)
    select image_id, cast(vx as double) as x, cast(vy as double) as y, cast(case when k = 2 then 2 else 1 end as bigint) as visits
    from corners where k in (1, 3) or k = 2 and odd <> 1""")
def ring_vertices(spark, sf):
    """Corners of all rings, holes too, with blocks small enough to cut most rings; straightened across their seams."""
    found = V.rings(_noise(spark, sf), ["image_id"], block=8).select("image_id", F.explode(V.drop_straight(F.col("ring"))).alias("p"))
    return found.groupBy("image_id", F.col("p.x").alias("x"), F.col("p.y").alias("y")).agg(F.count("*").alias("visits"))


@query("ring_areas", f"select image_id, cast(count(*) as double) as area from ({_MASK}) group by 1")
def ring_areas(spark, sf):
    """Outer rings less holes give back the pixel count, here with blocks small enough to cut most rings."""
    return V.rings(_noise(spark, sf), ["image_id"], block=8).groupBy("image_id").agg(F.sum("signed").alias("area"))


_LABELLED = "select image_id * 1000000 + cast(floor(y / 16) * 100 + floor(x / 16) as bigint) as image_id, x, y from fx_pixels"


@query("contours_from_labels", f"""
    with recursive {_outlines(_LABELLED)},
    filled as (select image_id, component, (hx - lx + 1) * (hy - ly + 1) - n as area
               from bb join (select image_id, component, count(*) as n from ext group by 1, 2) using (image_id, component)),
    best as (select *, row_number() over (partition by image_id order by area desc, component) as place from filled),
    points as (select image_id, component, sum(visits) as points, sum(visits * vx) as sx, sum(visits * vy) as sy from turns group by 1, 2)
    select cast(floor(image_id / 1000000) as int) as image_id, image_id % 1000000 as region, cast(area as double) as area,
           cast(points as int) as points, cast(sx as double) as sx, cast(sy as double) as sy
    from best join points using (image_id, component) where place = 1""")
def contours_from_labels(spark, sf):
    px = fx(spark, sf, "fx_pixels").selectExpr("image_id", "x", "y", "floor(y / 16) * 100 + floor(x / 16) as region")
    total = lambda c: F.aggregate("ring", F.lit(0.0), lambda a, p: a + p[c])
    return V.contours_from_labels(px).select("image_id", "region", "area", F.size("ring").alias("points"), total("x").alias("sx"), total("y").alias("sy"))


_REG = "r as (select image_id, x, y, cast(floor(y / 16) * 100 + floor(x / 16) as bigint) as region from fx_pixels)"


def _reg(spark, sf):
    return fx(spark, sf, "fx_pixels").selectExpr("image_id", "x", "y", "floor(y / 16) * 100 + floor(x / 16) as region")


@query("region_props", f"""
    with {_REG} select image_id, region, count(*) as area, sum(x)::bigint as sx, sum(y)::bigint as sy, sum(x * x)::bigint as sxx,
      sum(y * y)::bigint as syy, sum(x * y)::bigint as sxy from r group by 1, 2""")
def region_props(spark, sf):
    return V.region_props(_reg(spark, sf))


_CORE = f"""
    {_REG},
    core as (select image_id, region, x, y from r where not exists (
      select 1 from (values (1, 0), (-1, 0), (0, 1), (0, -1)) o(dx, dy) where r.x + dx between 0 and 63 and r.y + dy between 0 and 63
       and not exists (select 1 from r q where q.image_id = r.image_id and q.region = r.region and q.x = r.x + dx and q.y = r.y + dy))),
    m as (select image_id, region, count(*) as n, avg(x) as x0, avg(y) as y0, var_pop(x) + 1.0::double / 12 as vx, var_pop(y) + 1.0::double / 12 as vy,
                 covar_pop(x, y) as vxy from core group by 1, 2 having count(*) >= 5),
    e as (select *, 4 * sqrt((vx + vy) / 2 + sqrt(power((vx - vy) / 2, 2) + vxy * vxy)) as aa,
                 4 * sqrt((vx + vy) / 2 - sqrt(power((vx - vy) / 2, 2) + vxy * vxy)) as bb, atan2(2 * vxy, vx - vy) / 2 as ang from m)"""


@query("fit_ellipses", f"""
    with {_CORE} select image_id, region, n as area, round(x0, 6) as x0, round(y0, 6) as y0, round(aa, 6) as axis_a, round(bb, 6) as axis_b,
      round(degrees(ang), 4) as angle_deg from e""")
def fit_ellipses(spark, sf):
    px = _reg(spark, sf)
    rows = V.fit_ellipses(px, _sizes(px), 20, 1, 0.9)
    return rows.select("image_id", "region", "area", *[F.round(c, 6).alias(c) for c in ("x0", "y0", "axis_a", "axis_b")], F.round("angle_deg", 4).alias("angle_deg"))


@query("ellipse_polygons", f"""
    with {_CORE} select image_id, region, cast(t as int) as point_no,
      round(0.25 * (x0 + 0.45 * aa * cos(t * 2 * pi() / 19) * cos(ang) - 0.45 * bb * sin(t * 2 * pi() / 19) * sin(ang)) + 1000, 4) as x,
      round(-0.25 * (y0 + 0.45 * aa * cos(t * 2 * pi() / 19) * sin(ang) + 0.45 * bb * sin(t * 2 * pi() / 19) * cos(ang)) + 5000, 4) as y
    from e, range(20) p(t) where 0.45 * aa * 0.45 * bb * 0.0625 * 9.5 * sin(2 * pi() / 19) >= 3""")
def ellipse_polygons(spark, sf):
    px = _reg(spark, sf)
    meta = _sizes(px).selectExpr("image_id", "0.25D as a", "0.0D as b", "1000.0D as c", "0.0D as d", "-0.25D as e", "5000.0D as f")
    rows = V.ellipse_polygons(V.fit_ellipses(px, _sizes(px), 20, 1, 0.9), meta, 20, min_area=3.0)
    rows = rows.select("image_id", "region", F.posexplode("ring").alias("point_no", "p")).filter("point_no < 20")
    return rows.select("image_id", "region", "point_no", F.round("p.x", 4).alias("x"), F.round("p.y", 4).alias("y"))
