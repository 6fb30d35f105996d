"""Stand-in tables derived from the given tables, so that they grow with them.

``SHARED`` texts run unchanged in Spark and DuckDB (source tables in braces); ``DUCK`` texts are the
long forms the oracles use. Image ids come from key ranges: more data means more images, not fuller ones.
"""

from __future__ import annotations

import string

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arborlake.session import spread

IMAGE_SIDE = 144  # pixel width and height of the polygon images

SHARED: dict[str, str] = {
    # sparse 64x64 prediction / truth pairs on an integer scale
    "fx_pixels": """
        select cast(floor(l_orderkey / 2000) as int) as image_id, cast(l_partkey % 64 as int) as x,
               cast((l_suppkey * 7 + l_linenumber) % 64 as int) as y,
               max(cast(round(l_discount * 100) as int)) as pred_pct,
               max(cast(round(l_tax * 100) as int)) as truth_pct,
               max(case when l_partkey % 64 between 4 and 59 then 1 else 0 end) as buffer_mask
        from {lineitem} group by 1, 2, 3""",
    # ground-truth polygons: 10x10 slots per image, neighbours may overlap; shape 0 box, 1 triangle, 2 L
    "fx_gt_poly": """
        select cast(floor(p_partkey / 100) as int) as image_id, p_partkey as poly_id,
               cast(12 * (p_partkey % 10) + 2 + p_partkey * 3 % 4 as int) as x0,
               cast(12 * floor((p_partkey % 100) / 10) + 2 + p_partkey * 7 % 4 as int) as y0,
               cast(4 + p_size % 12 as int) as w, cast(4 + p_partkey * 7 % 11 as int) as h,
               cast(p_partkey % 3 as int) as shape, cast(p_partkey % 2 as int) as flipped
        from {part}""",
    # predictions: shifted copies with partly other shapes, one in five out of reach of any other
    "fx_pred_poly": """
        select cast(floor(p_partkey / 100) as int) as image_id, p_partkey as poly_id,
               cast(12 * (p_partkey % 10) + 2 + p_partkey * 3 % 4 + p_partkey * 13 % 5 - 2 as int) as x0,
               cast(12 * floor((p_partkey % 100) / 10) + 2 + p_partkey * 7 % 4 + p_partkey * 17 % 5 - 2
                    + case when p_partkey % 5 = 0 then 400 else 0 end as int) as y0,
               cast(4 + p_size % 12 as int) as w, cast(4 + p_partkey * 7 % 11 as int) as h,
               cast((p_partkey + floor(p_partkey / 7)) % 3 as int) as shape,
               cast(floor(p_partkey / 2) % 2 as int) as flipped
        from {part}""",
    # one geo-reference per polygon image
    "fx_meta": """
        select cast(floor(p_partkey / 100) as int) as image_id, 144 as width, 144 as height,
               cast(0.25 as double) as a, cast(0.0 as double) as b,
               cast(300000 + (min(p_partkey) % 40000) as double) as c,
               cast(0.0 as double) as d, cast(-0.25 as double) as e,
               cast(6700000 + (min(p_partkey) % 90000) as double) as f,
               case when floor(p_partkey / 100) % 4 = 0 then 32635 else 3067 end as epsg
        from {part} group by floor(p_partkey / 100)""",
    # patch metadata: 25 clusters two degrees apart, about 1% null coordinates
    "fx_patches": """
        select concat('img_', c_nationkey, '_', cast(floor(c_custkey / 500) as int), '_', c_custkey) as patch_key,
               concat('img_', c_nationkey, '_', cast(floor(c_custkey / 500) as int), '.tif') as source_image,
               case when c_custkey % 10 < 6 then 0 else cast(c_custkey * 31 % 10 as int) end as num_trees,
               case when c_custkey % 97 = 0 then null else cast(60.0 as double) + 2 * (c_nationkey % 5)
                    + cast(c_custkey % 10 as double) / 50 end as latitude,
               case when c_custkey % 97 = 0 then null else cast(20.0 as double) + 2 * floor(c_nationkey / 5)
                    + cast(c_custkey % 7 as double) / 50 end as longitude,
               cast(c_custkey % 8 * 128 as int) as pixel_x, cast(floor(c_custkey / 8) % 8 * 128 as int) as pixel_y
        from {customer}""",
    # file catalogue for pairing, suffix and skip-existing joins
    "fx_files": """
        select concat('/data/region_', o_custkey % 4, '/',
                      case o_orderkey % 3 when 0 then 'Images' when 1 then 'Geojsons' else 'Predictions' end,
                      case when o_orderkey % 3 = 2 and o_orderkey % 5 = 0 then '_b' else '' end,
                      case when o_orderkey % 11 = 0 then '/S' else '/T' end, cast(floor(o_orderkey / 3) as int),
                      case when o_orderkey % 3 <> 0 then '.geojson' when o_orderkey % 7 = 0 then '.jp2'
                           when o_orderkey % 2 = 0 then '.tif' else '.tiff' end) as path
        from {orders}""",
    # half-pixel points with exact copies; the id follows the position in raster order
    "fx_points": """
        select cast(floor(l_orderkey / 100) as int) as image_id,
               l_suppkey * 11 % 157 * 1000 + l_partkey * 7 % 199 as point_id,
               cast(l_partkey * 7 % 199 as double) / 2 as x, cast(l_suppkey * 11 % 157 as double) / 2 as y,
               cast(l_linenumber % 2 as int) as side
        from {lineitem}""",
}

DUCK: dict[str, str] = {
    # every 64-long embedding read as one 8x8 logit raster with a truth pattern and a buffer
    "fx_scores": """
        select image_id, cast(pos % 8 as int) as x, cast(floor(pos / 8) as int) as y, cast(v as double) * 10 as logit,
               cast(case when (pos * 7 + image_id) % 5 < 2 then 1 else 0 end as double) as truth,
               cast(case when pos % 8 between 1 and 6 then 1 else 0 end as double) as buffer
        from (select vec_id as image_id, generate_subscripts(embedding, 1) - 1 as pos, unnest(embedding) as v from embeddings)""",
    # the same embedding as 4 bands of 4x4 whole-number pixels, long form
    "fx_tile_pixels": """
        select image_id, cast(floor(pos / 16) as int) as band, cast(pos % 4 as int) as x,
               cast(floor((pos % 16) / 4) as int) as y, cast(pos % 16 as int) as pos,
               cast(greatest(0, round(200 + 800 * cast(v as double))) as double) as value
        from (select vec_id as image_id, generate_subscripts(embedding, 1) - 1 as pos, unnest(embedding) as v from embeddings)""",
    "fx_gt_vertices": "select * from (" + "{VERTICES:fx_gt_poly}" + ")",
    "fx_pred_vertices": "select * from (" + "{VERTICES:fx_pred_poly}" + ")",
    "fx_gt_edges": "{EDGES:fx_gt_vertices}",
    "fx_pred_edges": "{EDGES:fx_pred_vertices}",
    "fx_gt_areas": "{AREAS:fx_gt_edges}",
    "fx_pred_areas": "{AREAS:fx_pred_edges}",
    "fx_gt_lines": "{LINES:fx_gt_edges,fx_gt_areas}",
    "fx_pred_lines": "{LINES:fx_pred_edges,fx_pred_areas}",
}

# exact overlap of every prediction / truth pair: one join of left-to-right edges, signs multiplied
DUCK["fx_overlaps"] = """
    select image_id, pred_id, gt_id, sum(s * case
             when da * db >= 0 then (b - a) * (least(pa, pa - da) + least(pb, pb - db)) / 2
             else (b - a) * (da / (da - db) * (least(pa, pa - da) + pa + (pb - pa) * da / (da - db))
                           + db / (db - da) * (least(pb, pb - db) + pa + (pb - pa) * da / (da - db))) / 2 end) as inter
    from (select image_id, pred_id, gt_id, s, a, b,
                 pl + pm * (a - px) as pa, pl + pm * (b - px) as pb,
                 pl + pm * (a - px) - gl - gm * (a - gx) as da, pl + pm * (b - px) - gl - gm * (b - gx) as db
          from (select p.image_id, p.poly_id as pred_id, g.poly_id as gt_id, p.s * g.s as s,
                       greatest(p.xl, g.xl) as a, least(p.xr, g.xr) as b, p.xl as px, p.yl as pl, p.m as pm,
                       g.xl as gx, g.yl as gl, g.m as gm
                from fx_pred_lines p join fx_gt_lines g
                  on p.image_id = g.image_id and p.xl < g.xr and g.xl < p.xr))
    group by 1, 2, 3"""


def _vertices(poly: str) -> str:
    return f"""
        select image_id, poly_id, case when flipped = 1 then nv - 1 - n else n end as vertex_no, nv,
               cast(x0 + case shape
                 when 0 then case when n in (1, 2) then w else 0 end
                 when 1 then case n when 1 then w when 2 then 2 else 0 end
                 else case when n in (1, 2) then w when n in (3, 4) then floor(w / 2) else 0 end end as double) as x,
               cast(y0 + case shape
                 when 0 then case when n in (2, 3) then h else 0 end
                 when 1 then case n when 1 then 2 when 2 then h else 0 end
                 else case when n in (2, 3) then floor(h / 2) when n in (4, 5) then h else 0 end end as double) as y
        from (select *, case shape when 0 then 4 when 1 then 3 else 6 end as nv from {poly}), range(6) t(n)
        where n < nv"""


def _edges(vertices: str) -> str:
    return f"""
        select p.image_id, p.poly_id, p.vertex_no as edge_no, p.x as x0, p.y as y0, q.x as x1, q.y as y1
        from {vertices} p join {vertices} q on p.poly_id = q.poly_id and q.vertex_no = (p.vertex_no + 1) % p.nv"""


def _areas(edges: str) -> str:
    return f"""
        select image_id, poly_id, sum(x0 * y1 - x1 * y0) / 2 as signed,
               sum((x0 + x1) * (x0 * y1 - x1 * y0)) / 6 as s10, sum((y0 + y1) * (x0 * y1 - x1 * y0)) / 6 as s01,
               abs(sum(x0 * y1 - x1 * y0)) / 2 as area
        from {edges} group by 1, 2"""


def _lines(edges: str, areas: str) -> str:
    return f"""
        select e.image_id, e.poly_id, least(x0, x1) as xl, greatest(x0, x1) as xr,
               case when x0 < x1 then y0 else y1 end as yl, (y1 - y0) / (x1 - x0) as m,
               (case when x0 < x1 then -1 else 1 end) * sign(signed) as s
        from {edges} e join {areas} a on e.poly_id = a.poly_id where x0 <> x1"""


def duck_sql(name: str) -> str:
    """DuckDB text of a fixture."""
    if name in SHARED:
        return SHARED[name].format(**{t: t for t in _tables(SHARED[name])})
    text = DUCK[name]
    if text.startswith("{EDGES:"):
        return _edges(text[7:-1])
    if text.startswith("{AREAS:"):
        return _areas(text[7:-1])
    if text.startswith("{LINES:"):
        return _lines(*text[7:-1].split(","))
    if "{VERTICES:" in text:
        return _vertices(text.split("{VERTICES:")[1].split("}")[0])
    return text


def _tables(text: str) -> list[str]:
    return sorted({field for _, field, _, _ in string.Formatter().parse(text) if field})


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fx(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A shared fixture as a DataFrame."""
    text = SHARED[name]
    return spark.sql(text, **{t: table(spark, sf_dir, t) for t in _tables(text)})


def polygons(spark: SparkSession, sf_dir: str, which: str) -> DataFrame:
    """``gt`` or ``pred`` polygons: image_id, poly_id, ring."""

    corner = """named_struct(
        'x', cast(x0 + case shape when 0 then if(n in (1, 2), w, 0) when 1 then case n when 1 then w when 2 then 2 else 0 end
             else case when n in (1, 2) then w when n in (3, 4) then floor(w / 2) else 0 end end as double),
        'y', cast(y0 + case shape when 0 then if(n in (2, 3), h, 0) when 1 then case n when 1 then 2 when 2 then h else 0 end
             else case when n in (2, 3) then floor(h / 2) when n in (4, 5) then h else 0 end end as double))"""
    last = "case shape when 0 then 3 when 1 then 2 else 5 end"
    order = f"if(flipped = 1, sequence({last}, 0), sequence(0, {last}))"
    # a small file is one task: spread before rings are built and measured
    return spread(fx(spark, sf_dir, f"fx_{which}_poly"), "image_id", "poly_id").selectExpr("image_id", "poly_id", f"transform({order}, n -> {corner}) as ring")


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """8x8 logit rasters with truth and buffer: image_id, x, y, logit, truth, buffer."""
    cells = table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("image_id"), F.posexplode("embedding").alias("pos", "v")
    )
    return cells.selectExpr(
        "image_id", "cast(pos % 8 as int) as x", "cast(floor(pos / 8) as int) as y", "cast(v as double) * 10 as logit",
        "cast(case when (pos * 7 + image_id) % 5 < 2 then 1 else 0 end as double) as truth",
        "cast(case when pos % 8 between 1 and 6 then 1 else 0 end as double) as buffer",
    )


def tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """4-band 4x4 tiles: image_id, width, height, bands."""
    return table(spark, sf_dir, "embeddings").selectExpr(
        "vec_id as image_id", "4 as width", "4 as height",
        """transform(sequence(0, 3), b -> transform(slice(embedding, b * 16 + 1, 16),
             v -> cast(greatest(0, round(200 + 800 * cast(v as double))) as double))) as bands""",
    )


def tile_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tiles in long form: image_id, band, x, y, value."""
    rows = tiles(spark, sf_dir).select("image_id", F.posexplode("bands").alias("band", "values"))
    rows = rows.select("image_id", "band", F.posexplode("values").alias("pos", "value"))
    return rows.selectExpr("image_id", "band", "cast(pos % 4 as int) as x", "cast(floor(pos / 4) as int) as y", "value")
