"""Band, value and resampling operators on tiles and pixel tables."""

from pyspark.sql import functions as F

from arborlake.functions import bands as B
from arborlake.functions import coords
from arborlake.operators import raster
from catalog.fixtures import fx, polygons, scores, tile_pixels, tiles
from catalog.registry import query


def _long(df, *keep):
    """Tile arrays as rows image_id, band, pos, value."""
    rows = df.select("image_id", *keep, F.posexplode("bands").alias("band", "values"))
    return rows.select("image_id", *keep, "band", F.posexplode("values").alias("pos", "value"))


@query("reorder_bands", """
    select image_id, cast(case band when 3 then 0 else band + 1 end as int) as band, pos, value from fx_tile_pixels""")
def reorder_bands(spark, sf):
    return _long(tiles(spark, sf).withColumn("bands", B.reorder_bands(F.col("bands"), [3, 0, 1, 2])))


@query("check_bands", "select image_id, band, pos, value from fx_tile_pixels")
def check_bands(spark, sf):
    return _long(raster.check_bands(tiles(spark, sf), [3, 0, 1, 2]))


@query("mask_nodata", """
    select image_id, band, pos, case when value = 0 then 0 when value = 200 then 0
        when value < 100 then 0 else value end as value from fx_tile_pixels""")
def mask_nodata(spark, sf):
    # 200 is the stated nodata value; small values stand for the missing-data floor
    low = B.map_bands(F.col("bands"), lambda v: F.when(v < 100, F.lit(-3.4e38)).otherwise(v))
    rows = tiles(spark, sf).withColumn("bands", low)
    rows = rows.withColumn("bands", B.map_bands(F.col("bands"), lambda v: B.mask_nodata(B.mask_nodata(v), F.lit(200.0))))
    return _long(rows)


@query("clip_uint8", """
    select image_id, band, pos, cast(trunc(least(greatest(value * 1.5 - 100.25, 0), 255)) as int) as value from fx_tile_pixels""")
def clip_uint8(spark, sf):
    return _long(tiles(spark, sf).withColumn("bands", B.map_bands(F.col("bands"), lambda v: B.clip_uint8(v * 1.5 - 100.25))))


@query("scale_by_dtype", """
    select image_id, band, pos, round(value / case image_id % 3 when 0 then 65535 when 1 then 255 else 1 end, 9) as value
    from fx_tile_pixels""")
def scale_by_dtype(spark, sf):
    kind = F.when(F.col("image_id") % 3 == 0, "uint16").when(F.col("image_id") % 3 == 1, "uint8").otherwise("float32")
    rows = tiles(spark, sf).withColumn("dtype", kind)
    return _long(rows.withColumn("bands", B.map_bands(F.col("bands"), lambda v: F.round(B.scale_by_dtype(v, F.col("dtype")), 9))))


@query("nonzero_percentiles", """
    select image_id, band, round(quantile_cont(value, 0.01), 6) as p_low, round(quantile_cont(value, 0.99), 6) as p_high
    from fx_tile_pixels where value > 0 group by 1, 2""")
def nonzero_percentiles(spark, sf):
    rows = raster.nonzero_percentiles(tile_pixels(spark, sf))
    return rows.select("image_id", "band", F.round("p_low", 6).alias("p_low"), F.round("p_high", 6).alias("p_high"))


_STRETCH = """
    with p as (select image_id{key}, quantile_cont(value, 0.01) as p1, quantile_cont(value, 0.99) as p99
               from fx_tile_pixels where value > 0 group by image_id{key})
    select t.image_id, t.band, t.x, t.y,
           case when coalesce(p99, 0) <> coalesce(p1, 0)
                then cast(trunc(least(greatest((value - p1) / (p99 - p1) * 255, 0), 255)) as int)
                when coalesce(p1, 0) = 0 then 0 else 255 end as value
    from fx_tile_pixels t left join p on t.image_id = p.image_id {cond}"""


@query("stretch_channelwise", _STRETCH.format(key=", band", cond="and t.band = p.band"))
def stretch_channelwise(spark, sf):
    return raster.stretch_uint8(tile_pixels(spark, sf), "channel")


@query("stretch_imagewise", _STRETCH.format(key="", cond=""))
def stretch_imagewise(spark, sf):
    return raster.stretch_uint8(tile_pixels(spark, sf), "image")


@query("max_normalise", """
    select image_id, band, x, y, cast(trunc(value / max(value) over (partition by image_id) * 255) as int) as value from fx_tile_pixels""")
def max_normalise(spark, sf):
    return raster.max_normalise(tile_pixels(spark, sf))


@query("unit_and_signed", """
    select image_id, band, pos, round(value / 255, 9) as unit, (value / 512 + 1) * 127.5 as signed from fx_tile_pixels""")
def unit_and_signed(spark, sf):
    rows = _long(tiles(spark, sf))
    return rows.select("image_id", "band", "pos", F.round(B.to_unit(F.col("value")), 9).alias("unit"),
                       B.from_signed(F.col("value") / 512).alias("signed"))


@query("composites", """
    select image_id, 'true' as kind, cast(band - 1 as int) as band, pos, value from fx_tile_pixels where band in (1, 2, 3)
    union all select image_id, 'false', band, pos, value from fx_tile_pixels where band in (0, 1, 2)""")
def composites(spark, sf):
    both = F.explode(F.array(*[
        F.struct(F.lit(k).alias("kind"), B.composite(F.col("bands"), k).alias("bands")) for k in ("true", "false")
    ]))
    return _long(tiles(spark, sf).select("image_id", both.alias("c")).select("image_id", "c.kind", "c.bands"), "kind")


@query("activate", """
    select image_id, x, y, round(1 / (1 + exp(-logit)), 9) as sigmoid,
           round((exp(logit) - exp(-logit)) / (exp(logit) + exp(-logit)), 9) as tanh from fx_scores""")
def activate(spark, sf):
    z = F.col("logit")
    return scores(spark, sf).select("image_id", "x", "y", F.round(B.activate(z), 9).alias("sigmoid"), F.round(B.activate(z, "tanh"), 9).alias("tanh"))


@query("threshold", """
    select image_id, count(*) filter (pred_pct >= 5) as at_least, count(*) filter (pred_pct > 5) as above from fx_pixels group by 1""")
def threshold(spark, sf):
    hit = lambda inc: F.count(F.when(B.threshold(F.col("pred_pct"), 5, inc), 1))
    return fx(spark, sf, "fx_pixels").groupBy("image_id").agg(hit(True).alias("at_least"), hit(False).alias("above"))


@query("rescale_standardise", """
    select image_id, band, pos, round((value * 0.00390625 - case band when 0 then 0.5 when 1 then 0.25 when 2 then 0.5 else 0.75 end)
           / case band when 0 then 0.5 when 1 then 0.25 when 2 then 0.2 else 0.125 end, 9) as value from fx_tile_pixels""")
def rescale_standardise(spark, sf):
    scaled = B.map_bands(F.col("bands"), lambda v: B.rescale(v, 0.00390625))
    out = B.standardise(scaled, [0.25, 0.5, 0.75], [0.25, 0.2, 0.125])
    rows = _long(tiles(spark, sf).withColumn("bands", out))
    return rows.withColumn("value", F.round("value", 9))


@query("resize_nearest", """
    select image_id, band, cast(tx as int) as x, cast(ty as int) as y, value from fx_tile_pixels, range(6) a(tx), range(3) b(ty)
    where x = floor(tx * 4 / 6) and y = floor(ty * 4 / 3)""")
def resize_nearest(spark, sf):
    sizes = tiles(spark, sf).select("image_id", "width", "height")
    return raster.resize(tile_pixels(spark, sf), sizes, 6, 3, "nearest")


@query("resize_bilinear", """
    select image_id, band, cast(tx as int) as x, cast(ty as int) as y, round(sum(value
        * greatest(0, 1 - abs(least(greatest((tx + 0.5) * 4 / 7 - 0.5, 0), 3) - x))
        * greatest(0, 1 - abs(least(greatest((ty + 0.5) * 4 / 6 - 0.5, 0), 3) - y))), 6) as value
    from fx_tile_pixels, range(7) a(tx), range(6) b(ty) group by 1, 2, 3, 4""")
def resize_bilinear(spark, sf):
    sizes = tiles(spark, sf).select("image_id", "width", "height")
    rows = raster.resize(tile_pixels(spark, sf), sizes, 7, 6, "bilinear")
    return rows.select("image_id", "band", F.col("x").cast("int").alias("x"), F.col("y").cast("int").alias("y"), F.round("value", 6).alias("value"))


def _by_band(df, fn):
    return df.withColumn("bands", F.transform("bands", fn))


@query("pad_to", """
    select g.image_id, cast(b as int) as band, cast(i as int) as pos, coalesce(value, 0) as value
    from (select image_id, b, i from (select distinct image_id from fx_tile_pixels), range(4) bb(b), range(30) p(i)) g
    left join fx_tile_pixels t on t.image_id = g.image_id and t.band = b and t.x = i % 6 and t.y = floor(i / 6)""")
def pad_to(spark, sf):
    return _long(_by_band(tiles(spark, sf), lambda b: B.pad_to(b, F.col("width"), F.col("height"), 6, 5)))


@query("center_crop", """
    select image_id, band, cast((y - 1) * 2 + x - 1 as int) as pos, value from fx_tile_pixels where x between 1 and 2 and y between 1 and 2""")
def center_crop(spark, sf):
    return _long(_by_band(tiles(spark, sf), lambda b: B.center_crop_or_pad(b, F.col("width"), F.col("height"), 2)))


@query("center_pad", """
    select g.image_id, cast(b as int) as band, cast(i as int) as pos, coalesce(value, 0) as value
    from (select image_id, b, i from (select distinct image_id from fx_tile_pixels), range(4) bb(b), range(49) p(i)) g
    left join fx_tile_pixels t on t.image_id = g.image_id and t.band = b and t.x = i % 7 - 1 and t.y = floor(i / 7) - 1""")
def center_pad(spark, sf):
    return _long(_by_band(tiles(spark, sf), lambda b: B.center_crop_or_pad(b, F.col("width"), F.col("height"), 7)))


@query("crop_pixels", """
    select image_id, cast(x - 8 as int) as x, cast(y - 8 as int) as y, pred_pct from fx_pixels
    where x between 8 and 55 and y between 8 and 55""")
def crop_pixels(spark, sf):
    px = fx(spark, sf, "fx_pixels").select("image_id", "x", "y", "pred_pct")
    sizes = px.select("image_id").distinct().withColumns({"width": F.lit(64), "height": F.lit(64)})
    return raster.crop_or_pad_pixels(px, sizes, 48)


# coordinates


@query("geo_to_pixel", """
    select v.image_id, v.poly_id, cast(vertex_no as int) as vertex_no,
           cast(trunc((a * x + c + 0.1 - c) / 0.25) as int) as col,
           cast(trunc(height + (f - 0.25 * height - (f - 0.25 * y - 0.05)) / 0.25) as int) as row
    from fx_gt_vertices v join fx_meta m using (image_id)""")
def geo_to_pixel(spark, sf):
    rows = polygons(spark, sf, "gt").join(fx(spark, sf, "fx_meta"), "image_id")
    rows = rows.select("image_id", "poly_id", "a", "c", "f", "height", F.posexplode("ring").alias("vertex_no", "p"))
    gx, gy = F.col("a") * F.col("p.x") + F.col("c") + 0.1, F.col("f") - 0.25 * F.col("p.y") - 0.05
    col, row = coords.geo_to_pixel(gx, gy, F.col("c"), F.col("f") - 0.25 * F.col("height"), F.lit(0.25), F.lit(0.25), F.col("height"))
    return rows.select("image_id", "poly_id", "vertex_no", col.alias("col"), row.alias("row"))


@query("pixel_to_geo", """
    select image_id, poly_id, cast(vertex_no as int) as vertex_no, a * x + b * y + c as gx, d * x + e * y + f as gy,
           a * (x + 0.5) + b * (y + 0.5) + c as centre_x, d * (x + 0.5) + e * (y + 0.5) + f as centre_y
    from fx_gt_vertices join fx_meta using (image_id)""")
def pixel_to_geo(spark, sf):
    rows = polygons(spark, sf, "gt").join(fx(spark, sf, "fx_meta"), "image_id")
    rows = rows.select("image_id", "poly_id", *"abcdef", F.posexplode("ring").alias("vertex_no", "p"))
    gx, gy = coords.pixel_to_geo(F.col("p.x"), F.col("p.y"), F.col)
    cx, cy = coords.pixel_to_geo(F.col("p.x"), F.col("p.y"), F.col, 0.5)
    return rows.select("image_id", "poly_id", "vertex_no", gx.alias("gx"), gy.alias("gy"), cx.alias("centre_x"), cy.alias("centre_y"))


def _inverse_sql(x: str, y: str, lon0: str) -> tuple[str, str]:
    """Inverse transverse Mercator in SQL by the meridian-arc footpoint series, independent of the engine's form."""
    a, f = "6378137.0", "(1 / 298.257223563)"
    e2 = f"({f} * (2 - {f}))"
    ep2 = f"({e2} / (1 - {e2}))"
    e1 = f"((1 - sqrt(1 - {e2})) / (1 + sqrt(1 - {e2})))"
    mu = f"({y} / 0.9996 / ({a} * (1 - {e2} / 4 - 3 * power({e2}, 2) / 64 - 5 * power({e2}, 3) / 256 - 175 * power({e2}, 4) / 16384)))"
    phi = (f"({mu} + (3 * {e1} / 2 - 27 * power({e1}, 3) / 32) * sin(2 * {mu}) + (21 * power({e1}, 2) / 16 - 55 * power({e1}, 4) / 32) * sin(4 * {mu})"
           f" + (151 * power({e1}, 3) / 96) * sin(6 * {mu}) + (1097 * power({e1}, 4) / 512) * sin(8 * {mu}))")
    return a, e2, ep2, phi


def _lonlat_sql() -> str:
    a, e2, ep2, phi = _inverse_sql("x", "y", "lon0")
    return f"""
      select *, degrees(phi - (n1 * tan(phi) / r1) * (power(d1, 2) / 2 - (5 + 3 * t1 + 10 * c1 - 4 * c1 * c1 - 9 * {ep2}) * power(d1, 4) / 24
                 + (61 + 90 * t1 + 298 * c1 + 45 * t1 * t1 - 252 * {ep2} - 3 * c1 * c1) * power(d1, 6) / 720
                 - (1385 + 3633 * t1 + 4095 * t1 * t1 + 1575 * t1 * t1 * t1) * power(d1, 8) / 40320)) as lat,
             lon0 + degrees((d1 - (1 + 2 * t1 + c1) * power(d1, 3) / 6 + (5 - 2 * c1 + 28 * t1 - 3 * c1 * c1 + 8 * {ep2} + 24 * t1 * t1) * power(d1, 5) / 120
                 - (61 + 662 * t1 + 1320 * t1 * t1 + 720 * t1 * t1 * t1) * power(d1, 7) / 5040) / cos(phi)) as lon
      from (select *, power(tan(phi), 2) as t1, {ep2} * power(cos(phi), 2) as c1, {a} / sqrt(1 - {e2} * power(sin(phi), 2)) as n1,
                   {a} * (1 - {e2}) / power(1 - {e2} * power(sin(phi), 2), 1.5) as r1,
                   (x - 500000) / ({a} / sqrt(1 - {e2} * power(sin(phi), 2)) * 0.9996) as d1
            from (select *, {phi} as phi from src))"""


@query("tm_to_lonlat", f"""
    with src as (select image_id, c as x, f as y, 27 as lon0 from fx_meta)
    select image_id, round(lon, 5) as lon, round(lat, 5) as lat from ({_lonlat_sql()})""")
def tm_to_lonlat(spark, sf):
    g = coords.tm_to_lonlat(F.col("c"), F.col("f"), coords.grid_for_epsg(3067))
    rows = fx(spark, sf, "fx_meta").withColumn("g", g)
    return rows.select("image_id", F.round("g.lon", 5).alias("lon"), F.round("g.lat", 5).alias("lat"))


@query("image_center_lonlat", f"""
    with src as (select image_id, c + 0.25 * width / 2 as x, f - 0.25 * height / 2 as y, 27 as lon0 from fx_meta)
    select image_id, round(lon, 5) as longitude, round(lat, 5) as latitude from ({_lonlat_sql()})""")
def image_center_lonlat(spark, sf):
    from arborlake.sources.tiles import image_center_lonlat as center

    rows = center(fx(spark, sf, "fx_meta"), [3067, 32635])
    return rows.select("image_id", F.round("longitude", 5).alias("longitude"), F.round("latitude", 5).alias("latitude"))


@query("align_crs", f"""
    with src as (select v.image_id, poly_id, vertex_no, c + 0.25::double * x as x, f - 0.25::double * y as y, 27 as lon0,
                        case when v.image_id % 2 = 1 then 32636 else epsg end as epsg
                 from fx_gt_vertices v join fx_meta m using (image_id))
    select image_id, poly_id, cast(vertex_no as int) as vertex_no, cast(epsg as int) as epsg, round(lon, 4) as lon, round(lat, 4) as lat,
           round(x, 3) as back_x, round(y, 3) as back_y from ({_lonlat_sql()})""")
def align_crs(spark, sf):
    """True rings moved into the system of their file's predictions; odd files have theirs in a zone of another meridian.

    Degrees are compared with the independent series, and the way back has to end at the same millimetre.
    """
    from arborlake.operators.vectorize import to_map
    from arborlake.plans.evaluate import align_crs as align

    meta = fx(spark, sf, "fx_meta")
    truth = to_map(polygons(spark, sf, "gt"), meta).join(meta.select("image_id", "epsg"), "image_id")
    pred = meta.select("image_id", F.when(F.col("image_id") % 2 == 1, 32636).otherwise(F.col("epsg")).alias("epsg"))
    rows = align(pred, truth, ["image_id"], [3067, 32635, 32636]).select("image_id", "poly_id", "epsg", F.posexplode("ring").alias("vertex_no", "p"))
    systems = [3067, 32635, 32636]
    rows = rows.withColumn("g", coords.to_lonlat(F.col("p.x"), F.col("p.y"), F.col("epsg"), systems))
    rows = rows.withColumn("o", coords.reproject(F.col("p.x"), F.col("p.y"), F.col("epsg"), F.lit(3067), systems))
    return rows.select("image_id", "poly_id", "vertex_no", "epsg", F.round("g.lon", 4).alias("lon"), F.round("g.lat", 4).alias("lat"),
                       F.round("o.x", 3).alias("back_x"), F.round("o.y", 3).alias("back_y"))
