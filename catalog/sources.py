"""File catalogues, GeoJSON and patch store."""

import uuid

from pyspark.sql import functions as F

from arborlake.functions import geometry as geo
from arborlake.session import ensure_checkpoint_dir, join_large
from arborlake.sources import files, geojson, patches, tiles as tile_source
from catalog.fixtures import fx, polygons, tile_pixels, tiles
from catalog.registry import query


def _scratch(spark) -> str:
    """A fresh name in the shared folder the session checkpoints to."""
    return f"{ensure_checkpoint_dir(spark)}/out-{uuid.uuid4().hex}"


_IMAGES = "(path like '%.tiff' or path like '%.tif' or path like '%.jp2')"


@query("image_catalog", f"select path from fx_files where {_IMAGES}")
def image_catalog(spark, sf):
    return files.image_catalog(fx(spark, sf, "fx_files"))


_LABEL = "regexp_replace(replace(i.path, '/Images/', '/Geojsons/'), '\\.[^./]*$', '.geojson')"


@query("pair_labels", f"""
    select i.path as image_path, l.path as label_path from fx_files i join fx_files l on l.path = {_LABEL}
    where (i.path like '%.tiff' or i.path like '%.tif' or i.path like '%.jp2')""")
def pair_labels(spark, sf):
    return files.pair_labels(fx(spark, sf, "fx_files"))[0]


@query("unpaired_images", f"""
    select i.path as image_path from fx_files i where (i.path like '%.tiff' or i.path like '%.tif' or i.path like '%.jp2')
    and {_LABEL} not in (select path from fx_files)""")
def unpaired_images(spark, sf):
    return files.pair_labels(fx(spark, sf, "fx_files"))[1]


_TRIPLES = """
    f as (select path, regexp_extract(path, '^(.*)/[^/]*/[^/]*$', 1) as root, regexp_extract(path, '([^/]*)/[^/]*$', 1) as leaf,
                 regexp_extract(path, '([^/]*)\\.[^./]*$', 1) as stem from fx_files),
    t as (select i.root, i.stem, i.path as image_path, g.path as truth_path, p.path as pred_path, p.root || '/' || p.leaf as pred_set
          from f i join f g on i.root = g.root and i.stem = g.stem join f p on p.root = i.root and p.stem = i.stem
          where i.leaf = 'Images' and (i.path like '%.tif' or i.path like '%.tiff') and g.leaf = 'Geojsons' and g.path like '%.geojson'
            and p.leaf like 'Predictions%' and p.path like '%.geojson')"""


@query("find_triples", f"with {_TRIPLES} select * from t")
def find_triples(spark, sf):
    return files.find_triples(fx(spark, sf, "fx_files"))


_KEYS = ["T1", "T22.", "T404", "T5", "nothing"]


@query("filter_by_keys", "with " + _TRIPLES + " select image_path, truth_path from t where " + " or ".join(f"contains(truth_path, '{k}')" for k in _KEYS))
def filter_by_keys(spark, sf):
    rows = files.find_triples(fx(spark, sf, "fx_files"))
    return files.filter_by_keys(rows, _KEYS).select("image_path", "truth_path")


@query("filter_by_key_table", """
    select path from fx_files where try_cast(regexp_extract(path, 'T([0-9]+)\\.', 1) as bigint) in (select c_custkey from customer)""")
def filter_by_key_table(spark, sf):
    keys = spark.read.parquet(f"{sf}/customer.parquet").selectExpr("concat('T', c_custkey, '.') as key")
    return files.semi_by_substring(fx(spark, sf, "fx_files"), keys, "path")


@query("skip_done", """
    select path from fx_files where (path like '%.tiff' or path like '%.tif' or path like '%.jp2')
    and regexp_extract(path, '^(.*)/[^/]*/[^/]*$', 1) || '|' || regexp_extract(path, '([^/]*)\\.[^./]*$', 1) not in (
      select regexp_extract(path, '^(.*)/[^/]*/[^/]*$', 1) || '|' || regexp_extract(path, '([^/]*)\\.[^./]*$', 1) from fx_files where path like '%/Predictions%')""")
def skip_done(spark, sf):
    rows = fx(spark, sf, "fx_files")
    return files.skip_done(files.image_catalog(rows), rows.filter(F.col("path").contains("/Predictions")))


@query("limit_samples", f"select path from fx_files where {_IMAGES} order by path limit 25")
def limit_samples(spark, sf):
    return files.limit_samples(files.image_catalog(fx(spark, sf, "fx_files")), 25)


@query("prediction_sets", """
    select distinct regexp_extract(path, '^(.*)/[^/]*$', 1) as pred_set from fx_files where path like '%/Predictions%'""")
def prediction_sets(spark, sf):
    return files.prediction_sets(fx(spark, sf, "fx_files"))


@query("suffix_union", """
    select path from fx_files where path like '%.tiff' union all select path from fx_files where path like '%.tif'
    union all select path from fx_files where path like '%.jp2'""")
def suffix_union(spark, sf):
    rows = fx(spark, sf, "fx_files")
    out = None
    for suffix in files.IMAGE_SUFFIXES:
        part = files.image_catalog(rows, [suffix])
        out = part if out is None else out.unionByName(part)
    return out


@query("stem_intersection", """
    select regexp_extract(path, '([^/]*)\\.[^./]*$', 1) as stem from fx_files where path like '%/Images/%'
    intersect select regexp_extract(path, '([^/]*)\\.[^./]*$', 1) from fx_files where path like '%/Predictions%'""")
def stem_intersection(spark, sf):
    rows = fx(spark, sf, "fx_files").withColumn("stem", files.stem(F.col("path")))
    return rows.filter("path like '%/Images/%'").select("stem").intersect(rows.filter("path like '%/Predictions%'").select("stem"))


def _documents(spark, sf):
    """GeoJSON text, ten polygons to a file: Polygon, MultiPolygon, two-point rings and null geometries."""
    kind = F.col("poly_id") % 11
    points = lambda r: F.to_json(F.transform(r, lambda p: F.array(p["x"], p["y"])))
    ring = points(F.when(kind == 3, F.slice("ring", 1, 2)).otherwise(F.col("ring")))
    geometry = (
        F.when(kind == 5, F.lit("null"))
        .when(kind % 2 == 0, F.concat(F.lit('{"type":"MultiPolygon","coordinates":[['), ring, F.lit("]]}")))
        .otherwise(F.concat(F.lit('{"type":"Polygon","coordinates":['), ring, F.lit("]}")))
    )
    rows = polygons(spark, sf, "gt").select(
        "image_id", F.floor(F.col("poly_id") / 10).alias("doc_id"), "poly_id",
        F.concat(F.lit('{"type":"Feature","properties":{"n":'), F.col("poly_id").cast("string"), F.lit('},"geometry":'), geometry, F.lit("}")).alias("f"),
    )
    docs = rows.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("poly_id", "f"))).alias("fs"))
    head = F.lit('{"type":"FeatureCollection","crs":{"type":"name","properties":{"name":"EPSG:3067"}},"features":[')
    return docs.select("doc_id", F.concat(head, F.array_join(F.transform("fs", lambda s: s["f"]), ","), F.lit("]}")).alias("value"))


@query("read_geojson_labels", """
    select cast(floor(poly_id / 10) as bigint) as doc_id, cast(poly_id % 10 as int) as ordinal, cast(vertex_no as int) as vertex_no, x, y
    from fx_gt_vertices where poly_id % 11 not in (3, 5)""")
def read_geojson_labels(spark, sf):
    rows = geojson.read_geojson_labels(_documents(spark, sf), ["doc_id"])
    return rows.select("doc_id", "ordinal", F.posexplode("ring").alias("vertex_no", "p")).select("doc_id", "ordinal", "vertex_no", "p.x", "p.y")


@query("read_geojson_labels_strict", """
    select cast(floor(poly_id / 10) as bigint) as doc_id, cast(poly_id % 10 as int) as ordinal, count(*) as points
    from fx_gt_vertices where poly_id % 11 % 2 = 0 group by 1, 2""")
def read_geojson_labels_strict(spark, sf):
    rows = geojson.read_geojson_labels(_documents(spark, sf), ["doc_id"], strict_multipolygon=True)
    return rows.select("doc_id", "ordinal", F.size("ring").cast("bigint").alias("points"))


@query("read_geojson_features", """
    select cast(floor(poly_id / 10) as bigint) as doc_id, cast(poly_id % 10 as bigint) as poly_id, 3067 as epsg,
           cast(poly_id as bigint) as n, count(*) as points
    from fx_gt_vertices where poly_id % 11 not in (3, 5) group by fx_gt_vertices.poly_id""")
def read_geojson_features(spark, sf):
    rows = geojson.read_geojson_features(_documents(spark, sf), ["doc_id"])
    return rows.select("doc_id", "poly_id", "epsg", F.get_json_object("properties", "$.n").cast("bigint").alias("n"),
                       F.size("ring").cast("bigint").alias("points"))


def _holed(spark, sf):
    """Every box and its neighbour's box as two parts of one feature, the first with a hole in its middle."""
    boxes = fx(spark, sf, "fx_gt_poly").select("image_id", "poly_id", "x0", "y0", "w", "h")
    box = "array(named_struct('x', {x}, 'y', {y}), named_struct('x', {x} + {w}, 'y', {y}), named_struct('x', {x} + {w}, 'y', {y} + {h}), named_struct('x', {x}, 'y', {y} + {h}))"
    outer = box.format(x="cast(x0 as double)", y="cast(y0 as double)", w="w", h="h")
    hole = box.format(x="cast(x0 + w / 4D as double)", y="cast(y0 + h / 4D as double)", w="w / 2D", h="h / 2D")
    apart = box.format(x="cast(x0 + 200 as double)", y="cast(y0 as double)", w="w", h="2")
    return boxes.selectExpr("image_id", "poly_id", f"{outer} as ring", f"array(array({outer}, {hole}), array({apart})) as geometry")


@query("read_geojson_multipart", """
    select image_id, poly_id as poly_id, 2::int as parts, 2::int as rings, round(w * h * 0.75::double + w * 2, 6) as area,
           round((w * h * 0.75::double * (x0 + w / 2.0::double) + w * 2 * (x0 + 200 + w / 2.0::double)) / (w * h * 0.75::double + w * 2), 6) as cx from fx_gt_poly""")
def read_geojson_multipart(spark, sf):
    """Parts and holes written, read back and measured."""
    lines = geojson.feature_collections(_holed(spark, sf), fx(spark, sf, "fx_meta"))
    path = _scratch(spark)
    geojson.write_geojson(lines, path)
    rows = geojson.read_geojson_features(spark.read.text(path, wholetext=True), ["image_id"])
    order = _holed(spark, sf).selectExpr("image_id", "poly_id as own", "row_number() over (partition by image_id order by poly_id) - 1 as poly_id")
    m = geo.geometry_moments(F.col("geometry"))
    rows = rows.join(order, ["image_id", "poly_id"])
    return rows.select("image_id", F.col("own").alias("poly_id"), F.size("geometry").alias("parts"), F.size(F.get("geometry", F.lit(0))).alias("rings"),
                       F.round(m["m00"], 6).alias("area"), F.round(m["cx"], 6).alias("cx"))


@query("overlap_with_holes", """
    with b as (select image_id, poly_id, x0::double as x0, y0::double as y0, w::double as w, h::double as h from fx_gt_poly),
    pieces as (select image_id, poly_id, 1 as s, x0, y0, x0 + w as x1, y0 + h as y1 from b
         union all select image_id, poly_id, -1, x0 + w / 4, y0 + h / 4, x0 + w * 0.75, y0 + h * 0.75 from b
         union all select image_id, poly_id, 1, x0 + 200, y0, x0 + 200 + w, y0 + 2 from b)
    select l.image_id, l.poly_id as left_id, r.poly_id as right_id,
           round(sum(l.s * r.s * greatest(0, least(l.x1, r.x1) - greatest(l.x0, r.x0)) * greatest(0, least(l.y1, r.y1) - greatest(l.y0, r.y0))), 6) as inter
    from pieces l join pieces r using (image_id) group by 1, 2, 3
    having round(sum(l.s * r.s * greatest(0, least(l.x1, r.x1) - greatest(l.x0, r.x0)) * greatest(0, least(l.y1, r.y1) - greatest(l.y0, r.y0))), 9) > 0""")
def overlap_with_holes(spark, sf):
    from arborlake.operators.polygons import overlap_area

    rows = overlap_area(_holed(spark, sf), _holed(spark, sf)).filter(F.round("inter", 9) > 0)
    return rows.select("image_id", "left_id", "right_id", F.round("inter", 6).alias("inter"))


@query("rejected_features", """
    select cast(floor(poly_id / 10) as bigint) as doc_id, case when poly_id % 30 < 10 then null else cast(poly_id % 10 as bigint) end as poly_id,
           case when poly_id % 30 < 10 then 'no feature collection' else 'no usable ring' end as reason
    from fx_gt_poly where poly_id % 30 < 10 or poly_id % 11 in (3, 5) group by all""")
def rejected_features(spark, sf):
    """Every third document is cut short."""
    broken = F.when(F.col("doc_id") % 3 == 0, F.substring("value", 1, 40)).otherwise(F.col("value"))
    return geojson.rejected_features(_documents(spark, sf).withColumn("value", broken), ["doc_id"])


@query("feature_collections", """
    select v.image_id, v.poly_id, epsg, m.c, count(*) + 1 as points, round(sum(x) + min(x) filter (vertex_no = 0), 3) as sum_x
    from fx_gt_vertices v join fx_meta m using (image_id) group by 1, 2, 3, 4""")
def feature_collections(spark, sf):
    """Written documents parsed back: every feature, its closed ring and the image's reference."""
    shapes = polygons(spark, sf, "gt").withColumn("properties", F.struct("poly_id"))
    lines = geojson.feature_collections(shapes, fx(spark, sf, "fx_meta"))
    docs = lines.groupBy("image_id").agg(F.array_sort(F.collect_list(F.struct("line_no", "value"))).alias("lines"))
    docs = docs.select("image_id", F.array_join("lines.value", "\n").alias("value"))
    parsed = docs.select("image_id", F.from_json("value", """crs struct<properties: struct<name: string>>, metadata struct<transform: array<double>>,
        features array<struct<properties: struct<poly_id: bigint>, geometry: struct<coordinates: array<array<array<double>>>>>>""").alias("d"))
    rows = parsed.select("image_id", "d.crs", "d.metadata", F.explode("d.features").alias("f"))
    ring = F.get("f.geometry.coordinates", F.lit(0))
    return rows.select(
        "image_id", F.col("f.properties.poly_id").alias("poly_id"), F.regexp_extract("crs.properties.name", r"(\d+)", 1).cast("int").alias("epsg"),
        F.get("metadata.transform", F.lit(2)).alias("c"), F.size(ring).cast("bigint").alias("points"),
        F.round(F.aggregate(ring, F.lit(0.0), lambda a, p: a + F.get(p, F.lit(0))), 3).alias("sum_x"),
    )


@query("write_geojson", """
    select image_id, count(*) as features, round(sum(area), 4) as area, round(sum(s10 / signed), 4) as cx, 1::bigint as documents
    from fx_gt_areas group by 1""")
def write_geojson(spark, sf):
    path = _scratch(spark)
    geojson.write_geojson(geojson.feature_collections(polygons(spark, sf, "gt"), fx(spark, sf, "fx_meta")), path)
    documents = spark.read.text(path, wholetext=True)
    back = geojson.read_geojson_features(documents, ["image_id"])
    m = geo.moments(F.col("ring"))
    rows = back.groupBy("image_id").agg(F.count("*").alias("features"), F.round(F.sum(m["m00"]), 4).alias("area"), F.round(F.sum(m["cx"]), 4).alias("cx"))
    return rows.join(documents.groupBy("image_id").agg(F.count("*").alias("documents")), "image_id")


@query("read_raster_tiles", "select image_id, band, x, y, value from fx_tile_pixels")
def read_raster_tiles(spark, sf):
    path = _scratch(spark)
    tiles(spark, sf).write.parquet(path)
    return tile_source.explode_pixels(tile_source.read_raster_tiles(spark, path))


def _typed_tiles(spark, sf):
    """Written tiles with the type of their values; every second one has a value for missing pixels."""
    path = _scratch(spark)
    kind = F.when(F.col("image_id") % 3 == 0, "uint8").when(F.col("image_id") % 3 == 1, "uint16").otherwise("float32")
    missing = F.when(F.col("image_id") % 2 == 0, F.lit(200.0))
    tiles(spark, sf).withColumns({"dtype": kind, "nodata": missing}).write.parquet(path)
    return path


@query("masked_tiles", """
    select image_id, (band + 1) % 4 as band, x, y, cast(least(255, case when image_id % 2 = 0 and value = 200 then 0 else value end) as double) as value
    from fx_tile_pixels""")
def masked_tiles(spark, sf):
    """Read tiles as the dataset job has them: their own missing value is 0, bands in another order, clipped to a byte."""
    from arborlake.plans.create_patches import PatchParams, normalised_tiles

    read = tile_source.read_raster_tiles(spark, _typed_tiles(spark, sf))
    return tile_source.explode_pixels(normalised_tiles(read, PatchParams()))


@query("scaled_tiles", """
    select image_id, band, x, y, case image_id % 3 when 0 then 'uint8' when 1 then 'uint16' else 'float32' end as dtype,
           round(value / case image_id % 3 when 0 then 255 when 1 then 65535 else 1 end, 9) as value
    from fx_tile_pixels""")
def scaled_tiles(spark, sf):
    """Tiles written with the type of their values, read and scaled for the model."""
    from arborlake.plans.predict import model_tiles

    read = model_tiles(tile_source.read_raster_tiles(spark, _typed_tiles(spark, sf)))
    rows = join_large(tile_source.explode_pixels(read), read.select("image_id", "dtype"), "image_id")
    return rows.select("image_id", "band", "x", "y", "dtype", F.round("value", 9).alias("value"))


@query("raster_bounds", """
    select image_id, c as min_x, f - 0.25 * height as min_y, c + 0.25 * width as max_x, f as max_y, a as res_x, -e as res_y from fx_meta""")
def raster_bounds(spark, sf):
    return tile_source.with_bounds(fx(spark, sf, "fx_meta")).select("image_id", "min_x", "min_y", "max_x", "max_y", "res_x", "res_y")


@query("patch_catalog", "select patch_key, source_image, num_trees, latitude, longitude, pixel_x, pixel_y from fx_patches")
def patch_catalog(spark, sf):
    path = _scratch(spark)
    patches.write_patches(fx(spark, sf, "fx_patches").withColumn("image", F.array_repeat(F.lit(0.5), 16)), path)
    return patches.patch_catalog(spark, path)


@query("read_patches", "select patch_key, source_image, num_trees, cast(16 * pixel_x as double) as pixel_sum from fx_patches")
def read_patches(spark, sf):
    path = _scratch(spark)
    patches.write_patches(fx(spark, sf, "fx_patches").withColumn("image", F.array_repeat(F.col("pixel_x").cast("double"), 16)), path)
    total = F.aggregate("image", F.lit(0.0), lambda a, v: a + v)
    return patches.read_patches(spark, path).select("patch_key", "source_image", "num_trees", total.alias("pixel_sum"))


@query("catalog_by_image", """
    select source_image, count(*) as patches, sum(num_trees)::bigint as trees, min(patch_key) as first_key from fx_patches group by 1""")
def catalog_by_image(spark, sf):
    return patches.catalog_by_image(fx(spark, sf, "fx_patches"))


