"""Splits, samples, clusters, greedy matching, windows, scoring and augmentation."""

import numpy as np
from pyspark.sql import functions as F

from arborlake.functions import augment as A
from arborlake.operators import graph, matching, ranking, scoring, spatial_join, splits, tiling
from arborlake.operators.blocks import cut_windows
from catalog.bands import _lonlat_sql
from catalog.fixtures import fx, tile_pixels, tiles
from catalog.registry import query

_BINS = """
    b as (select *, concat(cast(floor(latitude / 2) as int), '_', cast(floor(longitude / 2) as int)) as region
          from fx_patches where latitude is not null and longitude is not null),
    rb as (select b.*, sum(num_trees) over (partition by region)::bigint as region_trees from b)"""


@query("region_bins", f"with {_BINS} select patch_key, region, region_trees from rb")
def region_bins(spark, sf):
    return splits.region_bins(fx(spark, sf, "fx_patches")).select("patch_key", "region", "region_trees")


def _clusters(eps, source="fx_patches where latitude is not null", name="cl"):
    return f"""
    {name}_p as (select distinct latitude as lat, longitude as lon, min(patch_key) over (partition by latitude, longitude) as pk from {source}),
    {name}_all as (select pk as node, pk as seen from {name}_p
      union select r.node, q.pk from {name}_all r join {name}_p p on p.pk = r.seen join {name}_p q
        on sqrt(power(p.lat - q.lat, 2) + power(p.lon - q.lon, 2)) <= {eps}),
    {name}_min as (select node, min(seen) as root from {name}_all group by 1),
    {name} as (select p.lat as latitude, p.lon as longitude, dense_rank() over (order by root) - 1 as cluster from {name}_min m join {name}_p p on p.pk = m.node)"""


def _cluster_query(name, eps):
    @query(name, f"with recursive {_clusters(eps)} select patch_key, cluster from fx_patches join cl using (latitude, longitude)")
    def run(spark, sf):
        rows = fx(spark, sf, "fx_patches").filter("latitude is not null")
        out = splits.cluster_patches(rows, eps)
        return out.select("patch_key", F.col("cluster").cast("bigint").alias("cluster"))

    return run


_cluster_query("eps_clusters", 0.5)
_cluster_query("eps_clusters_tight", 0.0299)


def _split_sql(value):
    return f"""
    cw as (select cluster, sum({value})::bigint as weight from rb join cl using (latitude, longitude) group by 1),
    o as (select *, coalesce(sum(weight) over (order by weight desc, cluster rows between unbounded preceding and 1 preceding), 0) as before,
                 sum(weight) over () as total from cw),
    t as (select *, before < round_even((1 - 0.2::double - 0.1::double) * total, 0) as tr from o),
    t2 as (select *, coalesce(sum(weight) filter (tr) over (), 0) as used from t),
    v as (select *, not tr and before - used < round_even(0.2::double * total, 0) as va from t2),
    v2 as (select *, used + coalesce(sum(weight) filter (va) over (), 0) as used2 from v),
    sp as (select cluster, case when tr then 'train' when va then 'val' when before - used2 < round_even(0.1::double * total, 0) then 'test'
                  else 'leftover' end as split from v2)"""


def _split_query(name, weight, value):
    @query(name, f"""with recursive {_BINS}, {_clusters(0.5)}, {_split_sql(value)}
        select patch_key, split from rb join cl using (latitude, longitude) join sp using (cluster)""")
    def run(spark, sf):
        rows = splits.cluster_patches(splits.region_bins(fx(spark, sf, "fx_patches")))
        return splits.split_by_cluster(rows, weight=weight).select("patch_key", "split")

    return run


_split_query("split_by_cluster", "region_total", "region_trees")
_split_query("split_by_cluster_trees", "trees", "num_trees")


@query("split_by_patch_count", """
    with i as (select source_image, count(*) as n from fx_patches group by 1),
    o as (select *, coalesce(sum(n) over (order by md5(concat(source_image, '|split42')), source_image rows between unbounded preceding and 1 preceding), 0) as before,
                 sum(n) over () as total from i),
    v as (select *, before < floor(0.2 * total) as va from o),
    u as (select *, sum(n) filter (va) over () as used from v)
    select patch_key, case when va then 'val' when before - used < floor(0.1 * total) then 'test' else 'train' end as split
    from fx_patches join u using (source_image)""")
def split_by_patch_count(spark, sf):
    return splits.split_by_patch_count(fx(spark, sf, "fx_patches"), 0.2, 0.1).select("patch_key", "split")


@query("balanced_sample", """
    with r as (select *, row_number() over (partition by num_trees > 0 order by md5(concat(patch_key, '|sample42')), patch_key) as rn from fx_patches),
    n as (select min(c) as n from (select count(*) as c from fx_patches group by num_trees > 0))
    select patch_key, num_trees, md5(concat(patch_key, '|sample42|order')) as shuffle from r, n where rn <= n""")
def balanced_sample(spark, sf):
    return splits.balanced_sample(fx(spark, sf, "fx_patches")).select("patch_key", "num_trees", "shuffle")


@query("prepare_splits", f"""
    with recursive {_BINS}, {_clusters(0.5)}, {_split_sql("region_trees")},
    k as (select patch_key, num_trees, split from rb join cl using (latitude, longitude) join sp using (cluster) where split <> 'leftover'),
    r as (select *, row_number() over (partition by split, num_trees > 0 order by md5(concat(patch_key, '|sample42')), patch_key) as rn from k),
    n as (select split, case when count(*) = 2 then min(c) else 0 end as n from (select split, num_trees > 0, count(*) as c from k group by 1, 2) group by 1)
    select patch_key, split, split = 'train' as augment from r join n using (split) where rn <= n""")
def prepare_splits(spark, sf):
    return splits.prepare_splits(fx(spark, sf, "fx_patches")).select("patch_key", "split", "augment")


@query("sample_n", "select patch_key from fx_patches order by md5(concat(patch_key, '|n42')), patch_key limit 40")
def sample_n(spark, sf):
    return splits.sample_n(fx(spark, sf, "fx_patches"), 40, "patch_key").select("patch_key")


@query("shuffled_rank", "select patch_key, row_number() over (order by md5(concat(patch_key, '|r')), patch_key) - 1 as rank from fx_patches")
def shuffled_rank(spark, sf):
    return ranking.hash_rank(fx(spark, sf, "fx_patches"), "patch_key", "r").select("patch_key", F.col("rank").cast("bigint").alias("rank"))


@query("region_totals_joined", f"with {_BINS} select source_image, sum(region_trees)::bigint as total from rb group by 1")
def region_totals_joined(spark, sf):
    return splits.region_bins(fx(spark, sf, "fx_patches")).groupBy("source_image").agg(F.sum("region_trees").alias("total"))


# pairs within a distance and greedy matching on points


_POINTS = """
    l as (select image_id, min(point_id) as id, x, y from fx_points where side = 0 group by 1, 3, 4),
    r as (select image_id, min(point_id) as id, x, y from fx_points where side = 1 group by 1, 3, 4)"""


def _side(spark, sf, side):
    rows = fx(spark, sf, "fx_points").filter(F.col("side") == side)
    return rows.groupBy("image_id", "x", "y").agg(F.min("point_id").alias("point_id"))


@query("distance_join", f"""
    with {_POINTS} select l.image_id, l.id as left_id, r.id as right_id, round(sqrt(power(l.x - r.x, 2) + power(l.y - r.y, 2)), 6) as distance
    from l join r on l.image_id = r.image_id and sqrt(power(l.x - r.x, 2) + power(l.y - r.y, 2)) <= 5""")
def distance_join(spark, sf):
    left = _side(spark, sf, 0).selectExpr("image_id", "point_id as left_id", "x as lx", "y as ly")
    right = _side(spark, sf, 1).selectExpr("image_id", "point_id as right_id", "x as rx", "y as ry")
    pairs = spatial_join.distance_join(left, right, ["image_id"], 5.0)
    return pairs.select("image_id", "left_id", "right_id", F.round("distance", 6).alias("distance"))


@query("proximity_match", f"""
    with recursive {_POINTS},
    p as (select l.image_id, l.id as a, r.id as b, sqrt(power(l.x - r.x, 2) + power(l.y - r.y, 2)) as d,
                 row_number() over (partition by l.image_id order by l.id, r.id) as rn
          from l join r on l.image_id = r.image_id and sqrt(power(l.x - r.x, 2) + power(l.y - r.y, 2)) <= 5),
    walk as (select image_id, 0::bigint as rn, []::bigint[] as ua, []::bigint[] as ub, 0::bigint as tp, 0::double as total from (select distinct image_id from p)
      union all
      select image_id, prn, case when ok then list_append(ua, a) else ua end, case when ok then list_append(ub, b) else ub end,
             tp + ok::int, total + case when ok then d else 0 end
      from (select w.*, p.a, p.b, p.d, p.rn as prn, not list_contains(ua, a) and not list_contains(ub, b) as ok
            from walk w join p on p.image_id = w.image_id and p.rn = w.rn + 1) z),
    last as (select * from (select *, row_number() over (partition by image_id order by rn desc) as z from walk) where z = 1),
    n as (select image_id, sum(pl)::double as np, sum(pr)::double as nt from (select image_id, 1 as pl, 0 as pr from l union all select image_id, 0, 1 from r) group by 1)
    select image_id, coalesce(tp, 0) as tp, round(case when np = 0 then 0 else coalesce(tp, 0) / np end, 6) as precision,
           round(case when nt = 0 then 0 else coalesce(tp, 0) / nt end, 6) as recall, round(2 * coalesce(tp, 0) / (np + nt), 6) as f1,
           round(total / tp, 6) as localization_error
    from n left join last using (image_id)""")
def proximity_match(spark, sf):
    rows = matching.proximity_match(_side(spark, sf, 0), _side(spark, sf, 1))
    return rows.select("image_id", "tp", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1", "localization_error")])


# windows and patches


def _meta(spark, sf):
    return fx(spark, sf, "fx_meta")


@query("window_grid", """
    select image_id, cast(row_no * 5 + col_no as int) as idx, cast(row_no as int) as patch_row, cast(col_no as int) as patch_col, cast(col_no * 24 as int) as pixel_x, cast(row_no * 24 as int) as pixel_y
    from fx_meta, range(5) a(row_no), range(5) b(col_no)""")
def window_grid(spark, sf):
    return tiling.window_grid(_meta(spark, sf), 48, 24)


@query("window_grid_padded", """
    select image_id, cast(row_no * 5 + col_no as int) as idx, cast(col_no * 32 as int) as pixel_x, cast(row_no * 32 as int) as pixel_y
    from fx_meta, range(5) a(row_no), range(5) b(col_no)""")
def window_grid_padded(spark, sf):
    # 144 grows to 192, so windows of 64 start at 0, 32, 64, 96, 128
    return tiling.window_grid(_meta(spark, sf), 64, 32, "multiple").select("image_id", "idx", "pixel_x", "pixel_y")


@query("patch_metadata", f"""
    with src as (
      select image_id, row_no, col_no, c + 0.25::double * (col_no * 24 + 24.5::double) as x, f - 0.25::double * (row_no * 24 + 24.5::double) as y, 27 as lon0
      from fx_meta, range(5) a(row_no), range(5) b(col_no))
    select image_id, concat(image_id, '_', row_no * 5 + col_no) as patch_key, cast(row_no as int) as patch_row, cast(col_no as int) as patch_col,
           cast(col_no * 24 as int) as pixel_x, cast(row_no * 24 as int) as pixel_y, round(lat, 5) as latitude, round(lon, 5) as longitude
    from ({_lonlat_sql()})""")
def patch_metadata(spark, sf):
    rows = tiling.patch_metadata(_meta(spark, sf), 48, 24, [3067, 32635])
    return rows.select("image_id", "patch_key", "patch_row", "patch_col", "pixel_x", "pixel_y", F.round("latitude", 5).alias("latitude"), F.round("longitude", 5).alias("longitude"))


@query("cut_patches", """
    select image_id, cast(r * 3 + c as int) as idx, cast(c as int) as pixel_x, cast(r as int) as pixel_y, band,
           cast((y - r) * 2 + x - c as int) as pos, value
    from fx_tile_pixels, range(3) a(r), range(3) b(c) where x between c and c + 1 and y between r and r + 1""")
def cut_patches(spark, sf):
    rows = cut_windows(tiles(spark, sf), tiles(spark, sf).select("image_id", "width", "height"), 2, 1)
    rows = rows.select("image_id", "idx", "pixel_x", "pixel_y", F.posexplode("bands").alias("band", "values"))
    return rows.select("image_id", "idx", "pixel_x", "pixel_y", "band", F.posexplode("values").alias("pos", "value"))


def _scorer():
    return lambda batch: batch.mean(axis=1, keepdims=True) / 50.0 - 4.0


def _scored(spark, sf):
    meta = tiles(spark, sf).select("image_id", "width", "height")
    patches = cut_windows(tiles(spark, sf), meta, 3, 1, "multiple")
    return scoring.score_patches(patches, _scorer, 3, 5, keep=("image_id", "idx", "pixel_x", "pixel_y")), meta


_WINDOWS = """
    pv as (select image_id, x, y, 1 / (1 + exp(-(avg(value) / 50 - 4))) as s from fx_tile_pixels group by 1, 2, 3),
    full_map as (select k.image_id, cx as x, cy as y, coalesce(s, 1 / (1 + exp(4::double))) as s
          from (select image_id, cx, cy from (select distinct image_id from pv), range(6) a(cx), range(6) b(cy)) k
          left join pv on pv.image_id = k.image_id and pv.x = cx and pv.y = cy),
    w as (select image_id, r * 4 + c as idx, c as px, r as py, x, y, s from full_map, range(4) a(r), range(4) b(c)
          where x between c and c + 2 and y between r and r + 2)"""


@query("score_patches", f"with {_WINDOWS} select image_id, cast(idx as int) as idx, cast((y - py) * 3 + x - px as int) as pos, round(s, 9) as score from w")
def score_patches(spark, sf):
    rows = _scored(spark, sf)[0].select("image_id", "idx", F.posexplode("scores").alias("pos", "score"))
    return rows.withColumn("score", F.round("score", 9))


def _stitch_query(name, mode, counted):
    @query(name, f"""
        with {_WINDOWS} select image_id, cast(x as int) as x, cast(y as int) as y,
          round(case when sum({counted}) > 0 then least(1, sum(s) / sum({counted})) else 0 end, 6) as value
        from w where x < 4 and y < 4 group by 1, 2, 3""")
    def run(spark, sf):
        scored, meta = _scored(spark, sf)
        return scoring.stitch(scored, meta, 3, 0.5, mode).withColumn("value", F.round("value", 6))

    return run


_stitch_query("stitch", "sum", "case when s >= 0.5 then 1 else 0 end")
_stitch_query("stitch_mean", "mean", "1")


@query("reduce_queries", """
    with top as (select image_id, x, y, max(value) as value from fx_tile_pixels group by 1, 2, 3)
    select image_id, cast(tx as int) as x, cast(ty as int) as y, round(sum(value
        * greatest(0, 1 - abs(least(greatest((tx + 0.5) * 4 / 6 - 0.5, 0), 3) - x))
        * greatest(0, 1 - abs(least(greatest((ty + 0.5) * 4 / 6 - 0.5, 0), 3) - y))), 6) as value
    from top, range(6) a(tx), range(6) b(ty) group by 1, 2, 3""")
def reduce_queries(spark, sf):
    masks = tile_pixels(spark, sf).withColumnRenamed("band", "query")
    rows = scoring.reduce_queries(masks, tiles(spark, sf).select("image_id", "width", "height"), 6, 6)
    return rows.select("image_id", F.col("x").cast("int").alias("x"), F.col("y").cast("int").alias("y"), F.round("value", 6).alias("value"))


@query("class_channel", "select image_id, x, y, value from fx_tile_pixels where band = 1")
def class_channel(spark, sf):
    return scoring.class_channel(tile_pixels(spark, sf))


# augmentation


def _u(purpose, extra=""):
    return f"(('0x' || substr(md5(concat(image_id, '|7|3|{purpose}'{extra})), 1, 8))::bigint / 4294967296.0::double)"


_TURNED = f"""
    d as (select distinct image_id, {_u("hflip")} > 0.5 as hf, {_u("vflip")} > 0.5 as vf, cast(floor({_u("turns")} * 4) as int) as k,
                 0.8 + {_u("brightness")} * (1.2 - 0.8)::double as br, 0.8 + {_u("contrast")} * (1.2 - 0.8)::double as co, 0.8 + {_u("gamma")} * (1.2 - 0.8)::double as ga
          from fx_tile_pixels),
    f as (select image_id, band, case when hf then 3 - x else x end as mx, case when vf then 3 - y else y end as my, value / 1024 as v, k, br, co, ga
          from fx_tile_pixels join d using (image_id)),
    t as (select image_id, band, case k when 0 then mx when 1 then my when 2 then 3 - mx else 3 - my end as x,
                 case k when 0 then my when 1 then 3 - mx when 2 then 3 - my else mx end as y, v, br, co, ga from f)"""


@query("flip_and_turn", f"with {_TURNED} select image_id, band, cast(y * 4 + x as int) as pos, v as value from t")
def flip_and_turn(spark, sf):
    rows = _units(spark, sf).withColumn("_d", A.draws(F.col("image_id").cast("string"), 7, 3))
    moved = F.transform("bands", lambda b: A.flip_and_turn(b, F.col("_d"), F.col("width"), F.col("height")))
    return _long(rows.withColumn("bands", moved))


def _units(spark, sf):
    from arborlake.functions.bands import map_bands

    return tiles(spark, sf).withColumn("bands", map_bands(F.col("bands"), lambda v: v / 1024))


def _long(rows):
    rows = rows.select("image_id", F.posexplode("bands").alias("band", "values"))
    return rows.select("image_id", "band", F.posexplode("values").alias("pos", "value"))


_LIT = """,
    b1 as (select *, least(greatest(v * br, 0), 1) as w, cast(y * 4 + x as int) as pos from t),
    m as (select image_id, band, avg(w) as mean from b1 group by 1, 2),
    c1 as (select b1.*, least(greatest((w - mean) * co + mean, 0), 1) as c from b1 join m using (image_id, band))"""


def _aug_sql(select):
    return f"with {_TURNED}{_LIT} {select}"


@query("brightness_contrast", _aug_sql("select image_id, band, pos, round(w, 9) as bright, round(c, 9) as contrast from c1"))
def brightness_contrast(spark, sf):
    rows = _units(spark, sf).withColumn("_d", A.draws(F.col("image_id").cast("string"), 7, 3))
    moved = F.transform("bands", lambda b: A.flip_and_turn(b, F.col("_d"), F.col("width"), F.col("height")))
    rows = rows.withColumn("bright", F.transform(moved, lambda b: A.brightness(b, F.col("_d.brightness"))))
    rows = rows.withColumn("contrast", F.transform("bright", lambda b: A.contrast(b, F.col("_d.contrast"))))
    both = F.arrays_zip("bright", "contrast")
    rows = rows.select("image_id", F.posexplode(both).alias("band", "z")).select("image_id", "band", F.posexplode(F.arrays_zip("z.bright", "z.contrast")).alias("pos", "v"))
    return rows.select("image_id", "band", "pos", F.round("v.bright", 9).alias("bright"), F.round("v.contrast", 9).alias("contrast"))


_NOISE = "(0.9 + " + _u("noise", ", '|', band, '|', pos") + " * (1.1::double - 0.9::double))"


@query("augment", _aug_sql(f"select image_id, band, pos, round(power(least(greatest(c * {_NOISE}, 0), 1), ga), 6) as value from c1"))
def augment(spark, sf):
    return _long(A.augment(_units(spark, sf), 7, 3, "image_id")).withColumn("value", F.round("value", 6))
