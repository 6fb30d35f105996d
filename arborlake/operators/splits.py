"""Splitting and sampling of a patch catalogue ``patch_key, source_image, num_trees, latitude, longitude``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arborlake.functions.hashing import bucket, digest
from arborlake.operators.graph import eps_clusters
from arborlake.operators.ranking import first_by_hash, ordered_total, running_total
from arborlake.session import cut_lineage


def region_bins(patches: DataFrame, lat_bin: float = 2.0, lon_bin: float = 2.0) -> DataFrame:
    """Adds ``region`` and ``region_trees``; patches without numeric coordinates are dropped.

    Regions are degree cells, so their totals are a table of bounded size and can be broadcast.
    """
    rows = patches.withColumns({"latitude": F.col("latitude").try_cast("double"), "longitude": F.col("longitude").try_cast("double")})
    rows = rows.filter(F.col("latitude").isNotNull() & F.col("longitude").isNotNull())
    lat, lon = F.floor(F.col("latitude") / lat_bin), F.floor(F.col("longitude") / lon_bin)
    rows = rows.withColumn("region", F.concat_ws("_", lat.cast("string"), lon.cast("string")))
    totals = rows.groupBy("region").agg(F.sum("num_trees").alias("region_trees"))
    cells = (180.0 / lat_bin + 1) * (360.0 / lon_bin + 1)
    small = F.broadcast(totals) if cells <= 1e6 else totals
    return rows.join(small, "region")


def cluster_patches(patches: DataFrame, eps: float = 0.5) -> DataFrame:
    """Adds ``cluster``: patches whose coordinates chain within ``eps`` degrees. Equal coordinates are one point."""
    spots = patches.groupBy("latitude", "longitude").agg(F.min("patch_key").alias("point_id"))
    points = spots.select("point_id", F.col("longitude").alias("x"), F.col("latitude").alias("y"))
    named = spots.join(eps_clusters(points, eps), "point_id").drop("point_id")
    return patches.join(named, ["latitude", "longitude"])


def split_by_cluster(patches: DataFrame, val: float = 0.2, test: float = 0.1, weight: str = "region_total") -> DataFrame:
    """Adds ``split``: clusters in descending weight fill train, then val, then test; the rest is ``leftover``.

    ``weight='region_total'`` adds up the region total of every patch, ``'trees'`` the trees. Of the cluster
    table only four sums come to the driver.
    """
    value = {"region_total": "region_trees", "trees": "num_trees"}[weight]
    clusters = patches.groupBy("cluster").agg(F.sum(value).alias("weight"))
    rows = cut_lineage(ordered_total(clusters, [F.desc("weight"), F.col("cluster")], "weight"))

    def weight_of(chosen) -> float:
        return rows.filter(chosen).agg(F.coalesce(F.sum("weight"), F.lit(0))).first()[0]

    def target(share: float):
        return F.bround(F.lit(float(share)) * F.lit(float(total)), 0)

    total = weight_of(F.lit(True))
    train = F.col("before") < target(1 - val - test)
    used = weight_of(train)
    in_val = ~train & (F.col("before") - used < target(val))
    used += weight_of(in_val)
    in_test = ~train & ~in_val & (F.col("before") - used < target(test))
    split = F.when(train, "train").when(in_val, "val").when(in_test, "test").otherwise("leftover")
    return patches.join(rows.select("cluster", "weight", split.alias("split")), "cluster")


def split_by_patch_count(patches: DataFrame, val: float, test: float, seed: int = 42) -> DataFrame:
    """Adds ``split``: images in shuffled order fill val, then test; the remainder is train."""
    salt = f"split{seed}"
    images = patches.groupBy("source_image").agg(F.count("*").alias("n")).withColumn("_h", digest(F.col("source_image"), salt))
    images = cut_lineage(running_total(images, bucket(F.col("_h")), ["_h", "source_image"], "n").drop("_h"))
    total = images.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    in_val = F.col("before") < int(val * total)
    used = images.filter(in_val).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    in_test = F.col("before") - used < int(test * total)
    split = F.when(in_val, "val").when(in_test, "test").otherwise("train")
    return patches.join(images.select("source_image", split.alias("split")), "source_image")


def balanced_sample(patches: DataFrame, seed: int = 42, by: str | None = None) -> DataFrame:
    """Equal numbers of patches with and without trees, per value of ``by`` (few values) when given.

    Adds ``shuffle``, a hash to order by. Only the hash bucket on the edge of the quota is ever ranked.
    """
    salt = f"sample{seed}"
    rows = patches.withColumn("_class", F.concat_ws("|", F.col(by) if by else F.lit(""), (F.col("num_trees") > 0).cast("string")))
    group = F.regexp_extract("_class", r"^(.*)\|", 1)
    sizes = rows.groupBy("_class").agg(F.count("*").alias("size")).withColumn("group", group)
    least = sizes.groupBy("group").agg(F.when(F.count("*") == 2, F.min("size")).otherwise(F.lit(0)).alias("n"))
    take = sizes.join(least, "group").select("_class", "n")
    picked = first_by_hash(rows, "patch_key", salt, "_class", take).drop("_class")
    return picked.withColumn("shuffle", digest(F.col("patch_key"), salt, "order"))


def sample_n(df: DataFrame, n: int, key: str, seed: int = 42) -> DataFrame:
    """``n`` random rows: the smallest hashes, so every partition keeps only its own best ``n``."""
    return df.orderBy(digest(F.col(key).cast("string"), f"n{seed}"), key).limit(n)


def prepare_splits(patches: DataFrame, val: float = 0.2, test: float = 0.1, eps: float = 0.5, seed: int = 42) -> DataFrame:
    """Region split, balanced sample inside each split; ``augment`` is true for train only."""
    binned = cut_lineage(region_bins(patches))
    split = cut_lineage(split_by_cluster(cluster_patches(binned, eps), val, test)).filter("split <> 'leftover'")
    return balanced_sample(split, seed, "split").withColumn("augment", F.col("split") == "train")
