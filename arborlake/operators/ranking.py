"""Ranks, running sums and exact quantiles of whole tables without one task holding a whole group.

Rows fall into ordered buckets. Bucket totals are tiny and get the prefix sums; only rows inside one
bucket are ordered by a window.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arborlake.functions.hashing import bucket, digest
from arborlake.session import cut_lineage, join_small


BUCKET_ROWS = 4096  # rows of a group that are looked at together


def running_total(df: DataFrame, bucket_col: Column, order: Sequence[str], value: str, by: Sequence[str] = (),
                  out: str = "before") -> DataFrame:
    """Adds ``out``: sum of ``value`` over all rows of the same ``by`` that come earlier in (bucket, order).

    The bucket must respect the order and have a bounded number of values. Starts of buckets are one row a bucket and
    key; they are counted before they are broadcast.
    """
    by = list(by)
    rows = df.withColumn("_bucket", bucket_col)
    totals = rows.groupBy(*by, "_bucket").agg(F.sum(value).alias("_sum"))
    earlier = Window.partitionBy(*by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(*by, "_bucket", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_start"))
    inside = Window.partitionBy(*by, "_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    local = rows.withColumn("_local", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    joined = join_small(local, cut_lineage(starts), [*by, "_bucket"])
    return joined.withColumn(out, F.col("_start") + F.col("_local")).drop("_bucket", "_start", "_local")


def ordered_total(df: DataFrame, order: Sequence[Column | str], value: str, out: str = "before") -> DataFrame:
    """Adds ``out``: sum of ``value`` over all rows that come earlier in ``order``, which has to tell rows apart.

    Rows are dealt by ranges of the order and written with the number of their range, so the numbers hold for
    good; only the sums of the ranges, one row each, are added up in one place.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = cut_lineage(df.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()))
    sums = rows.groupBy("_part").agg(F.sum(value).alias("_sum"))
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("_part", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_start"))
    inside = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    local = rows.withColumn("_local", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    joined = local.join(F.broadcast(starts), "_part")
    return joined.withColumn(out, F.col("_start") + F.col("_local")).drop("_part", "_start", "_local")


def hash_rank(df: DataFrame, key: str, salt: str, by: Sequence[str] = (), out: str = "rank", digits: int = 3) -> DataFrame:
    """Adds ``out``: 0-based position in shuffled order, the order of md5(key | salt)."""
    rows = df.withColumn("_h", digest(F.col(key).cast("string"), salt)).withColumn("_one", F.lit(1))
    ranked = running_total(rows, bucket(F.col("_h"), digits), ["_h", key], "_one", by, out)
    return ranked.drop("_h", "_one")


def first_by_hash(df: DataFrame, key: str, salt: str, by: str, take: DataFrame, digits: int = 3) -> DataFrame:
    """The first ``take`` rows (columns ``by, n``) of every ``by`` in hash order.

    Buckets wholly inside the quota pass without any ordering; only the one bucket on the edge is ranked.
    """
    rows = df.withColumn("_h", digest(F.col(key).cast("string"), salt)).withColumn("_bucket", bucket(F.col("_h"), digits))
    sizes = rows.groupBy(by, "_bucket").agg(F.count("*").alias("_size"))
    earlier = Window.partitionBy(by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    plan = (
        sizes.withColumn("_start", F.coalesce(F.sum("_size").over(earlier), F.lit(0)))
        .join(take, by).filter("_start < n")
        .select(by, "_bucket", (F.col("n") - F.col("_start")).alias("_quota"), (F.col("_start") + F.col("_size") <= F.col("n")).alias("_whole"))
    )
    planned = join_small(rows, cut_lineage(plan), [by, "_bucket"])
    edge = Window.partitionBy(by, "_bucket").orderBy("_h", key)
    whole = planned.filter("_whole").select(df.columns)
    cut = planned.filter("not _whole").withColumn("_n", F.row_number().over(edge)).filter("_n <= _quota").select(df.columns)
    return whole.unionByName(cut)


def cuts_below(cuts: Column, value: Column, most: int) -> Column:
    """Number of the sorted ``cuts`` (at most ``most``) that are below a value, by halving."""
    halves = F.array(*(F.lit(1 << i) for i in range(most.bit_length() - 1, -1, -1)))

    def further(place: Column, step: Column) -> Column:
        return F.when((place + step <= F.size(cuts)) & (F.get(cuts, place + step - 1) < value), place + step).otherwise(place)

    return F.aggregate(halves, F.lit(0), further)


def with_buckets(counts: DataFrame, by: Sequence[str], value: str, buckets: int) -> DataFrame:
    """Adds ``_b``: ordered buckets of about equally many rows each, whatever the values are.

    A group of up to ``BUCKET_ROWS`` rows is one bucket. Bounds of larger ones come from a rank sketch that tasks build
    and merge; its error is a tenth of a bucket. Equal values share a bucket.
    """
    by = list(by)
    shares = [i / buckets for i in range(1, buckets)]
    large = counts.groupBy(*by).agg(F.count("*").alias("_rows")).filter(F.col("_rows") > BUCKET_ROWS).select(*by)
    cuts = counts.join(large, by, "left_semi").groupBy(*by).agg(F.array_distinct(F.percentile_approx(value, shares, 10 * buckets)).alias("_cuts"))
    place = F.when(F.col("_cuts").isNull(), F.lit(0)).otherwise(cuts_below(F.col("_cuts"), F.col(value), buckets))
    return counts.join(cuts, by, "left").withColumn("_b", place).drop("_cuts")


def exact_quantiles(df: DataFrame, by: Sequence[str], value: str, probs: Sequence[float], buckets: int = 1000, weight: str | None = None) -> DataFrame:
    """Linear-interpolated quantiles per ``by``: columns ``by, n, quantiles`` (array in the order of ``probs``).

    Values are counted first (partial aggregation collapses repeats). The counts go into ordered buckets of equal
    numbers of values, and only buckets that hold a wanted rank are looked at value by value. No task sees a whole
    group, and an outlier takes a place in a bucket like any other value. ``weight`` names a column with the number of
    times that a row's value stands.
    """
    by = list(by)
    if not by:
        raise ValueError("exact_quantiles needs at least one key column")
    counts = df.groupBy(*by, F.col(value).cast("double").alias("_v")).agg((F.count("*") if weight is None else F.sum(weight)).alias("_n"))
    sizes = counts.groupBy(*by).agg(F.sum("_n").alias("n"))
    binned = with_buckets(counts, by, "_v", buckets).join(sizes, by)
    hist = binned.groupBy(*by, "_b", "n").agg(F.sum("_n").alias("_size"))
    earlier = Window.partitionBy(*by).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    hist = hist.withColumn("_start", F.coalesce(F.sum("_size").over(earlier), F.lit(0)))
    wanted = F.array(*[
        F.struct(F.lit(i).alias("i"), F.lit(float(p)).alias("p")) for i, p in enumerate(probs)
    ])
    asked = hist.withColumn("_q", F.explode(wanted)).withColumn("_at", F.col("_q.p") * (F.col("n") - 1))
    asked = asked.withColumn("_rank", F.explode(F.array_distinct(F.array(F.floor("_at"), F.ceil("_at")))))
    asked = asked.filter("_rank >= _start and _rank < _start + _size").select(*by, "_b", "_start", "_q.i", "_at", "_rank")
    inside = Window.partitionBy(*by, "_b").orderBy("_v").rowsBetween(Window.unboundedPreceding, -1)
    needed = binned.join(asked.select(*by, "_b", "_start").distinct(), [*by, "_b"])
    needed = needed.withColumn("_first", F.col("_start") + F.coalesce(F.sum("_n").over(inside), F.lit(0)))
    hit = asked.drop("_start").join(needed, [*by, "_b"]).filter("_rank >= _first and _rank < _first + _n")
    found = hit.groupBy(*by, "n", "i", "_at").agg(F.min("_v").alias("_low"), F.max("_v").alias("_high"))
    quantile = F.col("_low") + (F.col("_high") - F.col("_low")) * (F.col("_at") - F.floor("_at"))
    listed = found.select(*by, "n", F.struct("i", quantile.alias("v")).alias("_s")).groupBy(*by, "n")
    # one entry per asked probability
    return listed.agg(F.transform(F.array_sort(F.collect_list("_s")), lambda s: s["v"]).alias("quantiles"))
