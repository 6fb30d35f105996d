"""Grouped metrics over pixel tables and result tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arborlake.functions import scores
from arborlake.operators.ranking import exact_quantiles, hash_rank


def confusion(pixels: DataFrame, pred: Column, truth: Column, by: Sequence[str], buffer: Column | None = None) -> DataFrame:
    return pixels.groupBy(*by).agg(*scores.confusion(pred, truth, buffer))


def image_scores(counts: DataFrame) -> DataFrame:
    """Every per-image score of one confusion row."""
    return counts.withColumns({
        "iou": scores.iou_score(), "f1": scores.f_score(1.0), "masked_iou": scores.masked_iou(), "masked_f1": scores.masked_f1(),
        "mean_iou": scores.mean_iou(), "balanced_iou": scores.balanced_iou(), "dice": scores.dice(),
        "adjusted_dice": scores.adjusted_dice(), "mcc": scores.mcc(),
    })


def pixel_summary(counts: DataFrame, tree_iou: DataFrame, by: Sequence[str] = ("image_id",)) -> DataFrame:
    """Pooled dice, precision, recall, F2 and IoU with means of per-image scores; a zero denominator gives null.

    ``counts`` has one confusion row per image, ``tree_iou`` one component score per image.
    """
    rows = image_scores(counts).join(tree_iou, list(by), "left")
    pooled = rows.agg(
        F.sum("tp").cast("double").alias("tp"), F.sum("fp").cast("double").alias("fp"), F.sum("fn").cast("double").alias("fn"),
        F.avg("tree_iou").alias("mean_iou_trees"), F.avg("mean_iou").alias("mean_iou"),
        F.avg("balanced_iou").alias("mean_balanced_iou"), F.avg("mcc").alias("mean_mcc"),
    )
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    pooled = pooled.withColumns({
        "mean_dice_score": F.try_divide(2 * tp, 2 * tp + fp + fn), "mean_precision": F.try_divide(tp, tp + fp),
        "mean_recall": F.try_divide(tp, tp + fn), "mean_iou_pixels": F.try_divide(tp, tp + fp + fn),
    })
    p, r = F.col("mean_precision"), F.col("mean_recall")
    return pooled.withColumn("mean_f2_score", F.try_divide(5 * p * r, 4 * p + r)).drop("tp", "fp", "fn")


def batch_mean(metrics: DataFrame, key: str, values: Sequence[str], size: int = 8, salt: str = "batch") -> DataFrame:
    """Mean over full batches of ``size`` rows in shuffled order, then over batches; a short last batch is dropped."""
    ranked = hash_rank(metrics, key, salt).withColumn("batch", F.floor(F.col("rank") / size))
    batches = ranked.groupBy("batch").agg(*[F.avg(v).alias(v) for v in values], F.count("*").alias("n")).filter(F.col("n") == size)
    return batches.agg(*[F.avg(v).alias(v) for v in values], F.count("*").alias("batches"))


def _unpivot(df: DataFrame, columns: Sequence[str], by: Sequence[str]) -> DataFrame:
    entries = F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in columns])
    rows = df.select(*by, F.explode(entries).alias("e")).select(*by, "e.metric", "e.value")
    return rows.filter(F.col("value").isNotNull() & ~F.isnan("value"))


def describe(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """count, mean, std (n-1), min, quartiles, max per column; null and NaN are skipped. All columns in one pass."""
    rows, keys = _unpivot(df, columns, by), [*by, "metric"]
    basic = rows.groupBy(*keys).agg(
        F.count("*").alias("count"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"),
        F.min("value").alias("min"), F.max("value").alias("max"),
    )
    quartiles = exact_quantiles(rows, keys, "value", (0.25, 0.5, 0.75)).select(
        *keys, *[F.get("quantiles", F.lit(i)).alias(n) for i, n in enumerate(("q25", "q50", "q75"))]
    )
    return basic.join(quartiles, keys).select(*keys, "count", "mean", "std", "min", "q25", "q50", "q75", "max")


def confidence_interval(df: DataFrame, columns: Sequence[str], confidence: float = 0.95, by: Sequence[str] = ()) -> DataFrame:
    """mean -/+ z * std / sqrt(n) per column; NaN removed; NaN when nothing is left."""
    rows, keys = _unpivot(df, columns, by), [*by, "metric"]
    basic = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"))
    margin = scores.normal_quantile(F.lit((1.0 + confidence) / 2.0)) * F.col("std") / F.sqrt("n")
    filled = basic.select(*keys, (F.col("mean") - margin).alias("low"), (F.col("mean") + margin).alias("high"))
    nan = F.lit(float("nan"))
    # one row per metric name and key of the input
    names = F.array(*[F.lit(c) for c in columns])
    wanted = df.select(*by).distinct() if by else df.sparkSession.range(1).select()
    wanted = wanted.withColumn("metric", F.explode(names))
    return wanted.join(filled, keys, "left").select(*keys, F.coalesce("low", nan).alias("low"), F.coalesce("high", nan).alias("high"))


def totals(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*by).agg(F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn"))


def count_weighted_iou(df: DataFrame) -> DataFrame:
    """Pixel IoU weighted by predictions, tree IoU weighted by truths."""
    return df.agg(
        F.try_divide(F.sum(F.col("pixel_iou") * F.col("n_pred")), F.sum("n_pred")).alias("pixel_iou"),
        F.try_divide(F.sum(F.col("tree_iou") * F.col("n_truth")), F.sum("n_truth")).alias("tree_iou"),
    )
