"""The per-file evaluation table as CSV."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Header of the evaluation file, with the engine's column and type.
COLUMNS = (
    ("File", "file", "string"),
    ("Pixel IoU", "pixel_iou", "double"),
    ("Tree IoU", "tree_iou", "double"),
    ("True Positives", "tp", "bigint"),
    ("False Positives", "fp", "bigint"),
    ("False Negatives", "fn", "bigint"),
    ("Precision", "precision", "double"),
    ("Recall", "recall", "double"),
    ("F1-Score", "f1", "double"),
    ("Centroid Error", "centroid_error", "double"),
    ("Latitude", "latitude", "double"),
    ("Longitude", "longitude", "double"),
    ("Prediction Count", "n_pred", "bigint"),
    ("Ground Truth Count", "n_truth", "bigint"),
)


def write_eval_csv(rows: DataFrame, path: str, by: Sequence[str] = ()) -> None:
    """The fourteen columns as CSV, in a folder for each value of ``by``."""
    named = rows.select(*[F.col(c).alias(head) for head, c, _ in COLUMNS], *by)
    named.write.mode("errorifexists").option("header", True).partitionBy(*by).csv(path)


def read_eval_csv(spark: SparkSession, path: str) -> DataFrame:
    schema = ", ".join(f"`{head}` {kind}" for head, _, kind in COLUMNS)
    rows = spark.read.schema(schema).option("header", True).option("nanValue", "NaN").csv(path)
    return rows.select(*[F.col(f"`{head}`").alias(c) for head, c, _ in COLUMNS])
