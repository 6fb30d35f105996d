"""Incremental prediction: the skip-existing rule as a file stream, and images that wait for all their tiles.

The batch rule leaves out images whose output exists. As a stream the checkpoint remembers which tile files
were read, so a rerun only sees new ones, and the same anti-join guards against outputs written elsewhere.

Tiles of an image may arrive in several batches. A keyed state counts the pixels that are there; the batch that
brings the last tile releases the image, and only then is the job run on it, with all its tiles.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from arborlake.session import cut_lineage
from arborlake.sources.tiles import TILE_SCHEMA, read_raster_tiles


def process_new_tiles(spark: SparkSession, tile_path: str, out_path: str, checkpoint: str,
                      job: Callable[[DataFrame], DataFrame], files_per_batch: int = 1000) -> StreamingQuery:
    """Run ``job`` on tiles that arrived since the last call and write its result under ``out_path``.

    Each micro-batch writes its own folder, overwritten when a lost batch is repeated, so a retry never
    duplicates rows.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        job(batch).write.mode("overwrite").parquet(f"{out_path}/batch={batch_id}")

    stream = spark.readStream.schema(TILE_SCHEMA).option("maxFilesPerTrigger", files_per_batch).parquet(tile_path)
    return (
        stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


COUNTED = "pixels long, done boolean"
RELEASED = "image_id {kind}, have long"


def released_images(tiles: DataFrame, meta: DataFrame) -> DataFrame:
    """Streamed ``image_id`` of images that have become complete, each once.

    ``tiles`` is a stream of tiles that do not overlap, ``meta`` the sizes of the images. The state of an image is
    one number, so a hot image needs no more than any other; tiles of a batch are summed up before the state.
    """
    sizes = meta.select("image_id", (F.col("width").cast("long") * F.col("height")).alias("_want"))
    own = tiles.select("image_id", (F.col("width").cast("long") * F.col("height")).alias("_have")).join(sizes, "image_id")
    kind = tiles.schema["image_id"].dataType.simpleString()

    def count(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        have, done = state.get if state.exists else (0, False)
        want = 0
        for part in parts:
            have, want = have + int(part["_have"].sum()), int(part["_want"].iloc[0])
        state.update((have, done or have >= want))
        if have >= want and not done:
            yield pd.DataFrame({"image_id": [key[0]], "have": [have]})

    return own.groupBy("image_id").applyInPandasWithState(count, RELEASED.format(kind=kind), COUNTED, "append", GroupStateTimeout.NoTimeout)


def process_complete_images(spark: SparkSession, tile_path: str, out_path: str, checkpoint: str, meta: DataFrame,
                            job: Callable[[DataFrame], DataFrame], files_per_batch: int = 1000) -> StreamingQuery:
    """Run ``job`` on all tiles of every image whose last tile has arrived since the last call.

    Images that miss tiles wait, over any number of batches and calls. Their tiles are read again from the folder
    when they are released, so the state stays small. A repeated batch overwrites its own folder.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        ready = cut_lineage(batch.select("image_id"))
        tiles = read_raster_tiles(spark, tile_path).join(ready, "image_id", "left_semi")
        job(tiles).write.mode("overwrite").parquet(f"{out_path}/batch={batch_id}")

    stream = spark.readStream.schema(TILE_SCHEMA).option("maxFilesPerTrigger", files_per_batch).parquet(tile_path)
    return (
        released_images(stream, meta).writeStream.outputMode("append").foreachBatch(write)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def pending_images(tiles: DataFrame, results: DataFrame) -> DataFrame:
    """Tiles of images without a result yet."""
    return tiles.join(results.select(F.col("image_id")).distinct(), "image_id", "left_anti")
