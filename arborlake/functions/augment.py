"""Random augmentation of patch arrays as column expressions.

Patches keep ``bands`` and ``labels`` as ``ARRAY<ARRAY<double>>`` of one size; every random number is a hash of
patch key, seed, epoch and purpose. Nothing is shuffled or exploded.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arborlake.functions.geometry import let
from arborlake.functions.hashing import uniform, uniform_between


def draws(key: Column, seed: int, epoch: int) -> Column:
    """All per-patch random choices: hflip, vflip, quarter turns, brightness, contrast, gamma."""
    salt = f"{seed}|{epoch}"
    return F.struct(
        (uniform(key, salt, "hflip") > 0.5).alias("hflip"), (uniform(key, salt, "vflip") > 0.5).alias("vflip"),
        F.floor(uniform(key, salt, "turns") * 4).cast("int").alias("turns"),
        uniform_between(0.8, 1.2, key, salt, "brightness").alias("brightness"),
        uniform_between(0.8, 1.2, key, salt, "contrast").alias("contrast"),
        uniform_between(0.8, 1.2, key, salt, "gamma").alias("gamma"),
    )


def _unit(v: Column) -> Column:
    return F.least(F.greatest(v, F.lit(0.0)), F.lit(1.0))


def flip_and_turn(band: Column, d: Column, width: Column, height: Column) -> Column:
    """Mirror each axis when drawn, then turn anticlockwise by quarter turns."""
    even = d["turns"] % 2 == 0
    out_w = F.when(even, width).otherwise(height)

    def source(i: Column) -> Column:
        ox, oy = i % out_w, F.floor(i / out_w).cast("int")
        x = F.when(d["turns"] == 0, ox).when(d["turns"] == 1, width - 1 - oy).when(d["turns"] == 2, width - 1 - ox).otherwise(oy)
        y = F.when(d["turns"] == 0, oy).when(d["turns"] == 1, ox).when(d["turns"] == 2, height - 1 - oy).otherwise(height - 1 - ox)
        x = F.when(d["hflip"], width - 1 - x).otherwise(x)
        y = F.when(d["vflip"], height - 1 - y).otherwise(y)
        return F.get(band, y * width + x)

    return F.transform(F.sequence(F.lit(0), width * height - 1), source)


def brightness(band: Column, factor: Column) -> Column:
    return F.transform(band, lambda v: _unit(v * factor))


def contrast(band: Column, factor: Column) -> Column:
    """Around the mean of the channel."""
    mean = lambda b: F.aggregate(b, F.lit(0.0), lambda a, v: a + v) / F.size(b)
    return let(band, lambda b: let(mean(b), lambda m: F.transform(b, lambda v: _unit((v - m) * factor + m))))


def noise(band: Column, number: Column, key: Column, seed: int, epoch: int) -> Column:
    """Multiplicative noise per pixel, 0.9 to 1.1."""
    salt = f"{seed}|{epoch}"
    return F.transform(
        band,
        lambda v, i: _unit(v * uniform_between(0.9, 1.1, key, salt, "noise", number.cast("string"), i.cast("string"))),
    )


def gamma(band: Column, power: Column) -> Column:
    return F.transform(band, lambda v: _unit(F.pow(v, power)))


def augment(patches: DataFrame, seed: int, epoch: int, key: str = "patch_key") -> DataFrame:
    """The six steps in fixed order; flips and turns move image and labels together, the rest is image only."""
    k = F.col(key).cast("string")
    rows = patches.withColumn("_d", draws(k, seed, epoch))
    d, w, h = F.col("_d"), F.col("width"), F.col("height")

    def image(band: Column, number: Column) -> Column:
        moved = flip_and_turn(band, d, w, h)
        lit = contrast(brightness(moved, d["brightness"]), d["contrast"])
        return gamma(noise(lit, number, k, seed, epoch), d["gamma"])

    changes = {"bands": F.transform("bands", image)}
    if "labels" in patches.columns:
        changes["labels"] = F.transform("labels", lambda b: flip_and_turn(b, d, w, h))
    odd = F.col("_d.turns") % 2 == 1
    rows = rows.withColumns(changes)
    return rows.withColumns({"width": F.when(odd, h).otherwise(w), "height": F.when(odd, w).otherwise(h)}).drop("_d")
