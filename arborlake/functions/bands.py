"""Band and value expressions on ``ARRAY<ARRAY<double>>`` tiles and on scalar pixel values."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Largest value of each integer raster type.
DTYPE_MAX = {
    "uint8": 255.0,
    "int8": 127.0,
    "uint16": 65535.0,
    "int16": 32767.0,
    "uint32": 4294967295.0,
    "int32": 2147483647.0,
    "uint64": 18446744073709551615.0,
    "int64": 9223372036854775807.0,
}
# Raster values below this mark missing data when no nodata value is set.
NODATA_FLOOR = -3e38


def map_bands(bands: Column, fn) -> Column:
    """Apply ``fn(value)`` to every pixel of every band."""
    return F.transform(bands, lambda band: F.transform(band, lambda v: fn(v)))


def reorder_bands(bands: Column, order: Sequence[int]) -> Column:
    return F.array(*[F.element_at(bands, int(i) + 1) for i in order])


def check_bands(bands: Column, order: Sequence[int]) -> Column:
    """The bands unchanged; raises when an index is out of range."""
    needed = max(order) + 1 if len(order) else 0
    message = F.concat(F.lit(f"band order needs {needed} bands, tile has "), F.size(bands).cast("string"))
    return F.when(F.size(bands) >= needed, bands).otherwise(F.raise_error(message).cast("array<array<double>>"))


def mask_nodata(value: Column, nodata: Column | None = None) -> Column:
    """0 where the value equals nodata; without a nodata value, 0 below the floor."""
    if nodata is None:
        return F.when(value < F.lit(NODATA_FLOOR), F.lit(0.0)).otherwise(value)
    return F.when(nodata.isNotNull() & (value == nodata), F.lit(0.0)).when(
        nodata.isNull() & (value < F.lit(NODATA_FLOOR)), F.lit(0.0)
    ).otherwise(value)


def clip_uint8(value: Column) -> Column:
    return F.least(F.greatest(value, F.lit(0.0)), F.lit(255.0)).cast("int")


def scale_by_dtype(value: Column, dtype: Column) -> Column:
    """Divide integers by the maximum of their type; floats pass; other types raise."""
    divisor = F.when(dtype.startswith("float"), F.lit(1.0))
    for name, top in DTYPE_MAX.items():
        divisor = divisor.when(dtype == name, F.lit(top))
    named = F.concat(F.lit("unsupported raster type "), F.coalesce(dtype, F.lit("null")))
    divisor = divisor.otherwise(F.raise_error(named).cast("double"))
    return value / divisor


def to_unit(value: Column) -> Column:
    return value / F.lit(255.0)


def from_signed(value: Column) -> Column:
    return (value + F.lit(1.0)) * F.lit(127.5)


def composite(bands: Column, kind: str) -> Column:
    """Three display bands of a NIR,R,G,B tile."""
    orders = {"true": (1, 2, 3), "false": (0, 1, 2)}
    if kind not in orders:
        raise ValueError(f"composite is 'true' or 'false', not {kind!r}")
    return reorder_bands(bands, orders[kind])


def activate(value: Column, name: str = "sigmoid") -> Column:
    if name == "sigmoid":
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-value))
    if name == "tanh":
        return F.tanh(value)
    raise ValueError(f"unsupported activation {name!r}")


def threshold(value: Column, limit: float, inclusive: bool = True) -> Column:
    """Inference keeps scores at the limit, metrics and segmentation do not."""
    return value >= F.lit(float(limit)) if inclusive else value > F.lit(float(limit))


def rescale(value: Column, factor: float) -> Column:
    return value * F.lit(float(factor))


def standardise(bands: Column, mean: Sequence[float], std: Sequence[float]) -> Column:
    """(v - mean) / std per band. Three-band statistics get 0.5 in front for the extra first band."""
    mean, std = list(mean), list(std)
    if len(mean) == 3:
        mean.insert(0, 0.5)
    if len(std) == 3:
        std.insert(0, 0.5)
    centre = F.array(*[F.lit(float(m)) for m in mean])
    spread = F.array(*[F.lit(float(s)) for s in std])
    return F.transform(
        bands,
        lambda band, i: F.transform(band, lambda v: (v - F.get(centre, i)) / F.get(spread, i)),
    )


def pad_to(band: Column, width: Column, height: Column, to_width: int, to_height: int) -> Column:
    """Zero padding of one row-major band on the right and at the bottom."""
    out_w = F.greatest(width, F.lit(to_width))
    out_h = F.greatest(height, F.lit(to_height))
    cells = F.sequence(F.lit(0), out_w * out_h - 1)
    return F.transform(cells, lambda i: _cell_or_zero(band, width, height, i % out_w, F.floor(i / out_w).cast("int")))


def center_crop_or_pad(band: Column, width: Column, height: Column, size: int) -> Column:
    """Centred crop where a side is longer than ``size``, centred zero padding where it is shorter."""
    left = F.floor(F.greatest(F.lit(size) - width, F.lit(0)) / 2) - F.floor(F.greatest(width - size, F.lit(0)) / 2)
    top = F.floor(F.greatest(F.lit(size) - height, F.lit(0)) / 2) - F.floor(F.greatest(height - size, F.lit(0)) / 2)
    cells = F.sequence(F.lit(0), F.lit(size * size - 1))
    return F.transform(
        cells,
        lambda i: _cell_or_zero(
            band, width, height, (i % size - left).cast("int"), (F.floor(i / size) - top).cast("int")
        ),
    )


def _cell_or_zero(band: Column, width: Column, height: Column, x: Column, y: Column) -> Column:
    inside = (x >= 0) & (x < width) & (y >= 0) & (y < height)
    return F.when(inside, F.get(band, y * width + x)).otherwise(F.lit(0.0))
