"""Peaks and seeded floods settle many blocks at once and give what a plain walk gives."""

import heapq

import numpy as np
import pytest
from pyspark.sql import functions as F

from arborlake.operators import morphology


def pixel_table(spark, rows):
    return spark.createDataFrame(rows, "image_id int, x int, y int, value double")


def window_peaks(values, k, limit):
    back, on = k // 2, k - k // 2 - 1
    near = lambda x, y: (values.get((x + dx, y + dy)) for dx in range(-back, on + 1) for dy in range(-back, on + 1))
    return {(x, y) for (x, y), v in values.items() if v > limit and v == max(w for w in near(x, y) if w is not None)}


def plain_peaks(values, distance):
    kept = []
    for x, y in sorted(window_peaks(values, 2 * distance + 1, 0.0), key=lambda p: (-values[p], p[1], p[0])):
        if all(abs(x - a) >= distance or abs(y - b) >= distance for a, b in kept):
            kept.append((x, y))
    return set(kept)


def plain_regions(values, seeds):
    """Marker of every pixel that a seed reaches: pixels come in order of (level, steps on it, marker), and the first one
    next to a pixel decides it."""
    heap = [(-values[p], 0, m, p) for p, m in seeds.items() if p in values]
    state = {p: m for _, _, m, p in heap}
    heapq.heapify(heap)
    while heap:
        level, hops, marker, (x, y) = heapq.heappop(heap)
        for p in ((x + 1, y), (x - 1, y), (x, y + 1), (x, y - 1)):
            if p in values and p not in state:
                state[p] = marker
                up = -values[p] > level
                heapq.heappush(heap, (-values[p] if up else level, 1 if up else hops + 1, marker, p))
    return state


@pytest.fixture(scope="module")
def images():
    rng = np.random.default_rng(8)
    out = {}
    for image, (left, top, side) in enumerate(((0, 0, 40), (230, 240, 50), (3, 100, 17))):
        out[image] = {(left + i, top + j): float(rng.integers(0, 7)) for i in range(side) for j in range(side) if rng.random() < 0.85}
    return out


@pytest.mark.parametrize("k", [1, 4, 7])
def test_window_maxima_slide_over_blocks(spark, images, k):
    rows = [(i, x, y, v) for i, values in images.items() for (x, y), v in values.items()]
    px = pixel_table(spark, [*rows, rows[0], (0, None, 3, 9.0), (0, 2, None, 9.0), (None, 1, 1, 9.0), (1, 900, 900, None)])
    found = morphology.local_maxima(px, k, 2.0)
    assert "HashAggregate" not in found._jdf.queryExecution().toString()  # no row a pixel and place of the window
    got = sorted((r.image_id, r.x, r.y, r.value) for r in found.collect())
    want = sorted((i, x, y, images[i][x, y]) for i in images for x, y in window_peaks(images[i], k, 2.0))
    assert got == sorted(want + [r for r in rows[:1] if r in want])


def test_chains_of_peaks_are_decided_in_few_rounds(spark, images, monkeypatch):
    written, cut = [], morphology.cut_lineage
    monkeypatch.setattr(morphology, "cut_lineage", lambda df: (written.append(df.columns), cut(df))[1])
    chain = {(8 * i + d, 5): 200.0 - i if d == 0 else 0.0 for i in range(70) for d in range(8)}
    chain |= {(8 * i + 4, 5 + d): 199.5 - i for i in range(69) for d in (0, 6)}
    shapes = {**images, 9: chain}
    px = pixel_table(spark, [(i, x, y, v) for i, values in shapes.items() for (x, y), v in values.items()])
    for distance in (3, 7):
        written.clear()
        got = {(r.image_id, r.x, r.y) for r in morphology.spaced_peaks(px, distance).collect()}
        assert got == {(i, *p) for i, values in shapes.items() for p in plain_peaks(values, distance)}
        assert len(written) <= 8


@pytest.mark.parametrize("tile", [5, 16, 256])
def test_floods_of_many_tiles_at_once(spark, images, monkeypatch, tile):
    written, cut = [], morphology.cut_lineage
    monkeypatch.setattr(morphology, "cut_lineage", lambda df: (lambda out: (written.append(out), out)[1])(cut(df)))
    px = pixel_table(spark, [(i, x, y, v) for i, values in images.items() for (x, y), v in values.items()] + [(0, None, 4, 3.0), (0, 300, 4, None)])
    seeds = {i: {p: int(p[1] * 1000 + p[0]) for p in sorted(window_peaks(values, 9, 0.0))[::3]} for i, values in images.items()}
    markers = spark.createDataFrame([(i, *p, m) for i, s in seeds.items() for p, m in s.items()] + [(0, 301, 4, 5)], "image_id int, x int, y int, marker long")
    regions = morphology.seeded_regions(px, markers, tile=tile)
    assert regions.dtypes == [("image_id", "int"), ("x", "int"), ("y", "int"), ("region", "bigint")]
    got = {(r.image_id, r.x, r.y): r.region for r in regions.collect()}
    assert got == {(i, *p): m for i, values in images.items() for p, m in plain_regions(values, seeds[i]).items()}
    tiles = {(i, x // tile, y // tile) for i, values in images.items() for x, y in values}
    assert all(t.filter("own").count() == len(tiles) for t in written)  # a tile is a row, not a row a pixel


def test_a_batch_with_too_many_levels_is_halved(monkeypatch):
    rng = np.random.default_rng(1)
    cells = {c: [] for c in ("tile", "x", "y", "own", "cost", "seed", "level", "hops", "marker")}
    for t in range(6):
        cost = rng.permutation(64).astype(float)
        start = np.isin(np.arange(64), rng.choice(64, 3, False))
        for c, v in zip(cells, (np.full(64, t), np.arange(64) % 8 + 1, np.arange(64) // 8 + 1, np.ones(64, bool), cost + 100 * t, start, np.where(start, cost + 100 * t, np.inf),
                                np.zeros(64, int), np.where(start, np.arange(64) + 64 * t, morphology._NONE))):
            cells[c].append(v)
    cells = {c: np.concatenate(v) for c, v in cells.items()}
    want = {c: v.copy() for c, v in cells.items()}
    morphology._flood_tiles(want, np.ones(6, bool))
    monkeypatch.setattr(morphology, "_BITS", 18)  # room for two tiles
    morphology._flood_tiles(cells, np.ones(6, bool))
    assert all(np.array_equal(cells[c], want[c]) for c in cells) and (cells["marker"] != morphology._NONE).all()
    monkeypatch.setattr(morphology, "_BITS", 8)
    with pytest.raises(ValueError, match="too many levels"):
        morphology._flood_tiles({c: np.where(want["seed"], want[c], v) if c == "marker" else v for c, v in want.items()}, np.ones(6, bool))
