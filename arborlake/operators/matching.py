"""Matching of predicted and true objects.

Order-dependent loops become joins: "first wins" is a minimum over ids, and one row per pair is never
needed for a whole image. Per-image totals are plain aggregates, so one hot image stays spread out.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from itertools import cycle

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arborlake.functions.scores import precision_recall_f1
from arborlake.operators.graph import components
from arborlake.operators.polygons import iou, overlap_area, polygon_moments, shape_column
from arborlake.operators.spatial_join import distance_join, nearest_join
from arborlake.session import cut_lineage


def count_sides(pred: DataFrame, truth: DataFrame, by: Sequence[str]) -> DataFrame:
    """n_pred and n_truth per key, also for keys with one side only."""
    both = pred.select(*by, F.lit(1).alias("p"), F.lit(0).alias("t")).unionByName(
        truth.select(*by, F.lit(0).alias("p"), F.lit(1).alias("t"))
    )
    return both.groupBy(*by).agg(F.sum("p").alias("n_pred"), F.sum("t").alias("n_truth"))


def count_copies(polys: DataFrame, by: Sequence[str]) -> DataFrame:
    """How many polygons share the shape of the smallest id."""
    shape = shape_column(polys)
    return polys.groupBy(*by, shape).agg(F.min("poly_id").alias("left_id"), F.count("*").alias("copies")).drop(shape)


def best_truth(pairs: DataFrame, copies: DataFrame, by: Sequence[str], score: str) -> DataFrame:
    """Best truth per distinct prediction ring by ``iou`` or ``coverage`` (overlap / prediction area).

    ``pairs`` comes from :func:`overlap_area`, ``copies`` from :func:`count_copies` of the predictions; it tells how
    many predictions the ring stands for. The first truth wins ties.
    """
    by = list(by)
    value = {
        "iou": iou(F.col("inter"), F.col("left_area"), F.col("right_area")),
        "coverage": F.col("inter") / F.col("left_area"),
    }[score]
    # twelve digits hide the last-bit noise of the overlap sum, so that equal overlaps tie
    pairs = pairs.withColumn("value", F.round(value, 12)).filter("value > 0")
    best = pairs.groupBy(*by, "left_id").agg(F.min(F.struct((-F.col("value")).alias("low"), "right_id")).alias("b"))
    best = best.select(*by, "left_id", (-F.col("b.low")).alias("value"), F.col("b.right_id").alias("truth_id"))
    return best.join(copies, [*by, "left_id"])


def object_pixel_iou(pred: DataFrame, truth: DataFrame, by: Sequence[str] = ("image_id",), pairs: DataFrame | None = None,
                     counts: DataFrame | None = None, copies: DataFrame | None = None) -> DataFrame:
    """Mean over best IoU per prediction and one 0 per truth that no prediction chose; 0 when a side is empty.

    ``pairs``, ``counts`` and ``copies`` may pass in overlaps, :func:`count_sides` and :func:`count_copies` that are already there.
    """
    by = list(by)
    copies = count_copies(pred, by) if copies is None else copies
    best = best_truth(overlap_area(pred, truth, by) if pairs is None else pairs, copies, by, "iou")
    total = best.groupBy(*by).agg(F.sum(F.col("value") * F.col("copies")).alias("total"))
    # two levels, so that one image's chosen truths are counted in many tasks
    chosen = best.select(*by, "truth_id").distinct().groupBy(*by).agg(F.count("*").alias("chosen"))
    rows = (count_sides(pred, truth, by) if counts is None else counts).join(total, by, "left").join(chosen, by, "left")
    both = (F.col("n_pred") > 0) & (F.col("n_truth") > 0)
    entries = F.col("n_pred") + F.col("n_truth") - F.coalesce("chosen", F.lit(0))
    value = F.when(both, F.coalesce("total", F.lit(0.0)) / entries).otherwise(F.lit(0.0))
    return rows.select(*by, value.alias("pixel_iou"))


def tree_iou_greedy(pred: DataFrame, truth: DataFrame, by: Sequence[str] = ("image_id",), limit: float = 0.4,
                    pairs: DataFrame | None = None, counts: DataFrame | None = None, copies: DataFrame | None = None) -> DataFrame:
    """Best-covered truth per prediction; a truth counts once, for its first prediction."""
    by = list(by)
    pairs = overlap_area(pred, truth, by) if pairs is None else pairs
    copies = count_copies(pred, by) if copies is None else copies
    best = best_truth(pairs, copies, by, "coverage").filter(F.col("value") >= F.lit(float(limit)))
    hits = best.select(*by, "truth_id").distinct().groupBy(*by).agg(F.count("*").alias("hits"))
    rows = (count_sides(pred, truth, by) if counts is None else counts).join(hits, by, "left").withColumn("tp", F.coalesce("hits", F.lit(0)))
    both = (F.col("n_pred") > 0) & (F.col("n_truth") > 0)
    value = F.when(both, F.col("tp") / (F.col("n_pred") + F.col("n_truth") - F.col("tp"))).otherwise(F.lit(0.0))
    return rows.select(*by, value.alias("tree_iou"))


def centroid_match(pred: DataFrame, truth: DataFrame, by: Sequence[str] = ("image_id",), limit: float = 50.0,
                   counts: DataFrame | None = None) -> DataFrame:
    """Nearest prediction per truth within ``limit``; per prediction the first truth wins.

    Returns tp, fp, fn and the mean distance (NaN without a match).
    """
    by = list(by)
    p = polygon_moments(pred).select(*by, F.col("poly_id").alias("candidate_id"), F.col("cx").alias("rx"), F.col("cy").alias("ry"))
    # read twice, to search and to match
    t = cut_lineage(polygon_moments(truth).select(*by, F.col("poly_id").alias("point_id"), F.col("cx").alias("lx"), F.col("cy").alias("ly")))
    near = nearest_join(t, p, by, limit)
    kept = near.groupBy(*by, "candidate_id").agg(F.min(F.struct("point_id", "distance")).alias("m"))
    hits = kept.groupBy(*by).agg(F.count("*").alias("tp"), F.sum("m.distance").alias("total"))
    rows = (count_sides(pred, truth, by) if counts is None else counts).join(hits, by, "left").withColumn("tp", F.coalesce("tp", F.lit(0)))
    error = F.when(F.col("tp") > 0, F.col("total") / F.col("tp")).otherwise(F.lit(float("nan")))
    return rows.select(
        *by, "tp", (F.col("n_pred") - F.col("tp")).alias("fp"), (F.col("n_truth") - F.col("tp")).alias("fn"),
        error.alias("centroid_error"),
    )


def mutual_rounds(pairs: DataFrame, by: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Greedy one-to-one matching of ``left_id, right_id`` pairs in ``order``, by rounds.

    A pair that is first for both of its ends is taken by the sequential loop too. Every round accepts all
    such pairs and drops the pairs they touch; it ends when no pair is left.
    """
    by = list(by)
    key = F.struct(*order, "left_id", "right_id")
    left_pairs = cut_lineage(pairs.withColumn("k", key))
    taken = None
    while not left_pairs.isEmpty():
        first_l = left_pairs.groupBy(*by, "left_id").agg(F.min("k").alias("first_l"))
        first_r = left_pairs.groupBy(*by, "right_id").agg(F.min("k").alias("first_r"))
        ranked = left_pairs.join(first_l, [*by, "left_id"]).join(first_r, [*by, "right_id"])
        won = cut_lineage(ranked.filter("k = first_l and k = first_r").select(pairs.columns))
        taken = won if taken is None else taken.unionByName(won)
        left_pairs = cut_lineage(
            left_pairs.join(won.select(*by, "left_id"), [*by, "left_id"], "left_anti")
            .join(won.select(*by, "right_id"), [*by, "right_id"], "left_anti")
        )
    return pairs.limit(0) if taken is None else taken


BLOCK = 32  # side of a block of the matching, in limits; above 4, so that a point is inside of some layout's block


def _block_pass(keys: Sequence[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Walks over sorted pairs and says of each block's pairs which are ``taken``; others come out open, or not at all.

    A pair is open when its right point may have pairs in other blocks, or one of its ends an open pair before it.
    """

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        used_l, used_r, open_l, open_r = set(), set(), set(), set()
        for batch in batches:
            if not batch.num_rows:
                continue
            fresh = np.zeros(batch.num_rows, bool)
            for key in keys:
                column = batch.column(key)
                fresh[1:] |= pc.not_equal(column[1:], column[:-1]).to_numpy(zero_copy_only=False)
            place = [batch.column(key)[0].as_py() for key in keys]
            fresh[0] = place != last
            last = [batch.column(key)[-1].as_py() for key in keys]
            state = np.zeros(batch.num_rows, np.int8)
            ends = [batch.column(c).to_numpy(zero_copy_only=False).tolist() for c in ("left_id", "right_id", "shared")]
            for i, (new, a, b, shared) in enumerate(zip(fresh.tolist(), *ends)):
                if new:
                    used_l, used_r, open_l, open_r = set(), set(), set(), set()
                if a in used_l or b in used_r:
                    continue
                if shared or a in open_l or b in open_r:
                    open_l.add(a)
                    open_r.add(b)
                    state[i] = 1
                else:
                    used_l.add(a)
                    used_r.add(b)
                    state[i] = 2
            kept = batch.drop_columns([*(c for c in keys if c.startswith("_block")), "shared"]).append_column("taken", pa.array(state == 2))
            yield kept.filter(pa.array(state > 0))

    return walk


def first_free_pairs(pairs: DataFrame, by: Sequence[str], limit: float) -> DataFrame:
    """``by, left_id, right_id, distance`` of the pairs that a loop in (left, right) order takes, each end once.

    Pairs carry the places of their points, one place an id. Those of a block of places are walked in order, which needs
    no more than the ids met in the block. What hangs on other blocks is walked again in blocks moved by half their
    side, until no pair is open: every point is well inside a block of one of the four layouts, so the first open pair
    is settled by then, and mostly a whole block of pairs.
    """
    by, columns = list(by), [*by, "left_id", "right_id", "distance", "lx", "ly", "rx", "ry"]
    side, reach = float(limit) * BLOCK, float(limit) * 1.000001
    keys = [*by, "_block_x", "_block_y"]
    taken, open_ = None, pairs.select(*columns)
    for shift in cycle(((0.0, 0.0), (0.5, 0.5), (0.5, 0.0), (0.0, 0.5))):
        block = lambda v, s=shift: [F.floor(v(c) / side + o) for c, o in zip("xy", s)]
        low, high = (block(lambda c, d=d: F.col(f"r{c}") + d) for d in (-reach, reach))
        x, y = block(lambda c: F.col(f"l{c}"))
        placed = open_.withColumns({"_block_x": x, "_block_y": y, "shared": (low[0] != high[0]) | (low[1] != high[1])})
        # blocks are told apart by a hash first, which sorts faster than their keys
        placed = placed.repartition(*keys).sortWithinPartitions(F.xxhash64(*keys), *keys, "left_id", "right_id")
        walked = cut_lineage(placed.mapInArrow(_block_pass(keys), open_.withColumn("taken", F.lit(True)).schema))
        won, open_ = (walked.filter(c).drop("taken") for c in ("taken", "not taken"))
        taken = won if taken is None else taken.unionByName(won)
        if open_.isEmpty():
            return taken.select(*columns[:-4])


def proximity_match(pred: DataFrame, truth: DataFrame, by: Sequence[str] = ("image_id",), limit: float = 5.0) -> DataFrame:
    """First free pair within ``limit`` in (prediction, truth) order, matched in rounds.

    Sides carry ``by, point_id, x, y`` where ``point_id`` gives the order; they are heatmap peaks, one per
    pixel, so a point has a bounded number of partners. Returns precision, recall, f1
    and the mean distance of matched pairs; (0, 0, 0, inf) when a side is empty.
    """
    by = list(by)
    pred, truth = (cut_lineage(side.select(*by, "point_id", "x", "y")) for side in (pred, truth))
    left = pred.select(*by, F.col("point_id").alias("left_id"), F.col("x").alias("lx"), F.col("y").alias("ly"))
    right = truth.select(*by, F.col("point_id").alias("right_id"), F.col("x").alias("rx"), F.col("y").alias("ry"))
    pairs = distance_join(left, right, by, limit).filter("left_id is not null and right_id is not null")
    both = pred.withColumn("side", F.lit(0)).unionByName(truth.withColumn("side", F.lit(1))).filter("point_id is not null")
    repeated = both.groupBy(*by, "side", "point_id").agg(F.count("*").alias("n")).filter("n > 1")
    if repeated.isEmpty():
        matched = first_free_pairs(pairs, by, limit)
    else:  # an id with several places belongs to no block
        matched = mutual_rounds(pairs.select(*by, "left_id", "right_id", "distance"), by, [])
    hits = matched.groupBy(*by).agg(F.count("*").alias("tp"), F.sum("distance").alias("total"))
    rows = count_sides(pred, truth, by).join(hits, by, "left").withColumn("tp", F.coalesce("tp", F.lit(0)))
    precision, recall, f1 = precision_recall_f1(F.col("tp"), F.col("n_pred") - F.col("tp"), F.col("n_truth") - F.col("tp"))
    error = F.when(F.col("tp") > 0, F.col("total") / F.col("tp")).otherwise(F.lit(float("inf")))
    return rows.select(
        *by, F.col("tp").cast("bigint").alias("tp"), precision.alias("precision"), recall.alias("recall"), f1.alias("f1"),
        error.alias("localization_error"),
    )


def _assign(weights: np.ndarray) -> list[tuple[int, int]]:
    """Maximum-weight one-to-one assignment of a small dense matrix by shortest augmenting paths."""
    flip = weights.shape[0] > weights.shape[1]
    cost = -(weights.T if flip else weights)
    n, m = cost.shape
    row_price, col_price = np.zeros(n + 1), np.zeros(m + 1)
    owner = np.zeros(m + 1, dtype=int)
    for row in range(1, n + 1):
        owner[0], col = row, 0
        slack, came_from, done = np.full(m + 1, np.inf), np.zeros(m + 1, dtype=int), np.zeros(m + 1, dtype=bool)
        while True:
            done[col] = True
            i = owner[col]
            gap = cost[i - 1] - row_price[i] - col_price[1:]
            better = ~done[1:] & (gap < slack[1:])
            slack[1:][better], came_from[1:][better] = gap[better], col
            reach = np.where(done, np.inf, slack)
            nxt = int(np.argmin(reach))
            step = reach[nxt]
            row_price[owner[done]] += step
            col_price[done] -= step
            slack[~done] -= step
            col = nxt
            if owner[col] == 0:
                break
        while col:
            owner[col] = owner[came_from[col]]
            col = came_from[col]
    pairs = [(int(owner[j]) - 1, j - 1) for j in range(1, m + 1) if owner[j]]
    return [(b, a) for a, b in pairs] if flip else pairs


def _assign_component(rows: pd.DataFrame) -> pd.DataFrame:
    lefts = rows.groupby("left_id")["left_copies"].first()
    rights = rows.groupby("right_id")["right_copies"].first()
    # a ring never needs more copies than its partners have together
    l_cap = np.minimum(lefts, rows.groupby("left_id")["right_copies"].sum())
    r_cap = np.minimum(rights, rows.groupby("right_id")["left_copies"].sum())
    weights = np.zeros((len(lefts), len(rights)))
    weights[lefts.index.get_indexer(rows["left_id"]), rights.index.get_indexer(rows["right_id"])] = rows["iou"]
    l_of, r_of = np.repeat(np.arange(len(lefts)), l_cap), np.repeat(np.arange(len(rights)), r_cap)
    units = np.zeros(weights.shape, dtype="int64")
    for i, j in _assign(weights[np.ix_(l_of, r_of)]):
        units[l_of[i], r_of[j]] += 1
    out = rows.assign(units=units[lefts.index.get_indexer(rows["left_id"]), rights.index.get_indexer(rows["right_id"])])
    return out[(out["units"] > 0) & (out["iou"] > 0)]


def best_assignment(pairs: DataFrame, by: Sequence[str]) -> DataFrame:
    """One-to-one pairs of greatest total ``iou``: adds ``units``, how many copies of the pair are matched.

    Pairs carry ``by, left_id, right_id, left_copies, right_copies, iou`` over distinct rings, so copies are
    counts, not rows. A pair at least as heavy as the best other choices of its two ends together belongs to
    some best assignment. Rounds take all such pairs and drop the rings they use up, which settles nearly
    every object in a distributed way. What is left splits into components of mutually contested rings, one
    exact assignment each.
    """
    by = list(by)
    open_pairs = cut_lineage(pairs.withColumn("units", F.lit(0).cast("bigint")))
    taken = open_pairs.limit(0)
    while not open_pairs.isEmpty():

        def ends(end: str) -> DataFrame:
            top = open_pairs.groupBy(*by, end).agg(F.max(F.struct("iou", "left_id", "right_id")).alias("top"))
            rest = (
                open_pairs.join(top, [*by, end]).filter("left_id <> top.left_id or right_id <> top.right_id")
                .groupBy(*by, end).agg(F.max("iou").alias("second"))
            )
            return top.join(rest, [*by, end], "left").select(*by, end, "top", F.coalesce("second", F.lit(0.0)).alias("second"))

        left = ends("left_id").withColumnsRenamed({"top": "lt", "second": "ls"})
        right = ends("right_id").withColumnsRenamed({"top": "rt", "second": "rs"})
        won = cut_lineage(
            open_pairs.join(left, [*by, "left_id"]).join(right, [*by, "right_id"])
            .filter("lt.right_id = right_id and rt.left_id = left_id and iou >= ls + rs")
            .withColumn("units", F.least("left_copies", "right_copies")).select(open_pairs.columns)
        )
        if won.isEmpty():
            break
        taken = taken.unionByName(won)
        used_l = won.select(*by, "left_id", F.col("units").alias("used_l"))
        used_r = won.select(*by, "right_id", F.col("units").alias("used_r"))
        open_pairs = cut_lineage(
            open_pairs.join(used_l, [*by, "left_id"], "left").join(used_r, [*by, "right_id"], "left")
            .withColumn("left_copies", F.col("left_copies") - F.coalesce("used_l", F.lit(0)))
            .withColumn("right_copies", F.col("right_copies") - F.coalesce("used_r", F.lit(0)))
            .filter("left_copies > 0 and right_copies > 0").select(open_pairs.columns)
            .join(won.select(*by, "left_id", "right_id"), [*by, "left_id", "right_id"], "left_anti")
        )
    if open_pairs.isEmpty():
        return taken
    end = lambda side, c: F.struct(F.lit(side).alias("side"), F.col(c).alias("id"))
    linked = open_pairs.select(*by, end(0, "left_id").alias("u"), end(1, "right_id").alias("v"))
    groups = components(linked, by).filter("node.side = 0").select(*by, F.col("node.id").alias("left_id"), "component")
    contested = open_pairs.join(groups, [*by, "left_id"])
    solved = contested.groupBy(*by, "component").applyInPandas(_assign_component, contested.schema)
    return taken.unionByName(solved.select(taken.columns))


def tree_iou_optimal(pred: DataFrame, truth: DataFrame, by: Sequence[str] = ("image_id",), limit: float = 0.4) -> DataFrame:
    """Assignment of greatest total IoU, then pairs with IoU at least ``limit`` count. Pairs without overlap add nothing."""
    by = list(by)
    shapes = overlap_area(pred, truth, by)
    pairs = shapes.withColumn("iou", F.round(iou(F.col("inter"), F.col("left_area"), F.col("right_area")), 12)).filter("iou > 0")
    right_copies = count_copies(truth, by).withColumnsRenamed({"left_id": "right_id", "copies": "right_copies"})
    pairs = (
        pairs.join(count_copies(pred, by).withColumnRenamed("copies", "left_copies"), [*by, "left_id"])
        .join(right_copies, [*by, "right_id"]).select(*by, "left_id", "right_id", "left_copies", "right_copies", "iou")
    )
    matched = best_assignment(pairs, by).filter(F.col("iou") >= F.lit(float(limit)))
    hits = matched.groupBy(*by).agg(F.sum("units").alias("hits"))
    rows = count_sides(pred, truth, by).join(hits, by, "left").withColumn("tp", F.coalesce("hits", F.lit(0)))
    both = (F.col("n_pred") > 0) & (F.col("n_truth") > 0)
    value = F.when(both, F.col("tp") / (F.col("n_pred") + F.col("n_truth") - F.col("tp"))).otherwise(F.lit(0.0))
    return rows.select(*by, value.alias("tree_iou"))
