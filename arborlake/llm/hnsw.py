"""Near-duplicate embeddings by hierarchical navigable small-world graphs.

Equal vectors of a label are collapsed to one with a count. A label's vectors are dealt by hash into shards of
bounded size, each with a graph of its own, and every vector is searched in its own shard and in all others, so
that every pair is met from both sides. Searches walk many queries at once with a beam of the best nodes met.

Before a search some queries are audited: their true nearest nodes, linked or not, are compared with those that
their walks meet. While too few are met, the beam is doubled and the audit repeated; a beam of the whole shard
meets every node. The nodes of the beams are candidates; links are those whose cosine in double precision reaches
the threshold. A beam can be full of links; so the cosines between all members of a component that beams have joined
are verified as well, which costs little next to the walks. The recall of the last audits is returned with the
vectors.

A task hands on, for each vector, the number of its links and one link to the least vector it is joined with, so
groups of any size pass through without their pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arborlake.llm.common import mix, partitions, roots_of
from arborlake.operators.graph import components
from arborlake.session import cut_lineage

LEAST = 0.98
SHARD = 8192  # vectors of one graph, fewer if they are long
SHARD_BYTES = 32 << 20
NEIGHBOURS = 16  # links of a node; twice as many on the ground layer
BEAM = 48  # width of a search to begin with
BUILD_BEAM = 64
BATCH = 256  # queries that walk together
STEP = 12  # a query expands one in so many nodes of its beam at once
AUDIT = 64  # queries of each side that are compared with a scan
NEAREST = 10  # nodes that the walk of an audited query should meet
RECALL = 0.98  # share of them that has to be met before a beam is wide enough
SINGLE = 1e-5  # error of a cosine in single precision, at most


class Graph:
    """Layers of links over unit vectors; node numbers are those of the ground layer."""

    def __init__(self, unit: np.ndarray, layers: list[tuple[np.ndarray, np.ndarray]]) -> None:
        self.unit, self.layers = unit, layers  # per layer: its nodes, and the links by place in the layer

    @classmethod
    def build(cls, unit: np.ndarray, keys: np.ndarray) -> Graph:
        """Inserts the vectors in batches, those of high layers first; layers follow from the hashed keys."""
        chance = (mix(keys.astype(np.uint64)) >> np.uint64(11)).astype(float) / 2.0**53
        level = np.floor(-np.log(np.maximum(chance, 1e-300)) / np.log(NEIGHBOURS)).astype(int)
        graph = cls(unit, [])
        for layer in range(int(level.max()), -1, -1):
            nodes = np.nonzero(level >= layer)[0]
            nodes = nodes[np.argsort(-level[nodes], kind="stable")]
            graph.layers.insert(0, (nodes, graph._connect(nodes, NEIGHBOURS * (1 if layer else 2))))
        return graph

    def _connect(self, nodes: np.ndarray, width: int) -> np.ndarray:
        """Links of one layer. The layers above are finished and lead the way to it."""
        own = self.unit[nodes]
        links = np.full((len(nodes), width), -1, np.int32)
        done = min(len(nodes), BATCH)
        same = own[:done] @ own[:done].T
        np.fill_diagonal(same, -2)
        most = min(BUILD_BEAM, done)
        near = np.argsort(-same, axis=1, kind="stable")[:, :most]
        links[:done] = _diverse(own, np.arange(done), near, np.take_along_axis(same, near, 1), width)
        self._back(own, links, np.arange(done), width)
        while done < len(nodes):
            new = np.arange(done, min(len(nodes), done + BATCH))
            start = self._descend(own[new], nodes)
            ids, cosines = _walk(own, links, own[new], start, BUILD_BEAM)
            among = own[new] @ own[new].T
            np.fill_diagonal(among, -2)
            ids = np.concatenate([ids, np.broadcast_to(new, (len(new), len(new)))], axis=1)
            cosines = np.concatenate([cosines, among], axis=1)
            order = np.argsort(-cosines, axis=1, kind="stable")[:, :BUILD_BEAM]
            links[new] = _diverse(own, new, np.take_along_axis(ids, order, 1), np.take_along_axis(cosines, order, 1), width)
            self._back(own, links, new, width)
            done += len(new)
        return links

    @staticmethod
    def _back(own: np.ndarray, links: np.ndarray, new: np.ndarray, width: int) -> None:
        """Adds the way back for all links of the new nodes; full lists keep a diverse choice."""
        source = np.repeat(new, width)
        target = links[new].ravel()
        source, target = source[target >= 0], target[target >= 0]
        order = np.argsort(target, kind="stable")
        source, target = source[order], target[order]
        touched, first, count = np.unique(target, return_index=True, return_counts=True)
        most = min(int(count.max()) if len(count) else 0, 4 * width)
        if not most:
            return
        offered = np.full((len(touched), most), -1, np.int32)
        place = np.arange(len(target)) - np.repeat(first, count)
        row = np.repeat(np.arange(len(touched)), count)
        offered[row[place < most], place[place < most]] = source[place < most]
        ids = np.concatenate([links[touched], offered], axis=1)
        for lo in range(0, len(touched), BATCH):
            part, at = ids[lo : lo + BATCH], touched[lo : lo + BATCH]
            part = np.sort(part, axis=1)
            part[:, 1:][part[:, 1:] == part[:, :-1]] = -1
            cosines = np.where(part >= 0, np.einsum("md,mkd->mk", own[at], own[part]), -2)
            order = np.argsort(-cosines, axis=1, kind="stable")[:, :BUILD_BEAM]
            links[at] = _diverse(own, at, np.take_along_axis(part, order, 1), np.take_along_axis(cosines, order, 1), width)

    def _descend(self, queries: np.ndarray, below: np.ndarray | None = None) -> np.ndarray:
        """Place in the layer below (by default the ground) of the nearest node on the lowest finished layer."""
        if not self.layers:
            return np.zeros((len(queries), 1), np.int64)
        place = np.zeros((len(queries), 1), np.int64)
        for depth in range(len(self.layers) - 1, -1 if below is not None else 0, -1):
            nodes, links = self.layers[depth]
            ids, _ = _walk(self.unit[nodes], links, queries, place, 8)
            under = below if depth == 0 else self.layers[depth - 1][0]
            position = np.full(len(self.unit), 0, np.int64)
            position[under] = np.arange(len(under))
            place = position[nodes[ids[:, :2]]] if ids.shape[1] > 1 else position[nodes[ids[:, :1]]]
        return place

    def search(self, queries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """Nodes and cosines of the beam of every query, the best first; -1 where the beam is not full."""
        nodes, links = self.layers[0]
        ids, cosines = _walk(self.unit[nodes], links, queries, self._descend(queries), beam)
        return np.where(ids >= 0, nodes[ids], -1), cosines


def _diverse(own: np.ndarray, at: np.ndarray, ids: np.ndarray, cosines: np.ndarray, width: int) -> np.ndarray:
    """Of sorted candidates those nearer to the node than to any chosen before; then the best of the rest."""
    chosen = np.zeros(ids.shape, bool)
    valid = (ids >= 0) & (cosines > -1.5) & (ids != at[:, None])
    closest = np.full(ids.shape, -2.0, np.float32)
    vectors = own[ids]
    among = vectors @ vectors.transpose(0, 2, 1)
    room = np.full(len(ids), width)
    for j in range(ids.shape[1]):
        take = np.flatnonzero(valid[:, j] & (cosines[:, j] > closest[:, j]) & (room > 0))
        if len(take):
            chosen[take, j] = True
            room[take] -= 1
            closest[take] = np.maximum(closest[take], among[take, j])
    rank = np.where(chosen, 0, np.where(valid, 1, 2))
    order = np.argsort(rank, axis=1, kind="stable")[:, :width]
    out = np.full((len(ids), width), -1, np.int32)
    picked = np.take_along_axis(ids, order, 1)
    out[:, : picked.shape[1]] = np.where(np.take_along_axis(rank, order, 1) < 2, picked, -1)
    return out


def _walk(own: np.ndarray, links: np.ndarray, queries: np.ndarray, start: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """Best-first walks of all queries through one layer, with a beam of the best nodes met."""
    beam = min(beam, len(own))
    step = max(1, beam // STEP)
    out_ids, out_cosines = np.full((len(queries), beam), -1, np.int64), np.full((len(queries), beam), -2.0, np.float32)
    for lo in range(0, len(queries), BATCH):
        q, first = queries[lo : lo + BATCH], np.sort(start[lo : lo + BATCH], axis=1)
        rows = np.arange(len(q))[:, None]
        seen = np.zeros((len(q), len(own) + 1), bool)  # the last column takes the missing links
        seen[:, -1] = True
        fresh = np.concatenate([np.ones((len(q), 1), bool), first[:, 1:] != first[:, :-1]], axis=1)
        ids = np.full((len(q), beam), -1, np.int64)
        cosines = np.full((len(q), beam), -2.0, np.float32)
        open_ = np.zeros((len(q), beam), bool)
        width = min(beam, first.shape[1])
        ids[:, :width] = np.where(fresh, first, -1)[:, :width]
        cosines[:, :width] = np.where(fresh, np.einsum("md,mkd->mk", q, own[first]), -2)[:, :width]
        open_[:, :width] = fresh[:, :width]
        seen[rows, first] = True
        while open_.any():
            score = np.where(open_, cosines, -3)
            best = np.argpartition(-score, step - 1, axis=1)[:, :step]
            expand = np.take_along_axis(open_, best, 1)
            np.put_along_axis(open_, best, False, 1)
            nodes = np.where(expand, np.take_along_axis(ids, best, 1), -1)
            near = np.where(nodes[:, :, None] >= 0, links[nodes], -1).reshape(len(q), -1)
            near = np.sort(near, axis=1)
            twice = np.concatenate([np.zeros((len(q), 1), bool), near[:, 1:] == near[:, :-1]], axis=1)
            new = ~seen[rows, near] & ~twice
            keep = np.nonzero(new.any(axis=0))[0]
            if not len(keep):
                continue
            most = int(new.sum(axis=1).max())
            order = np.argsort(~new, axis=1, kind="stable")[:, :most]
            near, new = np.take_along_axis(near, order, 1), np.take_along_axis(new, order, 1)
            seen[rows, near] = True
            got = np.where(new, np.einsum("md,mkd->mk", q, own[near]), -2).astype(np.float32)
            ids, cosines = np.concatenate([ids, np.where(new, near, -1)], axis=1), np.concatenate([cosines, got], axis=1)
            open_ = np.concatenate([open_, new], axis=1)
            order = np.argpartition(-cosines, beam - 1, axis=1)[:, :beam]
            ids, cosines, open_ = (np.take_along_axis(x, order, 1) for x in (ids, cosines, open_))
        order = np.argsort(-cosines, axis=1, kind="stable")
        out_ids[lo : lo + BATCH], out_cosines[lo : lo + BATCH] = np.take_along_axis(ids, order, 1), np.take_along_axis(cosines, order, 1)
    return out_ids, out_cosines


def _unit(vectors: np.ndarray) -> np.ndarray:
    exact = vectors.astype(float)
    exact /= np.abs(exact).max(axis=1, keepdims=True)
    return exact / np.sqrt((exact**2).sum(axis=1, keepdims=True))


def audit(graph: Graph, exact: np.ndarray, queries: np.ndarray, recall: float = RECALL) -> tuple[int, float]:
    """The beam at which walks meet enough of the nearest nodes, and the share they meet.

    ``exact`` and ``queries`` are unit vectors in double precision. A query always has nearest nodes, so the audit
    does not depend on how many links there are.
    """
    chosen = np.unique(np.linspace(0, len(queries) - 1, min(AUDIT, len(queries))).astype(int))
    most = min(NEAREST, len(exact))
    best = -np.sort(-(queries[chosen] @ exact.T), axis=1)[:, :most]
    beam, met = BEAM, 0.0
    while beam < len(exact):
        cosines = graph.search(queries[chosen].astype(np.float32), beam)[1][:, :most]
        met = float((cosines >= best - SINGLE).mean())
        if met >= recall:
            return beam, met
        beam *= 2
    return len(exact), 1.0


def candidates(graph: Graph, exact: np.ndarray, queries: np.ndarray, beam: int, least: float = LEAST) -> np.ndarray:
    """Table of queries x nodes: links among the nodes of every query's beam."""
    hits = np.zeros((len(queries), len(exact)), bool)
    for lo in range(0, len(queries), BATCH):
        part = queries[lo : lo + BATCH]
        if beam >= len(exact):  # the beam holds every node
            hits[lo : lo + BATCH] = part @ exact.T >= least
            continue
        ids, cosines = graph.search(part.astype(np.float32), beam)
        row, place = np.nonzero((ids >= 0) & (cosines >= least - SINGLE))
        node = ids[row, place]
        hits[row + lo, node] = np.einsum("ij,ij->i", part[row], exact[node]) >= least
    return hits


def complete(hits: np.ndarray, queries: np.ndarray, exact: np.ndarray, least: float = LEAST) -> np.ndarray:
    """Adds the links that full beams had no place for: cosines of all queries and nodes of one component."""
    row, node = np.nonzero(hits)
    root = roots_of(sum(hits.shape), row, node + len(queries))
    left, right = root[: len(queries)], root[len(queries) :]
    by_left, by_right = np.argsort(left, kind="stable"), np.argsort(right, kind="stable")
    for r in np.unique(left[row]).tolist():
        q = by_left[slice(*np.searchsorted(left[by_left], [r, r + 1]))]
        n = by_right[slice(*np.searchsorted(right[by_right], [r, r + 1]))]
        if len(q) > 1 and len(n) > 1:
            for lo in range(0, len(q), BATCH):
                part = q[lo : lo + BATCH]
                hits[part[:, None], n] = queries[part] @ exact[n].T >= least
    return hits


def joint_links(left: tuple[Graph, np.ndarray], right: tuple[Graph, np.ndarray] | None, least: float = LEAST) -> tuple[np.ndarray, int, float]:
    """Links of two shards, or of one with itself, searched from both sides; the widest beam and the least recall."""
    to = right or left
    beam, recall = audit(*to, left[1])
    hits = candidates(*to, left[1], beam, least)
    if right is None:
        hits |= hits.T
    else:
        back, met = audit(*left, right[1])
        hits |= candidates(*left, right[1], back, least).T
        beam, recall = max(beam, back), min(recall, met)
    return complete(hits, left[1], to[1], least), beam, recall


def _index(rows: pd.DataFrame) -> pd.DataFrame:
    """One shard with its graph as a row."""
    rows = rows.sort_values("rid")
    vectors = np.stack([np.asarray(v, np.float64) for v in rows["embedding"]])
    graph = Graph.build(_unit(vectors).astype(np.float32), rows["rid"].to_numpy())
    layers = [(n.astype("<i4").tobytes(), k.astype("<i4").tobytes()) for n, k in graph.layers]
    return pd.DataFrame({
        "label": [rows["label"].iloc[0]], "dim": [vectors.shape[1]], "shard": [rows["shard"].iloc[0]],
        "ids": [rows["rid"].to_numpy().astype("<i8").tobytes()], "copies": [rows["copies"].to_numpy().astype("<i8").tobytes()],
        "vectors": [vectors.astype("<f8").tobytes()], "nodes": [[n for n, _ in layers]], "links": [[k for _, k in layers]],
    })


def _load(row) -> tuple[np.ndarray, np.ndarray, np.ndarray, Graph]:
    ids, copies = np.frombuffer(row["ids"], "<i8"), np.frombuffer(row["copies"], "<i8")
    exact = _unit(np.frombuffer(row["vectors"], "<f8").reshape(len(ids), -1))
    layers = [(np.frombuffer(n, "<i4"), np.frombuffer(k, "<i4")) for n, k in zip(row["nodes"], row["links"])]
    return ids, copies, exact, Graph(exact.astype(np.float32), [(n, k.reshape(len(n), -1)) for n, k in layers])


def _search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Links of each pair of shards: per vector their number and the least vector it is joined with.

    A row without a vector tells how a pair was searched.
    """
    for batch in batches:
        for row in batch.to_dict("records"):
            ids, copies, exact, graph = _load(row["left"])
            own = row["left"]["shard"] == row["right"]["shard"]
            to_ids, to_copies, to_exact, to_graph = _load(row["right"])
            hits, beam, recall = joint_links((graph, exact), None if own else (to_graph, to_exact))
            if own:
                np.fill_diagonal(hits, False)
            nodes, shift = (ids, 0) if own else (np.concatenate([ids, to_ids]), len(ids))
            links = np.zeros(len(nodes), np.int64)
            root = np.arange(len(nodes))
            order = np.argsort(nodes, kind="stable")  # roots are the least ids
            rank = np.empty(len(nodes), np.int64)
            rank[order] = np.arange(len(nodes))
            for lo in range(0, len(ids), BATCH):
                a, b = np.nonzero(hits[lo : lo + BATCH])
                np.add.at(links, a + lo, to_copies[b])
                if not own:
                    np.add.at(links, b + shift, copies[a + lo])
                known = np.nonzero(root != np.arange(len(nodes)))[0]
                root = roots_of(len(nodes), np.concatenate([known, rank[a + lo]]), np.concatenate([root[known], rank[b + shift]]))
            some = np.nonzero(links)[0]
            pair = {"label": row["label"], "dim": row["dim"], "a": row["left"]["shard"], "b": row["right"]["shard"]}
            told = pd.DataFrame([{**pair, "beam": beam, "recall": recall}])
            out = pd.DataFrame({"rid": nodes[some], "links": links[some], "root": nodes[order][root[rank[some]]]}).assign(**pair)
            yield pd.concat([told, out]).astype({"rid": "Int64", "links": "Int64", "root": "Int64", "beam": "Int64"})


def embedding_groups(vectors: DataFrame, shard: int = SHARD) -> DataFrame:
    """``vec_id, n_links, component_id, kept, recall`` for every row.

    Only vectors with equal labels that are not null are compared, and of equal length. Vectors that are null,
    zero or hold null or non-finite components link with nothing, nor do rows without an id, whose component is
    null. Rows repeated under an id are one vector. ``recall`` is the least that the audits of the vector's label
    met, null where nothing was searched. An empty table gives an empty result.
    """
    rows = vectors.select("vec_id", "label", F.col("embedding").cast("array<double>").alias("embedding"))
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable = finite & F.exists("embedding", lambda x: x != 0) & F.col("label").isNotNull() & F.col("vec_id").isNotNull()
    # sign of zero does not tell vectors apart
    good = rows.filter(usable).withColumn("embedding", F.transform("embedding", lambda x: x + F.lit(0.0)))
    spelled = F.unhex(F.sha2(F.array_join(F.col("embedding").cast("array<string>"), ","), 256))
    good = good.withColumn("digest", spelled).dropDuplicates(["vec_id", "label", "digest"])
    copies = good.groupBy("label", "digest").agg(
        F.min("vec_id").alias("rid"), F.count("*").alias("copies"), F.any_value("embedding").alias("embedding")
    )
    copies = cut_lineage(copies.withColumn("dim", F.size("embedding")))
    held = F.greatest(F.lit(1), F.least(F.lit(shard), F.lit(SHARD_BYTES) / (8 * F.col("dim"))))
    sizes = copies.groupBy("label", "dim").agg(F.count("*").alias("n")).select("label", "dim", F.ceil(F.col("n") / held).cast("int").alias("shards"))
    dealt = copies.join(F.broadcast(sizes), ["label", "dim"]).withColumn("shard", F.pmod(F.xxhash64("rid"), F.col("shards").cast("long")).cast("int"))
    kind = "ids binary, copies binary, vectors binary, nodes array<binary>, links array<binary>"
    label = dict(copies.dtypes)["label"]
    index = cut_lineage(
        dealt.select("label", "dim", "shard", "rid", "copies", "embedding")
        .groupBy("label", "dim", "shard").applyInPandas(_index, f"label {label}, dim int, shard int, {kind}")
    )
    names = index.select("label", "dim", "shard")
    pairs = names.withColumnRenamed("shard", "a").join(names.withColumnRenamed("shard", "b"), ["label", "dim"]).filter("a <= b")
    side = F.struct("shard", "ids", "copies", "vectors", "nodes", "links")
    left = index.select("label", "dim", F.col("shard").alias("a"), side.alias("left"))
    right = index.select("label", "dim", F.col("shard").alias("b"), side.alias("right"))
    key = ["label", "dim", "a", "b"]
    tasks = pairs.repartition(partitions(vectors), *key).join(right, ["label", "dim", "b"]).join(left, ["label", "dim", "a"])
    spread = tasks.repartition(partitions(vectors), *key).select("label", "dim", "left", "right")
    told = f"label {label}, dim int, a int, b int, rid long, links long, root long, beam long, recall double"
    searched = cut_lineage(spread.mapInPandas(_search, told))
    recalls = searched.filter("rid is null").groupBy("label", "dim").agg(F.min("recall").alias("recall"))
    found = searched.filter("rid is not null").select("rid", "links", "root")

    joined = components(found.select(F.col("rid").alias("u"), F.col("root").alias("v")).filter("u <> v"))
    roots = joined.select(F.col("node").alias("rid"), "component")
    counts = found.groupBy("rid").agg(F.sum("links").alias("links"))
    classes = copies.join(counts, "rid", "left").join(roots, "rid", "left").join(recalls, ["label", "dim"]).select(
        "label", "digest", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
        F.coalesce("component", "rid").alias("component_id"), "recall",
    )
    members = good.select("vec_id", "label", "digest").join(classes, ["label", "digest"]).select("vec_id", "n_links", "component_id", "recall")
    # an id given to several vectors is counted and named with all of them
    named = members.groupBy("vec_id").agg(
        F.max("n_links").alias("n_links"), F.min("component_id").alias("component_id"), F.min("recall").alias("recall")
    )
    out = rows.select("vec_id").join(named, "vec_id", "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"), "recall",
    )
