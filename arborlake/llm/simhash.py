"""Near-duplicate documents by 64-bit SimHash, found with vantage-point trees.

A document's words are the runs outside ASCII white space, with A-Z in lower case; its shingles are four
consecutive words. A fingerprint bit is one where more than half of the shingles' hashes have it.

Equal fingerprints are collapsed first. Two fingerprints within four bits differ in at most one bit on some
third of the bits, so there are three trees, one for each third. The levels of a tree split by the Hamming
distance to a vantage point on one block of the third. A fingerprint lives in the shard of its own rings and
also queries those shards beyond a ring boundary that the triangle bound cannot rule out: rings differ by one
in total, because the blocks are disjoint and share the single bit of the third. Within a shard a vantage
tree over all 64 bits prunes by the triangle bound, and what is left is compared exactly.

Trees deepen with the number of fingerprints, so shards keep their size. A shard that is still too large,
as around a very large group of near copies, is dealt out as pairs of blocks. No task lists the pairs of a
group for others: it joins what it found and passes on one link per member.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import LongType

from arborlake.llm.common import roots_of, runs_of
from arborlake.operators.graph import components
from arborlake.session import cut_lineage

RADIUS = 4
THIRDS = ((0, 22), (22, 21), (43, 21))  # first bit and width
SHARD = 512  # fingerprints that a shard should hold
BLOCK = 2048  # fingerprints of one side in one task
PIVOTS = 1024  # bound of the sample that vantage points are chosen from
WORDS = 4
SEED = 42

_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)


def simhash(texts: list[str | None], words: int = WORDS, chunk: int = 1 << 19) -> np.ndarray:
    """Fingerprints as unsigned 64-bit integers; null texts and texts without words give zero."""
    out = np.zeros(len(texts), np.uint64)
    digest = xxhash.xxh64_digest
    for lo, hi in runs_of([len(t or "") for t in texts], chunk):
        hashes, counts = [], []
        for t in texts[lo:hi]:
            parts = (t or "").encode("utf-8", "surrogatepass").lower().split()
            flat = b" ".join(parts)
            if len(parts) <= words:
                own = [digest(flat, SEED)] if parts else []
            else:
                ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
                starts = np.concatenate([[0], ends[:-1] + 1])
                own = [digest(flat[a:b], SEED) for a, b in zip(starts[: len(parts) - words + 1].tolist(), ends[words - 1 :].tolist())]
            hashes += own
            counts.append(len(own))
        if not hashes:
            continue
        octets = np.frombuffer(b"".join(hashes), np.uint8).reshape(-1, 8)
        place = np.repeat(np.arange(hi - lo) * 256, counts)
        most = np.array(counts)[:, None]
        bits = np.empty((hi - lo, 64), np.uint8)
        for j in range(8):
            seen = np.bincount(place + octets[:, j], minlength=(hi - lo) * 256).reshape(hi - lo, 256)
            bits[:, 8 * j : 8 * j + 8] = 2 * (seen @ _BITS) > most
        out[lo:hi] = np.packbits(bits, axis=1).view(">u8").ravel()
    return out


@pandas_udf(LongType())
def fingerprint(text: pd.Series) -> pd.Series:
    """SimHash of a text column, its 64 bits as a signed long."""
    return pd.Series(simhash(text.tolist()).view(np.int64))


def _rings(width: int, blocks: int) -> list[int]:
    return [width // blocks + (i < width % blocks) for i in range(blocks)]


def _depth(n: int) -> int:
    """Fewest levels whose rings cut ``n`` spread-out fingerprints into shards of the wanted size."""
    for blocks in range(1, THIRDS[1][1]):
        bits = 0.0
        for w in _rings(THIRDS[1][1], blocks):
            p = [math.comb(w, i) / 2**w for i in range(w + 1)]
            bits -= sum(x * math.log2(x) for x in p)
        if n / 2**bits <= SHARD:
            return blocks
    return THIRDS[1][1]


def _vantage(sample: np.ndarray, mask: int) -> int:
    """The sampled fingerprint from which the others' distances on the masked bits spread most."""
    near = sample & np.uint64(mask)
    distances = np.bitwise_count(near[:64, None] ^ near[None, :]).astype(float)
    return int(sample[int(distances.var(axis=1).argmax())])


def near_pairs(points: np.ndarray, queries: np.ndarray, radius: int = RADIUS, leaf: int = 48) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs (point, query) within ``radius`` bits, by a vantage-point tree over the points."""
    found_p, found_q = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    stack = [(np.arange(len(points)), np.arange(len(queries)))]
    while stack:
        p, q = stack.pop()
        if not len(p) or not len(q):
            continue
        if len(p) > leaf:
            vantage = points[p[len(p) // 2]]
            dp, dq = np.bitwise_count(points[p] ^ vantage), np.bitwise_count(queries[q] ^ vantage).astype(np.int64)
            cut = int(np.median(dp))
            inside = dp <= cut
            if not inside.all():
                stack += [(p[inside], q[dq <= cut + radius]), (p[~inside], q[dq > cut - radius])]
                continue
            if cut and (dp < cut).any():
                inside = dp < cut
                stack += [(p[inside], q[dq < cut + radius]), (p[~inside], q[dq >= cut - radius])]
                continue
        a, b = np.nonzero(np.bitwise_count(points[p][:, None] ^ queries[q][None, :]) <= radius)
        found_p.append(p[a])
        found_q.append(q[b])
    return np.concatenate(found_p), np.concatenate(found_q)


def _shard_links(rows: pd.DataFrame) -> pd.DataFrame:
    """Links of one shard (or pair of blocks of it): every member to the least of its component."""
    prints, side = rows["fp"].to_numpy(np.int64).view(np.uint64), rows["side"].to_numpy()
    left, right = np.nonzero(side != 1)[0], np.nonzero(side != 0)[0]
    p, q = near_pairs(prints[left], prints[right])
    root = roots_of(len(prints), left[p], right[q])
    moved = np.nonzero(root != np.arange(len(prints)))[0]
    return pd.DataFrame({"u": rows["fp"].to_numpy()[moved], "v": rows["fp"].to_numpy()[root[moved]]})


def fingerprint_links(distinct: DataFrame, key: str = "fp") -> DataFrame:
    """Links ``u, v`` that join all distinct fingerprints within four bits into the same components."""
    prints = distinct.select(F.col(key).alias("fp"))
    sample = prints.orderBy(F.xxhash64("fp")).limit(PIVOTS)
    n, picked = prints.count(), np.array([r.fp for r in sample.collect()], np.int64).view(np.uint64)
    if n < 2:
        return prints.select(F.col("fp").alias("u"), F.col("fp").alias("v")).limit(0)
    blocks = _depth(n)
    shards = []
    for tree, (start, width) in enumerate(THIRDS):
        cell, steps, scale = F.lit(0).cast("long"), [], 1
        for w in _rings(width, blocks):
            mask = ((1 << w) - 1) << start
            vantage = _vantage(picked, mask)
            signed = [x - (1 << 64) if x >= 1 << 63 else x for x in (vantage, mask)]
            ring = F.bit_count(F.col("fp").bitwiseXOR(F.lit(signed[0])).bitwiseAND(F.lit(signed[1])))
            cell = cell + ring.cast("long") * F.lit(scale)
            steps.append(scale)
            scale, start = scale * (w + 1), start + w
        # linked cells differ by one in one ring; the lower of the two asks the upper
        shards.append(F.struct(F.lit(tree).alias("tree"), cell.alias("cell"), F.lit(True).alias("home")))
        shards += [F.struct(F.lit(tree).alias("tree"), (cell + F.lit(s)).alias("cell"), F.lit(False).alias("home")) for s in steps]
    seated = prints.select("fp", F.explode(F.array(*shards)).alias("s")).select("fp", "s.*")
    sizes = (
        seated.groupBy("tree", "cell").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("parts"), F.max("home").alias("lived"))
        .filter("lived").drop("lived")
    )
    placed = seated.join(sizes, ["tree", "cell"]).withColumn("part", F.pmod(F.xxhash64("fp"), F.col("parts").cast("long")).cast("int"))
    # side 2 is compared with itself and is asked, 0 is only asked, 1 only asks
    every, part, parts = F.sequence(F.lit(0), F.col("parts") - 1), F.col("part"), F.col("parts")
    task = lambda a, b, side: F.struct(a.alias("a"), b.alias("b"), side.cast("int").alias("side"))
    among = F.transform(every, lambda o: task(F.least(o, part), F.greatest(o, part), F.when(o == part, 2).when(part < o, 0).otherwise(1)))
    asked = F.transform(every, lambda o: task(part, parts + o, F.lit(0)))
    asks = F.transform(every, lambda o: task(o, parts + part, F.lit(1)))
    one = F.array(task(F.lit(0), F.lit(0), F.when(F.col("home"), 2).otherwise(1)))
    tasks = F.when(parts == 1, one).when(F.col("home"), F.concat(among, asked)).otherwise(asks)
    dealt = placed.select("tree", "cell", "fp", F.explode(tasks).alias("x")).select("tree", "cell", "fp", "x.*")
    return dealt.groupBy("tree", "cell", "a", "b").applyInPandas(_shard_links, "u long, v long")


def _classes(prints: DataFrame) -> DataFrame:
    """``fp, root`` of every distinct fingerprint of rows ``fp``; written, so joins with it can split a hot value."""
    distinct = cut_lineage(prints.select("fp").distinct())
    links = components(fingerprint_links(distinct)).select(F.col("node").alias("fp"), F.col("component").alias("root"))
    return cut_lineage(distinct.join(links, "fp", "left").withColumn("root", F.coalesce("root", "fp")))


def simhash_groups(documents: DataFrame) -> DataFrame:
    """``doc_id, fp, fingerprint, component_id`` for every row: smallest doc_id among all it is linked to.

    Null and empty texts have fingerprint zero and link like any other. Rows repeated under an id stay
    repeated. An empty table gives an empty result. A null id keeps its row and never names a component
    unless all its members lack an id.
    """
    prints = cut_lineage(documents.select("doc_id", fingerprint("text").alias("fp")))
    classes = _classes(prints)
    first = cut_lineage(prints.groupBy("fp").agg(F.min("doc_id").alias("first")))
    rooted = classes.join(first, "fp")
    named = cut_lineage(rooted.groupBy("root").agg(F.min("first").alias("component_id")))
    by_print = cut_lineage(classes.join(named, "root").select("fp", "component_id"))
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return prints.join(by_print, "fp").select("doc_id", "fp", hexed.alias("fingerprint"), "component_id")


def keep_first_copies(documents: DataFrame) -> DataFrame:
    """One document of each group of near copies: that of the smallest id, of several texts under it the one of the
    smallest hash, once.

    A group whose rows have no id keeps one of them by the hash alone; rows without an id go where another has one.
    """
    prints = cut_lineage(documents.select("doc_id", F.xxhash64("text").alias("hash"), fingerprint("text").alias("fp")))
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "hash")).alias("least")
    by_print = cut_lineage(prints.groupBy("fp").agg(least))
    winners = _classes(prints).join(by_print, "fp").groupBy("root").agg(F.min("least").alias("least"))
    kept = cut_lineage(winners.select(F.col("least.doc_id").alias("_id"), F.col("least.hash").alias("_hash")))
    stamped = documents.withColumn("_own", F.xxhash64("text"))
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_own") == F.col("_hash"))
    return stamped.join(kept, same, "left_semi").dropDuplicates(["doc_id", "_own"]).select(*documents.columns)
