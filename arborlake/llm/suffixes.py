"""Removal of long repeats between and within documents, by suffix arrays.

A byte goes if it lies in a string of 100 bytes that also starts earlier in the corpus. Every such string is
named by the smallest hash among the 32-byte grams inside it, the leftmost if several are equal. Strings that
follow each other mostly share their gram, so a document falls into spans, each with one gram, and equal strings
always have equal grams: spans of one gram are all that has to meet.

1. Equal spans of a gram are copies. A task settles those it sees itself, a sorted pass over the shuffled spans
   settles the rest: the first stays, all strings of the others are repeats.
2. A gram that is left with one span has no further repeat. The spans of the others go, with their text, to shards
   of bounded size that keep a gram together. A shard builds its suffix array in two stages: only suffixes
   smaller than their successor are sorted directly, the rest are induced by a scan through the buckets of the
   first byte. Adjacent common prefixes of 100 bytes are the repeats; the first of each run stays.
3. A gram with too many different spans is dealt out over several shards. Strings that are first in their shard
   then meet by a hash of all their bytes, one from each shard, and the first of those stays.

Long texts are read in slices that overlap by one string, so memory does not grow with a document's length.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

from arborlake.llm.common import Rolling, mix, partitions, runs_of, slices
from arborlake.session import cut_lineage

LENGTH = 100
GRAM = 32
SLICE = 1 << 20  # bytes of one text worked on at once
CHUNK = 1 << 18  # bytes of short texts worked on at once
HELD = 1 << 19  # spans that a task compares with each other
SHARD = 4096  # spans of one suffix array, about
SAMPLED = 64  # one document in so many tells which grams are hot
SEPARATOR = 0xFF  # no UTF-8 text has this byte

SPANS = "gram long, print long, doc long, low int, high int, copy boolean"
RUNS = "doc long, low int, high int, gram long"


def utf8(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def anchors(hashes: np.ndarray, spread: int) -> np.ndarray:
    """For each position the leftmost smallest hash among the ``spread`` from there on."""
    value = (hashes >> np.uint64(32)).astype(np.uint32)
    index = np.arange(len(value), dtype=np.int32)
    width = 1
    while width < spread:
        step = min(width, spread - width)
        right = value[step:]
        left = value[:-step]
        closer = right < left
        index = np.where(closer, index[step:], index[:-step])
        value = np.where(closer, right, left)
        width += step
    return index


def spans(parts: list[bytes], length: int, gram: int, rolling: Rolling) -> tuple[np.ndarray, ...]:
    """Part, first and last string start, gram and print of every span of some texts or slices."""
    sizes = np.array([len(p) for p in parts])
    data = np.frombuffer(b"".join(parts), np.uint8)
    if len(data) < length:
        return (np.zeros(0, np.int64),) * 5
    sums = rolling.prefix(data)
    hashes = rolling.grams(sums, gram)
    anchor = anchors(hashes, length - gram + 1)
    ends = np.cumsum(sizes)
    part = np.repeat(np.arange(len(parts)), sizes)[: len(anchor)]
    start = np.nonzero(np.arange(len(anchor)) + length <= ends[part])[0]
    if not len(start):
        return (np.zeros(0, np.int64),) * 5
    own, of = anchor[start], part[start]
    new = np.concatenate([[True], (own[1:] != own[:-1]) | (of[1:] != of[:-1])])
    first = np.nonzero(new)[0]
    low, high = start[first], start[np.concatenate([first[1:] - 1, [len(start) - 1]])]
    base = (ends - sizes)[of[first]]
    return of[first], low - base, high - base, hashes[own[first]].view(np.int64), rolling.slices(sums, low, high + length).view(np.int64)


def _find_spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rolling, held, count = Rolling(), [], 0
    for batch in slices(batches):
        docs = batch.column(0).to_numpy()
        texts = [utf8(t.as_py()) for t in batch.column(1)]
        pieces, doc, shift = [], [], []
        for key, text in zip(docs.tolist(), texts):
            for at in range(0, max(1, len(text) - LENGTH + 1), SLICE):
                pieces.append(text[at : at + SLICE + LENGTH - 1])
                doc.append(key)
                shift.append(at)
        doc, shift = np.array(doc, np.int64), np.array(shift, np.int64)
        for lo, hi in runs_of([len(p) for p in pieces], CHUNK):
            of, low, high, gram, stamp = spans(pieces[lo:hi], LENGTH, GRAM, rolling)
            if len(of):
                held.append((gram, stamp, doc[lo:hi][of], low + shift[lo:hi][of], high + shift[lo:hi][of]))
                count += len(of)
            if count >= HELD:
                yield from _settle_own(held)
                held, count = [], 0
    if held:
        yield from _settle_own(held)


def _settle_own(held: list[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
    """The first of equal spans, to be compared with those of other tasks; the rest as runs of copies."""
    gram, stamp, doc, low, high = (np.concatenate(c) for c in zip(*held))
    order = np.lexsort((low, doc, stamp, gram))
    gram, stamp, doc, low, high = gram[order], stamp[order], doc[order], low[order], high[order]
    again = np.concatenate([[False], (gram[1:] == gram[:-1]) & (stamp[1:] == stamp[:-1])])
    # a row repeated under an id is not earlier than itself
    again[1:] &= (doc[1:] != doc[:-1]) | (low[1:] != low[:-1])
    yield _span_batch(gram[~again], stamp[~again], doc[~again], low[~again], high[~again], False)
    runs = joined(doc[again], low[again], high[again])
    yield _span_batch(mix(runs[0].astype(np.uint64)).view(np.int64), np.zeros(len(runs[0]), np.int64), *runs, True)


def _span_batch(gram, stamp, doc, low, high, copy: bool) -> pa.RecordBatch:
    columns = [pa.array(gram), pa.array(stamp), pa.array(doc), pa.array(low.astype(np.int32)), pa.array(high.astype(np.int32)), pa.array(np.full(len(gram), copy))]
    return pa.record_batch(columns, ["gram", "print", "doc", "low", "high", "copy"])


def joined(doc: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of string starts, those of a document that touch or overlap made one."""
    if not len(doc):
        return doc, low, high
    order = np.lexsort((low, doc))
    doc, low, high = doc[order], low[order], high[order]
    group = np.concatenate([[0], np.cumsum(doc[1:] != doc[:-1])]).astype(np.int64)
    reach = np.maximum.accumulate(high + (group << 40)) - (group << 40)
    new = np.concatenate([[True], (doc[1:] != doc[:-1]) | (low[1:] > reach[:-1] + 1)])
    first = np.nonzero(new)[0]
    return doc[first], low[first], reach[np.concatenate([first[1:] - 1, [len(doc) - 1]])]


def _settle_sorted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spans in order of gram, print and place: copies come out as runs, spans in doubt with their gram.

    Of a gram's spans only the last one read is held, so a gram of any size streams through. Spans of a hot gram have
    ``own`` set: others of it are elsewhere, so each is in doubt.
    """
    pending, in_doubt = None, False  # the last different span, and whether its gram had one before
    for batch in batches:
        gram, stamp, doc, low, high, copy = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(6))
        yield _run_batch(doc[copy], low[copy], high[copy], None)
        rows = [c[~copy] for c in (gram, stamp, doc, low, high, batch.column(6).is_valid().to_numpy(zero_copy_only=False))]
        if not len(rows[0]):
            continue
        if pending is not None:
            rows = [np.concatenate([[p], c]) for p, c in zip(pending, rows)]
        gram, stamp, doc, low, high, alone = rows
        same_gram = gram[1:] == gram[:-1]
        again = np.concatenate([[False], same_gram & (stamp[1:] == stamp[:-1])])
        # the same place twice is a repeated row, not a copy
        first_of = np.maximum.accumulate(np.where(again, 0, np.arange(len(gram))))
        elsewhere = again & ((doc != doc[first_of]) | (low != low[first_of]))
        yield _run_batch(doc[elsewhere], low[elsewhere], high[elsewhere], None)
        kinds = np.nonzero(~again)[0]
        beside = gram[kinds[1:]] == gram[kinds[:-1]]
        before = np.concatenate([[in_doubt and pending is not None], beside])
        doubt = before | alone[kinds].astype(bool)
        doubt[:-1] |= beside
        out = kinds[:-1][doubt[:-1]]
        yield _run_batch(doc[out], low[out], high[out], gram[out])
        last = kinds[-1]
        pending, in_doubt = [c[last] for c in rows], bool(before[-1] or alone[last])
    if pending is not None and in_doubt:
        yield _run_batch(*(np.array([x]) for x in pending[2:5]), np.array([pending[0]]))


def _run_batch(doc, low, high, gram: np.ndarray | None) -> pa.RecordBatch:
    named = pa.nulls(len(doc), pa.int64()) if gram is None else pa.array(gram)
    return pa.record_batch([pa.array(doc), pa.array(low.astype(np.int32)), pa.array(high.astype(np.int32)), named], ["doc", "low", "high", "gram"])


def eights(data: np.ndarray, spare: int) -> np.ndarray:
    """The eight bytes from each position as one number, zeros behind the end; ``spare`` more positions follow."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)]).astype(np.uint64)
    words = np.zeros(len(data) + spare, np.uint64)
    for i in range(8):
        words[: len(data)] |= padded[i : i + len(data)] << np.uint64(56 - 8 * i)
    return words


def suffix_order(data: np.ndarray, depth: int, words: np.ndarray | None = None) -> np.ndarray:
    """Suffixes of ``data`` in order of their first ``depth`` bytes, by two-stage sorting.

    Stage one sorts the suffixes that are smaller than their successors; stage two walks the buckets of the first
    byte upwards and puts, for each suffix met, the one before it behind what its own bucket has so far, if that
    one is larger than its successor. Suffixes alike in ``depth`` bytes stand together in any order.
    """
    n = len(data)
    if not n:
        return np.zeros(0, np.int64)
    words = eights(data, depth + 8) if words is None else words
    differs = np.concatenate([data[:-1] != data[1:], [True]])
    rises = np.concatenate([data[:-1] < data[1:], [False]])  # the last is larger than the empty suffix
    at = np.minimum.accumulate(np.where(differs, np.arange(n), n)[::-1])[::-1]
    smaller = rises[at]

    direct = np.nonzero(smaller)[0][::-1]  # stable sorts then put a suffix that ends before one that goes on with zeros
    direct = direct[np.argsort(words[direct], kind="stable")]
    key = words[direct]
    new = np.concatenate([[True], key[1:] != key[:-1]])[: len(direct)]
    for offset in range(8, depth, 8):
        group = np.cumsum(new)
        alone = new & np.concatenate([new[1:], [True]])[: len(new)]
        tied = np.nonzero(~alone)[0]
        if not len(tied):
            break
        key = words[direct[tied] + offset]
        order = np.lexsort((key, group[tied]))
        direct[tied], key, of = direct[tied][order], key[order], group[tied]
        new[tied[1:]] |= (key[1:] != key[:-1]) & (of[1:] == of[:-1])

    bounds = np.searchsorted(data[direct], np.arange(257))
    waiting: list[list[np.ndarray]] = [[] for _ in range(256)]
    result = []

    def induce(found: np.ndarray, byte: int) -> np.ndarray:
        """Deals out the suffixes before these; returns those that fall into the bucket being walked."""
        before = found[found > 0] - 1
        before = before[~smaller[before]]
        first = data[before]
        order = np.argsort(first, kind="stable")
        before, first = before[order], first[order]
        edges = np.concatenate([[0], np.nonzero(first[1:] != first[:-1])[0] + 1, [len(first)]]) if len(first) else [0]
        stay = before[:0]
        for lo, hi in zip(edges[:-1], edges[1:]):
            if first[lo] == byte:
                stay = before[lo:hi]
            else:
                waiting[first[lo]].append(before[lo:hi])
        return stay

    waiting[data[-1]].append(np.array([n - 1]))
    for byte in range(256):
        wave = np.concatenate(waiting[byte]) if waiting[byte] else direct[:0]
        while len(wave):
            result.append(wave)
            wave = induce(wave, byte)
        own = direct[bounds[byte] : bounds[byte + 1]]
        if len(own):
            result.append(own)
            induce(own, byte)
    return np.concatenate(result)


def common_prefix(words: np.ndarray, a: np.ndarray, b: np.ndarray, length: int) -> np.ndarray:
    """Whether the suffixes at ``a`` and ``b`` have their first ``length`` bytes in common."""
    equal = np.ones(len(a), bool)
    for offset in [*range(0, length - 7, 8), length - 8]:
        open_ = np.nonzero(equal)[0]
        equal[open_] = words[a[open_] + offset] == words[b[open_] + offset]
    return equal


def repeats(texts: list[bytes], length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Strings of ``length`` bytes inside the texts: place of each, whether an earlier one is equal, the joined bytes.

    Places are positions in the texts put behind one another with a separator; earlier means smaller.
    """
    data = np.frombuffer(bytes([SEPARATOR]).join(texts) + bytes([SEPARATOR]), np.uint8)
    sizes = np.array([len(t) + 1 for t in texts])
    end = np.repeat(np.cumsum(sizes) - 1, sizes)
    inside = np.arange(len(data)) + length <= end
    words = eights(data, length + 8)
    order = suffix_order(data, length, words)
    order = order[inside[order]]
    if not len(order):
        return order, inside[:0], data
    new = np.concatenate([[True], ~common_prefix(words, order[1:], order[:-1], length)])
    first = np.minimum.reduceat(order, np.nonzero(new)[0])[np.cumsum(new) - 1]
    return order, order != first, data


def _shard(rows: pd.DataFrame) -> pd.DataFrame:
    """Repeats of one shard as runs; of a gram that is dealt out also its first strings, with their hash."""
    # a row repeated under an id is not earlier than itself
    rows = rows.drop_duplicates(["doc", "low", "text"]).sort_values(["doc", "low"])
    texts, doc, low = rows["text"].tolist(), rows["doc"].to_numpy(), rows["low"].to_numpy(np.int64)
    begins = np.cumsum([0] + [len(t) + 1 for t in texts])
    place, later, data = repeats(texts)

    def at(where: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        of = np.searchsorted(begins, where, side="right") - 1
        return doc[of], low[of] + where - begins[of]

    gone_doc, gone = at(place[later])
    run_doc, first, last = joined(gone_doc, gone, gone)
    none = np.zeros(len(run_doc), np.int64)
    out = pd.DataFrame({"doc": run_doc, "low": first, "high": last, "one": none, "two": none, "first": False})
    if rows["dealt"].iloc[0]:
        stay = place[~later]
        rolling = Rolling()
        one = rolling.slices(rolling.prefix(data), stay, stay + LENGTH)
        half = rolling.slices(rolling.prefix(data[::-1]), len(data) - stay - LENGTH, len(data) - stay)
        stay_doc, start = at(stay)
        out = pd.concat([out, pd.DataFrame({"doc": stay_doc, "low": start, "high": start, "one": one.view(np.int64), "two": half.view(np.int64), "first": True})])
    return out


def _cut_spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        doc, texts, runs = (batch.column(i).to_pylist() for i in range(3))
        rows = [
            (d, r["gram"], r["low"], r["blocks"], utf8_text[r["low"] : r["high"] + LENGTH])
            for d, t, own in zip(doc, texts, runs) for utf8_text in [utf8(t)] for r in own
        ]
        columns = list(zip(*rows)) or [()] * 5
        types = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary())
        yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, types)], ["doc", "gram", "low", "blocks", "text"])


def _keyed(documents: DataFrame) -> DataFrame:
    """The documents and, in ``_doc``, a key in the order of their ids: equal texts under an id share it.

    Rows without an id come first, each with a key of its own, in the order of hashed texts. Of different texts under
    an id the one of the smallest hash has the id as its key; the others come after all ids. Keys that are made up
    are written, so that a later read or a retry finds the same.
    """
    texts = documents.filter("doc_id is not null").withColumn("_hash", F.xxhash64("text"))
    several = cut_lineage(
        texts.groupBy(F.col("doc_id").alias("_id")).agg(F.min("_hash").alias("_least"), F.max("_hash").alias("_most"))
        .filter("_least <> _most").select("_id", "_least")
    )
    known = texts.join(several, F.col("doc_id") == F.col("_id"), "left")
    other = F.col("_hash") != F.coalesce("_least", "_hash")
    named = known.filter(~other).withColumn("_doc", F.col("doc_id").cast("long")).select(*documents.columns, "_doc")
    made = F.monotonically_increasing_id()
    again = known.filter(other).select("doc_id", "_hash").distinct().orderBy("doc_id", "_hash").withColumn("_doc", F.lit(1 << 62) + made)
    again = cut_lineage(again.withColumnsRenamed({"doc_id": "_id2", "_hash": "_hash2"}))
    rest = known.filter(other).join(again, (F.col("doc_id") == F.col("_id2")) & (F.col("_hash") == F.col("_hash2")))
    ordered = documents.filter("doc_id is null").orderBy(F.xxhash64("text"), F.monotonically_increasing_id())
    unnamed = cut_lineage(ordered.withColumn("_doc", F.lit(-(1 << 63)) + made))
    return named.unionByName(rest.select(*documents.columns, "_doc")).unionByName(unnamed)


def _hot_grams(texts: DataFrame, parts: int) -> DataFrame:
    """``gram, hot``: grams that would fill a large part of one of so many tasks, by a sample of the documents.

    There are at most ``8 * parts`` of them. They only decide where spans meet, not what is found.
    """
    some = texts.filter(F.pmod(F.xxhash64("doc"), F.lit(SAMPLED)) == 0).mapInArrow(_find_spans, SPANS).filter("not copy")
    sizes = cut_lineage(some.groupBy("gram").agg(F.count("*").alias("n")).filter("n > 1"))
    total = sizes.agg(F.sum("n")).first()[0] or 0
    return sizes.filter(F.col("n") * 8 * parts > total).select("gram", F.lit(True).alias("hot"))


def repeated_runs(documents: DataFrame) -> DataFrame:
    """``doc, low, high``: runs of starts of 100-byte strings that also start earlier; documents as keyed before."""
    texts = documents.select(F.col("_doc").alias("doc"), "text").filter(F.octet_length("text") >= LENGTH)
    parts = partitions(documents)
    hot = _hot_grams(texts, parts)
    found = texts.mapInArrow(_find_spans, SPANS).join(F.broadcast(hot), "gram", "left")
    # spans of a hot gram meet by their print only, and are all in doubt
    found = found.withColumn("own", F.when(F.col("hot"), F.col("print")))
    ordered = found.drop("hot").repartition(parts, "gram", "own").sortWithinPartitions("gram", "print", "doc", "low")
    settled = cut_lineage(ordered.mapInArrow(_settle_sorted, RUNS))
    copies = settled.filter("gram is null").select("doc", "low", "high")
    doubt = settled.filter("gram is not null")

    sizes = doubt.groupBy("gram").agg(F.count("*").alias("n"))
    total = doubt.count()
    # the blocks of a gram join its narrow rows, before any text does
    many = cut_lineage(sizes.filter(F.col("n") > SHARD).select("gram", F.ceil(F.col("n") / SHARD).cast("int").alias("blocks")))
    doubt = doubt.join(many, "gram", "left")
    by_doc = doubt.groupBy("doc").agg(F.collect_set(F.struct("gram", "low", "high", "blocks")).alias("runs"))
    placed = texts.join(by_doc, "doc").select("doc", "text", "runs").mapInArrow(_cut_spans, "doc long, gram long, low int, blocks int, text binary")
    shards = max(1, -(-total // SHARD))
    placed = placed.withColumn("dealt", F.col("blocks").isNotNull())
    shard = F.when(F.col("dealt"), F.pmod(F.xxhash64("doc", "low"), F.col("blocks").cast("long"))).otherwise(F.pmod(F.xxhash64("gram"), F.lit(shards)))
    keyed = placed.select("doc", "low", "text", "dealt", F.when(F.col("dealt"), F.col("gram")).alias("own"), shard.alias("shard"))
    sorted_out = cut_lineage(keyed.groupBy("own", "shard").applyInPandas(_shard, "doc long, low int, high int, one long, two long, first boolean"))
    within = sorted_out.filter("not first").select("doc", "low", "high")
    order = Window.partitionBy("one", "two").orderBy("doc", "low")
    across = sorted_out.filter("first").withColumn("place", F.rank().over(order)).filter("place > 1").select("doc", "low", "high")
    return copies.unionByName(within).unionByName(across)


def covered(runs: list, size: int) -> list[tuple[int, int]]:
    """Maximal byte ranges that the strings starting in the runs cover."""
    out: list[list[int]] = []
    for low, high in sorted((r["low"], r["high"]) for r in runs):
        stop = min(high + LENGTH, size)
        if out and low <= out[-1][1]:
            out[-1][1] = max(out[-1][1], stop)
        elif low < size:
            out.append([low, stop])
    return [(a, b) for a, b in out]


def kept_bytes(text: str | None, runs: list | None) -> tuple[bytes, list[tuple[int, int]]]:
    raw = utf8(text)
    gone = covered(list(runs) if runs is not None else [], len(raw))
    edges = [0, *(x for pair in gone for x in pair), len(raw)]
    return b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2])), gone


def _with_runs(documents: DataFrame) -> DataFrame:
    """The documents and, in ``_runs``, what of them repeats."""
    keyed = _keyed(documents)
    runs = repeated_runs(keyed).groupBy(F.col("doc").alias("_doc")).agg(F.collect_list(F.struct("low", "high")).alias("_runs"))
    return keyed.join(runs, "_doc", "left").drop("_doc")


def repeat_digests(documents: DataFrame) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` for every row.

    Null texts are empty; texts below 100 bytes lose nothing. Equal rows under an id are one document and get equal
    results; different texts under an id are documents of their own (see ``_keyed``), as are rows without an id. An
    empty table gives an empty result.
    """

    @pandas_udf("n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    def digest(text: pd.Series, runs: pd.Series) -> pd.DataFrame:
        rows = []
        for t, r in zip(text, runs):
            kept, gone = kept_bytes(t, r)
            lost = sum(b - a for a, b in gone)
            rows.append((len(kept) + lost, lost, len(gone), hashlib.sha256(kept).hexdigest()))
        return pd.DataFrame(rows, columns=["n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return _with_runs(documents.select("doc_id", "text")).select("doc_id", digest("text", "_runs").alias("d")).select("doc_id", "d.*")


def without_repeats(documents: DataFrame) -> DataFrame:
    """The documents with repeats cut out of ``text`` and ``n_chars`` brought up to date.

    A character that loses some of its bytes goes as a whole. Texts that lose nothing stay as they are.
    """

    @pandas_udf(StringType())
    def rest(text: pd.Series, runs: pd.Series) -> pd.Series:
        return pd.Series([t if r is None else kept_bytes(t, r)[0].decode("utf-8", "ignore") for t, r in zip(text, runs)], dtype=object)

    cut = _with_runs(documents)
    new = cut.withColumn("_new", F.when(F.col("_runs").isNull(), F.col("text")).otherwise(rest("text", "_runs")))
    size = F.when(F.col("_runs").isNull(), F.col("n_chars")).otherwise(F.length("_new").cast("long"))
    return new.withColumns({"n_chars": size, "text": F.col("_new")}).select(*documents.columns)
