"""Packing of tokenized documents into sequences of one window with little padding.

Documents are cut at multiples of the window only, so all that has to be arranged is the histogram of piece
lengths, which has at most as many entries as the window has tokens. Combinations of two and three lengths that
fill a window exactly are enumerated; non-negative least squares finds how often each should be repeated so that
together they use up the histogram; the counts are rounded down, and what is left over is packed greedily, the
longest first and each gap with the longest piece that fits. The plan is a list of patterns with repeat counts
and never larger than a few lengths' worth of rows, however many documents there are.

Every piece then finds its place by its rank among the pieces of its length. Ranks are counted in hashed buckets
whose sizes are added up, so a length that most pieces share is not ordered in one task.
"""

from __future__ import annotations

import os
import zlib
from bisect import bisect_right
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from arborlake.llm.common import kept, partitions
from arborlake.session import cut_lineage

WINDOW = 4096
VOCABULARY = "word_bpe_49k.json"
END = 2  # id behind every document
COMBINATIONS = 200_000  # combinations of three lengths that take part in the fit
CACHED_WORDS = 250_000
CACHED_PARTS = 500_000
MARKS = b".,;:!?*#$%&|()-"  # marks that never share a token with the letters before them

PIECES = "doc_id long, start long, length int, ids_crc32 long, doc_tokens long"


class WordEncoder:
    """Ids of a text as little-endian unsigned 32-bit numbers.

    White space never joins a token of this vocabulary, so a text's ids are those of its words one after the
    other; likewise a run of letters and the marks behind it share no token, and case does not count. Words and
    runs of letters seen before are looked up, each up to a fixed number.
    """

    def __init__(self, vocabulary: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import public_tokenizers
        import tokenizers

        self._tokenizer = tokenizers.Tokenizer.from_file(public_tokenizers.path(vocabulary))
        self._words: dict[bytes, bytes] = {}
        self._parts: dict[bytes, bytes] = {}

    def __call__(self, text: str) -> bytes:
        split = text.encode("utf-8", "replace").split()
        words = self._words
        new = {w: self._word(w) for w in set(split) if w not in words}
        if not new:
            return b"".join(map(words.__getitem__, split))
        if len(words) < CACHED_WORDS:
            words.update(new)
            return b"".join(map(words.__getitem__, split))
        return b"".join([new[w] if w in new else words[w] for w in split])

    def _word(self, word: bytes) -> bytes:
        stem = word.rstrip(MARKS)
        if len(stem) == len(word) or not stem:
            return self._part(word.lower() if word.isalpha() else word)  # bytes: ASCII letters only
        if stem.isalpha():
            return self._part(stem.lower()) + self._part(word[len(stem) :])
        return self._part(stem) + self._part(word[len(stem) :]) if stem.decode().isalpha() else self._part(word)

    def _part(self, part: bytes) -> bytes:
        ids = self._parts.get(part)
        if ids is None:
            ids = np.array(self._tokenizer.encode(part.decode(), add_special_tokens=False).ids, "<u4").tobytes()
            if len(self._parts) < CACHED_PARTS:
                self._parts[part] = ids
        return ids


def word_encoder(vocabulary: str) -> Callable[[str], bytes]:
    """The encoder of a vocabulary; a worker process keeps it from task to task."""
    return kept("word encoders", vocabulary, lambda: WordEncoder(vocabulary))


def _pieces(vocabulary: str, window: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = word_encoder(vocabulary)
        last = END.to_bytes(4, "little")
        for batch in batches:
            rows = []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = encode(text.as_py() or "") + last
                total = len(ids) // 4
                for start in range(0, total, window):
                    part = ids[4 * start : 4 * (start + window)]
                    rows.append((key, start, len(part) // 4, zlib.crc32(part), total))
            columns = list(zip(*rows)) or [()] * 5
            types = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64())
            yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, types)], ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return cut


def exact_fills(lengths: np.ndarray, counts: np.ndarray, window: int, most: int = COMBINATIONS) -> np.ndarray:
    """Two or three lengths each that add up to the window, as rows padded with zero.

    All pairs take part. Triples are taken from the most frequent lengths first until there are ``most``; the
    greedy step deals with whatever they leave.
    """
    present = np.zeros(window + 1, bool)
    present[lengths] = True
    pairs = lengths[(2 * lengths <= window) & present[window - lengths]]
    found = [np.stack([window - pairs, pairs, np.zeros_like(pairs)], axis=1)]
    frequent, have = lengths[np.argsort(-counts, kind="stable")], 0
    for i, a in enumerate(frequent.tolist()):
        b = frequent[: i + 1]  # each triple is met at its rarest member
        c = window - a - b
        rank = np.full(window + 1, len(lengths))
        rank[frequent] = np.arange(len(frequent))
        fits = (c > 0) & (c <= b)
        b, c = b[fits], c[fits]
        inside = present[c] & (rank[c] <= i)
        found.append(np.stack([np.full(inside.sum(), a), b[inside], c[inside]], axis=1))
        have += int(inside.sum())
        if have >= most:
            break
    return np.concatenate(found)


def repeat_counts(fills: np.ndarray, histogram: np.ndarray, rounds: int = 300) -> np.ndarray:
    """Non-negative repeat counts whose lengths come nearest to the histogram in the least-squares sense.

    Accelerated projected gradient; the lengths are weighed by their share so that frequent ones do not drown
    the rest.
    """
    weight = 1 / np.maximum(histogram, 1.0)
    weight[0] = 0
    x = np.zeros(len(fills))
    if not len(fills):
        return x
    use = np.bincount(fills.ravel(), minlength=len(histogram)).astype(float)
    use[0] = 0
    # a step for each combination: the row sums of the normal matrix bound its curvature
    step = 1 / np.maximum((weight * use)[fills].sum(axis=1) * 3, 1e-12)
    y, t = x.copy(), 1.0
    for _ in range(rounds):
        used = np.bincount(fills.ravel(), np.repeat(y, fills.shape[1]), minlength=len(histogram))
        slope = (weight * (used - histogram))[fills].sum(axis=1)
        new = np.maximum(0.0, y - step * slope)
        again = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y, x, t = new + (t - 1) / again * (new - x), new, again
    return x


@dataclass(frozen=True)
class Plan:
    """Places by length and rank: ``starts`` are sorted ``length << 40 | rank`` from which a slot holds."""

    starts: np.ndarray
    sequence: np.ndarray
    offset: np.ndarray
    sequences: int

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = length.astype(np.int64) << 40 | rank
        slot = np.searchsorted(self.starts, key, side="right") - 1
        return self.sequence[slot] + key - self.starts[slot], self.offset[slot]


def plan_sequences(histogram: dict[int, int], window: int = WINDOW) -> Plan:
    """The plan for so many pieces of each length; no sequence is longer than the window."""
    left = np.zeros(window + 1, np.int64)
    for length, count in histogram.items():
        left[length] = count
    patterns: list[tuple[tuple[int, ...], int]] = []

    def take(pattern: tuple[int, ...], times: int) -> None:
        if times > 0:
            patterns.append((pattern, times))
            for length in pattern:
                left[length] -= times

    take((window,), int(left[window]))
    lengths = np.nonzero(left)[0]
    fills = exact_fills(lengths, left[lengths], window)
    wanted = repeat_counts(fills, left.astype(float))
    for i in np.argsort(-wanted, kind="stable").tolist():
        times = int(wanted[i] + 1e-6)
        if not times:
            break
        pattern = tuple(int(x) for x in fills[i] if x)
        take(pattern, min(times, *(int(left[x]) // pattern.count(x) for x in pattern)))
    while True:
        open_ = np.nonzero(left)[0].tolist()
        if not open_:
            break
        pattern, room, free = [], window, dict(zip(open_, left[open_].tolist()))
        while (at := bisect_right(open_, room)) and room:
            length = open_[at - 1]
            fit = min(free[length], room // length)
            pattern += [length] * fit
            room, free[length] = room - fit * length, free[length] - fit
            if not free[length] or fit == 0:
                open_.pop(at - 1)
        take(tuple(pattern), min(int(left[x]) // pattern.count(x) for x in set(pattern)))
    used, rows, sequence = np.zeros(window + 1, np.int64), [], 0
    for pattern, times in patterns:
        offset = 0
        for length in pattern:
            rows.append((length << 40 | int(used[length]), sequence, offset))
            used[length] += times
            offset += length
        sequence += times
    rows.sort()
    table = np.array(rows, np.int64).reshape(-1, 3)
    return Plan(table[:, 0], table[:, 1], table[:, 2], sequence)


def pack(documents: DataFrame, window: int = WINDOW, vocabulary: str = VOCABULARY) -> DataFrame:
    """One row per piece: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset``.

    Every document's ids, an end id behind them, lie in exactly one piece each; null and empty texts are the end
    id alone. Rows repeated under an id are packed each on its own. An empty table gives an empty result.
    """
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    pieces = cut_lineage(texts.mapInArrow(_pieces(vocabulary, window), PIECES))
    plan = plan_sequences({r.length: r["count"] for r in pieces.groupBy("length").count().collect()}, window)
    bucket = F.pmod(F.xxhash64("doc_id", "start"), F.lit(max(16, partitions(documents)))).cast("int")
    dealt = pieces.withColumn("bucket", bucket)
    sizes = dealt.groupBy("length", "bucket").agg(F.count("*").alias("size"))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("length", "bucket", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("first"))
    inside = Window.partitionBy("length", "bucket").orderBy("doc_id", "start", "ids_crc32")
    ranked = dealt.withColumn("own", F.row_number().over(inside) - 1).join(starts, ["length", "bucket"])

    @pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        sequence, offset = plan.place(length.to_numpy(), rank.to_numpy())
        return pd.DataFrame({"sequence_id": sequence, "offset": offset})

    placed = ranked.withColumn("at", place("length", F.col("first") + F.col("own")))
    return placed.select("doc_id", "start", F.col("length").cast("long").alias("length"), "ids_crc32", "doc_tokens", "at.*")
