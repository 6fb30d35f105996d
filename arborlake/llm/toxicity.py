"""Toxicity by the nearest labelled examples under exact TF-IDF cosine.

Every word of the learning rows is in the index. Its weight is its inverse document frequency, counted over all
documents, raised for words whose presence goes with the label beyond chance. Examples are unit vectors in an
inverted index; examples with the same leading words stand together and are cut into blocks. For a query, the words
that few examples have are summed up first. For the others the index keeps the largest weight in every block: the
sum of a query's weights times these maxima, on top of the block's largest sum so far, bounds every cosine in the
block. The block of the highest bound sets the bar, and blocks whose bound stays below it are left out. The result
is exact: no example that ties with or beats the k-th is passed over.

Neighbours vote by their distance, so an equal text outvotes all chance likenesses. The scale from votes to
probabilities comes from the examples' own votes, each without itself. The nearest examples are returned as evidence.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from arborlake.llm.common import calibrate, held_out, learning_rows
from arborlake.session import cut_lineage

EXAMPLES = 3000  # bound of the labelled sample
NEIGHBOURS = 15
BLOCK = 128  # examples of one block
COMMON = 64  # examples from which on a word has block maxima
ASSOCIATION = 4.0  # likelihood ratio that doubles a word's weight
NEAREST = 0.02  # least distance of a vote
EVIDENCE = 3

_WORD = re.compile(r"[^\W\d_]+")


def words(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def association(seen: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Likelihood ratio of words being present against the label; ``seen``: words x labels, ``size``: rows by label."""
    cells = np.stack([seen, size - seen], axis=2)  # word, label, present or absent
    expected = cells.sum(axis=1, keepdims=True) * cells.sum(axis=2, keepdims=True) / max(1.0, size.sum())
    with np.errstate(divide="ignore", invalid="ignore"):
        return 2 * np.where(cells > 0, cells * np.log(cells / expected), 0).sum(axis=(1, 2))


@dataclass
class ToxicityIndex:
    """Block-max inverted index of labelled examples with calibrated votes."""

    weight: np.ndarray  # by word
    ids: np.ndarray  # example ids in block order
    labels: np.ndarray
    examples: np.ndarray  # postings by word, in block order: example and weight
    weights: np.ndarray
    starts: np.ndarray  # by word: where its postings begin
    common: np.ndarray  # by word: its row in the block tables, or -1
    most: np.ndarray  # common words x blocks: largest weight
    cuts: np.ndarray  # common words x blocks + 1: where the block's postings begin
    none: float  # probability where no example is near
    scale: tuple[float, float] = (1.0, 0.0)
    known: dict = field(default_factory=dict)

    @classmethod
    def build(cls, texts: list[str], labels: np.ndarray, ids: np.ndarray, total: int, place: dict[str, int], frequency: np.ndarray) -> ToxicityIndex:
        """``frequency``: documents of ``total`` that have a word; it counts at least as often as in the examples."""
        own = [counted(t, place) for t in texts]
        at = np.repeat(np.arange(len(own)), [len(w) for w, _ in own])
        where, times = (np.concatenate([np.zeros(0, np.int64), *(c[i] for c in own)]) for i in (0, 1))
        seen = np.stack([np.bincount(where[labels[at] == y], minlength=len(place)) for y in (0, 1)], axis=1).astype(float)
        df = np.maximum(frequency, seen.sum(axis=1))
        rarity = np.log1p((np.maximum(total, df) - df + 0.5) / (df + 0.5))
        weight = rarity * (1 + association(seen, np.array([(labels == 0).sum(), (labels == 1).sum()], float)) / ASSOCIATION)
        value = (1 + np.log(times)) * weight[where]
        norm = np.sqrt(np.bincount(at, value**2, minlength=len(texts)))
        value /= norm[at]

        shared = seen.sum(axis=1) >= COMMON
        order = cls._block_order(at[shared[where]], where[shared[where]], value[shared[where]], ids)
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        by_word = np.lexsort((rank[at], where))
        examples, weights = rank[at][by_word], value[by_word]
        starts = np.searchsorted(where[by_word], np.arange(len(place) + 1))
        rows = np.flatnonzero(shared)
        common = np.full(len(place), -1)
        common[rows] = np.arange(len(rows))
        edges = np.arange(-(-max(1, len(texts)) // BLOCK) + 1) * BLOCK
        most, cuts = np.zeros((len(rows), len(edges) - 1)), np.zeros((len(rows), len(edges)), np.int64)
        for row, word in enumerate(rows.tolist()):
            lo, hi = starts[word], starts[word + 1]
            np.maximum.at(most[row], examples[lo:hi] // BLOCK, weights[lo:hi])
            cuts[row] = lo + np.searchsorted(examples[lo:hi], edges)
        alone = labels[norm == 0]
        rest = alone if len(alone) >= 20 else labels
        none = float((rest.sum() + 1) / (len(rest) + 2))
        index = cls(weight, ids[order], labels[order], examples, weights, starts, common, most, cuts, none)
        index._calibrate([own[i] for i in order.tolist()])
        return index

    @staticmethod
    def _block_order(at: np.ndarray, where: np.ndarray, value: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Examples by their three heaviest words among those that many have, then by id."""
        sort = np.lexsort((where, -value, at))
        at, where = at[sort], where[sort]
        first = np.searchsorted(at, np.arange(len(ids) + 1))
        lead = np.full((3, len(ids)), -1)
        for i in range(3):
            has = first[:-1] + i < first[1:]
            lead[i, has] = where[first[:-1][has] + i]
        return np.lexsort((ids, lead[2], lead[1], lead[0]))

    def vector(self, where: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Words of a text and their weights in a unit vector."""
        weight = (1 + np.log(times)) * self.weight[where]
        return where, weight / (np.sqrt((weight**2).sum()) or 1.0)

    def nearest(self, vector: tuple[np.ndarray, np.ndarray], k: int = NEIGHBOURS, without: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """Positions and cosines of the ``k`` examples nearest to a unit vector; ties go to the earlier position."""
        where, weight = vector
        row = self.common[where]
        rare, shared = row < 0, row >= 0
        base = self._sum_rare(where[rare], weight[rare])
        row, weight = row[shared], weight[shared]
        bounds = base.reshape(-1, BLOCK).max(axis=1) + weight @ self.most[row]
        top = int(bounds.argmax())
        at, cosine = self._best(base, row, weight, top, top + 1, k, without)
        bar = cosine[-1] - 1e-9 if len(at) == k else 1e-12
        open_ = np.flatnonzero(bounds >= bar)
        if len(open_) and (len(open_) > 1 or open_[0] != top):
            at, cosine = self._best(base, row, weight, int(open_[0]), int(open_[-1]) + 1, k, without)
        return at, cosine

    def _sum_rare(self, where: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """The part of every example's cosine that comes from words without block maxima."""
        low, high = self.starts[where], self.starts[where + 1]
        sizes = high - low
        take = np.repeat(low - np.concatenate([[0], np.cumsum(sizes)[:-1]]) if len(sizes) else low, sizes) + np.arange(sizes.sum())
        total = np.bincount(self.examples[take], self.weights[take] * np.repeat(weight, sizes), minlength=self.most.shape[1] * BLOCK)
        return total.astype(float)  # counts of nothing are whole numbers

    def _best(self, base: np.ndarray, row: np.ndarray, weight: np.ndarray, low: int, high: int, k: int, without: int) -> tuple[np.ndarray, np.ndarray]:
        """The best examples of a run of blocks that share a word with the query."""
        total, shift = base[low * BLOCK : high * BLOCK].copy(), low * BLOCK
        first, last = self.cuts[row, low], self.cuts[row, high]
        sizes = last - first
        take = np.repeat(first - np.concatenate([[0], np.cumsum(sizes)[:-1]]) if len(sizes) else first, sizes) + np.arange(sizes.sum())
        np.add.at(total, self.examples[take] - shift, np.repeat(weight, sizes) * self.weights[take])
        total = np.round(total, 12)
        if low * BLOCK <= without < high * BLOCK:
            total[without - shift] = 0
        found = np.flatnonzero(total)
        if len(found) > k:
            found = found[total[found] >= np.partition(total[found], -k)[-k]]
        found = found[np.lexsort((found, -total[found]))[:k]]
        return found + shift, total[found]

    def _vote(self, at: np.ndarray, cosine: np.ndarray) -> float:
        """Log odds of the neighbours' votes, smoothed by the rate without any neighbour."""
        votes = cosine / (1 + NEAREST - np.minimum(cosine, 1))
        p = ((votes * self.labels[at]).sum() + self.none) / (votes.sum() + 1)
        return float(np.log(p / (1 - p)))

    def _calibrate(self, counts: list[tuple[np.ndarray, np.ndarray]]) -> None:
        votes, labels = [], []
        for i, count in enumerate(counts):
            at, cosine = self.nearest(self.vector(*count), without=i)
            if len(at):
                votes.append(self._vote(at, cosine))
                labels.append(int(self.labels[i]))
        if len(set(labels)) == 2:
            slope, offset = calibrate(np.array(votes), np.array(labels))
            if slope > 0:
                self.scale = (slope, offset)

    def score(self, where: np.ndarray, times: np.ndarray) -> tuple[float, list[int], list[float]]:
        """Probability of the label for a text's counted words, and ids and cosines of the nearest examples."""
        vector = self.vector(where, times)
        if not len(vector[0]):
            return self.none, [], []
        key = hashlib.blake2b(vector[0].tobytes() + np.round(vector[1], 12).tobytes(), digest_size=16).digest()
        if key not in self.known:
            at, cosine = self.nearest(vector)
            margin = self.scale[0] * self._vote(at, cosine) + self.scale[1]
            answer = (float(1 / (1 + np.exp(-margin))) if len(at) else self.none, self.ids[at[:EVIDENCE]].tolist(), cosine[:EVIDENCE].tolist())
            if len(self.known) > 10_000:  # answers of frequent vectors; bounded
                self.known.clear()
            self.known[key] = answer
        return self.known[key]


def vocabulary(texts: list[str]) -> dict[str, int]:
    """A number for every word of some texts."""
    place: dict[str, int] = {}
    for text in texts:
        for word in words(text):
            place.setdefault(word, len(place))
    return place


def counted(text: str | None, place: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of a text's known words in ascending order, and how often each comes."""
    found = [at for at in map(place.get, words(text)) if at is not None]
    return np.unique(np.array(found, np.int64), return_counts=True)


def counted_words(documents: DataFrame, place: dict[str, int]) -> DataFrame:
    """``doc_id, words, times`` of every row, by a vocabulary of bounded size."""

    @pandas_udf("words array<int>, times array<int>")
    def count(text: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([counted(t, place) for t in text], columns=["words", "times"])

    return documents.select("doc_id", count("text").alias("c")).select("doc_id", "c.*")


def document_frequency(rows: DataFrame, size: int) -> np.ndarray:
    """Rows that have each word: counted per task, then summed. The result is as large as the vocabulary."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            total += np.bincount(batch.column(0).flatten().to_numpy(), minlength=size)
        some = np.flatnonzero(total)
        yield pa.record_batch([pa.array(some), pa.array(total[some])], ["word", "n"])

    sums = rows.select("words").mapInArrow(count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(size)
    out[sums["word"].to_numpy(np.int64)] = sums["n"].to_numpy(float)
    return out


def toxicity_scores(documents: DataFrame, labels: DataFrame, threshold: float = 0.5, label: str = "toxic", bound: int = EXAMPLES) -> DataFrame:
    """``doc_id, held_out, score, predicted, evidence_ids, evidence_cosines`` for every row; only the text is looked at.

    Examples are at most ``bound`` labelled rows outside the held-out fold; every document's words are counted once,
    for the frequencies and for its own score. A text without a word of any example, null and empty texts included,
    gets the rate of such examples and no evidence. Repeated rows are all scored, an empty table gives an empty
    result, and without learning rows every score is one half.
    """
    learned = learning_rows(documents, labels, label, bound).toPandas().sort_values("doc_id")
    texts = learned["text"].tolist()
    place = vocabulary(texts)
    rows = cut_lineage(counted_words(documents, place))
    index = ToxicityIndex.build(
        texts, learned["y"].to_numpy(np.int64), learned["doc_id"].to_numpy(np.int64), rows.count(), place, document_frequency(rows, len(place))
    )
    del learned, texts, place

    @pandas_udf("score double, evidence_ids array<long>, evidence_cosines array<double>")
    def judge(words: pd.Series, times: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([index.score(w, t) for w, t in zip(words, times)], columns=["score", "evidence_ids", "evidence_cosines"])

    judged = rows.select("doc_id", held_out().alias("held_out"), judge("words", "times").alias("j")).select("doc_id", "held_out", "j.*")
    return judged.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
