"""Document quality by supervised subword embeddings.

A document is the bag of its words, word pairs and the character n-grams inside words, with the word's ends marked.
Every feature is hashed to a row of an embedding table; the rows are averaged over the document and a softmax
over the two labels reads the average. Table and output layer are learned together by stochastic gradient
descent in numpy, on a bounded number of labelled rows.

A fifth of those rows is not learned from but sets the scale on which outputs are probabilities. The difference of the two outputs is linear in the average, so scoring needs one learned number per bucket:
the table folds into a vector that every task gets, and a document's score is the mean of its features' numbers.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType

from arborlake.llm.common import Rolling, calibrate, held_out, learning_rows, mix, runs_of

BITS = 16  # log2 of the number of feature buckets
GRAMS = (2, 3, 4)  # lengths of character n-grams, word ends counted
CHUNK = 1 << 18  # characters worked on at once

_SPACE = np.zeros(128, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def features(texts: list[str], bits: int = BITS, rolling: Rolling | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of every feature of all texts, and the text each belongs to.

    A feature is a word, a pair of neighbouring words, or an n-gram of characters with white space at most
    at its two ends.
    """
    rolling = rolling or Rolling()
    codes = np.frombuffer((" " + "  ".join(texts) + " ").encode("utf-32-le", "surrogatepass"), np.uint32).copy()
    space = np.zeros(len(codes), bool)
    low = codes < 128
    space[low] = _SPACE[codes[low]]
    codes[space] = 32
    sizes = np.array([len(t) + 2 for t in texts])
    owner = np.repeat(np.arange(len(texts)), sizes)
    gaps = np.concatenate([[0], np.cumsum(space)])  # white space before each position
    sums = rolling.prefix(codes)
    shift = np.uint64(64 - bits)
    starts = np.nonzero(space[:-1] & ~space[1:])[0] + 1
    stops = np.nonzero(~space[:-1] & space[1:])[0] + 1
    words, whose = rolling.slices(sums, starts, stops), owner[starts]
    # pairs of neighbouring words; a word said twice running is one feature whatever the word
    pairs = np.where(words[1:] == words[:-1], np.uint64(1), words[1:] * np.uint64(3) + words[:-1])
    inside = whose[1:] == whose[:-1]
    found, places = [words >> shift, mix(pairs[inside]) >> shift], [whose, whose[1:][inside]]
    for n in GRAMS:
        if len(codes) < n:
            continue
        # no white space strictly inside, and not white space alone
        inner = gaps[n - 1 : len(gaps) - 1] - gaps[1 : len(gaps) - n + 1]
        whole = gaps[n:] - gaps[:-n]
        at = np.nonzero((inner == 0) & (whole < n))[0]
        found.append(rolling.grams(sums, n)[at] + np.uint64(n << 56) >> shift)
        places.append(owner[at])
    return np.concatenate(found).astype(np.int64), np.concatenate(places)


@dataclass(frozen=True)
class QualityModel:
    weights: np.ndarray  # learned output difference of each bucket
    bias: float

    def scores(self, texts: list[str | None], rolling: Rolling | None = None) -> np.ndarray:
        """Probability of label 1; null and empty texts have no feature and get the learned bias alone."""
        out = np.empty(len(texts))
        filled = [t or "" for t in texts]
        rolling = rolling or Rolling()
        for lo, hi in runs_of([len(t) for t in filled], CHUNK):
            bucket, owner = features(filled[lo:hi], int(np.log2(len(self.weights))), rolling)
            total = np.bincount(owner, self.weights[bucket], minlength=hi - lo)
            margin = total / np.maximum(np.bincount(owner, minlength=hi - lo), 1) + self.bias
            out[lo:hi] = 1 / (1 + np.exp(-np.clip(margin, -500, 500)))
        return out


def train(texts: list[str], labels: np.ndarray, spare: int = 5) -> QualityModel:
    """A model learned on the rows; every ``spare``-th row is kept back to turn its outputs into probabilities."""
    kept = np.arange(len(texts)) % spare == spare - 1
    learn, check = np.nonzero(~kept)[0], np.nonzero(kept)[0]
    if len(set(labels[learn].tolist())) < 2 or min(np.bincount(labels[check], minlength=2)) < 5:
        return learn_embeddings(texts, labels)
    model = learn_embeddings([texts[i] for i in learn], labels[learn])
    p = np.clip(model.scores([texts[i] for i in check]), 1e-12, 1 - 1e-12)
    slope, offset = calibrate(np.log(p / (1 - p)), labels[check])
    return QualityModel(model.weights * slope, model.bias * slope + offset)


def learn_embeddings(texts: list[str], labels: np.ndarray, size: int = 16, epochs: int = 6, batch: int = 32, rate: float = 0.1,
          bits: int = BITS, seed: int = 1) -> QualityModel:
    """Fits the table (buckets x ``size``) and the output layer by minibatch gradient descent with a falling rate.

    Without both labels in the rows the model is the share of ones for every text.
    """
    n = len(texts)
    ones = float(labels.sum())
    prior = (ones + 1) / (n + 2)
    if not n or ones in (0.0, float(n)):
        return QualityModel(np.zeros(1 << bits), float(np.log(prior / (1 - prior))))
    rolling, bags = Rolling(), []
    for lo, hi in runs_of([len(t) for t in texts], CHUNK):
        bucket, owner = features(texts[lo:hi], bits, rolling)
        pair, count = np.unique(owner << bits | bucket, return_counts=True)
        ends = np.searchsorted(pair >> bits, np.arange(1, hi - lo))
        per = np.bincount(owner, minlength=hi - lo)
        share = (count / per[pair >> bits]).astype(np.float32)
        bags += list(zip(np.split((pair & ((1 << bits) - 1)).astype(np.int32), ends), np.split(share, ends)))
    rng = np.random.default_rng(seed)
    table = rng.uniform(-1 / size, 1 / size, (1 << bits, size)).astype(np.float32)
    out = rng.normal(0, 1, (size, 2)).astype(np.float32)
    bias = np.log([1 - prior, prior]).astype(np.float32)
    squared = np.full(1 << bits, 1e-12, np.float32)
    steps, done = epochs * -(-n // batch), 0
    for _ in range(epochs):
        order = rng.permutation(n)
        for at in range(0, n, batch):
            picked = order[at : at + batch]
            ids = np.concatenate([bags[i][0] for i in picked])
            share = np.concatenate([bags[i][1] for i in picked])
            sizes = [len(bags[i][0]) for i in picked]
            row = np.repeat(np.arange(len(picked)), sizes)
            mean = np.zeros((len(picked), size), np.float32)
            filled = np.nonzero(sizes)[0]
            if len(filled):
                edges = np.concatenate([[0], np.cumsum(sizes)[:-1]])[filled]
                mean[filled] = np.add.reduceat(table[ids] * share[:, None], edges)
            logits = mean @ out + bias
            p = np.exp(logits - logits.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(picked)), labels[picked]] -= 1
            step = rate * (1 - done / steps)
            back = p @ out.T
            out -= step * mean.T @ p / len(picked)
            bias -= step * p.sum(axis=0) / len(picked)
            # a bucket learns at its own pace: its rate is divided by the root of what it has seen
            touched, inverse = np.unique(ids, return_inverse=True)
            into = np.argsort(inverse, kind="stable")
            gradient = np.add.reduceat((back[row] * share[:, None])[into], np.searchsorted(inverse[into], np.arange(len(touched))))
            squared[touched] += (gradient**2).mean(axis=1)
            table[touched] -= step * gradient / np.sqrt(squared[touched])[:, None]
            done += 1
    difference = out[:, 1] - out[:, 0]
    return QualityModel((table @ difference).astype(np.float64), float(bias[1] - bias[0]))


def fit(documents: DataFrame, labels: DataFrame, label: str = "quality", bound: int = 4000) -> QualityModel:
    """Model learned on at most ``bound`` labelled rows outside the held-out fold, taken by hashed id.

    One task learns from the rows; only the finished numbers come to the driver.
    """
    def learn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = list(batches)  # bounded
        rows = pd.concat(parts).sort_values("doc_id") if parts else pd.DataFrame({"text": [], "y": []})
        model = train(rows["text"].tolist(), rows["y"].to_numpy(np.int64))
        yield pd.DataFrame({"weights": [model.weights.tobytes()], "bias": [model.bias]})

    rows = learning_rows(documents, labels, label, bound).repartition(1)
    learned = rows.mapInPandas(learn, "weights binary, bias double").first()
    return QualityModel(np.frombuffer(learned.weights), learned.bias) if learned else train([], np.zeros(0, np.int64))


def scorer(model: QualityModel) -> Callable[[str], Column]:
    rolling = Rolling()

    @pandas_udf(DoubleType())
    def score(text: pd.Series) -> pd.Series:
        return pd.Series(model.scores(text.tolist(), rolling))

    return score


def quality_scores(documents: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row of the documents; only the text is looked at.

    Null and empty texts get the learned bias, rows repeated under an id are all scored, an empty table gives
    an empty result.
    """
    scored = documents.select("doc_id", held_out().alias("held_out"), scorer(fit(documents, labels))("text").alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep_good(documents: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """The documents whose score reaches the threshold, with all their columns."""
    return documents.filter(scorer(fit(documents, labels))("text") >= threshold)
