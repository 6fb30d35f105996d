"""Language of a text by one bit-sliced Bloom filter over the n-grams of all languages.

Every language contributes all letter n-grams of its learning texts; words that are shorter than an n-gram count as
wholes, so every letter has a part. All languages share one filter: a slot holds a bitmask with one bit for each language, and looking up an n-gram is the conjunction of its slots' masks,
that is all languages that contain it. A text's bits are counted for each language, the hits expected from false
positives are taken off, and the largest count decides.

The size of the filter follows from the learning texts, whose number is bounded.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from arborlake.llm.common import Rolling, held_out, mix, runs_of

GRAM = 5  # letters of an n-gram, a word's two ends counted
PER_LANGUAGE = 4000  # learning rows of a language, about: the bound of the fitted sample
HASHES = 3
SLOTS_PER_KEY = 8
CHUNK = 1 << 18
UNDETERMINED = "und"

_LOW = np.array([chr(c).isalpha() for c in range(0x3400)])


def _letters(codes: np.ndarray) -> np.ndarray:
    is_letter = np.zeros(len(codes), bool)
    low = codes < len(_LOW)
    is_letter[low] = _LOW[codes[low]]
    if not low.all():
        kinds, back = np.unique(codes[~low], return_inverse=True)
        is_letter[~low] = np.array([chr(c).isalpha() for c in kinds])[back]
    return is_letter


def grams(texts: list[str], rolling: Rolling) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-grams of the lower-cased texts and the bounds of each text's part.

    Runs of letters are words, anything else is one blank; an n-gram has a blank at its ends only. A shorter word with
    its two blanks is one n-gram.
    """
    low = [t.lower() for t in texts]
    codes = np.frombuffer((" " + "  ".join(low) + " ").encode("utf-32-le", "surrogatepass"), np.uint32).copy()
    letter = _letters(codes)
    codes[~letter] = 32
    ends = np.cumsum([len(t) + 2 for t in low])
    sums = rolling.prefix(codes)
    found, owner = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for size in range(3, GRAM + 1):
        if len(codes) < size:
            continue
        inner = letter[1 : len(codes) - 1].copy()
        for shift in range(1, size - 2):
            inner[: len(inner) - shift] &= letter[1 + shift : len(codes) - 1]
        at = np.nonzero(inner[: len(codes) - size + 1])[0]
        if size < GRAM:
            at = at[~letter[at] & ~letter[at + size - 1]]
        found.append(rolling.grams(sums, size)[at])
        owner.append(np.searchsorted(ends - 1, at, side="right"))
    owner_, found_ = np.concatenate(owner), np.concatenate(found)
    order = np.argsort(owner_, kind="stable")
    return found_[order], np.searchsorted(owner_[order], np.arange(len(texts) + 1))


@dataclass(frozen=True)
class LanguageFilter:
    names: list[str]  # most frequent first
    slots: np.ndarray  # slots x bytes of language bits
    wrong: np.ndarray  # chance that an n-gram outside a language seems to be in it

    @classmethod
    def build(cls, names: list[str], keys: np.ndarray, language: np.ndarray) -> LanguageFilter:
        size = 1 << max(10, int(np.ceil(np.log2(max(1, len(keys)) * SLOTS_PER_KEY))))
        slots = np.zeros((size, max(1, -(-len(names) // 8))), np.uint8)
        bit = (128 >> (language % 8)).astype(np.uint8)
        for places in cls._places(keys, size):
            np.bitwise_or.at(slots, (places, language // 8), bit)
        full = np.unpackbits(slots, axis=1).mean(axis=0)[: len(names)]
        return cls(names, slots, full**HASHES)

    @staticmethod
    def _places(keys: np.ndarray, size: int) -> Iterator[np.ndarray]:
        for i in range(HASHES):
            yield (mix(keys + np.uint64(i * 0x9E3779B9)) & np.uint64(size - 1)).astype(np.int64)

    def hits(self, keys: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Per text and language the n-grams it contains, false positives taken off."""
        masks = None
        for places in self._places(keys, len(self.slots)):
            masks = self.slots[places] if masks is None else masks & self.slots[places]
        bits = np.unpackbits(masks, axis=1)[:, : len(self.names)]
        sums = np.zeros((len(keys) + 1, len(self.names)), np.int32)
        np.cumsum(bits, axis=0, out=sums[1:])
        seen = (sums[bounds[1:]] - sums[bounds[:-1]]).astype(float)
        asked = (bounds[1:] - bounds[:-1])[:, None]
        return np.maximum(0.0, (seen - asked * self.wrong) / np.maximum(1e-9, 1 - self.wrong))

    def predict(self, texts: list[str | None], rolling: Rolling) -> tuple[list[str], np.ndarray]:
        names, scores = [], np.zeros(len(texts))
        filled = [t or "" for t in texts]
        for lo, hi in runs_of([len(t) for t in filled], CHUNK):
            keys, bounds = grams(filled[lo:hi], rolling)
            if not self.names:
                names += [UNDETERMINED] * (hi - lo)
                continue
            counts = self.hits(keys, bounds)
            best = counts.argmax(axis=1)  # ties: the more frequent language
            scores[lo:hi] = counts.max(axis=1) / np.maximum(counts.sum(axis=1), 1e-9)
            has_letter = bounds[1:] > bounds[:-1]
            names += [self.names[b] if h else UNDETERMINED for b, h in zip(best, has_letter)]
        return names, scores


def _distinct_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rolling = Rolling()
    for batch in batches:
        texts, language = batch.column("text").to_pylist(), batch.column("language").to_numpy()
        for lo, hi in runs_of([len(t) for t in texts], CHUNK * 8):
            keys, bounds = grams(texts[lo:hi], rolling)
            own = np.repeat(language[lo:hi], np.diff(bounds))
            for one in np.unique(own):
                kinds = np.unique(keys[own == one])
                yield pa.record_batch([pa.array(np.full(len(kinds), one, np.int32)), pa.array(kinds.view(np.int64))], ["language", "gram"])


def fit(documents: DataFrame, per_language: int = PER_LANGUAGE) -> LanguageFilter:
    """The filter of all languages, from about ``per_language`` rows of each outside the held-out fold.

    Rows are chosen by hashed id with a rate that follows from the language's size, so rare languages are
    learned from whole. Distinct n-grams are found where the texts are; the driver sees each of a language once.
    """
    known = documents.select("doc_id", "text", "lang").filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out())
    sizes = [(r.lang, r["count"]) for r in known.groupBy("lang").count().orderBy(F.desc("count"), "lang").collect()]
    names = [name for name, _ in sizes]
    if not names:
        return LanguageFilter.build([], np.zeros(0, np.uint64), np.zeros(0, np.int64))
    spark = documents.sparkSession
    rates = spark.createDataFrame([(i, n, float(per_language) / c) for i, (n, c) in enumerate(sizes)], "language int, lang string, rate double")
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / float(1 << 30)
    chosen = known.join(F.broadcast(rates), "lang").filter(draw < F.col("rate")).select("text", "language")
    kinds = chosen.mapInArrow(_distinct_grams, "language int, gram long").distinct().toPandas()
    return LanguageFilter.build(names, kinds["gram"].to_numpy(np.int64).view(np.uint64), kinds["language"].to_numpy(np.int64))


def language_ids(documents: DataFrame) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` for every row; only the text is looked at.

    ``und`` with score 0 for null texts and texts without a letter, and for all where no language is known. The
    score is the winner's part of all counted hits. Ties go to the language with more learning rows. Letters of
    which no n-gram is known give the most frequent language with score 0. Repeated rows are all answered; an
    empty table gives an empty result.
    """
    known, rolling = fit(documents), Rolling()

    @pandas_udf("lang_pred string, score double")
    def predict(text: pd.Series) -> pd.DataFrame:
        names, scores = known.predict(text.tolist(), rolling)
        return pd.DataFrame({"lang_pred": names, "score": scores})

    return documents.select("doc_id", held_out().alias("held_out"), predict("text").alias("p")).select("doc_id", "held_out", "p.*")
