"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import sys
import types
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FOLDS = 5  # one fold of five is held out


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def held_out(key: str = "doc_id") -> Column:
    """True where crc32 of the id as text falls into the fold that nothing is learned from."""
    fold = F.crc32(F.col(key).cast("string").cast("binary")) % FOLDS
    return F.coalesce(fold == 0, F.lit(False))


def is_held_out(key: int | None) -> bool:
    return key is not None and zlib.crc32(str(key).encode()) % FOLDS == 0


def learning_rows(documents: DataFrame, labels: DataFrame, label: str, bound: int) -> DataFrame:
    """At most ``bound`` labelled rows ``doc_id, text, y`` outside the held-out fold, those of smallest hashed id.

    The bound only limits what a model is fitted on. A document with several labels counts once, with the
    largest; rows without a label or an id are no learning rows.
    """
    known = (
        labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
        .groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))
    )
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound)
    texts = documents.select("doc_id", "text").filter("text is not null")
    return texts.join(F.broadcast(chosen), "doc_id").dropDuplicates(["doc_id"]).select("doc_id", "text", "y")


def calibrate(margin: np.ndarray, labels: np.ndarray, ridge: float = 0.05) -> tuple[float, float]:
    """Slope and offset that turn margins of unseen rows into log odds (logistic regression on one number)."""
    spread = float(margin.std()) or 1.0
    x = np.stack([(margin - margin.mean()) / spread, np.ones(len(margin))], axis=1)
    w = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        pull = np.array([ridge, 1e-6])
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(pull), x.T @ (p - labels) + pull * w)
        w -= np.clip(step, -5, 5)
    slope = w[0] / spread
    return float(slope), float(w[1] - slope * margin.mean())


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads the bits of unsigned 64-bit hashes (the usual xor-multiply finish)."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


class Rolling:
    """Hashes of arbitrary slices of one buffer from prefix sums of ``c[i] * base**i`` modulo 2**64."""

    BASE = 0x9E3779B97F4A7C15

    def __init__(self) -> None:
        self.power = np.ones(1, np.uint64)
        self.inverse = np.ones(1, np.uint64)

    def _grow(self, n: int) -> None:
        if len(self.power) <= n:
            size = 1 << int(n).bit_length()
            self.power, self.inverse = self._powers(self.BASE, size), self._powers(pow(self.BASE, -1, 1 << 64), size)

    @staticmethod
    def _powers(base: int, n: int) -> np.ndarray:
        steps = np.full(n, base, np.uint64)
        steps[0] = 1
        return np.cumprod(steps)

    def prefix(self, codes: np.ndarray) -> np.ndarray:
        """Prefix sums, one longer than ``codes``; pass them to ``slices``."""
        self._grow(len(codes) + 1)
        sums = np.zeros(len(codes) + 1, np.uint64)
        np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * self.power[: len(codes)], out=sums[1:])
        return sums

    def slices(self, sums: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return mix((sums[stop] - sums[start]) * self.inverse[start])

    def grams(self, sums: np.ndarray, n: int) -> np.ndarray:
        """Hash of the ``n`` codes from each position on, for all positions that have so many."""
        return mix((sums[n:] - sums[:-n]) * self.inverse[: len(sums) - n])


def slices(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of few rows, so that only a piece's texts are Python objects at a time."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def runs_of(sizes: list[int], limit: int) -> Iterator[tuple[int, int]]:
    """Consecutive slices of a list whose sizes add up to about ``limit``; never an empty slice."""
    start = total = 0
    for i, size in enumerate(sizes):
        if total and total + size > limit:
            yield start, i
            start, total = i, 0
        total += size
    if start < len(sizes):
        yield start, len(sizes)


def roots_of(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest member of the component of each of ``n`` nodes under the links ``a[i] - b[i]``."""
    root = np.arange(n)
    while len(a):
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        while True:
            jumped = new[new]
            if np.array_equal(jumped, new):
                break
            new = jumped
        root = new
        open_ = root[a] != root[b]
        a, b = a[open_], b[open_]
    return root


def kept(kind: str, name: str, make: Callable[[], object]):
    """``make()``, once for a worker process: it lives in a module of this library's own."""
    module = sys.modules.setdefault("_arborlake_worker", types.ModuleType("_arborlake_worker"))
    return module.__dict__.setdefault(kind, {}).get(name) or module.__dict__[kind].setdefault(name, make())
