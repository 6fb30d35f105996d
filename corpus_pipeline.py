"""A training corpus from raw documents: quality, near copies, repeats, mix of languages, packed sequences.

Every stage takes the documents that the one before kept and returns documents with the same columns; the last
returns the pieces of the sequences. ``run`` writes each stage's result as Parquet and reads it again.
"""

from __future__ import annotations

import sys

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession

from arborlake.llm.common import table
from arborlake.llm.mixing import repeat_to_targets
from arborlake.llm.packing import pack
from arborlake.llm.quality import keep_good
from arborlake.llm.simhash import keep_first_copies
from arborlake.llm.suffixes import without_repeats
from arborlake.session import cut_lineage

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject; it learns from the labels of these documents."""
    return keep_good(docs, table(spark, sf_dir, "labels"))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that of the smallest id."""
    return keep_first_copies(docs)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the bytes in 100-byte strings that also start earlier."""
    return without_repeats(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of scarce languages repeated towards the target weights; none is dropped."""
    return repeat_to_targets(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences of 4096."""
    return pack(docs)


STAGES = [("quality", quality), ("near_copies", near_copies), ("repeats", repeats), ("mix", mix), ("packing", packing)]

#: A learned classifier, hashed shingles and a subword tokenizer are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole ``documents`` table."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return docs


QUERIES = {"pipeline": run}
ORACLES = {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
