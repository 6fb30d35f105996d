"""How a chain of document filters works together in every order.

Each document becomes a mask with one bit per filter that it fails, and the documents of a part become cells: one row
per mask with its counts. A recursive query then extends filter prefixes by a letter not used yet, joined to the
masks: every level carries the bits applied so far and says what its filter does to a mask at that step. The cells
give these rows their counts. The recursion depends on the number of filters alone, so only the masks of the
documents grow with the input.

Null texts are empty, a null source is the part of the empty string. A row without ``doc_id`` has no smaller and no
larger id: it is never a repeat. Rows under one id count one by one and are no repeats of each other. Several labels
of a document count once. An empty table has no part and gives no row.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arborlake.session import cut_lineage

FEW_WORDS = 200
MOST_CAPITALS = 2  # of a hundred characters
LEAST_DISTINCT = 50  # of a hundred words
REPEATED = "E"
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")

#: One level a step: a mask's row stays alive while none of its bits was applied.
PREFIXES = """
with recursive prefixes (prefix, letter, step, before, applied, mask) as (
  select '', '', 0, 0, 0, mask from {masks}
  union all
  select concat(p.prefix, t.letter), t.letter, p.step + 1, p.applied, p.applied | t.bit, p.mask
  from prefixes p join {unused} t on t.mask = p.mask and (p.applied & t.bit) = 0
)
select prefix, letter, step, mask,
  (mask & applied) = 0 as kept,
  (mask & before) = 0 and (mask & applied) != 0 as removed,
  (mask & before) != 0 and (mask & (applied - before)) != 0 as redundant,
  mask = applied - before as unique_fails
from prefixes where step > 0
"""


def text_failures(text: Column) -> dict[str, Column]:
    """Failure conditions that a text answers alone: few words, few distinct ones, many capitals, odd characters."""
    words = F.array_remove(F.split(text, r"[ \t-\r]+"), "")
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    return {
        "A": F.size(words) < FEW_WORDS,
        "B": 100 * F.size(F.array_distinct(words)) < LEAST_DISTINCT * F.size(words),
        "C": 100 * capitals > MOST_CAPITALS * F.length(text),
        "D": text.rlike(r"[#$%&*|]"),
    }


def failure_masks(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """One row a document: ``part, mask, good, toxic``; filter ``E`` is the last bit.

    The texts are read once. What travels is a digest: the smallest id of each digest that has several is found by
    an aggregate that combines before its shuffle, and joined back.
    """
    text = F.coalesce("text", F.lit(""))
    failures = text_failures(text)
    narrow = cut_lineage(documents.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"),
        mask_of(failures).alias("mask"),
        F.unhex(F.sha2(text, 256)).alias("digest"),
    ))
    copied = cut_lineage(  # written, so that a digest shared by many rows can be split in the join
        narrow.filter("doc_id is not null").groupBy("digest")
        .agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).filter("first < last").drop("last")
    )
    marks = labels.filter("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        *(F.coalesce(F.max((F.col(label) == 1).cast("int")), F.lit(0)).alias(name) for label, name in (("quality", "good"), ("toxic", "toxic")))
    )
    repeated = F.when(F.col("doc_id") > F.col("first"), F.lit(1 << len(failures))).otherwise(0)
    rows = narrow.join(copied, "digest", "left").withColumn("mask", F.col("mask").bitwiseOR(repeated)).drop("digest", "first")
    return rows.join(marks, "doc_id", "left").select("part", "mask", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("good", "toxic")))


def mask_of(failures: Mapping[str, Column]) -> Column:
    """Bit i is set where the i-th condition holds; a condition that is null does not hold."""
    mask = F.lit(0)
    for i, failure in enumerate(failures.values()):
        mask = mask.bitwiseOR(F.when(failure, F.lit(1 << i)).otherwise(0))
    return mask


def interactions(masked: DataFrame, letters: str) -> DataFrame:
    """Effect of every filter at every step of every order, for rows ``part, mask, good, toxic``.

    ``letters`` names the filters, bit by bit; every order is looked at, so it should have at most seven. Returns
    ``part, filter_order, step`` with the counts of that step's filter and its ``shapley`` total. A part has at
    most ``2 ** len(letters)`` cells, and the broadcast tables depend on ``letters`` alone.
    """
    spark = masked.sparkSession
    cells = cut_lineage(masked.groupBy("part", "mask").agg(
        F.count("*").alias("n"), F.sum("good").alias("good"), F.sum("toxic").alias("toxic"),
    ))
    masks = cells.select("mask").distinct()
    bits = F.array(*(F.struct(F.lit(c).alias("letter"), F.lit(1 << i).alias("bit")) for i, c in enumerate(letters)))
    unused = masks.select("mask", F.inline(bits))
    levels = cut_lineage(spark.sql(PREFIXES, masks=masks, unused=unused))

    count = {c: F.sum(F.when(F.col(c), F.col("n")).otherwise(0)).alias(c) for c in ("kept", "removed", "redundant", "unique_fails")}
    lost = {f"{c}_lost": F.sum(F.when(F.col("removed"), F.col(c)).otherwise(0)).alias(f"{c}_lost") for c in ("good", "toxic")}
    by_prefix = (
        cells.repartition("part").join(F.broadcast(levels), "mask")
        .groupBy("part", "prefix", "letter").agg(*(count | lost).values())
    )
    orders = levels.filter(F.col("step") == len(letters)).select(F.col("prefix").alias("filter_order")).distinct()
    steps = orders.select("filter_order", F.explode(F.sequence(F.lit(1), F.lit(len(letters)))).alias("step"))
    steps = steps.withColumn("prefix", F.expr("substring(filter_order, 1, step)"))
    everywhere = F.sum("removed").over(Window.partitionBy("part", "letter"))  # one row an order
    listed = by_prefix.join(F.broadcast(steps), "prefix").withColumn("shapley", everywhere)
    return listed.select("part", "filter_order", "step", *COUNTS, "shapley")


def filter_audit(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """The five filters of a corpus in all 120 orders, per source; see the module for odd rows."""
    return interactions(failure_masks(documents, labels), "ABCD" + REPEATED)
