"""Document fingerprints as Merkle trees over sections, paragraphs and pieces, in DataFrame functions only.

Sections are what blank lines part, paragraphs what line ends part inside a section. A paragraph falls into pieces of
up to three words that end with a sentence at the latest, and after a fixed number of characters where nothing parts
words; the rule is one for texts of any length. A paragraph's node is the digest of its text, a section's the digest
of its paragraphs' digests, the root that of the sections'. Roots are equal just where texts are; two trees that
differ are compared branch by branch to find the paragraphs that do.

A fingerprint is the root and a sketch of the leaves: the smallest digests of the distinct pieces, a fixed number at
most. The likeness of two fingerprints is 1 if the roots agree, and else the part that both sketches share of the
smallest digests of their union: exactly the part of shared pieces while they have few, and an estimate of it for
longer texts.

The next document is the neighbour in order of the id. Rows are ordered within ranges of ids whose bounds come
from quantiles; the first row of a range visits the range before it, so one shuffle of the texts is enough and no
window spans the table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arborlake.llm.common import partitions

SECTION, PARAGRAPH = "\n\n", "\n"
BLANK, STOP = r" \t\x0B\f\r", "。！？"
# a word of at most 24 characters, and such a word that does not end a sentence
WORD = rf"[^{BLANK}\n{STOP}]{{0,23}}[^{BLANK}\n]"
INNER = rf"[^{BLANK}\n{STOP}]{{0,23}}[^{BLANK}\n.!?{STOP}]"
PIECE = rf"(?:{INNER}[{BLANK}]{{1,8}}){{0,2}}{WORD}[{BLANK}]{{0,8}}|[{BLANK}]{{1,24}}"
SKETCH = 128  # pieces of a sketch
DIGITS = 10  # hexadecimal digits of a piece
FANOUT = 64  # bounds looked through at each of two steps


def sections(text: Column) -> Column:
    """Digests of the paragraphs of each section: the leaves of the tree."""
    return F.transform(F.split(text, SECTION), lambda s: F.transform(F.split(s, PARAGRAPH), lambda p: F.sha2(p, 256)))


def root(leaves: Column) -> Column:
    """Digest of the sections' digests."""
    return F.sha2(F.concat_ws(",", F.transform(leaves, lambda ps: F.sha2(F.concat_ws(",", ps), 256))), 256)


def differing(a: Column, b: Column) -> Column:
    """``section, paragraph`` of the branches in which two trees of leaves differ, counted from 0.

    Branches are compared by position; below a section of equal paragraphs nothing is looked at.
    """
    def branches(i: Column) -> Column:
        left = F.coalesce(F.get(a, i), F.array().cast("array<string>"))
        right = F.coalesce(F.get(b, i), F.array().cast("array<string>"))
        longest = F.greatest(F.size(left), F.size(right))
        places = F.filter(F.sequence(F.lit(0), longest - 1), lambda j: ~F.get(left, j).eqNullSafe(F.get(right, j)))
        found = F.transform(places, lambda j: F.struct(i.alias("section"), j.alias("paragraph")))
        return F.when(left == right, F.array().cast("array<struct<section:int,paragraph:int>>")).otherwise(found)

    return F.flatten(F.transform(F.sequence(F.lit(0), F.greatest(F.size(a), F.size(b)) - 1), branches))


def sketch(text: Column) -> Column:
    """The smallest digests of a text's distinct pieces, in order. No piece crosses a paragraph."""
    cut = F.array_distinct(F.regexp_extract_all(text, F.lit(PIECE), F.lit(0)))
    leaves = F.array_distinct(F.transform(cut, lambda p: F.substring(F.md5(p), 1, DIGITS)))
    return F.slice(F.array_sort(leaves), 1, SKETCH)


def fingerprint(top: Column, leaves: Column) -> Column:
    return F.concat(top, F.lit(":"), F.array_join(leaves, ""))


def likeness(root_a: Column, a: Column, root_b: Column, b: Column) -> Column:
    """Of two fingerprints, from 0 to 1."""
    least = F.slice(F.array_sort(F.array_union(a, b)), 1, SKETCH)
    shared = F.size(F.array_intersect(least, F.array_intersect(a, b))) / F.size(least)
    return F.when(root_a == root_b, 1.0).when(F.size(least) > 0, shared).otherwise(0.0)


def _long_array(values: list[int]) -> Column:
    """A constant array; as text it is one expression however long it is."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<long>")


def id_range(key: Column, bounds: list[int]) -> Column:
    """Number of the (sorted) bounds that are not above the key, looked up in two steps."""
    if not bounds:
        return F.lit(0)
    coarse = F.size(F.filter(_long_array(bounds[::FANOUT]), lambda x: x <= key))
    start = F.greatest(coarse - 1, F.lit(0)) * FANOUT
    return start + F.size(F.filter(F.slice(_long_array(bounds), start + 1, FANOUT), lambda x: x <= key))


def with_next(documents: DataFrame) -> DataFrame:
    """``doc_id, text, root, leaves`` and those of the row that comes next: null texts empty, the last row's next is the first.

    Rows without an id come first. Rows under one id follow each other in order of their text.
    """
    shown = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    made = {"root": root(sections(F.col("text"))), "leaves": sketch(F.col("text"))}
    rows = shown.select("doc_id", "text", F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("key"))
    nexts = [F.col(c).alias(f"next_{c}") for c in ("text", *made)]
    ranges = max(16, 4 * partitions(documents))
    cuts = [i / ranges for i in range(1, ranges)]
    found = rows.agg(F.percentile_approx("key", cuts, 20 * ranges).alias("cuts")).first().cuts
    bounds = sorted(set(found or []))
    ranged = rows.withColumn("range", id_range(F.col("key"), bounds))
    firsts = {r.range: r.first for r in ranged.groupBy("range").agg(F.min("key").alias("first")).collect()}  # one row per range
    if not firsts:
        return rows.withColumns(made).select("doc_id", "text", *made, *nexts)
    order = sorted(firsts)
    before = dict(zip(order, [order[-1], *order[:-1]]))
    known = [firsts.get(i, 0) for i in range(len(bounds) + 1)]
    back = [before.get(i, 0) for i in range(len(bounds) + 1)]
    own = F.struct(F.col("range").alias("at"), F.lit(False).alias("visits"))
    visit = F.struct(F.get(_long_array(back), F.col("range")).cast("int").alias("at"), F.lit(True).alias("visits"))
    leads = F.get(_long_array(known), F.col("range")) == F.col("key")
    seated = ranged.withColumns(made).select("doc_id", "text", "key", *made, F.explode(F.when(leads, F.array(own, visit)).otherwise(F.array(own))).alias("seat"))
    following = Window.partitionBy("at").orderBy("visits", "key", "text")
    led = {f"next_{c}": F.lead(c).over(following) for c in ("text", *made)}
    return (
        seated.select("doc_id", "text", "key", *made, "seat.*").withColumns(led)
        .filter(~F.col("visits")).select("doc_id", "text", *made, *led)
    )


def merkle_trees(documents: DataFrame) -> DataFrame:
    """``doc_id, sections, root, leaves, fingerprint`` for every row: digests of paragraphs by section, the root, and the sketch."""
    text = F.coalesce("text", F.lit(""))
    trees = documents.select("doc_id", sections(text).alias("sections"), sketch(text).alias("leaves"))
    trees = trees.withColumn("root", root(F.col("sections")))
    return trees.select("doc_id", "sections", "root", "leaves", fingerprint(F.col("root"), F.col("leaves")).alias("fingerprint"))


def edit_report(documents: DataFrame) -> DataFrame:
    """Fingerprints of every row's text and of the text with its second half replaced from the next document.

    ``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next``, and where the edit is:
    ``n_differing`` paragraphs, the first of them ``edit_section, edit_paragraph`` (from 0; null if none differs).
    Empty texts stay empty when edited. Rows repeated under an id are neighbours of each other. An empty table gives
    an empty result.
    """
    half = F.floor(F.length("text") / 2).cast("int")
    edited = F.concat(F.expr("substring(text, 1, length(text) - cast(floor(length(text) / 2) as int))"), F.substring("next_text", F.lit(1), half))
    # a shuffle lies below, so a row's texts are looked at once for each result column that needs them
    shown = with_next(documents).withColumn("edited", edited)
    cut = shown.select(
        "doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"),
        "root", "leaves", "next_root", "next_leaves", sections(F.col("text")).alias("own"), sections(F.col("edited")).alias("new"),
        sketch(F.col("edited")).alias("new_leaves"),
    ).withColumn("new_root", root(F.col("new")))
    own, next_, new = ([F.col(f"{name}root"), F.col(f"{name}leaves")] for name in ("", "next_", "new_"))
    told = cut.select(
        "doc_id", "n_chars", "edited_sha256", fingerprint(*own).alias("fingerprint"), fingerprint(*new).alias("edited_fingerprint"),
        likeness(*own, *new).alias("near_edited"), likeness(*own, *next_).alias("near_next"), differing(F.col("own"), F.col("new")).alias("edits"),
    )
    first = F.get("edits", F.lit(0))
    return told.withColumns({
        "n_differing": F.size("edits"), "edit_section": first["section"], "edit_paragraph": first["paragraph"],
    }).drop("edits")
