"""Prefix trie of conversations: what they share from their first turn on.

Conversations are rebuilt first: one borrows the head of another of its group and goes on with its own later turns.
Identical rebuilt conversations then collapse into one weighted sequence with the list of those that end there, so
thousands of copies cost one path. Sequences that are proper prefixes of others drop out by an anti-join; the rest
are the leaves. The weighted prefixes of all sequences are the nodes.

A prefix is known by the exclusive or of hashes of its turns with their positions (128 bits) and its depth, so it
grows turn by turn as a running aggregate and loses its last turn as easily. Running aggregates go over ranges of
rows, and what a range takes over from those before it is one row a range: a conversation of any length is many
tasks. Totals below a node are gathered path by path: each node counts on one leaf's path only, summed up from
there.

Null roles and texts are empty. Turns are ordered by ``turn`` (null first) and, where that is equal, by a digest of
role and text; equal rows all count. Rows without ``conv_id`` belong to no conversation and are left out; an empty
table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arborlake.llm.common import partitions, slices
from arborlake.session import cut_lineage

GROUP = 5  # conversations that borrow from the same one
HEADS = 9  # a head has fewer turns than this
LIST_BITS = 9  # ids of 512 neighbouring numbers are listed together
KEY = ("kx", "ky", "depth")


def running(df: DataFrame, key: str, order: list[Column], values: dict[str, Column], total: Callable[[Column | str], Column],
            plus: Callable[[Column, Column], Column]) -> DataFrame:
    """Adds ``values``, each totalled over the rows of the same key up to this one in the order.

    Rows are dealt by ranges of key and order and written with the number of their range. Only a key that goes on
    from one range to the next takes anything over: fewer rows than there are ranges.
    """
    rows = cut_lineage(
        df.withColumns({f"_{name}": value for name, value in values.items()})
        .repartitionByRange(partitions(df), key, *order).withColumn("_part", F.spark_partition_id())
    )
    sums = rows.groupBy(key, "_part").agg(*(total(f"_{name}").alias(name) for name in values))
    earlier = Window.partitionBy(key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    taken = sums.select(key, "_part", *(total(name).over(earlier).alias(f"_from_{name}") for name in values))
    taken = taken.filter(" or ".join(f"_from_{name} is not null" for name in values))
    inside = Window.partitionBy(key, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = rows.withColumns({name: total(f"_{name}").over(inside) for name in values})
    joined = local.join(F.broadcast(taken), [key, "_part"], "left")
    whole = {name: F.coalesce(plus(F.col(f"_from_{name}"), F.col(name)), F.col(name)) for name in values}
    return joined.withColumns(whole).drop("_part", *(f"_{name}" for name in values), *(f"_from_{name}" for name in values))


def numbered_turns(conversations: DataFrame) -> DataFrame:
    """``conv_id, position`` (from 1)``, digest, n_bytes`` of every turn of a conversation; no text goes further."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    framed = F.concat(F.length(role).cast("string"), F.lit(":"), role, text)
    turns = cut_lineage(conversations.filter("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.unhex(F.sha2(framed, 256)).alias("digest"), F.octet_length(text).cast("long").alias("n_bytes"),
    ))
    order = [F.col("turn").asc_nulls_first(), F.col("digest").asc()]
    return running(turns, "conv_id", order, {"position": F.lit(1).cast("long")}, F.sum, Column.__add__).drop("turn")


def head_length(conv_id: Column) -> Column:
    return F.crc32(conv_id.cast("string").cast("binary")) % HEADS


def rebuilt_turns(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rebuilt turns ``conv_id, depth, hx, hy, n_bytes``, and the ids of all conversations, turnless ones too.

    A conversation takes its head from the one whose id is the last multiple of ``GROUP`` towards zero.
    """
    turns = cut_lineage(numbered_turns(conversations))
    sizes = turns.groupBy("conv_id").agg(F.count("*").alias("size"))
    convs = sizes.select(
        "conv_id", (F.col("conv_id") - F.col("conv_id") % GROUP).alias("base"), head_length(F.col("conv_id")).alias("head")
    )
    bases = sizes.select(F.col("conv_id").alias("base"), "size")
    convs = cut_lineage(
        convs.join(bases, "base", "left")
        .withColumn("borrowed", F.least("head", F.coalesce("size", F.lit(0)))).drop("size")
    )
    heads = turns.filter((F.col("conv_id") % GROUP == 0) & (F.col("position") < HEADS)).withColumnRenamed("conv_id", "base")
    taken = convs.join(heads, "base").filter("position <= borrowed").select("conv_id", F.col("position").alias("depth"), "digest", "n_bytes")
    own = turns.join(convs, "conv_id").filter("position > head").select(
        "conv_id", (F.col("position") - F.col("head") + F.col("borrowed")).alias("depth"), "digest", "n_bytes"
    )
    rows = taken.unionByName(own).select(
        "conv_id", "depth", F.xxhash64("depth", "digest").alias("hx"), F.xxhash64("digest", "depth").alias("hy"), "n_bytes"
    )
    return cut_lineage(rows), convs.select("conv_id")


def end_lists(whole: DataFrame) -> DataFrame:
    """Digest of the ids of every distinct sequence in ascending order: ``kx, ky, depth, ends_sha256``.

    Neighbouring ids are listed together first, at most ``2 ** LIST_BITS`` as ids are distinct; the lists of a
    sequence then pass through one hash in order, none of them kept.
    """
    part = F.expr(f"shiftright(conv_id, {LIST_BITS})").alias("part")
    listed = whole.groupBy(*KEY, part).agg(
        F.array_join(F.array_sort(F.collect_list("conv_id")).cast("array<string>"), ",").alias("ids")
    )

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        for batch in slices(batches):
            done = []
            *keys, lists = (batch.column(i).to_pylist() for i in (0, 1, 2, 4))
            for *new, ids in zip(*keys, lists):
                if new != key:
                    if state:
                        done.append((*key, state.hexdigest()))
                    key, state = new, hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            yield _ends(done)
        if state:
            yield _ends([(*key, state.hexdigest())])

    dealt = listed.repartition(partitions(whole), *KEY).sortWithinPartitions(*KEY, "part")
    return dealt.select(*KEY, "part", "ids").mapInArrow(fold, "kx long, ky long, depth long, ends_sha256 string")


def _ends(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * 4
    return pa.record_batch([*(pa.array(c, pa.int64()) for c in columns[:3]), pa.array(columns[3], pa.string())], [*KEY, "ends_sha256"])


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """One row a node of the trie of rebuilt conversations.

    ``conv_id`` is the smallest member, ``saved_tokens`` the bytes that one copy of each shared turn saves in the
    node's subtree; ``n_leaves`` counts nodes without children there, the node itself if it has none.
    """
    turns, convs = rebuilt_turns(conversations)
    zero = F.lit(0).cast("long")

    # whole sequences: identical conversations become one, with a weight
    steps = turns.select("conv_id", "hx", "hy", F.lit(1).alias("one")).unionByName(convs.select("conv_id", zero.alias("hx"), zero.alias("hy"), F.lit(0).alias("one")))
    whole = cut_lineage(steps.groupBy("conv_id").agg(F.bit_xor("hx").alias("kx"), F.bit_xor("hy").alias("ky"), F.sum("one").alias("depth")))
    sequences = cut_lineage(whole.groupBy(*KEY).agg(F.count("*").alias("weight"), F.min("conv_id").alias("conv_id")))

    # prefixes of one conversation a sequence
    owners = sequences.select("conv_id", "weight", F.col("depth").alias("length"))
    paths = running(
        turns.join(owners, "conv_id"), "conv_id", [F.col("depth").asc()], {"kx": F.col("hx"), "ky": F.col("hy")},
        F.bit_xor, Column.bitwiseXOR,
    )
    parent = {"px": F.col("kx").bitwiseXOR(F.col("hx")), "py": F.col("ky").bitwiseXOR(F.col("hy"))}
    shape = ["conv_id", "weight", "length", *KEY, "px", "py", "n_bytes"]
    null = F.lit(None).cast("long")
    roots = owners.withColumns({"kx": zero, "ky": zero, "depth": zero, "px": null, "py": null, "n_bytes": zero})
    paths = cut_lineage(paths.withColumns(parent).select(shape).unionByName(roots.select(shape)))

    # leaves: sequences that are no proper prefix
    proper = paths.filter("depth < length").select(*KEY).distinct()
    leaves = cut_lineage(sequences.join(proper, [*KEY], "left_anti").select("conv_id", F.lit(1).alias("leaf")))
    paths = paths.join(leaves, "conv_id", "left")
    nodes = cut_lineage(paths.groupBy(*KEY).agg(
        F.min("conv_id").alias("conv_id"), F.sum("weight").alias("n_convs"), F.min("px").alias("px"), F.min("py").alias("py"),
        F.max("n_bytes").alias("n_bytes"), F.count("leaf").alias("n_leaves"), F.min(F.when(F.col("leaf") == 1, F.col("conv_id"))).alias("owner"),
    ))

    # each node's saving on its owner's path, summed from the leaf up
    gain = F.when(F.col("owner") == F.col("conv_id"), (F.col("n_convs") - 1) * F.col("n_bytes")).otherwise(zero)
    on_paths = paths.filter("leaf = 1").select("conv_id", *KEY).join(nodes.select(*KEY, "n_convs", "n_bytes", "owner"), [*KEY])
    below = running(on_paths, "conv_id", [F.col("depth").desc()], {"below": gain}, F.sum, Column.__add__)
    saved = below.groupBy(*KEY).agg(F.sum("below").alias("saved_tokens"))

    above = nodes.select(F.col("kx").alias("px"), F.col("ky").alias("py"), (F.col("depth") + 1).alias("depth"), F.col("conv_id").alias("parent_conv_id"))
    children = nodes.filter("depth > 0").groupBy(F.col("px").alias("kx"), F.col("py").alias("ky"), (F.col("depth") - 1).alias("depth")).agg(F.count("*").alias("n_children"))
    named = nodes.join(above, ["px", "py", "depth"], "left")
    filled = named.join(children, [*KEY], "left").join(saved, [*KEY], "left").join(end_lists(whole), [*KEY], "left")
    return filled.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", zero).alias("n_children"), "n_leaves",
        F.coalesce("saved_tokens", zero).alias("saved_tokens"), F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"),
    )
