import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from arborlake.llm import conversation_trie as ct

SCHEMA = "conv_id long, turn long, role string, text string"


def towards_zero(c):
    return c - (abs(c) % 5) * (1 if c > 0 else -1)


def tie(role, text):
    return hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()


def plain_rebuilt(rows):
    turns = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            turns[conv].append((turn is not None, turn or 0, tie(role or "", text or ""), role or "", text or ""))
    own = {c: [r[3:] for r in sorted(t)] for c, t in turns.items()}
    head = {c: zlib.crc32(str(c).encode()) % 9 for c in own}
    return {c: tuple(own.get(towards_zero(c), [])[: head[c]] + own[c][head[c] :]) for c in own}


def plain_trie(rows):
    rebuilt = plain_rebuilt(rows)
    members = defaultdict(list)
    for c, turns in rebuilt.items():
        for d in range(len(turns) + 1):
            members[turns[:d]].append(c)
    children = defaultdict(list)
    for key in members:
        if key:
            children[key[:-1]].append(key)
    out = []
    for key, convs in members.items():
        saved, leaves, open_ = 0, 0, [key]
        while open_:
            node = open_.pop()
            saved += (len(members[node]) - 1) * (len(node[-1][1].encode()) if node else 0)
            leaves += not children[node]
            open_ += children[node]
        ends = ",".join(str(c) for c in sorted(convs) if rebuilt[c] == key)
        out.append((
            min(convs), len(key), min(members[key[:-1]]) if key else None, len(convs), len(children[key]), leaves, saved,
            hashlib.sha256(ends.encode()).hexdigest(),
        ))
    return sorted(out, key=str)


def trie(spark, rows):
    conversations = spark.createDataFrame(rows, SCHEMA).withColumns({"depth": F.lit("x"), "kx": F.lit(1), "weight": F.lit(None).cast("int")})
    return sorted(map(tuple, ct.prefix_trie(conversations).collect()), key=str)


def drawn(seed, convs, most, words="ab"):
    draw = random.Random(seed)
    return [(c, t, draw.choice(["u", "v"]), draw.choice(words)) for c in range(convs) for t in range(draw.randint(1, most))]


def test_equals_brute_force(spark):
    rows = drawn(1, 60, 12)
    found = trie(spark, rows)
    assert found == plain_trie(rows)
    assert len(found) < sum(len(t) for t in plain_rebuilt(rows).values())  # some paths are shared


def test_odd_rows(spark):
    rows = [
        (-3, 1, "u", "é"), (-3, None, None, None), (0, 2, "u", ""), (0, 2, "u", ""), (0, 2, "a", "x" * 1_100_000), (0, 1, None, "t"),
        (None, 1, "u", "lost"), (7, 5, "u", "alone"), (7, 5, "u", "alone"), (11, 1, "uu", "v"), (12, 1, "u", "uv"), (10**15, 3, "z", "z"),
    ]
    rows += [(6, t, "u", "same") for t in range(20)] + [(8, t, "u", "same") for t in range(20)] + [(9, -t, "u", "same") for t in range(15)]
    assert any(not t for t in plain_rebuilt(rows).values())  # a turnless one
    assert trie(spark, rows) == plain_trie(rows)


def test_copies_and_one_long_conversation(spark):
    rows = [(5 * c, t, "u", f"t{t}") for c in range(1200) for t in range(2)]
    rows += [(5 * 2000 + 1, t, "u", f"{t}") for t in range(400)]
    found = trie(spark, rows)
    assert found == plain_trie(rows)
    assert max(n for _, _, _, n, *_ in found) == 1201


def test_empty_table(spark):
    assert trie(spark, []) == trie(spark, [(None, 1, "u", "x")]) == []


@pytest.mark.parametrize("total,plus,plain", [
    (F.sum, lambda a, b: a + b, lambda a, b: a + b), (F.bit_xor, lambda a, b: a.bitwiseXOR(b), lambda a, b: a ^ b),
])
def test_running_goes_on_across_ranges(spark, total, plus, plain):
    rows = [(k, i, (i * 7919 + k) % 1000) for k, n in ((1, 900), (2, 1), (3, 40)) for i in range(n)]
    out = ct.running(spark.createDataFrame(rows, "k long, i long, v long"), "k", [F.col("i").desc()], {"s": F.col("v")}, total, plus)
    want, at = {}, {}
    for k, i, v in sorted(rows, key=lambda r: (r[0], -r[1])):
        at[k] = plain(at[k], v) if k in at else v
        want[k, i] = at[k]
    assert {(r.k, r.i): r.s for r in out.collect()} == want
