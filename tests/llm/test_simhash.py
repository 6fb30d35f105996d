import re

import numpy as np
import xxhash

from arborlake.llm import simhash as sh

TEXT = "the quick brown fox jumps over the lazy dog while seven wizards quietly boil green tea near an old harbour wall"


def plain_print(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] if len(words) >= 4 else [" ".join(words)] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(ids, prints, radius=4):
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in range(len(ids)):
        for b in range(a):
            if (prints[a] ^ prints[b]).bit_count() <= radius:
                x, y = sorted((find(ids[a]), find(ids[b])))
                root[y] = x
    return {i: find(i) for i in ids}


def test_fingerprints_match_the_plain_rule():
    texts = [TEXT, None, "", " \t", "One", "One two  THREE", "a b c d", "a b c d " * 50, "Ü ü Ñ x\x0by z\x85w q", TEXT.upper(), "x " * 3000]
    assert [int(x) for x in sh.simhash(texts)] == [plain_print(t) for t in texts]


def test_groups_match_brute_force(spark):
    rng = np.random.default_rng(1)
    words = np.array([f"w{i}" for i in range(300)])
    rows, ids = [], iter(range(10, 10_000, 3))
    for _ in range(120):
        base = list(rng.choice(words, rng.integers(1, 120)))
        for _ in range(rng.integers(1, 4)):
            near = list(base)
            if len(near) > 60:
                near[rng.integers(len(near))] = "changed"
            rows.append((next(ids), " ".join(near)))
    rows += [(1, None), (2, ""), (3, "\n")]
    got = sh.simhash_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = plain_components([i for i, _ in rows], [plain_print(t) for _, t in rows])
    assert {r.doc_id: r.component_id for r in got} == want
    assert {r.doc_id: r.fingerprint for r in got} == {i: f"{plain_print(t):016x}" for i, t in rows}


def test_links_of_crowded_prints_match_brute_force(spark, monkeypatch):
    """Clouds around a few centres, with shards split into many blocks."""
    monkeypatch.setattr(sh, "BLOCK", 16)
    rng = np.random.default_rng(2)
    prints = []
    for centre in rng.integers(0, 1 << 63, 12):
        for _ in range(40):
            flips = sum(1 << int(b) for b in set(rng.integers(0, 64, rng.integers(0, 6))))
            prints.append((int(centre) ^ flips) & ((1 << 64) - 1))
    prints = sorted(set(prints) | {int(x) for x in rng.integers(0, 1 << 63, 300)})
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    links = sh.fingerprint_links(spark.createDataFrame([(p,) for p in signed], "fp long")).collect()
    at = {p: i for i, p in enumerate(signed)}
    root = sh.roots_of(len(prints), np.array([at[r.u] for r in links]), np.array([at[r.v] for r in links]))
    want = plain_components(list(range(len(prints))), prints)
    assert {i: int(r) for i, r in enumerate(root)} == want


def test_one_copy_of_each_group_stays(spark):
    rows = [(5, TEXT, "x"), (3, TEXT, "y"), (3, TEXT, "y"), (9, "something else entirely", "z"), (None, "no id here at all today", "z")]
    rows += [(None, "no id here at all today", "z"), (None, TEXT, "n"), (20, "one text under this id here", "a"), (20, "and quite another under the same", "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    kept = sh.keep_first_copies(docs)
    assert kept.columns == docs.columns
    assert sorted((str(r.doc_id), r.text) for r in kept.collect()) == sorted([
        ("3", TEXT), ("9", "something else entirely"), ("None", "no id here at all today"),
        ("20", "one text under this id here"), ("20", "and quite another under the same"),
    ])
    assert sh.keep_first_copies(docs.limit(0)).count() == 0
