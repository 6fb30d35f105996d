import hashlib

import numpy as np
import pytest

from arborlake.llm import suffixes as sx
from arborlake.llm.common import Rolling


def plain_digests(rows, length=100):
    """Brute force over (id, text) in id order: all strings seen so far in one set."""
    seen, out = set(), {}
    for key, text in sorted(rows, key=lambda r: r[0]):
        raw = (text or "").encode()
        gone = np.zeros(len(raw), bool)
        for i in range(len(raw) - length + 1):
            string = raw[i : i + length]
            if string in seen:
                gone[i : i + length] = True
            seen.add(string)
        starts = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        out[key] = (len(raw), int(gone.sum()), starts, hashlib.sha256(kept).hexdigest())
    return out


def corpus(seed, n=60, words=40):
    rng = np.random.default_rng(seed)
    vocabulary = ["".join(rng.choice(list("abcdeéß "), rng.integers(2, 9))) for _ in range(words)]
    passages = [" ".join(rng.choice(vocabulary, 60)) for _ in range(6)]
    rows = []
    for i in range(n):
        own = [" ".join(rng.choice(vocabulary, rng.integers(0, 80)))]
        for _ in range(rng.integers(0, 4)):
            passage = passages[rng.integers(len(passages))]
            own += [passage[rng.integers(0, 60) :], "".join(rng.choice(list("xyz"), rng.integers(0, 30)))]
        rows.append((i * 7, " ".join(own)))
    rows += [(1000, rows[3][1]), (1001, None), (1002, ""), (1003, "x" * 99), (1004, "x" * 100), (1005, "x" * 230), (1006, "ab" * 300), (1007, passages[0] * 3)]
    return rows


@pytest.mark.parametrize("text", [b"", b"a", b"aaaa", b"banana", b"abracadabra" * 9, bytes(range(255)) * 2, b"mississippi\xffmississippi\xff"])
def test_two_stage_order_is_the_suffix_order(text):
    data = np.frombuffer(text, np.uint8)
    order = sx.suffix_order(data, 64)
    assert sorted(order.tolist()) == list(range(len(text)))
    cut = [text[i : i + 64] for i in order]
    assert cut == sorted(cut)


def test_two_stage_order_of_random_texts():
    rng = np.random.default_rng(0)
    for letters in (1, 2, 3, 20):
        text = bytes(rng.integers(97, 97 + letters, 700).astype(np.uint8))
        cut = [text[i : i + 104] for i in sx.suffix_order(np.frombuffer(text, np.uint8), 104)]
        assert cut == sorted(cut)


def test_equal_strings_have_equal_grams():
    rng = np.random.default_rng(4)
    shared = bytes(rng.integers(97, 101, 100).astype(np.uint8))
    grams = []
    for seed in range(5):
        around = np.random.default_rng(seed).integers(97, 123, 300).astype(np.uint8)
        text = bytes(around[:150]) + shared + bytes(around[150:])
        of, low, high, gram, _ = sx.spans([b"zz" * seed, text], 100, 32, Rolling())
        grams.append({int(g) for o, a, b, g in zip(of, low, high, gram) if o == 1 and a <= 150 <= b})
    assert len(set.union(*grams)) == 1


@pytest.mark.parametrize("shard, piece", [(4096, 1 << 20), (8, 150)])
def test_digests_match_brute_force(spark, monkeypatch, shard, piece):
    """With tiny shards and slices as well: frequent grams are dealt out, long texts are cut."""
    monkeypatch.setattr(sx, "SHARD", shard)
    monkeypatch.setattr(sx, "SLICE", piece)
    rows = corpus(shard)
    docs = spark.createDataFrame([(i, t, "c") for i, t in rows], "doc_id long, text string, gram string").repartition(5)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in sx.repeat_digests(docs).collect()}
    assert got == plain_digests(rows)
    assert sum(x[1] for x in got.values()) > 5000


def test_odd_rows(spark):
    long = "".join(chr(97 + (i * i) % 23) for i in range(4000))
    rows = [(1, long, "a", 4000), (1, long, "a", 4000), (None, long, "b", 4000), (5, "é" * 200, "c", 200), (6, None, "d", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, doc string, n_chars long")
    got = sorted((str(r.doc_id), r.n_removed) for r in sx.repeat_digests(docs).collect())
    whole = plain_digests([(0, long)])[0][1]
    assert got == [("1", 4000), ("1", 4000), ("5", 400 - 2), ("6", 0), ("None", whole)]
    rest = sx.without_repeats(docs)
    assert rest.columns == docs.columns
    assert all(r.n_chars == len(r.text or "") for r in rest.collect())
    assert sx.repeat_digests(docs.limit(0)).count() == 0


def test_repeated_rows_and_rows_without_id_lose_only_repeats(spark):
    """A phrase of less than 100 bytes shared with another document puts spans in doubt, but nothing goes."""
    rng = np.random.default_rng(8)
    phrase = "".join(rng.choice(list("abcdefgh"), 90))
    one, two, three, four = ("".join(rng.choice(list("klmnopqr"), 400)) for _ in range(4))
    texts = [f"{x[:200]}{phrase}{x[200:]}" for x in (one, two, three)]
    rows = [(1, texts[0])] * 3 + [(2, texts[1]), (None, texts[2]), (None, four + four[:150]), (None, four[::-1] + "z" * 300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted((r.doc_id or 0, r.n_bytes, r.n_removed) for r in sx.repeat_digests(docs).collect())
    assert got == [(0, 490, 0), (0, 550, 150), (0, 700, 299), (1, 490, 0), (1, 490, 0), (1, 490, 0), (2, 490, 0)]


def test_equal_rows_without_id_are_copies(spark):
    text = "".join(chr(97 + (i * i * i + i) % 23) for i in range(200)) + "".join(np.random.default_rng(1).choice(list("uvwxyz"), 300))
    docs = spark.createDataFrame([(None, text)] * 3, "doc_id long, text string")
    got = sorted(r.n_removed for r in sx.repeat_digests(docs).collect())
    assert got[1:] == [500, 500] and got[0] == plain_digests([(0, text)])[0][1]


def test_different_texts_under_one_id_are_documents_of_their_own(spark):
    rng = np.random.default_rng(11)
    shared, unique = ("".join(rng.choice(list(letters), 400)) for letters in ("abcdefgh", "klmnopqr"))
    rows = [(1, shared), (5, shared), (5, unique), (5, unique), (7, unique[:250] + shared[:50])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted((r.doc_id, r.n_bytes, r.n_removed) for r in sx.repeat_digests(docs).collect())
    assert got[0] == (1, 400, 0)
    whole = {n for k, _, n in got if k == 5}
    assert whole <= {0, 250, 400} and sorted(n for k, _, n in got if k == 5).count(400) == 1
    # the unique text is nobody's copy: what it shares with document 7 goes from one of the two
    lost = {(k, n) for k, _, n in got}
    assert ((5, 0) in lost) == ((7, 250) in lost)


@pytest.mark.parametrize("sampled", [1, 1 << 40])
def test_hot_grams_change_nothing(spark, monkeypatch, sampled):
    """A phrase in every document, in other surroundings each time, with all of it sampled or nothing."""
    monkeypatch.setattr(sx, "SAMPLED", sampled)
    rng = np.random.default_rng(12)
    phrase = "".join(rng.choice(list("abcd"), 140))
    rows = [(i, "".join(rng.choice(list("klmnopqrstuv"), 90)) + phrase + "".join(rng.choice(list("klmnopqrstuv"), 90 + i % 3))) for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in sx.repeat_digests(docs).collect()}
    assert got == plain_digests(rows)
