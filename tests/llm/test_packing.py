import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from arborlake.llm import packing as pk

TEXTS = ["Hello, World! it's 3.5 o'clock", None, "", " \t\n", "naïve ÉCOLE ΟΔΟΣ İstanbul é", "a b c\x1cd\x85e", "<|endoftext|> x<|startoftext|>y", "漢字 かな 😀👍🏽", "word " * 3000,
    "Word, WORD. word! word!! wörd, ΣΟΦΟΣ. Straße?! a-b c--- it's. 'tis, don't! x.y. 5. 5!! a1. é) (é) ǅ, ﬁne! e\u0301. ... a\u0301! ne\u0301e, $a$ #x##"]


def test_ids_equal_the_tokenizers_own():
    encode, plain = pk.word_encoder(pk.VOCABULARY), Tokenizer.from_file(public_tokenizers.path(pk.VOCABULARY))
    for text in TEXTS:
        assert encode(text or "") == np.array(plain.encode(text or "", add_special_tokens=False).ids, "<u4").tobytes()


@pytest.mark.parametrize("histogram", [{}, {4096: 3}, {1: 1}, {3000: 10}, {2048: 7, 1024: 5, 512: 3}, {4095: 4, 1: 2, 2: 9}])
def test_plans_place_every_piece_once(histogram):
    check_plan(histogram)


def test_plan_of_many_lengths_wastes_little():
    rng = np.random.default_rng(5)
    lengths = np.minimum(4096, rng.lognormal(6, 1.1, 20_000).astype(int) + 1)
    plan = check_plan(Counter(lengths.tolist()))
    assert plan.sequences * 4096 < lengths.sum() * 1.002
    few = np.minimum(4096, rng.lognormal(6, 1.1, 500).astype(int) + 1)
    assert check_plan(Counter(few.tolist())).sequences * 4096 < few.sum() + 2 * 4096


def check_plan(histogram):
    plan = pk.plan_sequences(histogram)
    if not histogram:
        assert plan.sequences == 0
        return plan
    length = np.repeat(list(histogram), list(histogram.values()))
    rank = np.concatenate([np.arange(n) for n in histogram.values()])
    sequence, offset = plan.place(length, rank)
    order = np.lexsort((offset, sequence))
    sequence, offset, length = sequence[order], offset[order], length[order]
    first = np.concatenate([[True], sequence[1:] != sequence[:-1]])
    assert (offset[first] == 0).all() and sequence.max() + 1 == plan.sequences == first.sum()
    assert (offset[1:] == np.where(first[1:], 0, offset[:-1] + length[:-1])).all()
    assert (offset + length <= 4096).all()
    return plan


def test_least_squares_uses_up_a_histogram_that_fits():
    fills = np.array([[3000, 1096, 0], [2048, 2048, 0], [2048, 1024, 1024], [3000, 1000, 96]])
    histogram = np.zeros(4097)
    for row, times in zip(fills, (5, 2, 4, 7)):
        for x in row[row > 0]:
            histogram[x] += times
    assert np.allclose(pk.repeat_counts(fills, histogram, 3000), (5, 2, 4, 7), atol=0.05)


def test_pieces_hold_all_ids(spark):
    rows = [(i, t, i) for i, t in enumerate(TEXTS)] + [(9, "word " * 3000, 0), (None, "no id", 0), (20, "long text " * 9000, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, length long")
    got = pk.pack(docs).collect()
    plain = Tokenizer.from_file(public_tokenizers.path(pk.VOCABULARY))
    want = Counter()
    for key, text, _ in rows:
        ids = np.array([*plain.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        for start in range(0, len(ids), 4096):
            part = ids[start : start + 4096]
            want[key, start, len(part), zlib.crc32(part.tobytes()), len(ids)] += 1
    assert Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in got) == want
    spans = sorted((r.sequence_id, r.offset, r.length) for r in got)
    ends = {}
    for sequence, offset, length in spans:
        assert offset == ends.get(sequence, 0)
        ends[sequence] = offset + length
    assert max(ends.values()) <= 4096 and set(ends) == set(range(len(ends)))
    assert pk.pack(docs.limit(0)).count() == 0
