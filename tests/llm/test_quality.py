import numpy as np

from arborlake.llm import quality as q
from arborlake.llm.common import is_held_out


def plain_features(text):
    """Strings of words, word pairs (equal ones marked) and n-grams in their order-free multiset."""
    out, words = [], text.split()
    out += [("w", w) for w in words]
    out += [("again",) if a == b else ("p", a, b) for a, b in zip(words, words[1:])]
    for w in words:
        marked = f" {w} "
        for n in q.GRAMS:
            out += [("g", marked[i : i + n]) for i in range(len(marked) - n + 1) if marked[i : i + n].strip()]
    return out


def test_features_are_the_stated_ones():
    texts = ["The the\tThe cat\n\nsat", "", "  ", "é", "no no no!", "x" * 50]
    bucket, owner = q.features(texts, bits=40)
    for i, text in enumerate(texts):
        want = plain_features(text)
        got = bucket[owner == i]
        assert len(got) == len(want)
        assert len(set(got.tolist())) == len(set(want))


def test_features_do_not_depend_on_neighbours():
    alone, _ = q.features(["some words here"], bits=40)
    both, owner = q.features(["before it", "some words here", "after"], bits=40)
    assert sorted(alone) == sorted(both[owner == 1])


def test_held_out_accuracy_and_odd_rows(spark):
    rng = np.random.default_rng(0)
    words = [f"{a}{b}" for a in "bcdfghjk" for b in ("ane", "olo", "ist", "urm")]
    docs, labels = [], []
    for i in range(400):
        good = i % 3 != 0
        text = " ".join(rng.choice(words, 40))
        docs.append((i, text if good else text.upper() + "!!", "src"))
        labels.append((i, int(good)))
    docs += [(400, None, None), (401, "", "s"), (402, "long " * 60_000, "s"), (402, "long " * 60_000, "s"), (None, "no id", "s")]
    labels += [(None, 1), (3, 0), (500, None)]
    frame = spark.createDataFrame(docs, "doc_id long, text string, score string")
    given = spark.createDataFrame(labels, "doc_id long, quality int")
    rows = q.quality_scores(frame, given).collect()
    assert len(rows) == len(docs)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)
    assert all(r.held_out == is_held_out(r.doc_id) for r in rows)
    unseen = [r for r in rows if r.held_out and r.doc_id < 400]
    assert np.mean([r.predicted == int(r.doc_id % 3 != 0) for r in unseen]) > 0.95
    assert q.keep_good(frame, given).columns == frame.columns


def test_without_labels_the_share_is_used(spark):
    frame = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert [r.score for r in q.quality_scores(frame, none).collect()] == [0.5, 0.5]
    assert q.quality_scores(frame.limit(0), none).count() == 0
