import numpy as np
import pytest

from arborlake.llm import toxicity as tx
from arborlake.llm.common import is_held_out

BAD, FINE = ["vile", "rotten", "foul"], [f"word{chr(97 + i)}{chr(97 + j)}" for i in range(8) for j in range(8)]


def sample(n, seed):
    rng = np.random.default_rng(seed)
    texts, labels = [], []
    for i in range(n):
        toxic = int(rng.random() < 0.3)
        own = list(rng.choice(FINE, rng.integers(3, 40))) + (list(rng.choice(BAD, rng.integers(1, 4))) if toxic else [])
        texts.append(" ".join(rng.permutation(own)))
        labels.append(toxic)
    return texts, np.array(labels)


def built(texts, labels, ids, total, more=0):
    place = tx.vocabulary(texts)
    seen = np.array([sum(w in t.split() for t in texts) + more for w in place], float)
    return tx.ToxicityIndex.build(texts, labels, ids, total, place, seen), place


@pytest.mark.parametrize("k", [1, 7, 40])
@pytest.mark.parametrize("common", [1, 40, 10_000])
def test_nearest_is_exact(k, common, monkeypatch):
    monkeypatch.setattr(tx, "COMMON", common)
    monkeypatch.setattr(tx, "BLOCK", 16)
    texts, labels = sample(500, 1)
    index, place = built(texts, labels, np.arange(500) * 3, 600, 7)
    dense = np.zeros((500, len(place)))
    for at, doc in enumerate(index.ids // 3):
        where, weight = index.vector(*tx.counted(texts[doc], place))
        dense[at, where] = weight
    assert np.allclose(np.linalg.norm(dense, axis=1), 1)
    for query in ["vile", "foul vile worda", FINE[0] * 2 + " " + " ".join(FINE[:9]), *sample(40, 2)[0]]:
        where, weight = vector = index.vector(*tx.counted(query, place))
        if not len(where):
            continue
        exact = np.round(dense[:, where] @ weight, 11)
        order = [i for i in np.lexsort((np.arange(500), -exact))[:k] if exact[i] > 0]
        at, cosine = index.nearest(vector, k)
        assert np.allclose(cosine, exact[order], atol=1e-10)
        assert set(at.tolist()) == set(order) or np.isclose(exact[order][-1], cosine[-1], atol=1e-10)


def test_every_word_is_indexed_and_those_with_the_label_weigh_more():
    texts, labels = sample(600, 3)
    index, place = built(texts, labels, np.arange(600), 600)
    assert set(place) == {w for t in texts for w in t.split()} and (np.diff(index.starts) > 0).all()
    heavy = sorted(place, key=lambda w: -index.weight[place[w]])[:3]
    assert set(heavy) == set(BAD)
    plain = np.array([[10, 0], [3, 7]], float)
    assert np.allclose(tx.association(plain, np.array([10.0, 10.0])), [2 * 20 * np.log(2), 2 * (3 * np.log(3 / 5) + 7 * np.log(7 / 5)) * 2], atol=8)


def test_copy_of_a_toxic_example_without_telling_words():
    texts, labels = sample(400, 5)
    texts.append("a remark that nobody else would make about zebras and umbrellas")
    labels = np.append(labels, 1)
    index, place = built(texts, labels, np.arange(401), 401)
    score, near, cosine = index.score(*tx.counted(texts[-1], place))
    assert score >= 0.5 and near[0] == 400 and abs(cosine[0] - 1) < 1e-9
    assert index.score(*tx.counted("never seen", place))[1] == [] == index.score(*tx.counted(None, place))[1]


def test_document_frequency_is_of_all_documents(spark):
    rows = [("Vile vile, ROT\u00c9 x9y m\u00b2",), ("rot\u00e9 y",), (None,), ("",), ("y " * 600_000,)]
    docs = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "doc_id long, text string").repartition(3)
    place = {w: i for i, w in enumerate(["vile", "rot\u00e9", "y", "m\u00b2", "none"])}
    found = tx.counted_words(docs, place)
    assert tx.document_frequency(found, 5).tolist() == [1, 2, 3, 1, 0]
    assert tx.document_frequency(found.limit(0), 5).tolist() == [0] * 5 and tx.document_frequency(tx.counted_words(docs, {}), 0).tolist() == []
    assert {r.doc_id: (r.words, r.times) for r in found.collect()}[0] == ([0, 1, 2, 3], [2, 1, 1, 1])


def test_held_out_accuracy_and_odd_rows(spark):
    texts, labels = sample(400, 4)
    rows = [(i, t, "x") for i, t in enumerate(texts)] + [(400, None, "x"), (401, "", None), (402, "vile " * 30_000, "x"), (402, "vile " * 30_000, "x"), (None, "foul", "x")]
    given = [(i, int(y)) for i, y in enumerate(labels)] + [(None, 1), (1, None), (900, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, predicted string")
    known = spark.createDataFrame(given, "doc_id long, toxic int")
    got = tx.toxicity_scores(docs, known).collect()
    assert len(got) == len(rows)
    assert all(0 <= r.score <= 1 and r.held_out == is_held_out(r.doc_id) and len(r.evidence_ids) <= tx.EVIDENCE for r in got)
    unseen = [r for r in got if r.held_out and r.doc_id < 400]
    assert np.mean([r.predicted == labels[r.doc_id] for r in unseen]) > 0.95
    assert not any(is_held_out(i) for r in got for i in r.evidence_ids)
    by_id = {r.doc_id: r for r in got}
    assert by_id[402].predicted == 1 and by_id[None].predicted == 1 and by_id[400].predicted == by_id[401].predicted == 0
    assert tx.toxicity_scores(docs.limit(0), known).count() == 0
    assert {r.score for r in tx.toxicity_scores(docs, known.limit(0)).collect()} == {0.5}


def test_postings_of_a_run_of_blocks_are_summed_without_a_loop_over_words(monkeypatch):
    monkeypatch.setattr(tx, "BLOCK", 16)
    texts, labels = sample(500, 6)
    index, place = built(texts, labels, np.arange(500), 500)
    where, weight = index.vector(*tx.counted(" ".join(FINE[:30]), place))
    shared = index.common[where] >= 0
    row, weight = index.common[where][shared], weight[shared]
    base = np.zeros(index.most.shape[1] * 16)
    dense = base.copy()
    for w, word in zip(weight, np.array(where)[shared]):
        at = slice(index.starts[word], index.starts[word + 1])
        dense[index.examples[at]] += w * index.weights[at]

    def no_loop(*_):
        raise AssertionError("a step for every word")

    monkeypatch.setattr(tx, "zip", no_loop, raising=False)
    for low, high in ((0, 1), (3, 9), (0, index.most.shape[1])):
        at, cosine = index._best(base, row, weight, low, high, 5, -1)
        part = np.round(dense[low * 16 : high * 16], 12)
        assert cosine.tolist() == sorted(part.tolist(), reverse=True)[:5] and (part[at - low * 16] == cosine).all()
