import numpy as np

from arborlake.llm import language as lg
from arborlake.llm.common import Rolling, is_held_out

SYLLABLES = {"xa": ["ka", "to", "mi"], "yb": ["ôl", "ün", "är"], "zc": ["the", "ing", "ka"]}


def test_grams_are_letters_with_blank_ends():
    rolling = Rolling()
    keys, bounds = lg.grams(["Ab, c9d", "", "é", "12 !", "AB", "abcd dx"], rolling)
    assert np.diff(bounds).tolist() == [3, 0, 1, 0, 1, 3]  # " ab ", " c ", " d " and " é " are whole words; " abcd", "abcd ", " dx "
    assert len(set(keys.tolist())) == 7 and keys[bounds[4]] in keys[:3]
    assert lg.grams([], rolling)[1].tolist() == [0] and lg.grams([""], rolling)[1].tolist() == [0, 0]


def test_filter_returns_all_languages_of_a_gram():
    keys = np.arange(1, 3001, dtype=np.uint64) * np.uint64(7919)
    language = np.arange(3000) % 12
    both = np.concatenate([keys, keys[:1]]), np.concatenate([language, [11]])
    known = lg.LanguageFilter.build([str(i) for i in range(12)], *both)
    hits = known.hits(keys, np.array([0, 3000]))[0]
    assert np.allclose(hits, 250, atol=8)
    one = known.hits(keys[:1], np.array([0, 1]))[0]
    assert one[0] > 0.9 and one[11] > 0.9
    assert lg.LanguageFilter.build([], np.zeros(0, np.uint64), np.zeros(0, np.int64)).predict(["abc"], Rolling())[0] == ["und"]


def test_held_out_accuracy_and_odd_rows(spark):
    rng = np.random.default_rng(3)
    rows = []
    for i in range(300):
        lang = list(SYLLABLES)[i % 3]
        text = " ".join("".join(rng.choice(SYLLABLES[lang], rng.integers(1, 4))) for _ in range(rng.integers(2, 60)))
        rows.append((i, text, lang if i % 10 else None, i))
    rows += [(300, None, "xa", 0), (301, "12 ?!", "xa", 0), (301, "", None, 0), (302, "ka " * 90_000, None, 0), (None, "ôl ün", None, 0), (303, "漢字 語", None, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, lang_pred int")
    got = lg.language_ids(docs).collect()
    assert len(got) == len(rows)
    unseen = [r for r in got if r.doc_id is not None and r.doc_id < 300 and (r.held_out or r.doc_id % 10 == 0)]
    assert np.mean([r.lang_pred == list(SYLLABLES)[r.doc_id % 3] for r in unseen]) > 0.95
    odd = {r.doc_id: (r.lang_pred, r.score) for r in got if r.doc_id in (300, 301, 303)}
    assert odd[300] == odd[301] == ("und", 0.0) and odd[303][0] in SYLLABLES and odd[303][1] == 0.0
    assert all(r.held_out == is_held_out(r.doc_id) and 0 <= r.score <= 1 for r in got)
    unknown = docs.withColumn("lang", docs.lang.substr(9, 1).cast("string")).selectExpr("doc_id", "text", "nullif('a','a') lang")
    assert {r.lang_pred for r in lg.language_ids(unknown).collect()} == {"und"}
    assert lg.language_ids(docs.limit(0)).count() == 0


def test_every_gram_of_the_sample_is_found(spark):
    """However rare: a word that one text of a language has once is known to that language, and to no other."""
    docs = spark.createDataFrame([(i, "kato " * 400 + ("zyxwv" if i == 1 else ""), "xa") for i in range(1, 5)] + [(i, "öl " * 90, "yb") for i in range(5, 9)], "doc_id long, text string, lang string")
    learned = [i for i in range(1, 9) if not is_held_out(i)]
    known, rolling = lg.fit(docs), Rolling()
    hits = known.hits(*lg.grams(["zyxwv"], rolling))[0]
    assert (1 in learned) == (hits[known.names.index("xa")] > 2) and hits[known.names.index("yb")] < 1


def test_ties_go_to_the_language_with_more_rows(spark):
    docs = spark.createDataFrame([(i, "same words here", "xa" if i % 3 else "yb") for i in range(60)], "doc_id long, text string, lang string")
    assert {r.lang_pred for r in lg.language_ids(docs).collect()} == {"xa"}


def test_text_of_a_megabyte(spark):
    docs = spark.createDataFrame([(i, "kato mila ", "xa") for i in range(6)] + [(6, "kato mila " * 120_000, None)], "doc_id long, text string, lang string")
    assert {r.doc_id: r.lang_pred for r in lg.language_ids(docs).collect()}[6] == "xa"
