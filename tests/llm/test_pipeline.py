from collections import Counter

import numpy as np
import pytest

import __spark_entry__ as driver
import corpus_pipeline as cp
from arborlake.llm import simhash
from tests.llm.test_simhash import plain_components, plain_print
from tests.llm.test_suffixes import plain_digests

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Good and bad documents in two languages with planted copies, near copies and a shared passage."""
    rng = np.random.default_rng(8)
    words = {"xa": [f"{a}{b}" for a in "bcdfgh" for b in ("ane", "olo", "ist", "urm")], "yb": [f"{a}{b}" for a in "klmnpr" for b in ("ür", "ät", "önn", "ei")]}
    passage = " ".join(rng.choice(words["xa"], 60))
    docs, labels = [], []
    for i in range(360):
        lang = "xa" if i % 3 else "yb"
        text = " ".join(rng.choice(words[lang], rng.integers(20, 90)))
        if i % 12 == 5:
            text = text[:150] + " " + passage + " " + text[150:]
        good = i % 5 != 0
        docs.append((i, text if good else text.upper().replace(" ", "!! "), lang if i % 7 else None, f"s{i % 4}"))
        labels.append((i, int(good), 0))
    docs += [(1000 + i, docs[i + 1][1], "xa", "s0") for i in range(0, 40, 4)]
    docs += [(2000, None, None, "s0"), (2001, "", "xa", None)]
    folder = str(tmp_path_factory.mktemp("corpus"))
    frame = spark.createDataFrame([(*d, len(d[1] or "")) for d in docs], "doc_id long, text string, lang string, source string, n_chars long")
    frame.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder


def test_stages_do_what_they_say(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    stages = dict(cp.STAGES)
    good = stages["quality"](spark, docs, tables)
    kept = {r.doc_id for r in good.collect()}
    assert good.columns == COLUMNS
    wrong = [i for i in range(360) if (i in kept) != (i % 5 != 0)]
    assert len(wrong) <= 4

    single = stages["near_copies"](spark, good, tables)
    rows = {r.doc_id: r.text for r in good.collect()}
    component = plain_components(list(rows), [plain_print(t) for t in rows.values()])
    assert single.columns == COLUMNS
    assert {r.doc_id for r in single.collect()} == {i for i, c in component.items() if i == c}

    cut = stages["repeats"](spark, single, tables)
    want = plain_digests([(r.doc_id, r.text) for r in single.collect()])
    assert cut.columns == COLUMNS
    lost = {r.doc_id: want[r.doc_id][0] - len((r.text or "").encode()) for r in cut.collect()}
    assert all(want[i][1] <= n <= want[i][1] + 6 * want[i][2] for i, n in lost.items())  # whole characters go
    assert sum(lost.values()) > 3000

    mixed = stages["mix"](spark, cut, tables)
    assert mixed.columns == COLUMNS
    times = Counter(r.doc_id for r in mixed.collect())
    assert set(times) == {r.doc_id for r in cut.collect()}
    rare, common = (np.mean([n for i, n in times.items() if i < 360 and (i % 3 == 0) == want]) for want in (True, False))
    assert rare > common

    packed = stages["packing"](spark, mixed, tables).collect()
    pieces = Counter(r.doc_id for r in packed if r.start == 0)
    assert pieces == times


def test_run_is_all_stages_in_order(spark, tables):
    assert [name for name, _ in cp.STAGES] == ["quality", "near_copies", "repeats", "mix", "packing"]
    out = cp.run(spark, tables)
    rows = out.collect()
    assert rows and {r.doc_id for r in rows} <= set(range(3000))
    assert "pipeline" in driver.queries()


def test_empty_documents(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert cp.run(spark, str(tmp_path)).count() == 0


def test_largest_group_is_kept_once(spark):
    text = "one of very many equal copies of this short text"
    docs = spark.createDataFrame([(i, text) for i in range(5, 2005)], "doc_id long, text string")
    assert [r.doc_id for r in simhash.keep_first_copies(docs).collect()] == [5]
