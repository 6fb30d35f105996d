import itertools
import re

from arborlake.llm import filter_audit as fa

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
LETTERS = "ABCDE"


def plain_fails(docs):
    first = {}
    for key, text, _ in docs:
        if key is not None:
            first[text or ""] = min(key, first.get(text or "", key))
    rows = []
    for key, text, source in docs:
        text = text or ""
        words = WORDS.findall(text)
        rows.append((key, source or "", {
            c for c, bad in zip(LETTERS, (
                len(words) < 200,
                100 * len(set(words)) < 50 * len(words),
                100 * len(re.findall("[A-Z]", text)) > 2 * len(text),
                bool(re.search(r"[#$%&*|]", text)),
                key is not None and key > first[text],
            )) if bad
        }))
    return rows


def plain_audit(docs, labels):
    good = {k for k, q, _ in labels if q == 1}
    toxic = {k for k, _, t in labels if t == 1}
    rows, out = plain_fails(docs), []
    for part in {p for _, p, _ in rows}:
        own = [(k, f) for k, p, f in rows if p == part]
        total = dict.fromkeys(LETTERS, 0)
        steps = []
        for order in itertools.permutations(LETTERS):
            for i, letter in enumerate(order):
                alive = [(k, f) for k, f in own if not f & set(order[:i])]
                removed = [k for k, f in alive if letter in f]
                total[letter] += len(removed)
                steps.append((
                    part, "".join(order), i + 1, len(alive) - len(removed), len(removed),
                    sum(letter in f for _, f in own) - len(removed), sum(f == {letter} for _, f in own),
                    sum(k in good for k in removed), sum(k in toxic for k in removed),
                ))
        out += [(*s, total[s[1][s[2] - 1]]) for s in steps]
    return sorted(out)


def audited(spark, docs, labels):
    documents = spark.createDataFrame(docs, "doc_id long, text string, source string").selectExpr("*", "1 as mask", "'x' as part", "2 as good")
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    return sorted(map(tuple, fa.filter_audit(documents, marks).collect()))


LONG = " ".join(f"w{i}" for i in range(250))
DOCS = [
    (1, LONG, "a"), (2, LONG, "b"), (3, LONG, "a"), (3, LONG, "a"), (None, LONG, "a"),  # copies, one row twice, one without id
    (4, " ".join(["same"] * 250), "a"), (5, LONG.upper(), None), (6, LONG + " #", ""),
    (7, None, "b"), (8, "", "b"), (9, "few Words & more", "b"), (-1, "few Words & more", "c"),
    (10, "x\x0by\tz\r\n\x0c  z", "c"), (11, "ÄÖÜ é é", "c"), (12, LONG * 400, "a"),
]
LABELS = [(3, 1, 0), (3, 0, 1), (4, 1, None), (5, None, 1), (9, 1, 1), (None, 1, 1), (99, 1, 1)]


def test_equals_filtering_in_every_order(spark):
    assert audited(spark, DOCS, LABELS) == plain_audit(DOCS, LABELS)


def test_conditions_at_their_bounds(spark):
    words = [f"w{i}" for i in range(100)]
    texts = [" ".join(words * 2), " ".join([*words * 2, "w0"]), " ".join([*words, *words][:199]), "A" + "b" * 49, "AA" + "b" * 98, "AA" + "b" * 97]
    docs = [(i, t, "s") for i, t in enumerate(texts)]
    rows = spark.createDataFrame([(t,) for t in texts], "text string")
    found = [{c for c in "ABCD" if r[c]} for r in rows.select(*(f.alias(c) for c, f in fa.text_failures(rows.text).items())).collect()]
    assert found == [f - {"E"} for _, _, f in plain_fails(docs)] == [set(), {"B"}, {"A"}, {"A"}, {"A"}, {"A", "C"}]


def test_empty_table(spark):
    assert audited(spark, [], LABELS) == []


def test_other_filters(spark):
    rows = spark.createDataFrame([("p", m, 1, 0) for m in (0, 1, 2, 3, 3)], "part string, mask int, good int, toxic int")
    found = {(r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.shapley) for r in fa.interactions(rows, "XY").collect()}
    assert found == {("XY", 1): (2, 3, 0, 1, 4), ("XY", 2): (1, 1, 2, 1, 4), ("YX", 1): (2, 3, 0, 1, 4), ("YX", 2): (1, 1, 2, 1, 4)}
