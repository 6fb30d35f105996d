import hashlib
import re

from pyspark.sql import functions as F

from arborlake.llm import merkle as mk


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_root(text):
    return sha(",".join(sha(",".join(sha(p) for p in s.split("\n"))) for s in text.split("\n\n")))


def plain_sketch(text):
    found = re.findall(mk.PIECE.replace(r"\x0B", "\x0b"), text)
    return sorted({hashlib.md5(p.encode()).hexdigest()[: mk.DIGITS] for p in found})[: mk.SKETCH]


def plain_print(text):
    return plain_root(text) + ":" + "".join(plain_sketch(text))


def plain_near(a, b):
    if a == b:
        return 1.0
    x, y = set(plain_sketch(a)), set(plain_sketch(b))
    least = set(sorted(x | y)[: mk.SKETCH])
    return len(least & x & y) / len(least) if least else 0.0


def plain_report(rows):
    order = sorted(((k, t or "") for k, t in rows), key=lambda r: (-(1 << 63) if r[0] is None else r[0], r[1]))
    out = []
    for i, (key, a) in enumerate(order):
        c = order[(i + 1) % len(order)][1]
        half = len(a) // 2
        b = a[: len(a) - half] + c[:half]
        out.append((key, len(a), sha(b), plain_print(a), plain_print(b), plain_near(a, b), plain_near(a, c)))
    return out


def ordered(rows):
    return sorted(rows, key=lambda r: tuple(map(str, r)))


def check(spark, rows, parts=5):
    docs = spark.createDataFrame([(k, t, 0, "x") for k, t in rows], "doc_id long, text string, range int, key string").repartition(parts)
    got = [tuple(r)[:7] for r in mk.edit_report(docs).collect()]
    assert ordered(got) == ordered(plain_report(rows))


def test_report_matches_the_plain_rule(spark):
    words = "Lorem ipsum dolor sit amet. Consetetur sadipscing elitr, sed diam nonumy eirmod tempor! Ünïcode wörds 漢字\n"
    rows = [(i * i - 50, (words[i % 30 :] + "\n" * (i % 4)) * (i % 17)) for i in range(90)]
    check(spark, rows + [(10_000, None), (10_001, ""), (10_002, " \t"), (10_003, "a"), (10**15, "wide " * 20_000), (10**15, "other"), (None, "no id")])


def test_few_rows(spark):
    check(spark, [(7, "alone\n\nhere")])
    check(spark, [(7, "alone"), (7, "alone"), (3, None)])
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert mk.edit_report(empty).count() == 0 and mk.merkle_trees(empty).count() == 0


def test_ranges_count_bounds(spark):
    bounds = [i * 3 for i in range(200)]
    got = spark.range(-5, 700).select("id", mk.id_range(F.col("id"), bounds).alias("r")).collect()
    assert all(r.r == sum(b <= r.id for b in bounds) for r in got)


def test_differing_branches_locate_edits(spark):
    a = "one\ntwo\n\nthree\nfour\n\nfive"
    b = "one\nTWO\n\nthree\nfour\n\nfive\nsix\n\nseven"
    pair = spark.createDataFrame([(a, b), (a, a)], "a string, b string")
    got = pair.select(mk.differing(mk.sections(F.col("a")), mk.sections(F.col("b"))).alias("d")).collect()
    assert [tuple(x) for x in got[0].d] == [(0, 1), (2, 1), (3, 0)]
    assert got[1].d == []


def test_edits_stay_near_and_strangers_do_not(spark):
    texts = [(i, " ".join(f"w{(i * 7919 + j * j * 31) % 5000}" for j in range(80)) + ".") for i in range(20)]
    rows = mk.edit_report(spark.createDataFrame(texts, "doc_id long, text string")).collect()
    assert all(r.near_edited > 0.25 > 0.05 > r.near_next and r.fingerprint != r.edited_fingerprint for r in rows)


def near(spark, a, b):
    rows = spark.createDataFrame([(1, a), (2, b)], "doc_id long, text string")
    x, y = mk.merkle_trees(rows).orderBy("doc_id").collect()
    assert (x.fingerprint == y.fingerprint) == (a == b)
    return plain_near(a, b)


def test_pieces_stay_in_paragraphs_and_cover_the_text():
    for text in ("one two three four. five\nsix\tseven\n\n eight", "漢字" * 120, "x" * 5000, " " * 100, "a" + " " * 30 + "b", "。。！a\x0bb\r\n"):
        found = re.findall(mk.PIECE.replace(r"\x0B", "\x0b"), text)
        assert "".join(found) == text.replace("\n", "") and max(map(len, found)) <= 96


def test_one_rule_for_all_lengths(spark):
    text = "The river ran high that spring and nobody in the valley slept w"
    assert len(text) == 63 and near(spark, text, text + "x") > 0.6
    han = "".join(chr(0x4E00 + (i * i * 37) % 5000) for i in range(240))
    assert near(spark, han, han[:120] + han[::-1][:120]) > 0.25
    assert near(spark, "", "\n") == 0.0 and near(spark, "", "") == 1.0


def test_rows_without_id_in_number(spark):
    check(spark, [(None, f"text number {i}. " * (i % 5)) for i in range(60)] + [(5, "last")])
