import hashlib
import random

import pytest

from arborlake.llm import sentence_pieces as sp

sentencepiece = pytest.importorskip("sentencepiece")

LETTERS = list("abc  \n\t▁eéèßü漢字😀$.,'<s>/\x00\x7f´ﬁＡñ") + ["the ", "ing", "  ", "Hello"]
MAPPED = list("abcÀ  \n\t▁eéèßü漢字😀　\xa0¨ﬁＡｶﾞé가㍿½ﷺ​\xad")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_proto=sp.read_model(sp.MODEL))


@pytest.fixture(scope="module")
def encoder():
    return sp.PieceEncoder(sp.read_model(sp.MODEL))


def spelled(letters, rounds, longest, seed):
    draw = random.Random(seed)
    return ["".join(draw.choices(letters, k=draw.randint(0, longest))) for _ in range(rounds)]


def assert_same(encoder, library, text):
    ids, starts, ends = encoder(text)
    want = library.encode(text, return_type="proto").pieces
    assert list(zip(ids.tolist(), starts.tolist(), ends.tolist())) == [(p.id, p.begin, p.end) for p in want], text


def test_ids_and_spans_equal_the_library(encoder, library):
    for text in spelled(LETTERS, 600, 40, 1):
        assert_same(encoder, library, text)


def test_long_chunks_and_long_texts(encoder, library):
    draw = random.Random(2)
    for text in ("".join(draw.choices("abeinrst", k=5000)), " " * 3000, "漢" * 2000, "ab" * 40 + "é" * 100, "the cat sat. " * 100_000):
        assert encoder(text)[0].tolist() == library.encode(text)
    assert len("the cat sat. " * 100_000) > 1_000_000


def test_short_and_long_merging_agree(encoder):
    for text in spelled(list("abeinrst'.thing"), 300, 60, 3):
        assert encoder._short(list(text)) == encoder._long(list(text))


@pytest.mark.parametrize("rule", ["nmt_nfkc", "nfkc_cf", "identity"])
@pytest.mark.parametrize("options", [{}, {"remove_extra_whitespaces": True}, {"add_dummy_prefix": False, "escape_whitespaces": False}])
def test_character_map_and_alignment_equal_the_library(rule, options):
    normalizer = sentencepiece.SentencePieceNormalizer(rule_name=rule, **options)
    own = sp.Normalizer(normalizer.serialized_normalizer_spec())
    for text in spelled(MAPPED, 400, 14, 4):
        data, source = own(text)
        want, offsets = normalizer.normalize(text, with_offsets=True)
        assert data.decode() == want, text
        at = [0]
        for c in want:
            at.append(at[-1] + len(c.encode()))
        assert [len(text.encode()[: source[i]].decode()) for i in at] == list(offsets), text


def test_models_that_cannot_be_read():
    with pytest.raises(ValueError):
        sp.PieceEncoder(b"")


def test_digests(spark, library):
    texts = ["the  cat\n", None, "", "the  cat\n", "x" * 1_200_000, "Ça   va 😀\x00 ▁ ", "a\tb"]
    docs = [(i // 2, t, "clash", 7) for i, t in enumerate(texts)] + [(None, "no id", None, None)]
    documents = spark.createDataFrame(docs, "doc_id long, text string, ids string, decoded int")
    rows = sp.piece_digests(documents).collect()

    def sha(text):
        return hashlib.sha256(text.encode()).hexdigest()

    def plain(key, text):
        ids = library.encode(text or "")
        return key, len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids)), len((text or "").encode())

    order = lambda r: tuple(map(str, r))
    assert sorted(map(tuple, rows), key=order) == sorted((plain(d[0], d[1]) for d in docs), key=order)
    assert sp.piece_digests(documents.limit(0)).collect() == []


def test_spans_cover_the_text(spark):
    text = "Zoë said: 漢字 😀!\n\nok"
    documents = spark.createDataFrame([(1, text)], "doc_id long, text string")
    row = sp.encode_pieces(documents).collect()[0]
    data = text.encode()
    assert b"".join(data[a:b] for a, b in zip(row.starts, row.ends)) == data
    assert sp.decode_pieces(sp.encode_pieces(documents)).collect()[0].decoded == text
