"""SentencePiece encoding and decoding against the library itself."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece

from bandloom.llm import piece_bpe
from bandloom.llm.piece_bpe import op11_sentencepiece

MODEL = public_tokenizers.path(piece_bpe.MODEL)
PARTS = [*"abehint", " ", "  ", "\n", "\t", "▁", "é", "😀", "\x00", "<0x41>", "<unk>", "</s>", "漢", "​", "xxxxx", " " * 20, "ing", "tion", "1", ".", "\r\n", "�", "\U0010ffff", "й"]


@pytest.fixture(scope="module")
def own():
    return piece_bpe.coder(MODEL)


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


def same(own, library, texts):
    ids, at = own.encode_texts(texts)
    for k, (text, want) in enumerate(zip(texts, library.encode(texts), strict=True)):
        assert ids[at[k] : at[k + 1]].tolist() == want, text[:80]
        assert own.decode(ids[at[k] : at[k + 1]]) == library.decode(want), text[:80]


def test_mixed_texts(own, library):
    draw = random.Random(5)
    same(own, library, ["", " ", *("".join(draw.choice(PARTS) for _ in range(draw.randint(0, 60))) for _ in range(3000))])


def test_long_words_and_runs(own, library):
    draw = random.Random(6)
    words = ["".join(draw.choice("ethinaors") for _ in range(draw.randint(1, 400))) for _ in range(300)]
    same(own, library, [*words, *(" " * k for k in range(0, 600, 13)), "ab" * 1000, "x" * 5000, "the" * 2000, " " * 50_000, "x" * 1_200_000])


def test_heap_and_rounds_agree(own, monkeypatch):
    texts = ["".join(random.Random(k).choice("ethinaors ") for _ in range(300)) for k in range(50)]
    want, _ = own.encode_texts(texts)
    monkeypatch.setattr(piece_bpe, "ROUNDS", 1)
    assert np.array_equal(own.encode_texts(texts)[0], want)


def test_decode_of_any_ids(own, library):
    draw = random.Random(7)
    for _ in range(2000):
        ids = [draw.choice([draw.randrange(3), draw.randrange(3, 259), draw.randrange(259, 32000)]) for _ in range(draw.randint(0, 12))]
        assert own.decode(np.array(ids, np.int64)) == library.decode(ids)
    with pytest.raises(ValueError):
        own.decode(np.array([32000]))


def test_operator_on_odd_rows(spark, library):
    rows = [(1, "the text", "x"), (1, "the text", "x"), (2, None, "y"), (3, "", None), (None, "no id", "z"), (4, "long " * 250_000, "w")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, ids string").repartition(3)
    got = sorted(((r.doc_id, r.ids, r.decoded) for r in piece_bpe.encode(df).collect()), key=str)
    want = sorted(((d, library.encode(t or ""), t or "") for d, t, _ in rows), key=str)
    assert got == want
    back = piece_bpe.decode(piece_bpe.encode(df)).collect()
    assert sorted((str(r.doc_id), r.text) for r in back) == sorted((str(d), t or "") for d, t, _ in rows)
    assert piece_bpe.encode(df.where("false")).count() == 0 and piece_bpe.digests(df.where("false")).count() == 0
    assert [r.text for r in piece_bpe.decode(spark.createDataFrame([(1, None)], "doc_id bigint, ids array<int>")).collect()] == [None]


def test_op11_on_the_table(spark, sf_dir, library):
    want = set()
    for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect():
        ids = library.encode(r.text or "")
        want.add((r.doc_id, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest()))
    got = op11_sentencepiece(spark, sf_dir).collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want)
