"""Encoding and decoding with the piece model, against the sentencepiece library."""

import random
from hashlib import sha256
from struct import pack

import public_tokenizers
import pytest
import sentencepiece

from siftlog.llm.pieces import PieceModel, encode_decode_pieces
from siftlog.llm.queries import QUERIES

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def model():
    return PieceModel(PATH)


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def _texts(library):
    r = random.Random(11)
    shown = [library.id_to_piece(i).replace("▁", " ") for i in range(259, library.get_piece_size())]
    yield from ["", " ", "   ", "▁", "a▁▁b", "\x00", "\n\n a", "\t\tx", "日本 龘龘", "é" * 5, " " * 40, "x" + " " * 37 + "y", "<s> </s> <0x41> <unk>", "​﻿", "a\r\nb", "😀😀 a"]
    signs = "abcdeth   \n.,'▁é日'\t0123()<>/=_"
    for _ in range(4000):
        yield "".join(r.choice(signs) for _ in range(r.randint(1, 60)))
        yield "".join(r.choice(shown) for _ in range(r.randint(1, 12)))
        yield "".join(r.choice(" ab") for _ in range(r.randint(1, 60)))


def test_texts_equal_library(model, library):
    for text in _texts(library):
        want = library.encode(text, add_bos=True, add_eos=True)
        assert model.encode(text) == want, text
        assert model.decode(want) == library.decode(want), text


def test_pairs_equal_merging(model):
    """The walk along the border decides as merging both tokens together does."""
    r = random.Random(5)
    tokens = sorted(model.whole)
    for _ in range(20_000):
        a, b = r.choice(tokens), r.choice(tokens)
        assert model._may_follow(model.id[a] * len(model.text) + model.id[b]) == (model._merged(a + b) == [a, b])


def test_decode_any_ids(model, library):
    """Bytes that form no character, control ids and the unknown id."""
    r = random.Random(6)
    for _ in range(500):
        ids = [r.choice([r.randint(0, 2), r.randint(3, 258), r.randint(259, 31999)]) for _ in range(r.randint(0, 12))]
        assert model.decode(ids) == library.decode(ids), ids


def test_prefix_table(model, library):
    """Every entry is the last token of that prefix's own encoding."""
    word = "▁uncharacteristically"
    table = model.prefix_table(word)
    for i in range(2, len(word) + 1):
        assert table[i - 1] == library.encode(word[1:i])[-1]


def test_long_texts(model, library):
    for text in ("ab" * 30_000, " " * 20_000, "\n" * 20_000, "word " * 20_000, "龘" * 5_000):
        assert model.encode(text, ends=False) == library.encode(text)


def test_tables(spark, library):
    """Nulls, repeated rows, clashing names, an empty table."""
    rows = [(1, "two words", 7), (1, "two words", 7), (None, None, 8), (3, "", 9), (4, "naïve 龘\n", 1)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, n_tokens int")
    got = sorted(map(tuple, encode_decode_pieces(df, PATH, ("n_tokens", "ids", "decoded")).collect()), key=str)
    want = []
    for d, t, _ in rows:
        ids = library.encode(t or "", add_bos=True, add_eos=True)
        want.append((d, len(ids), ids, library.decode(ids)))
    assert got == sorted(want, key=str)
    assert encode_decode_pieces(df.limit(0), PATH).count() == 0
    with pytest.raises(ValueError):
        encode_decode_pieces(df, PATH, ("words",))


def test_query_equals_library(spark, library):
    folder = "/root/testdata/sf0.001"
    got = {x["doc_id"]: x for x in QUERIES["op11_pieces"](spark, folder).collect()}
    docs = spark.read.parquet(f"{folder}/documents.parquet").collect()
    assert len(got) == len(docs)
    for x in docs:
        ids = library.encode(x["text"] or "", add_bos=True, add_eos=True)
        want = (len(ids), sha256(pack(f"<{len(ids)}I", *ids)).hexdigest(), sha256(library.decode(ids).encode()).hexdigest())
        assert tuple(got[x["doc_id"]][c] for c in ("n_tokens", "ids_sha256", "decoded_sha256")) == want
