"""Encoding by distinct chunks against the library itself."""

import hashlib

import public_tokenizers
import pytest
import sentencepiece

from corpusmill.llm import sentencepiece_ids as pieces

ODD = [None, "", " ", "  ", "▁", "▁a▁▁b", "a\tb\n c", "\x00", "😀" * 300, "x" * 20000, "a  b   c    ", "<s> </s> <unk> <0x41>", "ﬁ é é　z", " lead", "trail ", "\n\n \n", "a b"]


@pytest.fixture(scope="module")
def model():
    with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as f:
        return f.read()


@pytest.fixture(scope="module")
def library(model):
    return sentencepiece.SentencePieceProcessor(model_proto=model)


@pytest.mark.parametrize("limit", [0, 60, 1 << 20])
def test_odd_texts(spark, model, library, limit):
    """Without a dictionary, with a small one and with all repeated chunks in it; repeated rows, clashing columns."""
    docs = spark.createDataFrame([(i % 5, t, "q", [1]) for i, t in enumerate(ODD * 2)], "doc_id int, text string, _RARE string, ids array<int>")
    got = sorted((tuple(r["ids"]), r["decoded"]) for r in pieces.decode(pieces.encode(docs, model, limit), model).collect())
    assert got == sorted((tuple(library.encode(t or "")), library.decode(library.encode(t or ""))) for t in ODD * 2)
    assert sorted((tuple(r["ids"]), r["decoded"]) for r in pieces.encode(docs, model, limit, decoded=True).collect()) == got
    assert pieces.encode(docs.limit(0), model).count() == 0


@pytest.mark.parametrize("limit", [20_000, pieces.DICTIONARY_BYTES])
def test_whole_table(spark, model, library, limit):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = {r["doc_id"]: r["ids"] for r in pieces.encode(docs, model, limit).collect()}
    assert got == {r["doc_id"]: library.encode(r["text"] or "") for r in docs.collect()}


def test_digests(spark, model, library):
    docs = spark.createDataFrame([(7, "Hé  there"), (8, None)], "doc_id long, text string")
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    ids = library.encode("Hé  there")
    assert sorted(map(tuple, pieces.encoding_digests(docs, model).collect())) == [(7, len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids))), (8, 0, sha(""), sha(""))]


def test_refuses_other_models(model, monkeypatch):
    class Crossing:
        normalize = staticmethod(lambda text: pieces.MARK + text.replace(" ", pieces.MARK))
        get_piece_size = staticmethod(lambda: 1)
        id_to_piece = staticmethod(lambda i: "of▁the")

    monkeypatch.setattr(pieces, "processor", lambda _: Crossing)
    with pytest.raises(ValueError, match="cross"):
        pieces.check_model(model)
    monkeypatch.setattr(Crossing, "normalize", staticmethod(str.lower))
    with pytest.raises(ValueError, match="changes"):
        pieces.check_model(model)
