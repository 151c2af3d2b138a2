"""SentencePiece encoding with source ranges: equal to the library, for the given model and for models with a character map."""

import hashlib
import random

import public_tokenizers
import pytest
import sentencepiece
from sentencepiece import sentencepiece_model_pb2 as proto

from linkloom.llm import piece_codec, queries

ODD = [None, "", " ", "  a  b ", "▁x ▁", "a\0b", "日本語 テスト😀", "á é ﬁ ½ Ⅷ ｱｲｳ ", "<s> </s> <unk> <0x41>", "\t\n x", "x" * 900, "　全　角　", "​﻿a ", " ▁", "́́"]


def some(n, seed=5):
    r = random.Random(seed)
    return ODD + ["".join(r.choice(" ▁aéﬁ́日😀\n<s>½　xyz") for _ in range(r.randint(1, 40))) for _ in range(n)]


@pytest.fixture(scope="module")
def model():
    with open(public_tokenizers.path(piece_codec.MODEL), "rb") as f:
        return f.read()


def changed(model, rule, extra, dummy, **kinds):
    m = proto.ModelProto.FromString(model)
    spec = proto.NormalizerSpec.FromString(sentencepiece.SentencePieceNormalizer(rule_name=rule).serialized_normalizer_spec())
    spec.add_dummy_prefix, spec.remove_extra_whitespaces, spec.escape_whitespaces = dummy, extra, True
    m.normalizer_spec.CopyFrom(spec)
    for p in m.pieces:
        if p.piece in kinds.get("kept", ()):
            p.type = proto.ModelProto.SentencePiece.USER_DEFINED
        if p.type == proto.ModelProto.SentencePiece.BYTE and kinds.get("no_bytes"):
            p.type = proto.ModelProto.SentencePiece.NORMAL
    if kinds.get("no_bytes"):
        m.trainer_spec.byte_fallback = False
    return m.SerializeToString()


def same_as_library(model, texts):
    own, library = piece_codec.PieceCodec(model), sentencepiece.SentencePieceProcessor(model_proto=model)
    texts = [t or "" for t in texts]
    for text, (ids, begins, ends) in zip(texts, own.encode(texts), strict=True):
        want = library.encode(text, return_type="proto").pieces
        assert list(zip(ids, begins, ends, strict=True)) == [(p.id, p.begin, p.end) for p in want], text
        assert own.decode(ids) == library.decode([p.id for p in want])


@pytest.mark.parametrize(("rule", "extra", "dummy"), [("identity", False, True), ("identity", True, True), ("nmt_nfkc", True, True), ("nfkc", False, False), ("nmt_nfkc_cf", True, False)])
def test_ids_and_ranges_equal_the_library(model, rule, extra, dummy):
    same_as_library(changed(model, rule, extra, dummy), some(400))


def test_symbols_that_stay_whole_and_unknown_characters(model):
    same_as_library(changed(model, "nmt_nfkc", True, True, kept=("the", "é")), [*some(200), "thethe é thé", "éthe"])
    same_as_library(changed(model, "identity", False, True, no_bytes=True), some(200))


def test_longest_prefix_wins(model):
    own = piece_codec.PieceCodec(changed(model, "nfkc", False, False))
    shown, places = own.normalise("xa\u0301\u00bd")
    assert (shown, places.tolist()) == ("x\u00e11\u20442", [0, 1, 1, 4, 4, 4, 4, 4, 6])


def test_long_texts_decode_in_parts(model, monkeypatch):
    own = piece_codec.PieceCodec(model)
    text = " ".join(t or "" for t in some(300))
    ids = own.encode([text])[0][0]
    monkeypatch.setattr(piece_codec, "DECODE_IDS", 50)
    assert own.decode(ids) == own.whole.decode(ids.tolist())


def test_memory_of_chunks_is_bounded(model, monkeypatch):
    monkeypatch.setattr(piece_codec, "MEMORY_CHUNKS", 10)
    own = piece_codec.PieceCodec(model)
    for text in filter(None, some(50)):
        assert own.encode([text])[0][0].tolist() == own.whole.encode(text)


def test_operator(spark, model):
    texts = some(60)
    rows = [(None if k == 3 else k // 2, t, "x") for k, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string").repartition(3)
    library = sentencepiece.SentencePieceProcessor(model_proto=model)
    found = piece_codec.encode_pieces(docs)
    assert found.columns == ["doc_id", "ids", "begins", "ends", "decoded"]
    want = sorted((-1 if i is None else i, library.encode(t or ""), library.decode(library.encode(t or ""))) for i, t, _ in rows)
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.ids, r.decoded) for r in found.collect()) == want
    assert piece_codec.encode_pieces(docs.limit(0)).count() == 0


def test_query_equals_the_library(spark, model, sf_dir):
    library = sentencepiece.SentencePieceProcessor(model_proto=model)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    ids = {d.doc_id: library.encode(d.text or "") for d in docs}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in queries.QUERIES["op12_piece_codec"](spark, sf_dir).collect()}
    assert got == {i: (len(v), sha(",".join(map(str, v))), sha(library.decode(v))) for i, v in ids.items()}
