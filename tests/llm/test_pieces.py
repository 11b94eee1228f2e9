"""Piece encoding against the sentencepiece library: ids, spans, decoded texts, character maps and edge cases."""

import hashlib
import random

import numpy as np
import pytest
import sentencepiece
from sentencepiece import sentencepiece_model_pb2 as pb2

from terrapix.llm import pieces, queries, tokens

SF = "/root/testdata/sf0.001"
ALPHABET = "ab \t\n  eﬁ①é́　ガÅ ｶﾞ1/2½​\x00▁­한하😀."


@pytest.fixture(scope="module")
def model():
    return pieces.read_model(tokens.public_piece_bpe())


def some_texts(n=400, size=30):
    rnd = random.Random(4)
    return ["".join(rnd.choice(ALPHABET) for _ in range(rnd.randint(0, size))) for _ in range(n)]


def sha(values, kind="<u4"):
    return hashlib.sha256(np.asarray(values, kind).tobytes()).hexdigest()


def test_query_against_the_library(spark, model):
    library = sentencepiece.SentencePieceProcessor(model_proto=model)
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = {r.doc_id: r for r in queries.op13_pieces(spark, SF).collect()}
    assert set(got) == set(docs)
    for k, text in docs.items():
        ids = library.encode(text, add_bos=True, add_eos=True)
        assert (got[k].n_tokens, got[k].ids_sha256) == (len(ids), sha(ids))
        assert got[k].decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()


def test_parts_of_a_long_text_give_the_ids_of_the_whole(model):
    small, whole = pieces.Encoder(model, 7), pieces.Encoder(model, 1 << 30)
    texts = [*some_texts(), *["".join(random.Random(k).choice("ab  .\n") for _ in range(300)) for k in range(200)], "one two  three " * 50]
    assert small.splits and small.ids(texts) == whole.ids(texts) == whole.library.encode(texts)


@pytest.mark.parametrize("squeeze", [True, False])
@pytest.mark.parametrize("front", [True, False])
@pytest.mark.parametrize("rule", ["identity", "nmt_nfkc", "nmt_nfkc_cf"])
def test_spans_through_a_character_map(model, squeeze, front, rule):
    """Maps that the library compiles: the pieces spell the normal form, and spans are those that the library reports."""
    other = sentencepiece.SentencePieceNormalizer(rule_name=rule)
    spec, proto = pb2.ModelProto(), pb2.ModelProto()
    spec.ParseFromString(other.serialized_model_proto())
    proto.ParseFromString(model)
    proto.normalizer_spec.CopyFrom(spec.normalizer_spec)
    proto.normalizer_spec.remove_extra_whitespaces, proto.normalizer_spec.add_dummy_prefix = squeeze, front
    proto.normalizer_spec.escape_whitespaces = True
    encoder = pieces.Encoder(proto.SerializeToString())
    for text in [*some_texts(), "   ", "", " x", "x "]:
        (ids,) = encoder.ids([text])
        starts, stops = encoder.spans(text, ids)
        want = [(p.begin, p.end, p.piece) for p in encoder.library.encode(text, return_type="proto").pieces]
        assert len(want) == len(starts)
        for a, b, (begin, end, piece) in zip(starts.tolist(), stops.tolist(), want, strict=True):
            assert (a, b) == (begin, end) or piece.startswith("<0x")


def test_the_map_is_searched_for_the_longest_key():
    spec = pb2.ModelProto()
    spec.ParseFromString(sentencepiece.SentencePieceNormalizer(rule_name="nmt_nfkc").serialized_model_proto())
    table = pieces.CharacterMap(spec.normalizer_spec.precompiled_charsmap)
    assert table.longest("ｶﾞ".encode(), 0) == (6, "ガ".encode()) and table.longest("ｶ".encode(), 0) == (3, "カ".encode())
    assert table.longest(b"q", 0) is None and "ﬁ".encode() in table.heads()


def test_unknown_characters_without_byte_pieces(model):
    proto = pb2.ModelProto()
    proto.ParseFromString(model)
    proto.trainer_spec.byte_fallback = False
    for p in proto.pieces:
        if p.type == pieces.BYTE:
            p.type = 5  # unused
    encoder = pieces.Encoder(proto.SerializeToString())
    text = "ab ①② c"
    (ids,) = encoder.ids([text])
    starts, stops = encoder.spans(text, ids)
    assert encoder.unknown in ids and starts[0] == 0 and stops[-1] == len(text.encode())


def test_edges(spark, model):
    data = [(1, None), (2, ""), (3, "a b"), (3, "a b"), (None, "é"), ((1 << 62) + 1, "word " * 200_000)]
    docs = spark.createDataFrame([(*r, 7, "x", 1) for r in data], "doc_id long, text string, n_tokens int, key_ string, ids int").repartition(2)
    out = pieces.encode_texts(docs, model)
    rows = out.collect()
    assert sorted((r.doc_id or 0, r.n_tokens) for r in rows)[:5] == [(0, 3), (1, 2), (2, 2), (3, 4), (3, 4)]
    assert max(r.doc_id or 0 for r in rows) == (1 << 62) + 1
    for r in rows:
        text = dict(data)[r.doc_id] or ""
        assert r.ids[0] == 1 and r.ids[-1] == 2 and r.spans_sha256 == sha([*r.starts, *r.stops], "<u8")
        cut = text.encode()
        assert b"".join(cut[a:b] for a, b in zip(r.starts, r.stops, strict=True)) == cut
    decoded = {r.doc_id: r.text for r in pieces.decode_ids(out.select("doc_id", "ids").union(spark.createDataFrame([(9, None)], "doc_id long, ids array<int>")), model).collect()}
    assert decoded[3] == "a b" and decoded[1] == "" and decoded[9] is None and decoded[None] == "é"
    assert pieces.encode_texts(docs.where("false"), model).count() == 0
