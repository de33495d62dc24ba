"""Encoding and decoding against the library, text by text."""

import hashlib

import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as hs

from spindrift.llm import piece_encoding as pe

PATH = public_tokenizers.path("piece_bpe_32k.model")
LIB = sentencepiece.SentencePieceProcessor(model_file=PATH)
TEXT = hs.text(alphabet=hs.sampled_from("aZ é'sß19.,!-\n\t\r  \x1c\x85\xa0ſİ中́▁<>0xthe in_()\"²»\x00"), max_size=60)


@settings(max_examples=400, deadline=None)
@given(TEXT)
def test_agenda_equals_the_library(text):
    model = pe.PieceModel.at(PATH)
    want = LIB.encode(text, add_eos=True)
    ids, back = pe.encoded(model, text)
    assert list(map(int, ids.split())) == want and back == LIB.decode(want) == pe.decoded(model, want)
    model.memo.settle()


def test_one_part_without_a_cut():
    model = pe.PieceModel.at(PATH)
    text = "abcdeéf" * 3000
    assert model.agenda(pe.META + text) == LIB.encode(text)


def test_the_check_finds_a_wrong_id():
    model = pe.PieceModel.at(PATH)
    model.check({"▁the": model.agenda("▁the"), "ing": model.agenda("ing"), "▁": model.agenda("▁")})
    with pytest.raises(ValueError):
        model.check({"▁the": model.agenda("▁the"), "ing": model.agenda("ed")})


def test_digests_and_ids_of_odd_rows(spark, odd, none):
    want = []
    for r in odd.collect():
        ids = LIB.encode(r["text"] or "", add_eos=True)
        sha = [hashlib.sha256(x.encode()).hexdigest() for x in (" ".join(map(str, ids)), LIB.decode(ids))]
        want.append((r["doc_id"], len(ids), *sha))
    got = pe.encode_digest(odd, PATH)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
    whole = pe.encode(odd, PATH).collect()
    assert sorted((r["doc_id"] or 0, len(r["ids"])) for r in whole) == sorted((w[0] or 0, w[1]) for w in want)
    assert all(LIB.decode(r["ids"]) == r["text"] for r in whole)
    assert pe.encode_digest(none, PATH).count() == 0 and pe.encode(none, PATH).count() == 0


def test_whole_small_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = {r["doc_id"]: r["ids"] for r in pe.encode(docs, PATH).collect()}
    assert got == {r["doc_id"]: LIB.encode(r["text"] or "", add_eos=True) for r in docs.collect()}
