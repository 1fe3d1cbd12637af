"""Encoding and decoding against the tokenizers library."""

from __future__ import annotations

import hashlib
import json
import random
from array import array

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from barloom.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)
MINE = bpe.ForcedBoundaryBPE(PATH, most=500)
ODD = ["", " ", "\n\n a", "a\n\n\nb  c", "x's 't it'll 've", "a  b　　c   d", "\x1c \x1f\x85 z", "x" * 5000, "ab" * 3000, "中文 文 € €1 ٣٤ \U0001f600\U0001f600 ‍",
       "<|endoftext|>", "a <|endoftext|>b<|endoftext|><|endoftext|>", "<|endof", " " * 300 + "x" + "\t" * 70, "\r\n\r\n \r\n\x0b\x0c x", "a  b  c᠎ d﻿ e", "\u0085 \u0085x", "ჼ Ⅰ ½ a1b2"]


def same(text):
    ids = MINE.encode(text)
    want = LIBRARY.encode(text, add_special_tokens=False).ids
    assert array("I", ids).tolist() == want
    assert MINE.decode(ids) == LIBRARY.decode(want, skip_special_tokens=False)


@pytest.mark.parametrize("text", ODD)
def test_odd_texts(text):
    same(text)


@settings(max_examples=400, deadline=None)
@given(st.text(st.one_of(st.characters(exclude_categories=["Cs"]), st.sampled_from(" \n\t\r  　'sreabc1"))))
def test_any_text(text):
    same(text)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 50256), max_size=12))
def test_any_ids(ids):
    assert MINE.decode(array("I", ids).tobytes()) == LIBRARY.decode(ids, skip_special_tokens=False)


def test_many_texts():
    """Slices of texts, long runs by the heap, and a memory that starts again."""
    rng = random.Random(2)
    texts = ["".join(rng.choices("ab  é\n'.x1中", k=rng.randrange(400))) for _ in range(300)] + ["".join(rng.choices("ab", k=700)), *ODD]
    want = [LIBRARY.encode(t, add_special_tokens=False).ids for t in texts]
    assert [array("I", x).tolist() for x in MINE.encode_all(texts, slice_bytes=900)] == want
    assert len(MINE.known) < 3000


def test_cuts_are_forced():
    """No token of a text reaches over a cut, and cuts are many."""
    rng = random.Random(1)
    text = " ".join("".join(rng.choices("etaoinshéñ.,", k=rng.randrange(1, 12))) for _ in range(500))
    ends, at = set(), 0
    for i in LIBRARY.encode(text).ids:
        at += len(MINE.tokens[i])
        ends.add(at)
    cut = MINE.cuts([text.encode()])[0]
    assert set(cut[1:]) <= ends and len(cut) > 490


@pytest.mark.parametrize("name", ["edge", "docs", "empty"])
def test_tables(request, name):
    table = request.getfixturevalue(name)
    got = sorted(map(tuple, bpe.decode_ids(bpe.encode_texts(table, PATH), PATH).select("doc_id", "n_tokens", "ids_sha256", "decoded").collect()), key=str)
    want = []
    for r in table.select("doc_id", "text").collect():
        ids = LIBRARY.encode(r.text or "", add_special_tokens=False).ids
        want.append((r.doc_id, len(ids), hashlib.sha256(array("I", ids).tobytes()).hexdigest(), LIBRARY.decode(ids, skip_special_tokens=False)))
    assert got == sorted(want, key=str)


def test_query(spark, small):
    out = bpe.op13_bpe(spark, small)
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    assert all(r.decoded_sha256 == hashlib.sha256((texts[r.doc_id] or "").encode()).hexdigest() for r in out.collect())


def test_errors(spark, tmp_path):
    with open(PATH, encoding="utf-8") as f:
        spec = json.load(f)
    for change in ({"normalizer": {"type": "NFC"}}, {"pre_tokenizer": {"type": "Whitespace"}}, {"pre_tokenizer": spec["pre_tokenizer"] | {"add_prefix_space": True}}, {"added_tokens": [spec["added_tokens"][0] | {"lstrip": True}]}):
        other = tmp_path / "other.json"
        other.write_text(json.dumps(spec | change))
        with pytest.raises(ValueError):
            bpe.ForcedBoundaryBPE(str(other))
    with pytest.raises(ValueError):
        bpe.decode_ids(spark.createDataFrame([(b"", "x")], "ids binary, decoded string"), PATH)
