"""Encoding by tree reduction equals the library's, and decodes to the text."""

from __future__ import annotations

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer as Library

from studyloom.llm.tokens import TOKENIZERS, Tokenizer, decode_texts, encode_texts, token_count

PIECES = ["a", "ab", "the", " ", "  ", "\n", "\t", "1", "23", "!", "...", "й", "слово", "é", "😀", "'s", "'ll", "'l", " ", "\r\n", "<|endoftext|>", "—", "́"]


@pytest.fixture(scope="module")
def library():
    t = Library.from_file(f"{TOKENIZERS}/byte_bpe_50k.json")
    t.encode_special_tokens = True
    return t


@pytest.fixture(scope="module")
def tiny():
    return Tokenizer(leaf=7, long_word=5, window=4)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=60))
def test_any_text(library, tiny, pieces):
    text = "".join(pieces)
    ids = [int(i) for i in tiny.encode(text)]
    assert ids == library.encode(text, add_special_tokens=False).ids
    assert tiny.decode(ids) == text


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="abcdehilnorst", max_size=300))
def test_long_words(library, tiny, text):
    assert [int(i) for i in tiny.encode(text)] == library.encode(text, add_special_tokens=False).ids


def test_very_long_words_are_fast_and_exact():
    t = Tokenizer()
    rng = random.Random(1)
    for text in ("a" * 400_000, "ab" * 100_000, " " * 100_000 + "x", "".join(rng.choice("abcdefgh") for _ in range(100_000))):
        assert list(t.encode(text)) == t.library.encode_ordinary(text)


def test_nulls_empty_texts_and_repeats(spark):
    df = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, "Привет, мир", "x"), (3, "Привет, мир", "x"), (None, " ", None)], "doc_id long, text string, ids string")
    rows = encode_texts(df, "doc_id", "text").collect()
    got = sorted(((r.doc_id, r.ids) for r in rows), key=str)
    assert [r for r in got if r[0] in (1, 2)] == [(1, []), (2, [])]
    assert sum(1 for r in got if r[0] == 3) == 2 and len(got) == 5
    back = {r.doc_id: r.text for r in decode_texts(encode_texts(df, "doc_id", "text"), "doc_id", "ids").collect()}
    assert back[3] == "Привет, мир" and back[1] == ""
    counts = {r.doc_id: r.n for r in df.select("doc_id", token_count(df.text).alias("n")).collect()}
    assert counts[1] == 0 and counts[3] == len([r for r in got if r[0] == 3][0][1])
    assert encode_texts(df.where("false"), "doc_id", "text").collect() == []


def test_documents_are_joined_up_the_tree(spark):
    t, texts = Tokenizer(), [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect() if r.text]
    joined = 0
    for text in texts:
        before = t.joins
        assert list(t.encode(text)) == t.library.encode_ordinary(text)
        joined += t.joins > before
    assert joined > len(texts) / 2
