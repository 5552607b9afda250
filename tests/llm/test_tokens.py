"""Counts against the vocabulary's own library."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from conftest import SF_SMALL
from tabflaw.llm import tokens

P = pytest.importorskip("public_tokenizers")
PATH = P.path("byte_bpe_50k.json")
EDGES = ["", " ", "a<|endoftext|>b", "<|endoftext|>", "<|endoftext|><|endoftext|> x", "it's  \n\n x\x1c\x1d \x85 　 ٣٤² Ⅷ 日本語 😀😀 ​­",
         "x" * 5000, "ab" * 3000 + " " * 400, "I'LL we'll 'S", "\x00\x01", "é" * 300]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer
    return Tokenizer.from_file(PATH)


def test_edges_like_the_library(library):
    c = tokens.counter(PATH)
    assert [c.count(t) for t in EDGES] == [len(library.encode(t, add_special_tokens=False).ids) for t in EDGES]


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60))
def test_any_text_like_the_library(text):
    from tokenizers import Tokenizer
    global _LIB
    _LIB = globals().get("_LIB") or Tokenizer.from_file(PATH)
    assert tokens.counter(PATH).count(text) == len(_LIB.encode(text, add_special_tokens=False).ids)


def test_a_full_table_and_long_texts_change_nothing(library, monkeypatch):
    monkeypatch.setattr(tokens, "CACHED", 5)
    monkeypatch.setattr(tokens, "WHOLE", 50)
    c = tokens.Counter(tokens.counter(PATH).ranks, ["<|endoftext|>"])
    text = "the quick brown fox, jumps over 12 lazy dogs' tails; " * 20
    assert c.count(text) == len(library.encode(text, add_special_tokens=False).ids) and len(c) <= 5


def test_documents_like_the_library(prepared, library):
    d = prepared.read.parquet(f"{SF_SMALL}/documents.parquet")
    got = {r["doc_id"]: r for r in tokens.token_counts(d, PATH, 512).collect()}
    for r in d.collect():
        n = len(library.encode(r["text"], add_special_tokens=False).ids)
        g = got[r["doc_id"]]
        assert (g["n_tokens"], g["n_bytes"], g["over_limit"]) == (n, len(r["text"].encode()), n > 512)


def test_nulls_repeats_and_empty_tables(docs, prepared):
    got = sorted(tuple(r) for r in tokens.token_counts(docs([(1, None), (2, ""), (3, "a b"), (3, "a b")]).withColumn(
        "n_tokens", F.lit(9)), PATH, 1).collect())
    assert got == [(1, 0, 0, False), (2, 0, 0, False), (3, 3, 2, True), (3, 3, 2, True)]
    assert tokens.token_counts(docs([(1, "x")]).filter("doc_id < 0"), PATH, 1).count() == 0
