"""Token ids against the reference tokenizer of the same vocabulary, and exact round trips."""

import os

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from logloom.llm import tokens as t

RANKS = t.default_ranks()
pytestmark = pytest.mark.skipif(not os.path.exists(RANKS), reason="no vocabulary files on this machine")


@pytest.fixture(scope="module")
def other():
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(RANKS.replace(".tiktoken", ".json"))
    tok.encode_special_tokens = True
    return lambda text: tok.encode(text, add_special_tokens=False).ids


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=80))
def test_agrees_and_comes_back(other, text):
    ids = t.encode_text(text, RANKS)
    assert ids == other(text)
    assert t.decode_bytes(ids, RANKS).decode() == text


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from(["word", " ", "  \n", "12", "é", "'s", "…", "汉字", " ", "x1y"]), max_size=60), st.integers(1, 12))
def test_cuts_are_safe(parts, size):
    text = "".join(parts)
    pieces = t.pieces(text, size)
    assert "".join(pieces) == text
    assert [i for p in pieces for i in t.encode_text(p, RANKS)] == t.encode_text(text, RANKS)


def test_long_text_is_whole(other):
    text = "The quick brown fox, 1234 times. " * 9_000
    assert t.encode_text(text, RANKS) == other(text)


def test_corpus(spark):
    rows = [(1, None, "c"), (2, "", "c"), (3, "  ", "c"), (4, "<|endoftext|> is text", "c"), (4, "<|endoftext|> is text", "c"), (5, "汉字", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    out = t.encode_corpus(df, keep=["doc_id"])
    got = sorted((r[0], r[1]) for r in out.collect())
    assert got[0] == (1, []) and got[1] == (2, []) and got[2][1] != []
    assert 50256 not in got[3][1] and got[3] == got[4]
    back = {r["doc_id"]: bytes(r["raw"]).decode() for r in t.decode_corpus(out).collect()}
    assert back[5] == "汉字" and back[1] == "" and back[4] == "<|endoftext|> is text"
    assert t.encode_corpus(df.limit(0), keep=["doc_id"]).collect() == []
