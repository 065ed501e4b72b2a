"""The structural index against the standard parser, on whole, cut and damaged texts."""

import json

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from logloom.functions import jsontape as j

JSON = st.recursive(st.none() | st.booleans() | st.integers(-(10**9), 10**9) | st.floats(allow_nan=False) | st.text(max_size=8), lambda x: st.lists(x, max_size=3) | st.dictionaries(st.text(max_size=4), x, max_size=3), max_leaves=12)


def readable(text):
    try:
        json.loads(text)
        return True
    except ValueError:
        return False


def tape(texts):
    return j.index(*j.arrow_bytes(pa.array(texts, pa.string())))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(JSON, st.floats(0, 1.5), st.booleans()), min_size=1, max_size=6))
def test_readability_of_cut_texts(values):
    texts = [(d := json.dumps(v, ensure_ascii=a))[: int(len(d) * min(1, cut)) if cut < 1 else len(d)] for v, cut, a in values]
    assert list(tape(texts).readable) == [readable(t) for t in texts]


@settings(max_examples=100, deadline=None)
@given(st.lists(JSON, min_size=1, max_size=5), st.data())
def test_readability_of_damaged_texts(values, data):
    texts = []
    for v in values:
        t = json.dumps(v)
        i = data.draw(st.integers(0, len(t)))
        texts.append(t[:i] + data.draw(st.sampled_from(list('{}[]:,"\\ 1a\n'))) + t[i + data.draw(st.integers(0, 1)) :])
    assert list(tape(texts).readable) == [readable(t) for t in texts]


@settings(max_examples=100, deadline=None)
@given(st.lists(JSON, min_size=1, max_size=4))
def test_values_come_back(values):
    t = tape([json.dumps(v) for v in values])
    roots = [i for i in range(len(t.kind)) if t.value[i] and t.parent[i] < 0]
    assert [t.load(i) for i in roots] == values
    for i in range(len(t.kind)):
        if t.value[i] and t.parent[i] >= 0:
            parent = t.load(t.parent[i])
            assert t.load(i) == (parent[t.place[i]] if isinstance(parent, list) else json.loads(t.raw(t.parent[i]))[t.string(t.key[i])]) or isinstance(parent, dict)


@pytest.mark.parametrize("texts", [[], [""], [None, ""], ["{", "[1]", '"a\\', "{}"], ["[" * 3000 + "]" * 3000, "1"]])
def test_odd_batches(texts):
    assert list(tape(texts).readable) == [readable(t or "") for t in texts]


def test_escaped_and_repeated_keys():
    t = tape(['{"a": 1, "\\u0061": 2, "b": {"a": 3}}'])
    assert [t.load(i) for i in t.keyed("a")] == [2, 3]
