"""Redaction, markdown, rule binding, explanation, registry and patterns."""

import json
import re

import pytest

from logloom import registry
from logloom.functions import patterns, redact
from logloom.operators import binder, explain
from logloom.sources.sessions import since_stamp

TOKEN = "gh" + "p_" + "a1B2" * 6


@pytest.mark.parametrize(
    ("text", "gone", "kept"),
    [
        (f"use {TOKEN} now", TOKEN, ["use ", " now"]),
        ("client_secret = 'abc def ghi'\nnext", "abc def", ["next"]),
        ("password: hunter2 # x\nnext: y", "hunter2", ["next: y"]),
        ('{"api_key": "v\\"al", "b": 1}', "al", ['"b": 1']),
        ("-----BEGIN RSA PRIVATE KEY-----\nAAAA\n-----END RSA PRIVATE KEY-----\nafter", "AAAA", ["after"]),
        ("-----BEGIN PRIVATE KEY-----\nAAAA and to the end", "AAAA", []),
        ("https://me:pa55@host/x", "pa55", ["https://me:", "@host/x"]),
        ("Authorization: Bearer abcdefgh1234", "abcdefgh1234", ["Authorization: "]),
    ],
)
def test_redact(text, gone, kept):
    out = redact.redact(text)
    assert gone not in out and redact.REDACTED in out and all(k in out for k in kept)
    assert redact.redact(out).count(redact.REDACTED) >= 1


def test_redact_odd():
    assert redact.redact(None) == "" and redact.redact("plain words") == "plain words"
    assert "\\x1b" in redact.shown("a\x1bb")
    redact.redact("password=" * 20_000)
    redact.redact("://" * 60_000)


def test_redact_column(spark):
    df = spark.createDataFrame([(1, f"x {TOKEN}", "c"), (2, None, "c"), (3, "", "c")], "id int, text string, redacted string")
    assert [(r["id"], r["redacted"], r["n_secrets"]) for r in redact.with_redacted(df).orderBy("id").collect()] == [(1, f"x {redact.REDACTED}", 1), (2, "", 0), (3, "", 0)]


MARKDOWN = """intro text
# Testing #
- Run the tests before finishing, e.g. with `pytest`.
- [ ] Never force-push to *main*.
  goes on

```
# not a heading
```
<!-- a
comment -->
## Testing
> quoted
lazy

| a | b |
| - | - |
    code after a table is text
## [Link](http://x) & Co!
Use uv. Unless it fails (see below. really).
"""


def test_markdown():
    kinds = [k for k, _ in binder.line_kinds(MARKDOWN)]
    assert kinds[:12] == ["text", "heading", "text", "text", "text", "blank", "fence", "fence", "fence", "comment", "comment", "heading"]
    assert kinds[12:17] == ["quote", "quote", "blank", "table", "table"]
    found = binder.sections(MARKDOWN)
    assert [s["anchor"] for s in found] == ["testing", "testing-2", "link--co"]
    assert found[0]["heading"] == "Testing" and len(found[0]["paragraphs"]) == 2
    assert binder.normalised("- [x] **Run** [the](u) `tests`  now’s") == "Run the tests now's"
    assert binder.split_sentences("One, e.g. this (a. b) here. Two! Three") == ["One, e.g. this (a. b) here.", "Two!", "Three"]
    assert binder.slug("***") == "section"


def test_binding(spark):
    shapes = [("t/tests", r"run\s+the\s+tests?\b"), ("g/push", r"never\s+force-?push\b"), ("g/any", r"never\s+force")]
    files = {
        "a.md": "# T\nRun the tests. With no exceptions.\n# U\nRun the tests if you like.\n# V\nRun the tests. Docs are exempt.\n# W\nNever force-push.\n# X\nBe kind.\n# Y\n",
        "b.md": "Run the test always.",
        "c.md": None,
    }
    df = spark.createDataFrame(list(files.items()), "path string, text string")
    got = {(r["path"], r["anchor"]): (r["state"], r["detectors"], r["reason"]) for r in binder.bind_rules(df, shapes).collect()}
    assert got == {
        ("a.md", "t"): ("measured", ["t/tests"], ""),
        ("a.md", "u"): ("unmeasured", [], "an exception or a condition"),
        ("a.md", "v"): ("unmeasured", [], "an exception or a condition"),
        ("a.md", "w"): ("unmeasured", [], "several shapes"),
        ("a.md", "x"): ("unmeasured", [], "no shape"),
        ("b.md", ""): ("measured", ["t/tests"], ""),
    }
    assert binder.coverage(binder.bind_rules(df, shapes)).first()["measured"] == 2


def test_explain(spark):
    events = spark.createDataFrame([("r", "s", 1, "i", "tool_use", "Bash", json.dumps({"command": f"echo {TOKEN}"}), 0), ("r", "s", 1, "i", "tool_use", "Bash", "later", 1)], "runtime string, session_id string, turn int, id string, kind string, name string, input string, pos long")
    hits = spark.createDataFrame([("r", "s", "b/x", 1, "i", 0), ("r", "s", "a/x", 1, None, 5), ("r", "t", "a/x", 1, "i", 0)], "runtime string, session_id string, detector string, turn int, tool_use_id string, pos long")
    rows = explain.explain(hits, events, session="r:s").collect()
    assert [(r["detector"], r["key"]) for r in rows] == [("a/x", "1:-"), ("b/x", "1:i")]
    assert TOKEN not in rows[1]["shown"] and "echo" in rows[1]["shown"]
    assert explain.explain(hits, events, detector="b/x", key="1:i").count() == 1


def test_registry():
    r = registry.default()
    n = len(r.ids())
    r.add({"id": "bad"})
    assert len(r.errors) == 1 and len(r.ids()) == n
    r.add({"id": "cache-hygiene/compact", "event": "session", "when": {"kind": "x"}})
    assert len(r.ids()) == n
    r.rename("cache-hygiene/compact", "cache-hygiene/model-switch")
    assert r.get("cache-hygiene/compact").id == "cache-hygiene/model-switch"
    assert registry.fold_map({"a": "b", "b": "c"}) == {"a": "c", "b": "c"}
    with pytest.raises(ValueError):
        registry.fold_map({"a": "b", "b": "a"})
    assert [d.id for d in r.detectors({"verification/no-verify"})] == ["verification/no-verify"]
    r.copy().remove("verification/no-verify")
    assert r.get("verification/no-verify")


@pytest.mark.parametrize(
    ("pattern", "texts"),
    [(r"(?i)\bÄb\b", ["äB c", "xäb"]), (r"a$", ["a", "a\n", "ab"]), (r"(?m)^a$", ["b\na", "ba"]), (r"\Aa\Z", ["a", "a\n"]), (r"(?P<x>a)(?P=x)", ["aa", "ab"]), (r"[[a]", ["[", "b"]), (r"[a&&b]+$", ["&", "c"]), (r"\d\w", ["٣é", "x"]), (r"[]x]", ["]", "y"]), (r"[^]x]", ["]", "y"])],
)
def test_patterns_mean_the_same(spark, pattern, texts):
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    from pyspark.sql import functions as F

    got = [r["m"] for r in df.select(F.col("t").rlike(patterns.java_regex(pattern)).alias("m")).collect()]
    assert got == [re.search(pattern, t) is not None for t in texts]


def test_bad_patterns():
    for bad in ("(", "(?(1)a)", "*"):
        with pytest.raises(patterns.PatternError):
            patterns.java_regex(bad)


def test_since():
    assert since_stamp("2025-01-02T03:00:00Z") == "2025-01-02" and len(since_stamp(3)) == 10
    with pytest.raises(ValueError):
        since_stamp(True)
