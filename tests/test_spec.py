"""The detector language: one hit and one miss for each predicate, three truth values, errors, gates."""

import json

import pytest

from logloom.detectors import LIBRARY
from logloom.operators import measure
from logloom.plans import spec
from logloom.schema import EVENTS


def ev(kind="tool_use", name="Bash", turn=1, text=None, final=None, model=None, tool_id=None, **given):
    return {"runtime": "r", "session_id": "s", "path": "", "kind": kind, "turn": turn, "id": tool_id, "name": name, "input": json.dumps(given), "text": text, "final": final, "model": model}


def bash(c, **k):
    return ev(command=c, **k)


@pytest.fixture(scope="module")
def truth(spark):
    def go(matcher, events):
        rows = [e | {"pos": n} for n, e in enumerate(events)]
        df = measure.parsed_events(spark.createDataFrame(rows, EVENTS))
        return [r["t"] for r in df.select("pos", spec.matcher(matcher).alias("t")).orderBy("pos").collect()]

    return go


CASES = [
    ({"tool": "Bash"}, [bash("x"), ev(name="Read"), ev(kind="compact", name=None)], [True, False, False]),
    ({"tool": {"name": ["Bash", "Read"], "glob": "R*"}}, [bash("x"), ev(name="Read")], [False, True]),
    ({"kind": ["compact"]}, [ev(kind="compact"), ev()], [True, False]),
    ({"arg": {"field": "a.b", "equals": [1, "x"]}}, [ev(a={"b": 1}), ev(a={"b": "1"}), ev(a={"b": True}), ev(a={"b": "x"}), ev(a=3), ev()], [True, False, True, True, False, False]),
    ({"arg": {"field": ["a", "b"], "regex": "^x$"}}, [ev(a="x\n"), ev(b="x"), ev(b="yx"), ev(b=5)], [True, True, False, False]),
    ({"arg": {"field": "f", "path_glob": "src/*.py"}}, [ev(f="/r/src/a.py"), ev(f="/r/src/d/a.py"), ev(f="xsrc/a.py"), ev(f="src/a.py")], [True, False, False, True]),
    ({"arg": {"field": "f", "contains": ["q", "z"]}}, [ev(f="aq"), ev(f="b")], [True, False]),
    ({"arg": {"field": "f", "exists": True}}, [ev(f=0), ev(f=None), ev()], [True, False, False]),
    ({"command": {"starts_with": "cat", "sole_segment": True, "redirect": False, "arg_count": 1}}, [bash("cat a"), bash("cat a b"), bash("cat a | x"), bash("cat a > b"), bash("{ cat a"), bash("'"), ev(name="Read")], [True, False, False, False, None, None, False]),
    ({"command": {"name": "git", "contains": "no-ver", "none_of": ["-q"]}}, [bash("git commit --no-verify"), bash("git commit --no-verify -q"), bash("x; git a no-verx")], [True, False, True]),
    ({"command": {"program": "py(?:test)?", "first_operand": "te.*"}}, [bash("A=1 /bin/pytest -f x tests"), bash("pytest2 tests"), bash("pytest")], [True, False, False]),
    ({"command": {"unparsed": True}}, [bash("echo '"), bash("ls")], [True, False]),
    ({"command": {"regex": "r[mM] -rf"}}, [bash("echo 'rm -rf"), bash("rm -r")], [True, False]),
    ({"command": {"arg_count": {"min": 1, "max": 2}}}, [bash("a"), bash("a b"), bash("a b c d")], [False, True, False]),
    ({"git": {"subcommand": ["push"], "args_any": ["-f"], "args_none": ["-n"], "arg_regex": "^main$"}}, [bash("git push -f origin main"), bash("git push -f -n main"), bash("git push main"), bash("'")], [True, False, False, None]),
    ({"git": {"subcommand": "commit", "message_regex": "^fix"}}, [bash("git commit -m 'fix: a'"), bash('git commit -m "$X"'), bash("git commit"), bash("git commit -m other")], [True, None, False, False]),
    ({"git": {"subcommand": "commit", "config_regex": "^core"}}, [bash("git -c core.x=1 commit"), bash("git -c $Y commit"), bash("git -c a=b commit")], [True, None, False]),
    ({"git": {"subcommand": "commit", "token_prefix": "--am"}}, [bash("git commit --amend"), bash("git commit")], [True, False]),
    ({"env": {"name": "SKIP", "command": "git"}}, [bash("SKIP=1 git push"), bash("SKIP=1 ls"), bash("git push SKIP=1"), bash("'")], [True, False, False, None]),
    ({"text": {"source": "heredocs", "regex": "key"}}, [bash("cat <<E\nkey\nE"), bash("echo key"), bash("'")], [True, False, None]),
    ({"text": {"source": "payload", "contains": "key"}}, [bash("cat <<E\nkey\nE"), bash("echo key"), bash("'key")], [True, False, True]),
    ({"text": {"source": "assistant", "contains": "hi"}}, [ev(kind="assistant_text", text="oh hi"), ev(kind="user_prompt", text="hi"), ev(kind="assistant_text")], [True, False, False]),
    ({"message": {"role": "user", "regex": "a", "contains": "b"}}, [ev(kind="user_prompt", text="ab"), ev(kind="user_prompt", text="a"), ev(kind="assistant_text", text="ab")], [True, False, False]),
    ({"message": {"final": True}}, [ev(kind="assistant_text", final=True), ev(kind="assistant_text", final=False), ev(kind="assistant_text")], [True, False, False]),
    ({"not": {"command": "ls"}}, [bash("ls"), bash("x"), bash("'"), ev(name="Read")], [False, True, None, True]),
    ({"any": [{"command": "ls"}, {"tool": "Bash"}]}, [bash("'")], [True]),
    ({"all": [{"command": "ls"}, {"tool": "Read"}]}, [bash("'")], [False]),
    ({"not": [{"tool": "Read"}, {"command": "ls"}]}, [bash("'"), bash("x")], [None, True]),
]


@pytest.mark.parametrize(("matcher", "events", "want"), CASES, ids=[str(n) for n in range(len(CASES))])
def test_matchers(truth, matcher, events, want):
    assert truth(matcher, events) == want


@pytest.mark.parametrize(
    "bad",
    [
        {}, "x", {"nope": 1}, {"tool": {}}, {"tool": {"x": 1}}, {"arg": {"field": "a"}}, {"arg": {"regex": "x"}}, {"arg": {"field": "a", "regex": "("}}, {"command": {}}, {"command": {"arg_count": True}},
        {"command": {"redirect": "yes"}}, {"git": {}}, {"env": {}}, {"text": {"source": "x", "regex": "y"}}, {"text": {}}, {"message": {"role": "x"}}, {"any": []}, {"all": "x"}, {"order": {"first": {"kind": "x"}, "then": {"kind": "y"}}},
    ],
)
def test_errors(spark, bad):
    with pytest.raises(spec.SpecError):
        spec.matcher(bad)


@pytest.mark.parametrize("bad", [{"id": "x"}, {"id": "a/b"}, {"id": "a/b", "when": {"kind": "x"}, "zzz": 1}, {"id": "a/b", "when": {"kind": "x"}, "event": "y"}, {"id": "a/b", "when": {"kind": "x"}, "schema_version": True}, {"id": "a/b", "when": {"order": {}}, "event": "tool_use"}, {"id": "a/b", "rule": "c/d", "when": {"kind": "x"}}, {"id": "a/b", "event": "session", "when": {"order": {"first": {"kind": "x"}, "then": {"kind": "x"}, "within": 0}}}])
def test_entry_errors(spark, bad):
    with pytest.raises(spec.SpecError):
        spec.compile_detector(bad)


def test_gates(spark):
    d = spec.compile_detector({"id": "a/b", "when": {"kind": "x"}, "gate": {"stance": "mode", "variants": ["fast"]}})
    assert [d.enabled(x) for x in ({"mode": "fast"}, {"mode": "slow"}, {"mode": "off"}, {}, None)] == [True, False, False, False, False]


HITS = [
    ("transcript-hygiene/whole-file-cat", bash("cat a.py"), bash("cat a.py | head")),
    ("transcript-hygiene/unfiltered-find", bash("find ."), bash("find . -name x")),
    ("verification/no-verify", bash("git commit --no-verify -m x"), bash("git commit -m --no")),
    ("verification/no-verify", bash("git -c core.hooksPath=/dev/null push"), bash("git -c core.hooksPath=.hooks push")),
    ("verification/no-verify", bash("SKIP=lint git commit"), bash("SKIP=lint make")),
    ("secrets/secret-in-write", ev(name="Write", content="k = '" + "AKIA" + "ABCDEFGH12345678'"), ev(name="Write", content="AKIA" + "YOURKEYYOURKEYXX")),
    ("git-safety/force-push-default", bash("git push --force origin main"), bash("git push --force origin topic")),
    ("package-manager/pip-install", bash("pip install x"), bash("uv pip install x")),
    ("commits/non-conventional-subject", bash("git commit -m 'did things'"), bash("git commit -m 'fix(a): things'")),
    ("secrets/secret-file-add", bash("git add .env"), bash("git add env.py")),
    ("cache-hygiene/compact", ev(kind="compact"), ev(kind="user_prompt")),
]


def test_library(spark):
    rows = []
    for n, (_, hit, miss) in enumerate(HITS):
        rows += [hit | {"session_id": f"h{n}", "pos": 0}, miss | {"session_id": f"m{n}", "pos": 0}]
    df = measure.parsed_events(spark.createDataFrame(rows, EVENTS))
    found = {(r["session_id"], r["detector"]) for r in measure.find_hits(df, [spec.compile_detector(d) for d in LIBRARY]).collect()}
    for n, (name, _, _) in enumerate(HITS):
        assert (f"h{n}", name) in found, name
        assert (f"m{n}", name) not in found, name
