"""Operators whose results no SQL over tables can give, on fixed inputs: the outputs that must come out are the SQL.

Each query runs the library's own operator over all its inputs; its SQL is the table of expected rows.
"""

from __future__ import annotations

import json
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom import detectors
from logloom.functions import redact, shellparse
from logloom.operators import binder, measure
from logloom.plans import spec
from logloom.schema import EVENTS

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _sql(value) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return "TRUE" if value else "FALSE"
    return str(value) if isinstance(value, int) else "'" + value.replace("'", "''") + "'"


def _register(name: str, run: Callable[[SparkSession], DataFrame], columns: str, rows: list[tuple], doc: str) -> None:
    """``columns``: "name TYPE, ..." of the expected ``rows``."""

    def query(spark: SparkSession, sf: str) -> DataFrame:
        return run(spark)

    query.__name__, query.__doc__ = name, doc
    QUERIES[name] = query
    cast = ", ".join(f"CAST({c.split()[0]} AS {c.split()[1]}) AS {c.split()[0]}" for c in columns.split(", "))
    ORACLES[name] = f"SELECT {cast} FROM (VALUES {', '.join('(' + ', '.join(map(_sql, r)) + ')' for r in rows)}) t({', '.join(c.split()[0] for c in columns.split(', '))})"


def _event(given, **more) -> dict:
    base = {"runtime": "r", "session_id": "s", "path": "", "kind": "tool_use", "turn": 1, "id": None, "name": "Bash", "input": json.dumps({"command": given} if isinstance(given, str) else given), "text": None, "final": None, "model": None}
    return base | more


def _events(spark: SparkSession, given: list) -> DataFrame:
    rows = [(e if isinstance(e, dict) and "kind" in e else _event(e)) | {"pos": n} for n, e in enumerate(given)]
    return measure.parsed_events(spark.createDataFrame([{"tool_use_id": None, "tool_name": None} | r for r in rows], EVENTS))


def _matches(name: str, matcher: dict, cases: list[tuple]) -> None:
    """``cases``: (event or command, truth)."""
    run = lambda spark: _events(spark, [e for e, _ in cases]).select(F.col("pos").alias("case_no"), spec.matcher(matcher).alias("truth"))
    _register(name, run, "case_no BIGINT, truth BOOLEAN", [(n, t) for n, (_, t) in enumerate(cases)], f"The truth of the matcher {name} for fixed events.")


_OPEN = "echo 'never closed"  # a command that no parse can be had of
_matches("command_name", {"command": {"name": ["git", "hg"]}}, [("git status", True), ("ls; hg log", True), ("echo git", False), ("/usr/bin/git status", False), (_OPEN, None), (_event({}, name="Read"), False)])
_matches("command_starts_with", {"command": {"starts_with": ["npm", "run"]}}, [("npm run test", True), ("cd a && npm run x", True), ("npm test run", False), ("npm", False), (_OPEN, None)])
_matches("command_contains", {"command": {"contains": ["no-ver"]}}, [("git commit --no-verify", True), ("echo a | tee no-verb", True), ("git commit", False), (_OPEN, None)])
_matches("command_none_of", {"command": {"starts_with": "find", "none_of": ["-name", "-type"]}}, [("find .", True), ("find . -name x", False), ("find -type f", False), ("find . -names", True), (_OPEN, None)])
_matches("command_arg_count", {"command": {"arg_count": {"min": 1, "max": 2}}}, [("cat a", True), ("cat a b", True), ("cat", False), ("cat a b c", False), ("cat -n a", True)])
_matches("command_program", {"command": {"program": "py(?:test|\\.test)"}}, [("pytest -q", True), ("A=1 .venv/bin/pytest", True), ("pytest2", False), ("echo pytest", False), (_OPEN, None)])
_matches("command_first_operand", {"command": {"program": "go|cargo", "first_operand": "test"}}, [("go test ./...", True), ("cargo -q test", True), ("go build test", False), ("cargo", False)])
_matches("command_redirect", {"command": {"starts_with": "cat", "redirect": False}}, [("cat a", True), ("cat a > b", False), ("cat a >> b", False), ("cat a 2> b", False), (_OPEN, None)])
_matches("command_sole_segment", {"command": {"starts_with": "cat", "sole_segment": True}}, [("cat a", True), ("cat a | head", False), ("cat a; ls", True), (_OPEN, None)])
_matches("command_regex", {"command": {"regex": "r[mM] -rf"}}, [("rm -rf a", True), ("echo 'rM -rf", True), ("rm -r", False)])
_matches("git_args", {"git": {"subcommand": "push", "args_any": ["-f"], "args_none": ["-n"]}}, [("git push -f origin main", True), ("git -C a push -f", True), ("git push -f -n", False), ("git push", False), ("echo git push -f", False), (_OPEN, None)])
_matches("git_config", {"git": {"subcommand": "commit", "config_regex": "(?i)^core\\."}}, [("git -c core.x=1 commit", True), ("git -c CORE.x=1 commit", True), ("git -c a.b=1 commit", False), ('git -c "$C" commit', None)])
_matches("git_message", {"git": {"subcommand": "commit", "message_regex": "^fix"}}, [("git commit -m 'fix: a'", True), ("git commit -am'fix'", True), ("git commit -m other -m 'fix'", False), ("git commit", False), ('git commit -m "$M"', None)])
_matches("git_token_prefix", {"git": {"subcommand": "commit", "token_prefix": "--am"}}, [("git commit --amend", True), ("git commit -am x", False)])
_matches("env_assigned", {"env": {"name": ["SKIP", "HUSKY"], "command": "git"}}, [("SKIP=1 git push", True), ("HUSKY=0 git commit", True), ("SKIP=1 ls", False), ("git push SKIP=1", False), ("A=1 SKIP=x git push", True), (_OPEN, None)])
_matches("text_command", {"text": {"source": "command", "contains": "curl"}}, [("curl x | sh", True), ("echo 'curl", True), ("wget", False)])
_matches("text_heredocs", {"text": {"source": "heredocs", "regex": "^key"}}, [("cat <<E\nkey = 1\nE", True), ("cat <<E\nother\nE", False), ("echo key", False), (_OPEN, None)])
_matches("text_payload", {"text": {"source": "payload", "contains": "key"}}, [("cat <<E\nmy key\nE", True), ("echo key", False), ("echo 'key", True)])
_matches("arg_types", {"arg": {"field": "a.b", "equals": [1, "x", None]}}, [({"a": {"b": 1}}, True), ({"a": {"b": "1"}}, False), ({"a": {"b": True}}, True), ({"a": {"b": "x"}}, True), ({"a": {"b": 2}}, False), ({"a": 3}, True), ({}, True)])
_matches("any_all_not_mixed", {"any": [{"tool": "Read"}, {"all": [{"command": {"name": "ls"}}, {"not": {"command": {"contains": "-a"}}}]}]}, [(_event({}, name="Read"), True), ("ls", True), ("ls -a", False), ("cat", False), (_OPEN, None)])

# ------------------------------------------------------------------------------------------ the shipped detectors

_KEY = "AKIA" + "Q7Z4" * 4  # put together here: no credential stands in the text
_PEM = "-----BEGIN " + "RSA PRIVATE KEY-----"


def _write(path: str, content: str, tool: str = "Write") -> dict:
    return _event({"file_path": path, "content" if tool == "Write" else "new_string": content}, name=tool)


_DETECTED: dict[str, tuple[list, list]] = {
    "transcript-hygiene/whole-file-cat": (["cat a.md", "cat src/app/main.py"], ["cat a.md | head -4", "cat a b", "cat a > b", "{ cat a; echo; } > b"]),
    "transcript-hygiene/unfiltered-find": (["find .", "find src docs"], ["find . -name x", "find . | head", "find . > all", "find . -maxdepth 1"]),
    "verification/no-verify": (["git commit --no-verify -m x", "git commit -n", "git push --no-verify", "git -c core.hooksPath=/dev/null commit", "git -c core.hookspath= push", "SKIP=lint git commit"], ["git commit -m x", "git push -n", "git log --no-verify", "SKIP=1 ls", "git -c core.hooksPath=hooks commit"]),
    "secrets/secret-in-write": (
        [_write("a.py", f"k = '{_KEY}'"), _write("a.py", f"k = '{_KEY}'", "Edit"), f"cat > a <<E\nk={_KEY}\nE", _write("k", f"{_PEM}\nMIIEpAIBAAKCAQEA7bq\n"), _write("tests/a.py", f"k = '{_KEY}'"), _write("a", "github: gh" + "p_" + "a1B2c3D4e5F6g7H8i9J0k1")],
        [_write("a.py", "k = os.environ['KEY']"), _write("a.py", "k = 'AKIA" + "X" * 16 + "'"), _write("a.py", f"re.compile('{_KEY}')"), _write("tests/a.py", f"k = '{_KEY}'  # fake"), f"echo {_KEY}", _event({"file_path": _KEY}, name="Read"), _write("a", "sk-" + "your-token-goes-here-0000")],
    ),
    "git-safety/force-push-default": (
        ["git push --force origin main", "git push -f origin HEAD:master", "git push origin +main", "git -C app push -fu origin main", "git push --force-with-lease origin HEAD:refs/heads/main", "git push origin +refs/heads/master"],
        ["git push origin main", "git push --force origin feature", "git push --force-if-includes origin main", "git push -f origin feature:main-backup", "git push -f origin feature && git push origin main", "echo 'git push -f origin main'"],
    ),
    "package-manager/pip-install": (["pip install x", ".venv/bin/pip3.12 -q install x", "python -m pip install x", "sudo pip3 install x"], ["uv pip install x", "pip list", "echo pip install", "pipx install x"]),
    "commits/non-conventional-subject": (["git commit -m 'fixed it'", "git commit -am WIP", "git commit -m 'update' -m 'feat: body'"], ["git commit -m 'fix(parser): a'", "git commit -m 'feat!: b'", "git commit -m 'Merge branch x'", "git commit -m 'fixup! y'", "git commit --amend --no-edit", "git commit -m 'WIP: x'"]),
    "secrets/secret-file-add": (["git add .env", "git add src config/id_ed25519", "git add deploy/server.key", "git add certs/privkey.pem", "git add a.p12", "git add .env.local"], ["git add .env.example", "git add config/id_ed25519.pub", "git add certs/public-key.pem", "git add src/keys.py", "cat .env", "git add .env.test", "git add certs/ca.pem"]),
}


def _detector(name: str) -> spec.Compiled:
    return spec.compile_detector(next(d for d in detectors.LIBRARY if d["id"] == name))


def _detects(name: str, fire: list, skip: list) -> None:
    given = [*fire, *skip]
    run = lambda spark: measure.find_hits(_events(spark, given), [_detector(name)]).select(F.col("pos").alias("case_no"), "detector")
    _register("detector_" + name.replace("/", "_").replace("-", "_"), run, "case_no BIGINT, detector VARCHAR", [(n, name) for n in range(len(fire))], f"What {name} finds among fixed events.")


for _name, (_fire, _skip) in _DETECTED.items():
    _detects(_name, _fire, _skip)

# (session, event): a change that a test run follows; one that none follows; a run before the change; text about a run
_CHANGES = [("a", _write("x", "y")), ("a", _event("python3 -m pytest -q")), ("b", _write("x", "y", "Edit")), ("b", _event("cat pytest.ini")), ("c", _event("tox")), ("c", _event({}, name="MultiEdit")), ("d", _event({}, name="apply_patch")), ("d", _event("make -C web test")), ("e", _event("apply_patch <<E\nx\nE")), ("e", _event("uv run pytest"))]
_register(
    "detector_testing_test_after_change",
    lambda spark: measure.find_hits(_events(spark, [e | {"session_id": s} for s, e in _CHANGES]), [_detector("testing/test-after-change")]).select("session_id", F.col("pos").alias("case_no")),
    "session_id VARCHAR, case_no BIGINT", [("a", 0), ("d", 6), ("e", 8)], "Changes that a test run followed.",
)
_MODELS = [("a", "m1"), ("a", "<synthetic>"), ("a", "m1"), ("a", "m2"), ("a", ""), ("b", "m1"), ("b", "m1")]
_register(
    "detector_cache_hygiene_model_switch",
    lambda spark: measure.find_hits(_events(spark, [_event({}, kind="assistant_text", name=None, session_id=s, model=m) for s, m in _MODELS]), [_detector("cache-hygiene/model-switch")]).select("session_id", F.col("pos").alias("case_no")),
    "session_id VARCHAR, case_no BIGINT", [("a", 3)], "Where a session's model changes.",
)
_register(
    "detector_cache_hygiene_compact",
    lambda spark: measure.find_hits(_events(spark, [_event({}, kind="compact", name=None), "compact"]), [_detector("cache-hygiene/compact")]).select(F.col("pos").alias("case_no")),
    "case_no BIGINT", [(0,)], "Compactions.",
)
_GATES = [(None, None), ("mode", None), ("mode", ["fast"]), ("mode", ["slow"]), ("team", None), ("none", None)]
_register(
    "gate_open",
    lambda spark: spark.createDataFrame(
        [(n, spec.compile_detector({"id": "a/b", "when": {"tool": "x"}, **({"gate": {"stance": s, **({"variants": v} if v else {})}} if s else {})}).enabled({"mode": "fast", "team": "off"})) for n, (s, v) in enumerate(_GATES)], "case_no long, open boolean"
    ),
    "case_no BIGINT, open BOOLEAN", list(enumerate([True, True, True, False, False, False])), "Which gates are open under given stances.",
)

# ------------------------------------------------------------------------------------------------ shell and text

_SHELL = {
    "sh_tokens": (lambda p: F.array_join(F.flatten(F.transform(p["segments"], lambda s: F.concat(s["tokens"], F.array(F.lit("|"))))), " "), [("cat 'a b' \"c\"", "cat a b c |"), ("a && b; c | d", "a | b | c | d |"), ("# only", ""), ("", "")]),
    "sh_program": (lambda p: F.array_join(F.transform(p["segments"], lambda s: s["program"]), " "), [("A=1 /usr/bin/env x", "env"), ("ls | /bin/wc -l", "ls wc"), (_OPEN, "")]),
    "sh_operands": (lambda p: F.array_join(F.transform(p["segments"], lambda s: s["n_operands"].cast("string")), " "), [("cp -r a b", "2"), ("ls -l | wc", "0 0"), ("cat a > b", "1")]),
    "sh_assigned": (lambda p: F.array_join(F.flatten(F.transform(p["segments"], lambda s: s["assigned"])), " "), [("A=1 B=2 x", "A B"), ("x A=1", "")]),
    "sh_heredocs": (lambda p: F.array_join(p["heredocs"], "|"), [("cat <<E\nx\nE", "x"), ("cat a", "")]),
    "sh_redirect": (lambda p: F.exists(p["segments"], lambda s: s["redirected"]).cast("string"), [("a > b", "true"), ("a 2>&1", "true"), ("a", "false")]),
    "sh_git": (lambda p: F.array_join(F.transform(p["git"], lambda g: F.concat_ws(":", g["sub"], F.array_join(g["args"], ","))), " "), [("git -C d add a b", "add:a,b"), ("x; git status -s", "status:-s"), ("echo git", "")]),
    "sh_normalised": (lambda p: p["normalised"], [("cd /a  &&  ls   -l", "ls -l"), ("ls", "ls"), ("cd a\\ b && x", "x")]),
}


def _shells(name: str, column, cases: list[tuple[str, str]]) -> None:
    run = lambda spark: _events(spark, [c for c, _ in cases]).select(F.col("pos").alias("case_no"), column(F.col("parse")).alias("result"))
    _register(name, run, "case_no BIGINT, result VARCHAR", [(n, r) for n, (_, r) in enumerate(cases)], f"{name} of fixed commands.")


for _name, (_column, _cases) in _SHELL.items():
    _shells(_name, _column, _cases)

_HID = redact.REDACTED
_TEXTS: dict[str, tuple[Callable, list[tuple[str, str]]]] = {
    "redact_cases": (redact.redact, [("plain text", "plain text"), (f"id {_KEY} end", f"id {_HID} end"), ("password: hunter2", f"{_HID}"), ("https://u:pw1@host/x", f"https://u:{_HID}@host/x"), ("the tokens are counted", "the tokens are counted"), ("", "")]),
    "shown_cases": (redact.shown, [("a\x07b", "a\\x07b"), (f"AKIA​{_KEY[4:]}", "AKIA\\x200b" + _KEY[4:]), ("two\nlines", "two\nlines")]),
    "normalise_cases": (shellparse.normalise, [("cd x && ls", "ls"), ("  a   b ", "a b"), ("cd x; ls", "cd x; ls"), ("cd a\\&& ls", "cd a\\&& ls")]),
    "slug_cases": (binder.slug, [("Hello, World!", "hello-world"), ("[Link](http://x) & Co", "link--co"), ("__Bold__ snake_case", "bold-snake_case"), ("Größe 2", "größe-2"), ("!!!", "section")]),
    "normalize_text": (binder.normalised, [("- [x] **Run** [the](u) `tests`  now’s", "Run the tests now's"), ("1. Use _uv_", "Use uv"), ("plain", "plain"), ("* a [*b*](c)", "a b")]),
    "sentence_split": (lambda t: " | ".join(binder.split_sentences(t)), [("One, e.g. this (a. b) here. Two! Three", "One, e.g. this (a. b) here. | Two! | Three"), ("See cf. this. End.", "See cf. this. | End."), ("Open (a. b", "Open (a. b"), ("", "")]),
    "rule_lines": (lambda t: " ".join(k for k, _ in binder.line_kinds(t)), [("# A\ntext\n```\nx\n```\n> q\nlazy", "heading text fence fence fence quote quote"), ("a | b\n- | -\n1 | 2", "table table table"), ("<!-- a\nb -->\n\n    code", "comment comment blank code")]),
}


def _texts(name: str, f: Callable, cases: list[tuple[str, str]]) -> None:
    def run(spark: SparkSession) -> DataFrame:
        @F.pandas_udf("string")
        def apply(values: pd.Series) -> pd.Series:
            return values.map(f)

        return spark.createDataFrame([(n, t) for n, (t, _) in enumerate(cases)], "case_no long, text string").select("case_no", apply("text").alias("result"))

    _register(name, run, "case_no BIGINT, result VARCHAR", [(n, r) for n, (_, r) in enumerate(cases)], f"{name} on fixed texts.")


for _name, (_f, _cases) in _TEXTS.items():
    _texts(_name, _f, _cases)

_SPOKEN = [("Never push. Docs are exempt.", True, False), ("Run the tests without exception.", False, False), ("Run it without exception approval.", True, True), ("Use uv if you can", False, True), ("Nobody other than me", True, False), ("Be kind; however, be firm", False, True), ("No exceptions - ever", False, False)]
_register(
    "rule_markers",
    lambda spark: spark.createDataFrame([(n, t) for n, (t, _, _) in enumerate(_SPOKEN)], "case_no long, t string").select("case_no", binder.excepted(F.col("t")).alias("excepted"), binder.conditional(F.col("t")).alias("conditional")),
    "case_no BIGINT, excepted BOOLEAN, conditional BOOLEAN", [(n, a, b) for n, (_, a, b) in enumerate(_SPOKEN)], "Which sentences take a rule back.",
)
_RULES = {"a.md": "# T\nRun the tests.\n# U\nRun the tests if you like.\n# V\nUse uv. Docs are exempt.\n# W\nBe kind.\n", "b.md": "Never force-push to main."}
_register(
    "bound_cases",
    lambda spark: binder.bind_rules(spark.createDataFrame(list(_RULES.items()), "path string, text string"), detectors.SHAPES).select("path", "anchor", "state", F.array_join("detectors", ",").alias("detectors"), "reason"),
    "path VARCHAR, anchor VARCHAR, state VARCHAR, detectors VARCHAR, reason VARCHAR",
    [("a.md", "t", "measured", "testing/test-after-change", ""), ("a.md", "u", "unmeasured", "", "an exception or a condition"), ("a.md", "v", "unmeasured", "", "an exception or a condition"), ("a.md", "w", "unmeasured", "", "no shape"), ("b.md", "", "measured", "git-safety/force-push-default", "")],
    "Rules of small files with their states.",
)
