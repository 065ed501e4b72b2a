"""The declarative detector language, compiled to columns and sequence plans.

A *matcher* is a mapping whose keys are and-ed; a list of values are alternatives. It compiles to one
nullable BOOLEAN column over an events table with the columns ``parse`` (of a shell command) and ``args`` (the
input as a variant, parsed once for all matchers): true, false, or NULL for undecided. An event of the wrong kind
is false, never NULL.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logloom.functions.kleene import all3, any3, not3
from logloom.functions.patterns import PatternError, full_match, java_regex, name_glob, path_glob
from logloom.functions.variants import once
from logloom.operators import sequence
from logloom.schema import SCHEMA_READ

ENTRY_KEYS = {"id", "rule", "event", "when", "gate", "kind", "description", "examples", "schema_version"}
TARGETS = ("tool_use", "assistant_text", "session")
MAX_DEPTH = 32


class SpecError(ValueError):
    """A detector that does not compile; it costs that detector and nothing else."""


def _texts(value: Any, what: str) -> list[str]:
    values = value if isinstance(value, list) else [value]
    if not values or not all(isinstance(v, str) for v in values):
        raise SpecError(f"{what} takes a text or a list of texts")
    return values


def _options(value: Any, what: str, allowed: set[str]) -> dict:
    if not isinstance(value, dict):
        raise SpecError(f"{what} takes a mapping")
    if unknown := set(value) - allowed:
        raise SpecError(f"{what} does not know {sorted(unknown)}")
    return value


def _flag(value: Any, what: str) -> bool:
    if not isinstance(value, bool):
        raise SpecError(f"{what} is true or false")
    return value


def _patterns(value: Any, what: str) -> list[str]:
    try:
        return [java_regex(p) for p in _texts(value, what)]
    except PatternError as e:
        raise SpecError(str(e)) from e


def _is(column: str, value: str) -> Column:
    return F.coalesce(F.col(column) == value, F.lit(False))


_BASH = lambda: _is("kind", "tool_use") & _is("name", "Bash")


def _guard(condition: Column, then: Column) -> Column:
    """``then`` where the event is of the right kind, else false."""
    return F.when(condition, then).otherwise(F.lit(False))


def _path(name: str) -> str:
    return "$" + "".join("['" + p.replace("'", "\\'") + "']" for p in name.split("."))


def _field(name: str) -> Column:
    """The text of a dotted field of the input; '' where it is absent or no text."""
    return F.when(F.startswith(_schema(name), F.lit("STRING")), F.try_variant_get("args", _path(name), "string")).otherwise(F.lit(""))


def _schema(name: str) -> Column:
    return F.coalesce(F.schema_of_variant(F.try_variant_get("args", _path(name), "variant")), F.lit("VOID"))


def _equal(name: str, want: Any) -> Column:
    """Equality by type: a text never equals a number; true equals 1, as numbers do."""
    raw, kind = F.try_variant_get("args", _path(name), "string"), _schema(name)
    if want is None:
        return kind == "VOID"
    if isinstance(want, str):
        return (kind == "STRING") & F.coalesce(raw == want, F.lit(False))
    if isinstance(want, (bool, int, float)):
        number = F.when(kind == "BOOLEAN", F.when(raw == "true", 1.0).otherwise(0.0)).when(kind != "STRING", raw.try_cast("double"))
        return F.coalesce(number == float(want), F.lit(False))
    raise SpecError("equals compares with a text, a number or a truth value")


def _tool(value: Any) -> Column:
    spec = {"name": value} if isinstance(value, (str, list)) else _options(value, "tool", {"name", "glob"})
    tests = []
    if "name" in spec:
        tests.append(F.coalesce(F.col("name").isin(*_texts(spec["name"], "tool name")), F.lit(False)))
    if "glob" in spec:
        tests.append(any3([F.coalesce(F.col("name").rlike(name_glob(g)), F.lit(False)) for g in _texts(spec["glob"], "tool glob")]))
    if not tests:
        raise SpecError("tool needs a name or a glob")
    return _is("kind", "tool_use") & all3(tests)


def _kind(value: Any) -> Column:
    return F.coalesce(F.col("kind").isin(*_texts(value, "kind")), F.lit(False))


def _arg(value: Any) -> Column:
    spec = _options(value, "arg", {"field", "exists", "equals", "regex", "path_glob", "contains"})
    if "field" not in spec or len(spec) < 2:
        raise SpecError("arg needs a field and a test")
    each = []
    for name in _texts(spec["field"], "arg field"):
        tests = []
        if "exists" in spec:
            there = _schema(name) != "VOID"
            tests.append(there if _flag(spec["exists"], "exists") else ~there)
        if "equals" in spec:
            tests.append(any3([_equal(name, w) for w in (spec["equals"] if isinstance(spec["equals"], list) else [spec["equals"]])]))
        if "regex" in spec:
            tests.append(any3([_field(name).rlike(p) for p in _patterns(spec["regex"], "regex")]))
        if "path_glob" in spec:
            tests.append(any3([_field(name).rlike(path_glob(g)) for g in _texts(spec["path_glob"], "path_glob")]))
        if "contains" in spec:
            tests.append(any3([F.contains(_field(name), F.lit(c)) for c in _texts(spec["contains"], "contains")]))
        each.append(all3(tests))
    return _guard(_is("kind", "tool_use"), any3(each))


def _counted(value: Any) -> Callable[[Column], Column]:
    if isinstance(value, int) and not isinstance(value, bool):
        return lambda n: n == value
    spec = _options(value, "arg_count", {"eq", "min", "max"})
    if not spec or not all(isinstance(v, int) and not isinstance(v, bool) for v in spec.values()):
        raise SpecError("arg_count takes whole numbers")
    tests = {"eq": lambda n, v: n == v, "min": lambda n, v: n >= v, "max": lambda n, v: n <= v}
    return lambda n: all3([tests[k](n, v) for k, v in spec.items()])


def _command(value: Any) -> Column:
    keys = {"name", "starts_with", "contains", "none_of", "arg_count", "sole_segment", "redirect", "unparsed", "regex", "program", "first_operand"}
    spec = {"starts_with": value} if isinstance(value, (str, list)) else _options(value, "command", keys)
    if not spec:
        raise SpecError("command needs a test")
    tests: list[Callable[[Column], Column]] = []
    if "name" in spec:
        names = _texts(spec["name"], "command name")
        tests.append(lambda s: F.coalesce(F.get(s["tokens"], 0).isin(*names), F.lit(False)))
    if "starts_with" in spec:
        head = _texts(spec["starts_with"], "starts_with")
        tests.append(lambda s: F.slice(s["tokens"], 1, len(head)) == F.array(*map(F.lit, head)))
    if "contains" in spec:
        parts = _texts(spec["contains"], "contains")
        tests.append(lambda s: F.exists(s["tokens"], lambda t: any3([F.contains(t, F.lit(p)) for p in parts])))
    if "none_of" in spec:
        none = _texts(spec["none_of"], "none_of")
        tests.append(lambda s: ~F.arrays_overlap(F.slice(s["tokens"], 2, F.size(s["tokens"])), F.array(*map(F.lit, none))))
    if "arg_count" in spec:
        counted = _counted(spec["arg_count"])
        tests.append(lambda s: counted(s["n_operands"]))
    for key in ("program", "first_operand"):
        if key in spec:
            try:
                whole = [full_match(p) for p in _texts(spec[key], key)]
            except PatternError as e:
                raise SpecError(str(e)) from e
            tests.append(lambda s, key=key, whole=whole: F.coalesce(any3([s[key].rlike(p) for p in whole]), F.lit(False)) if True else None)
    undecided = F.lit(None).cast("boolean")
    if "redirect" in spec:
        want = _flag(spec["redirect"], "redirect")
        tests.append(lambda s: F.when(~s["redirected"] & s["unsure"], undecided).otherwise(s["redirected"] == want))
    if "sole_segment" in spec:
        alone = _flag(spec["sole_segment"], "sole_segment")
        tests.append(lambda s: F.when(s["alone"] & s["unsure"], undecided).otherwise(s["alone"] == alone))
    p = F.col("parse")
    whole = []
    if "unparsed" in spec:
        whole.append(p["skipped"] == _flag(spec["unparsed"], "unparsed"))
    if "regex" in spec:
        whole.append(any3([p["command"].rlike(x) for x in _patterns(spec["regex"], "regex")]))
    if tests:
        one_arg = [_unary(t) for t in tests]
        whole.append(F.when(p["skipped"], undecided).otherwise(F.exists(p["segments"], lambda s: all3([t(s) for t in one_arg]))))
    return _guard(_BASH() & p.isNotNull(), all3(whole))


def _unary(f: Callable) -> Callable[[Column], Column]:
    """Spark counts a lambda's parameters; defaults would be taken for an index."""
    return lambda s: f(s)


def _git(value: Any) -> Column:
    spec = _options(value, "git", {"subcommand", "args_any", "args_none", "token_prefix", "arg_regex", "config_regex", "message_regex"})
    if "subcommand" not in spec:
        raise SpecError("git needs a subcommand")
    tests: list[Callable[[Column], Column]] = [lambda c: c["sub"].isin(*_texts(spec["subcommand"], "subcommand"))]
    if "args_any" in spec:
        some = F.array(*map(F.lit, _texts(spec["args_any"], "args_any")))
        tests.append(lambda c: F.arrays_overlap(c["args"], some))
    if "args_none" in spec:
        none = F.array(*map(F.lit, _texts(spec["args_none"], "args_none")))
        tests.append(lambda c: ~F.arrays_overlap(c["args"], none))
    if "token_prefix" in spec:
        heads = _texts(spec["token_prefix"], "token_prefix")
        tests.append(lambda c: F.exists(c["tokens"], lambda t: any3([F.startswith(t, F.lit(h)) for h in heads])))
    undecided = F.lit(None).cast("boolean")
    if "arg_regex" in spec:
        args = _patterns(spec["arg_regex"], "arg_regex")
        tests.append(lambda c: F.exists(c["args"], lambda a: any3([a.rlike(p) for p in args])))
    if "config_regex" in spec:
        configs = _patterns(spec["config_regex"], "config_regex")
        tests.append(lambda c: F.when(F.exists(c["configs"], lambda v: any3([v.rlike(p) for p in configs])), True).when(c["configs_unread"], undecided).otherwise(False))
    if "message_regex" in spec:
        messages = _patterns(spec["message_regex"], "message_regex")
        tests.append(lambda c: F.when(c["message"].isNull(), False).when(c["message_unread"], undecided).otherwise(any3([c["message"].rlike(p) for p in messages])))
    p = F.col("parse")
    return _guard(_BASH() & p.isNotNull(), F.when(p["skipped"], undecided).otherwise(F.exists(p["git"], lambda c: all3([t(c) for t in tests]))))


def _env(value: Any) -> Column:
    spec = _options(value, "env", {"name", "command"})
    if "name" not in spec:
        raise SpecError("env needs a name")
    names = F.array(*map(F.lit, _texts(spec["name"], "env name")))
    commands = _texts(spec["command"], "env command") if "command" in spec else None
    p = F.col("parse")

    def one(s: Column) -> Column:
        here = F.arrays_overlap(s["assigned"], names)
        return here & F.coalesce(F.get(s["words"], 0).isin(*commands), F.lit(False)) if commands else here

    return _guard(_BASH() & p.isNotNull(), F.when(p["skipped"], F.lit(None).cast("boolean")).otherwise(F.exists(p["segments"], one)))


def _found(text: Column, patterns: list[str], parts: list[str], both: bool) -> Column:
    a, b = any3([text.rlike(x) for x in patterns]), any3([F.contains(text, F.lit(c)) for c in parts])
    if not both:
        return a | b
    return (a if patterns else F.lit(True)) & (b if parts else F.lit(True))


def _text(value: Any) -> Column:
    spec = _options(value, "text", {"source", "regex", "contains"})
    source = spec.get("source", "command")
    patterns = _patterns(spec["regex"], "regex") if "regex" in spec else []
    parts = _texts(spec["contains"], "contains") if "contains" in spec else []
    if not patterns and not parts:
        raise SpecError("text needs a regex or a contains")
    test = lambda t: (t != "") & _found(t, patterns, parts, False)
    p = F.col("parse")
    bash = _BASH() & p.isNotNull()
    if source == "assistant":
        return _guard(_is("kind", "assistant_text"), test(F.coalesce("text", F.lit(""))))
    if source == "command":
        return _guard(bash, test(p["command"]))
    if source == "heredocs":
        return _guard(bash, F.when(p["skipped"], F.lit(None).cast("boolean")).otherwise(F.exists(p["heredocs"], test)))
    if source == "payload":
        return _guard(bash, F.when(p["skipped"], test(p["command"])).otherwise(F.exists(p["heredocs"], test)))
    raise SpecError(f"unknown text source {source!r}")


def _message(value: Any) -> Column:
    spec = _options(value, "message", {"role", "final", "regex", "contains"})
    kinds = {"assistant": "assistant_text", "user": "user_prompt"}
    role = spec.get("role", "assistant")
    if role not in kinds:
        raise SpecError(f"unknown role {role!r}")
    tests = []
    if "final" in spec:
        tests.append(F.coalesce("final", F.lit(False)) == _flag(spec["final"], "final"))
    tests.append(_found(F.coalesce("text", F.lit("")), _patterns(spec["regex"], "regex") if "regex" in spec else [], _texts(spec["contains"], "contains") if "contains" in spec else [], True))
    return _guard(_is("kind", kinds[role]), all3(tests))


def _branches(value: Any, what: str, depth: int) -> list[Column]:
    if not isinstance(value, list) or not value:
        raise SpecError(f"{what} takes a list of matchers")
    return [matcher(v, depth) for v in value]


_SESSION_ONLY = ("order", "absent", "change")
_PREDICATES: dict[str, Callable[[Any], Column]] = {"tool": _tool, "kind": _kind, "arg": _arg, "command": _command, "git": _git, "env": _env, "text": _text, "message": _message}


def matcher(spec: Any, depth: int = 0) -> Column:
    """A matcher as a nullable BOOLEAN column over events with a ``parse`` column."""
    if depth > MAX_DEPTH:
        raise SpecError("matchers are nested too deeply")
    if not isinstance(spec, dict) or not spec:
        raise SpecError("a matcher is a mapping with at least one key")
    out = []
    for key, value in spec.items():
        if key in _PREDICATES:
            out.append(_PREDICATES[key](value))
        elif key == "any":
            out.append(any3(_branches(value, key, depth + 1)))
        elif key == "all":
            out.append(all3(_branches(value, key, depth + 1)))
        elif key == "not":
            out.append(not3(any3(_branches(value, key, depth + 1)) if isinstance(value, list) else matcher(value, depth + 1)))
        elif key in _SESSION_ONLY:
            raise SpecError(f"{key} reads a whole session and stands alone in a session detector")
        else:
            raise SpecError(f"unknown matcher {key!r}")
    return all3(out)


def with_args(events: DataFrame) -> DataFrame:
    """Events with ``args``; those that have it already are left alone."""
    return events if "args" in events.columns else events.withColumn("args", once(F.try_parse_json("input")))


HITS = ["runtime", "session_id", "turn", "tool_use_id", "pos"]


@dataclass
class Compiled:
    """A detector as plan fragments: ``hits(events)`` and, if it has a notion of compliance, ``opportunities(events)``."""

    id: str
    rule: str
    event: str
    hits: Callable[[DataFrame], DataFrame]
    opportunities: Callable[[DataFrame], DataFrame] | None = None
    gate: tuple[str, tuple[str, ...] | None] | None = None
    examples: dict = field(default_factory=dict)
    predicate: Column | None = None  # a per-event detector's condition, so that many are found in one pass

    def enabled(self, stances: dict[str, str] | None) -> bool:
        """A gate is open if the stance of its dimension is there, is not ``off``, and is one of its variants."""
        if self.gate is None:
            return True
        variant = (stances or {}).get(self.gate[0])
        return bool(variant) and variant != "off" and (self.gate[1] is None or variant in self.gate[1])


def _point(df: DataFrame, *more: Column) -> DataFrame:
    tool = F.when(F.col("kind") == "tool_use", F.col("id")) if "kind" in df.columns else F.lit(None).cast("string")
    return df.select("runtime", "session_id", "turn", tool.alias("tool_use_id"), "pos", *more)


def compile_detector(entry: Any) -> Compiled:
    """An entry of a detector file as plan fragments; SpecError if it is not one."""
    if not isinstance(entry, dict):
        raise SpecError("a detector is a mapping")
    if unknown := set(entry) - ENTRY_KEYS:
        raise SpecError(f"unknown keys {sorted(unknown)}")
    version = entry.get("schema_version", 1)
    if isinstance(version, bool) or version not in SCHEMA_READ:
        raise SpecError(f"unknown schema_version {version!r}")
    name = entry.get("id")
    if not isinstance(name, str) or not re.fullmatch(r"[^/\s]+/\S+", name):
        raise SpecError("an id is RULE/OBSERVABLE")
    rule = entry.get("rule", name.split("/")[0])
    if not isinstance(rule, str) or not rule or "/" in rule:
        raise SpecError("a rule is a name without /")
    target = entry.get("event", "tool_use")
    if target not in TARGETS:
        raise SpecError(f"event is one of {TARGETS}")
    when = entry.get("when")
    if not isinstance(when, dict) or not when:
        raise SpecError("when is a matcher")
    gate = None
    if (g := entry.get("gate")) is not None:
        g = _options(g, "gate", {"stance", "variants"})
        if not isinstance(g.get("stance"), str):
            raise SpecError("a gate names a stance")
        gate = (g["stance"], tuple(_texts(g["variants"], "variants")) if g.get("variants") is not None else None)
    common = {"id": name, "rule": rule, "event": target, "gate": gate, "examples": entry.get("examples") or {}}
    special = [k for k in when if k in _SESSION_ONLY]
    if not special:
        condition = matcher(when)
        if target != "session":
            condition = _is("kind", target) & condition
        return Compiled(**common, hits=lambda e: _point(e.where(condition)), predicate=condition)
    if target != "session" or len(when) != 1:
        raise SpecError(f"{special[0]} stands alone in a session detector")
    return Compiled(**common, **_session_plan(special[0], when[special[0]]))


def _session_plan(kind: str, value: Any) -> dict:
    if kind == "order":
        spec = _options(value, "order", {"first", "then", "within"})
        within = spec.get("within", 5)
        if isinstance(within, bool) or not isinstance(within, int) or within < 1:
            raise SpecError("within is a positive number")
        first, then = matcher(spec.get("first")), matcher(spec.get("then"))
        opened = lambda e: sequence.order_within(e, first, then, within).where("opened")
        return {"hits": lambda e: _point(opened(e).where("followed")), "opportunities": lambda e: _point(opened(e), F.col("followed"))}
    if kind == "absent":
        spec = _options(value, "absent", {"of", "scope"})
        of, scope = matcher(spec.get("of")), spec.get("scope", "session")
        if scope not in ("session", "turn"):
            raise SpecError("scope is session or turn")
        found = lambda e: sequence.absent(e, of, scope)
        plan = {"hits": lambda e: _point(found(e).where("absent"))}
        if scope == "turn":
            plan["opportunities"] = lambda e: _point(found(e), F.col("found").alias("followed"))
        return plan
    spec = _options(value, "change", {"kind", "field", "ignore_prefix", "ignore_empty"})
    name = spec.get("field")
    if not isinstance(name, str):
        raise SpecError("change needs a field")
    of_kind = _texts(spec.get("kind", "assistant_text"), "kind")
    columns = {"model", "name", "text", "tool_name", "tool_use_id", "id"}
    text = F.coalesce(F.col(name), F.lit("")) if name in columns else _field(name.removeprefix("input."))
    keep = F.lit(True)
    if _flag(spec.get("ignore_empty", True), "ignore_empty"):
        keep = keep & (text != "")
    if "ignore_prefix" in spec:
        for prefix in _texts(spec["ignore_prefix"], "ignore_prefix"):
            keep = keep & ~F.startswith(text, F.lit(prefix))
    chosen = F.col("kind").isin(*of_kind)
    return {"hits": lambda e: _point(sequence.change(e.where(chosen), text, keep))}
