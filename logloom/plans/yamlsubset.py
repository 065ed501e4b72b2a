"""The YAML subset of detector files: block and flow mappings and lists, quoted and plain scalars, comments.

Refused with a line number: anchors, aliases, tags, block scalars, directives, several documents, tabs as
indentation, repeated keys, the words yes/no/on/off and numbers with leading zeros. JSON files are read as
JSON, repeated keys refused as well. Everything here runs on the driver; these files are metadata.
"""

from __future__ import annotations

import json
import re
from typing import Any

MAX_DEPTH = 32
_INT = re.compile(r"[-+]?(?:0|[1-9]\d*)")
_FLOAT = re.compile(r"[-+]?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][-+]?\d+)?")
_WORDS = {"true": True, "false": False, "null": None, "~": None}
_REFUSED = {"yes", "no", "on", "off"}
_PLAIN_KEY = re.compile(r"""[^\s#:\[\]{},&*!|>'"%@`-][^:#\[\]{},]*|-[^\s:#\[\]{},][^:#\[\]{},]*""")


class YamlError(ValueError):
    def __init__(self, reason: str, line: int):
        super().__init__(f"line {line}: {reason}")
        self.line = line


class _Flow:
    """Scalars and flow collections on one logical line."""

    def __init__(self, text: str, line: int):
        self.text, self.at, self.line = text, 0, line

    def fail(self, reason: str):
        raise YamlError(reason, self.line)

    def blank(self):
        while self.at < len(self.text) and self.text[self.at] in " \t":
            self.at += 1
        if self.text.startswith("#", self.at) and (self.at == 0 or self.text[self.at - 1] in " \t"):
            self.at = len(self.text)

    def value(self, closers: str = "", depth: int = 0) -> Any:
        if depth > MAX_DEPTH:
            self.fail("nested too deeply")
        self.blank()
        c = self.text[self.at : self.at + 1]
        if c == "[":
            return self.items("]", depth, lambda: self.value(",]", depth + 1), list())
        if c == "{":
            return self.items("}", depth, lambda: self.pair(depth), dict())
        if c in ("'", '"'):
            return self.quoted()
        return self.plain(closers)

    def items(self, close: str, depth: int, one, out):
        self.at += 1
        while True:
            self.blank()
            if self.text.startswith(close, self.at):
                self.at += 1
                return out
            if self.at >= len(self.text):
                self.fail("a flow collection is not closed")
            got = one()
            if isinstance(out, dict):
                if got[0] in out:
                    self.fail(f"key {got[0]!r} is given twice")
                out[got[0]] = got[1]
            else:
                out.append(got)
            self.blank()
            if self.text.startswith(",", self.at):
                self.at += 1
            elif not self.text.startswith(close, self.at):
                self.fail("expected , or the end of the collection")

    def pair(self, depth: int):
        key = self.key()
        self.blank()
        if not self.text.startswith(":", self.at):
            self.fail("expected : after a key")
        self.at += 1
        return key, self.value(",}", depth + 1)

    def key(self) -> str:
        self.blank()
        if self.text[self.at : self.at + 1] in ("'", '"'):
            return self.quoted()
        m = _PLAIN_KEY.match(self.text, self.at)
        if not m:
            self.fail("not a key")
        self.at = m.end()
        return m[0].strip()

    def quoted(self) -> str:
        mark, out = self.text[self.at], []
        self.at += 1
        while self.at < len(self.text):
            c = self.text[self.at]
            if c == mark:
                if mark == "'" and self.text.startswith("''", self.at):
                    out.append("'")
                    self.at += 2
                    continue
                self.at += 1
                return "".join(out)
            if c == "\\" and mark == '"':
                m = re.compile(r'\\(?:u[0-9a-fA-F]{4}|x[0-9a-fA-F]{2}|["\\/bfnrt0])').match(self.text, self.at)
                if not m:
                    self.fail("unknown escape")
                e = m[0]
                out.append(chr(int(e[2:], 16)) if e[1] in "ux" else "\0" if e[1] == "0" else json.loads(f'"{e}"'))
                self.at = m.end()
                continue
            out.append(c)
            self.at += 1
        self.fail("a quote is not closed")

    def plain(self, closers: str) -> Any:
        start = self.at
        while self.at < len(self.text):
            c = self.text[self.at]
            if closers and c in closers:
                break
            if c == "#" and self.text[self.at - 1 : self.at] in (" ", "\t"):
                break
            if c == ":" and (self.at + 1 >= len(self.text) or self.text[self.at + 1] in " \t"):
                self.fail("a mapping inside a plain value; quote it")
            self.at += 1
        word = self.text[start : self.at].strip()
        if word[:1] in tuple("&*!|>%@`"):
            self.fail(f"{word[:1]!r} is not part of the subset")
        if word == "":
            return None
        if word.lower() in _REFUSED:
            self.fail(f"write true or false, or quote {word!r}")
        if word in _WORDS:
            return _WORDS[word]
        if _INT.fullmatch(word):
            return int(word)
        if re.fullmatch(r"[-+]?0\d+", word):
            self.fail(f"quote {word!r}; a leading zero is ambiguous")
        if _FLOAT.fullmatch(word):
            return float(word)
        return word

    def end(self):
        self.blank()
        if self.at < len(self.text):
            self.fail(f"unexpected {self.text[self.at:][:20]!r}")


def parse(text: str) -> Any:
    """The document as plain objects."""
    lines: list[tuple[int, int, str]] = []
    for n, raw in enumerate(text.replace("\r\n", "\n").split("\n"), 1):
        body = raw.rstrip()
        if not body.strip() or body.lstrip().startswith("#"):
            continue
        indent = len(body) - len(body.lstrip(" "))
        if body[indent] == "\t":
            raise YamlError("a tab as indentation", n)
        if body.startswith("%") or body in ("---", "..."):
            if body == "---" and not lines:
                continue
            raise YamlError("directives and several documents are not part of the subset", n)
        lines.append((n, indent, body[indent:]))
    if not lines:
        return None
    n, indent, first = lines[0]
    if len(lines) == 1 and not (first == "-" or first.startswith("- ")) and not _opens_mapping(first, n):
        f = _Flow(first, n)
        value = f.value()
        f.end()
        return value
    value, at = _block(lines, 0, indent, 0)
    if at < len(lines):
        raise YamlError("unexpected indentation", lines[at][0])
    return value


def _block(lines, at: int, indent: int, depth: int) -> tuple[Any, int]:
    if depth > MAX_DEPTH:
        raise YamlError("nested too deeply", lines[at][0])
    is_list = lines[at][2] == "-" or lines[at][2].startswith("- ")
    out: Any = [] if is_list else {}
    while at < len(lines) and lines[at][1] == indent:
        n, _, text = lines[at]
        if is_list != (text == "-" or text.startswith("- ")):
            if is_list:
                break
            raise YamlError("a list item among keys", n)
        if is_list:
            rest = text[1:].lstrip()
            inner = indent + len(text) - len(rest)
            if not rest or rest.startswith("#"):
                value, at = _below(lines, at + 1, indent, depth, strict=True)
            elif _opens_mapping(rest, n):
                lines[at] = (n, inner, rest)
                value, at = _block(lines, at, inner, depth + 1)
            else:
                f = _Flow(rest, n)
                value = f.value()
                f.end()
                at += 1
            out.append(value)
            continue
        f = _Flow(text, n)
        key = f.key()
        f.blank()
        if not f.text.startswith(":", f.at):
            raise YamlError("expected : after a key", n)
        f.at += 1
        if key in out:
            raise YamlError(f"key {key!r} is given twice", n)
        f.blank()
        if f.at >= len(f.text):
            out[key], at = _below(lines, at + 1, indent, depth, strict=False)
        else:
            out[key] = f.value()
            f.end()
            at += 1
    if at < len(lines) and lines[at][1] > indent:
        raise YamlError("unexpected indentation", lines[at][0])
    return out, at


def _below(lines, at: int, indent: int, depth: int, strict: bool) -> tuple[Any, int]:
    """The block under a key or a dash; a list may stand as far left as its key."""
    if at < len(lines) and (lines[at][1] > indent or (not strict and lines[at][1] == indent and (lines[at][2] + " ").startswith("- "))):
        return _block(lines, at, lines[at][1], depth + 1)
    return None, at


def _opens_mapping(text: str, n: int) -> bool:
    if text[:1] in "[{":
        return False
    f = _Flow(text, n)
    try:
        f.key()
        f.blank()
    except YamlError:
        return False
    return f.text.startswith(":", f.at) and (f.at + 1 >= len(f.text) or f.text[f.at + 1] in " \t")


def load(path: str) -> Any:
    """A detector file: ``.json`` as JSON, anything else in the subset."""
    with open(path, encoding="utf-8-sig") as f:
        text = f.read()
    if not path.endswith(".json"):
        return parse(text)

    def unique(pairs):
        out = dict(pairs)
        if len(out) < len(pairs):
            raise YamlError("a key is given twice", 1)
        return out

    return json.loads(text, object_pairs_hook=unique)


def emit(value: Any, indent: int = 0) -> str:
    """A value in the subset, so that ``parse(emit(v)) == v``."""
    pad = "  " * indent
    if isinstance(value, dict) and value:
        return "".join(f"{pad}{json.dumps(str(k), ensure_ascii=False)}:" + _after(v, indent) for k, v in value.items())
    if isinstance(value, list) and value:
        return "".join(f"{pad}-" + _after(v, indent) for v in value)
    return f"{pad}{_scalar(value)}\n"


def _after(value: Any, indent: int) -> str:
    if isinstance(value, (dict, list)) and value:
        return "\n" + emit(value, indent + 1)
    return f" {_scalar(value)}\n"


def _scalar(value: Any) -> str:
    if isinstance(value, str):
        return json.dumps(value, ensure_ascii=False)
    if isinstance(value, (dict, list)):
        return "{}" if isinstance(value, dict) else "[]"
    return json.dumps(value)


def entries(document: Any) -> list[dict]:
    """The detector entries of a document: a list, a mapping with ``detectors``, or one entry; the file's version is each entry's default."""
    if isinstance(document, list):
        return document
    if not isinstance(document, dict):
        raise ValueError("a detector file is a list, a mapping with detectors, or one detector")
    if "detectors" in document:
        version = document.get("version")
        found = document["detectors"] or []
        return [{"schema_version": version, **e} if version is not None and isinstance(e, dict) else e for e in found]
    if "when" in document:
        return [document]
    raise ValueError("no detectors in this file")
