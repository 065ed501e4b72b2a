"""Patterns of the detector language as Java regular expressions."""

from __future__ import annotations

import re


class PatternError(ValueError):
    pass


def java_regex(pattern: str) -> str:
    """A Python pattern as a Java one with the same meaning; refused if Python cannot compile it or Java lacks it.

    Unicode classes and case folding are switched on (Python has them by default) and only ``\\n`` ends a
    line. Named groups are respelled, ``\\Z`` becomes ``\\z``, and ``[`` or ``&&`` inside a class is escaped,
    where Java would read a nested class or an intersection.
    """
    try:
        re.compile(pattern)
    except re.error as e:
        raise PatternError(f"bad pattern {pattern!r}: {e}") from e
    if re.search(r"\(\?\(|\(\?[aL]", pattern):
        raise PatternError(f"pattern {pattern!r} uses what Java lacks")
    flags, body = "", pattern
    if m := re.match(r"\(\?([imsx]+)\)", pattern):
        flags, body = m[1], pattern[m.end() :]
    out, i, inside = [], 0, False
    while i < len(body):
        c, two = body[i], body[i : i + 2]
        if c == "\\":
            out.append("\\z" if two == "\\Z" else two)
            i += 2
            continue
        if inside:
            if c == "[" or two == "&&":
                out.append("\\" + c)
            else:
                out.append(c)
                inside = c != "]" or body[i - 1] == "[" or (body[i - 1] == "^" and body[i - 2] == "[")
        elif c == "[":
            inside = True
            out.append(c)
        elif body.startswith("(?P<", i):
            out.append("(?<")
            i += 4
            continue
        elif m := re.match(r"\(\?P=(\w+)\)", body[i:]):
            out.append(f"\\k<{m[1]}>")
            i += m.end()
            continue
        elif c == "$":
            out.append("$" if "m" in flags or "(?m" in body else r"(?=\n?\z)")
        else:
            out.append(c)
        i += 1
    return f"(?Ud{flags}{'u' if 'i' in flags or '(?i' in body else ''})" + "".join(out)


def full_match(pattern: str) -> str:
    """The pattern as one that must cover the whole text."""
    regex = java_regex(pattern)
    head = regex[: regex.index(")") + 1]
    return f"{head}\\A(?:{regex[len(head):]})\\z"


def _class(pattern: str, i: int) -> tuple[str, int]:
    end = pattern.find("]", i + 2 if pattern[i + 1 : i + 2] in ("!", "]") else i + 1)
    if end < 0:
        return "\\[", i + 1
    body = pattern[i + 1 : end].replace("\\", "\\\\").replace("[", "\\[").replace("&&", "&\\&")
    return f"[{'^' + body[1:] if body.startswith('!') else body}]", end + 1


def _literal(c: str) -> str:
    return c if c.isalnum() or c in "_/ -" else "\\" + c if c.isascii() else c


def path_glob(pattern: str) -> str:
    """A path glob: ``*`` and ``?`` stop at ``/``, ``**`` does not; a glob that begins neither with ``/`` nor ``**`` fits any suffix that starts a path component."""
    out, i = [], 0
    while i < len(pattern):
        if pattern.startswith("**", i):
            piece, i = ".*", i + 2
        elif pattern[i] in "*?":
            piece, i = {"*": "[^/]*", "?": "[^/]"}[pattern[i]], i + 1
        elif pattern[i] == "[":
            piece, i = _class(pattern, i)
        else:
            piece, i = _literal(pattern[i]), i + 1
        out.append(piece)
    anchored = pattern.startswith(("/", "**"))
    return ("\\A" if anchored else "(?:\\A|\\A.*/)") + "".join(out) + "\\z"


def name_glob(pattern: str) -> str:
    """A name glob as of shells without paths: ``*`` any text, ``?`` one character, ``[...]`` a class."""
    out, i = [], 0
    while i < len(pattern):
        if pattern[i] in "*?":
            piece, i = {"*": ".*", "?": "."}[pattern[i]], i + 1
        elif pattern[i] == "[":
            piece, i = _class(pattern, i)
        else:
            piece, i = _literal(pattern[i]), i + 1
        out.append(piece)
    return "(?s)\\A" + "".join(out) + "\\z"
