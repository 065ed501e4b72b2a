"""Markdown as far as rule files need it: opaque regions, then a lexer over lines, then the lines' neighbours.

Regions that hide what stands in them (fenced code, comments) are found by one pattern over the whole text, so
whichever opens first hides the other. The lines outside are told apart by one lexer pattern; what a line alone
cannot tell (indented code, the lazy end of a quotation, a table's rows) its neighbours tell.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

_REGION = re.compile(
    r"^ {0,3}(?P<mark>`{3,}(?=[^`\n]*$)|~{3,})[^\n]*(?:\n(?:.*?\n)? {0,3}(?P=mark)(?:`*|~*)[ \t]*$|.*\Z)|<!--.*?(?:-->|\Z)",
    re.M | re.S,
)
_LINE = re.compile(
    r"(?P<blank>\s*$)|(?P<heading> {0,3}(?P<level>\#{1,6})(?:[ \t]+(?P<title>.*?))?(?:[ \t]+\#+)?[ \t]*$)|(?P<quote> {0,3}>)|(?P<table>[ ]*\|)"
    r"|(?P<definition> {0,3}\[[^\]]+\]:[ \t]*\S)|(?P<badges>(?:\s*\[?!\[[^\]]*\]\([^)]*\)(?:\]\([^)]*\))?)+\s*$)|(?P<item>\s*(?:[-*+]|\d{1,9}[.)])(?:[ \t]|$))|(?P<text>)"
)
_INDENTED = re.compile(r"(?: {4}| {0,3}\t)")
_DELIMITERS = re.compile(r"\s*\|?(?:\s*:?-+:?\s*\|)*\s*:?-+:?\s*\|?\s*$")
_ENDS_LINE = re.compile(r"\r\n?|\n")
_INLINE = re.compile(r"\[(?P<label>[^\]]*)\]\([^)]*\)|[`*]+|(?<![A-Za-z0-9])_+|_+(?![A-Za-z0-9])|’")
_MARKER = re.compile(r"\s*(?:(?:[-*+]|\d{1,9}[.)])(?:\s+|$))?(?:\[[ xX]\]\s+)?")
_BREAK = re.compile(r"[()]|[.!?](?=\s)")
#: Abbreviations after which a sentence goes on.
ABBREVIATIONS = ("e.g", "i.e", "etc", "vs", "cf")


@dataclass
class Line:
    kind: str
    text: str
    title: str = ""
    starts: bool = False  # a list item


@dataclass
class Section:
    heading: str
    line: int
    anchor: str = ""
    paragraphs: list[str] = field(default_factory=list)


def _visible(text: str) -> list[tuple[str, str]]:
    """(``fence``, ``comment`` or '', what is seen) of each line; a comment hides its own stretch of a line only."""
    hidden: list[tuple[int, int, str]] = [(m.start(), m.end(), "fence" if m["mark"] else "comment") for m in _REGION.finditer(text)]
    out, at = [], 0
    for line in text.split("\n"):
        end = at + len(line)
        while hidden and hidden[0][1] <= at and hidden[0][1] < end:
            hidden.pop(0)
        seen, place, over = [], at, ""
        for a, b, kind in hidden:
            if a > end or (a == end and a > at):
                break
            if b <= at and not (a <= at < b):
                continue
            over = over or kind
            seen.append(text[place : max(place, a)])
            place = min(end, max(place, b))
        seen.append(text[place:end])
        shown = "".join(seen)
        out.append((over if over == "fence" or not any(c.isalnum() for c in shown) else "", line if over == "fence" else shown))
        at = end + 1
    return out


def lines(text: str) -> list[Line]:
    """The lines with their kinds: heading, fence, comment, code, table, quote, blank or text."""
    out: list[Line] = []
    for region, shown in _visible(_ENDS_LINE.sub("\n", text)):
        before = out[-1] if out else Line("blank", "")
        m = _LINE.match(shown)
        kind = m.lastgroup if m.lastgroup not in ("level", "title") else "heading"
        if region:
            out.append(Line(region, shown))
            continue
        if kind != "blank" and _INDENTED.match(shown) and before.kind not in ("text", "quote", "table"):
            kind = "code"  # indented, and no paragraph that it could go on
        elif kind in ("text", "table", "definition", "badges") and before.kind == "quote":
            kind = "quote"
        elif kind in ("definition", "badges"):
            kind = "blank"
        elif kind in ("text", "item") and not any(c.isalnum() for c in shown) and not (before.kind == "text" and "|" in shown):
            kind = "blank"
        if before.kind == "text" and "|" in before.text and "|" in shown and "-" in shown and _DELIMITERS.match(shown):
            before.kind = kind = "table"
        elif before.kind == "table" and kind in ("text", "item") and "|" in shown:
            kind = "table"
        out.append(Line("text" if kind == "item" else kind, shown, (m["title"] or "").strip(" \t#") if kind == "heading" and (m["title"] or "").strip("# \t") == "" else (m["title"] or "").strip() if kind == "heading" else "", kind == "item"))
    return out


def sections(text: str) -> list[Section]:
    """Headings with their paragraphs; ``anchor`` is unique in the file, counted over every heading. Text before the first heading is in none."""
    out: list[Section] = []
    used: dict[str, int] = {}
    goes_on = False
    for n, line in enumerate(lines(text)):
        if line.kind == "heading":
            name = slug(line.title)
            used[name] = used.get(name, 0) + 1
            out.append(Section(line.title, n, name if used[name] == 1 else f"{name}-{used[name]}"))
        elif line.kind == "text" and out:
            if goes_on and not line.starts and out[-1].paragraphs:
                out[-1].paragraphs[-1] += " " + line.text.strip()
            else:
                out[-1].paragraphs.append(line.text.strip())
        goes_on = line.kind == "text"
    return out


def prose(text: str) -> list[str]:
    """The lines of running text."""
    return [line.text.strip() for line in lines(text) if line.kind == "text"]


def plain(text: str) -> str:
    """Without inline marks: a link as its label, no code or emphasis marks, plain apostrophes."""
    return _INLINE.sub(lambda m: plain(m["label"]) if m["label"] is not None else "'" if m[0] == "’" else "", text)


def slug(heading: str) -> str:
    """The anchor of a heading: small letters, digits, underscores and hyphens of any script, blanks as hyphens."""
    bare = re.sub(r"\[([^\]]*)\]\([^)]*\)", r"\1", heading)
    bare = re.sub(r"(?<![A-Za-z0-9])_+|_+(?![A-Za-z0-9])", "", bare)
    kept = "".join(c for c in bare.strip().lower() if c.isalnum() or c in "_- ").strip()
    return kept.replace(" ", "-") or "section"


def normalised(text: str) -> str:
    """A heading or paragraph as shapes read it: no list or task marker, no inline marks, single blanks."""
    return " ".join(plain(text[_MARKER.match(text).end() :]).split())


def sentences(text: str) -> list[str]:
    """Sentences of a normalised paragraph. Brackets hold none of their ends, and known abbreviations are none."""
    out, start, depth = [], 0, 0
    for m in _BREAK.finditer(text):
        if m[0] in "()":
            depth = depth + 1 if m[0] == "(" else max(0, depth - 1)
        elif not depth and not (m[0] == "." and re.split(r"[\s(\[]", text[start : m.start()])[-1].lower() in ABBREVIATIONS):
            out.append(text[start : m.end()].strip())
            start = m.end()
    rest = text[start:].strip()
    return [*out, rest] if rest else out
