"""Sentence units of texts in many languages and scripts.

Three steps. (1) Lines give blocks: headings, list items, fenced code, paragraphs. (2) Inside a block every
stop, blank or closing mark that could end a sentence is a candidate; inline code, and quotations and
brackets that stand inside a sentence, hold none. (3) A candidate whose outcome the script itself settles is
decided at once; every full stop before a blank goes to a maximum-entropy classifier (logistic regression)
over its neighbours: case, length, digits, script, and how the tokens beside it behave in the whole corpus
(does this token ever end a block? does this word ever begin one?). These counts are taken over all documents.
The classifier is fitted on *reliable* stops only: ends of blocks against stops that plainly stand inside a
sentence, as the counts tell.
"""

from __future__ import annotations

import unicodedata
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logloom.storage import materialize

#: Stops that the classifier is fitted on, at most; which ones is decided by a hash of document and place.
TRAINING_STOPS = 60_000
#: Tokens and words that make up a smaller share of all stops count as never seen, so that there are at most 2 / RARE of them.
RARE = 1e-6

# Words known beforehand to stand before a stop that ends nothing, those after which a sentence may end as
# well, and month names. They are a prior only: a few made-up observations (PRIOR) that the counts of a corpus outweigh.
FOLLOWED = frozenset(
    """cf e.g i.e fig figs sec secs ch chap no nos nr rev vs viz ca approx max incl excl ed eds vol pp p pg art eq eqs mr mrs ms dr prof st mt gen
    w.r.t wrt resp z.b d.h bzw vgl kap abs s abb bspw ggf inkl sog evtl hrsg jh bd vgl núm pág págs p.ej ej aprox cap sr sra dra ud uds art fig vol
    p.ex ex c.-à-d c.à.d env chap éd т.е см стр рис гл ср напр табл п ст г ул им тов सं डॉ श्री पृ د ص jan feb mar apr jun jul aug sep sept oct nov dec
    janv févr juil déc ene abr ago dic okt dez""".split()
)
ENDING = frozenset("etc usw a.m p.m u.a u.s.w et.al al inc ltd corp co jr sr т.д т.п др и.т.д min sec hr hrs ff u.ä o.ä ee.uu s.a с.г н.э и.др et.al руб тыс млн km kg".split())
MONTHS = frozenset(
    "januar februar märz april mai juni juli august september oktober november dezember jänner jahrhundert jahrestag января февраля марта апреля мая июня июля августа сентября октября ноября декабря".split()
)
PRIOR = 10

_STOPS = ".!?…؟。！？｡．।॥۔"
_FULL = "。！？｡．"  # stops of unspaced scripts
_SURE = "!?؟।॥۔"
_PAIRS = {"(": ")", "[": "]", "{": "}", "“": "”", "«": "»", "「": "」", "『": "』", "《": "》", "〈": "〉", "（": "）", "【": "】", "［": "］", "‹": "›", "｢": "｣", "„": "“", "‚": "‘", "‘": "’"}
_CLOSERS = frozenset(")]}”»」』》〉）】］›｣’\"'“‘")
_OPENING = "([{\"'“«„‚‘「『（¿¡>*_-"
_BRACKETS = frozenset("([{（［【")
_NEXT_STRIP = "([{\"'“«„‚‘「『（¿¡`>*_- \t\r\n"


@lru_cache(maxsize=1)
def _re():
    import re

    return {
        "fence": re.compile(r"[ \t]*(?:>[ \t]?)*(`{3,}(?=[^`]*$)|~{3,})"),
        "heading": re.compile(r"[ \t]*(?:>[ \t]?)*#{1,6}(?:[ \t]|$)"),
        "bullet": re.compile(r"[ \t]*(?:>[ \t]?)*([-*+•‣◦])[ \t]+(?=\S)"),
        "number": re.compile(r"[ \t]*(?:>[ \t]?)*(\d{1,9})[.)][ \t]+(?=\S)"),
        "quote": re.compile(r"[ \t]*>"),
        "marks": re.compile(r"[ \t]*(?:>[ \t]?)+"),
        "code": re.compile(r"(`+)(?!`)(.+?)(?<!`)\1(?!`)", re.S),
        "address": re.compile(r"(?<![a-z+.-])[a-z][a-z+.-]{0,15}://[^\s<>\"'“”«»]+"),
        "candidate": re.compile(rf"[{_STOPS}]+|(?<=[฀-๿])[ \t \r\n]+(?=[฀-๿])"),
        "digits": re.compile(r"\d+"),
        "paired": re.compile("[" + re.escape("\"'" + "".join(_PAIRS) + "".join(_PAIRS.values())) + "]"),
        "next": re.compile(r"\s*(?=(\S?))[" + re.escape(_NEXT_STRIP) + r"]*(\S*)"),
    }


@lru_cache(maxsize=100_000)
def script(ch: str) -> str:
    """A coarse script class of a character: latin, cyrillic, greek, cjk, hangul, thai, deva, arabic, digit or other."""
    o = ord(ch)
    if ch.isdigit():
        return "digit"
    if o < 0x250 or 0x1E00 <= o < 0x1F00:
        return "latin" if ch.isalpha() else "other"
    if 0x370 <= o < 0x400:
        return "greek"
    if 0x400 <= o < 0x530:
        return "cyrillic"
    if 0x590 <= o < 0x780 or 0x8A0 <= o < 0x900:
        return "arabic"
    if 0x900 <= o < 0xE00:
        return "deva"
    if 0xE00 <= o < 0xE80:
        return "thai"
    if 0xAC00 <= o < 0xD7B0 or 0x1100 <= o < 0x1200 or 0x3130 <= o < 0x3190:
        return "hangul"
    if 0x3005 <= o < 0x3008 or 0x3040 <= o < 0x3100 or 0x31F0 <= o < 0x3200 or 0x3400 <= o < 0xA000 or 0xF900 <= o < 0xFB00 or 0xFF66 <= o < 0xFFA0 or 0x20000 <= o < 0x33480:
        return "cjk"
    return "latin" if ch.isalpha() else "other"


def _upper(ch: str) -> bool:
    return unicodedata.category(ch) in ("Lu", "Lt")


# --------------------------------------------------------------------------------------------- blocks


def blocks(text: str) -> list[tuple[int, int, str]]:
    """(first, end, kind) of every block, kind one of code, heading, item, text; blank lines belong to none."""
    r = _re()
    out: list[tuple[int, int, str]] = []
    open_: list = []  # first, end, kind
    at, n = 0, len(text)
    fence = ""
    fence_first = fence_end = 0
    last_number = None

    def close():
        if open_:
            out.append(tuple(open_))
            open_.clear()

    while at < n:
        nl = text.find("\n", at)
        end = n if nl < 0 else nl
        line = text[at:end]
        if fence:
            fence_end = end
            m = r["fence"].match(line)
            if m and m[1][0] == fence[0] and len(m[1]) >= len(fence) and not line[m.end() :].strip():
                out.append((fence_first, end, "code"))
                fence = ""
        elif not line.strip():
            close()
        else:
            content = line
            marked = r["marks"].match(line)
            if marked and not line[marked.end() :].strip():
                close()  # a quoting mark alone is a blank line
            elif m := r["fence"].match(line):
                close()
                fence, fence_first, fence_end = m[1], at, end
            elif r["heading"].match(line):
                close()
                out.append((at, end, "heading"))
            else:
                m = r["bullet"].match(line)
                k = None if m else r["number"].match(line)
                if m or k:
                    number = int(k[1]) if k else None
                    if open_ and open_[2] == "text":
                        before = text[open_[0] : open_[1]].rstrip()[-1:]
                        starts = before in ":：" or (before in _STOPS and (number is None or number <= 1))
                    elif open_ and number is not None:
                        starts = last_number is None or number == last_number + 1 or number == 1
                    else:
                        starts = True
                    if starts:
                        close()
                        last_number = number
                        open_[:] = [at, end, "item"]
                    else:
                        open_[1] = end
                elif open_ and bool(r["quote"].match(text[open_[0] : open_[1]])) >= bool(r["quote"].match(content)):
                    open_[1] = end
                else:  # a quotation opens after plain text
                    close()
                    open_[:] = [at, end, "text"]
        at = end + 1
    if fence:
        out.append((fence_first, fence_end, "code"))
    close()
    return out


# ------------------------------------------------------------------------------------------ candidates


@dataclass
class Candidate:
    """A place where a unit may end (``end``, closing marks included), and what the classifier sees of it."""

    end: int
    verdict: bool | None
    bits: int = 0
    token: str = ""
    word: str = ""
    earlier: str = ""


def _enclosed(text: str, first: int, end: int) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """Spans of inline code and addresses; matched pairs of quotes and brackets (outermost only) outside them."""
    r = _re()
    code = [m.span() for m in r["code"].finditer(text, first, end)] if text.find("`", first, end) >= 0 else []
    if text.find("://", first, end) >= 0:
        code += [m.span() for m in r["address"].finditer(text, first, end) if not any(a <= m.start() < b for a, b in code)]
        code.sort()
    skip = iter([*code, (end, end)])
    a, b = next(skip)
    last: dict[str, int] = {}  # of each closing mark the last place in the block
    stack: list[tuple[str, int]] = []
    waiting: Counter = Counter()  # closing marks in the stack
    pairs: list[tuple[int, int]] = []
    for m in r["paired"].finditer(text, first, end):
        i, ch = m.start(), m[0]
        while i >= b and a < end:
            a, b = next(skip)
        if a <= i < b:
            continue
        if stack and ch == stack[-1][0]:
            if ch != "'" and ch != "’" or not text[i + 1 : i + 2].isalnum():
                pairs.append((stack.pop()[1], i + 1))
                waiting[ch] -= 1
                continue
        elif ch in "\"'":
            before, after = text[i - 1 : i] if i > first else " ", text[i + 1 : i + 2]
            if (not before or before.isspace() or before in "([{（「『“«—–-:") and after and not after.isspace():
                # an opening mark needs its closing one in the block
                if ch not in last:
                    j = text.rfind(ch, i + 1, end)
                    while j >= 0 and (text[j - 1].isspace() or (ch == "'" and text[j + 1 : j + 2].isalnum())):
                        j = text.rfind(ch, i + 1, j)
                    last[ch] = j
                if last[ch] > i:
                    stack.append((ch, i))
                    waiting[ch] += 1
        elif ch in _PAIRS and last.setdefault(_PAIRS[ch], text.rfind(_PAIRS[ch], i + 1, end)) > i and (ch != "‘" or i == first or not text[i - 1].isalnum()):
            stack.append((_PAIRS[ch], i))
            waiting[_PAIRS[ch]] += 1
        elif ch in ")]}）」』》”»" and waiting[ch]:  # an inner mark was never closed
            while stack[-1][0] != ch:
                waiting[stack.pop()[0]] -= 1
            pairs.append((stack.pop()[1], i + 1))
            waiting[ch] -= 1
    pairs.sort(key=lambda p: (p[0], -p[1]))
    outer: list[tuple[int, int]] = []
    for p in pairs:
        if not outer or p[0] >= outer[-1][1]:
            outer.append(p)
    return code, outer


def _word_before(text: str, first: int, stop: int) -> tuple[str, str]:
    """The token that ends at ``stop`` and the one before it; spelled-apart abbreviations (z. B, т. е) come as one."""
    back = 48
    while True:  # further back until three words are there, so that two are whole
        at = max(first, stop - back)
        words = text[at:stop].split()
        if at == first or len(words) > 2:
            break
        back *= 4
    if at == stop or text[stop - 1].isspace():
        words.append("")
    token = words[-1].lstrip(_OPENING)
    head, mark, rest = token.partition("’" if "’" in token else "'")
    if mark and len(head) <= 2 and head.isalpha() and rest:  # an elided article: l'art
        token = rest
    before = words[-2].lstrip(_OPENING) if len(words) > 1 else ""
    head = before.rstrip(".")
    if 0 < len(token) <= 3 and 0 < len(head) <= 2 and before.endswith(".") and token.isalpha() and head.isalpha():
        return f"{head}.{token}", ""
    return token, before


def _next_word(text: str, at: int, end: int) -> tuple[str, str]:
    """(first character after blanks, first word after opening marks)."""
    m = _re()["next"].match(text, at, end)
    return m[1], m[2].rstrip(".,;:!?…)]}\"'”»“`")


@lru_cache(maxsize=10_000)
def _stops(run: str) -> tuple[bool, bool, bool, bool]:
    """Of a run of stops: is it an ellipsis, has it stops of unspaced scripts, those or a danda, sure ones."""
    some = set(run)
    ellipsis = ("…" in run or ".." in run) and not some & set(_SURE + _FULL)
    return ellipsis, bool(some & set(_FULL)), bool(some & set(_FULL + "।")), bool(some & set(_SURE))


def candidates(text: str, first: int, end: int) -> list[Candidate]:
    """The candidates of the block ``text[first:end]`` in order, without its own end."""
    r = _re()
    code, pairs = _enclosed(text, first, end)
    last = end
    while last > first and text[last - 1].isspace():
        last -= 1
    out: list[Candidate] = []
    ci = pi = 0
    for m in r["candidate"].finditer(text, first, end):
        s, e = m.span()
        while ci < len(code) and code[ci][1] <= s:
            ci += 1
        if ci < len(code) and code[ci][0] < e and not (code[ci][0] >= s and text[s] in " \t"):
            if code[ci][0] <= s < code[ci][1]:
                # an address may carry the stop that ends its sentence
                if text.startswith("`", code[ci][0]) or code[ci][1] != e or not (e >= end or text[e].isspace()):
                    continue
        while pi < len(pairs) and pairs[pi][1] <= s:
            pi += 1
        run = text[s:e]
        if run[0].isspace():
            if pi < len(pairs) and pairs[pi][0] < s:
                continue
            if "ๆ" in (text[s - 1], text[e : e + 1]):
                continue
            out.append(Candidate(s, True))
            continue
        opened = -1
        j = e
        if pi < len(pairs) and pairs[pi][0] < s:
            opened, closes = pairs[pi]
            while j < closes and (text[j] in _CLOSERS or text[j] in _STOPS):
                j += 1
            if j < closes:
                continue
        while j < end and (text[j] in _CLOSERS and not (text[j] in "\"'“‘" and not _closes_here(text, j, end)) or text[j] in _STOPS):
            j += 1
        if j >= last:
            continue  # the end of the block
        if out and out[-1].end >= j:
            continue
        gap = text[j].isspace()
        mark, word = _next_word(text, j, end)
        lead = word[:1] or mark
        before_ch = text[s - 1] if s > first else " "
        tail = text[e:j].strip(_STOPS)
        ellipsis, full, danda, sure = _stops(run)
        if opened >= 0:
            # the mark closes a quotation or bracket whose own last sentence stops here
            whole = opened == _sentence_start(text, first, out)
            if script(lead) in ("cjk", "hangul", "thai", "deva", "arabic") or danda:
                if whole and text[opened] in _BRACKETS and (gap or full):
                    out.append(Candidate(j, True))
                continue
            if not gap:
                continue
            if ellipsis:
                out.append(Candidate(j, _upper(lead)))
            elif (whole and text[opened] in _BRACKETS) or _upper(lead) or lead.isdigit() or mark == "`":
                out.append(Candidate(j, True))
            else:
                out.append(Candidate(j, None, *_seen("", "", word, mark, True)))
            continue
        if ellipsis:
            if _upper(lead) and (gap or run[-1] == "…" or len(run) >= 3):
                out.append(Candidate(j, True))
            continue
        if full or (run[0] in "।॥۔؟"):
            out.append(Candidate(j, True))
            continue
        if script(before_ch) == "cjk":
            if run[-1] in "!?" or gap or script(text[j]) == "cjk" or text[j] in "`「『“《（(":
                out.append(Candidate(j, True))
            continue
        if not gap:
            continue
        if sure:
            out.append(Candidate(j, True))
            continue
        token, earlier = _word_before(text, first, s)
        out.append(Candidate(j, None, *_seen(token, earlier, word, mark, bool(tail))))
    return out


def _closes_here(text: str, j: int, end: int) -> bool:
    return j + 1 >= end or text[j + 1].isspace() or text[j + 1] in _CLOSERS or text[j + 1] in _STOPS


def _sentence_start(text: str, first: int, done: list[Candidate]) -> int:
    """Where the sentence at hand begins, past list and quoting marks; undecided candidates count as ends."""
    i = done[-1].end if done else first
    n = len(text)
    while i < n and (text[i].isspace() or text[i] in ">*-+•#"):
        i += 1
    j = i
    while j < n and text[j].isdigit():
        j += 1
    if i < j < n - 1 and text[j] in ".)" and text[j + 1].isspace() and not done:
        i = j + 1
        while i < n and text[i].isspace():
            i += 1
    return i


# ------------------------------------------------------------------------------------------ classifier

#: What is seen at a stop itself, a bit each.
SEEN = (
    "inner stop", "single letter", "number before", "short before", "lower before", "upper before", "closed before", "upper next", "lower next", "digit next", "caseless next",
    "code next", "opening next", "file-like next", "long before", "dot next", "caseless before", "short next",
)
_BIT = {name: k for k, name in enumerate(SEEN)}
#: What the counts of the corpus add.
NAMES = (
    "bias", *SEEN, "never ends", "never ends and upper next", "never ends and digit next", "never ends and lower next", "before is mostly inside", "mostly inside and upper next",
    "digits follow", "starter", "never starts", "starter in lower case", "follows numbers", "number and lower next", "number after abbreviation", "parts of one abbreviation", "single letter and upper next", "rare before",
    "goes on", "goes on and upper next", "starter and goes on", "never ends and starter",
)


#: Where the ridge pulls the weights: what an example-poor corpus starts from.
BELIEF = {"bias": 1.0, "never ends": -1.5, "lower next": -2.0, "starter": 1.0, "follows numbers": -4.0, "parts of one abbreviation": -3.0, "inner stop": -0.5, "goes on": -1.0}


def _plain(word: str) -> str:
    """A word with every run of digits as one 9, so that numbers share their counts."""
    return word if word.isalpha() else _re()["digits"].sub("9", word)


@lru_cache(maxsize=100_000)
def _seen(token: str, earlier: str, word: str, mark: str, closed: bool) -> tuple[int, str, str, str]:
    """(bits of SEEN, token, next word, the token before a number) of a stop."""
    low = token.lower().rstrip(".")
    lead = word[:1] or mark or " "
    number = bool(token) and token[-1].isdigit()
    code = mark == "`"  # the case of inline code says nothing
    upper, lower, digit = not code and _upper(lead), not code and lead.islower(), not code and lead.isdigit()
    flags = (
        "." in low and low.replace(".", "").isalpha(), len(low) == 1 and low.isalpha(), number, len(low) <= 3 and not number, token[:1].islower(), token[:1].isupper(), closed, upper, lower, digit,
        not upper and not lower and lead.isalpha(), code, mark in "([{\"'“«„「『（¿¡", "." in word or "/" in word, len(low) >= 5, mark == ".",
        bool(token) and token[-1].isalpha() and not token[-1].islower() and not token[-1].isupper(), 0 < len(word) <= 2 and word.isalpha(),
    )
    return sum(1 << k for k, f in enumerate(flags) if f), "9" if number else _plain(low), _plain(word), earlier.lower().rstrip(".") if number else ""


#: Counts of a token that stands before a stop: the stop ends a block; a lower-case word, a digit, anything else follows.
_TOKEN = ("ends", "lower", "digit", "other")
#: Counts of a word: it begins a block; it follows a stop inside one; it follows a number and a stop.
_WORD = ("begins", "follows", "after number")


def _observations(state: int, bits: int, token: str, word: str) -> list[tuple[str, str, int]]:
    """(t or w, token or word, which count) of a stop that ends a block (END) or may end a sentence (OPEN)."""
    if state == END:
        return [("t", token, 0), ("w", word, 0)]
    follows = 1 if bits >> _BIT["lower next"] & 1 else 2 if bits >> _BIT["digit next"] & 1 else 3
    out = [("t", token, follows), ("w", word, 1)]
    return [*out, ("w", word, 2)] if bits >> _BIT["number before"] & 1 else out


def _known_beforehand() -> dict[tuple[str, str], list[int]]:
    out: dict[tuple[str, str], list[int]] = {("t", w): [0, PRIOR, PRIOR, PRIOR] for w in FOLLOWED}
    for w in ENDING:
        out["t", w] = [PRIOR // 2, PRIOR, 0, PRIOR // 2]
    for w in MONTHS:
        for form in (w, w.capitalize()):
            out["w", form] = [0, PRIOR, PRIOR]
    return out


@dataclass
class Model:
    """Weights, and the counts by token and by word that features are made of; the prior is in them."""

    weights: np.ndarray
    counts: dict
    base: float = 0.3  # the share of all stops that end blocks
    total_begins: float = 1.0
    _memo: dict = field(default_factory=dict, repr=False)

    @classmethod
    def of(cls, counts: Iterable[tuple[str, str, list[int]]]) -> Model:
        """A model without weights from (t or w, token or word, counts)."""
        merged, sums, begins = _known_beforehand(), np.zeros(4), 0
        for kind, key, n in counts:
            old = merged.get((kind, key))
            merged[kind, key] = list(n) if old is None else [a + b for a, b in zip(old, n)]
            if kind == "t":
                sums += np.asarray(n, float)[:4]
            else:
                begins += n[0]
        base = (sums[0] + 1) / (sums.sum() + 3)
        return cls(np.zeros(len(NAMES)), merged, float(np.clip(base, 0.02, 0.9)), max(1.0, float(begins)))

    def never_ends(self, token: str) -> float:
        """How far a token ends blocks less often than tokens do that stand before so many stops, in deviations."""
        n = self.counts.get(("t", token))
        if not token or n is None or token == "9":
            return 0.0
        expected = self.base * sum(n)
        return float(np.clip((expected - n[0]) / np.sqrt(expected + 1), -4, 4))

    def row(self, bits: int, token: str, word: str, earlier: str) -> tuple:
        has = lambda name: bits >> _BIT[name] & 1
        ends, lower, digit, other = self.counts.get(("t", token), (0, 0, 0, 0)) if token and token != "9" else (0, 0, 0, 0)
        begins, follows, after = self.counts.get(("w", word), (0, 0, 0))
        n = ends + lower + digit + other
        z = self.never_ends(token)
        inside = (lower - ends) / (n + 2)
        starter = float(np.log1p(1e4 * begins / self.total_begins)) / 3
        number, on = has("number before"), self.goes_on(token)
        return (
            1.0, *(float(bits >> k & 1) for k in range(len(SEEN))), z, z * has("upper next"), z * has("digit next"), z * has("lower next"), inside, inside * has("upper next"), digit / (n + 2), starter,
            float(has("lower next") and self.never_begins(word)), starter * has("lower next"), number * (after - begins) / (after + begins + 1), float(number and has("lower next")),
            max(0.0, self.never_ends(earlier)) if number else 0.0, self.joined(token, word), float(has("single letter") and has("upper next")), 1.0 / (1 + n),
            on, on * has("upper next"), on * starter, z * starter,
        )

    def joined(self, token: str, word: str) -> float:
        """How surely token and word are parts of one abbreviation that is spelled apart (z. B.)."""
        if not (0 < len(token) <= 2 and 0 < len(word) <= 3):
            return 0.0
        return max(0.0, self.never_ends(f"{token}.{word}".lower()))

    def goes_on(self, token: str) -> float:
        """The share of a token's stops that a lower-case word or a digit follows."""
        n = self.counts.get(("t", token))
        return (n[1] + n[2]) / (sum(n) + 1) if n is not None and token and token != "9" else 0.0

    def never_begins(self, word: str) -> bool:
        begins, follows, _ = self.counts.get(("w", word), (0, 0, 0))
        return begins <= 0.01 * follows

    def label(self, bits: int, token: str, word: str, earlier: str) -> int | None:
        """1 or 0 for a stop inside a block that plainly is, or is not, the end of a sentence; None for all others."""
        has = lambda name: bits >> _BIT[name] & 1
        begins, follows, after = self.counts.get(("w", word), (0, 0, 0))
        z = self.never_ends(token)
        if has("lower next"):
            if self.never_begins(word):
                return 0
            if begins >= 5 and begins >= 0.2 * follows and z < 0.5:
                return 1  # a name in lower case
        if self.joined(token, word) >= 2:
            return 0
        if has("number before") and after >= 5 and begins <= 0.02 * after and not has("digit next"):
            return 0
        if has("upper next") and begins >= 5 and 1e4 * begins / self.total_begins >= 5:
            return 1 if self.goes_on(token) < 0.9 and not has("short next") else None
        return 0 if z >= 2.5 else None

    def train(self, stops: Iterable[tuple[int, int, str, str, str]], rounds: int = 400, ridge: float = 1e-3) -> Model:
        """Fits the weights on the reliable ones of (state, bits, token, word, token before a number)."""
        x, y = [], []
        for state, *stop in stops:
            label = 1 if state == END else self.label(*stop)
            if label is not None:
                x.append(self.row(*stop))
                y.append(label)
        before = np.zeros(len(NAMES))  # what is believed of the weights without any data
        for name, value in BELIEF.items():
            before[NAMES.index(name)] = value
        w = before.copy()
        if 0 < sum(y) < len(y):
            x, y = np.asarray(x, float), np.asarray(y, float)
            balance = np.where(y == 1, 0.5 / y.sum(), 0.5 / (1 - y).sum())
            for _ in range(rounds):  # Newton steps until the weights rest
                p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
                grad = x.T @ (balance * (p - y)) + ridge * (w - before)
                hess = (x * (balance * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
                step = np.linalg.solve(hess, grad)
                w -= step
                if np.abs(step).max() < 1e-6:
                    break
        self.weights = w
        return self

    def ends(self, bits: int, token: str, word: str, earlier: str) -> bool:
        key = (bits, token, word, earlier)
        if key not in self._memo:
            if len(self._memo) > 200_000:
                self._memo.clear()
            self._memo[key] = float(np.dot(self.weights, np.asarray(self.row(*key), float))) > 0
        return self._memo[key]

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "_memo"} | {"_memo": {}}


# --------------------------------------------------------------------------------------------- units

#: States of a point of a text: a stop for the classifier, a sure end, the end of a block; END is no point but an example.
OPEN, SURE, BLOCK, END = range(4)


def points(text: str | None) -> tuple[int, list[tuple]]:
    """(where the first unit begins, points); a point is (state, end, next beginning, bits, token, word, token before a number).

    The stop that a block ends with is told once more, as an END with the first word of the block after it (of
    the text's first block for the last): examples for the classifier.
    """
    out: list[tuple] = []
    start, leads, lasts = 0, [], []
    n = len(text or "")
    for first, end, kind in blocks(text or ""):
        a, b = first, end
        while a < b and text[a].isspace():
            a += 1
        while b > a and text[b - 1].isspace():
            b -= 1
        if a == b:
            continue
        if out:
            out[-1] = (*out[-1][:2], a, *out[-1][3:])
        else:
            start = a
        if kind not in ("code", "heading"):
            lead = _sentence_start(text, first, [])
            body = lead if kind == "item" else first  # the stop of a marker ends nothing
            for c in candidates(text, body, end):
                if c.verdict is not False:
                    after = c.end
                    while after < n and text[after].isspace():
                        after += 1
                    out.append((OPEN if c.verdict is None else SURE, c.end, after, c.bits, c.token, c.word, c.earlier))
            leads.append(_next_word(text, lead, end))
            if text[b - 1] == "." and not text.endswith("..", 0, b):
                lasts.append((len(leads) - 1, _word_before(text, body, b - 1)))
        out.append((BLOCK, b, b, 0, "", "", ""))
    for k, (token, earlier) in lasts:
        mark, word = leads[(k + 1) % len(leads)]
        out.append((END, 0, 0, *_seen(token, earlier, word, mark, False)))
    return start, out


def units(text: str | None, model: Model) -> list[tuple[int, int]]:
    """(start, end) of the sentence units of a text in code points, from the first to the last non-blank character."""
    out = []
    start, all_points = points(text)
    for state, end, after, *stop in all_points:
        if state == END:
            break
        if state != OPEN or model.ends(*stop):
            if end > start:
                out.append((start, end))
            start = after
    return out


def fit(texts: list[str]) -> Model:
    """The model of a few texts, counted and fitted here; :func:`fit_corpus` is the same over a table."""
    counts, stops = {}, []
    for text in texts:
        for state, _, _, *stop in points(text)[1]:
            if state in (OPEN, END):
                stops.append((state, *stop))
                for kind, key, which in _observations(state, *stop[:3]):
                    counts.setdefault((kind, key), [0] * (len(_TOKEN) if kind == "t" else len(_WORD)))[which] += 1
    return Model.of((kind, key, n) for (kind, key), n in counts.items()).train(stops)


_POINTS = "doc_id long, first int, state array<int>, at array<int>, after array<int>, bits array<int>, token array<string>, word array<string>, earlier array<string>"


def _parse(batches: Iterator) -> Iterator:
    """mapInArrow: (doc_id, text) -> the points of each text."""
    import pyarrow as pa

    kinds = [pa.int32()] * 4 + [pa.string()] * 3
    names = [c.split()[0] for c in _POINTS.split(", ")]
    for batch in batches:
        firsts, lists = [], [[] for _ in kinds]
        for text in batch.column(1).to_pylist():
            start, all_points = points(text)
            firsts.append(start)
            for held, column in zip(lists, zip(*all_points) if all_points else [()] * len(kinds)):
                held.append(column)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(firsts, pa.int32()), *(pa.array(v, pa.list_(t)) for v, t in zip(lists, kinds))], names=names)


def fit_corpus(parsed: DataFrame, limit: int = TRAINING_STOPS, rare: float = RARE) -> Model:
    """The model of all documents, from the table of their points.

    Tokens and words are counted over all of them. What the driver receives is bounded: counts of those that
    make up at least ``rare`` of all observations, and about ``limit`` stops, chosen by a hash.
    """
    stop = F.explode(F.filter(F.arrays_zip("state", "bits", "token", "word", "earlier"), lambda p: p["state"].isin(OPEN, END))).alias("p")
    stops = parsed.select("doc_id", stop).select("doc_id", "p.*")
    bit = lambda name: (F.shiftright("bits", _BIT[name]) % 2) == 1
    ended = F.col("state") == END
    one = lambda condition: F.when(condition, 1).otherwise(0)
    lower, digit = ~ended & bit("lower next"), ~ended & ~bit("lower next") & bit("digit next")
    of_token = F.array(one(ended), one(lower), one(digit), one(~ended & ~bit("lower next") & ~bit("digit next")))
    of_word = F.array(one(ended), one(~ended), one(~ended & bit("number before")), F.lit(0))
    seen = stops.select(F.explode(F.array(F.struct(F.lit("t").alias("kind"), F.col("token").alias("key"), of_token.alias("n")), F.struct(F.lit("w").alias("kind"), F.col("word").alias("key"), of_word.alias("n")))).alias("o"))
    counts = materialize(seen.groupBy("o.kind", "o.key").agg(*[F.sum(F.col("o.n")[k]).alias(f"n{k}") for k in range(4)]), "stop-counts")
    total = counts.agg(F.sum(F.when(F.col("kind") == "t", F.col("n0") + F.col("n1") + F.col("n2") + F.col("n3")))).first()[0] or 0
    common = counts.where(F.col("n0") + F.col("n1") + F.col("n2") + F.col("n3") >= rare * total)
    model = Model.of((r["kind"], r["key"], [r["n0"], r["n1"], r["n2"], r["n3"]] if r["kind"] == "t" else [r["n0"], r["n1"], r["n2"]]) for r in common.collect())
    sample = stops
    if total > limit:
        share = 0.9 * limit / total  # places are spread evenly: more than limit is out of reach
        sample = parsed.select("doc_id", F.posexplode(F.arrays_zip("state", "bits", "token", "word", "earlier")).alias("i", "p")).where(F.xxhash64("doc_id", "i") < int(-(1 << 63) + share * (1 << 64)))
        sample = sample.where(F.col("p.state").isin(OPEN, END)).select("p.*")
    rows = sample.select("state", "bits", "token", "word", "earlier").limit(limit).collect()
    return model.train(map(tuple, rows))


_UNITS = "doc_id long, start_pos long, end_pos long"


def sentence_units(documents: DataFrame, model: Model | None = None) -> DataFrame:
    """(doc_id, start_pos, end_pos) of every sentence of every document; positions are code points, end exclusive.

    ``documents`` needs ``doc_id`` and ``text``; other columns are ignored. NULL, empty and blank texts have no
    units. Whole texts are read, however long, once and without a shuffle; their points are kept in the shared
    folder until the classifier is fitted (:func:`fit_corpus`, unless a ``model`` is given) and then decided.
    """
    spark = documents.sparkSession
    parsed = documents.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long"), "text").mapInArrow(_parse, _POINTS)
    if model is None:
        parsed = materialize(parsed, "sentence-points")
        model = fit_corpus(parsed)
    shared = spark.sparkContext.broadcast(model)  # bounded: see fit_corpus

    def cut(batches: Iterator) -> Iterator:
        import pyarrow as pa

        ends = shared.value.ends
        for batch in batches:
            sizes = np.diff(batch.column(2).offsets.to_numpy())
            flat = [batch.column(k).flatten() for k in range(2, 9)]
            state, at, after = (c.to_numpy().astype(np.int64) for c in flat[:3])
            open_ = np.flatnonzero(state == OPEN)
            keep = (state == SURE) | (state == BLOCK)
            if len(open_):
                take = pa.array(open_)
                keep[open_] = list(map(ends, *(c.take(take).to_pylist() for c in flat[3:])))
            doc = np.repeat(np.arange(len(sizes)), sizes)[keep]
            end, begin = at[keep], after[keep]
            starts = np.empty(len(end), np.int64)
            starts[1:] = begin[:-1]
            new = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]])) if len(doc) else np.empty(0, np.int64)
            starts[new] = batch.column(1).to_numpy()[doc[new]]
            real = end > starts
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(doc[real])), pa.array(starts[real]), pa.array(end[real])], names=["doc_id", "start_pos", "end_pos"])

    return parsed.mapInArrow(cut, _UNITS)
