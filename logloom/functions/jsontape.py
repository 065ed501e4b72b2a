"""Vectorised structural index of many JSON texts at once.

A batch of texts is one byte buffer. Bitmaps of quotes, brackets and delimiters come from a few passes of
numpy over it; strings are told from structure by the running parity of unescaped quotes, nesting by the
running sum of brackets. What remains is a tape of tokens, each with its span, its container, its key and
its place in the container. No text is parsed on its own.

A text counts as readable if it is one JSON value: brackets match, the order of tokens obeys the grammar,
scalars are numbers, true, false or null (also NaN and Infinity, as runtimes write them), strings hold
neither control characters nor unknown escapes.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass

import numpy as np

OPEN_OBJ, CLOSE_OBJ, OPEN_ARR, CLOSE_ARR, COLON, COMMA, KEY, STRING, SCALAR = range(9)
_KINDS = np.full(256, 255, np.uint8)
for _i, _c in enumerate(b"{}[]:,"):
    _KINDS[_c] = _i
_SPACE = np.zeros(256, bool)
_SPACE[list(b" \t\n\r")] = True
_ESCAPE = np.zeros(256, bool)
_ESCAPE[list(b'"\\/bfnrtu')] = True
_HEX = np.zeros(256, bool)
_HEX[list(b"0123456789abcdefABCDEF")] = True
_SCALAR = re.compile(rb"-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?|true|false|null|NaN|-?Infinity")

_STARTS = (OPEN_OBJ, OPEN_ARR, STRING, SCALAR)
_ENDS = (CLOSE_OBJ, CLOSE_ARR, STRING, SCALAR)
#: _ALLOWED[container is an array][previous token][token]
_ALLOWED = np.zeros((2, 9, 9), bool)
for _a, _b in [(OPEN_OBJ, KEY), (OPEN_OBJ, CLOSE_OBJ), (KEY, COLON), (COMMA, KEY)]:
    _ALLOWED[0, _a, _b] = True
_ALLOWED[0, COLON, list(_STARTS)] = True
_ALLOWED[1, OPEN_ARR, [*_STARTS, CLOSE_ARR]] = True
_ALLOWED[1, COMMA, list(_STARTS)] = True
for _e in _ENDS:
    _ALLOWED[0, _e, [COMMA, CLOSE_OBJ]] = True
    _ALLOWED[1, _e, [COMMA, CLOSE_ARR]] = True


@dataclass
class Tape:
    """Tokens of a batch. ``parent`` is the token that opens the container (-1: none), ``key`` the token of the
    value's key (-1: none), ``place`` the 0-based place of a value among its container's values. ``readable``
    is by text; tokens of unreadable texts stay on the tape and must be left aside by the caller."""

    data: np.ndarray
    kind: np.ndarray
    start: np.ndarray
    end: np.ndarray
    text: np.ndarray
    parent: np.ndarray
    key: np.ndarray
    place: np.ndarray
    value: np.ndarray
    readable: np.ndarray
    backslashes: np.ndarray

    def raw(self, i: int) -> bytes:
        return self.data[self.start[i] : self.end[i]].tobytes()

    def load(self, i: int):
        """The Python value of token ``i`` (a container is read whole)."""
        return json.loads(self.raw(i))

    def string(self, i: int) -> str:
        raw = self.data[self.start[i] + 1 : self.end[i] - 1].tobytes()
        return json.loads(self.raw(i)) if b"\\" in raw else raw.decode()

    def keyed(self, name: str) -> np.ndarray:
        """Values whose key is ``name``; of a key repeated in one object the last."""
        want = np.frombuffer(json.dumps(name).encode(), np.uint8)
        at = np.flatnonzero(self.value & (self.key >= 0))
        k = self.key[at]
        hit = self.end[k] - self.start[k] == len(want)
        at, k = at[hit], k[hit]
        if len(at):
            same = (self.data[self.start[k][:, None] + np.arange(len(want))] == want).all(1)
            at = at[same]
        other = self._escaped_keys.get(name)
        if other is not None:
            at = np.union1d(at, other)
        if len(at) > 1:  # the last of each parent
            _, last = np.unique(self.parent[at][::-1], return_index=True)
            at = np.sort(at[::-1][last])
        return at

    def __post_init__(self):
        self._escaped_keys: dict[str, np.ndarray] = {}
        keys = np.flatnonzero(self.value & (self.key >= 0) & self.readable[self.text])
        if len(keys) and len(self.backslashes):
            k = self.key[keys]
            has = np.searchsorted(self.backslashes, self.end[k]) > np.searchsorted(self.backslashes, self.start[k])
            for i in keys[has]:
                name = json.loads(self.raw(self.key[i]))
                self._escaped_keys[name] = np.append(self._escaped_keys.get(name, np.empty(0, np.int64)), i)


def index(data: np.ndarray, offsets: np.ndarray) -> Tape:
    """``data``: the bytes of all texts, ``offsets``: where each starts, and the end of the last."""
    n, starts, ends = len(offsets) - 1, offsets[:-1].astype(np.int64), offsets[1:].astype(np.int64)
    base = int(offsets[0])
    data, starts, ends = data[base : offsets[-1]], starts - base, ends - base  # buffers may be longer than their texts
    full = starts < ends
    readable = full.copy()
    firsts = np.zeros(len(data) + 1, bool)
    firsts[starts[full]] = True
    text_of = lambda pos: np.searchsorted(ends, pos, side="right")

    # Backslash runs of odd length escape the byte after them.
    slash = data == 92
    slashes = np.flatnonzero(slash)
    escaped = np.zeros(len(data) + 1, bool)
    if len(slashes):
        new = np.ones(len(slashes), bool)
        new[1:] = (np.diff(slashes) != 1) | firsts[slashes[1:]]
        run_first = slashes[new]
        run_end = np.append(slashes[np.flatnonzero(new)[1:] - 1], slashes[-1]) + 1
        odd = (run_end - run_first) % 2 == 1
        escaped[run_end[odd]] = True
        escaped[:-1] &= ~firsts[:-1]
    quote = (data == 34) & ~escaped[:-1]
    quotes = np.flatnonzero(quote)
    count = np.searchsorted(quotes, ends) - np.searchsorted(quotes, starts)
    readable &= count % 2 == 0

    # Parity of quotes, put back to even where a text was cut inside a string.
    toggles = quote.copy()
    broken = np.flatnonzero(full & (count % 2 == 1))
    after = ends[broken]
    after = after[after < len(data)]
    toggles[after] ^= True
    inside = np.bitwise_xor.accumulate(toggles.view(np.uint8)).view(bool) if len(data) else np.zeros(0, bool)
    outside = ~inside & ~quote
    opening = quotes[inside[quotes]]

    bad = np.flatnonzero(inside & (data < 32))
    readable[text_of(bad)] = False
    if len(slashes):
        esc = np.flatnonzero(escaped[:-1])
        esc_ok = _ESCAPE[data[esc]]
        u = esc[data[esc] == 117]
        padded = np.concatenate([data, np.zeros(4, np.uint8)])
        u_bad = u[~_HEX[padded[u[:, None] + np.arange(1, 5)]].all(1)] if len(u) else u
        readable[text_of(np.concatenate([esc[~esc_ok], u_bad]))] = False

    kinds = np.where(outside, _KINDS[data], 255)
    struct = np.flatnonzero(kinds != 255)
    plain = outside & (kinds == 255) & ~_SPACE[data]
    was = np.empty_like(plain)
    was[:1] = False
    was[1:] = plain[:-1]
    s_first = np.flatnonzero(plain & (~was | firsts[:-1]))
    follows = np.ones_like(plain)
    follows[:-1] = ~plain[1:] | firsts[1:-1]
    s_end = np.flatnonzero(plain & follows) + 1
    closing = quotes[~inside[quotes]]
    # each opening quote ends at the next closing one of its text
    q_end = np.searchsorted(closing, opening)
    str_end = np.where(q_end < len(closing), np.append(closing, len(data))[np.minimum(q_end, len(closing))] + 1, len(data))

    pos = np.concatenate([struct, opening, s_first])
    end = np.concatenate([struct + 1, str_end, s_end])
    kind = np.concatenate([kinds[struct], np.full(len(opening), STRING, np.uint8), np.full(len(s_first), SCALAR, np.uint8)])
    order = np.argsort(pos, kind="stable")
    pos, end, kind = pos[order], end[order], kind[order].astype(np.uint8)
    text = text_of(pos)
    end = np.minimum(end, ends[text]) if len(pos) else end
    m = len(pos)
    lead = np.ones(m, bool)
    lead[1:] = text[1:] != text[:-1]

    step = np.zeros(m, np.int64)
    step[(kind == OPEN_OBJ) | (kind == OPEN_ARR)] = 1
    step[(kind == CLOSE_OBJ) | (kind == CLOSE_ARR)] = -1
    total = np.cumsum(step)
    first_token = np.searchsorted(text, np.arange(n))
    before_text = np.where(first_token > 0, total[np.minimum(first_token, m) - 1], 0) if m else np.zeros(n, np.int64)
    depth = total - step - before_text[text] if m else total  # before the token
    last_token = np.searchsorted(text, np.arange(n), side="right") - 1
    has_tokens = last_token >= first_token
    readable &= has_tokens
    if m:
        closed = np.zeros(n, bool)
        closed[has_tokens] = total[last_token[has_tokens]] == before_text[has_tokens]
        readable &= closed
        readable[text[(depth + step < 0)]] = False

    # The container: the latest opening bracket one level up.
    parent = np.full(m, -1, np.int64)
    if m:
        level = np.clip(depth, 0, None)
        opens = np.flatnonzero(step == 1)
        okey = level[opens] * m + opens
        o = np.argsort(okey, kind="stable")
        okey, opens = okey[o], opens[o]
        inner = np.flatnonzero(level > 0)
        at = np.searchsorted(okey, (level[inner] - 1) * m + inner) - 1
        p = np.where(at >= 0, opens[np.maximum(at, 0)], -1) if len(opens) else np.full(len(inner), -1)
        ok = (p >= 0) & (text[np.maximum(p, 0)] == text[inner])
        if len(opens):
            ok &= level[np.maximum(p, 0)] == level[inner] - 1
        parent[inner] = np.where(ok, p, -1)
    in_array = np.zeros(m, np.int64)
    has_parent = parent >= 0
    in_array[has_parent] = kind[parent[has_parent]] == OPEN_ARR

    prev = np.empty(m, np.int64)
    prev[:1] = 0
    prev[1:] = kind[:-1]
    is_key = (kind == STRING) & has_parent & (in_array == 0) & ~lead & ((prev == OPEN_OBJ) | (prev == COMMA))
    kind[is_key] = KEY
    prev[1:] = kind[:-1]
    good = np.where(lead, np.isin(kind, _STARTS), has_parent & _ALLOWED[in_array, prev, kind])
    readable[text[~good]] = False
    closes = np.flatnonzero(step == -1)
    wrong = closes[has_parent[closes] & ((kind[closes] == CLOSE_ARR) != (in_array[closes] == 1))]
    readable[text[wrong]] = False

    scalars = np.flatnonzero(kind == SCALAR)
    if len(scalars):
        raw = data.tobytes()
        known: dict[bytes, bool] = {}
        for i in scalars.tolist():
            w = raw[pos[i] : end[i]]
            if w not in known:
                known[w] = bool(_SCALAR.fullmatch(w))
            if not known[w]:
                readable[text[i]] = False

    value = np.isin(kind, _STARTS)
    key = np.full(m, -1, np.int64)
    vk = np.flatnonzero(value & has_parent & (in_array == 0))
    vk = vk[vk >= 2]
    vk = vk[(kind[vk - 1] == COLON) & (kind[vk - 2] == KEY)]
    key[vk] = vk - 2
    place = np.zeros(m, np.int64)
    vals = np.flatnonzero(value)
    if len(vals):
        o = np.argsort(parent[vals], kind="stable")
        sv = vals[o]
        sp = parent[sv]
        head = np.ones(len(sv), bool)
        head[1:] = sp[1:] != sp[:-1]
        place[sv] = np.arange(len(sv)) - np.maximum.accumulate(np.where(head, np.arange(len(sv)), 0))
    # spans of containers reach to their closing bracket
    if len(closes):
        c = closes[has_parent[closes]]
        end[parent[c]] = end[c]
    return Tape(data, kind, pos, end, text, parent, key, place, value, readable, slashes)


def arrow_bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of an Arrow string column without copying; a NULL is an empty text."""
    import pyarrow as pa

    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    _, off, buf = column.buffers()
    offsets = np.frombuffer(off, np.int64, len(column) + 1, column.offset * 8)
    return (np.frombuffer(buf, np.uint8) if buf is not None else np.zeros(0, np.uint8)), offsets
