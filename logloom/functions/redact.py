"""Secrets taken out of texts that are shown.

Every shape is looked for in the original text and gives a span; spans are widened to where the secret
plausibly ends, merged, and replaced once, so no shape reads another's replacement. Widening errs on the
side of hiding too much.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

REDACTED = "[redacted]"

# Shapes of issued tokens, names of keys, and where a value ends.
TOKENS = (
    r"(?<![A-Za-z0-9])AKIA[A-Z0-9]{12,}",
    r"(?<![A-Za-z0-9])Bearer [A-Za-z0-9._~+/-]{8,}",
    r"(?<![A-Za-z0-9_-])xox[abeoprs]-[A-Za-z0-9-]{6,}",
    r"(?<![A-Za-z0-9_])gh[pousr]_[A-Za-z0-9]{10,}",
    r"(?<![A-Za-z0-9_])github_pat_[A-Za-z0-9_]{10,}",
    r"(?<![A-Za-z0-9_-])sk-(?:ant-|proj-)?[A-Za-z0-9_-]{16,}",
    r"(?<![A-Za-z0-9_])AIza[A-Za-z0-9_-]{20,}",
    r"(?<![A-Za-z0-9_.-])eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}",
)
KEY_NAMES = r"(?<![A-Za-z0-9])[A-Za-z0-9_-]*(?:aws_secret_access_key|client_secret|api[_-]?key|secret[_-]?key|private[_-]?key|passphrase|passwd|password|pwd|token|secret)(?![A-Za-z])"
PEM_HEAD = r"-----BEGIN [A-Z ]*PRIVATE KEY(?: BLOCK)?-----"
PEM_FOOT = r"-----END [A-Z ]*PRIVATE KEY(?: BLOCK)?-----"
URL_LOGIN = r"://[^\s/@:]*:([^\s/@]+)@"


@lru_cache(maxsize=1)
def _shapes():
    return (
        re.compile("|".join(TOKENS)),
        re.compile(KEY_NAMES + r"""(?:\\?["'])?\]?[ \t]*[:=]""", re.IGNORECASE),
        re.compile(PEM_HEAD),
        re.compile(PEM_FOOT),
        re.compile(URL_LOGIN),
        re.compile(r"[^\s\"'`,;<>)\]}\\]*"),
    )


def _value_end(text: str, at: int) -> int:
    """Where the value of a key ends: its closing quote, else the end of its line and of lines that continue it."""
    while at < len(text) and text[at] in " \t":
        at += 1
    escaped = text.startswith('\\"', at)
    quote = '\\"' if escaped else text[at : at + 1]
    if quote in ('"', "'", "`", '\\"'):
        i = at + len(quote)
        while i < len(text):
            if text.startswith(quote, i):
                return i + len(quote)
            i += 2 if text[i] == "\\" and not escaped else 1
        return len(text)
    end = at
    while True:
        nl = text.find("\n", end)
        if nl < 0:
            return len(text)
        if text[at:nl].strip() and not text[end:nl].rstrip("\r").endswith("\\"):
            return nl  # the value stood on this line
        end = nl + 1


def secret_spans(text: str) -> list[tuple[int, int]]:
    """Merged spans of everything that looks like a secret."""
    token, key, head, foot, login, rest = _shapes()
    spans = [(m.start(), rest.match(text, m.end()).end()) for m in token.finditer(text)]
    spans += [m.span(1) for m in login.finditer(text)]
    reach = 0
    for m in key.finditer(text):
        if m.start() >= reach:
            reach = _value_end(text, m.end())
            spans.append((m.start(), reach))
    at = 0
    while m := head.search(text, at):
        end = foot.search(text, m.end())
        at = end.end() if end else len(text)
        spans.append((m.start(), at))
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def redact(text) -> str:
    """The text without its secrets; '' for anything that is no text."""
    if not isinstance(text, str):
        return ""
    out, at = [], 0
    for a, b in secret_spans(text):
        out += [text[at:a], REDACTED]
        at = b
    return "".join([*out, text[at:]])


def shown(text) -> str:
    """Redacted, control and format characters spelled out, and redacted again, so that none of them hid a secret."""
    import unicodedata

    plain = redact(text)
    bare = "".join(c if c in "\n\t" or unicodedata.category(c) not in ("Cc", "Cf") else f"\\x{ord(c):02x}" for c in plain)
    return redact(bare)


def with_redacted(df, text: str = "text", spelled: bool = False):
    """Adds ``redacted`` and ``n_secrets`` in one Arrow pass; a NULL text gives '' and 0. ``spelled``: as :func:`shown`."""
    from pyspark.sql import functions as F

    kept = [c for c in df.columns if c not in ("redacted", "n_secrets")]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*kept).schema.fields) + ", redacted string, n_secrets int"

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            texts = batch.column(batch.num_columns - 1).to_pylist()
            counts = [len(secret_spans(t)) if t else 0 for t in texts]
            clean = [shown(t) if spelled else (redact(t) if n else t) or "" for t, n in zip(texts, counts)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(clean, pa.string()), pa.array(counts, pa.int32())], names=[*batch.schema.names[:-1], "redacted", "n_secrets"])

    return df.select(*kept, F.col(text).alias("__text")).mapInArrow(run, schema)
