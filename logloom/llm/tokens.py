"""Encoding of whole texts with a public byte-level BPE.

The ranks are read from a local file (one base64 token and its number per line); nothing is trained and
nothing is downloaded. An encoder is built once per Python worker.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Where the vocabulary files lie; override with the parameter ``ranks`` or this environment variable.
VOCABULARY_FOLDER = os.environ.get("LOGLOOM_TOKENIZERS", "/opt/tokenizers")
#: Fixed value: the pre-tokenisation pattern that belongs to the 50k byte-level vocabularies.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Texts longer than this many characters are encoded in pieces, cut where no token can reach across.
PIECE = 100_000


def default_ranks(name: str = "byte_bpe_50k") -> str:
    return f"{VOCABULARY_FOLDER}/{name}.tiktoken"


@lru_cache(maxsize=4)
def encoder(ranks: str):
    import tiktoken

    with open(ranks, "rb") as lines:
        table = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding(os.path.basename(ranks), pat_str=PATTERN, mergeable_ranks=table, special_tokens={})


@lru_cache(maxsize=1)
def _cuts():
    import regex

    # No pre-token holds a blank after a non-blank, nor a digit after a letter or the reverse: cutting between them is safe.
    return regex.compile(r"(?<=\S)(?=\s)|(?<=\p{L})(?=\p{N})|(?<=\p{N})(?=\p{L})")


def pieces(text: str, size: int = PIECE) -> list[str]:
    """``text`` cut at safe places into pieces of about ``size`` characters; one longer run without a safe place stays whole."""
    out, at = [], 0
    while len(text) - at > size:
        cut = _cuts().search(text, at + size)
        if cut is None:
            break
        out.append(text[at : cut.start()])
        at = cut.start()
    out.append(text[at:])
    return out


def encode_text(text: str | None, ranks: str) -> list[int]:
    """Token ids of one text; the empty list for None and ''. What looks like a special token is plain text."""
    if not text:
        return []
    e = encoder(ranks)
    if len(text) <= PIECE:
        return e.encode_ordinary(text)
    return [i for p in pieces(text) for i in e.encode_ordinary(p)]


def decode_bytes(ids: list[int], ranks: str) -> bytes:
    """The exact UTF-8 bytes that ``ids`` stand for, also where a character is split over tokens."""
    return encoder(ranks).decode_bytes(ids)


def encode_corpus(df: DataFrame, text: str = "text", ids: str = "ids", ranks: str | None = None, keep: list[str] | None = None) -> DataFrame:
    """Adds ``ids`` (array<int>), the token ids of ``text``, to the columns ``keep`` (default: all but the text).

    NULL and empty texts give an empty list, never NULL; blank texts are encoded as they stand. No shuffle.
    """
    ranks = ranks or default_ranks()
    keep = keep if keep is not None else [c for c in df.columns if c not in (text, ids)]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keep).schema.fields)

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            lists = [encode_text(t, ranks) for t in batch.column(batch.num_columns - 1).to_pylist()]
            offsets = np.zeros(len(lists) + 1, np.int32)
            np.cumsum([len(x) for x in lists], out=offsets[1:])
            flat = np.fromiter((i for x in lists for i in x), np.int32, int(offsets[-1]))
            column = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], column], names=[*batch.schema.names[:-1], ids])

    return df.select(*keep, F.col(text).alias("__text")).mapInArrow(run, f"{schema}, `{ids}` array<int>")


def decode_corpus(df: DataFrame, ids: str = "ids", raw: str = "raw", ranks: str | None = None, keep: list[str] | None = None) -> DataFrame:
    """The way back: adds ``raw`` (binary), the bytes of the text. NULL or empty ids give no bytes."""
    ranks = ranks or default_ranks()
    keep = keep if keep is not None else [c for c in df.columns if c not in (raw, ids)]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keep).schema.fields)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            column = pa.array([decode_bytes(x or [], ranks) for x in batch.column(batch.num_columns - 1).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], column], names=[*batch.schema.names[:-1], raw])

    return df.select(*keep, F.col(ids).alias("__ids")).mapInArrow(run, f"{schema}, `{raw}` binary")
