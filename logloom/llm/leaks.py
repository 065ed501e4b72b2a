"""Held-out passages in training texts, found with a generalised suffix automaton of the test items.

The automaton is built over the items' normalised tokens. A document's tokens are streamed through it; at
every token the state gives the longest suffix read so far that occurs in some item, and the states above it
the items with the lengths that they share. Many items make several automata: each is built by one task,
written to the shared folder and loaded by the tasks that read the documents, which are scanned once.
"""

from __future__ import annotations

import pickle
import uuid
from array import array
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logloom.storage import arrow_filesystem, qualified, scratch

#: Consecutive words that make a leak, and consecutive characters in an unspaced script (items with a lang of zh).
WORDS, CHARACTERS = 13, 20
#: Characters of item text per automaton (an item is never divided), about 40 MB of it in a task.
BLOCK_CHARACTERS = 1_000_000
#: Automata that a task keeps loaded; beyond that they are loaded anew for each batch of documents.
HELD_BLOCKS = 8


@lru_cache(maxsize=1)
def _patterns():
    import regex

    return regex.compile(r"\p{Cf}+|\p{Variation_Selector}+"), regex.compile(r"\p{Han}|[\p{L}\p{M}\p{N}--\p{Han}]+", regex.V1), regex.compile(r"\p{Han}"), regex.compile(r"\X")


def normalised_tokens(text: str | None) -> list[str]:
    """Words in lower case and single Chinese characters; punctuation, mark-up, blanks and invisible characters are gone.

    Compatibility forms are folded (NFKC), so full-width letters equal plain ones. NULL has no tokens.
    """
    if not text:
        return []
    import unicodedata

    invisible, token, *_ = _patterns()
    return token.findall(text.casefold() if text.isascii() else unicodedata.normalize("NFKC", invisible.sub("", text)).casefold())


def placed_tokens(text: str) -> list[tuple[str, int, int]]:
    """:func:`normalised_tokens` with the span of the text that each stands for."""
    import unicodedata

    invisible, token, _, cluster = _patterns()
    if text.isascii():
        return [(m[0], m.start(), m.end()) for m in token.finditer(text.casefold())]
    places = [i for a, b in _gaps(invisible, text) for i in range(a, b)]
    plain = "".join(text[i] for i in places)
    out, origin = [], []  # the folded text, and of each of its characters the cluster of the text that it comes from
    for m in cluster.finditer(plain):
        folded = unicodedata.normalize("NFKC", m[0]).casefold()
        out.append(folded)
        origin += [(places[m.start()], places[m.end() - 1] + 1)] * len(folded)
    return [(m[0], origin[m.start()][0], origin[m.end() - 1][1]) for m in token.finditer("".join(out))]


def _gaps(pattern, text: str) -> Iterator[tuple[int, int]]:
    """The stretches of ``text`` between the matches of ``pattern``."""
    at = 0
    for m in pattern.finditer(text):
        yield at, m.start()
        at = m.end()
    yield at, len(text)


def is_character(token: str) -> bool:
    return len(token) == 1 and bool(_patterns()[2].match(token))


@dataclass
class SuffixAutomaton:
    """A generalised suffix automaton over token sequences, while it is built; ``items`` of a state: those that hold its substrings."""

    next: list[dict] = field(default_factory=lambda: [{}])
    link: list[int] = field(default_factory=lambda: [-1])
    length: list[int] = field(default_factory=lambda: [0])
    items: list[set] = field(default_factory=lambda: [set()])
    _seqs: list = field(default_factory=list)

    def _new(self, length: int) -> int:
        self.next.append({})
        self.link.append(-1)
        self.length.append(length)
        self.items.append(set())
        return len(self.next) - 1

    def _split(self, p: int, c, q: int) -> int:
        clone = self._new(self.length[p] + 1)
        self.next[clone] = dict(self.next[q])
        self.link[clone] = self.link[q]
        while p != -1 and self.next[p].get(c) == q:
            self.next[p][c] = clone
            p = self.link[p]
        self.link[q] = clone
        return clone

    def add(self, tokens: list, item: int) -> None:
        last = 0
        for c in tokens:
            q = self.next[last].get(c)
            if q is not None:  # this prefix has been seen in another sequence
                last = q if self.length[q] == self.length[last] + 1 else self._split(last, c, q)
                continue
            cur, p = self._new(self.length[last] + 1), last
            while p != -1 and c not in self.next[p]:
                self.next[p][c] = cur
                p = self.link[p]
            if p == -1:
                self.link[cur] = 0
            else:
                q = self.next[p][c]
                self.link[cur] = q if self.length[q] == self.length[p] + 1 else self._split(p, c, q)
            last = cur
        self._seqs.append((tokens, item))

    def finish(self, least: int) -> SuffixAutomaton:
        """Gives every state of length ``least`` or more its items: each prefix's state and those on its suffix links."""
        for tokens, item in self._seqs:
            state = 0
            for c in tokens:
                state = self.next[state][c]
                s = state
                while s > 0 and self.length[s] >= least and item not in self.items[s]:
                    self.items[s].add(item)
                    s = self.link[s]
        self._seqs = []
        return self

    def compact(self) -> Automaton:
        """The same automaton in flat arrays, for reading."""
        symbols: dict = {}
        for edges in self.next:
            for c in edges:
                symbols.setdefault(c, len(symbols))
        one, to, many = array("i"), array("i"), {}
        for s, edges in enumerate(self.next):
            (c, q) = next(iter(edges.items())) if len(edges) == 1 else (None, 0)
            one.append(symbols[c] if c is not None else -1)
            to.append(q)
            if len(edges) > 1:
                many[s] = {symbols[c]: q for c, q in edges.items()}
        return Automaton(symbols, one, to, many, array("i", self.link), array("i", self.length), {s: tuple(sorted(x)) for s, x in enumerate(self.items) if x})


@dataclass
class Automaton:
    """A finished automaton: states with one way out keep it in two arrays, the others in a mapping."""

    symbols: dict
    one: array
    to: array
    many: dict
    link: array
    length: array
    items: dict

    def _runs(self, tokens: list, least: int) -> Iterator[tuple[int, list[int]]]:
        """(place, symbols) of the stretches of known tokens that are long enough to hold a match."""
        known = np.fromiter(map(self.symbols.get, tokens, [-1] * len(tokens)), np.int64, len(tokens))
        edges = np.flatnonzero(np.diff(np.concatenate([[0], (known >= 0).view(np.int8), [0]])))
        for a, b in zip(edges[::2], edges[1::2]):
            if b - a >= least:
                yield int(a), known[a:b].tolist()

    def matches(self, tokens: list, least: int) -> Iterator[tuple[int, int, int]]:
        """(end, length, state) at every place where the longest match has ``least`` tokens or more."""
        one, to, many, link, length = self.one, self.to, self.many, self.link, self.length
        for place, run in self._runs(tokens, least):
            state = size = 0
            for i, c in enumerate(run, place + 1):
                while True:
                    q = to[state] if one[state] == c else many[state].get(c, -1) if state in many else -1
                    if q >= 0:
                        state, size = q, size + 1
                        break
                    if not state:
                        size = 0
                        break
                    state = link[state]
                    size = length[state]
                if size >= least:
                    yield i, size, state

    def longest(self, tokens: list, least: int) -> dict[int, int]:
        """Of each item that shares a run of ``least`` tokens or more the length of the longest."""
        best: dict[int, int] = {}
        for _, size, state in self.matches(tokens, least):
            while self.length[state] >= least:  # each state above is a shorter suffix, which more items hold
                for item in self.items[state]:
                    if size > best.get(item, 0):
                        best[item] = size
                state = self.link[state]
                size = self.length[state]
        return best


def build(items: list[tuple[int, str | None, str | None]]) -> tuple[Automaton, Automaton]:
    """(item_id, lang, text) -> the automata of words and of Chinese characters."""
    words, characters = SuffixAutomaton(), SuffixAutomaton()
    for item, lang, text in items:
        tokens = normalised_tokens(text)
        if (lang or "").lower().startswith("zh"):
            run: list[str] = []
            for t in [*tokens, ""]:
                if t and is_character(t):
                    run.append(t)
                elif run:
                    characters.add(run, item)
                    run = []
        else:
            words.add(tokens, item)
    return words.finish(WORDS).compact(), characters.finish(CHARACTERS).compact()


def build_automata(items: DataFrame) -> list[str]:
    """Builds the automata of all items, each in a task of its own, in the shared folder; returns where they lie.

    Items meet by a hash of their id in so many blocks that each has about BLOCK_CHARACTERS characters.
    """
    spark = items.sparkSession
    some = items.where("item_id is not null and text is not null and text <> ''").select(F.col("item_id").cast("long").alias("item_id"), F.col("lang").cast("string").alias("lang"), "text")
    size = some.agg(F.sum(F.length("text"))).first()[0]
    if not size:
        return []
    blocks = -(-size // BLOCK_CHARACTERS)
    folder = qualified(spark, scratch(spark, "automata"))

    def make(group):
        import pandas as pd

        block = int(group["block"].iloc[0])
        automata = build(list(zip(group["item_id"].tolist(), group["lang"].where(group["lang"].notna(), None).tolist(), group["text"].tolist())))
        fs, path = arrow_filesystem(f"{folder}/{block}")
        fs.create_dir(path.rsplit("/", 1)[0], recursive=True)
        aside = f"{path}.{uuid.uuid4().hex}"
        with fs.open_output_stream(aside) as f:
            f.write(pickle.dumps(automata, 5))
        fs.move(aside, path)  # a task that runs twice puts the same in its place
        return pd.DataFrame({"block": [block]})

    made = some.withColumn("block", F.pmod(F.xxhash64("item_id"), F.lit(blocks)).cast("int")).groupBy("block").applyInPandas(make, "block int")
    return sorted(f"{folder}/{r['block']}" for r in made.collect())  # a number per block


@lru_cache(maxsize=HELD_BLOCKS)
def _load(uri: str) -> tuple[Automaton, Automaton]:
    fs, path = arrow_filesystem(uri)
    with fs.open_input_stream(path) as f:
        return pickle.loads(f.read())


_SPANS = "doc_id long, item_id long, n_tokens long, doc_tokens long"


def leak_spans(documents: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id, n_tokens, doc_tokens): for each document and item the longest shared run that is long enough.

    ``documents`` needs ``doc_id`` and ``text``, ``items`` ``item_id``, ``lang`` and ``text``; other columns are
    ignored. NULL and empty texts share nothing. Whole texts are read, once; the documents are not shuffled, as
    a document's leaks depend on that document and the automata alone. Several items may share the passage; all
    are named, each with its own length.
    """
    blocks = build_automata(items)
    docs = documents.where("doc_id is not null and text is not null and text <> ''").select(F.col("doc_id").cast("long"), "text")
    if not blocks:
        return documents.sparkSession.createDataFrame([], _SPANS)

    def find(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            tokens = [normalised_tokens(t) for t in batch.column(1).to_pylist()]
            best: list[dict] = [{} for _ in tokens]
            for uri in blocks:
                for automaton, least in zip(_load(uri), (WORDS, CHARACTERS)):
                    for k, t in enumerate(tokens):
                        for item, n in automaton.longest(t, least).items():
                            best[k][item] = max(best[k].get(item, 0), n)
            rows = [(doc, item, n, len(t)) for doc, t, b in zip(batch.column(0).to_pylist(), tokens, best) for item, n in b.items()]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*rows) if rows else [()] * 4)], names=["doc_id", "item_id", "n_tokens", "doc_tokens"])

    return docs.mapInArrow(find, _SPANS)


def leaked_items(documents: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id): every document with every item that it leaks; repeated document rows count once."""
    return leak_spans(documents, items).select("doc_id", "item_id").distinct()


def covered(tokens: list[str], automata: list[tuple[Automaton, Automaton]]) -> np.ndarray:
    """Which tokens stand in a run that some item shares."""
    edges = np.zeros(len(tokens) + 1, np.int64)
    for pair in automata:
        for automaton, least in zip(pair, (WORDS, CHARACTERS)):
            for end, size, _ in automaton.matches(tokens, least):
                edges[end - size] += 1
                edges[end] -= 1
    return np.cumsum(edges[:-1]) > 0


def without(text: str, hit: np.ndarray) -> str:
    """The text without the tokens that are ``hit``, and without what stands between two of them."""
    out, at, tokens = [], 0, placed_tokens(text)
    k = 0
    while k < len(tokens):
        if hit[k]:
            first = k
            while k + 1 < len(tokens) and hit[k + 1]:
                k += 1
            out.append(text[at : tokens[first][1]])
            at = tokens[k][2]
        k += 1
    return "".join(out) + text[at:]


_CLEAN = "doc_id long, text string, removed long, tokens long"


def remove_leaks(documents: DataFrame, items: DataFrame, max_coverage: float = 0.5) -> DataFrame:
    """(doc_id, text, removed, tokens): the documents without their leaked spans.

    Spans of at least WORDS words or CHARACTERS Chinese characters, of whichever items, are found in the text as
    it is and cut out together. A document of which more than ``max_coverage`` leaked has an empty text; a NULL
    text stays NULL and counts no tokens.
    """
    blocks = build_automata(items)

    def cut(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            docs, texts = (c.to_pylist() for c in batch.columns)
            tokens = [normalised_tokens(t) for t in texts]
            hits = [np.zeros(len(t), bool) for t in tokens]
            for uri in blocks:
                pair = _load(uri)
                for k, t in enumerate(tokens):
                    hits[k] |= covered(t, [pair])
            removed = [int(h.sum()) for h in hits]
            for k, n in enumerate(removed):
                if n > max_coverage * len(tokens[k]):
                    texts[k] = ""
                elif n:
                    texts[k] = without(texts[k], hits[k])
            yield pa.RecordBatch.from_arrays(
                [pa.array(docs, pa.int64()), pa.array(texts, pa.string()), pa.array(removed, pa.int64()), pa.array([len(t) for t in tokens], pa.int64())], names=["doc_id", "text", "removed", "tokens"]
            )

    return documents.where("doc_id is not null").select(F.col("doc_id").cast("long"), "text").mapInArrow(cut, _CLEAN)
