"""Written rules bound to detectors: markdown -> sections -> sentences -> exactly one shape -> state.

Markdown is read by one Arrow pass per file (:mod:`logloom.functions.markdown`); sentences meet the shapes as
boolean columns of one plan, never as a join. What takes a rule back is looked for among the sentences' words.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logloom.functions import markdown
from logloom.functions.patterns import java_regex

# Words that unbind a whole rule, words that unbind their sentence, phrases that deny an exception
# where a clause ends after them.
EXCEPTIONS = "except excepted excepting exception exceptions exempt exempted exempting exempts exemption exemptions unless excluding allowed fine okay ok".split()
EXCEPTION_PHRASES = ("other than", "apart from")
CONDITIONS = "if when but however without".split()
DENIALS = ("without any exception", "admit no exception", "allow no exception", "make no exception", "with no exception", "without exception", "no exception")


def line_kinds(text: str) -> list[tuple[str, str]]:
    """(kind, visible line) of each line."""
    return [(line.kind, line.text) for line in markdown.lines(text)]


def sections(text: str) -> list[dict]:
    """The sections of :func:`logloom.functions.markdown.sections` as mappings."""
    return [vars(s) for s in markdown.sections(text)]


slug, normalised, split_sentences = markdown.slug, markdown.normalised, markdown.sentences

_SECTIONS = "path string, anchor string, heading string, line int, is_rule boolean, sentences array<string>"


def _per_file(files: DataFrame, schema: str, rows) -> DataFrame:
    """One Arrow pass over files (path, text); ``rows`` gives the rows of one file. NULL texts give none."""

    def run(batches: Iterator) -> Iterator:
        import pandas as pd

        names = [c.split()[0] for c in schema.split(", ")]
        for batch in batches:
            yield pd.DataFrame([r for path, text in zip(batch["path"], batch["text"]) for r in rows(path, text)], columns=names)

    return files.where("text is not null").select("path", "text").mapInPandas(run, schema)


def _rules_of(path: str, text: str) -> list[tuple]:
    found = markdown.sections(text)
    if not any(s.paragraphs for s in found):  # a file without headings is one section
        prose = markdown.prose(text)
        found = [markdown.Section("", 0, "", prose)] if prose else found
    return [(path, s.anchor, s.heading, s.line, bool(s.paragraphs), [x for p in [s.heading, *s.paragraphs] for x in markdown.sentences(markdown.normalised(p))]) for s in found]


def rule_sections(files: DataFrame) -> DataFrame:
    """(path, anchor, heading, line, is_rule, sentences) of files (path, text); the heading is the first sentence.

    A file without headings is one section called after itself. NULL texts give no sections.
    """
    return _per_file(files, _SECTIONS, _rules_of)


def heading_slugs(files: DataFrame) -> DataFrame:
    """(path, line, heading, slug, anchor) of every heading of files (path, text), whatever its length; NULL texts give none."""
    return _per_file(files, "path string, line int, heading string, slug string, anchor string", lambda path, text: [(path, s.line, s.heading, markdown.slug(s.heading), s.anchor) for s in markdown.sections(text)])


def section_digest(text: Column) -> Column:
    """SHA-256 of a section, whatever its line ends and the blanks at them."""
    ends = F.regexp_replace(F.regexp_replace(text, r"\r\n?", "\n"), r"[ \t]+(?=\n|$)", "")
    return F.sha2(ends.cast("binary"), 256)


def _spoken(sentence: Column) -> Column:
    """A sentence's words in lower case between single blanks, ``¶`` where a clause ends, denials of an exception taken out."""
    words = F.regexp_replace(F.concat(F.lit(" "), F.lower(sentence), F.lit(" ¶ ")), r"\s-+\s|[.,;:!?)\]–—]", " ¶ ")
    words = F.regexp_replace(words, r"[^\p{L}\p{N}_¶]+", " ")
    for phrase in DENIALS:
        for form in (phrase + "s", phrase):
            words = F.replace(words, F.lit(f" {form} ¶"), F.lit(" ¶"))
    return words


def excepted(sentence: Column) -> Column:
    """Does the sentence grant an exception, which unbinds the rule that it is part of?"""
    words = _spoken(sentence)
    phrases = F.lit(False)
    for p in EXCEPTION_PHRASES:
        phrases = phrases | F.contains(words, F.lit(f" {p} "))
    return phrases | F.arrays_overlap(F.split(words, " "), F.array(*map(F.lit, EXCEPTIONS)))


def conditional(sentence: Column) -> Column:
    """Does the sentence hold a condition or a contrast, which unbinds it alone?"""
    return F.arrays_overlap(F.split(_spoken(sentence), " "), F.array(*map(F.lit, CONDITIONS)))


def shapes_of(sentence: Column, shapes: list[tuple[str, str]]) -> Column:
    """The detectors whose shape the sentence begins with."""
    return F.array_compact(F.array(*[F.when(sentence.rlike(java_regex(rf"(?i)\A(?:{p})")), F.lit(d)) for d, p in shapes]))


def bind_rules(files: DataFrame, shapes: list[tuple[str, str]]) -> DataFrame:
    """(path, anchor, state, detectors, reason) of every rule section; ``shapes``: (detector, pattern at the start of a sentence).

    A sentence binds if it begins with exactly one shape and neither an exception anywhere in the rule nor a
    condition in the sentence unbinds it. A rule is ``measured`` if a sentence binds, else ``unmeasured``.
    """
    rules = rule_sections(files).where("is_rule")
    read = F.transform("sentences", lambda s: F.struct(shapes_of(s, shapes).alias("detectors"), conditional(s).alias("conditional"), excepted(s).alias("excepted")))
    rules = rules.select("path", "anchor", read.alias("read"))
    granted = F.exists("read", lambda s: s["excepted"])
    some = F.filter("read", lambda s: F.size(s["detectors"]) > 0)
    binding = F.filter("read", lambda s: (F.size(s["detectors"]) == 1) & ~s["conditional"])
    names = F.array_sort(F.array_distinct(F.flatten(F.transform(binding, lambda s: s["detectors"]))))
    rules = rules.select("path", "anchor", F.when(granted, F.array().cast("array<string>")).otherwise(names).alias("detectors"), some.alias("some"), granted.alias("granted"))
    held_back = F.col("granted") | F.exists("some", lambda s: s["conditional"])
    reason = F.when(F.size("detectors") > 0, "").when(F.size("some") == 0, "no shape").when(held_back, "an exception or a condition").otherwise("several shapes")
    return rules.select("path", "anchor", F.when(F.size("detectors") > 0, "measured").otherwise("unmeasured").alias("state"), "detectors", reason.alias("reason"))


def coverage(bound: DataFrame) -> DataFrame:
    """(rules, measured, share) over all rules."""
    measured = F.count_if(F.col("state") == "measured")
    return bound.agg(F.count("*").alias("rules"), measured.alias("measured"), F.when(F.count("*") > 0, measured / F.count("*")).alias("share"))
