"""JSON objects as variants, parsed once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def once(value: Column) -> Column:
    """A generator of exactly this value. The optimiser moves neither filters nor copies of an expression through a
    generator, so an expensive value behind it is computed once per row, however often it is used afterwards."""
    return F.explode(F.array(value))


def json_objects(df: DataFrame, text: str, keep: list[str], out: str = "v") -> DataFrame:
    """``keep`` and the variant ``out`` of the rows whose ``text`` is a readable JSON object; each text is parsed once.

    NULL, empty and unreadable texts and other JSON values give no row.
    """
    candidates = df.where(F.coalesce(F.col(text).rlike(r"^[ \t\r\n]*[{]"), F.lit(False)))  # stops at the first other character
    return candidates.select(*keep, once(F.try_parse_json(F.col(text))).alias(out)).where(F.col(out).isNotNull())
