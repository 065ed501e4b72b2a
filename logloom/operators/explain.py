"""Hits shown one by one, with the call that each is on and secrets taken out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logloom.functions.redact import with_redacted
from logloom.operators.validity import hit_key

MAX_CHARS = 4000


def capped(text: Column, limit: int = MAX_CHARS) -> Column:
    """The first ``limit`` characters, and how many more there are."""
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit), F.lit(" ... "), (F.length(text) - limit).cast("string"), F.lit(" more"))).otherwise(text)


def with_calls(hits: DataFrame, events: DataFrame) -> DataFrame:
    """Hits with ``key`` and the input of the first call at (turn, id); NULL where there is none."""
    first = events.where("kind = 'tool_use'").groupBy("runtime", "session_id", "turn", F.col("id").alias("tool_use_id")).agg(F.min_by("input", "pos").alias("input"), F.min_by("name", "pos").alias("name"))
    return hits.join(first, ["runtime", "session_id", "turn", "tool_use_id"], "left").withColumn("key", hit_key(F.col("turn"), F.col("tool_use_id")))


def explain_order() -> list[Column]:
    """By turn, then hits without a call, then position, then name."""
    return [F.col("turn").asc_nulls_last(), F.when(F.col("tool_use_id").isNull(), F.lit(-1)).otherwise(F.col("pos")), F.col("detector"), F.col("pos")]


def explain(hits: DataFrame, events: DataFrame, session: str | None = None, detector: str | None = None, key: str | None = None) -> DataFrame:
    """(address, detector, key, name, shown), filtered before anything is redacted and ordered for reading.

    ``session`` is an id or ``runtime:id``. Filters on session and detector reach the scans of both tables.
    """
    if session is not None:
        address = F.concat_ws(":", "runtime", "session_id")
        same = (F.col("session_id") == session) | (address == session)
        hits, events = hits.where(same), events.where(same)
    if detector is not None:
        hits = hits.where(F.col("detector") == detector)
    joined = with_calls(hits, events)
    if key is not None:
        joined = joined.where(F.col("key") == key)
    clean = with_redacted(joined, "input", spelled=True).orderBy("runtime", "session_id", *explain_order())
    return clean.select(F.concat_ws(":", "runtime", "session_id").alias("address"), "detector", "key", "name", capped(F.col("redacted")).alias("shown"))
