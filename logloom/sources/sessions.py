"""All sessions below a folder: runtimes told apart, copies dropped, a date cut applied, problems reported."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date, datetime, timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from logloom.sources import transcripts
from logloom.sources.files import RUNTIMES, detect_runtime, read_lines

READERS = {"claude-code": transcripts.read_a, "codex": transcripts.read_b, "gemini": transcripts.read_c}


def since_stamp(since: date | datetime | str | int) -> str:
    """The first day that counts: a date, a text YYYY-MM-DD, or a number of days back from today."""
    if isinstance(since, bool):
        raise ValueError("since is a date or a number of days")
    if isinstance(since, int):
        return (date.today() - timedelta(days=since)).isoformat()
    if isinstance(since, (date, datetime)):
        return since.isoformat()[:10]
    return date.fromisoformat(since[:10]).isoformat()


def since_filter(ended: Column, since: date | datetime | str | int) -> Column:
    """Kept: what ended on that day or later, and what has no stamp."""
    return (F.coalesce(ended, F.lit("")) == "") | (F.substring(ended, 1, 10) >= F.lit(since_stamp(since)))


def best_copies(sessions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(kept, copies): of sessions with the same runtime and id the one with most events, then the first path.

    A session without an id is a group of its own.
    """
    key = F.when(F.coalesce("session_id", F.lit("")) == "", F.concat(F.lit("\0"), "path")).otherwise(F.col("session_id"))
    best = F.row_number().over(Window.partitionBy("runtime", key).orderBy(F.col("n_events").desc(), "path"))
    ranked = sessions.withColumn("__rank", best)
    return ranked.where("__rank = 1").drop("__rank"), ranked.where("__rank > 1").drop("__rank")


@dataclass
class Scan:
    events: DataFrame
    sessions: DataFrame
    errors: DataFrame  # path, error


def scan(spark: SparkSession, root: str, runtime: str | None = None, since=None, project_roots: DataFrame | None = None) -> Scan:
    """Every session below ``root``, of one runtime or of all.

    ``errors`` names files without events, copies of other sessions, and files of runtime C outside a
    ``chats`` folder. The date cut comes before all of them.
    """
    lines = read_lines(spark, root)
    of = detect_runtime(lines)
    events, sessions = [], []
    for name in RUNTIMES if runtime is None else (runtime,):
        part = lines.join(of.where(F.col("runtime") == name).select("path"), "path", "left_semi")
        e, s = READERS[name](part, project_roots) if name == "gemini" else READERS[name](part)
        events.append(e)
        sessions.append(s)
    union = lambda dfs: reduce(lambda a, b: a.unionByName(b), dfs)
    every = union(sessions)
    if since is not None:
        every = every.where(since_filter(F.col("ended"), since))
    outside = (F.col("runtime") == "gemini") & ~F.col("path").contains("/chats/")
    empty = every.where((F.col("n_events") == 0) & ~outside)
    kept, copies = best_copies(every.where((F.col("n_events") > 0) & ~outside))
    errors = (
        empty.select("path", F.lit("no event").alias("error"))
        .unionAll(every.where(outside).select("path", F.lit("outside a chats folder").alias("error")))
        .unionAll(copies.select("path", F.lit("a copy of another session").alias("error")))
    )
    return Scan(union(events).join(kept.select("path"), "path", "left_semi"), kept, errors)


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """Events written one per line in the common schema; refuses lines without kind or turn."""
    raw = spark.read.text(path).where("trim(value) <> ''")
    v = raw.select("value", F.try_parse_json("value").alias("v"))
    bad = v.where("v is null or try_variant_get(v, '$.kind', 'string') is null or try_variant_get(v, '$.turn', 'int') is null").limit(1).collect()
    if bad:
        raise ValueError(f"not an event: {bad[0]['value'][:80]!r}")
    from logloom.schema import EVENTS

    return spark.read.schema(EVENTS).json(path)
