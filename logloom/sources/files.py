"""Transcript files as ordered lines, and which runtime wrote each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from logloom.functions.variants import json_objects

RUNTIMES = ("claude-code", "codex", "gemini")


def read_lines(spark: SparkSession, root: str, glob: str = "*.json*") -> DataFrame:
    """(path, pos, line) of all files below ``root``; ``pos`` counts lines. Bytes that are no UTF-8 are replaced.

    Lines end at ``\\n``, ``\\r\\n`` or ``\\r`` only: other separators are legal inside JSON strings. A whole
    ``.json`` file is one line, so that a legacy session stays one record.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(root)
    text = F.make_valid_utf8(F.col("content").cast("string"))
    lines = F.when(F.col("path").endswith(".json") & F.try_parse_json(text).isNotNull(), F.array(text)).otherwise(F.split(text, r"\r\n|\r|\n"))
    return files.select("path", F.posexplode(lines).alias("pos", "line")).where("trim(line) <> ''").select("path", F.col("pos").cast("long").alias("pos"), "line")


def get(v: str, path: str, kind: str = "string") -> Column:
    """A field of a variant column, NULL where it is absent or of another type."""
    return F.expr(f"try_variant_get({v}, '$.{path}', '{kind}')")


def text_field(v: str, path: str) -> Column:
    """A field that is a text, NULL for any other type."""
    return F.expr(f"case when schema_of_variant(try_variant_get({v}, '$.{path}', 'variant')) = 'STRING' then try_variant_get({v}, '$.{path}', 'string') end")


def detect_runtime(lines: DataFrame) -> DataFrame:
    """(path, runtime), from the first readable line of each file."""
    first = json_objects(lines, "line", ["path", "pos", "line"]).groupBy("path").agg(F.min_by("line", "pos").alias("line")).withColumn("v", F.try_parse_json("line"))
    there = lambda p: F.expr(f"try_variant_get(v, '$.{p}', 'variant') is not null")
    other = there("message") | there("payload")
    meta = text_field("v", "sessionId").isNotNull() & text_field("v", "projectHash").isNotNull()
    message = text_field("v", "id").isNotNull() & F.coalesce(get("v", "type").isin("user", "gemini", "info", "error", "warning"), F.lit(False)) & there("content")
    update = F.expr("""coalesce(schema_of_variant(try_variant_get(v, '$["$set"]', 'variant')) like 'OBJECT%', false) or coalesce(schema_of_variant(try_variant_get(v, '$["$rewindTo"]', 'variant')) = 'STRING', false)""")
    runtime = F.when(get("v", "type") == "session_meta", "codex").when(~other & (meta | message | update), "gemini").otherwise("claude-code")
    return first.select("path", runtime.alias("runtime"))


def final_flags(events: DataFrame, by: tuple[str, ...] = ("path",), order: str = "at") -> DataFrame:
    """Sets ``final``: the last assistant text before the next prompt or the end. One window over each file."""
    w = Window.partitionBy(*by).orderBy(F.col(order).desc()).rowsBetween(Window.unboundedPreceding, -1)
    # Looking back from the end: the next message or prompt after this event.
    following = F.last(F.when(F.col("kind").isin("assistant_text", "user_prompt"), F.col("kind")), ignorenulls=True).over(w)
    return events.withColumn("final", F.when(F.col("kind") == "assistant_text", F.coalesce(following == "user_prompt", F.lit(True))))


def number_events(events: DataFrame) -> DataFrame:
    """``pos``: the place of an event in its file."""
    return events.withColumn("pos", (F.row_number().over(Window.partitionBy("path").orderBy("at")) - 1).cast("long"))


def named_results(events: DataFrame) -> DataFrame:
    """A result's ``tool_name``: that of the latest earlier call with its id; its text is kept for few tools only, cut."""
    from logloom.schema import RESULT_CHARS, RESULT_TOOLS

    key = F.coalesce("id", "tool_use_id")
    w = Window.partitionBy("path", key).orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    name = F.coalesce(F.last(F.when(F.col("kind") == "tool_use", F.col("name")), ignorenulls=True).over(w), F.lit(""))
    events = events.withColumn("tool_name", F.when(F.col("kind") == "tool_result", name))
    kept = F.when(F.col("tool_name").isin(*RESULT_TOOLS), F.substring("text", 1, RESULT_CHARS)).otherwise("")
    return events.withColumn("text", F.when(F.col("kind") == "tool_result", kept).otherwise(F.col("text")))


def basename(path: Column) -> Column:
    return F.coalesce(F.regexp_extract(F.regexp_replace(path, "/+$", ""), "([^/]*)$", 1), F.lit(""))
