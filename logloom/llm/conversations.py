"""Conversations rebuilt from message rows.

Rows are folded into messages, messages are range-partitioned by (conversation, instant) and sorted
inside each partition, and a finite-state automaton reads them in that order. A partition may begin or
end in the middle of a conversation, so the automaton is run as a *function of its start state*: each
partition yields, for every conversation that it touches, the function its rows compute, and these
functions are composed afterwards. A conversation with a third of all rows is thus read by many tasks.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logloom.functions.instants import instant_micros
from logloom.functions.variants import json_objects, once
from logloom.storage import materialize

#: States of the automaton: nothing read, a prompt that waits for its reply, all prompts replied to, broken.
START, OPEN, REPLIED, BROKEN = range(4)
#: Symbols: a prompt, an assistant message with text, one without, a tool's message.
PROMPT, REPLY, SILENT, TOOL = range(4)
_STEP = (
    # PROMPT   REPLY    SILENT   TOOL
    (OPEN, BROKEN, BROKEN, BROKEN),  # START: the first message must be a prompt
    (BROKEN, REPLIED, OPEN, OPEN),  # OPEN: a second prompt before any reply breaks it
    (OPEN, REPLIED, REPLIED, REPLIED),  # REPLIED
    (BROKEN, BROKEN, BROKEN, BROKEN),  # BROKEN
)


def _monoid() -> tuple[list[tuple[int, ...]], list[list[int]], list[int]]:
    """All functions state -> state that some run of symbols computes; their products; the symbols' own numbers."""
    of_symbol = [tuple(_STEP[q][s] for q in range(4)) for s in range(4)]
    seen = {(0, 1, 2, 3): 0}
    todo = [(0, 1, 2, 3)]
    while todo:
        f = todo.pop()
        for g in of_symbol:
            h = tuple(g[x] for x in f)
            if h not in seen:
                seen[h] = len(seen)
                todo.append(h)
    functions = sorted(seen, key=seen.get)
    product = [[seen[tuple(g[x] for x in f)] for g in functions] for f in functions]
    return functions, product, [seen[f] for f in of_symbol]


FUNCTIONS, PRODUCT, OF_SYMBOL = _monoid()
_NEVER = 1 << 62  # the instant of a message without one: after all others


def _blank(text: Column) -> Column:
    return F.coalesce(F.trim(F.regexp_replace(text, r"[\s\p{Z}\p{Cf}]+", "")), F.lit("")) == ""


def _counted_lines(lines: DataFrame) -> DataFrame:
    """(session_id, line_type, us, id, content) of the lines that count, each parsed once."""
    flag = lambda name: F.coalesce(F.col(name), F.lit(False))
    chosen = (
        lines.where(F.col("session_id").isNotNull() & (F.col("session_id") != "") & F.col("line_type").isin("user", "assistant"))
        .where(~flag("is_meta") & ~flag("is_compact_summary") & ~flag("is_sidechain"))
        .withColumn("us", instant_micros(F.col("ts")))
    )
    return json_objects(chosen, "message", ["session_id", "line_type", "us"]).select(
        "session_id",
        "line_type",
        "us",
        F.expr("try_variant_get(v, '$.id', 'string')").alias("id"),
        F.expr("try_variant_get(v, '$.content', 'variant')").alias("content"),
    )


def _message_key() -> Column:
    """What lines of one message share: the id, or for a line without one a hash of all that it says, behind a NUL."""
    own = F.concat(F.lit("\0"), F.xxhash64("us", "line_type", F.to_json("content")).cast("string"))
    return F.when(F.coalesce("id", F.lit("")) == "", own).otherwise(F.col("id"))


def _id_of(key: str) -> Column:
    return F.when(F.startswith(F.col(key), F.lit("\0")), "").otherwise(F.col(key))


def message_contents(lines: DataFrame) -> DataFrame:
    """(session_id, message_key, content): the blocks of each message, as JSON texts in order.

    A block that was streamed in several lines counts once, at its earliest instant and with its longest
    text; deliveries that repeat it add nothing. A plain text is one block.
    """
    block = F.expr("coalesce(try_variant_get(content, '$', 'array<variant>'), array(content))")
    field = lambda name: F.expr(f"try_variant_get(b, '$.{name}', 'string')")
    rows = _counted_lines(lines).select("session_id", _message_key().alias("message_key"), "us", F.posexplode(block).alias("i", "b")).where("b is not null")
    rows = rows.select(
        "session_id", "message_key", "us", F.coalesce(F.expr("try_variant_get(b, '$.apiBlockIndex', 'int')"), F.col("i")).alias("slot"),
        F.concat_ws("\0", F.coalesce(field("type"), F.lit("")), F.coalesce(field("id"), field("tool_use_id"), F.lit(""))).alias("which"), F.to_json("b").alias("json"),
    )
    whole = rows.groupBy("session_id", "message_key", "slot", "which").agg(F.min("us").alias("us"), F.max_by("json", F.struct(F.length("json"), "json")).alias("json"))
    ordered = F.array_sort(F.collect_list(F.struct("slot", "us", "which", "json")))
    return whole.groupBy("session_id", "message_key").agg(F.transform(ordered, lambda x: x["json"]).alias("content"))


def messages(lines: DataFrame) -> DataFrame:
    """Lines (the columns of ``session_lines``) -> one row per message.

    Left out: lines without session, system, meta, compact-summary and sidechain lines, and lines whose
    JSON cannot be parsed. Lines of one session with the same ``message.id`` are one message at its
    earliest instant. A line without an id is a message of its own (equal deliveries of it count once)
    and carries the id ``''``. A message without any readable instant comes after all others.

    Columns: session_id, message_key, us, is_tool, line_type, has_text, uses, results.
    """
    rows = _counted_lines(lines)
    block = lambda path: f"try_variant_get(b, '$.{path}', 'string')"
    rows = rows.select(
        "*",
        once(F.expr(
            "transform(coalesce(try_variant_get(content, '$', 'array<variant>'), array(content)), b -> named_struct("
            f"'type', {block('type')}, 'id', {block('id')}, 'of', {block('tool_use_id')}, "
            f"'text', case when schema_of_variant(b) = 'STRING' then try_variant_get(b, '$', 'string') when {block('type')} = 'text' then {block('text')} end))"
        )).alias("blocks"),
    )
    key = _message_key()
    has_text = F.exists("blocks", lambda b: ~_blank(b["text"]))
    ids = lambda kind, field: F.transform(F.filter("blocks", lambda b: b["type"] == kind), lambda b: F.coalesce(b[field], F.lit("")))
    return (
        rows.select(
            "session_id",
            key.alias("message_key"),
            F.coalesce("us", F.lit(_NEVER)).alias("us"),
            "line_type",
            F.coalesce(has_text, F.lit(False)).alias("has_text"),
            F.exists("blocks", lambda b: F.coalesce(b["type"] == "tool_result", F.lit(False))).alias("is_tool"),
            ids("tool_use", "id").alias("uses"),
            ids("tool_result", "of").alias("results"),
        )
        .groupBy("session_id", "message_key")
        .agg(
            F.min("us").alias("us"),
            F.max("is_tool").alias("is_tool"),
            F.min_by("line_type", "us").alias("line_type"),
            F.max("has_text").alias("has_text"),
            F.array_distinct(F.flatten(F.collect_set("uses"))).alias("uses"),
            F.array_distinct(F.flatten(F.collect_set("results"))).alias("results"),
        )
    )


def broken_links(msgs: DataFrame) -> DataFrame:
    """The sessions in which a tool_result names no tool_use of an earlier message, or a tool_use has no result.

    One row per (session, tool id) meets in the shuffle, not one group per session. At the same instant a
    call counts as earlier than its result; within one message it does not. An absent tool id names nothing.
    """
    place = F.struct("us", "message_key")
    ref = F.concat(
        F.transform("uses", lambda x: F.struct(x.alias("ref"), F.lit(True).alias("use"))),
        F.transform("results", lambda x: F.struct(x.alias("ref"), F.lit(False).alias("use"))),
    )
    return (
        msgs.where((F.size("uses") > 0) | (F.size("results") > 0))
        .select("session_id", "us", "message_key", F.explode(ref).alias("r"))
        .groupBy("session_id", F.col("r.ref").alias("ref"))
        .agg(
            F.min(F.when(F.col("r.use"), place)).alias("use"),
            F.min(F.when(~F.col("r.use"), F.col("us"))).alias("result_us"),
            F.max(F.when(~F.col("r.use"), F.col("message_key"))).alias("k1"),
            F.min(F.when(~F.col("r.use"), F.col("message_key"))).alias("k0"),
        )
        .where(
            (F.col("ref") == "")
            | F.col("use").isNull()
            | F.col("result_us").isNull()
            | (F.col("use.us") > F.col("result_us"))
            | (F.col("use.message_key") == F.col("k0"))
            | (F.col("use.message_key") == F.col("k1"))
        )
        .select("session_id")
        .distinct()
    )


_TAGGED = "session_id string, piece int, n long, seq long, prompt_key string, steps long, speaker string, message_key string, f int, has_prompt_text boolean"


def _read_in_order(batches: Iterator) -> Iterator:
    """mapInArrow over sorted messages: each row with its place since the piece's latest prompt, and a row per piece and session."""
    import pyarrow as pa
    from pyspark import TaskContext

    piece = TaskContext.get().partitionId()
    schema = pa.schema(
        [("session_id", pa.string()), ("piece", pa.int32()), ("n", pa.int64()), ("seq", pa.int64()), ("prompt_key", pa.string()), ("steps", pa.int64())]
        + [("speaker", pa.string()), ("message_key", pa.string()), ("f", pa.int32()), ("has_prompt_text", pa.bool_())]
    )
    session, f, prompt, steps, seq, text = None, 0, None, 0, 0, False
    out: list[tuple] = []

    def flush():
        table = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 10, schema.types)], schema=schema)
        out.clear()
        return table

    for batch in batches:
        cols = [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("session_id", "message_key", "line_type", "is_tool", "has_text")]
        for s, m, kind, tool, has_text in zip(*cols):
            if s != session:
                if session is not None:
                    out.append((session, piece, seq, None, prompt, steps, None, None, f, text))
                session, f, prompt, steps, seq, text = s, 0, None, 0, 0, False
            if tool:
                symbol, speaker = TOOL, "tool"
            elif kind == "user":
                symbol, speaker = PROMPT, "user"
                prompt, steps, text = m, -1, text or has_text
            else:
                symbol, speaker = (REPLY if has_text else SILENT), "assistant"
            f = PRODUCT[f][OF_SYMBOL[symbol]]
            steps += 1
            out.append((s, piece, None, seq, prompt, steps, speaker, m, None, None))
            seq += 1
        yield flush()
    if session is not None:
        out.append((session, piece, seq, None, prompt, steps, None, None, f, text))
    yield flush()


def rebuild_conversations(lines: DataFrame, content: bool = False) -> DataFrame:
    """Message rows -> the ordered messages of every whole conversation.

    ``lines`` has the columns of ``session_lines``; further columns are ignored. Result: ``session_id,
    prompt_id, step_no, speaker, message_id``, one row per message of a kept session. Kept are sessions
    whose first message is a prompt, with a prompt that has non-blank text, a spoken reply to every prompt
    before the next one, and sound tool links (see :func:`broken_links`). Order: instant, then calls before
    tool messages, then message id. Empty input gives no rows; null ids, texts and stamps are covered in
    :func:`messages`. With ``content`` each row also has its blocks (:func:`message_contents`; NULL for a
    message with none); they join at the end, so that only kept messages carry theirs.
    """
    spark = lines.sparkSession
    msgs = materialize(messages(lines), "messages")
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = (
        msgs.select("session_id", "us", "is_tool", "message_key", "line_type", "has_text")
        .repartitionByRange(width, "session_id", "us", "is_tool", "message_key")
        .sortWithinPartitions("session_id", "us", "is_tool", "message_key")
    )
    tagged = materialize(ordered.mapInArrow(_read_in_order, _TAGGED), "ordered-messages")

    table = F.array(*[F.lit(x) for x in itertools.chain.from_iterable(PRODUCT)])
    size = len(FUNCTIONS)
    # Pieces of a session compose left to right; there are at most as many as range partitions.
    pieces = (
        tagged.where(F.col("f").isNotNull())
        .groupBy("session_id")
        .agg(F.array_sort(F.collect_list(F.struct("piece", "f", "has_prompt_text", "prompt_key", "steps", "n"))).alias("pieces"))
        .withColumn("f", F.aggregate("pieces", F.lit(0), lambda acc, p: F.element_at(table, acc * size + p["f"] + 1)))
        .where(F.element_at(F.array(*[F.lit(f[START] == REPLIED) for f in FUNCTIONS]), F.col("f") + 1) & F.exists("pieces", lambda p: p["has_prompt_text"]))
        .join(broken_links(msgs), "session_id", "left_anti")
    )
    start = F.struct(F.lit(None).cast("string").alias("prompt_key"), F.lit(0).cast("long").alias("steps"), F.lit(-1).alias("piece"))
    step = lambda acc, p: F.struct(
        F.coalesce(p["prompt_key"], acc["prompt_key"]).alias("prompt_key"),
        F.when(p["prompt_key"].isNull(), acc["steps"] + p["n"]).otherwise(p["steps"]).alias("steps"),
        p["piece"].alias("piece"),
    )
    # What each piece inherits: the latest prompt before it, and the messages since.
    carried = pieces.select(
        "session_id",
        F.explode(
            F.transform(
                "pieces",
                lambda p, i: F.struct(p["piece"].alias("piece"), F.aggregate(F.slice("pieces", 1, i), start, step).alias("before")),
            )
        ).alias("c"),
    ).select("session_id", "c.piece", F.col("c.before.prompt_key").alias("before_key"), F.col("c.before.steps").alias("before_steps"))
    rows = tagged.where(F.col("speaker").isNotNull()).select("session_id", "piece", "seq", "prompt_key", "steps", "speaker", "message_key")
    out = rows.join(carried, ["session_id", "piece"]).select(
        "session_id",
        F.coalesce("prompt_key", "before_key").alias("prompt_key"),
        F.when(F.col("prompt_key").isNull(), F.col("before_steps") + F.col("seq") + 1).otherwise(F.col("steps")).alias("step_no"),
        "speaker",
        "message_key",
    )
    columns = ["session_id", _id_of("prompt_key").alias("prompt_id"), "step_no", "speaker", _id_of("message_key").alias("message_id")]
    if not content:
        return out.select(*columns)
    return out.join(message_contents(lines), ["session_id", "message_key"], "left").select(*columns, "content")
