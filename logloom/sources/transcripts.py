"""The three native transcript formats as events and sessions, with plans of built-in functions only.

Each reader takes ordered lines (path, pos, line) and gives ``(events, sessions)``. A line that is no JSON
object is skipped: a transcript's tail may be half written. One file is one unit of order, so windows are
partitioned by path.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logloom.functions.variants import json_objects, once
from logloom.sources.files import basename, final_flags, get, named_results, number_events, text_field
from logloom.storage import materialize

# How runtimes word the results of calls that never ran.
NOT_RUN_A = (
    "The user doesn't want to proceed with this tool use",
    "The user doesn't want to take this action right now",
    "[Request interrupted by user",
    "[Tool call not completed",
    "[Tool call did not complete",
    "[Tool call interrupted",
    "Permission to use ",
)
HOOK_BLOCKED_A = r"^PreToolUse:\S+ hook error: "
TOOL_ERROR_A = "<tool_use_error>"
NOT_RUN_B = ("exec command rejected by user", "patch rejected by user", "aborted")
NOT_RUN_PREFIX_B = ("patch rejected:", "apply_patch verification failed:")
NAMES_B = {"exec_command": "Bash", "spawn_agent": "Agent"}
NAMES_C = {"write_file": "Write", "replace": "Edit"}

_EVENT = ["path", "at", "kind", "turn", "id", "name", "input", "text", "model", "tool_use_id"]


def _objects(lines: DataFrame) -> DataFrame:
    return json_objects(lines, "line", ["path", "pos"])


def _event(df: DataFrame, **columns: Column) -> DataFrame:
    """Rows as events; columns that a kind does not have are NULL."""
    empty = {c: F.lit(None).cast("int" if c == "turn" else "string") for c in _EVENT[2:]}
    return df.select("path", columns.pop("at").alias("at"), *[(columns.get(c, empty[c])).alias(c) for c in _EVENT[2:]])


def _place(pos: str, part: int | Column, index: int | Column = 0) -> Column:
    """Where an event stands: line, part of the line, index in the part."""
    as_column = lambda x: (x if isinstance(x, Column) else F.lit(x)).cast("int")
    return F.struct(F.col(pos).alias("line"), as_column(part).alias("part"), as_column(index).alias("index"))


def _finish(events: DataFrame, sessions: DataFrame, runtime: str) -> tuple[DataFrame, DataFrame]:
    events = number_events(final_flags(named_results(events)))
    ids = sessions.select("path", "session_id")
    events = events.join(ids, "path").select(
        F.lit(runtime).alias("runtime"), "session_id", "path", "pos", "kind", "turn", "id", "name", "input", "text", "final", "model", "tool_use_id", "tool_name"
    )
    counts = events.groupBy("path").agg(F.count("*").alias("n_events"))
    sessions = sessions.join(counts, "path", "left").select(
        F.lit(runtime).alias("runtime"), "session_id", "path", basename(F.col("cwd")).alias("repo"), "cwd", "started", "ended", F.coalesce("n_events", F.lit(0)).alias("n_events")
    )
    return events, sessions


def _joined_sql(blocks: str, separator: str = "\\n") -> str:
    """SQL: the texts of text blocks, or the text itself; '' for anything else."""
    return (
        f"case when schema_of_variant({blocks}) = 'STRING' then try_variant_get({blocks}, '$', 'string') else coalesce(array_join(transform(filter(try_variant_get({blocks}, '$', 'array<variant>'), "
        f"x -> try_variant_get(x, '$.type', 'string') = 'text'), x -> case when schema_of_variant(try_variant_get(x, '$.text', 'variant')) = 'STRING' then try_variant_get(x, '$.text', 'string') else '' end), '{separator}'), '') end"
    )


def _joined(blocks: str) -> Column:
    return F.expr(_joined_sql(blocks))


_TEXT_OF = "case when schema_of_variant(try_variant_get({0}, '$.{1}', 'variant')) = 'STRING' then try_variant_get({0}, '$.{1}', 'string') end"


def _never_ran_a(said: Column) -> Column:
    """Whether an error result's text says that its call was refused, interrupted or not accepted."""
    lead = F.ltrim(said)
    after = F.ltrim(F.substring(lead, len(TOOL_ERROR_A) + 1, 1 << 30))
    plain = lead.rlike(HOOK_BLOCKED_A)
    for prefix in NOT_RUN_A:
        plain = plain | F.startswith(lead, F.lit(prefix))
    return F.when(F.startswith(lead, F.lit(TOOL_ERROR_A)), ~F.startswith(after, F.lit("Error: "))).otherwise(plain)


def read_a(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Runtime A: user, assistant and system lines with content blocks.

    Each line is parsed once, into the events that it may hold, and written down; all the rest is windows
    over the file in one shuffle: turns, streamed blocks, repeated calls, calls that never ran, names of results.
    """
    of = lambda name: F.expr(f"coalesce({_TEXT_OF.format('v', name)}, '')")
    flag = lambda name: F.coalesce(get("v", name, "boolean"), F.lit(False))
    rows = _objects(lines).select(
        "path", "pos", get("v", "type").alias("type"), get("v", "subtype").alias("subtype"), of("timestamp").alias("ts"), of("sessionId").alias("sid"), of("cwd").alias("cwd"),
        flag("isSidechain").alias("side"), of("agentId").alias("agent"), (flag("isMeta") | flag("isCompactSummary")).alias("meta"), of("toolDenialKind").alias("denial"),
        of("toolUseResult").alias("use_result"), of("message.id").alias("mid"), of("message.model").alias("model"), get("v", "message.content", "variant").alias("content"),
    )
    return _events_of_a(rows)


def read_a_table(table: DataFrame, path: Column) -> tuple[DataFrame, DataFrame]:
    """Runtime A from a table with a column per field of a line (``session_lines``) and ``message`` as JSON: the same events.

    ``path`` says which lines are one file; ``line_id`` orders them. Only the message is parsed, once. A row whose
    message is unreadable or NULL has none; rows without a path give nothing.
    """
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    flag = lambda c: F.coalesce(F.col(c), F.lit(False))
    of = lambda name: F.expr(f"coalesce({_TEXT_OF.format('m', name)}, '')")
    use_result = F.regexp_extract("tool_use_result", r'^\s*"([^"\\]*)"\s*$', 1) if "tool_use_result" in table.columns else F.lit(None).cast("string")
    rows = table.select("*", once(F.try_parse_json("message")).alias("m"), path.alias("__path")).where("__path is not null")
    return _events_of_a(
        rows.select(
            F.col("__path").alias("path"), F.col("line_id").alias("pos"), F.col("line_type").alias("type"), "subtype", text("ts").alias("ts"), text("session_id").alias("sid"), text("cwd").alias("cwd"),
            flag("is_sidechain").alias("side"), text("agent_id").alias("agent"), (flag("is_meta") | flag("is_compact_summary")).alias("meta"), text("tool_denial_kind").alias("denial"),
            F.coalesce(use_result, F.lit("")).alias("use_result"), of("id").alias("mid"), of("model").alias("model"), get("m", "content", "variant").alias("content"),
        )
    )


def _events_of_a(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Events and sessions of lines that are taken apart but for their content."""
    # A block that stands alone is read as a list of one.
    rows = rows.withColumn("content", F.expr("case when schema_of_variant(content) like 'OBJECT%' then to_variant_object(array(content)) else content end"))
    user, assistant = F.col("type") == "user", F.col("type") == "assistant"
    blocks = F.expr("try_variant_get(content, '$', 'array<variant>')")
    is_result = "try_variant_get({0}, '$.type', 'string') = 'tool_result'"
    n_results = F.expr(f"size(filter(coalesce(try_variant_get(content, '$', 'array<variant>'), array()), x -> {is_result.format('x')}))")
    # One row per block, and one for a line without blocks; what follows sees one block at a time.
    rows = rows.select("*", F.when(user, n_results).otherwise(0).alias("n_results"), F.posexplode_outer(blocks).alias("i", "b"))
    t = F.expr("case when schema_of_variant(b) like 'OBJECT%' then try_variant_get(b, '$.type', 'string') end")
    first = F.coalesce("i", F.lit(0)) == 0
    kind = (
        F.when(user & (F.col("n_results") == 0) & ~F.col("meta") & first, "user_prompt")
        .when(user & (t == "tool_result"), "tool_result")
        .when(assistant & (t == "text"), "assistant_text")
        .when(assistant & (t == "tool_use"), "tool_use")
        .when((F.col("type") == "system") & (F.col("subtype") == "compact_boundary") & first, "compact")
    )
    # A generator keeps the optimiser from spelling the kind out again in every column that asks for it.
    rows = rows.select("*", once(kind).alias("kind"))
    block = lambda name: F.expr(f"coalesce({_TEXT_OF.format('b', name)}, '')")
    is_kind = lambda k: F.col("kind") == k
    text = F.when(is_kind("user_prompt"), _joined("content")).when(is_kind("tool_result"), _joined("try_variant_get(b, '$.content', 'variant')")).when(is_kind("assistant_text"), block("text"))
    slot = F.coalesce(get("b", "apiBlockIndex", "int"), F.col("i")).cast("string")
    key = F.when(is_kind("assistant_text") & (F.col("mid") != ""), F.concat_ws("\0", "mid", slot)).when(is_kind("tool_use"), F.concat_ws("\0", F.col("mid"), slot, block("id")))
    rows = rows.select(
        "path", "pos", "type", "ts", "sid", "cwd", "side", "agent", "kind", text.alias("text"), key.alias("key"),
        F.struct(F.col("pos").alias("line"), F.when(assistant, 1).otherwise(0).alias("part"), F.coalesce("i", F.lit(0)).alias("index")).alias("at"),
        F.when(is_kind("tool_use"), block("id")).alias("id"), F.when(is_kind("tool_use"), block("name")).alias("name"), F.when(is_kind("tool_use"), F.expr("to_json(try_variant_get(b, '$.input', 'variant'))")).alias("input"),
        F.when(is_kind("assistant_text"), F.col("model")).alias("model"), F.when(is_kind("tool_result"), block("tool_use_id")).alias("of"),
        ((F.col("n_results") == 1) & ((F.col("denial") != "") | (F.col("use_result") == "User rejected tool use"))).alias("marked"),
        (is_kind("tool_result") & F.coalesce(get("b", "is_error", "boolean"), F.lit(False))).alias("error"),
    )
    rows = materialize(rows, "lines-a")

    work = F.col("type").isin("user", "assistant")
    sessions = rows.groupBy("path").agg(
        F.coalesce(F.min_by("sid", F.when(F.col("sid") != "", F.col("pos"))), F.lit("")).alias("sid"),
        F.coalesce(F.min_by("cwd", F.when(F.col("cwd") != "", F.col("pos"))), F.lit("")).alias("cwd"),
        F.coalesce(F.min(F.when(F.col("ts") != "", F.col("ts"))), F.lit("")).alias("started"),
        F.coalesce(F.max("ts"), F.lit("")).alias("ended"),
        F.bool_and(F.when(work, F.col("side") & (F.col("agent") != ""))).alias("all_side"),
        F.min(F.when(work, F.col("agent"))).alias("a0"),
        F.max(F.when(work, F.col("agent"))).alias("a1"),
    )
    stem = F.regexp_extract("path", r"([^/]*?)(?:\.jsonl?)?$", 1)
    own = F.coalesce(F.col("all_side") & (F.col("a0") == F.col("a1")), F.lit(False))
    name = F.when(own, F.concat_ws("/", F.nullif("sid", F.lit("")), "a0")).otherwise(F.coalesce(F.nullif("sid", F.lit("")), stem))
    sessions = sessions.select("path", own.alias("own"), name.alias("session_id"), "cwd", "started", "ended")

    events = rows.join(sessions.select("path", "own"), "path").where((~F.col("side") | F.col("own")) & F.col("kind").isNotNull())
    events = events.withColumn("never", F.coalesce(F.col("error") & (F.col("of") != "") & (F.col("marked") | _never_ran_a(F.col("text"))), F.lit(False)))
    file = Window.partitionBy("path").orderBy("at")
    events = events.withColumn("turn", F.sum(F.when(F.col("kind") == "user_prompt", 1).otherwise(0)).over(file).cast("int"))
    # A streamed block stands at its first place with its longest text; a repeated call counts once.
    same = Window.partitionBy("path", "kind", F.coalesce("key", F.to_json("at")))
    first = F.row_number().over(same.orderBy("at"))
    longest = F.max_by("text", F.struct(F.length("text"), -F.col("at.line"), -F.col("at.index"))).over(same)
    events = events.withColumn("nth", first).withColumn("text", F.when(F.col("kind") == "assistant_text", longest).otherwise(F.col("text")))
    call = Window.partitionBy("path", F.coalesce("id", "of"))
    refused = F.max(F.when(F.col("never"), 1)).over(call).isNotNull() & (F.coalesce("id", F.lit("")) != "")
    events = events.withColumn("refused", refused).where(~((F.col("kind").isin("assistant_text", "tool_use")) & (F.col("nth") > 1)) & ~F.col("never") & ~((F.col("kind") == "tool_use") & F.col("refused")))
    return _finish(events.withColumnRenamed("of", "tool_use_id").select(*_EVENT), sessions, "claude-code")


def read_b(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Runtime B: items with a payload; turns come from turn_context, not from prompts."""
    rows = _objects(lines).select("path", "pos", get("v", "type").alias("type"), F.coalesce(text_field("v", "timestamp"), F.lit("")).alias("ts"), get("v", "payload", "variant").alias("p"))
    rows = rows.where("p is null or schema_of_variant(p) like 'OBJECT%' or schema_of_variant(p) = 'VOID'")
    meta = F.col("type") == "session_meta"
    text = lambda name: F.coalesce(text_field("p", name), F.lit(""))
    sessions = rows.groupBy("path").agg(
        F.min_by(F.struct(get("p", "id").alias("id"), text("cwd").alias("cwd"), text("model").alias("model")), F.when(meta, F.col("pos"))).alias("m"),
        F.coalesce(F.min_by("ts", F.when(F.col("ts") != "", F.col("pos"))), F.lit("")).alias("started"),
        F.coalesce(F.max_by("ts", F.when(F.col("ts") != "", F.col("pos"))), F.lit("")).alias("ended"),
    )
    stem = F.regexp_extract("path", r"([^/]*?)(?:\.jsonl?)?$", 1)
    sessions = sessions.select("path", F.coalesce(F.nullif("m.id", F.lit("")), stem).alias("session_id"), F.coalesce("m.cwd", F.lit("")).alias("cwd"), F.coalesce("m.model", F.lit("")).alias("meta_model"), "started", "ended")
    upto = Window.partitionBy("path").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    context = F.col("type") == "turn_context"
    rows = rows.withColumn("turn", F.sum(F.when(context, 1).otherwise(0)).over(upto).cast("int"))
    rows = rows.withColumn("now", F.last(F.when(context, F.nullif(text("model"), F.lit(""))), ignorenulls=True).over(upto))
    rows = rows.join(sessions.select("path", "meta_model"), "path").where("type = 'response_item'").withColumn("what", get("p", "type")).withColumn("call", text("call_id"))

    raw = F.expr("coalesce(try_variant_get(p, '$.arguments', 'variant'), try_variant_get(p, '$.input', 'variant'))")
    calls = rows.where("what in ('function_call', 'custom_tool_call')").withColumn("raw", raw)
    spelled = F.expr("case when schema_of_variant(raw) = 'STRING' then try_variant_get(raw, '$', 'string') end")
    args = F.coalesce(F.when(spelled.isNotNull(), F.coalesce(F.expr("to_json(try_parse_json(try_variant_get(raw, '$', 'string')))"), F.to_json(F.struct(spelled.alias("command"))))), F.to_json("raw"), F.lit("{}"))
    cmd = F.get_json_object(args, "$.cmd")
    merged = F.when(F.startswith(args, F.lit("{")) & cmd.isNotNull(), F.concat(F.expr("substring(args, 1, length(args) - 1)"), F.lit(', "command": '), F.coalesce(F.expr("to_json(try_variant_get(try_parse_json(args), '$.cmd', 'variant'))"), F.lit("null")), F.lit("}"))).otherwise(F.col("args"))
    calls = calls.withColumn("args", args).withColumn("input", merged)
    name = text("name")
    known = F.coalesce(F.create_map(*[F.lit(x) for kv in NAMES_B.items() for x in kv])[name], name)
    outputs = rows.where("what in ('function_call_output', 'custom_tool_call_output')").withColumn("o", get("p", "output", "variant"))
    each = "transform(filter(try_variant_get(o, '$', 'array<variant>'), x -> schema_of_variant(x) like 'OBJECT%'), x -> coalesce(try_variant_get(x, '$.text', 'string'), ''))"
    flat = F.expr(f"case when schema_of_variant(o) = 'STRING' then try_variant_get(o, '$', 'string') else array_join({each}, '') end")
    outputs = outputs.withColumn("flat", F.trim(F.coalesce(flat, F.lit(""))))
    never = F.col("flat").isin(*NOT_RUN_B)
    for prefix in NOT_RUN_PREFIX_B:
        never = never | F.startswith("flat", F.lit(prefix))
    outputs = outputs.withColumn("never", (F.col("call") != "") & never)
    shown = F.expr(f"case when schema_of_variant(o) = 'STRING' then try_variant_get(o, '$', 'string') else coalesce(array_join({each}, '\n'), '') end")
    refused = outputs.where("never").select("path", "call").distinct()
    said = F.expr(
        "case when schema_of_variant(c) = 'STRING' then try_variant_get(c, '$', 'string') else coalesce(array_join(transform(filter(try_variant_get(c, '$', 'array<variant>'), "
        "x -> schema_of_variant(x) like 'OBJECT%'), x -> coalesce(try_variant_get(x, '$.text', 'string'), '')), '\n'), '') end"
    )
    messages = rows.where("what = 'message'").withColumn("role", get("p", "role")).withColumn("c", get("p", "content", "variant"))
    at = _place("pos", 0)
    turn = F.col("turn")
    events = (
        _event(calls.join(refused, ["path", "call"], "left_anti"), at=at, kind=F.lit("tool_use"), turn=turn, id=F.col("call"), name=known, input=F.col("input"))
        .unionAll(_event(outputs.where("not never"), at=at, kind=F.lit("tool_result"), turn=turn, tool_use_id=F.col("call"), text=shown))
        .unionAll(_event(messages.where("role = 'assistant'"), at=at, kind=F.lit("assistant_text"), turn=turn, text=said, model=F.coalesce("now", "meta_model")))
        .unionAll(_event(messages.where("role = 'user'"), at=at, kind=F.lit("user_prompt"), turn=turn, text=said))
    )
    return _finish(events, sessions, "codex")


def read_c(lines: DataFrame, project_roots: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Runtime C: metadata, messages, ``$set`` and ``$rewindTo`` records, or one legacy object with ``messages``.

    Messages are upserted by id: the last version counts, at the place where the id first appeared.
    ``project_roots`` (path, project_root) gives the folder that relative paths belong to; under a POSIX root
    a shell call is the tool Bash.
    """
    rows = _objects(lines)
    special = """try_variant_get(v, '$["{}"]', 'variant')"""
    rows = rows.where(F.expr(special.format("$rewindTo") + " is null")).withColumn("set", F.expr(special.format("$set")))
    plain = rows.where("set is null")
    has_id = text_field("v", "id").isNotNull()
    records = plain.where(has_id).select("path", "pos", F.lit(0).alias("sub"), "v")
    meta = plain.where(~has_id & text_field("v", "sessionId").isNotNull())
    listed = meta.select("path", "pos", F.posexplode(get("v", "messages", "array<variant>")).alias("sub", "v")).where(F.expr("schema_of_variant(v) like 'OBJECT%'") & has_id)
    records = records.unionByName(listed).withColumn("id", text_field("v", "id")).withColumn("place", F.struct("pos", "sub"))
    # VARIANT is no grouping value; its JSON text is.
    latest = records.groupBy("path", "id").agg(F.min("place").alias("first"), F.max_by(F.to_json("v"), "place").alias("json"))
    latest = latest.select("path", F.col("first.pos").alias("pos"), F.col("first.sub").alias("sub"), F.try_parse_json("json").alias("v"))
    stamps = (
        meta.select("path", F.explode(F.array(text_field("v", "startTime"), text_field("v", "lastUpdated"))).alias("s"))
        .unionAll(rows.where("set is not null").select("path", text_field("set", "lastUpdated").alias("s")))
        .unionAll(latest.select("path", F.nullif(text_field("v", "timestamp"), F.lit("")).alias("s")))
        .groupBy("path")
        .agg(F.coalesce(F.min("s"), F.lit("")).alias("started"), F.coalesce(F.max("s"), F.lit("")).alias("ended"))
    )
    nested = F.regexp_extract("path", r"/chats/(?:(.*)/)?[^/]*$", 1)
    stem = F.regexp_extract("path", r"([^/]*?)(?:\.jsonl?)?$", 1)
    ids = meta.groupBy("path").agg(F.min_by(text_field("v", "sessionId"), "pos").alias("own"))
    sessions = rows.select("path").distinct().join(ids, "path", "left").join(stamps, "path", "left")
    if project_roots is not None:
        sessions = sessions.join(project_roots, "path", "left")
    else:
        sessions = sessions.withColumn("project_root", F.lit(None).cast("string"))
    sessions = sessions.select(
        "path", F.concat_ws("/", F.nullif(nested, F.lit("")), F.coalesce(F.nullif("own", F.lit("")), stem)).alias("session_id"),
        F.coalesce("project_root", F.lit("")).alias("cwd"), F.coalesce("started", F.lit("")).alias("started"), F.coalesce("ended", F.lit("")).alias("ended"),
    )
    latest = latest.join(sessions.select("path", "cwd"), "path")

    part = lambda field: (
        f"array_join(transform(filter(coalesce(try_variant_get(try_variant_get(v, '$.{field}', 'variant'), '$', 'array<variant>'), array(try_variant_get(v, '$.{field}', 'variant'))), "
        "x -> schema_of_variant(x) = 'STRING' or (schema_of_variant(x) like 'OBJECT%' and schema_of_variant(try_variant_get(x, '$.text', 'variant')) = 'STRING' and not coalesce(try_variant_get(x, '$.thought', 'boolean'), false))), "
        "x -> case when schema_of_variant(x) = 'STRING' then try_variant_get(x, '$', 'string') else try_variant_get(x, '$.text', 'string') end), '')"
    )
    kind = get("v", "type")
    parts = F.expr("coalesce(try_variant_get(try_variant_get(v, '$.content', 'variant'), '$', 'array<variant>'), array(try_variant_get(v, '$.content', 'variant')))")
    responses = F.expr("coalesce(size(parts) > 0 and forall(parts, x -> coalesce(schema_of_variant(x) like 'OBJECT%', false) and try_variant_get(x, '$.functionResponse', 'variant') is not null), false)")
    latest = latest.withColumn("kind", kind).withColumn("parts", parts).withColumn("answers", responses)
    latest = latest.withColumn("prompt", (F.col("kind") == "user") & ~F.col("answers"))
    order = Window.partitionBy("path").orderBy("pos", "sub")
    latest = latest.withColumn("turn", F.sum(F.when(F.col("prompt"), 1).otherwise(0)).over(order).cast("int"))
    at = lambda p, i=0: F.struct(F.col("pos").alias("line"), (F.col("sub") * 2 + p).cast("int").alias("part"), (i if isinstance(i, Column) else F.lit(i)).cast("int").alias("index"))
    turn = F.col("turn")
    shown = F.coalesce(F.nullif(F.expr(part("displayContent")), F.lit("")), F.expr(part("content")), F.lit(""))
    prompts = _event(latest.where("prompt"), at=at(0), kind=F.lit("user_prompt"), turn=turn, text=shown)
    texts = latest.where("kind = 'gemini'").withColumn("said", F.coalesce(F.expr(part("content")), F.lit(""))).where("trim(said) <> ''")
    texts = _event(texts, at=at(0), kind=F.lit("assistant_text"), turn=turn, text=F.col("said"), model=F.lit(""))
    calls = latest.where("kind = 'gemini'").select("path", "pos", "sub", "turn", "cwd", F.posexplode(get("v", "toolCalls", "array<variant>")).alias("i", "c"))
    calls = calls.where("schema_of_variant(c) like 'OBJECT%' and try_variant_get(c, '$.status', 'string') = 'success'")
    posix = F.startswith("cwd", F.lit("/"))
    native = F.coalesce(text_field("c", "name"), F.lit(""))
    args = F.expr("case when schema_of_variant(try_variant_get(c, '$.args', 'variant')) like 'OBJECT%' then to_json(try_variant_get(c, '$.args', 'variant')) else '{}' end")
    mapped = F.create_map(*[F.lit(x) for kv in NAMES_C.items() for x in kv])
    edited = mapped[native].isNotNull() & (F.coalesce(get("c", "args.modified_by_user", "boolean"), F.lit(False)) | get("c", "args.ai_proposed_content", "variant").isNotNull())
    calls = calls.withColumn("native", native).withColumn("args", args).withColumn("edited", edited).withColumn("use", F.coalesce(text_field("c", "id"), F.lit("")))
    calls = calls.withColumn("tool", F.when((F.col("native") == "run_shell_command") & posix, "Bash").when(F.col("edited"), F.col("native")).otherwise(F.coalesce(mapped[F.col("native")], F.col("native"))))
    fields = F.from_json("args", "map<string,string>")
    without_text = F.to_json(F.map_filter(fields, lambda k, _: ~k.isin("content", "new_string", "old_string", "ai_proposed_content")))
    calls = calls.withColumn("args", F.when(F.col("edited"), without_text).otherwise(F.col("args")))
    calls = calls.withColumn("args", F.when((F.col("tool").isin("Write", "Edit") | F.col("edited")) & posix, _resolved(F.col("args"), F.col("cwd"))).otherwise(F.col("args")))
    uses = _event(calls, at=at(1, F.col("i") * 2), kind=F.lit("tool_use"), turn=turn, id=F.col("use"), name=F.col("tool"), input=F.col("args"))
    r = "try_variant_get(c, '$.result', 'variant')"
    pieces = (
        f"flatten(transform(coalesce(try_variant_get({r}, '$', 'array<variant>'), array({r})), x -> case when schema_of_variant(x) = 'STRING' then array(try_variant_get(x, '$', 'string')) else filter(array("
        "case when schema_of_variant(try_variant_get(x, '$.text', 'variant')) = 'STRING' then try_variant_get(x, '$.text', 'string') end, "
        "case when schema_of_variant(try_variant_get(x, '$.functionResponse.response.output', 'variant')) = 'STRING' then try_variant_get(x, '$.functionResponse.response.output', 'string') end, "
        "case when schema_of_variant(try_variant_get(x, '$.functionResponse.response.error', 'variant')) = 'STRING' then try_variant_get(x, '$.functionResponse.response.error', 'string') end), y -> y is not null) end))"
    )
    full = F.expr(f"{r} is not null and to_json({r}) not in ('null', '[]', '{{}}', '\"\"', 'false', '0')")
    results = _event(calls.where(full), at=at(1, F.col("i") * 2 + 1), kind=F.lit("tool_result"), turn=turn, tool_use_id=F.col("use"), text=F.expr(f"coalesce(array_join({pieces}, '\n'), '')"))
    return _finish(prompts.unionAll(texts).unionAll(uses).unionAll(results), sessions, "gemini")


def _resolved(args: Column, root: Column) -> Column:
    """``file_path`` joined to the root and without ``.`` and ``..``; as written where it would climb out."""
    path = F.get_json_object(args, "$.file_path")
    joined = F.split(F.concat(F.regexp_replace(root, "/+$", ""), F.lit("/"), path), "/")
    folded = F.aggregate(
        joined,
        F.array().cast("array<string>"),
        lambda acc, x: F.when(x.isin("", "."), acc).when(x == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(x))),
    )
    whole = F.concat(F.lit("/"), F.array_join(folded, "/"))
    inside = (whole == root) | F.startswith(whole, F.concat(F.regexp_replace(root, "/+$", ""), F.lit("/")))
    fields = F.from_json(args, "map<string,string>")
    moved = F.to_json(F.map_concat(F.map_filter(fields, lambda k, _: k != "file_path"), F.create_map(F.lit("file_path"), whole)))
    return F.when(path.isNotNull() & (path != "") & ~F.startswith(path, F.lit("/")) & inside, moved).otherwise(args)
