"""Readers of the three formats on small sessions of our own."""

import json

from logloom.sources import sessions, transcripts


def lines(spark, files):
    rows = [(p, n, x if isinstance(x, str) else json.dumps(x)) for p, entries in files.items() for n, x in enumerate(entries)]
    return spark.createDataFrame(rows, "path string, pos long, line string")


def shown(events):
    return [(r["kind"], r["turn"], r["id"] or r["tool_use_id"], r["name"] or r["tool_name"], r["text"], r["final"]) for r in events.orderBy("path", "pos").collect()]


def a(kind, second, content=None, mid=None, **more):
    return {"type": kind, "timestamp": f"2025-01-01T00:00:{second:02d}Z", "sessionId": "s1", "cwd": "/work/repo", "message": {"id": mid, "model": "m", "content": content}, **more}


def test_runtime_a(spark):
    use = lambda i, name="Bash": {"type": "tool_use", "id": i, "name": name, "input": {"command": "ls"}}
    entries = [
        a("user", 1, "hello"),
        a("assistant", 2, [{"type": "text", "text": "par"}, use("t1")], "m1"),
        a("assistant", 3, [{"type": "text", "text": "partial grown"}, use("t1")], "m1"),
        a("assistant", 3, [use("t2")], "m2"),
        a("user", 4, [{"type": "tool_result", "tool_use_id": "t1", "content": [{"type": "text", "text": "out"}]}]),
        a("user", 5, [{"type": "tool_result", "tool_use_id": "t2", "is_error": True, "content": "nope"}], toolDenialKind="policy"),
        a("user", 6, "meta", isMeta=True),
        a("assistant", 6, [{"type": "text", "text": "side"}], isSidechain=True),
        {"type": "system", "subtype": "compact_boundary", "timestamp": "2025-01-01T00:00:07Z"},
        a("assistant", 8, "a plain string is no event", "m3"),
        a("user", 9, [{"type": "text", "text": "a"}, {"type": "text", "text": "b"}]),
        a("assistant", 10, [{"type": "text", "text": "end"}], "m4"),
        '{"type": "assist',
        "[1]",
    ]
    events, meta = transcripts.read_a(lines(spark, {"/x/f.jsonl": entries}))
    assert shown(events) == [
        ("user_prompt", 1, None, None, "hello", None),
        ("assistant_text", 1, None, None, "partial grown", True),
        ("tool_use", 1, "t1", "Bash", None, None),
        ("tool_result", 1, "t1", "Bash", "out", None),
        ("compact", 1, None, None, None, None),
        ("user_prompt", 2, None, None, "a\nb", None),
        ("assistant_text", 2, None, None, "end", True),
    ]
    s = meta.collect()[0]
    assert (s["session_id"], s["repo"], s["started"], s["ended"], s["n_events"]) == ("s1", "repo", "2025-01-01T00:00:01Z", "2025-01-01T00:00:10Z", 7)


def test_runtime_a_subagent_file(spark):
    entries = [a("user", 1, "go", isSidechain=True, agentId="ag"), a("assistant", 2, [{"type": "text", "text": "ok"}], "m", isSidechain=True, agentId="ag")]
    events, meta = transcripts.read_a(lines(spark, {"/x/sub.jsonl": entries}))
    assert meta.collect()[0]["session_id"] == "s1/ag" and events.count() == 2


def test_runtime_b(spark):
    item = lambda kind, s, **p: {"type": kind, "timestamp": f"2025-01-01T00:00:{s:02d}Z", "payload": p}
    entries = [
        item("session_meta", 0, id="r1", cwd="/w/proj", model="base"),
        item("turn_context", 1, model="first"),
        item("response_item", 2, type="message", role="user", content=[{"type": "input_text", "text": "do"}]),
        item("response_item", 3, type="function_call", call_id="c1", name="exec_command", arguments='{"cmd": "ls -la"}'),
        item("response_item", 4, type="function_call_output", call_id="c1", output="files"),
        item("response_item", 5, type="custom_tool_call", call_id="c2", name="apply_patch", input="*** patch"),
        item("response_item", 6, type="custom_tool_call_output", call_id="c2", output="patch rejected by user"),
        item("response_item", 7, type="message", role="assistant", content=[{"type": "output_text", "text": "a"}]),
        item("turn_context", 8),
        item("response_item", 9, type="message", role="assistant", content="b"),
        {"type": "response_item", "payload": "bad"},
    ]
    events, meta = transcripts.read_b(lines(spark, {"/x/r.jsonl": entries}))
    rows = events.orderBy("pos").collect()
    assert [(r["kind"], r["turn"], r["text"], r["final"], r["model"]) for r in rows if r["kind"] != "tool_use"] == [
        ("user_prompt", 1, "do", None, None), ("tool_result", 1, "files", None, None), ("assistant_text", 1, "a", False, "first"), ("assistant_text", 2, "b", True, "first"),
    ]
    call = next(r for r in rows if r["kind"] == "tool_use")
    assert call["name"] == "Bash" and json.loads(call["input"])["command"] == "ls -la" and len(rows) == 5
    assert meta.collect()[0]["repo"] == "proj"


def test_runtime_c(spark):
    call = {"id": "k", "name": "run_shell_command", "args": {"command": "ls"}, "status": "success", "result": [{"functionResponse": {"id": "k", "response": {"output": "files"}}}]}
    write = {"id": "w", "name": "write_file", "args": {"file_path": "a/../b.txt", "content": "x"}, "status": "success", "result": []}
    entries = [
        {"sessionId": "g1", "projectHash": "h", "startTime": "2025-01-01T00:00:00Z", "lastUpdated": "2025-01-01T00:00:01Z"},
        {"id": "1", "type": "user", "timestamp": "2025-01-01T00:00:02Z", "content": "hi"},
        {"id": "2", "type": "gemini", "content": "draft", "toolCalls": [call, {**call, "status": "error"}]},
        {"id": "3", "type": "user", "content": [{"functionResponse": {"id": "k"}}]},
        {"id": "2", "type": "gemini", "content": [{"text": "th", "thought": True}, {"text": "last"}], "toolCalls": [call, write]},
        {"$set": {"lastUpdated": "2025-01-01T01:00:00Z"}},
        {"$rewindTo": "1"},
    ]
    path = "/x/chats/parent/s.jsonl"
    roots = spark.createDataFrame([(path, "/root/p")], "path string, project_root string")
    events, meta = transcripts.read_c(lines(spark, {path: entries}), roots)
    assert [(r[0], r[2], r[3], r[4]) for r in shown(events)] == [("user_prompt", None, None, "hi"), ("assistant_text", None, None, "last"), ("tool_use", "k", "Bash", None), ("tool_result", "k", "Bash", "files"), ("tool_use", "w", "Write", None)]
    assert json.loads(events.where("id = 'w'").collect()[0]["input"])["file_path"] == "/root/p/b.txt"
    s = meta.collect()[0]
    assert (s["session_id"], s["ended"]) == ("parent/g1", "2025-01-01T01:00:00Z")


def test_scan_copies_dates_and_errors(spark, tmp_path):
    good = [a("user", 1, "hi"), a("assistant", 2, [{"type": "text", "text": "yo"}], "m")]
    for name, entries in {"b.jsonl": good, "sub/a.jsonl": [*good, a("user", 3, "more")], "empty.jsonl": [{"type": "summary"}]}.items():
        f = tmp_path / name
        f.parent.mkdir(exist_ok=True)
        f.write_text("\n".join(json.dumps(x) for x in entries) + '\n{"half')
    s = sessions.scan(spark, str(tmp_path))
    assert [r["path"].rsplit("/", 1)[-1] for r in s.sessions.collect()] == ["a.jsonl"]
    assert sorted((r["path"].rsplit("/", 1)[-1], r["error"]) for r in s.errors.collect()) == [("b.jsonl", "a copy of another session"), ("empty.jsonl", "no event")]
    assert s.events.count() == 3
    assert sessions.scan(spark, str(tmp_path), since="2025-06-01").sessions.count() == 0
