"""Schema changes on hand-made files, and the consistent table with its failed casts."""

import json
from datetime import datetime

import pytest

from logloom.operators import drift as d

LINES = "item_id long, stream_id string, file_id long, written_at timestamp, line_no int, body string, path string"


def lines(spark, files):
    rows = []
    for file, stream, day, bodies in files:
        for n, b in enumerate(bodies):
            rows.append((len(rows), stream, file, datetime(2025, 1, day), n, b if b is None or isinstance(b, str) else json.dumps(b), "clash"))
    return spark.createDataFrame(rows, LINES)


def item(payload, **top):
    return {"type": "response_item", "timestamp": "2025-01-01T00:00:00Z", "payload": payload, **top}


def test_all_kinds(spark):
    call = {"type": "function_call", "call_id": "call_0123456789abcdef", "name": "exec_command"}
    files = [
        (7, "s", 1, [item({**call, "arguments": '{"cmd": "ls"}', "phase": "commentary"}), item({"type": "message", "role": "user"}), None, "{half", ""]),
        (3, "s", 2, [item({"type": "function_call", "callId": "call_fedcba9876543210", "name": "exec_command", "arguments": {"cmd": "ls"}, "turn": 4}), item({"type": "message", "role": "assistant", "phase": None})]),
        (9, "s", 3, [{"record_type": "response_item", "timestamp": 1735689600000, "payload": {"type": "function_call", "callId": "call_1111111111111111", "name": "exec_command", "arguments": {"cmd": "ls"}, "turn": 5}}, {"record_type": "response_item", "timestamp": 1735689600000, "payload": {"type": "message", "speaker": "user"}}]),
        (1, "other", 2, [item(call)]),
        (2, None, 2, [item(call)]),
    ]
    got = sorted(map(tuple, d.schema_changes(lines(spark, files)).collect()))
    assert got == sorted(
        [
            (3, "renamed", "payload.call_id", "payload.callId"),
            (3, "retyped", "payload.arguments", "payload.arguments"),
            (3, "removed", "payload.phase", ""),
            (3, "added", "", "payload.turn"),
            (9, "renamed", "type", "record_type"),
            (9, "retyped", "timestamp", "timestamp"),
            (9, "renamed", "payload.role", "payload.speaker"),
        ]
    )


def test_no_rename_across_types_sorts_or_kinds(spark):
    files = [
        (1, "s", 1, [item({"type": "message", "role": "user", "mark": "x y z", "n": 5}), item({"type": "function_call", "call_id": "call_0123456789"})]),
        (2, "s", 2, [item({"type": "message", "role": "user", "when": "2025-01-01T00:00:00Z", "m": "5"}), item({"type": "function_call", "call_id": "call_0123456789", "note": "x y z"})]),
    ]
    assert {r["change_kind"] for r in d.schema_changes(lines(spark, files)).collect()} == {"added", "removed"}


def test_long_stream_over_partitions_and_repeats(spark):
    files = [(k, "hot", 1 + k % 28, [item({"type": "message", f"f{k % 28 % 2}": True})] * 3) for k in range(28)]
    got = d.schema_changes(lines(spark, files).repartition(7)).collect()
    assert len(got) == 27 and {r["change_kind"] for r in got} == {"renamed"}


def test_empty(spark):
    assert d.schema_changes(lines(spark, [])).collect() == []


def test_consistent_table(spark):
    files = [(1, "s", 1, [item({"type": "message", "exit_code": 3}), item({"type": "message", "exit_code": "exit:3"}), item({"item_type": "x", "exit_code": None}), item({"data": {"a": 1}})])]
    table = d.consistent_table(lines(spark, files), {"code": ("int", ["payload.exit_code"]), "item": ("string", ["payload.type", "payload.item_type"]), "data": ("string", ["payload.data"])}, keep=["line_no"])
    rows = {r["line_no"]: r for r in table.collect()}
    assert rows[0]["code"] == 3 and rows[0]["failed_casts"] == []
    assert rows[1]["code"] is None and [tuple(x) for x in rows[1]["failed_casts"]] == [("code", "payload.exit_code", "string", "exit:3")]
    assert rows[2]["item"] == "x" and rows[2]["code"] is None and rows[2]["failed_casts"] == []
    assert rows[3]["data"] == '{"a":1}'
    with pytest.raises(ValueError):
        d.consistent_table(lines(spark, files), {"line_no": ("int", ["payload.x"])}, keep=["line_no"])


def test_table_holds_every_value(spark):
    call = {"type": "function_call", "call_id": "call_0123456789abcdef", "phase": "final", "n": 1}
    later = {"type": "function_call", "callId": "call_fedcba9876543210", "phase": "final", "n": 2.5}
    files = [
        (1, "s", 1, [item({**call, "usage": {"a": 1}}), item({**call, "usage": {"a": 2}})]),
        (2, "s", 2, [item({**later, "usage": 7, "line_no": True}), item(later, item_id="x"), item("bare")]),
        (None, "s", 2, [item({**later, "call_id": "call_00000000", "only_here": [1]})]),
    ]
    table = lines(spark, files)
    keep = ["item_id", "file_id", "line_no"]
    columns = d.consistent_columns(table, keep)
    assert columns == {
        "timestamp": ("string", ["timestamp"]), "type": ("string", ["type"]), "payload_callId": ("string", ["payload.callId", "payload.call_id"]), "payload_n": ("double", ["payload.n"]),
        "payload_phase": ("string", ["payload.phase"]), "payload_type": ("string", ["payload.type"]), "payload_usage": ("object", ["payload.usage"]),
        "item_id_2": ("string", ["item_id"]), "payload_line_no": ("boolean", ["payload.line_no"]), "payload_only_here": ("array", ["payload.only_here"]),
    }
    rows = {r["item_id"]: r for r in d.consistent_table(table, columns, keep).collect()}
    assert [rows[i]["payload_callId"] for i in range(4)] == ["call_0123456789abcdef"] * 2 + ["call_fedcba9876543210"] * 2
    assert rows[0]["payload_usage"] == '{"a":1}' and rows[2]["payload_usage"] is None
    assert [tuple(x) for x in rows[2]["failed_casts"]] == [("payload_usage", "payload.usage", "number", "7")]
    assert rows[5]["payload_callId"] == "call_fedcba9876543210" and [tuple(x) for x in rows[5]["other_paths"]] == [("payload.call_id", "string", "call_00000000")]
    assert [tuple(x) for x in rows[4]["other_paths"]] == [("payload", "string", "bare")]
    assert rows[5]["payload_only_here"] == "[1]" and rows[3]["item_id_2"] == "x"
    values = sum(sum(v is not None for v in r[len(keep) : -2]) + len(r["failed_casts"]) + len(r["other_paths"]) for r in rows.values())
    assert values == sum(len(r["entries"]) for r in d.path_values(table, keep=keep, raw=True).collect())
    few = {"type": ("string", ["type"]), "n": ("double", ["payload.n"])}
    assert [len(r["other_paths"]) for r in d.consistent_table(table, few, keep).orderBy("item_id").collect()] == [5, 5, 6, 5, 2, 6]
