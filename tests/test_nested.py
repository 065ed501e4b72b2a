"""Flat rows of nested records against a plain recursive reading."""

import json

from logloom.operators.nested import node_table, tool_items


def test_tool_items(spark):
    lines = [
        (1, json.dumps({"content": [{"type": "text"}, {"type": "tool_use", "id": "u", "input": {"command": ["ls", "-la"]}}, 7, {"type": "tool_result", "tool_use_id": "u", "content": [{"type": "tool_use", "id": "deep"}]}]}), "x"),
        (2, json.dumps({"content": {"type": "tool_use", "id": None, "input": '{"command": "pwd"}'}}), "x"),
        (3, '{"content": [{"type": "tool_use", "id": "cut"', "x"),
        (4, None, None),
        (5, "", ""),
        (6, json.dumps({"content": "tool_use"}), "x"),
        (7, json.dumps({"content": [{"type": "tool_use", "id": 5, "input": {"command": 'a "b" é\\'}}]}), "x"),
        (7, json.dumps({"content": [{"type": "tool_use", "id": 5, "input": {"command": 'a "b" é\\'}}]}), "x"),
        (8, json.dumps({"content": [{"type": "tool_result", "tool_use_id": "big", "content": "z" * 400_000}]}), "x"),
    ]
    records = [
        (1, json.dumps({"toolCalls": [{"id": "c", "args": {"command": "make"}}, {"args": None}, None], "content": [{"text": "t"}, {"functionResponse": {"id": "c"}}, {"functionResponse": None}]}), 0),
        (2, json.dumps({"messages": [{"toolCalls": {"id": "x", "args": "not json"}}, "junk", {"content": {"functionResponse": {}}}]}), 0),
        (3, json.dumps({"toolCalls": None, "content": None}), 0),
    ]
    a = spark.createDataFrame(lines, "line_id long, message string, command string")
    b = spark.createDataFrame(records, "record_id long, body string, src int")
    got = sorted(map(tuple, tool_items(a, b).collect()))
    odd = 'a "b" é\\'
    assert got == sorted(
        [
            ("session_lines", 1, -1, "tool_use", 1, "u", "ls -la"),
            ("session_lines", 1, -1, "tool_result", 3, "u", ""),
            ("session_lines", 2, -1, "tool_use", 0, "", "pwd"),
            ("session_lines", 7, -1, "tool_use", 0, "5", odd),
            ("session_lines", 7, -1, "tool_use", 0, "5", odd),
            ("session_lines", 8, -1, "tool_result", 0, "big", ""),
            ("chat_records", 1, -1, "call", 0, "c", "make"),
            ("chat_records", 1, -1, "call", 1, "", ""),
            ("chat_records", 1, -1, "response", 1, "c", ""),
            ("chat_records", 2, 0, "call", 0, "x", ""),
            ("chat_records", 2, 2, "response", 0, "", ""),
        ]
    )
    assert tool_items(a.limit(0), b.limit(0)).collect() == []


def test_node_table_rebuilds_the_record(spark):
    value = {"a": [1, {"b": None, "c": "x\ny"}], "d": {}, "e": [], "f": True}
    df = spark.createDataFrame([(1, json.dumps(value)), (2, '{"a"'), (3, None), (4, '"only"')], "row_id long, body string")
    rows = node_table(df, "row_id", "body").orderBy("row_id", "node").collect()
    assert [r["value"] for r in rows if r["row_id"] == 4] == ["only"]
    nodes = {r["node"]: r for r in rows if r["row_id"] == 1}

    def build(n):
        r, kids = nodes[n], sorted((k for k in nodes.values() if k["parent"] == n), key=lambda k: k["place"])
        if r["kind"] == "object":
            return {k["name"]: build(k["node"]) for k in kids}
        if r["kind"] == "array":
            return [build(k["node"]) for k in kids]
        return r["value"] if r["kind"] == "string" else json.loads(r["value"] or "null")

    assert build(0) == value and {r["row_id"] for r in rows} == {1, 4}
    assert all(r["depth"] == nodes[r["parent"]]["depth"] + 1 for r in nodes.values() if r["parent"] >= 0)


def test_nodes_of_both_tables(spark, tmp_path):
    from logloom.plans.records import p2_nodes

    spark.createDataFrame([(5, '{"content": [{"type": "text"}]}'), (6, None)], "line_id long, message string").write.parquet(str(tmp_path / "session_lines.parquet"))
    spark.createDataFrame([(5, '{"a": 1}')], "record_id long, body string").write.parquet(str(tmp_path / "chat_records.parquet"))
    got = sorted((r["src"], r["row_id"], r["node"], r["parent"], r["name"], r["value"]) for r in p2_nodes(spark, str(tmp_path)).collect())
    assert got == [
        ("chat_records", 5, 0, -1, None, None), ("chat_records", 5, 1, 0, "a", "1"),
        ("session_lines", 5, 0, -1, None, None), ("session_lines", 5, 1, 0, "content", None), ("session_lines", 5, 2, 1, None, None), ("session_lines", 5, 3, 2, "type", "text"),
    ]
