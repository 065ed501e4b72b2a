"""The shipped detectors over whole transcripts: sessions, turns, names and inputs as they stand."""

import json

from logloom.plans.reference import QUERIES

LINES = "line_id long, session_id string, line_type string, subtype string, ts string, cwd string, is_sidechain boolean, agent_id string, is_meta boolean, is_compact_summary boolean, tool_denial_kind string, message string"
SECRET = "AKIA" + "Q7" * 8


def use(i, name, given):
    return {"type": "tool_use", "id": i, "name": name, "input": given}


def test_all_detectors_see_all_events(spark, tmp_path):
    def line(n, session, content, kind="assistant", model="m1", side=False, agent=None, subtype=None):
        message = None if content is None else json.dumps({"id": f"msg{n}", "model": model, "content": content})
        return (n, session, kind, subtype, f"2025-01-01T00:00:{n:02d}Z", "/w", side, agent, False, False, None, message)

    rows = [
        line(1, "s", "go", "user"),
        line(2, "s", [{"type": "text", "text": "a"}, use("w", "Write", {"file_path": "x", "content": f"key = {SECRET}"})]),
        line(3, "s", use("c", "Bash", json.dumps({"command": "cat a.txt"}))),
        line(4, "s", [use("p", "Bash", {"command": ["pip", "install", "x"], "description": "d"})]),
        line(5, "s", None, "system", subtype="compact_boundary"),
        line(6, "s", [{"type": "text", "text": "b"}, use("t", "Bash", {"command": "pytest -q"})], model="m2"),
        line(7, "s", [use("k", "Bash", {"command": "cat side.txt"})], side=True, agent="ag"),
        line(8, None, [use("n", "Bash", {"command": "cat none.txt"})]),
    ]
    spark.createDataFrame(rows, LINES).write.parquet(str(tmp_path / "session_lines.parquet"))
    hits = {(r["session_id"], r["detector"], r["turn"], r["tool_use_id"]) for r in QUERIES["library_hits"](spark, str(tmp_path)).collect()}
    sequence = {h[1] for h in hits if h[0] == "s" and h[1].startswith(("cache", "testing"))}
    assert sequence == {"cache-hygiene/compact", "cache-hygiene/model-switch", "testing/test-after-change"}
    assert {h for h in hits if not h[1].startswith(("cache", "testing"))} == {
        ("s", "secrets/secret-in-write", 1, "w"), ("s", "transcript-hygiene/whole-file-cat", 1, "c"), ("s", "package-manager/pip-install", 1, "p"),
        ("s/ag", "transcript-hygiene/whole-file-cat", 0, "k"), ("line-8", "transcript-hygiene/whole-file-cat", 0, "n"),
    }
    events = QUERIES["session_events"](spark, str(tmp_path)).where("id = 'w'").collect()
    assert json.loads(events[0]["input"])["content"] == f"key = {SECRET}"
