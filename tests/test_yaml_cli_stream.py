"""The YAML subset, the commands, and the streaming operators."""

import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from logloom import cli
from logloom.operators.sequence import order_within
from logloom.plans import yamlsubset as y
from logloom.streaming import sessions as stream

DOC = """
# detectors
version: 1
detectors:
- id: a/b   # note
  when:
    any:
      - tool: [Write, 'it''s']
      - {arg: {field: "x\\ty", regex: "a # b"}}
      -
        kind: compact
  n: [1, -2.5, true, null, ~]
- id: c/d
  when: {kind: x}
  empty:
"""


def test_subset():
    got = y.parse(DOC)
    assert got["detectors"][0]["when"]["any"] == [{"tool": ["Write", "it's"]}, {"arg": {"field": "x\ty", "regex": "a # b"}}, {"kind": "compact"}]
    assert got["detectors"][0]["n"] == [1, -2.5, True, None, None] and got["detectors"][1]["empty"] is None
    assert [e["schema_version"] for e in y.entries(got)] == [1, 1]
    assert y.parse("") is None and y.parse("[1, {a: b}]") == [1, {"a": "b"}]


@pytest.mark.parametrize("bad", ["a: &x 1", "a: *x", "a: !t 1", "a: |\n  x", "a: yes", "a: 012", "a: 1\na: 2", "\ta: 1", "a: 1\n---\nb: 2", "%YAML 1", "a: [1", "a: 'x", "a: b: c", "a: 1\n   b: 2", "{a: 1, a: 2}", "a: {b: 1", "- x\na: 1", "a: " + "[" * 40])
def test_refused(bad):
    with pytest.raises(y.YamlError) as e:
        y.parse(bad)
    assert e.value.line >= 1


VALUES = st.recursive(st.none() | st.booleans() | st.integers(-(10**9), 10**9) | st.floats(allow_nan=False, allow_infinity=False, width=32) | st.text(max_size=8), lambda x: st.lists(x, max_size=3) | st.dictionaries(st.text(max_size=5), x, max_size=3), max_leaves=10)


@settings(max_examples=200, deadline=None)
@given(VALUES)
def test_round_trip(value):
    assert y.parse(y.emit(value)) == value


def test_commands(spark, tmp_path, capsys):
    line = lambda kind, s, content, **k: json.dumps({"type": kind, "sessionId": "s1", "timestamp": f"2025-01-01T00:00:0{s}Z", "cwd": "/w/repo", "message": {"id": f"m{s}", "model": "m", "content": content}, **k})
    root = tmp_path / "logs"
    root.mkdir()
    (root / "a.jsonl").write_text("\n".join([line("user", 1, "hi"), line("assistant", 2, [{"type": "tool_use", "id": "t", "name": "Bash", "input": {"command": "cat a.py"}}]), line("assistant", 3, [{"type": "text", "text": "ok"}])]))
    extra = tmp_path / "own.yaml"
    extra.write_text("detectors:\n- id: own/hi\n  event: session\n  when: {message: {role: user, contains: hi}}\n- id: broken\n")
    assert cli.main(["report", "--root", str(root), "--json", "--detectors", str(extra)], spark) == 1
    by = {r["detector"]: r for r in json.loads(capsys.readouterr().out)}
    assert by["transcript-hygiene/whole-file-cat"]["hits"] == 1 and by["own/hi"]["sessions"] == 1
    assert cli.main(["report", "--root", str(root), "--by", "repo"], spark) == 0
    assert "repo" in capsys.readouterr().out
    assert cli.main(["explain", "--root", str(root), "--session", "s1", "--detector", "transcript-hygiene/whole-file-cat"], spark) == 0
    assert "cat a.py" in capsys.readouterr().out
    rules = tmp_path / "r.md"
    rules.write_text("# Tests\nRun the tests after a change.\n")
    assert cli.main(["bind", "--rules", str(rules)], spark) == 0
    assert "measured" in capsys.readouterr().out
    assert cli.main(["report", "--root", str(tmp_path / "none")], spark) == 2
    assert cli.main(["bind", "--rules", str(tmp_path / "none")], spark) == 2
    assert cli.main(["detectors"], spark) == 0
    with pytest.raises(SystemExit):
        cli.main(["report", "--root", ".", "--since", "2025"], spark)


def test_streams(spark, tmp_path):
    rows = [("s" if k % 3 else "t", k, k % 5 == 0, k % 7 == 3, k % 4 != 1, f"2025-01-01 00:{k // 60:02d}:{k % 60:02d}") for k in range(120)]
    df = spark.createDataFrame(rows, "session_id string, pos long, first boolean, then boolean, step boolean, t string").withColumn("ts", F.col("t").cast("timestamp"))
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    query = stream.order_within_stream(source, 3).writeStream.format("memory").queryName("followed").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    got = {(r["session_id"], r["pos"]): r["followed"] for r in spark.table("followed").collect()}
    batch = order_within(df.withColumn("kind", F.lit("x")), F.col("first"), F.col("then"), 3, keys=("session_id",), step=F.col("step")).where("opened").collect()
    want = {(r["session_id"], r["pos"]): r["followed"] for r in batch}
    assert got == {k: want[k] for k in got} and len(want) - len(got) <= 2  # the last openers are still open
    hits = source.select("ts", "session_id", F.lit("d").alias("detector"))
    query = stream.windowed_counts(hits).writeStream.format("memory").queryName("hits").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    assert spark.table("hits").columns == ["session_id", "detector", "start", "end", "hits"]
