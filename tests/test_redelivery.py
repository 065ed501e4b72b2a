"""Copies to drop, against a plain dictionary, in one go and batch by batch."""

import json
import random

import pytest
from pyspark.sql import functions as F

from logloom.operators import redelivery as r
from logloom.operators import sortedruns

LINES = "line_id long, session_id string, batch_no int, message string, row_id string"


def brute(rows):
    groups = {}
    for line, session, batch, message, _ in rows:
        try:
            m = json.loads(message)
        except (TypeError, ValueError):
            continue
        if session and m.get("id"):
            first = m["content"][0] if isinstance(m.get("content"), list) and m["content"] else m.get("content") if isinstance(m.get("content"), dict) else {}
            groups.setdefault((session, m["id"], first.get("apiBlockIndex") or 0), []).append((-1 if batch is None else batch, line))
    return sorted(line for g in groups.values() for _, line in sorted(g)[:-1])


def make(n, seed, hot=0.4):
    rng = random.Random(seed)
    out = []
    for k in range(n):
        mid = "hot" if rng.random() < hot else rng.choice(["", None, *[f"m{i}" for i in range(n // 4)]])
        content = rng.choice([[{"type": "text", "apiBlockIndex": 1}], {"apiBlockIndex": 1}, "text", [], None, [{"type": "text"}]])
        message = rng.choice([None, "", "{half"]) if rng.random() < 0.05 else json.dumps({"id": mid, "content": content})
        out.append((k, rng.choice(["s", "s", "t", None, ""]), rng.choice([None, 1, 2, 3, 4, 5]), message, "clash"))
    rng.shuffle(out)
    return out


def test_one_go(spark):
    rows = make(800, 1)
    got = r.redelivered(r.line_deliveries(spark.createDataFrame(rows, LINES).repartition(5)))
    assert sorted(x["row_id"] for x in got.collect()) == brute(rows)


def test_batches_replace_and_merge(spark, monkeypatch):
    monkeypatch.setattr(r, "LOCAL_ROWS", 50)
    rows = make(900, 2)
    index, dropped = r.IdentifierIndex(spark, prefix_bits=2, merge_every=2), []
    for k in range(7):  # batches arrive in any order of batch_no
        part = r.line_deliveries(spark.createDataFrame(rows[k::7], LINES))
        dropped += [x["row_id"] for x in index.ingest(part).collect()]
    assert sorted(dropped) == brute(rows)
    assert len(index.runs) <= 3
    assert index.ingest(r.line_deliveries(spark.createDataFrame([], LINES))).collect() == []


def test_empty_and_records(spark):
    assert r.redelivered(r.line_deliveries(spark.createDataFrame([], LINES))).collect() == []
    records = [(1, "s", 1, '{"id": "a"}', 0), (2, "s", 2, '{"id": "a"}', 0), (3, "s", 2, '{"$set": {}}', 0), (4, "t", 1, '{"id": "a"}', 0), (5, None, 1, '{"id": "a"}', 0)]
    df = spark.createDataFrame(records, "record_id long, session_id string, batch_no int, body string, h1 int")
    assert [tuple(x) for x in r.redelivered(r.record_deliveries(df)).collect()] == [("chat_records", 1)]


def test_a_folder_is_taken_up_again(spark, tmp_path):
    """Each batch comes with an index object of its own, as in jobs that know only the folder."""
    rows, dropped = make(900, 3), []
    for k in range(5):
        index = r.IdentifierIndex(spark, f"file://{tmp_path}/index", prefix_bits=k, merge_every=2)  # the bits of the first one count
        dropped += [x["row_id"] for x in index.ingest(r.line_deliveries(spark.createDataFrame(rows[k::5], LINES)), batch=str(k)).collect()]
        assert index.state["prefix_bits"] == 0
    assert sorted(dropped) == brute(rows)
    again = r.IdentifierIndex(spark, f"file://{tmp_path}/index")
    part = r.line_deliveries(spark.createDataFrame(rows[4::5], LINES))
    assert sorted(x["row_id"] for x in again.ingest(part, batch="4").collect()) == sorted(x["row_id"] for x in index._dropped(index.state["batches"]["4"]).collect())


def test_two_writers_and_a_failed_one(spark, tmp_path, monkeypatch):
    rows = make(400, 4)
    part = lambda k: r.line_deliveries(spark.createDataFrame(rows[k::2], LINES))
    a, b = (r.IdentifierIndex(spark, f"file://{tmp_path}/index") for _ in range(2))
    dropped = [x["row_id"] for x in a.ingest(part(0)).collect()]
    with pytest.raises(Exception, match="exist"):
        b.ingest(part(1))  # its step was published meanwhile
    c = r.IdentifierIndex(spark, f"file://{tmp_path}/index")
    monkeypatch.setattr(r, "publish_version", lambda *_: (_ for _ in ()).throw(RuntimeError("killed")))
    with pytest.raises(RuntimeError):
        c.ingest(part(1))
    monkeypatch.undo()
    dropped += [x["row_id"] for x in r.IdentifierIndex(spark, f"file://{tmp_path}/index").ingest(part(1)).collect()]
    assert sorted(dropped) == brute(rows)
    again = [x["row_id"] for x in r.IdentifierIndex(spark, f"file://{tmp_path}/index").ingest(part(1)).collect()]
    assert set(again) <= set(dropped)  # all of it is known: what stays is not dropped


def test_a_batch_shuffles_only_itself(spark):
    """The plan of a late batch exchanges the batch alone, and a lookup opens only row groups that can hold its keys."""
    index = r.IdentifierIndex(spark, prefix_bits=1, merge_every=9)
    many = spark.range(200_000).select(F.lit("s").alias("src"), F.xxhash64("id").alias("h1"), F.xxhash64(F.col("id") + 1).alias("h2"), F.lit(1).cast("long").alias("batch_no"), F.col("id").alias("row_id"))
    monkey = sortedruns.ROW_GROUP
    sortedruns.ROW_GROUP = 1 << 16
    try:
        assert index.ingest(many).count() == 0
    finally:
        sortedruns.ROW_GROUP = monkey
    reader = sortedruns.PrefixReader(index.runs[0], 0, ["row_id"])
    assert len(reader.groups) > 5
    key = reader.group(0)["h1"][:1], reader.group(0)["h2"][:1]
    fresh = sortedruns.PrefixReader(index.runs[0], 0, ["row_id"])
    assert sum(len(w) for w, _, _ in fresh.find(*key)) == 1
    assert fresh.bytes_read <= 2 * max(g[4] for g in fresh.groups)
