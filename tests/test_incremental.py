"""What runs take, against a plain replay; the persisted feed, with a run that fails before it publishes."""

import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from logloom.functions.instants import instant_micros
from logloom.operators import incremental as i

SNAPS = "snap_id long, session_id string, last_updated string, last_message_ts string, arrived_at timestamp, run_id string"
RUNS = "run_id long, cutoff_at timestamp, status string"
T0 = datetime(2025, 1, 1)


def test_instants(spark):
    cases = {
        "2025-01-01T00:00:00Z": 1735689600000000,
        "2025-01-01T02:00:00.5+02:00": 1735689600500000,
        "2024-12-31 19:00:00.123456-0500": 1735689600123456,
        "2025-01-01T01:00+01": 1735689600000000,
        "2025-01-01T00:00:00": 1735689600000000,
        "1735689600000": 1735689600000000,
        "1735689600": 1735689600000000,
        "": None,
        "unknown": None,
        "0000-00-00": None,
        "2025-0": None,
        "2025": None,
        "2025-13-01T00:00:00Z": None,
        "2025-01-01": None,
    }
    df = spark.createDataFrame([(k,) for k in cases] + [(None,)], "t string").select("t", instant_micros(F.col("t")).alias("us"))
    assert {r["t"]: r["us"] for r in df.collect()} == {**cases, None: None}


def make(n, seed):
    rng = random.Random(seed)
    rows = []
    for k in range(n):
        stamp = f"2025-01-01T00:{rng.randrange(60):02d}:00Z"
        rows.append((k, "hot" if rng.random() < 0.4 else rng.choice([None, *[f"s{x}" for x in range(n // 6)]]), rng.choice([stamp, None, "", "unknown"]), rng.choice([stamp, None]), rng.choice([None, *[T0 + timedelta(minutes=m) for m in range(0, 60, 7)]]), "x"))
    return rows


def brute(rows, runs):
    minute = lambda t: int(t[14:16]) if t and t.startswith("2025-") else None
    before, out = {}, []
    for run, cut in runs:
        seen = {}
        for snap, session, a, b, arrived, _ in rows:
            stamp = minute(a) if minute(a) is not None else minute(b)
            if session and stamp is not None and arrived is not None and arrived <= cut:
                seen[session] = max(seen.get(session, (-1, 0)), (stamp, -snap))
        out += [(run, s, -x) for s, (t, x) in seen.items() if s not in before or t > before[s][0]]
        before = seen
    return sorted(out)


@pytest.mark.parametrize("depth", [1, 3])
def test_against_replay(spark, depth):
    rows = make(500, depth)
    log = [(k, T0 + timedelta(minutes=5 * k), "ok" if k % 3 else "failed") for k in range(1, 12)]
    log += [log[1], (50, None, "ok"), (51, T0, None)]
    got = i.taken_by_runs(spark.createDataFrame(rows, SNAPS), spark.createDataFrame(log, RUNS), depth)
    assert sorted(map(tuple, got.collect())) == brute(rows, [(a, b) for a, b, s in sorted(set(log[:11])) if s == "ok"])


def test_empty(spark):
    snaps, runs = spark.createDataFrame([], SNAPS), spark.createDataFrame([], RUNS)
    assert i.taken_by_runs(snaps, runs).collect() == []
    assert i.taken_by_runs(snaps, spark.createDataFrame([(1, T0, "ok")], RUNS)).collect() == []


def test_tree_finds_exactly_the_changed_leaves():
    rng = np.random.default_rng(1)
    for depth in (1, 2, 3):
        leaves = rng.integers(0, 1 << 63, i.FANOUT**depth, dtype=np.uint64)
        for k in (0, 1, 5):
            other = leaves.copy()
            at = rng.choice(len(leaves), k, replace=False)
            other[at] += np.uint64(1)
            assert sorted(i.MerkleTree(other).changed(i.MerkleTree(leaves))) == sorted(at)


def _rows(spark, *x):
    return spark.createDataFrame(list(x), "key string, stamp long, snap long")


def _keys(df):
    return sorted((r["key"], r["stamp"]) for r in df.collect())


def test_feed_over_everything_visible(spark, tmp_path):
    feed = i.ChangeFeed(spark, f"file://{tmp_path}/feed", depth=2, merge_every=2)
    first = [("a", 1, 1), ("b", 1, 2), (None, 9, 9), ("c", None, 3)]
    assert _keys(feed.run(_rows(spark, *first), whole=True)) == [("a", 1), ("b", 1)]
    second = [*first, ("b", 2, 4), ("d", 1, 5), ("a", 0, 6)]
    assert _keys(feed.run(_rows(spark, *second), whole=True)) == [("b", 2), ("d", 1)]
    assert _keys(feed.run(_rows(spark, *second), whole=True)) == []
    again = i.ChangeFeed(spark, f"file://{tmp_path}/feed")
    assert again.state["depth"] == 2 and again.verify()
    assert _keys(again.run(_rows(spark, *second, ("a", 5, 7)), whole=True)) == [("a", 5)]
    assert _keys(again.run(_rows(spark), whole=True)) == [] and again.verify()
    assert _keys(again.outputs()) == [("a", 1), ("a", 5), ("b", 1), ("b", 2), ("d", 1)]


@pytest.mark.parametrize("step", ["write_run", "_save", "publish_version"])
def test_a_run_that_fails_at_any_step_is_neither_skipped_nor_repeated(spark, tmp_path, monkeypatch, step):
    feed = lambda: i.ChangeFeed(spark, f"file://{tmp_path}/feed", depth=1)
    assert _keys(feed().run(_rows(spark, ("a", 1, 1)), cutoff=10)) == [("a", 1)]

    def killed(*_):
        raise RuntimeError("killed")

    monkeypatch.setattr(i.ChangeFeed if step == "_save" else i, step, killed)
    with pytest.raises(RuntimeError):
        feed().run(_rows(spark, ("a", 2, 2), ("b", 1, 3)), cutoff=20)
    monkeypatch.undo()
    assert feed().cutoff == 10
    assert _keys(feed().run(_rows(spark, ("a", 2, 2), ("b", 1, 3), ("a", 1, 1)), cutoff=20)) == [("a", 2), ("b", 1)]
    assert _keys(feed().run(_rows(spark, ("z", 9, 9)), cutoff=20)) == [("a", 2), ("b", 1)]  # published: what it put out then
    assert feed().cutoff == 20 and feed().verify()


def test_only_the_ranges_that_changed_are_opened(spark, tmp_path):
    from logloom.operators import sortedruns

    feed = i.ChangeFeed(spark, f"file://{tmp_path}/feed", depth=2)
    many = spark.range(100_000).select(F.col("id").cast("string").alias("key"), F.lit(1).cast("long").alias("stamp"), F.col("id").alias("snap"))
    held, sortedruns.ROW_GROUP = sortedruns.ROW_GROUP, 1 << 14
    try:
        assert feed.run(many).count() == 100_000
    finally:
        sortedruns.ROW_GROUP = held
    assert _keys(feed.run(_rows(spark, ("77", 2, 1)))) == [("77", 2)]
    run = f"{feed.folder}/{feed.state['runs'][0]['name']}"
    h1, h2, prefix = spark.createDataFrame([("77",)], "key string").select(F.xxhash64("key"), F.xxhash64(F.lit(0x5EED), "key"), i.prefix_of(F.xxhash64("key"), 4)).first()
    reader = i.PrefixReader(run, prefix, ["stamp"])
    assert len(reader.groups) > 3 and [len(w) for w, _, _ in reader.find(np.array([h1]), np.array([h2]))] == [1]
    assert reader.bytes_read <= 2 * max(g[4] for g in reader.groups)
    moved, _ = feed._new_digests(feed.state["outputs"][-1]["name"])
    assert len(moved) == 1
