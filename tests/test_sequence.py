"""Sequence operators against plain walks, their identities, and the report's arithmetic."""

import random

import pytest
from pyspark.sql import functions as F

from logloom.functions.kleene import all3, any3, group_all3, group_any3
from logloom.operators import measure, sequence, validity
from logloom.operators.sequence import order_within
from logloom.plans import spec
from logloom.schema import EVENTS, ROWS

KINDS = {"F": (True, False), "T": (False, True), "B": (True, True), "U": (None, None), "N": (False, False), "R": (False, None), "V": (True, None)}


def naive(marks, within):
    """The window of an opener: later events until ``within`` steps have been seen; what follows the last step is outside."""
    out = []
    for i, m in enumerate(marks):
        first = KINDS[m][0]
        if first is False:
            continue
        steps, inside = 0, []
        for n in marks[i + 1 :]:
            if steps == within:
                break
            inside.append(KINDS[n][1])
            steps += n not in "RV"
        seen = True if True in inside else None if None in inside else False
        out.append((i, None if first is None else seen))
    return out


@pytest.mark.parametrize("within", [1, 2, 5, 1000])
def test_order(spark, within):
    rng = random.Random(within)
    sessions = {f"s{k}": [rng.choice("FTBUNRV") for _ in range(rng.randrange(0, 40))] for k in range(60)}
    rows = [("r", s, p, "tool_result" if m in "RV" else "tool_use", m) for s, ms in sessions.items() for p, m in enumerate(ms)]
    df = spark.createDataFrame(rows, "runtime string, session_id string, pos long, kind string, m string")
    pick = lambda k: F.expr("case m " + " ".join(f"when '{m}' then {str(v[k]).lower().replace('none', 'null')}" for m, v in KINDS.items()) + " end")
    got = order_within(df, pick(0), pick(1), within).where("opened").orderBy("pos").collect()
    by = {}
    for r in got:
        by.setdefault(r["session_id"], []).append((r["pos"], r["followed"]))
    assert by == {s: naive(m, within) for s, m in sessions.items() if naive(m, within)}


def test_kleene(spark):
    values = [True, False, None]
    for a in values:
        for b in values:
            lit = [F.lit(x).cast("boolean") for x in (a, b)]
            row = spark.range(1).select(any3(lit).alias("o"), all3(lit).alias("a")).first()
            g = spark.createDataFrame([(a,), (b,)], "x boolean").agg(group_any3(F.col("x")).alias("o"), group_all3(F.col("x")).alias("a")).first()
            assert (row["o"], row["a"]) == (g["o"], g["a"]) == (True if True in (a, b) else None if None in (a, b) else False, False if False in (a, b) else None if None in (a, b) else True)
    assert spark.range(1).select(any3([]).alias("o"), all3([]).alias("a")).first() == (False, True)


def test_absent_and_change(spark):
    rows = [("r", "s", 1, n, k) for n, k in enumerate(["a", "b", "a"])] + [("r", "t", 1, 0, "u"), ("r", "t", 2, 1, "b")]
    df = spark.createDataFrame(rows, "runtime string, session_id string, turn int, pos long, k string")
    of = F.when(F.col("k") == "u", F.lit(None).cast("boolean")).otherwise(F.col("k") == "z")
    assert {(r["session_id"], r["turn"], r["found"], r["absent"]) for r in sequence.absent(df, of).collect()} == {("s", 1, False, True), ("t", 2, None, False)}
    assert {(r["session_id"], r["turn"], r["absent"]) for r in sequence.absent(df, of, "turn").collect()} == {("s", 1, True), ("t", 1, False), ("t", 2, True)}
    assert [(r["session_id"], r["pos"]) for r in sequence.change(df, F.col("k"), F.col("k") != "b").collect()] == []
    assert sequence.change(df, F.col("k")).count() == 3
    with pytest.raises(ValueError):
        sequence.absent(df, of, "x")


def test_measure_and_reports(spark):
    rows = []
    for s in range(25):
        for p in range(4):
            rows.append({"runtime": "r", "session_id": f"s{s}", "path": "", "pos": p, "kind": "tool_use", "turn": p, "id": f"i{p}", "name": "A" if p % 2 == 0 else "B", "input": "{}", "text": None, "final": None, "model": None})
    events = spark.createDataFrame(rows, EVENTS)
    events = measure.parsed_events(events)
    sessions = spark.createDataFrame([("r", f"s{s}", "p", "repo" if s % 2 else "", "", "2025", "2025") for s in range(25)], "runtime string, session_id string, path string, repo string, cwd string, started string, ended string")
    detectors = [
        spec.compile_detector({"id": "x/a", "when": {"tool": "A"}}),
        spec.compile_detector({"id": "x/none", "when": {"tool": "Z"}}),
        spec.compile_detector({"id": "x/order", "event": "session", "when": {"order": {"first": {"tool": "A"}, "then": {"tool": "B"}, "within": 1}}}),
        spec.compile_detector({"id": "x/gated", "when": {"tool": "A"}, "gate": {"stance": "m"}}),
    ]
    out = measure.measure(sessions, events, detectors).cache()
    first = out.where("session_id = 's0'").first()
    assert first["rules"] == {"x/a": 2, "x/order": 2} and tuple(first["compliance"]["x/order"]) == (2, 2, 0)
    by = {r["detector"]: r for r in measure.report_by_rule(out, ["x/a", "x/none", "x/order"]).collect()}
    assert (by["x/a"]["hits"], by["x/a"]["sessions"], by["x/a"]["of"], by["x/a"]["note"]) == (50, 25, 25, "frequent")
    assert by["x/none"]["note"] == "unobserved" and by["x/order"]["rate"] == 1.0
    groups = {r["key"]: (r["sessions"], r["hits"], r["top"]) for r in measure.report_by_group(out).collect()}
    assert groups == {"repo": (12, 48, ["x/a", "x/order"]), "(no repo)": (13, 52, ["x/a", "x/order"])}
    folded = {r["detector"]: r["hits"] for r in measure.report_by_rule(out, [], {"x/order": "x/a"}).collect()}
    assert folded == {"x/a": 100}
    assert measure.report_by_group(out, "stance").first()["key"] == "(no stances)"
    assert measure.report_by_rule(out.limit(0), ["x/a"]).first()["share"] == 0.0


def test_status_and_malformed(spark):
    rows = spark.createDataFrame([(9, "a", "", "r", "", "", None, {}, None, None), (2, "b", "", "r", "", "", None, None, None, None), (None, "c", "", "r", "", "", None, {"d": 1}, None, [("d", "raised")])], ROWS)
    assert {r["session_id"]: r["status"] for r in measure.row_status(rows).collect()} == {"a": "unknown schema", "b": "no rules", "c": "ok"}
    r = measure.report_by_rule(rows, ["d"]).first()
    assert (r["hits"], r["of"], r["share"]) == (0, 0, 0.0)
    points = spark.createDataFrame([("r", "s", "d", 1, "x", True), ("r", "s", "d", 1, "x", False), ("r", "t", "d", 1, None, None), ("r", "t", "d", 1, None, True)], "runtime string, session_id string, detector string, turn int, tool_use_id string, followed boolean")
    assert {x["session_id"]: (x["malformed"], x["undecided"]) for x in measure.tally(points).collect()} == {"s": (True, 0), "t": (False, 1)}


def test_validity_by_hand(spark):
    labels = spark.createDataFrame([("s", "1:a", "d", "fire"), ("s", "2:b", "d", "fire"), ("s", "3:-", "d", "near"), ("s", "1:a", "e", "near")], "session string, key string, detector string, polarity string")
    hits = spark.createDataFrame([("s", "1:a", "d"), ("s", "1:a", "d"), ("s", "3:-", "d"), ("t", "9:-", "d"), ("s", "1:a", "other")], "session string, key string, detector string")
    counts = validity.validity_counts(hits, labels)
    by = {r["detector"]: r.asDict() for r in validity.scores(counts).collect()}
    assert {k: by["d"][k] for k in ("positives", "negatives", "tp", "fp", "fn", "precision", "recall", "f1")} == {"positives": 2, "negatives": 1, "tp": 1, "fp": 2, "fn": 1, "precision": 0.3333, "recall": 0.5, "f1": 0.4}
    assert (by["e"]["precision"], by["e"]["recall"], by["e"]["f1"]) == (1.0, 1.0, 1.0)
    assert [r["detector"] for r in validity.below_floor(validity.scores(counts)).collect()] == ["d"]
    assert {r["detector"] for r in validity.total(counts).collect()} == {"d", "e", "(all)"}
    shown = spark.createDataFrame([(0.0,), (0.001,), (0.999,), (1.0,), (0.5,), (None,)], "r double").select(measure.rate_display(F.col("r")).alias("d"))
    assert [r["d"] for r in shown.collect()] == [0, 1, 99, 100, 50, None]
