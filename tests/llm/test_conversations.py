"""Conversations against a plain walk over the same rows, and the edge cases of the docstrings."""

import itertools
import json

import pytest

from logloom.llm import conversations as c

COLUMNS = "line_id long, session_id string, line_type string, ts string, is_meta boolean, is_compact_summary boolean, is_sidechain boolean, message string, extra string"


def line(n, session, kind, second, mid, content, **flags):
    message = content if isinstance(content, str) and content.startswith("!") else json.dumps({"id": mid, "content": content})
    return (n, session, kind, f"2025-01-01T00:00:{second:02d}Z", flags.get("meta"), flags.get("compact"), flags.get("side"), message, "x")


def text(t):
    return [{"type": "text", "text": t}]


def use(i):
    return [{"type": "tool_use", "id": i, "name": "Bash", "input": {}}]


def result(i):
    return [{"type": "tool_result", "tool_use_id": i}]


GOOD = [("user", 0, "p", "hi"), ("assistant", 1, "a", use("t")), ("user", 1, "r", result("t")), ("assistant", 2, "b", text("done"))]


def rows(session, items, start=0):
    return [line(start + k, session, *i) for k, i in enumerate(items)]


@pytest.fixture(scope="module")
def run(spark):
    def go(lines):
        return sorted(map(tuple, c.rebuild_conversations(spark.createDataFrame(lines, COLUMNS)).collect()))

    return go


def test_order_speakers_and_ties(run):
    shuffled = list(reversed(rows("s", GOOD)))  # the call and its result bear the same instant
    assert run(shuffled) == [("s", "p", 0, "user", "p"), ("s", "p", 1, "assistant", "a"), ("s", "p", 2, "tool", "r"), ("s", "p", 3, "assistant", "b")]


@pytest.mark.parametrize(
    "items",
    [
        GOOD[1:],  # does not begin with a prompt
        [GOOD[0], GOOD[3][:3] + (text("  \n"),)],  # the reply is blank
        [GOOD[0], ("user", 1, "q", "more"), GOOD[3]],  # a prompt without reply
        [*GOOD, ("user", 5, "q", "more")],  # the last prompt without reply
        [("user", 0, "p", "  "), GOOD[3]],  # no prompt with text
        [GOOD[0], GOOD[1], GOOD[3]],  # a call without result
        [GOOD[0], GOOD[2], GOOD[3]],  # a result without call
        [GOOD[0], ("user", 1, "r", result("t")), ("assistant", 2, "a", use("t")), ("assistant", 3, "b", text("x"))],  # the result is earlier
        [GOOD[0], ("assistant", 1, "a", use("t") + result("t")), GOOD[3]],  # within one message
        [GOOD[0], ("user", 1, "r", [{"type": "tool_result"}]), GOOD[3]],  # names nothing
    ],
)
def test_broken_sessions_do_not_come_out(run, items):
    assert run(rows("bad", items) + rows("good", GOOD, 50)) == run(rows("good", GOOD))


def test_blank_prompt_is_fine_if_another_speaks(run):
    items = [*GOOD, ("user", 5, "q", ""), ("assistant", 6, "c", "plain text reply")]
    assert run(rows("s", items))[-2:] == [("s", "q", 0, "user", "q"), ("s", "q", 1, "assistant", "c")]


def test_left_out_lines_and_copies(run):
    noise = [
        line(90, None, "user", 0, "x", "no session"),
        line(91, "s", "system", 0, "x", "system"),
        line(92, "s", "user", 0, "m", "meta", meta=True),
        line(93, "s", "user", 0, "m2", "summary", compact=True),
        line(94, "s", "user", 0, "m3", "side", side=True),
        line(95, "s", "user", 0, "m4", "!{half"),
        line(96, "s", "user", 9, "p", "hi"),  # a later delivery of the first prompt
        (97, "s", "user", None, None, None, None, None, None),
    ]
    assert run(rows("s", GOOD) + noise) == run(rows("s", GOOD))


def test_empty_and_long(run):
    assert run([]) == []
    items = [("user", 0, "p", "x" * 300_000), ("assistant", 1, "a", text("y" * 300_000))]
    assert len(run(rows("s", items))) == 2


def test_a_session_over_many_partitions(spark, run):
    items = []
    for k in range(600):
        items.append((k, "hot", "user" if k % 3 == 0 else "assistant", f"2025-01-01T{k // 3600:02d}:{k // 60 % 60:02d}:{k % 60:02d}Z", None, None, None, json.dumps({"id": f"m{k:04d}", "content": f"t{k}"}), ""))
    got = run(items)
    assert len(got) == 600
    assert {(p, s) for _, p, s, _, m in got} == {(f"m{k - k % 3:04d}", k % 3) for k in range(600)}


def test_pieces_compose_like_one_walk():
    for symbols in itertools.product(range(4), repeat=5):
        state, f = c.START, 0
        for s in symbols:
            state, f = c._STEP[state][s], c.PRODUCT[f][c.OF_SYMBOL[s]]
        assert c.FUNCTIONS[f][c.START] == state
        for cut in range(6):
            left = right = 0
            for s in symbols[:cut]:
                left = c.PRODUCT[left][c.OF_SYMBOL[s]]
            for s in symbols[cut:]:
                right = c.PRODUCT[right][c.OF_SYMBOL[s]]
            assert c.PRODUCT[left][right] == f


def test_content_comes_along(spark):
    lines = rows("s", GOOD)
    lines[3] = line(3, "s", "assistant", 2, "b", [{"type": "text", "text": "par", "apiBlockIndex": 0}])
    lines.append(line(9, "s", "assistant", 2, "b", [{"type": "text", "text": "partial", "apiBlockIndex": 0}]))
    lines.append(line(10, "s", "assistant", 3, "b", [{"type": "text", "text": "second", "apiBlockIndex": 1}]))
    got = {r["message_id"]: [json.loads(x) for x in r["content"]] for r in c.rebuild_conversations(spark.createDataFrame(lines, COLUMNS), content=True).collect()}
    assert got["p"] == ["hi"] and [b["text"] for b in got["b"]] == ["partial", "second"]
    assert got["a"][0]["id"] == "t" and got["r"][0]["tool_use_id"] == "t"


def test_messages_without_an_id_carry_their_content(spark):
    say = lambda line, kind, ts, content: (line, 1, None, "s", kind, None, ts, "", "", False, "", False, False, None, None, json.dumps({"content": content}))
    lines = [say(1, "user", "2025-01-01T00:00:00Z", "hello"), say(2, "assistant", "2025-01-01T00:00:01Z", [{"type": "text", "text": "one"}, {"type": "text", "text": "two"}]), say(3, "user", "2025-01-01T00:00:02Z", "bye"), say(4, "assistant", "2025-01-01T00:00:03Z", "so long")]
    names = [f.name for f in spark.createDataFrame([], COLUMNS).schema.fields]
    table = spark.createDataFrame([], COLUMNS)
    assert {"session_id", "line_type", "ts", "message"} <= set(names)
    rows = [{"line_id": x[0], "session_id": x[3], "line_type": x[4], "ts": x[6], "message": x[15]} for x in lines]
    table = spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], table.schema)
    got = sorted((((r["step_no"], r["speaker"], r["message_id"], r["prompt_id"]), [json.loads(x) for x in r["content"]]) for r in c.rebuild_conversations(table, content=True).collect()), key=str)
    assert [k for k, _ in got] == [(0, "user", "", ""), (0, "user", "", ""), (1, "assistant", "", ""), (1, "assistant", "", "")]
    assert sorted(v for k, v in got if k[0] == 0) == [["bye"], ["hello"]]
    assert sorted(len(v) for k, v in got if k[0] == 1) == [1, 2]
