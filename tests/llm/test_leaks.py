"""Leaks against brute force over all runs of words, with disguised copies and near misses."""

import random

from logloom.llm import leaks as l

PASSAGE = "the brittle urn lifts the amber turbine softly while the woven dial trims a tangled magnet twice before the icy ferry"
ZH = "青色的矿井支撑着沉重的吊桶而冰冷的石磨唤醒了轻巧的灯塔沉重的齿轮支撑着潮湿的船锚"


def found(spark, docs, items):
    d = spark.createDataFrame(docs, "doc_id long, text string, item_id string")
    i = spark.createDataFrame(items, "item_id long, lang string, text string, doc_id string")
    return sorted(map(tuple, l.leaked_items(d, i).collect()))


def test_disguises_and_limits(spark):
    words = PASSAGE.split()
    docs = [
        (1, "x " + PASSAGE.upper() + " y", None),
        (2, "> " + ", **".join(words[:13]) + "** end", None),
        (3, " ".join(words[:12]) + " stop", None),
        (4, " ​".join(w[:2] + "­" + w[2:] for w in words[3:17]), None),
        (5, None, None),
        (6, "", None),
        (7, "引言：" + ZH[:10] + "，\n" + ZH[10:20] + "。", None),
        (8, ZH[:19], None),
        (9, ZH[:12] + " abc " + ZH[12:24], None),
        (1, "x " + PASSAGE.upper() + " y", None),
    ]
    items = [(10, "en", f"Read this. {PASSAGE} What now?", ""), (11, "en", PASSAGE, ""), (12, "zh", ZH, ""), (13, None, None, ""), (14, "en", "", ""), (15, "zh", PASSAGE, "")]
    assert found(spark, docs, items) == [(1, 10), (1, 11), (2, 10), (2, 11), (4, 10), (4, 11), (7, 12)]


def test_empty_tables(spark):
    assert found(spark, [], [(1, "en", PASSAGE, "")]) == []
    assert found(spark, [(1, PASSAGE, "")], []) == []


def test_automaton_against_brute_force():
    rng = random.Random(5)
    for _ in range(60):
        items = [[rng.choice("abc") for _ in range(rng.randrange(1, 14))] for _ in range(rng.randrange(1, 6))]
        text = [rng.choice("abcd") for _ in range(60)]
        least = rng.randrange(2, 5)
        a = l.SuffixAutomaton()
        for k, seq in enumerate(items):
            a.add(seq, k)
        got = a.finish(least).compact().longest(text, least)
        runs = lambda seq, n: {tuple(seq[i : i + n]) for i in range(len(seq) - n + 1)}
        want = {k: n for k, seq in enumerate(items) if (n := max((n for n in range(least, len(seq) + 1) if runs(seq, n) & runs(text, n)), default=0))}
        assert got == want


def test_blocks_of_items_give_the_same(spark, monkeypatch):
    docs = [(1, PASSAGE, ""), (2, ZH, "")]
    items = [(k, "en", PASSAGE, "") for k in range(5)] + [(9, "zh", ZH, "")]
    whole = found(spark, docs, items)
    monkeypatch.setattr(l, "BLOCK_CHARACTERS", 60)
    assert found(spark, docs, items) == whole


def test_removal_does_not_depend_on_blocks(spark, monkeypatch):
    """Items that overlap in a document, and clean text that would join into a leak if cuts followed one another."""
    words = PASSAGE.split()
    rest = [f"filler{k}" for k in range(60)]
    docs = [(1, " ".join([*rest, *words[:9], *"one two three four five six seven eight nine ten eleven twelve thirteen".split(), *words[9:]]), ""), (2, " ".join(rest + words), "")]
    items = [(1, "en", PASSAGE), (2, "en", "one two three four five six seven eight nine ten eleven twelve thirteen"), (3, "en", " ".join(words[4:] + ["more"])), (4, "en", " ".join(words[:15]))]
    d, i = spark.createDataFrame(docs, "doc_id long, text string, x string"), spark.createDataFrame(items, "item_id long, lang string, text string")
    clean = lambda: sorted(map(tuple, l.remove_leaks(d, i).collect()))
    spans = lambda: sorted(map(tuple, l.leak_spans(d, i).collect()))
    want = [(1, " ".join([*rest, *words[:9], "", *words[9:]]), 13, 60 + 13 + len(words)), (2, " ".join(rest) + " ", len(words), 60 + len(words))]
    one = spans()
    assert clean() == want and [r[:3] for r in one] == [(1, 2, 13), (2, 1, len(words)), (2, 3, len(words) - 4), (2, 4, 15)]
    monkeypatch.setattr(l, "BLOCK_CHARACTERS", 60)
    assert clean() == want and spans() == one


def test_removal(spark):
    head = "An opening that nobody leaked, with quite a few words of its own so that it weighs more than all of the rest does here. "
    docs = [(1, head + PASSAGE.title() + "! An end.", ""), (2, PASSAGE, ""), (3, None, ""), (4, "clean", ""), (5, head * 2 + ZH[:25] + "。", "")]
    d = spark.createDataFrame(docs, "doc_id long, text string, tokens string")
    i = spark.createDataFrame([(10, "en", PASSAGE), (12, "zh", ZH)], "item_id long, lang string, text string")
    got = {r["doc_id"]: r for r in l.remove_leaks(d, i).collect()}
    assert got[1]["text"] == head + "! An end." and got[1]["removed"] == len(PASSAGE.split())
    assert got[2]["text"] == "" and got[3]["text"] is None and got[4]["text"] == "clean" and got[5]["text"] == head * 2 + "。"
    clean = spark.createDataFrame([(r["doc_id"], r["text"]) for r in got.values()], "doc_id long, text string")
    assert l.leaked_items(clean, i).collect() == []
    assert l.remove_leaks(d, i.limit(0)).where("removed > 0").collect() == []


def test_placed_tokens_are_the_tokens():
    for text in (PASSAGE, ZH, "> The  ​Old **urn**, x1 Straße ﬁx", "", "…", "㈱会社™ ½ e\u0301\u00ad\u0323x İI 각한 \u1100\u1161\u11a8 ﷺ ๆกำ"):
        placed = l.placed_tokens(text)
        assert [t for t, _, _ in placed] == l.normalised_tokens(text)
        assert all(a < b for _, a, b in placed)
