"""Sentence units on texts whose cuts are known, in all scripts; '|' marks the cuts."""

import pytest

from logloom.llm import sentences as s

TRAIN = [
    "The queue is empty.\n\nWe keep logs, rows, etc. for each rule. The scan passed.\n\nSee Fig. 3 and Sec. 4 for it.",
    "At 8 a.m. the token counts.\n\nIt works, i.e. the cache is warm.\n\ncargo passed after the fix.\n\nThis is rule 12.",
    "Der Puffer ist leer.\n\nSiehe Nr. 3 in der Liste. Die Regel gilt.\n\nEs gilt ca. 3 Tage, d. h. der Bericht bleibt.",
    "La regla es la 3.\n\nVéase la pág. 3, etc. antes de leer.\n\nEl lector está vacío.",
    "Это правило 3.\n\nНужно всё, т. е. проверить список.\n\nЭта строка новая.",
] * 6

CASES = [
    "It was 5 p.m. |The hook ran.",
    "At 8 a.m. the token ran. |It took approx. 55 rows.",
    "This is plan B. |The scan passed.",
    "See Fig. 3 and Sec. 4.2 of tools/scan.go:27. |The ratio fell to 67.34 vs. the rest.",
    "Wait... the reader merges it. |It failed again... |Then it passed… |The end… well, no.",
    'The user wrote "Stop. Do not parse it." and left. |"Did you look?" asked the reviewer. |(The log says "Pin it.") |The scan is late.',
    "The hook printed 'Blocked. Track the rule first.' before it ran. |Really?! |The queue is empty.",
    "Run `sed -n '1,40p' a.py. B` now. |The suffix is .py, not .rs.",
    "Ask https://ci.example.invalid/run?id=68.16 if it fails. |The rule is empty.",
    "Is it done? |cargo passed after the fix.",
    "Ab dem 21. Dezember ist die Regel leer. |Es gilt Regel Nr. 22. |Der Nutzer schrieb „Halt. Nicht lesen.“ und ging.",
    "El usuario escribió «Alto. No leer.» y salió. |¿Quién? |¡Nadie! |Es la regla 40.",
    "Pourquoi la branche est vide ? |On a écrit « Stop. Ne rien lire. » dans Makefile.",
    "Он написал «Стоп. Не надо.» и вышел. |Нужно всё, т. е. удалить список. |Это правило 9.",
    "用户写道：“停。不要关闭！”并关闭了会话。|参见《规则。续》第44页。|真的吗？！|队列正确……但是分支很慢。|缓存为空.|模型很慢.",
    "利用者は「待って。しないで！」と書いて閉じた。|モデル（遅いです。）を分割しました。|ラベルは空です｡|先に.gitignoreを開きます。",
    '사용자는 "멈춰. 하지 마."라고 쓰고 나갔습니다. |왜요? |창은 느립니다.',
    'उसने लिखा "रुको। अभी नहीं।" और पंक्ति बंद की। |कौन सा? |सत्र या सूची?',
    "كتب المستخدم «توقف. لا تفعل.» ثم أغلق الفرع. |هل الفرع قديم؟ |لا نعرف!",
    "คิวช้ามาก |อย่าลบ! |คำสั่งต่าง ๆ เช่นกฎนั้นว่าง |ไฟล์ web/index.html ทำให้ช้า",
    "# Notes on v2.1\n|Plain text goes on\nover the line. |Next.\n\n|- One. |Two.\n|- Three\n|1. Four. |Five\n|2. Six",
    "Text.\n\n|```sh\n$ a. B\n\nc. D\n```\n|After it. |End.",
    "|> The harbor forwards the\n> ferry before dawn. |The inlet\n> nudges it.",
    "A line of\n22. Mai text. |More of it.",
]


@pytest.fixture(scope="module")
def model():
    return s.fit(TRAIN)


@pytest.mark.parametrize("marked", CASES)
def test_known_cuts(model, marked):
    text = marked.replace("|", "")
    want = [p.strip() for p in marked.split("|") if p.strip()]
    got = s.units(text, model)
    assert [text[a:b] for a, b in got] == want
    assert all(a < b for a, b in got) and all(x[1] <= y[0] for x, y in zip(got, got[1:]))


@pytest.mark.parametrize("text", [None, "", "   ", "\n \n\t", "```", ".", "...", '"', "(((", "``", "- ", "1. ", "。", "a" * 200_000, "a. " * 50_000, '"' * 5000, "(" * 20_000])
def test_odd_texts(model, text):
    got = s.units(text, model)
    assert [x for a, b in got for x in text[a:b] if not x.isspace()] == [x for x in (text or "") if not x.isspace()]


def test_a_quoting_mark_alone_is_a_blank_line(model):
    assert s.units("> One.\n>\n> Two.", model) == [(0, 6), (9, 15)]


def test_units_cover_everything_and_fit_without_data():
    empty = s.fit([])
    text = "One is here. Two is there, e.g. this."
    assert [text[a:b] for a, b in s.units(text, empty)] == ["One is here.", "Two is there, e.g. this."]


def test_corpus(spark):
    df = spark.createDataFrame([(1, "The end. The start.", "x"), (1, "The end. The start.", "x"), (2, None, "x"), (3, " ", "x"), (None, "No id.", "x")], "doc_id long, text string, start_pos string")
    assert sorted(map(tuple, s.sentence_units(df).collect())) == [(1, 0, 8), (1, 0, 8), (1, 9, 19), (1, 9, 19)]
    assert s.sentence_units(df.limit(0)).collect() == []
