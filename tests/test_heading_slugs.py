"""Slugs of all headings of documents against brute force."""

from logloom.plans.reference import QUERIES


def brute(heading):
    kept = "".join(c for c in heading.lower() if c.isalnum() or c in "_- ").strip()
    return kept.replace(" ", "-") or "section"


def test_whole_headings_of_all_scripts(spark, tmp_path):
    titles = ["A heading of more than sixty characters, which goes on - and on - until the very end!", "Prüfung der Läufe: größer", "Проверка 2", "测试 之后", "!!!"]
    texts = ["\n".join(f"# {t}\n\ntext {n}\n" for n, t in enumerate(titles)), "x " * 50 + f"\n\n## {titles[1]}\n", None, "no heading"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted((r["path"], r["heading"], r["slug"]) for r in QUERIES["heading_slugs"](spark, str(tmp_path)).collect())
    assert got == sorted([("0", t, brute(t)) for t in titles] + [("1", titles[1], brute(titles[1]))])
