"""Which texts count as readable JSON objects."""

from logloom.functions.variants import json_objects


def test_objects_behind_many_blanks(spark):
    texts = ['{"a": 1}', " \t\r\n" * 50 + '{"a": 2}', " " * 64 + '{"a": 3}', " " * 100 + "[1]", " " * 100, "", None, "{half"]
    got = json_objects(spark.createDataFrame(list(enumerate(texts)), "n int, text string"), "text", ["n"]).select("n").collect()
    assert sorted(r["n"] for r in got) == [0, 1, 2]
