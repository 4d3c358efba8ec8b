from pyspark.sql import functions as F

from loam.operators import replies

MEMBERS = {"title": "string", "tags": "array<string>", "count": "long", "done": "boolean"}


def one(spark, text, strict=False):
    r = spark.createDataFrame([(text,)], "j string").select(replies.decoded(F.col("j"), MEMBERS, strict).alias("d")).first()["d"]
    return r.asDict()


def test_replies_are_told_apart(spark):
    good = one(spark, ' {"title": "T", "tags": ["a", "b"], "count": 3, "done": true}\n', strict=True)
    assert good == {"title": "T", "tags": ["a", "b"], "count": 3, "done": True, "unknown": [], "missing": [], "mistyped": [], "error": None}
    some = one(spark, '{"Title": "T", "tags": null, "extra": 1, "more": {"x": 1}}')
    assert some["title"] == "T" and some["missing"] == ["tags", "count", "done"] and some["unknown"] == ["extra", "more"] and some["error"] is None
    assert one(spark, '{"Title": "T", "extra": 1}', strict=True)["error"] == "unknown member extra"
    both = one(spark, '{"TITLE": "first", "title": "exact"}')
    assert both["title"] == "exact" and both["unknown"] == []
    for text, name, said in (('{"tags": "a"}', "tags", "a list of texts"), ('{"tags": ["a", 1]}', "tags", "a list of texts"), ('{"count": 1.5}', "count", "a whole number"), ('{"done": 0}', "done", "true or false"), ('{"title": []}', "title", "text")):
        for strict in (False, True):
            got = one(spark, text, strict)
            assert got["mistyped"] == [name] and got["error"] == f"{name} must be {said}" and got[name] is None
    for text in ("", None, "[]", "3", '{"a": ', "no"):
        got = one(spark, text)
        assert got["error"] == "a JSON object is needed" and got["unknown"] == got["missing"] == []
    assert one(spark, '{"tags": ["x"]} and more')["tags"] == ["x"]
    assert one(spark, "{}")["error"] is None and one(spark, '{"tags": []}')["tags"] == []


def test_tags_of_replies(spark):
    rows = ['{"tags": ["A", "a", " go "], "extra": 1}', '{"tags": ["12"]}', '{"tags": 3}', "{}", None]
    df = spark.createDataFrame([(r,) for r in rows], "j string")
    got = [(r[0], r[1]) for r in df.select(replies.tags(F.col("j"), shortest=1), replies.tags(F.col("j"), strict=True, shortest=1)).collect()]
    assert got == [(["a", "go"], None), ([], []), (None, None), ([], []), (None, None)]
