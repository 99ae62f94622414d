"""Nested results by their schema: the cases that the rules were made for."""

import json

import pytest
from pyspark.sql import functions as F

from gleaner.operators import declared as D
from gleaner.plans.schema import spark_type

TEXT = {"type": "string"}
FIELDS = ["domHtml", "author", "publishTime", "content", "likes", "comments", "shares"]
POSTS = {"type": "object", "required": ["posts"], "properties": {"posts": {"type": "array", "items": {"type": "object", "required": FIELDS, "properties": {f: TEXT for f in FIELDS}}}}}


def post(**x):
    return dict.fromkeys(FIELDS, "v") | x


def frame(spark, results, schema, wrap=None):
    kind = spark_type(schema).simpleString() if wrap is None else wrap
    rows = spark.createDataFrame([(i, None if r is None else json.dumps(r)) for i, r in enumerate(results)], "id int, t string")
    return rows.select("id", F.from_json("t", kind).alias("result"))


def told(rows, what):
    return [r["x"] for r in rows.select("id", what.alias("x")).orderBy("id").collect()]


def test_blank_fields(spark):
    results = [
        {"posts": [post(comments="", shares="", likes=n) for n in ("4", "1", "294")]}, {"posts": [post(comments="5", shares=""), post(comments="", shares=""), post(comments=" \n", shares="")]},
        {"posts": [post(), post(shares=""), post(shares="2")]}, {"posts": [post(comments="")]}, {"posts": [post(likes="  "), None]}, None, {"posts": []}, {},
    ]
    rows = frame(spark, results, POSTS)
    declared = D.Declared.column(rows, "result", POSTS)
    got = told(rows, D.blank_fields(declared))
    flat = lambda xs: [(x["path"], x["n_empty"], x["n_records"], round(x["ratio"], 3), x["samples"]) for x in xs or []]
    assert flat(got[0]) == [("posts.comments", 3, 3, 1.0, []), ("posts.shares", 3, 3, 1.0, [])]
    assert flat(got[1]) == [("posts.comments", 2, 3, 0.667, ["5"]), ("posts.shares", 3, 3, 1.0, [])]
    assert flat(got[2]) == flat(got[3]) == flat(got[5]) == flat(got[6]) == flat(got[7]) == []
    assert [x[:3] for x in flat(got[4])] == [(f"posts.{f}", 2 if f == "likes" else 1, 2) for f in FIELDS]
    assert [x["path"] for x in told(rows, D.blank_fields(declared, threshold=0.3))[2]] == ["posts.shares"]
    assert [[x["path"] for x in xs or []] for xs in told(rows, D.blank_fields(declared, threshold=1.0))][:2] == [["posts.comments", "posts.shares"], ["posts.shares"]]
    scalars = {"type": "object", "required": ["title", "tags"], "properties": {"title": TEXT, "tags": {"type": "array", "items": TEXT}}}
    some = frame(spark, [{"title": "", "tags": []}], scalars)
    assert told(some, D.blank_fields(D.Declared.column(some, "result", scalars))) == [[]]


def test_long_samples_are_cut(spark):
    rows = frame(spark, [{"posts": [post(likes="x" * 200), post(likes=""), post(likes="")]}], POSTS)
    assert told(rows, D.blank_fields(D.Declared.column(rows, "result", POSTS)))[0][0]["samples"] == ["x" * 80]


def test_missing_outputs(spark):
    schema = {"type": "object", "required": ["a", "b", "c", "gone"], "properties": {"a": TEXT, "b": {"type": "array", "items": TEXT}, "c": {"type": "integer"}}}
    rows = frame(spark, [{"a": "x", "b": ["y"], "c": 0}, {"a": "", "b": []}, None, {"a": " ", "b": [""], "c": 1}], schema)
    assert told(rows, D.missing(D.Declared.column(rows, "result", schema))) == [["gone"], ["a", "b", "c", "gone"], ["a", "b", "c", "gone"], ["gone"]]
    wrapped = rows.select("id", F.struct(F.col("result").alias("data"), F.lit("a").alias("a")).alias("result"))
    assert told(wrapped, D.missing(D.Declared.column(wrapped, "result", schema))) == [["gone"], ["a", "b", "c", "gone"], ["a", "b", "c", "gone"], ["gone"]]
    text = rows.select("id", F.lit("x").alias("result"))
    assert told(text, D.missing(D.Declared.column(text, "result", schema)))[0] == ["a", "b", "c", "gone"]
    assert told(rows, D.missing(D.Declared.column(rows, "result", {"type": "object"})))[1] == []


def test_empty_lists(spark):
    schema = {"type": "object", "required": ["posts", "tags", "title"], "properties": POSTS["properties"] | {"tags": {"type": "array", "items": TEXT}, "title": TEXT}}
    hollow = dict.fromkeys(FIELDS, "")
    results = [{"posts": [], "tags": []}, {"posts": [hollow, {}], "tags": ["a"]}, {"posts": [hollow, post()]}, {"posts": [hollow | {"likes": " "}]}, {"posts": [hollow, None]}, {"title": ""}, None]
    rows = frame(spark, results, schema)
    got = told(rows, D.empty_lists(D.Declared.column(rows, "result", schema)))
    assert [x or [] for x in got] == [["posts"], ["posts"], [], [], [], [], []]


DUPLICATES = {"type": "object", "properties": {"posts": {"type": "array", "items": {"type": "object", "properties": {f: TEXT for f in ("group", "username", "content")}}}}}


@pytest.mark.parametrize(("posts", "threshold", "want"), [
    ([("g", "u", "c")] * 10, 1.0, (10, 1, 10, 1.0)), ([("g", "u", str(i)) for i in range(3)], 1.0, None), ([("g", "u", "c")] * 5 + [("g", "u", "d")], 1.0, None),
    ([("g", "u", "c")] * 5 + [("g", "u", "d")], 0.8, (6, 2, 5, 5 / 6)), ([("g", "u", "c")] * 2, 1.0, None), ([("g", " ", None), ("g", "", ""), ("g", None, "\t")], 1.0, (3, 1, 3, 1.0)),
])
def test_repeated_records(spark, posts, threshold, want):
    rows = frame(spark, [{"posts": [dict(zip(("group", "username", "content"), p, strict=True)) for p in posts]}], DUPLICATES)
    got = D.repeated_records(rows, ["id"], "result", DUPLICATES, threshold).collect()
    assert [(r["n_records"], r["n_unique"], r["largest"], r["ratio"]) for r in got] == ([want] if want else [])
    if want and want[1] == 2:
        assert got[0]["signature"] == "group:g||username:u||content:c"


def test_scores(spark):
    inner = {"a": TEXT, "b": TEXT, "c": TEXT}
    schema = {"type": "object", "required": ["posts"], "properties": {"posts": {"type": "array", "items": {"type": "object", "properties": inner}}}}
    full = dict.fromkeys("abc", "x")
    rows = frame(spark, [{"posts": [full, full]}, {"posts": [{"a": "x", "b": ""}]}, {"posts": []}, {}, None], schema)
    got = told(rows, D.score(D.Declared.column(rows, "result", schema)))
    assert [(x["is_data"], round(x["score"], 6)) for x in got] == [(True, 125.0), (True, round(100 + 10 + 5 / 3, 6)), (True, 0.0), (True, 0.0), (False, 0.0)]
    one = {"type": "object", "required": ["title"], "properties": {"title": TEXT}}
    rows = frame(spark, [{"title": "x"}, {"title": ""}], one)
    assert [x["score"] for x in told(rows, D.score(D.Declared.column(rows, "result", one)))] == [100.0, 0.0]
    text = rows.select("id", F.lit("plain").alias("result"))
    assert [x["is_data"] for x in told(text, D.score(D.Declared.column(text, "result", one)))] == [False, False]
    assert not told(rows, D.score(D.Declared.column(rows, "result", {})))[0]["is_data"]
    nested = {"type": "object", "required": ["o", "p"], "properties": {"o": {"type": "object", "properties": {"x": TEXT, "y": {"type": "array", "items": TEXT}}}, "p": {"type": "object", "properties": {"q": {"type": "object", "properties": {"z": {"type": "integer"}}}}}}}
    rows = frame(spark, [{"o": {"x": "", "y": []}, "p": {"q": {"z": 0}}}, {"o": {"x": "a"}, "p": {"q": {}}}], nested)
    assert [x["score"] for x in told(rows, D.score(D.Declared.column(rows, "result", nested)))] == [50.0, 50.0]


def test_best_attempt(spark):
    schema = {"type": "object", "required": ["title"], "properties": {"title": TEXT}}
    rows = frame(spark, [{"title": ""}, {"title": "b"}, {"title": "c"}, None], schema).withColumn("job", F.lit(1))
    assert [tuple(r) for r in D.best_attempts(rows, ["job"], "id", "result", schema).collect()] == [(1, 1, 100.0)]


def test_best_attempt_of_equal_scores(spark):
    """98 is added up to 97.99999999999999 for the first attempt, and to 98 for the second."""
    record = lambda n: {c: "x" for c in "abcde"[:n]}
    items = {"type": "object", "properties": {c: TEXT for c in "abcde"}}
    schema = {"type": "object", "required": ["t", "u", "posts"], "properties": {"t": TEXT, "u": TEXT, "posts": {"type": "array", "items": items}}}
    results = [{"t": "x", "posts": [record(n) for n in (1, 1, 2)]}, {"posts": [record(n) for n in (5, 5, 4, 5, 4, 5)]}]
    rows = frame(spark, results, schema).withColumn("job", F.lit(1))
    scores = [x["score"] for x in told(rows, D.score(D.Declared.column(rows, "result", schema)))]
    assert scores[0] < scores[1] and round(scores[0], 6) == round(scores[1], 6)
    assert [tuple(r) for r in D.best_attempts(rows, ["job"], "id", "result", schema).collect()] == [(1, 0, 98.0)]
