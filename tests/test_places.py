"""Places in ranges, step edits, answers with code, frames of pages."""

import datetime
import json
import random
import time

import plain_reduce
import pytest

from gleaner.functions import answers
from gleaner.functions import text as X
from gleaner.operators import nodes, places, reduce, steps
from gleaner.sources import html as H
from gleaner.streaming import feeds


def _expected(rows, at):
    want, seen = {}, {}
    for i, (group, value) in sorted(enumerate(rows), key=lambda r: (r[1][at] is not None, r[1][at] if r[1][at] is not None else 0, r[0])):
        seen[group] = seen.get(group, 0) + 1
        want[i] = seen[group]
    return want


@pytest.mark.parametrize("kind", ["long", "string", "timestamp", "timestamp_ntz", "date"])
def test_numbered(spark, kind):
    rng = random.Random(5)
    at = datetime.datetime(2024, 10, 26)
    make = {
        "long": lambda: rng.randrange(40), "string": lambda: rng.choice(["", "a", "abcdefgh", "abcdefzz", "é", "z"]) + str(rng.randrange(9)),
        "timestamp": lambda: at + datetime.timedelta(minutes=rng.randrange(4000)), "timestamp_ntz": lambda: at + datetime.timedelta(minutes=rng.randrange(4000)),
        "date": lambda: at.date() + datetime.timedelta(days=rng.randrange(30)),
    }[kind]
    rows = [(rng.choice(["hot", "hot", "hot", "b", None]), make() if rng.random() < 0.95 else None) for _ in range(400)]
    frame = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"i int, g string, v {kind}")
    found = places.numbered(frame, ["g"], ["v", "i"], "n", ranges=7)
    assert found.columns == ["i", "g", "v", "n"]
    assert {r["i"]: r["n"] for r in found.collect()} == _expected(rows, 1)


def test_numbered_one_value_and_nothing(spark):
    frame = spark.range(50).selectExpr("id", "1 as v")
    assert {(r["id"] + 1) == r["n"] for r in places.numbered(frame, [], ["v", "id"], "n").collect()} == {True}
    assert places.numbered(frame.where("v > 1"), [], ["v", "id"], "n").collect() == []


def test_strings_with_one_beginning(spark):
    """URLs of one site are several ranges, though their first bytes are all the same."""
    frame = spark.range(2000).selectExpr("id", "concat('https://www.example.org/page/', lpad(id * 7919 % 2000, 5, '0')) as url")
    assert frame.select(places.measure(frame, "url").alias("m")).distinct().count() > 100
    found = places.numbered(frame, [], ["url"], "n", ranges=16)
    assert [r["n"] for r in found.orderBy("url").collect()] == list(range(1, 2001))


def test_sums_in_ranges(spark):
    rng = random.Random(2)
    rows = [(rng.choice(["hot", "hot", "b", None]), rng.choice([None, *range(300)]), rng.choice([None, 0, 1, 5])) for _ in range(500)]
    frame = spark.createDataFrame(rows, "g string, o int, v int")
    got = sorted((str(r["g"]), str(r["o"]), r["s"]) for r in places.summed(frame, ["g"], "o", frame["v"], "s", ranges=9).collect())
    key = lambda o: -1 if o is None else o
    assert got == sorted((str(g), str(o), sum(w or 0 for h, p, w in rows if h == g and key(p) <= key(o))) for g, o, _ in rows)


def test_fingerprints(spark):
    texts = ["", " \n", None, "a", "x é漢🙂 y", "ab " * 70_000]
    got = [r[0] for r in spark.createDataFrame(list(enumerate(texts)), "i int, t string").orderBy("i").select(X.fingerprint("t")).collect()]
    for text, found in zip(texts, got, strict=True):
        h = 5381
        for c in " ".join((text or "").split()):
            h = (h * 33 + ord(c)) % 2**32
        assert found == (f"{h:08x}" if (text or "").split() else "empty")


def test_steps_added_and_deleted(spark):
    schema = "graph int, id string, ordinal int, script string, on_success string, on_failure string, max_iterations int"
    table = spark.createDataFrame([(1, "a", 0, "x", "step-3", "TERMINATE", 1), (1, "step-3", 1, "x", None, "a", 1), (2, "c", 0, "x", "c", "c", 2)], schema)
    new = spark.createDataFrame([(1, None, None, None, None, None), (9, "q", None, None, None, None)], "graph int, id string, script string, on_success string, on_failure string, max_iterations int")
    found = sorted(tuple(r) for r in steps.added(table, new).collect())
    assert found == [
        (1, "a", 0, "x", "step-3", "TERMINATE", 1), (1, "step-3", 1, "x", "step-4", "a", 1), (1, "step-4", 2, "", "TERMINATE", "TERMINATE", 1), (2, "c", 0, "x", "c", "c", 2),
    ]
    gone = spark.createDataFrame([(1, "step-3"), (2, "none")], "graph int, id string")
    assert sorted(tuple(r) for r in steps.deleted(table, gone).collect()) == [(1, "a", 0, "x", "TERMINATE", "TERMINATE", 1), (2, "c", 0, "x", "c", "c", 2)]


def test_code_in_json(spark):
    code = """$count('div[role="article"]') > 0 && x == "y" """
    texts = [
        '{"script": "' + code + '", "n": 1}', '{condition: "' + code + '"\n, "note": "plain"}', '{"code": "a \\"b\\" c",}', '{"script": "if (a) {", "n": 2,}', '{"note": "say "no"", "n": 1}', '{"script": "no end', None,
    ]
    frame = spark.createDataFrame(list(enumerate(texts)), "i int, t string").orderBy("i")
    got = [r[0] and json.loads(r[0]) for r in frame.select(answers.lenient_json("t")).collect()]
    assert got == [{"script": code, "n": 1}, {"condition": code, "note": "plain"}, {"code": 'a "b" c'}, {"script": "if (a) {", "n": 2}, None, None, None]


def test_fenced(spark):
    cases = [
        ("// NACK: no\r\n```js\r\nlet a = 1\r\n```\nend", "let a = 1"), ("```json\n{}\n```\n```js\nopen", "open"), ("so: [1, {2}] and", "[1, {2}]"), ("so: {1} and [2] x", "{1}"), ("return {a}; // x", "return {a}; // x"),
        ("ACK: x\ny", "ACK: x\ny"), ("```\n \n```", "```\n \n```"), ("", ""), (None, None),
    ]
    frame = spark.createDataFrame([(i, a) for i, (a, _) in enumerate(cases)], "i int, a string").orderBy("i")
    assert [r[0] for r in frame.select(X.fenced("a")).collect()] == [b for _, b in cases]


def test_frames_are_marked(spark):
    page = '<body><iframe id="a b">x</iframe><iframe name=\'n"\'>y</iframe><iframe>z</iframe><iframe src="s"></iframe></body>'
    found = [e.attrs.get("data-iframe-prefix") for e in plain_reduce.clean(H.parse(page)) if e.tag == "iframe"]
    assert found == ["iframe#a\\ b::", 'iframe[name="n\\""]::', "iframe:nth-of-type(3)::", None]
    table = nodes.parsed(spark.createDataFrame([(page,)], "html string"), [])
    rows = reduce.cleaned(table).where("tag = 'iframe'").orderBy("start").collect()
    assert [r["attrs"].get("data-iframe-prefix") for r in rows] == found


def _samples(spark, path, rows):
    for i, part in enumerate(rows):
        spark.createDataFrame(part, "k string, n long, v string").coalesce(1).write.parquet(f"{path}/in/{i}")
    return spark.readStream.schema("k string, n long, v string").option("maxFilesPerTrigger", 1).parquet(f"{path}/in/*")


def test_runs_go_on_in_the_next_batch(spark, tmp_path):
    batches = [[("a", 1, "x"), ("a", 2, "y"), ("b", 1, "q"), ("c", 1, None)], [("a", 3, "y"), ("b", 2, None), ("c", 2, None)], [("a", 4, "y"), ("a", 5, "y"), ("b", 3, "q"), ("c", 3, None)], [("a", 6, "z"), ("b", 4, "q"), ("b", 5, "q")]]
    found = feeds.drained(feeds.settled(_samples(spark, tmp_path, batches), "k", "v", "n", 3), f"{tmp_path}/out", f"{tmp_path}/state")
    assert sorted(tuple(r) for r in found.collect()) == [("a", 4), ("b", 5)]


def test_idle_keys_are_forgotten(spark, tmp_path):
    stream = feeds.settled(_samples(spark, tmp_path, [[("a", 1, "x"), ("a", 2, "x")]]), "k", "v", "n", 3, idle=1)
    query = stream.writeStream.format("memory").queryName("idle_keys").option("checkpointLocation", f"{tmp_path}/state").start()
    try:
        states = lambda: [p.stateOperators[0].numRowsTotal for p in query.recentProgress if p.stateOperators]
        for _ in range(200):
            if (seen := states()) and max(seen) == 1 and seen[-1] == 0:
                break
            time.sleep(0.1)
    finally:
        query.stop()
    assert max(states()) == 1 and states()[-1] == 0 and spark.table("idle_keys").count() == 0
