"""Versions, registry, event log and stateful streams, step by step."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from gleaner.operators import dependent
from gleaner.operators import extract as E
from gleaner.plans import stored
from gleaner.sources import store
from gleaner.sources.export import export
from gleaner.sources.registry import Refused, Registry
from gleaner.sources.versions import Conflict, Pointer
from gleaner.streaming import states
from gleaner.streaming.sink import EventLog

STEP = "struct<id:string,name:string,script:string,condition:string,onSuccess:string,onFailure:string,maxIterations:int,entryUrl:string>"
SERVICE = f"id string, name string, displayName string, steps array<{STEP}>"


def step(i, success="TERMINATE", script="run()"):
    return (i, None, script, None, success, "TERMINATE", 1, None)


def test_pointer_switches_whole(spark, tmp_path):
    pointer = Pointer(spark, str(tmp_path / "a"))
    assert pointer.read() is None
    pointer.switch(None, {"x": "é", "n": [1]})
    assert pointer.read() == {"x": "é", "n": [1]}
    with pytest.raises(Conflict):
        Pointer(spark, str(tmp_path / "a")).switch(None, {"x": 2})
    pointer.switch({"x": "é", "n": [1]}, {})
    assert pointer.read() == {} and [p.name for p in (tmp_path / "a").iterdir() if not p.name.startswith(".")] == ["_current"]


def services(spark, rows):
    return spark.createDataFrame(rows, SERVICE)


def test_registry(spark, tmp_path):
    registry = Registry(spark, str(tmp_path / "r"))
    assert registry.read().count() == 0 and registry.version() == 0 and registry.find("x").count() == 0
    one, two = ("1", "first", "First", [step("a", "b"), step("b")]), ("2", "second", None, [])
    assert registry.save(services(spark, [one, two]), now=5) == 1
    assert {r["id"]: r["updatedAt"] for r in registry.read().collect()} == {"1": 5, "2": 5}
    assert registry.find("First").first()["id"] == registry.find("first").first()["id"] == registry.by_id("1").first()["id"] == "1"
    for bad, told in (
        (("1", "x", None, [step("a", "nowhere")]), "DANGLING_POINTER"), (("3", "x", None, [step("a"), step("b")]), "UNREACHABLE"),
        (("3", "x", None, [step("a", "SELF")]), "SELF_POINTER"), ((None, "x", None, []), "NO_ID"),
    ):
        with pytest.raises(Refused, match=told) as e:
            registry.save(services(spark, [bad, ("9", "fine", None, [step("a")])]), now=6)
        assert told in {r["problem"] for r in e.value.problems.collect()}
    with pytest.raises(Refused, match="REPEATED_SERVICE"):
        registry.save(services(spark, [two, two]), now=6)
    assert registry.version() == 1 and registry.read().count() == 2
    assert registry.save(services(spark, [("2", "second", "Shown", [step("a")]), ("3", "third", None, [])]), now=7) == 2
    assert sorted((r["id"], r["displayName"], r["updatedAt"]) for r in registry.read().collect()) == [("1", "First", 5), ("2", "Shown", 7), ("3", None, 7)]
    assert registry.delete(spark.createDataFrame([("1",), ("7",)], "id string")) == 3
    assert {r["id"] for r in registry.read().collect()} == {"2", "3"}
    assert registry.clear() == 4 and registry.read().count() == 0
    assert len([p for p in (tmp_path / "r").iterdir() if p.name.startswith("services-")]) <= 2


def test_readers_keep_their_version(spark, tmp_path, monkeypatch):
    registry = Registry(spark, str(tmp_path / "r"))
    registry.save(services(spark, [("1", "a", None, [])]), now=1)
    begun = registry.read()
    monkeypatch.setattr(registry._pointer, "switch", lambda *_: (_ for _ in ()).throw(OSError("gone")))
    with pytest.raises(OSError):
        registry.save(services(spark, [("2", "b", None, [])]), now=2)
    monkeypatch.undo()
    assert [r["id"] for r in registry.read().collect()] == ["1"]
    registry.save(services(spark, [("3", "c", None, [])]), now=2)
    assert [r["id"] for r in begun.collect()] == ["1"] and registry.read().count() == 2


EVENTS = "id long, at timestamp_ntz, what string"
NOON = datetime.datetime(2024, 5, 1, 12)


@pytest.mark.parametrize(("age", "most", "parts"), [(None, None, 32), (3600, None, 32), (None, 7, 32), (3600, 5, 2), (600, 100, 1), (None, 0, 3)])
def test_event_log_equals_all_at_once(spark, tmp_path, age, most, parts):
    """Whatever comes late, twice or without a time: the log is what all batches would give."""
    r = random.Random(most or 1)
    log = EventLog(spark, str(tmp_path / "log"), EVENTS, "at", "id", age, most, parts)
    assert log.read().count() == 0 and log.last_batch() == -1
    every, n = [], 0
    for batch in range(7):
        rows = []
        for _ in range(r.choice([0, 1, 4, 9])):
            at = None if r.random() < 0.1 else NOON + datetime.timedelta(seconds=batch * 400 + r.randrange(-900, 900))
            rows.append((n, at, "x"))
            n += 1
        frame = spark.createDataFrame(rows, EVENTS)
        assert log.write(frame.withColumn("more", F.lit(1)), batch)
        assert not log.write(frame, batch) and not log.write(frame, batch - 1)
        every += rows
        newest = max((t for _, t, _ in every if t), default=None)
        left = [x for x in every if age is None or newest is None or (x[1] and x[1] > newest - datetime.timedelta(seconds=age))]
        left.sort(key=lambda x: (x[1] or datetime.datetime.min, x[0]), reverse=True)
        want = left if most is None else left[:most]
        assert sorted(x["id"] for x in log.read().collect()) == sorted(x[0] for x in want), batch
    assert log.last_batch() == 6
    assert len(log._pointer.read()["parts"]) <= max(parts, 1)


def test_a_batch_lost_before_the_pointer_comes_again(spark, tmp_path, monkeypatch):
    log = EventLog(spark, str(tmp_path / "log"), EVENTS, "at", "id")
    frame = spark.createDataFrame([(1, NOON, "x")], EVENTS)
    monkeypatch.setattr(log._pointer, "switch", lambda *_: (_ for _ in ()).throw(OSError("gone")))
    with pytest.raises(OSError):
        log.write(frame, 0)
    monkeypatch.undo()
    assert log.read().count() == 0 and log.write(frame, 0) and log.read().count() == 1


def stream_of(spark, path, batches, schema):
    import os
    import time

    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
        for name in os.listdir(path):  # files are read in the order of their times
            if name.startswith("part-") and os.path.getmtime(f"{path}/{name}") > time.time() - 3600:
                os.utime(f"{path}/{name}", (1_600_000_000 + i, 1_600_000_000 + i))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def told(spark, stream, tmp_path, name):
    out = []
    states.run(stream, lambda rows, i: out.append((i, [tuple(r) for r in rows.collect()])), str(tmp_path / name), 2)
    return out


def test_ids_are_known_up_to_a_bound(spark, tmp_path):
    """2,000 ids are known; the 2,001st makes the 1,000 oldest unknown again."""
    r = random.Random(4)
    rows = [(1, n, r.choice([n, n, n - 900, max(n - 1500, 0), n // 2])) for n in range(5000)] + [(2, n, n % 3) for n in range(30)] + [(None, 5, 1), (None, 6, 1), (2, 40, None), (2, 41, None)]
    cuts = [rows[:1700] + rows[5000:5010], rows[1700:2500], rows[2500:5000] + rows[5010:]]
    want, known = [], {}
    for key, n, x in sorted(rows, key=lambda x: (str(x[0]), x[1])):
        have = known.setdefault(key, [])
        if x not in have:
            want.append((key, n, x))
            have.append(x)
            if len(have) > 2000:
                del have[:1000]
    stream = states.once(stream_of(spark, str(tmp_path / "in"), cuts, "k long, n long, x long"), "k", "n", "x")
    got = [row for _, rows in told(spark, stream, tmp_path, "notes") for row in rows]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_ids_sent_once_of_keys_in_one_bucket(spark, tmp_path):
    """Keys of a bucket don't meet, a null key is one, and one call of the store serves them all."""
    r = random.Random(5)
    rows = [(r.choice([None, "a", "b", "c"]), n, r.choice([None, 1, 2, 3, 4, 5])) for n in range(120)]
    cuts, lines, want = [rows[:50], rows[50:55], rows[55:]], {}, []
    for k, n, x in rows:
        line = lines.setdefault(k, [])
        if x not in line:
            want.append((k, n, x))
            line.append(x)
            if len(line) > 3:
                del line[:2]
    stream = states.once(stream_of(spark, str(tmp_path / "in"), cuts, "k string, n long, x long"), "k", "n", "x", 3, 2, buckets=1)
    got = [row for _, rows in told(spark, stream, tmp_path, "notes") for row in rows]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_ids_are_forgotten_with_their_key():
    """A bucket's timer forgets the keys whose time is out, and waits for the next."""
    from types import SimpleNamespace as Of

    from pyspark.sql import Row

    value, timers = [], set()
    state = Of(get=lambda: value[0] if value else None, update=lambda x: value.__setitem__(slice(None), [x]), clear=value.clear)
    once = states.Once("k", "n", "x", {"k": "string", "x": "bigint"}, 6, 3, 100)
    once.init(Of(getValueState=lambda *_: state, listTimers=lambda: iter(timers), deleteTimer=timers.discard, registerTimer=timers.add))
    at = lambda now: Of(getCurrentProcessingTimeInMs=lambda: now)
    rows = lambda *xs: [Row("b", "k", "n", "x")(0, *x) for x in xs]
    assert len(list(once.handleInputRows((0,), rows(("a", 0, 1), ("b", 1, 1)), at(1000)))) == 2 and timers == {1100}
    assert not list(once.handleInputRows((0,), rows(("b", 2, 1)), at(1050))) and timers == {1100}
    assert not list(once.handleExpiredTimer((0,), at(1100), None)) and timers == {1150}
    assert [tuple(x) for x in once.handleInputRows((0,), rows(("a", 3, 1), ("b", 4, 1)), at(1120))] == [("a", 3, 1)] and timers == {1220}
    assert not list(once.handleExpiredTimer((0,), at(1220), None)) and not timers and not value


def test_an_arrival_is_written_by_many_tasks(spark, tmp_path, monkeypatch):
    """One batch each, in their order, of as many files as there are cores."""
    monkeypatch.setattr(store, "scratch", lambda _, name: str(tmp_path / name))
    rows = spark.range(40_000).select("id", (F.col("id") % 7).alias("x"))
    stream, seen = stored.arrivals(spark, rows, "id", 4, many=1000), []
    states.run(stream, lambda batch, n: seen.append((n, *batch.agg(F.min("id"), F.max("id"), F.count(F.lit(1))).first())), str(tmp_path / "notes"))
    assert seen == [(i, i * 10_000, i * 10_000 + 9_999, 10_000) for i in range(4)]
    assert len(list((tmp_path / "arrivals").glob("part-*"))) == 4 * spark.sparkContext.defaultParallelism


def test_feed_over_batches(spark, tmp_path):
    """A poll that a batch cuts in two is judged when it is whole, and an ended feed is quiet."""
    polls = {"t": ["a", "b", "a", "c", "d", "e", "f"], "s": ["a", "a", "a", "a", "a", "a", "b", "b"], "o": ["a", "b"]}
    rows = [(k, n, x) for k, xs in polls.items() for n, x in enumerate(xs)]
    cuts = [[x for x in rows if x[1] < 3], [x for x in rows if 3 <= x[1] < 6], [x for x in rows if x[1] >= 6]]
    stream = states.feeds(stream_of(spark, str(tmp_path / "in"), cuts, "k string, n long, x string"), "k", "n", "x", size=2, target=4, stalls=2)
    by_batch = told(spark, stream, tmp_path, "notes")
    rows = {b: {x[0]: x[1:] for x in xs} for b, xs in by_batch}
    assert rows[0] == {"t": (3, 2, 2, None, False), "s": (3, 2, 1, None, False), "o": (2, 1, 2, None, False)}
    assert rows[1]["t"] == (6, 3, 5, "target", True) and rows[1]["s"] == (6, 3, 1, "stalled", True)
    assert not rows.get(2, {}).get("t") and not rows.get(2, {}).get("s")


def test_export_of_many_tasks(spark, tmp_path):
    import json

    rows = [(str(i), f"näme {i:03d}", None if i % 2 else "Shown", [step("a", 'b"')] if i % 3 else []) for i in range(50)]
    table = services(spark, rows)
    path = str(tmp_path / "all.json")
    export(table.repartitionByRange(7, "name").sortWithinPartitions("name"), path)
    got = json.loads((tmp_path / "all.json").read_text())
    assert [x["name"] for x in got] == [r[1] for r in rows] and "displayName" not in got[1] and got[1]["steps"][0]["onSuccess"] == 'b"'
    assert [p.name for p in tmp_path.iterdir()] == ["all.json"]
    export(table.where("false"), path)
    assert json.loads((tmp_path / "all.json").read_text()) == []
    export(table.where("id < 2").withColumn("inputSchema", F.lit('{"properties": {"q": {"type": "string"}}}')), f"file://{tmp_path}/all.md", "markdown")
    text = (tmp_path / "all.md").read_text()
    assert text.count("\n# ") + text.startswith("# ") == text.count("| q | string | no |") and "# Shown" in text


def test_a_failed_export_leaves_nothing(spark, tmp_path):
    path = tmp_path / "all.json"
    path.write_text("as it was")
    bad = spark.range(40).repartition(4).select(F.col("id").cast("string").alias("id"), F.when(F.col("id") == 33, F.raise_error(F.lit("gone"))).otherwise("x").alias("name"))
    with pytest.raises(Exception, match="gone"):
        export(bad, str(path))
    assert path.read_text() == "as it was" and [p.name for p in tmp_path.iterdir()] == ["all.json"]
    with pytest.raises(Exception, match="form is one of"):
        export(bad, str(path), "xml")


def test_export_is_read_by_many_tasks(spark, tmp_path):
    import json

    table = services(spark, [(str(i), f"näme\n {i:03d},", None, [step("a", 'b"\n]')]) for i in range(50)])
    path = str(tmp_path / "all.json")
    export(table.repartitionByRange(3, "name"), path)
    given = json.loads((tmp_path / "all.json").read_text())
    (tmp_path / "other.json").write_text(json.dumps(given, indent=1, ensure_ascii=False))
    with states.settings(spark, {"spark.sql.files.maxPartitionBytes": "2000", "spark.sql.files.openCostInBytes": "0"}):
        again = store.read_services(spark, path)
        assert again.rdd.getNumPartitions() > 3
        rows = sorted(again.collect())
    other = sorted(store.read_services(spark, str(tmp_path / "other.json")).collect())
    assert len(rows) == 50 and rows == other


LISTS = {
    "indented": lambda rows, dump: dump(rows, indent=2),
    "crlf": lambda rows, dump: dump(rows, indent="\t").replace("\n", "\r\n"),
    "blank": lambda rows, dump: dump(rows, indent=2).replace("\n", "\n\n"),
    "mixed": lambda rows, dump: "[\n" + ",\n".join(dump(r, indent=1 if i % 2 else None) for i, r in enumerate(rows)) + "\n]",
}
OTHERS = {
    "one line": lambda rows, dump: dump(rows),
    "closing and opening": lambda rows, dump: dump(rows, indent=2).replace("},\n  {", "}, {"),
    "brackets aside": lambda rows, dump: "[" + ",\n".join(dump(r, indent=1) for r in rows) + "]",
}


@pytest.mark.parametrize("form", [*LISTS, *OTHERS])
def test_other_lists_of_services(spark, tmp_path, monkeypatch, form):
    """Indented ones are read by many tasks, too; all with what a reader of the whole file finds."""
    import json

    odd = ['{"[', "}]\\", 'a\\" }, {', "\n},\n{", "ä\t]"]
    rows = [{"id": str(i), "name": odd[i % 5] + str(i), "enabled": True, "steps": [{"id": "s", "script": odd[(i + 1) % 5]}] * (i % 3 + 1), "inputSchema": json.dumps({"x": odd})} for i in range(40)]
    rows += [{"id": "none", "name": "no steps", "steps": []}, {}, {"id": "code", "name": "c", "scriptCode": odd[3], "else": [[1, {"a": []}], "]"]}]
    path = str(tmp_path / "list.json")
    monkeypatch.setattr(store, "ONE_TASK", 0)
    with open(path, "w", newline="") as out:
        out.write((LISTS | OTHERS)[form](rows, lambda x, **k: json.dumps(x, ensure_ascii=False, **k)))
    with states.settings(spark, {"spark.sql.files.maxPartitionBytes": "2000", "spark.sql.files.openCostInBytes": "0"}):
        again = store.read_services(spark, path)
        assert ("Scan json" in again._jdf.queryExecution().toString()) == (form in OTHERS)
        got = sorted(again.collect(), key=str)
    want = spark.read.schema(store.SERVICE).option("multiLine", True).json(path).where("id is not null and name is not null and (size(steps) > 0 or scriptCode is not null)")
    assert len(got) == 41 and got == sorted(want.collect(), key=str)


def test_exported_names_may_repeat_and_be_long(spark, tmp_path):
    import duckdb

    from gleaner.plans.queries import ORACLE_SQL

    names = ["same", "same", "same", "n" * 1500, "other"]
    spark.createDataFrame([(i, n, 1, "M") for i, n in enumerate(names)], "c_custkey long, c_name string, c_nationkey int, c_mktsegment string").write.parquet(f"{tmp_path}/customer.parquet")
    db = duckdb.connect()
    db.execute(f"create view customer as select * from '{tmp_path}/customer.parquet/*.parquet'")
    assert sorted(tuple(r) for r in stored.service_export(spark, str(tmp_path)).collect()) == sorted(db.execute(ORACLE_SQL["service_export"]).fetchall())


def test_pages_are_opened_once(spark):
    pages = spark.createDataFrame([("u1", "<title>t</title><ul><li>1</li></ul>"), ("u2", "<title>none</title>"), ("u2", None), ("u3", None)], "url string, html string")
    rows = spark.createDataFrame([(i, u) for i, u in enumerate(["u1", "u1", "u2", "u3", "u4", None, "u1"])], "n int, target string")
    job = E.Job({"title": E.Read("title"), "items": E.Records("li", {"text": ""}, strict=True)})
    got = {r["n"]: (r["value"] and (r["value"]["title"], len(r["value"]["items"])), r["error"] and r["error"]["code"]) for r in dependent.opened(rows, "target", pages, job).collect()}
    fails = (None, "SCRIPT_ERROR")
    assert got == {0: (("t", 1), None), 1: (("t", 1), None), 6: (("t", 1), None), 2: fails, 3: fails, 4: (None, "PAGE_NOT_FOUND"), 5: (None, None)}
    assert dependent.opened(rows.where("false"), "target", pages, job).count() == 0
