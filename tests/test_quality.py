import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gleaner.functions import text as X
from gleaner.operators import history, pages, quality, steps
from gleaner.sources import store


def one(spark, column, **values):
    schema = ", ".join(f"{k} {'bigint' if isinstance(v, int) else 'string'}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], schema).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(("value", "e1", "e4", "e6"), [("", True, True, True), ("  \t", False, True, False), (None, True, True, True), ("0", False, False, False)])
def test_emptiness_rules_differ(spark, value, e1, e4, e6):
    got = spark.createDataFrame([(value,)], "v string").select(X.empty_value("v"), X.empty_ratio_value("v"), X.unpopulated("v")).first()
    assert tuple(got) == (e1, e4, e6)


@pytest.mark.parametrize(("name", "kind"), [("postTime", "time-like"), ("likes", "count-like"), ("account.profileUrl", "url-like"), ("postId", "id-like"), ("username", "text-like")])
def test_field_types(spark, name, kind):
    assert one(spark, X.field_type("n"), n=name) == kind


def test_url_templates(spark):
    make = lambda template, **v: one(spark, X.resolve_template(F.lit(template), {k: F.col(k) for k in v}, strict=False), **v)
    assert make("http://a/", q="1") == "http://a/"
    assert make("http://a/{{q}}", q="hello world") == "http://a/hello%20world"
    assert make("http://a/{{ q }}", q="a&b=c") == "http://a/a%26b%3Dc"
    assert make("http://a/{{q}}", q="1,2,3") == "http://a/1%2C2%2C3"
    assert make("http://a/{{q}}", q="$1\\~(*)") == "http://a/%241%5C~(*)"
    assert make("http://a/{{r}}", q="x") is None
    assert make("http://a/{{a-b}}", q="x") == "http://a/{{a-b}}"
    with pytest.raises(Exception, match="MISSING_URL_PARAM"):
        one(spark, X.resolve_template(F.lit("{{r}}"), {}), q="x")


def test_brittleness(spark):
    score = lambda s: one(spark, X.brittleness("s"), s=s)
    assert score("li:nth-of-type(3) > a") == 35
    assert score("a > b") == 10
    assert score("div.x1f6 > [role='x']") == 20
    assert score("") == 0


def test_empty_ratio(spark):
    rows = spark.createDataFrame([("d", i, c, s) for i, (c, s) in enumerate([("", "1"), (" ", "2"), ("5", "")])], "doc string, i int, comments string, shares string")
    found = {r["field"]: r["n_empty"] for r in quality.empty_ratio(rows, ["doc"], ["comments", "shares"]).collect()}
    assert found == {"comments": 2}
    assert {r["field"] for r in quality.empty_ratio(rows, ["doc"], ["comments", "shares"], 0.3).collect()} == {"comments", "shares"}
    assert quality.empty_ratio(rows.limit(1), ["doc"], ["comments"]).count() == 0


@pytest.mark.parametrize(("values", "threshold", "flagged"), [("a" * 10, 1.0, True), ("abc", 1.0, False), ("aaaaab", 1.0, False), ("aaaaab", 0.8, True), ("aa", 1.0, False)])
def test_duplicates(spark, values, threshold, flagged):
    rows = spark.createDataFrame([("d", i, v) for i, v in enumerate(values)], "doc string, i int, v string")
    found = quality.duplicates(rows, ["doc"], ["v"], "i", threshold).collect()
    assert bool(found) is flagged
    if found and values == "a" * 10:
        assert (found[0]["n_records"], found[0]["n_unique"], found[0]["ratio"]) == (10, 1, 1.0)


def test_shapes(spark):
    rows = spark.createDataFrame([(1, i, *v) for i, v in enumerate([("x", None, ""), ("x", None, None), ("x", "", None), (None, "y", None), (None, None, "z"), ("", None, "z")])], "d int, i int, a string, b string, c string")
    found = quality.shapes(rows, ["d"], ["a", "b", "c"], "i")
    assert [(r["shape"], r["signature"], r["n"], r["first"]) for r in found.orderBy("shape").collect()] == [("A", "a", 3, 0), ("B", "c", 2, 4), ("C", "b", 1, 3)]
    assert quality.shapes(rows.limit(1), ["d"], ["a"], "i").count() == 0


def test_nested_shapes(spark):
    rows = [(1, i, r) for i, r in enumerate([("x", (0, ""), []), ("x", (0, None), None), ("x", None, ["a"]), ("", (None, "n"), ["a", ""]), (None, None, None)])]
    frame = spark.createDataFrame(rows, "d int, i int, r struct<t: string, u: struct<n: int, name: string>, l: array<string>>")
    found = quality.shapes(frame, ["d"], [], "i", quality.nested_shape("r", frame.schema["r"].dataType))
    assert [(r["shape"], r["signature"], r["n"]) for r in found.orderBy("shape").collect()] == [("A", "t,u.n", 2), ("B", "l,t", 1), ("C", "l,u.name", 1), ("D", "", 1)]
    assert [p for p, _ in quality.leaf_paths(frame.schema["r"].dataType)] == ["t", "u.n", "u.name", "l"]


def test_step_checks(spark):
    rows = [("g", "a", "x()", None), ("g", "b", "return {done: false}", None), ("g", "c", "x()", 5), ("g", "d", " // PENDING_ANNOTATION ", 3), ("g", "e", None, None), ("g", "f", "loading : true", 2), ("g", "h", "undone: 1", None)]
    frame = spark.createDataFrame(rows, "graph string, id string, script string, max_iterations int")
    assert {(r["id"], r["note"]) for r in steps.execution_notes(frame).collect()} == {("c", "NO_SIGNAL"), ("d", "PENDING_ANNOTATION"), ("e", "PENDING_ANNOTATION")}
    assert {r["id"]: r["max_iterations"] for r in steps.with_defaults(frame).collect()} == {"a": None, "b": 30, "c": 5, "d": 3, "e": None, "f": 2, "h": None}


def test_attempt_score(spark):
    score = lambda c, n, f: spark.range(1).select(quality.attempt_score(F.lit(float(c)), F.lit(n), F.lit(f)).alias("s")).first()["s"]
    assert score(1, 2, 6) == 135.0 and score(0, 0, 0) == 0.0
    assert score(1, 1, 1) == 115.0


def test_page_captures(spark):
    rows = [("j", 1, "u", '<p a="1" b="2">x</p>'), ("j", 2, "u", '<p  b="2" a="1">x</p> <!-- t -->'), ("j", 3, "u", "<p>y</p>"), ("j", 4, "v", '<p a="1" b="2">x</p>'), ("j", 5, "v", None), ("j", 6, "v", "")]
    found = pages.deduplicated(spark.createDataFrame(rows, "job string, seq int, url string, html string"), "job", "seq").orderBy("seq").collect()
    assert [r["seq"] for r in found] == [1, 3, 4]
    assert found[0]["page_id_text"] == f"page_0001_{found[0]['hash'][:8]}" and len(found[0]["hash"]) == 64


@pytest.mark.parametrize(("n", "cap", "kept"), [(60, 50, [*range(5), *range(15, 60)]), (20, 10, [0, *range(11, 20)]), (3, 0, []), (3, 5, [0, 1, 2])])
def test_page_caps(spark, n, cap, kept):
    rows = spark.range(n).withColumn("job", F.lit(1))
    found = pages.capped(rows, "job", "id", cap).orderBy("id").collect()
    assert [r["id"] for r in found] == kept
    assert all(r["dropped"] == max(0, n - cap) for r in found)


def test_unique_slugs_are_the_first_free(spark):
    taken = ["r0", "r0-3", "r1-1", "r2-2", "r2-3", "r3", "r3-1", "r3-2", "r4-01", "other"]
    rows = [(10 * i + j, f"r{i}") for i in range(5) for j in range(5)]
    found = store.unique_slugs(spark.createDataFrame(rows, "k int, slug string"), "slug", spark.createDataFrame([(x,) for x in taken], "name string"), "k")
    want, used = {}, set(taken)
    for k, slug in rows:
        want[k] = next(x for x in [slug, *(f"{slug}-{n}" for n in range(1, 99))] if x not in used)
        used.add(want[k])
    assert {r["k"]: r["unique_slug"] for r in found.collect()} == want


def test_pages_nest_at_any_depth(spark):
    deep = "<div>" * 5000 + "x" + "</div>" * 5000
    rows = [(1, 1, "u", deep), (1, 2, "u", deep + "<!-- c -->"), (1, 3, "u", "only text"), (1, 4, "u", '<p data-k="abcdefghijklmnopqrstuvwxyz" b=\'1\' a>&amp;</p>'), (1, 5, "u", '<P a b="1">&amp;</p>')]
    found = pages.deduplicated(spark.createDataFrame(rows, "job int, seq int, url string, html string"), "job", "seq").orderBy("seq").collect()
    assert [(r["seq"], r["n_captures"]) for r in found] == [(1, 2), (3, 1), (4, 2)]


def middle_out(sizes, budget):
    left = list(enumerate(sizes))
    while budget and len(left) > 2 and sum(s for _, s in left) > budget:
        left.pop(len(left) // 2)
    return [i for i, _ in left]


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(sizes=st.lists(st.integers(0, 50), min_size=1, max_size=12), budget=st.integers(0, 120))
def test_byte_budget_equals_the_loop(spark, sizes, budget):
    rows = spark.createDataFrame([(1, i, s) for i, s in enumerate(sizes)], "job int, seq int, size long")
    found = pages.within_budget(rows, "job", "seq", "size", budget).orderBy("seq").collect()
    assert [r["seq"] for r in found] == middle_out(sizes, budget)


def test_streaks(spark):
    rows = spark.createDataFrame([("a", i, v) for i, v in enumerate(["x", "x", None, "y", "y", "y"])] + [("b", 0, None), ("b", 1, None)], "k string, n int, v string")
    at = lambda equal: {r["k"]: r["settled_at"] for r in history.stable_at(rows, ["k"], ["n"], "v", equal).collect()}
    assert at(3) == {"a": 6, "b": None} and at(2) == {"a": 2, "b": None}


def test_step_edits():
    two = steps.appended(steps.appended([], {"id": "a"}), {"id": "b"})
    assert [(s["id"], s["on_success"]) for s in two] == [("a", "b"), ("b", "TERMINATE")]
    assert [(s["id"], s["on_success"]) for s in steps.removed(two, "a")] == [("b", "TERMINATE")]


def graphs_of(spark, rows):
    return spark.createDataFrame(rows, "graph int, id string, ordinal int, script string, on_success string, on_failure string, max_iterations int")


def walk(rows):
    by, out = {}, set()
    for g, i, o, _, s, f, _ in rows:
        by.setdefault(g, []).append((o, i, s, f))
    for g, xs in by.items():
        xs.sort()
        to, seen, todo = {}, set(), [xs[0][1]]
        for _, i, s, f in xs:
            to.setdefault(i, []).extend([s, f])
        while todo:
            x = todo.pop()
            if x not in seen:
                seen.add(x)
                todo += [y for y in to.get(x, []) if y and y != "TERMINATE"]
        out |= {(g, x) for x in seen}
    return out


def test_reachable_by_joins(spark):
    """Random graphs of both sizes at once, against a walk."""
    import random

    r = random.Random(8)
    rows = []
    for g in range(12):
        n = r.choice([3, 9, 30])
        for i in range(n):
            point = lambda i=i, n=n: r.choice(["TERMINATE", None, f"s{i + 1}", f"s{r.randrange(n)}", "nowhere"])
            rows.append((g, f"s{i}", i, "run()", point(), point(), 1))
    got = {tuple(x) for x in steps.reachable(graphs_of(spark, rows), short=5).collect()}
    assert got == walk(rows) == {tuple(x) for x in steps.reachable(graphs_of(spark, rows)).collect()}


def test_reachable_in_a_long_chain(spark):
    """100,000 steps one after the other, a way back, and a part that nothing leads to."""
    n = 100_000
    ids = spark.range(n).selectExpr("cast(1 as int) as graph", "concat('s', id) as id", "cast(id as int) as ordinal", "'run()' as script",
        f"case when id = {n // 2} or id = {n - 1} then 'TERMINATE' else concat('s', id + 1) end as on_success", "case when id = 900 then 's70000' when id = 90000 then 's10' else 'TERMINATE' end as on_failure", "1 as max_iterations")
    found = steps.reachable(ids).selectExpr("cast(substr(id, 2) as int) as i").agg({"i": "count", "*": "count"}).first()
    assert found[0] == n // 2 + 1 + 30_000


def test_short_graphs_are_judged_as_by_joins(spark):
    """Random graphs with every fault, gathered as arrays, by joins, and some of both."""
    import random

    r = random.Random(12)
    rows = []
    for g in range(60):
        n = r.choice([1, 2, 4, 7])
        ids = [r.choice([f"s{i}"] * 12 + ["s0", "", None]) for i in range(n)]
        for i in range(n):
            point = lambda i=i, n=n: r.choice(["TERMINATE", None, *[f"s{i + 1}"] * 5, f"s{r.randrange(n)}", "s0", "nowhere", "", "SELF"] if r.random() < 0.3 else ["TERMINATE", f"s{(i + 1) % n}"])
            script = r.choice([None, "", "// PENDING_ANNOTATION"] if r.random() < 0.1 else ["run()", "await $wait(40000)", "return { done: false }"])
            rows.append((g, ids[i], i, script, point(), point(), r.choice([None, 0, 1, 1, 3, 3])))
    table = graphs_of(spark, rows)
    told = lambda frame: sorted((tuple(x) for x in frame.collect()), key=str)
    for of in (steps.verdicts, steps.problems):
        assert told(of(table)) == told(of(table, short=0)) == told(of(table, short=3)), of


def test_short_graphs_meet_in_one_shuffle(spark, tmp_path):
    """No join and one exchange of the steps."""
    path = str(tmp_path / "steps")
    graphs_of(spark, [(1, "a", 0, "run()", None, None, 1)]).write.parquet(path)
    table = spark.read.parquet(path)
    for of in (steps.verdicts, steps.problems):
        plan = of(table)._jdf.queryExecution().sparkPlan().toString()
        assert "Join" not in plan and plan.count("FileScan") == 1


def test_verdicts(spark):
    ok, pend = "return { done: false }", "// PENDING_ANNOTATION"
    graphs = {
        1: [("a", ok, "b", None, 5), ("b", "run()", None, None, 1)], 2: [("a", "", "b", None, 1), ("b", "x", None, None, 0)], 3: [("a", pend, "b", None, 1), ("b", "", None, None, 1)],
        4: [("a", "x", "b", None, 1), ("b", pend, "nowhere", None, 1)], 5: [("a", "x", "nowhere", "SELF", 1)], 6: [("a", "x", None, None, 1), ("b", "x", None, None, 1)],
        7: [("a", "x", "a", None, 1), ("a", "x", None, None, 1)], 8: [("a", "await $wait(20000); await $wait(10001)", "b", None, 1), ("b", "x", None, None, 3), ("c", "$wait(40000)", None, "zz", None)],
        9: [("a", "await $wait(20000); await $wait(10001)", "b", None, 1), ("b", "$wait(99999)", "", None, 3)], 10: [("a", "x", "SELF", "nowhere", 1)], 11: [("a", "x", "", "nowhere", 1), (None, "x", None, None, 1)],
        12: [("a", "x", "b", None, 1), ("b", "x", None, None, 0), ("b", "x", None, None, 1)],
    }
    rows = [(g, i, n, s, a, b, m) for g, xs in graphs.items() for n, (i, s, a, b, m) in enumerate(xs)]
    got = {r["graph"]: (r["valid"], r["step"], r["error"], r["warnings"]) for r in steps.verdicts(graphs_of(spark, rows)).collect()}
    assert got == {
        1: (True, None, None, []), 2: (False, "a", "NO_SCRIPT", []), 3: (False, "b", "NO_SCRIPT", []), 4: (False, "b", "PENDING_ANNOTATION", []), 5: (False, "a", "DANGLING_POINTER", []),
        6: (False, "b", "UNREACHABLE", []), 7: (False, "a", "DUPLICATE_ID", []), 8: (False, "c", "DANGLING_POINTER", []), 9: (True, None, None, ["LONG_DELAY:a", "LONG_DELAY:b", "NO_SIGNAL:b"]),
        10: (False, "a", "SELF_POINTER", []), 11: (False, None, "NO_ID", []), 12: (False, "b", "BAD_ITERATIONS", []),
    }
