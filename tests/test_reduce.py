import json

import plain_reduce
import pyarrow as pa
from pyspark.sql import functions as F

from gleaner.functions import answers
from gleaner.operators import anchors, candidates, nodes, reduce, selectors
from gleaner.plans import schema
from gleaner.sources import html as H
from gleaner.streaming import feeds

PAGE = '<html><head><title>T</title><script>x</script></head><body><nav>n</nav><div hidden>h</div><!-- c --><div class="card css-1x a1b2c3d4" style="a" onclick="b" title="{v}"><p>{t}</p></div></body></html>'


def test_snapshot(spark):
    page = PAGE.format(v="v" * 300, t="word " * 100)
    table = nodes.parsed(spark.createDataFrame([(0, page), (1, None)], "i int, html string"), ["i"])
    s = table.told(reduce.snapshots(table), "title", "html", "structure").orderBy("i").collect()
    assert s[0]["title"] == "T" and s[1]["html"] == ""
    for gone in ("<script", "<nav", "hidden", "<!--", "style", "onclick", "css-1x", "a1b2c3d4", "v" * 201):
        assert gone not in s[0]["html"]
    assert 'class="card"' in s[0]["html"] and "v" * 200 + "..." in s[0]["html"] and len(s[0]["html"]) < 700
    assert s[0]["structure"].startswith("<html>") and "<nav>n</nav>" in s[0]["structure"]


def test_wrappers_give_way():
    tree = H.parse('<body><div><div><p class="a">x</p></div></div><div id="k"><b>y</b></div></body>')
    plain_reduce.unwrapped(tree)
    assert tree[0].inner() == '<p class="a">x</p><div id="k"><b>y</b></div>'


def test_snapshots_give_what_trees_give(spark):
    """Every part of random pages, and wrappers, against the trees."""
    import random

    r = random.Random(21)

    def tree(depth):
        if r.random() < 0.25:
            return r.choice(["text ", " a\n \n b ", "&amp;\u00a0<i>x</i>", "w" * 230, " 2024-01-02 " + "y" * 300, "> <"])
        tag = r.choice("div div div span p ul li a nav svg img section form iframe".split())
        mark = r.choice(["", "", "", f' id="n{r.randrange(9)}" name="q"', ' class="css-9 card sidebar-x" style="a"', ' class="k css-1a l m" onclick="x" href="h"', ' hidden', ' style="display:none"', f' title="{"v" * 210}"', ' name="a&quot;b"', ' class="css-1"'])
        return f"<{tag}{mark}>{''.join(tree(depth - 1) for _ in range(r.randrange(1, 4))) if depth else 'x'}</{tag}>"

    deep = "<div>" * 30 + "x" + "</div>" * 30
    pages = [f"<html><head><title> t {i} </title><style>a<b</style></head><body>{tree(5)} {tree(5)}<!-- c -->\n\n{tree(4)}</body></html>" for i in range(25)] + ["", f"<body>{deep}</body>", "<div>a</div>t<p>b</p>", "plain"]
    table = nodes.parsed(spark.createDataFrame(list(enumerate(pages)), "i int, html string"), ["i"])
    got = {x["i"]: x.asDict() for x in table.told(reduce.snapshots(table, 900, 300, 200), "title", "html", "text", "structure", "summary").collect()}
    for i, page in enumerate(pages):
        want = plain_reduce.snapshot(page, 900, 300, 200)
        for part in want:
            assert got[i][part] == want[part], (i, part, page)
    bare = {x["i"]: x["html"] for x in table.told(reduce.html(reduce.unwrapped(table.rows.where("tag is not null or parent >= 0"))), "html").collect()}
    for i, page in enumerate(pages[:25]):
        tree_ = H.parse(page)
        root = tree_[0].parent
        plain_reduce.unwrapped(tree_)
        assert bare[i] == plain_reduce._squeezed("".join(c.outer() for c in root.children if not isinstance(c, str))), page


def test_tiers(spark):
    page = PAGE.format(v="v", t="text")
    modes = lambda budget, *s: anchors.tiered(spark.createDataFrame([(page,)], "html string"), [], list(s), budget).first()["mode"]
    table = nodes.parsed(spark.createDataFrame([(page,)], "html string"), [])
    full = len(reduce.snapshots(table).first()["html"])
    assert modes(full) == "full" and modes(60, "p") == "annotated" and modes(10, "p") == "needs_subtree_selection"


def test_leaf_selectors_and_strength(spark):
    page = '<div><a href="/x" id="i">link</a><time>now</time><span class="n m">12K</span><b data-k="v">abc</b><i>5 min ago</i></div>'
    rows = spark.createDataFrame([(1, page)], "page_id int, html string")
    found = candidates.field_candidates(rows, ["page_id"], ["profileUrl", "postTime", "likes", "name"]).collect()
    by = {(r["field"], r["place"]): (r["selector"], r["strength"]) for r in found}
    assert by["profileUrl", 1] == ("#i", 3) and by["likes", 1] == ("span.n", 3)
    assert by["postTime", 1][0].startswith("div:nth-of-type(1) > time") and by["postTime", 2][1] == 3
    assert by["name", 1] == ("#i", 2) and ("profileUrl", 2) not in by


def test_lenient_json(spark):
    texts = ['{"a": 1}', "{a: 'x', // y\n}", '{"u": "http://a//b", "v": "it\'s {k: 1}"}', "[1,,2,]", '{"a": 1\n "b": 2}', "nothing", "", None]
    got = [r[0] for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(answers.lenient_json("t")).collect()]
    assert [json.loads(x) if x else None for x in got] == [{"a": 1}, {"a": "x"}, {"u": "http://a//b", "v": "it's {k: 1}"}, [1, 2], {"a": 1, "b": 2}, None, None, None]


def test_predecessors(spark):
    pairs = [("[1,2,3,4,5]", "[1,2,3,4,9]", True), ("[1,2]", "[1,3]", False), ("{}", '{"a":1}', True), ('{"a":1}', '{"a":2}', False), ("1", "1", True), ("1", "true", False)]
    got = spark.createDataFrame(pairs, "a string, b string, w boolean").select(answers.predecessor("a", "b").alias("g"), "w").collect()
    assert all(r["g"] is r["w"] for r in got)


def test_predecessors_of_nested_values(spark):
    """Random values against the rule as a recursion; numbers are one kind, truth values another."""
    import random

    r = random.Random(6)

    def value(depth):
        kind = r.randrange(7 if depth else 5)
        if kind == 5:
            return [value(depth - 1) for _ in range(r.randrange(7))]
        if kind == 6:
            return {r.choice("abc"): value(depth - 1) for _ in range(r.randrange(3))}
        return r.choice([1, 1.0, 2, True, False, None, "1", "x", 0, ""])

    def changed(x):
        if r.random() < 0.05:
            return value(1)
        if isinstance(x, list):
            return [changed(v) for v in x]
        if isinstance(x, dict):
            return {k: changed(v) for k, v in x.items()} | ({"z": 1} if r.random() < 0.3 else {})
        return float(x) if type(x) is int else x

    def before(x, y):
        if isinstance(x, list):
            return isinstance(y, list) and len(x) == len(y) and (not x or 5 * sum(before(a, b) for a, b in zip(x, y, strict=True)) >= 4 * len(x))
        if isinstance(x, dict):
            return isinstance(y, dict) and all(k in y and before(v, y[k]) for k, v in x.items())
        return isinstance(x, bool) == isinstance(y, bool) and not isinstance(y, list | dict) and (x is None) == (y is None) and x == y

    values = [value(3) for _ in range(300)]
    pairs = [(json.dumps(x), json.dumps(y), before(x, y)) for x in values for y in (changed(x), value(2))] + [("1", "1.0", True), ("[1, 0]", "[1.0, false]", False), ("1", "true", False)]
    got = spark.createDataFrame(pairs, "a string, b string, w boolean").select("a", "b", answers.predecessor("a", "b").alias("g"), "w").collect()
    assert all(x["g"] is x["w"] for x in got) and 100 < sum(x["w"] for x in got) < 500


def test_leaf_selectors(spark):
    """By id, class or data attribute; else by up to three places below the body."""
    page = '<html><head><title>t</title></head><body><p>a</p><ul><li><a id="1 b">x</a></li><li><b class="  k l">y</b><i data-z="" data-a>z</i><u class=" ">w</u></li></ul><p>b</p></body></html>'
    rows = spark.createDataFrame([(1, page), (2, "<p>x</p>"), (3, None)], "page_id int, html string")
    table = nodes.parsed(rows, ["page_id"])
    got = {}
    for r in table.told(candidates.leaves(table), "ordinal", "text", "selector").orderBy("page_id", "ordinal").collect():
        got.setdefault(r["page_id"], []).append((r["text"], r["selector"]))
    assert got[1] == [("t", "html > head:nth-of-type(1) > title:nth-of-type(1)"), ("a", "html > body:nth-of-type(1) > p:nth-of-type(1)"[len("html > body:nth-of-type(1) > "):]), ("x", "#\\31 \\ b"), ("y", "ul:nth-of-type(1) > li:nth-of-type(2) > b:nth-of-type(1)"), ("z", "i[data-z]"), ("w", "ul:nth-of-type(1) > li:nth-of-type(2) > u:nth-of-type(1)"), ("b", "p:nth-of-type(2)")]
    assert got[2] == [("x", "p:nth-of-type(1)")] and 3 not in got


def test_schema():
    s = {"type": "object", "required": ["posts"], "properties": {"posts": {"type": "array", "items": {"type": "object", "properties": {"a": {"type": "string"}, "b": {"type": ["object", "null"], "properties": {"c": {"type": "number"}}}}}}, "n": {"type": "integer", "examples": [3]}}}
    assert schema.leaf_paths(s) == ["posts.a", "posts.b.c", "n"] and schema.collections(s) == ["posts"]
    assert schema.spark_type(s).simpleString() == "struct<posts:array<struct<a:string,b:struct<c:double>>>,n:bigint>"
    assert schema.example(s) == {"posts": [], "n": 3}
    assert "| posts | array | yes |" in schema.document({"name": "x", "inputSchema": {}, "outputSchema": s})


def test_list_patterns_and_clusters(spark):
    rows = [("posts.author", f'div[role="article"]:nth-of-type({i}) > b') for i in (1, 2)] + [("posts.body", f'div[role="article"]:nth-of-type({i}) > i.x1abcd{i}') for i in (1, 2)] + [("posts.bad", 'div[role="article"]:nth-of-type(1) > u'), ("posts.bad", 'div[role="article"]:nth-of-type(2) > s')]
    found = selectors.list_patterns(spark.createDataFrame(rows, "output_field string, selector string")).collect()
    assert {(r["array"], r["container"], r["field"]) for r in found} == {("posts", 'div[role="article"]', "author"), ("posts", 'div[role="article"]', "body")}


def test_popovers(spark):
    rows = [(1, 1, True, 60, 60, 10, False, "scan", True, 5, 90_000), (1, 2, True, 60, 60, 10, True, "added", False, 1, 90_000), (1, 3, False, 60, 60, 1, False, "added", True, 9, 90_000), (2, 4, True, 10, 60, 1, False, "scan", True, 9, 90_000)]
    names = "k int, popover_id int, visible boolean, width int, height int, distance int, baseline boolean, source string, absolute boolean, z_index int, viewport_area int"
    assert [tuple(r) for r in candidates.popovers(spark.createDataFrame(rows, names), ["k"]).collect()] == [(1, 2)]


def test_streams_equal_batch(spark, tmp_path):
    import datetime

    at = lambda s: datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=s)
    rows = [("a", i, v, at(i)) for i, v in enumerate("xxyyyyz")] + [("b", i, v, at(i)) for i, v in enumerate("pq")]
    spark.createDataFrame(rows, "k string, n long, v string, ts timestamp").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema("k string, n long, v string, ts timestamp").parquet(str(tmp_path / "in"))
    settled = feeds.drained(feeds.settled(stream(), "k", "v", "n", 3), str(tmp_path / "o1"), str(tmp_path / "c1"))
    assert [tuple(r) for r in settled.collect()] == [("a", 5)]
    seen = feeds.drained(feeds.first_seen(stream(), ["k", "v"], "ts", "1 hour"), str(tmp_path / "o2"), str(tmp_path / "c2"))
    assert sorted((r["k"], r["v"]) for r in seen.collect()) == [("a", "x"), ("a", "y"), ("a", "z"), ("b", "p"), ("b", "q")]


def test_segments_keep_brackets(spark):
    got = spark.createDataFrame([("div[a='x > y'] > li:has(> b) a",)], "s string").select(selectors.segments("s")).first()[0]
    assert [(r["seg"], r["child"]) for r in got] == [("div[a='x > y']", False), ("li:has(> b)", True), ("a", False)]
    assert pa is not None and F is not None


def test_trim_looks_at_the_ends(spark):
    """Every white space of browsers, nothing else, and nothing within; not by a pattern over the whole text."""
    from gleaner.functions import text as X

    odd = ["", " ", "a", " a b ", "\u00a0\ufeffa\u3000b\u2028\n", "a \x85", "\x00 a", "\u200b a", "\U0001f600 ", "\t\n\v\f\r\u1680\u2000\u200a\u202f\u205fé", None]
    frame = spark.createDataFrame([(i, x) for i, x in enumerate(odd)], "i int, x string").select("i", X.trim("x").alias("t"))
    white = "\t\n\v\f\r \xa0\u1680\u2000\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
    assert dict(map(tuple, frame.collect())) == {i: x and x.strip(white) for i, x in enumerate(odd)}
    assert "regexp" not in frame._jdf.queryExecution().optimizedPlan().toString()


def test_the_whole_page_alone(spark):
    from gleaner.operators import nodes, reduce

    pages = spark.createDataFrame([(1, "<body><nav>n</nav><p class='a'>x</p></body>"), (2, None), (3, "t"), (4, "<body>" + "<p>é</p>" * 30 + "</body>")], "i int, html string")
    table = nodes.parsed(pages, ["i"])
    for cap in (50, 80_000):
        assert sorted(reduce.whole(table, cap).collect()) == sorted(reduce.snapshots(table, cap).select("page", "html").collect())
