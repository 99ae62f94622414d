import random

from pyspark.sql import Row
from pyspark.sql import functions as F

import plain_anchors as anchors
from gleaner.functions import nested
from gleaner.operators import anchors as joined
from gleaner.operators import nodes as N
from gleaner.sources import html as H

CARDS = "".join(f'<div role="article" id="mount_0_{i}"><span class="x1abcd by">a</span><div><i>t</i><button name="more">+</button></div></div>' for i in range(3))
PAGE = f'<body><div id="main"><div class="feed">{CARDS}</div></div><div role="dialog"><button name="more">+</button></div><p id="7 up">x</p></body>'


def test_selectors_of_marks():
    nodes = H.parse(PAGE)
    names = anchors.Namer(nodes)
    made = {e.index: names.selector(e) for e in nodes}
    by = lambda s: [made[e.index] for e in H.select(nodes, s)]
    assert by("#main") == ["#main"] and by(".feed") == ["div.feed"]
    assert by("[role=dialog] button") == ['div[role="dialog"] button[name="more"]']
    # the others can't be told apart by marks, and each is the only one of its tag beside its siblings
    assert by("[role=article] button") == ['#main div.feed div[role="article"] button[name="more"]'] * 3
    assert by("[role=article]") == [f'#main div.feed div[role="article"]:nth-of-type({i})' for i in (1, 2, 3)]
    assert by("p") == ["#\\37 \\ up"]
    assert anchors.path(H.select(nodes, "i")[0]) == '#main > div.feed > div[role="article"] > div > i'


def test_selectors_find_their_elements():
    """In random pages a selector finds its element, and alone unless marks run out."""
    r = random.Random(3)

    def tree(depth: int) -> str:
        tag, mark = r.choice("div span b".split()), r.choice(["", "", f' id="n{r.randrange(40)}"', f' class="c{r.randrange(4)}"', f' role="r{r.randrange(3)}"'])
        return f"<{tag}{mark}>{''.join(tree(depth - 1) for _ in range(r.randrange(4))) if depth else 'x'}</{tag}>"

    for _ in range(20):
        nodes = H.parse(f"<body>{tree(4)}{tree(4)}</body>")
        names = anchors.Namer(nodes)
        for e in nodes[1:]:
            found = H.select(nodes, names.selector(e))
            assert any(x is e for x in found)
            marks = [anchors.Anchor.of(x) for x in anchors.above(e)]
            whole = (*[a for a in reversed(marks) if not a.bare()], anchors.Anchor.of(e))
            assert len(found) == 1 or len(names.matches(whole)) > 1


def test_contexts_and_structures():
    nodes = H.parse(PAGE)
    hit = H.select(nodes, "button")[0]
    one = '<div id="mount_0_0"><span class="by">a</span><div><i>t</i><button data-annotated>+</button></div></div>'
    got = anchors.context(hit)
    assert got.startswith('<div class="feed"><div id="mount_0_0"><span') and one in got.replace("x1abcd ", "")
    assert got.endswith('<div id="mount_0_1">+2 children</div><div id="mount_0_2">+2 children</div></div>')
    deep = H.parse("<body><ul>" + "".join(f"<li>{i}</li>" for i in range(9)) + "<li class='k'><b><i><u><s>1</s></u></i></b></li></ul></body>")
    got = anchors.context(H.select(deep, ".k")[0])
    assert got == '<ul><!-- 7 siblings before --><li>7</li><li>8</li><li class="k" data-annotated><b><i><u>+1 descendants</u></i></b></li></ul>'
    assert anchors.structure(nodes, [".feed"]) == ['<div id="main" [ANNOTATED]><div class="feed" [ANNOTATED]>' + "".join(f'<div id="mount_0_{i}">+2 children</div>' for i in range(3)) + "</div></div>", "<div>+1 children</div>", '<p id="7 up">x</p>']
    assert anchors.structure(H.parse(""), ["p"]) == [] and anchors.context(H.parse("<body>t</body>")[0], 3).startswith("<body data-annotated>")


def test_null_pages_and_selectors_that_match_nothing(spark):
    rows = spark.createDataFrame([(1, None), (2, ""), (3, "<p>x</p>")], "page_id int, html string")
    table = N.parsed(rows, ["page_id"])
    assert [r["page_id"] for r in joined.named(table, "p").collect()] == [3]
    got = table.told(joined.surroundings(table, ["a", "p"]), "contexts").orderBy("page_id").collect()
    assert [r["contexts"] for r in got] == [[], [], ["<p data-annotated>x</p>"]]


def random_pages(n: int) -> list[str]:
    r = random.Random(11)

    def tree(depth: int) -> str:
        if r.random() < 0.15:
            return r.choice(["text", " a\nlonger text than sixty letters, so that it has to be cut somewhere ", "&amp;\u00a0<i>"])
        tag = r.choice("div span b ul li p svg section".split())
        mark = r.choice(["", "", f' id="n{r.randrange(30)}"', ' id="mount_0_x"', f' class="c{r.randrange(4)} xab12 k  w z"', f' role="r{r.randrange(3)}" name="a b"', ' placeholder="p"', ' id="7 up"', ' class="-1 a.b"'])
        return f"<{tag}{mark}>{''.join(tree(depth - 1) for _ in range(r.randrange(5))) if depth else 'x'}</{tag}>"

    deep = "<div class='d'>" * 14 + "<b>end</b>" + "</div>" * 14
    return [f"<html><body>{tree(5)}{tree(4)}t{tree(5)}</body></html>" for _ in range(n)] + [PAGE, deep, f"<body>{deep}<p></p></body>", "<div><b>x</b></div>", ""]


def test_joins_give_what_trees_give(spark):
    """Selectors, paths, contexts and structures of random pages."""
    pages = random_pages(12)
    table = N.parsed(spark.createDataFrame(list(enumerate(pages)), "page_id int, html string"), ["page_id"])
    chosen = "b, li, [role], .c1 span, div"
    got = {}
    for r in joined.named(table, chosen).collect():
        got.setdefault(r["page_id"], []).append((r["ordinal"], r["tag"], r["selector"], r["path"]))
    for i, page in enumerate(pages):
        nodes = H.parse(page)
        names = anchors.Namer(nodes)
        want = [(n, e.tag, names.selector(e), anchors.path(e)) for n, e in enumerate(H.select(nodes, chosen))]
        assert sorted(got.get(i, [])) == want, page
    selectors = ["b", "li", "svg span", "[name]", "section > *"]
    found = {r["page_id"]: r for r in table.told(joined.surroundings(table, selectors), "contexts", "structure").collect()}
    assert len(found) == len(pages)
    for i, page in enumerate(pages):
        nodes = H.parse(page)
        hits = [H.select(nodes, s, first=True) for s in selectors]
        assert found[i]["contexts"] == [anchors.context(h[0]) for h in hits if h], page
        assert found[i]["structure"] == anchors.structure(nodes, selectors), page


def test_selectors_as_joins(spark):
    pages = random_pages(12)
    table = N.parsed(spark.createDataFrame(list(enumerate(pages)), "page_id int, html string"), ["page_id"])
    for selector in ("div", "#n3", ".c1.k", "div span", "div > b", "b ~ span", "b + span", "li:nth-of-type(2)", "p:nth-child(1)", "div:has(b)", "div:has(> span)", '[role="r1"], .c2', "[class^=c] > *", "[name='A b' i]", "[class~=w]"):
        got = {}
        for r in table.told(N.matching(table, selector), "start", "tag").collect():
            got.setdefault(r["page_id"], []).append((r["start"], r["tag"]))
        for i, page in enumerate(pages):
            assert [t for _, t in sorted(got.get(i, []))] == [e.tag for e in H.select(H.parse(page), selector)], (selector, page)


def test_full_html(spark):
    page = '<body><div id="a" class="b" title="&quot;x&quot; &amp;">t &lt;<br><script>a<b</script><p>one<p>two</div></body>'
    table = N.parsed(spark.createDataFrame([(1, page), (2, None)], "page_id int, html string"), ["page_id"])
    rows = {(r["page_id"], r["selector"]): r for r in N.full_html(table, ["div", "p:first", "i", "p"]).collect()}
    r = rows[1, "div"]
    assert r["found"] and r["outer_html"] == '<div id="a" class="b" title="&quot;x&quot; &amp;">t &lt;<br><script>a<b</script><p>one</p><p>two</p></div>'
    assert r["inner_text"] == "t <a<bonetwo" and [(a["name"], a["value"]) for a in r["attributes"]] == [("id", "a"), ("class", "b"), ("title", '"x" &')]
    assert rows[1, "p"]["outer_html"] == "<p>one</p>" and rows[1, "p"]["attributes"] == []
    assert not rows[1, "i"]["found"] and rows[1, "i"]["error"] is None and rows[1, "p:first"]["error"].startswith("INVALID_SELECTOR")
    assert [rows[2, s]["found"] for s in ("div", "p")] == [False, False]


def test_hidden_by_what_is_above(spark):
    page = '<body><div style="DISPLAY : none"><p>a</p><i>b</i></div><div><i hidden>c</i><u style="opacity:0.5">d</u><b>e</b></div></body>'
    table = N.parsed(spark.createDataFrame([(1, page), (2, "<i>x</i>")], "page_id int, html string"), ["page_id"])
    got = {r["page_id"]: r.asDict() for r in N.existing(table, {"p": "p", "i": "i", "u": "u", "b": "b", "second": "div + div > b"}).collect()}
    assert got[1] == {"page_id": 1, "p": False, "i": False, "u": True, "b": True, "second": True}
    assert got[2] == {"page_id": 2, "p": False, "i": True, "u": False, "b": False, "second": False}


def test_containment_by_intervals(spark):
    """Against every pair of elements of random pages."""
    pages = random_pages(10)
    table = N.parsed(spark.createDataFrame(list(enumerate(pages)), "page_id int, html string"), ["page_id"])
    got = {}
    for r in table.told(N.contained(N.matching(table, "div, b, li")), "ordinal", "holder").collect():
        got.setdefault(r["page_id"], set()).add((r["ordinal"], r["holder"]))
    for i, page in enumerate(pages):
        found = H.select(H.parse(page), "div, b, li")
        want = set()
        for n, e in enumerate(found):
            holders = [m for m, x in enumerate(found) if x is not e and x.index < e.index < x.end]
            want |= {(n, min(holders))} if holders else set()
        assert got.get(i, set()) == want


def test_nested_results(spark):
    data = Row(steps=[Row(snapshot="s", out=[1] * 30)] * 5, items=[Row(a="x" * 300, sourcePageId="p")] * 4, none=None)
    rows = spark.createDataFrame([(1, data), (2, None)], "id int, r struct<steps:array<struct<snapshot:string,out:array<int>>>,items:array<struct<a:string,sourcePageId:string>>,none:array<string>>")
    kind = rows.schema["r"].dataType
    small = nested.pruned(F.col("r"), kind, ("snapshot", "sourcePageId"), 200)
    got = rows.select("id", small.alias("r")).orderBy("id").collect()
    assert got[1]["r"] is None and got[0]["r"].steps[0].asDict() == {"out": [1] * 30} and got[0]["r"]["items"][0].asDict() == {"a": "[TRUNCATED 300 chars] " + "x" * 170}
    got = rows.select("id", nested.sampled(F.col("r"), kind).alias("r")).orderBy("id").collect()
    r = got[0]["r"]
    assert got[1]["r"] is None and len(r.steps) == 5 and len(r.steps[0].out) == 20 and r.steps[0].out_omitted == 10
    assert len(r["items"]) == 3 and r.items_omitted == 1 and r["none"] is None


def test_elements_are_matched_once(spark, monkeypatch):
    """What all rounds start from is written once."""
    names, kept = [], joined.store.kept
    monkeypatch.setattr(joined.store, "kept", lambda df, name: names.append(name) or kept(df, name))
    table = N.parsed(spark.createDataFrame([(1, PAGE)], "i int, html string"), ["i"])
    assert joined.named(table, "button").count() == 4 and "found" in names
