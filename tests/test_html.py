import pytest

from gleaner.operators.extract import Read, Records
from gleaner.sources import html as H

POSTS = '<div class="post"><span class="author">Alice</span><p class="body">Hi</p></div><div class="post">{a}<p class="body">Yo</p></div>'
FIELDS = {"author": ".author", "body": ".body"}


def read(html, spec):
    return spec.read(H.parse(html))


def test_fields_stay_aligned_when_one_is_missing():
    rows = read(POSTS.format(a=""), Records(".post", FIELDS))
    assert [(r["author"], r["body"]) for r in rows] == [("Alice", "Hi"), (None, "Yo")]


def test_strict_and_empty():
    assert read("<p>x</p>", Records(".post", FIELDS)) == []
    with pytest.raises(ValueError, match="no containers matched"):
        read("<p>x</p>", Records(".post", FIELDS, strict=True))
    with pytest.raises(ValueError):
        Records(".post", {})


def test_multi_gives_empty_arrays_and_the_container_itself():
    rows = read(POSTS.format(a=""), Records(".post", {"author": ".author", "own": ("", "outerHTML")}, multi=True))
    assert rows[1]["author"] == [] and len(rows[0]["own"]) == 1 and rows[0]["own"][0].startswith('<div class="post">')


def test_attribute_missing_against_no_match():
    rows = read('<li><a>x</a></li><li></li>', Records("li", {"href": ("a", "href")}, counts=True))
    assert [(r["href"], r["n_href"]) for r in rows] == [(None, 1), (None, 0)]


def test_positions_generalise():
    page = "".join(f'<div role="article"><b>A{i}</b><i>B{i}</i></div>' for i in (1, 2, 3))
    rows = read(page, Records('div[role="article"]', {"a": "b", "b": "i"}))
    assert [(r["a"], r["b"]) for r in rows] == [("A1", "B1"), ("A2", "B2"), ("A3", "B3")]


def test_ancestors_of_the_container_may_match_leading_parts():
    rows = read('<ul class="x"><li><a>1</a></li></ul><ul><li><a>2</a></li></ul>', Records("li", {"a": "ul.x a"}))
    assert [r["a"] for r in rows] == ["1", None]


@pytest.mark.parametrize(
    ("selector", "expected"),
    [("li:nth-of-type(2)", ["b"]), ("li[data-x]", ["a"]), ('li[data-x="Q" i]', ["a"]), ("ul > li:has(> b)", ["b"]), ("li ~ li", ["b"]), ("b, p", ["b", "t"]), ("#i", ["t"]), ("[id^='i']", ["t"])],
)
def test_selectors(selector, expected):
    nodes = H.parse('<ul><li data-x="q">a<li><b>b</b></ul><p id="i">t')
    assert [e.text() for e in H.select(nodes, selector)] == expected


def test_pages_with_traps():
    nodes = H.parse('<script>var t="</p>";</script><p><b>one<br><p>two')
    assert [e.text() for e in H.select(nodes, "p")] == ["one", "two"]
    assert Read("[[bad", "count").read(nodes) == 0
    assert Read("p", "exists").read(H.parse('<p style="display: none">x</p>')) is False
    assert H.parse("") == []
