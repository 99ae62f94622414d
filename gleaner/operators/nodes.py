"""A page as a table of nodes, and selectors as joins over it.

Each element and each text of a page is a row with the interval of its descendants: `start`
counts nodes in document order, `end` is one past the last node below, so that a stands
above b where a.start < b.start < a.end. Only the parser is Python; it writes the table once,
and everything that asks about ancestors, siblings or uniqueness is a join, a window or a
count within a page. No page is larger than what its html makes of it, and pages are what
shuffles deal out.

A null page has no nodes. Rows of pages that are equal in `keep` stay apart by `page`, a
number given when the table is written.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.functions.text import BLANKS
from gleaner.sources import html as H
from gleaner.sources import store

NODE = "start int, end int, parent int, depth int, tag string, attrs map<string,string>, text string"
#: Pages that a task parses before it hands them on.
PAGES = 32
_ATTRS = pa.map_(pa.string(), pa.string())
_KINDS = (pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.string(), _ATTRS, pa.string())


@dataclass(frozen=True)
class Pages:
    """`pages` (page, and what was kept) and `rows` (page, and the nodes' columns); tag is
    null for texts, parent -1 for what stands at the top."""

    pages: DataFrame
    rows: DataFrame
    keep: tuple[str, ...]

    def elements(self) -> DataFrame:
        return self.rows.where("tag is not null")

    def told(self, found: DataFrame, *columns: str) -> DataFrame:
        """Rows by page with what was kept of it in the page's place."""
        return found.join(self.pages, "page").select(*self.keep, *columns)


def _nodes(html: str | None) -> list[tuple]:
    order = H.parse(html or "")
    if not order:
        return []
    rows: list[list] = []
    todo: list[tuple] = [(c, -1, 0) for c in reversed(order[0].parent.children)]
    while todo:
        x, parent, depth = todo.pop()
        if isinstance(x, int):
            rows[x][1] = len(rows)
            continue
        at = len(rows)
        if isinstance(x, str):
            rows.append([at, at + 1, parent, depth, None, None, x])
            continue
        rows.append([at, 0, parent, depth, x.tag, list(x.attrs.items()), None])
        todo.append((at, 0, 0))
        todo.extend((c, at, depth + 1) for c in reversed(x.children))
    return rows


def parsed(pages: DataFrame, keep: list[str], html: Column | str = "html") -> Pages:
    """The node table of pages, written to the shared folder."""
    source = pages.select(F.monotonically_increasing_id().alias("page"), *keep, (F.col(html) if isinstance(html, str) else html).alias("_html"))
    fields = [f"{f.name} {f.dataType.simpleString()}" for f in source.select("page", *keep).schema]
    names = ["start", "end", "parent", "depth", "tag", "attrs", "text"]
    kind = pa.struct(list(zip(names, _KINDS, strict=True)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, PAGES):
                part = batch.slice(lo, PAGES)
                found = [_nodes(x) for x in part.column("_html").to_pylist()]
                flat = [row for rows in found for row in rows]
                columns = [pa.array([row[i] for row in flat], k) for i, k in enumerate(_KINDS)]
                bounds = [0]
                for rows in found:
                    bounds.append(bounds[-1] + len(rows))
                lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.StructArray.from_arrays(columns, fields=list(kind)))
                yield pa.record_batch([*(part.column(c) for c in ("page", *keep)), lists], ["page", *keep, "nodes"])

    typed = ",".join(f"{n.split(' ', 1)[0]}:{n.split(' ', 1)[1]}" for n in NODE.split(", "))
    made = store.kept(source.mapInArrow(run, f"{', '.join(fields)}, nodes array<struct<{typed}>>"), "nodes")
    return Pages(made.select("page", *keep), made.select("page", F.inline("nodes")), tuple(keep))


# --- selectors -----------------------------------------------------------------------


def siblings(rows: DataFrame) -> DataFrame:
    """Elements with their place among the elements of their parent and among those of
    their tag, both from 1, and how many of their tag there are."""
    own = Window.partitionBy("page", "parent").orderBy("start")
    same = Window.partitionBy("page", "parent", "tag")
    elements = rows.where("tag is not null").withColumn("child", F.row_number().over(own))
    return elements.withColumn("of_type", F.row_number().over(same.orderBy("start"))).withColumn("n_of_type", F.count(F.lit(1)).over(same))


def tokens(value: Column) -> Column:
    """Words of an attribute."""
    return F.filter(F.split(F.coalesce(value, F.lit("")), f"[{BLANKS}]+"), lambda x: x != "")


def _test(g: dict) -> Column:
    """What one simple selector says of an element."""
    if g["tag"]:
        return F.lit(True) if g["tag"] == "*" else F.col("tag") == g["tag"].lower()
    if g["id"]:
        return F.col("attrs")["id"] == g["id"]
    if g["cls"]:
        return F.array_contains(tokens(F.col("attrs")["class"]), g["cls"])
    if g["nth"]:
        return F.col("of_type" if g["nth"] == "of-type" else "child") == int(g["n"])
    fold = F.lower if g["flag"] else (lambda c: c)
    own = fold(F.col("attrs")[g["attr"].lower()])
    value = next((g[k] for k in ("dq", "sq", "bare") if g[k] is not None), "")
    want = F.lit(value.lower() if g["flag"] else value)
    tests = {
        None: lambda: own.isNotNull(), "=": lambda: own == want, "*=": lambda: own.contains(want) & F.lit(value != ""),
        "^=": lambda: own.startswith(want) & F.lit(value != ""), "$=": lambda: own.endswith(want) & F.lit(value != ""),
        "~=": lambda: F.array_contains(tokens(own), want), "|=": lambda: (own == want) | own.startswith(F.concat(want, F.lit("-"))),
    }
    return tests[g["op"]]()


def _compound(elements: DataFrame, text: str) -> DataFrame:
    tests, inner, at = [], [], 0
    while at < len(text):
        m = H._SIMPLE.match(text, at)
        at, g = m.end(), m.groupdict()
        if g["has"]:
            inner.append((g["has"].strip(), re.match(r":has\(\s*>", m.group()) is not None))
        else:
            tests.append(F.coalesce(_test(g), F.lit(False)))
    out = elements.where(reduce(lambda a, b: a & b, tests, F.lit(True)))
    for selector, direct in inner:
        held = _matching(elements, selector).select(F.col("page").alias("_page"), F.col("start").alias("_start"), F.col("parent").alias("_parent"))
        below = F.col("_parent") == F.col("start") if direct else (F.col("_start") > F.col("start")) & (F.col("_start") < F.col("end"))
        out = out.join(held, (F.col("page") == F.col("_page")) & below, "left_semi")
    return out


def says(selector: str) -> Column:
    """A selector of what an element has itself (tag, id, classes, attributes) as a condition on
    its row; a comma list is any of them."""
    ways = []
    for one in H._commas(selector):
        text, tests, at = one.strip(), [], 0
        while at < len(text):
            m = H._SIMPLE.match(text, at)
            if m is None or m["nth"] or m["has"]:
                raise H.Invalid(text)
            tests.append(F.coalesce(_test(m.groupdict()), F.lit(False)))
            at = m.end()
        ways.append(reduce(lambda a, b: a & b, tests))
    return reduce(lambda a, b: a | b, ways)


_BEFORE = {
    " ": lambda: (F.col("_start") < F.col("start")) & (F.col("start") < F.col("_end")),
    ">": lambda: F.col("_start") == F.col("parent"),
    "~": lambda: (F.col("_parent") == F.col("parent")) & (F.col("_start") < F.col("start")),
    "+": lambda: (F.col("_parent") == F.col("parent")) & (F.col("_child") == F.col("child") - 1),
}


def _matching(elements: DataFrame, selector: str) -> DataFrame:
    ways = []
    for one in H._commas(selector):
        found = None
        for joint, text in H._split(one):
            here = _compound(elements, text)
            if found is not None:
                above = found.select(*[F.col(c).alias(f"_{c}") for c in ("page", "start", "end", "parent", "child")])
                here = here.join(above, (F.col("page") == F.col("_page")) & _BEFORE[joint](), "left_semi")
            found = here
        ways.append(found)
    if len(ways) == 1:
        return ways[0]
    keys = reduce(lambda a, b: a.union(b), [w.select("page", "start") for w in ways]).distinct()
    return elements.join(keys, ["page", "start"], "left_semi")


def matching(table: Pages, selector: str) -> DataFrame:
    """Elements that a selector matches, with `siblings`' columns; raises Invalid. A chain is
    a semi-join for each of its links: what stands above by intervals, parents and
    neighbours by equality."""
    H.compiled(selector)
    return _matching(siblings(table.rows), selector)


def first(found: DataFrame) -> DataFrame:
    """The first element of each page."""
    return found.join(found.groupBy("page").agg(F.min("start").alias("start")), ["page", "start"], "left_semi")


def hides(attrs: Column | str = "attrs") -> Column:
    """Whether an element hides itself by what static html says."""
    a = F.col(attrs) if isinstance(attrs, str) else attrs
    style = F.regexp_replace(F.lower(F.coalesce(a["style"], F.lit(""))), r"\s", "")
    said = style.contains("display:none") | style.contains("visibility:hidden") | style.rlike(r"opacity:0(;|$|\.0+(;|$))")
    return F.coalesce(a["hidden"].isNotNull(), F.lit(False)) | said


def shown(table: Pages, found: DataFrame) -> DataFrame:
    """Those of the elements that neither hide themselves nor stand in one that does."""
    hidden = table.elements().where(hides()).select(F.col("page").alias("_page"), F.col("start").alias("_start"), F.col("end").alias("_end"))
    within = (F.col("page") == F.col("_page")) & (F.col("_start") <= F.col("start")) & (F.col("start") < F.col("_end"))
    return found.join(hidden, within, "left_anti")


def existing(table: Pages, selectors: dict[str, str]) -> DataFrame:
    """(kept columns, name...): whether the first element of each selector is there to be seen."""
    out = table.pages
    for name, selector in selectors.items():
        seen = shown(table, first(matching(table, selector))).select("page", F.lit(True).alias(name))
        out = out.join(seen, "page", "left").withColumn(name, F.coalesce(name, F.lit(False)))
    return out.select(*table.keep, *selectors)


def texts(table: Pages, found: DataFrame) -> DataFrame:
    """(page, start, text) of elements: all text below, in order."""
    inner = table.rows.where("tag is null").select(F.col("page").alias("_page"), F.col("start").alias("_at"), "text")
    met = found.select("page", "start", "end").join(inner, (F.col("page") == F.col("_page")) & (F.col("start") < F.col("_at")) & (F.col("_at") < F.col("end")))
    return met.groupBy("page", "start").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_at", "text"))), lambda x: x["text"]), "").alias("text"))


# --- frames --------------------------------------------------------------------------


def framing(table: Pages) -> DataFrame:
    """rows with `frame`: the start of the nearest frame that a node stands in, -1 for none."""
    frames = table.elements().where("tag = 'iframe'").select(F.col("page").alias("_page"), F.col("start").alias("_start"), F.col("end").alias("_end"))
    within = (F.col("page") == F.col("_page")) & (F.col("_start") < F.col("start")) & (F.col("start") < F.col("_end"))
    near = table.rows.select("page", "start").join(frames, within).groupBy("page", "start").agg(F.max("_start").alias("frame"))
    return table.rows.join(near, ["page", "start"], "left").withColumn("frame", F.coalesce("frame", F.lit(-1)))


def resolved(table: Pages, selector: str) -> DataFrame:
    """(page, start, end, tag, frame): the first element of a selector that may lead through
    frames (iframe#a::iframe.b::p): each frame is the first that fits in the one before, and
    what is asked for is looked for in the last alone. Without frames: the page itself,
    else the first frame right in it that has such an element. Raises Invalid."""
    parts = selector.split("::")
    n = next((i for i, p in enumerate(parts) if not p.startswith("iframe") or p == "iframe"), len(parts))
    chain, inner = parts[:n], "::".join(parts[n:])
    for one in (*chain, inner):
        H.compiled(one)
    rows = store.kept(framing(table), "framed")
    scope = table.pages.select("page", F.lit(-1).alias("frame"))
    of = lambda scope, css: _matching(siblings(rows.join(scope, ["page", "frame"], "left_semi")), css)
    for css in chain:
        scope = first(of(scope, css)).select("page", F.col("start").alias("frame"))
    found = of(scope, inner)
    if not chain:
        outer = rows.where("tag = 'iframe' and frame = -1").select("page", F.col("start").alias("frame"))
        found = found.unionByName(of(outer, inner))
        # the page's own elements come first, then those of frames in their order
        best = found.groupBy("page").agg(F.min(F.struct("frame", "start")).alias("b")).select("page", "b.frame", "b.start")
        return found.join(best, ["page", "frame", "start"], "left_semi").select("page", "start", "end", "tag", "frame")
    return first(found).select("page", "start", "end", "tag", "frame")


# --- writing nodes out ---------------------------------------------------------------


def opening(start: Column | str = "start") -> Column:
    """Where a node's own text goes among all others of its page, for `written`."""
    return F.struct(F.col(start).alias("at") if isinstance(start, str) else start.alias("at"), F.lit(1).alias("kind"), F.lit(0.0).cast("double").alias("level"))


def closing(end: Column | str = "end", level: Column | str = "depth") -> Column:
    """Where an end tag goes: before all that begins there, deeper ones first."""
    c = lambda x: F.col(x) if isinstance(x, str) else x
    return F.struct(c(end).alias("at"), F.lit(0).alias("kind"), (-c(level)).cast("double").alias("level"))


def written(pieces: DataFrame, key: list[str]) -> DataFrame:
    """(key, html) of pieces (key, at, piece) put together in their order."""
    ordered = F.array_sort(F.collect_list(F.struct("at", "piece")))
    return pieces.groupBy(*key).agg(F.array_join(F.transform(ordered, lambda x: x["piece"]), "").alias("html"))


def _escaped(c: Column, attribute: bool = False) -> Column:
    c = F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("\u00a0"), F.lit("&nbsp;"))
    return F.replace(c, F.lit('"'), F.lit("&quot;")) if attribute else F.replace(F.replace(c, F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def tags(rows: DataFrame) -> DataFrame:
    """(page, start, at, piece): what each node of a table writes of itself, with its place."""
    raw = rows.where(F.col("tag").isin("script", "style")).select("page", F.col("start").alias("parent"), F.lit(True).alias("_raw"))
    rows = rows.join(raw, ["page", "parent"], "left")
    shown_attrs = F.array_join(F.transform(F.map_entries("attrs"), lambda a: F.concat(F.lit(" "), a["key"], F.lit('="'), _escaped(a["value"], True), F.lit('"'))), "")
    own = F.when(F.col("tag").isNotNull(), F.concat(F.lit("<"), "tag", shown_attrs, F.lit(">"))).when(F.col("_raw"), F.col("text")).otherwise(_escaped(F.col("text")))
    begin = F.struct(opening().alias("at"), own.alias("piece"))
    end = F.struct(closing().alias("at"), F.concat(F.lit("</"), "tag", F.lit(">")).alias("piece"))
    closed = F.col("tag").isNotNull() & ~F.col("tag").isin(*H.VOID)
    return rows.select("page", "start", F.inline(F.when(closed, F.array(begin, end)).otherwise(F.array(begin))))


def outer_html(table: Pages, found: DataFrame) -> DataFrame:
    """(page, start, html) of elements, written with all that is below them."""
    pieces = tags(table.rows).select(F.col("page").alias("_page"), F.col("start").alias("_start"), "at", "piece")
    met = found.select("page", "start", "end").join(pieces, (F.col("page") == F.col("_page")) & (F.col("_start") >= F.col("start")) & (F.col("_start") < F.col("end")))
    return written(met.select("page", "start", "at", "piece"), ["page", "start"])


def without(rows: DataFrame, gone: DataFrame) -> DataFrame:
    """rows but for elements that are gone and all below them."""
    cut = gone.select(F.col("page").alias("_page"), F.col("start").alias("_start"), F.col("end").alias("_end"))
    return rows.join(cut, (F.col("page") == F.col("_page")) & (F.col("_start") <= F.col("start")) & (F.col("start") < F.col("_end")), "left_anti")


def full_html(table: Pages, selectors: list[str]) -> DataFrame:
    """(kept columns, selector, found, error, outer_html, inner_text, attributes) for each page
    and selector: its first element as it is, or why there is none."""
    out = []
    nothing = {"outer_html": "string", "inner_text": "string", "attributes": "array<struct<name:string,value:string>>"}
    for selector in selectors:
        told = F.lit(selector).alias("selector")
        try:
            hits = first(matching(table, selector))
        except H.Invalid as e:
            none = [F.lit(None).cast(k).alias(n) for n, k in nothing.items()]
            out.append(table.pages.select(*table.keep, told, F.lit(False).alias("found"), F.lit(f"INVALID_SELECTOR: {e}").alias("error"), *none))
            continue
        attributes = F.transform(F.map_entries("attrs"), lambda a: F.struct(a["key"].alias("name"), a["value"].alias("value")))
        own = hits.select("page", "start", F.lit(True).alias("_found"), attributes.alias("attributes"))
        own = own.join(outer_html(table, hits).withColumnRenamed("html", "outer_html"), ["page", "start"], "left").join(texts(table, hits).withColumnRenamed("text", "inner_text"), ["page", "start"], "left")
        met = table.pages.join(own, "page", "left").withColumn("found", F.coalesce("_found", F.lit(False)))
        inner = F.when(F.col("found"), F.coalesce("inner_text", F.lit(""))).alias("inner_text")
        out.append(met.select(*table.keep, told, "found", F.lit(None).cast("string").alias("error"), "outer_html", inner, "attributes"))
    return reduce(lambda a, b: a.unionByName(b), out)


# --- containment ---------------------------------------------------------------------


def contained(found: DataFrame) -> DataFrame:
    """(page, ordinal, holder): elements that stand in another one found, with the first that
    holds them. Intervals of a tree don't cross, so in document order an element stands in
    one before it exactly where the greatest end so far is past its start, and the first
    that holds it is the last that began with no end past it."""
    w = Window.partitionBy("page").orderBy("start")
    rows = found.select("page", "start", "end", (F.row_number().over(w) - 1).alias("ordinal"))
    reach = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = rows.withColumn("_top", F.coalesce(reach <= F.col("start"), F.lit(True)))
    head = F.last(F.when(F.col("_top"), F.col("ordinal")), ignorenulls=True).over(w)
    return marked.withColumn("holder", head).where(~F.col("_top")).select("page", "ordinal", "holder")
