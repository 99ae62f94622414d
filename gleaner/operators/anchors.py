"""What names an element and what stands around it: selectors that outlast a page load,
paths for clustering, and shortened surroundings of annotated elements, over the table of
nodes (`gleaner.operators.nodes`)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.functions.text import filter_classes, trim, truncate_text
from gleaner.operators import nodes as N
from gleaner.operators.nodes import Pages
from gleaner.operators.reduce import USELESS, whole
from gleaner.sources import store

#: Attributes that stay the same from load to load.
STABLE_ATTRS = ("role", "aria-label", "aria-posinset", "aria-describedby", "aria-labelledby", "data-testid", "data-ad-rendering-role", "data-sigil", "name", "type")
#: Generated ids and class names, in either case.
AUTO_ID = r"(?i)^(mount_|react-aria[-_:]|headlessui-|r_[0-9]+_|^[Rr]_[a-z0-9]+:)"
AUTO_CLASS = r"(?i)^(x[0-9a-z]{4,}|_[a-z0-9]+|html-)"
#: Ancestors and siblings shown, and levels below the element.
RADIUS, SIBLINGS, BELOW = 3, 2, 2
#: Fixed value: depth to which annotated elements of a structure are opened.
DEPTH = 8


# --- names ---------------------------------------------------------------------------


def identifier(name: Column) -> Column:
    """An identifier as selectors write it (CSSOM, "serialize an identifier")."""
    control = lambda c: c.rlike("^[\\x01-\\x1f\\x7f]$")
    spelled = F.array_join(F.transform(F.split(name, ""), lambda c: F.when(control(c), F.concat(F.lit("\\"), F.lower(F.hex(F.ascii(c))), F.lit(" "))).when(c.rlike(r"[\x20-\x2c./:-@\[-^`{-~]"), F.concat(F.lit("\\"), c)).otherwise(c)), "")
    plain = F.regexp_replace(name, r"([\x20-\x2c./:-@\[-^`{-~])", r"\\$1")
    out = F.replace(F.when(name.rlike("[\\x01-\\x1f\\x7f]"), spelled).otherwise(plain), F.lit("\0"), F.lit("�"))
    return F.when(name == "-", F.lit("\\-")).otherwise(F.regexp_replace(out, "^(-?)([0-9])", r"$1\\3$2 "))


def anchored(elements: DataFrame) -> DataFrame:
    """Elements with their lasting marks: `own_id`, or else (null there) `marks`, attributes
    that stay, and `names`, up to three classes; `anchor` is the selector these make, `bare`
    says that it is the tag alone."""
    own = F.col("attrs")["id"]
    a = elements.withColumn("own_id", F.when((own != "") & ~own.rlike(AUTO_ID), own))
    pair = lambda k: F.when(F.col("attrs")[k] != "", F.struct(F.lit(k).alias("k"), F.col("attrs")[k].alias("v")))
    a = a.withColumn("marks", F.array_compact(F.array(*[pair(k) for k in STABLE_ATTRS])))
    a = a.withColumn("names", F.slice(F.filter(N.tokens(F.col("attrs")["class"]), lambda c: ~c.rlike(AUTO_CLASS)), 1, 3))
    marks = F.array_join(F.transform("marks", lambda m: F.concat(F.lit("["), m["k"], F.lit('="'), identifier(m["v"]), F.lit('"]'))), "")
    names = F.array_join(F.transform("names", lambda c: F.concat(F.lit("."), identifier(c))), "")
    text = F.when(F.col("own_id").isNotNull(), F.concat(F.lit("#"), identifier(F.col("own_id")))).otherwise(F.concat("tag", marks, names))
    return a.withColumn("anchor", text).withColumn("bare", F.col("own_id").isNull() & (F.size("marks") == 0) & (F.size("names") == 0))


def above(table: Pages, found: DataFrame, elements: DataFrame) -> DataFrame:
    """(page, target, rank, and elements' columns): what stands above each element found, below
    the body, rank 1 being the parent."""
    up = elements.join(
        found.select(F.col("page").alias("_page"), F.col("start").alias("target")),
        (F.col("page") == F.col("_page")) & (F.col("start") < F.col("target")) & (F.col("target") < F.col("end")),
    ).drop("_page")
    own = Window.partitionBy("page", "target")
    body = F.coalesce(F.max(F.when(F.col("tag") == "body", F.col("start"))).over(own), F.lit(-1))
    below = up.withColumn("_body", body).where(F.col("start") > F.col("_body")).drop("_body")
    return below.withColumn("rank", F.row_number().over(own.orderBy(F.desc("start"))))


def fitting(elements: DataFrame, wanted: DataFrame) -> DataFrame:
    """(page, anchor, start, end): elements that have all the marks of an anchor of their page;
    `wanted` has anchors as `anchored` gives them."""
    own = elements.select("page", "start", "end", "tag", "attrs", N.tokens(F.col("attrs")["class"]).alias("_classes"))
    asked = wanted.select("page", "anchor", "own_id", F.col("tag").alias("_tag"), "marks", "names").dropDuplicates(["page", "anchor"])
    by_id = own.withColumn("own_id", F.col("attrs")["id"]).join(asked.where("own_id is not null"), ["page", "own_id"])
    held = F.forall("marks", lambda m: F.col("attrs")[m["k"]].eqNullSafe(m["v"])) & (F.size(F.array_except("names", "_classes")) == 0)
    others = asked.where("own_id is null").withColumnRenamed("_tag", "tag")
    by_marks = own.join(others.drop("own_id"), ["page", "tag"]).where(held)
    return by_id.select("page", "anchor", "start", "end").unionByName(by_marks.select("page", "anchor", "start", "end"))


def named(table: Pages, selector: str) -> DataFrame:
    """(kept columns, ordinal, tag, selector, path): elements of a selector, and the selector and
    path made for each. A selector is the element's anchor with those of ancestors until no
    other element matches; ancestors without marks are left out, and where the body is
    reached the element's place among those of its tag is added.

    Elements of a page with one chain of anchors are one row while it grows. In each round
    the chains that match several elements get one anchor more: an element stays matched if
    one that fits stands above where the chain was matched so far, the nearest of them."""
    elements = anchored(table.elements())
    found = own = store.kept(anchored(N.matching(table, selector)), "found")
    ups = store.kept(above(table, found, elements).select("page", "target", "rank", "start", "tag", "own_id", "marks", "names", "anchor", "bare"), "ups")
    marked = ups.where("not bare").withColumn("step", F.row_number().over(Window.partitionBy("page", "target").orderBy("rank")))
    fits = store.kept(fitting(elements, own.select("page", "anchor", "own_id", "tag", "marks", "names").unionByName(marked.select("page", "anchor", "own_id", "tag", "marks", "names"))), "fits")
    state = own.select("page", F.col("start").alias("target"), F.col("anchor").alias("chain"))
    # (page, chain, element, top): what a chain matches, and where its first anchor was found
    matched = fits.join(state.select("page", F.col("chain").alias("anchor")).distinct(), ["page", "anchor"], "left_semi")
    matched = matched.select("page", F.col("anchor").alias("chain"), F.col("start").alias("element"), F.col("start").alias("top"))
    count = lambda m: m.groupBy("page", "chain").agg(F.count(F.lit(1)).alias("n"))
    state = store.kept(state.join(count(matched), ["page", "chain"]), "state")
    steps = marked.agg(F.max("step")).first()[0] or 0
    for step in range(1, steps + 1):
        more = marked.where(F.col("step") == step).select("page", "target", "anchor")
        grown = state.where("n > 1").join(more, ["page", "target"]).withColumn("next", F.concat("anchor", F.lit(" "), "chain"))
        chains = grown.select("page", "chain", "anchor", "next").distinct()
        if not chains.take(1):
            break
        over = fits.select("page", "anchor", F.col("start").alias("_start"), F.col("end").alias("_end"))
        met = matched.join(chains, ["page", "chain"]).join(over, ["page", "anchor"]).where((F.col("_start") < F.col("top")) & (F.col("top") < F.col("_end")))
        matched = store.kept(met.groupBy("page", F.col("next").alias("chain"), "element").agg(F.max("_start").alias("top")), "matched")
        longer = grown.select("page", "target", F.col("next").alias("chain")).join(count(matched), ["page", "chain"])
        state = store.kept(state.join(longer.select("page", "target"), ["page", "target"], "left_anti").unionByName(longer.select(*state.columns)), "state")
    place = F.concat(F.lit(":nth-of-type("), F.col("of_type").cast("string"), F.lit(")"))
    position = F.when((F.col("n") > 1) & (F.col("n_of_type") > 1), place).otherwise("")
    paths = ups.select("page", "target", "rank", "anchor").unionByName(own.select("page", F.col("start").alias("target"), F.lit(0).alias("rank"), "anchor"))
    paths = paths.groupBy("page", "target").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("rank")).alias("r"), "anchor"))), lambda x: x["anchor"]), " > ").alias("path"))
    out = found.select("page", "start", "tag", "of_type", "n_of_type").withColumn("ordinal", F.row_number().over(Window.partitionBy("page").orderBy("start")) - 1).withColumnRenamed("start", "target")
    out = out.join(state, ["page", "target"]).join(paths, ["page", "target"])
    return table.told(out.select("page", "ordinal", "tag", F.concat("chain", position).alias("selector"), "path"), "ordinal", "tag", "selector", "path")


# --- surroundings --------------------------------------------------------------------


def _begin(names: int, mark: Column | str = "") -> Column:
    """A start tag with id and a few classes."""
    own = F.col("attrs")["id"]
    kept = F.array_join(F.slice(F.split(filter_classes(F.col("attrs")["class"]), " "), 1, names), " ")
    mark = F.lit(mark) if isinstance(mark, str) else mark
    return F.concat(F.lit("<"), "tag", F.when(own != "", F.concat(F.lit(' id="'), own, F.lit('"'))).otherwise(""), F.when(kept != "", F.concat(F.lit(' class="'), kept, F.lit('"'))).otherwise(""), mark, F.lit(">"))


def _end() -> Column:
    return F.concat(F.lit("</"), "tag", F.lit(">"))


def _pieces(rows: DataFrame, key: list[str], begin: Column, end: Column) -> DataFrame:
    """Start and end tags of elements, to be written around what stands in them."""
    both = F.array(F.struct(N.opening().alias("at"), begin.alias("piece")), F.struct(N.closing().alias("at"), end.alias("piece")))
    return rows.select(*key, F.inline(both))


def _whole(rows: DataFrame, key: list[str], piece: Column) -> DataFrame:
    return rows.select(*key, N.opening().alias("at"), piece.alias("piece"))


def with_contents(table: Pages, rows: DataFrame) -> DataFrame:
    """Rows with the number of elements right in them, and the text right in them."""
    inner = table.rows.groupBy("page", F.col("parent").alias("start")).agg(
        F.count("tag").alias("_inside"), F.array_sort(F.collect_list(F.when(F.col("tag").isNull(), F.struct("start", "text")))).alias("_texts")
    )
    text = F.array_join(F.transform("_texts", lambda x: x["text"]), "")
    out = rows.join(inner, ["page", "start"], "left")
    return out.withColumn("inside", F.coalesce("_inside", F.lit(0))).withColumn("own_text", F.coalesce(text, F.lit(""))).drop("_inside", "_texts")


def _folded(n: Column, kind: str) -> Column:
    """An element closed over the number of those in it, or its text."""
    count = F.concat(F.lit("+"), n.cast("string"), F.lit(f" {kind}"))
    element = F.concat(_begin(2), F.when(n > 0, count).otherwise(trim("own_text")), _end())
    return F.when(F.col("tag").isNull(), truncate_text("text", 60)).otherwise(element)


def contexts(table: Pages, selectors: list[str], radius: int = RADIUS, siblings: int = SIBLINGS) -> DataFrame:
    """(page, which, html): the first element of each selector (by its place in the list),
    opened two levels down within its nearest ancestors, each with the siblings next to the
    way down, folded; what is left out is counted. Selectors that match nothing have no row.

    Every node that is shown gives pieces with their places in the page, and these are put
    together in order once."""
    targets = reduce(lambda a, b: a.unionByName(b), [N.first(N.matching(table, s)).withColumn("which", F.lit(i)) for i, s in enumerate(selectors)])
    targets = store.kept(targets.select("page", "which", "start", "end", "parent", "depth", "tag", "attrs"), "targets")
    key = ["page", "which"]
    # the way from the target up: (page, which, at: the child on the way, and the ancestor)
    ups = above(table, targets.select("page", "start").distinct(), table.elements()).where(F.col("rank") <= radius)
    ups = targets.select("page", "which", F.col("start").alias("target")).join(ups, ["page", "target"])
    way = ups.select("page", "which", "rank", F.col("start").alias("on"))
    way = way.unionByName(targets.select("page", "which", F.lit(0).alias("rank"), F.col("start").alias("on")))
    ups = store.kept(ups.join(way.withColumn("rank", F.col("rank") + 1), ["page", "which", "rank"]), "ways")
    # siblings by their place among all that stands in the ancestor
    inner = table.rows.select("page", F.col("parent").alias("_up"), "start", "end", "parent", "depth", "tag", "attrs", "text")
    level = inner.join(ups.select("page", "which", F.col("start").alias("_up"), "on"), ["page", "_up"])
    w = Window.partitionBy("page", "which", "_up")
    level = level.withColumn("_i", F.row_number().over(w.orderBy("start")) - 1).withColumn("_n", F.count(F.lit(1)).over(w))
    level = level.withColumn("_on", F.max(F.when(F.col("start") == F.col("on"), F.col("_i"))).over(w))
    level = level.withColumn("_first", F.greatest(F.lit(0), F.col("_on") - siblings)).withColumn("_last", F.least(F.col("_n"), F.col("_on") + 1 + siblings))
    near = level.where((F.col("_i") >= F.col("_first")) & (F.col("_i") < F.col("_last")))
    beside = with_contents(table, near.where(F.col("start") != F.col("on")))
    note = lambda n, side: F.concat(F.lit("<!-- "), n.cast("string"), F.lit(f" siblings {side} -->"))
    before = near.where((F.col("_i") == F.col("_first")) & (F.col("_first") > 0))
    place = lambda at, kind, order: F.struct(at.alias("at"), F.lit(kind).alias("kind"), order.cast("double").alias("level"))
    before = before.select(*key, place(F.col("start"), 1, F.lit(-1.0)).alias("at"), note(F.col("_first"), "before").alias("piece"))
    after = ups.select("page", "which", F.col("start").alias("_up"), F.col("end").alias("_end"), F.col("depth").alias("_depth"))
    after = near.where((F.col("_i") == F.col("_last") - 1) & (F.col("_last") < F.col("_n"))).join(after, ["page", "which", "_up"])
    after = after.select(*key, place(F.col("_end"), 0, -F.col("_depth") - 0.5).alias("at"), note(F.col("_n") - F.col("_last"), "after").alias("piece"))
    # what stands in the target
    down = table.rows.join(
        targets.select(F.col("page").alias("_page"), "which", F.col("start").alias("_start"), F.col("end").alias("_end"), F.col("depth").alias("_depth")),
        (F.col("page") == F.col("_page")) & (F.col("_start") < F.col("start")) & (F.col("start") < F.col("_end")),
    )
    down = store.kept(down.withColumn("level", F.col("depth") - F.col("_depth")).where(F.col("level") <= BELOW + 1).drop("_page", "_start", "_end", "_depth"), "down")
    deep = down.where((F.col("level") > BELOW) & F.col("tag").isNotNull())
    held = table.elements().select(F.col("page").alias("_page"), F.col("start").alias("_start"))
    counts = deep.select("page", "start", "end").distinct().join(held, (F.col("page") == F.col("_page")) & (F.col("start") < F.col("_start")) & (F.col("_start") < F.col("end")))
    counts = counts.groupBy("page", "start").agg(F.count(F.lit(1)).alias("_below"))
    deep = with_contents(table, deep).join(counts, ["page", "start"], "left").withColumn("_below", F.coalesce("_below", F.lit(0)))
    pieces = [
        _pieces(ups, key, _begin(2), _end()), _pieces(targets, key, _begin(2, " data-annotated"), _end()),
        _whole(beside, key, _folded(F.col("inside"), "children")), before, after,
        _pieces(down.where((F.col("level") <= BELOW) & F.col("tag").isNotNull()), key, _begin(2), _end()),
        _whole(down.where("tag is null"), key, truncate_text("text", 60)), _whole(deep, key, _folded(F.col("_below"), "descendants")),
    ]
    return N.written(reduce(lambda a, b: a.unionByName(b), pieces), key)


def structures(table: Pages, selectors: list[str]) -> DataFrame:
    """(page, top, html): what stands right in the body: ways to annotated elements are open and
    marked, every other element with elements in it is folded."""
    hits = reduce(lambda a, b: a.union(b), [N.matching(table, s).select("page", "start") for s in selectors]).distinct()
    marked = above(table, hits, table.elements()).select("page", "start").union(hits).distinct().withColumn("_m", F.lit(True))
    body = table.elements().where("tag = 'body'").groupBy("page").agg(F.min_by(F.struct("start", "end", "depth"), "start").alias("b"))
    rows = table.rows.join(body, "page").where((F.col("b.start") < F.col("start")) & (F.col("start") < F.col("b.end")))
    rows = rows.withColumn("level", F.col("depth") - F.col("b.depth") - 1).withColumn("_top", F.col("parent") == F.col("b.start")).drop("b")
    rows = with_contents(table, rows.join(marked, ["page", "start"], "left")).withColumn("_m", F.coalesce("_m", F.lit(False)))
    useless = F.col("tag").isin(*USELESS, "img")
    folded = (F.col("inside") > 0) & (~F.col("_m") | (F.col("level") >= DEPTH))
    rows = store.kept(rows.withColumn("_open", F.col("tag").isNotNull() & ~useless & ~folded).drop("own_text"), "inside")
    ways = lambda c: rows.where(c).select("page", F.col("start").alias("parent"))
    # an element is shown in the body or in an open way, unless that way is closed further up
    tops = F.col("_top")
    elements = rows.where(F.col("tag").isNotNull() & ~useless)
    reached = elements.where(tops).unionByName(elements.where(~tops).join(ways("_open and inside > 0"), ["page", "parent"], "left_semi").select(*rows.columns))
    shut = rows.where("_m and tag is not null and not _open").select(F.col("page").alias("_page"), F.col("start").alias("_start"), F.col("end").alias("_end"))
    under = (F.col("page") == F.col("_page")) & (F.col("_start") < F.col("start")) & (F.col("start") < F.col("_end"))
    reached = store.kept(reached.join(shut, under, "left_anti"), "reached")
    told = rows.where("tag is null")
    leaves = reached.where("_open").select("page", F.col("start").alias("parent"))
    told = told.where(tops).unionByName(told.where(~tops).join(leaves, ["page", "parent"], "left_semi").select(*rows.columns))
    hint = F.substring(F.coalesce(F.col("attrs")["placeholder"], F.lit("")), 1, 30)
    mark = F.concat(F.when(hint != "", F.concat(F.lit(' placeholder="'), hint, F.lit('"'))).otherwise(""), F.when(F.col("_m"), " [ANNOTATED]").otherwise(""))
    closed = F.concat(_begin(1, mark), F.lit("+"), F.col("inside").cast("string"), F.lit(" children"), _end())
    key = ["page", "start", "_top"]
    pieces = reduce(lambda a, b: a.unionByName(b), [_pieces(reached.where("_open"), key, _begin(1, mark), _end()), _whole(reached.where("not _open"), key, closed), _whole(told, key, truncate_text("text", 60))])
    # by the body's child that a piece stands in
    roots = rows.where(tops).select(F.col("page").alias("_page"), F.col("start").alias("top"), F.col("end").alias("_end"))
    pieces = pieces.join(roots, (F.col("page") == F.col("_page")) & (F.col("top") <= F.col("start")) & (F.col("start") < F.col("_end")))
    return N.written(pieces.select("page", "top", "at", "piece"), ["page", "top"]).where("html <> ''")


def surroundings(table: Pages, selectors: list[str]) -> DataFrame:
    """(page, contexts, structure) for every page: contexts in the order of their selectors, and
    the folded body's parts."""
    listed = lambda rows, by, name: rows.groupBy("page").agg(F.transform(F.array_sort(F.collect_list(F.struct(by, "html"))), lambda x: x["html"]).alias(name))
    out = table.pages.select("page")
    if selectors:
        out = out.join(listed(contexts(table, selectors), "which", "contexts"), "page", "left").join(listed(structures(table, selectors), "top", "structure"), "page", "left")
    else:
        out = out.withColumn("contexts", F.lit(None).cast("array<string>")).join(listed(structures(table, ["nothing-has-this-tag"]), "top", "structure"), "page", "left")
    empty = F.array().cast("array<string>")
    return out.select("page", F.coalesce("contexts", empty).alias("contexts"), F.coalesce("structure", empty).alias("structure"))


def tiered(pages: DataFrame, keep: list[str], selectors: list[str] = (), budget: int = 30_000, html: str = "html") -> DataFrame:
    """(kept columns, mode, html): the first of the full page, the annotated parts and the folded
    structure that fits the budget; else what a part has to be chosen from."""
    table = N.parsed(pages, keep, html)
    parts = surroundings(table, list(selectors)).join(whole(table).withColumnRenamed("html", "_full"), "page")
    texts = {"full": F.col("_full"), "annotated": F.array_join("contexts", "\n"), "compressed": F.array_join("structure", "\n")}
    pick = lambda mode, c: F.struct(F.lit(mode).alias("mode"), c.alias("html"))
    fits = [F.when((F.length(c) <= budget) & ((c != "") | (mode == "full")), pick(mode, c)) for mode, c in texts.items()]
    return table.pages.join(parts, "page").select(*keep, F.inline(F.array(F.coalesce(*fits, pick("needs_subtree_selection", texts["compressed"])))))
