"""Shortened pages: cleaned, compressed, and cut to a budget, over the table of nodes
(`gleaner.operators.nodes`). What is taken out is an anti-join with the intervals of the
elements that go; what is left writes itself out once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.functions.text import filter_classes, trim, truncate_text
from gleaner.operators import nodes as N
from gleaner.operators.nodes import Pages

#: What is taken out of a page before it's read.
USELESS = ("script", "style", "link", "video", "audio", "canvas", "svg", "noscript", "template", "meta", "path", "g", "defs", "use")
HIDDEN = '[hidden], [aria-hidden="true"], [style*="display: none"], [style*="display:none"], [style*="visibility: hidden"]'
NOISE = (
    "nav", "footer", "header", "aside",
    '[role="navigation"]', '[role="banner"]', '[role="contentinfo"]', '[role="complementary"]',
    '[class*="sidebar"]', '[class*="side-bar"]', '[class*="Sidebar"]', '[class*="toast"]', '[class*="modal-backdrop"]', '[class*="overlay"]',
    '[class*="cookie"]', '[class*="banner"]', '[class*="popup"]', '[class*="tooltip"]', '[class*="dropdown-menu"]',
)
#: Attributes of a compressed page, and tags kept as they are.
SHOWN = ("id", "name", "placeholder", "type", "href")
OPAQUE = ("html", "head", "body", "table", "thead", "tbody", "tr", "td", "th", "ul", "ol", "li", "a", "button", "select", "form", "iframe")
#: Lengths of texts and attribute values from which they are shortened, and the
#: depth to which a page is compressed.
LONG_TEXT, LONG_VALUE, DEEP = 200, 200, 20
#: Code points of a snapshot's parts, if `snapshots` isn't told others.
HTML_CAP, TEXT_CAP, SUMMARY_CAP = 80_000, 15_000, 3000


def noise(table: Pages) -> DataFrame:
    """(page, start, end) of elements that nobody reads: one pass over their own attributes."""
    return table.elements().where(F.col("tag").isin(*USELESS) | N.says(", ".join(NOISE)) | N.says(HIDDEN)).select("page", "start", "end")


def frame_prefix(place: Column) -> Column:
    """What a selector begins with to reach into a frame: by id, name or place."""
    from gleaner.operators.anchors import identifier

    a = F.col("attrs")
    quoted = F.replace(F.replace(a["name"], F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    by_place = F.concat(F.lit("iframe:nth-of-type("), place.cast("string"), F.lit(")::"))
    return F.when(a["id"] != "", F.concat(F.lit("iframe#"), identifier(a["id"]), F.lit("::"))).when(a["name"] != "", F.concat(F.lit('iframe[name="'), quoted, F.lit('"]::'))).otherwise(by_place)


def cleaned(table: Pages) -> DataFrame:
    """The nodes that are read, with their columns: without noise, styles and handlers, classes
    that frameworks make, and long ends of texts and values; frames that hold something say
    how they are reached (`data-iframe-prefix`)."""
    rows = N.without(table.rows, noise(table))
    kept = F.map_filter("attrs", lambda k, v: (k != "style") & ~k.startswith("on"))
    kept = F.transform_values(kept, lambda k, v: F.when(k == "class", filter_classes(v)).otherwise(v))
    kept = F.map_filter(kept, lambda k, v: (k != "class") | (v != ""))
    kept = F.transform_values(kept, lambda k, v: F.when(F.length(v) > LONG_VALUE, F.concat(F.left(v, F.lit(LONG_VALUE)), F.lit("..."))).otherwise(v))
    inner = rows.select("page", F.col("parent").alias("start"), F.lit(True).alias("_inner")).distinct()
    w = Window.partitionBy("page", "parent").orderBy("start")
    frames = rows.where("tag = 'iframe'").withColumn("_place", F.row_number().over(w)).join(inner, ["page", "start"], "left_semi").select("page", "start", "_place")
    out = rows.withColumn("attrs", kept).join(frames, ["page", "start"], "left")
    marked = F.map_concat("attrs", F.create_map(F.lit("data-iframe-prefix"), frame_prefix(F.col("_place"))))
    told = F.when(F.col("_place").isNotNull(), F.when(F.map_contains_key("attrs", "data-iframe-prefix"), F.col("attrs")).otherwise(marked)).otherwise(F.col("attrs"))
    long = (F.length("text") > LONG_TEXT) & (F.length(trim("text")) > LONG_TEXT)
    short = F.when(long, truncate_text("text", LONG_TEXT)).otherwise(F.col("text"))
    return out.withColumn("attrs", told).withColumn("text", F.when(F.col("text").isNotNull(), short)).drop("_place")


def unwrapped(rows: DataFrame) -> DataFrame:
    """rows without wrappers: elements without attributes (a style aside) around one element,
    whatever is written beside it. Which tags are wrappers doesn't depend on the order in
    which they go, since one that gives way to another is no kept tag itself."""
    elements = rows.where("tag is not null")
    kids = elements.groupBy("page", F.col("parent").alias("start")).agg(F.count(F.lit(1)).alias("_n"), F.min("tag").alias("_kid"))
    bare = F.size(F.filter(F.map_keys("attrs"), lambda k: k != "style")) == 0
    gone = elements.join(kids, ["page", "start"]).where((F.col("_n") == 1) & bare & ~F.col("tag").isin(*OPAQUE) & ~F.col("_kid").isin(*OPAQUE))
    keys = gone.select("page", F.col("start").alias("_gone"))
    beside = rows.where("tag is null").join(keys.withColumnRenamed("_gone", "parent"), ["page", "parent"], "left_anti").select(*rows.columns)
    return elements.join(keys.withColumnRenamed("_gone", "start"), ["page", "start"], "left_anti").select(*rows.columns).unionByName(beside)


def html(rows: DataFrame) -> DataFrame:
    """(page, html) of nodes, written without blank lines and blanks between tags."""
    out = N.written(N.tags(rows).select("page", "at", "piece"), ["page"])
    return out.withColumn("html", F.regexp_replace(F.regexp_replace("html", r"(?U)\n\s*\n", "\n"), r"(?U)>\s+<", "><"))


def compressed(table: Pages) -> DataFrame:
    """(page, structure): tags with a few attributes and short texts, down to depth DEEP."""
    gone = table.elements().where(F.col("tag").isin(*USELESS, "img") | (F.col("depth") > DEEP))
    rows = N.without(table.rows, gone)
    a = F.col("attrs")
    some = [F.when(a[k] != "", F.concat(F.lit(f' {k}="'), a[k], F.lit('"'))).otherwise("") for k in SHOWN]
    classes = F.array_join(F.slice(F.split(filter_classes(a["class"]), " "), 1, 2), " ")
    begin = F.concat(F.lit("<"), "tag", *some, F.when(classes != "", F.concat(F.lit(' class="'), classes, F.lit('"'))).otherwise(""), F.lit(">"))
    element = F.array(F.struct(N.opening().alias("at"), begin.alias("piece")), F.struct(N.closing().alias("at"), F.concat(F.lit("</"), "tag", F.lit(">")).alias("piece")))
    text = F.array(F.struct(N.opening().alias("at"), truncate_text("text", 60).alias("piece")))
    top = rows.where(F.col("tag").isNotNull() | (F.col("parent") >= 0))
    pieces = top.select("page", F.inline(F.when(F.col("tag").isNotNull(), element).otherwise(text)))
    return N.written(pieces, ["page"]).withColumnRenamed("html", "structure")


def _text(rows: DataFrame, found: DataFrame, name: str) -> DataFrame:
    """(page, name) of the first of the elements found on each page."""
    table = Pages(rows.select("page").distinct(), rows, ())
    return N.texts(table, N.first(found)).select("page", F.col("text").alias(name))


def _cleaned(table: Pages) -> tuple[DataFrame, DataFrame]:
    """The nodes that are read, written once, and those of them that a page is written of."""
    rows = N.store.kept(cleaned(table), "cleaned")
    return rows, rows.where(F.col("tag").isNotNull() | (F.col("parent") >= 0))


def whole(table: Pages, html_cap: int = HTML_CAP) -> DataFrame:
    """(page, html) of every page: the cleaned page alone, as `snapshots` has it."""
    out = table.pages.select("page").join(html(_cleaned(table)[1]), "page", "left")
    return out.select("page", F.left(F.coalesce("html", F.lit("")), F.lit(html_cap)).alias("html"))


def snapshots(table: Pages, html_cap: int = HTML_CAP, text_cap: int = TEXT_CAP, summary_cap: int = SUMMARY_CAP) -> DataFrame:
    """(page, title, html, text, structure, summary) of every page: the cleaned page and its
    text, and of the page as it is the structure and the beginning of its text. The caps are
    the snapshot's own limits on code points; a page without nodes has empty parts."""
    rows, tops = _cleaned(table)
    body, title = (table.elements().where(F.col("tag") == t) for t in ("body", "title"))
    out = table.pages.select("page")
    for part in (_text(table.rows, title, "title"), html(tops), _text(rows, rows.where("tag = 'body'"), "text"), compressed(table), _text(table.rows, body, "summary")):
        out = out.join(part, "page", "left")
    cap = lambda c, n: F.left(F.coalesce(c, F.lit("")), F.lit(n))
    text = F.col("text")
    return out.select(
        "page", F.coalesce(trim("title"), F.lit("")).alias("title"), cap(F.col("html"), html_cap).alias("html"), cap(trim(text), text_cap).alias("text"),
        F.coalesce("structure", F.lit("")).alias("structure"), cap(F.col("summary"), summary_cap).alias("summary"),
    )
