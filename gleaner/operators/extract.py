"""Records out of pages: all selectors of a job in one parse of each page."""

from __future__ import annotations

from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.sources import html as H

#: Fixed value: the longest text of a single element that is kept.
ELEMENT_TEXT = 50_000


@dataclass(frozen=True)
class Records:
    """A container selector and its fields: name -> selector, or (selector, attribute).
    An empty selector reads the container; outerHTML and innerHTML are attributes too.
    multi: every match of a field, as an array. strict: a page without containers fails."""

    container: str
    fields: dict[str, str | tuple[str, str]]
    multi: bool = False
    strict: bool = False
    counts: bool = False

    def __post_init__(self):
        if not self.fields:
            raise ValueError("no fields")
        H.compiled(self.container)

    def type(self) -> str:
        kind = "array<string>" if self.multi else "string"
        extra = [f"n_{f}:int" for f in self.fields] if self.counts else []
        return "array<struct<" + ",".join(["ordinal:int", *(f"{f}:{kind}" for f in self.fields), *extra]) + ">>"

    def read(self, nodes: list[H.Node]) -> list[dict]:
        found = H.select(nodes, self.container)
        if not found and self.strict:
            raise ValueError(f"no containers matched: {self.container}")
        out = []
        for i, box in enumerate(found):
            row: dict = {"ordinal": i}
            for name, spec in self.fields.items():
                selector, attr = (spec, None) if isinstance(spec, str) else spec
                if not selector:
                    matched = [box]
                else:
                    matched = H.select(nodes, selector, within=box, first=not (self.multi or self.counts))
                values = [value(e, attr) for e in (matched if self.multi else matched[:1])]
                row[name] = values if self.multi else (values[0] if values else None)
                if self.counts:
                    row[f"n_{name}"] = len(matched)
            out.append(row)
        return out


@dataclass(frozen=True)
class Read:
    """One value of a page. what: text, count, exists, or an attribute of the first match."""

    selector: str
    what: str = "text"

    def type(self) -> str:
        return {"count": "bigint", "exists": "boolean"}.get(self.what, "string")

    def read(self, nodes: list[H.Node]):
        try:
            found = H.select(nodes, self.selector, first=self.what != "count")
        except H.Invalid:
            found = []
        if self.what == "count":
            return len(found)
        if self.what == "exists":
            return bool(found) and not H.hidden(found[0])
        return value(found[0], None if self.what == "text" else self.what) if found else None


def value(e: H.Node, attr: str | None) -> str | None:
    if attr == "outerHTML":
        return e.outer()
    if attr == "innerHTML":
        return e.inner()
    if attr:
        return e.attrs.get(attr.lower())
    return e.text().strip("\t\n\x0b\x0c\r \xa0                　﻿")[:ELEMENT_TEXT]


@dataclass(frozen=True)
class Elements:
    """Every match of a selector as a flat row; an invalid selector matches nothing."""

    selector: str

    def type(self) -> str:
        texts = ",".join(f"{k}:string" for k in ("tag", "id", "class", "text", "value", "href", "src"))
        return f"array<struct<ordinal:int,{texts},checked:boolean,disabled:boolean>>"

    def read(self, nodes: list[H.Node]) -> list[dict]:
        try:
            found = H.select(nodes, self.selector)
        except H.Invalid:
            found = []
        own = lambda e: {k: e.attrs.get(k) for k in ("id", "class", "value", "href", "src")} | {k: k in e.attrs for k in ("checked", "disabled")}
        return [{"ordinal": i, "tag": e.tag, "text": value(e, None)} | own(e) for i, e in enumerate(found)]


@dataclass(frozen=True)
class Clicks:
    """What a click in every container would have done: clicked, or the containers that
    have no such element."""

    container: str
    target: str

    def type(self) -> str:
        return "struct<clicked:int,missing:array<int>>"

    def read(self, nodes: list[H.Node]) -> dict:
        boxes = H.select(nodes, self.container)
        missing = [i for i, box in enumerate(boxes) if self.target and not H.select(nodes, self.target, within=box, first=True)]
        return {"clicked": len(boxes) - len(missing), "missing": missing}


@dataclass(frozen=True)
class Job:
    """What to read from a page, by name."""

    parts: dict[str, Records | Read | Elements | Clicks] = field(default_factory=dict)

    def type(self) -> str:
        return "struct<" + ",".join(f"{k}:{v.type()}" for k, v in self.parts.items()) + ">"


def extracted(job: Job, html: str | Column = "html") -> Column:
    """A struct with a field for each part; null html is an empty page."""
    from pyspark.sql.types import _parse_datatype_string

    arrow_type = None

    def run(pages: pa.Array) -> pa.Array:
        nonlocal arrow_type
        rows = []
        for page in pages:
            nodes = H.parse(page.as_py() or "")
            rows.append({name: part.read(nodes) for name, part in job.parts.items()})
        if arrow_type is None:
            from pyspark.sql.pandas.types import to_arrow_type

            arrow_type = to_arrow_type(kind)
        return pa.array(rows, arrow_type)

    kind = _parse_datatype_string(job.type())
    return F.arrow_udf(run, kind)(html)


def records(pages: DataFrame, job: Job, part: str, keep: list[str], partitions: int | None = None) -> DataFrame:
    """A row for each record of a part, with the page's columns `keep`. Only those and
    html go to the parser; pages in few files are dealt out first."""
    some = pages.select(*keep, "html")
    some = some.repartition(partitions) if partitions else some
    return some.select(*keep, extracted(job).alias("_x")).select(*keep, F.inline(F.col(f"_x.{part}")))


def ranged(rows: DataFrame, index: int | None = None, span: tuple[int, int] | None = None, most: int | None = None) -> DataFrame:
    """Records of one container, of containers [start, end), or of the first few; one of
    the three has to be given."""
    given = [x is not None for x in (index, span, most)]
    if sum(given) != 1:
        raise ValueError("give one of index, span and most")
    at = F.col("ordinal")
    return rows.where(at == index if index is not None else (at >= span[0]) & (at < span[1]) if span is not None else at < most)


def values(pages: DataFrame, job: Job, keep: list[str]) -> DataFrame:
    """The single values of a job, a row for each page."""
    some = pages.select(*keep, "html").select(*keep, extracted(job).alias("_x"))
    return some.select(*keep, *[F.col(f"_x.{k}").alias(k) for k in job.parts])


def diagnostics(rows: DataFrame, group: list[str], fields: list[str]) -> DataFrame:
    """For records with counts: containers and, for each field, the containers with a
    match and what that says. One pass of partial sums, turned to rows afterwards."""
    sums = [F.count_if(F.col(f"n_{f}") > 0).alias(f"m_{f}") for f in fields]
    texts = [F.count_if((F.col(f"n_{f}") > 0) & (F.coalesce(F.col(f), F.lit("")) != "")).alias(f"t_{f}") for f in fields]
    total = rows.groupBy(*group).agg(F.count(F.lit(1)).alias("containers"), *sums, *texts)
    each = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"m_{f}").alias("matches"), F.col(f"t_{f}").alias("texts")) for f in fields])
    out = total.select(*group, "containers", F.inline(each))
    flag = F.when((F.col("matches") == 0) & (F.col("containers") > 0), "OVER-CONSTRAINED").when(F.col("matches") < F.col("containers"), "PARTIAL")
    return out.withColumn("flag", F.coalesce(flag.when(F.col("texts") == 0, "EMPTY-EXTRACTIONS"), F.lit("OK")))


def placed(found: DataFrame, group: list[str]) -> DataFrame:
    """Diagnostics in the order to be looked at: fields without a match first, then by name."""
    w = Window.partitionBy(*group).orderBy((F.col("matches") == 0).desc(), "field")
    return found.withColumn("place", F.row_number().over(w).cast("long"))


def samples(rows: DataFrame, group: list[str], fields: dict[str, str], k: int = 3, order: str = "ordinal") -> DataFrame:
    """(field, sample_texts, sample_hrefs): the first k texts, to 80 characters, and links,
    to 120, of the elements matched; `fields` maps a counted field to the one with its
    href. A matched element without text is a sample, one without a link is none. The
    rank limit is taken before the shuffle, so no group is gathered."""
    text = lambda f: F.when(F.col(f"n_{f}") > 0, F.left(F.coalesce(f, F.lit("")), F.lit(80)))
    link = lambda f: F.when(F.col(f) != "", F.left(f, F.lit(120)))
    pick = lambda f, kind, v: F.struct(F.lit(f).alias("field"), F.lit(kind).alias("kind"), v.alias("value"))
    each = [pick(f, kind, v) for f, h in fields.items() for kind, v in (("text", text(f)), ("href", link(h)))]
    w = Window.partitionBy(*group, "field", "kind").orderBy(order)
    top = rows.select(*group, order, F.inline(F.array(*each))).where("value is not null").withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= k)
    of = lambda kind: F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") == kind, F.struct("_n", "value")))), lambda x: x["value"])
    return top.groupBy(*group, "field").agg(of("text").alias("sample_texts"), of("href").alias("sample_hrefs"))
