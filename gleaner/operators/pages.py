"""The page store: identity, de-duplication, caps and provenance of captured pages."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.functions.text import squeeze
from gleaner.sources import html as H

#: Attributes that change from one load of a page to the next, and what a
#: generated value of a data attribute looks like.
VOLATILE = ("data-reactid", "nonce", "integrity")
GENERATED = r"[A-Za-z0-9_-]{20,}"

_generated = re.compile(GENERATED).fullmatch


def normal_html(html: str | Column) -> Column:
    """A page as its tree is written: without comments and volatile attributes, attributes in
    order of name, blanks squeezed."""

    def normal(page: str) -> str:
        nodes = H.parse(page)
        for e in nodes:
            e.attrs = {k: v for k, v in sorted(e.attrs.items()) if k not in VOLATILE and not (k.startswith("data-") and _generated(v))}
        return nodes[0].parent.inner() if nodes else page

    def run(pages: pa.Array) -> pa.Array:
        return pa.array([None if x is None else normal(x.as_py()) for x in pages], pa.string())

    return squeeze(F.arrow_udf(run, "string")(html))


def page_key(url: str, html: Column) -> Column:
    return F.sha2(F.concat(F.coalesce(F.col(url), F.lit("")), F.char(F.lit(0)), html), 256)


def deduplicated(captures: DataFrame, job: str, seq: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """The first capture of each page (url and normalised html) of a job: job, seq, the columns
    of `keep`, hash, n_captures, page_number and page_id_text (page_NNNN_xxxxxxxx). Captures
    without html aren't pages. Each is normalised once and only its hash is shuffled; html is
    found again by (job, seq) where it's wanted. A job's pages are numbered in one task."""
    hashed = captures.where("html is not null and html <> ''").select(job, seq, *keep, page_key("url", normal_html("html")).alias("hash"))
    first = hashed.groupBy(job, "hash").agg(F.min(F.struct(seq, *keep)).alias("_f"), F.count(F.lit(1)).alias("n_captures"))
    n = F.row_number().over(Window.partitionBy(job).orderBy(seq))
    out = first.select(job, "_f.*", "hash", "n_captures").withColumn("page_number", n)
    return out.withColumn("page_id_text", F.format_string("page_%04d_%s", "page_number", F.substring("hash", 1, 8)))


def capped(pages: DataFrame, job: str, seq: str, cap: int) -> DataFrame:
    """The first ceil(cap / 10) and the last pages of a job, `cap` in all, with the number
    dropped; a cap of 0 keeps none."""
    first = -(-cap // 10) if cap > 0 else 0
    w = Window.partitionBy(job)
    ranked = pages.withColumn("_n", F.row_number().over(w.orderBy(seq))).withColumn("_all", F.count(F.lit(1)).over(w))
    kept = ranked.where((F.col("_n") <= first) | (F.col("_n") > F.col("_all") - (max(cap, 0) - first)))
    return kept.withColumn("dropped", F.greatest(F.col("_all") - max(cap, 0), F.lit(0)).cast("long")).drop("_n", "_all")


def within_budget(pages: DataFrame, job: str, seq: str, size: str, budget: int) -> DataFrame:
    """A job's pages after taking out the middle one again and again while they are more
    than two and over the budget; 0 is no budget. Which page goes when depends on the places
    alone: from the middle outwards, one on either side in turn, beginning behind it if the
    number is odd and before it if it is even. So a running sum in that order tells what was
    left before each turn, and a page goes if that was over the budget."""
    whole = Window.partitionBy(job)
    n, at = F.count(F.lit(1)).over(whole), F.row_number().over(whole.orderBy(seq)) - 1
    rows = pages.withColumn("_n", n).withColumn("_d", at - F.floor(n / 2))
    near = F.when(F.col("_n") % 2 == 1, F.col("_d") > 0).otherwise(F.col("_d") < 0)
    rows = rows.withColumn("_turn", 2 * F.abs("_d") - near.cast("int"))
    bytes_ = F.coalesce(F.col(size).cast("long"), F.lit(0))
    gone = F.coalesce(F.sum(bytes_).over(whole.orderBy("_turn").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumn("_goes", (F.lit(budget) > 0) & (F.col("_turn") < F.col("_n") - 2) & (F.sum(bytes_).over(whole) - gone > budget))
    rows = rows.withColumn("dropped", F.count_if("_goes").over(whole).cast("long"))
    return rows.where(~F.col("_goes")).select(job, F.col(seq), F.col(size).cast("long").alias(size), "dropped")


def stamped(records: DataFrame, page: str, name: str = "source_page_id") -> DataFrame:
    """Records with the page they come from; one that is set already stays."""
    return records.withColumn(name, F.coalesce(name, page) if name in records.columns else F.col(page))
