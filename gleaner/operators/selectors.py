"""Selector algebra over tables of annotations."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.functions.text import item_like, normal_segment, stable_signature, strip_positional


def segments(selector: str | Column) -> Column:
    """A selector's compounds with the combinator before each (' ' or '>'); brackets and
    quotes hold together."""
    cut = re.compile(r"""(?:\[[^\]]*\]|\([^()]*(?:\([^()]*\)[^()]*)*\)|[^\s>\[\(])+|>""")

    def run(column: pa.Array) -> pa.Array:
        out = []
        for text in column.to_pylist():
            row, child = [], False
            for token in cut.findall(text or ""):
                if token == ">":
                    child = True
                else:
                    row.append({"seg": token, "child": child})
                    child = False
            out.append(row)
        return pa.array(out, pa.list_(pa.struct([("seg", pa.string()), ("child", pa.bool_())])))

    return F.arrow_udf(run, "array<struct<seg:string,child:boolean>>")(selector)


def common_prefix(rows: DataFrame, group: list[str], selector: str, most: int = 8) -> DataFrame:
    """(container, depth) of a group's selectors: the longest prefix of segments, without
    positions, that all share, shorter than the shortest. Segments are counted by place,
    so a group of any size is a few partial sums."""
    s = rows.select(*group, segments(selector).alias("_s"))
    size = s.groupBy(*group).agg(F.count(F.lit(1)).alias("_n"), F.min(F.size("_s")).alias("_least"))
    each = s.select(*group, F.posexplode("_s").alias("at", "x")).where(F.col("at") < most)
    by = each.groupBy(*group, "at", strip_positional("x.seg").alias("seg")).agg(F.count(F.lit(1)).alias("c"), F.min("x.child").alias("child"))
    same = by.join(size, group).where("c = _n and at < _least - 1")
    w = Window.partitionBy(*group).orderBy("at")
    run = same.withColumn("_i", F.row_number().over(w)).where("_i = at + 1")
    joined = F.array_sort(F.collect_list(F.struct("at", "seg", "child")))
    text = F.aggregate("_l", F.lit(""), lambda a, x: F.when(x["at"] == 0, x["seg"]).otherwise(F.concat(a, F.when(x["child"], " > ").otherwise(" "), x["seg"])))
    return run.groupBy(*group).agg(joined.alias("_l")).select(*group, text.alias("container"), F.size("_l").cast("long").alias("depth"))


def _suffixes(annotations: DataFrame, output: str, selector: str) -> DataFrame:
    """(array, container, field, sub_selector, n_forms): what leads from an array's container to
    a field, and in how many forms."""
    a = annotations.withColumn("array", F.element_at(F.split(output, r"\."), 1)).withColumn("field", F.regexp_replace(output, r"^[^.]*\.?", "")).where("field <> ''")
    found = common_prefix(a, ["array"], selector)
    rest = a.join(found, "array").withColumn("_s", segments(selector))
    suffix = F.slice("_s", F.col("depth").cast("int") + 1, F.greatest(F.size("_s") - F.col("depth").cast("int"), F.lit(0)))
    text = lambda f: F.array_join(F.transform(suffix, lambda x: f(x["seg"])), " ")
    parts = rest.select("array", "container", "field", text(strip_positional).alias("sub_selector"), text(stable_signature).alias("_sig"))
    return parts.groupBy("array", "container", "field").agg(F.min("sub_selector").alias("sub_selector"), F.count_distinct("_sig").alias("n_forms"))


def list_patterns(annotations: DataFrame, output: str = "output_field", selector: str = "selector") -> DataFrame:
    """(array, container, field, sub_selector) from annotations of the same field on several
    items. A field whose items differ in more than positions and generated classes is a
    conflict and has no row (see `list_conflicts`)."""
    return _suffixes(annotations, output, selector).where("n_forms = 1").drop("n_forms")


def list_conflicts(annotations: DataFrame, output: str = "output_field", selector: str = "selector") -> DataFrame:
    """(array, container, field, n_forms): the fields that `list_patterns` leaves out, however
    many annotations agree on one form."""
    return _suffixes(annotations, output, selector).where("n_forms > 1").drop("sub_selector")


def click_templates(clicks: DataFrame, patterns: DataFrame, selector: str = "selector", order: str = "place", most: int = 8) -> DataFrame:
    """(container, sub_selector) of clicks to repeat in every item: each click belongs to the
    first pattern, by `order`, whose container it begins with, positions aside. Clicks meet
    patterns by equal beginnings; a click on a container itself has no row."""
    key = lambda s: F.array_join(F.transform(s, lambda x: strip_positional(x["seg"])), "\n")
    known = patterns.select("container", F.col(order).alias("_o"), segments("container").alias("_c")).select("container", "_o", key("_c").alias("_key"))
    each = clicks.select(F.col(selector).alias("_click")).distinct().withColumn("_s", segments("_click")).where(F.size("_s") > 0)
    heads = each.select("*", F.explode(F.sequence(F.lit(1), F.least(F.size("_s"), F.lit(most)))).alias("_n")).withColumn("_key", key(F.slice("_s", 1, F.col("_n"))))
    best = heads.join(known, "_key").groupBy("_click").agg(F.min_by(F.struct("container", F.slice("_s", F.col("_n") + 1, F.size("_s")).alias("rest")), "_o").alias("b"))
    step = lambda a, x: F.concat(a, F.when(a == "", "").when(x["child"], " > ").otherwise(" "), strip_positional(x["seg"]))
    return best.select("b.container", F.aggregate("b.rest", F.lit(""), step).alias("sub_selector")).where("sub_selector <> ''").distinct()


def clusters(annotations: DataFrame, path: str = "dom_path") -> DataFrame:
    """(depth, confidence, segment, n): annotations by the segment at the first depth where
    they part into item-like elements, else the first where two groups hold two or more."""
    each = annotations.select(F.posexplode(F.split(path, r"\s*>\s*")).alias("depth", "segment"))
    by = each.groupBy("depth", "segment").agg(F.count(F.lit(1)).alias("n"))
    level = by.groupBy("depth").agg(F.count(F.lit(1)).alias("kinds"), F.bool_and(item_like("segment")).alias("items"), F.count_if(F.col("n") >= 2).alias("pairs"), F.count_distinct(normal_segment("segment")).alias("forms"))
    fit = level.where("kinds > 1 and (items or pairs >= 2)")
    best = fit.agg(F.min(F.struct((~F.col("items")).alias("low"), "depth")).alias("b")).select(F.col("b.depth").alias("depth"), F.when(F.col("b.low"), "LOW").otherwise("HIGH").alias("confidence"))
    return by.join(best, "depth").select("depth", "confidence", "segment", "n")


def contained(elements: DataFrame, key: list[str], order: str, html: str, least: int = 24) -> DataFrame:
    """Each element that stands in another of its page, with the first that holds it. The
    pairs are those of one page, whose elements are bounded by the page."""
    a = elements.select(*key, F.col(order).alias("inner"), F.col(html).alias("_a"))
    b = elements.select(*key, F.col(order).alias("holder"), F.col(html).alias("_b"))
    shorter = (F.length("_a") < F.length("_b")) & (F.length("_a") >= least)
    equal = (F.col("_a") == F.col("_b")) & (F.col("inner") > F.col("holder"))
    met = a.join(b, key).where((F.col("inner") != F.col("holder")) & F.col("_b").contains(F.col("_a")) & (shorter | equal))
    return met.groupBy(*key, "inner").agg(F.min("holder").alias("holder"))
