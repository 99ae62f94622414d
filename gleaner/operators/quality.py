"""How good records are: what is missing, empty, repeated, and in which shapes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleaner.functions import text as X


def missing(fields: list[str], arrays: tuple[str, ...] = ()) -> Column:
    """Names of required fields without a value."""
    return F.filter(F.array(*[F.when(X.empty_output(f, f in arrays), F.lit(f)) for f in fields]), lambda x: x.isNotNull())


def input_error(required: dict[str, str], total: int = 500_000, single: int = 100_000) -> Column:
    """The first reason to refuse an input row, or null: size caps, then each required
    field's value and kind, in order."""
    lengths = [F.coalesce(F.length(F.col(c).cast("string")), F.lit(0)) for c in required]
    reasons = [F.when(sum(lengths, F.lit(0)) > total, F.lit("INPUT_TOO_LARGE"))]
    reasons += [F.when(n > single, F.lit(f"FIELD_TOO_LARGE:{c}")) for c, n in zip(required, lengths, strict=True)]
    for c, kind in required.items():
        reasons.append(F.when(X.empty_value(F.col(c).cast("string")), F.lit(f"MISSING:{c}")))
        if kind in ("number", "integer"):
            reasons.append(F.when(F.col(c).cast("string").try_cast("double").isNull(), F.lit(f"TYPE:{c}")))
    return F.coalesce(*reasons)


def all_empty(rows: DataFrame, group: list[str], fields: list[str]) -> DataFrame:
    """Groups of records none of whose values is set."""
    some = [F.count_if(~X.empty_output(f)) for f in fields]
    return rows.groupBy(*group).agg(F.count(F.lit(1)).alias("n_records"), sum(some[1:], some[0]).alias("_v")).where("_v = 0").drop("_v")


def empty_ratio(rows: DataFrame, group: list[str], fields: list[str], threshold: float = 0.5, least: int = 2) -> DataFrame:
    """(field, n_empty, n_records, ratio) where the ratio of blank values is reached."""
    total = rows.groupBy(*group).agg(F.count(F.lit(1)).alias("n_records"), *[F.count_if(X.empty_ratio_value(f)).alias(f) for f in fields])
    each = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("n_empty")) for f in fields])
    out = total.where(F.col("n_records") >= least).select(*group, "n_records", F.inline(each))
    return out.withColumn("ratio", F.col("n_empty") / F.col("n_records")).where(F.col("ratio") >= threshold)


def first_samples(rows: DataFrame, group: list[str], value: str, order: str, k: int = 3, cut: int = 80) -> DataFrame:
    """Up to k values a group that aren't blank, by place. The rank filter is pushed
    below the shuffle by Spark, so no group is gathered."""
    w = Window.partitionBy(*group).orderBy(order)
    top = rows.where(~X.empty_ratio_value(value)).withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= k)
    return top.groupBy(*group).agg(F.transform(F.array_sort(F.collect_list(F.struct("_n", F.left(value, F.lit(cut)).alias("v")))), lambda x: x["v"]).alias("samples"))


def signature(fields: list[str]) -> Column:
    return F.concat_ws("||", *[F.concat(F.lit(f"{f}:"), F.when(X.empty_ratio_value(F.col(f).cast("string")), F.lit("")).otherwise(F.col(f).cast("string"))) for f in fields])


def duplicates(rows: DataFrame, group: list[str], fields: list[str], order: str, threshold: float = 1.0, least: int = 3) -> DataFrame:
    """Groups in which one record makes up `threshold` of all: by signatures counted
    first, so that a repeated record is one row before groups meet."""
    sigs = rows.withColumn("_s", signature(fields)).groupBy(*group, "_s").agg(F.count(F.lit(1)).alias("_c"), F.min(order).alias("_o"))
    out = sigs.groupBy(*group).agg(F.sum("_c").alias("n_records"), F.count(F.lit(1)).alias("n_unique"), F.max("_c").alias("largest"), F.max_by("_s", F.struct("_c", -F.col("_o"))).alias("signature"))
    out = out.withColumn("ratio", F.col("largest") / F.col("n_records"))
    return out.where((F.col("n_records") >= least) & (F.col("ratio") >= threshold))


def shape(fields: list[str]) -> Column:
    """Names of populated fields, sorted and joined."""
    return F.array_join(F.array_sort(F.filter(F.array(*[F.when(~X.unpopulated(F.col(f).cast("string")), F.lit(f)) for f in fields]), lambda x: x.isNotNull())), ",")


def leaf_paths(schema: T.StructType, above: str = "") -> list[tuple[str, T.DataType]]:
    """Dotted paths of a record's leaves, in order; an array is one leaf."""
    out = []
    for f in schema.fields:
        path = f"{above}{f.name}"
        out += leaf_paths(f.dataType, f"{path}.") if isinstance(f.dataType, T.StructType) else [(path, f.dataType)]
    return out


def nested_shape(record: str | Column, schema: T.StructType) -> Column:
    """Paths of a record's populated leaves, sorted and joined: a text that isn't empty, an
    array with elements, any other value that isn't null (0 and false are values)."""

    def populated(path: str, kind: T.DataType) -> Column:
        value = reduce(lambda c, name: c.getField(name), path.split("."), record if isinstance(record, Column) else F.col(record))
        if isinstance(kind, T.StringType):
            return F.coalesce(value != "", F.lit(False))
        return F.coalesce(F.size(value) > 0, F.lit(False)) if isinstance(kind, T.ArrayType | T.MapType) else value.isNotNull()

    names = [F.when(populated(path, kind), F.lit(path)) for path, kind in leaf_paths(schema)]
    return F.array_join(F.array_sort(F.array_compact(F.array(*names))), ",")


def shapes(rows: DataFrame, group: list[str], fields: list[str], order: str, signature: Column | None = None) -> DataFrame:
    """The shapes of each group's records: A is the most frequent, ties by first place. A
    record's shape is that of its fields, or the signature given (see nested_shape)."""
    found = rows.withColumn("signature", shape(fields) if signature is None else signature).groupBy(*group, "signature").agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("first"))
    w = Window.partitionBy(*group)
    found = found.withColumn("_r", F.row_number().over(w.orderBy(F.desc("n"), "first"))).withColumn("_n", F.sum("n").over(w))
    return found.where("_n >= 2").select(*group, F.char(64 + F.col("_r")).alias("shape"), "signature", "n", "first")


def shape_fields(found: DataFrame, group: list[str]) -> DataFrame:
    """Fields of groups with two shapes or more: in all of them, or in some."""
    n = found.groupBy(*group).agg(F.count(F.lit(1)).alias("n_shapes")).where("n_shapes >= 2")
    each = found.where("signature <> ''").select(*group, F.explode(F.split("signature", ",")).alias("field")).groupBy(*group, "field").agg(F.count(F.lit(1)).alias("in_shapes"))
    return each.join(n, group).select(*group, "field", "in_shapes", "n_shapes", (F.col("in_shapes") == F.col("n_shapes")).alias("universal"))


def first_shaped(results: DataFrame, key: list[str], arrays: list[str]) -> DataFrame:
    """(key, array, shape, signature, n, first) of each result's first array, in the order
    given, whose records have two shapes or more. Records become signatures in place, so
    only those are counted; a null array or one of fewer than two records says nothing."""
    of = {f.name: f.dataType for f in results.schema if f.name in arrays}
    sigs = lambda name: F.transform(name, lambda r: nested_shape(r, of[name].elementType))
    each = [F.struct(F.lit(i).alias("_at"), F.lit(name).alias("array"), sigs(name).alias("_s")) for i, name in enumerate(arrays)]
    rows = results.select(*key, F.inline(F.array(*each))).select(*key, "_at", "array", F.posexplode("_s").alias("_pos", "_sig"))
    found = shapes(rows, [*key, "_at", "array"], [], "_pos", F.col("_sig"))
    w = Window.partitionBy(*key)
    found = found.withColumn("_kinds", F.count(F.lit(1)).over(Window.partitionBy(*key, "_at"))).where("_kinds > 1")
    return found.withColumn("_first", F.min("_at").over(w)).where("_at = _first").drop("_at", "_kinds", "_first")


def attempt_score(coverage: Column, items: Column, filled: Column) -> Column:
    """100 for required fields present, 10 a record, 5 an average field filled."""
    return coverage * 100.0 + items * 10.0 + F.when(items > 0, filled / items * 5.0).otherwise(0.0)


def best_attempt(scored: DataFrame, group: list[str], score: str, attempt: str) -> DataFrame:
    """The earliest attempt with the highest score."""
    return scored.groupBy(*group).agg(F.max_by(attempt, F.struct(F.col(score), -F.col(attempt))).alias(attempt), F.max(score).alias(score))


def collisions(samples: DataFrame, group: list[str], field: str, values: str) -> DataFrame:
    """Pairs of fields of one group whose sets of samples are the same and not empty: an
    equality join on the set, never all pairs of a group."""
    sets = samples.withColumn("_set", F.array_join(F.array_sort(F.array_distinct(F.filter(F.transform(values, X.trim), lambda v: v != ""))), "\u0001")).where("_set <> ''")
    a, b = sets.select(*group, "_set", F.col(field).alias("field_a")), sets.select(*group, "_set", F.col(field).alias("field_b"))
    return a.join(b, [*group, "_set"]).where("field_a < field_b").select(*group, "field_a", "field_b")


def field_roles(annotations: DataFrame, sample: str, field: str, selector: str) -> DataFrame:
    """Fields over sample pages: in all with one selector, in all with several, or optional."""
    total = annotations.select(F.count_distinct(sample)).scalar()
    out = annotations.groupBy(field).agg(F.count_distinct(sample).alias("n_samples"), F.count_distinct(selector).alias("n_selectors"))
    every = F.col("n_samples") == total
    return out.withColumn("role", F.when(every & (F.col("n_selectors") == 1), "UNIVERSAL").when(every, "SHAPE-DEPENDENT").otherwise("OPTIONAL"))


def intervention(signals: DataFrame, key: list[str], dismissed: tuple[str, ...] = ()) -> DataFrame:
    """The most severe thing a person should do about an attempt: of signals (kind), the
    first by severity, then priority."""
    severity = F.when(F.col("kind").isin("needs_login", "rate_limited"), 3).otherwise(2)
    rank = F.when(F.col("kind") == "needs_login", 100).when(F.col("kind") == "rate_limited", 90).when(F.col("kind") == "page_state_stale", 50)
    rank = rank.when(F.col("kind") == "needs_annotation_relax", 30).otherwise(20)
    some = signals.where(~F.col("kind").isin(*dismissed)) if dismissed else signals
    return some.groupBy(*key).agg(F.max_by("kind", F.struct(severity, rank)).alias("kind"))
