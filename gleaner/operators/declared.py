"""Quality of nested results by the schema that declares them.

A JSON Schema and the Spark type of a result column become column expressions: which required
values are missing, which lists were found but came out empty, how often a field is blank,
how good an attempt is. Each is one projection of the row, however deep the result is and
however long its lists are; nothing is exploded but for repeated records, which are counted
by their signatures before those of a result meet.

A key that the type doesn't have is missing, like a null. Four kinds of empty are told apart:
E2 (null, '', an empty list), E3 (the same, of a record's values), E4 (E3, and blank texts)
and deep (E3, and objects all of whose values are empty). Numbers and truth values are never
empty.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleaner.functions.text import trim
from gleaner.operators import quality as Q
from gleaner.plans.schema import kind


def empty(value: Column, of: T.DataType, blank: bool = False, deep: bool = False) -> Column:
    """Whether a value is empty: E2 and E3, with `blank` E4."""
    said = F.lit(False)
    if isinstance(of, T.StringType):
        said = (trim(value) if blank else value) == ""
    elif isinstance(of, T.ArrayType):
        said = F.size(value) == 0
    elif deep and isinstance(of, T.StructType):
        said = reduce(lambda a, b: a & b, [empty(value[f.name], f.dataType, blank, deep) for f in of.fields], F.lit(True))
    elif deep and isinstance(of, T.MapType):
        said = F.forall(F.map_values(value), lambda v: empty(v, of.valueType, blank, deep))
    return value.isNull() | F.coalesce(said, F.lit(False))


def _named(c: Column, of: T.DataType, name: str) -> tuple[Column, T.DataType] | None:
    if isinstance(of, T.StructType) and name in of.fieldNames():
        return c.getField(name), of[name].dataType
    return (c[name], of.valueType) if isinstance(of, T.MapType) else None


@dataclass(frozen=True)
class Declared:
    """A schema over a result column of a Spark type."""

    schema: dict
    result: Column
    of: T.DataType

    @staticmethod
    def column(rows: DataFrame, name: str, schema: dict) -> Declared:
        return Declared(schema or {}, F.col(name), rows.schema[name].dataType)

    @property
    def required(self) -> list[str]:
        found = self.schema.get("required")
        return list(found) if isinstance(found, list) else []

    def is_object(self) -> bool:
        return isinstance(self.of, T.StructType | T.MapType)

    def value(self, name: str) -> tuple[Column, T.DataType] | None:
        return _named(self.result, self.of, name)

    def unwrapped(self) -> Declared:
        """The result's `data`, where it has that."""
        inner = _named(self.result, self.of, "data") if isinstance(self.of, T.StructType) else None
        return Declared(self.schema, *inner) if inner else self

    def lists(self) -> list[tuple[str, Column, T.StructType, list[str]]]:
        """Declared lists of objects that the type has: (name, list, type of a record, fields to
        look at: those that records require, or else have)."""
        out = []
        for name, prop in (self.schema.get("properties") or {}).items():
            items, here = prop.get("items") or {}, self.value(name)
            if kind(prop) != "array" or kind(items) != "object" or here is None:
                continue
            if not isinstance(here[1], T.ArrayType) or not isinstance(here[1].elementType, T.StructType):
                continue
            fields = items.get("required") or list(items.get("properties") or {})
            if fields:
                out.append((name, here[0], here[1].elementType, list(fields)))
        return out


def _none_of(names: list[str]) -> Column:
    return F.array(*[F.lit(n) for n in names]).cast("array<string>")


def missing(declared: Declared) -> Column:
    """Required outputs that are empty (E2), in the order required; all of them where the
    result, or the `data` in it, isn't an object or is null."""
    data = declared.unwrapped()
    if not data.required or not data.is_object():
        return _none_of(data.required)
    each = []
    for name in data.required:
        here = data.value(name)
        each.append(F.lit(name) if here is None else F.when(empty(*here), F.lit(name)))
    return F.when(data.result.isNull(), _none_of(data.required)).otherwise(F.array_compact(F.array(*each)))


def _hollow(item: T.StructType):
    """A test of a record: there, and without a value."""
    return lambda r: r.isNotNull() & reduce(lambda a, b: a & b, [empty(r[f.name], f.dataType) for f in item.fields], F.lit(True))


def _text(of: T.DataType):
    """A value as text."""
    if isinstance(of, T.StringType):
        return lambda v: v
    return F.to_json if isinstance(of, T.ArrayType | T.StructType | T.MapType) else lambda v: v.cast("string")


def _filled(value: Column, field: str, of: T.DataType) -> Column:
    """A field's values in a list of records, blank ones left out."""
    return F.filter(F.transform(value, lambda r: r[field]), lambda v: ~empty(v, of, blank=True))


def _samples(filled: Column, of: T.DataType, n: int, cut: int) -> Column:
    text = _text(of)
    return F.transform(F.slice(filled, 1, n), lambda v: F.substring(text(v), 1, cut) if isinstance(of, T.StringType) else text(v))


def _signature(item: T.StructType, fields: list[str]):
    """A record's declared fields as one text; null for none."""

    def said(r: Column, field: str) -> Column:
        if field not in item.fieldNames():
            return F.lit(f"{field}:")
        v, of = r[field], item[field].dataType
        return F.concat(F.lit(f"{field}:"), F.when(empty(v, of, blank=True), F.lit("")).otherwise(_text(of)(v)))

    return lambda r: F.when(r.isNotNull(), F.concat_ws("||", *[said(r, f) for f in fields]))


def _share(item: T.StructType, inner: list[str]):
    """The share of a record's declared fields that are set."""
    fields = [f for f in item.fields if f.name in inner]
    return lambda r: sum([(~empty(r[f.name], f.dataType, deep=True)).cast("double") for f in fields], F.lit(0.0)) / len(inner)


def empty_lists(declared: Declared) -> Column:
    """Required lists that were found empty though records are declared, or whose records are
    all objects without a value (E3)."""
    if not declared.is_object():
        return _none_of([])
    objects = {name for name, prop in (declared.schema.get("properties") or {}).items() if kind(prop) == "array" and kind(prop.get("items") or {}) == "object"}
    each = []
    for name in declared.required:
        here = declared.value(name)
        if here is None or not isinstance(here[1], T.ArrayType):
            continue
        value, item = here[0], here[1].elementType
        found = F.lit(False)
        if name in objects:
            found = F.size(value) == 0
        if isinstance(item, T.StructType):
            found = found | ((F.size(value) > 0) & F.forall(value, _hollow(item)))
        each.append(F.when(value.isNotNull() & found, F.lit(name)))
    return F.array_compact(F.array(*each)) if each else _none_of([])


def blank_fields(declared: Declared, threshold: float = 0.5, least: int = 2, samples: int = 3, cut: int = 80) -> Column:
    """array of struct(path, n_empty, n_records, ratio, samples): declared fields that are blank
    (E4) in a share of `threshold` or more of a list's records, with the first values that
    aren't. Lists of fewer than `least` records say nothing; with 1.0 only fields that never
    had a value are told. A record that is null is blank in every field."""
    each = []
    for name, value, item, fields in declared.lists() if declared.is_object() else []:
        for field in fields:
            if field in item.fieldNames():
                filled = _filled(value, field, item[field].dataType)
                some, n_empty = _samples(filled, item[field].dataType, samples, cut), F.size(value) - F.size(filled)
            else:
                some, n_empty = _none_of([]), F.size(value)
            ratio = n_empty / F.size(value)
            told = F.struct(F.lit(f"{name}.{field}").alias("path"), n_empty.cast("long").alias("n_empty"), F.size(value).cast("long").alias("n_records"), ratio.alias("ratio"), some.alias("samples"))
            each.append(F.when(value.isNotNull() & (F.size(value) >= least) & (ratio >= threshold), told))
    if not each:
        return F.array().cast("array<struct<path:string,n_empty:bigint,n_records:bigint,ratio:double,samples:array<string>>>")
    return F.array_compact(F.array(*each))


def repeated_records(rows: DataFrame, key: list[str], name: str, schema: dict, threshold: float = 1.0, least: int = 3) -> DataFrame:
    """(key, list, n_records, n_unique, largest, signature, ratio): lists of results in which one
    record makes up a share of `threshold` or more. A record is its declared fields, blank
    ones alike; records without a value are no record but count in the length."""
    declared = Declared.column(rows, name, schema)
    found = []
    for at, (of_list, value, item, fields) in enumerate(declared.lists()):
        some = rows.where(F.size(value) >= least).select(*key, F.lit(at).alias("_at"), F.lit(of_list).alias("list"), F.size(value).cast("long").alias("n_records"), F.posexplode(F.transform(value, _signature(item, fields))).alias("_pos", "_s"))
        found.append(some)
    if not found:
        kinds = "list string, n_records bigint, n_unique bigint, largest bigint, signature string, ratio double"
        return rows.select(*key).where("false").select(*key, *[F.lit(None).cast(k.split()[1]).alias(k.split()[0]) for k in kinds.split(", ")])
    every = reduce(lambda a, b: a.union(b), found).where("_s is not null")
    by = every.groupBy(*key, "_at", "list", "n_records", "_s").agg(F.count(F.lit(1)).alias("_c"), F.min("_pos").alias("_o"))
    out = by.groupBy(*key, "_at", "list", "n_records").agg(F.count(F.lit(1)).alias("n_unique"), F.max("_c").alias("largest"), F.max_by("_s", F.struct("_c", -F.col("_o"))).alias("signature"))
    return out.withColumn("ratio", F.col("largest") / F.col("n_records")).where(F.col("ratio") >= threshold).drop("_at")


def score(declared: Declared) -> Column:
    """struct(score, is_data, coverage, items, filled) of an attempt: 100 for the share of
    required fields that aren't empty (deep), 10 for each item of the list scored, 5 for the
    average share of an item's declared fields that are set. The list is the result's first
    that is there and declared as one. What isn't an object, or has no schema, is no data."""
    zero = F.lit(0.0)
    told = lambda is_data, coverage, items, filled: F.struct((coverage * 100.0 + items * 10.0 + filled * 5.0).alias("score"), F.lit(is_data).alias("is_data"), coverage.alias("coverage"), items.cast("long").alias("items"), filled.alias("filled"))
    nothing = told(False, zero, F.lit(0), zero)
    if not declared.is_object() or not declared.schema:
        return nothing
    kept = [here for here in map(declared.value, declared.required) if here is not None]
    satisfied = sum([(~empty(*here, deep=True)).cast("double") for here in kept], zero)
    coverage = satisfied / len(declared.required) if declared.required else zero
    props, choices = declared.schema.get("properties") or {}, []
    for field in declared.of.fields if isinstance(declared.of, T.StructType) else []:
        prop = props.get(field.name)
        if not isinstance(field.dataType, T.ArrayType) or not prop or kind(prop) != "array":
            continue
        value, item = declared.result.getField(field.name), field.dataType.elementType
        inner = list((prop.get("items") or {}).get("properties") or {})
        filled = zero
        if inner and isinstance(item, T.StructType):
            shares = F.transform(F.filter(value, lambda r: r.isNotNull()), _share(item, inner))
            filled = F.when(F.size(shares) > 0, F.aggregate(shares, zero, lambda a, x: a + x) / F.size(shares)).otherwise(zero)
        choices.append(F.when(value.isNotNull(), F.struct(F.size(value).alias("items"), filled.alias("filled"))))
    none = F.struct(F.lit(0).alias("items"), zero.alias("filled"))
    best = F.coalesce(*choices, none) if choices else none
    return F.when(declared.result.isNull(), nothing).otherwise(told(True, coverage, best["items"], best["filled"]))


def best_attempts(rows: DataFrame, group: list[str], attempt: str, name: str, schema: dict) -> DataFrame:
    """The earliest attempt with the highest score of each group; attempts that are no data
    aren't considered. Scores are equal that don't differ in six decimals: shares that are
    added up in another order differ in their last bits."""
    scored = rows.select(*group, attempt, score(Declared.column(rows, name, schema)).alias("_s")).where("_s.is_data")
    return Q.best_attempt(scored.select(*group, attempt, F.round("_s.score", 6).alias("score")), group, "score", attempt)
