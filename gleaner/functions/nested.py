"""Results of any nesting made smaller, from their schema: expressions, no Python in tasks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleaner.functions.text import capped_html

#: Fields that say nothing to a reader of results.
PAGE_FIELDS, SNAPSHOT_FIELDS = ("pages", "pagesTruncated", "sourcePageId"), ("snapshot",)
#: Records and other items that are kept of an array.
RECORDS, ITEMS = 3, 20


def pruned(value: Column, kind: T.DataType, drop: tuple[str, ...] = (), cap: int | None = None) -> Column:
    """The value without the fields named in `drop`, at any depth, and with texts of more
    than `cap` characters cut. Nulls stay nulls; a struct left without fields is null."""
    inside = lambda v, k: pruned(v, k, drop, cap)
    if isinstance(kind, T.StructType):
        kept = [inside(value.getField(f.name), f.dataType).alias(f.name) for f in kind if f.name not in drop]
        return F.when(value.isNotNull(), F.struct(*kept)) if kept else F.lit(None).cast("string")
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda x: inside(x, kind.elementType))
    if isinstance(kind, T.MapType):
        return F.transform_values(F.map_filter(value, lambda k, _: ~k.isin(*drop)) if drop else value, lambda _, x: inside(x, kind.valueType))
    return capped_html(value, cap) if cap and isinstance(kind, T.StringType) else value


def sampled(value: Column, kind: T.DataType, records: int = RECORDS, items: int = ITEMS) -> Column:
    """The value with the first records and items of its arrays, at any depth (a sampling
    operator). Beside each array of a struct stands <name>_omitted, how many were left
    out; a field `steps` is never cut, what is in it is."""

    def array(v: Column, k: T.ArrayType, whole: bool = False) -> Column:
        keep = records if isinstance(k.elementType, T.StructType) else items
        return F.transform(v if whole else F.slice(v, 1, keep), lambda x: sampled(x, k.elementType, records, items))

    if isinstance(kind, T.ArrayType):
        return array(value, kind)
    if not isinstance(kind, T.StructType):
        return value
    kept = []
    for f in kind:
        v = value.getField(f.name)
        if isinstance(f.dataType, T.ArrayType):
            whole = f.name == "steps"
            out = array(v, f.dataType, whole)
            kept += [out.alias(f.name), (F.size(v) - F.size(out)).cast("long").alias(f"{f.name}_omitted")] if not whole else [out.alias(f.name)]
        else:
            kept.append(sampled(v, f.dataType, records, items).alias(f.name))
    return F.when(value.isNotNull(), F.struct(*kept))


#: Fixed value: where a record says which page it comes from.
SOURCE = "sourcePageId"


def _with_source(value: Column, kind: T.StructType, page: Column) -> Column:
    own = value.getField(SOURCE) if SOURCE in kind.fieldNames() else F.lit(None).cast("string")
    return F.struct(*[value.getField(f.name).alias(f.name) for f in kind if f.name != SOURCE], F.coalesce(own, page.cast("string")).alias(SOURCE))


def stamped(value: Column, kind: T.StructType, page: Column) -> Column:
    """A result whose records say which page they come from: those of every array right in it,
    or, where none of its arrays is there, the result itself. What is said already stays;
    arrays of other things are left as they are."""
    lists = [f for f in kind if isinstance(f.dataType, T.ArrayType)]
    flat = F.lit(True)
    for f in lists:
        flat = flat & value.getField(f.name).isNull()

    def field(f: T.StructField) -> Column:
        v = value.getField(f.name)
        if isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, T.StructType):
            return _records(v, f.dataType.elementType, page).alias(f.name)
        return v.alias(f.name)

    own = value.getField(SOURCE) if SOURCE in kind.fieldNames() else F.lit(None).cast("string")
    said = F.when(flat, F.coalesce(own, page.cast("string"))).otherwise(own)
    return F.when(value.isNotNull(), F.struct(*[field(f) for f in kind if f.name != SOURCE], said.alias(SOURCE)))


def _records(v: Column, kind: T.StructType, page: Column) -> Column:
    return F.transform(v, lambda x: F.when(x.isNotNull(), _with_source(x, kind, page)))
