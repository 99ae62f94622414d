"""Places in an order, for groups of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def measure(rows: DataFrame, column: str) -> Column:
    """A number that never falls along the column's order (it may stay)."""
    kind, c = rows.schema[column].dataType, F.col(column)
    if isinstance(kind, T.NumericType):
        return c.cast("double")
    if isinstance(kind, T.DateType):
        return F.unix_date(c).cast("double")
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(c).cast("double")
    if isinstance(kind, T.TimestampNTZType):  # by the clock, which no time zone sets back
        return F.unix_date(F.to_date(c)) * 86_400.0 + F.hour(c) * 3600 + F.minute(c) * 60 + F.second(c)
    if isinstance(kind, T.StringType):  # the first six bytes that aren't the same in all
        least, most = (x.encode() if x is not None else b"" for x in rows.agg(F.min(c), F.max(c)).first())
        same = next((i for i, (a, b) in enumerate(zip(least, most, strict=False)) if a != b), min(len(least), len(most)))
        return F.conv(F.rpad(F.substring(F.hex(c), 2 * same + 1, 12), 12, "0"), 16, 10).cast("double")
    raise TypeError(f"{column}: no places by {kind.simpleString()}")


def _parted(rows: DataFrame, column: str, ranges: int) -> DataFrame:
    """rows with `_part`, the range of the column's values that a row is in."""
    by = measure(rows, column)
    ends = sorted(set(rows.select(by.alias("v")).approxQuantile("v", [i / ranges for i in range(1, ranges)], 0.5 / ranges)))
    return rows.withColumn("_part", F.size(F.filter(F.array(*[F.lit(x) for x in ends]), lambda x: x < by)) if ends else F.lit(0))


def _moved(rows: DataFrame, group: list[str], sizes: DataFrame, own: str, name: str) -> DataFrame:
    """own, a row's value within its range, and what the ranges before have (sizes: `_c`)."""
    before = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    sizes = sizes.select(*[F.col(g).alias(f"_g{i}") for i, g in enumerate(group)], F.col("_part").alias("_p"), F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_b"))
    same = [F.col(g).eqNullSafe(F.col(f"_g{i}")) for i, g in enumerate(group)]
    out = rows.join(sizes, [*same, F.col("_part") == F.col("_p")])
    return out.withColumn(name, (F.col(own) + F.col("_b")).cast("long")).drop("_part", own, "_p", "_b", *[f"_g{i}" for i in range(len(group))])


def summed(rows: DataFrame, group: list[str], order: str, value: Column, name: str, ranges: int = 64) -> DataFrame:
    """Rows with the sum of a whole number over those of their group up to them, in the order of
    `order` (rows equal in it have one sum). As in `numbered`, a group is as many tasks as
    there are ranges."""
    placed = _parted(rows.withColumn("_v", value.cast("long")), order, ranges)
    sizes = placed.groupBy(*group, "_part").agg(F.sum("_v").alias("_c"))
    own = placed.withColumn("_n", F.coalesce(F.sum("_v").over(Window.partitionBy(*group, "_part").orderBy(order)), F.lit(0))).drop("_v")
    return _moved(own, group, sizes, "_n", name)


def numbered(rows: DataFrame, group: list[str], order: list[str], name: str, ranges: int = 64) -> DataFrame:
    """Rows with their place in their group, from 1, in the order of `order`, which should
    be total (nulls come first). Rows are ranked within ranges of the first column and moved
    by the ranges before, so that one group with all rows is as many tasks as there are
    ranges. The ends of ranges, at most `ranges` numbers, are approximate quantiles of all
    rows: where they lie changes no place. Rows with one value of the first column stay in
    one range. `rows` is read three times: give written rows, or cheap ones."""
    placed = _parted(rows, order[0], ranges)
    sizes = placed.groupBy(*group, "_part").agg(F.count(F.lit(1)).alias("_c"))
    own = placed.withColumn("_n", F.row_number().over(Window.partitionBy(*group, "_part").orderBy(*order)))
    return _moved(own, group, sizes, "_n", name)
