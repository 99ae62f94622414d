"""A bounded event table that a stream writes."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.sources.versions import Pointer


class EventLog:
    """Events that `foreachBatch` hands over, kept while they are young enough and among the
    latest. Each batch is a part of its own; which parts count, the last batch and the newest
    time stand in one pointer, switched once a batch. So a batch that comes again after a
    failure (before the pointer or after it) is in the table once, and what it makes too old
    or too many goes in the same step. `age` (seconds, by the newest time of all batches) and
    `most` (by time, then key) may each be None. Parts that retention has emptied are
    dropped unread; small parts are put together when there are more than `parts`."""

    def __init__(self, spark: SparkSession, folder: str, schema: str, time: str, key: str, age: int | None = None, most: int | None = None, parts: int = 32):
        self.spark, self.folder, self.schema, self.time, self.key = spark, folder, schema, time, key
        self.age, self.most, self.parts = age, most, parts
        self._pointer = Pointer(spark, folder)

    def _micros(self) -> Column:
        return F.unix_micros(F.col(self.time).cast("timestamp"))

    def _retained(self, found: dict) -> DataFrame:
        """The rows of a version: those of its parts that are young enough, the latest of them.
        Rows without a time are older than all others."""
        names = [f"{self.folder}/{p['files']}" for p in found["parts"]]
        rows = self.spark.read.schema(self.schema).parquet(*names) if names else self.spark.createDataFrame([], self.schema)
        if self.age is not None and found["newest"] is not None:
            rows = rows.where(self._micros() > found["newest"] - self.age * 1_000_000)
        if self.most is not None:
            rows = rows.orderBy(F.desc_nulls_last(self.time), F.desc(self.key)).limit(self.most)
        return rows

    def read(self) -> DataFrame:
        return self._retained(self._pointer.read() or {"parts": [], "newest": None})

    def last_batch(self) -> int:
        return (self._pointer.read() or {"batch": -1})["batch"]

    def _part(self, rows: DataFrame, batch: int) -> dict:
        files = f"batch-{batch:010d}-{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.folder}/{files}")
        told = self.spark.read.schema(self.schema).parquet(f"{self.folder}/{files}").agg(F.count(F.lit(1)).alias("rows"), F.min(self._micros()).alias("first"), F.max(self._micros()).alias("last")).first()
        return {"files": files, **told.asDict()}

    def _live(self, parts: list[dict], newest: int | None) -> list[dict]:
        """Parts that may hold a retained row: the newest `most` rows of others are later than
        all of a part that is left out, or its youngest row is too old."""
        floor = newest - self.age * 1_000_000 if self.age is not None and newest is not None else None
        young = [p for p in parts if p["rows"] and (floor is None or (p["last"] is not None and p["last"] > floor))]
        if self.most is None:
            return young
        whole = [p for p in young if p["first"] is not None and (floor is None or p["first"] > floor)]
        later = lambda p: sum(q["rows"] for q in whole if p["last"] is None or q["first"] > p["last"])
        return [p for p in young if later(p) < self.most]

    def write(self, rows: DataFrame, batch: int) -> bool:
        """For `foreachBatch`. False if the batch is in the table already."""
        found = self._pointer.read()
        old = found or {"batch": -1, "newest": None, "parts": [], "gone": []}
        if batch <= old["batch"]:
            return False
        new = self._part(rows.select(*[f.name for f in self.spark.createDataFrame([], self.schema).schema]), batch)
        newest = max((x for x in (old["newest"], new["last"]) if x is not None), default=None)
        parts = self._live([*old["parts"], new], newest)
        if len(parts) > self.parts:
            parts = [self._part(self._retained({"parts": parts, "newest": newest}), batch)]
        kept = {p["files"] for p in parts}
        gone = [p["files"] for p in [*old["parts"], new] if p["files"] not in kept]
        self._pointer.switch(found, {"batch": batch, "newest": newest, "parts": parts, "gone": gone})
        for files in old["gone"]:  # a reader of the version before may still have begun
            self._pointer.remove(files)
        return True
