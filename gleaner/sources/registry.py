"""The service registry: whole versions of a table of services, and who may change it."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.operators.steps import problems
from gleaner.sources import store
from gleaner.sources.versions import Pointer

SCHEMA = f"{store.SERVICE}, config struct<timeoutMs:bigint,maxRetries:bigint>, updatedAt long"
#: Defaults of old services, and those that take their place.
OLD_TIMEOUT, TIMEOUT, OLD_RETRIES, RETRIES = 30_000, 60_000, 2, 1


class Refused(ValueError):
    """Services that can't be saved; `problems` has (id, step, problem) rows."""

    def __init__(self, found: DataFrame):
        first = found.orderBy("graph", "id", "problem").first()
        super().__init__(f"service {first['graph']}, step {first['id']}: {first['problem']}")
        self.problems = found.select(F.col("graph").alias("id"), F.col("id").alias("step"), "problem")


def service_steps(services: DataFrame) -> DataFrame:
    """The steps of services as a table of graphs; a service without steps has no rows."""
    rows = services.select(F.col("id").alias("graph"), F.posexplode("steps").alias("ordinal", "s"))
    return rows.select(
        "graph", F.col("s.id").alias("id"), "ordinal", F.col("s.script").alias("script"), F.col("s.onSuccess").alias("on_success"),
        F.col("s.onFailure").alias("on_failure"), F.col("s.maxIterations").alias("max_iterations"),
    )


class Registry:
    """Services by id. A change writes all services of its outcome as a new version, then
    switches the pointer: readers have one version or the next, whenever they look, and a
    write that is cut off leaves files that no version names. The two last versions stay,
    for readers that have begun."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder, self._pointer = spark, folder, Pointer(spark, folder)

    def version(self) -> int:
        return (self._pointer.read() or {"version": 0})["version"]

    def _at(self, found: dict | None) -> DataFrame:
        if found is None or found["files"] is None:
            return self.spark.createDataFrame([], SCHEMA)
        return self.spark.read.schema(SCHEMA).parquet(f"{self.folder}/{found['files']}")

    def read(self) -> DataFrame:
        """All services. Timeouts and retries that are old defaults come as today's."""
        config = F.struct(
            F.when(F.col("config.timeoutMs") == OLD_TIMEOUT, TIMEOUT).otherwise(F.col("config.timeoutMs")).alias("timeoutMs"),
            F.when(F.col("config.maxRetries") == OLD_RETRIES, RETRIES).otherwise(F.col("config.maxRetries")).alias("maxRetries"),
        )
        return self._at(self._pointer.read()).withColumn("config", F.when(F.col("config").isNotNull(), config))

    def find(self, name: str) -> DataFrame:
        """By name or shown name."""
        return store.find(self.read(), name)

    def by_id(self, service_id: str) -> DataFrame:
        return self.read().where(F.col("id") == service_id)

    def save(self, changes: DataFrame, now: int) -> int:
        """Puts services in the place of those with their ids, or adds them. All or none:
        Refused if any has a broken chain of steps, no id, or comes twice."""
        changes = changes.select(*[F.col(f.name) if f.name in changes.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in self.spark.createDataFrame([], SCHEMA).schema])
        changes = changes.withColumn("updatedAt", F.lit(now).cast("long"))
        twice = changes.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1 or id is null")
        twice = twice.select(F.col("id").alias("graph"), F.lit(None).cast("string").alias("id"), F.when(F.col("graph").isNull(), "NO_ID").otherwise("REPEATED_SERVICE").alias("problem"))
        found = store.kept(problems(service_steps(changes)).unionByName(twice), "refused")
        if found.take(1):
            raise Refused(found)
        return self._write(lambda rows: store.upserted(rows, changes))

    def delete(self, gone: DataFrame) -> int:
        """Takes out the services that `gone` has the ids of."""
        return self._write(lambda rows: store.deleted(rows, gone, "id"))

    def clear(self) -> int:
        found = self._pointer.read()
        return self._switch(found, None)

    def _write(self, change) -> int:
        found = self._pointer.read()
        files = f"services-{uuid.uuid4().hex}"
        change(self._at(found)).write.parquet(f"{self.folder}/{files}")
        return self._switch(found, files)

    def _switch(self, found: dict | None, files: str | None) -> int:
        old = found or {"version": 0, "files": None, "before": None}
        self._pointer.switch(found, {"version": old["version"] + 1, "files": files, "before": old["files"]})
        if old["before"]:
            self._pointer.remove(old["before"])
        return old["version"] + 1
