"""One small file that says which data files count, switched as a whole."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import SparkSession


class Conflict(RuntimeError):
    """Another writer has switched the pointer meanwhile."""


class Pointer:
    """`_current` in a folder: a JSON object, or nothing yet. It is written beside its place
    and renamed onto it, so a reader sees the old one or the new one, and a writer that dies
    leaves the old one. Works on any file system that Spark can reach; on object stores
    without a rename a table format should be used instead."""

    def __init__(self, spark: SparkSession, folder: str):
        self.folder, self._jvm, self._gateway = folder, spark._jvm, spark.sparkContext._gateway
        self._conf = spark._jsparkSession.sessionState().newHadoopConf()
        self._at = self._path("_current")
        self._fs = self._at.getFileSystem(self._conf)
        self._at = self._fs.makeQualified(self._at)

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")

    def read(self) -> dict | None:
        if not self._fs.exists(self._at):
            return None
        stream = self._fs.open(self._at)
        try:
            return json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def switch(self, before: dict | None, after: dict) -> None:
        """`before` is what the writer began with; if it isn't there any more, nothing is
        changed. (Two writers that look at the same instant aren't kept apart: one writer a
        table, as a stream or a service has, is assumed.)"""
        if self.read() != before:
            raise Conflict(self.folder)
        beside = self._fs.makeQualified(self._path(f"_next-{uuid.uuid4().hex}"))
        out = self._fs.create(beside, False)
        out.write(bytearray(json.dumps(after), "utf-8"))
        out.close()
        kind = getattr(self._jvm.org.apache.hadoop.fs, "Options$Rename")
        how = self._gateway.new_array(kind, 1)
        how[0] = kind.OVERWRITE
        self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self._conf).rename(beside, self._at, how)

    def remove(self, name: str) -> None:
        """Deletes a folder that no version names any more."""
        self._fs.delete(self._path(name), True)
