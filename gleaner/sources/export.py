"""One file out of many tasks: services as a JSON array, or as a Markdown document.

A Spark data source for writing. Each task writes its services to a file of its own in a
staging folder beside the target; when all have, the driver puts those files together, in
the order of their partitions and a block at a time, in a new file that it then moves to
the target. A job that fails takes its staging folder with it and leaves the target as it
was. The order of the rows is that of the table: `services.orderBy("name")` gives a sorted
file. Paths are what pyarrow's file systems reach: a shared folder, hdfs:// or s3://.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from gleaner.plans import schema

NAME = "gleaner_services"
#: Bytes that the driver holds of a part while it puts them together.
BLOCK = 1 << 20


@dataclass
class Written(WriterCommitMessage):
    partition: int
    file: str
    rows: int


def _plain(value):
    """A row as JSON has it: no keys without a value."""
    if isinstance(value, Row):
        return {k: _plain(v) for k, v in value.asDict().items() if v is not None}
    if isinstance(value, dict):
        return {k: _plain(v) for k, v in value.items() if v is not None}
    return [_plain(v) for v in value] if isinstance(value, list) else value


def _described(service: dict) -> str:
    parsed = {k: json.loads(service[k]) for k in ("inputSchema", "outputSchema") if service.get(k)}
    return schema.document(service | parsed)


FORMS = {
    "json": (b"[\n", b",\n", b"\n]\n", lambda s: json.dumps(s, ensure_ascii=False)),
    "markdown": (b"", b"\n\n---\n\n", b"\n", _described),
}


class Export(DataSourceWriter):
    def __init__(self, options: dict[str, str]):
        self.form = options.get("form", "json")
        if self.form not in FORMS:
            raise ValueError(f"form is one of {', '.join(FORMS)}")
        self.path = options["path"]
        self.staging = f"{self.path}.staging-{uuid.uuid4().hex}"

    def _at(self, path: str) -> tuple[fs.FileSystem, str]:
        return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)

    def write(self, iterator: Iterator[Row]) -> Written:
        _, between, _, said = FORMS[self.form]
        at, folder = self._at(self.staging)
        at.create_dir(folder, recursive=True)
        partition = TaskContext.get().partitionId()
        file, rows = f"{folder}/{partition}-{uuid.uuid4().hex}", 0
        with at.open_output_stream(file) as out:
            for row in iterator:
                out.write((between if rows else b"") + said(_plain(row)).encode())
                rows += 1
        return Written(partition, file, rows)

    def commit(self, messages: list[Written | None]) -> None:
        begin, between, end, _ = FORMS[self.form]
        at, target = self._at(self.path)
        _, folder = self._at(self.staging)
        at.create_dir(folder, recursive=True)
        whole, first = f"{folder}/whole", True
        with at.open_output_stream(whole) as out:
            out.write(begin)
            for part in sorted((m for m in messages if m is not None and m.rows), key=lambda m: m.partition):
                out.write(b"" if first else between)
                first = False
                with at.open_input_stream(part.file) as given:
                    while block := given.read(BLOCK):
                        out.write(block)
            out.write(end)
        at.move(whole, target)
        at.delete_dir(folder)

    def abort(self, messages: list[Written | None]) -> None:
        at, folder = self._at(self.staging)
        if at.get_file_info(folder).type == fs.FileType.Directory:
            at.delete_dir(folder)


class ServiceFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def writer(self, schema, overwrite: bool) -> Export:
        return Export(self.options)


def export(services: DataFrame, path: str, form: str = "json") -> None:
    """Writes services to one file; a file that is there is replaced when all is done."""
    spark: SparkSession = services.sparkSession
    spark.dataSource.register(ServiceFiles)
    services.write.format(NAME).option("path", path).option("form", form).mode("append").save()
