"""Lines of a table of any size in one order: numbered parts that tasks write side by side, and a manifest that holds them together."""

from __future__ import annotations

import json
import posixpath
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

MANIFEST = "_manifest.json"
#: Lines of one Arrow batch.
BATCH = 10_000


@dataclass
class Part(WriterCommitMessage, InputPartition):
    """A written part: its place in the order, its file, and how many lines and bytes it has; `before` counts the lines ahead of it."""

    place: int
    file: str
    lines: int
    size: int
    before: int = 0


class OrderedWriter(DataSourceWriter):
    """Each partition of the table becomes one part, in the partitions' order.

    Parts have names of their own, so a task that runs twice leaves two files, of which the manifest
    names one; commit deletes the folder's other parts, abort those of the failed job. Readers
    follow the manifest, which is moved into place last, so they see the old table or the new one.
    """

    def __init__(self, options: dict):
        self.path, self.end = options["path"], options.get("lineEnd", "\n")

    def write(self, iterator: Iterator[Row]) -> Part:
        store, root = fs.FileSystem.from_uri(self.path)
        store.create_dir(root, recursive=True)
        place = TaskContext.get().partitionId()
        name, lines, size = f"part-{place:06d}-{uuid.uuid4().hex}", 0, 0
        try:
            with store.open_output_stream(posixpath.join(root, name)) as f:
                for row in iterator:
                    data = (row[0] + self.end).encode()
                    f.write(data)
                    lines += 1
                    size += len(data)
        except BaseException:
            _delete(store, root, {name})
            raise
        return Part(place, name, lines, size)

    def commit(self, messages: list[Part | None]) -> None:
        store, root = fs.FileSystem.from_uri(self.path)
        parts, lines, offset = [], 0, 0
        for m in sorted((m for m in messages if m is not None), key=lambda m: m.place):
            parts.append({"file": m.file, "lines": m.lines, "bytes": m.size, "first_line": lines, "offset": offset})
            lines, offset = lines + m.lines, offset + m.size
        hidden = posixpath.join(root, f".{uuid.uuid4().hex}")
        with store.open_output_stream(hidden) as f:
            f.write(json.dumps({"line_end": self.end, "lines": lines, "bytes": offset, "parts": parts}).encode())
        store.move(hidden, posixpath.join(root, MANIFEST))
        named = {p["file"] for p in parts}
        found = store.get_file_info(fs.FileSelector(root))
        _delete(store, root, {f.base_name for f in found if f.base_name.startswith("part-")} - named)

    def abort(self, messages: list[Part | None]) -> None:
        store, root = fs.FileSystem.from_uri(self.path)
        _delete(store, root, {m.file for m in messages if m is not None})


class OrderedReader(DataSourceReader):
    """(number, line) of the parts that the manifest names; number counts from 0 through all parts."""

    def __init__(self, options: dict):
        self.path = options["path"]

    def manifest(self) -> dict:
        store, root = fs.FileSystem.from_uri(self.path)
        with store.open_input_stream(posixpath.join(root, MANIFEST)) as f:
            return json.loads(f.read())

    def partitions(self) -> list[Part]:
        parts = self.manifest()["parts"]
        return [Part(i, p["file"], p["lines"], p["bytes"], p["first_line"]) for i, p in enumerate(parts)] or [Part(0, "", 0, 0)]

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        if not partition.lines:
            return
        store, root = fs.FileSystem.from_uri(self.path)
        end, number, rest, lines = self.manifest()["line_end"].encode(), partition.before, b"", []
        with store.open_input_stream(posixpath.join(root, partition.file)) as f:
            while data := f.read(1 << 20):
                *done, rest = (rest + data).split(end)
                lines += done
                while len(lines) >= BATCH:
                    yield _numbered(lines[:BATCH], number)
                    lines, number = lines[BATCH:], number + BATCH
        if lines:
            yield _numbered(lines, number)


def _numbered(lines: list[bytes], first: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(range(first, first + len(lines)), pa.int64()), pa.array([x.decode() for x in lines])], ["number", "line"])


def _delete(store: fs.FileSystem, root: str, names: set[str]) -> None:
    for info in store.get_file_info([posixpath.join(root, n) for n in sorted(names)]):
        if info.type == fs.FileType.File:
            store.delete_file(info.path)


class OrderedLines(DataSource):
    """spark.read.format("ordered_lines") and df.write.format("ordered_lines"); options path and lineEnd. Paths are those of pyarrow's file systems."""

    @classmethod
    def name(cls) -> str:
        return "ordered_lines"

    def schema(self) -> str:
        return "number bigint, line string"

    def reader(self, schema) -> OrderedReader:
        return OrderedReader(self.options)

    def writer(self, schema, overwrite: bool) -> OrderedWriter:
        if not overwrite:
            raise ValueError("ordered_lines: a table is replaced whole; use mode('overwrite')")
        return OrderedWriter(self.options)


def write_ordered(lines: DataFrame, order: list[str], path: str, line_end: str = "\n") -> None:
    """The column `line` of lines, sorted by `order`, as parts that are in order one after the other. Lines must not hold the line end."""
    lines.sparkSession.dataSource.register(OrderedLines)
    ranged = lines.repartitionByRange(*order).sortWithinPartitions(*order).select("line")
    ranged.write.format("ordered_lines").option("lineEnd", line_end).mode("overwrite").save(path)


def read_ordered(spark: SparkSession, path: str) -> DataFrame:
    spark.dataSource.register(OrderedLines)
    return spark.read.format("ordered_lines").load(path)
