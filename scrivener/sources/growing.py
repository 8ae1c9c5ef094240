"""A streaming source of text files that grow: whole lines only, by file and byte.

Spark's own file stream takes a file once. This source keeps for each file the byte up to which it was read, and a trigger
takes what was appended since, up to the last line end; a line that isn't finished waits for the rest. Offsets are a map
from file to byte, so a trigger that is run again reads the same bytes. A file that has become shorter is another file and
is read from its beginning; one that is gone is forgotten. Large appends are cut into ranges of `split_bytes`: a range
reads the lines that begin in it.

Files are reached through pyarrow's file systems (local, HDFS, S3 and others by URI), on the driver for their lengths and
last line ends, and in the tasks for the bytes.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from scrivener.session import prepare

BLOCK, ROWS = 1 << 20, 10_000


def file_system(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a URI or of a local path, and the path in it."""
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)


def line_end(file: pa.NativeFile, begin: int, end: int) -> int:
    """The place after the last line end in [begin, end); begin if there is none."""
    while end > begin:
        at = max(begin, end - BLOCK)
        file.seek(at)
        if (found := file.read(end - at).rfind(b"\n")) >= 0:
            return at + found + 1
        end = at
    return begin


def line_start(file: pa.NativeFile, at: int, end: int) -> int:
    """The first place from `at` on at which a line begins; end if none does before."""
    while at < end:
        file.seek(at - 1)
        block = file.read(min(BLOCK, end - at + 1))
        if (found := block.find(b"\n")) >= 0:
            return min(end, at + found)
        at += len(block)
    return end


def lines_between(file: pa.NativeFile, begin: int, end: int) -> Iterator[tuple[int, bytes]]:
    """Lines and where they begin; begin and end are places of line starts, or the end of a file whose last line is open."""
    file.seek(begin)
    at, rest = begin, b""
    while at + len(rest) < end:
        rest += file.read(min(BLOCK, end - at - len(rest)))
        *whole, left = rest.split(b"\n")
        for line in whole:
            yield at, line
            at += len(line) + 1
        rest = left
    if rest:
        yield at, rest


@dataclass
class Range(InputPartition):
    path: str
    first: int  # where the trigger's part of the file begins
    begin: int
    end: int
    last: int  # where the trigger's part of the file ends


class GrowingLines(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.suffix = options["path"], options.get("suffix", "")
        self.split_bytes, self.final = int(options.get("split_bytes", 64 << 20)), options.get("final", "false").lower() == "true"

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        """Up to the last line end of each file; with the option `final`, up to its end."""
        fs, path = file_system(self.path)
        found = {}
        for info in fs.get_file_info(pafs.FileSelector(path, recursive=True, allow_not_found=True)):
            if info.type == pafs.FileType.File and info.path.endswith(self.suffix) and not info.base_name.startswith((".", "_")):
                with fs.open_input_file(info.path) as file:
                    found[info.path] = info.size if self.final else line_end(file, 0, info.size)
        return dict(sorted(found.items()))

    def partitions(self, start: dict, end: dict) -> list[Range]:
        out = []
        for path, last in end.items():
            first = start.get(path, 0) if start.get(path, 0) <= last else 0
            out += [Range(path, first, at, min(last, at + self.split_bytes), last) for at in range(first, last, self.split_bytes)]
        return out

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        fs, _ = file_system(self.path)
        names, rows = ["file", "position", "value"], []
        with fs.open_input_file(partition.path) as file:
            begin, end = (at if at in (partition.first, partition.last) else line_start(file, at, partition.last) for at in (partition.begin, partition.end))
            for at, line in lines_between(file, begin, end):
                if line.strip():
                    rows.append((partition.path, at, line.decode("utf-8", "replace").strip()))
                if len(rows) == ROWS:
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names)
                    rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names)

    def commit(self, end: dict) -> None:
        """Nothing is kept outside Spark's checkpoint."""


class GrowingLinesSource(DataSource):
    """file, position and value of each line of the files below `path`."""

    @classmethod
    def name(cls) -> str:
        return "growing_lines"

    def schema(self) -> str:
        return "file string, position long, value string"

    def streamReader(self, schema) -> GrowingLines:
        return GrowingLines(dict(self.options))


def growing_ndjson(spark: SparkSession, path: str, schema: str, final: bool = False, **options: str) -> DataFrame:
    """Objects of JSON lines as files grow, with file, position and the line itself. Blank lines are left out; a line that is
    no object of the schema has nulls. `final` also takes the last line of a file without its line end."""
    prepare(spark).dataSource.register(GrowingLinesSource)
    rows = spark.readStream.format("growing_lines").options(path=path, final=str(final), **options).load()
    return rows.withColumn("__o", F.from_json("value", schema)).select("file", "position", "value", "__o.*")
