"""Tables with revisions: a change is written against the revision that its writer has seen, and published by one rename.

A table is a folder. `data` holds every version's rows, each in a folder of its own; `revisions` holds one small file per
revision, which names its data. A writer writes the rows first and then renames its file to the next revision's name, which
fails if another writer was there before: compare and set, by the file system. Readers see a revision whole or not at all,
old ones stay, and a restore is a revision that names old data.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class RevisionConflict(RuntimeError):
    """The table has another revision than the writer has seen."""


class Versions:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.jvm, self.root = spark, spark._jvm, path.rstrip("/")
        self.conf = spark._jsc.hadoopConfiguration()
        self.fs = self._path("").getFileSystem(self.conf)

    def _path(self, below: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{below}" if below else self.root)

    def _names(self) -> list[str]:
        folder = self._path("revisions")
        if not self.fs.exists(folder):
            return []
        return sorted(s.getPath().getName() for s in self.fs.listStatus(folder) if s.getPath().getName().isdigit())

    def revision(self) -> int:
        """The newest revision; 0 before the first."""
        names = self._names()
        return int(names[-1]) if names else 0

    def _data_of(self, revision: int) -> str:
        path = self._path(f"revisions/{revision:012d}")
        if not self.fs.exists(path):
            raise ValueError(f"no revision {revision}")
        stream = self.fs.open(path)
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def read(self, revision: int | None = None) -> DataFrame:
        """The rows of a revision, the newest by default."""
        return self.spark.read.parquet(f"{self.root}/data/{self._data_of(self.revision() if revision is None else revision)}")

    def _publish(self, data: str, expected: int) -> int:
        new, part = expected + 1, self._path(f"revisions/.{uuid.uuid4().hex}")
        stream = self.fs.create(part, False)
        stream.write(bytearray(data.encode()))
        stream.close()
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(part.toUri() if part.toUri().getScheme() else self.fs.getUri(), self.conf)
        options = self.spark.sparkContext._gateway.new_array(self.jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            context.rename(part, self._path(f"revisions/{new:012d}"), options)  # fails where the name is taken
        except Exception as e:
            self.fs.delete(part, False)
            if self.revision() != expected:
                raise RevisionConflict(f"revision {self.revision()} instead of {expected}") from e
            raise
        return new

    def _expect(self, expected: int) -> None:
        if self.revision() != expected:
            raise RevisionConflict(f"revision {self.revision()} instead of {expected}")

    def write(self, rows: DataFrame, expected: int) -> int:
        """A new revision with these rows, if the newest is still `expected`. Returns its number."""
        self._expect(expected)
        name = uuid.uuid4().hex
        rows.write.parquet(f"{self.root}/data/{name}")
        return self._publish(name, expected)

    def mutate(self, change: Callable[[DataFrame], DataFrame], expected: int) -> int:
        """A new revision with what `change` makes of the expected one."""
        self._expect(expected)
        return self.write(change(self.read(expected)), expected)

    def dry_run(self, change: Callable[[DataFrame], DataFrame], keys: list[str]) -> dict[str, int]:
        """How many rows a change would add, remove and alter in the newest revision; nothing is written."""
        before = self.read()
        digest = lambda df: df.select(*keys, F.xxhash64(*sorted(before.columns)).alias("h"))
        old, new = digest(before), digest(change(before)).withColumnRenamed("h", "n")
        both = old.join(new, keys, "full")
        counts = both.agg(F.count_if(F.col("h").isNull()).alias("added"), F.count_if(F.col("n").isNull()).alias("removed"), F.count_if(F.col("h") != F.col("n")).alias("altered")).first()
        return counts.asDict()

    def restore(self, revision: int, expected: int) -> int:
        """A new revision that has the rows of an old one, without writing them again."""
        self._expect(expected)
        return self._publish(self._data_of(revision), expected)
