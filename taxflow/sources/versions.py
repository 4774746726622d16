"""Versions of a snapshot table: written to fresh paths, and made valid by one atomic step each."""

from __future__ import annotations

import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession


class VersionConflict(RuntimeError):
    """Another writer has committed since the version was read."""


class Versions:
    """A table below ``root``: data in ``data/<unique>``, and one small file ``commits/<number>`` for each version.

    A version is valid as soon as its commit file exists.  That file is written elsewhere and then renamed, without overwriting, which is atomic
    on HDFS and local file systems; of two writers that read the same version only one gets its number.  What a lost writer
    has left in ``data`` is never read.  A store whose rename isn't atomic needs a committer of its own.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._path = self._jvm.org.apache.hadoop.fs.Path
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self._path(self.root).getFileSystem(self._conf)
        self._at = self._fs.makeQualified(self._path(self.root))

    def _named(self, *parts: str):
        return self._path(self._at, "/".join(parts))

    def numbers(self) -> list[int]:
        """Committed versions, in order."""
        folder = self._named("commits")
        if not self._fs.exists(folder):
            return []
        return sorted(int(x.getPath().getName()) for x in self._fs.listStatus(folder) if x.getPath().getName().isdigit())

    def entry(self, number: int) -> dict:
        """data (folder), schema and tag of a version."""
        return json.loads("".join(r.value for r in self.spark.read.text(self._named("commits", str(number)).toString()).collect()))  # one line

    def read(self, number: int) -> DataFrame:
        found = self.entry(number)
        return self.spark.read.schema(found["schema"]).parquet(self._named("data", found["data"]).toString())

    def latest(self) -> tuple[int, DataFrame]:
        """(number, table) of the latest version; ValueError before the first."""
        numbers = self.numbers()
        if not numbers:
            raise ValueError(f"no version in {self.root}")
        return numbers[-1], self.read(numbers[-1])

    def commit(self, table: DataFrame, read: int | None, tag: str = "") -> int:
        """Write ``table`` as the version after ``read`` (None: the first) and return its number.

        VersionConflict if that number is taken.  A rerun of a commit that went through, told by its ``tag``, returns its number and writes nothing.
        """
        numbers = self.numbers()
        if tag and numbers and self.entry(numbers[-1])["tag"] == tag:
            return numbers[-1]
        number = 0 if read is None else read + 1
        if number in numbers or (numbers and number <= numbers[-1]):
            raise VersionConflict(f"version {number} of {self.root} is taken")
        data = uuid.uuid4().hex
        table.write.parquet(self._named("data", data).toString())
        self._make_valid(number, {"data": data, "schema": _ddl(table), "tag": tag})
        return number

    def _make_valid(self, number: int, entry: dict) -> None:
        waiting = self._named("waiting", entry["data"])
        out = self._fs.create(waiting, False)
        out.write(bytearray(json.dumps(entry).encode()))
        out.close()
        self._fs.mkdirs(self._named("commits"))
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._at.toUri(), self._conf)
        plain = self.spark.sparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 0)  # no overwriting
        try:
            context.rename(waiting, self._named("commits", str(number)), plain)
        except Py4JJavaError as e:
            if "FileAlreadyExistsException" in str(e.java_exception):
                raise VersionConflict(f"version {number} of {self.root} is taken") from None
            raise


def _ddl(table: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in table.schema)
