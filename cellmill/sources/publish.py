"""Tables that are replaced at once.

Spark's overwrite deletes what is there before the job that writes anew, so a job that fails leaves nothing. Here a version is written beside the others,
in a folder of its own, and then a numbered pointer to it is created by a rename that can't replace anything. Readers follow the highest
pointer. A job that dies half-way leaves an unread folder; of two writers that began from the same version the second to come gets a Conflict.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession


class Conflict(Exception):
    """Another writer has published since."""


class Files:
    """The few file operations that writers need, on any file system that Spark reaches."""

    def __init__(self, spark: SparkSession, path: str):
        self._hadoop, self._conf = spark._jvm.org.apache.hadoop.fs, spark._jsc.hadoopConfiguration()
        self._fs = self._hadoop.Path(path).getFileSystem(self._conf)
        self._never_over = spark.sparkContext._gateway.new_array(getattr(self._hadoop, "Options$Rename"), 0)
        self._context = self._hadoop.FileContext.getFileContext(self._fs.getUri(), self._conf)

    def exists(self, path: str) -> bool:
        return self._fs.exists(self._hadoop.Path(path))

    def names(self, path: str) -> list[str]:
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self._hadoop.Path(path))) if self.exists(path) else []

    def delete(self, path: str) -> None:
        self._fs.delete(self._hadoop.Path(path), True)

    def put(self, path: str, text: str) -> None:
        stream = self._fs.create(self._hadoop.Path(path), True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()

    def text(self, path: str) -> str:
        stream = self._fs.open(self._hadoop.Path(path))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def rename(self, old: str, new: str) -> bool:
        """False if `new` is there already; it is never replaced."""
        try:
            self._context.rename(self._hadoop.Path(old), self._hadoop.Path(new), self._never_over)
        except Py4JJavaError as e:
            if not e.java_exception.getClass().getName().endswith(".FileAlreadyExistsException"):
                raise
            return False
        return True


def replace(spark: SparkSession, path: str, write: Callable[[str], None]) -> None:
    """Lets `write` make a table beside path, then puts it in path's place by two renames. If writing fails, path stays as it was. Between
    the renames there is nothing at path for a moment; Published has no such gap."""
    files, mark = Files(spark, path), uuid.uuid4().hex
    new, old = f"{path}.new-{mark}", f"{path}.old-{mark}"
    try:
        write(new)
        if files.exists(path):
            files.rename(path, old)
        if not files.rename(new, path):
            raise Conflict(path)
    except Exception:
        if files.exists(old) and not files.exists(path):
            files.rename(old, path)
        files.delete(new)
        raise
    files.delete(old)


class Published:
    """A folder of versions. Each version has its table, and a sidecar of JSON fields beside it."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder, self.files = spark, folder, Files(spark, folder)

    def _pointers(self) -> list[str]:
        return [n for n in self.files.names(self.folder) if n.startswith("current-")]

    def number(self) -> int:
        """Of the current version, from 1; 0 if there is none."""
        return max((int(n.removeprefix("current-")) for n in self._pointers()), default=0)

    def _version(self, number: int) -> dict:
        return json.loads(self.files.text(f"{self.folder}/current-{number:012d}"))

    def publish(self, table: DataFrame, sidecar: dict | None = None, based_on: int | None = None, partition_by: tuple[str, ...] = ()) -> int:
        """Writes a version and makes it the current one; returns its number. Fields of the sidecar that this call doesn't name are kept from the
        version before. based_on: the version that was read to make this one, the current one if not given."""
        base = self.number() if based_on is None else based_on
        kept = self._version(base)["sidecar"] if base else {}
        place = f"version-{uuid.uuid4().hex}"
        writer = table.write.option("compression", "zstd")
        (writer.partitionBy(*partition_by) if partition_by else writer).parquet(f"{self.folder}/{place}")
        staged = f"{self.folder}/staged-{uuid.uuid4().hex}"
        self.files.put(staged, json.dumps({"place": place, "sidecar": kept | (sidecar or {})}, sort_keys=True))
        if not self.files.rename(staged, f"{self.folder}/current-{base + 1:012d}"):
            self.files.delete(staged)
            self.files.delete(f"{self.folder}/{place}")
            raise Conflict(f"{self.folder}: version {base + 1} is there already")
        return base + 1

    def read(self, number: int | None = None) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{self._version(number or self.number())['place']}")

    def sidecar(self, number: int | None = None) -> dict:
        return self._version(number or self.number())["sidecar"]

    def keep(self, latest: int) -> None:
        """Deletes all but the latest versions, and what failed writers left. Not while others write or read older ones."""
        pointers = self._pointers()
        known = {self._version(int(n.removeprefix("current-")))["place"] for n in pointers[-latest:]}
        for name in pointers[:-latest]:
            self.files.delete(f"{self.folder}/{name}")
        for name in self.files.names(self.folder):
            if name.startswith(("version-", "staged-")) and name not in known:
                self.files.delete(f"{self.folder}/{name}")
