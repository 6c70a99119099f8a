"""Tables as versions: each commit names the folders that all tables consist of, and readers stay with the version they began with."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession

from ..schema import GraphError

ATTEMPTS = 10
DAY = 86400


class Conflict(GraphError):
    """Other writers were faster each time."""


@dataclass(frozen=True)
class Version:
    """number (0: nothing was committed yet) and the folders of each table, relative to the path."""

    number: int
    tables: dict[str, list[str]]


class Versions:
    """A folder for each batch of rows, and a small file for each version that lists them.

    A version is there once its file is; the file is written aside and renamed, and the rename fails if another writer has taken
    the number. Whatever a stopped writer leaves behind is named by no version. This asks for a file system whose rename refuses
    an existing target: HDFS does so atomically, a local one checks first. Batches are written once and never changed.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _path(self, name: str = ""):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def _fs(self):
        return self._path().getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _listed(self, name: str) -> list:
        fs, where = self._fs(), self._path(name)
        return list(fs.listStatus(where)) if fs.exists(where) else []

    def numbers(self) -> list[int]:
        names = [s.getPath().getName() for s in self._listed("_versions")]
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and n[0].isdigit())

    def at(self, number: int) -> Version:
        if number == 0:
            return Version(0, {})
        stream = self._fs().open(self._path(f"_versions/{number:012d}.json"))
        try:
            return Version(number, json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")))
        finally:
            stream.close()

    def current(self) -> Version:
        return self.at(max(self.numbers(), default=0))

    def read(self, version: Version, name: str, schema: str | None = None) -> DataFrame:
        """A table as of a version; one without folders is empty and needs a schema."""
        folders = [f"{self.path}/{f}" for f in version.tables.get(name, [])]
        if not folders:
            if schema is None:
                raise GraphError(f"version {version.number} has no {name}")
            return self.spark.createDataFrame([], schema)
        return (self.spark.read.schema(schema) if schema else self.spark.read).parquet(*folders)

    def write(self, name: str, rows: DataFrame) -> str:
        """A new folder of the table, which no version names yet."""
        folder = f"{name}/{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.path}/{folder}")
        return folder

    def commit(self, change: Callable[[Version], dict[str, list[str]]]) -> Version:
        """The version after ``change``, which gets the current one and gives the folders of all tables; it is asked again if another
        writer has committed in the meantime."""
        for _ in range(ATTEMPTS):
            base = self.current()
            after = Version(base.number + 1, {name: list(folders) for name, folders in change(base).items()})
            if self._put(after):
                return after
        raise Conflict(f"{self.path}: {ATTEMPTS} attempts to commit")

    def _put(self, version: Version) -> bool:
        fs, hadoop = self._fs(), self.spark._jvm.org.apache.hadoop.fs
        aside, final = self._path(f"_versions/_{uuid.uuid4().hex}"), self._path(f"_versions/{version.number:012d}.json")
        out = fs.create(aside, False)
        out.write(json.dumps(version.tables).encode())
        out.close()
        kind = getattr(hadoop, "Options$Rename")
        options = self.spark.sparkContext._gateway.new_array(kind, 1)
        options[0] = kind.NONE
        context = hadoop.FileContext.getFileContext(fs.makeQualified(final).toUri(), self.spark._jsc.hadoopConfiguration())
        try:
            context.rename(fs.makeQualified(aside), fs.makeQualified(final), options)
        except Py4JJavaError as problem:
            fs.delete(aside, False)
            if "FileAlreadyExists" in problem.java_exception.getClass().getName():
                return False
            raise
        return True

    def add(self, rows: dict[str, DataFrame]) -> Version:
        """More rows for some tables, in one commit."""
        new = {name: self.write(name, df) for name, df in rows.items()}
        return self.commit(lambda base: base.tables | {name: [*base.tables.get(name, []), folder] for name, folder in new.items()})

    def replace(self, rows: dict[str, DataFrame]) -> Version:
        """Some tables anew, in one commit."""
        new = {name: [self.write(name, df)] for name, df in rows.items()}
        return self.commit(lambda base: base.tables | new)

    def without(self, base: Version, name: str, hit: Callable[[DataFrame], DataFrame], left: Callable[[DataFrame], DataFrame], schema: str) -> list[str]:
        """Folders of the table after a deletion: only those with rows among ``hit`` are written anew, as what is ``left`` of them."""
        folders = base.tables.get(name, [])
        if not folders:
            return []
        from pyspark.sql import functions as F

        table = self.read(base, name, schema).withColumn("_folder", F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)/[^/]+$", 1))
        found = {f"{name}/{r['_folder']}" for r in hit(table).select("_folder").distinct().collect()}  # a row for each folder at most
        if not found:
            return folders
        rest = left(self.read(Version(base.number, {name: sorted(found)}), name, schema))
        return [*[f for f in folders if f not in found], self.write(name, rest)]

    def vacuum(self, keep: int = 1, older_than: float = DAY) -> int:
        """Delete all but the last ``keep`` versions, and folders that these don't name and that have not changed for ``older_than``
        seconds (younger ones may belong to a writer at work, or to a reader of an older version). Returns how many folders went."""
        fs, gone = self._fs(), 0
        numbers = self.numbers()
        kept = numbers[-max(keep, 1):]
        named = {f for n in kept for folders in self.at(n).tables.values() for f in folders}
        now = self.spark._jvm.java.lang.System.currentTimeMillis()
        for table in self._listed(""):
            name = table.getPath().getName()
            for s in self._listed(name) if name != "_versions" else []:
                folder = f"{name}/{s.getPath().getName()}"
                if folder not in named and now - s.getModificationTime() >= older_than * 1000:
                    fs.delete(s.getPath(), True)
                    gone += 1
        for n in numbers[: len(numbers) - len(kept)]:
            fs.delete(self._path(f"_versions/{n:012d}.json"), False)
        return gone
