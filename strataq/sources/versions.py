"""Tables of Parquet files with a log of commits, for writers that do not know of one another.

A commit is one small JSON file named by its version, which names the files that it adds and takes away; it is put in
place only if no other commit has that version. Data are written first, under names of their own, so a job that fails
leaves nothing that is read. A writer that finds its version taken reads the other commit: if both can stand,
it takes the next version, else it starts again from the new state or gets a CommitConflict. Rows are deleted by listing their
places in their files, which stay as they are; readers of an older version see it unchanged.
"""

from __future__ import annotations

import json
import os
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

LOG = "_log"
#: Every so many commits one holds the whole state, so that readers fold at most so many files.
STATE_EVERY = 32
TRIES = 10


class CommitConflict(RuntimeError):
    """Another commit changed what this one rests on."""


def file_system(spark: SparkSession, path: str):
    """The Hadoop file system of a path, and the constructor of its paths."""
    at = spark._jvm.org.apache.hadoop.fs.Path
    return at(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def put_if_absent(spark: SparkSession, path: str, text: str) -> bool:
    """Write a small file whole unless there is one of that name already; False if there is.

    On a local file system by a hard link, else by a rename, which has to fail on an existing target as it
    does on HDFS; a store where it does not has no such commits.
    """
    fs, at = file_system(spark, path)
    fs.mkdirs(at(path).getParent())
    if fs.getScheme() == "file":
        target = at(path).toUri().getPath()
        fd, beside = tempfile.mkstemp(dir=os.path.dirname(target), prefix=".")
        try:
            with os.fdopen(fd, "w") as f:
                f.write(text)
            os.link(beside, target)
            return True
        except FileExistsError:
            return False
        finally:
            os.unlink(beside)
    beside = at(f"{at(path).getParent()}/.{uuid.uuid4().hex}")
    out = fs.create(beside, False)
    out.write(bytearray(text.encode()))
    out.close()
    if not fs.exists(at(path)) and fs.rename(beside, at(path)):
        return True
    fs.delete(beside, False)
    return False


class CommitLog:
    """The commits of a folder, numbered from 1."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.folder = spark, f"{path.rstrip('/')}/{LOG}"

    def _name(self, version: int) -> str:
        return f"{self.folder}/{version:020d}.json"

    def latest(self) -> int:
        fs, at = file_system(self.spark, self.folder)
        if not fs.exists(at(self.folder)):
            return 0
        names = [x.getPath().getName() for x in fs.listStatus(at(self.folder))]
        return max((int(n[:20]) for n in names if n.endswith(".json") and n[:20].isdigit()), default=0)

    def read(self, version: int) -> dict:
        fs, at = file_system(self.spark, self.folder)
        source = fs.open(at(self._name(version)))
        try:
            return json.loads(bytes(self.spark._jvm.org.apache.commons.io.IOUtils.toByteArray(source)).decode())
        finally:
            source.close()

    def put(self, version: int, commit: dict) -> bool:
        return put_if_absent(self.spark, self._name(version), json.dumps(commit))

    def commit(self, base: int, make: Callable[[int], dict], clash: Callable[[dict], str | None]) -> int:
        """Put ``make(version)`` behind ``base`` and all commits that ``clash`` finds nothing against; its version."""
        version = base + 1
        while not self.put(version, make(version)):
            why = clash(self.read(version))
            if why:
                raise CommitConflict(f"version {version} of {self.folder.removesuffix('/' + LOG)} {why}")
            version += 1
        return version


class VersionedTable:
    """A table at ``path``; ``schema``, a type or its text, is needed to make it, and has to be its own if given later."""

    def __init__(self, spark: SparkSession, path: str, schema: StructType | str | None = None):
        self.spark, self.path, self.log = spark, path.rstrip("/"), CommitLog(spark, path)
        schema = StructType.fromDDL(schema) if isinstance(schema, str) else schema
        if not self.log.latest():
            if schema is None:
                raise ValueError(f"there is no table at {path}")
            self.log.put(1, {"op": "create", "schema": schema.jsonValue()})
        self.schema = StructType.fromJson(self.log.read(1)["schema"])
        if schema is not None and [(f.name, f.dataType) for f in schema] != [(f.name, f.dataType) for f in self.schema]:
            raise ValueError(f"the table at {path} has the schema {self.schema.simpleString()}")

    def version(self) -> int:
        return self.log.latest()

    def state(self, version: int) -> tuple[list[str], list[str]]:
        """Data files and folders of deleted places of a version."""
        commits = []
        for v in range(version, 0, -1):
            commits.append(self.log.read(v))
            if "state" in commits[-1]:
                break
        files, deleted = map(list, commits[-1].get("state", ([], [])))
        for c in reversed(commits[:-1] if "state" in commits[-1] else commits):
            files, deleted = self._folded(files, deleted, c)
        return files, deleted

    @staticmethod
    def _folded(files: list[str], deleted: list[str], commit: dict) -> tuple[list[str], list[str]]:
        gone = set(commit.get("remove", ()))
        return [f for f in files if f not in gone] + commit.get("add", []), [d for d in deleted if d not in gone] + commit.get("deleted", [])

    def _rows(self, files: list[str], deleted: list[str]) -> DataFrame:
        """Rows with their places ``_file`` and ``_row``."""
        if not files:
            return self.spark.createDataFrame([], self.schema).withColumns({"_file": F.lit(""), "_row": F.lit(0).cast("long")})
        rows = self.spark.read.schema(self.schema).parquet(*(f"{self.path}/{f}" for f in files)).select("*", F.col("_metadata.file_name").alias("_file"), F.col("_metadata.row_index").alias("_row"))
        if not deleted:
            return rows
        gone = self.spark.read.schema("_file string, _row bigint").parquet(*(f"{self.path}/{d}" for d in deleted))
        return rows.join(gone, ["_file", "_row"], "left_anti").select(*self.schema.names, "_file", "_row")

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version, the latest if none is named; later commits do not change what it reads."""
        return self._rows(*self.state(self.version() if version is None else version)).drop("_file", "_row")

    def _written(self, rows: DataFrame) -> list[str]:
        folder = f"data/{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.path}/{folder}")
        fs, at = file_system(self.spark, self.path)
        names = [x.getPath().getName() for x in fs.listStatus(at(f"{self.path}/{folder}"))]
        return sorted(f"{folder}/{n}" for n in names if n.endswith(".parquet"))

    def _places(self, rows: DataFrame) -> list[str]:
        """Write the places of rows to delete, if there are any."""
        folder = f"deleted/{uuid.uuid4().hex}"
        rows.select("_file", "_row").write.parquet(f"{self.path}/{folder}")
        return [folder] if self.spark.read.schema("_file string, _row bigint").parquet(f"{self.path}/{folder}").limit(1).count() else []

    def _commit(self, base: int, actions: dict, clash: Callable[[dict], str | None]) -> int:
        def make(version: int) -> dict:
            if version % STATE_EVERY:
                return actions
            return actions | {"state": self._folded(*self.state(version - 1), actions)}

        return self.log.commit(base, make, clash)

    def _retried(self, attempt: Callable[[int], int], tries: int) -> int:
        for left in range(tries - 1, -1, -1):
            try:
                return attempt(self.version())
            except CommitConflict:
                if not left:
                    raise
        raise AssertionError

    def append(self, rows: DataFrame) -> int:
        """Add rows; stands beside whatever others commit meanwhile. Returns the version, as all writers do."""
        add = self._written(rows.select(*self.schema.names))
        return self._commit(self.version(), {"op": "append", "add": add}, lambda c: None)

    def delete(self, where: Column, tries: int = TRIES) -> int:
        """Delete the rows for which ``where`` is true; rows that others add meanwhile are not looked at."""

        def attempt(base: int) -> int:
            files, deleted = self.state(base)
            gone = self._places(self._rows(files, deleted).where(where))
            return self._commit(base, {"op": "delete", "deleted": gone}, lambda c: "took away files" if set(c.get("remove", ())) & set(files) else None)

        return self._retried(attempt, tries)

    def upsert(self, rows: DataFrame, key: str, tries: int = TRIES) -> int:
        """Put ``rows``, one per key, in the place of those with their keys; null keys are only added. Starts again if others changed the table."""

        def attempt(base: int) -> int:
            gone = self._places(self._rows(*self.state(base)).join(rows.select(key).distinct(), key, "left_semi"))
            add = self._written(rows.select(*self.schema.names))
            return self._commit(base, {"op": "upsert", "add": add, "deleted": gone}, _any_change)

        return self._retried(attempt, tries)

    def insert_new(self, rows: DataFrame, key: str, tries: int = TRIES) -> int:
        """Add those of ``rows``, one per key, whose key the table lacks. Starts again if others changed the table."""

        def attempt(base: int) -> int:
            add = self._written(rows.join(self.read(base).select(key), key, "left_anti").select(*self.schema.names))
            return self._commit(base, {"op": "insert", "add": add}, _any_change)

        return self._retried(attempt, tries)

    def rewrite(self, files: int | None = None, tries: int = TRIES) -> int:
        """Replace all files by ones without deleted rows; others may append meanwhile."""

        def attempt(base: int) -> int:
            old, deleted = self.state(base)
            rows = self._rows(old, deleted).drop("_file", "_row")
            add = self._written(rows.repartition(files) if files else rows)
            clash = lambda c: "deleted or took away rows" if c.get("deleted") or c.get("remove") else None
            return self._commit(base, {"op": "rewrite", "add": add, "remove": old + deleted}, clash)

        return self._retried(attempt, tries)

    def expire(self, keep: int = 1) -> int:
        """Delete what the last ``keep`` versions do not need and return the number of folders deleted. No writer and no reader of an older version may be at work."""
        last = self.version()
        used = {x for v in range(max(1, last - keep + 1), last + 1) for part in self.state(v) for x in part}
        folders = {"/".join(x.split("/")[:2]) for x in used}
        fs, at = file_system(self.spark, self.path)
        gone = 0
        for kind in ("data", "deleted"):
            top = at(f"{self.path}/{kind}")
            for x in fs.listStatus(top) if fs.exists(top) else ():
                if f"{kind}/{x.getPath().getName()}" not in folders:
                    gone += bool(fs.delete(x.getPath(), True))
        return gone


def _any_change(commit: dict) -> str | None:
    return "changed rows" if commit.get("add") or commit.get("deleted") else None
