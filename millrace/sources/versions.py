"""Tables as versions: data folders that never change, and one manifest a version.

A table is a folder with `data/` (a folder for each write, of Parquet files) and `manifests/` (a
small JSON file for each version, named by its number). A manifest lists the data folders of its
version and the keys that are unique in it. It is created exclusively: of two writers that want the
same number one fails and takes the next, after it has looked again at what the other did. Readers
resolve the newest manifest and read just the folders that it names, so they see one version whole,
before, during and after any write. A writer that dies leaves data that no manifest names.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import types as T

from .writers import digest_sums


class Conflict(RuntimeError):
    """Another writer has made the version first."""


@dataclass(frozen=True)
class Version:
    """number from 0; folders of data, relative to the table; schema as JSON; what was told of it."""

    number: int
    folders: tuple[str, ...]
    schema: str
    notes: dict = field(default_factory=dict)


class Table:
    """A versioned table in a folder of any file system that Spark reaches."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._files = self._path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, *parts: str):
        return self._path("/".join([self.path, *parts]))

    def numbers(self) -> list[int]:
        """The versions that are there, in order."""
        folder = self._at("manifests")
        if not self._files.exists(folder):
            return []
        names = (s.getPath().getName() for s in self._files.listStatus(folder))
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and not n.startswith((".", "_")))

    def version(self, number: int | None = None) -> Version | None:
        """A version, or the newest; None for a table without any."""
        if number is None:
            there = self.numbers()
            if not there:
                return None
            number = there[-1]
        stream = self._files.open(self._at("manifests", f"{number:020d}.json"))
        try:
            told = json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()
        return Version(number, tuple(told["folders"]), told["schema"], told["notes"])

    def read(self, number: int | None = None) -> DataFrame:
        """The rows of a version, or of the newest."""
        v = self.version(number)
        if v is None:
            raise FileNotFoundError(f"no version of {self.path}")
        schema = T.StructType.fromJson(json.loads(v.schema))
        if not v.folders:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/{f}" for f in v.folders])

    def _publish(self, number: int, folders: tuple[str, ...], schema: T.StructType, notes: dict) -> Version:
        """Makes the manifest where none is. It is written whole beside, and takes its name by a
        rename that refuses to replace, so that no reader sees a part of it."""
        text = json.dumps({"folders": list(folders), "schema": schema.json(), "notes": notes}, sort_keys=True)
        self._files.mkdirs(self._at("manifests"))
        beside, to = self._at("manifests", f"_{uuid.uuid4().hex}.json"), self._at("manifests", f"{number:020d}.json")
        out = self._files.create(beside, False)
        out.write(bytearray(text.encode()))
        out.close()
        try:
            self._claim(beside, to)
        except Exception as e:
            if self._files.exists(to):
                raise Conflict(f"version {number} of {self.path} is there already") from e
            raise
        finally:
            self._files.delete(beside, False)
        return Version(number, folders, schema.json(), notes)

    def _claim(self, beside, to) -> None:
        """Gives a file its name unless that is taken: one step of the file system, a link on a
        local one and a rename without replacing elsewhere."""
        jvm = self.spark._jvm
        if self._files.getUri().getScheme() == "file":
            names = [jvm.java.io.File(self._path(x.toString()).toUri().getPath()).toPath() for x in (to, beside)]
            jvm.java.nio.file.Files.createLink(*names)
            return
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(beside.toUri(), self.spark._jsc.hadoopConfiguration())
        context.rename(beside, to, self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0))

    def _data(self, df: DataFrame) -> str:
        folder = f"data/{uuid.uuid4().hex}"
        df.write.mode("errorifexists").parquet(f"{self.path}/{folder}")
        return folder

    def commit(self, make: Callable[[Version | None], tuple[tuple[str, ...], T.StructType]], notes: dict | None = None, tries: int = 20) -> Version:
        """Publishes what `make` says of the newest version, looked at again after each conflict."""
        for _ in range(tries):
            old = self.version()
            folders, schema = make(old)
            try:
                return self._publish(0 if old is None else old.number + 1, folders, schema, notes or {})
            except Conflict:
                continue
        raise Conflict(f"{tries} writers came first: {self.path}")

    def replace(self, df: DataFrame, notes: dict | None = None) -> Version:
        """A version with these rows only. They may come from the table itself."""
        folder = self._data(df)
        return self.commit(lambda old: ((folder,), df.schema), notes)

    def append(self, df: DataFrame, notes: dict | None = None) -> Version:
        """A version with these rows too; the columns must be those that are there."""
        folder = self._data(df)

        def more(old: Version | None) -> tuple[tuple[str, ...], T.StructType]:
            if old is None:
                return (folder,), df.schema
            there = T.StructType.fromJson(json.loads(old.schema))
            if [(f.name, f.dataType) for f in there] != [(f.name, f.dataType) for f in df.schema]:
                raise ValueError(f"other columns: {df.schema.simpleString()}, not {there.simpleString()}")
            return (*old.folders, folder), there

        return self.commit(more, notes)

    def clean(self, keep: Callable[[DataFrame], DataFrame], apply: bool = False) -> dict:
        """keep(rows) -> rows: a dry run by default. Applied, the new rows are written, read again
        and compared with what was written (rows and digest), and only then published; the version
        before stays as the backup. Fails if another version comes meanwhile."""
        old = self.version()
        before = self.read(old.number)
        after = keep(before)
        if not apply:
            return {"before": before.count(), "after": after.count(), "applied": False}
        told = Observation(f"written-{uuid.uuid4().hex}")
        folder = self._data(after.observe(told, *digest_sums(after)))
        back = self.spark.read.schema(after.schema).parquet(f"{self.path}/{folder}").agg(*digest_sums(after)).first().asDict()
        if back != told.get:
            raise ValueError("the copy differs from what was to be written")
        new = self._publish(old.number + 1, (folder,), after.schema, {"cleans": old.number})
        return {"before": before.count(), "after": told.get["rows"], "applied": True, "backup": old.number, "version": new.number}

    def compact(self, parts: int) -> Version:
        """The newest version's rows in one folder. Fails if another version comes meanwhile."""
        old = self.version()
        df = self.read(old.number)
        return self._publish(old.number + 1, (self._data(df.coalesce(parts)),), df.schema, {"compacts": old.number})

    def orphans(self) -> list[str]:
        """Data folders that no version names: of writers that died, or that are still at work."""
        folder = self._at("data")
        if not self._files.exists(folder):
            return []
        named = {f for n in self.numbers() for f in self.version(n).folders}
        there = {f"data/{s.getPath().getName()}" for s in self._files.listStatus(folder)}
        return sorted(there - named)

    def forget(self, keep: int = 1, orphans: bool = False) -> list[str]:
        """Removes all but the newest `keep` versions, and the data that only they name; what
        readers of older versions still need goes with it. Orphans go only if asked for."""
        numbers = self.numbers()
        old, new = numbers[: max(0, len(numbers) - keep)], numbers[-keep:] if keep else []
        needed = {f for n in new for f in self.version(n).folders}
        gone = {f for n in old for f in self.version(n).folders} - needed
        for n in old:
            self._files.delete(self._at("manifests", f"{n:020d}.json"), False)
        gone |= set(self.orphans()) - needed if orphans else set()
        for f in gone:
            self._files.delete(self._at(f), True)
        return sorted(gone)
