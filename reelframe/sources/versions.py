"""Versions of several tables under one folder, of which readers see all or nothing.

A version is a numbered manifest that names the folders of its tables. It is made whole beside its place and put there
only if nothing stands there, in one step of the file system (a hard link on local disks, a rename that doesn't
overwrite elsewhere), so of two writers that start from one version one is refused. Numbers order versions, no clock does.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession

_DIGITS = 20


class Conflict(Exception):
    """Another writer has made the version that was to be made."""


class Versions:
    """The versions under a folder of any store that Spark reads."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = lambda *parts: jvm.org.apache.hadoop.fs.Path("/".join((self.root, *parts)))
        self._fs = self._path().getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._jvm = jvm

    def latest(self) -> int:
        """The last version's number; 0 if there is none."""
        found = self._fs.globStatus(self._path("_versions", "[0-9]" * _DIGITS))
        return max((int(f.getPath().getName()) for f in found or ()), default=0)

    def manifest(self, version: int | None = None) -> dict:
        version = self.latest() if version is None else version
        if not version:
            return {"version": 0, "parent": None, "tables": {}}
        stream = self._fs.open(self._path("_versions", f"{version:0{_DIGITS}}"))
        try:
            return json.loads(bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode())
        finally:
            stream.close()

    def read(self, name: str, version: int | None = None) -> DataFrame:
        """A table of a version, the last by default; tables that a version didn't write are its parent's."""
        return self.spark.read.parquet(f"{self.root}/{self.manifest(version)['tables'][name]}")

    def commit(self, tables: dict[str, DataFrame], parent: int | None = None) -> int:
        """Write tables and make them the version after `parent` (the last one now, by default), whose other tables stay.

        Conflict, and nothing to be seen of the tables, if that version exists by then: read again, then try again.
        """
        before = self.manifest(self.latest() if parent is None else parent)
        number, own = before["version"] + 1, uuid.uuid4().hex
        if self._fs.exists(self._path("_versions", f"{number:0{_DIGITS}}")):
            raise Conflict(number)
        places = {name: f"{name}/{number}-{own}" for name in tables}
        for name, df in tables.items():
            df.write.parquet(f"{self.root}/{places[name]}")
        self._publish(number, {"version": number, "parent": before["version"], "tables": before["tables"] | places})
        return number

    def _publish(self, number: int, manifest: dict) -> None:
        draft, place = self._path("_versions", f".{number}-{uuid.uuid4().hex}"), self._path("_versions", f"{number:0{_DIGITS}}")
        out = self._fs.create(draft, False)
        try:
            out.write(json.dumps(manifest).encode())
        finally:
            out.close()
        try:
            if self._fs.getScheme() == "file":
                local = lambda p: self._jvm.java.nio.file.Path.of(self._fs.makeQualified(p).toUri())
                self._jvm.java.nio.file.Files.createLink(local(place), local(draft))
            else:
                context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(place.toUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
                none = self.spark.sparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 0)
                context.rename(self._fs.makeQualified(draft), self._fs.makeQualified(place), none)
        except Exception as e:
            if self._fs.exists(place):
                raise Conflict(number) from e
            raise
        finally:
            self._fs.delete(draft, False)
