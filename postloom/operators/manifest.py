"""Versions of a small JSON object in a shared folder; of two writers that start from one version, one gets a Conflict."""

from __future__ import annotations

import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


class Conflict(Exception):
    """Another writer has committed the version that this one was about to."""


class Manifest:
    """Version n is the file `v<n>.json`, renamed into place without overwriting (atomic on local disks and HDFS; object stores need a table service of their own for that)."""

    def __init__(self, spark: SparkSession, root: str):
        self.jvm, self.gateway, self.root = spark._jvm, spark.sparkContext._gateway, root.rstrip("/")
        conf = spark._jsparkSession.sessionState().newHadoopConf()
        self.fs = self._path().getFileSystem(conf)
        self.context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.getUri(), conf)

    def _path(self, name: str = ""):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}".rstrip("/"))

    def versions(self) -> list[int]:
        if not self.fs.exists(self._path()):
            return []
        names = [s.getPath().getName() for s in self.fs.listStatus(self._path())]
        return sorted(int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".json"))

    def subfolders(self) -> list[str]:
        """Names of the folders in this one; none if it isn't there."""
        if not self.fs.exists(self._path()):
            return []
        return sorted(s.getPath().getName() for s in self.fs.listStatus(self._path()) if s.isDirectory())

    def delete(self, folder: str) -> None:
        self.fs.delete(self._path(folder), True)

    def read(self, version: int | None = None) -> tuple[int, dict]:
        """(version, object), the latest if not given; (-1, {}) if there is none."""
        found = self.versions()
        if version is None:
            if not found:
                return -1, {}
            version = found[-1]
        stream = self.fs.open(self._path(f"v{version}.json"))
        try:
            return version, json.loads(self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def commit(self, after: int, value: dict) -> int:
        """Makes `value` the version after `after`."""
        aside, at = self._path(f".{uuid.uuid4().hex}"), self._path(f"v{after + 1}.json")
        stream = self.fs.create(aside, True)
        stream.write(bytearray(json.dumps(value, sort_keys=True).encode()))
        stream.close()
        none = self.gateway.new_array(getattr(self.jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        try:
            self.context.rename(self.context.makeQualified(aside), self.context.makeQualified(at), none)
        except Py4JJavaError as e:
            self.fs.delete(aside, False)
            if "FileAlreadyExists" in str(e.java_exception.getClass().getName()):
                raise Conflict(f"{self.root}: version {after + 1} exists") from None
            raise
        return after + 1
