"""Numbered manifests: small files that say which version of each bucket a slice consists of.

A writer lays new data beside the old and then adds the next manifest. Creating a manifest fails if its number is taken, so of two writers one starts again from the
other's result, and a writer that stops before this step leaves readers with what they had. Files are reached through Spark's own file systems, so any shared store works.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import SparkSession


class CommitConflict(Exception):
    """Another writer took the manifest number."""


class Manifests:
    def __init__(self, spark: SparkSession, folder: str):
        self.jvm = spark.sparkContext._jvm
        self.conf = spark.sparkContext._jsc.hadoopConfiguration()
        self.fs_package = self.jvm.org.apache.hadoop.fs
        self.folder = self.fs_package.Path(folder)
        self.fs = self.folder.getFileSystem(self.conf)

    def latest(self) -> tuple[int, dict | None]:
        """(number, content) of the newest manifest; (0, None) before the first."""
        if not self.fs.exists(self.folder):
            return 0, None
        names = [f.getPath().getName() for f in self.fs.listStatus(self.folder)]
        numbers = [int(n[: -len(".json")]) for n in names if n.endswith(".json") and n[0].isdigit()]
        if not numbers:
            return 0, None
        stream = self.fs.open(self._path(max(numbers)))
        try:
            return max(numbers), json.loads(self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def add(self, number: int, content: dict) -> None:
        """Write manifest ``number`` whole or not at all; CommitConflict if it exists."""
        self.fs.mkdirs(self.folder)
        draft = self.fs_package.Path(self.folder, f"_draft-{uuid.uuid4().hex}")
        stream = self.fs.create(draft, False)
        stream.write(bytearray(json.dumps(content), "utf-8"))
        stream.close()
        context = self.fs_package.FileContext.getFileContext(self.folder.toUri(), self.conf)
        options = self.jvm.java.lang.reflect.Array.newInstance(self._class("org.apache.hadoop.fs.Options$Rename"), 0)
        try:
            context.rename(self.fs.makeQualified(draft), self.fs.makeQualified(self._path(number)), options)
        except Exception as error:
            self.fs.delete(draft, False)
            if "FileAlreadyExists" in str(error):
                raise CommitConflict(number) from None
            raise

    def remove(self, path: str) -> None:
        """Delete a data folder that no manifest names any more."""
        self.fs.delete(self.fs_package.Path(path), True)

    def folders(self, path: str) -> list[str]:
        at = self.fs_package.Path(path)
        return [f.getPath().getName() for f in self.fs.listStatus(at)] if self.fs.exists(at) else []

    def _path(self, number: int):
        return self.fs_package.Path(self.folder, f"{number:012d}.json")

    def _class(self, name: str):
        return self.jvm.java.lang.Class.forName(name, True, self.jvm.java.lang.Thread.currentThread().getContextClassLoader())
