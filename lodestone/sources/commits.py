"""Versions of a folder of tables: each is named by one small file, which is there as a whole or not at all.

A writer puts its files into a folder of its own, then adds the next version's file. Only one writer can add a number; the
others find it taken. Readers take the last version and read the files that it names, whatever is added meanwhile. Files that no
version of the last few names are deleted by ``vacuum``.

The one thing asked of the file system is that a file can be created only where there is none, as in HDFS and on local disks.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import SparkSession


class Taken(RuntimeError):
    """Another writer was first."""


class Commits:
    """The versions of a folder, numbered from 1; a version is a dictionary that JSON can hold."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self._jvm = spark.sparkContext._jvm

    def _at(self, name: str):
        p = self._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        return p, p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def new_folder(self) -> str:
        return f"{self.folder}/data/{uuid.uuid4().hex}"

    def versions(self) -> list[int]:
        p, files = self._at("versions")
        if not files.exists(p):
            return []
        names = (f.getPath().getName() for f in files.listStatus(p))
        return sorted(int(n[:-5]) for n in names if n.endswith(".json"))

    def read(self, version: int) -> dict:
        return json.loads(self.get(f"versions/{version:012d}.json"))

    def last(self) -> tuple[int, dict]:
        """The last version and what it holds; 0 and nothing where there is none."""
        found = self.versions()
        return (found[-1], self.read(found[-1])) if found else (0, {})

    def commit(self, version: int, content: dict) -> None:
        """Add a version; ``Taken`` if there is one of that number."""
        if not self.create(f"versions/{version:012d}.json", json.dumps(content)):
            raise Taken(f"version {version} of {self.folder} is there already")

    def create(self, name: str, text: str) -> bool:
        """Write a file where there is none: whether that was so. The name appears with the whole text in it."""
        p, files = self._at(name)
        part, _ = self._at(f"parts/{uuid.uuid4().hex}")
        self._put(part, files, text)
        files.mkdirs(p.getParent())
        # a rename onto a file that is there fails on HDFS, but not on every local file system: the name is taken first
        claim, _ = self._at(f"claims/{name}")
        try:
            files.create(claim, False).close()
        except Exception as e:
            files.delete(part, False)
            if files.exists(claim):
                return False
            raise e
        return bool(files.rename(part, p))

    def get(self, name: str) -> str | None:
        p, files = self._at(name)
        if not files.exists(p):
            return None
        stream = files.open(p)
        try:
            return self._jvm.java.lang.String(stream.readAllBytes(), "UTF-8")
        finally:
            stream.close()

    def put(self, name: str, text: str) -> None:
        """Write a file, or replace it."""
        p, files = self._at(name)
        self._put(p, files, text)

    def delete(self, name: str) -> None:
        for x in (name, f"claims/{name}"):
            p, files = self._at(x)
            files.delete(p, True)

    def _put(self, p, files, text: str) -> None:
        stream = files.create(p, True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()

    def vacuum(self, keep: int = 2) -> list[str]:
        """Delete the folders under ``data`` that none of the last ``keep`` versions names, and forget the versions before; gives their names.

        Only when no writer is at work: what it has written isn't named yet.
        """
        found = self.versions()
        named = json.dumps([self.read(v) for v in found[-keep:]])
        p, files = self._at("data")
        gone = [f.getPath().getName() for f in files.listStatus(p)] if files.exists(p) else []
        gone = [n for n in gone if f"/data/{n}" not in named]
        for v in found[:-keep]:
            p, files = self._at(f"versions/{v:012d}.json")  # its claim stays, so that no number is used twice
            files.delete(p, False)
        for n in gone:
            p, files = self._at(f"data/{n}")
            files.delete(p, True)
        return sorted(gone)
