"""Stored rows that grow by folders: each folder is one job's output and counts from the moment that Spark marks it as finished.

A folder's name starts with its generation.  Readers take the finished folders of the newest generation that has any; appending adds a
folder to it, and rewriting writes all rows into the first folder of the next one, so that readers see the old folders or the new
one.  A job that was lost leaves a folder that nobody reads.  There is one writer at a time.
"""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


class Generations:
    def __init__(self, spark: SparkSession, path: str, last: str = ""):
        """last: the part of a folder that is written last and whose mark makes the folder count; the folder itself without it."""
        self.spark, self.path, self.last = spark, path.rstrip("/"), last
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _finished(self) -> list[tuple[int, str]]:
        if not self._fs.exists(self._path(self.path)):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(self._path(self.path))]
        return sorted((int(n.split("-")[0]), n) for n in names if self._fs.exists(self._path("/".join(p for p in (self.path, n, self.last, "_SUCCESS") if p))))

    def folders(self) -> list[str]:
        """Paths of the folders that hold the rows."""
        found = self._finished()
        return [f"{self.path}/{n}" for g, n in found if g == found[-1][0]]

    def new(self, following: bool = False, mark: str = "") -> str:
        """A path for a folder of the newest generation, or of the one that follows it."""
        found = self._finished()
        return f"{self.path}/{(found[-1][0] if found else 0) + following:06d}-{mark}-{uuid.uuid4().hex}"

    def drop_older(self) -> list[str]:
        """Deletes all generations but the two newest ones, as running queries may still read the one before; returns the folders."""
        found = self._finished()
        gone = [f"{self.path}/{n}" for g, n in found if g < found[-1][0] - 1]
        for folder in gone:
            self._fs.delete(self._path(folder), True)
        return gone
