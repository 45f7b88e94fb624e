"""Inventory of a local tree as a Spark source: one partition a sub-tree, walked where the task runs."""

from __future__ import annotations

import os
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "path string, is_dir boolean, size long, mtime timestamp, link string, target string"


@dataclass
class Walk(InputPartition):
    """Directories to list, with all below them (deep) or alone; each with the link it was reached by and its target."""

    places: list[tuple[str, str | None, str | None]]
    deep: bool


class FileTree(DataSource):
    """Entries below the option `path`; `partitions` is how many sub-trees the driver looks for before tasks take over."""

    @classmethod
    def name(cls) -> str:
        return "file_tree"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return FileTreeReader(self.options["path"], int(self.options.get("partitions", "64")))


class FileTreeReader(DataSourceReader):
    def __init__(self, root: str, partitions: int) -> None:
        self.root, self.want = root.removeprefix("file://").removeprefix("file:").rstrip("/") or "/", partitions
        self.real = os.path.realpath(self.root)

    def _list(self, folder: str, link: str | None, target: str | None) -> tuple[list[tuple], list[tuple]]:
        """Rows of a directory's entries, and the directories among them to go on with. What can't be read is left out. A
        link to a directory is a row; it is followed only out of the tree, and not back to where it came from."""
        rows, below = [], []
        try:
            with os.scandir(folder) as found:
                entries = sorted(found, key=lambda e: e.name)
        except OSError:
            return rows, below
        for e in entries:
            try:
                is_dir, is_file = e.is_dir(), e.is_file()
                stat = e.stat()
            except OSError:
                continue
            if not (is_dir or is_file):
                continue
            rows.append((e.path + "/" * is_dir, is_dir, None if is_dir else stat.st_size, stat.st_mtime, link, target))
            if is_dir and not e.is_symlink():
                below.append((e.path, link, target))
            elif is_dir:
                real = os.path.realpath(e.path)
                inside = real == self.real or real.startswith(self.real.rstrip("/") + "/") or self.real.startswith(real.rstrip("/") + "/")
                around = target is not None and (real.startswith(target) or target.startswith(real))
                if not inside and not around and link is None:
                    below.append((e.path, e.path, real))
        return rows, below

    def partitions(self) -> list[InputPartition]:
        queue, shallow = [(self.root, None, None)], []
        while queue and len(queue) < self.want and len(shallow) < self.want:
            at = queue.pop(0)
            shallow.append(at)
            queue += self._list(*at)[1]
        return [Walk(shallow, False), *[Walk([at], True) for at in queue]]

    def read(self, partition: Walk) -> Iterator[tuple]:
        from datetime import datetime, timezone

        stack = list(reversed(partition.places))
        while stack:
            rows, below = self._list(*stack.pop())
            for path, is_dir, size, mtime, link, target in rows:
                yield path, is_dir, size, datetime.fromtimestamp(mtime, timezone.utc), link, target
            if partition.deep:
                stack += reversed(below)


def read_tree(spark: SparkSession, root: str, partitions: int = 64) -> DataFrame:
    """path, is_dir, size, mtime of all entries below a root that lies in a file system every executor mounts.

    Directories (their paths end in /) are rows, empty ones too; entries that can't be read are left out; an unreadable
    directory is a row without anything below it. A link to a directory in the tree is a row alone; of links to one
    directory outside it, the first by path is followed.
    """
    spark.dataSource.register(FileTree)
    found = spark.read.format("file_tree").option("path", root).option("partitions", partitions).load()
    first = found.where("target IS NOT NULL").groupBy("target").agg(F.min("link").alias("first")).withColumnRenamed("target", "of")
    kept = found.join(first, F.col("target") == F.col("of"), "left").where("target IS NULL OR link = first")
    return kept.select("path", "is_dir", "size", "mtime")


def is_mounted(root: str) -> bool:
    """Whether a root is a path of the local file system, not one of a store that only Spark's own readers open."""
    return "://" not in root.removeprefix("file://") and (root.startswith(("file:", "/")) or ":" not in root)
