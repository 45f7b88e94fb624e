"""A session with the settings that the operators count on."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_own_folder: dict[str, str] = {}
_tables: list[str] = []


def session(app: str = "tidemark", **settings: str) -> SparkSession:
    """UTC, adaptive execution and ANSI arithmetic; `settings` are further options with `_` for `.`."""
    builder = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true").config("spark.sql.adaptive.skewJoin.enabled", "true")
    for name, value in settings.items():
        builder = builder.config(name.replace("_", "."), value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: spark.checkpoint.dir. Where it is unset, a temporary folder if
    all runs in one process (master local), and an error on a cluster, whose executors would write to disks of their own."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    context = spark.sparkContext
    if not (context.master == "local" or context.master.startswith("local[")):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if context.applicationId not in _own_folder:
        _own_folder[context.applicationId] = tempfile.mkdtemp(prefix="tidemark-")
    return _own_folder[context.applicationId]


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut lineage: a table in the folder that all executors share. `scratch` deletes it; so does `discard`."""
    path = new_folder(df.sparkSession, "tidemark")
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._tidemark_path = path
    return out


def new_folder(spark: SparkSession, kind: str) -> str:
    """The name of a new folder under the shared one."""
    _tables.append(f"{shared_folder(spark)}/{kind}-{uuid.uuid4().hex}")
    return _tables[-1]


def discard(*frames: DataFrame) -> None:
    """Delete the tables of checkpointed frames. Only for frames that nothing still to be run reads."""
    for frame in frames:
        delete_folder(frame.sparkSession, frame._tidemark_path)


def delete_folder(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
    if path in _tables:
        _tables.remove(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Delete, at the end of the block, all tables that operators wrote to the shared folder within it. Results are lazy:
    write or collect them before the block ends."""
    before = set(_tables)
    try:
        yield
    finally:
        for path in [p for p in _tables if p not in before]:
            delete_folder(spark, path)
