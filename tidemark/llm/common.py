"""Small helpers shared by the corpus operators."""

from __future__ import annotations

import gc
import tempfile
import uuid
import weakref
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a run of anything but the six ASCII blanks. The class reads the same in Java, RE2 and Python.
WORD = r"[^\x20\x09-\x0D]+"
BLANKS = r"[\x20\x09-\x0D]+"

#: A side of a join is broadcast only if a count shows that it stays under this many bytes.
BROADCAST_BYTES = 32 << 20

_own_folder: dict[str, str] = {}
_written: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


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


def staged(df: DataFrame, **options: str) -> DataFrame:
    """Write a frame once to the shared folder and read it back: lineage ends there, and a lost executor costs no recomputation."""
    path = f"{shared_folder(df.sparkSession)}/tidemark-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    _written[out] = path
    return out


def drop(*frames: DataFrame) -> None:
    """Delete the files of staged frames. Only for frames whose readers have all been staged themselves."""
    for frame in frames:
        spark, path = frame.sparkSession, _written.pop(frame)
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def spread(docs: DataFrame) -> DataFrame:
    """docs, dealt out anew if they come in fewer partitions than there are cores: one small file would keep one core busy.
    Larger inputs have more partitions than that and are left where they are. For scans; asking runs what lies before them."""
    cores = docs.sparkSession.sparkContext.defaultParallelism
    return docs if docs.rdd.getNumPartitions() >= cores else docs.repartition(cores)


def let_go(spark: SparkSession) -> None:
    """Have the driver find the frames that nothing refers to any more: Spark then deletes their shuffle files, which else
    stay on the executors' disks until the driver happens to run out of room. For the end of a phase with a large shuffle."""
    gc.collect()
    spark._jvm.System.gc()


def packed(docs: DataFrame, *plain: Column) -> DataFrame:
    """`doc`, the whole row as one struct, and the columns `plain`: no other column of docs can clash with a join's."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), *plain)


def unpacked(columns: list[str], **changed: Column) -> list[Column]:
    """The columns of `doc` again, some of them replaced."""
    return [(changed[c] if c in changed else F.col(f"doc.`{c}`")).alias(c) for c in columns]


def small(df: DataFrame, row_bytes: int | Column) -> DataFrame:
    """Hint a broadcast if the (staged) frame is shown to be small, by a count or, for rows of any length, by the sum of
    their bytes; else leave the join to a shuffle."""
    if isinstance(row_bytes, Column):
        found = df.agg(F.coalesce(F.sum(row_bytes.cast("long")), F.lit(0))).first()[0]
    else:
        found = df.count() * row_bytes
    return F.broadcast(df) if found <= BROADCAST_BYTES else df


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value computed once for each row, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    """The words of a text; a null text has none."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))


def uniform(*keys: Column) -> Column:
    """A double in (0, 1) that depends on the keys alone, from 52 bits of an MD5 (the same in any engine)."""
    digest = F.md5(F.concat_ws(":", *[F.coalesce(k.cast("string"), F.lit("~")) for k in keys]))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + F.lit(0.5)) / F.lit(float(1 << 52))
