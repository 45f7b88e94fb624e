"""Request-log streams: incident windows, throughput, de-duplication, sessions, late rows, incremental reconcile."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from datetime import datetime, timedelta

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState
from pyspark.sql.types import LongType, StructField, StructType

from ..operators.logs import failure_runs  # noqa: F401  a batch query; callers of this module may know it from here
from ..session import checkpointed, discard, new_folder
from ..sources.snapshots import load_snapshot, write_snapshot

LATE = "1 day"


def incident_windows(log: DataFrame, least: int = 5) -> DataFrame:
    """domain, window start and end, incidents: 14-day windows a day apart with enough 429 or 503 answers."""
    hit = log.where(F.col("status").isin(429, 503)).withWatermark("ts", LATE)
    counts = hit.groupBy(F.window("ts", "14 days", "1 day").alias("w"), F.lower("domain").alias("domain")).agg(F.count("*").alias("incidents"))
    return counts.where(F.col("incidents") >= least).select("domain", F.col("w.start").alias("start_ts"), F.col("w.end").alias("end_ts"), "incidents")


def throughput(log: DataFrame, width: str = "10 seconds", delay: str | None = LATE) -> DataFrame:
    """start_ts, n_files, bytes, mb_per_s of tumbling windows."""
    marked = log.withWatermark("ts", delay) if delay else log  # None: the stream has its own watermark
    w = marked.groupBy(F.window("ts", width).alias("w")).agg(F.count("*").alias("n_files"), F.sum("bytes").alias("bytes"))
    seconds = F.col("w.end").cast("long") - F.col("w.start").cast("long")
    return w.select(F.col("w.start").alias("start_ts"), "n_files", "bytes", (F.col("bytes") / 1e6 / seconds).alias("mb_per_s"))


def _by_time(batches: Iterator[pd.DataFrame], *order: str) -> pd.DataFrame:
    parts = list(batches)
    return (pd.concat(parts) if len(parts) > 1 else parts[0]).sort_values(list(order), kind="stable", ignore_index=True)


def _ms(ts: pd.Timestamp) -> int:
    return ts.value // 1_000_000


def distinct_within(log: DataFrame, key: str = "url", ttl: str = "1 hour", tie: str = "event_id", delay: str = LATE) -> DataFrame:
    """key, ts, tie of the rows that start a key's time to live: its first row, and each first row more than `ttl` after the
    one that started it last. What comes in between is dropped and doesn't prolong it.

    State is one time a key, with a timer: once the watermark is past it the key is forgotten. A batch's rows of a key are
    ordered by time; rows later than the watermark are dropped by Spark (`late_rows` counts them).
    """
    span = pd.Timedelta(ttl)
    kind = log.schema[key].dataType.simpleString(), log.schema[tie].dataType.simpleString()

    def admit(at: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = _by_time(batches, "ts", tie)
        first = pd.Timestamp(state.get[0]) if state.exists else None
        kept = []
        for i, ts in enumerate(rows["ts"]):
            if first is None or ts - first > span:
                first = ts
                kept.append(i)
        state.update((first.to_pydatetime(),))
        state.setTimeoutTimestamp(max(_ms(first + span) + 1, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({key: [at[0]] * len(kept), "ts": rows["ts"].iloc[kept].array, tie: rows[tie].iloc[kept].array})

    told = log.select(key, "ts", tie).withWatermark("ts", delay).groupBy(key)
    return told.applyInPandasWithState(admit, f"`{key}` {kind[0]}, ts timestamp, `{tie}` {kind[1]}", "first timestamp", "append", "EventTimeTimeout")


def transfer_sessions(log: DataFrame, key: str = "partial", gap: str = "24 hours", delay: str = LATE) -> DataFrame:
    """key, start_ts, last_ts, bytes, state: the closed sessions of each partial file.

    A row (ts, bytes, completed) opens or goes on with its file's session; `completed` closes it at once. Without a row for
    `gap` it is stale: closed by the next row, or, where nothing arrives any more, by a timer once the watermark has passed
    its end. A closed session leaves no state. Sessions still open are not told of.
    """
    pause = pd.Timedelta(gap)
    names = [key, "start_ts", "last_ts", "bytes", "state"]

    def follow(at: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        done = []
        start = last = None
        total = 0
        if state.exists:
            start, last, total = pd.Timestamp(state.get[0]), pd.Timestamp(state.get[1]), state.get[2]
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame([(at[0], start, last, total, "stale")], columns=names)
            return
        rows = _by_time(batches, "ts", "completed")
        for ts, size, completed in zip(rows["ts"], rows["bytes"], rows["completed"]):
            if start is not None and ts - last >= pause:
                done.append((at[0], start, last, total, "stale"))
                start = None
            if start is None:
                start, last, total = ts, ts, 0
            start, last, total = min(start, ts), max(last, ts), total + int(size)
            if completed:
                done.append((at[0], start, last, total, "completed"))
                start = None
        if start is not None and _ms(last + pause) <= state.getCurrentWatermarkMs():
            done.append((at[0], start, last, total, "stale"))
            start = None
        if start is not None:
            state.update((start.to_pydatetime(), last.to_pydatetime(), total))
            state.setTimeoutTimestamp(_ms(last + pause))
        elif state.exists:
            state.remove()
        if done:
            yield pd.DataFrame(done, columns=names)

    kind = log.schema[key].dataType.simpleString()
    told = log.select(key, "ts", F.coalesce("bytes", F.lit(0)).cast("long").alias("bytes"), F.coalesce("completed", F.lit(False)).alias("completed")).withWatermark("ts", delay).groupBy(key)
    return told.applyInPandasWithState(follow, f"`{key}` {kind}, start_ts timestamp, last_ts timestamp, bytes long, state string", "start timestamp, last timestamp, bytes long", "append", "EventTimeTimeout")


def rolling_profile(log: DataFrame, width: str = "1 hour", step: str = "10 minutes") -> DataFrame:
    """domain, start_ts, n, error_rate, avg_rtt_ms of sliding windows."""
    w = log.withWatermark("ts", LATE).groupBy(F.window("ts", width, step).alias("w"), "domain")
    told = w.agg(F.count("*").alias("n"), F.count_if(F.col("status") >= 400).alias("errors"), F.avg(F.when(F.col("status") < 400, F.col("rtt_ms"))).alias("avg_rtt_ms"))
    return told.select("domain", F.col("w.start").alias("start_ts"), "n", (F.col("errors") / F.col("n")).alias("error_rate"), "avg_rtt_ms")


def late_rows(log: DataFrame, until: Column, delay: str = LATE, folder: str | None = None) -> tuple[DataFrame, DataFrame]:
    """The rows of a stream that came too late to count, and a row (batch, watermark, n, n_late) for each batch.

    until: the end of the last window that a row belongs to (or its own time). A row is late if that end is not after the
    watermark of its batch: the latest time of all batches before it, less `delay`, which is how Spark's windows drop it.
    Runs what the source holds now, and goes on from there when called again with the same `folder`; a repeated batch replaces its rows. A batch's mark is one row, and marks are read back
    by the next batch as one maximum.
    """
    spark = log.sparkSession
    base = folder or new_folder(spark, "stream")
    marks = "batch long, latest timestamp, watermark timestamp, n long, n_late long"

    def batch(df: DataFrame, number: int) -> None:
        s = df.sparkSession
        known = s.read.schema(marks).parquet(f"{base}/marks/batch=*").where(F.col("batch") < number) if number else s.createDataFrame([], marks)
        limit = known.agg((F.max("latest") - F.expr(f"INTERVAL {delay}")).alias("w")).first().w
        told = df.withColumn("_late", F.coalesce(until.cast("timestamp") <= F.lit(limit).cast("timestamp"), F.lit(False)))
        told.where("_late").drop("_late").write.mode("overwrite").parquet(f"{base}/late/batch={number}")
        one = told.agg(F.max("ts").alias("latest"), F.count("*").alias("n"), F.count_if("_late").alias("n_late"))
        one = one.select(F.lit(number).cast("long").alias("batch"), "latest", F.lit(limit).cast("timestamp").alias("watermark"), "n", "n_late")
        one.coalesce(1).write.mode("overwrite").parquet(f"{base}/marks/batch={number}")

    query = log.writeStream.foreachBatch(batch).option("checkpointLocation", f"{base}/progress").trigger(availableNow=True).start()
    query.awaitTermination()
    late = spark.read.schema(log.schema).parquet(f"{base}/late/batch=*")
    return late, spark.read.schema(marks).parquet(f"{base}/marks/batch=*").select("batch", "watermark", "n", "n_late")


def run_available(stream: DataFrame, mode: str = "append", keys: list[str] | None = None) -> DataFrame:
    """Run a stream over what its source holds now, and return what it wrote. Output and progress lie in the shared
    folder, where a restarted query goes on.

    Update mode: each batch is written to a folder of its own number, so a repeated batch replaces itself, and of the
    rows of one key (the columns `keys`) the last batch's counts. State is kept for as long as the watermark asks.
    """
    spark = stream.sparkSession
    base = new_folder(spark, "stream")
    if mode == "append":
        query = stream.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/progress").trigger(availableNow=True).start()
        query.awaitTermination()
        return spark.read.schema(stream.schema).parquet(f"{base}/out")
    query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{base}/progress").foreachBatch(lambda df, n: df.write.mode("overwrite").parquet(f"{base}/out/batch={n}")).trigger(availableNow=True).start()
    query.awaitTermination()
    told = spark.read.schema(StructType([*stream.schema.fields, StructField("batch", LongType())])).parquet(f"{base}/out")
    if mode == "complete":
        return told.join(F.broadcast(told.agg(F.max("batch").alias("batch"))), "batch").select(*stream.columns)
    row = F.struct(*stream.columns)
    return told.groupBy(*keys).agg(F.max_by(row, "batch").alias("row")).select("row.*")


def stream_table(spark: SparkSession, folder: str, name: str, files_a_batch: int | None = None) -> DataFrame:
    """A stream of a Parquet table `name` (a file or a folder of files) in a folder."""
    schema = spark.read.parquet(f"{folder}/{name}").schema
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", files_a_batch) if files_a_batch else reader).parquet(f"{folder}/{name}*")


#: Directories of at most so many are sent whole to each executor (about 100 bytes each).
BROADCAST_DIRS = 200_000

SNAPSHOT = {"dirs": "dir_url string, signature string", "files": "url string, dir_url string, size long, last_modified timestamp, etag string, status int"}


def _signatures(lines: DataFrame) -> DataFrame:
    """dir_url, signature from (dir_url, line: an MD5 a file): the MD5 over the number of a directory's lines and the sums
    of the four quarters of their MD5s. It doesn't depend on their order, so tasks sum up before the shuffle."""
    quarter = lambda i: F.sum(F.conv(F.substring("line", 8 * i + 1, 8), 16, 10).cast("long"))
    sums = lines.groupBy("dir_url").agg(F.count("*").alias("n"), *[quarter(i).alias(f"q{i}") for i in range(4)])
    return sums.select("dir_url", F.concat(F.lit("content:"), F.md5(F.concat_ws(":", "n", "q0", "q1", "q2", "q3"))).alias("signature"))


def _files_of(files: DataFrame, stay: DataFrame, gone: DataFrame) -> DataFrame:
    """The snapshot's files of the directories `stay`, which are all but `gone`. The smaller of the two tables is sent to
    the files if a count shows that it is small; then the files are not shuffled."""
    n_stay, n_gone = stay.count(), gone.count()
    how, side = ("left_semi", stay) if n_stay <= n_gone else ("left_anti", gone)
    side = side.select(F.col("dir_url").alias("dir_"))
    same = F.col("dir_url").eqNullSafe(F.col("dir_")) if how == "left_semi" else F.col("dir_url") == F.col("dir_")  # a null directory stays
    return files.join(F.broadcast(side) if min(n_stay, n_gone) <= BROADCAST_DIRS else side, same, how)


def incremental_reconcile(listing: DataFrame, local: Callable[[SparkSession], DataFrame], store: str, sink: Callable[[DataFrame, DataFrame, int], None], progress: str, schema_version: int = 1, variant: str = "sync") -> StreamingQuery:
    """Start a query that compares each batch of listings with the snapshot before it, and merges it into the next.

    listing: url, dir_url, size, last_modified, etag, status; a batch holds whole directories. Its directories' signatures
    are compared with the snapshot's (`diff_signatures`), its files with the local ones (`classify_freshness`), which trusts
    directories whose signature is unchanged; `sink` gets the changes of directories (dir_url, change), the verdicts
    (url, needs_download, reason) and the batch's number. Then the snapshot's other directories and the batch's make the
    snapshot of that number, committed by its manifest. A repeated batch reads the snapshot before its own number and
    replaces its own, so it changes nothing.
    """
    from ..operators.reconcile import classify_freshness, diff_signatures

    stamp = lambda n: (datetime(2000, 1, 1) + timedelta(seconds=n)).isoformat(" ")  # noqa: E731  a batch's number as a run time

    def batch(df: DataFrame, number: int) -> None:
        s = df.sparkSession
        now = checkpointed(df.select(*[F.col(name).cast(kind).alias(name) for name, kind in (f.split() for f in SNAPSHOT["files"].split(", "))]))
        old = {t: load_snapshot(s, store, schema, schema_version, 1 << 15, stamp(number), table=t, before=stamp(number)).select(*[f.split()[0] for f in schema.split(", ")]) for t, schema in SNAPSHOT.items()}
        line = F.concat_ws("|", "url", F.coalesce("etag", F.lit("")), F.coalesce(F.col("last_modified").cast("string"), F.lit("")), F.coalesce("size", F.lit(0)).cast("string"))
        dirs = checkpointed(_signatures(now.select("dir_url", F.md5(line).alias("line"))))
        before = old["dirs"].join(dirs.select("dir_url"), "dir_url", "left_semi")
        both = before.select("dir_url", F.col("signature").alias("old_sig")).join(dirs.select("dir_url", F.col("signature").alias("new_sig")), "dir_url")
        sink(diff_signatures(before, dirs), classify_freshness(now, local(s), both, variant=variant), number)
        rest = checkpointed(old["dirs"].join(dirs.select("dir_url"), "dir_url", "left_anti"))
        merged = {"dirs": rest.unionByName(dirs), "files": _files_of(old["files"], rest, dirs).unionByName(now)}
        write_snapshot(merged, store, schema_version, stamp(number))
        discard(now, dirs, rest)

    return listing.writeStream.foreachBatch(batch).option("checkpointLocation", progress).trigger(availableNow=True).start()
