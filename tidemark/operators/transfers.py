"""Transfer plans: ranges, methods, work lists, schedules, chunk ledgers, space."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scan import count_since, floored_sum, running_sum

MIB = 1 << 20
MIN_CHUNK, MAX_CHUNKS = 10 * MIB, 8


def chunk_count(size: Column, min_chunk: int = MIN_CHUNK, max_chunks: int = MAX_CHUNKS) -> Column:
    return F.when(size < min_chunk, 1).otherwise(F.greatest(F.lit(2), F.least(F.lit(max_chunks), F.floor(size / min_chunk)))).cast("int")


def plan_ranges(files: DataFrame, min_chunk: int = MIN_CHUNK, max_chunks: int = MAX_CHUNKS) -> DataFrame:
    """url, chunk_id, start_byte, end_byte of files large enough to split; the last chunk takes the rest."""
    n = chunk_count(F.col("size"), min_chunk, max_chunks)
    each = files.where(F.col("size") >= min_chunk).withColumn("n", n).withColumn("chunk_id", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    part = F.floor(F.col("size") / F.col("n"))
    return each.select("url", "chunk_id", (F.col("chunk_id") * part).alias("start_byte"), F.when(F.col("chunk_id") == F.col("n") - 1, F.col("size") - 1).otherwise((F.col("chunk_id") + 1) * part - 1).alias("end_byte"))


def resume_plan(remote: DataFrame, partials: DataFrame) -> DataFrame:
    """url, offset, range_header: from where each file goes on; null header for a fresh or complete one."""
    joined = remote.join(partials.select("url", F.col("size").alias("have")), "url", "left")
    offset = F.when(F.coalesce("have", F.lit(0)) < F.col("size"), F.coalesce("have", F.lit(0))).otherwise(F.lit(0))
    return joined.select("url", offset.alias("offset"), F.when(offset > 0, F.concat(F.lit("bytes="), offset.cast("string"), F.lit("-"))).alias("range_header"))


def transfer_plan(files: DataFrame, by: list[str], ssd: bool = True, mbps: float = 1000.0) -> DataFrame:
    """The method for each batch of files (size, range_ok): sequential, parallel or streaming."""
    n, mean = F.count("*"), F.avg("size")
    told = files.groupBy(*by).agg(n.alias("n_files"), mean.alias("mean_size"), F.count_if(F.col("size") < 10 * MIB).alias("n_small"), F.bool_and("range_ok").alias("range_ok"))
    method = (
        F.when(F.col("n_files") == 1, "sequential")
        .when((F.col("n_small") > F.col("n_files") * 0.7) & (F.col("n_files") >= 3), "parallel")
        .when((F.col("mean_size") >= 100 * MIB) & (F.col("n_files") >= 4) & F.lit(ssd and mbps > 100) & F.col("range_ok"), "streaming")
        .when((F.col("mean_size") >= 50 * MIB) & (F.col("n_files") >= 3) & F.lit(not ssd) & F.col("range_ok"), "parallel")
        .otherwise("sequential")
    )
    return told.withColumn("method", method)


def verify_chunks(ledger: DataFrame) -> DataFrame:
    """url, n_chunks, n_failed, n_gaps, size, whole: a ledger is whole if all chunks are complete and follow each other
    from byte 0."""
    before = F.lag("end_byte").over(Window.partitionBy("url").orderBy("start_byte", "chunk_id"))
    told = ledger.withColumn("gap", F.coalesce(before, F.lit(-1)) + 1 != F.col("start_byte"))
    agg = told.groupBy("url").agg(F.count("*").alias("n_chunks"), F.count_if(F.col("status") != "completed").alias("n_failed"), F.count_if("gap").alias("n_gaps"), F.sum(F.col("end_byte") - F.col("start_byte") + 1).alias("size"), F.max("end_byte").alias("last"))
    return agg.withColumn("whole", (F.col("n_failed") == 0) & (F.col("n_gaps") == 0) & (F.col("size") == F.col("last") + 1)).drop("last")


def chunk_failures(results: DataFrame, file_limit: int = 3, server_limit: int = 6, chunks: int | None = None) -> DataFrame:
    """Each result (url, server, seq, ok) with its counters after it: a file's failures since its last success, and a
    server's failures less successes, never below 0. Both are prefix scans: one server may hold most results."""
    told = count_since(results, ["url"], ["seq"], ~F.col("ok"), F.col("ok"), "file_failures", chunks)
    told = floored_sum(told, ["server"], ["seq"], F.when(F.col("ok"), -1).otherwise(1), "server_failures", chunks)
    return told.select("url", "server", "seq", "file_failures", "server_failures", (F.col("file_failures") >= file_limit).alias("file_failed"), (F.col("server_failures") >= server_limit).alias("server_open"))


def work_list(tasks: DataFrame, max_size: int = 10_000) -> DataFrame:
    """Tasks (url, path, priority, created_at): the first of equal ones, by priority, then age, at most max_size."""
    first = tasks.groupBy("url", "path").agg(F.min_by("priority", F.struct("created_at", "priority")).alias("priority"), F.min("created_at").alias("created_at"))
    return first.orderBy("priority", "created_at", "url", "path").limit(max_size)


def work_batches(tasks: DataFrame, size: int, max_size: int = 10_000, chunks: int | None = None) -> DataFrame:
    """The work list with `batch`: the first `size` tasks are batch 0, the next ones batch 1, and so on. Places are a prefix
    scan over the order of the list, so a list of any length is numbered in many tasks."""
    listed = work_list(tasks, max_size).withColumn("_all", F.lit(0))
    placed = running_sum(listed, ["_all"], ["priority", "created_at", "url", "path"], F.lit(1), "place", chunks)
    return placed.withColumn("place", F.col("place") - 1).withColumn("batch", F.floor((F.col("place")) / size)).drop("_all")


def preview(files: DataFrame, order: str = "url", n: int = 10) -> DataFrame:
    """The first n, and how many more there are."""
    more = files.agg(F.greatest(F.count("*") - n, F.lit(0)).alias("n_more"))
    return files.orderBy(order).limit(n).crossJoin(F.broadcast(more))


def guard_links(links: DataFrame, per_dir: int = 100, in_all: int = 1000, max_depth: int = 10) -> DataFrame:
    """link, dir, depth, pos, verdict for links to follow: ok, too deep, seen, dir full or full.

    A link's first visit counts; a directory takes so many, and the whole run so many in order of `pos`. The last rule
    is a top-k over all candidates, not a window over one partition.
    """
    deep = F.col("depth") > max_depth
    seen = F.row_number().over(Window.partitionBy("link", deep).orderBy("pos"))
    told = links.withColumn("verdict", F.when(deep, "too deep").when(seen > 1, "seen"))
    place = F.sum(F.when(F.col("verdict").isNull(), 1).otherwise(0)).over(Window.partitionBy("dir").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0))
    told = told.withColumn("verdict", F.when(F.col("verdict").isNull() & (place > per_dir), "dir full").otherwise(F.col("verdict")))
    top = told.where("verdict IS NULL").orderBy("pos").limit(in_all).agg(F.max("pos").alias("last"))
    return told.crossJoin(F.broadcast(top)).withColumn("verdict", F.coalesce("verdict", F.when(F.col("pos") <= F.col("last"), "ok").otherwise("full"))).drop("last")


def stale_partials(partials: DataFrame, as_of: Column, hours: int = 24) -> DataFrame:
    """path, last_activity of partial files idle for longer."""
    idle = partials.groupBy("path").agg(F.max("last_activity").alias("last_activity"))
    return idle.where(F.unix_micros(as_of.cast("timestamp")) - F.unix_micros(F.col("last_activity").cast("timestamp")) > hours * 3_600_000_000)


def splittable(size: Column, min_chunk: int = MIN_CHUNK) -> Column:
    return size >= min_chunk


def space_verdict(plan: DataFrame, volumes: DataFrame) -> DataFrame:
    """volume, needed, free, verdict. plan: volume, size, streaming (assembled chunks need twice the room)."""
    needed = plan.groupBy("volume").agg(F.sum(F.col("size") * F.when(F.col("streaming"), 1).otherwise(2)).alias("needed"))
    joined = volumes.join(needed, "volume", "left").withColumn("needed", F.coalesce("needed", F.lit(0)))
    used = (F.col("total") - F.col("free")) / F.col("total")
    verdict = F.when((F.col("free") < 100 * MIB) | (F.col("free") < F.col("needed")), "block").when(used > 0.95, "critical").when(used > 0.85, "warning").otherwise("ok")
    return joined.select("volume", "needed", "free", verdict.alias("verdict"))
