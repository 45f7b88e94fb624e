"""Analytics over request logs: counters, latency, profiles, windows, curves, classes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.headers import backoff_seconds, retry_after_seconds
from .scan import moving_average, prefix_scan, running_sum

THROTTLE_DAYS, THROTTLE_COUNT = 14, 5
SLOW_RTT_MS, MANY_ERRORS = 1000.0, 0.05
MILESTONES = (25, 50, 75, 90, 100)


def last_k(df: DataFrame, key: str, ts: str, k: int, tie: str = "event_id") -> DataFrame:
    """The newest k rows of each key. Spark keeps k rows a key and task before the shuffle (a top-k window)."""
    order = Window.partitionBy(key).orderBy(F.desc(ts), F.desc(tie))
    return df.withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= k).drop("rn")


def run_counters(events: DataFrame) -> DataFrame:
    return events.groupBy("metric").agg(F.sum("value").alias("value"))


def run_summary(log: DataFrame) -> DataFrame:
    """One row: downloaded, skipped, failed, bytes, mean milliseconds and bytes a second of busy time."""
    ok = F.col("status") == 200
    busy = F.sum(F.when(ok, F.col("rtt_ms"))) / 1000
    return log.agg(
        F.count_if(ok).alias("downloaded"),
        F.count_if(F.col("status").isin(304, 403, 404, 410, 451)).alias("skipped"),
        F.count_if((F.col("status") >= 400) & ~F.col("status").isin(403, 404, 410, 451)).alias("failed"),
        F.coalesce(F.sum(F.when(ok, F.col("bytes"))), F.lit(0)).alias("bytes"),
        F.avg("rtt_ms").alias("mean_ms"),
        F.coalesce(F.try_divide(F.sum(F.when(ok, F.col("bytes"))), busy), F.lit(0.0)).alias("bytes_per_s"),
    )


def run_report(log: DataFrame, parses: DataFrame, lookups: DataFrame) -> DataFrame:
    """`run_summary` in one row with pages_parsed, parse_mb and parse_mb_per_s, from parses (bytes, ms), and lookups, hits
    and hit_pct over all caches, from lookups (cache, hit). Without rows: zeros."""
    zero = lambda c, like=0.0: F.coalesce(c, F.lit(like))
    parsed = parses.agg(F.count("*").alias("pages_parsed"), zero(F.sum("bytes") / 1e6).alias("parse_mb"), zero(F.try_divide(F.sum("bytes") / 1e6, F.sum("ms") / 1e3)).alias("parse_mb_per_s"))
    asked = lookups.agg(F.count("*").alias("lookups"), F.count_if("hit").alias("hits"), zero(F.try_divide(F.count_if("hit") * 100.0, F.count("*"))).alias("hit_pct"))
    return run_summary(log).crossJoin(parsed).crossJoin(asked)  # one row each


def latency_stats(log: DataFrame, last_n: int = 1000) -> DataFrame:
    """operation, avg_ms, p95_ms, max_ms, min_ms, count of the newest rows; success and failure over all rows.
    p95 is the value of 1-based rank floor(0.95 n) + 1."""
    recent = last_k(log, "operation", "ts", last_n)
    by = Window.partitionBy("operation")
    ranked = recent.withColumn("n", F.count("*").over(by)).withColumn("rk", F.row_number().over(by.orderBy("rtt_ms", "event_id")))
    at = F.floor(F.lit(0.95) * F.col("n")) + 1
    stats = ranked.groupBy("operation").agg(F.avg("rtt_ms").alias("avg_ms"), F.max(F.when(F.col("rk") == at, F.col("rtt_ms"))).alias("p95_ms"), F.max("rtt_ms").alias("max_ms"), F.min("rtt_ms").alias("min_ms"), F.count("*").alias("n"))
    totals = log.groupBy("operation").agg(F.count_if(F.col("status") < 400).alias("success"), F.count_if(F.col("status") >= 400).alias("failure"))
    return stats.join(totals, "operation")


def latency_totals(stats: DataFrame) -> DataFrame:
    """One row over the operations of `latency_stats`: operations, calls (of the kept rows), success, failure, success_pct,
    mean_ms (weighted by calls), slowest operation by its p95 (the first by name of equal ones). Without operations: zeros."""
    done = F.coalesce(F.sum("success"), F.lit(0))
    lost = F.coalesce(F.sum("failure"), F.lit(0))
    return stats.agg(
        F.count("*").alias("operations"), F.coalesce(F.sum("n"), F.lit(0)).alias("calls"), done.alias("success"), lost.alias("failure"),
        F.coalesce(F.try_divide(done * 100.0, done + lost), F.lit(0.0)).alias("success_pct"), F.coalesce(F.try_divide(F.sum(F.col("avg_ms") * F.col("n")), F.sum("n")), F.lit(0.0)).alias("mean_ms"),
        F.min(F.struct(-F.col("p95_ms"), F.col("operation")))["operation"].alias("slowest"),
    )


def domain_stats(log: DataFrame, last_n: int = 50, ok_rule: str = "status") -> DataFrame:
    """domain, n, error_rate, avg_rtt_ms, files_per_s, throttled_now, ever_throttled over the newest rows of a domain.
    ok_rule `status`: below 400; `any_response`: any status. ever_throttled looks at all prefixes of those rows."""
    ok = F.col("status") < 400 if ok_rule == "status" else F.col("status").isNotNull()
    recent = last_k(log, "domain", "ts", last_n).withColumn("ok", ok)
    upto = Window.partitionBy("domain").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    rate = 1 - F.count_if("ok").over(upto) / F.count("*").over(upto)
    rtt = F.coalesce(F.avg(F.when(F.col("ok"), F.col("rtt_ms"))).over(upto), F.lit(0.0))
    told = recent.withColumn("slow", (rate > MANY_ERRORS) | (rtt > SLOW_RTT_MS))
    good = F.count_if("ok")
    agg = told.groupBy("domain").agg(
        F.count("*").alias("n"),
        (1 - good / F.count("*")).alias("error_rate"),
        F.coalesce(F.avg(F.when(F.col("ok"), F.col("rtt_ms"))), F.lit(0.0)).alias("avg_rtt_ms"),
        F.coalesce(F.try_divide(good, F.sum(F.when(F.col("ok"), F.col("rtt_ms"))) / 1000), F.lit(0.0)).alias("files_per_s"),
        F.bool_or("slow").alias("ever_throttled"),
    )
    return agg.withColumn("throttled_now", (F.col("error_rate") > MANY_ERRORS) | (F.col("avg_rtt_ms") > SLOW_RTT_MS))


def server_verdict(log: DataFrame, samples: int = 20) -> DataFrame:
    """domain, verdict over its first samples: fallback (over 5 % errors), slow (mean over 1000 ms), or ok."""
    first = log.withColumn("rn", F.row_number().over(Window.partitionBy("domain").orderBy("ts", "event_id"))).where(F.col("rn") <= samples)
    errors, rtt = F.count_if(F.col("status") >= 400) / F.count("*"), F.avg(F.when(F.col("status") < 400, F.col("rtt_ms")))
    return first.groupBy("domain").agg(F.when(errors > MANY_ERRORS, "fallback").when(rtt > SLOW_RTT_MS, "slow").otherwise("ok").alias("verdict"))


def sample_urls(df: DataFrame, key: str = "domain", order: str = "url", n: int = 20) -> DataFrame:
    return df.withColumn("rn", F.row_number().over(Window.partitionBy(key).orderBy(order))).where(F.col("rn") <= n)


def throttled_domains(log: DataFrame, as_of: Column, days: int = THROTTLE_DAYS, least: int = THROTTLE_COUNT) -> DataFrame:
    """domain (lower-cased, never empty), incidents: those with enough 429 or 503 answers since the cut-off, inclusive."""
    cut = as_of - F.make_interval(days=F.lit(days))
    hit = log.where(F.col("status").isin(429, 503) & (F.col("ts") >= cut) & (F.col("ts") <= as_of)).withColumn("domain", F.lower("domain")).where("domain <> ''")
    return hit.groupBy("domain").agg(F.count("*").alias("incidents")).where(F.col("incidents") >= least)


def hit_rates(log: DataFrame) -> DataFrame:
    """cache, hit_pct from rows (cache, hit)."""
    return log.groupBy("cache").agg((F.count_if("hit") * 100.0 / F.count("*")).alias("hit_pct"))


def errors_by_type(errors: DataFrame) -> DataFrame:
    return errors.groupBy("type").agg(F.count("*").alias("n"))


def newest(df: DataFrame, n: int, ts: str = "ts", tie: str = "event_id") -> DataFrame:
    return df.orderBy(F.desc(ts), F.desc(tie)).limit(n)


def distinct_urls(df: DataFrame, url: str = "url") -> DataFrame:
    return df.select(url).where(F.col(url) != "").dropDuplicates([url])


def suffix_summary(results: DataFrame) -> DataFrame:
    """status, n, n_suffixes, first_suffix, last_suffix of a run over several roots (suffix, status). A status may hold any
    number of roots, so they are counted; `suffixes_of` lists them as rows."""
    per = results.groupBy("status", "suffix").agg(F.count("*").alias("n"))
    return per.groupBy("status").agg(F.sum("n").alias("n"), F.count("*").alias("n_suffixes"), F.min("suffix").alias("first_suffix"), F.max("suffix").alias("last_suffix"))


def suffixes_of(results: DataFrame, most: int = 20) -> DataFrame:
    """status, suffix, rank: the first `most` roots of each status by name, a top-k window."""
    names = results.select("status", "suffix").distinct()
    return names.withColumn("rank", F.row_number().over(Window.partitionBy("status").orderBy("suffix"))).where(F.col("rank") <= most)


def symlink_stats(links: DataFrame) -> DataFrame:
    return links.agg(F.count("*").alias("followed"), F.countDistinct("link").alias("n_unique"), F.countDistinct("dir").alias("n_dirs"))


def queue_stats(tasks: DataFrame) -> DataFrame:
    return tasks.groupBy("state").agg(*[F.count_if(F.col("priority") == p).alias(name) for p, name in ((0, "high"), (1, "normal"), (2, "low"))])


def rolling_speed(batches: DataFrame, threshold: float = 25.0, width: int = 5) -> DataFrame:
    """Adds mean_speed over the last batches of a key and slow: below 0.6 of the threshold."""
    over = Window.partitionBy("key").orderBy("batch").rowsBetween(-(width - 1), 0)
    return batches.withColumn("mean_speed", F.avg("speed").over(over)).withColumn("slow", F.col("mean_speed") < 0.6 * threshold)


def bandwidth_curve(log: DataFrame, chunks: int | None = None) -> DataFrame:
    """domain, sec, bytes, peak, ewma: bytes a second with any traffic, the peak so far, and 0.9 avg + 0.1 cur from 0, over
    all seconds of a domain. Both are prefix scans, so a domain with most of the traffic runs in many tasks."""
    per = log.groupBy("domain", F.date_trunc("second", "ts").alias("sec")).agg(F.sum("bytes").alias("bytes"))
    told = moving_average(per, ["domain"], ["sec"], "bytes", "ewma", chunks=chunks)
    told = prefix_scan(told, ["domain"], ["sec"], lambda df, w: df.withColumn("_p", F.max("bytes").over(w)), [F.max("bytes").alias("_t")], lambda df, w: df.withColumn("_p0", F.max("_t").over(w)), chunks)
    return told.select("domain", "sec", "bytes", F.greatest("_p", "_p0").alias("peak"), "ewma")


def throughput_change(samples: DataFrame) -> DataFrame:
    """Adds change (ratio to the previous sample of a key) and trend: up or down beyond 5 %, else flat."""
    before = F.lag("value").over(Window.partitionBy("key").orderBy("ts", "event_id"))
    told = samples.withColumn("change", F.try_divide(F.col("value"), before) - 1)
    return told.withColumn("trend", F.when(F.col("change") > 0.05, "up").when(F.col("change") < -0.05, "down").when(F.col("change").isNotNull(), "flat"))


def progress_curve(log: DataFrame, chunks: int | None = None) -> DataFrame:
    """job, ts, event_id, done, pct, rate, eta_s from rows (job, ts, event_id, total). Counts and first times are a prefix
    scan, so one job may hold most rows."""
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    told = prefix_scan(
        log, ["job"], ["ts", "event_id"], lambda df, w: df.withColumn("_at", at).withColumn("_n", F.count("*").over(w)).withColumn("_f", F.min("_at").over(w)),
        [F.count("*").alias("_t"), F.min("_at").alias("_ft")], lambda df, w: df.withColumn("_n0", F.sum("_t").over(w)).withColumn("_f0", F.min("_ft").over(w)), chunks,
    )
    told = told.withColumn("done", F.col("_n") + F.coalesce("_n0", F.lit(0))).withColumn("spent", (F.col("_at") - F.least("_f", "_f0")) / 1e6).withColumn("pct", F.col("done") * 100.0 / F.col("total"))
    told = told.withColumn("rate", F.when(F.col("spent") > 0, F.col("done") / F.col("spent")).otherwise(0.0))
    return told.withColumn("eta_s", F.when(F.col("rate") > 0, (F.col("total") - F.col("done")) / F.col("rate"))).select("job", "ts", "event_id", "done", "pct", "rate", "eta_s")


def milestones(curve: DataFrame, marks: tuple[int, ...] = MILESTONES) -> DataFrame:
    """job and the first time at which each milestone was reached."""
    return curve.groupBy("job").agg(*[F.min(F.when(F.col("pct") >= m, F.col("ts"))).alias(f"at_{m}") for m in marks])


def active_curve(log: DataFrame, cap: int = 20, chunks: int | None = None) -> DataFrame:
    """domain, peak, over_cap: most transfers at once (ends count before starts), and starts beyond the cap. The running
    count is a prefix scan: a busy host runs in many tasks."""
    start = F.unix_micros(F.col("ts").cast("timestamp"))
    events = log.select("domain", start.alias("at"), F.lit(1).alias("d"), "event_id").union(log.select("domain", start + (F.col("rtt_ms") * 1000).cast("long"), F.lit(-1), "event_id"))
    told = running_sum(events, ["domain"], ["at", "d", "event_id"], F.col("d"), "active", chunks)
    return told.groupBy("domain").agg(F.max("active").alias("peak"), F.count_if((F.col("d") == 1) & (F.col("active") > cap)).alias("over_cap"))


def failure_runs(log: DataFrame, chunks: int | None = None) -> DataFrame:
    """domain, start_ts, end_ts, failures: the longest stretches of failed results (domain, event_id, ts, ok) of each
    domain without a success between, by event time. A stretch is known by the successes before it, a running sum."""
    told = running_sum(log, ["domain"], ["ts", "event_id"], F.col("ok").cast("int"), "run", chunks).where("NOT ok")
    return told.groupBy("domain", "run").agg(F.min("ts").alias("start_ts"), F.max("ts").alias("end_ts"), F.count("*").alias("failures")).drop("run")


def classify_responses(log: DataFrame, max_retries: int = 3, as_of: Column | None = None) -> DataFrame:
    """Adds class, is_incident and wait_s. log: status, attempt and retry_after."""
    s, left = F.col("status"), F.col("attempt") < max_retries
    kind = (
        F.when(s == 304, "not modified").when(s == 416, "range").when(s.isin(301, 302, 303, 307, 308), "redirect").when(s < 300, "ok")
        .when((s == 429) & left, "retry").when((s >= 500) & left, "retry").when(s >= 500, "final 5xx").otherwise("final 4xx")
    )
    asked = retry_after_seconds(F.col("retry_after"), as_of if as_of is not None else F.current_timestamp())
    wait = F.when(kind == "retry", F.greatest(F.coalesce(asked, F.lit(0.0)), backoff_seconds(F.col("attempt"))))
    return log.withColumn("class", kind).withColumn("is_incident", s.isin(429, 503)).withColumn("wait_s", wait)


def classify_transfers(log: DataFrame) -> DataFrame:
    """Adds outcome. log: status, partial_bytes (0: none) and content_range."""
    s, part = F.col("status"), F.coalesce(F.col("partial_bytes"), F.lit(0))
    total = F.regexp_extract("content_range", r"/([0-9]+)$", 1).try_cast("long")
    return log.withColumn(
        "outcome",
        F.when((s == 416) & F.coalesce(part >= total, F.lit(False)), "already complete").when(s == 416, "restart").when((s == 206) & (part > 0), "resumed").when((s == 200) & (part > 0), "range ignored")
        .when(s.isin(200, 206), "downloaded").when(s.isin(403, 404, 410, 451), "skipped").otherwise("failed"),
    )


def retry_accounts(attempts: DataFrame) -> DataFrame:
    """url, attempts, last_status, failed, verdict from a chunk's attempts (url, chunk_id, attempt, ok, status): done,
    retry while at most half of the chunks failed last, else failed."""
    chunk = attempts.groupBy("url", "chunk_id").agg(F.max("attempt").alias("attempts"), F.max_by("ok", "attempt").alias("ok"), F.max_by("status", "attempt").alias("status"))
    told = chunk.groupBy("url").agg(F.max("attempts").alias("attempts"), F.max_by("status", F.struct("attempts", "chunk_id")).alias("last_status"), F.count_if(~F.col("ok")).alias("failed"), F.count("*").alias("chunks"))
    return told.withColumn("verdict", F.when(F.col("failed") == 0, "done").when(F.col("failed") * 2 <= F.col("chunks"), "retry").otherwise("failed"))
