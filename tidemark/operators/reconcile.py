"""Remote inventory against local inventory: missing, changed, obsolete, and what to do about it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.headers import normalize_etag
from ..functions.urls import local_key

TOLERANCE_S = 1.5


def missing_files(remote: DataFrame, local: DataFrame, key: str = "url") -> DataFrame:
    return remote.join(local.select(key), key, "left_anti")


def classify_freshness(remote: DataFrame, local: DataFrame, signatures: DataFrame | None = None, no_etag: bool = False, missing_only: bool = False, use_cache: bool = True, variant: str = "sync") -> DataFrame:
    """url, needs_download, reason.

    remote: url, dir_url, size, last_modified, etag, status; local: url, size, mtime, cached_etag; signatures:
    dir_url, old_sig, new_sig. The rules hold in a strict order, each NULL-safe; what is unknown never means "current".
    `async` tests the directory before the local file, skips 403, 410 and 451, downloads on 404, compares ETags even
    with no_etag, and has no size rule. Remote and local meet on url: one shuffle each; then signatures (one row a directory) join the verdicts by directory.
    """
    have = local.select(F.col("url"), F.col("size").alias("local_size"), "mtime", "cached_etag", F.lit(True).alias("present"))
    joined = remote.join(have, "url", "left")
    present, directory = F.col("present").isNotNull(), "directory unchanged"
    status = F.coalesce(F.col("status"), F.lit(0))
    mine, theirs = normalize_etag(F.col("cached_etag")), normalize_etag(F.col("etag"))
    tags = (mine != "") & (theirs != "") & F.lit(variant == "async" or not no_etag)
    newer = F.unix_micros(F.col("last_modified").cast("timestamp")) > F.unix_micros(F.col("mtime").cast("timestamp")) + int(TOLERANCE_S * 1e6)
    size = F.coalesce(F.col("size"), F.lit(0))
    rules: list[tuple[Column, str]] = []
    if variant == "async":
        rules.append((F.lit(True), directory))
    rules.append((~present, "absent"))
    if missing_only:
        rules.append((F.lit(True), "present"))
    if not use_cache:
        rules.append(((size == F.col("local_size")) & (status == 200), "same size"))
    if variant != "async":
        rules.append((F.lit(True), directory))
    rules.append((status == 304, "not modified"))
    if variant == "async":
        rules += [(status.isin(403, 410, 451), "skipped"), (status == 404, "gone")]
    rules += [
        (status != 200, "other status"),
        (tags & (mine == theirs), "etag equal"),
        (tags, "etag differs"),
        (newer, "newer"),
        (F.col("last_modified").isNotNull(), "not newer"),
    ]
    if variant == "async":
        rules.append((F.lit(True), "assumed current"))
    rules.append((size != F.col("local_size"), "size differs"))

    def first(of: list[tuple[Column, str]]) -> Column:
        chain = F
        for test, name in of:
            chain = chain.when(test, F.lit(name))
        return chain.otherwise(F.lit("same size"))

    # Both verdicts are told before the directories are joined, so that join shuffles no more of a file than these.
    changed = joined.select("url", "dir_url", first([r for r in rules if r[1] != directory]).alias("reason"), first(rules).alias("trusted"))
    if signatures is not None:
        same = signatures.where((F.col("old_sig") == F.col("new_sig")) & ~F.col("new_sig").startswith("url:")).select("dir_url", F.lit(True).alias("unchanged"))
        changed = changed.join(same, "dir_url", "left").withColumn("reason", F.when(F.col("unchanged"), F.col("trusted")).otherwise(F.col("reason")))
    need = ["absent", "other status", "gone", "etag differs", "newer", "size differs"]
    return changed.select("url", F.col("reason").isin(need).alias("needs_download"), "reason")


def diff_signatures(old: DataFrame, new: DataFrame) -> DataFrame:
    """dir_url, change: new, gone, untrusted (url: form), unchanged or changed."""
    a, b = old.select("dir_url", F.col("signature").alias("a")), new.select("dir_url", F.col("signature").alias("b"))
    change = F.when(F.col("a").isNull(), "new").when(F.col("b").isNull(), "gone").when(F.col("b").startswith("url:"), "untrusted").when(F.col("a") == F.col("b"), "unchanged").otherwise("changed")
    return a.join(b, "dir_url", "full_outer").select("dir_url", change.alias("change"))


def obsolete_files(local: DataFrame, expected: DataFrame, pages: DataFrame, policy: str = "preview", key: str = "url") -> DataFrame:
    """Local files that are not expected; none while any listing failed, nor under policy `safe`."""
    gate = pages.agg((F.count_if("failed") == 0).alias("complete")).where(F.col("complete") & F.lit(policy != "safe"))
    return local.join(expected.select(key).distinct(), key, "left_anti").join(F.broadcast(gate.select(F.lit(1))), how="left_semi")


def stale_metadata(meta: DataFrame, expected: DataFrame, key: str = "key") -> DataFrame:
    return meta.join(expected.select(key), key, "left_anti")


def expected_keys(remote: DataFrame, root: Column) -> DataFrame:
    return remote.select(local_key(F.col("url"), root).alias("key")).where("key IS NOT NULL").distinct()


def reconcile(remote: DataFrame, local: DataFrame, key: str = "url") -> DataFrame:
    """key, side: remote only, local only, both. Duplicates count once."""
    a, b = remote.select(key).distinct().withColumn("r", F.lit(1)), local.select(key).distinct().withColumn("l", F.lit(1))
    return a.join(b, key, "full_outer").select(key, F.when(F.col("l").isNull(), "remote only").when(F.col("r").isNull(), "local only").otherwise("both").alias("side"))


def cleanup_plan(obsolete: DataFrame, policy: str, dry_run: bool = False) -> DataFrame:
    """The obsolete files with an action: keep, preview, delete or move. A plan; nothing is touched."""
    if policy not in ("safe", "preview", "delete", "move"):
        raise ValueError(f"unknown policy: {policy}")
    action = "keep" if policy == "safe" else "preview" if dry_run else policy
    return obsolete.withColumn("action", F.lit(action))


def move_plan(obsolete: DataFrame, existing: DataFrame, as_of_ms: int) -> DataFrame:
    """path, target: the destination; with _<ms> before its extension if that exists already."""
    name = F.substring_index("target", "/", -1)
    stem, ext = F.regexp_extract(name, r"(?s)^(.+?)(\.[^.]*)?$", 1), F.regexp_extract(name, r"(?s)^.+?(\.[^.]*)?$", 1)
    folder = F.substr("target", F.lit(1), F.length("target") - F.length(name))
    taken = existing.select(F.col("path").alias("taken")).distinct()
    joined = obsolete.join(taken, F.col("target") == F.col("taken"), "left")
    return joined.select("path", F.when(F.col("taken").isNotNull(), F.concat(folder, stem, F.lit(f"_{as_of_ms}"), ext)).otherwise(F.col("target")).alias("target"))


def latest_metadata(meta: DataFrame, key: str = "key", limit: int = 100_000, tie: str | None = None) -> DataFrame:
    """The newest row of each key, and of those the newest `limit` (the cache's size). Of rows of one time the largest by
    `tie`, or else by all their columns, so reruns agree; keys of one time by name."""
    row = F.struct(*[c for c in meta.columns if c != key])
    by = F.struct("updated", *([tie] if tie else []), row)
    newest = meta.groupBy(key).agg(F.max_by(row, by).alias("row")).select(key, "row.*")
    return newest.orderBy(F.desc("updated"), key).limit(limit)


def with_sizes(downloads: DataFrame, remote: DataFrame) -> DataFrame:
    """downloads (url) with their size; 0 where it is unknown."""
    return downloads.join(remote.select("url", "size"), "url", "left").withColumn("size", F.coalesce("size", F.lit(0)))


def fresh_entries(df: DataFrame, ts: str, ttl_seconds: float, as_of: Column) -> DataFrame:
    """Entries of an age of at most the TTL."""
    return df.where(F.unix_micros(as_of.cast("timestamp")) - F.unix_micros(F.col(ts).cast("timestamp")) <= int(ttl_seconds * 1e6))


def domain_profile(domains: DataFrame, throttled: DataFrame, known: list[str]) -> DataFrame:
    """domain, throttled, level: 3 for learned or known slow domains, else 5."""
    from .links import throttled_name

    joined = domains.join(throttled.select(F.col("domain"), F.lit(True).alias("learned")), "domain", "left")
    slow = F.coalesce("learned", F.lit(False)) | throttled_name(F.col("domain"), known)
    return joined.select("domain", slow.alias("throttled"), F.when(slow, 3).otherwise(5).alias("level"))
