"""Run snapshots: tables of a run, and a manifest that makes them visible all at once."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.headers import listing_signatures

_MANIFEST = "run_ts string, schema_version int, data string, counts map<string, bigint>"


def _path(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def write_snapshot(tables: DataFrame | dict[str, DataFrame], path: str, schema_version: int, run_ts: str) -> None:
    """Write a run's tables (a frame alone is the table `rows`), then its manifest.

    Tables go to a folder of their own; a reader sees them only through the manifest, which is put in place by one rename.
    A run that stops halfway leaves no manifest and so is never read. A run that is repeated (the same run_ts) replaces
    its manifest, after which the tables of its first attempt are deleted.
    """
    tables = {"rows": tables} if isinstance(tables, DataFrame) else tables
    spark = next(iter(tables.values())).sparkSession
    name = "".join(c if c.isalnum() else "-" for c in run_ts)
    data = f"data/{name}-{uuid.uuid4().hex}"
    for table, df in tables.items():
        df.write.parquet(f"{path}/{data}/{table}")
    counts = {t: spark.read.schema(df.schema).parquet(f"{path}/{data}/{t}").count() for t, df in tables.items()}
    old = spark.read.schema(_MANIFEST).json(f"{path}/manifests").where(F.col("run_ts") == run_ts).select("data").collect() if has_manifests(spark, path) else []
    _commit(spark, f"{path}/manifests", name, json.dumps({"run_ts": run_ts, "schema_version": schema_version, "data": data, "counts": counts}))
    for row in old:
        at, fs = _path(spark, f"{path}/{row.data}")
        fs.delete(at, True)


def has_manifests(spark: SparkSession, path: str) -> bool:
    at, fs = _path(spark, f"{path}/manifests")
    return fs.exists(at)


def _commit(spark: SparkSession, folder: str, name: str, text: str) -> None:
    """A small file that appears whole: written under a hidden name, then renamed over what may be there."""
    fs_ = spark._jvm.org.apache.hadoop.fs
    hidden, fs = _path(spark, f"{folder}/_{uuid.uuid4().hex}")
    out = fs.create(hidden, True)
    out.write(bytearray(text.encode()))
    out.close()
    options = spark.sparkContext._gateway.new_array(getattr(fs_, "Options$Rename"), 1)
    options[0] = getattr(fs_, "Options$Rename").OVERWRITE
    final = fs_.Path(f"{folder}/{name}.json")
    fs_.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration()).rename(fs.makeQualified(hidden), fs.makeQualified(final), options)


def manifests(spark: SparkSession, path: str) -> DataFrame:
    """run_ts (as a timestamp), schema_version, data, counts of the committed runs."""
    if not has_manifests(spark, path):
        return spark.createDataFrame([], _MANIFEST).withColumn("run_ts", F.col("run_ts").cast("timestamp"))
    return spark.read.schema(_MANIFEST).json(f"{path}/manifests").withColumn("run_ts", F.col("run_ts").cast("timestamp"))


def usable_runs(runs: DataFrame, schema_version: int, max_age_days: int, as_of: Column, refresh: bool = False) -> DataFrame:
    """Runs of the right version that are at most so old; none if a refresh is forced."""
    return runs.where((F.col("schema_version") == schema_version) & (F.col("run_ts").cast("timestamp") >= as_of - F.make_interval(days=F.lit(max_age_days))) & F.lit(not refresh))


def latest_snapshot(runs: DataFrame, schema_version: int, max_age_days: int, as_of: Column, refresh: bool = False) -> DataFrame:
    """The same for runs that lie in one frame with schema_version and run_ts: the rows of the newest usable run."""
    fit = usable_runs(runs, schema_version, max_age_days, as_of, refresh)
    return fit.join(F.broadcast(fit.agg(F.max("run_ts").alias("last"))), F.col("run_ts") == F.col("last")).drop("last")


def load_snapshot(spark: SparkSession, path: str, schema: str, schema_version: int, max_age_days: int, as_of: str, refresh: bool = False, table: str = "rows", before: str | None = None) -> DataFrame:
    """A table of the newest usable run (before a time, if one is given), with schema_version and run_ts; no row where there is none. The driver reads one
    manifest's name; the table is read lazily."""
    fit = usable_runs(manifests(spark, path), schema_version, max_age_days, F.lit(as_of).cast("timestamp"), refresh)
    fit = fit.where(F.col("run_ts") < F.lit(before).cast("timestamp")) if before else fit
    last = fit.orderBy(F.desc("run_ts")).select("data", "run_ts").first()
    stamp = lambda df, ts: df.withColumn("schema_version", F.lit(schema_version)).withColumn("run_ts", F.lit(ts).cast("timestamp"))
    if last is None:
        return stamp(spark.createDataFrame([], schema), None)
    return stamp(spark.read.schema(schema).parquet(f"{path}/{last.data}/{table}"), last.run_ts)


LISTINGS = "dir_url string, child string, is_dir boolean"
DIRECTORIES = "dir_url string, n_files bigint, n_dirs bigint, content_hash string"


def parsed_listings(links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """From links (dir_url, child, is_dir): the listings, a row a child, and the directories with their counts and content
    hash (MD5 over the sorted children). A directory of any size is many rows, not one array."""
    rows = links.select("dir_url", "child", "is_dir").distinct()
    counts = rows.groupBy("dir_url").agg(F.count_if(~F.col("is_dir")).alias("n_files"), F.count_if("is_dir").alias("n_dirs"))
    return rows, counts.join(listing_signatures(rows, "dir_url", "child").withColumnRenamed("signature", "content_hash"), "dir_url")
