"""Sources and sinks: stored pages, local inventories, snapshots, incident stores, key/value caches, run records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.urls import redact_url
from .inventory import is_mounted, read_tree
from .snapshots import latest_snapshot, load_snapshot, write_snapshot  # noqa: F401

INCIDENT_VERSION = 1
KEPT_INCIDENTS = 20


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Listing pages with `status` (200 where the table has none) and `failed`: not 200, or without html."""
    pages = spark.read.parquet(path)
    status = F.col("status") if "status" in pages.columns else F.lit(200)
    return pages.withColumn("status", status.cast("int")).withColumn("failed", (F.coalesce(F.col("status"), F.lit(0)) != 200) | F.col("html").isNull())


def read_inventory(spark: SparkSession, root: str, partitions: int = 64) -> tuple[DataFrame, DataFrame]:
    """Files (path, size, mtime) below a root, and its directories (dir). Contents are not read.

    A mounted root is walked by tasks (`read_tree`), so empty directories are among them. A store that only Spark's readers
    open is listed by Spark; there, directories are those that hold a file.
    """
    if is_mounted(root):
        found = read_tree(spark, root, partitions)
        return found.where("NOT is_dir").drop("is_dir"), found.where("is_dir").select(F.col("path").alias("dir"))
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", F.col("length").alias("size"), F.col("modificationTime").alias("mtime"))
    return found, directories_of(found)


def directories_of(files: DataFrame, path: str = "path") -> DataFrame:
    """All distinct ancestors of the files' paths, each ending in /."""
    return files.select(F.explode(ancestors(F.col(path))).alias("dir")).distinct()


def ancestors(path: Column) -> Column:
    """All directories above a path: for a URL from its site on, for a plain path from its first segment on. Each is the one
    before it and one segment more."""
    site = F.regexp_extract(path, r"^([A-Za-z][A-Za-z0-9+.-]*:/+[^/]*/|/)", 1)
    parts = F.split(F.regexp_replace(path, r"^([A-Za-z][A-Za-z0-9+.-]*:/+[^/]*/|/)", ""), "/")
    inner = F.slice(parts, F.lit(1), F.size(parts) - 1)
    start = F.struct(site.alias("at"), F.when(site != "", F.array(site)).otherwise(F.array().cast("array<string>")).alias("all"))

    def step(got: Column, part: Column) -> Column:
        at = F.concat(got["at"], part, F.lit("/"))
        return F.struct(at.alias("at"), F.concat(got["all"], F.array(at)).alias("all"))

    return F.aggregate(inner, start, step, lambda got: got["all"])


def read_incidents(spark: SparkSession, path: str) -> DataFrame:
    """domain, ts from a JSON store; another version or a malformed entry gives no row."""
    return parse_incidents(spark.read.option("wholetext", "true").text(path))


def parse_incidents(raw: DataFrame) -> DataFrame:
    """The same from a column `value` of JSON text."""
    schema = T.StructType([T.StructField("_meta", T.StructType([T.StructField("version", T.IntegerType())])), T.StructField("domains", T.MapType(T.StringType(), T.StringType()))])
    told = raw.select(F.from_json("value", schema).alias("j")).where(F.col("j._meta.version") == INCIDENT_VERSION)
    each = told.select(F.explode("j.domains").alias("domain", "times"))
    return each.select("domain", F.explode(F.from_json("times", T.ArrayType(T.DoubleType()))).alias("epoch")).where("epoch IS NOT NULL").select("domain", F.timestamp_micros((F.col("epoch") * 1000000).cast("long")).alias("ts"))


def newest_incidents(df: DataFrame, k: int = KEPT_INCIDENTS) -> DataFrame:
    order = Window.partitionBy("domain").orderBy(F.desc("ts"))
    return df.withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= k).drop("rn")


def write_incidents(df: DataFrame, path: str, k: int = KEPT_INCIDENTS) -> None:
    newest_incidents(df, k).write.mode("overwrite").json(path)


def sanitize_keyed(df: DataFrame, key: str, order: str) -> tuple[DataFrame, DataFrame]:
    """Keys trimmed, empty ones dropped, the first of equal keys kept; the others are the second frame."""
    clean = df.withColumn(key, F.trim(F.col(key))).where(F.col(key) != "")
    ranked = clean.withColumn("rn", F.row_number().over(Window.partitionBy(key).orderBy(order)))
    return ranked.where("rn = 1").drop("rn"), ranked.where("rn > 1").drop("rn")


def write_metrics(df: DataFrame, path: str, url_columns: list[str]) -> None:
    """A run's metrics as JSON, with its URLs redacted. A repeated run replaces them."""
    df.withColumns({c: redact_url(F.col(c)) for c in url_columns}).write.mode("overwrite").json(path)


def health_record(summary: DataFrame, errors: DataFrame, latency: DataFrame, most: int = 20) -> DataFrame:
    """One row: summary (of one row: ok, failed, ...), errors, latency, status, is_healthy.

    errors (type, n) and latency (operation, n, ...) are told as arrays of their `most` rows with the largest n, so the
    record stays small however many kinds there are; n_error_types and n_operations count them all.
    """

    def record(df: DataFrame, name: str, count: str, tie: str) -> DataFrame:
        first = df.orderBy(F.desc("n"), tie).limit(most).agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("_o"), *df.columns))).alias("a"))
        told = first.select(F.transform("a", lambda x: F.struct(*[x[c].alias(c) for c in df.columns])).alias(name))
        return told.crossJoin(df.agg(F.count("*").alias(count)))

    one = summary.select(F.struct(*summary.columns).alias("summary"), F.col("ok"), F.col("failed"))
    told = one.crossJoin(record(errors, "errors", "n_error_types", "type")).crossJoin(record(latency, "latency", "n_operations", "operation"))
    return told.withColumn("status", F.when(F.col("ok"), "healthy").otherwise("degraded")).withColumn("is_healthy", F.col("ok") & (F.col("failed") < 10))
