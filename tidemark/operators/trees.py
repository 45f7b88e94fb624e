"""Directory trees: discovery, listings, sizes, empty directories, redirects."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.urls import relative_path
from ..session import checkpointed, delete_folder, discard, new_folder
from ..sources.tables import ancestors
from .links import excluded_dir


def discover(edges: DataFrame, root: str, max_depth: int = 50, exclude: list[str] | None = None) -> DataFrame:
    """dir_url, depth, ord: every directory below a root, once, at its least depth.

    edges: parent, child, pos. Children outside the root and excluded ones (with all below them) are left out;
    directories at max_depth are found but not expanded. `ord` is the path of link positions, so (depth, ord) is the
    order of discovery and settles ties.

    Edges are bucketed by parent once, so a level shuffles its frontier alone (or ships it, while Spark finds it small).
    A directory with one link to it can be reached once only; what was seen is asked for the others alone, and only of
    the levels' rows of that kind. A level's table cuts the lineage; its emptiness alone reaches the driver. Edges are
    deleted at the end.
    """
    spark = edges.sparkSession
    inside = edges.where(F.col("child").startswith(root) & (F.col("child") != F.col("parent")) & (F.col("child") != root) & ~excluded_dir(F.col("child"), exclude or []))
    inside = checkpointed(inside.select("parent", "child", F.col("pos").cast("int").alias("pos")))
    often = inside.groupBy("child").agg((F.count("*") > 1).alias("often"))
    known = Bucketed(inside.join(often, "child").select("parent", "child", "pos", "often"), "parent")
    discard(inside)
    frontier = spark.createDataFrame([(root, 0, [], False)], "dir_url string, depth int, ord array<int>, often boolean")
    levels = [frontier]
    for depth in range(1, max_depth + 1):
        step = known.table.join(frontier.select("dir_url", "ord"), F.col("parent") == F.col("dir_url")).select(F.col("child").alias("dir_url"), F.lit(depth).alias("depth"), F.concat("ord", F.array("pos")).alias("ord"), "often")
        seen = reduce(lambda a, b: a.union(b), [x.where("often").select("dir_url") for x in levels])
        again = step.where("often").join(seen, "dir_url", "left_anti").groupBy("dir_url", "depth").agg(F.min("ord").alias("ord")).select("*", F.lit(True).alias("often"))
        frontier = checkpointed(step.where("NOT often").union(again))
        if frontier.isEmpty():
            discard(frontier)
            break
        levels.append(frontier)
    known.delete()
    return reduce(lambda a, b: a.union(b), levels).drop("often")


class Bucketed:
    """A table in the shared folder, bucketed by a column: joins on it leave its rows where they are."""

    def __init__(self, df: DataFrame, column: str, buckets: int | None = None) -> None:
        self.spark = df.sparkSession
        n = buckets or int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        self.path = new_folder(self.spark, "tidemark")
        self.name = self.path.rsplit("/", 1)[1].replace("-", "_")
        df.repartition(n, column).write.format("parquet").option("path", self.path).bucketBy(n, column).sortBy(column).saveAsTable(self.name)
        self.table = self.spark.table(self.name)

    def delete(self) -> None:
        self.spark.sql(f"DROP TABLE {self.name}")
        delete_folder(self.spark, self.path)


def level_counts(found: DataFrame) -> DataFrame:
    return found.groupBy("depth").agg(F.count("*").alias("n_dirs"))


def list_files(files: DataFrame, root: str, n: int = 0) -> DataFrame:
    """dir_url, url, rel, rank: the last n files of each directory by name, in ascending order of `rel` (n = 0: all).
    Duplicates stay."""
    rel = files.withColumn("rel", relative_path(F.col("url"), F.lit(root)))
    ranked = rel.withColumn("rank", F.row_number().over(Window.partitionBy("dir_url").orderBy(F.desc("rel"))))
    return (ranked.where(F.col("rank") <= n) if n else ranked).select("dir_url", "url", "rel", "rank")


def shown_of_total(files: DataFrame, n: int = 0) -> DataFrame:
    """dir_url, shown, total of such a listing."""
    total = F.count("*")
    return files.groupBy("dir_url").agg((F.least(total, F.lit(n)) if n else total).alias("shown"), total.alias("total"))


def list_dirs(dirs: DataFrame, n: int = 0) -> DataFrame:
    """root, dir_url, rel: the last n directories of each root by name, the root itself left out; n = 0: all, with the
    root, in order of discovery if dirs has (depth, ord)."""
    rel = dirs.withColumn("rel", relative_path(F.col("dir_url"), F.col("root")))
    if not n:
        return rel.orderBy("root", "depth", "ord") if "ord" in dirs.columns else rel
    ranked = rel.where("rel <> '.'").withColumn("rank", F.row_number().over(Window.partitionBy("root").orderBy(F.desc("rel"))))
    return ranked.where(F.col("rank") <= n).select("root", "dir_url", "rel")


def union_roots(frames: dict[str, DataFrame]) -> DataFrame:
    """All frames with a `suffix` column (null if there is one alone)."""
    one = len(frames) == 1
    return reduce(lambda a, b: a.unionByName(b), [df.withColumn("suffix", F.lit(None if one else name).cast("string")) for name, df in frames.items()])


def dir_sizes(files: DataFrame, path: str = "url") -> DataFrame:
    """dir, n_files, size of every directory with all below it; combined before the shuffle, so roots don't skew it."""
    return files.select(F.explode(ancestors(F.col(path))).alias("dir"), "size").groupBy("dir").agg(F.count("*").alias("n_files"), F.sum("size").alias("size"))


def empty_dirs(dirs: DataFrame, files: DataFrame, obsolete: DataFrame, key: str = "url") -> DataFrame:
    """dir_url, empty_now, empty_after: without any file below now; and after the obsolete ones go."""
    holds = lambda df: df.select(F.explode(ancestors(F.col(key))).alias("dir_url")).distinct()
    now = holds(files).withColumn("now", F.lit(True))
    after = holds(files.join(obsolete.select(key), key, "left_anti")).withColumn("after", F.lit(True))
    joined = dirs.select("dir_url").distinct().join(now, "dir_url", "left").join(after, "dir_url", "left")
    return joined.select("dir_url", F.col("now").isNull().alias("empty_now"), F.col("after").isNull().alias("empty_after")).where("empty_now OR empty_after")


def deepest_first(dirs: DataFrame) -> DataFrame:
    return dirs.orderBy(F.desc(F.size(F.split("dir_url", "/"))), "dir_url")


def resolve_redirects(redirects: DataFrame, allowed=None, max_hops: int = 10) -> DataFrame:
    """src, final_url, hops, outcome: resolved, loop, too long or blocked (a hop that `allowed` refuses).

    Paths of distinct nodes double: after k joins each node knows its next 2^k nodes, so ten hops take four rounds. A path
    holds max_hops + 1 nodes at most. It loops at the first hop whose target is on it already; of several targets of a
    source the least counts; a chain that returns to its own source loops even if that is refused.
    """
    step = redirects.groupBy(F.col("src").alias("node")).agg(F.min("dst").alias("dst"))
    step = step.withColumn("ok", F.col("dst").isNotNull() & (F.coalesce(allowed(F.col("dst")), F.lit(True)) if allowed else F.lit(True)))
    # path: the nodes after this one; stop: the refused target at its end, if there is one; open: whether it may go on
    now = checkpointed(step.select("node", F.when(F.col("ok"), F.array("dst")).otherwise(F.array().cast("array<string>")).alias("path"), F.when(~F.col("ok"), F.col("dst")).alias("stop"), F.col("ok").alias("open")))
    reach = 1
    while reach <= max_hops:
        ahead = now.select(F.col("node").alias("end"), F.col("path").alias("more"), F.col("stop").alias("stop2"), F.col("open").alias("open2"))
        met = now.withColumn("end", F.when(F.col("open"), F.element_at("path", -1))).join(ahead, "end", "left")
        path = F.slice(F.concat("path", F.coalesce("more", F.array().cast("array<string>"))), 1, max_hops + 1)
        step = checkpointed(met.select("node", path.alias("path"), F.coalesce("stop", "stop2").alias("stop"), (F.col("open") & F.coalesce("open2", F.lit(False))).alias("open")))
        discard(now)
        now, reach = step, 2 * reach
    whole = F.concat(F.array("node"), "path")
    told = now.withColumn("whole", whole).withColumn("n", F.size("path"))
    # the least hop h whose target, the node after it, stands on the path up to h
    hops = F.filter(F.sequence(F.lit(0), F.greatest(F.col("n") - 1, F.lit(0))), lambda h: (h < F.col("n")) & F.array_contains(F.slice("whole", 1, h + 1), F.get("whole", h + 1)))
    told = told.withColumn("loop", F.when((F.col("n") > 0) & (F.get(hops, F.lit(0)) <= max_hops), F.get(hops, F.lit(0))))
    home = F.col("stop") == F.col("node")
    at = F.coalesce("loop", F.least(F.col("n"), F.lit(max_hops)))
    ended = F.when(F.col("loop").isNotNull(), "loop").when(F.col("n") > max_hops, "too long").when(F.col("stop").isNull(), "resolved").when(home, "loop").when(F.col("n") == max_hops, "too long").otherwise("blocked")
    return told.select(F.col("node").alias("src"), F.get("whole", at).alias("final_url"), at.alias("hops"), ended.alias("outcome"))
