"""Connected components among items that share keys, without expanding a bucket into all its pairs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop, let_go, small, staged
from .graph import connected_components


def shared_keys(keys: DataFrame, can: Callable[[str, str], Column]) -> tuple[DataFrame, DataFrame]:
    """From keys (key, d: a struct that begins with doc), a doc at most once under a key: two (x, y: structs d, weight),
    the pairs that meet in buckets of two and for which the test `can` holds, and inside (key, d, c, weight), the members
    of buckets of c > 2 docs.

    Most keys are held once. They are counted as bare numbers, so nothing else of them is shuffled. Of several keys that
    hold the same docs, one stays, and `weight` tells how many they were.
    """
    often = staged(keys.groupBy("key").agg(F.count("*").alias("c")).where("c > 1"))
    members = staged(keys.join(small(often, 16), "key"))
    pairs = members.where("c = 2").groupBy("key").agg(F.max("d").alias("x"), F.min("d").alias("y"))
    two = staged(pairs.where(can("x", "y")).groupBy("x", "y").agg(F.count("*").alias("weight")))
    held = members.where("c > 2").groupBy("key", "c").agg(F.bit_xor(F.xxhash64("d.doc")).alias("p"), F.bit_xor(F.xxhash64("d.doc", F.lit(1))).alias("q"))
    one = staged(held.groupBy("c", "p", "q").agg(F.min("key").alias("key"), F.count("*").alias("weight")).select("key", "weight"))
    inside = staged(members.where("c > 2").join(small(one, 16), "key"))
    drop(often, members, one)
    return two, inside


def _crossing(label: DataFrame, can: Callable[[str, str], Column]) -> DataFrame:
    """Pairs (a, b), a > b, of different components in a bucket, from label (key, d, of): members outside the bucket's
    largest component with all that are in another one than theirs."""
    per = label.groupBy("key", "of").agg(F.count("*").alias("c")).groupBy("key").agg(F.max_by("of", F.struct("c", "of")).alias("main"), F.count("*").alias("parts"))
    per = staged(per.where("parts > 1").select("key", "main"))
    open_ = staged(label.join(small(per, 32), "key"))
    some = open_.where("of <> main").select("key", F.col("d").alias("x"), F.col("of").alias("ox"))
    other = open_.select("key", F.col("d").alias("y"), F.col("of").alias("oy"))
    met = some.join(other, (some.key == other.key) & (F.col("ox") != F.col("oy")) & can("x", "y"))
    found = staged(met.select(F.greatest("x.doc", "y.doc").alias("a"), F.least("x.doc", "y.doc").alias("b")))
    drop(per, open_)
    return found


def linked_components(
    two: DataFrame,
    inside: DataFrame,
    can: Callable[[str, str], Column],
    verify: Callable[[DataFrame], DataFrame],
    finer: Callable[[DataFrame], DataFrame] | None = None,
    can_finer: Callable[[str, str], Column] | None = None,
) -> DataFrame:
    """node, component over all links between docs that meet in `two` or `inside` (see shared_keys); `can` is a cheap
    necessary test on two structs d, `verify` turns pairs (a, b) into the links (u, v) among them. Docs without a link
    have no row.

    First each doc is compared with one other: the hub (the member with most company in all its buckets) of those of
    its buckets where it shares most keys with it. The copies of a text thus meet the text itself. Only what then still
    lies in several components goes on: of a bucket, the members outside its largest component are compared with all
    that are in another one, as members of one component need no comparing. `finer` may turn the members (key, d, c,
    of: their component) of such buckets into those (key, d, of) of other ones, under which two docs that link still
    meet, if `can_finer` holds, and fewer others do.
    """
    degree = staged(inside.groupBy("d.doc").agg(F.sum(F.col("c") * F.col("weight")).alias("degree")))
    ranked = inside.join(small(degree, 16), F.col("d.doc") == F.col("doc")).groupBy("key").agg(F.max_by("d", F.struct("degree", -F.col("d.doc"))).alias("hub"))
    ranked = staged(ranked)
    stars = inside.join(small(ranked, 40), "key").where("d.doc <> hub.doc").select(F.col("d").alias("x"), F.col("hub").alias("y"), "weight")
    pairs = stars.where(can("x", "y")).union(two).groupBy(F.col("x.doc").alias("a"), F.col("y.doc").alias("b")).agg(F.sum("weight").alias("shared"))
    first = staged(pairs.groupBy("a").agg(F.max_by("b", F.struct("shared", -F.col("b"))).alias("b")))
    found = staged(connected_components(verify(first)))
    let_go(first.sparkSession)

    known = small(found, 16)
    label = inside.join(known, F.col("d.doc") == F.col("node"), "left").select("key", "d", "c", F.coalesce("component", "d.doc").alias("of"))
    several = staged(label.groupBy("key").agg(F.min("of").alias("p"), F.max("of").alias("q")).where("p <> q").select("key"))
    label = staged(label.join(small(several, 8), "key", "left_semi"))
    split = staged(finer(label) if finer else label.select("key", "d", "of"))
    let_go(first.sparkSession)
    crossed = _crossing(split, can_finer or can)
    apart = two.select(F.col("x.doc").alias("a"), F.col("y.doc").alias("b"))
    apart = apart.join(known, F.col("a") == F.col("node"), "left").select("a", "b", F.coalesce("component", "a").alias("oa"))
    apart = apart.join(known, F.col("b") == F.col("node"), "left").where(F.col("oa") != F.coalesce("component", "b")).select("a", "b")
    seen = first.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    left = staged(crossed.union(apart).distinct().join(seen, ["a", "b"], "left_anti"))
    more = staged(verify(left))
    drop(degree, ranked, first, several, label, split, crossed, left)
    if more.isEmpty():
        return found
    # The further links join whole components, so only those are put together.
    apart = more.join(known, F.col("u") == F.col("node"), "left").select("v", F.coalesce("component", "u").alias("u"))
    apart = apart.join(known, F.col("v") == F.col("node"), "left").select("u", F.coalesce("component", "v").alias("v"))
    joined = small(staged(connected_components(apart).select(F.col("node").alias("was"), F.col("component").alias("now"))), 16)
    every = found.union(more.select(F.explode(F.array("u", "v")).alias("node")).distinct().join(known, "node", "left_anti").select("node", F.col("node").alias("component")))
    return staged(every.join(joined, F.col("component") == F.col("was"), "left").select("node", F.coalesce("now", "component").alias("component")))
