"""Mix sources to target weights by Pareto order sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, packed, small, staged, table, uniform, unpacked

#: Ranks are cut into so many buckets; only the one bucket per source where the target is reached is ever sorted.
BUCKETS = 16384
#: So often a source gets one more document, of the size nearest to what it still wants.
LAST = 3


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), cap: int = 3) -> DataFrame:
    """One row per source: source, source_size, weight, target.

    Sources in code-point order (null last) take the weights in turn; the sum of all sizes is shared by weight,
    no target above `cap` times its source's size, and what is cut off is shared again until none is above.
    The sources are ranked by range partitions and their counts, so that no task holds all of them.
    """
    spark = sizes.sparkSession
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col("source").isNull().asc(), F.col("source").asc()]
    ranged = staged(per.repartitionByRange(n, *order).withColumn("part", F.spark_partition_id()))
    before = ranged.groupBy("part").count().select("part", (F.sum("count").over(Window.orderBy("part")) - F.col("count")).alias("before"))
    rank = F.col("before") + F.row_number().over(Window.partitionBy("part").orderBy(*order)) - 1
    picks = F.array(*[F.lit(w) for w in weights])
    ranked = staged(ranged.join(F.broadcast(before), "part").select("source", "source_size", F.get(picks, (rank % len(weights)).cast("int")).alias("weight")))

    limit = F.col("source_size") * cap
    total, free = ranked.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0))).first()
    share, seen = (total, free), None
    while share != seen and share[1]:  # each turn fixes more sources at their limit; two numbers reach the driver
        seen = share
        above = F.col("weight") * F.lit(float(share[0])) / F.lit(float(share[1])) > limit
        cut = ranked.agg(F.coalesce(F.sum(F.when(above, limit)), F.lit(0)), F.coalesce(F.sum(F.when(above, F.col("weight"))), F.lit(0))).first()
        share = (total - cut[0], free - cut[1])
    level = F.col("weight") * F.lit(float(share[0])) / F.lit(float(share[1] or 1))
    return ranked.withColumn("target", F.when(level > limit, limit.cast("double")).otherwise(level) if share[1] else limit.cast("double"))


def with_source(left: DataFrame, right: DataFrame, how: str = "inner") -> DataFrame:
    """A join by source in which null is a source."""
    right = right.withColumnRenamed("source", "source_")
    return left.join(right, left.source.eqNullSafe(right.source_), how).drop("source_")


def copy_levels(base: DataFrame, targets: DataFrame, cap: int = 3) -> DataFrame:
    """targets with `level`: a document of propensity g is expected least(cap, level * g) times, so that the expected
    words of each source are its target; null where all of a source's documents stand at the cap.

    Of each source, the words are summed up by propensity. From the largest propensity down, those that the level
    would lift above the cap are set to it, until the rest of the target, dealt by g, lifts none above.
    """
    words = base.groupBy("source", "g").agg(F.sum("size").alias("words"))
    down = Window.partitionBy("source").orderBy(F.desc("g"))
    above = F.coalesce(F.sum("words").over(down.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    weighed = F.sum(F.col("words") * F.col("g")).over(down.rowsBetween(0, Window.unboundedFollowing))
    steps = with_source(words, small(targets, 64)).withColumn("above", above).withColumn("weighed", weighed)
    steps = steps.withColumn("level", F.when(F.col("weighed") > 0, (F.col("target") - F.col("above") * cap) / F.col("weighed").cast("double")))
    levels = steps.where(F.col("level") * F.col("g") <= cap).groupBy("source").agg(F.max_by("level", "g").alias("level"))
    return staged(with_source(targets, levels, "left"))


def pareto_mix(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), cap: int = 3, propensity: Column | None = None, seed: int | None = None) -> DataFrame:
    """doc_id, source, size, source_size, target, copies, taken, and `row`, which tells rows apart.

    Each document has least(cap, level * g) expected copies, where g is its propensity and the level makes its source's
    expected words the target. The whole part is certain; the rest is its inclusion probability p, and documents are
    ranked by (u / (1 - u)) / (p / (1 - p)), u a number drawn from doc_id (and `seed`): Pareto order sampling, of a size
    fixed in words. Of each source the first documents that fit the words still wanted get one copy more; then, up to
    three times, one more document whose size comes nearest to what is left, if that helps. `propensity` is a positive whole number of each
    document (a column of docs or of `size`, its words); by default the bits of its size, so longer documents are
    likelier, in the measure of the logarithm.

    Null text or no word: size 0, never taken. Null source: a source of its own, the last. Null or repeated doc_id: such
    rows share u and are ranked by size, then by an arbitrary number kept for the run. Very long texts count whole; one
    longer than what its source still wants is passed over. Empty table: no rows. Further columns are not read.
    """
    g = F.length(F.bin("size")) if propensity is None else propensity
    size = F.coalesce(F.size(F.regexp_extract_all("text", F.lit(WORD), F.lit(0))), F.lit(0)).cast("long")
    sized = docs.withColumn("size", F.greatest(size, F.lit(0))).select("doc_id", "source", "size", F.greatest(F.coalesce(g.cast("long"), F.lit(1)), F.lit(1)).alias("g"))
    base = staged(sized.withColumn("row", F.monotonically_increasing_id()))
    targets = copy_levels(base, staged(source_targets(base, weights, cap)), cap)

    expected = F.when(F.col("source_size") > 0, F.coalesce(F.least(F.col("level") * F.col("g"), F.lit(float(cap))), F.lit(float(cap)))).otherwise(F.lit(0.0))
    u = uniform(F.col("doc_id")) if seed is None else uniform(F.col("doc_id"), F.lit(seed))
    odds = (u / (1 - u)) / (F.col("p") / (1 - F.col("p")))
    ranked = with_source(base, small(targets, 64)).withColumn("expected", expected).withColumn("copies", F.floor("expected")).withColumn("p", F.col("expected") - F.col("copies"))
    ranked = staged(ranked.withColumn("q", F.when((F.col("p") > 0) & (F.col("size") > 0), odds / (1 + odds))).withColumn("bucket", F.floor(F.col("q") * BUCKETS)).drop("expected", "g", "level", "p"))

    certain = ranked.groupBy("source").agg((F.first("target") - F.sum(F.col("copies") * F.col("size"))).alias("wanted"))
    steps = ranked.where("q IS NOT NULL").groupBy("source", "bucket").agg(F.sum("size").alias("words"))
    upto = F.sum("words").over(Window.partitionBy("source").orderBy("bucket"))
    edge = with_source(steps.withColumn("upto", upto), certain).where(F.col("upto") > F.col("wanted"))
    edge = edge.groupBy("source").agg(F.min("bucket").alias("edge"), F.min_by(F.col("upto") - F.col("words"), "bucket").alias("filled"))
    plan = staged(with_source(certain, edge, "left"))

    at = with_source(ranked, small(plan, 48))
    inside = F.coalesce(F.col("edge"), F.lit(BUCKETS + 1))
    order = Window.partitionBy("source").orderBy("q", "doc_id", "size", "row").rowsBetween(Window.unboundedPreceding, 0)
    kept = [c for c in ranked.columns if c != "bucket"]
    far = at.where(F.col("q").isNull() | (F.col("bucket") != inside)).select(*kept, F.coalesce(F.col("bucket") < inside, F.lit(False)).alias("more"), "wanted")
    near = at.where(F.col("bucket") == F.col("edge")).withColumn("upto", F.sum("size").over(order) + F.col("filled")).select(*kept, (F.col("upto") <= F.col("wanted")).alias("more"), "wanted")
    drawn = staged(far.unionByName(near))

    for _ in range(LAST):
        gap = drawn.groupBy("source").agg((F.first("wanted") - F.sum(F.when(F.col("more"), F.col("size")).otherwise(0))).alias("gap"))
        spare = with_source(drawn.where(~F.col("more") & F.col("q").isNotNull() & (F.col("copies") < cap)), small(staged(gap), 32))
        spare = spare.where(F.abs(F.col("size") - F.col("gap")) < F.col("gap"))
        nearest = F.min(F.struct(F.abs(F.col("size") - F.col("gap")).alias("off"), "q", "doc_id", "row")).alias("s")
        last = spare.groupBy("source").agg(nearest).select(F.col("s.row").alias("row"), F.lit(True).alias("last"))
        drawn = staged(drawn.join(small(staged(last), 16), "row", "left").withColumn("more", F.col("more") | F.coalesce("last", F.lit(False))).drop("last"))
    out = drawn.withColumn("copies", (F.col("copies") + F.col("more").cast("int")).cast("long"))
    return out.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"), "row")


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mixed corpus itself: each document as often as it is taken, with the columns of docs.

    A document without words stays once: it takes no words from any target. Rows of one doc_id share their copies
    (the most that any of them got).
    """
    taken = pareto_mix(docs, **options).groupBy("doc_id", "size").agg(F.max("copies").alias("copies"))
    taken = taken.select(F.col("doc_id").alias("id_"), F.col("size").alias("size_"), F.when(F.col("size") > 0, F.col("copies")).otherwise(1).cast("int").alias("copies"))
    size = F.greatest(F.coalesce(F.size(F.regexp_extract_all("text", F.lit(WORD), F.lit(0))), F.lit(0)), F.lit(0)).cast("long")
    rows = packed(docs, F.col("doc_id").alias("id"), size.alias("size"))
    joined = rows.join(taken, F.col("id").eqNullSafe(F.col("id_")) & (F.col("size") == F.col("size_"))).where("copies > 0")
    return joined.select("doc", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy")).select(*unpacked(docs.columns))


def op7_pareto_mix(spark, sf_dir: str) -> DataFrame:
    """doc_id, size, source_size, target, taken of all documents, each likelier by the bits of its size. See pareto_mix."""
    return pareto_mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


OP7_SQL = rf"""
WITH d AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '{WORD}')), 0) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS r FROM d GROUP BY source),
w AS (SELECT source, source_size, [5, 2, 1][1 + r % 3] AS weight FROM s),
o AS (SELECT *, sum(source_size) OVER () AS total, sum(weight) OVER () AS free,
        coalesce(sum(3 * source_size) OVER a, 0) AS cut, coalesce(sum(weight) OVER a, 0) AS cut_weight
      FROM w WINDOW a AS (ORDER BY 3 * source_size / weight, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT *, weight * CAST(total - cut AS DOUBLE) / CAST(free - cut_weight AS DOUBLE) <= 3 * source_size AS ends FROM o),
l AS (SELECT CAST(total - cut AS DOUBLE) AS a, CAST(free - cut_weight AS DOUBLE) AS b FROM f WHERE ends ORDER BY cut, cut_weight LIMIT 1),
t AS (SELECT source, source_size, CASE WHEN weight * a / b > 3 * source_size THEN CAST(3 * source_size AS DOUBLE) ELSE weight * a / b END AS target FROM w, l),
b AS (SELECT *, length(bin(size)) AS g FROM d),
x AS (SELECT source, g, sum(size) AS words FROM b GROUP BY source, g),
y AS (SELECT source, g, coalesce(sum(words) OVER (PARTITION BY source ORDER BY g DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS above,
        sum(words * g) OVER (PARTITION BY source ORDER BY g DESC ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weighed FROM x),
z AS (SELECT y.source, y.g, CASE WHEN weighed > 0 THEN (target - CAST(above * 3 AS DOUBLE)) / CAST(weighed AS DOUBLE) END AS level FROM y JOIN t ON y.source IS NOT DISTINCT FROM t.source),
v AS (SELECT source, arg_max(level, g) AS level FROM z WHERE level * g <= 3 GROUP BY source),
r AS (SELECT b.*, level FROM b LEFT JOIN v ON b.source IS NOT DISTINCT FROM v.source),
e AS (SELECT d.doc_id, d.source, size, source_size, target, CASE WHEN source_size > 0 THEN coalesce(least(level * g, 3.0::DOUBLE), 3.0::DOUBLE) ELSE 0 END AS expected,
        (CAST(CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '~')), 1, 13) AS UBIGINT) AS DOUBLE) + 0.5) / 4503599627370496.0::DOUBLE AS u
      FROM r AS d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
p AS (SELECT *, CAST(floor(expected) AS BIGINT) AS copies, expected - floor(expected) AS p FROM e),
q AS (SELECT *, CASE WHEN p > 0 AND size > 0 THEN (u / (1 - u)) / (p / (1 - p)) END AS odds FROM p),
k AS (SELECT *, odds / (1 + odds) AS q, target - sum(copies * size) OVER (PARTITION BY source) AS wanted FROM q),
m0 AS (SELECT *, q IS NOT NULL AND sum(CASE WHEN q IS NULL THEN 0 ELSE size END) OVER (PARTITION BY source ORDER BY q NULLS LAST, doc_id, size ROWS UNBOUNDED PRECEDING) <= wanted AS more FROM k),
@LAST@
SELECT doc_id, size, source_size, target, size * (copies + CASE WHEN more THEN 1 ELSE 0 END) AS taken FROM m3
"""
_PICK = "CASE WHEN NOT more AND q IS NOT NULL AND copies < 3 AND abs(size - gap) < gap THEN 0 ELSE 1 END"
_ROUND = f"""
g@ AS (SELECT *, wanted - sum(CASE WHEN more THEN size ELSE 0 END) OVER (PARTITION BY source) AS gap FROM m#),
n@ AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY {_PICK}, abs(size - gap), q, doc_id) AS rn FROM g@),
m@ AS (SELECT * EXCLUDE (more, gap, rn), more OR (rn = 1 AND {_PICK} = 0) AS more FROM n@)"""
OP7_SQL = OP7_SQL.replace("@LAST@", ",".join(_ROUND.replace("@", str(i + 1)).replace("#", str(i)) for i in range(LAST)))
