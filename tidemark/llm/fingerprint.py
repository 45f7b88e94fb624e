"""Document fingerprints by consistent weighted sampling."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import let, small, staged, table, words_of

BINS = 128
SHINGLE = 5


def _shingles(text: Column, n: int) -> Column:
    """The sorted hashes of all n-word shingles. A text of fewer words is one shingle; one without words has none."""

    def of(h: Column) -> Column:
        parts = lambda i: [F.get(h, i + k) for k in range(n)]
        return F.when(F.size(h) > 0, F.transform(F.sequence(F.lit(0), F.greatest(F.size(h) - n, F.lit(0))), lambda i: F.xxhash64(*parts(i)))).otherwise(F.array().cast("array<bigint>"))

    return let(F.transform(words_of(text), lambda w: F.xxhash64(w)), lambda h: F.sort_array(of(h)))


def _runs(s: Column, body) -> Column:
    """body(value, count) for each run of equal values of a sorted array."""
    starts = F.filter(F.transform(s, lambda h, i: F.when(i == 0, i).when(h != F.get(s, i - 1), i)), lambda i: i.isNotNull())
    return let(starts, lambda p: F.transform(p, lambda i, j: body(F.get(s, i), F.coalesce(F.get(p, j + 1), F.size(s)) - i)))


def signature(text: Column, bins: int = BINS, n: int = SHINGLE) -> Column:
    """The fingerprint of a whole text (null: as an empty one): for each bin the 24-bit name of its sample, -1 for a
    bin without a term. Equal texts have equal fingerprints.

    Each occurrence of a shingle is dealt to a bin by the shingle's hash and the occurrence's number, so two texts that
    hold a shingle deal as many occurrences alike as the lesser of them holds, and a bin holds a shingle with a weight w,
    the number of its occurrences there. A bin keeps one consistent weighted sample: with r and c drawn from Gamma(2, 1)
    and b from (0, 1) by the hash of (shingle, bin), t = floor(ln w / r + b) and ln a = ln c - r (t - b) - r; the least
    a is the bin's sample. It is the same (shingle, t) in two texts as often as their weights in the bin are alike, so
    the share of bins on which texts agree estimates their generalised Jaccard similarity, also where bins hold little.
    a differs for each (shingle, t), so it names the sample. (One draw a shingle and bin it lies in, not one for each bin.)
    """
    part = lambda x, at: F.shiftrightunsigned(x, at).bitwiseAND(0xFFFFFF) + F.lit(0.5)  # noqa: E731  24 random bits
    gamma = lambda x, p, q: F.lit(48 * math.log(2)) - F.ln(part(x, p) * part(x, q))  # noqa: E731  -ln(u v) of two uniforms

    def number(home: Column, x: Column, w: Column | None) -> Column:
        """One number for a shingle in a bin: the bin, and within it the order of ln a (well between -100 and 28)."""
        y = F.xxhash64(x)
        b = F.shiftrightunsigned(y, 48) / F.lit(float(1 << 16))
        r = gamma(x, 8, 32)
        log_a = F.ln(gamma(y, 0, 24)) + r * (b - 1)
        log_a = log_a if w is None else log_a - r * F.floor(F.ln(w) / r + b)
        return home * 128 + F.greatest(log_a + 100, F.lit(0.0))

    def once(h: Column) -> Column:
        return number(F.pmod(h, F.lit(bins)), h, None)

    def often(h: Column, n: Column) -> Column:
        """A shingle of n occurrences: the first goes to the bin of its hash, each later one to that of its number too."""
        homes = F.sort_array(F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.pmod(F.when(k == 0, h).otherwise(F.xxhash64(h, k)), F.lit(bins))))
        return let(homes, lambda bs: _runs(bs, lambda home, w: number(home, F.when(home == F.pmod(h, F.lit(bins)), h).otherwise(F.xxhash64(h, home)), w)))

    def keys(s: Column) -> Column:
        return F.sort_array(F.when(F.size(F.array_distinct(s)) == F.size(s), F.transform(s, once)).otherwise(F.flatten(_runs(s, often))))

    bin_of = lambda x: F.floor(x / 128)
    firsts = let(let(_shingles(text, n), keys), lambda s: F.filter(s, lambda x, i: (i == 0) | (bin_of(x) != bin_of(F.get(s, i - 1)))))
    blank = lambda k: F.array_repeat(F.lit(-1), k.cast("int"))
    name = lambda x: F.xxhash64(x).bitwiseAND(0xFFFFFF).cast("int")

    def spread(s: Column) -> Column:
        before = lambda i: F.coalesce(bin_of(F.get(s, i - 1)), F.lit(-1))
        filled = F.flatten(F.transform(s, lambda x, i: F.concat(blank(bin_of(x) - before(i) - 1), F.array(name(x)))))
        return F.concat(filled, blank(F.lit(bins - 1) - before(F.size(s))))

    return let(firsts, spread)


def fingerprint_text(found: Column) -> Column:
    """A fingerprint as text: six hexadecimal digits a bin, `------` for a bin without a sample."""
    return F.array_join(F.transform(found, lambda x: F.when(x < 0, F.lit("------")).otherwise(F.lpad(F.lower(F.hex(x)), 6, "0"))), "")


def likeness(a: Column, b: Column) -> Column:
    """The share of bins on which two fingerprints agree, of the bins where either has a sample; 1 if both have none."""
    used = F.size(F.filter(F.zip_with(a, b, lambda x, y: F.greatest(x, y)), lambda x: x >= 0))
    same = F.size(F.filter(F.zip_with(a, b, lambda x, y: (x == y) & (x >= 0)), lambda x: x))
    return F.when(used == 0, F.lit(1.0)).otherwise(same.cast("double") / used)


def _range_of(key: Column, cuts: list[int]) -> Column:
    """How many of the sorted cuts lie below a key: counted among every k-th cut, then in one stretch between two."""
    if not cuts:
        return F.lit(0)
    k = max(1, round(len(cuts) ** 0.5))
    coarse, stretches = cuts[::k], [[0][:0], *(cuts[i + 1 : i + k] for i in range(0, len(cuts), k))]
    longs = lambda xs: F.array(*[F.lit(x).cast("long") for x in xs]).cast("array<bigint>")
    below = lambda xs: F.size(F.filter(xs, lambda c: c < key))
    return let(below(longs(coarse)), lambda i: F.when(i == 0, F.lit(0)).otherwise((i - 1) * k + 1 + below(F.get(F.array(*map(longs, stretches)), i))))


def with_next(docs: DataFrame) -> DataFrame:
    """doc_id, text, found (its fingerprint) and next_text, next_found: those of the next document in descending
    doc_id; after the last comes the first.

    No window runs over the whole table. Ids are cut into ranges of about equal count (the bounds come from Spark's
    quantile sketch); each range is one window, and the one document at the end of each range gets the first document
    of the next range that has any. Null texts are empty; null ids come last; rows of one doc_id follow each other, by
    text. The texts are shuffled once.
    """
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions")) * 2
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    cuts = sorted({int(x) for x in base.select(F.percentile_approx("doc_id", [(i + 1) / n for i in range(n - 1)], 100 * n)).first()[0] or []})
    part = F.when(F.col("doc_id").isNull(), F.lit(-1)).otherwise(_range_of(F.col("doc_id"), cuts)).cast("int")
    ranged = base.withColumn("part", part)

    tops = staged(ranged.groupBy("part").agg(F.max("doc_id").alias("top")))  # n rows
    heads = ranged.join(F.broadcast(tops.withColumnRenamed("part", "of")), (F.col("part") == F.col("of")) & F.col("doc_id").eqNullSafe(F.col("top")), "left_semi")
    heads = staged(heads.groupBy("part").agg(F.min("text").alias("head_text")))  # one text for each of the n ranges
    found = sorted(r[0] for r in tops.select("part").collect())
    links = spark.createDataFrame([(p, found[i - 1]) for i, p in enumerate(found)], "of int, follow int")  # the lowest range is followed by the highest
    first = heads.join(F.broadcast(links), F.col("part") == F.col("follow")).select("of", "head_text", signature(F.col("head_text")).alias("head_found"))

    order = Window.partitionBy("part").orderBy(F.desc_nulls_last("doc_id"), "text")
    led = ranged.withColumn("found", signature(F.col("text"))).withColumn("next", F.lead(F.struct("text", "found")).over(order))
    heads_ = small(staged(first), F.octet_length("head_text") + F.lit(64 + 4 * BINS))
    joined = led.join(heads_, F.when(F.col("next").isNull(), F.col("part")) == F.col("of"), "left")
    return joined.select("doc_id", "text", "found", F.coalesce("next.text", "head_text").alias("next_text"), F.coalesce("next.found", "head_found").alias("next_found"))


def edited(text: Column, other: Column) -> Column:
    """The text with its last third (whole code points) replaced by as many first code points of another, or all of them."""
    third = F.floor(F.length(text) / 3).cast("int")
    return F.concat(F.substr(text, F.lit(1), F.length(text) - third), F.substr(other, F.lit(1), third))


def op1_weighted_fingerprints(spark, sf_dir: str) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of all documents.

    Null text: as an empty one, whose fingerprint has no sample; two of those have likeness 1. Rows of one doc_id follow
    each other by text, null ids come last; a single document is its own next. Texts of any length count whole. Empty
    table: no rows. Further columns are not read.
    """
    chained = with_next(table(spark, sf_dir, "documents")).withColumn("edit", edited(F.col("text"), F.col("next_text")))
    told = chained.select("doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2(F.encode("edit", "UTF-8"), 256).alias("edited_sha256"), "found", "next_found", signature(F.col("edit")).alias("edit_found"))
    return told.select(
        "doc_id", "n_chars", "edited_sha256", fingerprint_text(F.col("found")).alias("fingerprint"), fingerprint_text(F.col("edit_found")).alias("edited_fingerprint"),
        likeness(F.col("found"), F.col("edit_found")).alias("near_edited"), likeness(F.col("found"), F.col("next_found")).alias("near_next"),
    )
