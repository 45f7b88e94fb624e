"""Line-first quality rules: clean line by line, then reject documents that lose too much."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, let, table, words_of

# Phrases of license, cookie and site boilerplate, matched in the lower-cased line.
BOILERPLATE = r"all rights reserved|licensed under|spdx-license-identifier|copyright \(c\)|terms of (use|service)|privacy policy|accept (all )?cookies|use(s)? cookies|enable javascript|subscribe to|sign up for|click here|powered by"
SYMBOL = r"[#*$%&|<>]"
SEPARATOR = r"[|»›·]"
ENDING = "[.!?:;…\"'”’)\\]][\\x20\\x09-\\x0D]*$"


def repeated_window_words(words: Column, width: int = 8) -> Column:
    """How many words lie in a window of `width` words that occurs at least twice in the text.

    Windows are compared by a 64-bit hash of the hashes of their words. Only texts with a repeated window pay for
    more than the hashes: their (hash, position) pairs are sorted and the covered positions summed up.
    """

    def windows(h: Column) -> Column:
        parts = lambda i: [F.get(h, i + k) for k in range(width)]
        return F.when(F.size(h) >= width, F.transform(F.sequence(F.lit(0), F.size(h) - width), lambda i: F.xxhash64(*parts(i.cast("int")))))

    def covered(w: Column) -> Column:
        pairs = F.array_sort(F.transform(w, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        same = lambda s, x, j: F.coalesce(F.get(s, j)["h"] == x["h"], F.lit(False))
        hits = let(pairs, lambda s: F.filter(s, lambda x, j: same(s, x, j - 1) | same(s, x, j + 1)))
        places = F.array_sort(F.transform(hits, lambda x: x["i"]))
        steps = let(places, lambda p: F.transform(p, lambda x, j: F.least(F.lit(width), F.coalesce(F.get(p, j + 1) - x, F.lit(width)))))
        return F.aggregate(steps, F.lit(0), lambda a, b: a + b)

    hashes = F.transform(words, lambda w: F.xxhash64(w))
    return let(let(hashes, windows), lambda w: F.when(w.isNull() | (F.size(F.array_distinct(w)) == F.size(w)), F.lit(0)).otherwise(covered(w)))


def line_verdict(line: Column) -> Column:
    """The first rule that a line breaks, or null: `symbols`, `navigation`, `boilerplate`, `punctuation`."""
    n = F.regexp_count(line, F.lit(WORD))
    return (
        F.when(F.regexp_count(line, F.lit(SYMBOL)) * 10 > F.length(F.trim(line)), F.lit("symbols"))
        .when((F.regexp_count(line, F.lit(SEPARATOR)) >= 3) & (F.regexp_count(line, F.lit(SEPARATOR)) * 4 >= n), F.lit("navigation"))
        .when(F.lower(line).rlike(BOILERPLATE), F.lit("boilerplate"))
        .when((n < 3) & ~line.rlike(ENDING), F.lit("punctuation"))
    )


def line_first_quality(docs: DataFrame, min_words: int = 20, max_repeat_pct: int = 30, max_lost_pct: int = 50, extra: list[str] | None = None) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, lost_words, clean_text.

    Every \\n-split line with a word is judged alone; lines that break a rule go. A document is rejected if the base
    tests fail (too few words, too many in repeated windows) or if its failed lines held more than `max_lost_pct`
    percent of its words. Null and empty texts have no words and fail. All of it is one projection over the scan:
    no shuffle, and memory bounded by the longest text. Rows are never joined, so repeated or null ids don't matter.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD))
    read = docs.select("doc_id", *(extra or []), text.alias("text"), words_of(text).alias("w"), lines.alias("lines"))
    failed = F.filter("lines", lambda x: line_verdict(x).isNotNull())
    told = read.select(
        "doc_id",
        *(extra or []),
        F.size("w").cast("long").alias("n_words"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit(SYMBOL)).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        repeated_window_words(F.col("w")).cast("long").alias("n_repeat_words"),
        F.coalesce(F.regexp_count(F.array_join(failed, "\n"), F.lit(WORD)), F.lit(0)).cast("long").alias("lost_words"),
        F.array_join(F.filter("lines", lambda x: line_verdict(x).isNull()), "\n").alias("clean_text"),
    )
    base = (F.col("n_words") < min_words) | (F.col("n_repeat_words") * 100 > F.col("n_words") * max_repeat_pct)
    return told.withColumn("base_failed", base).withColumn("kept", ~F.col("base_failed") & (F.col("lost_words") * 100 <= F.col("n_words") * max_lost_pct))


def op10_line_first_quality(spark, sf_dir: str) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, lost_words of all documents.

    Null or empty text: no words, base_failed. Each row is judged alone, so repeated rows and null ids get equal results.
    Texts of any length count whole; limits that are met exactly pass. Empty table: no rows. Further columns are not read.
    """
    out = line_first_quality(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "lost_words")


_ENDING_SQL = ENDING.replace("'", "''")
OP10_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{WORD}') AS w FROM documents),
l AS (SELECT r, unnest(string_split(text, chr(10))) AS line FROM d),
v AS (SELECT r, line, len(regexp_extract_all(line, '{WORD}')) AS n,
        len(regexp_extract_all(line, '{SYMBOL}')) AS sy, len(regexp_extract_all(line, '{SEPARATOR}')) AS se FROM l WHERE regexp_matches(line, '{WORD}')),
f AS (SELECT r, count(*) - count(DISTINCT line) AS n_dup_lines,
        coalesce(sum(CASE WHEN sy * 10 > length(trim(line, ' ')) OR (se >= 3 AND se * 4 >= n) OR regexp_matches(lower(line), '{BOILERPLATE}')
          OR (n < 3 AND NOT regexp_matches(line, '{_ENDING_SQL}')) THEN n ELSE 0 END), 0) AS lost_words FROM v GROUP BY r),
p AS (SELECT r, w, unnest(range(1, len(w) - 6)) AS i FROM d WHERE len(w) >= 8),
g AS (SELECT r, i, count(*) OVER (PARTITION BY r, array_to_string(w[i:i + 7], ' ')) AS c FROM p),
h AS (SELECT r, least(8, coalesce(lead(i) OVER (PARTITION BY r ORDER BY i) - i, 8)) AS s FROM g WHERE c > 1),
k AS (SELECT r, sum(s) AS n_repeat_words FROM h GROUP BY r),
a AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
        CAST(len(regexp_extract_all(text, '{SYMBOL}')) AS BIGINT) AS n_symbols, CAST(coalesce(n_dup_lines, 0) AS BIGINT) AS n_dup_lines,
        CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words, CAST(coalesce(lost_words, 0) AS BIGINT) AS lost_words
      FROM d LEFT JOIN f USING (r) LEFT JOIN k USING (r)),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM a)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND lost_words * 100 <= n_words * 50 AS kept, lost_words FROM b
"""
