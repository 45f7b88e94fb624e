"""Pattern tables of any size against names: equi-joins by suffix, by gram and by required literal."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce
from itertools import chain

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import checkpointed

#: Letters a gram of the index of names.
GRAM = 4
#: So many regexes without a required literal are tried in one pass over the names.
AT_A_TIME = 50


def java_pattern(pattern: str) -> str:
    """A user's Python regex for Java: named groups, Unicode classes and case. Invalid ones fail here, before any plan."""
    re.compile(pattern)
    return "(?iU)" + pattern.replace("(?P<", "(?<")


def folded(text: Column) -> Column:
    """Text in which letters that a regex without regard to case takes for equal are equal: as capitals, then small ones
    (the empty text between keeps Spark from leaving the first step out), with one form of a sigma."""
    return F.translate(F.lower(F.concat(F.upper(text), F.lit(""))), "ς", "σ")


def required_literal(pattern: str) -> str | None:
    """The longest run of letters that every match of a regex holds, or None. Only what stands in sequence, in a group or
    in a repeat of once or more is required; alternatives, options, classes and look-arounds are not."""
    runs, run = [], []

    def end() -> None:
        if run:
            runs.append("".join(run))
            run.clear()

    def walk(nodes) -> None:
        for op, arg in nodes:
            name = str(op)
            if name == "LITERAL":
                run.append(chr(arg))
                continue
            if name == "SUBPATTERN":
                walk(arg[-1])
                continue
            end()
            if name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT") and arg[0] >= 1:
                walk(arg[2])
                end()
            elif name == "ATOMIC_GROUP":
                walk(arg)
                end()

    walk(re._parser.parse(pattern, re.IGNORECASE))
    end()
    return max(runs, key=len) if runs else None


@F.pandas_udf(T.StringType())
def _required(patterns: pd.Series) -> pd.Series:
    return patterns.map(lambda p: None if p is None else required_literal(p))


@F.pandas_udf(T.StringType())
def _java(patterns: pd.Series) -> pd.Series:
    return patterns.map(lambda p: None if p is None else java_pattern(p))


def _lengths(found: DataFrame, text: str) -> list[int]:
    """The distinct lengths of a column: numbers, not rows, and no more of them than the longest text has letters."""
    return sorted(r[0] for r in found.select(F.length(text)).distinct().collect())


def _cut(text: Column, lengths: list[int], part: Callable[[Column, Column], Column]) -> Column:
    return F.transform(F.filter(F.array(*[F.lit(n) for n in lengths]), lambda n: n <= F.length(text)), lambda n: part(text, n))


def _by_suffix(names: DataFrame, patterns: DataFrame) -> DataFrame:
    """names (name, low) that end in a row of patterns (low): a semi join by suffix, of the lengths that occur."""
    lengths = _lengths(patterns, "low")
    if not lengths:
        return names.select("name").limit(0)
    ends = names.select("name", F.explode(_cut(F.col("low"), lengths, lambda t, n: F.substr(t, F.length(t) - n + 1, n))).alias("end"))
    return ends.join(patterns.select(F.col("low").alias("end")).distinct(), "end", "left_semi").select("name")


def _by_gram(names: DataFrame, patterns: DataFrame, text: str, keep: Callable[[DataFrame], DataFrame], gram: int = GRAM) -> DataFrame:
    """name and the columns of patterns for each pair in which names' `text` holds patterns' `part`, after `keep`.

    Each pattern is looked up by one of its grams: of `gram` letters, the one that the fewest names hold; or the whole
    pattern if it is shorter. Names are cut into distinct grams of the lengths that occur. The pairs that meet are those of
    a pattern's rarest gram, and are checked; a gram that many names share is split by Spark where it is skewed.
    """
    patterns = patterns.withColumn("size", F.least(F.length("part"), F.lit(gram)))
    lengths = sorted(r[0] for r in patterns.select("size").distinct().collect())  # gram + 1 at most
    if not lengths:
        return names.select("name").limit(0)

    def grams(t: Column, n: Column) -> Column:
        return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(t) - n + 1), lambda i: F.substr(t, i, n)))

    cut = checkpointed(names.select("name", text, F.explode(F.array_distinct(F.flatten(_cut(F.col(text), lengths, grams)))).alias("key")))
    often = cut.groupBy("key").agg(F.count("*").alias("n"))
    each = patterns.select("*", F.explode(grams(F.col("part"), F.col("size"))).alias("key"))
    rows = [c for c in patterns.columns if c != "size"]
    rarest = each.join(often, "key").groupBy(*rows).agg(F.min(F.struct("n", "key"))["key"].alias("key"), F.count("*").alias("met"), F.any_value("size").alias("size"))
    # a pattern whose grams are not all in the names is in none of them
    whole = rarest.where(F.col("met") == F.size(grams(F.col("part"), F.col("size")))).select(*rows, "key")
    return keep(cut.join(whole, "key").where(F.contains(F.col(text), F.col("part")))).select("name")


def match_patterns(files: DataFrame, patterns: DataFrame, name: Column, gram: int = GRAM) -> DataFrame:
    """files whose name holds any row of patterns (kind: suffix, substring or regex; pattern), without regard to case.

    Neither table is bounded or broadcast. Distinct names are matched, so files are moved once, for the last semi join.
    Suffixes meet by text and length; substrings by their rarest gram; a regex by the rarest gram of a literal that all its
    matches hold, and is then run on those names alone. Regexes without such a literal are run over all names, AT_A_TIME
    in a pass. An empty suffix, substring or regex matches every name; null names and patterns match nothing, nor do other
    kinds; invalid regexes fail.
    """
    held = files.withColumn("_name", name)
    names = held.select(F.col("_name").alias("name")).where("name IS NOT NULL").distinct()
    names = checkpointed(names.select("name", F.lower("name").alias("low"), folded(F.col("name")).alias("fold")))
    wanted = checkpointed(patterns.where("pattern IS NOT NULL").select("kind", "pattern").distinct().withColumn("low", F.lower("pattern")))
    suffixes, texts = wanted.where("kind = 'suffix'"), wanted.where("kind = 'substring'")
    regexes = checkpointed(wanted.where("kind = 'regex'").select(_java("pattern").alias("java"), folded(_required("pattern")).alias("part")))
    found = [_by_suffix(names, suffixes), _by_gram(names, texts.select(F.col("low").alias("part")).distinct(), "low", lambda df: df, gram)]
    found.append(_by_gram(names, regexes.where("part IS NOT NULL"), "fold", lambda df: df.where(F.rlike(F.col("name"), F.col("java"))), gram))
    some: list[str] = []
    loose = regexes.where("part IS NULL").select("java").toLocalIterator()  # a partition at a time
    for row in chain(loose, [None]):
        if row is not None:
            some.append(row.java)
        if some and (row is None or len(some) == AT_A_TIME):
            found.append(checkpointed(names.where(reduce(lambda a, b: a | b, [F.col("name").rlike(p) for p in some])).select("name")))
            some = []
    matched = checkpointed(reduce(lambda a, b: a.union(b), found).distinct().select(F.col("name").alias("_name")))
    return held.join(matched, "_name", "left_semi").drop("_name")
