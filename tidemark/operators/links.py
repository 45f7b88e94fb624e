"""Links of stored pages: extraction, resolution, scope, link graph; file filters and directory exclusions."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import urls as U
from ..functions.anchors import all_anchors
from .patterns import java_pattern, match_patterns  # noqa: F401

BIG_PAGE = 1 << 20
_SKIPPED = "^(#|javascript:|mailto:)"


def hrefs(html: Column) -> Column:
    """All double-quoted, then all single-quoted href values; empty, #, javascript: and mailto: ones dropped."""
    both = F.concat(F.regexp_extract_all(html, F.lit('href="([^"]*)"'), F.lit(1)), F.regexp_extract_all(html, F.lit("href='([^']*)'"), F.lit(1)))
    return F.filter(both, lambda h: (h != "") & ~h.rlike(_SKIPPED))


def anchor_hrefs(html: Column) -> Column:
    """The href of <a> elements only, as a document tree gives them: decoded, without those in comments and scripts."""
    return F.filter(all_anchors(html), lambda h: (h != "") & ~h.rlike(_SKIPPED))


def extract_links(pages: DataFrame, mode: str = "fast", *keep: str) -> DataFrame:
    """url, pos, href, and the columns `keep` of pages. mode: `fast`, `anchor`, or `auto`, which takes anchors for pages up
    to 1 MiB."""
    found = {"fast": hrefs, "anchor": anchor_hrefs}
    links = found[mode](F.col("html")) if mode in found else F.when(F.octet_length("html") > BIG_PAGE, hrefs(F.col("html"))).otherwise(anchor_hrefs(F.col("html")))
    return pages.select("url", *keep, F.posexplode(links).alias("pos", "href"))


def _resolved(pages: DataFrame, mode: str) -> DataFrame:
    """url, base, pos, href, child_url: the page's URL is split once a page, before its links are dealt out."""
    links = extract_links(pages.withColumn("_base", U.page_base(F.col("url"))), mode, "_base")
    links = links.where(~F.col("href").isin("../", "./") & ~F.col("href").startswith("?"))
    return links.withColumn("child_url", U.resolve_link(F.col("_base"), F.col("href")))


def page_links(pages: DataFrame, mode: str = "fast") -> DataFrame:
    """url, pos, href, child_url, is_dir: navigation links skipped, the rest resolved."""
    return _resolved(pages, mode).withColumn("is_dir", U.is_directory(F.col("child_url"))).drop("_base")


def in_base_scope(url: Column, base: Column) -> Column:
    """http(s), the base's site, and its path or below."""

    def inside(p: Column, b: Column) -> Column:
        top = F.rtrim(b[2], F.lit("/"))
        return F.lower(p[0]).isin("http", "https") & (p[1] == b[1]) & ((F.rtrim(p[2], F.lit("/")) == top) | p[2].startswith(F.concat(top, F.lit("/"))))

    return U.has_web_scheme(url) & U._split(url, lambda p: U._split(base, lambda b: inside(p, b)))


def link_graph(pages: DataFrame) -> DataFrame:
    """host, n_links, n_in_scope, n_targets, n_dangling: what the pages of each host link to."""
    links = _resolved(pages, "fast").select(F.col("_base.host").alias("host"), "child_url", in_base_scope(F.col("child_url"), F.concat("_base.site", F.lit("/"))).alias("inside"))
    known = pages.select(F.regexp_replace("url", r"[?#].*$", "").alias("known")).distinct()
    targets = links.groupBy("host", F.regexp_replace("child_url", r"[?#].*$", "").alias("target")).agg(F.count("*").alias("n"), F.count_if("inside").alias("inside"))
    joined = targets.join(known, F.col("target") == F.col("known"), "left")
    return joined.groupBy("host").agg(F.sum("n").alias("n_links"), F.sum("inside").alias("n_in_scope"), F.count("*").alias("n_targets"), F.count_if(F.col("known").isNull()).alias("n_dangling"))


def degrees(pages: DataFrame) -> DataFrame:
    """url, out_degree, in_degree over the stored pages' links."""
    links = page_links(pages).select("url", "child_url")
    ends = links.select(F.col("url"), F.lit(1).alias("o"), F.lit(0).alias("i")).union(links.select("child_url", F.lit(0), F.lit(1)))
    return ends.groupBy("url").agg(F.sum("o").alias("out_degree"), F.sum("i").alias("in_degree"))


def file_filter(name: Column, patterns: list[str]) -> Column:
    """Whether a filename matches any pattern: .suffix, regex, or substring, all without regard to case. No pattern: all."""

    def one(p: str) -> Column:
        if p.startswith("."):
            return F.lower(name).endswith(p.lower())
        if any(c in p for c in "*?+[]{}()|\\^$"):
            return name.rlike(java_pattern(p))
        return F.lower(name).contains(p.lower())

    return reduce(lambda a, b: a | b, map(one, patterns), F.lit(False)) & (name != "") if patterns else F.lit(True)


def match_files(files: DataFrame, patterns: list[str], url: str = "url") -> DataFrame:
    return files.where(file_filter(U.url_filename(F.col(url)), patterns))


def excluded_dir(url: Column, patterns: list[str]) -> Column:
    """Exact path or URL, path suffix (without a boundary), or a * glob that ends at a segment's end."""
    p, whole = F.rtrim(U.path(url), F.lit("/")), F.rtrim(url, F.lit("/"))

    def one(pattern: str) -> Column:
        bare = pattern.rstrip("/")
        hit = (whole == bare) | p.endswith(bare)
        return hit | p.rlike(re.escape(bare).replace(r"\*", ".*") + "(/|$)") if "*" in bare else hit

    return reduce(lambda a, b: a | b, map(one, patterns), F.lit(False))


def exclude_dirs(dirs: DataFrame, patterns: list[str], url: str = "dir_url") -> DataFrame:
    return dirs.where(~excluded_dir(F.col(url), patterns))


def throttled_name(domain: Column, known: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.lower(domain).contains(k) for k in known], F.lit(False))


def safe_hosts(dns: DataFrame) -> DataFrame:
    """host, ip (the first), from (host, pos, ip): hosts none of whose addresses is private."""
    per = dns.groupBy("host").agg(F.bool_or(U.is_private_ip(F.col("ip"))).alias("private"), F.min_by("ip", "pos").alias("ip"))
    return per.where("NOT private").select("host", "ip")
