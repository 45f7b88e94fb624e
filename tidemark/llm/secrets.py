"""Secret scans: candidate spans in whole texts, and how widely each candidate is owned across the corpus."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small, staged, table

# The base kinds in their listed order, their patterns, and the least length of what they hold.
KINDS = ("assign", "access", "hex")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")
_DUMMY = re.compile(r"example|sample|dummy|change_?me|placeholder|your[_-]|x{4,}|test|(.)\1{5,}|1234567|abcdef", re.IGNORECASE)


def base_spans(text: str) -> list[tuple[int, int, str, int]]:
    """(start, end, kind, start of the secret itself) of every base match, by start, then kind as listed."""
    found = [(m.start(), m.end(), 0, m.start(2)) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    found += [(m.start(), m.end(), 1, m.start()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(m.start(), m.end(), 2, m.start()) for m in _HEX.finditer(text)]  # a shorter run can't hold a longer one
    return [(s, e, KINDS[k], v) for s, e, k, v in sorted(found, key=lambda x: (x[0], x[2]))]


def looks_live(value: str) -> bool:
    """Random enough for a credential: no dummy word, and 2.5 bits or more a character."""
    if _DUMMY.search(value):
        return False
    n = len(value)
    return -sum(c / n * math.log2(c / n) for c in Counter(value).values()) >= 2.5


def scan(docs: DataFrame, owner: Column, repository: Column) -> DataFrame:
    """One row per document: doc_id, row, owner, repository, n_assign, n_access, n_hex, base, base_sha256 and candidates
    (hash, start, end, live of each distinct secret value's places). A null text has no span."""
    place = "struct<hash:binary,start:int,stop:int,live:boolean>"
    schema = f"doc_id long, row long, owner string, repository string, n_assign long, n_access long, n_hex long, base array<string>, base_sha256 string, candidates array<{place}>"
    arrow = pa.struct([("hash", pa.binary()), ("start", pa.int32()), ("stop", pa.int32()), ("live", pa.bool_())])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["n_assign", "n_access", "n_hex", "base", "base_sha256", "candidates"]
        types = [pa.int64()] * 3 + [pa.list_(pa.string()), pa.string(), pa.list_(arrow)]
        for batch in batches:
            out: list[tuple] = []
            for text in batch.column(4):
                text = text.as_py() or ""
                spans = base_spans(text)
                told = [f"{k}:{s}:{e}" for s, e, k, _ in spans]
                values = {(v, e): text[v:e] for _, e, _, v in spans}
                places = [{"hash": hashlib.sha256(x.encode()).digest()[:16], "start": v, "stop": e, "live": looks_live(x)} for (v, e), x in sorted(values.items())]
                n = Counter(k for _, _, k, _ in spans)
                out.append((n["assign"], n["access"], n["hex"], told, hashlib.sha256(",".join(told).encode()).hexdigest(), places))
            columns = [pa.array(list(c), t) for c, t in zip(zip(*out), types)] if out else [pa.array([], t) for t in types]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], *columns], ["doc_id", "row", "owner", "repository", *names])

    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("row"), owner.cast("string").alias("owner"), repository.cast("string").alias("repository"), "text")
    return read.mapInArrow(rows, schema)


def ownership(scanned: DataFrame) -> DataFrame:
    """hash, n_places, n_repositories, n_owners of every candidate value of the corpus.

    Three sums in a row, each combined before its shuffle: by repository, by owner, by value. A value that is copied
    into a third of all documents thus reaches each task once for each repository it lies in, and once for each owner.
    A null owner or repository counts as one more.
    """
    places = scanned.select("owner", "repository", F.explode("candidates.hash").alias("hash"))
    by_repository = places.groupBy("hash", "owner", "repository").agg(F.count("*").alias("n"))
    by_owner = by_repository.groupBy("hash", "owner").agg(F.sum("n").alias("n"), F.count("*").alias("repositories"))
    return by_owner.groupBy("hash").agg(F.sum("n").alias("n_places"), F.sum("repositories").alias("n_repositories"), F.count("*").alias("n_owners"))


def find_secrets(docs: DataFrame, owner: Column, repository: Column, max_owners: int = 1, max_repositories: int = 3) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_live, n_shared; one row per row of docs.

    A candidate value that at most `max_owners` owners hold in at most `max_repositories` repositories, and that looks
    random, adds a span `live` over the value itself; one held more widely is an example that was copied, and adds a
    span `shared`. Base spans stay. Order: by start, then assign, access, hex, live, shared.
    """
    scanned = staged(scan(docs, owner, repository))
    owned = staged(ownership(scanned))
    places = scanned.where(F.size("candidates") > 0).select("row", F.explode("candidates").alias("c")).select("row", "c.*")
    narrow = (F.col("n_owners") <= max_owners) & (F.col("n_repositories") <= max_repositories)
    kind = F.when(narrow & F.col("live"), F.lit("live")).when(~narrow, F.lit("shared"))
    judged = places.join(small(owned, 64), "hash").select("row", "start", "stop", kind.alias("kind")).where("kind IS NOT NULL")
    added = judged.groupBy("row").agg(F.collect_list(F.concat_ws(":", "kind", "start", "stop")).alias("added"))
    ranks = F.create_map(*[x for i, k in enumerate((*KINDS, "live", "shared")) for x in (F.lit(k), F.lit(i))])
    part = lambda s, i: F.split(s, ":")[i]
    keyed = F.transform(F.concat("base", F.coalesce("added", F.array().cast("array<string>"))), lambda s: F.struct(part(s, 1).cast("int").alias("at"), ranks[part(s, 0)].alias("rank"), s.alias("s")))
    out = scanned.drop("candidates", "owner", "repository").join(small(staged(added), F.size("added") * 64 + 32), "row", "left")
    count = lambda k: F.coalesce(F.size(F.filter("added", lambda s: s.startswith(k))), F.lit(0)).cast("long")
    spans = F.array_join(F.transform(F.array_sort(keyed), lambda x: x["s"]), ",")
    return out.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", spans.alias("spans"), F.greatest(count("live"), F.lit(0)).alias("n_live"), F.greatest(count("shared"), F.lit(0)).alias("n_shared"))


def op8_secret_ownership(spark, sf_dir: str) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_live, n_shared of all documents, which stand for files:
    the source owns them, and each document is a repository of its own.

    Null or empty text: no span. A null source or doc_id counts as one more owner or repository. Repeated rows are places
    in one repository and get equal spans. Spans that start together follow by kind as listed. Texts of any length are
    scanned whole. Empty table: no rows. Further columns are not read.
    """
    return find_secrets(table(spark, sf_dir, "documents"), F.col("source"), F.col("doc_id"))
