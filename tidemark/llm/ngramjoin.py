"""Exact Jaccard join on word n-grams by universe partition and the pigeonhole principle.

The universe of n-grams is hashed into m segments. If two sets differ in at most H tokens, at least m - H of their
segments agree, so a key for each segment's content brings them together. Sets are cut into size bands, each with its
own H and its own allocation, chosen by cost:

- exact keys alone, with m = H + 1 + x segments. Then at least 1 + x segments agree, so a set with at most x light
  segments (of fewer than two tokens, which many sets would share) may leave those out: one of the others agrees.
- q segments also get the keys of their one-deletion neighbourhoods, which allow them one differing token; then
  m + q = H + 1 is enough. It pays for small sets, whose segments would else be light.

Every pair brought together is verified by its full sets. As only components are wanted, no group is expanded into
pairs (see buckets.py).
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .buckets import linked_components, shared_keys
from .common import drop, let_go, packed, small, staged, table, unpacked

BAND_RATIO = 1.4
#: The cost of a candidate pair, in keys.
PAIR_COST = 50.0
#: How often two sets are taken to share a given token.
SHARED_TOKEN = 1e-6
CACHE_WORDS = 200_000

_M1, _M2, _M3 = (np.uint64(x) for x in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53, 0x9E3779B97F4A7C15))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * _M1
    x = (x ^ (x >> np.uint64(33))) * _M2
    return x ^ (x >> np.uint64(33))


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        self[word] = found = xxhash.xxh3_64_intdigest(word)
        return found


_hashes = _WordHashes()


def shingle_set(text: bytes | None, n: int) -> np.ndarray:
    """The sorted 64-bit hashes of a text's distinct n-word shingles, A-Z lower-cased; with fewer words, of the whole
    sequence; without any, none."""
    words = (text or b"").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))
    if len(words) < n:
        h = np.concatenate((h, np.full(n - len(words), len(words), np.uint64)))
    made = h[: len(h) - n + 1].copy()
    for i in range(1, n):
        made = made * _M3 + h[i : len(h) - n + 1 + i]
    return np.unique(_mix(made))


def _name(tokens: np.ndarray) -> bytes:
    """128 bits that name a set."""
    return _mix(tokens + _M1).sum(dtype=np.uint64).tobytes() + _mix(tokens ^ _M3).sum(dtype=np.uint64).tobytes()


class Band(NamedTuple):
    low: int
    high: int  # exclusive
    m: int
    q: int
    spare: int
    light: int


def _some(most: int) -> np.ndarray:
    """0 to `most`: all up to 64, then ever wider steps. A step not tried costs some keys at most, never a link."""
    return np.unique(np.concatenate((np.arange(min(most, 64) + 1), np.geomspace(1, most + 1, 120).astype(np.int64) - 1)))


def allocate(low: int, high: int, num: int, den: int, n_docs: int) -> tuple[int, int, int, int]:
    """m, q, the number x of light segments that a set may leave out, and the size under which a segment is light: of
    least cost for a band of sizes."""
    top = high - 1
    differ = (top + den * top // num) * (den - num) // (den + num)
    best: list[tuple[float, int, int, int, int]] = []
    x = _some(differ + 11)
    for light in (1, 2):
        m = differ + 1 + x
        t = low / m
        left_out = np.exp(-t) * (1 + t * (light - 1))
        single = t * np.exp(-t) * (2 - light)
        cost = m * (1 - left_out) + PAIR_COST * n_docs * m * single**2 * SHARED_TOKEN
        cost[x < m * left_out + 3 * np.sqrt(m * left_out)] = np.inf
        best += [(float(c), differ + 1 + int(i), 0, int(i), light) for c, i in zip(cost, x)]
    q = _some((differ + 1) // 2)
    m = differ + 1 - q
    t = (low + top) / 2 / m
    empty, nearly = np.exp(-t), np.exp(-t) * (1 + t)
    cost = m + q * t + PAIR_COST * n_docs * ((m - q) * empty**2 + q * nearly**2)
    best += [(float(c), differ + 1 - int(i), int(i), 0, 0) for c, i in zip(cost, q)]
    return min(best)[1:]


def bands(num: int, den: int, n_docs: int, longest: int = 1 << 22, known: tuple[Band, ...] = ()) -> tuple[Band, ...]:
    """Size bands from the least size at which two different sets can link, up to `longest` at least. Any two that can
    link lie in the same band or in neighbours. A greater `longest` only adds bands to those `known`."""
    out = list(known)
    low = out[-1].high if out else -(-num // (den - num))
    while low < longest:
        high = max(low + 1, int(low * BAND_RATIO))
        while out and den * (low - 1) // num >= high:
            high += 1
        out.append(Band(low, high, *allocate(low, high, num, den, n_docs)))
        low = high
    return tuple(out)


def band_keys(tokens: np.ndarray, index: int, band: Band) -> np.ndarray:
    """The keys of a set under a band's allocation."""
    segment = (_mix(tokens + _M3) % np.uint64(band.m)).astype(np.int64)
    value = _mix(tokens ^ _M1)
    total = np.zeros(band.m, np.uint64)
    np.add.at(total, segment, value)
    place = np.arange(band.m, dtype=np.uint64) + np.uint64(index << 32)
    exact = _mix(total + _mix(place))
    if not band.q:
        heavy = np.bincount(segment, minlength=band.m) >= band.light
        return exact[heavy] if band.m - heavy.sum() <= band.spare else exact
    some = segment < band.q
    return np.concatenate((exact, _mix(total[segment[some]] - value[some] + _mix(place[segment[some]]))))


class Scheme:
    """The bands of a join. The driver computes those of all usual sizes once and tasks get them with the function; a
    task that meets a larger set adds bands for it."""

    def __init__(self, num: int, den: int, n_docs: int, longest: int = 1 << 22):
        self.num, self.den, self.n_docs = num, den, n_docs
        self.bands = bands(num, den, n_docs, longest)

    def keys(self, tokens: np.ndarray) -> np.ndarray:
        """All keys of a set: its own band's, and those of the band below if a set there can link with it."""
        n = len(tokens)
        while n >= self.bands[-1].high:
            self.bands = bands(self.num, self.den, self.n_docs, 2 * self.bands[-1].high, self.bands)
        if n < self.bands[0].low:  # only an equal set links with it
            return np.zeros(0, np.uint64)
        own = bisect_right(self.bands, n, key=lambda b: b.low) - 1
        keys = [band_keys(tokens, own, self.bands[own])]
        if own and self.num * n <= self.den * (self.bands[own].low - 1):
            keys.append(band_keys(tokens, own - 1, self.bands[own - 1]))
        return np.unique(np.concatenate(keys))


def _verified(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """Those pairs (a, b) whose full sets link."""
    left = sets.select(F.col("doc").alias("a"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("doc").alias("b"), F.col("shingles").alias("sb"))

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3)):
                p, q = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = len(np.intersect1d(p, q, assume_unique=True))
                keep.append(den * both >= num * (len(p) + len(q) - both))
            kept = pa.RecordBatch.from_arrays(batch.columns[:2], ["u", "v"]).filter(pa.array(keep, pa.bool_()))
            yield kept

    return pairs.select("a", "b").join(left, "a").join(right, "b").select("a", "b", "sa", "sb").mapInArrow(linked, "u long, v long")


def _rare_tokens(sets: DataFrame, num: int, den: int) -> DataFrame:
    """Keys (key, d: doc, n, at) for sets in crowded buckets: their rarest tokens, rarest first, as many as it takes for
    any two that link to share one. In a group of edited copies these are the edits, which tell the copies apart.

    Tokens are whole 64-bit hashes. They are spelt out of the sets anew for the counts and for the join with them, and
    only what a set is looked up by is written."""

    def exploded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, raw in zip(batch.column(0).to_pylist(), batch.column(1)):
                tokens = np.frombuffer(raw.as_buffer(), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(tokens), doc)), pa.array(tokens)], ["doc", "token"])

    tokens = sets.select("doc", "shingles").mapInArrow(exploded, "doc long, token long")
    often = tokens.groupBy("token").agg(F.count("*").alias("often"))
    rare = tokens.join(often, "token").groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("often", "token"))).alias("t")).withColumn("n", F.size("t").cast("long"))
    prefix = F.slice("t", F.lit(1), (F.col("n") - F.ceil(F.col("n") * num / den) + 1).cast("int"))
    return staged(rare.select("doc", "n", F.posexplode(prefix).alias("at", "t")).select(F.col("t.token").alias("key"), F.struct("doc", "n", "at").alias("d")))


def _can_meet(num: int, den: int):
    """Whether two sets can link whose first common token in order of rarity is this one: what is left of each from
    there on must hold the overlap needed."""

    def test(x: str, y: str):
        sizes = F.col(f"{x}.n") + F.col(f"{y}.n")
        left = F.least(F.col(f"{x}.n") - F.col(f"{x}.at"), F.col(f"{y}.n") - F.col(f"{y}.at"))
        return left * (num + den) >= sizes * num

    return test


def _components(docs: DataFrame, n: int, num: int, den: int) -> tuple[DataFrame, DataFrame]:
    """Rows (row, doc_id, h: a hash of the text, n, name: of its set) of docs, and for each name of a set that is not
    empty its component and, if that holds more than one class of equal sets, least: the least doc_id in it."""
    scheme = Scheme(num, den, docs.count())

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, names, keys = [], [], []
            for text in batch.column(2):
                tokens = shingle_set(text.as_py(), n)
                sizes.append(len(tokens))
                names.append(_name(tokens))
                keys.append(scheme.keys(tokens).view(np.int64))
            ends = np.concatenate(([0], np.cumsum([len(k) for k in keys]))).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(keys) if keys else np.zeros(0, np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(names, pa.binary()), lists], ["doc_id", "h", "n", "name", "keys"])

    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("h"), F.col("text").cast("binary").alias("text"))
    read = staged(text.mapInArrow(keyed, "doc_id long, h long, n long, name binary, keys array<long>").withColumn("row", F.monotonically_increasing_id()))

    # Equal sets are one class. One row stands for it, that of the least doc_id.
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row", "h")).alias("first")
    classes = read.where("n > 0").groupBy("name").agg(first)
    classes = staged(classes.select("name", F.col("first.row").alias("doc"), F.col("first.doc_id").alias("id_"), F.col("first.h").alias("h_")))
    keys = read.select("row", "n", "keys").join(small(classes.select("doc"), 16), F.col("row") == F.col("doc"), "left_semi")
    can = lambda x, y: F.greatest(f"{x}.n", f"{y}.n") * num <= F.least(f"{x}.n", f"{y}.n") * den
    read_ = staged(read.drop("keys"))
    two, inside = shared_keys(keys.select(F.explode("keys").alias("key"), F.struct(F.col("row").alias("doc"), "n").alias("d")), can)
    del keys
    drop(read)  # the keys, several times the rest
    let_go(docs.sparkSession)
    met = two.select(F.explode(F.array("x.doc", "y.doc")).alias("doc")).union(inside.select("d.doc")).distinct()

    def shingled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(t.as_py(), n) for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array([_name(s) for s in sets], pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())], ["name", "shingles"])

    wanted = staged(classes.join(small(staged(met), 16), "doc", "left_semi"))
    texts = text.join(small(wanted.select("id_", "h_"), 32), F.col("doc_id").eqNullSafe(F.col("id_")) & (F.col("h") == F.col("h_")), "left_semi")
    sets = texts.select("text").mapInArrow(shingled, "name binary, shingles binary").join(small(wanted.select("name", "doc"), 40), "name")
    many = read_.groupBy("doc_id", "h").agg(F.count("*").alias("c")).where("c > 1")
    sets = sets.select("doc", "shingles")
    if not many.isEmpty():  # repeated rows give a set twice
        sets = sets.dropDuplicates(["doc"])
    sets = staged(sets, compression="none")

    def rarest(label: DataFrame) -> DataFrame:
        some = staged(label.select("d.doc", "of").distinct())
        keys = _rare_tokens(sets.join(small(some.select("doc"), 8), "doc", "left_semi"), num, den)
        return keys.join(small(some, 24), F.col("d.doc") == F.col("doc")).select("key", "d", "of")

    found = linked_components(two, inside, can, lambda pairs: _verified(pairs, sets, num, den), rarest, _can_meet(num, den))
    of = staged(classes.join(small(found, 16), F.col("doc") == F.col("node")).select("name", "component", "id_"))
    least = staged(of.groupBy("component").agg(F.min("id_").alias("least")))
    of = staged(of.join(small(least, 16), "component").select("name", "component", "least"))
    single = classes.join(small(of.select("name"), 24), "name", "left_anti")
    drop(two, inside, wanted, sets, least)
    return read_, of.union(single.select("name", F.col("doc").alias("component"), F.col("id_").alias("least")))


def jaccard_components(docs: DataFrame, n: int = 3, num: int = 90, den: int = 100) -> DataFrame:
    """doc_id, n_shingles, component_id, one row per row of docs.

    Two documents link when den * |intersection| >= num * |union| of their n-word shingle sets; component_id is the
    least doc_id reachable. Sets are compared by 64-bit shingle hashes, those of texts of any length.

    Null, empty or blank text: an empty set, linked with nothing; its component_id is its doc_id. A null doc_id: no
    component_id; others may be linked through such a row, whose doc_id is then not theirs. Repeated rows are linked
    with each other. Rows of one doc_id with different texts are documents of their own. Empty table: no rows. Further
    columns of docs are not read.
    """
    read, classes = _components(docs, n, num, den)
    out = read.select("doc_id", "n", F.when(F.col("n") > 0, F.col("name")).alias("name")).join(small(staged(classes), 48), "name", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("least", "doc_id")).alias("component_id"))


def one_of_each(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """One row of each component of near duplicates, on five-word shingles from 0.8 on: the one of the least doc_id, and
    of that of the least hash of its text. A row with a doc_id goes before one without. Rows with an empty set stay all.
    Repeated rows are near duplicates of each other, and one stays."""
    read, classes = _components(docs, n, num, den)
    rows = staged(read.where("n > 0").join(small(staged(classes), 48), "name").select("component", "doc_id", "h"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h")).alias("first")
    groups = rows.groupBy("component").agg(first, F.count("*").alias("c")).where("c > 1")
    keep = staged(groups.select("component", F.col("first.doc_id").alias("keep_id"), F.col("first.h").alias("keep_h")))
    told = rows.join(small(keep, 40), "component").groupBy("doc_id", "h").agg(F.max(F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("h") == F.col("keep_h"))).alias("first"), F.count("*").alias("c"))
    gone = staged(told.where("NOT first").select(F.col("doc_id").alias("id_"), F.col("h").alias("h_")))
    twice = staged(told.where("first AND c > 1").select(F.col("doc_id").alias("id_"), F.col("h").alias("h_")))
    same = F.col("id").eqNullSafe(F.col("id_")) & (F.col("h") == F.col("h_"))
    left = packed(docs, F.col("doc_id").cast("long").alias("id"), F.xxhash64("text").alias("h")).join(small(gone, 32), same, "left_anti")
    once = left
    if not twice.isEmpty():
        twice = small(twice, 32)
        once = left.join(twice, same, "left_anti").union(left.join(twice, same, "left_semi").dropDuplicates(["id", "h"]))
    return once.select(*unpacked(docs.columns))


def op4_ngram_jaccard_join(spark, sf_dir: str) -> DataFrame:
    """doc_id, n_shingles, component_id of all documents: 3-word shingles, similarity 0.9. See jaccard_components."""
    return jaccard_components(table(spark, sf_dir, "documents"))
