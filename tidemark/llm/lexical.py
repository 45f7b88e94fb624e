"""Ranked lexical search: posting lists cut into blocks of similar documents, skipped by exact bounds."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import drop, spread, staged, table

#: Items are searched in sets of about so many bytes of text, each over all documents.
ITEM_BYTES = 256 << 10
#: A shard of the index: so many cells of documents x terms at most. It bounds a task's memory.
CELLS = 1 << 24
#: Documents a block aims at, and blocks of a list at most (more documents make larger blocks).
BLOCK, BLOCKS = 64, 32
SKETCH = 16
TOP = 10

# A term is a run of ASCII letters, digits and anything beyond ASCII; A-Z are lower-cased.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 0x20 for c in range(256))


def terms_of(raw: bytes) -> list[bytes]:
    return raw.translate(_FOLD).split()


class _Known(dict):
    def __missing__(self, term: bytes) -> int:
        return -1


class Items:
    """A bounded set of items: their terms as sorted numbers, and for each term those that share an item with it."""

    def __init__(self, texts: list[bytes]) -> None:
        found = [sorted(set(terms_of(t))) for t in texts]
        self.number = _Known({t: i for i, t in enumerate(sorted({t for ts in found for t in ts}))})
        self.terms = [np.array([self.number[t] for t in ts], np.int64) for ts in found]
        by: list[list[np.ndarray]] = [[] for _ in self.number]
        for ts in self.terms:
            for t in ts:
                by[t].append(ts)
        self.beside = [np.unique(np.concatenate(x)) for x in by]


def weights(n_docs: int, df: np.ndarray) -> np.ndarray:
    return np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(x) + 1))) for x in df], np.int64)


def build_shard(n_docs: int, row: np.ndarray, term: np.ndarray, impact: np.ndarray, items: Items, weight: np.ndarray, block: int = BLOCK, blocks: int = BLOCKS) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(term, documents, where each block of them starts, maxima) for each posting list of a shard.

    Postings are (row, term, impact) by row. A list's documents are dealt to the nearest, by the cosine of sketches of their
    weighted impacts, of some documents of the list; a block's summary is the largest impact of each term of
    `items.beside` in it.
    """
    dense = np.zeros((n_docs, len(weight)), np.int32)
    dense[row, term] = impact
    signs = np.random.default_rng(7).choice(np.array([-1, 1], np.float32), (len(weight), SKETCH))
    sketch = np.zeros((n_docs, SKETCH), np.float32)
    for j in range(SKETCH):
        sketch[:, j] = np.bincount(row, signs[term, j] * (weight[term] * impact), n_docs)
    sketch /= np.maximum(np.linalg.norm(sketch, axis=1, keepdims=True), 1e-9)
    order = np.argsort(term, kind="stable")
    at = np.searchsorted(term[order], np.arange(len(weight) + 1))
    for t in range(len(weight)):
        docs = row[order[at[t] : at[t + 1]]]
        if len(docs):
            k = min(blocks, -(-len(docs) // block))
            if k > 1:
                own = (sketch[docs] @ sketch[docs[np.linspace(0, len(docs) - 1, k).astype(int)]].T).argmax(1)
                by = np.argsort(own, kind="stable")
                docs, own = docs[by], own[by]
                starts = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
            else:
                starts = np.zeros(1, np.int64)
            yield t, docs.astype(np.int32), starts.astype(np.int32), np.maximum.reduceat(dense[np.ix_(docs, items.beside[t])], starts, axis=0)


class Shard:
    """A shard of the index as its search needs it."""

    def __init__(self, n_docs: int, n_terms: int) -> None:
        self.dense, self.lists, self.ids = np.zeros((n_docs, n_terms), np.int32), {}, np.arange(n_docs)

    def search(self, of: np.ndarray, beside: list[np.ndarray], weight: np.ndarray, top: int = TOP) -> tuple[np.ndarray, np.ndarray, int]:
        """Rows and scores of the `top` best documents for an item's terms `of`, and how many documents were scored.

        Lists go from the heaviest term to the lightest, blocks of a list from the largest bound down. A block's bound is
        its summary's score; a document that stands in no list so far can't score more than the sum of what is left. Once
        `top` documents are found, what is bound below the last of them is skipped, and nothing else is.
        """
        of = np.array([t for t in of if t in self.lists], np.int64)
        of = of[np.argsort(-weight[of], kind="stable")]
        w = weight[of]
        most = [int(w[i]) * int(self.lists[t][2][:, np.searchsorted(beside[t], t)].max()) for i, t in enumerate(of)]
        left = np.cumsum(most[::-1])[::-1] if most else []
        seen = np.zeros(len(self.dense), bool)
        best, score, floor = np.zeros(0, np.int64), np.zeros(0, np.int64), 0
        for i, t in enumerate(of):
            if left[i] < floor:
                break
            docs, starts, maxima = self.lists[t]
            bound = maxima[:, np.searchsorted(beside[t], of)].astype(np.int64) @ w
            ends = np.append(starts[1:], len(docs))
            for b in np.argsort(-bound, kind="stable"):
                if bound[b] < floor:
                    break
                new = docs[starts[b] : ends[b]]
                new = new[~seen[new]]
                if len(new):
                    seen[new] = True
                    got = self.dense[np.ix_(new, of)].astype(np.int64) @ w
                    keep = got >= max(floor, 1)
                    best, score = np.concatenate((best, new[keep])), np.concatenate((score, got[keep]))
                    if len(best) > top:
                        first = np.lexsort((self.ids[best], -score))[:top]
                        best, score = best[first], score[first]
                    if len(best) == top:
                        floor = int(score.min())
        return best, score, int(seen.sum())


def forward(docs: DataFrame, items: Items) -> DataFrame:
    """doc_id, n, term, tf: each document's number of terms, and its postings of the items' terms."""
    known = docs.sparkSession.sparkContext.broadcast(items.number)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = known.value.__getitem__
        for batch in batches:
            n, term, tf = [], [], []
            for text in batch.column(1).cast(pa.binary()):
                found = terms_of(text.as_py() or b"")
                ids = np.fromiter(map(number, found), np.int32, len(found))
                ids, count = np.unique(ids[ids >= 0], return_counts=True)
                n.append(len(found))
                term.append(ids)
                tf.append(count)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(term, pa.list_(pa.int32())), pa.array(tf, pa.list_(pa.int64()))], ["doc_id", "n", "term", "tf"])

    return spread(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")).mapInArrow(rows, "doc_id long, n long, term array<int>, tf array<long>")


def statistics(postings: DataFrame, n_terms: int) -> tuple[int, int, np.ndarray]:
    """Documents with a term, their terms with repeats, and the document frequency of each term of the items."""

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros(n_terms + 2, np.int64)
        for batch in batches:
            n = np.asarray(batch.column(0))
            out[:2] += (n > 0).sum(), n.sum()
            out[2:] += np.bincount(np.asarray(batch.column(1).flatten()), minlength=n_terms)
        at = np.flatnonzero(out)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(out[at], pa.int64())], ["at", "n"])

    out = np.zeros(n_terms + 2, np.int64)
    for at, n in postings.select("n", "term").mapInArrow(summed, "at int, n long").groupBy("at").agg(F.sum("n")).collect():  # n_terms + 2 rows at most
        out[at] = n
    return int(out[0]), int(out[1]), out[2:]


_INDEX = "shard string, term int, docs array<long>, a binary, b binary, c binary"


def build_index(postings: DataFrame, items: Items, n_docs: int, n_terms: int, weight: np.ndarray, cells: int = CELLS, block: int = BLOCK) -> DataFrame:
    """The index: for each shard (consecutive documents of a task) its documents with their impacts (term -1) and a row for
    each posting list with its blocks and summaries. No shuffle; a list of any length is cut by the shards."""
    shared = postings.sparkSession.sparkContext.broadcast((items, weight))
    size = max(1, cells // max(1, len(weight)))
    told = pa.schema([("shard", pa.string()), ("term", pa.int32()), ("docs", pa.list_(pa.int64())), ("a", pa.binary()), ("b", pa.binary()), ("c", pa.binary())])

    def shard(name: str, doc_ids: list, length: list, term: list, tf: list) -> Iterator[pa.RecordBatch]:
        items, weight = shared.value
        row = np.repeat(np.arange(len(term)), [len(t) for t in term])
        t, f = np.concatenate(term).astype(np.int64), np.concatenate(tf)
        m = np.array([10 + (90 * n * n_docs) // n_terms for n in length], np.int64)[row]
        impact = (1_000_000_000 * f) // (1000 * f + 8 * m)
        rows = []
        for i in range(0, len(term), 512):
            here = (row >= i) & (row < i + 512)
            rows.append((name, -1, doc_ids[i : i + 512], (row[here] - i).astype(np.int32).tobytes(), t[here].astype(np.int32).tobytes(), impact[here].astype(np.int32).tobytes()))
        for number, docs, starts, maxima in build_shard(len(term), row, t, impact, items, weight, block):
            rows.append((name, number, None, docs.tobytes(), starts.tobytes(), maxima.astype(np.int32).tobytes()))
        for i in range(0, len(rows), 256):
            yield pa.RecordBatch.from_arrays([pa.array(list(c), kind) for c, kind in zip(zip(*rows[i : i + 256]), told.types)], schema=told)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, made, held = TaskContext.get().partitionId(), 0, ([], [], [], [])
        for batch in batches:
            for doc, n, term, tf in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3)):
                if len(term.values):
                    for kept, x in zip(held, (doc, n, term.values.to_numpy(), tf.values.to_numpy())):
                        kept.append(x)
                    if len(held[0]) == size:
                        yield from shard(f"{task}-{made}", *held)
                        made, held = made + 1, ([], [], [], [])
        if held[0]:
            yield from shard(f"{task}-{made}", *held)

    return postings.mapInArrow(build, _INDEX)


def search_index(index: DataFrame, items: Items, weight: np.ndarray, top: int = TOP) -> DataFrame:
    """item (its number), doc_id, score: the best documents of each shard for each item."""
    shared = index.sparkSession.sparkContext.broadcast((items, weight))
    told = pa.schema([("item", pa.int32()), ("doc_id", pa.int64()), ("score", pa.int64())])

    def search(group: pa.Table) -> pa.Table:
        items, weight = shared.value
        term = np.asarray(group.column("term"))
        docs = [group.slice(i, 1).to_pylist()[0] for i in np.flatnonzero(term < 0)]
        ids = [x for d in docs for x in d["docs"]]
        shard = Shard(len(ids), len(weight))
        shard.ids = np.array([np.iinfo(np.int64).max if x is None else x for x in ids], np.int64)
        read = lambda b: np.frombuffer(b, np.int32)
        base = 0
        for d in docs:
            shard.dense[base + read(d["a"]), read(d["b"])] = read(d["c"])
            base += len(d["docs"])
        for i in np.flatnonzero(term >= 0):
            starts = read(group.column("b")[i].as_py())
            shard.lists[int(term[i])] = (read(group.column("a")[i].as_py()), starts, read(group.column("c")[i].as_py()).reshape(len(starts), -1))
        out: list[list] = [[], [], []]
        for k, of in enumerate(items.terms):
            best, score, _ = shard.search(of, items.beside, weight, top)
            out[0] += [k] * len(best)
            out[1] += [ids[x] for x in best]
            out[2] += score.tolist()
        return pa.table([pa.array(c, kind) for c, kind in zip(out, told.types)], schema=told)

    return index.groupBy("shard").applyInArrow(search, "item int, doc_id long, score long")


def rank_documents(docs: DataFrame, items: DataFrame, top: int = TOP, item_bytes: int = ITEM_BYTES, cells: int = CELLS) -> DataFrame:
    """item_id, rank, doc_id, score: the `top` best documents of docs (doc_id, text) for each row of items (item_id, text).

    Items go in sets of about `item_bytes` of text, each against all documents; the driver holds one set at a time. For a
    set, documents are reduced to their postings of its terms, the index is written, and each shard is searched alone;
    ranks are a top-k an item over the shards' results, which each task cuts before the shuffle.
    """
    spark = docs.sparkSession
    spark_items = items.select("item_id", F.coalesce("text", F.lit("")).alias("text")).distinct()
    total = spark_items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    sets = -(-total // item_bytes) or 1
    found = []
    for k in range(sets):
        rows = spark_items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(sets)) == k).collect()
        rows.sort(key=lambda r: (r.item_id is None, r.item_id or 0, r.text))
        items_ = Items([r.text.encode("utf-8", "surrogatepass") for r in rows])
        if not items_.number:
            continue
        postings = staged(forward(docs, items_))
        n_docs, n_terms, df = statistics(postings, len(items_.number))
        weight = weights(n_docs, df)
        index = staged(build_index(postings, items_, n_docs, max(1, n_terms), weight, cells))
        order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
        ranked = search_index(index, items_, weight, top).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
        names = spark.createDataFrame([(i, r.item_id) for i, r in enumerate(rows)], f"item int, item_id {items.schema['item_id'].dataType.simpleString()}")
        found.append(staged(ranked.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")))  # a set of items is bounded
        drop(postings, index)
    none = spark.createDataFrame([], f"item_id {items.schema['item_id'].dataType.simpleString()}, rank int, doc_id long, score long")
    return reduce(lambda a, b: a.union(b), found) if found else none


def op12_geometric_block_search(spark, sf_dir: str) -> DataFrame:
    """item_id, rank, doc_id, score: the ten best of all documents for each item of benchmark.

    Null and empty texts have no term: they are never found, and find nothing. Repeated items count once, rows of one
    item_id with different texts are items of their own. Repeated documents are found as often as they come, one after
    the other; a null doc_id goes last of equal scores. Texts of any length count whole. Empty tables: no rows. Further
    columns are not read.
    """
    return rank_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_TERMS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
OP12_SQL = rf"""
WITH q AS (SELECT row_number() OVER () AS item, item_id, list_distinct({_TERMS}) AS ts FROM (SELECT DISTINCT item_id, text FROM benchmark)),
qt AS (SELECT item, item_id, unnest(ts) AS t FROM q),
d AS (SELECT row_number() OVER () AS id, doc_id, {_TERMS} AS ts FROM documents),
s AS (SELECT count(*) FILTER (len(ts) > 0) AS nn, sum(len(ts)) AS l FROM d),
p AS (SELECT id, doc_id, t, count(*) AS tf, any_value(n) AS n FROM (SELECT id, doc_id, len(ts) AS n, unnest(ts) AS t FROM d) WHERE t IN (SELECT t FROM qt) GROUP BY id, doc_id, t),
f AS (SELECT t, CAST(floor(1000 * ln((2 * nn + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE)) AS BIGINT) AS w FROM p, s GROUP BY t, nn),
i AS (SELECT id, doc_id, t, (1000000000 * tf) // (1000 * tf + 8 * (10 + CAST((90 * n::hugeint * nn) // l AS BIGINT))) AS x FROM p, s),
r AS (SELECT item, item_id, id, doc_id, CAST(sum(w * x) AS BIGINT) AS score FROM qt JOIN i USING (t) JOIN f USING (t) GROUP BY ALL),
k AS (SELECT *, CAST(row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM r WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM k WHERE rank <= 10
"""
