"""Phrase collocations from a weighted de Bruijn graph of words."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import drop, spread, staged, table

#: Grams are counted in so many hashed places (as a power of two) before any is spelt out; a bit each is broadcast.
PLACE_BITS = 27
PAGE = 1 << 15
#: A task aggregates so many words at a time.
CHUNK_WORDS = 1_000_000
TOP = 2000

# A piece ends at these characters; words are parted by blank and tab.
_ENDS = b".,;:!?\n\x0b\x0c\r"
_FOLD = bytes(0x2E if c in _ENDS else 0x20 if c == 9 else c + 32 if 65 <= c <= 90 else c for c in range(256))


class _Numbers(dict):
    """Words of a chunk by number, in order of appearance; 0 is the end of a piece."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


class _Chunk:
    """Numbered words of some documents of one language."""

    def __init__(self) -> None:
        self.number, self.parts, self.n = _Numbers({b".": 0}), [], 0

    def add(self, text: bytes) -> None:
        words = text.translate(_FOLD).replace(b".", b" . ").split()
        words.append(b".")
        self.parts.append(np.fromiter(map(self.number.__getitem__, words), np.int64, len(words)))
        self.n += len(words)

    def ids(self) -> np.ndarray:
        return np.concatenate([np.zeros(1, np.int64), *self.parts])


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, _Chunk]]:
    """The documents (lang, text) of a task by language, about CHUNK_WORDS words at a time."""
    held: dict[str, _Chunk] = {}
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary())):
            held.setdefault(lang, _Chunk()).add(text.as_py())
            if sum(c.n for c in held.values()) >= CHUNK_WORDS:
                yield from held.items()
                held = {}
    yield from held.items()


def _levels(lang: str, chunk: _Chunk, longest: int, told: np.ndarray | None, bits: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """k, ids, places, alive for grams of 1, 2, ... `longest` words: the hashed place of the gram that starts at each word,
    and whether it lies in one piece and all its shorter grams are in places told of."""
    ids = chunk.ids()
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, chunk.number), np.uint64, len(chunk.number))[ids]
    x = h ^ np.uint64(xxhash.xxh3_64_intdigest(lang.encode()))
    ok = ids > 0
    for k in range(1, longest + 1):
        if k > 1:
            x = (x[:-1] ^ (x[:-1] >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + h[k - 1 :]
            ok = ok[:-1] & ok[1:]
        y = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        place = ((y ^ (y >> np.uint64(32))) & np.uint64((1 << bits) - 1)).astype(np.int64)
        yield k, ids, place, ok
        if told is not None:
            ok = ok & ((told[place >> 3] >> (place & 7)) & 1 > 0)


def frequent_places(docs: DataFrame, longest: int, least: int, bits: int = PLACE_BITS) -> np.ndarray:
    """A bit for each place in which grams of 1 to `longest` words occur `least` times or more together.

    Every gram that occurs so often has its bit set. Words and pairs are counted in a first pass, each longer size in a
    further one, by then only where all shorter grams are in told places. A task sends a page of places as two byte strings;
    pages are added up as they come. The bits take 2^bits / 8 bytes whatever the input is, and they alone reach the driver;
    the fuller they get, the fewer grams they rule out, and no result depends on them.
    """
    context = docs.sparkSession.sparkContext
    told = np.zeros(max(PAGE, 1 << bits) // 8, np.uint8)
    for sizes in ([1, 2][:longest], *[[k] for k in range(3, longest + 1)]):
        shared = context.broadcast(told) if sizes[0] > 1 else None

        def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held, n = [], 0
            for lang, chunk in _chunks(batches):
                for k, _, place, alive in _levels(lang, chunk, sizes[-1], shared.value if shared else None, bits):
                    if k in sizes:
                        held.append(place[alive])
                        n += len(held[-1])
                if n >= 4 * CHUNK_WORDS:
                    yield _paged(held)
                    held, n = [], 0
            if n:
                yield _paged(held)

        def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            count: dict[int, np.ndarray] = {}
            kind = np.uint8 if least < 256 else np.int64
            for batch in batches:
                for page, at, n in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
                    c = count.setdefault(page, np.zeros(PAGE, kind))
                    at = np.frombuffer(at.as_py(), np.uint16)
                    c[at] = np.minimum(c[at].astype(np.int64) + np.frombuffer(n.as_py(), np.uint8), least)
            found = [np.packbits(c >= least, bitorder="little").tobytes() for c in count.values()]
            yield pa.RecordBatch.from_arrays([pa.array(list(count), pa.int32()), pa.array(found, pa.binary())], ["page", "b"])

        pages = docs.mapInArrow(counted, "page int, at binary, n binary").repartition("page").mapInArrow(added, "page int, b binary")
        told = told.copy()
        for row in pages.collect():  # a bit for each place
            told[row.page * PAGE // 8 : (row.page + 1) * PAGE // 8] |= np.frombuffer(row.b, np.uint8)
    return told


def _paged(places: list[np.ndarray]) -> pa.RecordBatch:
    """Counts by page: places within the page (16 bits each), and how often each occurs (8 bits, 255 at most: more than
    that is found in several parts)."""
    at, n = np.unique(np.concatenate(places), return_counts=True)
    more = np.flatnonzero(n > 255)
    at, n = np.concatenate((at, *[np.repeat(at[i], -(-int(n[i]) // 255) - 1) for i in more])), np.concatenate((np.minimum(n, 255), *[np.full(-(-int(n[i]) // 255) - 1, 255) for i in more]))
    page = at // PAGE
    order = np.argsort(page, kind="stable")
    page, at, n = page[order], (at[order] % PAGE).astype(np.uint16), n[order].astype(np.uint8)
    ends = np.flatnonzero(np.append(page[1:] != page[:-1], True)) + 1
    parts = list(zip(np.append(0, ends[:-1]), ends))
    return pa.RecordBatch.from_arrays([pa.array(page[ends - 1], pa.int32()), pa.array([at[i:j].tobytes() for i, j in parts], pa.binary()), pa.array([n[i:j].tobytes() for i, j in parts], pa.binary())], ["page", "at", "n"])


def graph(docs: DataFrame, longest: int, least: int, bits: int = PLACE_BITS) -> DataFrame:
    """lang, k, gram, n: the weighted edges of the de Bruijn graph and the ends of the walks through it.

    A piece of text is a walk over nodes of longest - 1 words, and each of its `longest`-grams an edge (k = longest) between
    two nodes that overlap. Where a gram of k words is not part of a longer one, as at the end of a piece, a row of k counts
    its end. The row of k = 0 counts a language's words. Walks also end before a gram whose place is not frequent
    (`frequent_places`): what occurs `least` times is never in such a place, so its count, what flows on plus what ends,
    stays exact. Grams are summed up in a task before the shuffle; a gram that a third of all documents share costs each
    task a few rows.
    """
    told = docs.sparkSession.sparkContext.broadcast(frequent_places(docs, longest, least, bits))
    names = ["lang", "k", "gram", "n"]

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, chunk in _chunks(batches):
            words = pa.array(list(chunk.number), pa.binary())
            size, code, before = np.int64(len(words)), None, None
            rows = []

            def add(k: int, ids: np.ndarray, code: np.ndarray, here: np.ndarray) -> None:
                here = np.flatnonzero(here)
                _, first, n = np.unique(code[here], return_index=True, return_counts=True)
                parts = [pc.take(words, pa.array(ids[here[first] + j])) for j in range(k)]
                text = parts[0] if k == 1 else pc.binary_join_element_wise(*parts, pa.scalar(b" ", pa.binary()))
                rows.append((k, text.cast(pa.string()), pa.array(n, pa.int64())))

            for k, ids, place, alive in _levels(lang, chunk, longest, told.value, bits):
                ok = alive & ((told.value[place >> 3] >> (place & 7)) & 1 > 0)
                if k == 1:
                    rows.append((0, pa.array([""]), pa.array([int((ids > 0).sum())], pa.int64())))
                    code_now = ids
                else:
                    ends = before.copy()
                    ends[: len(ok)] &= ~ok
                    add(k - 1, ids, code, ends)
                    code_now = np.zeros(len(ok), np.int64)
                    code_now[ok] = np.unique((code[:-1] * size + ids[k - 1 :])[ok], return_inverse=True)[1]
                code, before = code_now, ok
            add(longest, ids, code, before)
            for k, text, n in rows:
                for i in range(0, len(text), 50_000):
                    m = len(text[i : i + 50_000])
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * m, pa.string()), pa.array([k] * m, pa.int32()), text[i : i + 50_000], n[i : i + 50_000]], names)

    return docs.mapInArrow(grams, "lang string, k int, gram string, n long").groupBy("lang", "k", "gram").agg(F.sum("n").alias("n"))


def _first(gram, k: int):
    return F.substring_index(gram, " ", k)


def _last(gram, k: int):
    return F.substring_index(gram, " ", -k)


def compact(rows: DataFrame, longest: int) -> DataFrame:
    """lang, words, n: the edges of a graph with its unary paths made one row each.

    A node is unary if one edge enters it, one leaves it, and no piece starts or ends there, so both have its count. From
    each such node pointers double towards the first node of its path, in a number of rounds of the order of the logarithm
    of the longest path. A path lies within one piece of a text, which bounds a row and its group; as each walk starts
    somewhere, no path is a circle.
    """
    edges = rows.where(F.col("k") == longest)
    side = lambda node, other, d, w, x: edges.groupBy("lang", node.alias("node")).agg(F.count("*").alias(d), F.sum("n").alias(w), F.min(other).alias(x)).where(F.col(d) == 1)
    into = side(_last(F.col("gram"), longest - 1), _first(F.col("gram"), 1), "d1", "n", "before")
    out = side(_first(F.col("gram"), longest - 1), _last(F.col("gram"), 1), "d2", "m", "after")
    ends = rows.where(F.col("k") == longest - 1).select("lang", F.col("gram").alias("node"))
    unary = staged(into.join(out, ["lang", "node"]).where("n = m").join(ends, ["lang", "node"], "left_anti").select("lang", "node", "before", "after", "n"))
    # the node before: the word before and all words but the last
    kept = F.concat_ws(" ", "before", _first(F.col("node"), longest - 2)) if longest > 2 else F.col("before")
    known = unary.select("lang", F.col("node").alias("up"), F.lit(True).alias("is"))
    heads = unary.withColumn("up", kept).join(known, ["lang", "up"], "left")
    now = staged(heads.select("lang", "node", F.when(F.col("is"), F.col("up")).otherwise(F.col("node")).alias("up"), F.when(F.col("is"), 1).otherwise(0).alias("at"), F.lit(True).alias("moved")))
    while not now.where("moved").isEmpty():
        above = now.select("lang", F.col("node").alias("up"), F.col("up").alias("up2"), F.col("at").alias("at2"))
        step = staged(now.join(above, ["lang", "up"]).select("lang", "node", F.col("up2").alias("up"), (F.col("at") + F.col("at2")).alias("at"), (F.col("up") != F.col("up2")).alias("moved")))
        drop(now)
        now = step
    line = F.array_sort(F.collect_list(F.struct("at", "node", "before", "after")))
    per = now.join(unary, ["lang", "node"]).groupBy("lang", "up").agg(line.alias("p"), F.min("n").alias("n"))
    words = F.concat(F.array(F.col("p")[0]["before"]), F.split(F.col("p")[0]["node"], " "), F.transform("p", lambda x: x["after"]))
    inside = unary.select("lang", "node")
    plain = edges.withColumn("a", _first(F.col("gram"), longest - 1)).withColumn("b", _last(F.col("gram"), longest - 1))
    plain = plain.join(inside.withColumnRenamed("node", "a"), ["lang", "a"], "left_anti").join(inside.withColumnRenamed("node", "b"), ["lang", "b"], "left_anti")
    out = staged(per.select("lang", words.alias("words"), "n").union(plain.select("lang", F.split("gram", " ").alias("words"), "n")))
    drop(unary, now)
    return out


def gram_counts(rows: DataFrame, paths: DataFrame, longest: int, least: int) -> DataFrame:
    """lang, k, gram, n: all grams of 1 to `longest` words that occur `least` times or more.

    A path's edges have its count. A node's count is what flows out of it: the sum over its edges, and over the pieces
    that end there; and so on down to single words.
    """
    cut = lambda k, n: F.transform(F.sequence(F.lit(0), n), lambda i: F.array_join(F.slice("words", i + 1, k), " "))
    size = F.size("words")
    found, flows = [paths.where(F.col("n") >= least).select("lang", F.lit(longest).alias("k"), F.explode(cut(longest, size - longest)).alias("gram"), "n")], []
    flow = paths.select("lang", F.explode(cut(longest - 1, size - longest)).alias("gram"), "n")
    for k in range(longest - 1, 0, -1):
        flow = flow.union(rows.where(F.col("k") == k).select("lang", "gram", "n")).groupBy("lang", "gram").agg(F.sum("n").alias("n"))
        flow = staged(flow)
        flows.append(flow)
        found.append(flow.where(F.col("n") >= least).select("lang", F.lit(k).alias("k"), "gram", "n"))
        flow = flow.select("lang", _first(F.col("gram"), k - 1).alias("gram"), "n") if k > 1 else flow
    out = staged(reduce(lambda a, b: a.union(b), found))
    drop(*flows)
    return out


def collocations(docs: DataFrame, longest: int = 3, least: int = 10, share_pct: int = 50, top: int = TOP, bits: int = PLACE_BITS) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the `top` phrases of 2 to `longest` words of each language.

    docs: lang, text. A phrase occurs a >= `least` times; of its cuts in two, with counts l and r, the one with the least
    floor(1000000 a a / (l r)) counts, the first of equal ones. Phrases inside a longer one that occurs in at least
    `share_pct` percent of their places are dropped. Arithmetic is in decimals of 38 digits. Ranks are a top-k a language,
    which each task cuts before the shuffle.
    """
    text = spread(docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text")))
    return ranked_phrases(staged(graph(text, longest, least, bits)), longest, least, share_pct, top)


def ranked_phrases(rows: DataFrame, longest: int, least: int, share_pct: int, top: int) -> DataFrame:
    """The phrases of a (staged) graph, which is deleted."""
    paths = compact(rows, longest)
    counts = gram_counts(rows, paths, longest, least)
    wanted = counts.where("k > 1").select("lang", "k", F.col("gram").alias("phrase"), F.col("n").alias("a"))
    cuts = wanted.withColumn("cut", F.explode(F.sequence(F.lit(1), F.col("k") - 1)))
    cuts = cuts.withColumn("x", F.expr("substring_index(phrase, ' ', cut)")).withColumn("y", F.expr("substring_index(phrase, ' ', cut - k)"))
    of = lambda gram, n: counts.select("lang", F.col("gram").alias(gram), F.col("n").alias(n))
    d = lambda c: F.col(c).cast("decimal(19,0)")
    scored = cuts.join(of("x", "l"), ["lang", "x"]).join(of("y", "r"), ["lang", "y"])
    scored = scored.withColumn("up", d("a") * d("a").cast("decimal(18,0)")).withColumn("down", d("l").cast("decimal(18,0)") * d("r"))
    scored = scored.withColumn("score", F.expr("(cast(up AS DECIMAL(31, 0)) * cast(1000000 AS DECIMAL(7, 0))) DIV down"))
    best = scored.groupBy("lang", "phrase", "k", "a").agg(F.min(F.struct("score", "cut", "l", "r")).alias("b"))
    longer = wanted.where("k > 2").withColumn("m", F.explode(F.sequence(F.lit(2), F.col("k") - 1))).withColumn("i", F.explode(F.sequence(F.lit(1), F.col("k") - F.col("m") + 1)))
    longer = longer.select("lang", F.array_join(F.slice(F.split("phrase", " "), F.col("i"), F.col("m")), " ").alias("phrase"), F.col("a").alias("most"))
    longer = longer.groupBy("lang", "phrase").agg(F.max("most").alias("most"))
    kept = best.join(longer, ["lang", "phrase"], "left").where(f"most IS NULL OR 100 * most < {share_pct} * a")
    totals = rows.where("k = 0").select("lang", F.col("n").alias("n"))
    kept = kept.select("lang", "phrase", "a", F.col("b.l").alias("l"), F.col("b.r").alias("r"), F.col("b.score").alias("score"))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = kept.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    out = staged(ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score"))
    drop(rows, paths, counts)
    return out


def op11_de_bruijn_phrases(spark, sf_dir: str) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the first 2,000 phrases of two or three words of each language of documents.

    Null or empty text: no word. A null lang counts as `und`. Repeated rows count as often as they come. Ties end by the
    phrase's bytes. A very long text counts whole; doc_id and further columns are not read. Empty table: no rows.
    """
    return collocations(table(spark, sf_dir, "documents"))


_LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
OP11_SQL = rf"""
WITH p AS (SELECT lang, row_number() OVER () AS id, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM
  (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array({_LOWER.format("coalesce(text, '')")}, '[.,;:!?\x0A-\x0D]')) AS piece FROM documents)),
w AS (SELECT lang, id, unnest(w) AS w, generate_subscripts(w, 1) AS i FROM p),
g AS (SELECT lang, w AS w1, lead(w) OVER s AS w2, lead(w, 2) OVER s AS w3 FROM w WINDOW s AS (PARTITION BY id ORDER BY i)),
t AS (SELECT lang, count(*) AS n FROM w GROUP BY lang),
c AS (SELECT lang, 1 AS k, w1 AS gram, count(*) AS f FROM g GROUP BY ALL
  UNION ALL SELECT lang, 2, w1 || ' ' || w2, count(*) FROM g WHERE w2 IS NOT NULL GROUP BY ALL
  UNION ALL SELECT lang, 3, w1 || ' ' || w2 || ' ' || w3, count(*) FROM g WHERE w3 IS NOT NULL GROUP BY ALL),
a AS (SELECT lang, k, gram, f FROM c WHERE k > 1 AND f >= 10),
x AS (SELECT lang, k, gram, f, cut, array_to_string(string_split(gram, ' ')[:cut], ' ') AS x, array_to_string(string_split(gram, ' ')[cut + 1:], ' ') AS y
  FROM a, (VALUES (1), (2)) u(cut) WHERE cut < k),
s AS (SELECT x.lang, x.gram, x.k, x.f, b.f AS l, d.f AS r, cut, (1000000 * x.f::hugeint * x.f) // (b.f::hugeint * d.f) AS score
  FROM x JOIN c b ON b.lang = x.lang AND b.gram = x.x JOIN c d ON d.lang = x.lang AND d.gram = x.y),
m AS (SELECT lang, gram, k, f, l, r, score FROM (SELECT *, row_number() OVER (PARTITION BY lang, gram ORDER BY score, cut) AS o FROM s) WHERE o = 1),
i AS (SELECT lang, sub, max(f) AS f FROM (SELECT lang, f, unnest([array_to_string(string_split(gram, ' ')[:2], ' '), array_to_string(string_split(gram, ' ')[2:], ' ')]) AS sub FROM a WHERE k = 3) GROUP BY ALL),
k AS (SELECT m.*, row_number() OVER (PARTITION BY m.lang ORDER BY score DESC, m.f DESC, gram) AS rank FROM m LEFT JOIN i ON i.lang = m.lang AND i.sub = m.gram WHERE i.f IS NULL OR 100 * i.f < 50 * m.f)
SELECT k.lang, rank, gram AS phrase, k.f AS a, l, r, n, CAST(score AS BIGINT) AS score FROM k JOIN t ON t.lang = k.lang WHERE rank <= 2000
"""
