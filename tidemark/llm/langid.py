"""Language identification by nearest centroid over normalised TF-IDF character n-grams."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import staged, table

BUCKETS = 1 << 13
#: The classifier is fitted on about so many documents of each language; everything else covers all documents.
SAMPLE_PER_LANG = 1500
CENTROIDS = 4


@cache
def _letters() -> np.ndarray:
    """1 for each code point that is a letter."""
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), np.uint8, 0x110000)


def ngram_counts(text: str) -> tuple[np.ndarray, np.ndarray] | None:
    """Buckets and counts of the 1- to 3-grams of a whole text, lower-cased, all but letters read as blanks; None without a letter."""
    code = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letters()[code]
    if not letter.any():
        return None
    code = np.where(letter, code, 32).astype(np.uint64)
    code = np.concatenate(([np.uint64(32)], code, [np.uint64(32)]))
    two = code[:-1] * np.uint64(0x9E3779B1) + code[1:]
    three = two[:-1] * np.uint64(0x85EBCA6B) + code[2:]
    mixed = np.concatenate((code * np.uint64(0xC2B2AE3D27D4EB4F), two * np.uint64(0x9FB21C651E98DF25), three * np.uint64(0xD6E8FEB86659FD93)))
    count = np.bincount((mixed >> np.uint64(51)).astype(np.int64), minlength=BUCKETS)
    where = np.flatnonzero(count)
    return where, count[where]


def _unit(where: np.ndarray, count: np.ndarray, idf: np.ndarray) -> np.ndarray:
    v = (1 + np.log(count)).astype(np.float32) * idf[where]
    return v / max(float(np.linalg.norm(v)), 1e-12)


def cluster(vectors: np.ndarray, k: int, rounds: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """Spherical k-means from spread-out first centroids: the unit centroids, and each row's cosine to its own."""
    first = [0]
    near = vectors @ vectors[0]
    while len(first) < min(k, len(vectors)):
        first.append(int(near.argmin()))
        near = np.maximum(near, vectors @ vectors[first[-1]])
    centre = vectors[first]
    for _ in range(rounds):
        own = (vectors @ centre.T).argmax(1)
        sums = np.stack([vectors[own == j].sum(0) if (own == j).any() else centre[j] for j in range(len(centre))])
        centre = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)
    return centre.astype(np.float32), (vectors @ centre.T).max(1)


def document_frequencies(labelled: DataFrame) -> tuple[int, np.ndarray]:
    """The number of labelled documents that have a letter, and in how many of them each bucket occurs. Each task sums
    up its own documents, so a task sends one row a bucket."""

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(BUCKETS + 1, np.int64)
        for batch in batches:
            for text in batch.column(0):
                c = ngram_counts(text.as_py())
                if c:
                    n[c[0]] += 1
                    n[BUCKETS] += 1
        yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(n), pa.int32()), pa.array(n[n > 0], pa.int64())], ["at", "n"])

    out = np.zeros(BUCKETS + 1)
    for at, n in labelled.select("text").mapInArrow(summed, "at int, n long").groupBy("at").agg(F.sum("n")).collect():  # at most BUCKETS + 1 rows
        out[at] = n
    return int(out[BUCKETS]), out[:BUCKETS]


def fit(labelled: DataFrame, sample_per_lang: int = SAMPLE_PER_LANG, centroids: int = CENTROIDS) -> dict:
    """The model: idf, centroids, and for each its language and the cosine under which a text is rejected.

    `labelled` has doc_id, text and lang; rows without one of them teach nothing. Document frequencies are counted over
    all of them. The centroids come from a bounded sample drawn by a hash of doc_id (of rows with one doc_id and lang, the
    text that is least by its hash); each language's sample is clustered in one task (at most a few thousand sparse
    vectors). What reaches the driver is the model alone, of languages x centroids x buckets numbers. A text is rejected
    below a quarter of the cosine that all but one in a thousand texts of the centroid's language reach.
    """
    known = labelled.where("text IS NOT NULL AND lang IS NOT NULL AND doc_id IS NOT NULL")
    shares = F.broadcast(staged(known.groupBy("lang").count().select(F.col("lang").alias("lang_"), (F.lit(float(sample_per_lang)) / F.col("count")).alias("share"))))
    drawn = known.join(shares, F.col("lang") == F.col("lang_")).where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < F.col("share") * (1 << 20))
    drawn = drawn.groupBy("lang", "doc_id").agg(F.min_by("text", F.xxhash64("text")).alias("text"))

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(lang, doc, ngram_counts(text.as_py())) for lang, doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2))]
            rows = [(lang, doc, *c) for lang, doc, c in rows if c]
            arrays = [pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32())))]
            yield pa.RecordBatch.from_arrays(arrays, ["lang", "doc_id", "at", "n"])

    n, df = document_frequencies(known)
    idf = np.log((1 + n) / (1 + df)).astype(np.float32) + np.float32(0.1)

    def clusters(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("doc_id")  # they come in any order
        vectors = np.zeros((len(rows), BUCKETS), np.float32)
        for i, (at, c) in enumerate(zip(rows["at"], rows["n"])):
            vectors[i, at] = _unit(at, c, idf)
        centre, cosine = cluster(vectors, centroids)
        least = 0.25 * float(np.quantile(cosine, 0.001))
        return pd.DataFrame({"lang": rows["lang"].iloc[0], "centre": [c.tobytes() for c in centre], "least": least})

    sample = drawn.select("lang", F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(counts, "lang string, doc_id long, at array<int>, n array<int>")
    made = sample.groupBy("lang").applyInPandas(clusters, "lang string, centre binary, least double").orderBy("lang", "centre").collect()
    centre = np.stack([np.frombuffer(r.centre, np.float32) for r in made]) if made else np.zeros((0, BUCKETS), np.float32)
    return {"idf": idf, "centres": centre, "langs": [r.lang for r in made], "least": [r.least for r in made]}


def identify(docs: DataFrame, model: dict, *keep: str, inside: str | None = None) -> DataFrame:
    """The columns `keep`, and lang_pred, score (cosine to the nearest centroid, 0 to 1), rejected. The text is the column
    text of docs, or of its struct `inside`, one of `keep`, so that a text kept with its row is sent to Python once.

    Null text, or text without a letter: `und`, score 0, rejected. An empty model says `und` for all. Of centroids that
    are equally near, the first by language. Texts of any length count whole; repeated rows get equal results.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)
    fields = [docs.schema[c] for c in keep]
    place = [c.lower() for c in docs.schema[inside].dataType.names].index("text") if inside else 0

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        for batch in batches:
            langs, scores, rejected = [], [], []
            for text in batch.column(keep.index(inside)).field(place) if inside else batch.column(batch.num_columns - 1):
                c = ngram_counts(text.as_py() or "")
                if c is None or not m["langs"]:
                    lang, score, reject = "und", 0.0, True
                else:
                    cosine = m["centres"][:, c[0]] @ _unit(*c, m["idf"])
                    best = int(cosine.argmax())
                    score = min(1.0, max(0.0, float(cosine[best])))
                    lang, reject = m["langs"][best], score < m["least"][best]
                langs.append(lang)
                scores.append(score)
                rejected.append(reject)
            arrays = [*batch.columns[: len(keep)], pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(rejected, pa.bool_())]
            yield pa.RecordBatch.from_arrays(arrays, [*keep, "lang_pred", "score", "rejected"])

    told = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("rejected", T.BooleanType())]
    return docs.select(*keep, *[] if inside else [F.col("text").alias("text_")]).mapInArrow(predict, T.StructType([*fields, *told]))


def held_out(mod: int, rest: int):
    """True for documents that nothing is learned from: crc32(doc_id as text) mod `mod` is `rest`; false for a null doc_id."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % mod == rest, F.lit(False))


def op2_nearest_centroid_langid(spark, sf_dir: str) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected of all documents, learned from those that are not held out.

    Null, empty or letterless text: `und`, score 0. A null doc_id is not held out and teaches nothing. Repeated rows:
    one row each. Empty table: no rows; no labelled row: `und` for all. Further columns are not read.
    """
    docs = table(spark, sf_dir, "documents")
    model = fit(docs.where(~held_out(4, 2)))
    return identify(docs, model, "doc_id").select("doc_id", held_out(4, 2).alias("held_out"), "lang_pred", "score", "rejected")
