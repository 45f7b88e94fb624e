"""Toxicity by a factorization machine over hashed terms."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small, staged, table
from .langid import held_out

BUCKETS = 1 << 22
#: The machine is fitted on at most about so many labelled documents of either label.
SAMPLE_PER_LABEL = 8000
#: Terms that the machine knows: those whose rate differs most between the labels, alone or beside another term.
TERMS = 8192
#: Of the strongest and of the most frequent terms, so many each are looked at in pairs.
PAIRED = 768
FACTORS = 8
STEM = 5

_TOKEN = re.compile(r"[^\W\d_]+")


@lru_cache(maxsize=100_000)
def _terms_of(word: str) -> tuple[int, ...]:
    """Buckets of a blank-separated word: its letter runs, and the first letters of longer ones."""
    out = []
    for run in _TOKEN.findall(word):
        out.append(run)
        if len(run) > STEM:
            out.append(run[:STEM] + "*")
    return tuple(_bucket(x) for x in out)


def _bucket(term: str) -> int:
    h = 0xCBF29CE484222325
    for b in term.encode():
        h = ((h ^ b) * 0x100000001B3) & 0xFFFFFFFFFFFFFFFF
    return (h ^ (h >> 32)) % BUCKETS


def terms(text: str | None) -> set[int]:
    """The distinct hashed terms of a whole text; none for a null or empty one."""
    return {t for word in set((text or "").lower().split()) for t in _terms_of(word)}


def train(rows: list[np.ndarray], label: np.ndarray, n_terms: int, factors: int = FACTORS, epochs: int = 12, rate: float = 0.05, decay: float = 1e-4, seed: int = 7) -> tuple[float, np.ndarray, np.ndarray]:
    """w0, w and V of a factorization machine with 0/1 inputs, by Adam on the balanced logistic loss."""
    rng = np.random.default_rng(seed)
    w0, w, v = 0.0, np.zeros(n_terms), rng.normal(0, 0.05, (n_terms, factors))
    state = [[0.0, 0.0], [np.zeros_like(w), np.zeros_like(w)], [np.zeros_like(v), np.zeros_like(v)]]
    weight = np.where(label == 1, 0.5 / max(label.mean(), 1e-9), 0.5 / max(1 - label.mean(), 1e-9))
    by = lambda at, rows, n: np.stack([np.bincount(at, rows[:, f], n) for f in range(factors)], 1)  # noqa: E731  sums of rows by place
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for at in range(0, len(order), 256):
            batch = order[at : at + 256]
            flat = np.concatenate([rows[i] for i in batch]) if len(batch) else np.zeros(0, int)
            of = np.repeat(np.arange(len(batch)), [len(rows[i]) for i in batch])
            sums = by(of, v[flat], len(batch))
            squares = np.bincount(of, (v[flat] ** 2).sum(1), len(batch))
            z = w0 + np.bincount(of, w[flat], len(batch)) + 0.5 * ((sums**2).sum(1) - squares)
            g = weight[batch] * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - label[batch]) / len(batch)
            gw = np.bincount(flat, g[of], n_terms) + decay * w
            gv = by(flat, g[of, None] * (sums[of] - v[flat]), n_terms) + decay * v
            step += 1
            moved = []
            for old, grad, s in zip((w0, w, v), (g.sum(), gw, gv), state):
                s[0] = 0.9 * s[0] + 0.1 * grad
                s[1] = 0.999 * s[1] + 0.001 * grad**2
                moved.append(old - rate * (s[0] / (1 - 0.9**step)) / (np.sqrt(s[1] / (1 - 0.999**step)) + 1e-8))
            w0, w, v = moved
    return float(w0), w, v


def interacting(rows: list, label: np.ndarray, terms: list[int], least_z: float = 5.0) -> list[int]:
    """Those terms that tell beside another: among the rows that hold one term, the label's rate differs with and without
    the other by `least_z` standard errors, which speaks for the other one."""
    at = {t: i for i, t in enumerate(terms)}
    x = np.zeros((len(rows), len(terms)), np.float32)
    for i, ts in enumerate(rows):
        x[i, [at[t] for t in ts if t in at]] = 1
    n, a = x.T @ x, x[label == 1].T @ x[label == 1]  # rows that hold both terms, and those of them with label 1
    m, c = np.diag(n)[:, None], np.diag(a)[:, None]
    with np.errstate(all="ignore"):
        p = c / m
        z = np.abs(a / n - (c - a) / (m - n)) / np.sqrt(p * (1 - p) * (1 / n + 1 / (m - n)))
    found = (np.nan_to_num(z, nan=0.0, posinf=0.0) > least_z) & (n >= 5) & (m - n >= 5)
    return [terms[i] for i in np.flatnonzero(found.any(0))]


def term_counts(docs: DataFrame, known: DataFrame) -> DataFrame:
    """term, a, b: in how many of the labelled documents with label 1 and 0 each term occurs; term -1 counts the
    documents. Each task sums up its own documents, so a term costs one row a task. `known` (id_, toxic) is joined by
    doc_id, a shuffle of the labels and the labelled texts where the labels are no small table."""

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros((2, BUCKETS + 1), np.int32)
        for batch in batches:
            for toxic, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                n[toxic, [*terms(text.as_py()), BUCKETS]] += 1
        at = np.flatnonzero(n.any(0))
        name = np.where(at == BUCKETS, -1, at)
        yield pa.RecordBatch.from_arrays([pa.array(name, pa.int32()), pa.array(n[1, at], pa.int64()), pa.array(n[0, at], pa.int64())], ["term", "a", "b"])

    one = staged(known.groupBy("id_").agg(F.max("toxic").alias("toxic")))
    texts = docs.where("text IS NOT NULL").join(small(one, 16), F.col("doc_id") == F.col("id_")).select("toxic", "text")
    return texts.mapInArrow(summed, "term int, a long, b long").groupBy("term").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))


def fit(docs: DataFrame, labels: DataFrame, sample_per_label: int = SAMPLE_PER_LABEL, n_terms: int = TERMS) -> dict:
    """The machine, from docs (doc_id, text) and labels (doc_id, toxic).

    Terms are chosen by counts over all labelled documents, for rates that differ between the labels. A term may tell
    nothing but beside another one, so the strongest and the most frequent terms are also looked at in pairs on the sample
    (`interacting`), and those that tell in one are known too. The machine is fitted on a bounded sample of either label, drawn from `labels` by a hash of doc_id. Only that
    (two numbers a row, in a number bounded by the parameter) is broadcast to the texts, which are turned into hashed
    terms where they lie; one task then fits on those sparse rows. The driver gets the weights alone: `n_terms` x
    (factors + 1) numbers. Rows with a null label, text or doc_id teach nothing; of labels that share a doc_id the largest
    counts, of texts that do, the sample takes the least by its hash.
    """
    known = labels.where("toxic IN (0, 1) AND doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("id_"), F.col("toxic").cast("int").alias("toxic"))
    shares = F.broadcast(staged(known.groupBy("toxic").count().select(F.col("toxic").alias("toxic_"), (F.lit(float(sample_per_label)) / F.col("count")).alias("share"))))
    drawn = known.join(shares, F.col("toxic") == F.col("toxic_")).where(F.pmod(F.xxhash64("id_"), F.lit(1 << 20)) < F.col("share") * (1 << 20))
    drawn = staged(drawn.groupBy("id_").agg(F.max("toxic").alias("toxic")))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [sorted(terms(t.as_py())) for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.list_(pa.int32()))], ["doc_id", "toxic", "terms"])

    texts = docs.where("text IS NOT NULL").join(F.broadcast(drawn), F.col("doc_id") == F.col("id_")).select(F.col("id_").alias("doc_id"), "toxic", "text")
    texts = texts.groupBy("doc_id", "toxic").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    sample = staged(texts.select("doc_id", "toxic", "text").mapInArrow(hashed, "doc_id long, toxic int, terms array<int>"))

    # Choosing the terms is a count by term and label, over all labelled documents.
    counts = staged(term_counts(docs, known.select("id_", "toxic")))
    n = counts.where("term < 0").first()
    n1, n0 = (max(n.a, 1), max(n.b, 1)) if n else (1, 1)
    rate = (F.col("a") + F.col("b") + 1) / (n1 + n0 + 2)
    score = F.abs(F.col("a") / n1 - F.col("b") / n0) / F.sqrt(rate * (1 - rate) * (1 / n1 + 1 / n0))
    by = counts.where("term >= 0 AND a + b >= 3").select("term", (F.col("a") + F.col("b")).alias("n"), score.alias("z"))
    strong = [r[0] for r in by.where("z > 3").orderBy(F.desc("z"), "term").limit(n_terms).collect()]
    often = [r[0] for r in by.orderBy(F.desc("n"), "term").limit(PAIRED).collect()]
    pairs = list(dict.fromkeys([*strong[:PAIRED], *often]))

    def learn(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("doc_id")
        label = pdf["toxic"].to_numpy(dtype=np.float64)
        known = list(dict.fromkeys([*strong, *interacting(list(pdf["terms"]), label, pairs)]))[:n_terms]
        place = {t: i for i, t in enumerate(known)}
        rows = [np.array([place[t] for t in ts if t in place], dtype=np.int64) for ts in pdf["terms"]]
        w0, w, v = train(rows, label, max(len(place), 1))
        return pd.DataFrame({"w0": [w0], "w": [w.tobytes()], "v": [v.tobytes()], "known": [known]})

    made = sample.withColumn("machine", F.lit("all")).groupBy("machine").applyInPandas(learn, "w0 double, w binary, v binary, known array<int>").first()
    if made is None:  # no labelled text
        return {"place": {}, "w0": -10.0, "w": np.zeros(1), "v": np.zeros((1, FACTORS))}
    place = {t: i for i, t in enumerate(made.known)}
    w = np.frombuffer(made.w)
    return {"place": place, "w0": made.w0, "w": w, "v": np.frombuffer(made.v).reshape(len(w), -1)}


def score_text(model: dict, text: str | None) -> float:
    at = [model["place"][t] for t in terms(text) if t in model["place"]]
    z = model["w0"]
    if at:
        v = model["v"][at]
        z += model["w"][at].sum() + 0.5 * float((v.sum(0) ** 2 - (v**2).sum(0)).sum())
    return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def score_toxicity(docs: DataFrame, model: dict, *keep: str) -> DataFrame:
    """The columns `keep`, and score (0 to 1). Null and empty texts get the machine's bias."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = pa.array([score_text(held.value, t.as_py()) for t in batch.column(len(keep))], pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], scores], [*keep, "score"])

    return docs.select(*keep, F.col("text").alias("text_")).mapInArrow(predict, f"{schema}, score double")


def op6_factorization_toxicity(spark, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted of all documents, learned from labels of those that are not held out.

    Null and empty texts: the score of the machine's bias. A null doc_id is not held out and teaches nothing. Repeated
    rows and equal texts have equal scores; a score of exactly 0.5 predicts 1. Texts of any length count whole. Empty
    table: no rows; no label: scores near 0. Further columns are not read.
    """
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").select("doc_id", "toxic")
    model = fit(docs, labels.where(~held_out(5, 0)))
    scored = score_toxicity(docs, model, "doc_id")
    return scored.select("doc_id", held_out(5, 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
