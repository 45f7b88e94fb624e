"""Text quality by Bradley-Terry pairwise ranking: scores from preference pairs, a threshold by their quantile."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small, spread, staged, table
from .langid import held_out

#: The ranker is fitted on at most about so many labelled documents of either label.
SAMPLE_PER_LABEL = 8000
#: Cut points of each measure.
CUTS = 24
#: The score that stands for the threshold.
AT_THRESHOLD = 0.3

_SYMBOLS, _STOPS, _DIGITS = b"#*$%&|<>", b".,;:?", b"0123456789"
_UPPER = bytes(range(65, 91))
_BLANKS = bytes(0x20 if c in b"\t\x0b\x0c\r" else c for c in range(256))
MEASURES = ("words", "symbols", "pipes", "bangs", "stops", "digits", "capitals", "word_bytes", "distinct", "commonest", "again", "same_lines", "line_words", "short_lines", "squeezed")


def measures(text: str | bytes | None) -> np.ndarray:
    """MEASURES of a whole text; a null text reads as empty, whose measures are all 0."""
    raw = (text or b"") if isinstance(text, bytes) else (text or "").encode("utf-8", "surrogatepass")
    clean = raw.translate(_BLANKS)
    words = clean.split()
    if not words:
        return np.zeros(len(MEASURES))
    lines = [x for x in clean.split(b"\n") if x.strip()]
    n, size = len(words), len(raw)
    without = lambda chars: size - len(raw.translate(None, chars))
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, n)
    counts = np.bincount(ids)
    return np.array([
        np.log(n), without(_SYMBOLS) / n, raw.count(b"|") / n, raw.count(b"!") / n, without(_STOPS) / n, without(_DIGITS) / size, without(_UPPER) / size,
        sum(map(len, words)) / n, np.log1p(len(number)) / np.log1p(n), counts.max() / (n + 20), float((ids[1:] == ids[:-1]).sum()) / n,
        1 - len(set(lines)) / len(lines), np.log(n / len(lines)), sum(len(x.split(None, 3)) < 3 for x in lines) / len(lines), len(zlib.compress(raw, 1)) / (size + 20),
    ])


def coded(x: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """Rows of measures as 0/1 features: whether each measure is above each of its cut points."""
    return (x[:, :, None] > cuts[None]).reshape(len(x), -1).astype(np.float32)


def learn(good: np.ndarray, bad: np.ndarray, steps: int = 400, pairs: int = 1024, rate: float = 0.05, decay: float = 1e-3, seed: int = 7) -> np.ndarray:
    """Weights w that make w x of a preferred row the larger one: the Bradley-Terry likelihood of pairs (good, bad) drawn
    evenly, that is the logistic loss of feature differences, by Adam."""
    rng, w = np.random.default_rng(seed), np.zeros(good.shape[1])
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, steps + 1):
        d = good[rng.integers(len(good), size=pairs)] - bad[rng.integers(len(bad), size=pairs)]
        g = -(d.T @ (1 / (1 + np.exp(np.clip(d @ w, -30, 30))))) / pairs + decay * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g**2
        w = w - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w


def _measured(docs: DataFrame, *keep: str) -> DataFrame:
    """The columns `keep`, and x: the measures of text."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [measures(t.as_py()) for t in batch.column(len(keep)).cast(pa.binary())]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(found, pa.list_(pa.float64()))], [*keep, "x"])

    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    return docs.select(*keep, F.col("text").alias("text_")).mapInArrow(rows, f"{schema}, x array<double>".removeprefix(", "))


def _weigh(model: dict, x: np.ndarray) -> np.ndarray:
    return coded(x, model["cuts"]) @ model["w"]


def fit(docs: DataFrame, labels: DataFrame, sample_per_label: int = SAMPLE_PER_LABEL) -> dict:
    """cuts, w and threshold, from docs (doc_id, text) and labels (doc_id, quality).

    Every labelled document is measured where it lies. Cut points (quantiles) and weights are fitted in one task on a
    sample of at most about `sample_per_label` documents of either label, drawn by a hash of doc_id. The threshold is a
    quantile of the scores of all labelled documents: the one of the share of label 0 among them, halfway up to the
    next score. Rows with a null label, text or doc_id teach nothing; of labels that share a doc_id the largest counts.
    With one label alone there is no pair: all scores are equal, and at the threshold if that label is 1.
    """
    known = labels.where("quality IN (0, 1) AND doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("id_")).agg(F.max("quality").cast("int").alias("good"))
    known = staged(known)
    texts = spread(docs.select("doc_id", "text").where("text IS NOT NULL")).join(small(known, 16), F.col("doc_id") == F.col("id_")).select("id_", "good", "text")
    seen = staged(_measured(texts, "id_", "good"))
    n = {r.good: r["count"] for r in seen.groupBy("good").count().collect()}  # two rows at most
    if len(n) < 2:
        return {"cuts": np.zeros((len(MEASURES), 1)), "w": np.zeros(len(MEASURES)), "threshold": 0.0 if 1 in n or not n else 1.0}
    share = F.when(F.col("good") == 1, sample_per_label / n[1]).otherwise(sample_per_label / n[0])
    sample = seen.where(F.pmod(F.xxhash64("id_"), F.lit(1 << 20)) < share * (1 << 20))

    def ranker(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.assign(k=[tuple(x) for x in pdf["x"]]).sort_values(["id_", "good", "k"])
        x, good = np.stack(pdf["x"].to_numpy()), pdf["good"].to_numpy() == 1
        cuts = np.concatenate([np.quantile(x[side], np.linspace(0, 1, CUTS // 2), axis=0).T for side in (good, ~good)], 1)
        c = coded(x, cuts)
        return pd.DataFrame({"cuts": [cuts.tobytes()], "w": [learn(c[good], c[~good]).tobytes()]})

    made = sample.withColumn("one", F.lit(1)).groupBy("one").applyInPandas(ranker, "cuts binary, w binary").first()
    model = {"cuts": np.frombuffer(made.cuts).reshape(len(MEASURES), -1), "w": np.frombuffer(made.w)}
    held = docs.sparkSession.sparkContext.broadcast(model)

    def scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array(_weigh(held.value, np.array(batch.column(0).to_pylist())), pa.float64())], ["s"])

    told = staged(seen.select("x").mapInArrow(scores, "s double"))
    at = told.agg(F.percentile_approx("s", float(n[0] / (n[0] + n[1])), 100_000)).first()[0]
    above = told.where(F.col("s") > at).agg(F.min("s")).first()[0]
    return model | {"threshold": at if above is None else (at + above) / 2}


def score_quality(docs: DataFrame, model: dict, *keep: str) -> DataFrame:
    """The columns `keep`, and score (0 to 1): the Bradley-Terry odds of a document against one at the threshold, moved so
    that the threshold itself scores 0.3. A null text scores as an empty one."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    shift = float(np.log(AT_THRESHOLD / (1 - AT_THRESHOLD))) + 1e-9

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(len(keep)).cast(pa.binary())
            x = np.stack([measures(t.as_py()) for t in texts]) if len(texts) else np.zeros((0, len(MEASURES)))
            z = _weigh(held.value, x) - held.value["threshold"] + shift
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(1 / (1 + np.exp(-np.clip(z, -30, 30))), pa.float64())], [*keep, "score"])

    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    return spread(docs.select(*keep, F.col("text").alias("text_"))).mapInArrow(rows, f"{schema}, score double")


def op13_bradley_terry_quality(spark, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted of all documents, learned from labels of those that are not held out.

    Null, empty and blank texts score alike. A null doc_id is not held out and teaches nothing. Repeated rows and equal
    texts have equal scores. A text of any length counts whole. Empty table: no rows; without labels of both kinds all
    scores are equal. Further columns are not read.
    """
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").select("doc_id", "quality")
    scored = score_quality(docs, fit(docs, labels.where(~held_out(5, 0))), "doc_id")
    return scored.select("doc_id", held_out(5, 0).alias("held_out"), "score", (F.col("score") >= AT_THRESHOLD).cast("int").alias("predicted"))
