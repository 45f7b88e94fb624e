"""Language ID, n-gram join, packing, toxicity, secrets, WARC and the pipeline, with odd inputs."""

import base64
import collections
import gzip
import hashlib
import random
import re
import zlib
from array import array

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidemark.llm import langid as L
from tidemark.llm import ngramjoin as N
from tidemark.llm import packing as K
from tidemark.llm import secrets as X
from tidemark.llm import toxicity as T
from tidemark.llm import warc as W

PATH = public_tokenizers.path("word_bpe_49k.json")
DATA = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, doc string, key string, row int, name string"


def documents(spark, rows):
    """rows of (doc_id, text[, lang[, source]]), with extra columns whose names clash with the operators' own."""
    full = [(*r, *[None, "s"][len(r) - 2 :]) for r in rows]
    return spark.createDataFrame([(*r, 0, "d", "k", 1, "n") for r in full], SCHEMA)


# Language ID


def test_languages_of_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = L.identify(docs, L.fit(docs.where(~L.held_out(4, 2))), "doc_id", "lang").where(L.held_out(4, 2)).toPandas()
    assert (out.lang == out.lang_pred).mean() > 0.98
    assert not out.rejected.any() and out.score.between(0, 1).all()


def test_language_of_odd_texts(spark):
    rng = random.Random(1)
    train = [(i, " ".join(rng.choice(["der", "und", "nicht", "ist"] if i % 2 else ["the", "and", "not", "is"]) for _ in range(30)), "de" if i % 2 else "en") for i in range(80)]
    odd = [(100, None, "en"), (101, "", None), (102, "12 !? \n", "en"), (103, "der und nicht ist " * 20000, None), (None, "the and not", "en"), (104, "das ist the", None)]
    docs = documents(spark, train + odd)
    model = L.fit(docs)
    out = {r.doc_id: r for r in L.identify(docs, model, "doc_id", "key").collect()}
    assert [out[i].lang_pred for i in (100, 101, 102, 103, None)] == ["und", "und", "und", "de", "en"]
    assert out[100].rejected and out[100].score == 0 and out[103].key == "k"
    assert L.identify(docs.limit(0), model, "doc_id").count() == 0
    empty = L.fit(docs.limit(0))
    assert {r.lang_pred for r in L.identify(docs, empty, "doc_id").collect()} == {"und"}


# N-gram join


def shingles(text, n):
    w = tuple(re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower()))
    return {w[i : i + n] for i in range(max(1, len(w) - n + 1))} if w else set()


def components(rows, n, num):
    sets = {i: shingles(t, n) for i, t in rows if i is not None}
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(s), root(i)) for i, s in sets.items()}


@pytest.mark.parametrize(("n", "num"), [(3, 90), (5, 80)])
def test_join_against_brute_force(spark, n, num):
    rng = random.Random(n)
    rows, i = [], 0
    for size in (1, 2, 3, 6, 12, 13, 25, 40, 90, 200, 400):
        base = [f"w{rng.randrange(4000)}" for _ in range(size)]
        for _ in range(12):
            w = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 4, 9])):
                k = rng.randrange(len(w))
                w[k : k + rng.choice([0, 1, 2])] = [f"v{rng.randrange(10**6)}"] * rng.choice([0, 1, 1])
                w = w or ["z"]
            rows.append((i, rng.choice([" ", "\n", " \t"]).join(w)))
            i += 1
    rows += [(9000, None), (9001, ""), (9002, " \n "), (9003, "A b"), (9004, "a B"), (9005, "É b c"), (9006, "é b c")]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in N.jaccard_components(documents(spark, [*rows, (None, "a b")]), n, num).collect()}
    assert got.pop(None) == (1, None)
    assert got == components(rows, n, num)


def test_one_of_each_and_empty(spark):
    docs = documents(spark, [(3, "a b c d e f"), (3, "a b c d e f"), (1, "a b c d e f"), (4, "x"), (5, None), (None, "q")])
    kept = N.one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id is None, r.doc_id) for r in kept.select("doc_id").collect() if r.doc_id is not None) == [(False, 1), (False, 4), (False, 5)]
    assert N.one_of_each(docs.limit(0)).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.integers(4, 300), st.integers(0, 60), st.integers(0, 60), st.sampled_from([80, 90]), st.integers(0, 10**6))
def test_linking_sets_share_a_key(n, drop, add, num, seed):
    rng = np.random.default_rng(seed)
    x = rng.integers(0, 2**63, n).astype(np.uint64)
    y = np.concatenate((x[drop:], rng.integers(0, 2**63, add).astype(np.uint64)))
    a, b = np.unique(x), np.unique(y)
    both = len(np.intersect1d(a, b))
    if 100 * both >= num * (len(a) + len(b) - both) and not len(a) == len(b) == both:
        scheme = SCHEMES[num]
        assert np.intersect1d(scheme.keys(a), scheme.keys(b)).size


SCHEMES = {num: N.Scheme(num, 100, 10**6) for num in (80, 90)}


def test_sets_beyond_the_last_band_have_keys():
    rng = np.random.default_rng(3)
    for n in (60, 90, 100, 300, 1000):
        a = rng.integers(0, 1 << 63, n, np.uint64)
        b = np.concatenate((a[n // 25 :], rng.integers(0, 1 << 63, n // 25, np.uint64)))
        x, y = (N.Scheme(90, 100, 1000, 64).keys(np.unique(t)) for t in (a, b))
        assert len(np.intersect1d(x, y))


# Packing


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=" abcXYZ'\"stdrelm\n\t\r.,!?<|>09\xa0\x85\x1cÄßİŉΣςéà²½—’“”€中́‍_^`", max_size=40))
def test_ids_as_the_tokenizer_gives_them(text):
    tokens = K._tokenizer(PATH)
    assert tokens.ids(text) == array("I", tokens.whole.encode(text, add_special_tokens=False).ids).tobytes()


def test_language_of_a_text_within_its_row(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").withColumnRenamed("text", "Text")
    model = L.fit(docs.where(~L.held_out(4, 2)))
    plain = {r.doc_id: (r.lang_pred, r.score) for r in L.identify(docs, model, "doc_id").collect()}
    told = L.identify(docs.select(F.struct("*").alias("doc")), model, "doc", inside="doc")
    assert {r.doc.doc_id: (r.lang_pred, r.score) for r in told.collect()} == plain and len(plain) == docs.count()


def test_workers_keep_no_tokenizer(spark):
    rows = documents(spark, [(i, f"some text {i}", "en") for i in range(40)]).repartition(8)
    assert K.tokenized_pieces(rows, PATH).count() == 40

    def kept(batches):
        from tidemark.llm import packing

        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([len(packing._loaded)] * batch.num_rows)], ["n"])

    assert rows.select("doc_id").mapInArrow(kept, "n long").agg(F.max("n")).first()[0] == 0


def test_packing_is_a_partition_of_the_ids(spark):
    rng = random.Random(4)
    rows = [(i, " ".join(f"word{rng.randrange(500)}" for _ in range(rng.choice([0, 5, 60, 300, 900])))) for i in range(120)] + [(500, None), (501, "long text " * 4000), (502, ""), (7, "twice"), (7, "twice")]
    docs = documents(spark, rows)
    pieces = K.tokenized_pieces(docs, PATH).cache()
    placed = K.best_fit(pieces.drop("ids")).cache()
    whole = Tokenizer.from_file(PATH)
    want = collections.Counter()
    for i, t in rows:
        ids = [*whole.encode(t or "", add_special_tokens=False).ids, 0]
        for p, at in enumerate(range(0, len(ids), K.LENGTH)):
            part = ids[at : at + K.LENGTH]
            want[i, p, at, len(part), zlib.crc32(array("I", part).tobytes())] += 1
    got = placed.collect()
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    by = collections.defaultdict(list)
    for r in got:
        by[r.sequence_id].append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= K.LENGTH
    offline: list[int] = []  # first-fit decreasing, with every bin open
    for r in sorted(got, key=lambda r: -r.length):
        k = next((k for k, room in enumerate(offline) if room >= r.length), None)
        if k is None:
            offline.append(K.LENGTH)
            k = -1
        offline[k] -= r.length
    assert len(by) <= len(offline) * 1.05 + 1
    filled = {r.sequence_id: len(r.ids) // 4 for r in K.sequences(pieces, placed).collect()}
    assert filled == {s: sum(n for _, n in parts) for s, parts in by.items()}
    assert K.pack_documents(docs.limit(0), PATH).count() == 0


def test_open_bins_are_best_fit_and_bounded():
    rng = random.Random(5)
    bins, free, is_open = K.OpenBins(100, 4), {}, []
    for _ in range(3000):
        size = rng.randrange(1, 101)
        found, at = bins.place(size)
        fits = [b for b in is_open if free[b] >= size]
        if fits:
            assert free[found] == min(free[b] for b in fits)
            is_open.remove(found)
        else:
            assert found not in free
            free[found] = 100
        assert at == 100 - free[found]
        free[found] -= size
        if free[found]:
            if len(is_open) == 4:
                is_open = [b for b in is_open if b in {x for v in bins.by_free.values() for x in v}]
            is_open.append(found)
        assert len(is_open) <= 4 and bins.count <= 4


# Toxicity


def test_machine_learns_an_interaction():
    rng = np.random.default_rng(6)
    rows, label = [], []
    for _ in range(3000):
        have = rng.random(6) < 0.4
        rows.append(np.flatnonzero(have))
        label.append(float(have[0] and have[1]))
    w0, w, v = T.train(rows, np.array(label), 6, epochs=25)
    z = [w0 + w[r].sum() + 0.5 * ((v[r].sum(0) ** 2 - (v[r] ** 2).sum(0)).sum()) for r in rows]
    assert np.mean((np.array(z) > 0) == (np.array(label) > 0)) > 0.97


def test_held_out_toxicity(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    model = T.fit(docs, labels.where(~L.held_out(5, 0)))
    out = T.score_toxicity(docs, model, "doc_id").join(labels, "doc_id").where(L.held_out(5, 0)).toPandas()
    assert (out.score >= 0.5)[out.toxic == 0].mean() < 0.05
    assert (out.score >= 0.5)[out.toxic == 1].mean() > 0.5


def test_toxicity_of_odd_rows(spark):
    docs = documents(spark, [(i, "you awful clod" if i % 3 == 0 else "you fine person") for i in range(60)] + [(90, None), (91, ""), (None, "awful clod"), (3, "you awful clod"), (92, "fine " * 50000)])
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(60)] + [(None, 1), (200, 1), (61, None)], "doc_id long, toxic int")
    model = T.fit(docs, labels)
    out = {r.doc_id: r.score for r in T.score_toxicity(docs, model, "doc_id").collect()}
    assert out[0] > 0.5 and out[None] > 0.5 and out[1] < 0.5 and out[90] == out[91] and out[92] < 0.5
    none = T.fit(docs, labels.limit(0))
    assert all(r.score < 0.5 for r in T.score_toxicity(docs, none, "doc_id").collect())


# Secrets


def plain_spans(text):
    out = []
    for kind, pattern, least in (("assign", r"(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 6), ("access", r"(AKIA[A-Z0-9]+)", 20), ("hex", r"([0-9a-f]+)", 24)):
        out += [(m.start(), ("assign", "access", "hex").index(kind), f"{kind}:{m.start()}:{m.end()}") for m in re.finditer(pattern, text) if len(m[1]) >= least]
    return ",".join(s for *_, s in sorted(out))


def test_base_spans_as_defined():
    rng = random.Random(7)
    parts = ["password", "PASSWD", "secret", "token", "api_key", "apikey", "API_KEY", "ſecret", "toKen", "=", ": ", '"', "'", " ", "AKIA", "ABCDEFGHIJ123456", "Z9", "0123456789abcdef", "deadbeef", "x", "é", "\n", "abcde", "abcdef."]
    for _ in range(4000):
        text = "".join(rng.choices(parts, k=rng.randrange(1, 14)))
        assert ",".join(f"{k}:{s}:{e}" for s, e, k, _ in X.base_spans(text)) == plain_spans(text)


def test_ownership_tells_examples_from_live_ones(spark):
    rng = random.Random(8)
    key = lambda: "AKIA" + "".join(rng.choices("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", k=16))
    shared, own, dummy = key(), key(), "token = exampleexample"
    rows = [(i, f"é use {shared} here", None, f"s{i}") for i in range(6)] + [(10, f"x {own}", None, "s1"), (11, dummy, None, "s2"), (12, None, None, "s3"), (13, "", None, None), (10, f"x {own}", None, "s1"), (14, f"{own}", None, None)]
    docs = documents(spark, rows[:10])
    out = {r.doc_id: r for r in X.find_secrets(docs, F.col("source"), F.col("doc_id")).collect()}
    assert out[0].n_access == 1 and out[0].n_shared == 1 and out[0].n_live == 0
    assert out[0].spans == "access:6:26,shared:6:26" and out[0].base_sha256 == hashlib.sha256(b"access:6:26").hexdigest()
    assert out[10].spans == "access:2:22,live:2:22" and out[10].n_live == 1
    assert out[11].spans == f"assign:0:{len(dummy)}"
    assert out[12].spans == "" and out[13].spans == ""
    assert X.find_secrets(documents(spark, rows), F.col("source"), F.col("doc_id")).count() == len(rows)
    assert X.find_secrets(docs.limit(0), F.col("source"), F.col("doc_id")).count() == 0


# WARC


def test_archive_round_trip(spark, tmp_path):
    rows = [(3, "u\r\n3", "same"), (1, "u1", "same"), (2, None, None), (4, "u4", ""), (5, "u5", "é\r\n\r\n" * 40000), (None, "u6", "same"), (6, "u7", "\x00ü"), (3, "u\r\n3", "same")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit("clash"))
    W.write_archives(W.plan_revisits(pages), str(tmp_path / "a"), archive_bytes=100_000)
    got = W.read_archives(spark, str(tmp_path / "a")).collect()
    want = []
    for i, u, h in rows:
        p = (h or "").encode()
        first = min(j for j, _, g in rows if (g or "").encode() == p and j is not None)
        again = i != first
        want.append((i, (u or "").replace("\r\n", ""), "revisit" if again else "response", first if again else None, len(p), base64.b32encode(hashlib.sha1(p).digest()).decode(), None if again else p))
    key = lambda r: repr(r[:6])
    assert sorted(((*r[:6], None if r[6] is None else bytes(r[6])) for r in got), key=key) == sorted(want, key=key)
    files = [f.read_bytes() for f in (tmp_path / "a").glob("*.txt")]
    assert sum(len(list(W.read_records(f))) for f in files) == len(rows)
    assert all(gzip.decompress(f).startswith(b"WARC/1.1") for f in files if f)
    W.write_archives(W.plan_revisits(pages.limit(0)), str(tmp_path / "none"))
    assert W.read_archives(spark, str(tmp_path / "none")).count() == 0


def test_small_payloads_are_never_revisits(spark):
    pages = spark.createDataFrame([(1, "u", "abc"), (2, "v", "abc"), (3, "w", "abcdefgh"), (4, "x", "abcdefgh")], "page_id long, url string, html string")
    out = {r.page_id: r.refers_to for r in W.plan_revisits(pages, min_revisit_bytes=4).collect()}
    assert out == {1: None, 2: None, 3: None, 4: 3}


def test_damaged_archives_are_refused():
    good = W.record(1, "u", b"payload", None, "2024-01-01T00:00:00Z")
    assert [b.endswith(b"payload") for _, b in W.read_records(good * 2)] == [True, True]
    raw = gzip.decompress(good)
    for bad in (gzip.compress(raw.replace(b"payload", b"paylaod")), gzip.compress(raw[:-2]), good[:-9], gzip.compress(raw.replace(b"WARC/1.1", b"WARC/9.9"))):
        with pytest.raises((ValueError, zlib.error)):
            list(W.read_records(bad))


def test_records_above_16_mib(spark, tmp_path):
    pages = spark.createDataFrame([(1, "u", "x" * (17 << 20)), (2, "v", "y")], "page_id long, url string, html string")
    W.write_archives(W.plan_revisits(pages), str(tmp_path / "big"))
    assert {r.page_id: r.payload_bytes for r in W.read_archives(spark, str(tmp_path / "big")).select("page_id", "payload_bytes").collect()} == {1: 17 << 20, 2: 1}


# Pipeline


def test_pipeline_stages(spark):
    import corpus_pipeline as C

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    assert 4 <= len(C.STAGES) <= 5
    n = docs.count()
    language = C.language(spark, docs, DATA)
    assert language.columns == docs.columns and language.count() >= 0.99 * n
    lines = C.lines(spark, language, DATA)
    assert lines.columns == docs.columns and n * 0.5 < lines.count() <= n
    near = C.near_duplicates(spark, lines, DATA)
    assert near.columns == docs.columns and near.count() <= lines.count()
    assert C.mix(spark, near, DATA).columns == docs.columns
    assert C.pack(spark, near, DATA).select("doc_id").distinct().count() == near.select("doc_id").distinct().count()
