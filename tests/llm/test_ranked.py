"""Phrases, lexical search and the quality ranker against plain Python, over odd rows."""

import collections
import math
import random
import re

import numpy as np
import pytest

from tidemark.llm import lexical, phrases, preference
from tidemark.llm.common import staged
from tidemark.llm.queries import QUERIES

DOCS = "doc_id long, text string, lang string, rank long, n long, gram string"


def lower(s):
    return re.sub("[A-Z]", lambda m: m[0].lower(), s or "")


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    words = ["the", "of", "New", "York", "city", "hall", "éa", "b", "c", "d", "e"]
    passage = "one two three four five six seven eight nine ten"
    texts = [" ".join(rng.choice(words) + rng.choice(["", "", "", ",", ".", "\n", "\t", "; !"]) for _ in range(rng.randrange(0, 60))) for _ in range(120)]
    texts += [f"{rng.choice(words)} {passage} {rng.choice(words)}" for _ in range(12)] + [None, "", " \n\t.,", "New York", "NEW YORK city", "x " * 3000, "a b a b a b a b a b a b a b a b a b a b a b"]
    out = [(i * 2, t, rng.choice(["en", "en", "de", None, "und"]), 1, 1, "g") for i, t in enumerate(texts)]
    return out + [out[3], out[3], (None, "New York the of", "en", 1, 1, "g")]


def plain_phrases(rows, longest, least, share, top):
    out = []
    f, n = collections.defaultdict(collections.Counter), collections.Counter()
    for _, text, lang, *_ in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower(text)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang or "und"] += len(w)
            for k in range(1, longest + 1):
                for i in range(len(w) - k + 1):
                    f[lang or "und"][tuple(w[i : i + k])] += 1
    for lang, count in f.items():
        found = {g: a for g, a in count.items() if len(g) > 1 and a >= least}
        kept = []
        for g, a in found.items():
            score, _, left, right = min((1_000_000 * a * a // (count[g[:k]] * count[g[k:]]), k, count[g[:k]], count[g[k:]]) for k in range(1, len(g)))
            inside = any(len(h) > len(g) and 100 * b >= share * a and any(h[i : i + len(g)] == g for i in range(len(h))) for h, b in found.items())
            if not inside:
                kept.append((-score, -a, " ".join(g).encode(), left, right))
        for rank, (score, a, g, left, right) in enumerate(sorted(kept)[:top], 1):
            out.append((lang, rank, g.decode(), -a, left, right, n[lang], -score))
    return sorted(out)


@pytest.mark.parametrize(("longest", "least", "top", "bits"), [(3, 10, 2000, 20), (3, 3, 7, 4), (2, 2, 50, 20), (5, 4, 2000, 20)])
def test_phrases(spark, rows, longest, least, top, bits):
    out = phrases.collocations(spark.createDataFrame(rows, DOCS).repartition(5), longest, least, 50, top, bits)
    assert sorted((r.lang, r["rank"], r.phrase, r.a, r.l, r.r, r.n, r.score) for r in out.collect()) == plain_phrases(rows, longest, least, 50, top)


def test_paths_are_compact(spark):
    docs = spark.createDataFrame([("en", "p q r s t u v w")] * 4 + [("en", "a q r s t u b"), ("en", "z z z z")], "lang string, text string")
    graph = phrases.graph(docs, 3, 1, 20)
    paths = {(" ".join(r.words), r.n) for r in phrases.compact(staged(graph), 3).collect()}
    assert paths == {("p q r", 4), ("a q r", 1), ("q r s t u", 5), ("t u v w", 4), ("t u b", 1), ("z z z", 2)}


def test_phrases_of_large_counts(spark):
    """Products beyond 64 bits stay exact."""
    rows = spark.createDataFrame([("en", 2, "a b", 3_000_000_000), ("en", 1, "a", 1), ("en", 1, "b", 3_000_000_007), ("en", 0, "", 9_000_000_008)], "lang string, k int, gram string, n long")
    row = phrases.ranked_phrases(staged(rows), 2, 10, 50, 10).first()
    a, left, right = 3_000_000_000, 3_000_000_001, 6_000_000_007 - 3_000_000_000
    assert (row.a, row.l, row.r, row.score) == (a, left, right, 1_000_000 * a * a // (left * right))


def plain_search(docs, items, top):
    term = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lower(t))
    told = [(i, collections.Counter(term(t))) for i, t, *_ in docs]
    told = [(i, c, sum(c.values())) for i, c in told if c]
    n, total, df = len(told), sum(x[2] for x in told), collections.Counter(t for _, c, _ in told for t in c)
    out = []
    for item, text in set(items):
        of = {t: math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) for t in set(term(text)) if df[t]}
        scored = []
        for i, c, size in told:
            m = 10 + 90 * size * n // total
            score = sum(w * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m)) for t, w in of.items())
            if score > 0:
                scored.append((-score, i is None, i or 0))
        out += [(item, k, None if null else i, -s) for k, (s, null, i) in enumerate(sorted(scored)[:top], 1)]
    return sorted(out, key=repr)


@pytest.mark.parametrize(("cells", "item_bytes"), [(1 << 24, 1 << 18), (400, 60)])
def test_search(spark, rows, cells, item_bytes):
    rng = random.Random(9)
    items = [(i, " ".join(rng.choice(["the", "NEW", "york", "hall", "éa", "seven", "unseen", "a-b", "x"]) for _ in range(rng.randrange(1, 9)))) for i in range(25)]
    items += [(26, None), (27, ""), (28, "..."), (29, "the"), (29, "the"), (29, "york"), (None, "city of")]
    found = lexical.rank_documents(spark.createDataFrame(rows, DOCS).repartition(3), spark.createDataFrame(items, "item_id long, text string"), 10, item_bytes, cells)
    assert sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in found.collect()), key=repr) == plain_search(rows, items, 10)


def test_blocks_are_skipped():
    """Clusters of documents: whole blocks stay unread, and the best are those of a full count."""
    rng = np.random.default_rng(3)
    topics = [[f"t{k}w{j}" for j in range(30)] for k in range(40)]
    items = lexical.Items([" ".join(rng.choice(t, 8)).encode() for t in topics])
    row, term, impact = [], [], []
    for d in range(4000):
        for t in {items.number[w.encode()] for w in rng.choice(topics[d % 40], 12)} | {items.number[rng.choice(topics[rng.integers(40)]).encode()]}:
            if t >= 0:
                row.append(d), term.append(t), impact.append(int(rng.integers(1000, 900_000)))
    row, term, impact = np.array(row), np.array(term), np.array(impact)
    weight = rng.integers(100, 9000, len(items.number))
    shard = lexical.Shard(4000, len(weight))
    shard.dense[row, term] = impact
    shard.lists = {t: x for t, *x in lexical.build_shard(4000, row, term, impact, items, weight, block=16)}
    scored = 0
    for of in items.terms:
        best, score, n = shard.search(of, items.beside, weight)
        every = shard.dense[:, of].astype(np.int64) @ weight[of]
        want = np.lexsort((np.arange(4000), -every))[:10]
        assert best[np.lexsort((best, -score))].tolist() == want[every[want] > 0].tolist()
        assert n <= (every > 0).sum()
        scored += n / (every > 0).sum()
    assert scored / len(items.terms) < 0.8


def test_ranker(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 9)))
    good = lambda: ". ".join(" ".join(word() for _ in range(9)) for _ in range(8))
    bad = [lambda: " | ".join(word() for _ in range(40)), lambda: " ".join(word() + "###" for _ in range(50)), lambda: f"{word()} " * 60]
    docs = [(i, good() if i % 3 else bad[i // 3 % 3]()) for i in range(600)] + [(600, None), (601, ""), (None, "x y"), (602, good() * 200)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(400)] + [(None, 1), (5, None), (1, 0)], "doc_id long, quality int")
    model = preference.fit(frame, labels, 120)
    out = {r.doc_id: r.score for r in preference.score_quality(frame, model, "doc_id").collect()}
    assert len(out) == len(docs) and all(0 <= s <= 1 for s in out.values())
    late = range(400, 600)
    assert min(out[i] for i in late if i % 3) > max(out[i] for i in late if i % 3 == 0)
    assert all((out[i] >= preference.AT_THRESHOLD) == (i % 3 > 0) for i in late)
    assert out[600] == out[601] and out[602] >= preference.AT_THRESHOLD


def test_bradley_terry_finds_the_order():
    """Weights of plain Bradley-Terry strengths: preferences between single features follow their order."""
    rng = np.random.default_rng(1)
    strength = np.array([2.0, 1.0, 0.0, -1.0])
    good, bad = [], []
    for _ in range(4000):
        i, j = rng.choice(4, 2, replace=False)
        if rng.random() > 1 / (1 + np.exp(strength[j] - strength[i])):
            i, j = j, i
        good.append(np.eye(4)[i]), bad.append(np.eye(4)[j])
    d = np.array(good) - np.array(bad)
    w = preference.learn(d, np.zeros((1, 4)), decay=0.0)
    assert (np.argsort(-w) == np.arange(4)).all() and np.allclose(w[:-1] - w[1:], 1.0, atol=0.25)


def test_queries_over_odd_and_empty_tables(spark, rows, tmp_path):
    spark.createDataFrame(rows, DOCS).write.parquet(f"{tmp_path}/odd/documents.parquet")
    spark.createDataFrame([(2 * i, int(i % 4 > 0), 0, "clash") for i in range(len(rows))], "doc_id long, quality int, toxic int, text string").write.parquet(f"{tmp_path}/odd/labels.parquet")
    spark.createDataFrame([(1, "new york", "clash"), (2, None, "clash")], "item_id long, text string, score string").write.parquet(f"{tmp_path}/odd/benchmark.parquet")
    odd = lambda name: QUERIES[name](spark, f"{tmp_path}/odd").collect()
    told = sorted((r.lang, r["rank"], r.phrase, r.a, r.l, r.r, r.n, r.score) for r in odd("op11_de_bruijn_phrases"))
    assert told == plain_phrases(rows, 3, 10, 50, 2000)
    told = sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in odd("op12_geometric_block_search")), key=repr)
    assert told == plain_search(rows, [(1, "new york"), (2, None)], 10)
    told = odd("op13_bradley_terry_quality")
    assert collections.Counter(r.doc_id for r in told) == collections.Counter(r[0] for r in rows)
    by = collections.defaultdict(set)
    text_of = {r[0]: r[1] or "" for r in rows}
    for r in told:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
        by[text_of[r.doc_id]].add(r.score)
    assert all(len(x) == 1 for x in by.values())
    for name, schema in (("documents", DOCS), ("labels", "doc_id long, quality int, toxic int"), ("benchmark", "item_id long, text string")):
        spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/none/{name}.parquet")
    for name in ("op11_de_bruijn_phrases", "op12_geometric_block_search", "op13_bradley_terry_quality"):
        assert QUERIES[name](spark, f"{tmp_path}/none").count() == 0


def test_quality_on_held_out_rows(spark):
    d = "/root/testdata/sf0.01"
    told = QUERIES["op13_bradley_terry_quality"](spark, d).where("held_out").join(spark.read.parquet(f"{d}/labels.parquet").where("quality IS NOT NULL"), "doc_id")
    seen = [(r.score, r.predicted, r.quality) for r in told.select("score", "predicted", "quality").collect()]
    up, down = [s for s, _, q in seen if q], [s for s, _, q in seen if not q]
    auc = sum((a > b) + 0.5 * (a == b) for a in up for b in down) / (len(up) * len(down))
    assert auc > 0.97
    assert sum(p == q for _, p, q in seen) / len(seen) > 0.95
