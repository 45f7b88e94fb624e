"""Fingerprints, line dedup, mixing and quality rules against brute force, with odd inputs."""

import collections
import hashlib
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import fingerprint as P
from tidemark.llm import linedup as D
from tidemark.llm import mixing as M
from tidemark.llm import quality as Q

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row_ string, size long, key string, `n` int"


def documents(spark, rows, schema=SCHEMA):
    """rows of (doc_id, text, source), with extra columns whose names clash with the operators' own."""
    return spark.createDataFrame([(i, t, "en", s, len(t or ""), "r", 7, "k", 1) for i, t, s in rows], schema)


def prose(rng, n):
    return " ".join(rng.choice(["the", "of", "and", "a"]) if rng.random() < 0.3 else f"w{rng.randrange(10**6)}" for _ in range(n))


# Fingerprints


def shingles(text, n=5):
    w = WORD.findall(text)
    return collections.Counter(tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))) if w else collections.Counter()


def jaccard(a, b):
    return sum((a & b).values()) / sum((a | b).values()) if a or b else 1.0


def test_fingerprints_estimate_generalised_jaccard(spark):
    rng = random.Random(1)
    pairs = []
    for _ in range(40):
        w = prose(rng, 300).split()
        cut = rng.randrange(0, 300)
        pairs.append((" ".join(w), " ".join(w[:cut] + prose(rng, 300 - cut).split())))
    pairs.append(("a b c d e " * 60, "a b c d e " * 30))
    df = spark.createDataFrame(pairs, "a string, b string").withColumn("x", P.signature(F.col("a"))).withColumn("y", P.signature(F.col("b")))
    told = [r[0] for r in df.select(P.likeness(F.col("x"), F.col("y"))).collect()]
    off = np.array([t - jaccard(shingles(a), shingles(b)) for t, (a, b) in zip(told, pairs)])
    assert abs(off.mean()) < 0.03 and np.abs(off).max() < 0.2


def test_fingerprints_of_mixed_weights_in_short_texts(spark):
    rng = random.Random(11)
    for size in (12, 24):
        pairs = []
        for _ in range(100):
            shared = prose(rng, size)
            pairs.append(tuple(" ".join(f"{prose(rng, 6)} {shared}" for _ in range(4)) for _ in "ab"))
        df = spark.createDataFrame(pairs, "a string, b string")
        told = [r[0] for r in df.select(P.likeness(P.signature(F.col("a")), P.signature(F.col("b")))).collect()]
        off = np.array([t - jaccard(shingles(a), shingles(b)) for t, (a, b) in zip(told, pairs)])
        assert abs(off.mean()) < 0.025


def test_fingerprints_of_odd_texts(spark):
    texts = [None, "", " \n", "one", "one two", "one", "x " * 30000]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    found = [r[0] for r in df.select(P.fingerprint_text(P.signature(F.col("text")))).collect()]
    assert {len(f) for f in found} == {6 * P.BINS}
    assert found[0] == found[1] == found[2] == "------" * P.BINS
    assert found[3] == found[5] != found[4]


def test_next_document_and_edit(spark):
    rng = random.Random(2)
    rows = [(i * 3, prose(rng, rng.randrange(0, 30)) + "é", "s") for i in range(60)] + [(900, None, "s"), (901, "ü", "s")]
    out = {r.doc_id: r for r in P.with_next(documents(spark, rows)).withColumn("e", P.edited(F.col("text"), F.col("next_text"))).select("doc_id", "next_text", "e").collect()}
    order = sorted(((i, t or "") for i, t, _ in rows), reverse=True)
    for (i, text), (_, after) in zip(order, order[1:] + order[:1]):
        k = len(text) // 3
        assert out[i].next_text == after
        assert out[i].e == text[: len(text) - k] + after[:k]


def test_next_document_ties_nulls_and_none(spark):
    rows = [(1, "b", "s"), (1, "a", "s"), (None, "z", "s"), (2, "c", "s")]
    out = sorted((r.doc_id is None, r.doc_id or 0, r.text, r.next_text) for r in P.with_next(documents(spark, rows)).collect())
    assert out == [(False, 1, "a", "b"), (False, 1, "b", "z"), (False, 2, "c", "a"), (True, 0, "z", "c")]
    assert P.with_next(documents(spark, [])).count() == 0
    assert [r.next_text for r in P.with_next(documents(spark, [(5, "only", "s")])).collect()] == ["only"]


# Line dedup


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        row = _next(row, x, b, i)
    return row[-1]


def _next(row, x, b, i):
    out = [i + 1]
    for j, y in enumerate(b):
        out.append(min(row[j + 1] + 1, out[j] + 1, row[j] + (x != y)))
    return out


def test_simhash_of_any_length(spark):
    rng = random.Random(3)
    lists = [[rng.randrange(-(2**63), 2**63) for _ in range(n)] for n in (1, 5, 127, 128, 254, 255, 700)]
    df = spark.createDataFrame([(i, h) for i, h in enumerate(lists)], "i int, h array<long>")
    for i, sim in df.select("i", D.simhash(F.col("h"))).collect():
        h = [x & (2**64 - 1) for x in lists[i]]
        assert sim & (2**64 - 1) == sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_blocks_meet_within_two_bits(spark):
    rng = random.Random(4)
    pairs = []
    for _ in range(300):
        a = rng.randrange(2**64)
        b = a
        for bit in rng.sample(range(64), rng.randrange(0, 3)):
            b ^= 1 << bit
        pairs.append(tuple(x - 2**64 if x >= 2**63 else x for x in (a, b)))
    df = spark.createDataFrame(pairs, "a long, b long")
    assert df.where(~F.arrays_overlap(D.block_keys(F.col("a")), D.block_keys(F.col("b")))).count() == 0


def test_lines_keep_the_first_of_each_group(spark):
    rng = random.Random(5)
    lines = [prose(rng, 40) for _ in range(12)]
    near = lines[0].split()
    near[7] += "x"
    rows = [
        (10, "\n".join(lines[:4]), "s"),
        (11, "\n".join([lines[4], lines[1].upper() + "!", "short line", lines[5]]), "s"),
        (12, "\n".join([" ".join(near), lines[6], lines[6]]), "s"),
        (13, "short line\nshort line\n\n", "s"),
        (14, None, "s"),
        (15, "", "s"),
        (16, "\n".join(lines[:4]), "s"),
    ]
    docs = documents(spark, rows)
    out = {r.doc_id: r for r in D.dedup_lines(docs).collect()}
    assert out[10].text == rows[0][1]
    assert out[11].text == "\n".join([lines[4], "short line", lines[5]])
    assert out[12].text in (lines[6], "\n".join([" ".join(near), lines[6]]))  # a SimHash within the blocks, or not
    assert out[13].text == "\n" and out[14].text is None and out[15].text == ""  # equal short lines repeat too
    assert out[16].text == ""
    assert out[10].row_ == "r" and out[10]["size"] == 7
    kept = D.documents_without_repeats(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [10, 11, 12, 14, 15]


def test_lines_against_brute_force(spark):
    rng = random.Random(6)
    base = [prose(rng, rng.randrange(5, 60)) for _ in range(25)]
    rows = []
    for i in range(40):
        text = []
        for _ in range(3):
            w = rng.choice(base).split()
            for _ in range(rng.choice([0, 0, 0, 1, 2, 9])):
                w[rng.randrange(len(w))] = f"v{rng.randrange(10**6)}"
            text.append(" ".join(w))
        rows.append((i, "\n".join(text), "s"))
    docs = documents(spark, rows)
    sims = {(r.doc_id, r.line_no): r.sim & (2**64 - 1) for r in D.hashed_lines(docs).where("sim IS NOT NULL").collect()}
    texts = {(i, k): line for i, t, _ in rows for k, line in enumerate(t.split("\n"))}
    places, parent = sorted(texts), {p: p for p in texts}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    block = lambda s: [s >> a & ((1 << n) - 1) for a, n in D.BLOCKS]
    for a in places:
        for b in places:
            if a < b:
                x, y = texts[a], texts[b]
                shared = sum(p == q for p, q in zip(block(sims[a]), block(sims[b])))
                linked = x == y or (shared >= 2 and bin(sims[a] ^ sims[b]).count("1") <= D.HAMMING and distance(x.split(), y.split()) <= math.floor(max(len(x.split()), len(y.split())) * 0.2 + 1e-9))
                if linked and root(a) != root(b):
                    parent[max(root(a), root(b))] = min(root(a), root(b))
    gone = {p for p in places if root(p) != p}
    want = {i: "\n".join(line for k, line in enumerate(t.split("\n")) if (i, k) not in gone) for i, t, _ in rows}
    assert {r.doc_id: r.text for r in D.dedup_lines(docs).collect()} == want


def test_similar_lines_are_found(spark):
    """Against all pairs by edit similarity of characters alone."""
    rng = random.Random(12)
    cases = [(10, 1), (20, 1), (40, 1), (20, 2), (5, 1), (20, 4), (60, 12)]
    rows = []
    for size, changed in cases:
        for _ in range(60):
            w = ["the" if rng.random() < 0.3 else "".join(rng.choice("abcdefghij") for _ in range(rng.randrange(4, 9))) for _ in range(size)]
            v = list(w)
            for k in rng.sample(range(size), changed):
                v[k] = "".join(rng.choice("klmnopq") for _ in range(len(w[k])))
            rows += [(len(rows), " ".join(w), "s"), (len(rows) + 1, " ".join(v), "s")]
    text = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(120))
    rows += [(len(rows) + i, f"a b c d {text[:k]}{c}{text[k + 1 :]}", "s") for i, (k, c) in enumerate(((60, "!"), (30, "x")))]  # long words
    docs = documents(spark, rows)
    x, y = (docs.select(F.col("doc_id").alias(f"d{k}"), F.col("text").alias(f"t{k}")) for k in (1, 2))
    most = F.floor(F.greatest(F.length("t1"), F.length("t2")) * 0.2 + 1e-9)
    want = {r[0] for r in x.join(y, (F.col("d1") < F.col("d2")) & (F.levenshtein("t1", "t2") <= most)).select("d2").collect()}
    kept = {r.doc_id for r in D.documents_without_repeats(docs).select("doc_id").collect()}
    gone = {i for i, _, _ in rows} - kept
    assert gone <= want
    for at, case in enumerate(cases):
        of = {i for i in want if i // 120 == at}
        assert len(of) >= 20 and len(of & gone) >= 0.85 * len(of), (case, len(of), len(of & gone))
    assert len(rows) - 1 in gone


def test_crowded_buckets_lose_no_pair(spark):
    rng = random.Random(9)
    rows, want = [], collections.Counter()
    for k, of in enumerate(D.KEYS):
        lanes = [[7 if j in of else rng.randrange(4) for j in range(D.PARTS)] for _ in range(D.CROWD + 18)]
        rows += [(16 * 5 + k, 100 * k + i, sum(x << 4 * j for j, x in enumerate(lane)), len(lanes)) for i, lane in enumerate(lanes)]
        want.update((100 * k + i, 100 * k + j) for i in range(len(lanes)) for j in range(i) if sum(a == b for a, b in zip(lanes[i], lanes[j])) >= D.AGREE)
    label = spark.createDataFrame(rows, "key long, doc long, sim long, c long").select("key", F.struct("doc", F.lit(1).alias("n"), "sim").alias("d"), "c", F.col("doc").alias("of"))
    split = D.split_crowds(label)
    x, y = split.select("key", F.col("d").alias("x")), split.select("key", F.col("d").alias("y"))
    met = x.join(y, "key").where((F.col("x.doc") > F.col("y.doc")) & (D.agreeing(F.col("x.sim"), F.col("y.sim")) >= D.AGREE) & D.first_met("x", "y"))
    assert len(want) > 1000 and collections.Counter((r.a, r.b) for r in met.select(F.col("x.doc").alias("a"), F.col("y.doc").alias("b")).collect()) == want


def test_unlike_lines_crowd_no_bucket(spark):
    """Lines of common short words and rare long ones are keyed by the rare ones, so few of them share a key by chance."""
    rng = random.Random(4)
    word = lambda n: "".join(rng.choice("abcdefghij") for _ in range(n))
    common = [word(4) for _ in range(30)]
    rows = [(i, " ".join([rng.choice(common) for _ in range(40)] + [word(9) for _ in range(20)]), "s") for i in range(400)]
    held = D.parted_lines(documents(spark, rows)).select("doc_id", F.explode(D.part_keys()).alias("key"))
    assert held.groupBy("key").count().where(F.col("count") > D.CROWD).count() == 0


def test_buckets_of_near_copies_stay_whole(spark):
    """Under pairs of their parts near copies would all meet again, thirty times over; unlike lines hardly do."""
    rng = random.Random(10)
    lanes = lambda least: sum((7 if rng.random() < least else rng.randrange(16)) << 4 * j for j in range(D.PARTS))
    n = D.CROWD + 30
    members = [(key, 100 * key + i, lanes(least), n) for key, least in ((16, 0.9), (32, 0.0)) for i in range(n)]
    label = spark.createDataFrame(members, "key long, doc long, sim long, c long").select("key", F.struct("doc", F.lit(1).alias("n"), "sim").alias("d"), "c", F.col("doc").alias("of"))
    split = {r.near: r for r in D.split_crowds(label).groupBy((F.col("d.doc") < 2000).alias("near")).agg(F.count("*").alias("rows"), F.max("d.at").alias("at")).collect()}
    assert (split[True].rows, split[True]["at"]) == (n, -1)
    assert split[False].rows == 30 * n


def test_letters_bound_the_distance(spark):
    rng = random.Random(11)
    text = lambda: " ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randrange(2, 8))) for _ in range(rng.randrange(3, 14)))
    rows = [(text(), text()) for _ in range(150)]
    rows += [(x, x[: len(x) // 2] + "zzz" + x[len(x) // 2 + 2 :]) for x, _ in rows] + [("a" * 129, "b"), ("été à z", "zzz")]
    side = lambda c: F.struct(*[v.alias(f"c{i}") for i, v in enumerate(D.letter_counts(F.col(c)))])
    both = spark.createDataFrame(rows, "a string, b string").withColumn("x", side("a")).withColumn("y", side("b"))
    out = both.select("a", "b", D.letters_apart("x", "y").alias("least")).collect()
    assert all((r.least is None) == (max(len(r.a), len(r.b)) > D.SHORT_LINE) for r in out)
    assert all(r.least <= distance(r.a, r.b) for r in out if r.least is not None)
    assert sum(r.least > 0.2 * max(len(r.a), len(r.b)) for r in out[:150]) > 100  # unlike lines are told apart


def test_lines_of_an_empty_table(spark):
    assert D.dedup_lines(documents(spark, [])).count() == 0


# Mixing


def test_mix_meets_its_targets(spark):
    rng = random.Random(7)
    rows = [(i, prose(rng, rng.randrange(0, 80)), rng.choice(["a", "a", "a", "b", "c", "d", None])) for i in range(700)] + [(None, "x y", "a"), (5, None, "a")]
    docs = documents(spark, rows)
    out = M.pareto_mix(docs).collect()
    assert len(out) == len(rows)
    by = collections.defaultdict(list)
    for r in out:
        assert 0 <= r.taken <= 3 * r["size"]
        by[r.source].append(r)
    total = sum(r["size"] for r in out)
    assert abs(sum(x[0].target for x in by.values()) - total) < 1e-6 * total
    weight = dict(zip(sorted(k for k in by if k is not None) + [None], [5, 2, 1, 5, 2]))
    level = max(x[0].target / weight[k] for k, x in by.items())
    for k, x in by.items():
        assert x[0].target == pytest.approx(min(level * weight[k], 3 * x[0].source_size))
        assert abs(sum(r.taken for r in x) - x[0].target) <= 5
    again = {(r.doc_id, r["size"]): r.taken for r in M.pareto_mix(docs.repartition(5)).collect()}
    assert again == {(r.doc_id, r["size"]): r.taken for r in out}
    mixed = M.mixed_documents(docs.where("doc_id <> 5"))
    assert mixed.columns == docs.columns


def test_mix_with_propensity_prefers_it(spark):
    docs = documents(spark, [(i, "a b c d", "s" if i % 2 else "t") for i in range(2000)])
    out = M.pareto_mix(docs, (1, 4), propensity=F.when(F.col("doc_id") % 4 < 2, 3.0).otherwise(1.0)).collect()
    s = [r for r in out if r.source == "s"]
    liked, other = (sum(r.taken for r in s if (r.doc_id % 4 < 2) == x) for x in (True, False))
    assert abs(liked + other - s[0].target) <= 4 and liked > 2 * other


def test_mix_follows_inclusion_odds(spark):
    """Over seeds, each class of propensity is taken as often as its expected copies say, certain copies included."""
    n = 2400
    docs = documents(spark, [(i, "a b c d", "s" if i < n else "t") for i in range(2 * n)])
    for weights in ((1, 4), (5, 3)):
        rate = min(3.0, 2 * weights[0] / sum(weights))
        level = rate / 2.5
        for _ in range(4):  # at the cap of 3 copies the rest goes to the others
            capped = [g for g in (1, 2, 3, 4) if level * g > 3]
            level = (4 * rate - 3 * len(capped)) / sum(g for g in (1, 2, 3, 4) if g not in capped)
        taken = collections.Counter()
        for seed in (1, 2, 3):
            out = M.pareto_mix(docs, weights, propensity=F.col("doc_id") % 4 + 1, seed=seed).where("source = 's'")
            for r in out.groupBy((F.col("doc_id") % 4 + 1).alias("g")).agg(F.avg("copies").alias("c"), F.min("copies").alias("least")).collect():
                taken[r.g] += r.c / 3
                assert r.least == math.floor(min(3, level * r.g) + 1e-9)
        for g in (1, 2, 3, 4):
            assert taken[g] == pytest.approx(min(3, level * g), abs=0.03)


def test_mix_of_odd_tables(spark):
    assert M.pareto_mix(documents(spark, [])).count() == 0
    out = M.pareto_mix(documents(spark, [(1, "a b", "s"), (1, "a b", "s"), (2, None, "t")])).collect()
    assert sorted((r.doc_id, r.taken) for r in out) == [(1, 2), (1, 2), (2, 0)]


# Quality rules


def repeated(words, k=8):
    at = collections.defaultdict(list)
    for i in range(len(words) - k + 1):
        at[tuple(words[i : i + k])].append(i)
    return len({j for v in at.values() if len(v) > 1 for i in v for j in range(i, i + k)})


def test_quality_counts(spark):
    rng = random.Random(8)
    texts = [None, "", "a b", prose(rng, 50), ("x y z " * 20).strip(), "l1 a\nl1 a\n\n \nl1 a", "# * $ % & | < >", "w " * 20000]
    for _ in range(30):
        w = [rng.choice("abc") for _ in range(rng.randrange(0, 60))]
        texts.append(" ".join(w))
    out = {r.doc_id: r for r in Q.line_first_quality(documents(spark, [(i, t, "s") for i, t in enumerate(texts)])).collect()}
    for i, t in enumerate(texts):
        words, lines = WORD.findall(t or ""), [x for x in (t or "").split("\n") if WORD.search(x)]
        n = repeated(words)
        assert (out[i].n_words, out[i].word_chars, out[i].n_symbols) == (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in t or ""))
        assert (out[i].n_dup_lines, out[i].n_repeat_words) == (len(lines) - len(set(lines)), n)
        assert out[i].base_failed == (len(words) < 20 or 100 * n > 30 * len(words))


def test_quality_verdicts(spark):
    rng = random.Random(9)
    clean = "\n".join(prose(rng, 20).capitalize() + "." for _ in range(4))
    texts = [clean, clean + "\nAll rights reserved.", " | ".join(prose(rng, 60).split()), "### ".join(prose(rng, 60).split()), "tiny text", None]
    out = Q.line_first_quality(documents(spark, [(i, t, "s") for i, t in enumerate(texts)])).orderBy("doc_id").collect()
    assert [r.kept for r in out] == [True, True, False, False, False, False]
    assert out[1].clean_text == clean and out[1].lost_words == 3
    assert Q.line_first_quality(documents(spark, [])).count() == 0


def test_digest_is_of_the_edit(spark):
    df = spark.createDataFrame([("abcdef", "xyz")], "a string, b string")
    edit = df.select(P.edited(F.col("a"), F.col("b"))).first()[0]
    assert edit == "abcdxy" and len(hashlib.sha256(edit.encode()).hexdigest()) == 64
