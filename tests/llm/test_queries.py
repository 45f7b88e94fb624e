"""The registered queries, by name, over a small table with odd rows, against plain Python."""

import collections
import hashlib
import random
import re
import zlib
from array import array

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from tidemark.llm.queries import QUERIES

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row long, h string, key string"


def prose(rng, n):
    return " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(2, 9))) for _ in range(n))


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    """Documents with copies, near copies, shared lines, secrets, nulls, an empty and a very long text, ties and a
    repeated row; columns whose names clash with the operators' own."""
    rng = random.Random(21)
    texts = [prose(rng, rng.randrange(30, 90)) for _ in range(30)]
    texts += texts[:4] + ["\n".join([texts[5], "All rights reserved"]), "\n".join([texts[6], "All rights reserved", ""])]
    near = texts[7].split()
    near[11] = "zzzz"
    secret = "AKIA" + "".join(rng.choice("ABCDEFGHIJ0123456789") for _ in range(16))
    texts += [" ".join(near), None, "", " \n\t", "a b", "A B", f"é key {secret} here", f"token = {prose(rng, 1)}x9Kq2 and {secret}", prose(rng, 30_000)]
    rows = [(i * 3, t, rng.choice(["en", "de"]), rng.choice(["s1", "s1", "s1", "s2", None])) for i, t in enumerate(texts)]
    rows.append(rows[3])
    folder = str(tmp_path_factory.mktemp("queries"))
    spark.createDataFrame([(*r, len(r[1] or ""), 1, "h", "k") for r in rows], SCHEMA).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(r[0], 1, int(k % 3 == 0)) for k, r in enumerate(rows)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder, rows


def result(spark, table, name):
    return QUERIES[name](spark, table[0]).collect()


def held(i, mod, rest):
    return zlib.crc32(str(i).encode()) % mod == rest


def test_op1(spark, table):
    rows = sorted(((i, t or "") for i, t, *_ in table[1]), key=lambda r: (-r[0], r[1]))
    want = collections.Counter()
    for (i, text), (_, after) in zip(rows, rows[1:] + rows[:1]):
        k = len(text) // 3
        want[i, len(text), hashlib.sha256((text[: len(text) - k] + after[:k]).encode()).hexdigest()] += 1
    out = result(spark, table, "op1_weighted_fingerprints")
    assert collections.Counter((r.doc_id, r.n_chars, r.edited_sha256) for r in out) == want
    text_of = {i: t or "" for i, t, *_ in table[1]}
    for a in out:
        assert 0 <= a.near_edited <= 1 and 0 <= a.near_next <= 1
        for b in out:
            assert (a.fingerprint == b.fingerprint) or text_of[a.doc_id] != text_of[b.doc_id]


def test_op2_and_op6(spark, table):
    out = result(spark, table, "op2_nearest_centroid_langid")
    assert sorted(r.doc_id for r in out) == sorted(i for i, *_ in table[1])
    text_of = {i: t for i, t, *_ in table[1]}
    by_text = collections.defaultdict(set)
    for r in out:
        assert r.held_out == held(r.doc_id, 4, 2) and 0 <= r.score <= 1
        assert (r.lang_pred == "und") == (not any(c.isalpha() for c in text_of[r.doc_id] or ""))
        by_text[text_of[r.doc_id]].add((r.lang_pred, r.score))
    assert all(len(x) == 1 for x in by_text.values())
    out = result(spark, table, "op6_factorization_toxicity")
    assert sorted(r.doc_id for r in out) == sorted(i for i, *_ in table[1])
    by_text = collections.defaultdict(set)
    for r in out:
        assert r.held_out == held(r.doc_id, 5, 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
        by_text[text_of[r.doc_id] or ""].add(r.score)
    assert all(len(x) == 1 for x in by_text.values())


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        above, row[0] = row[0], i + 1
        for j, y in enumerate(b):
            above, row[j + 1] = row[j + 1], min(row[j + 1] + 1, row[j] + 1, above + (x != y))
    return row[-1]


def test_op3(spark, table):
    norm = lambda line: " ".join(re.findall(r"[^\W_]+", line.lower()))
    kept, want = [], {}
    for i, t in sorted({(i, t) for i, t, *_ in table[1]}, key=lambda r: r[0]):
        lines = []
        for line in (t or "").split("\n"):
            n = norm(line)
            same = n and any(x == n or (len(x.split()) > 4 and len(n.split()) > 4 and max(len(x), len(n)) < 2000 and distance(x, n) <= 0.2 * max(len(x), len(n))) for x in kept)
            if not same:
                lines.append(line)
                kept.append(n)
        want[i] = None if t is None else "\n".join(lines)
    out = result(spark, table, "op3_fuzzy_line_dedup")
    assert len(out) == len(table[1])
    assert {r.doc_id: r.text for r in out} == want
    assert {r.doc_id: r.n_lines for r in out} == {i: 0 if t is None else t.count("\n") + 1 for i, t, *_ in table[1]}


def test_op4(spark, table):
    def shingles(text):
        w = tuple(x.lower() for x in WORD.findall(text or ""))
        return {w[i : i + 3] for i in range(max(1, len(w) - 2))} if w else set()

    sets = {i: shingles(t) for i, t, *_ in table[1]}
    least = {i: min(j for j, s in sets.items() if j == i or (s and sets[i] and 100 * len(s & sets[i]) >= 90 * len(s | sets[i]))) for i in sets}
    out = result(spark, table, "op4_ngram_jaccard_join")
    assert len(out) == len(table[1])
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in out} == {i: (len(s), least[i]) for i, s in sets.items()}


def test_op5(spark, table):
    whole, want = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), collections.Counter()
    for i, t, *_ in table[1]:
        ids = [*whole.encode(t or "", add_special_tokens=False).ids, 0]
        for p, at in enumerate(range(0, len(ids), 2048)):
            part = ids[at : at + 2048]
            want[i, p, at, len(part), zlib.crc32(array("I", part).tobytes())] += 1
    out = result(spark, table, "op5_best_fit_packing")
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in out) == want
    by = collections.defaultdict(list)
    for r in out:
        by[r.sequence_id].append((r.offset, r.length))
    for parts in by.values():
        ends = [0]
        for at, n in sorted(parts):
            assert at == ends[-1]
            ends.append(at + n)
        assert ends[-1] <= 2048


def test_op8(spark, table):
    out = {r.doc_id: r for r in result(spark, table, "op8_secret_ownership")}
    pattern = re.compile("AKIA[A-Z0-9]{16,}")
    places = collections.defaultdict(set)
    for i, t, _, source in table[1]:
        for m in pattern.finditer(t or ""):
            places[m[0]].add((source, i))
    for i, t, *_ in table[1]:
        found = list(pattern.finditer(t or ""))
        assert out[i].n_access == len(found)
        for m in found:
            wide = len({s for s, _ in places[m[0]]}) > 1 or len(places[m[0]]) > 3
            assert (f"shared:{m.start()}:{m.end()}" in out[i].spans) == wide


def test_pipeline_stage_by_stage(spark, table):
    """Each stage on what its predecessor kept: columns stay, the right documents go, the texts are what they should be."""
    docs = spark.read.parquet(f"{table[0]}/documents.parquet")
    frames = {"start": docs}
    last = docs
    for name, stage in corpus_pipeline.STAGES:
        made = stage(spark, last, table[0])
        last = frames[name] = spark.createDataFrame(made.collect(), made.schema)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert last.columns == docs.columns
    rows = {k: [(r.doc_id, r.text) for r in f.collect()] for k, f in frames.items() if k != "pack"}
    letters = {i for i, t in rows["start"] if any(c.isalpha() for c in t or "")}
    assert {i for i, _ in rows["language"]} <= letters and len(rows["language"]) >= 0.9 * len(letters)
    known = {i: t for i, t in rows["language"]}
    for i, t in rows["lines"]:
        assert all(line in known[i].split("\n") for line in t.split("\n")) and WORD.search(t)
    lines = [line for _, t in {(i, t) for i, t in rows["lines"]} for line in t.split("\n") if WORD.search(line)]
    assert len(lines) == len(set(lines))
    assert len(rows["near_duplicates"]) == len(set(rows["near_duplicates"])) and set(rows["near_duplicates"]) <= set(rows["lines"])
    assert set(rows["mix"]) <= set(rows["near_duplicates"])
    assert max(collections.Counter(rows["mix"]).values()) <= 3
    taken = collections.Counter(r.doc_id for r in frames["pack"].where("piece = 0").collect())
    assert taken == collections.Counter(i for i, _ in rows["mix"])


def test_pipeline_of_nothing(spark, tmp_path):
    empty = spark.createDataFrame([], SCHEMA)
    empty.write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_pipeline_of_nulls(spark):
    docs = spark.createDataFrame([(None, None, None, None, None, None, None, None), (None, "x", None, None, 1, 1, "h", "k"), (1, None, "en", None, 0, 1, "h", "k")], SCHEMA)
    made = {name: stage(spark, docs, "") for name, stage in corpus_pipeline.STAGES}
    rows = {name: sorted(((r.doc_id, r.text) for r in made[name].collect()), key=repr) for name in ("language", "lines", "near_duplicates", "mix")}
    every = sorted([(None, None), (None, "x"), (1, None)], key=repr)
    assert rows == {"language": [], "lines": every, "near_duplicates": every, "mix": every}  # no text with a language to learn from
    assert sorted(((r.doc_id, r.piece, r.length) for r in made["pack"].collect()), key=repr) == sorted([(None, 0, 1), (None, 0, 2), (1, 0, 1)], key=repr)
    assert docs.where(F.col("text").isNull()).count() == 2
