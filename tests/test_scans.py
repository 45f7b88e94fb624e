"""Prefix scans, pattern tables, redirects and discovery against plain Python."""

import collections
import random
import re

import pytest
from pyspark.sql import functions as F

from tidemark.operators import logs as G
from tidemark.operators import patterns as P
from tidemark.operators import scan as C
from tidemark.operators import transfers as X
from tidemark.operators import trees as T
from tidemark.session import checkpointed, new_folder, scratch


@pytest.fixture(scope="module")
def rows():
    """One key with most rows, some small ones, a null one, and a null value now and then."""
    rng = random.Random(4)
    out = [("hot" if rng.random() < 0.8 else rng.choice(["a", "b", None]), i, rng.choice([1, 1, -1, -2, None])) for i in range(900)]
    rng.shuffle(out)
    return out + [("once", 0, 5)]


def by_key(rows):
    out = collections.defaultdict(list)
    for k, t, v in sorted(rows, key=lambda r: r[1]):
        out[k].append((t, v))
    return out


@pytest.mark.parametrize("chunks", [1, 7])
def test_scans(spark, rows, chunks):
    df = spark.createDataFrame(rows, "k string, t int, v int")
    zero = F.coalesce("v", F.lit(0))
    total = {(r.k, r.t): r.x for r in C.running_sum(df, ["k"], ["t"], zero, "x", chunks).collect()}
    floor = {(r.k, r.t): r.x for r in C.floored_sum(df, ["k"], ["t"], zero, "x", chunks).collect()}
    since = {(r.k, r.t): r.x for r in C.count_since(df, ["k"], ["t"], F.coalesce(F.col("v") > 0, F.lit(False)), F.coalesce(F.col("v") == -2, F.lit(False)), "x", chunks).collect()}
    mean = {(r.k, r.t): r.x for r in C.moving_average(df, ["k"], ["t"], "v", "x", 0.9, chunks).collect()}
    assert len(total) == len(floor) == len(since) == len(mean) == len(rows)
    for k, series in by_key(rows).items():
        s = f = n = x = 0
        for t, v in series:
            s, f = s + (v or 0), max(0, f + (v or 0))
            n = 0 if v == -2 else n + ((v or 0) > 0)
            x = x if v is None else 0.9 * x + 0.1 * v
            assert (total[k, t], floor[k, t], since[k, t]) == (s, f, n)
            assert mean[k, t] == pytest.approx(x, rel=1e-9, abs=1e-12)


def test_scan_of_nothing(spark):
    df = spark.createDataFrame([], "k string, t int, v int")
    assert C.running_sum(df, ["k"], ["t"], F.col("v"), "x").count() == 0
    assert C.moving_average(df, ["k"], ["t"], "v", "x").count() == 0


def test_a_hot_key_runs_in_many_tasks(spark):
    """One key with all rows: each chunk's rows are windowed apart, and the average goes on across them."""
    log = spark.range(20_000).select(F.lit("h").alias("domain"), F.timestamp_seconds(F.col("id")).alias("ts"), F.lit(1000).alias("bytes"), "id")
    sizes = log.repartitionByRange(16, "domain", "id").groupBy(F.spark_partition_id()).count().collect()
    assert len(sizes) == 16 and max(r["count"] for r in sizes) < 3000
    curve = G.bandwidth_curve(log, chunks=16)
    last = curve.orderBy(F.desc("sec")).first()
    assert last.peak == 1000 and last.ewma == pytest.approx(1000.0, rel=1e-12)
    early = curve.orderBy("sec").limit(500).collect()
    assert early[499].ewma == pytest.approx(1000 * (1 - 0.9**500), rel=1e-12)  # no cut at 400 rows


def test_batches(spark):
    tasks = spark.range(100).select(F.col("id").cast("string").alias("url"), F.lit("p").alias("path"), (F.col("id") % 3).alias("priority"), F.col("id").alias("created_at"))
    out = X.work_batches(tasks.union(tasks), 7, 50, chunks=5).orderBy("place").collect()
    want = sorted(range(100), key=lambda i: (i % 3, i))[:50]
    assert [(int(r.url), r.place, r.batch) for r in out] == [(i, k, k // 7) for k, i in enumerate(want)]


def test_required_literals():
    told = {r"^(?!a).*\.(png|txt)$": ".", r"o12+[.]fits": ".fits", r"(abc)+d?": "abc", r"(?P<x>report)_\d": "report_", r"a|b": None, r"x?y*": None, r"[ab]+": None, "": None, r"(?:ab|cd)ef": "ef", r"\bfoo\b": "foo", r"a{0,3}bc": "bc"}
    assert {p: P.required_literal(p) for p in told} == told


def plain_match(name, patterns):
    low = name.lower()
    for kind, p in patterns:
        if p is not None and (low.endswith(p.lower()) if kind == "suffix" else p.lower() in low if kind == "substring" else bool(re.search("(?i)" + p, name)) if kind == "regex" else False):
            return True
    return False


def test_pattern_tables(spark):
    rng = random.Random(8)
    word = lambda n: "".join(rng.choice("abcXé.1") for _ in range(rng.randrange(1, n)))
    names = [word(14) for _ in range(400)] + ["", "a", "ſtraße", "STRASSE", "Kelvin", "iİı"]
    for k in range(6):
        patterns = [(rng.choice(["suffix", "substring"]), word(7)) for _ in range(25)] + [("regex", rng.choice(["^a.*b$", "[ab]{3}c", "(x|é)1", "c+1+", ".1.a", "^.$", r"\.[a-c]$", "ſt", "kelvin", "σ"])) for _ in range(3)] + [("substring", None), ("other", "a")]
        patterns = patterns if k else [("suffix", "")]
        files = spark.createDataFrame([(i, n) for i, n in enumerate([*names, None])], "i int, n string")
        out = P.match_patterns(files, spark.createDataFrame(patterns, "kind string, pattern string"), F.col("n"))
        assert sorted(r.i for r in out.collect()) == [i for i, n in enumerate(names) if plain_match(n, patterns)]
    with pytest.raises(Exception):
        P.match_patterns(files, spark.createDataFrame([("regex", "([")], "kind string, pattern string"), F.col("n")).count()
    assert P.match_patterns(files, spark.createDataFrame([], "kind string, pattern string"), F.col("n")).count() == 0


def test_a_million_patterns(spark):
    """No limit on the table, and regexes without a literal beyond one pass."""
    n = 1_000_000
    patterns = spark.range(n).select(F.when(F.col("id") % 2 == 0, "substring").otherwise("suffix").alias("kind"), F.concat(F.lit("q"), F.format_string("%07d", F.col("id"))).alias("pattern"))
    patterns = patterns.union(spark.range(120).select(F.lit("regex"), F.concat(F.lit("^[z]{"), (F.col("id") + 3).cast("string"), F.lit("}$"))))
    names = [f"x_q{i * 7:07d}{'_y' if i % 3 else ''}" for i in range(3000)] + ["zz", "z" * 5, "z" * 122, "z" * 123]
    out = P.match_patterns(spark.createDataFrame([(x,) for x in names], "name string"), patterns, F.col("name"))
    want = {x for x in names[:3000] if int(x[3:10]) < n and (int(x[3:10]) % 2 == 0 or not x.endswith("_y"))} | {"z" * 5, "z" * 122}
    assert {r.name for r in out.collect()} == want
    assert "NestedLoop" not in out._jdf.queryExecution().toString() and "Cartesian" not in out._jdf.queryExecution().toString()


def plain_redirect(step, allowed, src, most):
    at, seen, hops = src, [src], 0
    while True:
        to = step.get(at)
        if to is None:
            return at, hops, "resolved"
        if to in seen:
            return at, hops, "loop"
        if hops == most:
            return at, hops, "too long"
        if not allowed(to):
            return at, hops, "blocked"
        at, hops = to, hops + 1
        seen.append(at)


@pytest.mark.parametrize("most", [1, 2, 5, 10])
def test_redirects_by_doubling(spark, most):
    rng = random.Random(most)
    nodes = [f"n{i:02d}" for i in range(60)]
    pairs = [(a, rng.choice(nodes)) for a in nodes if rng.random() < 0.9] + [(f"m{i}", f"m{i + 1}") for i in range(14)] + [("x", "x"), ("bad1", "ok1"), ("ok1", "bad1"), ("u", None)]
    pairs += pairs[:5] + [("n00", "zz")]
    step = {}
    for a, b in pairs:
        if b is not None:
            step[a] = min(step.get(a, b), b)
    allowed = lambda u: not (u.endswith("7") or u.startswith("bad"))
    out = T.resolve_redirects(spark.createDataFrame(pairs, "src string, dst string"), lambda u: ~(u.endswith("7") | u.startswith("bad")), most)
    assert {r.src: (r.final_url, r.hops, r.outcome) for r in out.collect()} == {a: plain_redirect(step, allowed, a, most) for a, _ in pairs}


def test_discovery_of_a_graph(spark):
    """Directories with several links to them, links back, and equal names."""
    rng = random.Random(6)
    root, dirs = "r/", ["r/"] + [f"r/{i}/" for i in range(40)]
    links = [(rng.choice(dirs[: 5 + i]), d, rng.randrange(3)) for i in range(0, 40, 2) for d in rng.sample(dirs, 4)] + [(dirs[1], root, 0), (dirs[3], dirs[3], 0), (root, "s/", 1)]
    out = T.discover(spark.createDataFrame(links, "parent string, child string, pos int"), root, 5)
    order, at = {root: (0, [])}, [root]
    for depth in range(1, 6):
        found = {}
        for p, c, pos in links:
            if p in at and c.startswith(root) and c not in order:
                found[c] = min(found.get(c, (depth, [9] * 9)), (depth, order[p][1] + [pos]))
        order |= found
        at = list(found)
    assert {r.dir_url: (r.depth, r.ord) for r in out.collect()} == order


def test_scratch_deletes_tables(spark):
    with scratch(spark):
        df = checkpointed(spark.range(5))
        path = df._tidemark_path
        assert df.count() == 5 and new_folder(spark, "x")
    with pytest.raises(Exception):
        spark.read.parquet(path)
