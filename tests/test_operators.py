"""Literal cases of trees, filters, reconcile, logs and stores."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from tidemark.operators import links as L
from tidemark.operators import logs as G
from tidemark.operators import reconcile as R
from tidemark.operators import transfers as X
from tidemark.operators import trees as T
from tidemark.sources import tables as S
from tidemark.streaming import logs as M

ROOT = "https://example.test/data/"


def edges(spark):
    a, b = ROOT + "A/", ROOT + "B/"
    rows = [(ROOT, a, 0), (ROOT, b, 1), (a, a + "sub/", 0), (b, b + "sub/", 0), (a + "sub/", a + "sub/leaf/", 0), (b + "sub/", b + "sub/leaf/", 0), (a + "sub/", ROOT, 1), (a, "https://other.test/", 2)]
    return spark.createDataFrame(rows, "parent string, child string, pos int")


@pytest.mark.parametrize(("depth", "found"), [(0, 1), (1, 3), (2, 5), (50, 7)])
def test_discovery_by_depth(spark, depth, found):
    out = T.discover(edges(spark), ROOT, depth)
    assert out.count() == found


def test_discovery_order_and_exclusion(spark):
    out = T.discover(edges(spark), ROOT).orderBy("depth", "ord")
    assert [r.dir_url.removeprefix(ROOT) for r in out.collect()] == ["", "A/", "B/", "A/sub/", "B/sub/", "A/sub/leaf/", "B/sub/leaf/"]
    assert T.discover(edges(spark), ROOT, exclude=["B"]).count() == 4


def test_listings(spark):
    files = spark.createDataFrame([(ROOT + "o1/", ROOT + f"o1/f{i}") for i in range(3)] + [(ROOT + "o2/", ROOT + f"o2/f{i}") for i in range(2)], "dir_url string, url string")
    assert {(r.dir_url[-3:], r.shown, r.total) for r in T.shown_of_total(files, 2).collect()} == {("o1/", 2, 3), ("o2/", 2, 2)}
    assert [r.rel for r in T.list_files(files, ROOT, 1).orderBy("rel").collect()] == ["o1/f2", "o2/f1"]
    dirs = spark.createDataFrame([(ROOT, ROOT)] + [(ROOT, ROOT + f"orbit_{i}/") for i in range(5)], "root string, dir_url string")
    assert [r.rel for r in T.list_dirs(dirs, 3).orderBy("rel").collect()] == ["orbit_2", "orbit_3", "orbit_4"]
    assert T.list_dirs(dirs).count() == 6


def test_file_filters(spark):
    names = spark.createDataFrame([("a_T073_x.FITS",), ("b.png",), ("",), ("c.txt",)], "n string")
    hit = lambda *p: [r.n for r in names.where(L.file_filter(F.col("n"), list(p))).orderBy("n").collect()]
    assert hit(".fits") == ["a_T073_x.FITS"]
    assert hit("t073") == ["a_T073_x.FITS"]
    assert hit(r"^(?!a).*\.(png|txt)$") == ["b.png", "c.txt"]
    assert len(hit()) == 4
    with pytest.raises(Exception):
        L.file_filter(F.col("n"), ["(["])


def test_dir_exclusion_has_no_boundary(spark):
    dirs = spark.createDataFrame([("https://h.test/gold/",), ("https://h.test/old/",), ("https://h.test/new_v1/x/",), ("https://h.test/y/",)], "dir_url string")
    assert sorted(r.dir_url for r in L.exclude_dirs(dirs, ["old", "new_*"]).collect()) == ["https://h.test/y/"]


def test_links_of_odd_pages(spark):
    html = "<a href=\"a/\">x</a><a href='b'>y</a><link href=\"c.css\"><a href=\"#t\"><a href=\"javascript:x\"><a href=\"mailto:m\"><a href=\"../\"><a href=\"q?a=1&amp;b=2\">"
    pages = spark.createDataFrame([("https://h.test/d/", html, 200), ("https://h.test/e/", None, 200)], "url string, html string, status int")
    assert [r.href for r in L.extract_links(pages).orderBy("pos").collect()] == ["a/", "c.css", "../", "q?a=1&amp;b=2", "b"]
    assert [r.href for r in L.extract_links(pages, "auto").orderBy("pos").collect()] == ["a/", "b", "../", "q?a=1&b=2"]
    assert {(r.child_url, r.is_dir) for r in L.page_links(pages, "anchor").collect()} == {("https://h.test/d/a/", True), ("https://h.test/d/b", False), ("https://h.test/d/q?a=1&b=2", False)}


def test_signatures_and_gate(spark):
    sig = lambda rows: spark.createDataFrame(rows, "dir_url string, signature string")
    out = R.diff_signatures(sig([("a", "etag:1"), ("b", "etag:1"), ("c", "url:c"), ("e", "etag:1")]), sig([("a", "etag:1"), ("b", "etag:2"), ("c", "url:c"), ("d", "etag:1")]))
    assert {(r.dir_url, r.change) for r in out.collect()} == {("a", "unchanged"), ("b", "changed"), ("c", "untrusted"), ("d", "new"), ("e", "gone")}
    local, remote = spark.createDataFrame([("keep",), ("gone",)], "url string"), spark.createDataFrame([("keep",)], "url string")
    pages = lambda failed: spark.createDataFrame([("p", failed), ("q", False)], "url string, failed boolean")
    assert [r.url for r in R.obsolete_files(local, remote, pages(False)).collect()] == ["gone"]
    assert R.obsolete_files(local, remote, pages(True)).count() == 0
    assert R.obsolete_files(local, remote, pages(False), "safe").count() == 0


def test_missing_only(spark):
    remote = spark.createDataFrame([("u1", "d", 1, None, None, 500), ("u2", "d", 1, None, None, 200)], "url string, dir_url string, size long, last_modified timestamp, etag string, status int")
    local = spark.createDataFrame([("u1", 1, None, None)], "url string, size long, mtime timestamp, cached_etag string")
    assert {(r.url, r.needs_download) for r in R.classify_freshness(remote, local, missing_only=True).collect()} == {("u1", False), ("u2", True)}
    assert {(r.url, r.reason) for r in R.classify_freshness(remote, local).collect()} == {("u1", "other status"), ("u2", "absent")}


def test_incident_window(spark):
    now = dt.datetime(2024, 2, 1)
    rows = [("four", now, 429)] * 4 + [("Five", now - dt.timedelta(days=14), 503)] * 5 + [("old", now - dt.timedelta(days=15), 429)] * 10 + [("old", now, 429)] * 4 + [("", now, 429)] * 9
    log = spark.createDataFrame(rows, "domain string, ts timestamp, status int")
    assert [r.domain for r in G.throttled_domains(log, F.lit(now)).collect()] == ["five"]


def test_incident_store(spark):
    stores = [json.dumps({"_meta": {"version": 1}, "domains": {"a": [1.5, 2.0], "b": "not-a-list"}}), json.dumps({"_meta": {"version": 999}, "domains": {"c": [1.0]}}), "corrupt"]
    out = S.parse_incidents(spark.createDataFrame([(s,) for s in stores], "value string"))
    assert sorted((r.domain, r.ts.timestamp()) for r in out.select("domain", "ts").collect()) == [("a", 1.5), ("a", 2.0)]


def test_redirects(spark):
    rows = [("a", "b"), ("b", "c"), ("x", "y"), ("y", "x"), ("p", "bad")] + [(f"n{i}", f"n{i + 1}") for i in range(13)]
    out = {r.src: (r.final_url, r.hops, r.outcome) for r in T.resolve_redirects(spark.createDataFrame(rows, "src string, dst string"), lambda u: u != "bad").collect()}
    assert out["a"] == ("c", 2, "resolved")
    assert out["x"][2] == "loop"
    assert out["p"][2] == "blocked"
    assert out["n0"][2] == "too long"
    assert out["n3"] == ("n13", 10, "resolved")


def test_link_guard_and_queue(spark):
    links = spark.createDataFrame([("l", "d", 1, 0), ("l", "d", 2, 1), ("m", "d", 11, 2)], "link string, dir string, depth int, pos int")
    assert [r.verdict for r in X.guard_links(links).orderBy("pos").collect()] == ["ok", "seen", "too deep"]
    t = dt.datetime(2024, 1, 1)
    tasks = spark.createDataFrame([("u1", "p", 2, t), ("u2", "p", 0, t), ("u3", "p", 1, t), ("u2", "p", 0, t)], "url string, path string, priority int, created_at timestamp")
    assert [r.priority for r in X.work_list(tasks).collect()] == [0, 1, 2]


def test_chunk_failures(spark):
    rows = [("f", "s", i, False) for i in range(3)] + [("f", "s", 3, True)]
    out = X.chunk_failures(spark.createDataFrame(rows, "url string, server string, seq int, ok boolean")).orderBy("seq").collect()
    assert [(r.file_failures, r.server_failures) for r in out] == [(1, 1), (2, 2), (3, 3), (0, 2)]
    assert [r.file_failed for r in out] == [False, False, True, False]


def test_failure_runs(spark):
    rows = [("a", i, i, i not in (1, 2, 5)) for i in range(7)] + [("b", i, i, False) for i in range(3)]
    log = spark.createDataFrame(rows, "domain string, event_id long, t long, ok boolean").withColumn("ts", F.timestamp_seconds("t"))
    out = M.failure_runs(log).select("domain", F.unix_seconds("start_ts"), F.unix_seconds("end_ts"), "failures").collect()
    assert sorted(map(tuple, out)) == [("a", 1, 2, 2), ("a", 5, 5, 1), ("b", 0, 2, 3)]



def test_inventory_and_empty_dirs(spark, tmp_path):
    (tmp_path / "a" / "b").mkdir(parents=True)
    (tmp_path / "a" / "b" / "keep.dat").write_text("x")
    (tmp_path / "a" / "gone.dat").write_text("yy")
    files, dirs = S.read_inventory(spark, str(tmp_path))
    assert sorted(r["size"] for r in files.collect()) == [1, 2]
    assert any(r.dir.endswith("/a/b/") for r in dirs.collect())
    files = spark.createDataFrame([("/t/a/x",), ("/t/b/y",)], "url string")
    out = T.empty_dirs(spark.createDataFrame([("/t/",), ("/t/a/",), ("/t/b/",), ("/t/c/",)], "dir_url string"), files, files.where("url = '/t/b/y'"))
    assert {(r.dir_url, r.empty_now, r.empty_after) for r in out.collect()} == {("/t/b/", False, True), ("/t/c/", True, True)}


def test_snapshots(spark, tmp_path):
    path = str(tmp_path / "runs")
    df = spark.createDataFrame([("d", "etag:1")], "dir_url string, signature string")
    S.write_snapshot(df, path, 2, "2024-01-01 00:00:00")
    S.write_snapshot(df.withColumn("signature", F.lit("etag:2")), path, 2, "2024-01-05 00:00:00")
    S.write_snapshot(df, path, 1, "2024-01-06 00:00:00")
    load = lambda days: [r.signature for r in S.load_snapshot(spark, path, "dir_url string, signature string", 2, days, "2024-01-07 00:00:00").collect()]
    assert load(30) == ["etag:2"]
    assert load(1) == []


def test_ranges_and_space(spark):
    mib = 1 << 20
    files = spark.createDataFrame([("a", 9 * mib), ("b", 11 * mib), ("c", 100 * mib + 3)], "url string, size long")
    out = X.plan_ranges(files)
    assert {(r.url, r["count"]) for r in out.groupBy("url").count().collect()} == {("b", 2), ("c", 8)}
    assert out.where("url = 'c'").agg(F.sum(F.col("end_byte") - F.col("start_byte") + 1), F.max("end_byte")).first()[0] == 100 * mib + 3
    plan = spark.createDataFrame([("v", 300 * mib, False)], "volume string, size long, streaming boolean")
    volumes = spark.createDataFrame([("v", 1000 * mib, 500 * mib), ("w", 1000 * mib, 990 * mib)], "volume string, total long, free long")
    assert {(r.volume, r.verdict) for r in X.space_verdict(plan, volumes).collect()} == {("v", "block"), ("w", "ok")}


def test_snapshot_keeps_files_without_shuffling_them(spark):
    from tidemark.streaming.logs import _files_of, _signatures

    files = spark.createDataFrame([(f"{d}f{i}", d) for d in ("a/", "b/", "c/", None) for i in range(3)], "url string, dir_url string")
    dirs = lambda *names: spark.createDataFrame([(n,) for n in names], "dir_url string")
    for stay, gone in ((("a/", None), ("b/", "c/", "d/")), (("a/", "d/", "e/", None), ("b/", "c/"))):
        kept = _files_of(files, dirs(*stay), dirs(*gone))
        assert sorted(r.url or "-" for r in kept.where("dir_url IS NOT NULL").collect()) == ["a/f0", "a/f1", "a/f2"] and kept.where("dir_url IS NULL").count() == 3
        assert "hashpartitioning" not in kept._jdf.queryExecution().executedPlan().toString()
    lines = spark.createDataFrame([("a", "x"), ("a", "y"), ("b", "y"), ("b", "x"), ("c", "x"), ("c", "x"), ("d", "x"), ("e", "y")], "dir_url string, line string")
    told = {r.dir_url: r.signature for r in _signatures(lines.select("dir_url", F.md5("line").alias("line"))).collect()}
    assert told["a"] == told["b"] and len(set(told.values())) == 4


def test_verdicts_join_directories_narrowly(spark):
    """What meets the directories' signatures has a file's URL, directory and two verdicts, not its tags, times and sizes."""
    remote = spark.createDataFrame([], "url string, dir_url string, size long, last_modified timestamp, etag string, status int")
    local = spark.createDataFrame([], "url string, size long, mtime timestamp, cached_etag string")
    signatures = spark.createDataFrame([], "dir_url string, old_sig string, new_sig string")
    plan = R.classify_freshness(remote, local, signatures)._jdf.queryExecution().analyzed().toString().splitlines()
    at = next(i for i, line in enumerate(plan) if "Join LeftOuter, (dir_url" in line)
    assert "Project [url" in plan[at + 1] and "reason" in plan[at + 1] and " AS trusted" in plan[at + 1]
