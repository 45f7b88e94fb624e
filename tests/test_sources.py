"""Anchors, inventories, snapshots, listing hashes, records and streams, against the standard library and plain replays."""

import datetime as dt
import hashlib
import os
import random
import shutil

from pyspark.sql import functions as F

from tidemark.functions import anchors as A
from tidemark.functions import headers as H
from tidemark.operators import logs as G
from tidemark.operators import reconcile as R
from tidemark.sources import snapshots as N
from tidemark.sources import tables as S
from tidemark.streaming import logs as M


def anchors(spark, pages):
    df = spark.createDataFrame([(i, p) for i, p in enumerate(pages)], "i int, html string")
    return [(r.found, r.native) for r in df.select("i", A.all_anchors(F.col("html")).alias("found"), A._native(F.col("html")).alias("native")).orderBy("i").collect()]


def test_anchors_of_odd_pages(spark):
    pages = [
        "<a href=foo>x</a>", "<!-- <a href='c'> --><a href='d'>", "<script>var s = '<a href=\"s\">';</script><a href=\"t\">", "<a href=\"a&#x2F;b&eacute;&amp;c&#39;\">", "<A CLASS=x HREF = 'up'>", "<a\nhref\n=\n\"nl\">",
        "<a href>", "<a name=n>", "<area href='no'><link href=\"no\"><abbr href='no'>", "<a href='1' href='2'>", "<div title=\"<a href='in'>\"><a href='out'>", "<div title='a > b <a href=\"q\">'></div>", "<title><a href='t'></title><a href='u'>",
        "<textarea><a href='ta'></textarea>", "<style><a href='st'></style>", "<!--><a href='e'>--><a href='f'>", "<![CDATA[<a href='cd'>]]><a href='g'>", "<?php <a href='php'> ?><a href='h'>", "<a href='un", "<a href='x'", "< a href='sp'>", "</a href='end'>", "<a/href='sl'>",
        "<a href='a'b='c'>", "<a data-x='1' href='k' id=\"z\">", "<noscript><a href='ns'></noscript>", "<script/><a href='sc'></script><a href='sd'>", "<a href=\"two\nlines\">", "<p <a href='nest'>", "", "no tags & \"quotes\" 'here'", None, "<a href=''><a href='#x'>", "<a href=\"%20 é\">\0",
    ]
    for page, (found, _) in zip(pages, anchors(spark, pages)):
        assert found == A.parsed_anchors(page), page


def test_anchors_of_random_pages(spark):
    rng = random.Random(12)
    bits = ["<a href=\"%s\">", "<a href='%s'>", "<a class=\"k\" href=\"%s\" id='i'>", "<a id='%s'>", "<p>", "</a>", "text %s", "<!-- <a href='no'> -->", "<script>if (a < b) '<a href=\"z\">'</script>", "<div title=\"%s\">", "<br/>", "<A HREF=\"%s\">"]
    odd = ["<a href=%s>", "&amp;", "<a href='&lt;%s'>", "\"", "'", "<", ">", "<!--", "<a href=\"%s", "<title>", "</title>"]
    pages = ["".join(b.replace("%s", rng.choice(["x", "y/z", "q?a=1", "é"])) for b in rng.choices(bits + odd * (k % 2), k=rng.randrange(1, 14))) for k in range(400)]
    told = anchors(spark, pages)
    for page, (found, native) in zip(pages, told):
        want = A.parsed_anchors(page)
        assert found == want and native in (None, want), page
    assert sum(native is not None for _, native in told[::2]) > 190  # well-formed pages are not sent to Python


def test_inventory_of_a_tree(spark, tmp_path):
    """Empty directories are rows; broken and circular links, and a second link to one directory, don't repeat anything."""
    root, out = tmp_path / "root", tmp_path / "out"
    for d in (root / "a" / "b", root / "empty_now", out / "deep"):
        d.mkdir(parents=True)
    for f, size in ((root / "keep.dat", 3), (root / "a" / "b" / "x.bin", 5), (out / "deep" / "o.dat", 7)):
        f.write_bytes(b"." * size)
    os.symlink(root, root / "a" / "round")
    os.symlink(root / "a", root / "a" / "b" / "up")
    os.symlink(tmp_path / "nowhere", root / "broken")
    os.symlink(out, root / "a" / "l2")
    os.symlink(out, root / "l1")
    os.symlink(out / "deep", out / "again")
    os.symlink(root / "keep.dat", root / "link.dat")
    for parts in (1, 3, 64):
        files, dirs = S.read_inventory(spark, str(root), parts)
        short = lambda p: p.removeprefix(f"{root}/")
        assert sorted((short(r.path), r["size"]) for r in files.collect()) == [("a/b/x.bin", 5), ("a/l2/deep/o.dat", 7), ("keep.dat", 3), ("link.dat", 3)]
        assert sorted(short(r.dir) for r in dirs.collect()) == ["a/", "a/b/", "a/b/up/", "a/l2/", "a/l2/again/", "a/l2/deep/", "a/round/", "empty_now/", "l1/"]
    assert files.where("mtime > '2020-01-01'").count() == 4
    files, dirs = S.read_inventory(spark, str(tmp_path / "none"))
    assert files.count() == dirs.count() == 0


def test_snapshots_are_whole(spark, tmp_path):
    store = f"file://{tmp_path}/store"
    one = lambda x: spark.createDataFrame([(x,)], "x string")
    read = lambda **kw: [r.x for r in N.load_snapshot(spark, store, "x string", 1, 30, "2024-02-01", **kw).collect()]
    assert read() == []
    N.write_snapshot(one("first"), store, 1, "2024-01-10")
    N.write_snapshot({"rows": one("second"), "more": one("m")}, store, 1, "2024-01-20")
    assert read() == ["second"] and read(refresh=True) == [] and read(table="more") == ["m"] and read(before="2024-01-20") == ["first"]
    one("torn").write.parquet(f"{store}/data/2024-01-25-torn/rows")  # a run that stopped before its manifest
    assert read() == ["second"]
    N.write_snapshot(one("again"), store, 1, "2024-01-20")  # a repeated run takes its own place
    assert read() == ["again"] and N.manifests(spark, store).count() == 2
    assert len([d for d in os.listdir(tmp_path / "store" / "data") if d.startswith("2024-01-20")]) == 1
    counts = {r.run_ts.date().isoformat(): r.counts for r in N.manifests(spark, store).collect()}
    assert counts == {"2024-01-10": {"rows": 1}, "2024-01-20": {"rows": 1}}


def test_parsed_listings_and_hashes(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["d1", "d1", "d1", "d2", None]), f"{rng.choice('abé')}{i}", i % 3 == 0) for i in range(300)]
    listed, dirs = N.parsed_listings(spark.createDataFrame(rows + rows[:9], "dir_url string, child string, is_dir boolean").repartition(7))
    assert listed.count() == 300
    for r in dirs.collect():
        mine = sorted((c for d, c, _ in rows if d == r.dir_url), key=str.encode)
        assert r.content_hash == hashlib.md5("\n".join(mine).encode()).hexdigest() and r.n_files + r.n_dirs == len(mine)
    assert H.listing_signatures(spark.createDataFrame([], "d string, c string"), "d", "c").count() == 0


def test_blake2b(spark):
    texts = ["", "a", "é" * 5000, None]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", H.content_signature(F.encode("t", "UTF-8"), "blake2b").alias("h")).orderBy("i").collect()
    assert [r.h for r in got] == [None if t is None else hashlib.blake2b(t.encode(), digest_size=32).hexdigest() for t in texts]


def test_records_of_nothing(spark):
    log = spark.createDataFrame([], "event_id long, ts timestamp, operation string, status int, rtt_ms double, bytes long")
    told = G.run_report(log, spark.createDataFrame([], "bytes long, ms long"), spark.createDataFrame([], "cache string, hit boolean")).first()
    assert (told.downloaded, told.pages_parsed, told.parse_mb_per_s, told.lookups, told.hit_pct) == (0, 0, 0.0, 0, 0.0)
    totals = G.latency_totals(G.latency_stats(log)).first()
    assert (totals.operations, totals.calls, totals.mean_ms, totals.slowest) == (0, 0, 0.0, None)
    assert R.latest_metadata(spark.createDataFrame([("k", 1, 5), ("k", 2, 5), ("l", 3, 1)], "key string, v int, updated int")).select("key", "v").collect() == [("k", 2), ("l", 3)]


START = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)


def feed(spark, folder, rows, number):
    """A batch: one file of rows (key, minute, event_id, bytes, completed)."""
    df = spark.createDataFrame([(k, START + dt.timedelta(minutes=m), e, 10, c) for k, m, e, c in rows], "partial string, ts timestamp, event_id long, bytes long, completed boolean")
    df.coalesce(1).write.parquet(f"{folder}/in/{number}")
    return spark.readStream.schema(df.schema).option("recursiveFileLookup", "true").parquet(f"{folder}/in")


def run(stream, folder, mode="append"):
    query = stream.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/progress").outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def minutes(ts):
    return round((ts.replace(tzinfo=dt.timezone.utc) - START).total_seconds() / 60)


def told(spark, folder, stream, *columns):
    out = spark.read.schema(stream.schema).parquet(f"{folder}/out")
    return sorted(tuple(minutes(r[c]) if isinstance(r[c], dt.datetime) else r[c] for c in columns) for r in out.collect())


def test_sessions_end_when_nothing_arrives(spark, tmp_path):
    """gap 60, delay 30 minutes; three batches. State goes once the watermark is past a session's end."""
    folder = str(tmp_path)
    batches = [
        [("a", 0, 1, False), ("a", 50, 2, False), ("b", 10, 3, False), ("b", 20, 4, True), ("b", 25, 5, False)],
        [("a", 100, 6, False), ("c", 100, 7, False)],
        [("d", 400, 8, False)],
        [("a", 5, 9, False), ("d", 410, 10, True)],  # the first of them is far too late
    ]
    totals = []
    for k, rows in enumerate(batches):
        stream = M.transfer_sessions(feed(spark, folder, rows, k), "partial", "60 minutes", "30 minutes")
        query = run(stream, folder)
        totals.append(query.recentProgress[-1]["stateOperators"][0]["numRowsTotal"])
    got = told(spark, folder, stream, "partial", "start_ts", "last_ts", "bytes", "state")
    assert got == [("a", 0, 100, 30, "stale"), ("b", 10, 20, 20, "completed"), ("b", 25, 25, 10, "stale"), ("c", 100, 100, 10, "stale"), ("d", 400, 410, 20, "completed")]
    assert totals[1] >= 2 and totals[2] == 1 and totals[3] == 0


def test_keys_come_back_after_their_time(spark, tmp_path):
    rng = random.Random(3)
    rows = [(rng.choice("ab"), m, m, False) for m in sorted(rng.sample(range(2000), 300))]
    folder = str(tmp_path)
    for k in range(3):
        stream = M.distinct_within(feed(spark, folder, rng.sample(rows[k * 100 : k * 100 + 100], 100), k), "partial", "90 minutes", "event_id", "200 minutes")
        query = run(stream, folder)
    want, first = [], {}
    for key, m, _, _ in rows:
        if key not in first or m - first[key] > 90:
            first[key] = m
            want.append((key, m))
    assert told(spark, folder, stream, "partial", "ts") == sorted(want)
    end = feed(spark, folder, [("z", 9000, 9000, False)], 9)
    query = run(M.distinct_within(end, "partial", "90 minutes", "event_id", "200 minutes"), folder)
    assert query.recentProgress[-1]["stateOperators"][0]["numRowsTotal"] == 1  # the others' state has gone


def test_late_rows_are_counted(spark, tmp_path):
    """The count is what Spark's own windows drop."""
    counted, windows = str(tmp_path / "counted"), str(tmp_path / "windows")
    batches = [[("a", m, m, False) for m in range(0, 300, 7)], [("a", m, m, False) for m in (3, 100, 209, 219, 231, 239, 240, 290)], [("a", 299, 1, False), ("a", 5, 2, False)]]
    dropped = 0
    for k, rows in enumerate(batches):
        late, marks = M.late_rows(feed(spark, counted, rows, k), F.window("ts", "10 minutes")["end"], "60 minutes", f"{counted}/state")
        log = feed(spark, windows, rows, k)
        query = run(M.throughput(log.select("ts", "bytes").withWatermark("ts", "60 minutes"), "10 minutes", None), windows)
        dropped += sum(op["numRowsDroppedByWatermark"] for p in query.recentProgress for op in p["stateOperators"])
    got = {r.batch: (r.n, r.n_late) for r in marks.collect()}
    latest = 294  # of the first batch
    want = sum((m // 10 + 1) * 10 <= latest - 60 for m in (3, 100, 209, 219, 231, 239, 240, 290))
    assert got == {0: (43, 0), 1: (8, want), 2: (2, 1)} and late.count() == want + 1 == dropped


def test_incremental_reconcile(spark, tmp_path):
    """Two batches in turn make the snapshot of one full run, and a repeated batch changes nothing."""
    base = f"file://{tmp_path}"
    schema = "url string, dir_url string, size long, last_modified timestamp, etag string, status int"
    file = lambda d, f, size, tag=None: (f"{d}{f}", d, size, None, tag, 200)
    days = [[file("d1/", "a", 1), file("d1/", "b", 2), file("d2/", "c", 3, '"t"')], [file("d1/", "a", 1), file("d1/", "b", 2), file("d3/", "e", 5)], [file("d2/", "c", 4, '"u"'), file("d3/", "e", 5)]]
    local = spark.createDataFrame([("d1/a", 9, None, None), ("d2/c", 3, None, '"t"'), ("d3/e", 5, None, None)], "url string, size long, mtime timestamp, cached_etag string")
    seen = {}

    def sink(changes, verdicts, n):
        seen[n] = ({(r.dir_url, r.change) for r in changes.collect()}, {(r.url, r.reason) for r in verdicts.collect()})

    def step():
        listing = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(f"{base}/in")
        M.incremental_reconcile(listing, lambda s: local, f"{base}/store", sink, f"{base}/progress").awaitTermination()

    load = lambda t: {tuple(r)[:-2] for r in N.load_snapshot(spark, f"{base}/store", M.SNAPSHOT[t], 1, 1 << 15, "2024-01-01", table=t).collect()}
    for k, rows in enumerate(days):
        spark.createDataFrame(rows, schema).write.parquet(f"{base}/in/{k}")
        step()
    assert seen[0] == ({("d1/", "new"), ("d2/", "new")}, {("d1/a", "size differs"), ("d1/b", "absent"), ("d2/c", "etag equal")})
    assert seen[1] == ({("d1/", "unchanged"), ("d3/", "new")}, {("d1/a", "directory unchanged"), ("d1/b", "absent"), ("d3/e", "same size")})
    assert seen[2] == ({("d2/", "changed"), ("d3/", "unchanged")}, {("d2/c", "etag differs"), ("d3/e", "directory unchanged")})
    files, dirs, last = load("files"), load("dirs"), seen[2]
    assert {r[0]: r[2] for r in files} == {"d1/a": 1, "d1/b": 2, "d2/c": 4, "d3/e": 5}
    for name in os.listdir(tmp_path / "progress" / "commits"):
        if name.strip(".crc") == "2":
            os.remove(tmp_path / "progress" / "commits" / name)
    step()  # the last batch once more
    assert (load("files"), load("dirs"), seen[2]) == (files, dirs, last) and N.manifests(spark, f"{base}/store").count() == 3
    shutil.rmtree(tmp_path / "in")
    whole = {r[0]: r for day in days for r in day}
    spark.createDataFrame(list(whole.values()), schema).write.parquet(f"{base}/full/in")
    listing = spark.readStream.schema(schema).parquet(f"{base}/full/in")
    M.incremental_reconcile(listing, lambda s: local, f"{base}/full/store", sink, f"{base}/full/progress").awaitTermination()
    full = {tuple(r)[:-2] for r in N.load_snapshot(spark, f"{base}/full/store", M.SNAPSHOT["dirs"], 1, 1 << 15, "2024-01-01", table="dirs").collect()}
    assert full == dirs


def test_kinds_of_roots():
    told = {"/x": True, "file:/x": True, "file:///x": True, "s3a://b/x": False, "viewfs://s/in": False, "hdfs:/x": False, "x/y": True}
    assert {k: S.is_mounted(k) for k in told} == told
