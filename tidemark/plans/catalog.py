"""Every operator as a query over the given tables, with DuckDB SQL for the same rows where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import anchors as A
from ..functions import headers as H
from ..functions import urls as U
from ..operators import links as L
from ..operators import logs as G
from ..operators import reconcile as R
from ..operators import transfers as X
from ..operators import trees as T
from ..session import new_folder
from ..sources import snapshots as N
from ..sources import tables as S
from ..streaming import logs as M
from .views import ROOT, oracle, view

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
AS_OF = "2024-01-31 00:00:00"
KNOWN_SLOW = ["host1.", "host7"]


def query(sql: str | None = None):
    """Register a function of (spark, sf_dir) under its name."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = oracle(sql)
        return f

    return add


def _remote(spark: SparkSession, d: str) -> DataFrame:
    return view(spark, d, "remote_files").withColumn("url", F.concat("dir_url", "filename"))


def _pages(spark: SparkSession, d: str) -> DataFrame:
    return S.read_pages(spark, f"{d}/pages.parquet")


_HREFS = """select url, unnest(h) as href, generate_subscripts(h, 1) - 1 as pos from (select url, list_filter(regexp_extract_all(html, 'href="([^"]*)"', 1) || regexp_extract_all(html, 'href=''([^'']*)''', 1),
 lambda x: x <> '' and not regexp_matches(x, '^(#|javascript:|mailto:)')) as h from pages)"""
_HOST = r"lower(regexp_extract(url, '^[A-Za-z]+://(?:[^/?#@]*@)?([^/?#:]*)', 1))"
_PATH = r"regexp_extract(url, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1)"


# Sources and sinks


@query("select url, 200 as status, html is null as failed, strlen(html) as n_bytes from pages")
def s1_read_pages(spark, d):
    return _pages(spark, d).select("url", "status", "failed", F.octet_length("html").cast("long").alias("n_bytes"))


@query("""with recursive f as (select concat(dir_url, filename) as u from remote_files), a as (select regexp_replace(u, '[^/]*$', '') as dir from f
 union select regexp_replace(dir, '[^/]+/$', '') from a where length(dir) > length('https://archive.example.org/')) select distinct dir from a""")
def s2_inventory_directories(spark, d):
    return S.directories_of(_remote(spark, d), "url")


@query()
def s2_read_inventory(spark, d):
    """The files and directories that hold the given tables themselves."""
    files, dirs = S.read_inventory(spark, d)
    name = lambda c: F.regexp_extract(c, "([^/]*/?)$", 1).alias("name")
    return files.select(name(F.col("path")), "size").union(dirs.select(name(F.rtrim("dir", F.lit("/"))), F.lit(None).cast("long")))


def _snapshots(spark, d):
    runs = [view(spark, d, "dir_signatures").select("dir_url", F.col(c).alias("signature"), F.lit(v).alias("schema_version"), F.lit(ts).cast("timestamp").alias("run_ts")) for c, v, ts in (("old_sig", 2, "2024-01-10"), ("new_sig", 2, "2024-01-20"), ("new_sig", 1, "2024-01-30"))]
    return runs[0].union(runs[1]).union(runs[2])


@query("select dir_url, new_sig as signature, 2 as schema_version from dir_signatures")
def s3_s4_latest_snapshot(spark, d):
    return S.latest_snapshot(_snapshots(spark, d), 2, 30, F.lit(AS_OF).cast("timestamp")).drop("run_ts")


@query("select dir_url, new_sig as signature, 2 as schema_version, timestamp '2024-01-20 00:00:00' as run_ts from dir_signatures")
def s3_s4_snapshot_store(spark, d):
    """Runs are written, one of them twice and one of another version, and the newest usable one is read back."""
    store = new_folder(spark, "snapshots")
    sig = view(spark, d, "dir_signatures")
    for column, version, ts in (("old_sig", 2, "2024-01-10"), ("old_sig", 2, "2024-01-20"), ("new_sig", 2, "2024-01-20"), ("old_sig", 1, "2024-01-30")):
        S.write_snapshot(sig.select("dir_url", F.col(column).alias("signature")), store, version, ts)
    out = S.load_snapshot(spark, store, "dir_url string, signature string", 2, 30, AS_OF)
    return out.withColumn("run_ts", F.col("run_ts").cast("timestamp_ntz"))


@query(f"""with h as ({_HREFS}), c as (select distinct url as dir_url, regexp_extract(url, '^([A-Za-z]+://[^/?#]*)', 1) || regexp_replace(href, '#.*$', '') as child from h where href not in ('../', './') and href not like '?%')
 select dir_url, count(*) filter (child not like '%/') as n_files, count(*) filter (child like '%/') as n_dirs, md5(string_agg(child, chr(10) order by child)) as content_hash from c group by dir_url""")
def s3_parsed_listings(spark, d):
    links = L.page_links(_pages(spark, d)).select(F.col("url").alias("dir_url"), F.col("child_url").alias("child"), "is_dir")
    return N.parsed_listings(links)[1]


@query("""select domain, count(*) as n, max(epoch_us(ts)) // 1000000 as last_s from (select *, row_number() over (partition by domain order by ts desc) as rn from request_log where status in (429, 503)) where rn <= 20 group by domain""")
def s5_s6_incident_store(spark, d):
    hit = view(spark, d, "request_log").where(F.col("status").isin(429, 503)).withColumn("ts", F.col("ts").cast("timestamp"))
    kept = S.newest_incidents(hit.select("domain", "ts"))
    per = kept.groupBy("domain").agg(F.collect_list(F.unix_micros("ts") / 1e6).alias("times"))
    raw = per.select(F.to_json(F.struct(F.struct(F.lit(1).alias("version")).alias("_meta"), F.create_map("domain", F.col("times")).alias("domains"))).alias("value"))
    return S.parse_incidents(raw).groupBy("domain").agg(F.count("*").alias("n"), F.floor(F.max(F.unix_micros("ts")) / 1000000).alias("last_s"))


@query("""select key, size from (select trim(concat(' ', filename)) as key, size, row_number() over (partition by trim(concat(' ', filename)) order by k) as rn from remote_files) where rn = 1 and key <> ''""")
def s7_sanitize_keyed(spark, d):
    return S.sanitize_keyed(view(spark, d, "remote_files").select(F.concat(F.lit(" "), "filename").alias("key"), "size", "k"), "key", "k")[0].select("key", "size")


@query("""select status, n, 'https://archive.example.org/run?<redacted>' as url from (select cast(status as varchar) as status, count(*) as n from request_log group by 1)""")
def s8_run_metrics(spark, d):
    per = view(spark, d, "request_log").groupBy(F.col("status").cast("string").alias("status")).agg(F.count("*").alias("n"))
    return per.withColumn("url", U.redact_url(F.lit("https://me:pw@archive.example.org/run?token=1#x")))


@query(r"""select domain, count(*) as n, 'https://' || domain || '/run?<redacted>' as url from request_log group by domain""")
def s8_metrics_written(spark, d):
    """Written as JSON with its URLs redacted, and read back."""
    path = new_folder(spark, "metrics")
    per = view(spark, d, "request_log").groupBy("domain").agg(F.count("*").alias("n"))
    S.write_metrics(per.withColumn("url", F.concat(F.lit("https://me:pw"), F.col("n").cast("string"), F.lit("@"), "domain", F.lit("/run?token=1#x"))), path, ["url"])
    return spark.read.schema("domain string, n bigint, url string").json(path)


@query("""select case when count(*) > 0 then 'healthy' else 'degraded' end as status, count(*) > 0 and count(*) filter (status >= 400 and status <> 404) < 10 as is_healthy, count(*) filter (status >= 400 and status <> 404) as failed from request_log""")
def s9_health_record(spark, d):
    log = view(spark, d, "request_log")
    summary = G.run_summary(log).select((F.col("downloaded") > 0).alias("ok"), "failed")
    return S.health_record(summary, G.errors_by_type(log.where("status >= 400").select(F.col("status").alias("type"))), G.latency_stats(log)).select("status", "is_healthy", "failed")


@query("""with e as (select cast(status as varchar) as type, count(*) as n from request_log where status >= 400 group by 1), o as (select operation, least(count(*), 1000) as n from request_log group by 1)
 select (select count(*) from e) as n_error_types, (select count(*) from o) as n_operations, (select string_agg(type || ':' || n, ',' order by n desc, type) from (select * from e order by n desc, type limit 2)) as errors, (select string_agg(operation || ':' || n, ',' order by n desc, operation) from (select * from o order by n desc, operation limit 2)) as latency""")
def s9_health_details(spark, d):
    log = view(spark, d, "request_log")
    summary = G.run_summary(log).select((F.col("downloaded") > 0).alias("ok"), "failed")
    errors = G.errors_by_type(log.where("status >= 400").select(F.col("status").cast("string").alias("type")))
    told = S.health_record(summary, errors, G.latency_stats(log), 2)
    shown = lambda c, name: F.array_join(F.transform(c, lambda x: F.concat_ws(":", x[name], x["n"].cast("string"))), ",").alias(c)
    return told.select("n_error_types", "n_operations", shown("errors", "type"), shown("latency", "operation"))


# Projections


@query(_HREFS)
def p1_extract_links(spark, d):
    return L.extract_links(_pages(spark, d)).select("url", "href", F.col("pos").cast("long"))


@query(_HREFS)
def p2_extract_links_auto(spark, d):
    return L.extract_links(_pages(spark, d), "auto").select("url", "href", F.col("pos").cast("long"))


_SHOWN = r"regexp_replace(regexp_replace(html, '(?is)<!--.*?-->', ' ', 'g'), '(?is)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g')"


@query(rf"""select url, replace(replace(h, '&quot;', '"'), '&amp;', '&') as href, pos from (select url, unnest(hs) as h, generate_subscripts(hs, 1) - 1 as pos from (select url, regexp_extract_all({_SHOWN}, '(?i)<a\s[^>]*href="([^"]*)"', 1) as hs from pages)) where h <> '' and not regexp_matches(h, '^(#|javascript:|mailto:)')""")
def p2_anchor_links(spark, d):
    """Anchors alone, as a document tree gives them."""
    pages = _pages(spark, d)
    kept = pages.select("url", F.posexplode(A.all_anchors(F.col("html"))).alias("pos", "href"))
    return kept.where(~F.col("href").rlike("^$|^(#|javascript:|mailto:)")).select("url", "href", F.col("pos").cast("long"))


@query(f"with h as ({_HREFS}) select url, pos, regexp_extract(url, '^([A-Za-z]+://[^/?#]*)', 1) || regexp_replace(href, '#.*$', '') as child_url, regexp_replace(href, '#.*$', '') like '%/' as is_dir from h where href not in ('../', './') and href not like '?%'")
def p3_resolve_links(spark, d):
    return L.page_links(_pages(spark, d)).select("url", F.col("pos").cast("long"), "child_url", "is_dir")


@query(rf"""select url, regexp_extract(url, '^([A-Za-z]+):', 1) as scheme, regexp_extract(url, '^[A-Za-z]+://([^/?#]*)', 1) as netloc, {_HOST} as host, {_PATH} as path,
 regexp_extract(url, '^[^?#]*\?([^#]*)', 1) as query, regexp_extract(url, '#(.*)$', 1) as fragment from pages""")
def p4_url_parts(spark, d):
    return _pages(spark, d).select("url", U.url_parts(F.col("url")).alias("p")).select("url", "p.scheme", "p.netloc", "p.host", "p.path", "p.query", "p.fragment")


@query(rf"""select url, regexp_extract(url, '://[^/]*(/.*)$', 1) as tail, regexp_extract(regexp_extract(url, '://[^/]*(/.*)$', 1), '([^/]*)$', 1) as filename,
 case when rtrim({_PATH}, '/') = '' then 'root' else regexp_extract(rtrim({_PATH}, '/'), '([^/]*)$', 1) end as last, regexp_extract(url, '^(.*/)', 1) as parent, url like '%/' as is_dir from pages""")
def p5_p10_url_columns(spark, d):
    u = F.col("url")
    return _pages(spark, d).select("url", U.url_tail(u).alias("tail"), U.url_filename(u).alias("filename"), U.last_component(u).alias("last"), U.parent_url(u).alias("parent"), U.is_directory(u).alias("is_dir"))


@query(r"select url, regexp_replace(regexp_replace(url, '#.*$', ''), '\?.+$', '?<redacted>') as redacted from pages")
def p11_redact_url(spark, d):
    return _pages(spark, d).select("url", U.redact_url(F.col("url")).alias("redacted"))


@query("select dir_url, trim(substr(dir_url, length('https://archive.example.org/data/') + 1), '/') as rel from (select distinct dir_url from remote_files)")
def p12_relative_path(spark, d):
    return view(spark, d, "remote_files").select("dir_url").distinct().select("dir_url", U.relative_path(F.col("dir_url"), F.lit(ROOT)).alias("rel"))


@query(rf"with p as (select url, {_PATH} as path from pages) select url, case when regexp_extract(path, '([^/]*)$', 1) <> '' then url_decode(regexp_extract(path, '([^/]*)$', 1)) else 'index' end as name, url_decode(path) as decoded from p")
def p7_p13_decoded_names(spark, d):
    name = U.download_name(F.col("url"))
    return _pages(spark, d).select("url", F.when(name.rlike("^index_[0-9a-f]+[.]html$"), "index").otherwise(name).alias("name"), U.percent_decode(U.path(F.col("url"))).alias("decoded"))


@query(rf"""with p as (select page_id, case when page_id % 2 = 0 then regexp_extract(url, '^([A-Za-z]+://[^/?#]*)', 1) || '/' || page_id || '/' else url end as url from pages) select page_id, case when url like '%/' then true else false end as fallback, case when url like '%/' then 'index_.html' else url_decode(regexp_extract({_PATH}, '([^/]*)$', 1)) end as name from p""")
def p7_download_names(spark, d):
    """Half of the pages are directories: their names are made of a hash (of 1 to 8 hex digits, which SQL can't compute)."""
    pages = _pages(spark, d).withColumn("u", F.when(F.col("page_id") % 2 == 0, F.concat(U.scheme(F.col("url")), F.lit("://"), U.netloc(F.col("url")), F.lit("/"), F.col("page_id").cast("string"), F.lit("/"))).otherwise(F.col("url")))
    told = pages.select("page_id", U.download_name(F.col("u")).alias("name"), F.lower(F.hex(F.crc32("u"))).alias("crc"))
    made = F.col("name") == F.concat(F.lit("index_"), "crc", F.lit(".html"))
    return told.select("page_id", made.alias("fallback"), F.when(made, "index_.html").otherwise(F.col("name")).alias("name"))


@query(r"select url, regexp_replace(url, '^([A-Za-z]+://[^/?#]*).*$', '\1') || array_to_string([url_encode(x) for x in string_split(url_decode(regexp_extract(url, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1)), '/')], '/') || regexp_extract(url, '^[^?#]*(\?[^#]*)', 1) as normal from pages")
def p14_p15_normalize_url(spark, d):
    return _pages(spark, d).select("url", U.normalize_url(F.col("url")).alias("normal"))


@query(rf"select url, case when {_PATH} = '' then '' else regexp_replace({_PATH}, '/+', '/', 'g') end as normal from pages")
def p16_normalize_path(spark, d):
    return _pages(spark, d).select("url", U.normalize_path(U.path(F.col("url"))).alias("normal"))


@query("""select url, coalesce(trim(regexp_replace(etag, '^[Ww]/', ''), '"'), '') as etag from (select concat(dir_url, filename) as url, etag from remote_files)""")
def p17_normalize_etag(spark, d):
    return _remote(spark, d).select("url", H.normalize_etag(F.col("etag")).alias("etag"))


@query("select o_orderkey, o_orderdate as parsed from orders")
def p18_parse_http_date(spark, d):
    told = F.date_format("o_orderdate", "EEE, dd MMM yyyy HH:mm:ss").alias("h")
    return view(spark, d, "orders").select("o_orderkey", told).select("o_orderkey", H.parse_http_date(F.concat("h", F.lit(" GMT"))).cast("timestamp_ntz").alias("parsed"))


@query("""select event_id, case when event_id % 3 = 0 then cast(least(event_id % 90, 60) as double) when event_id % 3 = 1 then least(60.0::double, greatest(0.0::double, cast(event_id % 100 - 20 as double))) end as wait_s,
 least(pow(2.0, event_id % 9), 60.0)::double as backoff_s from events""")
def p19_p20_retry_waits(spark, d):
    at = F.lit("2026-07-31 07:00:00").cast("timestamp")
    date = F.date_format(F.timestamp_seconds(F.unix_timestamp(at) + F.col("event_id") % 100 - 20), "EEE, dd MMM yyyy HH:mm:ss")
    value = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit(" "), (F.col("event_id") % 90).cast("string"))).when(F.col("event_id") % 3 == 1, F.concat(date, F.lit(" GMT"))).otherwise("soon")
    return view(spark, d, "events").select("event_id", H.retry_after_seconds(value, at).alias("wait_s"), H.backoff_seconds(F.col("event_id") % 9).alias("backoff_s"))


@query("""select url, case when size < 1024 then printf('%.2f B', size::double) when size < 1048576 then printf('%.2f KB', size / 1024.0::double) when size < 1073741824 then printf('%.2f MB', size / 1048576.0::double) else printf('%.2f GB', size / 1073741824.0::double) end as shown,
 (size // 3600) || 'h ' || (size % 3600 // 60) || 'm ' || (size % 60) || 's' as spent from (select concat(dir_url, filename) as url, size from remote_files)""")
def p21_format(spark, d):
    return _remote(spark, d).select("url", H.format_bytes(F.col("size")).alias("shown"), H.format_duration(F.col("size")).alias("spent"))


@query("""select o_orderkey, case when o_orderkey % 5 = 0 then '_CON.txt' when o_orderkey % 5 = 1 then 'c' || o_orderkey || '.fits' when o_orderkey % 5 = 2 then 'a_b' || o_orderkey when o_orderkey % 5 = 3 then repeat('x', 11) || '.fits' else 'unnamed' end as safe from orders""")
def p22_safe_filename(spark, d):
    k, n = F.col("o_orderkey") % 5, F.col("o_orderkey").cast("string")
    raw = F.when(k == 0, "CON.txt").when(k == 1, F.concat(F.lit("a/b/c"), n, F.lit("\x01.fits"))).when(k == 2, F.concat(F.lit("a\\b"), n)).when(k == 3, F.concat(F.repeat(F.lit("x"), 40), F.lit(".fits"))).otherwise("")
    return view(spark, d, "orders").select("o_orderkey", U.safe_filename(raw, 16).alias("safe"))


@query("select url, substr(url, length('https://archive.example.org/data/') + 1) as key from (select concat(dir_url, filename) as url from remote_files)")
def p23_local_key(spark, d):
    return _remote(spark, d).select("url", U.local_key(F.col("url"), F.lit(ROOT)).alias("key"))


@query("select n_name, 'https://archive.example.org/data/' || lower(replace(n_name, ' ', '_')) || '/' as root from nation")
def p24_target_root(spark, d):
    return view(spark, d, "nation").select("n_name", U.target_root(F.lit(ROOT), F.lower(F.replace("n_name", F.lit(" "), F.lit("_")))).alias("root"))


@query("""with s as (select distinct dir_url, substr(dir_url, length('https://archive.example.org/data/') + 1) as x, length(dir_url) % 5 as m from remote_files), t as (select dir_url, case m when 0 then '../' || x when 1 then '/' || x when 2 then replace(x, '/c', '//c') when 3 then '' else x end as suffix, m, x from s)
 select dir_url, suffix, case when m = 3 then 'https://archive.example.org/data/' when m = 4 then 'https://archive.example.org/data/' || x end as root from t""")
def p24_target_roots(spark, d):
    """Suffixes that climb, are absolute, have an empty segment, are missing, or fit."""
    s = view(spark, d, "remote_files").select("dir_url").distinct()
    x, m = F.substr("dir_url", F.lit(len(ROOT) + 1)), F.length("dir_url") % 5
    suffix = F.when(m == 0, F.concat(F.lit("../"), x)).when(m == 1, F.concat(F.lit("/"), x)).when(m == 2, F.replace(x, F.lit("/c"), F.lit("//c"))).when(m == 3, F.lit("")).otherwise(x)
    return s.withColumn("suffix", suffix).withColumn("root", U.target_root(F.lit(ROOT), F.col("suffix")))


@query("select doc_id, md5(text) as md5, sha256(text) as sha256 from documents")
def p25_content_signature(spark, d):
    c = F.encode("text", "UTF-8")
    return view(spark, d, "documents").select("doc_id", H.content_signature(c, "md5").alias("md5"), H.content_signature(c).alias("sha256"))


@query("""select dir_url, md5(string_agg(url, chr(10) order by url)) as signature from (select dir_url, concat(dir_url, filename) as url from remote_files) group by dir_url""")
def p25_listing_signature(spark, d):
    return H.listing_signatures(_remote(spark, d), "dir_url", "url")


@query()
def p25_blake2b_signature(spark, d):
    """BLAKE2b is in no SQL of DuckDB's; a test holds it against hashlib."""
    return view(spark, d, "documents").select("doc_id", H.content_signature(F.encode("text", "UTF-8"), "blake2b").alias("blake2b"))


@query("""select url, coalesce('etag:' || trim(regexp_replace(etag, '^[Ww]/', ''), '"'), 'mtime:' || strftime(last_modified, '%Y-%m-%d %H:%M:%S'), 'url:' || url) as signature from (select concat(dir_url, filename) as url, * from remote_files)""")
def p26_dir_signature(spark, d):
    return _remote(spark, d).select("url", H.dir_signature(F.col("url"), F.lit(None).cast("string"), F.col("etag"), F.col("last_modified")).alias("signature"))


@query("""select url, case when k % 3 = 0 then 'content:' || md5(url) when etag is not null then 'etag:' || trim(regexp_replace(etag, '^[Ww]/', ''), '"') when last_modified is not null then 'mtime:' || strftime(last_modified, '%Y-%m-%d %H:%M:%S') else 'url:' || url end as signature from (select concat(dir_url, filename) as url, * from remote_files)""")
def p26_signature_by_content(spark, d):
    content = F.when(F.col("k") % 3 == 0, F.md5("url")).when(F.col("k") % 3 == 1, F.lit(""))
    return _remote(spark, d).select("url", H.dir_signature(F.col("url"), content, F.col("etag"), F.col("last_modified")).alias("signature"))


@query("""select url, cast(i as integer) as chunk_id, i * (size // n) as start_byte, case when i = n - 1 then size - 1 else (i + 1) * (size // n) - 1 end as end_byte
 from (select url, size, n, unnest(range(n)) as i from (select concat(dir_url, filename) as url, size, greatest(2, least(8, size // 10485760)) as n from remote_files where size >= 10485760))""")
def p27_plan_ranges(spark, d):
    return X.plan_ranges(_remote(spark, d))


@query("""select r.url, case when coalesce(l.size, 0) // 2 < r.size then coalesce(l.size, 0) // 2 else 0 end as "offset", case when coalesce(l.size, 0) // 2 < r.size and coalesce(l.size, 0) // 2 > 0 then 'bytes=' || (l.size // 2) || '-' end as range_header
 from (select concat(dir_url, filename) as url, size from remote_files) r left join local_files l using (url)""")
def p28_resume_plan(spark, d):
    return X.resume_plan(_remote(spark, d), view(spark, d, "local_files").withColumn("size", F.floor(F.col("size") / 2)))


# Filters


@query("""select concat(dir_url, filename) as url from remote_files where lower(filename) like '%.png' or contains(lower(filename), 'o12') or regexp_matches(filename, '(?i)^O9\\d+[.]f')""".replace("\\\\", "\\"))
def f1_match_files(spark, d):
    return L.match_files(_remote(spark, d), [".png", "O12", r"^O9\d+[.]f"]).select("url")


@query("""select dir_url from (select distinct dir_url from remote_files) where not (rtrim(dir_url, '/') like '%/c7' or rtrim(dir_url, '/') like '%9' or regexp_matches(rtrim(dir_url, '/'), 'fr.*/c1(/|$)'))""")
def f2_exclude_dirs(spark, d):
    return L.exclude_dirs(view(spark, d, "remote_files").select("dir_url").distinct(), ["/c7", "9", "fr*/c1"])


@query(f"with h as ({_HREFS}) select count(*) as n_links, count(*) filter (href not in ('../', './') and href not like '?%') as n_content from h")
def f3_skip_navigation(spark, d):
    return L.extract_links(_pages(spark, d)).agg(F.count("*").alias("n_links"), F.count_if(~F.col("href").isin("../", "./") & ~F.col("href").startswith("?")).alias("n_content"))


@query(f"with h as ({_HREFS}) select url, pos from h where href not in ('../', './') and href not like '?%'")
def f3_content_links(spark, d):
    """Through the operator: parent, self and query links are added to each page first, and must go."""
    pages = _pages(spark, d).withColumn("html", F.concat("html", F.lit('<a href="../">u</a><a href="./">s</a><a href="?C=M;O=A">m</a>')))
    return L.page_links(pages).select("url", F.col("pos").cast("long"))


_MIXED = "case when page_id % 4 = 0 then replace(url, 'https:', 'ftp:') when page_id % 4 = 1 then replace(url, '.example.', '.example.net.') else url end"


@query(rf"select page_id, u, regexp_matches(u, '(?i)^https?://') as scheme_ok, regexp_matches(u, '(?i)^https?://') and regexp_extract(u, '^[A-Za-z]+://([^/?#]*)', 1) = regexp_extract((select min(url) from pages), '^[A-Za-z]+://([^/?#]*)', 1) as in_scope from (select page_id, {_MIXED} as u from pages)")
def f4_f6_scope(spark, d):
    pages = view(spark, d, "pages")
    first = pages.agg(F.concat(F.regexp_extract(F.min("url"), "^([A-Za-z]+://[^/?#]*)", 1), F.lit("/")).alias("base"))
    mixed = pages.select("page_id", F.expr(_MIXED).alias("u"))
    return mixed.crossJoin(F.broadcast(first)).select("page_id", "u", U.has_web_scheme(F.col("u")).alias("scheme_ok"), L.in_base_scope(F.col("u"), F.col("base")).alias("in_scope"))


_ODD_URL = "case when o_orderkey % 8 = 0 then 'ftp://archive.example.org/data/a' when o_orderkey % 8 = 1 then 'https://u@archive.example.org/data/' when o_orderkey % 8 = 2 then 'https://archive.example.org.evil.net/data/x' when o_orderkey % 8 = 3 then 'https://archive.example.org/data/../x' when o_orderkey % 8 = 4 then 'https://10.0.0.' || cast(o_orderkey % 250 as S) || '/data/' when o_orderkey % 8 = 5 then 'https://archive.example.org:22/data/' when o_orderkey % 8 = 6 then 'https://archive.example.org/data/%2e%2e/x' else 'https://archive.example.org/data/o' || cast(o_orderkey as S) end"


@query("""select o_orderkey, case o_orderkey % 8 when 0 then 'scheme' when 3 then 'traversal' when 6 then 'encoded traversal' end as scope, case o_orderkey % 8 when 0 then 'scheme' when 1 then 'userinfo' when 2 then 'other domain' when 3 then 'traversal' when 4 then 'private ip' when 5 then 'port' when 6 then 'encoded traversal' end as verdict from orders""")
def f5_f7_url_verdicts(spark, d):
    odd = view(spark, d, "orders").select("o_orderkey", F.expr(_ODD_URL.replace("as S)", "as string)")).alias("u"))
    return odd.select("o_orderkey", U.scope_verdict(F.col("u"), F.lit(ROOT)).alias("scope"), U.url_security_verdict(F.col("u"), F.lit(ROOT)).alias("verdict"))


_IP = "concat(cast(o_orderkey % 256 as S), '.', cast(o_custkey % 256 as S), '.0.', cast(o_orderkey % 7 as S))"
_PRIVATE = "(o_orderkey % 256 in (0, 10, 127) or o_orderkey % 256 >= 240 or (o_orderkey % 256 = 172 and o_custkey % 256 between 16 and 31) or (o_orderkey % 256 = 192 and o_custkey % 256 in (0, 168) and (o_custkey % 256 = 168 or o_orderkey % 7 < 8)) or (o_orderkey % 256 = 169 and o_custkey % 256 = 254) or (o_orderkey % 256 = 198 and o_custkey % 256 in (18, 19)))"


@query(f"select o_orderkey, {_IP.replace('as S)', 'as varchar)')} as ip, {_PRIVATE} as private from orders")
def f8_private_ips(spark, d):
    return view(spark, d, "orders").select("o_orderkey", F.expr(_IP.replace("as S)", "as string)")).alias("ip")).withColumn("private", U.is_private_ip(F.col("ip")))


@query(f"select o_custkey as host, arg_min({_IP.replace('as S)', 'as varchar)')}, o_orderkey) as ip from orders group by o_custkey having not bool_or({_PRIVATE})")
def f9_safe_hosts(spark, d):
    return L.safe_hosts(view(spark, d, "orders").select(F.col("o_custkey").alias("host"), F.col("o_orderkey").alias("pos"), F.expr(_IP.replace("as S)", "as string)")).alias("ip")))


@query("select distinct domain, contains(domain, 'host1.') or contains(domain, 'host7') as known from request_log")
def f10_known_throttled(spark, d):
    return view(spark, d, "request_log").select("domain").distinct().withColumn("known", L.throttled_name(F.col("domain"), KNOWN_SLOW))


@query("select event_id from request_log where ts >= timestamp '2024-01-24 00:00:00'")
def f11_fresh_entries(spark, d):
    return R.fresh_entries(view(spark, d, "request_log"), "ts", 7 * 86400, F.lit(AS_OF)).select("event_id")


@query("select concat(domain, '/', event_id % 400) as path, max(ts) as last_activity from request_log where ts < timestamp '2024-01-30 12:00:00' group by 1 having max(ts) < timestamp '2024-01-30 00:00:00'")
def f12_stale_partials(spark, d):
    log = view(spark, d, "request_log").where("ts < timestamp_ntz '2024-01-30 12:00:00'")
    return X.stale_partials(log.select(F.concat("domain", F.lit("/"), (F.col("event_id") % 400).cast("string")).alias("path"), F.col("ts").alias("last_activity")), F.lit(AS_OF))


@query("select concat(dir_url, filename) as url, size >= 10485760 as splittable from remote_files")
def f13_splittable(spark, d):
    return _remote(spark, d).select("url", X.splittable(F.col("size")).alias("splittable"))


# Joins

_R = "(select concat(dir_url, filename) as url, * from remote_files)"
_ETAG = """trim(regexp_replace(coalesce({c}, ''), '^[Ww]/', ''), '"')"""
_FRESH = f"""select r.url, case
  when l.url is null then 'absent'
  {{first}}
  when g.old_sig = g.new_sig and g.new_sig not like 'url:%' then 'directory unchanged'
  when r.status = 304 then 'not modified' {{skips}} when r.status <> 200 then 'other status'
  when {_ETAG.format(c="l.cached_etag")} <> '' and {_ETAG.format(c="r.etag")} <> '' then case when {_ETAG.format(c="l.cached_etag")} = {_ETAG.format(c="r.etag")} then 'etag equal' else 'etag differs' end
  when cast(r.last_modified as timestamp) > l.mtime + interval '1500' millisecond then 'newer' when r.last_modified is not null then 'not newer'
  {{sizes}} end as reason
 from {_R} r left join local_files l using (url) left join dir_signatures g using (dir_url)"""
_NEED = "reason in ('absent', 'other status', 'gone', 'etag differs', 'newer', 'size differs') as needs_download"


def _fresh(first: str = "", skips: str = "", sizes: str = "when coalesce(r.size, 0) <> l.size then 'size differs' else 'same size'") -> str:
    return f"select url, reason, {_NEED} from ({_FRESH.format(first=first, skips=skips, sizes=sizes)})"


@query(f"select url from {_R} where url not in (select url from local_files)")
def j1_missing_files(spark, d):
    return R.missing_files(_remote(spark, d), view(spark, d, "local_files")).select("url")


@query(_fresh())
def j2_classify_freshness(spark, d):
    return R.classify_freshness(_remote(spark, d), view(spark, d, "local_files"), view(spark, d, "dir_signatures"))


@query(_fresh(skips="when r.status in (403, 410, 451) then 'skipped' when r.status = 404 then 'gone'", sizes="else 'assumed current'").replace("when l.url is null then 'absent'", "when g.old_sig = g.new_sig and g.new_sig not like 'url:%' then 'directory unchanged' when l.url is null then 'absent'"))
def j3_freshness_async(spark, d):
    return R.classify_freshness(_remote(spark, d), view(spark, d, "local_files"), view(spark, d, "dir_signatures"), variant="async")


@query(_fresh(first="when coalesce(r.size, 0) = l.size and r.status = 200 then 'same size'"))
def j4_freshness_without_cache(spark, d):
    return R.classify_freshness(_remote(spark, d), view(spark, d, "local_files"), view(spark, d, "dir_signatures"), use_cache=False)


@query("""select coalesce(a.dir_url, b.dir_url) as dir_url, case when a.dir_url is null then 'new' when b.dir_url is null then 'gone' when new_sig like 'url:%' then 'untrusted' when old_sig = new_sig then 'unchanged' else 'changed' end as change
 from (select dir_url, old_sig from dir_signatures where length(dir_url) % 5 <> 0) a full join (select dir_url, new_sig from dir_signatures where length(dir_url) % 7 <> 0) b on a.dir_url = b.dir_url""")
def j5_diff_signatures(spark, d):
    s = view(spark, d, "dir_signatures")
    return R.diff_signatures(s.where("length(dir_url) % 5 <> 0").select("dir_url", F.col("old_sig").alias("signature")), s.where("length(dir_url) % 7 <> 0").select("dir_url", F.col("new_sig").alias("signature")))


_OBSOLETE = f"select url from local_files where url not in (select url from {_R})"


@query(_OBSOLETE)
def j6_obsolete_files(spark, d):
    return R.obsolete_files(view(spark, d, "local_files"), _remote(spark, d), _pages(spark, d)).select("url")


@query(f"select url, failed from ({_OBSOLETE}), (values (false), (true)) t(failed) where not failed")
def j6_gated_by_failures(spark, d):
    """Twice: with the listings as they are, and with one that failed, after which nothing counts as obsolete."""
    local, remote, pages = view(spark, d, "local_files"), _remote(spark, d), _pages(spark, d)
    bad = pages.withColumn("failed", F.col("page_id") == F.lit(0))
    runs = [R.obsolete_files(local, remote, p).select("url", F.lit(failed).alias("failed")) for p, failed in ((pages, False), (bad, True))]
    return runs[0].union(runs[1])


@query(f"select url from {_R} where lower(filename) like '%.txt' or contains(lower(filename), '77') or regexp_matches(filename, '(?i)^o5.*png$')")
def j7_match_patterns(spark, d):
    patterns = spark.createDataFrame([("suffix", ".TXT"), ("substring", "77"), ("regex", "^o5.*png$")], "kind string, pattern string")
    return L.match_patterns(_remote(spark, d), patterns, F.col("filename")).select("url")


_PATTERNS = """select 'suffix' as kind, concat(cast(o_orderkey % 5000 as S), '.PNG') as pattern from orders where o_orderkey % 40 = 1 union all select 'substring', concat('O', cast(o_orderkey as S)) from orders where o_orderkey % 300 = 7
 union all select 'regex', concat('^o', cast(o_custkey as S), '[0-9]+[.](fits|txt)$') from orders where o_orderkey % 500 = 3 union all select 'regex', '^[a-z]99+[.]' from orders where o_orderkey = 1"""


@query(f"""with p as ({_PATTERNS.replace(" as S)", " as varchar)")}) select distinct url from {_R} r, (select distinct * from p) where case kind when 'suffix' then ends_with(lower(filename), lower(pattern)) when 'substring' then contains(lower(filename), lower(pattern)) else regexp_matches(filename, '(?i)' || pattern) end""")
def j7_match_pattern_table(spark, d):
    """A pattern table that grows with the input."""
    view(spark, d, "orders").createOrReplaceTempView("tidemark_orders")
    patterns = spark.sql(_PATTERNS.replace(" as S)", " as string)").replace("from orders", "from tidemark_orders"))
    return L.match_patterns(_remote(spark, d), patterns, F.col("filename")).select("url")


@query(f"select url as key from local_files where url not in (select url from {_R})")
def j8_stale_metadata(spark, d):
    return R.stale_metadata(view(spark, d, "local_files").select(F.col("url").alias("key")), _remote(spark, d).select(F.col("url").alias("key")))


_THROTTLED = "select lower(domain) as domain, count(*) as incidents from request_log where status in (429, 503) and ts >= timestamp '2024-01-17 00:00:00' and ts <= timestamp '2024-01-31 00:00:00' group by 1 having count(*) >= 5"


@query(f"with t as ({_THROTTLED}) select d.domain, t.domain is not null or contains(d.domain, 'host1.') or contains(d.domain, 'host7') as throttled, case when t.domain is not null or contains(d.domain, 'host1.') or contains(d.domain, 'host7') then 3 else 5 end as level from (select distinct domain from request_log) d left join t using (domain)")
def j9_domain_profile(spark, d):
    log = view(spark, d, "request_log")
    return R.domain_profile(log.select("domain").distinct(), G.throttled_domains(log, F.lit(AS_OF).cast("timestamp")), KNOWN_SLOW)


_EXTRA = "select o_orderkey as k, concat('https://archive.example.org/', x, cast(o_orderkey as S)) as src, concat(case when x = 'out' then 'https://mirror.example.net/' else 'https://archive.example.org/' end, y, cast(o_orderkey as S)) as dst from orders, (values ('a', 'b'), ('b', 'a'), ('out', 'c')) t(x, y) where o_orderkey % 50 = 0"


@query(f"""with recursive c as (select src, dst, 1 as hops from redirects union all select c.src, r.dst, c.hops + 1 from c join redirects r on c.dst = r.src where c.hops < 11)
 select src, arg_max(dst, hops) filter (hops <= 10) as final_url, cast(least(max(hops), 10) as integer) as hops, case when max(hops) > 10 then 'too long' else 'resolved' end as outcome from c group by src
 union all select src, case when contains(src, '/out') then src else dst end, case when contains(src, '/out') then 0 else 1 end, case when contains(src, '/out') then 'blocked' else 'loop' end from ({_EXTRA.replace("as S)", "as varchar)")})""")
def j10_resolve_redirects(spark, d):
    view(spark, d, "orders").createOrReplaceTempView("tidemark_orders")
    extra = spark.sql(_EXTRA.replace("as S)", "as string)").replace("from orders", "from tidemark_orders")).select("src", "dst")
    return T.resolve_redirects(view(spark, d, "redirects").select("src", "dst").union(extra), lambda u: u.startswith("https://archive.example.org/"))


@query(f"""select url as path, case when url in (select replace(url, '/old_', '/') from ({_OBSOLETE}) where length(url) % 2 = 0) then url else replace(url, '/data/', '/trash/') end as target from ({_OBSOLETE}) where false
 union all select url, case when length(url) % 2 = 0 then regexp_replace(replace(url, '/data/', '/trash/'), '^(.*)([.][^.]*)$', '\\1_1700000000000\\2') else replace(url, '/data/', '/trash/') end from ({_OBSOLETE})""")
def j11_move_plan(spark, d):
    gone = R.obsolete_files(view(spark, d, "local_files"), _remote(spark, d), _pages(spark, d))
    gone = gone.select(F.col("url").alias("path"), F.replace("url", F.lit("/data/"), F.lit("/trash/")).alias("target"))
    return R.move_plan(gone, gone.where("length(path) % 2 = 0").select(F.col("target").alias("path")), 1_700_000_000_000)


@query(f"select count(*) as n, cast(sum(coalesce(r.size, 0)) as bigint) as bytes from local_files l left join {_R} r using (url)")
def j12_download_sizes(spark, d):
    return R.with_sizes(view(spark, d, "local_files").select("url"), _remote(spark, d)).agg(F.count("*").alias("n"), F.sum("size").alias("bytes"))


# Aggregations


@query("select dir_url, least(count(*), 3) as shown, count(*) as total from remote_files group by dir_url")
def a1_shown_of_total(spark, d):
    return T.shown_of_total(view(spark, d, "remote_files"), 3)


@query(f"""with recursive a as (select regexp_replace(url, '[^/]*$', '') as dir, size from {_R} union all select regexp_replace(dir, '[^/]+/$', ''), size from a where length(dir) > length('https://archive.example.org/'))
 select dir, count(*) as n_files, cast(sum(size) as bigint) as size from a group by dir""")
def a2_dir_sizes(spark, d):
    return T.dir_sizes(_remote(spark, d))


@query("select operation as metric, cast(sum(bytes) as bigint) as value from request_log group by 1")
def a3_run_counters(spark, d):
    return G.run_counters(view(spark, d, "request_log").select(F.col("operation").alias("metric"), F.col("bytes").alias("value")))


@query("""select count(*) filter (status = 200) as downloaded, count(*) filter (status in (304, 403, 404, 410, 451)) as skipped, count(*) filter (status >= 400 and status not in (403, 404, 410, 451)) as failed,
 cast(sum(bytes) filter (status = 200) as bigint) as bytes, round(avg(rtt_ms), 6) as mean_ms, round(sum(bytes) filter (status = 200) / (sum(rtt_ms) filter (status = 200) / 1000), 4) as bytes_per_s from request_log""")
def a4_run_summary(spark, d):
    return G.run_summary(view(spark, d, "request_log")).withColumn("mean_ms", F.round("mean_ms", 6)).withColumn("bytes_per_s", F.round("bytes_per_s", 4))


@query("""select (select count(*) from pages) as pages_parsed, round((select sum(strlen(html)) from pages) / 1000000.0, 6)::double as parse_mb, round((select sum(strlen(html)) / 1000000.0::double / (sum(page_id % 50 + 1) / 1000.0::double) from pages), 6) as parse_mb_per_s,
 count(*) as lookups, count(*) filter (rtt_ms < 500) as hits, round(count(*) filter (rtt_ms < 500) * 100.0::double / count(*), 6) as hit_pct, count(*) filter (status = 200) as downloaded from request_log""")
def a4_run_report(spark, d):
    log = view(spark, d, "request_log")
    parses = _pages(spark, d).select(F.octet_length("html").alias("bytes"), (F.col("page_id") % 50 + 1).alias("ms"))
    told = G.run_report(log, parses, log.select(F.col("operation").alias("cache"), (F.col("rtt_ms") < 500).alias("hit")))
    told = told.withColumns({c: F.round(F.col(c).cast("double"), 6) for c in ("parse_mb", "parse_mb_per_s", "hit_pct")})
    return told.select("pages_parsed", "parse_mb", "parse_mb_per_s", "lookups", "hits", "hit_pct", "downloaded")


@query("""with r as (select *, row_number() over (partition by operation order by ts desc, event_id desc) as rn from request_log), k as (select *, row_number() over (partition by operation order by rtt_ms, event_id) as rk, count(*) over (partition by operation) as n from r where rn <= 1000),
 t as (select operation, count(*) filter (status < 400) as success, count(*) filter (status >= 400) as failure from request_log group by 1)
 select operation, round(avg(rtt_ms), 6) as avg_ms, max(rtt_ms) filter (rk = floor(0.95::double * n) + 1) as p95_ms, max(rtt_ms) as max_ms, min(rtt_ms) as min_ms, count(*) as n, any_value(success) as success, any_value(failure) as failure from k join t using (operation) group by operation""")
def a5_latency_stats(spark, d):
    return G.latency_stats(view(spark, d, "request_log")).withColumn("avg_ms", F.round("avg_ms", 6))


@query("""with r as (select *, row_number() over (partition by operation order by ts desc, event_id desc) as rn from request_log), k as (select *, row_number() over (partition by operation order by rtt_ms, event_id) as rk, count(*) over (partition by operation) as n from r where rn <= 1000),
 o as (select operation, count(*) as n, avg(rtt_ms) as m, max(rtt_ms) filter (rk = floor(0.95::double * n) + 1) as p from k group by 1), t as (select count(*) filter (status < 400) as success, count(*) filter (status >= 400) as failure from request_log)
 select count(*) as operations, cast(sum(n) as bigint) as calls, any_value(success) as success, any_value(failure) as failure, round(any_value(success) * 100.0::double / (any_value(success) + any_value(failure)), 6) as success_pct, round(sum(m * n) / sum(n), 6) as mean_ms, arg_min(operation, (-p, operation)) as slowest from o, t""")
def a5_latency_totals(spark, d):
    out = G.latency_totals(G.latency_stats(view(spark, d, "request_log")))
    return out.withColumns({c: F.round(F.col(c).cast("double"), 6) for c in ("success_pct", "mean_ms")})


@query("""with r as (select *, status < 400 as ok, row_number() over (partition by domain order by ts desc, event_id desc) as rn from request_log), k as (select * from r where rn <= 50),
 p as (select *, 1 - count(*) filter (ok) over w / count(*) over w > 0.05 or coalesce(avg(rtt_ms) filter (ok) over w, 0) > 1000 as slow from k window w as (partition by domain order by ts, event_id rows unbounded preceding))
 select domain, count(*) as n, round(1 - count(*) filter (ok) / count(*), 6) as error_rate, round(coalesce(avg(rtt_ms) filter (ok), 0), 6) as avg_rtt_ms, round(coalesce(count(*) filter (ok) / (sum(rtt_ms) filter (ok) / 1000), 0), 6) as files_per_s,
 bool_or(slow) as ever_throttled, 1 - count(*) filter (ok) / count(*) > 0.05 or coalesce(avg(rtt_ms) filter (ok), 0) > 1000 as throttled_now from p group by domain""")
def a6_domain_stats(spark, d):
    out = G.domain_stats(view(spark, d, "request_log"))
    return out.withColumns({c: F.round(c, 6) for c in ("error_rate", "avg_rtt_ms", "files_per_s")})


@query("""with k as (select *, row_number() over (partition by domain order by ts, event_id) as rn from request_log) select domain, case when count(*) filter (status >= 400) / count(*) > 0.05 then 'fallback' when avg(rtt_ms) filter (status < 400) > 1000 then 'slow' else 'ok' end as verdict from k where rn <= 20 group by domain""")
def a6_server_verdict(spark, d):
    return G.server_verdict(view(spark, d, "request_log"))


@query(_THROTTLED)
def a7_throttled_domains(spark, d):
    return G.throttled_domains(view(spark, d, "request_log"), F.lit(AS_OF).cast("timestamp"))


@query("select operation as cache, round(count(*) filter (rtt_ms < 500) * 100.0 / count(*), 6)::double as hit_pct from request_log group by 1")
def a8_hit_rates(spark, d):
    out = G.hit_rates(view(spark, d, "request_log").select(F.col("operation").alias("cache"), (F.col("rtt_ms") < 500).alias("hit")))
    return out.withColumn("hit_pct", F.round(F.col("hit_pct").cast("double"), 6))


@query("""select dir_url, n as n_files, round(m, 4) as mean_size, s as n_small, ok as range_ok, case when n = 1 then 'sequential' when s > n * 0.7 and n >= 3 then 'parallel' when m >= 104857600 and n >= 4 and ok then 'streaming' else 'sequential' end as method
 from (select dir_url, count(*) as n, avg(size) as m, count(*) filter (size < 10485760) as s, bool_and(status = 200) as ok from remote_files group by 1)""")
def a9_transfer_plan(spark, d):
    return X.transfer_plan(view(spark, d, "remote_files").withColumn("range_ok", F.col("status") == 200), ["dir_url"]).withColumn("mean_size", F.round("mean_size", 4))


@query("""with g as (select *, coalesce(lag(end_byte) over (partition by url order by start_byte, chunk_id), -1) + 1 <> start_byte as gap from chunk_ledger)
 select url, count(*) as n_chunks, count(*) filter (status <> 'completed') as n_failed, count(*) filter (gap) as n_gaps, cast(sum(end_byte - start_byte + 1) as bigint) as size, count(*) filter (status <> 'completed') = 0 and count(*) filter (gap) = 0 and sum(end_byte - start_byte + 1) = max(end_byte) + 1 as whole from g group by url""")
def a10_verify_chunks(spark, d):
    return X.verify_chunks(view(spark, d, "chunk_ledger"))


@query("""with e as (select domain as url, operation as server, event_id as seq, status < 400 as ok from request_log), f as (select *, count(*) filter (not ok) over w as fails, sum(case when ok then -1 else 1 end) over (partition by server order by seq rows unbounded preceding) as s from e window w as (partition by url order by seq rows unbounded preceding)),
 m as (select *, fails - coalesce(max(case when ok then fails end) over (partition by url order by seq rows unbounded preceding), 0) as ff, s - least(0, min(s) over (partition by server order by seq rows unbounded preceding)) as sf from f)
 select url, server, seq, cast(ff as bigint) as file_failures, cast(sf as bigint) as server_failures, ff >= 3 as file_failed, sf >= 6 as server_open from m""")
def a11_chunk_failures(spark, d):
    log = view(spark, d, "request_log")
    return X.chunk_failures(log.select(F.col("domain").alias("url"), F.col("operation").alias("server"), F.col("event_id").alias("seq"), (F.col("status") < 400).alias("ok")))


@query("select cast(status as varchar) as type, count(*) as n from request_log where status >= 400 group by 1")
def a12_errors_by_type(spark, d):
    return G.errors_by_type(view(spark, d, "request_log").where("status >= 400").select(F.col("status").cast("string").alias("type")))


@query("select event_id, ts, status from request_log where status >= 400 order by ts desc, event_id desc limit 100")
def a12_newest_errors(spark, d):
    return G.newest(view(spark, d, "request_log").where("status >= 400"), 100).select("event_id", "ts", "status")


@query("select distinct url from local_files where url <> ''")
def a13_distinct_urls(spark, d):
    f = view(spark, d, "local_files")
    return G.distinct_urls(f.union(f))


_ROOTS = "select substr(dir_url, 1, length(dir_url)) as suffix, case when max(case when status in (404, 500) then 1 else 0 end) = 1 then 'failed' when max(case when status = 304 then 1 else 0 end) = 1 then 'skipped' else 'processed' end as status from remote_files group by 1"


@query(f"select status, count(*) as n, count(distinct suffix) as n_suffixes, min(suffix) as first_suffix, max(suffix) as last_suffix from ({_ROOTS}) group by 1")
def a14_suffix_summary(spark, d):
    return G.suffix_summary(_roots(spark, d))


@query(f"select status, suffix, rank from (select status, suffix, row_number() over (partition by status order by suffix) as rank from ({_ROOTS})) where rank <= 20")
def a14_suffixes_of(spark, d):
    return G.suffixes_of(_roots(spark, d)).withColumn("rank", F.col("rank").cast("long"))


def _roots(spark, d):
    bad, same = F.max(F.col("status").isin(404, 500)), F.max(F.col("status") == 304)
    return view(spark, d, "remote_files").groupBy(F.col("dir_url").alias("suffix")).agg(F.when(bad, "failed").when(same, "skipped").otherwise("processed").alias("status"))


@query("select count(*) as followed, count(distinct user_id) as n_unique, count(distinct user_id % 20) as n_dirs from events")
def a15_symlink_stats(spark, d):
    return G.symlink_stats(view(spark, d, "events").select(F.col("user_id").alias("link"), (F.col("user_id") % 20).alias("dir")))


@query("select o_orderstatus as state, count(*) filter (o_orderkey % 3 = 0) as high, count(*) filter (o_orderkey % 3 = 1) as normal, count(*) filter (o_orderkey % 3 = 2) as low from orders group by 1")
def a16_queue_stats(spark, d):
    return G.queue_stats(view(spark, d, "orders").select(F.col("o_orderstatus").alias("state"), (F.col("o_orderkey") % 3).alias("priority")))


# Windows, sorts, sets


@query(f"select dir_url, url, substr(url, length('{ROOT}') + 1) as rel, rn as rank from (select *, row_number() over (partition by dir_url order by url desc) as rn from {_R}) where rn <= 3")
def w1_list_files(spark, d):
    return T.list_files(_remote(spark, d), ROOT, 3).withColumn("rank", F.col("rank").cast("long"))


@query("""select root, dir_url, trim(substr(dir_url, length(root) + 1), '/') as rel from (select *, row_number() over (partition by root order by trim(substr(dir_url, length(root) + 1), '/') desc) as rn from (select distinct parent as root, child as dir_url from dir_edges)) where rn <= 4""")
def w2_list_dirs(spark, d):
    return T.list_dirs(view(spark, d, "dir_edges").select(F.col("parent").alias("root"), F.col("child").alias("dir_url")).distinct(), 4)


@query("select event_id, domain from (select *, row_number() over (partition by domain order by ts desc, event_id desc) as rn from request_log) where rn <= 50")
def w3_last_k(spark, d):
    return G.last_k(view(spark, d, "request_log"), "domain", "ts", 50).select("event_id", "domain")


@query("select domain as key, event_id as batch, round(avg(rtt_ms / 10) over w, 6) as mean_speed, avg(rtt_ms / 10) over w < 15 as slow from request_log window w as (partition by domain order by event_id rows 4 preceding)")
def w4_rolling_speed(spark, d):
    b = view(spark, d, "request_log").select(F.col("domain").alias("key"), F.col("event_id").alias("batch"), (F.col("rtt_ms") / 10).alias("speed"))
    return G.rolling_speed(b).select("key", "batch", F.round("mean_speed", 6).alias("mean_speed"), "slow")


@query("""with recursive s as (select domain, date_trunc('second', ts) as sec, cast(sum(bytes) as bigint) as bytes from request_log group by 1, 2), n as materialized (select *, row_number() over (partition by domain order by sec) as i, max(bytes) over (partition by domain order by sec rows unbounded preceding) as peak from s),
 e as (select domain, i, 0.1::double * bytes as x from n where i = 1 union all select n.domain, n.i, 0.9::double * e.x + 0.1::double * n.bytes from e join n on n.domain = e.domain and n.i = e.i + 1)
 select n.domain, sec, bytes, peak, round(x + 0.0000001, 3) as ewma from n join e on n.domain = e.domain and n.i = e.i""")
def w5_bandwidth_curve(spark, d):
    return G.bandwidth_curve(view(spark, d, "request_log")).withColumn("sec", F.col("sec").cast("timestamp_ntz")).withColumn("ewma", F.round(F.col("ewma") + 0.0000001, 3))


@query("""select event_id, case when c > 0.05 then 'up' when c < -0.05 then 'down' when c is not null then 'flat' end as trend from (select event_id, rtt_ms / nullif(lag(rtt_ms) over (partition by domain order by ts, event_id), 0) - 1 as c from request_log)""")
def w6_throughput_change(spark, d):
    return G.throughput_change(view(spark, d, "request_log").select(F.col("domain").alias("key"), "ts", "event_id", F.col("rtt_ms").alias("value"))).select("event_id", "trend")


@query("select domain as key, event_id, updated from (select domain, event_id, cast(date_trunc('day', ts) as timestamp) as updated, row_number() over (partition by domain order by date_trunc('day', ts) desc, event_id desc) as rn from request_log) where rn = 1")
def w8_latest_metadata(spark, d):
    """By day, so that each key has many rows of one time: the tie column decides."""
    day = F.date_trunc("day", "ts").cast("timestamp_ntz").alias("updated")
    return R.latest_metadata(view(spark, d, "request_log").select(F.col("domain").alias("key"), "event_id", day), tie="event_id")


@query("""with e as (select user_id as link, user_id % 20 as dir, event_id % 12 as depth, event_id as pos from events), s as (select *, case when depth > 10 then 'too deep' when row_number() over (partition by link, depth > 10 order by pos) > 1 then 'seen' end as v from e),
 f as (select *, case when v is null and count(*) filter (v is null) over (partition by dir order by pos rows unbounded preceding) > 100 then 'dir full' else v end as w from s), t as (select max(pos) as last from (select pos from f where w is null order by pos limit 1000))
 select link, dir, depth, pos, coalesce(w, case when pos <= last then 'ok' else 'full' end) as verdict from f, t""")
def w9_guard_links(spark, d):
    return X.guard_links(view(spark, d, "events").select(F.col("user_id").alias("link"), (F.col("user_id") % 20).alias("dir"), (F.col("event_id") % 12).alias("depth"), F.col("event_id").alias("pos")))


_CURVE = """select domain as job, ts, event_id, count(*) over w as done, count(*) over w * 100.0::double / count(*) over (partition by domain) as pct, count(*) over (partition by domain) as total, (epoch_us(ts) - min(epoch_us(ts)) over w) / 1000000.0::double as spent
 from request_log window w as (partition by domain order by ts, event_id rows unbounded preceding)"""


def _jobs(spark, d):
    log = view(spark, d, "request_log").select(F.col("domain").alias("job"), "ts", "event_id")
    return log.join(log.groupBy("job").agg(F.count("*").alias("total")), "job")


@query(f"select job, event_id, done, round(pct, 6) as pct, round(case when spent > 0 then done / spent else 0 end, 9) as rate, round(case when spent > 0 then (total - done) / (done / spent) end, 3) as eta_s from ({_CURVE})")
def w10_progress_curve(spark, d):
    return G.progress_curve(_jobs(spark, d)).select("job", "event_id", "done", F.round(F.col("pct").cast("double"), 6).alias("pct"), F.round("rate", 9).alias("rate"), F.round("eta_s", 3).alias("eta_s"))


@query(f"select job, min(ts) filter (pct >= 25) as at_25, min(ts) filter (pct >= 50) as at_50, min(ts) filter (pct >= 75) as at_75, min(ts) filter (pct >= 90) as at_90, min(ts) filter (pct >= 100) as at_100 from ({_CURVE}) group by job")
def w10_milestones(spark, d):
    return G.milestones(G.progress_curve(_jobs(spark, d)))


@query("""with e as (select domain, epoch_us(ts) as tm, 1 as d, event_id from request_log union all select domain, epoch_us(ts) + cast(floor(rtt_ms * 600000) as bigint), -1, event_id from request_log), a as (select *, sum(d) over (partition by domain order by tm, d, event_id rows unbounded preceding) as n from e)
 select domain, cast(max(n) as bigint) as peak, count(*) filter (d = 1 and n > 1) as over_cap from a group by domain""")
def w11_active_curve(spark, d):
    log = view(spark, d, "request_log").withColumn("rtt_ms", F.floor(F.col("rtt_ms") * 600000) / 1000)
    return G.active_curve(log, 1)


@query(f"select url, dir_url as path, cast(ck % 3 as bigint) as priority, k as created_at from {_R} order by ck % 3, k, url limit 10000")
def l1_work_list(spark, d):
    t = _remote(spark, d).select("url", F.col("dir_url").alias("path"), (F.col("ck") % 3).alias("priority"), F.col("k").alias("created_at"))
    return X.work_list(t.union(t))


@query(f"select url, floor((rn - 1) / 64) :: bigint as batch, rn - 1 as place from (select url, row_number() over (order by ck % 3, k, url) as rn from {_R}) where rn <= 10000")
def l1_work_batches(spark, d):
    t = _remote(spark, d).select("url", F.col("dir_url").alias("path"), (F.col("ck") % 3).alias("priority"), F.col("k").alias("created_at"))
    return X.work_batches(t.union(t), 64).select("url", "batch", "place")


@query(f"select url, cast(greatest((select count(*) from remote_files) - 10, 0) as bigint) as n_more from {_R} order by url limit 10")
def l2_l3_preview(spark, d):
    return X.preview(_remote(spark, d).select("url"))


@query("select domain, event_id from (select *, row_number() over (partition by domain order by event_id) as rn from request_log) where rn <= 20")
def l4_sample_urls(spark, d):
    return G.sample_urls(view(spark, d, "request_log"), "domain", "event_id").select("domain", "event_id")


@query("select child as dir_url, len(string_split(child, '/')) as depth from dir_edges")
def l5_deepest_first(spark, d):
    return T.deepest_first(view(spark, d, "dir_edges").select(F.col("child").alias("dir_url"))).withColumn("depth", F.size(F.split("dir_url", "/")).cast("long"))


@query(f"select url, case when k % 2 = 0 then 'even' else 'odd' end as suffix from {_R}")
def u1_union_roots(spark, d):
    r = _remote(spark, d)
    return T.union_roots({"even": r.where("k % 2 = 0").select("url"), "odd": r.where("k % 2 = 1").select("url")})


@query(f"select distinct substr(url, length('{ROOT}') + 1) as key from {_R}")
def u2_expected_keys(spark, d):
    return R.expected_keys(_remote(spark, d), F.lit(ROOT))


@query(f"select coalesce(r.url, l.url) as url, case when l.url is null then 'remote only' when r.url is null then 'local only' else 'both' end as side from (select distinct url from {_R}) r full join (select distinct url from local_files) l on r.url = l.url")
def u3_reconcile(spark, d):
    return R.reconcile(_remote(spark, d), view(spark, d, "local_files"))


# Trees and graphs


def _edges(spark, d):
    e = view(spark, d, "dir_edges")
    return e.withColumn("pos", F.row_number().over(Window.partitionBy("parent").orderBy("child")))


_TREE = f"with recursive t as (select '{ROOT}' as dir_url, 0 as depth union all select child, depth + 1 from t join dir_edges on parent = dir_url where not contains(child, '/asia/'))"


@query(f"{_TREE} select dir_url, depth from t")
def g1_discover(spark, d):
    return T.discover(_edges(spark, d), ROOT, exclude=["/data/asia"]).select("dir_url", "depth")


@query(f"{_TREE} select depth, count(*) as n_dirs from t group by depth")
def g2_level_counts(spark, d):
    return T.level_counts(T.discover(_edges(spark, d), ROOT, exclude=["/data/asia"]))


@query("""with d as (select distinct dir_url from remote_files), a as (select distinct dir_url from remote_files where k % 5 <> 0 and ck % 4 <> 0), b as (select distinct dir_url from remote_files where k % 5 <> 0 and ck % 4 <> 0 and k % 3 <> 0)
 select dir_url, dir_url not in (select dir_url from a) as empty_now, dir_url not in (select dir_url from b) as empty_after from d where dir_url not in (select dir_url from b)""")
def g3_empty_dirs(spark, d):
    r = _remote(spark, d)
    have = r.where("k % 5 <> 0 AND ck % 4 <> 0")
    return T.empty_dirs(r.select("dir_url"), have.select("url"), have.where("k % 3 = 0").select("url"))


@query(rf"""with h as ({_HREFS}), l as (select {_HOST} as host, regexp_extract(url, '^([A-Za-z]+://[^/?#]*)', 1) || regexp_replace(href, '[?#].*$', '') as target from h where href not in ('../', './') and href not like '?%'), p as (select distinct regexp_replace(url, '[?#].*$', '') as known from pages)
 select host, count(*) as n_links, count(*) as n_in_scope, count(distinct target) as n_targets, count(distinct case when known is null then target end) as n_dangling from l left join p on target = known group by host""")
def g4_link_graph(spark, d):
    return L.link_graph(_pages(spark, d))


@query(rf"""with h as ({_HREFS}), l as (select url, regexp_extract(url, '^([A-Za-z]+://[^/?#]*)', 1) || regexp_replace(href, '#.*$', '') as child from h where href not in ('../', './') and href not like '?%'), e as (select url, 1 as o, 0 as i from l union all select child, 0, 1 from l)
 select url, cast(sum(o) as bigint) as out_degree, cast(sum(i) as bigint) as in_degree from e group by url""")
def g4_degrees(spark, d):
    return L.degrees(_pages(spark, d))


# Classes and plans


@query("""select event_id, case when status = 200 then 'ok' when status in (429, 500, 503) and event_id % 5 < 3 then 'retry' when status >= 500 then 'final 5xx' else 'final 4xx' end as class, status in (429, 503) as is_incident,
 case when status in (429, 500, 503) and event_id % 5 < 3 then greatest(cast(least(event_id % 70, 60) as double), pow(2.0, event_id % 5)::double) end as wait_s from request_log""")
def c1_classify_responses(spark, d):
    log = view(spark, d, "request_log").withColumn("attempt", F.col("event_id") % 5).withColumn("retry_after", (F.col("event_id") % 70).cast("string"))
    return G.classify_responses(log, 3, F.lit(AS_OF).cast("timestamp")).select("event_id", "class", "is_incident", "wait_s")


@query("""with e as (select event_id, case event_id % 9 when 0 then 200 when 1 then 206 when 2 then 301 when 3 then 308 when 4 then 304 when 5 then 416 when 6 then 404 when 7 then 429 else 503 end as s, event_id % 5 as a from events)
 select event_id, case when s = 304 then 'not modified' when s = 416 then 'range' when s in (301, 308) then 'redirect' when s in (200, 206) then 'ok' when s in (429, 503) and a < 3 then 'retry' when s = 503 then 'final 5xx' else 'final 4xx' end as class from e""")
def c1_every_class(spark, d):
    status = F.element_at(F.array(*[F.lit(x) for x in (200, 206, 301, 308, 304, 416, 404, 429, 503)]), (F.col("event_id") % 9 + 1).cast("int"))
    log = view(spark, d, "events").select("event_id", status.alias("status"), (F.col("event_id") % 5).alias("attempt"), F.lit(None).cast("string").alias("retry_after"))
    return G.classify_responses(log, 3, F.lit(AS_OF).cast("timestamp")).select("event_id", "class")


@query("""with e as (select event_id, case event_id % 6 when 0 then 200 when 1 then 206 when 2 then 416 when 3 then 404 when 4 then 500 else 200 end as s, event_id % 4 * 100 as p from events)
 select event_id, case when s = 416 and p >= 200 then 'already complete' when s = 416 then 'restart' when s = 206 and p > 0 then 'resumed' when s = 200 and p > 0 then 'range ignored' when s in (200, 206) then 'downloaded' when s = 404 then 'skipped' else 'failed' end as outcome from e""")
def c2_classify_transfers(spark, d):
    status = F.element_at(F.array(*[F.lit(x) for x in (200, 206, 416, 404, 500, 200)]), (F.col("event_id") % 6 + 1).cast("int"))
    log = view(spark, d, "events").select("event_id", status.alias("status"), (F.col("event_id") % 4 * 100).alias("partial_bytes"), F.lit("bytes */200").alias("content_range"))
    return G.classify_transfers(log).select("event_id", "outcome")


@query("""with c as (select url, chunk_id, status = 'completed' as ok, (length(url) + chunk_id) % 3 + 1 as attempts from chunk_ledger)
 select url, max(attempts) as attempts, count(*) filter (not ok) as failed, case when count(*) filter (not ok) = 0 then 'done' when count(*) filter (not ok) * 2 <= count(*) then 'retry' else 'failed' end as verdict from c group by url""")
def c3_retry_accounts(spark, d):
    c = view(spark, d, "chunk_ledger").withColumn("attempt", F.explode(F.sequence(F.lit(1), (F.length("url") + F.col("chunk_id")) % 3 + 1)))
    last = F.col("attempt") == (F.length("url") + F.col("chunk_id")) % 3 + 1
    c = c.withColumn("ok", last & (F.col("status") == "completed")).withColumn("status", F.when(F.col("ok"), 206).otherwise(500))
    return G.retry_accounts(c).select("url", F.col("attempts").cast("long").alias("attempts"), "failed", "verdict")


@query(f"select url, policy, action from ({_OBSOLETE}), (values ('safe', 'keep'), ('preview', 'preview'), ('delete', 'delete'), ('move', 'move'), ('move, dry', 'preview')) p(policy, action)")
def c4_cleanup_plan(spark, d):
    gone = R.obsolete_files(view(spark, d, "local_files"), _remote(spark, d), _pages(spark, d))
    plans = [R.cleanup_plan(gone, p.split(",")[0], dry_run=p.endswith("dry")).select("url", F.lit(p).alias("policy"), "action") for p in ("safe", "preview", "delete", "move", "move, dry")]
    return reduce(lambda a, b: a.union(b), plans)


@query("""with p as (select r_name as volume, cast(sum(size) as bigint) as needed from (select regexp_extract(dir_url, '/data/([^/]*)/', 1) as v, size from remote_files) f join region on v = lower(replace(r_name, ' ', '_')) group by 1)
 select volume, needed, free, case when free < 104857600 or free < needed then 'block' when (1000000000000 - free) / 1000000000000 > 0.95 then 'critical' when (1000000000000 - free) / 1000000000000 > 0.85 then 'warning' else 'ok' end as verdict from (select volume, needed, 40000000000 * (1 + r_regionkey * 3) as free from p join region on volume = r_name)""")
def c5_space_verdict(spark, d):
    named = F.regexp_extract("dir_url", "/data/([^/]*)/", 1)
    plan = view(spark, d, "remote_files").select(named.alias("v"), "size", F.lit(True).alias("streaming")).join(F.broadcast(view(spark, d, "region")), F.col("v") == F.lower(F.replace("r_name", F.lit(" "), F.lit("_")))).withColumnRenamed("r_name", "volume")
    volumes = view(spark, d, "region").select(F.col("r_name").alias("volume"), F.lit(1_000_000_000_000).alias("total"), (F.lit(40_000_000_000) * (1 + F.col("r_regionkey") * 3)).alias("free"))
    return X.space_verdict(plan, volumes)


# Streams: each runs over what its source holds now


def _stream(spark, d):
    s = M.stream_table(spark, d, "events.parquet")
    status = "case when event_type <> 'error' then 200 when event_id % 4 = 0 then 429 when event_id % 4 = 1 then 503 when event_id % 4 = 2 then 500 else 404 end"
    return s.select("event_id", F.col("ts").cast("timestamp").alias("ts"), F.expr("concat('host', cast(user_id % 20 as string), '.example.org')").alias("domain"), F.expr(status).alias("status"), (F.col("value") * 10).alias("rtt_ms"), F.floor(F.col("value") * 1000).alias("bytes"))


_INCIDENTS = """select domain, s as start_ts, s + interval '14 days' as end_ts, count(*) as incidents from (select lower(domain) as domain, time_bucket(interval '1 day', ts) - to_days(cast(i as integer)) as s from request_log, range(14) t(i) where status in (429, 503)) group by all having count(*) >= 5"""


@query(_INCIDENTS)
def t1_incident_windows(spark, d):
    out = M.run_available(M.incident_windows(_stream(spark, d)), "update", ["domain", "start_ts"])
    return out.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("start_ts", "end_ts")})


@query("select time_bucket(interval '10 seconds', ts) as start_ts, count(*) as n_files, cast(sum(bytes) as bigint) as bytes, round(sum(bytes) / 1000000.0::double / 10, 9) as mb_per_s from request_log group by 1")
def t2_throughput(spark, d):
    out = M.run_available(M.throughput(_stream(spark, d)), "update", ["start_ts"])
    return out.withColumn("start_ts", F.col("start_ts").cast("timestamp_ntz")).withColumn("mb_per_s", F.round("mb_per_s", 9))


@query("select time_bucket(interval '10 seconds', ts) as start_ts, count(*) as n_files, cast(sum(bytes) as bigint) as bytes from request_log group by 1 having time_bucket(interval '10 seconds', ts) + interval '10 seconds' <= (select max(ts) - interval '1 day' from request_log)")
def t2_closed_throughput(spark, d):
    """In append mode: windows that the watermark has passed, each told once and then forgotten."""
    out = M.run_available(M.throughput(_stream(spark, d)))
    return out.select(F.col("start_ts").cast("timestamp_ntz").alias("start_ts"), "n_files", "bytes")


@query("""select domain, min(ts) as start_ts, max(ts) as end_ts, count(*) as failures from (select *, sum(case when status < 400 then 1 else 0 end) over (partition by domain order by ts, event_id rows unbounded preceding) as run from request_log) where status >= 400 group by domain, run""")
def t3_failure_runs(spark, d):
    return G.failure_runs(view(spark, d, "request_log").withColumn("ok", F.col("status") < 400))


@query("select distinct domain from request_log")
def t4_distinct_within(spark, d):
    return M.run_available(M.distinct_within(_stream(spark, d), "domain", "60 days")).select("domain")


@query("""with recursive a as (select domain, min(ts) as ts from request_log group by domain union all select a.domain, (select min(r.ts) from request_log r where r.domain = a.domain and r.ts > a.ts + interval '36 hours') from a where a.ts is not null)
 select domain, ts from a where ts is not null""")
def t4_distinct_ttl(spark, d):
    """A time to live of a day and a half within a month: keys come back."""
    out = M.run_available(M.distinct_within(_stream(spark, d), "domain", "36 hours"))
    return out.select("domain", F.col("ts").cast("timestamp_ntz").alias("ts"))


@query("""with e as (select domain, ts, bytes, status = 404 as c, event_id from request_log), o as (select *, lag(ts) over w as lt, lag(c) over w as lc from e window w as (partition by domain order by ts, c, event_id)),
 s as (select *, sum(case when lt is null or lc or ts >= lt + interval '2 hours' then 1 else 0 end) over (partition by domain order by ts, c, event_id rows unbounded preceding) as n from o)
 select domain, min(ts) as start_ts, max(ts) as last_ts, cast(sum(bytes) as bigint) as bytes, case when bool_or(c) then 'completed' else 'stale' end as state from s group by domain, n
 having bool_or(c) or max(ts) + interval '2 hours' < (select max(ts) - interval '1 day' from e) or n < (select max(n) from s z where z.domain = s.domain)""")
def t5_transfer_sessions(spark, d):
    """Closed sessions: by completion, by a later row, or by a timer once the watermark has passed their end."""
    out = M.run_available(M.transfer_sessions(_stream(spark, d).withColumn("completed", F.col("status") == 404), "domain", "2 hours"))
    return out.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("start_ts", "last_ts")})


@query("""select domain, s as start_ts, count(*) as n, round(count(*) filter (status >= 400) / count(*), 9) as error_rate, round(avg(rtt_ms) filter (status < 400), 6) as avg_rtt_ms from (select *, time_bucket(interval '10 minutes', ts) - to_minutes(cast(i * 10 as integer)) as s from request_log, range(6) t(i)) group by domain, s""")
def t6_rolling_profile(spark, d):
    out = M.run_available(M.rolling_profile(_stream(spark, d)), "update", ["domain", "start_ts"])
    return out.withColumn("start_ts", F.col("start_ts").cast("timestamp_ntz")).withColumn("error_rate", F.round("error_rate", 9)).withColumn("avg_rtt_ms", F.round("avg_rtt_ms", 6))


_CHANGED = "dir_url in (select dir_url from remote_files where k % 50 = 0)"


@query(_fresh().replace("g.old_sig = g.new_sig and g.new_sig not like 'url:%'", "r." + _CHANGED.replace("dir_url in", "dir_url not in", 1)))
def t7_incremental_reconcile(spark, d):
    """Two days of listings, one batch each; on the second one file in fifty has another size, and with it its directory
    another signature. The verdicts of the second day: directories of which nothing changed are trusted."""
    base = new_folder(spark, "reconcile")
    files = _remote(spark, d).select("url", "dir_url", "size", F.col("last_modified").cast("timestamp").alias("last_modified"), "etag", "status", "k")
    for day in (0, 1):
        files.withColumn("size", F.when((F.col("k") % 50 == 0) & F.lit(day == 0), F.col("size") + 1).otherwise(F.col("size"))).drop("k").write.parquet(f"{base}/in/day{day}")
        listing = spark.readStream.schema(files.drop("k").schema).option("recursiveFileLookup", "true").parquet(f"{base}/in")
        sink = lambda changes, verdicts, n: verdicts.write.mode("overwrite").parquet(f"{base}/out/batch={n}")
        M.incremental_reconcile(listing, lambda s: view(s, d, "local_files"), f"{base}/store", sink, f"{base}/progress").awaitTermination()
    return spark.read.schema("url string, needs_download boolean, reason string").parquet(f"{base}/out/batch=1")


@query("""select count(*) as n, count(*) filter (t.w <= (select max(ts) - interval '1 day' from request_log where event_id % 2 = 0)) as n_late from request_log, lateral (select time_bucket(interval '10 seconds', ts) + interval '10 seconds' as w) t where event_id % 2 = 1""")
def t2_late_rows(spark, d):
    """Events with even numbers come first; of those with odd ones, all in windows that have closed by then are late."""
    base = new_folder(spark, "late")
    log = view(spark, d, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"))
    for rest in (0, 1):
        log.where(F.col("event_id") % 2 == rest).write.parquet(f"{base}/in/part{rest}")
        listing = spark.readStream.schema(log.schema).option("recursiveFileLookup", "true").parquet(f"{base}/in")
        late, marks = M.late_rows(listing, F.window("ts", "10 seconds")["end"], folder=f"{base}/state")
    return marks.where("batch = 1").select("n", "n_late")


# SQL surface


@query(_HREFS)
def x2_links_from_sql(spark, d):
    from ..functions.sql import register

    register(spark)
    _pages(spark, d).createOrReplaceTempView("tidemark_pages")
    return spark.sql("SELECT p.url, l.href, CAST(l.pos AS BIGINT) AS pos FROM tidemark_pages p, LATERAL extract_links(p.html) l")


@query(f"select url, {_HOST} as host from pages")
def x3_functions_from_sql(spark, d):
    from ..functions.sql import register

    register(spark)
    _pages(spark, d).createOrReplaceTempView("tidemark_pages")
    return spark.sql("SELECT url, url_host(url) AS host FROM tidemark_pages")


@query(rf"""select url, regexp_extract(url, '^([A-Za-z]+):', 1) as scheme, {_HOST} as host, {_PATH} as path, regexp_extract(url, '^[^?#]*\?([^#]*)', 1) as query, regexp_extract(url, '^(.*/)', 1) as parent, url like '%/' as is_dir,
 regexp_replace(regexp_replace(url, '#.*$', ''), '\?.+$', '?<redacted>') as redacted, md5(encode(url)) as md5, sha256(encode(url)) as sha256, len(html) > 0 as has_html, least(pow(2.0, page_id % 9), 60.0)::double as backoff, greatest(1, least(8, page_id // 2)) > 0 as chunks, page_id * 1048576 >= 10485760 as splittable from pages""")
def x3_every_function_from_sql(spark, d):
    """One statement that calls each registered function; SQL here checks those that it can express."""
    from ..functions.sql import register

    names = register(spark)
    _pages(spark, d).createOrReplaceTempView("tidemark_pages")
    calls = {
        "url_resolve": "url, 'x/../y'", "url_relative": "url, url_site(url)", "local_key": "url, url_site(url)", "target_root": "url_site(url), 'a/b'", "url_security_verdict": "url, url", "url_scope_verdict": "url, url_site(url)", "url_in_base_scope": "url, url_site(url)",
        "is_ip": "url_host(url)", "is_private_ip": "url_host(url)", "ip_kind": "url_host(url)", "retry_after_seconds": "'5', timestamp '2024-01-01'", "backoff_seconds": "cast(page_id % 9 as int)", "format_bytes": "page_id", "format_duration": "cast(page_id as double)", "content_md5": "encode(url, 'UTF-8')",
        "content_sha256": "encode(url, 'UTF-8')", "blake2b_hex": "encode(url, 'UTF-8')", "listing_signature": "array(url, html)", "dir_signature": "url, null, url, null", "chunk_count": "page_id * 1048576", "splittable": "page_id * 1048576", "page_hrefs": "html", "page_anchors": "html",
    }
    every = ", ".join(f"{f}({calls.get(f, 'url')}) AS {f}" for f in names if f != "extract_links")
    told = spark.sql(f"SELECT page_id, url AS address, html, {every} FROM tidemark_pages").withColumn("seen", F.size("page_hrefs") <= F.regexp_count("html", F.lit("(?i)href")))
    parts = {"scheme": "url_scheme", "host": "url_host", "path": "url_path", "query": "url_query", "parent": "url_parent", "redacted": "url_redacted", "md5": "content_md5", "sha256": "content_sha256", "backoff": "backoff_seconds", "splittable": "splittable"}
    rest = F.coalesce(*[F.col(f).isNotNull() for f in names if f != "extract_links"], F.lit(True))
    return told.select(F.col("address").alias("url"), *[F.col(c).alias(k) for k, c in parts.items()], (F.col("url_is_directory") == "true").alias("is_dir"), (F.col("seen") & rest).alias("has_html"), (F.col("chunk_count") > 0).alias("chunks"))
