"""Inventories, trees and logs derived from the given tables; the same SQL text serves Spark and DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..session import checkpointed

ROOT = "https://archive.example.org/data/"

_VIEWS: dict[str, str] = {
    "remote_files": """
select concat('https://archive.example.org/data/', lower(replace(r_name,' ','_')), '/', lower(replace(n_name,' ','_')), '/c', cast(o_custkey as S), '/') as dir_url,
  concat('o', cast(o_orderkey as S), case when o_orderkey % 10 < 7 then '.fits' when o_orderkey % 10 < 9 then '.PNG' else '.txt' end) as filename,
  cast(floor(o_totalprice * 100) as bigint) as size,
  case when o_orderkey % 4 = 0 then null else o_orderdate end as last_modified,
  case when o_orderkey % 31 = 0 then null else concat('W/"', md5(cast(o_orderkey as S)), '"') end as etag,
  case when o_orderkey % 37 = 0 then 304 when o_orderkey % 41 = 0 then 404 when o_orderkey % 43 = 0 then 500 else 200 end as status,
  o_custkey as ck, o_orderkey as k
from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey""",
    "local_files": """
select concat(dir_url, filename) as url, case when k % 19 = 0 then size + 1 else size end as size,
  case when last_modified is null then timestamp '2000-01-01 00:00:00'
       when k % 13 = 0 then cast(last_modified as timestamp) - interval '1' day else cast(last_modified as timestamp) end as mtime,
  case when k % 5 = 0 then null when k % 17 = 0 then '"stale"' else concat('"', md5(cast(k as S)), '"') end as cached_etag
from remote_files where k % 11 <> 0
union all
select concat(dir_url, 'old_', filename), size, timestamp '2000-01-01 00:00:00', cast(null as S) from remote_files where k % 23 = 0""",
    "dir_signatures": """
select dir_url, case when ck % 9 = 0 then concat('url:', dir_url, ':1') else concat('etag:', md5(dir_url)) end as old_sig,
  case when ck % 9 = 0 then concat('url:', dir_url, ':1') when ck % 7 = 0 then concat('etag:', md5(concat(dir_url, '2'))) else concat('etag:', md5(dir_url)) end as new_sig
from (select distinct dir_url, ck from remote_files) t""",
    "dir_edges": """
select distinct 'https://archive.example.org/data/' as parent, regexp_replace(dir_url, '[^/]+/[^/]+/$', '') as child from remote_files
union all select distinct regexp_replace(dir_url, '[^/]+/[^/]+/$', ''), regexp_replace(dir_url, '[^/]+/$', '') from remote_files
union all select distinct regexp_replace(dir_url, '[^/]+/$', ''), dir_url from remote_files""",
    "chunk_ledger": """
select url, id as chunk_id, id * (size DIV n) as start_byte, case when id = n - 1 then size - 1 else (id + 1) * (size DIV n) - 1 end as end_byte,
  case when (k + id) % 29 = 0 then 'failed' else 'completed' end as status
from (select concat(dir_url, filename) as url, size, k, greatest(2, least(8, size DIV 10485760)) as n from remote_files where size >= 10485760) f
  cross join (select 0 as id union all select 1 union all select 2 union all select 3) i where id < n""",
    "request_log": """
select event_id, ts, concat('host', cast(user_id % 20 as S), '.example.org') as domain, event_type as operation,
  case when event_type <> 'error' then 200 when event_id % 4 = 0 then 429 when event_id % 4 = 1 then 503 when event_id % 4 = 2 then 500 else 404 end as status,
  value * 10 as rtt_ms, cast(floor(value * 1000) as bigint) as bytes from events""",
    "redirects": """
select concat('https://archive.example.org/p', cast(p_partkey as S)) as src, concat('https://archive.example.org/p', cast(floor(p_partkey / 2) as bigint)) as dst
from part where p_partkey > 1""",
}
_NEEDS = {"remote_files": ["orders", "customer", "nation", "region"], "request_log": ["events"], "redirects": ["part"]}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view by name, or a given table. Edges are drawn from a table of the distinct directories, so that a row a
    directory, not one a file, goes through their expressions. It is written: of a plan alone Spark would drop the inner
    distinct again, and push the expressions down to the files."""
    if name not in _VIEWS:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    needs = _NEEDS.get(name, ["remote_files"])
    text = _VIEWS[name].replace(" as S)", " as string)").replace("DIV", "div")
    for n in needs:
        text = _named(text, n)
    frames = {n: view(spark, sf_dir, n) for n in needs}
    if name == "dir_edges":
        frames["remote_files"] = checkpointed(frames["remote_files"].select("dir_url").distinct())
    return spark.sql(text, **frames)


def _named(text: str, name: str) -> str:
    import re

    return re.sub(rf"\b(from|join) {name}\b", rf"\1 {{{name}}}", text)


def oracle(sql: str) -> str:
    """DuckDB SQL with the views that it names as common tables."""
    import re

    wanted: list[str] = []
    for name in _VIEWS:
        if re.search(rf"\b{name}\b", sql):
            if name not in ("remote_files", "request_log", "redirects") and "remote_files" not in wanted:
                wanted.insert(0, "remote_files")
            if name not in wanted:
                wanted.append(name)
    text = ",\n".join(f"{n} as ({_VIEWS[n].replace(' as S)', ' as varchar)').replace('DIV', '//')})" for n in wanted)
    if not wanted:
        return sql
    body = sql.lstrip()
    if body.lower().startswith("with recursive"):
        return f"with recursive {text},\n{body[14:]}"
    if body.lower().startswith("with"):
        return f"with {text},\n{body[4:]}"
    return f"with {text}\n{body}"
