"""The column functions by name in SQL, each made from its column expression, so that both are one rule."""

from __future__ import annotations

import ipaddress
import re

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import links as L
from ..operators import transfers as X
from . import headers as H
from . import urls as U
from .anchors import _parsed


@F.pandas_udf(T.StringType())
def _ip_kind(s: pd.Series) -> pd.Series:
    """`private`, `public` or null where the text is no address."""

    def kind(x):
        try:
            a = ipaddress.ip_address(x)
        except ValueError:
            return None
        return "private" if a.is_private or a.is_loopback or a.is_link_local or a.is_reserved else "public"

    return s.map(lambda x: None if x is None else kind(x))


def _functions() -> dict[str, tuple[str, Column]]:
    """Parameters and expression of each function."""
    u, v, n, b = F.col("u"), F.col("v"), F.col("n"), F.col("b")
    one, two = "u STRING", "u STRING, v STRING"
    return {
        # URLs
        "url_scheme": (one, U.scheme(u)), "url_netloc": (one, U.netloc(u)), "url_host": (one, U.host(u)), "url_port": (one, U.port(u)), "url_path": (one, U.path(u)), "url_query": (one, U.query(u)),
        "url_fragment": (one, U.fragment(u)), "url_userinfo": (one, U.userinfo(u)), "url_parts": (one, U.url_parts(u)), "url_tail": (one, U.url_tail(u)), "url_filename": (one, U.url_filename(u)),
        "url_last_component": (one, U.last_component(u)), "url_parent": (one, U.parent_url(u)), "url_site": (one, F.regexp_extract(u, "^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)),
        "url_is_directory": (one, U.is_directory(u).cast("string")), "url_has_web_scheme": (one, U.has_web_scheme(u).cast("string")), "url_resolve": (two, U.resolve_url(u, v)), "url_unquote": (one, U.percent_decode(u)),
        "url_quote": (one, U.percent_encode(u)), "url_encode_path": (one, U.encode_path(u)), "url_normalized": (one, U.normalize_url(u)), "path_normalized": (one, U.normalize_path(u)), "url_redacted": (one, U.redact_url(u)),
        "url_relative": (two, U.relative_path(u, v)), "url_download_name": (one, U.download_name(u)), "safe_filename": (one, U.safe_filename(u)), "local_key": (two, U.local_key(u, v)), "target_root": (two, U.target_root(u, v)),
        "url_security_verdict": (two, U.url_security_verdict(u, v)), "url_scope_verdict": (two, U.scope_verdict(u, v)), "url_in_base_scope": (two, L.in_base_scope(u, v)), "is_ip": (one, U.is_ip(u)), "is_private_ip": (one, U.is_private_ip(u)),
        # headers, sizes, hashes
        "normal_etag": (one, H.normalize_etag(F.trim(u))), "parse_http_date": (one, H.parse_http_date(u)), "retry_after_seconds": ("u STRING, t TIMESTAMP", H.retry_after_seconds(u, F.col("t"))), "backoff_seconds": ("n INT", H.backoff_seconds(n)),
        "format_bytes": ("n BIGINT", H.format_bytes(n)), "format_duration": ("n DOUBLE", H.format_duration(n)), "content_md5": ("b BINARY", H.content_signature(b, "md5")), "content_sha256": ("b BINARY", H.content_signature(b)),
        "listing_signature": ("a ARRAY<STRING>", H.listing_signature(F.col("a"))), "dir_signature": ("u STRING, v STRING, w STRING, t TIMESTAMP", H.dir_signature(u, v, F.col("w"), F.col("t"))),
        "chunk_count": ("n BIGINT", X.chunk_count(n)), "splittable": ("n BIGINT", X.splittable(n)),
        # pages
        "page_hrefs": (one, L.hrefs(u)),
    }


def expression_sql(column: Column) -> str:
    """SQL text of a native column expression. Operators come as functions named by their signs, which SQL wants quoted."""
    parts = re.split(r"('(?:[^'\\]|\\.)*')", column._jc.node().sql())
    quoted = lambda p: re.sub(r"\b(and|or)\(", r"`\1`(", re.sub(r"(<=>|<=|>=|[=<>+\-*/%!])\(", r"`\1`(", p))
    return "".join(p if i % 2 else quoted(p) for i, p in enumerate(parts))


def register(spark: SparkSession) -> list[str]:
    """Register all functions for the session: native SQL functions, the table function extract_links(html) of (pos, href),
    and the Arrow functions blake2b_hex, ip_kind and page_anchors. The names."""
    spark.udf.register("blake2b_hex", H._blake2b)
    spark.udf.register("ip_kind", _ip_kind)
    spark.udf.register("page_anchors", _parsed)
    made = _functions()
    for name, (parameters, column) in made.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURN {expression_sql(column)}")
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION extract_links(html STRING) RETURNS TABLE (pos INT, href STRING) RETURN SELECT pos, col FROM LATERAL posexplode({expression_sql(L.hrefs(F.col('html')))})")
    return [*made, "extract_links", "blake2b_hex", "ip_kind", "page_anchors"]
