"""Column functions against urllib, and the literal cases."""

import ipaddress
import random
from urllib.parse import quote, unquote, urljoin

import pytest
from pyspark.sql import functions as F

from tidemark.functions import headers as H
from tidemark.functions import urls as U


def run(spark, values, f, *more):
    df = spark.createDataFrame([(i, *(v if isinstance(v, tuple) else (v,))) for i, v in enumerate(values)], "i int, " + ", ".join(f"c{k} string" for k in range(1 + len(more) if more else len(values[0]) if isinstance(values[0], tuple) else 1)))
    cols = [F.col(c) for c in df.columns[1:]]
    return [r[0] for r in df.select("i", f(*cols).alias("o")).orderBy("i").select("o").collect()]


def test_resolve_like_urljoin(spark):
    bases = ["https://h.test/a/b/c.html", "https://h.test/a/b/", "http://h.test", "https://h.test/a/b?x=1", "https://u@h.test:8/a//b/"]
    hrefs = ["x", "../x", "../../x", "../../../x", "./x/./y", "/x/../y", "//o.test/z", "?q=1", "", "x?y/../z", "https://o.test/a", "mailto:a@b", "x/..", "..", ".", "a/b/../../c/", "/", "x#y", " x "]
    pairs = [(b, h) for b in bases for h in hrefs]
    assert run(spark, pairs, U.resolve_url) == [urljoin(b, h.strip()).split("#")[0].strip() for b, h in pairs]


def test_decode_and_encode_like_urllib(spark):
    rng = random.Random(3)
    pieces = ["a", "%20", "%zz", "%", "+", "%C3%A9", "%C3", "%e2%82%ac", "é", "/", "%2F", "~", "*", "%25", "(", "%00"]
    texts = ["".join(rng.choices(pieces, k=rng.randint(0, 6))) for _ in range(300)]
    assert run(spark, texts, U.percent_decode) == [unquote(t) for t in texts]
    assert run(spark, texts, U.encode_path) == ["/".join(quote(p) for p in t.split("/")) for t in texts]


@pytest.mark.parametrize(
    ("url", "verdict"),
    [
        ("https://example.com/a/b", None),
        ("https://cdn.example.com/a", None),
        ("https://evil.com/a", "other domain"),
        ("https://notexample.com/a", "suffix attack"),
        ("file:///etc/passwd", "scheme"),
        ("https://me@example.com/", "userinfo"),
        ("https://example.com/a/../b", "traversal"),
        ("https://example.com/a/%2e%2e/b", "encoded traversal"),
        ("https://example.com/a/%252e%252e/b", "double encoded traversal"),
        ("https://example.com/a%00", "nul"),
        ("https://example.com/a%0d", "encoded control"),
        ("https://xn--a.com/", "punycode"),
        ("https://[::1]/", "private ip"),
        ("https://8.8.8.8/", "ip"),
        ("https://example.com:6379/", "port"),
        ("", "invalid"),
        (None, "invalid"),
    ],
)
def test_security_verdicts(spark, url, verdict):
    df = spark.createDataFrame([(url,)], "u string")
    assert df.select(U.url_security_verdict(F.col("u"), F.lit("https://example.com/"))).first()[0] == verdict


def test_private_ips(spark):
    ips = ["10.1.2.3", "172.16.0.1", "192.168.1.1", "127.0.0.1", "::1", "8.8.8.8", "2606:4700::1", "no ip", None]
    assert run(spark, [i if i is not None else (None,) for i in ips], U.is_private_ip) == [True] * 5 + [False, False, True, True]


def test_ipv6_like_ipaddress(spark):
    rng = random.Random(5)
    heads = ["", "2001:db8", "2001:4860", "fe80", "fc00", "fd12", "64:ff9b", "100", "2002:a00", "2001", "2001:3", "2001:20", "2001:4:112", "3fff:fff", "2606:4700", "ff02", "::ffff:10.0.0.1", "::ffff:8.8.8.8", "::1.2.3.4", "1:2:3:4:5:6:7", "g::1", "1::2::3", ":1", "1:", "12345::", "::", "::1", "2001:1::1", "2001:1::3"]
    texts = list(heads)
    for _ in range(300):
        texts.append(rng.choice(heads) + rng.choice(["::", ":", ":0:", "", "::a:"]) + rng.choice(["", "1", "1:2", "ffff", "1.2.3.4", "0:0:0:0:0:1", "1:2:3:4:5:6"]))
    texts = sorted({t for t in texts if ":" in t})

    def kind(x):
        try:
            a = ipaddress.ip_address(x)
        except ValueError:
            return (False, True)
        return (True, a.is_private or a.is_loopback or a.is_link_local or a.is_reserved)

    want = [kind(t) for t in texts]
    assert list(zip(run(spark, texts, U.is_ip), run(spark, texts, U.is_private_ip))) == want


def test_names_tags_and_sizes(spark):
    assert run(spark, ["a/b/c.txt", "CON", "com1", "readme.txt", "CON.txt", "", ".con", "a\\b"], U.safe_filename) == ["c.txt", "_CON", "_com1", "readme.txt", "_CON.txt", "unnamed", ".con", "a_b"]
    assert run(spark, ['W/"abc"', '"abc"', "w/x", "", '""'], H.normalize_etag) == ["abc", "abc", "x", "", ""]
    assert run(spark, ["0", "1536", "1048576"], lambda c: H.format_bytes(c.cast("double"))) == ["0.00 B", "1.50 KB", "1.00 MB"]
    assert run(spark, ["3665", "-1", "0.5"], lambda c: H.format_duration(c.cast("double"), True)) == ["1h 1m 5s", "unknown", "500ms"]


def test_bytes_round_halves_to_even_as_python_prints_them(spark):
    rng = random.Random(3)
    values = [k / 8 * 1024.0**i for k in range(1, 40) for i in range(6)] + [1.005, 0.055, 0.125, 2.0**-3 + 2**-55, -1.125, -5000.125, 1023.995, 2.0**62, 1e22]
    values += [round(rng.random() * 1000, 3) * 1024.0**i for i in range(6) for _ in range(100)] + [float(rng.randrange(1, 1 << rng.randrange(1, 63))) for _ in range(500)]

    def shown(x):
        for unit in ["B", "KB", "MB", "GB", "TB"]:
            if x < 1024.0:
                return f"{x:.2f} {unit}"
            x /= 1024.0
        return f"{x:.2f} PB"

    assert run(spark, [repr(v) for v in values], lambda c: H.format_bytes(c.cast("double"))) == [shown(v) for v in values]


def test_retry_after(spark):
    values = ["5", "0", "99", " 7 ", "Fri, 31 Jul 2026 07:00:10 GMT", "Fri, 31 Jul 2026 06:00:00 GMT", "Fri, 31 Jul 2027 07:00:00 GMT", "", "soon"]
    at = F.lit("2026-07-31 07:00:00").cast("timestamp")
    assert run(spark, values, lambda c: H.retry_after_seconds(c, at)) == [5.0, 0.0, 60.0, 7.0, 10.0, 0.0, 60.0, None, None]


def test_paths(spark):
    assert run(spark, ["/a//b/./c/", "a/b", "", "/", "/a%20b"], U.normalize_path) == ["/a/b/c/", "/a/b", "", "", "/a b"]
    root = F.lit("https://h.test/d/")
    urls = ["https://h.test/d/a/b.txt", "https://h.test/d/../x", "https://h.test/e/x", "https://h.test/d/a%2F..%2Fb", "https://h.test/d/CON"]
    assert run(spark, urls, lambda u: U.local_key(u, root)) == ["a/b.txt", None, None, None, "_CON"]
    assert run(spark, ["", "a/", "../a", "/a"], lambda s: U.target_root(root, s)) == ["https://h.test/d/", "https://h.test/d/a/", None, None]
    assert run(spark, ["https://u:p@h.test/p?token=1#f", "https://h.test/p"], U.redact_url) == ["https://h.test/p?<redacted>", "https://h.test/p"]
