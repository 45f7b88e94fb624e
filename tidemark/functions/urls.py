"""URL and path columns, all of them native expressions."""

from __future__ import annotations

import ipaddress
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
URL_REGEX = r"(?s)^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"
RESERVED_NAMES = ["CON", "PRN", "AUX", "NUL", "COM1", "COM2", "COM3", "COM4", "COM5", "COM6", "COM7", "COM8", "COM9", "LPT1", "LPT2", "LPT3", "LPT4", "LPT5", "LPT6", "LPT7", "LPT8", "LPT9"]
BLOCKED_PORTS = [22, 23, 25, 53, 110, 143, 445, 3306, 3389, 5432, 6379, 27017]
PRIVATE_RANGES = [("10.0.0.0", 8), ("172.16.0.0", 12), ("192.168.0.0", 16), ("127.0.0.0", 8), ("0.0.0.0", 8), ("169.254.0.0", 16), ("192.0.0.0", 29), ("192.0.0.170", 31), ("192.0.2.0", 24), ("198.18.0.0", 15), ("198.51.100.0", 24), ("203.0.113.0", 24), ("240.0.0.0", 4)]
# Ranges of IPv6 that are private or reserved, and the public ones inside them.
PRIVATE_RANGES_6 = ["::/8", "100::/8", "200::/7", "400::/6", "800::/5", "1000::/4", "2001::/23", "2001:db8::/32", "2002::/16", "4000::/3", "6000::/3", "8000::/3", "a000::/3", "c000::/3", "e000::/4", "f000::/5", "f800::/6", "fc00::/7", "fe00::/9", "fe80::/10"]
PUBLIC_RANGES_6 = ["2001:1::1/128", "2001:1::2/128", "2001:3::/32", "2001:4:112::/48", "2001:20::/28", "2001:30::/28"]


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value computed once for each row, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, URL_REGEX, 1))


def netloc(url: Column) -> Column:
    return F.regexp_extract(url, URL_REGEX, 2)


def path(url: Column) -> Column:
    return F.regexp_extract(url, URL_REGEX, 3)


def query(url: Column) -> Column:
    return F.regexp_extract(url, URL_REGEX, 4)


def fragment(url: Column) -> Column:
    return F.regexp_extract(url, URL_REGEX, 5)


def userinfo(url: Column) -> Column:
    return F.regexp_extract(netloc(url), r"(?s)^(.*)@", 1)


def host(url: Column) -> Column:
    """Lower-cased, without userinfo, port, brackets."""
    bare = F.regexp_replace(netloc(url), r"(?s)^.*@", "")
    return F.lower(F.when(bare.startswith("["), F.regexp_extract(bare, r"^\[([^\]]*)\]", 1)).otherwise(F.regexp_extract(bare, r"^([^:]*)", 1)))


def port(url: Column) -> Column:
    return F.nullif(F.regexp_extract(netloc(url), r":([0-9]{1,5})$", 1), F.lit("")).cast("int")  # a failing try_cast costs an exception a row


def url_parts(url: Column) -> Column:
    """scheme, netloc, userinfo, host, port, path, query, fragment as one struct."""
    parts = {"scheme": scheme, "netloc": netloc, "userinfo": userinfo, "host": host, "port": port, "path": path, "query": query, "fragment": fragment}
    return F.struct(*[f(url).alias(name) for name, f in parts.items()])


def url_tail(url: Column) -> Column:
    """From the first / after ://, with query and fragment; empty without one."""
    return F.regexp_extract(url, r"(?s)^.*?://[^/]*(/.*)$", 1)


def url_filename(url: Column) -> Column:
    return F.substring_index(url_tail(url), "/", -1)


def last_component(url: Column) -> Column:
    """The last segment of the path; `root` for an empty path."""
    bare = F.rtrim(path(url), F.lit("/"))
    return F.when(bare == "", F.lit("root")).otherwise(F.substring_index(bare, "/", -1))


def parent_url(url: Column) -> Column:
    return F.regexp_extract(url, r"(?s)^(.*/)", 1)


def is_directory(url: Column) -> Column:
    return url.endswith("/")


def _remove_dots(p: Column) -> Column:
    """RFC 3986 dot segments of a rooted path."""
    parts = F.split(F.substring(p, 2, 1 << 30), "/")

    def step(acc: Column, s: Column) -> Column:
        return F.when(s == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).when(s == ".", acc).otherwise(F.concat(acc, F.array(s)))

    kept = F.aggregate(parts, F.array().cast("array<string>"), step)
    joined = F.concat(F.lit("/"), F.array_join(kept, "/"))
    return F.when(p.rlike(r"(^|/)\.\.?$") & (F.size(kept) > 0), F.concat(joined, F.lit("/"))).otherwise(joined)


def _split(url: Column, body: Callable[[Column], Column]) -> Column:
    """body(p) with scheme (as written), netloc, path, query and fragment of a URL as p[0] to p[4], by one match."""
    return _let(F.split(F.regexp_replace(url, URL_REGEX, "$1\uffff$2\uffff$3\uffff$4\uffff$5"), "\uffff"), body)


def page_base(url: Column) -> Column:
    """What the links of a page are resolved against, split once: scheme, host, site, path, folder, whole."""

    def made(p: Column) -> Column:
        site = F.concat(F.lower(p[0]), F.lit("://"), p[1])
        bare = F.regexp_replace(p[1], r"(?s)^.*@", "")
        name = F.lower(F.when(bare.startswith("["), F.regexp_extract(bare, r"^\[([^\]]*)\]", 1)).otherwise(F.regexp_extract(bare, r"^([^:]*)", 1)))
        folder = F.when(p[2] == "", F.lit("/")).otherwise(F.substr(p[2], F.lit(1), F.length(p[2]) - F.length(F.substring_index(p[2], "/", -1))))
        whole = F.concat(site, p[2], F.when(p[3] != "", F.concat(F.lit("?"), p[3])).otherwise(F.lit("")))
        return F.struct(F.lower(p[0]).alias("scheme"), name.alias("host"), site.alias("site"), p[2].alias("path"), folder.alias("folder"), whole.alias("whole"))

    return _split(url, made)


def resolve_link(base: Column, href: Column) -> Column:
    """A link against its page's `page_base`: fragment cut, blanks trimmed. Links with another scheme stay as they are."""

    def resolved(link: Column) -> Column:
        bare = F.substring_index(link, "?", 1)
        tail = F.substr(link, F.length(bare) + 1)
        joined = F.when(bare.startswith("/"), bare).otherwise(F.regexp_replace(F.concat(base["folder"], bare), "/+", "/"))
        return F.trim(
            F.when(link == "", base["whole"])
            .when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), link)
            .when(link.startswith("//"), F.concat(base["scheme"], F.lit(":"), link))
            .when(link.startswith("?"), F.concat(base["site"], base["path"], link))
            .otherwise(F.concat(base["site"], _let(joined, _remove_dots), tail))
        )

    return _let(F.substring_index(F.trim(href), "#", 1), resolved)


def resolve_url(base: Column, href: Column) -> Column:
    """A link against its page's URL; see `resolve_link`."""
    return _let(page_base(base), lambda b: resolve_link(b, href))


def percent_decode(col: Column) -> Column:
    """Escapes read as UTF-8 bytes, where bytes that are no UTF-8 become U+FFFD; a % without two hex digits stays."""

    def spelt(part: Column, i: Column) -> Column:
        escape = part.rlike("^[0-9A-Fa-f]{2}")
        return F.when(i == 0, F.hex(part)).when(escape, F.concat(F.substring(part, 1, 2), F.hex(F.substring(part, 3, 1 << 30)))).otherwise(F.concat(F.lit("25"), F.hex(part)))

    raw = F.unhex(F.array_join(F.transform(F.split(col, "%"), spelt), ""))
    return F.when(~col.contains("%"), col).otherwise(F.make_valid_utf8(raw.cast("string")))


def percent_encode(segment: Column, safe: str = "") -> Column:
    """One segment; `safe` characters stay (the sign % itself is encoded)."""
    out = F.url_encode(segment)
    for a, b in (("+", "%20"), ("*", "%2A"), ("%7E", "~"), *((f"%{ord(c):02X}", c) for c in safe)):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def encode_path(p: Column) -> Column:
    """Each segment of a path; existing escapes are escaped again."""
    return F.array_join(F.transform(F.split(p, "/"), lambda s: percent_encode(s)), "/")


def normalize_url(url: Column) -> Column:
    """Request form: path decoded and encoded again, fragment dropped."""
    head = F.concat(scheme(url), F.lit("://"), netloc(url))
    tail = F.when(query(url) != "", F.concat(F.lit("?"), query(url))).otherwise(F.lit(""))
    again = F.replace(encode_path(percent_decode(path(url))), F.lit("%25"), F.lit("%"))
    return F.concat(head, again, tail)


def normalize_path(p: Column, rooted: bool = True) -> Column:
    """Decoded, without `.` and repeated slashes; a trailing slash stays. rooted: always led by a slash."""
    decoded = percent_decode(p)
    body = F.array_join(F.filter(F.split(decoded, "/"), lambda s: (s != "") & (s != ".")), "/")
    lead = F.lit("/") if rooted else F.when(p.startswith("/"), F.lit("/")).otherwise(F.lit(""))
    filled = F.concat(lead, body, F.when(decoded.endswith("/"), F.lit("/")).otherwise(F.lit("")))
    return F.when(p == "", F.lit("")).when(body == "", F.lit("" if rooted else "/") if rooted else lead).otherwise(filled)


def redact_url(url: Column) -> Column:
    """Without userinfo and fragment; a query reads ?<redacted>."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(url, r"(?s)#.*$", ""), r"^([A-Za-z][A-Za-z0-9+.-]*://)[^/?#]*@", "$1"), r"(?s)\?.+$", "?<redacted>")


def relative_path(url: Column, root: Column) -> Column:
    """Below a root, without slashes at its ends; `.` for the root itself; null outside."""
    rest = F.trim(F.substr(url, F.length(root) + 1), F.lit("/"))
    return F.when(url.startswith(root), F.when(rest == "", F.lit(".")).otherwise(rest))


def download_name(url: Column) -> Column:
    """The decoded last segment; index_<crc32>.html where there is none."""
    name = percent_decode(F.substring_index(path(url), "/", -1))
    return F.when(name == "", F.concat(F.lit("index_"), F.lower(F.hex(F.crc32(url))), F.lit(".html"))).otherwise(name)


def safe_filename(name: Column, max_len: int = 255) -> Column:
    """Last segment without control characters, cut to max_len with its extension, reserved names led by _."""
    base = F.regexp_replace(F.substring_index(name, "/", -1), r"[\x00-\x08\x0A-\x0C\x0E-\x1F]", "")
    ext = F.regexp_extract(base, r"(?s)^[.]*[^.](?:.*)(\.[^.]*)$", 1)
    cut = F.when(F.length(ext) < max_len, F.concat(F.substr(base, F.lit(1), F.lit(max_len) - F.length(ext)), ext)).otherwise(F.substr(base, F.lit(1), F.lit(max_len)))
    short = F.translate(F.when(F.length(base) > max_len, cut).otherwise(base), "\\", "_")
    stem = F.upper(F.regexp_replace(short, r"(?s)^(.+)\.[^.]*$", "$1"))
    return F.when(F.coalesce(short, F.lit("")) == "", F.lit("unnamed")).when(stem.isin(RESERVED_NAMES), F.concat(F.lit("_"), short)).otherwise(short)


def local_key(url: Column, root: Column, max_depth: int = 50, max_filename_len: int = 255) -> Column:
    """The relative path of a remote URL in a local copy; null outside the root, when it climbs, or too deep."""
    rest = F.ltrim(F.substr(path(url), F.length(path(root)) + 1), F.lit("/"))
    decoded = percent_decode(rest)
    parts = F.filter(F.split(decoded, "/"), lambda s: s != "")
    ok = path(url).startswith(path(root)) & ~rest.contains("..") & ~F.exists(F.split(decoded, "/"), lambda s: s == "..") & (F.size(parts) <= max_depth)
    return F.when(ok, F.array_join(F.transform(parts, lambda s: safe_filename(s, max_filename_len)), "/"))


def target_root(base: Column, suffix: Column, max_filename_len: int = 255) -> Column:
    """Base and suffix with one slash between, each segment of the suffix made a safe filename; null for a suffix that
    climbs, is absolute or has an empty segment inside. Without a suffix, the base."""
    end = F.trim(suffix, F.lit("/"))
    top = F.concat(F.rtrim(base, F.lit("/")), F.lit("/"))
    parts = F.transform(F.split(end, "/"), lambda s: safe_filename(s, max_filename_len))
    return F.when(F.coalesce(end, F.lit("")) == "", top).when(~suffix.startswith("/") & ~end.contains("..") & ~end.contains("//"), F.concat(top, F.array_join(parts, "/"), F.lit("/")))


def url_security_verdict(url: Column, base: Column) -> Column:
    """The first reason against a URL, or null. The URL is split once."""
    climbs = lambda c: c.contains("/..") | c.startswith("..")
    parts = {"scheme": scheme(url), "netloc": netloc(url), "name": F.rtrim(host(url), F.lit(".")), "home": F.rtrim(host(base), F.lit(".")), "port": port(url), "path": path(url), "low": F.lower(url), "decoded": percent_decode(path(url))}

    def verdict(u: Column) -> Column:
        name, home, p, low = u["name"], u["home"], u["path"], u["low"]
        inside = (name == home) | name.endswith(F.concat(F.lit("."), home))
        before = F.split_part(name, home, F.lit(1))
        fused = name.contains(home) & ~before.endswith(".") & (before != "")
        return (
            F.when(F.coalesce(url, F.lit("")) == "", F.lit("invalid"))
            .when(~u["scheme"].isin("http", "https"), F.lit("scheme"))
            .when(u["netloc"].contains("@"), F.lit("userinfo"))
            .when(name == "", F.lit("no host"))
            .when(name.startswith("xn--"), F.lit("punycode"))
            .when(is_ip(name), F.when(is_private_ip(name), F.lit("private ip")).otherwise(F.lit("ip")))
            .when(F.coalesce(u["port"].isin(BLOCKED_PORTS), F.lit(False)), F.lit("port"))
            .when(~inside, F.when(fused, F.lit("suffix attack")).otherwise(F.lit("other domain")))
            .when(climbs(p), F.lit("traversal"))
            .when(low.contains("%2e") & F.lower(p).contains("%2e") & climbs(u["decoded"]), F.lit("encoded traversal"))
            .when(url.contains("\0") | low.contains("%00"), F.lit("nul"))
            .when(url.rlike(r"[\r\n\t]"), F.lit("control"))
            .when(low.rlike("%0d|%0a|%09"), F.lit("encoded control"))
            .when((F.lower(p).contains("%25") | F.lower(p).contains("%c0%af")) & climbs(percent_decode(u["decoded"])), F.lit("double encoded traversal"))
        )

    return _let(F.struct(*[c.alias(k) for k, c in parts.items()]), verdict)


def scope_verdict(url: Column, root: Column) -> Column:
    """Why a URL is not strictly below a root, or null."""
    top = F.when(path(root) == "", F.lit("/")).otherwise(F.concat(F.rtrim(path(root), F.lit("/")), F.lit("/")))
    below = lambda tail, top: F.when(F.length(tail) > F.length(top), F.substr(tail, F.length(top) + 1)).otherwise(F.lit(""))

    def verdict(u: Column) -> Column:
        rest = u["rest"]
        return (
            F.when(~has_web_scheme(url), F.lit("scheme"))
            .when(u["tail"] == "", F.lit("no path"))
            .when(~u["tail"].startswith(u["top"]) & (u["top"] != "/"), F.lit("outside"))
            .when(rest.contains(".."), F.lit("traversal"))
            .when(rest.contains("/.") | rest.contains("./"), F.lit("dot segment"))
            .when(F.lower(rest).rlike("%2e|%2f") & (percent_decode(rest).contains("..") | percent_decode(rest).contains("/.")), F.lit("encoded traversal"))
        )

    split = _let(F.struct(url_tail(url).alias("tail"), top.alias("top")), lambda u: F.struct(u["tail"].alias("tail"), u["top"].alias("top"), below(u["tail"], u["top"]).alias("rest")))
    return _let(split, verdict)


def has_web_scheme(url: Column) -> Column:
    return url.rlike("(?i)^https?://")


def _ipv4(ip: Column) -> Column:
    parts = F.transform(F.split(ip, r"\."), lambda x: x.cast("long"))
    return F.when(ip.rlike(r"^(?:(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])(?:\.(?!$)|$)){4}$"), F.aggregate(parts, F.lit(0).cast("long"), lambda a, x: a * 256 + x))


def _ipv6(ip: Column) -> Column:
    """An IPv6 address as 32 hex digits; null for other text. A scope (%...) is left off."""
    bare = F.lower(F.split_part(ip, F.lit("%"), F.lit(1)))
    four = _ipv4(F.regexp_extract(bare, r":([0-9.]+)$", 1))
    tail = F.lower(F.concat(F.lpad(F.hex(F.floor(four / 65536)), 4, "0"), F.lit(":"), F.lpad(F.hex(four % 65536), 4, "0")))
    plain = F.when(bare.contains("."), F.concat(F.regexp_extract(bare, r"^(.*:)[0-9.]+$", 1), tail)).otherwise(bare)

    def digits(p: Column) -> Column:
        groups = lambda side: F.filter(F.split(side, ":"), lambda g: g != "")
        left, right = groups(F.split_part(p, F.lit("::"), F.lit(1))), groups(F.split_part(p, F.lit("::"), F.lit(2)))
        zeros = F.array_repeat(F.lit("0"), F.greatest(F.lit(8) - F.size(left) - F.size(right), F.lit(0)))
        every = F.concat(left, F.when(p.contains("::"), zeros).otherwise(F.array().cast("array<string>")), right)
        shaped = p.rlike("^(?:[0-9a-f]{1,4}(?::[0-9a-f]{1,4})*)?(?:::(?:[0-9a-f]{1,4}(?::[0-9a-f]{1,4})*)?)?$")
        fits = (F.size(every) == 8) & (~p.contains("::") | (F.size(left) + F.size(right) < 8))
        return F.when(shaped & fits, F.array_join(F.transform(every, lambda g: F.lpad(g, 4, "0")), ""))

    return F.when(ip.contains(":"), _let(plain, digits))


def _other_ip(ip: Column) -> Column:
    """`private` or `public` for an address with a colon, null for other text."""

    def within(x: Column, ranges: list[str]) -> Column:
        hit = F.lit(False)
        for net in map(ipaddress.ip_network, ranges):
            hit = hit | x.between(f"{int(net[0]):032x}", f"{int(net[-1]):032x}")
        return hit

    def kind(x: Column) -> Column:
        low = within(x, PRIVATE_RANGES_6) & ~within(x, PUBLIC_RANGES_6)
        return F.when(x.isNotNull(), F.when(low, F.lit("private")).otherwise(F.lit("public")))

    return F.when(ip.contains(":"), _let(_ipv6(ip), kind))


def is_ip(ip: Column) -> Column:
    return _ipv4(ip).isNotNull() | F.coalesce(_other_ip(ip).isNotNull(), F.lit(False))


def _private_ipv4(n: Column) -> Column:
    hit = F.lit(False)
    for start, bits in PRIVATE_RANGES:
        low = int(ipaddress.ip_address(start))
        hit = hit | n.between(low, low + (1 << (32 - bits)) - 1)
    return hit


def is_private_ip(ip: Column) -> Column:
    """Private, loopback, link-local or reserved; text that is no address counts as private."""
    n = _ipv4(ip)
    return F.when(n.isNotNull(), _private_ipv4(n)).otherwise(F.coalesce(_other_ip(ip) == "private", F.lit(True)))
