"""HTTP header, size and fingerprint columns."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MAX_DELAY = 60.0


def normalize_etag(etag: Column) -> Column:
    """Without the weak mark and quotes; null reads empty."""
    return F.coalesce(F.trim(F.regexp_replace(etag, "^[Ww]/", ""), F.lit('"')), F.lit(""))


def parse_http_date(value: Column) -> Column:
    """`Fri, 31 Jul 2026 07:28:00 GMT` as a timestamp; null where it is none."""
    bare = F.regexp_extract(value, r"^(?:[A-Za-z]+,)?\s*([0-9]{1,2} [A-Za-z]{3} [0-9]{4} [0-9]{2}:[0-9]{2}:[0-9]{2})", 1)
    return F.try_to_timestamp(F.when(bare.rlike("^[0-9] "), F.concat(F.lit("0"), bare)).when(bare != "", bare), F.lit("dd MMM yyyy HH:mm:ss"))


def retry_after_seconds(value: Column, as_of: Column, most: float = MAX_DELAY) -> Column:
    """Seconds to wait, between 0 and `most`: digits, or a date against `as_of`; else null."""
    text = F.trim(value)
    digits = F.when(text.rlike("^[0-9]+$"), text.cast("double"))
    until = F.unix_micros(parse_http_date(text)) / 1e6 - F.unix_micros(as_of.cast("timestamp")) / 1e6
    return F.least(F.greatest(F.coalesce(digits, until), F.when(F.coalesce(digits, until).isNotNull(), F.lit(0.0))), F.when(F.coalesce(digits, until).isNotNull(), F.lit(most)))


def backoff_seconds(attempt: Column, base: float = 1.0, most: float = MAX_DELAY, seed: int | None = None) -> Column:
    """min(base * 2^attempt, most); with a seed up to a tenth more, never above `most`."""
    wait = F.least(F.lit(base) * F.pow(F.lit(2.0), attempt), F.lit(most))
    return wait if seed is None else wait + F.rand(seed) * F.least(wait * 0.1, F.lit(most) - wait)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    return F.transform(F.array(value), body)[0]


def _two_places(v: Column) -> Column:
    """A number to two places, as Python and C print it: by its exact binary value, halves to even. (Java's formatter
    rounds halves of the decimal digits up.)"""

    def exact(a: Column) -> Column:
        scaled = (a - F.floor(a)) * float(1 << 52)
        return _let(scaled, lambda x: _let(F.struct((F.floor(x) * 100 + F.floor((x - F.floor(x)) * 100.0)).alias("h"), ((x - F.floor(x)) * 100.0 > F.floor((x - F.floor(x)) * 100.0)).alias("more")), lambda h: cents(a, h)))

    def cents(a: Column, h: Column) -> Column:
        places, rest, half = F.shiftright(h["h"], 52), h["h"] % F.lit(1 << 52), F.lit(1 << 51)
        up = (rest > half) | ((rest == half) & (h["more"] | (places % 2 == 1)))
        return _let(F.floor(a) * 100 + places + F.when(up, 1).otherwise(0), lambda n: F.concat(F.when(v < 0, F.lit("-")).otherwise(F.lit("")), F.floor(n / 100).cast("string"), F.lit("."), F.lpad((n % 100).cast("string"), 2, "0")))

    return F.when(F.abs(v) < float(1 << 53), exact(F.abs(v))).otherwise(F.format_string("%.2f", v))  # whole numbers beyond


def format_bytes(n: Column) -> Column:
    """`1.50 KB`: in the largest unit that leaves at least 1, to two places, halves to even."""
    unit = F.when(n.cast("double") < 1024.0, 0)
    for i in range(1, 5):
        unit = unit.when(n.cast("double") < float(1024 ** (i + 1)), i)
    units = F.array(*[F.struct(F.lit(float(1024**i)).alias("size"), F.lit(f" {name}").alias("name")) for i, name in enumerate(["B", "KB", "MB", "GB", "TB", "PB"])])
    return _let(F.get(units, unit.otherwise(5)), lambda u: _let(n.cast("double") / u["size"], lambda v: F.concat(_two_places(v), u["name"])))


def format_duration(seconds: Column, show_ms: bool = False) -> Column:
    whole = F.floor(seconds)
    told = F.concat((whole / 3600).cast("long").cast("string"), F.lit("h "), ((whole % 3600) / 60).cast("long").cast("string"), F.lit("m "), (whole % 60).cast("string"), F.lit("s"))
    out = F.when(seconds < 0, F.lit("unknown"))
    if show_ms:
        out = out.when(seconds < 1, F.concat(F.greatest(F.lit(1), F.rint(seconds * 1000).cast("long")).cast("string"), F.lit("ms")))
    return out.otherwise(told)


@F.pandas_udf(T.StringType())
def _blake2b(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else hashlib.blake2b(bytes(x), digest_size=32).hexdigest())


def content_signature(content: Column, algorithm: str = "sha256") -> Column:
    """Hexadecimal fingerprint of bytes: md5, sha256 (native) or blake2b (Arrow)."""
    return {"md5": F.md5, "sha256": lambda c: F.sha2(c, 256), "blake2b": _blake2b}[algorithm](content)


def listing_signature(children: Column) -> Column:
    """MD5 over the sorted children of a listing."""
    return F.md5(F.array_join(F.array_sort(children), "\n"))


def listing_signatures(rows: DataFrame, folder: str, child: str) -> DataFrame:
    """folder, signature: MD5 over each folder's children, sorted by their bytes and joined by line ends; as
    `listing_signature` gives it for an array, but streamed.

    Rows are sorted by (folder, child) within partitions by folder, so a hash is fed row after row and a folder with a
    third of all children takes the memory of one batch. Hashing a sequence is one task's work a folder. Duplicates count
    as often as they come; null children are left out; a null folder is a folder.
    """
    kind = rows.schema[folder].dataType.simpleString()

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, running, names, out = object(), None, [], []

        def told() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(names, at), pa.array(out, pa.string())], [folder, "signature"])

        at = None
        for batch in batches:
            at = batch.schema.field(0).type
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()):
                if running is None or name != now:
                    if running is not None:
                        names.append(now)
                        out.append(running.hexdigest())
                    now, running = name, hashlib.md5(text, usedforsecurity=False)
                else:
                    running.update(b"\n" + text)
            if len(names) > 10_000:
                yield told()
                names, out = [], []
        if running is not None:
            names.append(now)
            out.append(running.hexdigest())
            yield told()

    dealt = rows.select(folder, F.col(child).cast("string").alias("_child")).where("_child IS NOT NULL").repartition(folder).sortWithinPartitions(folder, "_child")
    return dealt.mapInArrow(hashed, f"`{folder}` {kind}, signature string")


def dir_signature(url: Column, content: Column, etag: Column, modified: Column) -> Column:
    """By preference content, ETag, Last-Modified; else the url: form, which is never trusted."""
    tag = lambda name, c: F.when(c != "", F.concat(F.lit(f"{name}:"), c))
    return F.coalesce(tag("content", content), tag("etag", normalize_etag(etag)), tag("mtime", modified.cast("string")), F.concat(F.lit("url:"), url))
