"""WARC archives: write one gzip member per record through Spark's text sink, read them back sequentially."""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_folder, small, staged, table

# The record format.
VERSION, CRLF = b"WARC/1.1", b"\r\n"
REVISIT_PROFILE = b"http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CHUNK = 1 << 16
#: An archive takes about so many bytes of payload, so one read task holds little more than that.
ARCHIVE_BYTES = 16 << 20


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str, payload: bytes, refers_to: int | None, date: str) -> bytes:
    """One gzip member. A revisit (refers_to given) has the HTTP head alone; its Content-Length is the payload's."""
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    body = head if refers_to is not None else head + payload
    uri = "".join(c for c in url if c not in "\r\n").encode()
    name = b"<urn:page:%s>"
    fields = [
        (b"WARC-Type", b"response" if refers_to is None else b"revisit"),
        (b"WARC-Record-ID", name % (b"" if page_id is None else b"%d" % page_id)),
        (b"WARC-Date", date.encode()),
        (b"WARC-Target-URI", uri),
        (b"Content-Type", b"application/http; msgtype=response"),
        (b"WARC-Payload-Digest", b"sha1:" + payload_digest(payload).encode()),
        (b"WARC-Block-Digest", b"sha1:" + payload_digest(body).encode()),
        *([(b"WARC-Profile", REVISIT_PROFILE), (b"WARC-Refers-To", name % (b"%d" % refers_to))] if refers_to is not None else []),
        (b"Content-Length", b"%d" % len(body)),
    ]
    raw = VERSION + CRLF + b"".join(k + b": " + v + CRLF for k, v in fields) + CRLF + body + CRLF + CRLF
    return gzip.compress(raw, 6, mtime=0)


def read_records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """The records of an archive in order: headers and block. One member is inflated at a time, chunk by chunk; blocks
    are framed by Content-Length, and a wrong frame or digest raises ValueError."""
    view, at = memoryview(data), 0
    while at < len(view):
        member, out = zlib.decompressobj(wbits=31), bytearray()
        while not member.eof:
            if at >= len(view):
                raise ValueError("the archive ends inside a record")
            part = view[at : at + CHUNK]
            out += member.decompress(part)
            at += len(part)
        at -= len(member.unused_data)
        head, _, rest = bytes(out).partition(CRLF + CRLF)
        lines = head.split(CRLF)
        if lines[0] != VERSION:
            raise ValueError("not a WARC record")
        headers = dict(x.decode().split(": ", 1) for x in lines[1:])
        n = int(headers["Content-Length"])
        if len(rest) != n + 4 or rest[n:] != CRLF + CRLF:
            raise ValueError("Content-Length does not frame the block")
        block = rest[:n]
        if headers["WARC-Block-Digest"] != f"sha1:{payload_digest(block)}":
            raise ValueError("the block does not match its digest")
        if headers["WARC-Type"] == "response" and headers["WARC-Payload-Digest"] != f"sha1:{payload_digest(block.partition(CRLF + CRLF)[2])}":
            raise ValueError("the payload does not match its digest")
        yield headers, block


def plan_revisits(pages: DataFrame, min_revisit_bytes: int = 0) -> DataFrame:
    """page_id, url, payload, refers_to. Of equal payloads of at least `min_revisit_bytes` bytes the smallest page_id
    is the response that the others refer to.

    Null html is an empty payload; a null page_id counts as the largest, and only a payload without any page_id has a
    response without one. Rows that repeat the response's page_id with its payload are responses too. The digests are
    summed up before the shuffle, so a payload that a third of the pages share costs each task one row.
    """
    payload = F.encode(F.coalesce(F.col("html"), F.lit("")), "UTF-8")
    digest = F.sha2(payload, 256)
    first = pages.select("page_id", digest.alias("digest")).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
    first = staged(first.where("n > 1 AND first IS NOT NULL").drop("n"))
    rows = pages.select("page_id", F.coalesce("url", F.lit("")).alias("url"), payload.alias("payload"), digest.alias("digest")).join(small(first, 80), "digest", "left")
    again = (F.length("payload") >= min_revisit_bytes) & F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return rows.select("page_id", "url", "payload", F.when(again, F.col("first")).alias("refers_to"))


def write_archives(planned: DataFrame, path: str, date: str = "2024-01-01T00:00:00Z", archive_bytes: int = ARCHIVE_BYTES) -> None:
    """Write page_id, url, payload, refers_to as .warc.gz members into files under `path`, on any store Spark writes to.

    Spark's text sink ends each row with a one-byte separator. A gzip member ends with the top byte of its length,
    which is 0 below 16 MiB: the sink gets the member without that byte and the byte as its separator. Longer records
    (rarely any) are written apart, by their top byte. Tasks commit through Spark's own protocol.
    """

    def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [record(*row, date) for row in zip(*(batch.column(i).to_pylist() for i in range(4)))]
            yield pa.RecordBatch.from_arrays([pa.array([m[:-1] for m in made], pa.binary()), pa.array([m[-1] for m in made], pa.int32())], ["member", "top"])

    total = planned.agg(F.coalesce(F.sum(F.length("payload")), F.lit(0))).first()[0]
    files = max(1, round(total / archive_bytes))
    dealt = planned.repartition(files, F.xxhash64("page_id", "url")).sortWithinPartitions("page_id", "url")
    made = staged(dealt.mapInArrow(members, "member binary, top int"))
    for top in [r[0] for r in made.select("top").distinct().collect()] or [0]:  # at most 127 values
        made.where(F.col("top") == top).select(F.col("member").cast("string").alias("value")).write.mode("append").option("lineSep", chr(top)).text(path)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """page_id, url, record_type, refers_to, payload_bytes, payload_digest and payload (null for a revisit), one row a record."""
    schema = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"

    def number(name: str | None) -> int | None:
        found = (name or "").removeprefix("<urn:page:").removesuffix(">")
        return int(found) if found else None

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in schema.split(", ")]
        types = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
        for batch in batches:
            for content in batch.column(0):
                out: list[tuple] = []
                held = 0
                for h, block in read_records(content.as_py()):
                    head, _, payload = block.partition(CRLF + CRLF)
                    length = next(int(x.split(b":")[1]) for x in head.split(CRLF) if x.lower().startswith(b"content-length:"))
                    kind = h["WARC-Type"]
                    out.append((number(h["WARC-Record-ID"]), h["WARC-Target-URI"], kind, number(h.get("WARC-Refers-To")), length, h["WARC-Payload-Digest"].removeprefix("sha1:"), payload if kind == "response" else None))
                    held += len(block)
                    if held > ARCHIVE_BYTES:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)
                        out, held = [], 0
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").load(path).select("content")
    return files.mapInArrow(rows, schema)


def op9_warc_round_trip(spark, sf_dir: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every record read back from the archives.

    Null html: an empty payload, which other empty ones refer to. Repeated rows of the response are responses; null
    page_ids come back as null. Payloads of any size are one record each. Empty table: no rows. Of further columns,
    url alone is read.
    """
    path = f"{shared_folder(spark)}/tidemark-warc-{uuid.uuid4().hex}"
    write_archives(plan_revisits(table(spark, sf_dir, "pages")), path)
    return read_archives(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP9_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
m AS (SELECT page_id, h, min(page_id) OVER (PARTITION BY h) AS f, upper(sha1(h)) AS x FROM p),
g AS (SELECT page_id, h, f, [CAST('0x' || substr(x, 5 * i + 1, 5) AS INTEGER) FOR i IN range(8)] AS v FROM m)
SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes,
  array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((n >> 15) & 31) + 1, 1) || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((n >> 10) & 31) + 1, 1)
    || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((n >> 5) & 31) + 1, 1) || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (n & 31) + 1, 1) FOR n IN v], '') AS payload_digest,
  CASE WHEN page_id IS DISTINCT FROM f THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id IS DISTINCT FROM f THEN f END AS refers_to
FROM g
"""
