"""WARC archives, index first.

Writing gives an index row per record: file, offset, length, URL and digest.
Reading selects index rows, sorts them by place and reads near ranges in one
go, so a few records cost a few seeks and all records cost whole-file reads.

Each task writes one archive of gzip members to the shared folder under a name
of its own; a repeated task writes another file, and the index (written once)
names only the files of the tasks that counted.

Of the payloads of at least ``min_bytes`` that are equal, that of the smallest
page id is a response record and the others revisit it. Whether a payload was
met elsewhere comes from a hash store of the repeated digests, so payloads are
never shuffled and a very common payload makes no hot task.

A null payload is an empty one. Rows that repeat both id and payload of the
response are responses too. A null id is never referred to; its row revisits
the payload's response if there is one, and it is a response otherwise. URLs
lose control characters; a null URL becomes about:blank. An empty table gives
an empty index. Extra columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import os
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import HashStore, bucket_bits, saved, scan_bytes, shared_dir, slices, texts, tidy, write_store

DATE = "2025-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
GAP = 64 << 10
RANGE = 8 << 20
INDEX = "page_id long, url string, digest string, record_type string, file string, offset long, length long"


def digest32(raw: bytes) -> str:
    """Bare upper-case base32 of the SHA-1."""
    return base64.b32encode(hashlib.sha1(raw).digest()).decode()


def record(page: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One gzip member. A revisit holds the HTTP header alone, with the full payload's length."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if refers_to is None else http
    uri = "".join(c for c in url or "" if ord(c) > 32 and ord(c) != 127) or "about:blank"
    head = [
        "WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{'' if page is None else page}>", f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {uri}", f"WARC-Payload-Digest: sha1:{digest}",
        *([] if refers_to is None else [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]),
        "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    pack = zlib.compressobj(1, zlib.DEFLATED, 31)
    return pack.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + pack.flush()


def parse(member: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """A record's WARC fields, HTTP fields and payload."""
    raw = zlib.decompress(member, 31)
    head, rest = raw.split(b"\r\n\r\n", 1)
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, payload = block.split(b"\r\n\r\n", 1)
    return fields, dict(line.split(": ", 1) for line in http.decode().split("\r\n")[1:]), payload


def write(spark: SparkSession, pages: DataFrame, min_bytes: int = 0, id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Writes the archives; gives their index."""
    body = F.coalesce(F.col(html), F.lit(""))
    repeated = (
        pages.select(F.col(id).cast("long").alias("p"), F.sha1(body.cast("binary")).alias("h"), F.octet_length(body).alias("n"))
        .filter(F.col("n") >= min_bytes).groupBy("h").agg(F.count("*").alias("n"), F.min("p").alias("p")).filter("n > 1 and p is not null")
    )
    path, bits = shared_dir(spark, "digests"), bucket_bits(scan_bytes(pages), 64 << 20)

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sha = [bytes.fromhex(h) for h in b.column("h").to_pylist()]
            key = np.array([int.from_bytes(h[:8], "little") for h in sha], np.uint64).view(np.int64)
            own = [h + p.to_bytes(8, "little", signed=True) for h, p in zip(sha, b.column("p").to_pylist())]
            yield pa.RecordBatch.from_pydict({"key": pa.array(key), "own": pa.array(own, pa.binary())})

    write_store(repeated.select("h", "p").mapInArrow(tidy(keyed), "key long, own binary"), path, bits, blob="own")
    folder = shared_dir(spark, "warc")

    def archive(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, file, at, out = HashStore(path, bits), f"{folder}/{uuid.uuid4().hex}.warc.gz", 0, None
        for batch in batches:
            for part in slices(batch, "html"):
                body = [t.encode() for t in texts(part.column("html")).to_pylist()]
                ids, urls = part.column("page_id").to_pylist(), part.column("url").to_pylist()
                sha = [hashlib.sha1(b).digest() for b in body]
                met = store.blobs(np.array([int.from_bytes(h[:8], "little") for h in sha], np.uint64))
                out = out or open(file, "wb")
                rows = []
                for page, link, raw, h, m in zip(ids, urls, body, sha, met):
                    first = int.from_bytes(m[20:], "little", signed=True) if m and m[:20] == h and len(raw) >= min_bytes else page
                    code = base64.b32encode(h).decode()
                    member = record(page, link, raw, code, None if first == page else first)
                    out.write(member)
                    rows.append((page, link, code, "response" if first == page else "revisit", file, at, len(member)))
                    at += len(member)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), *[pa.string()] * 4, pa.int64(), pa.int64()))], names=["page_id", "url", "digest", "record_type", "file", "offset", "length"])
        if out:
            out.flush()
            os.fsync(out.fileno())
            out.close()

    rows = pages.select(F.col(id).cast("long").alias("page_id"), F.col(url).alias("url"), F.col(html).alias("html"))
    return saved(rows.mapInArrow(tidy(archive), INDEX), spark, "warc-index")


def ranges(rows: list[tuple[str, int, int]]) -> list[tuple[str, int, int, list[int]]]:
    """Sorted (file, offset, length) rows as reads of at most about RANGE bytes: file, start, end, rows."""
    out: list = []
    for k, (file, offset, length) in enumerate(rows):
        last = out[-1] if out else None
        if last and last[0] == file and offset - last[2] <= GAP and offset + length - last[1] <= RANGE:
            last[2] = max(last[2], offset + length)
            last[3].append(k)
        else:
            out.append([file, offset, offset + length, [k]])
    return [tuple(x) for x in out]


def read(index: DataFrame, payloads: bool = False) -> DataFrame:
    """The records that ``index`` rows name, read back and verified:
    (page_id, payload_bytes, payload_digest, record_type, refers_to) and the payload if asked."""
    spark = index.sparkSession

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places = sorted({(f, o, n) for b in batches for f, o, n in zip(*(b.column(c).to_pylist() for c in ("file", "offset", "length")))})
        number = lambda uri: int(x) if (x := uri[len("<urn:page:") : -1]) else None
        for file, start, end, members in ranges(places):
            with open(file, "rb") as f:
                f.seek(start)
                raw = f.read(end - start)
            rows = []
            for k in members:
                _, offset, length = places[k]
                fields, http, payload = parse(raw[offset - start : offset - start + length])
                digest, kind = fields["WARC-Payload-Digest"].removeprefix("sha1:"), fields["WARC-Type"]
                if kind == "response" and digest32(payload) != digest:
                    raise ValueError(f"{file} at {offset}: the payload does not match its digest")
                rows.append((number(fields["WARC-Record-ID"]), int(http["Content-Length"]), digest, kind, number(fields["WARC-Refers-To"]) if kind == "revisit" else None, payload if payloads else None))
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"])

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = index.select("file", "offset", "length").withColumn("block", F.floor(F.col("offset") / RANGE)).repartition(n, "file", "block")
    out = dealt.mapInArrow(tidy(fetch), "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary")
    return out if payloads else out.drop("payload")
