"""WARC archives with a two-level capture index.

Every task writes one archive, each record a gzip member of its own.  Index
lines (reversed-host key, date, id, archive, offset, length) are sorted over
all tasks and cut into compressed blocks; a shard file holds one task's blocks
in key order and ends with a directory of their first keys.  The directory of
shards (first key, last key) is a small Parquet table.  A lookup searches the
shards, then the shard's directory, then range-reads one block and searches
its lines, then range-reads the record.

Archives have names that no other attempt of the task uses, so a task that
runs twice leaves a file that no index line names.  Files are written through
``pyarrow.fs`` to the shared folder, local or remote.
"""

from __future__ import annotations

import bisect
import gzip
import hashlib
import json
import struct
import uuid
from collections.abc import Iterator
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import column, materialise, open_fs, partitions, shared_path, text_chunks

#: Payloads below this many bytes are always written in full.
MIN_REVISIT = 100
BLOCK_LINES = 3000
DATE = "1970-01-01T00:00:00Z"
_FILES: dict[str, object] = {}


def url_key(url: str | None) -> str:
    """Sort key of a URL: host labels reversed, then path and query; without a host, the URL after ``)``."""
    text = "" if url is None else "".join(c if " " < c != "\x7f" else f"%{ord(c):02X}" for c in url)
    try:
        parts = urlsplit(text)
        host, port = parts.hostname or "", parts.port
    except ValueError:
        host, port = "", None
    if not host:
        return ")" + text
    host = host.removeprefix("www.")
    default = {"http": 80, "https": 443}.get(parts.scheme)
    key = ",".join(reversed(host.split("."))) + (f":{port}" if port and port != default else "") + ")" + (parts.path or "/")
    return key + (f"?{parts.query}" if parts.query else "")


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str = DATE) -> bytes:
    """One WARC record as a gzip member."""
    target = "".join(c if " " < c != "\x7f" else f"%{ord(c):02X}" for c in url or "urn:none")
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    body = http if refers_to is not None else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{page_id}>",
        f"WARC-Target-URI: {target}",
        f"WARC-Date: {date}",
        f"WARC-Payload-Digest: sha256:{digest}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(body)}",
    ]
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    raw = "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + body + b"\r\n\r\n"
    return gzip.compress(raw, 6, mtime=0)


def parse_record(member: bytes) -> dict:
    """A record's fields, with its payload where it has one; its digest is checked."""
    raw = gzip.decompress(member)
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    body = rest[: int(fields["Content-Length"])]
    http, _, payload = body.partition(b"\r\n\r\n")
    length = int(next(x.split(b": ")[1] for x in http.split(b"\r\n") if x.startswith(b"Content-Length: ")))
    digest = fields["WARC-Payload-Digest"].removeprefix("sha256:")

    def page(name: str) -> int | None:
        value = fields.get(name, "<urn:page:None>")[10:-1]
        return None if value == "None" else int(value)

    if fields["WARC-Type"] == "response" and (len(payload) != length or hashlib.sha256(payload).hexdigest() != digest):
        raise ValueError(f"damaged record of page {page('WARC-Record-ID')}")
    return {
        "page_id": page("WARC-Record-ID"), "url": fields["WARC-Target-URI"], "payload_bytes": length, "payload_digest": digest,
        "record_type": fields["WARC-Type"], "refers_to": page("WARC-Refers-To"), "payload": payload if fields["WARC-Type"] == "response" else None,
    }


def decide(pages: DataFrame, min_revisit: int = MIN_REVISIT) -> DataFrame:
    """(page_id, url, payload, digest, refers_to): which rows are written in full.

    Of equal payloads of ``min_revisit`` bytes or more, the one with the
    smallest page_id is; the others refer to it.  What refers is decided on ids
    and digests alone.
    """
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    facts = pages.select("page_id", F.sha2(payload, 256).alias("digest"), F.octet_length(payload).alias("size"))
    several = facts.where(F.col("size") >= min_revisit).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
    later = facts.join(several.where("n > 1").select("digest", "first").hint("merge"), "digest").where("page_id is null or page_id > first")
    later = later.select("digest", F.col("page_id").isNull().alias("bare"), F.coalesce("page_id", F.lit(0)).alias("id"), "first").distinct()
    # payloads are joined by digest and id, so that a payload that is everywhere doesn't meet in one task
    rows = pages.select("page_id", "url", payload.alias("payload"), F.sha2(payload, 256).alias("digest"), F.col("page_id").isNull().alias("bare"), F.coalesce("page_id", F.lit(0)).alias("id"))
    joined = rows.join(later.hint("merge"), ["digest", "bare", "id"], "left")
    return joined.select("page_id", "url", "payload", "digest", F.col("first").alias("refers_to"))


_LINES = 3000
DATE = "1970-01-01T00:00:00Z"
_FILES: dict[str, object] = {}


def url_key(url: str | None) -> str:
    """Sort key of a URL: host labels reversed, then path and query; without a host, the URL after ``)``."""
    text = "" if url is None else "".join(c if " " < c != "\x7f" else f"%{ord(c):02X}" for c in url)
    try:
        parts = urlsplit(text)
        host, port = parts.hostname or "", parts.port
    except ValueError:
        host, port = "", None
    if not host:
        return ")" + text
    host = host.removeprefix("www.")
    default = {"http": 80, "https": 443}.get(parts.scheme)
    key = ",".join(reversed(host.split("."))) + (f":{port}" if port and port != default else "") + ")" + (parts.path or "/")
    return key + (f"?{parts.query}" if parts.query else "")


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str = DATE) -> bytes:
    """One WARC record as a gzip member."""
    target = "".join(c if " " < c != "\x7f" else f"%{ord(c):02X}" for c in url or "urn:none")
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    body = http if refers_to is not None else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{page_id}>",
        f"WARC-Target-URI: {target}",
        f"WARC-Date: {date}",
        f"WARC-Payload-Digest: sha256:{digest}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(body)}",
    ]
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    raw = "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + body + b"\r\n\r\n"
    return gzip.compress(raw, 6, mtime=0)


def parse_record(member: bytes) -> dict:
    """A record's fields, with its payload where it has one; its digest is checked."""
    raw = gzip.decompress(member)
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    body = rest[: int(fields["Content-Length"])]
    http, _, payload = body.partition(b"\r\n\r\n")
    length = int(next(x.split(b": ")[1] for x in http.split(b"\r\n") if x.startswith(b"Content-Length: ")))
    digest = fields["WARC-Payload-Digest"].removeprefix("sha256:")

    def page(name: str) -> int | None:
        value = fields.get(name, "<urn:page:None>")[10:-1]
        return None if value == "None" else int(value)

    if fields["WARC-Type"] == "response" and (len(payload) != length or hashlib.sha256(payload).hexdigest() != digest):
        raise ValueError(f"damaged record of page {page('WARC-Record-ID')}")
    return {
        "page_id": page("WARC-Record-ID"), "url": fields["WARC-Target-URI"], "payload_bytes": length, "payload_digest": digest,
        "record_type": fields["WARC-Type"], "refers_to": page("WARC-Refers-To"), "payload": payload if fields["WARC-Type"] == "response" else None,
    }


def decide(pages: DataFrame, min_revisit: int = MIN_REVISIT) -> DataFrame:
    """(page_id, url, payload, digest, refers_to): which rows are written in full.

    Of equal payloads of ``min_revisit`` bytes or more, the one with the
    smallest page_id is; the others refer to it.  What refers is decided on ids
    and digests alone.
    """
    facts = pages.select("page_id", "url", F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload"))
    facts = facts.withColumn("digest", F.sha2("payload", 256))
    several = facts.where(F.octet_length("payload") >= min_revisit).groupBy("digest")
    several = several.agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").select("digest", "first")
    joined = facts.join(several, "digest", "left")
    later = F.col("first").isNotNull() & (F.col("page_id").isNull() | (F.col("page_id") > F.col("first")))
    return joined.select("page_id", "url", "payload", "digest", F.when(later, F.col("first")).alias("refers_to"))


_LINES = "key string, page_id long, file string, offset long, length long"


def write_archives(records: DataFrame, path: str) -> DataFrame:
    """Write ``records`` of :func:`decide`; returns one index line a record."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, name, at = None, f"records-{uuid.uuid4().hex}.warc.gz", 0
        for batch in text_chunks(batches, "payload", 8 << 20):
            if out is None:
                fs, root = open_fs(path)
                fs.create_dir(root, recursive=True)
                out = fs.open_output_stream(f"{root}/{name}", compression=None)
            lines: list[list] = [[], [], [], [], []]
            for row in batch.to_pylist():
                data = record(row["page_id"], row["url"], row["payload"], row["digest"], row["refers_to"])
                out.write(data)
                for col, v in zip(lines, (url_key(row["url"]), row["page_id"], name, at, len(data)), strict=True):
                    col.append(v)
                at += len(data)
            types = (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(lines, types, strict=True)], names=["key", "page_id", "file", "offset", "length"])
        if out is not None:
            out.close()

    return records.mapInArrow(run, _LINES)


def write_index(lines: DataFrame, path: str, block_lines: int = BLOCK_LINES) -> DataFrame:
    """Sort index lines over all tasks into shard files; returns (shard, first, last, blocks)."""
    ordered = lines.repartitionByRange(partitions(lines), "key", "page_id", "file", "offset").sortWithinPartitions("key", "page_id", "file", "offset")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, name, at = None, f"index-{uuid.uuid4().hex}.cdx.gz", 0
        held: list[str] = []
        directory: list[list] = []
        last = ""

        def flush() -> None:
            nonlocal at
            data = gzip.compress("\n".join(held).encode("utf-8", "surrogatepass"), 6, mtime=0)
            out.write(data)
            directory.append([held[0].split("\t", 1)[0], at, len(data)])
            at += len(data)
            held.clear()

        for batch in batches:
            for row in batch.to_pylist():
                if out is None:
                    fs, root = open_fs(path)
                    fs.create_dir(root, recursive=True)
                    out = fs.open_output_stream(f"{root}/{name}", compression=None)
                last = row["key"]
                held.append("\t".join([last, json.dumps([row["page_id"], row["file"], row["offset"], row["length"]])]))
                if len(held) == block_lines:
                    flush()
        if out is None:
            return
        if held:
            flush()
        tail = gzip.compress(json.dumps(directory).encode(), 6, mtime=0)
        out.write(tail + struct.pack("<Q", len(tail)))
        out.close()
        cols = [pa.array([v]) for v in (name, directory[0][0], last, len(directory))]
        yield pa.RecordBatch.from_arrays(cols, names=["shard", "first", "last", "blocks"])

    return ordered.mapInArrow(run, "shard string, first string, last string, blocks long")


def _open(path: str, name: str):
    """An open file of the archive; a few are kept open by a worker."""
    full = f"{path}/{name}"
    if full not in _FILES:
        if len(_FILES) >= 64:
            _FILES.pop(next(iter(_FILES))).close()
        fs, root = open_fs(path)
        _FILES[full] = fs.open_input_file(f"{root}/{name}")
    return _FILES[full]


def _range(path: str, name: str, offset: int, length: int) -> bytes:
    f = _open(path, name)
    f.seek(offset)
    return f.read(length)


def directory(path: str, shard: str) -> list[list]:
    """(first key, offset, length) of a shard's blocks, read from its end."""
    f = _open(path, shard)
    size = f.size()
    (n,) = struct.unpack("<Q", _range(path, shard, size - 8, 8))
    return json.loads(gzip.decompress(_range(path, shard, size - 8 - n, n)))


def block(path: str, shard: str, offset: int, length: int) -> list[tuple[str, list]]:
    lines = gzip.decompress(_range(path, shard, offset, length)).decode("utf-8", "surrogatepass").split("\n")
    pairs = (x.split("\t", 1) for x in lines)
    return [(k, json.loads(v)) for k, v in pairs]


def lookup(path: str, shards: list[tuple[str, str, str]], url: str) -> list[dict]:
    """All captures of a URL, by binary search; ``shards`` are (first, last, shard) in key order."""
    key, found = url_key(url), []
    for first, last, shard in shards[bisect.bisect_left([s[1] for s in shards], key) :]:
        if first > key:
            break
        blocks = directory(path, shard)
        firsts = [b[0] for b in blocks]
        for _, offset, length in blocks[max(0, bisect.bisect_left(firsts, key) - 1) : bisect.bisect_right(firsts, key)]:
            lines = block(path, shard, offset, length)
            keys = [k for k, _ in lines]
            for _, (_, file, at, n) in lines[bisect.bisect_left(keys, key) : bisect.bisect_right(keys, key)]:
                found.append(parse_record(_range(path, file, at, n)))
    return found


class Archive:
    """Archives and index under ``path``."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path

    @property
    def shards(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/shards")

    def captures(self, url: str) -> list[dict]:
        """Captures of one URL; only shards whose range holds its key reach the driver."""
        key = F.lit(url_key(url))
        rows = self.shards.where((F.col("first") <= key) & (F.col("last") >= key)).orderBy("first", "last").collect()
        return lookup(self.path, [(r["first"], r["last"], r["shard"]) for r in rows], url)

    def read(self, with_payload: bool = False) -> DataFrame:
        """Every capture, through directory and blocks, in one task a block."""
        path = self.path

        def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for shard in batch.column("shard").to_pylist():
                    d = directory(path, shard)
                    cols = [pa.array([shard] * len(d)), pa.array([x[1] for x in d]), pa.array([x[2] for x in d])]
                    yield pa.RecordBatch.from_arrays(cols, names=["shard", "offset", "length"])

        names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"] + ["url", "payload"] * with_payload
        types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()] + [pa.string(), pa.binary()] * with_payload
        schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", url string, payload binary" * with_payload

        def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for b in batch.to_pylist():
                    places = sorted(tuple(v[1:]) for _, v in block(path, b["shard"], b["offset"], b["length"]))
                    for k in range(0, len(places), 500):
                        rows = [parse_record(_range(path, *p)) for p in places[k : k + 500]]
                        yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], t) for n, t in zip(names, types, strict=True)], names=names)

        found = self.shards.select("shard").mapInArrow(blocks, "shard string, offset long, length long")
        return found.repartition(partitions(found), "shard", "offset").mapInArrow(records, schema)


def write(pages: DataFrame, path: str | None = None, min_revisit: int = MIN_REVISIT) -> Archive:
    """Write one record for every row of ``pages`` (page_id, url, html), and the index.

    Rows: null html is an empty payload; a null or odd URL is kept under a key
    of its own; repeated rows are separate records (of those that share the
    smallest id, each is written in full); rows without an id refer to the
    first that has one.  An empty table gives an archive without shards.
    Other columns are not read.
    """
    spark = pages.sparkSession
    path = path or shared_path(spark, "warc")
    plain = pages.select(column("page_id").cast("long"), column("url").cast("string"), column("html").cast("string"))
    lines = materialise(write_archives(decide(plain, min_revisit), path), "captures")
    write_index(lines, path).write.parquet(f"{path}/shards")
    return Archive(spark, path)
