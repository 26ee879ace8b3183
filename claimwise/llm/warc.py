"""Web archives, index first.

Writing: each task writes its pages as records of a .warc.gz file (one gzip member
per record, so that a record is a byte range) in a shared folder, and returns an
index row per record: file, offset, length, URL, digest. A file's name holds the
task attempt, so an attempt that is lost or repeated leaves a file that no index row
names. Of the records with one payload, the one with the smallest page_id is a
response, the others are revisits that name it.

Reading: selected index rows are sorted by file and offset, neighbouring ranges
are read at one go, and each record is parsed and its payload checked against its
digest.

Null html is an empty payload; null URLs have no target header. Rows with a null
page_id come after all others and revisit nothing that has none. Rows equal in page_id
and payload are the same page: all have the group's record type. Other columns are not read,
whatever their names; a very long page is one record. An empty table writes no archive.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import urllib.parse
import uuid

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import input_partitions, materialize, scratch_path, strings

DATE = "2024-01-01T00:00:00Z"
FILE_BYTES = 256_000_000      # a file is closed once it has so many bytes
SPAN_BYTES, GAP_BYTES = 8_000_000, 65_536
BROADCAST_ROWS = 500_000

INDEX = "file string, offset bigint, length bigint, page_id string, url string, payload_digest string, record_type string"


def _open(folder: str) -> tuple[fs.FileSystem, str]:
    if folder.startswith("file:/") and not folder.startswith("file://"):
        folder = "file://" + folder[5:]
    return fs.FileSystem.from_uri(folder)


def base32(sha1_hex: str) -> str:
    return base64.b32encode(bytes.fromhex(sha1_hex)).decode()


def record(page_id, url: str | None, payload: bytes, digest: str, refers_to, refers_url: str | None = None, date: str = DATE) -> bytes:
    """One WARC record; a revisit (``refers_to`` given) carries no payload."""
    kind = "response" if refers_to is None else "revisit"
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + payload if refers_to is None else http
    name = uuid.uuid5(uuid.NAMESPACE_URL, f"{page_id}/{kind}/{digest}")
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:uuid:{name}>", f"WARC-Date: {date}"]
    if url is not None:
        head.append("WARC-Target-URI: " + urllib.parse.quote(url, safe="%/:=&?~#+!$,;'@()*[]"))
    head += [f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {len(payload)}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}")
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"X-Refers-To-Page: {refers_to}",
                 f"WARC-Refers-To: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{refers_to}/response/{digest}')}>"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (lower-case names) and payload."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError("not a WARC record")
    headers = {k.lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}
    block = rest[:int(headers["content-length"])]
    return headers, block.partition(b"\r\n\r\n")[2]


def _writer(folder: str, file_bytes: int, level: int):
    def run(batches):
        task = TaskContext.get()
        store, base = _open(folder)
        store.create_dir(base, recursive=True)
        stem = f"{base}/part-{task.partitionId():05d}-{task.taskAttemptId()}"
        sink, name, at, count = None, None, 0, 0
        for batch in batches:
            rows = []
            for page_id, url, html, sha1, refers in zip(*(batch.column(i).to_pylist() for i in range(5))):
                if sink is None:
                    name, at, count = f"{stem}-{count}.warc.gz", 0, count + 1
                    sink = store.open_output_stream(name, compression=None)
                digest = base32(sha1)
                member = gzip.compress(record(page_id, url, (html or "").encode(), digest, refers), level, mtime=0)
                sink.write(member)
                rows.append((name, at, len(member), page_id, url, digest, "response" if refers is None else "revisit"))
                at += len(member)
                if at >= file_bytes:
                    sink.close()
                    sink = None
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 7, (
                pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string()))],
                names=["file", "offset", "length", "page_id", "url", "payload_digest", "record_type"])
        if sink is not None:
            sink.close()
    return run


def write(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_bytes: int = 0,
          file_bytes: int = FILE_BYTES, level: int = 4) -> DataFrame:
    """Writes the archives; returns the index (``INDEX``), itself written as a table.
    Payloads of fewer than ``min_bytes`` bytes are always responses."""
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), F.coalesce(strings(pages, html_col), F.lit("")).alias("html"))
    rows = rows.withColumn("sha1", F.sha1("html"))
    several = materialize(rows.select("id", "sha1", F.octet_length("html").alias("n")).filter(F.col("n") >= min_bytes)
                          .groupBy("sha1").agg(F.min("id").alias("first"), F.count("*").alias("c")).filter("c > 1").drop("c"), "warc-copies")
    known = F.broadcast(several) if several.count() <= BROADCAST_ROWS else several
    refers = F.when(F.col("id").eqNullSafe(F.col("first")), None).otherwise(F.col("first")).cast("string")
    marked = rows.join(known, "sha1", "left").select(F.col("id").cast("string"), "url", "html", "sha1", refers.alias("refers"))
    return materialize(marked.mapInArrow(_writer(folder, file_bytes, level), INDEX), "warc-index")


def _reader(folder: str, span: int, gap: int):
    def run(batches):
        store, _ = _open(folder)
        source, opened = None, None
        for batch in batches:
            rows = list(zip(*(batch.column(c).to_pylist() for c in ("file", "offset", "length"))))
            out = {k: [] for k in ("page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload")}
            i = 0
            while i < len(rows):
                name, start, size = rows[i]
                j, end = i + 1, start + size
                while j < len(rows) and rows[j][0] == name and 0 <= rows[j][1] - end <= gap and rows[j][1] + rows[j][2] - start <= span:
                    end = rows[j][1] + rows[j][2]
                    j += 1
                if opened != name:
                    if source is not None:
                        source.close()
                    source, opened = store.open_input_file(name), name
                data = source.read_at(end - start, start)
                for _, offset, length in rows[i:j]:
                    headers, payload = parse(gzip.decompress(data[offset - start:offset - start + length]))
                    digest, kind = headers["warc-payload-digest"].removeprefix("sha1:"), headers["warc-type"]
                    if kind == "response" and base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
                        raise ValueError(f"{name} at {offset}: the payload does not have its digest")
                    out["page_id"].append(headers.get("x-page-id"))
                    out["url"].append(headers.get("warc-target-uri"))
                    out["payload_bytes"].append(int(headers["x-payload-length"]))
                    out["payload_digest"].append(digest)
                    out["record_type"].append(kind)
                    out["refers_to"].append(headers.get("x-refers-to-page"))
                    out["payload"].append(payload if kind == "response" else None)
                i = j
            yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64() if k == "payload_bytes" else pa.binary() if k == "payload" else pa.string()) for k, v in out.items()],
                                             names=list(out))
    return run


def read(index: DataFrame, folder: str, span: int = SPAN_BYTES, gap: int = GAP_BYTES) -> DataFrame:
    """(page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload) of the index's records."""
    wanted = index.select("file", "offset", "length")
    wanted = wanted.repartitionByRange(input_partitions(index), "file", "offset").sortWithinPartitions("file", "offset")
    return wanted.mapInArrow(_reader(folder, span, gap), T._parse_datatype_string(
        "page_id string, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to string, payload binary"))


def archive(pages: DataFrame, id_col: str = "page_id", **options) -> DataFrame:
    """Pages written and read back: the digest columns per page, ids in their own type."""
    folder = scratch_path(pages.sparkSession, "warc")
    kind = pages.schema[id_col].dataType
    back = read(write(pages, folder, id_col=id_col, **options), folder)
    return back.select(F.col("page_id").cast(kind).alias(id_col), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind).alias("refers_to"))
