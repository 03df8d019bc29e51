"""WARC archives: a writer, and a sequential reader.

The reader goes through an archive once, in bounded memory: each record is a gzip member of
its own, inflated step by step; the record's header is parsed, its Content-Length frames the
block, and the block and payload digests are verified as the bytes go by.

Archives are written by tasks to the shared folder, several per partition if it is large, and
read by tasks that get one archive each. What counts is the manifest of the attempts that
succeeded, so a lost and repeated task leaves no record twice.
"""

import base64
import hashlib
import re
import uuid
import zlib

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_bytes, shared_folder, stored

#: An archive is closed once it has so many compressed bytes.
ARCHIVE_BYTES = 256 << 20
#: Payloads of at least so many bytes are stored once.
LEAST_SHARED = 1000
_READ = 1 << 16
_DATE = "2020-01-01T00:00:00Z"
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _store(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if re.match(r"\w+:/", path) else (fs.LocalFileSystem(), path)


def _digest(sha1: bytes) -> str:
    return "sha1:" + base64.b32encode(sha1).decode()


def record_name(page_id: int | None) -> str:
    """The record's URN, by which revisits refer to it."""
    return f"<urn:page:{page_id}>"


def record_bytes(kind: str, name: str, target: str, payload: bytes, payload_sha1: bytes, refers_to: str | None) -> bytes:
    """One record as a gzip member; a revisit has the HTTP header alone as its block."""
    block = _HTTP + payload if kind == "response" else _HTTP
    header = {
        "WARC-Type": kind,
        "WARC-Record-ID": name,
        "WARC-Date": _DATE,
        "WARC-Target-URI": re.sub(r"[\r\n]+", " ", target),
        "Content-Type": "application/http; msgtype=response",
        "WARC-Block-Digest": _digest(hashlib.sha1(block).digest()),
        "WARC-Payload-Digest": _digest(payload_sha1),
    }
    if refers_to is not None:
        header |= {"WARC-Profile": _PROFILE, "WARC-Refers-To": refers_to}
    header["Content-Length"] = str(len(block))
    lines = "".join(f"{k}: {v}\r\n" for k, v in header.items())
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    parts = [packer.compress(p) for p in (f"WARC/1.1\r\n{lines}\r\n".encode(), block, b"\r\n\r\n")]
    return b"".join(parts) + packer.flush()


class _Members:
    """The inflated bytes of a stream of gzip members, one member at a time."""

    def __init__(self, stream):
        self.stream, self.held, self.inflater = stream, b"", None

    def open(self) -> bool:
        """Go to the next member; False at the end of the stream."""
        self.held = self.held or self.stream.read(_READ)
        self.inflater = zlib.decompressobj(31) if self.held else None
        return bool(self.held)

    def read(self) -> bytes:
        """Some more bytes of the member; empty at its end."""
        while not self.inflater.eof:
            self.held = self.held or self.stream.read(_READ)
            if not self.held:
                raise ValueError("the archive ends inside a record")
            out = self.inflater.decompress(self.held, _READ)
            self.held = self.inflater.unused_data if self.inflater.eof else self.inflater.unconsumed_tail
            if out:
                return out
        return b""


def read_records(stream):
    """(header, payload) of each record of an open archive; header names are in lower case.

    Raises ValueError where framing or a digest is wrong.
    """
    members = _Members(stream)
    while members.open():
        head = b""
        while b"\r\n\r\n" not in head:
            more = members.read()
            if not more:
                raise ValueError("a record without a header")
            head += more
        head, _, rest = head.partition(b"\r\n\r\n")
        version, *lines = head.decode().split("\r\n")
        header = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        length = int(header["content-length"])
        block, http, payload, seen = hashlib.sha1(), b"", None, 0
        whole = bytearray()
        while True:
            part = rest[: length - seen]
            tail = rest[len(part):]
            seen += len(part)
            block.update(part)
            if payload is None:
                http += part
                if b"\r\n\r\n" in http:
                    part = http.partition(b"\r\n\r\n")[2]
                    payload = hashlib.sha1()
            if payload is not None:
                payload.update(part)
                whole += part
            if seen == length:
                break
            rest = members.read()
            if not rest:
                raise ValueError("a record shorter than its Content-Length")
        while more := members.read():
            tail += more
        if not version.startswith("WARC/") or tail != b"\r\n\r\n":
            raise ValueError("a record longer than its Content-Length")
        if _digest(block.digest()) != header["warc-block-digest"]:
            raise ValueError(f"block digest of {header['warc-record-id']}")
        if header["warc-type"] == "response" and _digest(payload.digest()) != header["warc-payload-digest"]:
            raise ValueError(f"payload digest of {header['warc-record-id']}")
        yield header, bytes(whole)


def plan_records(pages: DataFrame, least: int = LEAST_SHARED) -> DataFrame:
    """page_id, url, html (binary, empty for null), digest (hex SHA-1), refers_to.

    refers_to is the largest page_id with an equal payload if the payload has `least` bytes or
    more and that page is another one, else null.
    """
    html = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.coalesce(F.col("url").cast("string"), F.lit("")).cast("binary").alias("url"),
        html.alias("html"),
        F.sha1(html).alias("digest"),
    )
    heads = (
        rows.filter(F.length("html") >= least)
        .groupBy("digest")
        .agg(F.max("page_id").alias("head"), F.count(F.lit(1)).alias("n"))
        .filter("n > 1")
        .drop("n")
    )
    joined = rows.join(heads, "digest", "left")
    return joined.select(
        "page_id", "url", "html", "digest",
        F.when(~F.col("head").eqNullSafe(F.col("page_id")), F.col("head")).alias("refers_to"),
    )


def write_archives(records: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write the planned records; the manifest, path and records of every archive.

    Each attempt of a task writes files of its own; the manifest, itself stored in the shared
    folder, names those of the attempts that counted.
    """
    schema = pa.schema([("path", pa.string()), ("records", pa.int64())])

    def run(batches):
        store, root = _store(folder)
        store.create_dir(root, recursive=True)
        part, attempt = TaskContext.get().partitionId(), uuid.uuid4().hex
        out, size, names, counts = None, 0, [], []
        for batch in by_bytes(batches, "html"):
            for page_id, url, html, sha1, refers_to in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if out is None:
                    names.append(f"{folder}/part-{part:06d}-{len(names):06d}-{attempt}.warc.gz")
                    counts.append(0)
                    out, size = store.open_output_stream(f"{root}/{names[-1].rpartition('/')[2]}"), 0
                kind = "response" if refers_to is None else "revisit"
                other = None if refers_to is None else record_name(refers_to)
                member = record_bytes(kind, record_name(page_id), url.decode(), html, bytes.fromhex(sha1), other)
                out.write(member)
                counts[-1] += 1
                size += len(member)
                if size >= archive_bytes:
                    out.close()
                    out = None
        if out is not None:
            out.close()
        if names:
            yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(counts, pa.int64())], schema=schema)

    ordered = records.select("page_id", "url", "html", "digest", "refers_to")
    return stored(ordered.mapInArrow(run, "path string, records long"), "warc-manifest")


def read_archives(archives: DataFrame, payloads: bool = True) -> DataFrame:
    """page_id, url, record_type, payload_digest (hex), payload_bytes, payload, refers_to.

    `archives` has a column path; each archive is read once and in order by one task.
    payload_bytes and payload are null for revisits, payload also without `payloads`.
    """
    schema = pa.schema(
        [
            ("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload_digest", pa.string()),
            ("payload_bytes", pa.int64()), ("payload", pa.binary()), ("refers_to", pa.int64()),
        ]
    )

    def page(name):
        return None if name is None or name == record_name(None) else int(name[len("<urn:page:") : -1])

    def rows(path):
        store, place = _store(path)
        with store.open_input_stream(place) as stream:
            for header, payload in read_records(stream):
                response = header["warc-type"] == "response"
                digest = base64.b32decode(header["warc-payload-digest"].partition(":")[2]).hex()
                yield (
                    page(header["warc-record-id"]), header["warc-target-uri"], header["warc-type"], digest,
                    len(payload) if response else None, payload if response and payloads else None,
                    page(header.get("warc-refers-to")),
                )

    def run(batches):
        held, size = [], 0
        for batch in batches:
            for path in batch.column("path").to_pylist():
                for row in rows(path):
                    held.append(row)
                    size += len(row[5] or b"")
                    if size > 8 << 20 or len(held) == 5000:
                        yield _batch(held, schema)
                        held, size = [], 0
        if held:
            yield _batch(held, schema)

    return archives.select("path").repartition(max(1, archives.count())).mapInArrow(
        run,
        "page_id long, url string, record_type string, payload_digest string, payload_bytes long, payload binary, "
        "refers_to long",
    )


def _batch(held, schema):
    return pa.RecordBatch.from_arrays(
        [pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema
    )


def round_trip(pages: DataFrame, folder: str | None = None, least: int = LEAST_SHARED) -> DataFrame:
    """Write one record per page and read the archives back.

    page_id, payload_bytes, payload_digest, record_type, refers_to. A revisit's size comes
    from the response it refers to. A null html is an empty payload, a null url an empty
    target; line breaks in a url become a space. Equal pages with a null page_id are the
    response only if no id is known; repeated page_ids give a record each. Other columns are
    ignored; an empty table gives no records.
    """
    folder = folder or shared_folder(pages.sparkSession, "warc")
    archives = write_archives(plan_records(pages, least), folder)
    read = read_archives(archives, payloads=False).drop("payload", "url")
    sizes = read.filter("refers_to IS NULL").groupBy("payload_digest").agg(F.max("payload_bytes").alias("shared"))
    return read.join(sizes, "payload_digest", "left").select(
        "page_id",
        F.coalesce("payload_bytes", "shared").alias("payload_bytes"),
        "payload_digest",
        "record_type",
        "refers_to",
    )


ORACLE = """
SELECT page_id, strlen(h) AS payload_bytes, sha1(h) AS payload_digest,
  CASE WHEN strlen(h) >= 1000 AND head <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN strlen(h) >= 1000 AND head <> page_id THEN head END AS refers_to
FROM (SELECT page_id, coalesce(html, '') AS h, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS head FROM pages)
"""
