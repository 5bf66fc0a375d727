"""WARC archives: writer, and a sequential reader.

Each record is one gzip member.  The reader inflates a member piece by piece,
reads the header, then as many bytes as Content-Length says, and digests them
as they come; the member must end behind them.  So no record is held whole
unless its payload is asked for.

Archives are files of Spark's own text writer, so commits, retries and remote
stores are handled by Spark: a row is a run of gzip members without its last
byte, and that byte (always zero: the high byte of the last member's length
field) is the writer's line separator.

A record's id is made of the page id, percent-encoded, and the payload digest;
only rows that repeat both share a record id.  Payloads are stored once.  Of equal payloads of ``min_bytes`` or more, the
record with the smallest page id is a ``response`` and the others are
``revisit`` records.  A null payload is empty.  Rows that repeat the smallest
id are responses too; where all equal payloads have a null id, all are
responses.  Other columns are ignored; an empty table gives empty archives.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import keep_to_end, materialize, shared_path

PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2020-01-01T00:00:00Z"
#: Compressed bytes of a row of archive, and rows of a file.
CHUNK_BYTES = 4 << 20
CHUNKS_PER_FILE = 2
LEVEL = 4
#: Bytes that are inflated at once, and that a header may have.
PIECE = 1 << 16
HEADER = 1 << 20
PAGE_KINDS = ("response", "revisit")


class WarcError(ValueError):
    """A record that is not framed, or not digested, as its headers say."""


def sha1(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def member(data: bytes, level: int = LEVEL) -> bytes:
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def record(kind: str, name: str, uri: str | None, payload: bytes, digest: str | None = None, refers_to: str | None = None) -> bytes:
    """A record's bytes before compression."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if kind == "revisit" else http + payload
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{name}>", f"WARC-Date: {DATE}"]
    if uri is not None:
        lines.append("WARC-Target-URI: " + uri.replace("\r", "%0D").replace("\n", "%0A"))
    if kind == "revisit":
        lines += [f"WARC-Refers-To: <{refers_to}>", f"WARC-Profile: {PROFILE}"]
    lines += [f"WARC-Payload-Digest: {digest or sha1(payload)}", f"WARC-Block-Digest: {sha1(block)}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return ("\r\n".join(lines) + "\r\n\r\n").encode("utf-8", "surrogatepass") + block + b"\r\n\r\n"


def small(kind: str, name: str, block: bytes) -> bytes:
    """The member of a record of the archive's own."""
    head = f"WARC/1.1\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <{name}>\r\nWARC-Date: {DATE}\r\nWARC-Block-Digest: {sha1(block)}\r\nContent-Type: application/warc-fields\r\nContent-Length: {len(block)}\r\n\r\n"
    return member(head.encode() + block + b"\r\n\r\n")


def opening(first: str) -> bytes:
    """What a run of records begins with; ``first`` is the name of its first record."""
    return small("warcinfo", f"{first}:info", b"software: orthoquad\r\nformat: WARC File Format 1.1\r\n")


def closing(last: str) -> bytes:
    """A small record whose member surely ends with a zero byte."""
    return small("metadata", f"{last}:end", b"end: chunk\r\n")


@dataclass
class Record:
    headers: dict[str, str]
    http: dict[str, str]  # of a response or a revisit
    payload: bytes | None  # where it was asked for

    @property
    def kind(self) -> str:
        return self.headers.get("warc-type", "")


def _fields(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "surrogatepass").split("\r\n")[1:]
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines if x)}


class Inflated:
    """The bytes of one gzip member of a source, as they are asked for."""

    def __init__(self, source: Iterator[bytes], left: bytes):
        self.source, self.zip, self.raw, self.ready = source, zlib.decompressobj(31), left, b""

    def more(self) -> bool:
        """Inflate a bounded piece more; False at the member's end."""
        while not self.zip.eof:
            if not self.raw:
                self.raw = next(self.source, b"")
                if not self.raw:
                    raise WarcError("the archive ends inside a member")
            piece = self.zip.decompress(self.raw, PIECE)
            self.raw = self.zip.unused_data if self.zip.eof else self.zip.unconsumed_tail
            if piece:
                self.ready += piece
                return True
        return False

    def until(self, mark: bytes) -> bytes:
        """The bytes before ``mark``, which is dropped; headers are small."""
        while (at := self.ready.find(mark)) < 0:
            if len(self.ready) > HEADER or not self.more():
                raise WarcError("no end of the header")
        found, self.ready = self.ready[:at], self.ready[at + len(mark) :]
        return found

    def take(self, size: int) -> Iterator[bytes]:
        """The next ``size`` bytes, in pieces."""
        while size:
            if not self.ready and not self.more():
                raise WarcError("the block is shorter than its Content-Length")
            piece, self.ready = self.ready[:size], self.ready[size:]
            size -= len(piece)
            yield piece


def parse(member: Inflated, payload: bool = True) -> Record:
    """A record, framed and verified."""
    head = member.until(b"\r\n\r\n")
    if not head.startswith(b"WARC/"):
        raise WarcError("no WARC header")
    headers = _fields(head)
    size = headers.get("content-length", "")
    if not (size.isascii() and size.isdigit()):
        raise WarcError("no Content-Length")
    kind = headers.get("warc-type", "")
    whole, body, held, http, early = hashlib.sha1(), hashlib.sha1(), [], None, b""
    for piece in member.take(int(size)):
        whole.update(piece)
        if kind not in PAGE_KINDS:
            continue
        if http is None:
            early += piece
            at = early.find(b"\r\n\r\n")
            if at < 0:
                if len(early) > HEADER:
                    raise WarcError("the block has no HTTP header")
                continue
            http, piece, early = _fields(early[:at]), early[at + 4 :], b""
        body.update(piece)
        if payload and kind == "response":
            held.append(piece)
    if kind in PAGE_KINDS and http is None:
        raise WarcError("the block has no HTTP header")
    if b"".join(member.take(4)) != b"\r\n\r\n" or member.ready or member.more():
        raise WarcError("the record goes on behind its Content-Length")
    named = lambda x: "sha1:" + base64.b32encode(x.digest()).decode()
    if (want := headers.get("warc-block-digest")) and want != named(whole):
        raise WarcError("block digest")
    if kind == "response" and (want := headers.get("warc-payload-digest")) and want != named(body):
        raise WarcError("payload digest")
    return Record(headers, http or {}, b"".join(held) if payload and kind == "response" else None)


def read_records(source: Iterable[bytes], payload: bool = True) -> Iterator[Record]:
    """Records of an archive, in order; raises ``WarcError`` at the first bad one."""
    rest = iter(source)
    left = next(rest, b"")
    while left:
        member = Inflated(rest, left)
        yield parse(member, payload)
        left = member.raw or next(rest, b"")


def pieces(data: bytes, size: int = 1 << 16) -> Iterator[bytes]:
    view = memoryview(data)
    return (bytes(view[a : a + size]) for a in range(0, len(view), size))


def _name(page_id, digest: str) -> str:
    """A record's id; that of a null page id can't be that of any text."""
    own = "" if page_id is None else "=" + quote(str(page_id), safe="", errors="surrogatepass")
    return f"urn:x-page:{own}:{digest}"


def _page(name: str | None) -> str | None:
    """The page id in a record's id."""
    own = (name or "").strip("<>").removeprefix("urn:x-page:").partition(":")[0]
    return unquote(own[1:], errors="surrogatepass") if own.startswith("=") else None


def mark_revisits(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_bytes: int = 0) -> DataFrame:
    """_id, _url, _payload and _first: the id of the response that a row revisits, else null.

    Only digests that occur twice are kept aside and joined, so payloads move
    only if that table is too large for Spark to broadcast; a hot digest is then
    left to the skew join.
    """
    payload = F.coalesce(F.col(payload_col).cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).alias("_id"), F.col(url_col).cast("string").alias("_url"), payload.alias("_payload")).withColumn("_key", F.when(F.octet_length("_payload") >= min_bytes, F.sha1("_payload")))
    firsts = rows.where(F.col("_key").isNotNull()).groupBy("_key").agg(F.min("_id").alias("_first"), F.count("*").alias("_n")).where((F.col("_n") > 1) & F.col("_first").isNotNull()).select("_key", "_first")
    joined = rows.join(materialize(firsts, "warc-firsts"), "_key", "left")
    return joined.select("_id", "_url", "_payload", F.when(~F.col("_first").eqNullSafe(F.col("_id")), F.col("_first")).alias("_first"))


def write(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_bytes: int = 0) -> None:
    """Write archives of ``pages`` under the folder ``path``."""
    marked = mark_revisits(pages, id_col, url_col, payload_col, min_bytes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[bytes] = []
        size = 0

        def out(name: str) -> pa.RecordBatch:
            if parts[-1][-1]:
                parts.append(closing(name))
            return pa.RecordBatch.from_arrays([pa.array([b"".join(parts)[:-1]], pa.binary())], names=["value"])

        name = ""
        for batch in batches:
            for at in range(batch.num_rows):
                page, url, payload, first = (batch.column(c)[at].as_py() for c in range(4))
                digest = sha1(payload)
                name = _name(page, digest)
                if not parts:
                    parts.append(opening(name))
                parts.append(member(record("response" if first is None else "revisit", name, url, payload, digest, None if first is None else _name(first, digest))))
                size += len(parts[-1])
                if size >= CHUNK_BYTES:
                    yield out(name)
                    parts, size = [], 0
        if parts:
            yield out(name)

    chunks = marked.mapInArrow(run, "value binary").select(F.col("value").cast("string"))
    chunks.write.option("lineSep", "\0").option("compression", "none").option("maxRecordsPerFile", CHUNKS_PER_FILE).text(path)


def read(spark: SparkSession, path: str, id_type: str = "bigint", payload: bool = False) -> DataFrame:
    """One row per page record of the archives under ``path``.

    page_id, payload_bytes, payload_digest (bare), record_type, refers_to; with
    ``payload`` also the stored payload, null for revisits.
    """
    schema = "page_id string, payload_bytes bigint, payload_digest string, record_type string, refers_to string" + ", payload binary" * payload
    names = [x.split()[0] for x in schema.split(", ")]
    kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.binary()]

    def rows(batch: pa.RecordBatch) -> Iterator[tuple]:
        for at in range(batch.num_rows):
            for x in read_records(pieces(batch.column(0)[at].as_py()), payload):
                if x.kind in PAGE_KINDS:
                    yield _page(x.headers["warc-record-id"]), int(x.http["content-length"]), x.headers["warc-payload-digest"].removeprefix("sha1:"), x.kind, _page(x.headers.get("warc-refers-to")), x.payload

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            block: list[tuple] = []
            size = 0
            for row in rows(batch):
                block.append(row)
                size += len(row[5] or b"") if payload else 0
                if len(block) >= 4096 or size > CHUNK_BYTES:
                    yield batch_of(block)
                    block, size = [], 0
            if block:
                yield batch_of(block)

    def batch_of(block: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in list(zip(zip(*block, strict=True), kinds, strict=False))[: len(names)]], names=names)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    found = files.mapInArrow(run, schema)
    return found.withColumns({c: F.col(c).cast(id_type) for c in ("page_id", "refers_to")})


def archive(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_bytes: int = 0) -> DataFrame:
    """Write archives in the shared folder and read them back."""
    spark = pages.sparkSession
    path = keep_to_end(spark, shared_path(spark, "warc"))
    write(pages, path, id_col, url_col, payload_col, min_bytes)
    return read(spark, path, pages.schema[id_col].dataType.simpleString())
