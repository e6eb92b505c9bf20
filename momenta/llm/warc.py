"""WARC archives: written with a gzip member for each record, and read back record by record.

The reader is sequential: it inflates a file piece by piece, frames each record by its Content-Length, starts anew at
the end of each gzip member, and checks the digests of block and payload. Neither side holds more than a record.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from momenta.llm.common import saved, scratch

#: Payloads from so many bytes on are written once; equal ones refer to it.
MIN_REVISIT = 100
#: Bytes of an archive beyond which a task starts the next, and bytes read at a time.
ROLL = 128 << 20
PIECE = 1 << 18
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_DATE = "1970-01-01T00:00:00Z"
_READ = "page_id long, url string, record_type string, payload binary, payload_bytes long, payload_digest string, refers_to long, intact boolean"


def _uri(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def _page(uri: str | None) -> int | None:
    text = (uri or "").removeprefix("<urn:page:").removesuffix(">")
    return int(text) if text else None


def _clean(url: str | None) -> str:
    return "" if url is None else "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in url)


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One record, uncompressed. A revisit has no block; its payload's length is in a header of our own."""
    block = b"" if refers_to is not None else payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {_uri(page_id)}",
        f"WARC-Date: {_DATE}",
        f"WARC-Target-URI: {_clean(url)}",
        f"WARC-Payload-Digest: sha256:{digest}",
        f"WARC-Block-Digest: sha1:{base64.b32encode(hashlib.sha1(block).digest()).decode()}",
        f"X-Payload-Length: {len(payload)}",
    ]
    if refers_to is not None:
        head += [f"WARC-Refers-To: {_uri(refers_to)}", f"WARC-Profile: {_PROFILE}"]
    head += ["Content-Type: application/octet-stream", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(head).encode() + block + b"\r\n\r\n"


class Archive:
    """Appends records to a file, each as a gzip member."""

    def __init__(self, folder: str):
        fs, root = pafs.FileSystem.from_uri(folder)
        fs.create_dir(root, recursive=True)
        name = f"{uuid.uuid4().hex}.warc.gz"
        self.uri, self.size, self.records = f"{folder}/{name}", 0, 0
        self.stream = fs.open_output_stream(f"{root}/{name}", compression=None)

    def add(self, data: bytes) -> None:
        z = zlib.compressobj(wbits=31)
        member = z.compress(data) + z.flush()
        self.stream.write(member)
        self.size += len(member)
        self.records += 1

    def close(self) -> None:
        self.stream.close()


def members(pieces: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of every record of a file that comes in pieces; one gzip member holds one record."""
    z, data, rest = zlib.decompressobj(wbits=31), bytearray(), b""
    head: dict[str, str] | None = None
    need = 0

    def frame() -> tuple[dict[str, str] | None, int]:
        """The headers and the record's length as soon as the headers are whole."""
        end = data.find(b"\r\n\r\n")
        if end < 0:
            return None, 0
        version, *lines = data[:end].decode().split("\r\n")
        if not version.startswith("WARC/"):
            raise ValueError(f"no WARC record: {version[:20]!r}")
        fields = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}
        return fields, end + 4 + int(fields["content-length"])

    for piece in pieces:
        rest += piece
        while rest:
            data += z.decompress(rest)
            rest = z.unused_data
            if head is None:
                head, need = frame()
            if not z.eof:
                rest = b""
                break
            if head is None or len(data) != need + 4 or data[need:] != b"\r\n\r\n":
                raise ValueError("a record's length is not its Content-Length")
            yield head, bytes(data[need - int(head["content-length"]) : need])
            z, data, head = zlib.decompressobj(wbits=31), bytearray(), None
    if data or head:
        raise ValueError("the file ends within a record")


def _pieces(uri: str) -> Iterator[bytes]:
    fs, path = pafs.FileSystem.from_uri(uri)
    with fs.open_input_stream(path, compression=None) as f:
        while piece := f.read(PIECE):
            yield piece


def write(pages: DataFrame, folder: str, min_revisit: int = MIN_REVISIT) -> DataFrame:
    """Writes a record for every row of pages (page_id, url, html) and returns the archives: (uri, records, bytes).

    The payload is html in UTF-8 (null: empty). Of equal payloads of at least min_revisit bytes the row with the
    smallest page_id is a response and the others revisit it; all others are responses. Rows that repeat a page_id and
    payload are all responses if it is the smallest. Rows without page_id are responses and are not referred to. Only
    archives in the returned table, which is written when a task has ended well, count. An empty table gives none.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload"))
    sums = saved(rows.select("page_id", F.sha2("payload", 256).alias("digest"), F.octet_length("payload").alias("n")), "digests")
    # copies meet as sums, never as payloads
    large = sums.where((F.col("n") >= min_revisit) & F.col("page_id").isNotNull())
    first = large.groupBy("digest", "n").agg(F.min("page_id").alias("refers_to"), F.max("page_id").alias("last")).where("refers_to != last").drop("last", "n")
    revisits = large.join(first, "digest").where("page_id != refers_to").select(F.col("page_id").alias("revisit_id"), F.col("digest").alias("revisit_digest"), "refers_to").distinct()
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    rows = rows.join(revisits, (rows["page_id"] == revisits["revisit_id"]) & (rows["digest"] == revisits["revisit_digest"]), "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[Archive] = []
        for batch in batches:
            for row in zip(*(batch[c].to_pylist() for c in ("page_id", "url", "payload", "digest", "refers_to")), strict=True):
                if not done or done[-1].size > ROLL:
                    if done:
                        done[-1].close()
                    done.append(Archive(folder))
                done[-1].add(record(*row))
        if done:
            done[-1].close()
            yield pa.record_batch([pa.array([a.uri for a in done]), pa.array([a.records for a in done], pa.int64()), pa.array([a.size for a in done], pa.int64())], ["uri", "records", "bytes"])

    rows = rows.select("page_id", "url", "payload", "digest", "refers_to")
    return saved(rows.mapInArrow(run, "uri string, records long, bytes long"), "archives")


def read(archives: DataFrame, payloads: bool = True) -> DataFrame:
    """The records of the files in the column uri: page_id, url, record_type, payload, payload_bytes, payload_digest, refers_to, intact.

    A response's length and digest are those of the payload as read; a revisit has no payload and gives those that its
    headers state. intact is false where a digest in the headers isn't the data's. payloads=False leaves payload null.
    Each archive is a task of its own: their number is fixed from the table, so that adaptive execution, which sees only
    short file names, doesn't put them together.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64()), ("intact", pa.bool_())])
        for batch in batches:
            for uri in batch["uri"].to_pylist():
                out, size = [], 0
                for head, block in members(_pieces(uri)):
                    stated, kind = head["warc-payload-digest"].removeprefix("sha256:"), head["warc-type"]
                    whole = kind != "response" or hashlib.sha256(block).hexdigest() == stated
                    whole &= head["warc-block-digest"] == f"sha1:{base64.b32encode(hashlib.sha1(block).digest()).decode()}"
                    n = len(block) if kind == "response" else int(head["x-payload-length"])
                    digest = hashlib.sha256(block).hexdigest() if kind == "response" else stated
                    out.append((_page(head["warc-record-id"]), head["warc-target-uri"], kind, block if payloads and kind == "response" else None, n, digest, _page(head.get("warc-refers-to")), whole))
                    size += len(block) if payloads else 200
                    if size > PIECE * 16:
                        yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)
                        out, size = [], 0
                if out:
                    yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    return archives.select("uri").repartitionByRange(max(1, archives.count()), "uri").mapInArrow(run, _READ)


def round_trip(pages: DataFrame, min_revisit: int = MIN_REVISIT) -> DataFrame:
    """write() to the cluster's shared folder, then read() without payloads."""
    return read(write(pages, scratch(pages.sparkSession, "warc"), min_revisit), payloads=False)
