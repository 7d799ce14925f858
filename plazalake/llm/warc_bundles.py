"""WARC archives as seekable zstandard bundles: records in groups, a frame each.

Every page becomes a response record, or a revisit of the page with the largest
id among those with the same payload. A frame holds records up to FRAME_BYTES; the
footer's seek table and an index from record id to frame, offset in it and length
let a reader decompress one frame for one record. Bundles are rows of a table in the
shared folder, which Spark writes and reads wherever that is.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, join_hot, slices
from .seekable import BundleReader, BundleWriter

FRAME_BYTES, BUNDLE_BYTES = 256 << 10, 4 << 20
#: Record ids are made of the page id, so that equal input gives equal archives.
RECORD_ID = "<urn:page:%s>"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
DATE = "2024-01-01T00:00:00Z"


def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _clean(value: str | None) -> str:
    """A header value stays on one line."""
    return re.sub(r"[\x00-\x1f\x7f]", " ", value or "").strip()


def record(page_id, url: str | None, payload: bytes, refers_to, is_revisit: bool, date: str) -> bytes:
    """One WARC/1.1 record. A revisit carries the HTTP head only, and digest and length of the full payload."""
    block = HTTP + (b"" if is_revisit else payload)
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if is_revisit else 'response'}",
        f"WARC-Record-ID: {RECORD_ID % page_id}",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {_clean(url)}",
        "Content-Type: application/http; msgtype=response",
        f"WARC-Payload-Digest: sha1:{sha1_base32(payload)}",
        f"X-Payload-Length: {len(payload)}",
    ]
    if is_revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {RECORD_ID % refers_to}"]
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(content: bytes) -> tuple[dict[str, str], bytes]:
    """Headers by lower-case name, and the payload in the block."""
    head, _, rest = content.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    if first != "WARC/1.1":
        raise ValueError(f"not a WARC record: {first[:20]}")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
    block = rest[: int(fields["content-length"])]
    return fields, block.partition(b"\r\n\r\n")[2]


def page_of(record_id: str):
    found = record_id[len(RECORD_ID.partition("%s")[0]) : -1]
    return None if found == "None" else int(found)


def plan_records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_bytes: int = 0) -> DataFrame:
    """id, url, html and refers_to: the page to revisit, null for responses.

    Of equal payloads of at least least_bytes, the largest id is the response. Rows
    meet by digest with their ids alone, those of a very frequent payload in several tasks. A page with a null id is always a response,
    and never one that others revisit. Rows that repeat the largest id are responses.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    # SHA-256 finds equal payloads; the records carry SHA-1, which can be forged
    digest = F.when((F.octet_length("html") >= least_bytes) & F.col("id").isNotNull(), F.unhex(F.sha2("html", 256)))
    rows = rows.withColumn("digest", digest)
    known = cut(rows.select("id", "digest").where("digest is not null"), "digests")
    many = known.groupBy("digest").agg(F.max("id").alias("refers_to"), F.count(F.lit(1)).alias("n")).where("n > 1")
    small = join_hot(known, many.drop("n"), "digest", many)
    small = small.where("id <> refers_to").groupBy("id", "digest").agg(F.max("refers_to").alias("refers_to"))
    return rows.join(small, ["id", "digest"], "left").select("id", "url", "html", "refers_to")


class _Writer:
    """Collects records in frames and gives out bundles."""

    def __init__(self, frame_bytes: int, bundle_bytes: int):
        self.frame_bytes, self.bundle_bytes = frame_bytes, bundle_bytes
        self._begin()

    def _begin(self):
        self.bundle, self.index, self.frame, self.held = BundleWriter(), [], [], 0

    def _flush(self):
        if self.frame:
            self.bundle.add(b"".join(self.frame))
            self.frame, self.held = [], 0

    def add(self, name: str, content: bytes):
        """Returns a bundle if one is full; a record of over frame_bytes has a frame of its own."""
        if self.held and self.held + len(content) > self.frame_bytes:
            self._flush()
        self.index.append([name, len(self.bundle), self.held, len(content)])
        self.frame.append(content)
        self.held += len(content)
        return self.close() if self.bundle.size + self.held // 4 >= self.bundle_bytes else None

    def close(self):
        if not self.index:
            return None
        self._flush()
        row = len(self.index), self.bundle.finish(json.dumps(self.index).encode())
        self._begin()
        return row


def write_archives(records: DataFrame, bundle_bytes: int = BUNDLE_BYTES, date: str = DATE, frame_bytes: int = FRAME_BYTES) -> DataFrame:
    """The table of bundles, (n_records, content), from what plan_records gives.

    Pages that repeat an id give records that repeat it.
    """

    def pack(batches):
        writer = _Writer(frame_bytes, bundle_bytes)
        row = lambda full: pa.RecordBatch.from_arrays([pa.array([full[0]], pa.int64()), pa.array([full[1]], pa.binary())], names=["n_records", "content"])
        for batch in slices(batches, 2):
            for page_id, url, html, refers_to in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if full := writer.add(RECORD_ID % page_id, record(page_id, url, html.encode(), refers_to, refers_to is not None, date)):
                    yield row(full)
        if full := writer.close():
            yield row(full)

    return cut(records.mapInArrow(pack, "n_records long, content binary"), "warc-bundles", "uncompressed")


def find_records(bundle: bytes, record_id: str) -> list[tuple[dict[str, str], bytes]]:
    """The records with an id, one unless pages repeat it; only the frames that hold them are decompressed."""
    reader = BundleReader(bundle)
    return [parse(reader.frame(frame)[offset : offset + size]) for name, frame, offset, size in json.loads(reader.index) if name == record_id]


def record_index(bundles: DataFrame) -> DataFrame:
    """bundle (a hash of its content), record_id, frame, offset and length of every record; payloads stay compressed."""

    def read(batches):
        for batch in batches:
            for key, bundle in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows = json.loads(BundleReader(bundle).index)
                name, frame, offset, size = zip(*rows, strict=True)
                columns = [pa.array([key] * len(rows), pa.int64()), pa.array(name, pa.string()), *[pa.array(c, pa.int64()) for c in (frame, offset, size)]]
                yield pa.RecordBatch.from_arrays(columns, names=["bundle", "record_id", "frame", "offset", "length"])

    rows = bundles.select(F.xxhash64("content").alias("bundle"), "content")
    return rows.mapInArrow(read, "bundle long, record_id string, frame long, offset long, length long")


def read_archives(bundles: DataFrame, id_col: str = "page_id") -> DataFrame:
    """One row per record: id, url, payload_bytes, payload_digest, record_type, refers_to; a response's digest is verified."""
    names = [id_col, "url", "payload_bytes", "payload_digest", "record_type", "refers_to"]

    def unpack(batches):
        for batch in batches:
            for bundle in batch.column(0).to_pylist():
                reader, rows, number, content = BundleReader(bundle), [], -1, b""
                for _, frame, offset, size in json.loads(reader.index):
                    if frame != number:
                        number, content = frame, reader.frame(frame)
                    head, payload = parse(content[offset : offset + size])
                    digest = head["warc-payload-digest"].removeprefix("sha1:")
                    if head["warc-type"] == "response" and sha1_base32(payload) != digest:
                        raise ValueError(f"{head['warc-record-id']}: the payload isn't what its digest says")
                    refers = head.get("warc-refers-to")
                    rows.append((page_of(head["warc-record-id"]), head["warc-target-uri"], int(head["x-payload-length"]), digest, head["warc-type"], refers and page_of(refers)))
                types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    return bundles.select("content").mapInArrow(unpack, f"{id_col} long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long")
