"""WARC records in seekable Zstandard bundles.

Records go, several together, into independent Zstandard frames; a bundle is some frames and a footer, which is
the seek table of the seekable format (a skippable frame with each frame's compressed and plain size and the low
half of its XXH64). An index maps record identifiers to (frame, offset in the frame's plain bytes, length), so one
record costs the footer and one frame. Bundles and their index entries are rows of one table that Spark writes
into the shared folder: a retried task replaces both together, and no store but Spark's own is needed.
export_bundles writes bundles as .warc.zst files.

Of records with equal payloads (of min_bytes at least) the one with the smallest page_id is a response, the others
are revisits that refer to it. Equal payloads are found by SHA-256 and length; a payload that a third of all pages
share meets its group by a broadcast of hot groups, of which there are under 1000.

Nulls: a null html has an empty payload, a null url leaves the target URI out, a null page_id sorts last (it is a
response only where no other page has the payload). Rows with the same page_id and payload as the response are
responses too; only such copies share a record identifier, which is made of page_id and payload. Repeated rows are
records of their own. An empty table gives no bundles and no rows. Payloads are never cut. Only page_id, url and html
are read, so other columns may be called anything.
"""

from __future__ import annotations

import base64
import hashlib
import struct

import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import cut, heavy_join, table

FRAME_BYTES, FRAME_RECORDS, BUNDLE_BYTES = 1 << 18, 64, 1 << 22
DATE = "2024-01-01T00:00:00Z"
_SKIPPABLE, _SEEKABLE = 0x184D2A5E, 0x8F92EAB1
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


class BundleWriter:
    """Collects records into frames; finish() gives the bundle's bytes and its index."""

    def __init__(self, level: int = 3):
        self.zip = zstandard.ZstdCompressor(level=level, write_content_size=True)
        self.frames: list[bytes] = []
        self.seek: list[tuple[int, int, int]] = []
        self.index: list[tuple] = []
        self.open: list[bytes] = []
        self.plain = self.total = 0

    def add(self, identifier: int | None, record: bytes) -> None:
        if self.open and (self.plain + len(record) > FRAME_BYTES or len(self.open) >= FRAME_RECORDS):
            self._close()
        self.index.append((identifier, len(self.frames), self.plain, len(record)))
        self.open.append(record)
        self.plain += len(record)
        self.total += len(record)

    def _close(self) -> None:
        plain = b"".join(self.open)
        self.frames.append(self.zip.compress(plain))
        self.seek.append((len(self.frames[-1]), len(plain), xxhash.xxh64_intdigest(plain) & 0xFFFFFFFF))
        self.open, self.plain = [], 0

    def finish(self) -> bytes:
        if self.open:
            self._close()
        body = b"".join(struct.pack("<III", *x) for x in self.seek) + struct.pack("<IBI", len(self.seek), 0x80, _SEEKABLE)
        return b"".join([*self.frames, struct.pack("<II", _SKIPPABLE, len(body)), body])


class BundleReader:
    """Random access to a bundle's frames through its footer."""

    def __init__(self, content: bytes):
        count, flags, magic = struct.unpack("<IBI", content[-9:])
        if magic != _SEEKABLE:
            raise ValueError("no seek table")
        width = 12 if flags & 0x80 else 8
        at = len(content) - 9 - count * width
        if struct.unpack("<II", content[at - 8 : at]) != (_SKIPPABLE, count * width + 9):
            raise ValueError("broken seek table")
        self.content, self.places, start = content, [], 0
        for k in range(count):
            packed, plain, *check = struct.unpack_from("<III" if width == 12 else "<II", content, at + k * width)
            self.places.append((start, packed, plain, check[0] if check else None))
            start += packed
        self.held: tuple[int, bytes] = (-1, b"")
        self.zip = zstandard.ZstdDecompressor()

    def frame(self, number: int) -> bytes:
        if self.held[0] != number:
            start, packed, size, check = self.places[number]
            plain = self.zip.decompress(self.content[start : start + packed], max_output_size=size)
            if check is not None and xxhash.xxh64_intdigest(plain) & 0xFFFFFFFF != check:
                raise ValueError(f"frame {number} is damaged")
            self.held = number, plain
        return self.held[1]

    def record(self, frame: int, offset: int, length: int) -> bytes:
        return self.frame(frame)[offset : offset + length]


def _clean(value: str) -> str:
    return value.replace("\r", "%0D").replace("\n", "%0A")


def record_id(page_id: int | None, digest: str) -> str:
    """Names a record by its page and payload, so pages with one id and other payloads have other names."""
    return f"<urn:page:{'none' if page_id is None else page_id}:{digest}>"


def warc_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """A response with the payload in an HTTP message, or a revisit with the message's head only."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    digest = payload_digest(payload)
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {record_id(page_id, digest)}", f"WARC-Date: {DATE}"]
    head += [f"WARC-Target-URI: {_clean(url)}"] if url is not None else []
    head += [f"WARC-Payload-Digest: sha1:{digest}"]
    head += [f"WARC-Refers-To: {record_id(refers_to, digest)}", f"WARC-Profile: {_PROFILE}"] if refers_to is not None else []
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(record: bytes) -> dict:
    """page_id, url, record_type, refers_to, payload_bytes, payload_digest and payload (None for revisits)."""
    head, _, rest = record.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("no WARC record")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    number = lambda s: None if (s := s.removeprefix("<urn:page:").split(":")[0]) == "none" else int(s)
    size = int(next(x for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")).split(b":")[1])
    kind, digest = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if kind == "response" and (len(payload) != size or payload_digest(payload) != digest):
        raise ValueError("payload differs from its digest")
    return {
        "page_id": number(fields["WARC-Record-ID"]), "url": fields.get("WARC-Target-URI"), "record_type": kind, "payload_bytes": size, "payload_digest": digest,
        "refers_to": number(fields["WARC-Refers-To"]) if kind == "revisit" else None, "payload": payload if kind == "response" else None,
    }


_BUNDLE = "bundle string, content binary, entries array<struct<page_id: bigint, frame: int, place: bigint, size: bigint>>"
_ENTRY = pa.list_(pa.struct([("page_id", pa.int64()), ("frame", pa.int32()), ("place", pa.int64()), ("size", pa.int64())]))


def write_bundles(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """The bundles of all pages (page_id, url, html): bundle, content, entries; one row each, in the shared folder."""
    pages = pages.select("page_id", "url", "html").withColumn("_key", F.sha2(F.coalesce("html", F.lit("")), 256))
    size = F.coalesce(F.octet_length("html"), F.lit(0))
    keyed = pages.where(size >= min_bytes).select("page_id", "_key")
    groups = keyed.groupBy("_key").agg(F.min("page_id").alias("refers_to"), F.count(F.lit(1)).alias("n")).where("n > 1 AND refers_to IS NOT NULL")
    revisits = heavy_join(keyed, groups, "_key", "n", "inner").where("page_id IS NULL OR page_id <> refers_to").select(F.col("_key").alias("_k"), F.col("page_id").alias("_p"), "refers_to").distinct()
    rows = pages.join(revisits, (pages["_key"] == F.col("_k")) & pages["page_id"].eqNullSafe(F.col("_p")), "left").select("page_id", "url", "html", "refers_to")

    def packed(batches):
        from pyspark import TaskContext

        task, count, writer = TaskContext.get().partitionId(), 0, BundleWriter()

        def done():
            content = writer.finish()
            entries = [dict(zip(("page_id", "frame", "place", "size"), x, strict=True)) for x in writer.index]
            return pa.RecordBatch.from_arrays([pa.array([f"{task:06d}-{count:06d}"]), pa.array([content], pa.binary()), pa.array([entries], _ENTRY)], names=["bundle", "content", "entries"])

        for batch in batches:
            for page_id, url, html, refers_to in zip(*batch.columns, strict=True):
                writer.add(page_id.as_py(), warc_record(page_id.as_py(), url.as_py(), (html.as_py() or "").encode(), refers_to.as_py()))
                if writer.total >= BUNDLE_BYTES:
                    yield done()
                    count, writer = count + 1, BundleWriter()
        if writer.index:
            yield done()

    return cut(rows.mapInArrow(packed, _BUNDLE), "warc")


def read_bundles(bundles: DataFrame, payloads: bool = False) -> DataFrame:
    """Each record of the bundles, found by its index entry: page_id, url, record_type, refers_to,
    payload_bytes, payload_digest (of the full payload) and on demand the payload."""
    fields = [("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())] + [("payload", pa.binary())] * payloads

    def records(batches):
        for batch in batches:
            for content, entries in zip(batch.column(0), batch.column(1), strict=True):
                reader = BundleReader(content.as_py())
                rows = [parse_record(reader.record(e["frame"], e["place"], e["size"])) for e in entries.as_py()]
                yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], t) for n, t in fields], names=[n for n, _ in fields])

    return bundles.select("content", "entries").mapInArrow(records, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", payload binary" * payloads)


def look_up(bundles: DataFrame, page_ids: DataFrame) -> DataFrame:
    """The records of some page_ids: the index alone is joined, then only the bundles that hold them are read."""
    wanted = bundles.select("bundle", F.explode("entries").alias("e")).join(page_ids.select("page_id").distinct(), F.col("e.page_id") == F.col("page_id"), "left_semi")
    found = wanted.groupBy("bundle").agg(F.collect_list("e").alias("entries"))
    return read_bundles(bundles.select("bundle", "content").join(found, "bundle"), payloads=True)


def export_bundles(bundles: DataFrame, folder: str) -> DataFrame:
    """Writes each bundle as folder/<bundle>.warc.zst (a folder that executors share, as a pyarrow URI) and
    returns bundle, path, bytes. The name only appears once the file is whole."""

    def written(batches):
        from pyarrow import fs
        from pyspark import TaskContext

        attempt = TaskContext.get().taskAttemptId()
        store, base = fs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)
        for batch in batches:
            for bundle, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                path = f"{base}/{bundle}.warc.zst"
                with store.open_output_stream(f"{path}.part-{attempt}") as out:
                    out.write(content)
                store.move(f"{path}.part-{attempt}", path)
                yield pa.RecordBatch.from_arrays([pa.array([bundle]), pa.array([path]), pa.array([len(content)], pa.int64())], names=["bundle", "path", "bytes"])

    return bundles.select("bundle", "content").mapInArrow(written, "bundle string, path string, bytes long")


def op1_warc(spark, sf_dir: str) -> DataFrame:
    read = read_bundles(write_bundles(table(spark, sf_dir, "pages")))
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
