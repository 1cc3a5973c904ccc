"""WARC archives as seekable Zstandard bundles.

Records are grouped into frames that decompress on their own. A bundle ends with a footer seek
table: a skippable frame that lists every frame's compressed and plain size, so a reader finds a
frame from the file's last bytes alone. The index maps a record id to its bundle, frame and the
offset inside the frame.

Tasks write bundles straight to the shared folder through its file system. A file's name holds
the task attempt, and the index, itself written by Spark, only names files of attempts that
succeeded, so a task that runs again leaves at most an unused file.

Of equal payloads the record of the largest page id is the response and the others revisit it;
payload digests meet in a join, so a crowd of equal pages costs a row each.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import checkpoint_root
from .common import field, store

#: Plain bytes after which a frame ends, and compressed bytes after which a bundle does.
FRAME_BYTES, BUNDLE_BYTES = 1 << 19, 64 << 20

#: Payloads of at least so many bytes take part in deduplication.
LEAST_BYTES = 0

# Fixed values of the formats.
SKIPPABLE, SEEKABLE, FOOTER_BYTES = 0x184D2A5E, 0x8F92EAB1, 9
DATE = "2024-01-01T00:00:00Z"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

INDEX = "record_id string, bundle string, frame int, offset int, length int"


def record_name(page_id: int | None, row: int) -> str:
    return f"urn:page:{'' if page_id is None else page_id}:{row}"


def record(kind: str, name: str, url: str | None, payload: bytes, digest: str, refers_to: str | None = None) -> bytes:
    """One WARC record; a revisit keeps the HTTP header but not the payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if kind == "revisit" else http + payload
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{name}>", f"WARC-Date: {DATE}", "Content-Type: application/http; msgtype=response"]
    if url is not None:
        head.append(f"WARC-Target-URI: {quote(url, safe=':/?#[]@!$&()*+,;=%~-._')}")
    head.append(f"WARC-Payload-Digest: sha1:{digest}")
    if refers_to is not None:
        head += [f"WARC-Refers-To: <{refers_to}>", f"WARC-Profile: {REVISIT_PROFILE}"]
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict[str, str], bytes, bytes]:
    """Header fields, HTTP header and payload of a record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    return fields, http, payload


class BundleWriter:
    """One bundle: records in, frames and a seek table out."""

    def __init__(self, sink):
        self.sink, self.frames, self.plain = sink, [], bytearray()
        self.compressor = zstandard.ZstdCompressor(level=3)
        self.written = 0

    def add(self, raw: bytes) -> tuple[int, int]:
        """Frame and offset of the record."""
        if self.plain and len(self.plain) + len(raw) > FRAME_BYTES:
            self._end()
        place = len(self.frames), len(self.plain)
        self.plain += raw
        return place

    def _end(self) -> None:
        packed = self.compressor.compress(bytes(self.plain))
        self.sink.write(packed)
        self.frames.append((len(packed), len(self.plain)))
        self.written += len(packed)
        self.plain.clear()

    def close(self) -> None:
        if self.plain:
            self._end()
        table = b"".join(struct.pack("<II", *sizes) for sizes in self.frames)
        footer = struct.pack("<IBI", len(self.frames), 0, SEEKABLE)
        self.sink.write(struct.pack("<II", SKIPPABLE, len(table) + len(footer)) + table + footer)
        self.sink.close()


class BundleReader:
    """Frames of a bundle by number, found through its seek table."""

    def __init__(self, source):
        self.source, size = source, source.size()
        source.seek(size - FOOTER_BYTES)
        count, _, magic = struct.unpack("<IBI", source.read(FOOTER_BYTES))
        if magic != SEEKABLE:
            raise ValueError("no seek table")
        source.seek(size - FOOTER_BYTES - 8 * count)
        table = source.read(8 * count)
        self.frames, at = [], 0
        for i in range(count):
            packed, plain = struct.unpack_from("<II", table, 8 * i)
            self.frames.append((at, packed, plain))
            at += packed

    def frame(self, number: int) -> bytes:
        at, packed, plain = self.frames[number]
        self.source.seek(at)
        return zstandard.ZstdDecompressor().decompress(self.source.read(packed), max_output_size=plain)


def file_system(uri: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(uri if re.match(r"[a-z][a-z0-9+.-]*:", uri) else f"file://{uri}")


def decide(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", least: int = LEAST_BYTES) -> DataFrame:
    """``(page_id, url, payload, row, kind, to_page, to_row)``: what each row becomes in the archive."""
    payload = F.encode(F.coalesce(field(html).cast("string"), F.lit("")), "UTF-8")
    rows = pages.select(field(page_id).cast("long").alias("page_id"), field(url).cast("string").alias("url"), payload.alias("payload"))
    rows = store(rows.withColumn("digest", F.sha1("payload")).withColumn("row", F.monotonically_increasing_id()), "payloads", compression="zstd")
    best = rows.where(F.octet_length("payload") >= least).groupBy("digest").agg(F.max(F.struct("page_id", "row")).alias("best"))
    joined = rows.join(best, "digest", "left")
    revisit = F.coalesce(F.col("best.row") != F.col("row"), F.lit(False))
    return joined.select(
        "page_id", "url", "payload", "row", F.when(revisit, "revisit").otherwise("response").alias("kind"),
        F.when(revisit, F.col("best.page_id")).alias("to_page"), F.when(revisit, F.col("best.row")).alias("to_row"),
    )


def write(decided: DataFrame, folder: str) -> DataFrame:
    """Write the bundles under ``folder`` and return the stored index."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        system, base = file_system(folder)
        system.create_dir(base, recursive=True)
        bundle, name, number = None, "", 0
        for batch in batches:
            rows = []
            for page, url, payload, row, kind, to_page, to_row in zip(*(c.to_pylist() for c in batch.columns)):
                if bundle is None:
                    name = f"part-{context.partitionId():06d}-{context.taskAttemptId()}-{number:04d}.warc.zst"
                    bundle, number = BundleWriter(system.open_output_stream(f"{base}/{name}", compression=None)), number + 1
                digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
                raw = record(kind, record_name(page, row), url, payload, digest, record_name(to_page, to_row) if kind == "revisit" else None)
                frame, offset = bundle.add(raw)
                rows.append((record_name(page, row), name, frame, offset, len(raw)))
                if bundle.written >= BUNDLE_BYTES:
                    bundle.close()
                    bundle = None
            if rows:
                ids, names, frames, offsets, lengths = zip(*rows)
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(names), pa.array(frames, pa.int32()), pa.array(offsets, pa.int32()), pa.array(lengths, pa.int32())], ["record_id", "bundle", "frame", "offset", "length"])
        if bundle is not None:
            bundle.close()

    return store(decided.mapInArrow(run, INDEX), "warc-index")


READ = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, payload binary"


def read(index: DataFrame, folder: str, with_payload: bool = False) -> DataFrame:
    """Records read back through the index: each row opens its bundle at its frame.

    Rows of a bundle come in the order they were written, so a frame is decompressed once.
    """
    schema = READ if with_payload else READ.removesuffix(", payload binary")

    def page_of(name: str | None) -> int | None:
        number = (name or "").strip("<>").split(":")[2:3]
        return int(number[0]) if number and number[0] else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = file_system(folder)
        open_name, reader, open_frame, plain = None, None, None, b""
        for batch in batches:
            rows = []
            for name, frame, offset, length in zip(*(batch.column(i).to_pylist() for i in range(1, 5))):
                if name != open_name:
                    open_name, reader, open_frame = name, BundleReader(system.open_input_file(f"{base}/{name}")), None
                if frame != open_frame:
                    open_frame, plain = frame, reader.frame(frame)
                fields, http, payload = parse(plain[offset : offset + length])
                kind, digest = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha1:")
                size = int(re.search(rb"Content-Length: (\d+)", http)[1])
                if kind == "response" and (size != len(payload) or digest != base64.b32encode(hashlib.sha1(payload).digest()).decode()):
                    raise ValueError(f"{fields['WARC-Record-ID']} does not hold what it says")
                rows.append((page_of(fields["WARC-Record-ID"]), size, digest, kind, page_of(fields.get("WARC-Refers-To")), fields.get("WARC-Target-URI"), payload))
            columns = list(zip(*rows)) or [()] * 7
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()]
            keep = 7 if with_payload else 6
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns[:keep], kinds)], [x.split()[0] for x in schema.split(", ")])

    return index.mapInArrow(run, schema)


def archive(pages: DataFrame, folder: str | None = None, least: int = LEAST_BYTES) -> tuple[DataFrame, str]:
    """Write one record per row of ``pages`` and return the index and the folder.

    Null html is an empty payload, null ids and urls are kept as such, repeated rows are records
    of their own (all but one revisit), an empty table writes no bundle and other columns are
    ignored.
    """
    folder = folder or f"{checkpoint_root(pages.sparkSession)}/stages/warc-{uuid.uuid4().hex}"
    return write(decide(pages, least=least), folder), folder
