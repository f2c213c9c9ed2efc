"""WARC archives as seekable Zstandard bundles.

A bundle is a run of independent Zstandard frames, each with some whole records,
and a seek table in a skippable frame at its end.  An index maps record ids to
bundle, frame and offset inside the frame.  Bundles are rows of a table (bundle,
data), so that any store that Spark writes to can hold them.
"""

from __future__ import annotations

import base64
import hashlib
import struct

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

#: Fixed values of the seekable format: skippable frame, seek table footer.
SKIPPABLE, FOOTER = 0x184D2A5E, 0x8F92EAB1
FRAME_BYTES, BUNDLE_BYTES = 1 << 18, 8 << 20
_BUNDLE = "bundle string, data binary, ids array<long>, frames array<int>, offsets array<int>, lengths array<int>"


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


class BundleWriter:
    """Gathers records into frames and frames into bundles."""

    def __init__(self, frame_bytes: int = FRAME_BYTES, level: int = 3):
        self.frame_bytes, self.level = frame_bytes, level
        self.reset()

    def reset(self):
        self.frames: list[tuple[int, int]] = []  # compressed and plain sizes
        self.out, self.open, self.open_size = [], [], 0
        self.index: list[tuple] = []
        self.size = 0

    def add(self, key, record: bytes):
        self.index.append((key, len(self.frames), self.open_size, len(record)))
        self.open.append(record)
        self.open_size += len(record)
        if self.open_size >= self.frame_bytes:
            self.close_frame()

    def close_frame(self):
        if self.open:
            frame = zstandard.ZstdCompressor(level=self.level, write_content_size=True).compress(b"".join(self.open))
            self.out.append(frame)
            self.frames.append((len(frame), self.open_size))
            self.size += len(frame)
            self.open, self.open_size = [], 0

    def finish(self) -> tuple[bytes, list[tuple]]:
        self.close_frame()
        entries = b"".join(struct.pack("<II", *f) for f in self.frames)
        footer = struct.pack("<IBI", len(self.frames), 0, FOOTER)
        table = struct.pack("<II", SKIPPABLE, len(entries) + len(footer)) + entries + footer
        data, index = b"".join(self.out) + table, self.index
        self.reset()
        return data, index


def seek_table(data: bytes) -> list[tuple[int, int, int]]:
    """(start, compressed size, plain size) of the frames of a bundle, from its footer."""
    n, flags, magic = struct.unpack("<IBI", data[-9:])
    if magic != FOOTER or flags & 0x80:
        raise ValueError("not a seekable bundle without checksums")
    entries = data[-9 - 8 * n : -9]
    out, at = [], 0
    for packed, plain in struct.iter_unpack("<II", entries):
        out.append((at, packed, plain))
        at += packed
    return out


def read_frame(data: bytes, start: int, packed: int, plain: int) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data[start : start + packed], max_output_size=plain)


def read_record(data: bytes, frame: int, offset: int, length: int) -> bytes:
    """One record of a bundle, by its index entry: only its frame is unpacked."""
    return read_frame(data, *seek_table(data)[frame])[offset : offset + length]


def record(page, url, payload: bytes, digest: str, first) -> bytes:
    """A WARC/1.1 response record, or a revisit record without payload if ``first`` names another page."""
    revisit = first is not None and first != page
    head = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page:{'' if page is None else page}>",
        "WARC-Target-URI: " + "".join(ch if ch > " " else "%%%02X" % ord(ch) for ch in url or ""), "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {len(payload)}",
    ]
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{first}>"]
    block = b"" if revisit else payload
    head += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def records(data: bytes):
    """(headers, block) of the records of plain WARC data."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].decode().split("\r\n")
        if lines[0] != "WARC/1.1":
            raise ValueError("not a record")
        headers = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
        size = int(headers["Content-Length"])
        yield headers, data[end + 4 : end + 4 + size]
        at = end + 4 + size + 4


def _first_holders(pages: DataFrame, id_col: str, html_col: str, least_bytes: int) -> DataFrame:
    """(digest, size, first): the smallest id of each payload of enough bytes that two rows or more share."""
    payload = F.coalesce(F.col(html_col), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.sha1(payload).alias("digest"), F.octet_length(payload).alias("size"))
    return rows.where(F.col("size") >= least_bytes).groupBy("digest", "size").agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1")


def write(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_bytes: int = 0, bundle_bytes: int = BUNDLE_BYTES) -> None:
    """Write a record per row to bundles in the table at ``path``.

    Of rows with equal payloads of at least ``least_bytes`` bytes, those with the
    smallest id are responses and all others revisits of it; rows without an id
    are responses.  Null html is an empty payload, a null url an empty one.  Rows
    with one id are records with one record id, so the index has a row for each;
    those without an id share the id of none.  A bundle closes once it holds
    ``bundle_bytes``, so a payload larger than that, which is never split, has one
    of its own; memory follows the longest payload.
    """
    payload = F.coalesce(F.col(html_col), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"), F.sha1(payload).alias("digest"))
    # Only ids and digests go by digest, where one payload may be a third of all; payloads go by id, if at all.
    shared = C.cut(_first_holders(pages, id_col, html_col, least_bytes))
    keys = pages.select(F.col(id_col).cast("long").alias("id"), F.sha1(payload).alias("digest"), F.octet_length(payload).alias("size"))
    later = keys.join(shared, ["digest", "size"]).where("id != first").select(F.col("id").alias("_id"), F.col("digest").alias("_digest"), F.col("size").alias("_size"), "first").distinct()
    same = (rows.id == later._id) & (rows.digest == later._digest) & (F.octet_length(rows.payload) == later._size)
    rows = rows.join(later, same, "left").select("id", "url", "payload", "first")

    def run(batches):
        from pyspark import TaskContext

        writer, n = BundleWriter(), 0

        def row():
            nonlocal n
            data, index = writer.finish()
            name = f"part-{TaskContext.get().partitionId():06d}-{n:04d}.warc.zst"
            n += 1
            cols = [[name], [data], *[[list(x)] for x in zip(*index)]]
            kinds = [pa.string(), pa.binary(), pa.list_(pa.int64()), *[pa.list_(pa.int32())] * 3]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["bundle", "data", "ids", "frames", "offsets", "lengths"])

        for batch in batches:
            for i in range(batch.num_rows):
                page, url, payload, first = (batch.column(c)[i].as_py() for c in range(4))
                writer.add(page, record(page, url, payload, payload_digest(payload), first))
                if writer.size >= bundle_bytes:
                    yield row()
        if writer.index:
            yield row()

    rows.mapInArrow(run, _BUNDLE).write.mode("errorifexists").parquet(path)


def index(bundles: DataFrame) -> DataFrame:
    """(record_id, bundle, frame, offset, length), a row per record."""
    z = F.explode(F.arrays_zip("ids", "frames", "offsets", "lengths")).alias("z")
    return bundles.select("bundle", z).select(F.col("z.ids").alias("record_id"), "bundle", F.col("z.frames").alias("frame"), F.col("z.offsets").alias("offset"), F.col("z.lengths").alias("length"))


def read(bundles: DataFrame) -> DataFrame:
    """(page_id, url, payload_bytes, payload_digest, record_type, refers_to, block) of all records, frame by frame."""

    def run(batches):
        def page_of(x):
            text = x[len("<urn:page:") : -1]
            return int(text) if text else None

        for batch in batches:
            for x in batch.column(0):
                data = x.as_py()
                for entry in seek_table(data):
                    got = list(records(read_frame(data, *entry)))
                    heads = [h for h, _ in got]
                    for h, block in got:
                        if h["WARC-Type"] == "response" and "sha1:" + payload_digest(block) != h["WARC-Payload-Digest"]:
                            raise ValueError(f"{h['WARC-Record-ID']}: the payload does not have its digest")
                    cols = [
                        pa.array([page_of(h["WARC-Record-ID"]) for h in heads], pa.int64()), pa.array([h["WARC-Target-URI"] for h in heads], pa.string()),
                        pa.array([int(h["X-Payload-Length"]) for h in heads], pa.int64()), pa.array([h["WARC-Payload-Digest"].removeprefix("sha1:") for h in heads], pa.string()),
                        pa.array([h["WARC-Type"] for h in heads], pa.string()), pa.array([page_of(h["WARC-Refers-To"]) if "WARC-Refers-To" in h else None for h in heads], pa.int64()),
                        pa.array([b for _, b in got], pa.binary()),
                    ]
                    yield pa.RecordBatch.from_arrays(cols, names=["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "block"])

    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, block binary"
    return bundles.select("data").mapInArrow(run, schema)


def round_trip(pages: DataFrame, **how) -> DataFrame:
    """Write ``pages`` to archives in the shared folder and read them back: a row per page.

    read() checks every response against its digest.
    """
    import uuid

    spark = pages.sparkSession
    path = f"{C.shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    write(pages, path, **how)
    return read(spark.read.parquet(path)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
