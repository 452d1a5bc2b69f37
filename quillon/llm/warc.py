"""WARC: seekable Zstandard bundles.

Records are grouped into frames of about `FRAME_BYTES`, each compressed by itself, and frames into bundles of about
`BUNDLE_BYTES`. A bundle ends with a seek table in a skippable frame (sizes of every frame, as the seekable format
of Zstandard lays it down), so one record is read by decompressing one frame. The index maps each record's
identifier to bundle, frame and place in the frame.

Records with the same payload (SHA-1) of at least `least` bytes: the one with the largest page_id is a response,
the others are revisits that refer to it. Bundles are files of the folder given, written by the tasks under a
name of their own and then renamed; the index lists the files that count, so what a lost task left is never read.

Defined results: a null payload is an empty one; a null url is written without a target; rows that share the
largest page_id and the payload are all responses; pages without an id are responses of their own and are never
referred to; repeated rows give one record each; an empty table gives no bundle and an empty index; very long
payloads get a frame of their own; further columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import io
import re
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm._common import map_arrow, shared_dir, small, written

FRAME_BYTES = 1 << 20
BUNDLE_BYTES = 16 << 20
#: Fixed values of the seekable format: magic numbers of the skippable frame and of the footer.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
DATE = "2000-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

INDEX = "record_id string, page_id long, bundle string, frame int, place long, length long"


def record(page_id: int | None, name: str, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One WARC/1.1 record; a revisit has the headers of its response but no payload."""
    sha = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if refers_to is not None else 'response'}", f"WARC-Record-ID: <{name}>", f"WARC-Date: {DATE}"]
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}")
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    head.append(f"WARC-Payload-Digest: sha1:{sha}")
    if refers_to is not None:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {PROFILE}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes, place: int = 0) -> tuple[dict[str, str], bytes, int]:
    """(headers, payload, where the next record begins) of the record at a place."""
    end = data.index(b"\r\n\r\n", place)
    lines = data[place:end].decode("utf-8", "surrogatepass").split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError("no record begins here")
    head = dict(line.split(": ", 1) for line in lines[1:])
    begin = end + 4
    stop = begin + int(head["Content-Length"])
    block = data[begin:stop]
    http_end = block.index(b"\r\n\r\n") + 4
    head["payload_bytes"] = re.search(rb"Content-Length: (\d+)", block[:http_end])[1].decode()
    return head, block[http_end:], stop + 4


def seek_table(frames: list[tuple[int, int]]) -> bytes:
    """The closing skippable frame: (compressed, uncompressed) sizes of each frame, then their number and the magic."""
    body = b"".join(struct.pack("<II", *f) for f in frames) + struct.pack("<IBI", len(frames), 0, SEEKABLE)
    return struct.pack("<II", SKIPPABLE, len(body)) + body


def read_seek_table(bundle: bytes) -> list[tuple[int, int]]:
    """(begin, end) of each frame in the file, from its footer."""
    count, _, magic = struct.unpack("<IBI", bundle[-9:])
    if magic != SEEKABLE:
        raise ValueError("no seek table")
    sizes = struct.unpack(f"<{2 * count}I", bundle[-9 - 8 * count : -9])
    out, at = [], 0
    for n in sizes[::2]:
        out.append((at, at + n))
        at += n
    return out


def decompressed(frame: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompressobj().decompress(frame)


def store(folder: str):
    """(file system, path) of a shared folder, as Python reaches it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder if "://" in folder else re.sub(r"^(file:)?", "file://", folder, count=1))


class Bundler:
    """Writes one task's records into bundles and yields the index of each when it is closed."""

    def __init__(self, folder: str, level: int, frame_bytes: int, bundle_bytes: int):
        self.files, self.path = store(folder)
        self.frame_bytes, self.bundle_bytes = frame_bytes, bundle_bytes
        self.packer = zstandard.ZstdCompressor(level=level, write_checksum=True)
        self.start()

    def start(self) -> None:
        self.out, self.frames, self.index = io.BytesIO(), [], []
        self.frame, self.held = [], 0

    def add(self, page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> Iterator[pa.RecordBatch]:
        name = f"urn:page:{page_id}" if refers_to is None and page_id is not None else f"urn:uuid:{uuid.uuid4()}"
        data = record(page_id, name, url, payload, refers_to)
        self.index.append((name, page_id, len(self.frames), self.held, len(data)))
        self.frame.append(data)
        self.held += len(data)
        if self.held >= self.frame_bytes:
            self.close_frame()
            if self.out.tell() >= self.bundle_bytes:
                yield self.close()

    def close_frame(self) -> None:
        if self.frame:
            packed = self.packer.compress(b"".join(self.frame))
            self.frames.append((len(packed), self.held))
            self.out.write(packed)
            self.frame, self.held = [], 0

    def close(self) -> pa.RecordBatch:
        self.close_frame()
        self.out.write(seek_table(self.frames))
        name = f"bundle-{uuid.uuid4().hex}.warc.zst"
        with self.files.open_output_stream(f"{self.path}/{name}.tmp") as f:
            f.write(self.out.getbuffer())
        self.files.move(f"{self.path}/{name}.tmp", f"{self.path}/{name}")
        ids, pages, frames, places, lengths = zip(*self.index, strict=True)
        batch = pa.record_batch(
            [pa.array(ids), pa.array(pages, pa.int64()), pa.array([name] * len(ids)), pa.array(frames, pa.int32()), pa.array(places, pa.int64()), pa.array(lengths, pa.int64())],
            names=["record_id", "page_id", "bundle", "frame", "place", "length"],
        )
        self.start()
        return batch


def revisits(pages: DataFrame, least: int) -> DataFrame:
    """(page_id, sha, refers_to) of pages whose payload a page of a larger id has too."""
    own = pages.select("page_id", F.sha1(F.coalesce("html", F.lit("")).cast("binary")).alias("sha")).where(F.octet_length(F.coalesce("html", F.lit(""))) >= least) if least else pages.select("page_id", F.sha1(F.coalesce("html", F.lit("")).cast("binary")).alias("sha"))
    own = written(own, "digests")
    last = own.groupBy("sha").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1")
    return written(own.join(last, "sha").where("page_id < refers_to").select("page_id", "sha", "refers_to").distinct(), "revisits")


def write_bundles(pages: DataFrame, folder: str, least: int = 0, level: int = 3, frame_bytes: int = FRAME_BYTES, bundle_bytes: int = BUNDLE_BYTES) -> DataFrame:
    """Write one record for each page to bundles in the folder; the index, as written beside them. Pages have page_id, url and html."""
    files, path = store(folder)
    files.create_dir(path, recursive=True)
    back = small(revisits(pages, least), 120)
    named = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    sha = F.sha1(F.col("p.html").cast("binary"))
    joined = named.alias("p").join(back.alias("r"), (F.col("p.page_id") == F.col("r.page_id")) & (sha == F.col("r.sha")), "left").select("p.page_id", "p.url", "p.html", "r.refers_to")

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bundler = Bundler(folder, level, frame_bytes, bundle_bytes)
        for batch in batches:
            for page_id, url, html, refers_to in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                yield from bundler.add(page_id, url, html.encode("utf-8", "surrogatepass"), refers_to)
        if bundler.index:
            yield bundler.close()

    return written(joined.mapInArrow(over, INDEX), "index")


ROWS = "page_id long, record_id string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload_ok boolean"


def read_bundles(spark: SparkSession, folder: str, index: DataFrame) -> DataFrame:
    """Every record of the bundles that the index names, read back frame by frame; payload_ok tells whether a response's payload has its digest."""
    wanted = small(index.select("bundle").distinct(), 80)
    raw = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(folder).select(F.element_at(F.split("path", "/"), -1).alias("bundle"), "content")
    raw = raw.join(wanted, "bundle", "left_semi").select("content")

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                bundle = batch.column(0)[k].as_py()
                for begin, end in read_seek_table(bundle):
                    data, place, rows = decompressed(bundle[begin:end]), 0, []
                    while place < len(data):
                        head, payload, place = parse(data, place)
                        told = head["WARC-Payload-Digest"].removeprefix("sha1:")
                        refers = re.fullmatch(r"<urn:page:(-?\d+)>", head.get("WARC-Refers-To", ""))
                        ok = head["WARC-Type"] == "revisit" or base64.b32encode(hashlib.sha1(payload).digest()).decode() == told and len(payload) == int(head["payload_bytes"])
                        rows.append((int(head["X-Page-ID"]) if "X-Page-ID" in head else None, head["WARC-Record-ID"].strip("<>"), int(head["payload_bytes"]), told, head["WARC-Type"], int(refers[1]) if refers else None, ok))
                    names = [c.split()[0] for c in ROWS.split(", ")]
                    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.bool_()]
                    yield pa.record_batch([pa.array(v, t) for v, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return raw.mapInArrow(over, ROWS)


def fetch(index: DataFrame, folder: str, record_ids: list[str]) -> DataFrame:
    """(record_id, payload) of the records named: each task reads a bundle's seek table and then the one frame it needs."""

    def over(batch: pa.RecordBatch) -> pa.RecordBatch:
        files, path = store(folder)
        out = []
        for bundle, frame, place in zip(*(c.to_pylist() for c in batch.columns[1:4]), strict=True):
            with files.open_input_file(f"{path}/{bundle}") as f:
                size = f.size()
                count = struct.unpack("<IBI", f.read_at(9, size - 9))[0]
                sizes = struct.unpack(f"<{2 * count}I", f.read_at(8 * count, size - 9 - 8 * count))[::2]
                data = decompressed(f.read_at(sizes[frame], sum(sizes[:frame])))
            out.append(parse(data, place)[1])
        return pa.record_batch([batch.column(0), pa.array(out, pa.binary())], names=["record_id", "payload"])

    return map_arrow(index.where(F.col("record_id").isin(record_ids)).select("record_id", "bundle", "frame", "place"), over, "record_id string, payload binary")


def archive(pages: DataFrame, folder: str | None = None, least: int = 0) -> DataFrame:
    """Write the pages to bundles, then one row for each record as read back from them."""
    spark = pages.sparkSession
    folder = folder or f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    index = write_bundles(pages, folder, least)
    if index.isEmpty():
        return spark.createDataFrame([], ROWS)
    return read_bundles(spark, folder, index)
