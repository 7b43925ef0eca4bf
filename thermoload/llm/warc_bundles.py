"""WARC archives as seekable Zstandard bundles.

A bundle is a run of independent Zstandard frames, each of whole WARC records
(about ``frame_bytes`` of them), closed by a skippable frame that holds the seek
table: every frame's compressed and decompressed size, then the number of frames
and the magic number of the seekable format. Any Zstandard reader can read a
bundle from front to back; with the seek table one frame is enough for one
record. The index maps each record identifier to bundle, frame and the
record's offset within the decompressed frame.

Equal payloads (by SHA-1, length and a second hash, of at least ``min_payload``
bytes) are stored once: the smallest page id is the response, the others are
revisit records that refer to it. Smaller payloads are all responses.

Bundles are closed at ``bundle_bytes`` and travel as rows (name, bytes, index) of
a Parquet table in the shared folder, so a lost or repeated task leaves no half
archive behind, and any store that Spark reaches will do. A bundle's name is a
digest of its bytes. A task holds one bundle at a time.

Scale: the payloads are shuffled once, to meet their group's smallest id; groups
are reduced by ``min`` and the join splits hot ones.

Edge cases: null payload: empty; null url: empty header; a null page id is
written as an empty identifier and read as null, and loses against any other as
smallest id; rows repeated with the same id and payload are all responses. An
empty table gives an empty archive. Extra columns are not looked at.
"""

from __future__ import annotations

import base64
import hashlib
import struct

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_value

FRAME_BYTES = 256 << 10
BUNDLE_BYTES = 8 << 20
SKIPPABLE_MAGIC, SEEKABLE_MAGIC = 0x184D2A5E, 0x8F92EAB1
SCHEMA = ("name string, data binary, index array<struct<record_id: string, frame: int, offset: int, length: int>>")
WARC_DATE = "1970-01-01T00:00:00Z"  # the table has no fetch time


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _header_text(value: str | None) -> str:
    return (value or "").replace("\r", "%0D").replace("\n", "%0A")


def record(page_id, url: str | None, payload: bytes, refers_to=None, revisit: bool = False) -> tuple[str, bytes]:
    """(record identifier, bytes) of one WARC record."""
    rid = f"<urn:page:{'' if page_id is None else page_id}>"
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {rid}",
            f"WARC-Target-URI: {_header_text(url)}", f"WARC-Date: {WARC_DATE}",
            f"WARC-Payload-Digest: sha1:{payload_digest(payload)}", f"Payload-Length: {len(payload)}",
            "Content-Type: application/http;msgtype=response"]
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
                 f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head.append(f"Content-Length: {len(block)}")
    return rid, "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes) -> dict:
    """Headers, HTTP payload and length of the record at the start of ``data``."""
    end = data.index(b"\r\n\r\n")
    lines = data[:end].decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
    size = int(headers["Content-Length"])
    block = data[end + 4:end + 4 + size]
    if len(block) != size or data[end + 4 + size:end + 8 + size] != b"\r\n\r\n":
        raise ValueError("truncated WARC record")
    headers["payload"] = block[block.index(b"\r\n\r\n") + 4:]
    headers["size"] = end + 8 + size
    return headers


class BundleWriter:
    """Frames records, and closes a bundle with its seek table."""

    def __init__(self, frame_bytes: int = FRAME_BYTES, level: int = 3):
        self.frame_bytes, self.level = frame_bytes, level
        self.frames, self.sizes, self.index, self.open, self.open_size, self.size = [], [], [], [], 0, 0

    def add(self, rid: str, data: bytes) -> None:
        if self.open and self.open_size + len(data) > self.frame_bytes:
            self._close_frame()
        self.index.append({"record_id": rid, "frame": len(self.frames), "offset": self.open_size, "length": len(data)})
        self.open.append(data)
        self.open_size += len(data)

    def _close_frame(self) -> None:
        packed = zstandard.ZstdCompressor(level=self.level).compress(b"".join(self.open))
        self.frames.append(packed)
        self.sizes.append((len(packed), self.open_size))
        self.size += len(packed)
        self.open, self.open_size = [], 0

    def close(self) -> dict:
        if self.open:
            self._close_frame()
        table = b"".join(struct.pack("<II", *s) for s in self.sizes)
        foot = struct.pack("<IBI", len(self.sizes), 0, SEEKABLE_MAGIC)
        data = b"".join(self.frames) + struct.pack("<II", SKIPPABLE_MAGIC, len(table) + len(foot)) + table + foot
        return {"name": hashlib.sha256(data).hexdigest()[:32], "data": data, "index": self.index}


def seek_table(data: bytes) -> list[tuple[int, int, int]]:
    """(start, compressed size, decompressed size) of each frame, from the footer alone."""
    n, flags, magic = struct.unpack("<IBI", data[-9:])
    if magic != SEEKABLE_MAGIC:
        raise ValueError("no seek table")
    width = 12 if flags & 0x80 else 8  # with checksums
    at, out, first = 0, [], len(data) - 9 - n * width
    for i in range(n):
        packed, plain = struct.unpack_from("<II", data, first + i * width)
        out.append((at, packed, plain))
        at += packed
    return out


def read_frame(data: bytes, frame: tuple[int, int, int]) -> bytes:
    start, packed, plain = frame
    return zstandard.ZstdDecompressor().decompress(data[start:start + packed], max_output_size=plain)


def write_bundles(pages: DataFrame, id_col: str = "page_id", url: str = "url", payload: str = "html",
                  min_payload: int = 0, frame_bytes: int = FRAME_BYTES, bundle_bytes: int = BUNDLE_BYTES) -> DataFrame:
    """The bundles as rows (``SCHEMA``); write the result as a table before reading it more than once."""
    body = F.coalesce(F.col(payload), F.lit(""))
    rows = pages.select(F.col(id_col).alias("id"), F.col(url).alias("url"), body.alias("body"),
                        F.sha1(body.cast("binary")).alias("sha"), F.octet_length(body).alias("len"),
                        F.xxhash64(body).alias("xx"))
    first = rows.groupBy("sha", "len", "xx").agg(F.min("id").alias("first"))
    known = rows.join(first, ["sha", "len", "xx"]).select("id", "url", "body", "first")

    def run(batches):
        w = BundleWriter(frame_bytes)
        for b in batches:
            for i in range(b.num_rows):
                pid, link, text, lead = (c[i].as_py() for c in b.columns)
                data = text.encode("utf-8")
                again = pid != lead and len(data) >= min_payload
                w.add(*record(pid, link, data, lead, again))
                if w.size >= bundle_bytes:
                    yield _row(w.close())
                    w = BundleWriter(frame_bytes)
        if w.index:
            yield _row(w.close())

    def _row(x):
        kind = pa.list_(pa.struct([("record_id", pa.string()), ("frame", pa.int32()), ("offset", pa.int32()),
                                   ("length", pa.int32())]))
        return pa.RecordBatch.from_arrays([pa.array([x["name"]]), pa.array([x["data"]], pa.binary()),
                                           pa.array([x["index"]], kind)], names=["name", "data", "index"])
    return known.mapInArrow(run, SCHEMA)


def record_index(bundles: DataFrame) -> DataFrame:
    """``record_id`` to ``bundle``, ``frame``, ``offset``, ``length``."""
    return bundles.select(F.col("name").alias("bundle"), F.explode("index").alias("x")).select("x.*", "bundle")


def read_records(data: bytes, places: list[tuple[str, int, int, int]], open_frame=read_frame):
    """(record identifier, headers and payload) of the records at ``places`` (identifier, frame, offset, length) of
    one bundle; only the frames that hold them are opened, each once."""
    frames, at, plain = seek_table(data), None, b""
    for rid, frame, offset, length in sorted(places, key=lambda p: p[1:]):
        if frame != at:
            at, plain = frame, open_frame(data, frames[frame])
        r = parse_record(plain[offset:offset + length])
        if r["WARC-Record-ID"] != rid or r["size"] != length:
            raise ValueError(f"the index is wrong at {rid}")
        yield rid, r


def fetch(bundles: DataFrame, wanted: DataFrame) -> DataFrame:
    """The records named in ``wanted`` (column ``record_id``): ``record_id``, ``record_type``, ``payload`` (null for
    a revisit), ``refers_to`` (the record that has a revisit's payload), ``bundle``, ``frame``. Identifiers that no bundle has give no row.

    The index says where the records are; a bundle without any is not sent to a task, of the others the wanted frames are unpacked."""
    places = (record_index(bundles).join(wanted.select("record_id").distinct(), "record_id")
              .groupBy("bundle").agg(F.collect_list(F.struct("record_id", "frame", "offset", "length")).alias("places")))
    rows = bundles.join(places, F.col("name") == F.col("bundle")).select("name", "data", "places")

    def run(batches):
        for b in batches:
            for i in range(b.num_rows):
                at = [tuple(p.values()) for p in b.column(2)[i].as_py()]
                frame_of = {p[0]: p[1] for p in at}
                found = list(read_records(b.column(1)[i].as_py(), at))
                plain = [r["payload"] if r["WARC-Type"] == "response" else None for _, r in found]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([rid for rid, _ in found]), pa.array([r["WARC-Type"] for _, r in found]), pa.array(plain, pa.binary()),
                     pa.array([r.get("WARC-Refers-To") for _, r in found], pa.string()), pa.array([b.column(0)[i].as_py()] * len(found)),
                     pa.array([frame_of[rid] for rid, _ in found], pa.int32())],
                    names=["record_id", "record_type", "payload", "refers_to", "bundle", "frame"])
    return rows.mapInArrow(run, "record_id string, record_type string, payload binary, refers_to string, bundle string, frame int")


def read_bundles(bundles: DataFrame, id_type: str = "bigint") -> DataFrame:
    """One row per record, found through the index and the seek table: the id, payload size
    and digest (checked against the bytes of responses), type and the id referred to."""
    def run(batches):
        for b in batches:
            for i in range(b.num_rows):
                data, index = b.column(1)[i].as_py(), b.column(2)[i].as_py()
                frames, at, plain, out = seek_table(data), None, b"", []
                for x in index:
                    if x["frame"] != at:
                        at, plain = x["frame"], read_frame(data, frames[x["frame"]])
                    r = parse_record(plain[x["offset"]:x["offset"] + x["length"]])
                    if r["WARC-Record-ID"] != x["record_id"] or r["size"] != x["length"]:
                        raise ValueError(f"the index is wrong at {x}")
                    digest, size = r["WARC-Payload-Digest"].removeprefix("sha1:"), int(r["Payload-Length"])
                    if r["WARC-Type"] == "response" and (payload_digest(r["payload"]), len(r["payload"])) != (digest, size):
                        raise ValueError(f"the payload is not the one written at {x}")
                    refers = r.get("WARC-Refers-To", "")
                    out.append((x["record_id"][10:-1], size, digest, r["WARC-Type"], refers[10:-1]))
                if out:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, pa.int64() if k == 1 else pa.string()) for k, c in enumerate(zip(*out))],
                        names=["id", "payload_bytes", "payload_digest", "record_type", "refers_to"])
    rows = bundles.select("name", "data", "index").mapInArrow(
        run, "id string, payload_bytes long, payload_digest string, record_type string, refers_to string")
    ident = lambda c: F.when(F.col(c) != "", F.col(c)).cast(id_type).alias(c)
    return rows.select(ident("id"), "payload_bytes", "payload_digest", "record_type", ident("refers_to"))


by_value(__name__)
