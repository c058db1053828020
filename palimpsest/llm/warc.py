"""WARC archives as seekable Zstandard bundles.

Records are grouped into independent Zstandard frames; the bundle ends in a seek table (a skippable frame), and an index
maps every record identifier to (bundle, frame, offset inside the decompressed frame, length). Any record can be read by
one seek and the decompression of one frame.

Defined cases: a null payload is the empty payload; a null record id is written as ``null`` and read back as null; rows
that repeat (id, payload) and hold the largest id are all responses; an empty table gives no bundle and no row; other
columns of the input are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import io
import struct
import uuid
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm.common import scratch, ship_by_value, table

ship_by_value(__name__)

SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1  # fixed values of the seekable Zstandard format
FRAME_BYTES, BUNDLE_BYTES, LEVEL = 1 << 20, 1 << 30, 3
DATE = "2026-01-01T00:00:00Z"
INDEX = "record_id long, bundle string, frame int, frame_start long, offset long, length long"
RECORD = "record_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def warc_record(record_id, url: str | None, payload: bytes, kind: str, refers_to, digest: str, size: int) -> bytes:
    """One WARC/1.1 record. A revisit has no block; the size and digest of the payload it stands for are in its header."""
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <urn:page:{'null' if record_id is None else record_id}>",
        f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"X-Payload-Length: {size}",
    ]
    if url is not None:
        head.append("WARC-Target-URI: " + "".join(" " if c in "\r\n" else c for c in url))
    if kind == "revisit":
        head.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        head.append(f"WARC-Refers-To: <urn:page:{refers_to}>")
        payload = b""
    head.append(f"Content-Length: {len(payload)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + payload + b"\r\n\r\n"


def parse_records(data: bytes) -> Iterator[tuple[int, int, dict, bytes]]:
    """(offset, length, headers, block) of each record of a decompressed frame."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        headers = dict(x.split(": ", 1) for x in data[at:end].decode().split("\r\n")[1:])
        start, size = end + 4, int(headers["Content-Length"])
        yield at, start + size + 4 - at, headers, data[start : start + size]
        at = start + size + 4


def seek_table(frames: list[tuple[int, int]]) -> bytes:
    body = b"".join(struct.pack("<II", c, d) for c, d in frames) + struct.pack("<IBI", len(frames), 0, SEEKABLE)
    return struct.pack("<II", SKIPPABLE, len(body)) + body


def read_seek_table(f) -> list[tuple[int, int, int]]:
    """(start, compressed size, decompressed size) of each frame of an open bundle."""
    size = f.size()
    f.seek(size - 9)
    count, _, magic = struct.unpack("<IBI", f.read(9))
    if magic != SEEKABLE:
        raise ValueError("not a seekable bundle")
    f.seek(size - 9 - 8 * count)
    raw, out, at = f.read(8 * count), [], 0
    for k in range(count):
        c, d = struct.unpack_from("<II", raw, 8 * k)
        out.append((at, c, d))
        at += c
    return out


def open_store(uri: str):
    """File system and path for file:, hdfs:, s3: and other stores; a bare path is local."""
    return pafs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (pafs.LocalFileSystem(), uri)


class BundleWriter:
    """Appends records to frames and frames to a bundle; holds one frame and its index rows in memory."""

    def __init__(self, folder: str, frame_bytes: int, bundle_bytes: int, level: int):
        self.folder, self.frame_bytes, self.bundle_bytes = folder, frame_bytes, bundle_bytes
        self.zip = zstandard.ZstdCompressor(level=level)
        self.out, self.frame, self.waiting, self.index = None, io.BytesIO(), [], []

    def _open(self) -> None:
        self.name = f"bundle-{uuid.uuid4().hex}.warc.zst"  # a retried task writes other names; only indexed bundles count
        fs, path = open_store(self.folder)
        fs.create_dir(path, recursive=True)
        self.out, self.frames, self.at = fs.open_output_stream(f"{path}/{self.name}", compression=None), [], 0

    def add(self, record_id, record: bytes) -> None:
        if self.frame.tell() and self.frame.tell() + len(record) > self.frame_bytes:
            self.flush()
        self.waiting.append((record_id, self.frame.tell(), len(record)))
        self.frame.write(record)

    def flush(self) -> None:
        if not self.waiting:
            return
        if self.out is None:
            self._open()
        raw = self.frame.getvalue()
        packed = self.zip.compress(raw)
        self.out.write(packed)
        self.index += [(r, f"{self.folder}/{self.name}", len(self.frames), self.at, o, n) for r, o, n in self.waiting]
        self.frames.append((len(packed), len(raw)))
        self.at += len(packed)
        self.frame, self.waiting = io.BytesIO(), []
        if self.at >= self.bundle_bytes:
            self.close()

    def close(self) -> None:
        self.flush()
        if self.out is not None:
            self.out.write(seek_table(self.frames))
            self.out.close()
            self.out = None

    def take(self) -> pd.DataFrame:
        rows, self.index = self.index, []
        out = pd.DataFrame(rows, columns=["record_id", "bundle", "frame", "frame_start", "offset", "length"])
        return out.astype({"record_id": "Int64", "frame": "int32"})


def _writer(folder: str, frame_bytes: int, bundle_bytes: int, level: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer = BundleWriter(folder, frame_bytes, bundle_bytes, level)
        schema = pa.schema([("record_id", pa.int64()), ("bundle", pa.string()), ("frame", pa.int32()), ("frame_start", pa.int64()), ("offset", pa.int64()), ("length", pa.int64())])
        for batch in batches:
            for rid, url, text, response in zip(*(batch.column(c).to_pylist() for c in ("record_id", "url", "payload", "response")), strict=True):
                payload = text or b""
                kind = "response" if response is None or response == rid else "revisit"
                writer.add(rid, warc_record(rid, url, payload, kind, response, digest_of(payload), len(payload)))
            yield pa.RecordBatch.from_pandas(writer.take(), schema, preserve_index=False)
        writer.close()
        yield pa.RecordBatch.from_pandas(writer.take(), schema, preserve_index=False)

    return run


def _bare_id(urn: str):
    value = urn.removeprefix("<urn:page:").removesuffix(">")
    return None if value == "null" else int(value)


def _as_row(headers: dict, block: bytes, with_payload: bool) -> tuple:
    revisit = headers["WARC-Type"] == "revisit"
    digest = headers["WARC-Payload-Digest"].removeprefix("sha1:") if revisit else digest_of(block)
    size = int(headers["X-Payload-Length"]) if revisit else len(block)
    refers = _bare_id(headers["WARC-Refers-To"]) if revisit else None
    return _bare_id(headers["WARC-Record-ID"]), headers.get("WARC-Target-URI"), size, digest, headers["WARC-Type"], refers, block if with_payload else None


RECORD_ARROW = pa.schema([("record_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])


def _reader(with_payload: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unzip = zstandard.ZstdDecompressor()
        for batch in batches:
            frames: dict[str, list[int]] = {}
            for uri, frame in zip(batch.column("bundle").to_pylist(), batch.column("frame").to_pylist(), strict=True):
                frames.setdefault(uri, []).append(frame)
            for uri, numbers in frames.items():
                fs, path = open_store(uri)
                with fs.open_input_file(path) as f:
                    places = read_seek_table(f)
                    for start, packed, raw in (places[k] for k in sorted(numbers)):
                        f.seek(start)
                        data = unzip.decompress(f.read(packed), max_output_size=raw)
                        rows = [_as_row(h, b, with_payload) for _, _, h, b in parse_records(data)]
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), RECORD_ARROW.types, strict=True)], schema=RECORD_ARROW)

    return run


def write_bundles(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", text_col: str = "html", min_revisit_bytes: int = 0, frame_bytes: int = FRAME_BYTES, bundle_bytes: int = BUNDLE_BYTES, level: int = LEVEL) -> DataFrame:
    """Write one record per row into bundles under ``folder``; return the index, itself stored there.

    Payloads of at least ``min_revisit_bytes`` that occur more than once are stored once, by the row with the largest id.
    Equality is that of SHA-256, as SHA-1 collisions are public. The group of a payload is found from (digest, id) alone,
    with partial aggregation; the join that gives each copy its group may split a digest that very many rows share.
    """
    payload = F.coalesce(F.encode(F.col(text_col), "UTF-8"), F.lit(b""))
    rows = pages.select(F.col(id_col).cast("long").alias("record_id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload")).withColumn("key", F.sha2("payload", 256))
    light = pages.select(F.col(id_col).cast("long").alias("record_id"), F.sha2(payload, 256).alias("key"), F.length(payload).alias("n"))
    groups = light.groupBy("key").agg(F.max("record_id").alias("response"), F.count("*").alias("rows"), F.max("n").alias("n")).where((F.col("rows") > 1) & (F.col("n") >= min_revisit_bytes)).select("key", "response")
    index = rows.join(groups, "key", "left").select("record_id", "url", "payload", "response").mapInArrow(_writer(folder, frame_bytes, bundle_bytes, level), INDEX)
    index.write.parquet(f"{folder}/index")
    return pages.sparkSession.read.schema(INDEX).parquet(f"{folder}/index")


def read_bundles(index: DataFrame, with_payload: bool = False) -> DataFrame:
    """Every record of the indexed frames. Frames are dealt out evenly; digests and sizes of responses are computed from the bytes read."""
    frames = index.select("bundle", "frame").distinct()
    tasks = max(1, min(frames.count(), 4 * index.sparkSession.sparkContext.defaultParallelism))
    return frames.repartition(tasks, "bundle", "frame").mapInArrow(_reader(with_payload), RECORD)


def lookup(bundle: str, frame_start: int, offset: int) -> tuple[dict, bytes]:
    """Headers and block of one record: one seek, one frame. The seek table gives the sizes."""
    fs, path = open_store(bundle)
    with fs.open_input_file(path) as f:
        start, packed, raw = next(x for x in read_seek_table(f) if x[0] == frame_start)
        f.seek(start)
        data = zstandard.ZstdDecompressor().decompress(f.read(packed), max_output_size=raw)
    return next((h, b) for at, _, h, b in parse_records(data) if at == offset)


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = write_bundles(table(spark, sf_dir, "pages"), scratch(spark, "warc"))
    return read_bundles(index).select(F.col("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")




DIGIT = "substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((v >> {shift}) & 31 AS INTEGER) + 1, 1)"
OP6_SQL = f"""WITH p AS (SELECT page_id, coalesce(html, '') AS t FROM pages),
d AS (SELECT page_id, octet_length(encode(t)) AS n, sha1(t) AS h, max(page_id) OVER (PARTITION BY t) AS last FROM p),
g AS (SELECT page_id, k, CAST(concat('0x', substr(h, CAST(k * 5 + 1 AS INTEGER), 5)) AS INTEGER) AS v FROM d, range(0, 8) r(k)),
b AS (SELECT page_id, string_agg(concat({DIGIT.format(shift=15)}, {DIGIT.format(shift=10)}, {DIGIT.format(shift=5)}, {DIGIT.format(shift=0)}), '' ORDER BY k) AS payload_digest FROM g GROUP BY page_id)
SELECT d.page_id, CAST(n AS BIGINT) AS payload_bytes, payload_digest, CASE WHEN d.page_id = last THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN d.page_id <> last THEN last END AS refers_to FROM d JOIN b ON b.page_id = d.page_id"""
