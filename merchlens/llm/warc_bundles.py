"""WARC archives as seekable Zstandard bundles.

Records are grouped into independent frames of about ``frame_bytes``; a
bundle is a file of frames with a footer seek table (the skippable frame of
the seekable format: sizes of every frame). An index row maps each record to
(bundle, frame, offset inside the frame), so one record costs one frame.

Of pages with equal payloads of at least ``least`` bytes the one with the
smallest id is a response and the others are revisits of it, without payload;
everything else is a response. Payload digests are counted before payloads
move, and a group of copies of any size is one row of that count.

Each task writes its own bundles into the shared folder under names of its
attempt; only the index of finished tasks names files, so a lost executor
leaves no half bundle in use.

Defined results: a null payload is empty; a null url is the record's id; rows
with the smallest id of their group are responses even if that id repeats; a
null id is never the smallest unless all are. An empty table gives no bundle.
Other columns are not archived.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterable, Iterator
from urllib.parse import quote

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from merchlens.llm.files import map_file, write_file
from merchlens.llm.shared import new_folder, small_batches, written

SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1  # magic numbers of the seekable format
FRAME_BYTES, BUNDLE_BYTES = 256 << 10, 64 << 20
LEAST = 100
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def record(page: str, url: str | None, payload: bytes, digest: str, refers_to: str | None, date: str = DATE) -> bytes:
    """One WARC record; a revisit has the HTTP header with the payload's length, but no payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if refers_to is None else http
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{page}>", f"WARC-Date: {date}",
             f"WARC-Target-URI: {quote(url, safe=':/?#[]@!$&()*+,;=%~') if url else f'urn:page:{page}'}"]
    if refers_to is not None:
        lines += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {PROFILE}"]
    lines += [f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """Headers, HTTP headers and payload of one record."""
    def fields(raw: bytes) -> dict[str, str]:
        return dict(line.split(": ", 1) for line in raw.decode().split("\r\n")[1:])

    head, _, rest = data.partition(b"\r\n\r\n")
    headers = fields(head)
    http, _, payload = rest[:int(headers["Content-Length"])].partition(b"\r\n\r\n")
    return headers, fields(http), payload


def seek_table(sizes: list[tuple[int, int]]) -> bytes:
    """Footer of a bundle: compressed and plain size of every frame."""
    body = b"".join(struct.pack("<II", *s) for s in sizes) + struct.pack("<IBI", len(sizes), 0, SEEKABLE)
    return struct.pack("<II", SKIPPABLE, len(body)) + body


def frame_places(bundle) -> list[tuple[int, int, int]]:
    """Start, compressed and plain size of every frame, from the footer alone."""
    n, flags, magic = struct.unpack("<IBI", bundle[-9:])
    if magic != SEEKABLE or flags:
        raise ValueError("not a seekable bundle")
    out, at = [], 0
    table = bundle[len(bundle) - 9 - 8 * n:len(bundle) - 9]
    for packed, plain in struct.iter_unpack("<II", table):
        out.append((at, packed, plain))
        at += packed
    return out


def read_frame(bundle, place: tuple[int, int, int]) -> bytes:
    at, packed, plain = place
    return zstandard.ZstdDecompressor().decompress(bytes(bundle[at:at + packed]), max_output_size=plain) if plain else b""


def _writer(folder: str, frame_bytes: int, bundle_bytes: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(level=3)
        frames: list[bytes] = []
        sizes: list[tuple[int, int]] = []
        rows: list[tuple] = []
        open_frame: list[bytes] = []
        held = plain = 0

        def close_frame() -> None:
            nonlocal open_frame, held, plain
            data = b"".join(open_frame)
            frames.append(packer.compress(data))
            sizes.append((len(frames[-1]), len(data)))
            open_frame, held, plain = [], 0, plain + len(data)

        def close_bundle() -> pa.RecordBatch:
            nonlocal frames, sizes, rows, plain
            path = write_file(f"{folder}/bundle", [*frames, seek_table(sizes)])
            out = pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([path] * len(rows), pa.string()),
                                              *(pa.array([r[i] for r in rows], pa.int32()) for i in (1, 2, 3))],
                                             names=["record", "bundle", "frame", "offset", "length"])
            frames, sizes, rows, plain = [], [], [], 0
            return out

        for batch in batches:
            for page, url, html, digest, refers_to in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                data = record(page, url, html.encode(), digest, refers_to)
                if held and held + len(data) > frame_bytes:
                    close_frame()
                    if plain >= bundle_bytes:
                        yield close_bundle()
                rows.append((page, len(frames), held, len(data)))
                open_frame.append(data)
                held += len(data)
        if held:
            close_frame()
        if rows:
            yield close_bundle()

    return run


def write_bundles(pages: DataFrame, id: str = "page_id", url: str = "url", payload: str = "html", least: int = LEAST,
                  frame_bytes: int = FRAME_BYTES, bundle_bytes: int = BUNDLE_BYTES) -> DataFrame:
    """Archive all pages; the index: ``record`` (id as text), ``bundle``, ``frame``, ``offset``, ``length``."""
    small_batches(pages.sparkSession)
    body = F.coalesce(F.col(payload), F.lit(""))
    rows = pages.select(F.col(id).alias("id"), F.col(url).cast("string").alias("url"), body.alias("html"), F.sha2(body.cast("binary"), 256).alias("digest"))
    first = rows.where(F.octet_length("html") >= least).groupBy("digest").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    refers = F.when(F.col("first").isNotNull() & ~F.col("id").eqNullSafe(F.col("first")), F.col("first").cast("string"))
    records = rows.join(first, "digest", "left").select(F.coalesce(F.col("id").cast("string"), F.lit("null")), "url", "html", "digest", refers)
    made = records.mapInArrow(_writer(new_folder(pages.sparkSession, "warc"), frame_bytes, bundle_bytes), "record string, bundle string, frame int, offset int, length int")
    return written(made, "warc-index")


_READ = "record string, record_type string, payload_bytes bigint, payload_digest string, refers_to string, url string, payload binary"


def _reader(with_payload: bool):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path = number = bundle = places = frame = None
        for batch in batches:
            rows = []
            for of, at, offset, length in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if of != path:
                    path, number, bundle = of, None, map_file(of)
                    places = frame_places(bundle)
                if at != number:
                    number, frame = at, read_frame(bundle, places[at])
                headers, http, payload = parse(frame[offset:offset + length])
                kind, digest = headers["WARC-Type"], headers["WARC-Payload-Digest"].removeprefix("sha256:")
                if kind == "response" and hashlib.sha256(payload).hexdigest() != digest:
                    raise ValueError(f"damaged record {headers['WARC-Record-ID']} in {path}")
                refers_to = headers.get("WARC-Refers-To")
                rows.append((headers["WARC-Record-ID"][10:-1], kind, int(http["Content-Length"]), digest, refers_to and refers_to[10:-1],
                             headers["WARC-Target-URI"], payload if with_payload and kind == "response" else None))
            kinds = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)],
                                             names=["record", "record_type", "payload_bytes", "payload_digest", "refers_to", "url", "payload"])
    return run


def read_bundles(index: DataFrame, with_payload: bool = True) -> DataFrame:
    """Every record that ``index`` names, read by frame and offset; responses are checked against their digest."""
    small_batches(index.sparkSession)
    # A task a bundle: index rows are so small that Spark's own sizing would put them all into one.
    bundles = max(1, index.select("bundle").distinct().count())
    ordered = index.select("bundle", "frame", "offset", "length").repartitionByRange(bundles, "bundle").sortWithinPartitions("bundle", "frame", "offset")
    return ordered.mapInArrow(_reader(with_payload), _READ)
