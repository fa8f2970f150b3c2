"""WARC (4): seekable Zstandard bundles of archived pages.

Records gather in frames of about ``FRAME`` bytes, each compressed alone, and frames in
bundles of about ``BUNDLE`` bytes. A bundle ends with a seek table (a skippable frame, so
that any Zstandard reader takes the file) that gives the sizes of all frames. The index
maps each record to its bundle, frame and offset within the frame, so that one record is
read by unpacking one frame.

Of pages with equal payloads, the one with the largest id is written as a response, the
others as revisits without payload that refer to it. Pages move by payload only if some
payload repeats; the join splits payloads with very many pages.

A bundle is written whole, under a name of its own, by the task attempt that made it; only
bundles that the index names count, and the index is committed by Spark, so attempts that
were lost leave at most an unused file.

Null html counts as the empty payload, null urls as empty. A page with a null id is written
like others and never chosen as response unless all its copies have null ids; then all of
them are responses. Rows that repeat id and payload of a response are responses too. An
empty table gives an empty result. Other columns make no difference.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, functions as F

from shelfgauge.llm.common import map_rows, pieces, store, whole
from shelfgauge.sources.shared_tables import new_path

FRAME = 1 << 18
BUNDLE = 1 << 25
#: Bytes of records that a task reads back, unpacked.
READ = 1 << 25
LEVEL = 3
DATE = "2024-01-01T00:00:00Z"

#: Fixed values of the seekable format: skippable-frame and seek-table magic numbers.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

INDEX = (
    "record_id string, bundle string, frame long, offset long, length long, "
    "record_type string, payload_bytes long"
)


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: object, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}:{digest}')}>"


def _clean(url: str) -> str:
    return "".join(c if c.isprintable() and c != " " else f"%{ord(c):02X}" for c in url)


def record(page_id: object, url: str, payload: bytes, refers_to: object, revisit: bool) -> tuple[str, bytes]:
    """Id and bytes of the record of a page."""
    digest = payload_digest(payload)
    own = record_id(page_id, digest)
    http = (
        "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
        f"Content-Length: {len(payload)}\r\n\r\n"
    ).encode()
    block = http if revisit else http + payload
    head = {
        "WARC-Type": "revisit" if revisit else "response",
        "WARC-Record-ID": own,
        "WARC-Date": DATE,
        "WARC-Target-URI": _clean(url),
        "WARC-Payload-Digest": f"sha1:{digest}",
        "Content-Type": "application/http; msgtype=response",
        "Content-Length": len(block),
        "X-Payload-Length": len(payload),
    }
    if page_id is not None:
        head["X-Page-ID"] = page_id
    if revisit:
        head |= {
            "WARC-Profile": PROFILE,
            "WARC-Refers-To": record_id(refers_to, digest),
            "X-Refers-To-Page-ID": refers_to,
        }
    lines = "".join(f"{name}: {value}\r\n" for name, value in head.items())
    return own, b"WARC/1.1\r\n" + lines.encode() + b"\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields and payload of a record."""
    head, _, block = raw.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    if version != "WARC/1.1":
        raise ValueError(f"Not a record: {version[:40]}")
    fields = dict(line.split(": ", 1) for line in lines)
    block = block[: int(fields["Content-Length"])]
    return fields, block.partition(b"\r\n\r\n")[2]


def seek_table(sizes: list[tuple[int, int]]) -> bytes:
    """The skippable frame that lists compressed and plain sizes of all frames."""
    entries = b"".join(struct.pack("<II", *pair) for pair in sizes)
    footer = struct.pack("<IBI", len(sizes), 0, SEEKABLE)
    return struct.pack("<II", SKIPPABLE, len(entries) + len(footer)) + entries + footer


class Bundle:
    """A bundle that is open for reading, frame by frame."""

    def __init__(self, path: str) -> None:
        system, place = fs.FileSystem.from_uri(path)
        self.file = system.open_input_file(place)
        size = self.file.size()
        n, _, magic = struct.unpack("<IBI", self._at(size - 9, 9))
        if magic != SEEKABLE:
            raise ValueError(f"No seek table: {path}")
        table = self._at(size - 9 - 8 * n, 8 * n)
        self.starts, at = [], 0
        for packed, _ in struct.iter_unpack("<II", table):
            self.starts.append((at, packed))
            at += packed

    def _at(self, offset: int, length: int) -> bytes:
        self.file.seek(offset)
        return self.file.read(length)

    def frame(self, number: int) -> bytes:
        return zstandard.ZstdDecompressor().decompress(self._at(*self.starts[number]))

    def close(self) -> None:
        self.file.close()


class Writer:
    """Gathers records; yields an index row for each when their bundle is written."""

    def __init__(self, folder: str, frame: int, bundle: int) -> None:
        self.folder, self.frame_size, self.bundle_size = folder, frame, bundle
        self.packer = zstandard.ZstdCompressor(level=LEVEL, write_checksum=True)
        self._open()

    def _open(self) -> None:
        self.path = f"{self.folder}/{uuid.uuid4().hex}.warc.zst"
        self.frames: list[bytes] = []
        self.sizes: list[tuple[int, int]] = []
        self.records: list[bytes] = []
        self.held = self.total = 0
        self.rows: list[tuple] = []
        info = b"software: shelfgauge\r\nformat: WARC File Format 1.1\r\n"
        head = (
            f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:{uuid.uuid4()}>\r\n"
            f"WARC-Date: {DATE}\r\nContent-Type: application/warc-fields\r\n"
            f"Content-Length: {len(info)}\r\n\r\n"
        )
        self._put(head.encode() + info + b"\r\n\r\n")

    def _put(self, raw: bytes) -> None:
        self.records.append(raw)
        self.held += len(raw)

    def _end_frame(self) -> None:
        if self.records:
            packed = self.packer.compress(b"".join(self.records))
            self.frames.append(packed)
            self.sizes.append((len(packed), self.held))
            self.total += self.held
            self.records, self.held = [], 0

    def add(self, own: str, raw: bytes, *rest: object) -> Iterator[tuple]:
        if self.held and self.held + len(raw) > self.frame_size:
            self._end_frame()
        self.rows.append((own, self.path, len(self.frames), self.held, len(raw), *rest))
        self._put(raw)
        if self.total + self.held >= self.bundle_size:
            yield from self.end()

    def end(self) -> Iterator[tuple]:
        """Write the bundle, if it has pages, and hand out its index rows."""
        if self.rows:
            self._end_frame()
            system, place = fs.FileSystem.from_uri(self.path)
            system.create_dir(place.rsplit("/", 1)[0], recursive=True)
            with system.open_output_stream(place, compression=None) as out:
                for frame in self.frames:
                    out.write(frame)
                out.write(seek_table(self.sizes))
            yield from self.rows
            self._open()


def _choices(pages: DataFrame) -> DataFrame:
    """Pages with ``target``, the page that holds their payload where several share it."""
    keyed = pages.select(
        "page_id", whole("url").alias("url"), whole("html").alias("html")
    ).withColumn("sha", F.sha1("html"))
    shared = (
        pages.select("page_id", F.sha1(whole("html")).alias("sha"))
        .groupBy("sha")
        .agg(F.max("page_id").alias("target"), F.count("*").alias("n"))
        .where("n > 1")
        .select("sha", "target")
    )
    return keyed.join(shared, "sha", "left").drop("sha")


def write_archive(
    pages: DataFrame, folder: str | None = None, frame: int = FRAME, bundle: int = BUNDLE
) -> DataFrame:
    """Write all pages as bundles below ``folder``; returns the index, a written table."""
    folder = new_path(pages.sparkSession, "warc", folder)
    chosen = _choices(pages)
    kind = chosen.schema["page_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        writer = Writer(folder, frame, bundle)
        for part in pieces(batches, "page_id", "url", "html", "target"):
            for page, url, html, target in zip(*part):
                payload = html.encode("utf-8", "surrogatepass")
                revisit = target is not None and target != page
                own, raw = record(page, url, payload, target, revisit)
                what = "revisit" if revisit else "response"
                yield from writer.add(own, raw, what, len(payload), page)
        yield from writer.end()

    return store(map_rows(chosen, f"{INDEX}, page_id {kind}", run), "warc-index")


def read_archive(index: DataFrame) -> DataFrame:
    """The records that ``index`` names, read from their frames: header fields and payload.

    A task reads its bundles one after the other, each frame once. The index is small beside
    what it names, so the number of tasks is set by the bytes of the records: about
    ``READ`` a task, a task for each bundle at most.
    """
    wanted = index.select("page_id", "bundle", "frame", "offset", "length")
    size = wanted.agg(F.sum("length").alias("total"), F.countDistinct("bundle").alias("bundles")).first()
    tasks = max(1, min(size.bundles, -(-(size.total or 0) // READ)))
    wanted = wanted.repartition(tasks, "bundle").sortWithinPartitions("bundle", "frame", "offset")
    kind = wanted.schema["page_id"].dataType.simpleString()
    schema = (
        f"page_id {kind}, record_id string, record_type string, payload_bytes long, "
        f"payload_digest string, refers_to {kind}, payload binary"
    )
    number = int if kind in ("bigint", "int", "smallint", "tinyint") else str

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        bundle = path = frame = None
        for part in pieces(batches, "bundle", "frame", "offset", "length"):
            for own, n, offset, length in zip(*part):
                if own != path:
                    if bundle:
                        bundle.close()
                    bundle, path, frame = Bundle(own), own, None
                if n != frame:
                    plain, frame = bundle.frame(n), n
                fields, payload = parse(plain[offset : offset + length])
                digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
                what = fields["WARC-Type"]
                if what == "response" and payload_digest(payload) != digest:
                    raise ValueError(f"Damaged record {fields['WARC-Record-ID']} in {own}")
                page, target = fields.get("X-Page-ID"), fields.get("X-Refers-To-Page-ID")
                yield (
                    None if page is None else number(page),
                    fields["WARC-Record-ID"],
                    what,
                    int(fields["X-Payload-Length"]),
                    digest,
                    None if target is None else number(target),
                    payload if what == "response" else None,
                )
        if bundle:
            bundle.close()

    return map_rows(wanted, schema, run)
