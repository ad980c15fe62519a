"""Legacy archives: write ARC files, and convert them to WARC with revisits.

An ARC record is one header line, whose fields depend on the version of the file, and as many
bytes as that line declares. ``convert`` parses those lines and lengths and synthesises what a
WARC record has and an ARC record lacks: a record id (a name-based UUID of file and place), an
ISO timestamp from the 14-digit date, a record type from URL scheme and payload, and SHA-1
block and payload digests. Archives are files of one gzip member per record in the shared
folder; tasks write under a name of their own attempt and rename when whole, and only files in
the written manifest are read, so a repeated or lost task leaves no half archive behind.

Which record of several with equal payloads is kept whole is decided on narrow rows (file,
place, digest); payloads are never shuffled. Digests are counted before they are joined, and
the join is salted, so that one payload may be in a third of all records.

Defined results: null html is an empty payload, a null url is ``urn:unknown``, and a null page
id is smaller than any other and reads back as null. Of equal records with equal ids the first
by file and place stays whole. An empty table gives no records. Further columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Callable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.tokens import slices
from corpusmill.session import materialize

# The record definition lines of the two ARC versions.
ARC_FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
LEVEL = 1
CHUNK = 1 << 20
FILE_BYTES = 64 << 20
MIN_REVISIT_BYTES = 1_000
SALTS = 16
MAX_TASKS = 10_000
NAMESPACE = uuid.UUID("8d3f0c4e-6d52-5b7a-9d55-0d6c3a1f7b11")

FILES = "file STRING, records BIGINT"
NARROW = "file STRING, place BIGINT, page_id BIGINT, payload_bytes BIGINT, digest STRING"
RECORDS = "page_id BIGINT, payload_bytes BIGINT, payload_digest STRING, record_type STRING, refers_to BIGINT, url STRING, date STRING"


def open_folder(path: str) -> tuple[pafs.FileSystem, str]:
    if "://" not in path and not path.startswith("file:"):
        return pafs.LocalFileSystem(), path.rstrip("/")
    filesystem, inner = pafs.FileSystem.from_uri(path)
    return filesystem, inner.rstrip("/")


class Archive:
    """One growing archive: a gzip member per record, published by a rename."""

    def __init__(self, folder: str, name: str):
        self.filesystem, root = open_folder(folder)
        self.filesystem.create_dir(root, recursive=True)
        self.name, self.final = name, f"{root}/{name}"
        self.staged = f"{root}/_{uuid.uuid4().hex}-{name}"
        self.sink = self.filesystem.open_output_stream(self.staged, compression=None)
        self.size = self.records = 0

    def add(self, record: bytes, count: int = 1) -> None:
        packer = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
        data = packer.compress(record) + packer.flush()
        self.sink.write(data)
        self.size += len(data)
        self.records += count

    def publish(self) -> tuple[str, int]:
        self.sink.close()
        self.filesystem.move(self.staged, self.final)
        return self.name, self.records


class Unpacked:
    """A byte stream over all gzip members of an archive, read in chunks."""

    def __init__(self, folder: str, name: str):
        filesystem, root = open_folder(folder)
        self.source = filesystem.open_input_stream(f"{root}/{name}", compression=None)
        self.member, self.ready, self.at = zlib.decompressobj(31), bytearray(), 0

    def read(self, n: int) -> bytes:
        while len(self.ready) - self.at < n:
            if not self._fill():
                raise EOFError(f"an archive ends {n - len(self.ready) + self.at} bytes early")
        found = bytes(self.ready[self.at : self.at + n])
        self.at += n
        if self.at > CHUNK:
            del self.ready[: self.at]
            self.at = 0
        return found

    def _fill(self) -> bool:
        data = self.source.read(CHUNK)
        if not data:
            return False
        while data:
            self.ready += self.member.decompress(data)
            data = b""
            if self.member.eof:
                data, self.member = self.member.unused_data, zlib.decompressobj(31)
        return True

    def line(self) -> bytes | None:
        """The next line without its end, or None at the end of the archive."""
        searched = self.at
        while (end := self.ready.find(b"\n", searched)) < 0:
            searched = len(self.ready)
            if not self._fill():
                rest = bytes(self.ready[self.at :])
                self.at = len(self.ready)
                return rest or None
        found = bytes(self.ready[self.at : end])
        self.at = end + 1
        return found


class ArcRecord(NamedTuple):
    place: int
    url: str
    ip: str
    date: str
    mime: str
    head: bytes
    payload: bytes

    @property
    def page_id(self) -> int | None:
        found = http_field(self.head, b"x-page-id")
        return int(found) if found else None

    @property
    def sha1(self) -> bytes:
        return hashlib.sha1(self.payload).digest()


def http_field(head: bytes, name: bytes) -> bytes | None:
    for line in head.split(b"\r\n")[1:]:
        key, _, value = line.partition(b":")
        if key.strip().lower() == name:
            return value.strip()
    return None


def arc_start(name: str, version: int) -> bytes:
    """The version block that opens an ARC file."""
    body = f"{version} 0 corpusmill\n{ARC_FIELDS[version]}\n\n".encode()
    fields = {"URL": f"filedesc://{name}", "IP-address": "0.0.0.0", "Archive-date": "20240101000000", "Content-type": "text/plain"}
    return arc_line(version, fields | {"Result-code": "200", "Filename": name}, len(body)) + body


def arc_line(version: int, fields: dict[str, str], length: int) -> bytes:
    values = [str(length) if f == "Archive-length" else fields.get(f, "-") for f in ARC_FIELDS[version].split()]
    return (" ".join(values) + "\n").encode()


def arc_file(folder: str, name: str) -> Iterator[ArcRecord]:
    """Records of one ARC file, by the declared fields and lengths of its version."""
    stream, fields, place = Unpacked(folder, name), ARC_FIELDS[1].split(), 0
    while (line := stream.line()) is not None:
        if not line.strip():
            continue
        if place == 0:
            # The version block is in the layout it declares; its last field is its length.
            block = stream.read(int(line.rsplit(b" ", 1)[1])).decode().split("\n")
            fields = block[1].split()
            place += 1
            continue
        # A URL may hold blanks, so the fixed number of later fields is cut off from the right.
        values = line.decode("utf-8").rsplit(" ", len(fields) - 1)
        found = dict(zip(fields, values, strict=True))
        body = stream.read(int(found["Archive-length"]))
        head, mark, payload = body.partition(b"\r\n\r\n") if body.startswith(b"HTTP/") else (b"", b"", body)
        yield ArcRecord(
            place, found["URL"], found["IP-address"], found["Archive-date"], found["Content-type"], head + mark, payload
        )
        place += 1


def write_arc(pages: DataFrame, folder: str, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Write ``pages`` as ARC files, versions 1 and 2 in turn; returns their manifest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, part, archive, done = TaskContext.get().partitionId(), 0, None, []
        version = 1 + task % 2
        for batch in slices(batches):
            for page_id, address, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if archive is None or archive.size > FILE_BYTES:
                    if archive is not None:
                        done.append(archive.publish())
                    name = f"part-{task:06d}-{part:04d}.arc.gz"
                    archive, part = Archive(folder, name), part + 1
                    archive.add(arc_start(name, version), 0)
                payload = (text or "").encode("utf-8")
                mark = "" if page_id is None else f"X-Page-Id: {page_id}\r\n"
                head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n{mark}Content-Length: {len(payload)}\r\n\r\n"
                body = head.encode() + payload
                shown = (address or "urn:unknown").replace("\r", "%0D").replace("\n", "%0A")
                fields = {
                    "URL": shown, "IP-address": "0.0.0.0", "Archive-date": "20240101000000",
                    "Content-type": "text/html", "Result-code": "200", "Filename": archive.name,
                    "Offset": str(archive.size),
                }
                archive.add(arc_line(version, fields, len(body)) + body + b"\n")
        if archive is not None:
            done.append(archive.publish())
        yield _rows(done, ("file", "records"), (pa.string(), pa.int64()))

    rows = pages.select(F.col(key).cast("bigint"), F.col(url).cast("string"), F.col(html).cast("string"))
    return materialize(rows.mapInArrow(run, FILES), "arc-files")


def _rows(rows: list[tuple], names: tuple[str, ...], types: tuple[pa.DataType, ...]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], list(names))


def _each_file(files: DataFrame) -> DataFrame:
    """A task per few files, dealt in turn; the manifest has one row per archive."""
    return files.repartition(max(1, min(files.count(), MAX_TASKS)))


def _reader(parse: Callable, names: tuple[str, ...], types: tuple[pa.DataType, ...], rows: int = 2_000):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file in batch.column("file").to_pylist():
                held = []
                for row in parse(file):
                    held.append(row)
                    if len(held) == rows:
                        yield _rows(held, names, types)
                        held = []
                yield _rows(held, names, types)

    return run


def scan_arc(files: DataFrame, folder: str) -> DataFrame:
    """Narrow rows (``NARROW``) of all ARC records."""

    def parse(file: str) -> Iterator[tuple]:
        for r in arc_file(folder, file):
            yield file, r.place, r.page_id, len(r.payload), r.sha1.hex()

    names = ("file", "place", "page_id", "payload_bytes", "digest")
    types = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string())
    return _each_file(files).mapInArrow(_reader(parse, names, types), NARROW)


def revisits(narrow: DataFrame, min_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """(file, place, kept page, kept file, kept place) of every record with an equal one kept whole elsewhere."""
    large = narrow.where(F.col("payload_bytes") >= min_bytes)
    by_page = F.struct(F.col("page_id").isNotNull().alias("known"), "page_id")
    top = large.groupBy("digest").agg(F.max(by_page).alias("top"), F.count(F.lit(1)).alias("n")).where("n > 1")
    salted = top.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    keyed = large.withColumn("salt", F.pmod(F.xxhash64("file", "place"), F.lit(SALTS)).cast("int"))
    met = keyed.join(salted, ["digest", "salt"])
    own = F.col("page_id").eqNullSafe(F.col("top.page_id"))
    first = met.where(own).groupBy("digest").agg(F.min(F.struct("file", "place")).alias("kept"))
    kept = first.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    itself = (F.col("file") == F.col("kept.file")) & (F.col("place") == F.col("kept.place"))
    return met.join(kept, ["digest", "salt"]).where(~itself).select(
        "file",
        "place",
        F.col("top.page_id").alias("kept_page"),
        F.col("kept.file").alias("kept_file"),
        F.col("kept.place").alias("kept_place"),
    )


def record_id(file: str, place: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, f'{file}#{place}')}>"


def iso_date(date: str) -> str:
    """The WARC form of a 14-digit ARC date; shorter dates are filled with their first instant."""
    full = date + "00000101000000"[len(date) :]
    return f"{full[:4]}-{full[4:6]}-{full[6:8]}T{full[8:10]}:{full[10:12]}:{full[12:14]}Z"


def base32(sha1: bytes) -> str:
    return "sha1:" + base64.b32encode(sha1).decode()


def warc_record(file: str, r: ArcRecord, kept: tuple | None) -> bytes:
    """One WARC record; ``kept`` is (page, file, place) of the record that holds the payload."""
    http = bool(r.head)
    block = r.head + (b"" if kept else r.payload)
    kind = "revisit" if kept else "response" if http else "resource"
    fields = [
        ("WARC-Type", kind),
        ("WARC-Record-ID", record_id(file, r.place)),
        ("WARC-Date", iso_date(r.date)),
        ("WARC-Target-URI", r.url),
        ("WARC-IP-Address", r.ip),
        ("Content-Type", "application/http; msgtype=response" if http else r.mime),
        ("WARC-Payload-Digest", base32(r.sha1)),
        ("WARC-Block-Digest", base32(hashlib.sha1(block).digest())),
    ]
    if kept:
        fields += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", record_id(kept[1], kept[2]))]
        fields += [] if kept[0] is None else [("X-Refers-To-Page-Id", str(kept[0]))]
    return warc_bytes(fields, block)


def warc_bytes(fields: list[tuple[str, str]], block: bytes) -> bytes:
    lines = "".join(f"{name}: {value}\r\n" for name, value in [*fields, ("Content-Length", str(len(block)))])
    return f"WARC/1.1\r\n{lines}\r\n".encode() + block + b"\r\n\r\n"


def warc_start(name: str) -> bytes:
    """The record that describes the file."""
    fields = [
        ("WARC-Type", "warcinfo"),
        ("WARC-Record-ID", record_id(name, 0)),
        ("WARC-Date", iso_date("2024")),
        ("WARC-Filename", name),
        ("Content-Type", "application/warc-fields"),
    ]
    return warc_bytes(fields, b"software: corpusmill\r\nformat: WARC File Format 1.1\r\n")


def convert(files: DataFrame, arc_folder: str, warc_folder: str, min_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """Write a WARC file for each ARC file of the manifest; returns the manifest of WARC files."""
    narrow = materialize(scan_arc(files, arc_folder), "arc-records")
    repeats = revisits(narrow, min_bytes)
    # At most as many entries as the archive has records.
    entry = F.struct("place", "kept_page", "kept_file", "kept_place")
    per_file = repeats.groupBy("file").agg(F.collect_list(entry).alias("repeats"))
    # Dealt after the join, by a given number, so that adaptive execution leaves the tasks apart.
    jobs = files.join(per_file, "file", "left").repartition(max(1, min(files.count(), MAX_TASKS)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done = []
        for batch in batches:
            for file, found in zip(batch.column("file").to_pylist(), batch.column("repeats").to_pylist(), strict=True):
                kept = {e["place"]: (e["kept_page"], e["kept_file"], e["kept_place"]) for e in found or ()}
                name = file.replace(".arc", ".warc")
                archive = Archive(warc_folder, name)
                archive.add(warc_start(name), 0)
                for r in arc_file(arc_folder, file):
                    archive.add(warc_record(file, r, kept.get(r.place)))
                done.append(archive.publish())
        yield _rows(done, ("file", "records"), (pa.string(), pa.int64()))

    return materialize(jobs.select("file", "repeats").mapInArrow(run, FILES), "warc-files")


def warc_file(folder: str, name: str) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields in lower case, block) of each record of one WARC file."""
    stream = Unpacked(folder, name)
    while (line := stream.line()) is not None:
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"{name}: not a record: {line[:60]!r}")
        fields = {}
        while (line := stream.line()) is not None and line.strip():
            key, _, value = line.decode("utf-8").partition(":")
            fields[key.strip().lower()] = value.strip()
        yield fields, stream.read(int(fields["content-length"]))


def read_warc(files: DataFrame, folder: str) -> DataFrame:
    """Rows (``RECORDS``) of all response, resource and revisit records, digests checked."""

    def parse(file: str) -> Iterator[tuple]:
        for fields, block in warc_file(folder, file):
            kind = fields["warc-type"]
            if kind == "warcinfo":
                continue
            if fields["warc-block-digest"] != base32(hashlib.sha1(block).digest()):
                raise ValueError(f"{file}: the block of {fields['warc-record-id']} is damaged")
            head, _, payload = block.partition(b"\r\n\r\n") if kind != "resource" else (b"", b"", block)
            stated = base64.b32decode(fields["warc-payload-digest"].removeprefix("sha1:"))
            if kind != "revisit" and hashlib.sha1(payload).digest() != stated:
                raise ValueError(f"{file}: the payload of {fields['warc-record-id']} is damaged")
            size = int(http_field(head, b"content-length")) if kind == "revisit" else len(payload)
            page, refers = http_field(head, b"x-page-id"), fields.get("x-refers-to-page-id")
            yield (
                int(page) if page else None, size, stated.hex(), kind, int(refers) if refers else None,
                fields["warc-target-uri"], fields["warc-date"],
            )

    names = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "date")
    types = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string())
    return _each_file(files).mapInArrow(_reader(parse, names, types), RECORDS)

