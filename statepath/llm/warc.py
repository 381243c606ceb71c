"""WARC archives: one gzip member per record, written and read by many tasks.

Writing: of rows with equal payloads, the one with the largest id becomes a response; the
others become revisits that refer to it. Every task writes archives of its own into the
shared folder and reports them; only archives that successful tasks reported count, so
what a lost or repeated attempt left behind is never read.

Reading: archives are cut into byte ranges without regard to records. A task scans its
range for the gzip magic, and tries to decode a member at each candidate: one that begins
with a WARC header, is complete, and is followed by another such member or the end of
the archive, is a record. A task owns the records that start inside its range and reads
the last one to its end. A header may be of any length. The writer reports where records
start, and a range in which another number of records is found is an error.

A record that holds an uncompressed archive could deceive a range that starts inside it.
The writer always compresses, and a payload of text cannot contain the magic.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from statepath.llm.common import attach_groups, pieces, shared_files, ship_code
from statepath.storage import materialize, new_path

RANGE_BYTES = 8 << 20
ARCHIVE_BYTES = 1 << 30
# Payload bytes that leave a task in one Arrow batch.
BATCH_BYTES = 4 << 20
# Fixed values of the formats.
MAGIC = b"\x1f\x8b\x08"
VERSION = b"WARC/1.1\r\n"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_CONTROL = re.compile(r"[\x00-\x20\x7f]")
_HEADER_END = b"\r\n\r\n"
_READ = 1 << 20

RECORD = (
    "record_id string, record_type string, target_uri string, refers_to string, "
    "payload_digest string, payload_length long, payload binary"
)
_NAMES = [c.split(" ")[0] for c in RECORD.split(", ")]


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_uri(row_id: int | None) -> str:
    return f"urn:page:{'' if row_id is None else row_id}"


def member(
    row_id: int | None, url: str | None, payload: bytes, digest: str, original: int | None, date: str
) -> bytes:
    """A record as a gzip member: a revisit if ``original`` is given, else a response."""
    revisit = original is not None
    http = (
        "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
        f"Content-Length: {len(payload)}\r\n\r\n"
    ).encode()
    block = http if revisit else http + payload
    lines = [
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <{record_uri(row_id)}>",
        f"WARC-Date: {date}",
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if url is not None:
        safe = _CONTROL.sub(lambda m: f"%{ord(m[0]):02X}", url)
        lines.append(f"WARC-Target-URI: {safe}")
    if revisit:
        lines += [f"WARC-Refers-To: <{record_uri(original)}>", f"WARC-Profile: {REVISIT_PROFILE}"]
    head = VERSION + "\r\n".join(lines).encode() + _HEADER_END
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(head + block + _HEADER_END) + packer.flush()


def write_archives(
    pages: DataFrame,
    path: str,
    row_id: str = "page_id",
    url: str = "url",
    payload: str = "html",
    date: str = "1970-01-01T00:00:00Z",
    archive_bytes: int = ARCHIVE_BYTES,
) -> DataFrame:
    """Write a record per row under ``path``; returns the archives: file, n_bytes,
    n_records, and starts of the records.

    ``payload`` is a string column, written in UTF-8; null counts as empty. Rows of equal
    payloads that share the largest id, or all of them if none has an id, are responses.
    Control characters and spaces in a url are percent-encoded; a null url is left out.
    """
    spark = pages.sparkSession
    ship_code(spark)
    content = F.coalesce(F.col(payload), F.lit(""))
    keyed = pages.select(
        F.col(row_id).cast("long").alias("id"), F.col(url).alias("url"),
        content.alias("payload"), F.sha2(content, 256).alias("content_key"),
    )
    copies = (
        keyed.groupBy("content_key")
        .agg(F.max("id").alias("original"), F.count(F.lit(1)).alias("n"))
        .where("n > 1")
    )
    rows = attach_groups(keyed, copies, "content_key", "n", F.col("id")).withColumn(
        "original", F.when(~F.col("id").eqNullSafe(F.col("original")), F.col("original"))
    )

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = shared_files(path)
        files.create_dir(root)
        stream = name = None
        written, starts = 0, []
        done = []
        for batch in batches:
            for piece in pieces(batch, "payload"):
                columns = (piece.column(c).to_pylist() for c in ("id", "url", "payload", "original"))
                for own, address, text, original in zip(*columns):
                    if stream is None:
                        name = f"{uuid.uuid4().hex}.warc.gz"
                        stream = files.open_output_stream(f"{root}/{name}", compression=None)
                    body = text.encode()
                    data = member(own, address, body, payload_digest(body), original, date)
                    stream.write(data)
                    starts.append(written)
                    written += len(data)
                    if written >= archive_bytes:
                        stream.close()
                        done.append((name, written, len(starts), starts))
                        stream, written, starts = None, 0, []
        if stream is not None:
            stream.close()
            done.append((name, written, len(starts), starts))
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.list_(pa.int64())]
        columns = zip(*done) if done else [()] * len(kinds)
        yield pa.RecordBatch.from_arrays(
            [pa.array(x, kind) for x, kind in zip(columns, kinds)],
            names=["file", "n_bytes", "n_records", "starts"],
        )

    chosen = rows.select("id", "url", "payload", "original")
    return materialize(chosen.mapInArrow(write, "file string, n_bytes long, n_records long, starts array<long>"))


@dataclass
class _Member:
    content: bytes
    end: int  # where the next member starts


class Archive:
    """Bytes of an archive, read forward in blocks from ``start``."""

    def __init__(self, source, size: int, start: int):
        self._source, self.size, self._start, self._data = source, size, start, b""
        source.seek(start)

    def forget(self, place: int) -> None:
        """Drop what lies before ``place``."""
        if place - self._start > _READ:
            self._data = self._data[place - self._start :]
            self._start = place

    def bytes_at(self, place: int, n: int) -> bytes:
        while self._start + len(self._data) < min(place + n, self.size):
            more = self._source.read(_READ)
            if not more:
                break
            self._data += more
        return self._data[place - self._start : place - self._start + n]

    def find_magic(self, place: int, stop: int) -> int | None:
        """The first magic that starts in [place, stop)."""
        while place < stop:
            block = self.bytes_at(place, min(_READ, stop - place) + len(MAGIC) - 1)
            found = block.find(MAGIC)
            if found >= 0:
                return place + found
            place += _READ
            self.forget(min(place, stop))
        return None

    def member_at(self, place: int, header_only: bool = False) -> _Member | None:
        """The member at ``place``, if a WARC record can be decoded there."""
        unpacker = zlib.decompressobj(31)
        content = bytearray()
        at, seen = place, 0
        try:
            while not unpacker.eof:
                block = self.bytes_at(at, 1 << 16)
                if not block:
                    return None
                at += len(block)
                content += unpacker.decompress(block)
                if not content.startswith(VERSION[: len(content)]):
                    return None
                if header_only and len(content) >= len(VERSION):
                    if content.find(_HEADER_END, max(0, seen - len(_HEADER_END) + 1)) >= 0:
                        return _Member(bytes(content), at)
                    seen = len(content)
        except zlib.error:
            return None
        if len(content) < len(VERSION) or _HEADER_END not in content:
            return None
        return _Member(bytes(content), at - len(unpacker.unused_data))


def records_in_range(archive: Archive, start: int, stop: int) -> Iterator[dict]:
    """The records that start in [start, stop), in order."""
    place = archive.find_magic(start, stop)
    sure = start == 0
    while place is not None and place < stop:
        own = archive.member_at(place)
        if own is not None and not sure:
            sure = own.end >= archive.size or archive.member_at(own.end, True) is not None
        if own is None or not sure:
            place = archive.find_magic(place + 1, stop)
            continue
        yield parse(own.content)
        archive.forget(own.end)
        place = archive.find_magic(own.end, stop) if own.end < stop else None


def parse(content: bytes) -> dict:
    """A record as the columns of RECORD; the payload is null for a revisit."""
    head, _, rest = content.partition(_HEADER_END)
    fields = {}
    for line in head.decode().split("\r\n")[1:]:
        name, _, value = line.partition(":")
        fields[name.strip().lower()] = value.strip()
    block = rest[: int(fields["content-length"])]
    http, _, payload = block.partition(_HEADER_END)
    lengths = re.search(rb"(?im)^content-length:\s*(\d+)", http)
    digest = fields.get("warc-payload-digest", "").removeprefix("sha1:")
    revisit = fields["warc-type"] == "revisit"
    if not revisit and digest and payload_digest(payload) != digest:
        raise ValueError(f"payload of {fields['warc-record-id']} does not match its digest")
    return {
        "record_id": fields["warc-record-id"].strip("<>"),
        "record_type": fields["warc-type"],
        "target_uri": fields.get("warc-target-uri"),
        "refers_to": fields["warc-refers-to"].strip("<>") if "warc-refers-to" in fields else None,
        "payload_digest": digest or None,
        "payload_length": int(lengths[1]) if revisit and lengths else len(payload),
        "payload": None if revisit else payload,
    }


def read_archives(
    spark: SparkSession, path: str, archives: DataFrame, range_bytes: int = RANGE_BYTES
) -> DataFrame:
    """One row per record of the listed archives (file, n_bytes) under ``path``.

    If the archives have starts, a range must hold as many records as start in it.
    """
    ship_code(spark)
    step = F.lit(range_bytes).cast("long")
    starts = F.col("starts") if "starts" in archives.columns else F.lit(None).cast("array<long>")
    ranges = archives.where("n_bytes > 0").select(
        "file", "n_bytes", starts.alias("starts"),
        F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_bytes") - 1, step)).alias("start"),
    )
    inside = F.filter("starts", lambda s: (s >= F.col("start")) & (s < F.col("start") + step))
    ranges = ranges.select(
        "file", "n_bytes", "start", F.when(F.col("starts").isNotNull(), F.size(inside)).alias("n_expected")
    )
    tasks = max(1, ranges.count())

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = shared_files(path)
        schema = pa.schema(
            [(n, pa.int64() if n == "payload_length" else pa.string()) for n in _NAMES[:-1]]
            + [("payload", pa.binary())]
        )
        for batch in batches:
            for own in batch.to_pylist():
                held, size, found = [], 0, 0
                with files.open_input_file(f"{root}/{own['file']}") as source:
                    archive = Archive(source, own["n_bytes"], own["start"])
                    stop = min(own["start"] + range_bytes, own["n_bytes"])
                    for record in records_in_range(archive, own["start"], stop):
                        held.append(record)
                        found += 1
                        size += len(record["payload"] or b"")
                        if size > BATCH_BYTES:
                            yield pa.RecordBatch.from_pylist(held, schema)
                            held, size = [], 0
                if own["n_expected"] not in (None, found):
                    raise ValueError(
                        f"{own['file']} from byte {own['start']}: {found} records read, {own['n_expected']} written"
                    )
                yield pa.RecordBatch.from_pylist(held, schema)

    return ranges.repartition(tasks).mapInArrow(read, RECORD)


def round_trip(pages: DataFrame, range_bytes: int = RANGE_BYTES, **columns: str) -> DataFrame:
    """Write archives of ``pages`` in the shared folder and read them back."""
    path = new_path(pages.sparkSession)
    archives = write_archives(pages, path, **columns)
    return read_archives(pages.sparkSession, path, archives, range_bytes)


def row_of(uri: str):
    """The row id of a record URI column; null if the row had none."""
    return F.regexp_extract(F.col(uri), "^urn:page:(-?[0-9]+)$", 1).try_cast("long")
