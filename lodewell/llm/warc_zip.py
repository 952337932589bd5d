"""WARC records in ZIP archives: writing, and reading by ranges without extraction.

An archive holds two stored members, the records and an index of their places. The reader takes the end of the
file, the central directory (ZIP64 where sizes call for it), the index, and then each record's own bytes.
"""

from __future__ import annotations

import hashlib
import io
import json
import struct
import uuid
import zipfile
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodewell.sources.tables import materialize, scratch_path

RECORDS, INDEX = "archive/data.warc", "indexes/index.cdxj"
LEAST_REVISIT = 100  # bytes: equal payloads below this are all written in full

_DATE = "2024-01-01T00:00:00Z"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

# Signatures and lengths of the ZIP format.
END, END64, LOCATOR64, CENTRAL, LOCAL = b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07", b"PK\x01\x02", b"PK\x03\x04"
END_BYTES, LOCATOR_BYTES, END64_BYTES, CENTRAL_BYTES, LOCAL_BYTES = 22, 20, 56, 46, 30
FULL16, FULL32 = 0xFFFF, 0xFFFFFFFF

Read = Callable[[int, int], bytes]


@dataclass(frozen=True)
class Member:
    name: str
    method: int
    size: int
    stored: int
    header: int

    def start(self, read: Read) -> int:
        """Where the member's bytes begin, behind its local header."""
        if self.method != 0:
            raise ValueError(f"{self.name} is compressed; only stored members can be read by ranges")
        head = read(self.header, LOCAL_BYTES)
        if head[:4] != LOCAL:
            raise ValueError(f"no local header of {self.name} at {self.header}")
        name, extra = struct.unpack("<HH", head[26:30])
        return self.header + LOCAL_BYTES + name + extra


def directory(read: Read, size: int) -> dict[str, Member]:
    """The members of an archive of `size` bytes, from its central directory."""
    tail_at = max(0, size - END_BYTES - FULL16)
    tail = read(tail_at, size - tail_at)
    at = tail.rfind(END)
    while at >= 0 and at + END_BYTES + struct.unpack("<H", tail[at + 20 : at + 22].ljust(2, b"\0"))[0] != len(tail):
        at = tail.rfind(END, 0, at)
    if at < 0:
        raise ValueError("no end of a central directory: not a ZIP archive, or cut off")
    count, length, offset = struct.unpack("<HII", tail[at + 10 : at + 20])
    end = tail_at + at
    if FULL16 == count or FULL32 in (length, offset):
        locator = read(end - LOCATOR_BYTES, LOCATOR_BYTES) if end >= LOCATOR_BYTES else b""
        if locator[:4] == LOCATOR64:
            record = read(struct.unpack("<Q", locator[8:16])[0], END64_BYTES)
            if record[:4] != END64:
                raise ValueError("no ZIP64 end of a central directory where its locator points")
            count, length, offset = struct.unpack("<QQQ", record[32:56])
    data, members, at = read(offset, length), {}, 0
    for _ in range(count):
        if data[at : at + 4] != CENTRAL:
            raise ValueError("the central directory is damaged")
        method, stored, whole = struct.unpack("<H8xII", data[at + 10 : at + 28])
        name_bytes, extra_bytes, comment_bytes = struct.unpack("<HHH", data[at + 28 : at + 34])
        header = struct.unpack("<I", data[at + 42 : at + 46])[0]
        begin = at + CENTRAL_BYTES
        name = data[begin : begin + name_bytes].decode("utf-8")
        extra = data[begin + name_bytes : begin + name_bytes + extra_bytes]
        whole, stored, header = _wide(extra, [whole, stored, header])
        members[name] = Member(name, method, whole, stored, header)
        at = begin + name_bytes + extra_bytes + comment_bytes
    return members


def _wide(extra: bytes, values: list[int]) -> list[int]:
    """Values of which those that are full are replaced, in order, by the ZIP64 extra field's."""
    at = 0
    while at + 4 <= len(extra):
        kind, length = struct.unpack("<HH", extra[at : at + 4])
        if kind == 1:
            wide = iter(struct.unpack(f"<{length // 8}Q", extra[at + 4 : at + 4 + length // 8 * 8]))
            return [next(wide, v) if v == FULL32 else v for v in values]
        at += 4 + length
    return values


def record(page: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """A response, or a revisit of the record that `refers_to` names, which holds the HTTP header only."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if refers_to is None else http
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{'' if page is None else page}>",
        f"WARC-Date: {_DATE}",
        f"WARC-Payload-Digest: sha256:{digest}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if url is not None:
        lines.append("WARC-Target-URI: " + " ".join(url.split()))
    if refers_to is not None:
        lines += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {_PROFILE}"]
    return ("\r\n".join(lines) + "\r\n\r\n").encode("utf-8", "replace") + block + b"\r\n\r\n"


def parse(data: bytes) -> dict:
    """Fields of one record; the payload is checked against its digest."""
    head, _, block = data.partition(b"\r\n\r\n")
    version, *lines = head.decode("utf-8").split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(line.split(": ", 1) for line in lines)
    block = block[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    length = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    digest = fields["WARC-Payload-Digest"].removeprefix("sha256:")
    if fields["WARC-Type"] == "response" and (len(payload) != length or hashlib.sha256(payload).hexdigest() != digest):
        raise ValueError(f"the payload of {fields['WARC-Record-ID']} does not match its digest")
    page = lambda name: int(p) if (p := fields.get(name, "")[len("<urn:page:") : -1]) else None
    return {
        "page_id": page("WARC-Record-ID"),
        "url": fields.get("WARC-Target-URI"),
        "payload_bytes": length,
        "payload_digest": digest,
        "record_type": fields["WARC-Type"],
        "refers_to": page("WARC-Refers-To"),
        "payload": payload if fields["WARC-Type"] == "response" else None,
    }


def archive(records: list[bytes]) -> bytes:
    """A ZIP archive of the records and their index, both stored."""
    index, at = [], 0
    for r in records:
        index.append(json.dumps({"offset": at, "length": len(r)}))
        at += len(r)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED, allowZip64=True) as package:
        package.writestr(zipfile.ZipInfo(RECORDS), b"".join(records))
        package.writestr(zipfile.ZipInfo(INDEX), "\n".join(index))
    return out.getvalue()


def read_archive(read: Read, size: int, range_bytes: int = 4 << 20) -> Iterator[dict]:
    """The records of an archive. Neighbours are read together, in ranges of at most `range_bytes` or of one record."""
    members = directory(read, size)
    index, records = members[INDEX], members[RECORDS]
    begin = records.start(read)
    places = [json.loads(line) for line in read(index.start(read), index.size).decode().split("\n") if line]
    places = [(p["offset"], p["length"]) for p in places]
    at = 0
    while at < len(places):
        start, last = places[at][0], at + 1
        while last < len(places) and places[last][0] == sum(places[last - 1]) and sum(places[last]) - start <= range_bytes:
            last += 1
        data = read(begin + start, sum(places[last - 1]) - start)
        for offset, length in places[at:last]:
            yield parse(data[offset - start : offset - start + length])
        at = last


def write_archives(pages: DataFrame, folder: str, *, key: str = "page_id", url: str = "url", html: str = "html", archive_bytes: int = 16 << 20) -> DataFrame:
    """Write each row of `pages` as a record into archives below `folder`; (path, bytes, records) of each archive.

    A payload of any length is one record, an empty table gives no archive, and other columns, whatever their names, are
    left out.

    `folder` is a URI that driver and executors share. A null html is an empty payload. Of equal payloads of at
    least 100 bytes the rows with the smallest key are responses and the others revisit them; smaller payloads,
    and rows with a null key, are all responses. A task writes files of its own names and lists them only when
    it ends, so that a repeated task leaves at most files that no row names.
    """
    payload = F.coalesce(F.col(html), F.lit(""))
    rows = pages.select(F.col(key).cast("long").alias("page"), F.col(url).cast("string").alias("url"), payload.cast("binary").alias("payload"), F.sha2(payload, 256).alias("digest"))
    large = F.octet_length("payload") >= LEAST_REVISIT
    firsts = rows.where(large & F.col("page").isNotNull()).groupBy("digest").agg(F.min("page").alias("first"), F.count("*").alias("n"))
    # Written, so that both sides of the join are plain exchanges and a payload that many pages share can be split.
    firsts = materialize(firsts.where("n > 1").drop("n"), "firsts")
    revisit = large & (F.col("page") != F.col("first"))
    rows = rows.join(firsts, "digest", "left").withColumn("refers_to", F.when(revisit, F.col("first")))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = pa.fs.FileSystem.from_uri(folder)
        files.create_dir(root, recursive=True)
        pending, size = [], 0

        def flush() -> pa.RecordBatch:
            name, data = f"{uuid.uuid4().hex}.zip", archive(pending)
            with files.open_output_stream(f"{root}/{name}") as out:
                out.write(data)
            return pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name}"]), pa.array([len(data)]), pa.array([len(pending)])], names=["path", "bytes", "records"])

        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("page", "url", "payload", "digest", "refers_to")), strict=True):
                pending.append(record(*row))
                size += len(pending[-1])
                if size >= archive_bytes:
                    yield flush()
                    pending, size = [], 0
        if pending:
            yield flush()

    written = rows.select("page", "url", "payload", "digest", "refers_to").mapInArrow(write, "path string, bytes long, records long")
    return materialize(written, "archives")


def read_archives(archives: DataFrame, *, payloads: bool = False, task_bytes: int = 64 << 20, range_bytes: int = 4 << 20) -> DataFrame:
    """Every record of the archives that `archives` (path, bytes) lists: page_id, url, payload_bytes, payload_digest,
    record_type, refers_to, and with `payloads` the payload of responses. A damaged archive fails the job; no archives
    give no rows. Archives are packed into tasks of about `task_bytes`, or into as many as the cluster runs at once."""
    fields = [("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())]
    fields += [("payload", pa.binary())] * payloads
    schema = pa.schema(fields)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                files, name = pa.fs.FileSystem.from_uri(path)
                with files.open_input_file(name) as file:
                    rows = []
                    for found in read_archive(lambda at, n, file=file: file.read_at(n, at), file.size(), range_bytes):
                        rows.append(found)
                        if len(rows) >= 1000:
                            yield pa.RecordBatch.from_pylist(rows, schema)
                            rows = []
                    yield pa.RecordBatch.from_pylist(rows, schema)

    ddl = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", payload binary" * payloads
    n, total = archives.agg(F.count("*"), F.coalesce(F.sum("bytes"), F.lit(0))).first()
    tasks = min(n, max(archives.sparkSession.sparkContext.defaultParallelism, -(-total // task_bytes)))
    dealt = archives.select("path").repartition(max(1, tasks))
    return dealt.mapInArrow(read, ddl)


def round_trip(pages: DataFrame, **columns) -> DataFrame:
    """Write `pages` to archives in the shared folder and read all records back, one row per row of `pages`.

    Nulls, ties, empty and repeated payloads, an empty table and other columns are treated as in `write_archives`.
    """
    return read_archives(write_archives(pages, scratch_path(pages.sparkSession, "warc"), **columns))
