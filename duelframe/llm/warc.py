"""WARC archives: a writer that stores repeated payloads once, and a reader that salvages damaged files."""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from duelframe.llm.common import cut_lineage, pieces, shared_folder

VERSION = b"WARC/1.1"
REVISIT_LEAST = 1000
#: A writer begins another archive beyond this size.
ARCHIVE_BYTES = 32 << 20
_CHUNK = 1 << 20
_VERSION_LINE = re.compile(rb"WARC/[0-9]+(?:\.[0-9]+)*\r\n")
#: What a record begins with: a gzip member or a version line.
_MARKS = (b"\x1f\x8b\x08", b"WARC/")
_DATE = b"2000-01-01T00:00:00Z"
_PROFILE = b"http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _sha1(data: bytes) -> bytes:
    return b"sha1:" + base64.b32encode(hashlib.sha1(data).digest())


def record_bytes(page_id, url: str | None, payload: bytes, digest: bytes, refers_to, revisit: bool, length: int) -> bytes:
    """One record: a response holds HTTP head and payload, a revisit the head alone (its Content-Length tells the payload's size)."""
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % length
    if not revisit:
        block += payload
    head = [
        VERSION, b"WARC-Type: " + (b"revisit" if revisit else b"response"), b"WARC-Record-ID: <urn:page:%s>" % str(page_id).encode(),
        b"WARC-Date: " + _DATE, b"WARC-Payload-Digest: " + digest, b"WARC-Block-Digest: " + _sha1(block),
        b"Content-Type: application/http;msgtype=response", b"Content-Length: %d" % len(block),
    ]
    if url:
        head.append(b"WARC-Target-URI: " + " ".join(url.split()).encode())
    if revisit:
        head += [b"WARC-Refers-To: <urn:page:%s>" % str(refers_to).encode(), b"WARC-Profile: " + _PROFILE]
    return b"\r\n".join(head) + b"\r\n\r\n" + block + b"\r\n\r\n"


@dataclass
class Record:
    """A record that passed all checks. ``start`` and ``end`` are byte offsets in the archive."""

    start: int
    end: int
    headers: dict[str, str]
    block: bytes

    @property
    def payload(self) -> bytes:
        return self.block.partition(b"\r\n\r\n")[2]


@dataclass
class Gap:
    """Bytes that belong to no valid record, and the first check that failed there."""

    start: int
    end: int
    reason: str


class _Window:
    """A sliding view of a stream: bytes from ``base`` on, read as they are needed."""

    def __init__(self, stream):
        self.stream, self.base, self.data, self.over = stream, 0, bytearray(), False
        #: For each mark where it was found last (-1: nowhere yet) and up to where it does not begin.
        self.seen: dict[bytes, tuple[int, int]] = {}
        #: The line found last; heads that begin before ``refused`` fail for the same reason as an earlier one.
        self.line, self.refused, self.reason = (0, -1), 0, ""

    def refuse(self, until: float, reason: str) -> _Damaged:
        self.refused, self.reason = until, reason
        return _Damaged(reason)

    def upto(self, end: int) -> bool:
        """True if the stream reaches absolute offset ``end``."""
        while not self.over and self.base + len(self.data) < end:
            more = self.stream.read(_CHUNK)
            self.over = not more
            self.data += more
        return self.base + len(self.data) >= end

    def get(self, start: int, end: int) -> bytes:
        self.upto(end)
        return bytes(self.data[start - self.base:end - self.base])

    def drop(self, start: int) -> None:
        if start - self.base > _CHUNK:
            del self.data[:start - self.base]
            self.base = start

    def find(self, marks: tuple[bytes, ...], start: int) -> int | None:
        """Where the first of the marks begins; bytes are let go only behind what was searched for all of them."""
        while True:
            for mark in marks:
                at, clear = self.seen.get(mark, (-1, 0))
                if at < start:
                    clear = max(clear, start)
                    at = self.data.find(mark, clear - self.base)
                    clear = max(clear, self.base + len(self.data) - len(mark) + 1)
                    self.seen[mark] = (self.base + at if at >= 0 else -1, clear if at < 0 else self.base + at)
            found = [at for at, _ in map(self.seen.get, marks) if at >= start]
            if found:
                return min(found)
            if self.over:
                return None
            self.drop(min(clear for _, clear in map(self.seen.get, marks)))
            self.upto(self.base + len(self.data) + 1)

    def line_end(self, start: int) -> int | None:
        """Where the line at ``start`` ends. Remembered, so that starts inside a long line do not search it again."""
        if not self.line[0] <= start <= self.line[1]:
            at = start
            while True:
                end = self.data.find(b"\r\n", at - self.base)
                if end >= 0:
                    self.line = (start, self.base + end)
                    break
                if self.over:
                    return None
                at = max(start, self.base + len(self.data) - 1)
                self.upto(self.base + len(self.data) + 1)
        return self.line[1]


class _Damaged(Exception):
    pass


def _lacks(headers: dict[str, str]) -> str | None:
    """The mandatory header that is missing."""
    length = headers.get("content-length", "")
    if not (length.isascii() and length.isdigit()):
        return "no content length"
    return next((f"no {name}" for name in ("warc-type", "warc-record-id", "warc-date") if not headers.get(name)), None)


def _head(data: bytes) -> tuple[dict[str, str], int]:
    end = data.find(b"\r\n\r\n")
    if end < 0:
        raise _Damaged("head without end")
    first, *lines = data[:end].split(b"\r\n")
    if not first.startswith(b"WARC/") or not first[5:].replace(b".", b"").isdigit():
        raise _Damaged("no version line")
    headers = {}
    for line in lines:
        name, colon, value = line.partition(b":")
        if not colon:
            raise _Damaged("header line without colon")
        headers[name.strip().lower().decode("utf-8", "replace")] = value.strip().decode("utf-8", "replace")
    lacks = _lacks(headers)
    if lacks:
        raise _Damaged(lacks)
    return headers, end + 4


def _check(headers: dict[str, str], block: bytes) -> None:
    want = headers.get("warc-block-digest")
    if want and want.startswith("sha1:") and want.encode() != _sha1(block):
        raise _Damaged("block digest differs")


def _plain(window: _Window, at: int) -> Record:
    """The uncompressed record at ``at``.

    The head is read line by line. One that fails at some line, or ends without a length, says so for all heads
    that begin before: their lines from there on are the same. So false version lines cost no second reading.
    """
    version = _VERSION_LINE.match(window.get(at, at + 32))
    if not version:
        raise _Damaged("no version line")
    if at < window.refused:
        raise _Damaged(window.reason)
    pos, headers = at + version.end(), {}
    while True:
        end = window.line_end(pos)
        if end is None:
            raise window.refuse(float("inf"), "head without end")
        if end == pos:
            break
        name, colon, value = window.get(pos, end).partition(b":")
        if not colon:
            raise window.refuse(pos, "header line without colon")
        headers[name.strip().lower().decode("utf-8", "replace")] = value.strip().decode("utf-8", "replace")
        pos = end + 2
    lacks = _lacks(headers)
    if lacks:
        raise window.refuse(pos, lacks)
    begin = pos + 2
    end = begin + int(headers["content-length"])
    if not window.upto(end + 4):
        raise _Damaged("record is cut off")
    if window.get(end, end + 4) != b"\r\n\r\n":
        raise _Damaged("no end of record")
    block = window.get(begin, end)
    _check(headers, block)
    return Record(at, end + 4, headers, block)


def _member(window: _Window, at: int) -> Record:
    """The record in the gzip member at ``at``."""
    if window.get(at, at + 3) != b"\x1f\x8b\x08":
        raise _Damaged("no gzip member")
    unpack, out, pos = zlib.decompressobj(31), [], at
    try:
        while not unpack.eof:
            # A short first look: most false marks end there.
            data = window.get(pos, pos + (1 << 16 if out else 1 << 9))
            if not data:
                raise _Damaged("member is cut off")
            out.append(unpack.decompress(data))
            pos += len(data)
            if len(out) == 1 and not out[0].startswith(b"WARC/"[:len(out[0])]):
                raise _Damaged("no version line")
    except zlib.error as e:
        raise _Damaged(f"gzip: {e}") from None
    data = b"".join(out)
    headers, size = _head(data)
    length = int(headers["content-length"])
    if data[size + length:] != b"\r\n\r\n":
        raise _Damaged("length of record differs")
    block = data[size:size + length]
    _check(headers, block)
    return Record(at, pos - len(unpack.unused_data), headers, block)


def salvage(stream) -> Iterator[Record | Gap]:
    """All valid records of an archive (gzip members or plain), and the gaps between them, in order.

    After a failed check the search goes on one byte further, for the next gzip member or version line that
    begins a valid record; what lies between is one gap. Both marks are sought in one pass forward. Records and
    gaps cover the archive without overlap. Memory is bounded by the longest record that a head announces.
    """
    window, at, lost, reason = _Window(stream), 0, None, ""
    while window.upto(at + 1):
        packed = window.get(at, at + 2) == b"\x1f\x8b"
        try:
            record = _member(window, at) if packed else _plain(window, at)
        except _Damaged as e:
            if lost is None:
                lost, reason = at, str(e)
            found = window.find(_MARKS, at + 1)
            if found is None:
                at = window.base + len(window.data)
                break
            at = found
            continue
        if lost is not None:
            yield Gap(lost, at, reason)
            lost = None
        yield record
        at = record.end
        window.drop(at)
    if lost is not None:
        yield Gap(lost, at, reason)


@dataclass
class _Writer:
    """Archives of one task; a retry writes the same names anew, and a file appears only when it is whole."""

    folder: str
    part: int
    number: int = 0
    held: list = field(default_factory=list)
    size: int = 0
    records: int = 0

    def add(self, record: bytes) -> None:
        pack = zlib.compressobj(6, zlib.DEFLATED, 31)
        data = pack.compress(record) + pack.flush()
        self.held.append(data)
        self.size += len(data)
        self.records += 1

    def close(self) -> tuple[str, int, int] | None:
        if not self.records:
            return None
        name = f"{self.folder}/part-{self.part:06d}-{self.number:04d}.warc.gz"
        attempt = TaskContext.get().taskAttemptId()
        files, path = pafs.FileSystem.from_uri(name)
        files.create_dir(path.rpartition("/")[0], recursive=True)
        with files.open_output_stream(f"{path}.{attempt}.open") as out:
            for data in self.held:
                out.write(data)
        files.move(f"{path}.{attempt}.open", path)
        done = (name, self.records, self.size)
        self.number, self.held, self.size, self.records = self.number + 1, [], 0, 0
        return done


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Writes one record per row of page_id, url, html and returns the stored list of (path, records, bytes).

    The payload is the html in UTF-8, empty for null. Of equal payloads of at least REVISIT_LEAST bytes the one
    with the largest page_id becomes a response and the others revisits of it; rows that repeat that page_id
    are responses too. Null ids count as smallest. ``folder`` must be one that all executors share.
    """
    payload: Column = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload"))
    heads = rows.filter(F.octet_length("payload") >= REVISIT_LEAST).groupBy("digest").agg(
        F.max("page_id").alias("head"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("digest", "head")
    rows = rows.join(cut_lineage(heads), "digest", "left")
    revisit = F.coalesce(F.col("head").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("head")), F.lit(False))

    def write(batches):
        writer = _Writer(folder, TaskContext.get().partitionId())
        done = []
        for batch in pieces(batches, "payload"):
            for page_id, url, data, digest, head, again in zip(*(c.to_pylist() for c in batch.columns)):
                named = b"sha1:" + base64.b32encode(bytes.fromhex(digest))
                writer.add(record_bytes(page_id, url, data, named, head, again, len(data)))
                if writer.size >= ARCHIVE_BYTES:
                    done.append(writer.close())
        done.append(writer.close())
        done = [d for d in done if d]
        yield pa.RecordBatch.from_arrays(
            [pa.array([d[k] for d in done], t) for k, t in enumerate((pa.string(), pa.int64(), pa.int64()))], ["path", "records", "bytes"])

    given = rows.select("page_id", "url", "payload", "digest", "head", revisit.alias("again"))
    return cut_lineage(given.mapInArrow(write, "path string, records bigint, bytes bigint"))


def read_archives(archives: DataFrame, whole: bool = False) -> DataFrame:
    """Every valid record and every gap of the archives named in column ``path``, one archive per task at a time.

    ``whole``: the column ``records`` tells how many records an archive has; another number, or a gap, is an error.

    path, start, end; for records warc_type, record_id, target_uri, refers_to, payload_digest (hex of the
    header), http_length (Content-Length of the HTTP head), payload and its own digest; for gaps the reason.
    Payloads are not kept for revisits, which have none.
    """
    schema = (
        "path string, start bigint, end bigint, warc_type string, record_id string, target_uri string, refers_to string, "
        "payload_digest string, http_length bigint, payload binary, own_digest string, gap string"
    )
    names = [c.split()[0] for c in schema.split(", ")]
    types = [pa.string(), pa.int64(), pa.int64(), *[pa.string()] * 5, pa.int64(), pa.binary(), pa.string(), pa.string()]

    def packed(rows):
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names)

    def one(path: str, item: Record | Gap) -> tuple:
        if isinstance(item, Gap):
            return (path, item.start, item.end, *[None] * 8, item.reason)
        h = item.headers
        kind, digest = h.get("warc-type"), h.get("warc-payload-digest", "")
        digest = base64.b32decode(digest[5:]).hex() if digest.startswith("sha1:") and len(digest) == 37 else None
        http = [x for x in item.block.partition(b"\r\n\r\n")[0].split(b"\r\n") if x.lower().startswith(b"content-length:")]
        payload = None if kind == "revisit" else item.payload
        return (
            path, item.start, item.end, kind, h.get("warc-record-id"), h.get("warc-target-uri"), h.get("warc-refers-to"), digest,
            int(http[0].split(b":")[1]) if http else None, payload, None if payload is None else hashlib.sha1(payload).hexdigest(), None,
        )

    def read(batches):
        for batch in batches:
            for name, records in zip(batch.column("path").to_pylist(), batch.column("records").to_pylist()):
                files, path = pafs.FileSystem.from_uri(name)
                rows, size, seen = [], 0, 0
                with files.open_input_stream(path, compression=None) as stream:
                    for item in salvage(stream):
                        if whole and isinstance(item, Gap):
                            raise ValueError(f"{name}: bytes {item.start} to {item.end} are no record: {item.reason}")
                        seen += 1
                        rows.append(one(name, item))
                        size += len(rows[-1][9] or b"") + 500
                        if size > _CHUNK * 8:
                            yield packed(rows)
                            rows, size = [], 0
                if whole and seen != records:
                    raise ValueError(f"{name}: {seen} records were read, {records} were written")
                if rows:
                    yield packed(rows)

    return archives.select("path", (F.col("records") if whole else F.lit(None).cast("bigint")).alias("records")).mapInArrow(read, schema)


def archive_round_trip(pages: DataFrame) -> DataFrame:
    """Writes the pages to archives in the shared folder, reads these back and returns what the records tell.

    page_id, payload_bytes, payload_digest, record_type and refers_to (null for responses). A response tells
    size and digest of the payload that was read, a revisit those of its headers. A record that cannot be read
    back is an error.
    """
    archives = write_archives(pages, shared_folder(pages.sparkSession, "warc"))
    # A number is given, as adaptive execution would join tasks by the size of the names, not of the archives.
    records = read_archives(archives.repartition(max(archives.count(), 1)), whole=True)

    def page(column: str) -> Column:
        return F.regexp_extract(column, r"^<urn:page:(-?\d+)>$", 1).try_cast("bigint")

    response = F.col("warc_type") == "response"
    return records.select(
        page("record_id").alias("page_id"),
        F.when(response, F.octet_length("payload").cast("bigint")).otherwise(F.col("http_length")).alias("payload_bytes"),
        F.when(response, F.col("own_digest")).otherwise(F.col("payload_digest")).alias("payload_digest"),
        F.col("warc_type").alias("record_type"), page("refers_to").alias("refers_to"),
    )
