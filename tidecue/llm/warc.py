"""WARC archives: writing pages with revisit records, and a reader that salvages damaged archives.

Writing is done by Spark's text sink: a record is one value, and the two line breaks that end a record are
the sink's line separator, so part files are plain WARC files in any file system that Spark can write.
Equal payloads are found by their digest; the payloads themselves are not shuffled for that while the
repeated digests are few enough to be broadcast (their number is counted first), and are joined otherwise.

Reading maps over files, each read as a stream through a window that holds one record. A record whose header,
length, end or digest does not hold is not trusted: the reader searches for the next gzip member or version
line that starts a valid record, goes on from there, and returns the bytes in between as a quarantined gap.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator
from contextlib import suppress
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidecue.llm.common import counted, settle

VERSION = "WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Repeated digests that may be broadcast: about 100 bytes each.
BROADCAST_ROWS = 50_000
#: Records in one archive file.
FILE_RECORDS = 400
#: Bytes read at once; bytes of a header at most; bytes of one record at most, which must fit a task several times.
CHUNK, HEADER, RECORD = 1 << 20, 1 << 16, 1 << 28
#: Bytes of a gzip member that are kept while it unpacks, to search them again if it turns out to be damaged.
KEEP = 1 << 26
#: Rows and bytes of payload in one batch of the reader.
BATCH_ROWS, BATCH_BYTES = 256, 1 << 23
#: Schemes whose files tasks open themselves; of others, Spark hands over whole files.
SCHEMES = ("file", "hdfs", "s3", "s3a", "gs", "gcs", "abfs", "abfss")
_START = re.compile(rb"WARC/1\.[01]\r\n")
_MEMBER = b"\x1f\x8b\x08"


def base32_of_hex(hexes: Column) -> Column:
    """Upper-case base32 of 160 bits given as 40 hex digits: five digits make four letters."""
    letters = F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")
    groups = [F.conv(F.substring(hexes, 5 * i + 1, 5), 16, 10).cast("int") for i in range(8)]
    return F.concat(*[F.substring(letters, F.pmod(F.shiftright(n, 15 - 5 * k), F.lit(32)) + 1, F.lit(1)) for n in groups for k in range(4)])


def mark_revisits(pages: DataFrame, key: str = "page_id", payload: str = "html", least_bytes: int = 0) -> DataFrame:
    """Add payload_bytes, payload_digest and refers_to to pages.

    Of rows with equal payloads of at least ``least_bytes`` bytes, those with the largest key refer to
    nothing; the others refer to that key. A null payload counts as empty. A null key refers to the largest
    key of its payload, or to nothing if there is none; rows repeated with the largest key all refer to
    nothing. Columns of the pages that have one of the three names are replaced.
    """
    pages = pages.drop("payload_bytes", "payload_digest", "refers_to")
    body = F.coalesce(F.col(payload), F.lit(""))
    sized = pages.withColumns({payload: body, "payload_bytes": F.octet_length(body).cast("long"), "payload_digest": F.sha1(body.cast("binary"))})
    sized = sized.withColumn("payload_digest", base32_of_hex(F.col("payload_digest")))
    repeated = settle(
        sized.where(F.col("payload_bytes") >= least_bytes).groupBy("payload_digest").agg(F.count("*").alias("n"), F.max(key).alias("refers_to")).where("n > 1 and refers_to is not null").drop("n"),
        "repeated",
    )
    joined = sized.join(counted(repeated, BROADCAST_ROWS), "payload_digest", "left")
    own = F.col("refers_to").eqNullSafe(F.col(key)) | (F.col("payload_bytes") < least_bytes)
    return joined.withColumn("refers_to", F.when(~own, F.col("refers_to")))


def record(key: Column, url: Column, payload: Column, size: Column, digest: Column, refers_to: Column) -> Column:
    """The text of one WARC record without its two closing line breaks."""
    id_of = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("")), F.lit(">"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), size.cast("string"), F.lit("\r\n\r\n"))
    block = F.when(refers_to.isNull(), F.concat(http, payload)).otherwise(http)
    head = F.concat(
        F.lit(f"{VERSION}\r\nWARC-Type: "), F.when(refers_to.isNull(), "response").otherwise("revisit"),
        F.lit("\r\nWARC-Record-ID: "), id_of(key),
        # a line break in a URL would end the field
        F.lit("\r\nWARC-Target-URI: "), F.regexp_replace(F.coalesce(url, F.lit("")), "[\\r\\n]", ""),
        F.lit("\r\nWARC-Date: 1970-01-01T00:00:00Z\r\nContent-Type: application/http; msgtype=response\r\nWARC-Payload-Digest: sha1:"), digest,
        F.coalesce(F.concat(F.lit(f"\r\nWARC-Profile: {PROFILE}\r\nWARC-Refers-To: "), F.when(refers_to.isNotNull(), id_of(refers_to))), F.lit("")),
        F.lit("\r\nContent-Length: "), F.octet_length(block).cast("string"), F.lit("\r\n\r\n"),
    )
    return F.concat(head, block)


def write_warc(marked: DataFrame, path: str, key: str = "page_id", url: str = "url", payload: str = "html", compression: str = "none", file_records: int = FILE_RECORDS) -> None:
    """Write the rows of ``mark_revisits`` as archives; without a column named ``url`` the field stays empty.

    Spark's sink writes a compressed file as one gzip member; the reader takes such files too. An empty table
    gives no records.
    """
    c = F.col
    address = c(url).cast("string") if url in marked.columns else F.lit(None).cast("string")
    lines = marked.select(record(c(key), address, c(payload), c("payload_bytes"), c("payload_digest"), c("refers_to")).alias("value"))
    lines.write.option("lineSep", "\r\n\r\n").option("maxRecordsPerFile", file_records).option("compression", compression).text(path)


@dataclass
class Record:
    offset: int
    kind: str
    headers: dict[str, str] = field(default_factory=dict)
    payload: bytes | None = None
    size: int = 0
    digest: str = ""


def base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _fields(lines: list[bytes]) -> dict[str, str]:
    out = {}
    for x in lines:
        name, found, value = x.partition(b":")
        if not found:
            raise ValueError("a header line without a colon")
        out[name.strip().lower().decode("latin-1")] = value.strip().decode("utf-8", "replace")
    return out


def parse_record(data: bytes, at: int) -> tuple[Record, int]:
    """The record that starts at a place, and where it ends; ValueError if any check fails."""
    start = _START.match(data, at)
    head = data.find(b"\r\n\r\n", at)
    if not start or head < 0:
        raise ValueError("no version line or no end of the header")
    headers = _fields(data[start.end() : head].split(b"\r\n"))
    size = headers.get("content-length", "")
    if not size.isdigit():
        raise ValueError("no length")
    begin, end = head + 4, head + 4 + int(size)
    if data[end : end + 4] != b"\r\n\r\n":
        raise ValueError("the block does not end where it should")
    block = data[begin:end]
    r = Record(at, headers.get("warc-type", ""), headers)
    http = block.find(b"\r\n\r\n")
    if block.startswith(b"HTTP/") and http >= 0:
        inner = _fields(block[:http].split(b"\r\n")[1:])
        r.payload, r.size = block[http + 4 :], int(inner.get("content-length") or len(block) - http - 4)
    else:
        r.payload, r.size = block, len(block)
    told = headers.get("warc-payload-digest", "").removeprefix("sha1:")
    if r.kind == "revisit":
        r.payload, r.digest = None, told
    else:
        r.digest = base32(r.payload)
        if told and told != r.digest or r.size != len(r.payload):
            raise ValueError("the payload is not what its digest or length says")
    return r, end + 4


class Window:
    """What has been read of a stream of bytes and is not passed yet; ``at`` is the place of its first byte."""

    def __init__(self, chunks: Iterator[bytes]):
        self.chunks, self.data, self.at = chunks, bytearray(), 0

    def fill(self, n: int) -> bool:
        """Read until n bytes are there; false if the stream ends before."""
        while len(self.data) < n:
            chunk = next(self.chunks, None)
            if chunk is None:
                return False
            self.data += chunk
        return True

    def drop(self, n: int) -> None:
        del self.data[:n]
        self.at += n

    def find(self, what: bytes, most: int) -> int:
        """The place of some bytes that end within the first ``most``, or -1."""
        seen = 0
        while True:
            at = self.data.find(what, seen, most)
            if at >= 0 or len(self.data) >= most:
                return at
            seen = max(0, len(self.data) - len(what))
            if not self.fill(len(self.data) + 1):
                return -1

    def skip(self, members: bool) -> None:
        """Go to the next version line, or gzip member too, after the first byte; to the end if there is none."""
        self.drop(1)
        while True:
            line, member = _START.search(self.data), self.data.find(_MEMBER) if members else -1
            found = [x for x in (line.start() if line else -1, member) if x >= 0]
            if found:
                return self.drop(min(found))
            self.drop(max(0, len(self.data) - 9))  # a mark may have begun
            if not self.fill(len(self.data) + 1):
                return self.drop(len(self.data))

    def record(self) -> tuple[Record, int]:
        """The record that starts here and its length; ValueError if any check fails."""
        self.fill(10)
        if not _START.match(self.data):
            raise ValueError("no version line")
        head = self.find(b"\r\n\r\n", HEADER)
        told = re.search(rb"\r\n[Cc]ontent-[Ll]ength:[ \t]*(\d{1,12})[ \t]*\r\n", self.data[: head + 2]) if head >= 0 else None
        if not told or int(told[1]) > RECORD:
            raise ValueError("no end of the header or no length")
        end = head + 4 + int(told[1]) + 4
        if not self.fill(end):
            raise ValueError("the stream ends inside the record")
        return parse_record(bytes(self.data[:end]), 0)


def _plain(w: Window) -> Iterator[Record]:
    lost = None
    while w.fill(1):
        try:
            found, end = w.record()
        except ValueError:
            lost = w.at if lost is None else lost
            w.skip(members=False)
            continue
        if lost is not None:
            yield Record(lost, "gap", size=w.at - lost)
            lost = None
        found.offset = w.at
        yield found
        w.drop(end)
    if lost is not None:
        yield Record(lost, "gap", size=w.at - lost)


class Member:
    """The gzip member that starts a window. ``used`` is its length once it is unpacked whole; it stays 0 if damaged."""

    def __init__(self, w: Window):
        self.w, self.used, self.start = w, 0, w.at

    def _pieces(self) -> Iterator[bytes]:
        unpack, at = zlib.decompressobj(31), 0
        while not unpack.eof:
            if at >= len(self.w.data) and not self.w.fill(at + 1):
                return
            chunk = bytes(self.w.data[at : at + CHUNK])
            before = unpack.copy()
            try:
                piece = unpack.decompress(chunk, CHUNK)
            except zlib.error:
                yield from self._last(before, chunk)
                return
            at += len(chunk) - len(unpack.unconsumed_tail) - len(unpack.unused_data)
            if at > KEEP:
                self.w.drop(at)
                at = 0
            if piece:
                yield piece
        self.used = self.w.at + at - self.start

    @staticmethod
    def _last(unpack: zlib._Decompress, chunk: bytes) -> Iterator[bytes]:
        """What comes out of a damaged chunk before the damage."""
        with suppress(zlib.error):
            for i in range(len(chunk)):
                if piece := unpack.decompress(chunk[i : i + 1]):
                    yield piece

    def records(self) -> Iterator[Record]:
        """Its records as they are unpacked; of a damaged member those that came out whole, without gaps."""
        gaps = []
        for r in _plain(Window(self._pieces())):
            r.offset = self.start
            if r.kind == "gap":
                gaps.append(r)
            else:
                yield r
        if self.used:
            yield from gaps


def salvage(chunks: Iterator[bytes]) -> Iterator[Record]:
    """Records of an archive that is plain, gzip of any number of members, or both by turns; it comes in chunks.

    Offsets are places in the archive: of the record if it is plain, of its member if not. A member whose
    records are damaged in part gives the others; of a member that cannot be unpacked whole, the records that
    came out before are given, and the member becomes a gap.
    """
    w, lost = Window(chunks), None
    while w.fill(1):
        w.fill(3)
        start, end, found = w.at, 0, iter(())
        if w.data.startswith(_MEMBER):
            member = Member(w)
            first = next(records := member.records(), None)
            if first and lost is not None:
                yield Record(lost, "gap", size=start - lost)
                lost = None
            if first:
                yield first
                yield from records
            end = start + member.used - w.at if member.used else 0
        else:
            try:
                r, end = w.record()
                r.offset = start
                found = iter((r,))
            except ValueError:
                pass
        if not end:
            lost = start if lost is None else lost
            w.skip(members=True)
            continue
        if lost is not None:
            yield Record(lost, "gap", size=start - lost)
            lost = None
        yield from found
        w.drop(end)
    if lost is not None:
        yield Record(lost, "gap", size=w.at - lost)


def _chunks(path: str) -> Iterator[bytes]:
    """The bytes of a file in the file system that its scheme names."""
    from pyarrow import fs

    if path.startswith("file:"):
        system, place = fs.LocalFileSystem(), re.sub("^file:/*", "/", path)
    else:
        system, place = fs.FileSystem.from_uri(re.sub("^s3a:", "s3:", path))
    with system.open_input_stream(place) as stream:
        while chunk := stream.read(CHUNK):
            yield chunk


_SCHEMA = "path string, offset long, kind string, record_id string, target_uri string, refers_to string, payload_bytes long, payload_digest string, payload binary"


def _batch(path: str, rows: list[Record], payloads: bool) -> pa.RecordBatch:
    h = lambda key: pa.array([r.headers.get(key) for r in rows], pa.string())
    columns = [
        pa.array([path] * len(rows), pa.string()), pa.array([r.offset for r in rows], pa.int64()), pa.array([r.kind for r in rows], pa.string()),
        h("warc-record-id"), h("warc-target-uri"), h("warc-refers-to"), pa.array([r.size for r in rows], pa.int64()),
        pa.array([r.digest or None for r in rows], pa.string()), pa.array([r.payload if payloads else None for r in rows], pa.binary()),
    ]
    return pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in _SCHEMA.split(", ")])


def read_warc(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """All records and gaps of the archives below a path.

    kind is the record's type, or ``gap`` for quarantined bytes, with their number in payload_bytes. A
    revisit has the length and digest of the payload it stands for, and no payload. Empty files give no
    rows. Without ``payloads`` that column is null. Tasks open files themselves and read them as streams, where
    the scheme is one that they know; of other file systems Spark hands over whole files, which must be small.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    schemes = [r[0] for r in files.select(F.regexp_extract("path", "^([^:/]+):", 1)).distinct().limit(100).collect()]
    streamed = all(x in SCHEMES for x in schemes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, name in enumerate(b.column("path").to_pylist()):
                rows: list[Record] = []
                size = 0
                for r in salvage(_chunks(name) if streamed else iter((b.column("content")[i].as_py(),))):
                    rows.append(r)
                    size += len(r.payload or b"")
                    if len(rows) == BATCH_ROWS or size > BATCH_BYTES:
                        yield _batch(name, rows, payloads)
                        rows, size = [], 0
                yield _batch(name, rows, payloads)

    return (files.select("path") if streamed else files.select("path", "content")).mapInArrow(run, _SCHEMA)


def page_of(record_id: Column) -> Column:
    """The page id in a record id."""
    return F.regexp_extract(record_id, r"^<urn:page:(-?\d+)>$", 1).try_cast("long")
