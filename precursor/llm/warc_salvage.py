"""WARC archives with revisit records, and a reader that salvages damaged ones.

Writer: one gzip member per record, members appended to archives of bounded size.  Of records with
equal payloads the one with the largest page_id is a ``response``, the others are ``revisit``
records that refer to it and hold no payload.

Reader: every member is checked (gzip CRC, WARC version line, header lines, lengths of at most 18
digits, block digest).  After a failed check the reader searches for the next valid member (or, in plain archives, the next version
line that starts a valid record), goes on from there and logs the skipped bytes as a gap.

Defined results: a null html is an empty payload; of rows that agree in page_id and payload each one
becomes a record (several may be the response); a null page_id is never the largest and is written
as ``-``; a missing url becomes an empty target; an empty table gives no archive and no record; an
archive without a single valid record gives one gap of its whole length.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from precursor.llm.common import text_or_empty, written

VERSION = b"WARC/1.1"
_VERSION_LINE = re.compile(rb"WARC/\d+\.\d+\r\n")
_MEMBER = b"\x1f\x8b\x08"
_BLANK_LINE = b"\r\n\r\n"
_MARKS = {"member": _MEMBER, "blank": _BLANK_LINE, "zero": b"\0"}
#: Compressed bytes before the first inflated one at most (a false start may look like an endless file name).
GZIP_HEADER = 1 << 12
#: Bytes of a record's version line and headers at most (longer ones count as damaged).
MAX_HEADERS = 1 << 24
#: Target size of one archive, before compression of the last record.
ARCHIVE_BYTES = 8 << 20
#: Compressed bytes read at a time.
STEP = 1 << 15
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_bytes(headers: list[tuple[str, str]], block: bytes) -> bytes:
    """One plain record: version line, headers, blank line, block, two line ends."""
    lines = [VERSION.decode(), *(f"{k}: {v}" for k, v in headers), f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode() + block + b"\r\n\r\n"


def page_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """The record of a page: a response with its payload, or a revisit of page ``refers_to``."""
    name = lambda i: f"<urn:page:{'-' if i is None else i}>"
    target = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "")
    headers = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", name(page_id)),
               ("WARC-Date", DATE), ("WARC-Target-URI", target),
               ("WARC-Payload-Digest", f"sha1:{payload_digest(payload)}"), ("X-Payload-Length", str(len(payload)))]
    if refers_to is None:
        block = payload
    else:
        headers += [("WARC-Refers-To", name(refers_to)), ("WARC-Profile", REVISIT_PROFILE)]
        block = b""
    return record_bytes([*headers, ("WARC-Block-Digest", f"sha1:{payload_digest(block)}")], block)


def gzip_member(data: bytes) -> bytes:
    c = zlib.compressobj(6, zlib.DEFLATED, 31)
    return c.compress(data) + c.flush()


# ---------------------------------------------------------------------------- reading
@dataclass
class Record:
    offset: int
    headers: dict[str, str]
    block: bytes


@dataclass
class Gap:
    offset: int
    length: int
    reason: str


@dataclass
class _Failure(Exception):
    reason: str


def number(text: str) -> int | None:
    """A non-negative decimal number of at most 18 digits, else None."""
    return int(text) if text.isascii() and text.isdigit() and len(text) <= 18 else None


def parse_headers(data: bytes | bytearray, at: int, end: int) -> dict[str, str]:
    """Headers of a record that starts at ``at`` and whose blank line is at ``end``; fails at the first bad line."""
    headers: dict[str, str] = {}
    lo = data.find(b"\r\n", at, end) + 2
    while 1 < lo < end:
        hi = data.find(b"\r\n", lo, end)
        hi = end if hi < 0 else hi
        k, colon, v = bytes(data[lo:hi]).partition(b":")
        if not colon:
            raise _Failure("header")
        name = k.decode("latin-1").lower()
        if name in headers and name != "warc-concurrent-to":  # two records run into each other
            raise _Failure("repeated header")
        headers[name] = v.strip().decode("utf-8", "replace")
        lo = hi + 2
    if number(headers.get("content-length", "")) is None:
        raise _Failure("content length")
    if number(headers.get("x-payload-length", "0")) is None:
        raise _Failure("payload length")
    return headers


def checked(headers: dict[str, str], block: bytes) -> bytes:
    told = headers.get("warc-block-digest")
    if told and told != f"sha1:{payload_digest(block)}":
        raise _Failure("block digest")
    return block


@dataclass
class Salvage:
    """Reads one archive; ``records`` yields valid records, ``gaps`` fills as bytes are skipped.

    The next member mark, version line and blank line are searched once each, not at every failure,
    and a member is given up at its first bytes that are not a version line, so that false starts
    cost no more than their own length.  A member is inflated as far as its headers declare.
    """

    data: bytes
    gaps: list[Gap] = field(default_factory=list)
    _seen: dict[str, int] = field(default_factory=dict)

    def records(self) -> Iterator[Record]:
        data, at, bad_from, reason = self.data, 0, None, ""
        while at < len(data):
            try:
                record, end = self._member(at) if data.startswith(_MEMBER, at) else self._plain(at)
            except _Failure as e:
                if bad_from is None:
                    bad_from, reason = at, e.reason
                at = min(self._next("member", at + 1), self._next("line", at + 1))
                continue
            if bad_from is not None:
                self.gaps.append(Gap(bad_from, at - bad_from, reason))
                bad_from = None
            yield record
            at = end
        if bad_from is not None:
            self.gaps.append(Gap(bad_from, len(data) - bad_from, reason))

    def _next(self, mark: str, at: int) -> int:
        """The first place of a mark at ``at`` or behind (the end of the data: none)."""
        place = self._seen.get(mark, -1)
        if place < at:
            if mark == "line":
                found = _VERSION_LINE.search(self.data, at)
                place = found.start() if found else -1
            else:
                place = self.data.find(_MARKS[mark], at)
            self._seen[mark] = place = len(self.data) if place < 0 else place
        return place

    def _member(self, at: int) -> tuple[Record, int]:
        flags = self.data[at + 3] if at + 3 < len(self.data) else 0
        if flags & 0xE0 or flags & 0x18 and self._next("zero", at + 10) > at + GZIP_HEADER:  # reserved bits; a name or comment without end
            raise _Failure("gzip header")
        inflate, plain, end, step = zlib.decompressobj(31), bytearray(), at, 1 << 7
        headers: dict[str, str] = {}
        start = need = 0
        while not inflate.eof:
            piece = inflate.unconsumed_tail
            if not piece:
                piece, step = self.data[end:end + step], min(4 * step, STEP)
                end += len(piece)
                if not piece:
                    raise _Failure("truncated member")
            most = need or MAX_HEADERS
            try:
                plain += inflate.decompress(piece, min(most - len(plain) + 1, 1 << 20))
            except zlib.error:
                raise _Failure("gzip") from None
            if not plain and end - at > GZIP_HEADER:
                raise _Failure("gzip header")
            if not need:
                if not plain.startswith(b"WARC/"[:len(plain)]):
                    raise _Failure("no version line")
                head_end = plain.find(_BLANK_LINE)
                if head_end >= 0:
                    if not _VERSION_LINE.match(plain):
                        raise _Failure("no version line")
                    headers = parse_headers(plain, 0, head_end)
                    start = head_end + 4
                    need = start + int(headers["content-length"]) + 4
                elif len(plain) > MAX_HEADERS:
                    raise _Failure("no end of headers")
            if need and len(plain) > need:
                raise _Failure("more than one record in a member")
        if not need:
            raise _Failure("no end of headers")
        if len(plain) != need or not plain.endswith(_BLANK_LINE):
            raise _Failure("record end")
        block = checked(headers, bytes(memoryview(plain)[start:need - 4]))
        return Record(at, headers, block), end - len(inflate.unused_data)

    def _plain(self, at: int) -> tuple[Record, int]:
        data = self.data
        if not _VERSION_LINE.match(data, at):
            raise _Failure("no version line")
        head_end = self._next("blank", at)
        if not at <= head_end <= at + MAX_HEADERS:
            raise _Failure("no end of headers")
        headers = parse_headers(data, at, head_end)
        start = head_end + 4
        end = start + int(headers["content-length"])
        if data[end:end + 4] != _BLANK_LINE:
            raise _Failure("record end")
        return Record(at, headers, checked(headers, data[start:end])), end + 4


# ---------------------------------------------------------------------------- Spark jobs
def _archives(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[pa.RecordBatch]:
    members: list[bytes] = []
    size = rows = 0

    def archive():
        return pa.RecordBatch.from_arrays([pa.array([b"".join(members)], pa.binary()), pa.array([rows], pa.int64())],
                                          names=["content", "n_records"])

    for b in batches:
        for id, url, html, refers in zip(*(b.column(c).to_pylist() for c in ("_id", "_url", "_html", "_refers")),
                                         strict=True):
            members.append(gzip_member(page_record(id, url, (html or "").encode("utf-8", "surrogatepass"), refers)))
            size, rows = size + len(members[-1]), rows + 1
            if size >= limit:
                yield archive()
                members.clear()
                size = rows = 0
    if members:
        yield archive()


def write_archives(pages: DataFrame, id: str = "page_id", url: str = "url", html: str = "html",
                   archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Archives (content binary, n_records) in the shared folder, one record per row of ``pages``.

    Only ids and digests are grouped; a digest that a third of the pages share is combined before
    the shuffle.  The join back is a plain join of the scanned pages with the written groups, whose hot
    partitions adaptive execution splits.
    """
    rows = pages.select(F.col(id).cast("long").alias("_id"), F.col(url).alias("_url"), F.col(html).alias("_html"),
                        F.unhex(F.sha1(text_or_empty(html).cast("binary"))).alias("_digest"))
    groups = written(rows.groupBy("_digest").agg(F.max("_id").alias("_last"), F.count("*").alias("_n"))
                     .where("_n > 1").drop("_n"), "warc-groups")
    joined = rows.join(groups, "_digest", "left").withColumn(
        "_refers", F.when(F.col("_last") != F.col("_id"), F.col("_last"))
        .when(F.col("_id").isNull(), F.col("_last"))).select("_id", "_url", "_html", "_refers")
    made = joined.mapInArrow(lambda it: _archives(it, archive_bytes), "content binary, n_records long")
    return written(made, "warc-archives", compression="uncompressed")


RECORDS = ("archive_offset long, record_type string, record_id string, refers_to string, target_uri string, "
           "payload binary, payload_digest string, payload_bytes long, gap_bytes long, gap_reason string")


def _read(batches: Iterator[pa.RecordBatch], with_payload: bool) -> Iterator[pa.RecordBatch]:
    names = [f.split()[0] for f in RECORDS.split(", ")]
    kinds = [pa.int64(), *[pa.string()] * 4, pa.binary(), pa.string(), pa.int64(), pa.int64(), pa.string()]

    def block(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)],
                                          names=names)

    for b in batches:
        for content in b.column("content"):
            reader, rows = Salvage(content.as_py() or b""), []
            for r in reader.records():
                h, kind = r.headers, r.headers.get("warc-type")
                payload = r.block if kind != "revisit" else None
                digest = payload_digest(payload) if payload is not None else \
                    h.get("warc-payload-digest", "").removeprefix("sha1:")
                size = len(payload) if payload is not None else int(h.get("x-payload-length", "0"))
                rows.append((r.offset, kind, h.get("warc-record-id"), h.get("warc-refers-to"), h.get("warc-target-uri"),
                             payload if with_payload else None, digest, size, None, None))
                if len(rows) >= 1000:
                    yield block(rows)
                    rows = []
            rows += [(g.offset, None, None, None, None, None, None, None, g.length, g.reason) for g in reader.gaps]
            if rows:
                yield block(rows)


def read_archives(archives: DataFrame, with_payload: bool = True) -> DataFrame:
    """Records and gaps (``gap_bytes`` not null) of archives given as a ``content`` column.

    Archives on disk: ``spark.read.format("binaryFile").load(path)`` has that column.
    """
    return archives.select("content").mapInArrow(lambda it: _read(it, with_payload), RECORDS)


def page_of(record_id: str):
    """The page id in a record id written by :func:`write_archives`."""
    return F.regexp_extract(record_id, r"^<urn:page:(-?\d+)>$", 1).try_cast("long")
