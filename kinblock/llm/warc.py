"""WARC archives of pages through a chunked record table.

A payload is cut, by DataFrame functions, into rows (record id, chunk number)
of at most CHUNK bytes; a task streams them in order, carries the SHA-1 of the
payload so far from row to row, and turns each into a WARC/1.1 segment (a
first record and continuation records) that states it.  So beyond the page
row it came from, neither writer nor reader ever needs a whole record.  The
reader walks each archive as a byte stream, checks every carried digest, and
recomputes the payload's.

Archives are gzip text files, one a task, whose rows are segments and whose
row separator is the CR LF CR LF that ends a WARC record; payload bytes are
free to hold the separator, for the reader counts bytes by Content-Length.
Files end where tasks end, never within a record.

Of equal payloads of at least ``revisit_from`` bytes the smallest page_id is
``response`` and the others are ``revisit`` records that refer to it (rows
repeated with that page_id are responses too).

Defined results: a null html is an empty payload; a null page_id is written as
an empty id, takes part as the largest, and reads back as null; repeated rows
are one record each; an empty table gives no record; other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import fresh_path
from .common import map_arrow, sized, staged

CHUNK = 1 << 20
END = b"\r\n\r\n"
DATE = "1970-01-01T00:00:00Z"


def _b32(sha: "hashlib._Hash") -> str:
    return base64.b32encode(sha.digest()).decode()


def _safe(value: str | None) -> str:
    """``value`` as one header line."""
    return (value or "").replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A")


def _header(fields: list[tuple[str, object]]) -> bytes:
    return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n").encode()


def segment(page_id: int | None, url: str | None, chunk: int, chunks: int, length: int, data: bytes, so_far: str) -> bytes:
    """The WARC segment (without the final separator) of one chunk of a payload of ``length`` bytes."""
    own = "" if page_id is None else page_id
    if chunk == 0:
        fields = [("WARC-Type", "response"), ("WARC-Record-ID", f"<urn:page:{own}>"), ("WARC-Date", DATE), ("WARC-Target-URI", _safe(url))]
    else:
        fields = [("WARC-Type", "continuation"), ("WARC-Record-ID", f"<urn:page:{own}:{chunk + 1}>"), ("WARC-Date", DATE), ("WARC-Segment-Origin-ID", f"<urn:page:{own}>")]
    if chunks > 1:
        fields.append(("WARC-Segment-Number", chunk + 1))
        if chunk == chunks - 1:
            fields.append(("WARC-Segment-Total-Length", length))
    return _header([*fields, ("X-Digest-So-Far", f"sha1:{so_far}"), ("Content-Type", "text/html"), ("Content-Length", len(data))]) + data


def revisit(page_id: int | None, url: str | None, length: int, digest: str, refers_to: int) -> bytes:
    own = "" if page_id is None else page_id
    return _header(
        [("WARC-Type", "revisit"), ("WARC-Record-ID", f"<urn:page:{own}>"), ("WARC-Date", DATE), ("WARC-Target-URI", _safe(url)),
         ("WARC-Payload-Digest", f"sha1:{digest}"), ("WARC-Refers-To", f"<urn:page:{refers_to}>"),
         ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("X-Payload-Length", length), ("Content-Length", 0)]
    )


RECORDS = "record_id long, chunk int, digest_so_far string, value binary"


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of RECORDS from rows page_id, url, sha, length, first, revisit, chunk, chunks, data; the chunks of a record in order."""
    sha = hashlib.sha1()
    for batch in batches:
        out: list[tuple] = []
        size = 0
        *columns, data = batch.columns
        for i, (page_id, url, hexed, length, first, again, chunk, chunks) in enumerate(zip(*(c.to_pylist() for c in columns))):
            if again:
                digest = base64.b32encode(bytes.fromhex(hexed)).decode()
                out.append((page_id, 0, digest, revisit(page_id, url, length, digest, first)))
            else:
                part = data[i].as_buffer().to_pybytes()
                sha = hashlib.sha1() if chunk == 0 else sha
                sha.update(part)
                out.append((page_id, chunk, _b32(sha), segment(page_id, url, chunk, chunks, length, part, _b32(sha))))
            size += len(out[-1][-1])
            if size > 4 * CHUNK:
                yield _table(out)
                out, size = [], 0
        if out:
            yield _table(out)


def _table(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int32(), pa.string(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=["record_id", "chunk", "digest_so_far", "value"])


def records(pages: DataFrame, revisit_from: int = 0, chunk: int = CHUNK) -> DataFrame:
    """The chunked record table of ``pages`` (page_id, url, html): RECORDS, in the order in which it has to be written.

    Only digests are grouped: hash and smallest page_id, combined before the
    shuffle.  What is decided, which rows revisit which page, is broadcast up to
    a checked number of rows; beyond it payloads move once to meet the decision,
    and a hot digest's rows are split by the adaptive skew join.
    """
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select("page_id", F.col("url").cast("string").alias("url"), payload.alias("payload"), F.sha1(payload).alias("sha"))
    marks = staged(pages.select("page_id", F.sha1(payload).alias("sha"), F.length(payload).alias("n")), "digests", pages.count())
    groups = marks.where(F.col("n") >= revisit_from).groupBy("sha").agg(F.count("*").alias("k"), F.min("page_id").alias("first"))
    shared = groups.where("k > 1").select("sha", "first")  # payloads seen once need no decision
    again = marks.join(shared, "sha").where(~F.col("page_id").eqNullSafe(F.col("first"))).select("page_id", "sha", "first").distinct()
    again = sized(staged(again, "revisits", marks.count()))
    if again is None:
        decided = rows.select("page_id", "url", "payload", "sha", F.lit(None).cast("long").alias("first"), F.lit(False).alias("revisit"))
    else:
        decided = rows.join(again, [rows.sha == again.sha, rows.page_id.eqNullSafe(again.page_id)], "left").select(
            rows.page_id, "url", "payload", rows.sha, "first", again.sha.isNotNull().alias("revisit")
        )
    length = F.length("payload")
    chunks = F.when(F.col("revisit"), 1).otherwise(F.greatest(F.ceil(length / chunk), F.lit(1))).cast("int")
    dealt = decided.select("page_id", "url", "payload", "sha", "first", "revisit", chunks.alias("chunks"), F.explode(F.sequence(F.lit(0), chunks - 1)).alias("chunk"))
    data = F.when(F.col("revisit"), F.lit(b"")).otherwise(F.substring("payload", F.col("chunk") * chunk + 1, F.lit(chunk)))
    table = dealt.select("page_id", "url", "sha", length.cast("long").alias("length"), "first", "revisit", "chunk", "chunks", data.alias("data"))
    return map_arrow(table, _segments, RECORDS)


def write(pages: DataFrame, path: str, revisit_from: int = 0, chunk: int = CHUNK) -> None:
    """Write archives of ``pages`` (page_id, url, html) below ``path``."""
    lines = records(pages, revisit_from, chunk).select(F.col("value").cast("string").alias("value"))
    lines.write.options(lineSep=END.decode(), compression="gzip").option("maxRecordsPerFile", 0).text(path)


def _page(text: str) -> int | None:
    """The page_id in ``<urn:page:ID>``."""
    inner = text.split(":")[2].rstrip(">")
    return int(inner) if inner not in ("", "None") else None


class _Walk:
    """State of a walk over the byte stream of archives."""

    def __init__(self) -> None:
        self.buffer = bytearray()
        self.need = -1  # payload bytes still to come, or -1 in a header
        self.fields: dict[str, str] = {}
        self.sha = hashlib.sha1()
        self.size = 0
        self.page: int | None = None
        self.segment = 0
        self.rows: list[tuple] = []

    def feed(self, data: bytes) -> None:
        self.buffer += data
        while True:
            if self.need < 0:
                skip = 0
                while skip < len(self.buffer) and self.buffer[skip] in b"\r\n":
                    skip += 1
                stop = self.buffer.find(END, skip)
                if stop < 0:
                    return
                lines = self.buffer[skip:stop].decode().split("\r\n")
                if lines[0] != "WARC/1.1":
                    raise ValueError(f"not a WARC record: {lines[0][:60]!r}")
                self.fields = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
                del self.buffer[: stop + len(END)]
                self.need = int(self.fields["Content-Length"])
                if self.fields["WARC-Type"] in ("response", "revisit"):
                    self.sha, self.size, self.page, self.segment = hashlib.sha1(), 0, _page(self.fields["WARC-Record-ID"]), 1
                else:
                    self.segment += 1
                    if int(self.fields["WARC-Segment-Number"]) != self.segment or _page(self.fields["WARC-Segment-Origin-ID"]) != self.page:
                        raise ValueError(f"segments of page {self.page} are out of order")
            part = bytes(self.buffer[: self.need])
            del self.buffer[: len(part)]
            self.sha.update(part)
            self.size += len(part)
            self.need -= len(part)
            if self.need:
                return
            self.need = -1
            self._ended()

    def _ended(self) -> None:
        f = self.fields
        if f["WARC-Type"] == "revisit":
            self.rows.append((self.page, int(f["X-Payload-Length"]), f["WARC-Payload-Digest"].removeprefix("sha1:"), "revisit", _page(f["WARC-Refers-To"])))
            return
        if f["X-Digest-So-Far"] != f"sha1:{_b32(self.sha)}":
            raise ValueError(f"payload of page {self.page} is damaged in segment {self.segment}")
        if "WARC-Segment-Number" not in f or "WARC-Segment-Total-Length" in f:
            self.rows.append((self.page, self.size, _b32(self.sha), "response", None))


SHAPE = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
ARROW = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])


def _walked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    walk = _Walk()
    for batch in batches:
        for x in batch.column(0):
            walk.feed(x.as_buffer())
            walk.feed(END)
        rows, walk.rows = walk.rows, []
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 5, ARROW.types)], schema=ARROW)
    if walk.need > 0:
        raise ValueError(f"the archive ends within page {walk.page}")


def read(spark: SparkSession, path: str) -> DataFrame:
    """One row per page record of the archives below ``path``; gzip files are never split."""
    lines = spark.read.option("lineSep", END.decode()).text(path)
    return map_arrow(lines.select(F.col("value").cast("binary").alias("value")), _walked, SHAPE)


def op8(pages: DataFrame) -> DataFrame:
    path = fresh_path(pages.sparkSession, "warc")
    write(pages, path)
    return read(pages.sparkSession, path)


OP8_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, strlen(h) AS n, sha1(h) AS hx, min(page_id) OVER (PARTITION BY h) AS first FROM p),
b AS (SELECT *, array_to_string(list_transform(range(1, 41), lambda i:
             lpad(bin(strpos('0123456789abcdef', hx[i]) - 1), 4, '0')), '') AS bits FROM d)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes,
       array_to_string(list_transform(range(0, 32), lambda i: 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[
           CAST(list_sum(list_transform(range(0, 5), lambda j:
               CAST(bits[i * 5 + j + 1] AS INTEGER) * CAST(pow(2, 4 - j) AS INTEGER))) AS INTEGER) + 1]), '') AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to
FROM b
"""
