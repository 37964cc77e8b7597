r"""WARC archives as a chunked record table.

Writing: one WARC/1.1 record per row, payloads over ``segment_bytes`` cut into continuation
records (the format's own way), one output row per segment, through Spark's text writer with
``\r\n\r\n`` as the record end. So any file system that Spark reaches will do, and its commit
protocol covers lost executors.

Reading: `WarcChunks` takes bytes in pieces of any size and yields (record, chunk number, chunk
length, running SHA-1, running length, last, chunk) rows: the chunks of a record, in order, are its payload. It keeps at
most one header (of any length) and one chunk; no record is ever held whole. Input that ends within a record raises.

Identical payloads: of the records with equal payloads of at least ``min_revisit_bytes`` bytes, the
one with the smallest page_id is the response and the others are revisits without a payload.

Nulls: null html is the empty payload, null url an empty target, a null page_id sorts first (it
is the response and nobody refers to it by number) and is read back as null. Repeated page_ids
with equal payloads: one row is as good as another, both are responses. Empty tables write
no record. Extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from . import common

SEGMENT, CHUNK, END = 1 << 20, 1 << 18, "\r\n\r\n"
#: Payloads that occur more than once meet the pages by broadcast, so that no payload is shuffled, if they are so many at most; they are counted first.
BROADCAST_DIGESTS = 500_000
CHUNK_SCHEMA = "record_id string, warc_type string, chunk_no long, chunk_bytes long, sha1 string, bytes_so_far long, last boolean, refers_to string, full_digest string, full_bytes long, chunk binary"


def base32_sha1(data: Column) -> Column:
    """Upper-case base32 of the SHA-1 of a binary column, from built-ins: 5 hex digits are 4 base32 digits."""
    hexed = F.sha1(data)
    parts = [F.lpad(F.conv(F.substring(hexed, 1 + 5 * i, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def records(pages: DataFrame, segment_bytes: int = SEGMENT, min_revisit_bytes: int = 0) -> DataFrame:
    """pages(page_id, url, html) to one row per record segment, as bytes of the archive in a string."""
    src = pages.select("page_id", "url", F.coalesce(F.col("html").cast("binary"), F.lit(b"")).alias("payload"))
    src = src.withColumn("digest", base32_sha1(F.col("payload")))
    many = src.where(F.length("payload") >= min_revisit_bytes).groupBy("digest").agg(F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("copies")).where("copies > 1").select(F.col("digest").alias("dup"), "first_id")
    many = common.cut(many)
    many = F.broadcast(many) if many.count() <= BROADCAST_DIGESTS else many
    src = src.join(many, (src["digest"] == many["dup"]) & (F.length("payload") >= min_revisit_bytes), "left")
    revisit = F.col("first_id").isNotNull() & F.col("page_id").isNotNull() & (F.col("page_id") != F.col("first_id"))
    src = src.select("page_id", "url", "digest", F.length("payload").cast("long").alias("full"), F.when(revisit, F.col("first_id")).alias("refers"), F.when(revisit, F.lit(b"")).otherwise(F.col("payload")).alias("payload"))
    n_seg = F.greatest(F.lit(1), F.ceil(F.length("payload") / segment_bytes)).cast("int")
    src = src.withColumn("n_seg", n_seg).withColumn("seg", F.explode(F.sequence(F.lit(1), n_seg)))
    body = F.substring("payload", (F.col("seg") - 1) * segment_bytes + 1, F.lit(segment_bytes))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("full").cast("string"), F.lit(END)).cast("binary")
    block = F.when((F.col("seg") == 1) & F.col("refers").isNull(), F.concat(http, body)).otherwise(body)
    rid = F.concat(F.lit("<urn:x-page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("null")), F.lit(">"))
    kind = F.when(F.col("seg") > 1, "continuation").when(F.col("refers").isNotNull(), "revisit").otherwise("response")
    line = lambda name, value: F.concat(F.lit(f"\r\n{name}: "), value)
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "), kind,
        F.when(F.col("seg") == 1, line("WARC-Record-ID", rid)).otherwise(line("WARC-Record-ID", F.concat(F.expr("left(page, length(page) - 1)"), F.lit(":"), F.col("seg").cast("string"), F.lit(">")))),
        line("WARC-Date", F.lit("1970-01-01T00:00:00Z")),
        line("WARC-Target-URI", F.regexp_replace(F.coalesce(F.col("url"), F.lit("")), r"[\x00-\x20]", "%20")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        F.when(F.col("n_seg") > 1, line("WARC-Segment-Number", F.col("seg").cast("string"))).otherwise(F.lit("")),
        F.when(F.col("seg") > 1, line("WARC-Segment-Origin-ID", rid)).otherwise(F.lit("")),
        F.when((F.col("seg") == F.col("n_seg")) & (F.col("n_seg") > 1), line("WARC-Segment-Total-Length", F.col("full").cast("string"))).otherwise(F.lit("")),
        F.when(F.col("refers").isNotNull(), F.concat(line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")), line("WARC-Refers-To", F.concat(F.lit("<urn:x-page:"), F.col("refers").cast("string"), F.lit(">"))), line("X-Payload-Length", F.col("full").cast("string")))).otherwise(F.lit("")),
        F.when(F.col("refers").isNull(), line("Content-Type", F.lit("application/http; msgtype=response"))).otherwise(F.lit("")),
        line("Content-Length", F.length(block).cast("string")), F.lit(END),
    )
    return src.withColumn("page", rid).select(F.concat(head.cast("binary"), block).cast("string").alias("value"))


def write(pages: DataFrame, path: str, compression: str = "gzip", segment_bytes: int = SEGMENT, min_revisit_bytes: int = 0) -> None:
    """Writes archives into the folder `path`, one file per partition. Readers must not split the files, so they are compressed."""
    if compression not in ("gzip", "deflate"):
        raise ValueError(f"not a compression that keeps files whole: {compression!r}")
    records(pages, segment_bytes, min_revisit_bytes).write.option("lineSep", END).option("compression", compression).text(path)


class WarcChunks:
    """Incremental parser: feed() bytes, get chunk rows (see CHUNK_SCHEMA)."""

    def __init__(self, chunk_bytes: int = CHUNK):
        self.limit, self.buf, self.todo, self.skip_http, self.record = chunk_bytes, bytearray(), None, False, None
        self.open, self.seen = False, 0  # more segments to come; how far the end of a header was looked for

    def _start(self, head: bytes) -> None:
        lines = head.decode("utf-8", "replace").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
        f = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        self.todo = int(f.get("content-length", 0))
        if f.get("warc-type") != "continuation":
            self.record = {"id": f.get("warc-record-id", "").strip("<>"), "type": f.get("warc-type", ""), "sha1": hashlib.sha1(), "n": 0, "no": 0, "refers": f.get("warc-refers-to", "").strip("<>") or None, "digest": f.get("warc-payload-digest", "").removeprefix("sha1:") or None, "full": f.get("x-payload-length")}
            self.skip_http = "application/http" in f.get("content-type", "")
            self.open = "warc-segment-number" in f
        else:
            self.open = "warc-segment-total-length" not in f

    def _row(self, piece: bytes, last: bool) -> tuple:
        r = self.record
        r["sha1"].update(piece)
        r["n"] += len(piece)
        r["no"] += 1
        return (r["id"], r["type"], r["no"] - 1, len(piece), base64.b32encode(r["sha1"].digest()).decode(), r["n"], last, r["refers"], r["digest"], int(r["full"]) if r["full"] is not None else r["n"], piece)

    def feed(self, data: bytes) -> Iterator[tuple]:
        buf, at = self.buf, 0
        buf += data
        while True:
            if self.todo is None:  # between records, or in a header
                while at < len(buf) and buf[at] in b"\r\n":
                    at += 1
                end = buf.find(b"\r\n\r\n", max(at, self.seen))
                if end < 0:
                    self.seen = max(at, len(buf) - 3)
                    break
                self._start(bytes(buf[at:end]))
                at = end + 4
            if self.skip_http and self.todo:
                end = buf.find(b"\r\n\r\n", max(at, self.seen), at + self.todo)
                if end < 0:
                    if len(buf) - at >= self.todo:
                        raise ValueError(f"HTTP header without an end in record {self.record['id'][:80]!r}")
                    self.seen = max(at, len(buf) - 3)
                    break
                at, self.todo, self.skip_http = end + 4, self.todo - (end + 4 - at), False
            n = min(self.limit, self.todo)
            if len(buf) - at < n:
                break
            self.todo -= n
            last = not self.todo and not self.open
            if n or last:
                yield self._row(bytes(buf[at : at + n]), last)
            at += n
            if not self.todo:
                self.todo = None
        del buf[:at]
        self.seen = max(0, self.seen - at)

    def close(self) -> None:
        """To be called where the input ends: raises if a record or bytes are left."""
        if self.todo is not None or self.open or self.buf:
            raise ValueError(f"input ends within a record: {len(self.buf)} bytes left, after {self.record['id'][:80] if self.record else None!r}")

    def stream(self, file, read_bytes: int = CHUNK) -> Iterator[tuple]:
        """Chunk rows of an open binary file of any size."""
        while data := file.read(read_bytes):
            yield from self.feed(data)
        self.close()


def read(spark: SparkSession, path: str, chunk_bytes: int = CHUNK, payload: bool = True) -> DataFrame:
    """The chunked record table of the archives in a folder, in the order of each file; payload=False leaves the chunks' bytes out.

    Gzipped files aren't split, so a task reads whole files one after another, as pieces.
    """

    def parse(batches):
        parser = WarcChunks(chunk_bytes)
        rows: list[tuple] = []
        held = 0
        names = [x.split()[0] for x in CHUNK_SCHEMA.split(", ")]
        types = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.bool_(), pa.string(), pa.string(), pa.int64(), pa.binary()]
        out = lambda: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)
        for batch in batches:
            for line in batch.column(0):
                for row in parser.feed(line.as_py() + b"\n"):
                    rows.append(row if payload else (*row[:-1], None))
                    held += row[3] if payload else 0
                    if len(rows) >= 1000 or held >= 1 << 23:
                        yield out()
                        rows.clear()
                        held = 0
        parser.close()
        if rows:
            yield out()

    lines = spark.read.option("lineSep", "\n").text(path).select(F.col("value").cast(BinaryType()).alias("value"))
    return lines.mapInArrow(parse, CHUNK_SCHEMA)


def round_trip(pages: DataFrame, segment_bytes: int = SEGMENT) -> DataFrame:
    """Writes the archives to the shared folder and reads them back: one row per record."""
    spark = pages.sparkSession
    path = common.scratch(spark, "warc")
    write(pages, path, segment_bytes=segment_bytes)
    done = read(spark, path, payload=False).where("last")
    number = lambda c: F.nullif(F.substring_index(c, ":", -1), F.lit("null")).cast("long")
    revisit = F.col("warc_type") == "revisit"
    return done.select(
        number(F.col("record_id")).alias("page_id"), F.col("full_bytes").alias("payload_bytes"),
        F.when(revisit, F.col("full_digest")).otherwise(F.col("sha1")).alias("payload_digest"),
        F.col("warc_type").alias("record_type"), number(F.col("refers_to")).alias("refers_to"),
        (revisit | (F.col("sha1") == F.col("full_digest"))).alias("digest_ok"), (F.col("chunk_no") + 1).alias("n_chunks"),
    )


SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS body FROM pages),
d AS (SELECT page_id, octet_length(body)::BIGINT AS n, sha1(body) AS h FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY h) AS first_id FROM d)
SELECT page_id, n AS payload_bytes,
       translate(array_to_string([lpad(to_base(('0x' || substr(h, 1 + 5 * i, 5))::BIGINT, 32), 4, '0') FOR i IN range(8)], ''), '0123456789ABCDEFGHIJKLMNOPQRSTUV', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567') AS payload_digest,
       CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first_id THEN first_id END AS refers_to,
       true AS digest_ok, CASE WHEN page_id <> first_id THEN 1 ELSE greatest(1, ceil(n / 262144.0)) END::BIGINT AS n_chunks
FROM f
"""
