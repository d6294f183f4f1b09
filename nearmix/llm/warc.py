"""WARC archives of web pages: writing, reading back, and reassembly of segmented records.

Writing. One record per page. Pages of equal payload are found by the payload's digest: of those
of at least ``least_bytes`` bytes, the one with the largest page_id becomes a response and the
others revisit it. A response's block is an HTTP message in chunked transfer framing; blocks
longer than ``segment_bytes`` are cut into a first segment and continuation records that name
their origin and number, the last with the total length. Records are spread over files of bounded
size and written by Spark's text writer, which sends the bytes as they are; the record separator
is its line separator, so each file is a valid archive. With ``compression="gzip"`` the file is
one gzip member.

Reading. Files come as whole, bounded binaries; records are cut by their Content-Length. Segments
are grouped by the origin record, ordered by number, checked for gaps and against the total
length, and the chunked framing is decoded. A revisit takes its payload's size and digest from
the response it refers to.

Defined results: a null html is an empty payload; a null page_id stays null, and of equal
payloads with null ids only, each is a response; repeated rows of the response are responses
both, rows that repeat in id and payload give repeated result rows; a null url is an empty
target. A broken archive (gap, wrong length, broken chunk) raises an error.
"""

from __future__ import annotations

import base64
import gzip
import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from nearmix.llm.common import Scratch, map_texts, table

SEPARATOR = "\r\n\r\n"
CHUNK_BYTES = 4096
SEGMENT_BYTES = 16_384
#: Bytes of payload that one archive file is planned for.
FILE_BYTES = 16 << 20
_ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_DATE = "1970-01-01T00:00:00Z"


def base32_sha1(hexed: Column) -> Column:
    """Bare upper-case base32 of a SHA-1 in hexadecimal digits."""
    parts = [F.lpad(F.conv(F.substring(hexed, 1 + 10 * i, 10), 16, 32), 8, "0") for i in range(4)]
    return F.translate(F.upper(F.concat(*parts)), "0123456789ABCDEFGHIJKLMNOPQRSTUV", _ALPHABET)


def chunked(payload: bytes, size: int = CHUNK_BYTES) -> bytes:
    parts = []
    for at in range(0, len(payload), size):
        part = payload[at : at + size]
        parts += [b"%x\r\n" % len(part), part, b"\r\n"]
    return b"".join([*parts, b"0\r\n\r\n"])


def unchunked(body: bytes) -> bytes:
    parts, at = [], 0
    while True:
        end = body.index(b"\r\n", at)
        size = int(body[at:end].split(b";")[0], 16)
        at = end + 2
        if not size:
            return b"".join(parts)
        if body[at + size : at + size + 2] != b"\r\n":
            raise ValueError("a chunk does not end where its size says")
        parts.append(body[at : at + size])
        at += size + 2


def payload_of(block: bytes) -> bytes:
    """The payload of an HTTP response block."""
    head, _, body = block.partition(b"\r\n\r\n")
    return unchunked(body) if b"transfer-encoding: chunked" in head.lower() else body


def _record(fields: list[tuple[str, str]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in [*fields, ("Content-Length", str(len(block)))])
    return b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block


def records_of(page_id, url: str | None, html: str | None, kind: str, refers_to, digest: str, segment: int = SEGMENT_BYTES) -> list[bytes]:
    """A page's records without separators: one, or a first segment and its continuations."""
    name = f"<urn:page:{page_id}:{digest}>"
    target = "".join(c for c in url or "" if c > " ")
    common = [("WARC-Date", _DATE), ("WARC-Target-URI", target), ("WARC-Payload-Digest", f"sha1:{digest}")]
    typed = [("Content-Type", "application/http;msgtype=response")]
    if kind == "revisit":
        profile = [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")]
        refers = [("WARC-Refers-To", f"<urn:page:{refers_to}:{digest}>")]
        return [_record([("WARC-Type", kind), ("WARC-Record-ID", name), *common, *profile, *refers, *typed], b"HTTP/1.1 200 OK\r\n\r\n")]
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
    block = head + chunked((html or "").encode("utf-8", "surrogatepass"))
    cuts = list(range(0, len(block), segment))
    if len(cuts) == 1:
        return [_record([("WARC-Type", kind), ("WARC-Record-ID", name), *common, *typed], block)]
    out = [_record([("WARC-Type", kind), ("WARC-Record-ID", name), *common, ("WARC-Segment-Number", "1"), *typed], block[:segment])]
    for n, at in enumerate(cuts[1:], 2):
        own = [("WARC-Type", "continuation"), ("WARC-Record-ID", f"<urn:page:{page_id}:{digest}:{n}>"), ("WARC-Date", _DATE), ("WARC-Target-URI", target)]
        own += [("WARC-Segment-Origin-ID", name), ("WARC-Segment-Number", str(n))]
        if at == cuts[-1]:
            own.append(("WARC-Segment-Total-Length", str(len(block))))
        out.append(_record(own, block[at : at + segment]))
    return out


def parse(archive: bytes):
    """(fields with lower-case names, block) of each record of an archive."""
    if archive[:2] == b"\x1f\x8b":
        archive = gzip.decompress(archive)
    at = 0
    while at < len(archive):
        end = archive.index(b"\r\n\r\n", at)
        lines = archive[at:end].decode().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError("a record does not begin where the one before ends")
        fields = {k.lower(): v for k, _, v in (line.partition(": ") for line in lines[1:])}
        if "content-length" not in fields:
            raise ValueError("a record doesn't tell its length")
        begin = end + 4
        stop = begin + int(fields["content-length"])
        if archive[stop : stop + 4] != b"\r\n\r\n":
            raise ValueError("a record is cut short")
        yield fields, archive[begin:stop]
        at = stop + 4


def typed_pages(pages: DataFrame, scratch: Scratch, least_bytes: int = 0) -> DataFrame:
    """pages(page_id, url, html) with digest, record_type and refers_to.

    The ids to refer to are gathered per digest from ids and digests alone; only payloads that
    occur more than once take part in the join with the pages.
    """
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce("html", F.lit("")).alias("html")
    ).withColumn("sha1", F.sha1("html"))
    long_ = rows.where(F.octet_length("html") >= least_bytes)
    same = long_.groupBy("sha1").agg(F.max("page_id").alias("first"), F.count("*").alias("n")).where("n > 1 AND first IS NOT NULL")
    same = scratch.store(same.select("sha1", "first"), "same")
    joined = rows.join(same, "sha1", "left")
    revisits = F.coalesce((F.octet_length("html") >= least_bytes) & F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first")), F.lit(False))
    return joined.select(
        "page_id", "url", F.when(~revisits, F.col("html")).alias("html"), base32_sha1(F.col("sha1")).alias("digest"),
        F.when(revisits, F.lit("revisit")).otherwise(F.lit("response")).alias("record_type"), F.when(revisits, F.col("first")).alias("refers_to"),
    )


def write_warc(
    pages: DataFrame, path: str, scratch: Scratch, least_bytes: int = 0, segment: int = SEGMENT_BYTES, compression: str | None = "gzip"
) -> None:
    """Write pages(page_id, url, html) as archives under ``path``."""

    def step(batch: pa.RecordBatch):
        values = []
        for row in zip(*[batch.column(n).to_pylist() for n in ("page_id", "url", "html", "record_type", "refers_to", "digest")], strict=True):
            values += records_of(*row, segment=segment)
        return pa.RecordBatch.from_arrays([pa.array(values, pa.binary())], names=["value"])

    names = ["page_id", "url", "html", "digest", "record_type", "refers_to"]
    records = map_texts(typed_pages(pages, scratch, least_bytes), names, "value binary", lambda: step, 128)
    per_file = max(1, FILE_BYTES // (segment + 1024))
    writer = records.select(F.col("value").cast("string")).write.option("lineSep", SEPARATOR).option("maxRecordsPerFile", per_file)
    writer.text(path, compression=compression or "none")


def _joined(parts: list[dict]) -> bytes:
    """A record's block from its segments, in any order; equal numbers come from repeated rows."""
    by = {p["number"]: p for p in parts}
    if sorted(by) != list(range(1, len(by) + 1)):
        raise ValueError("a segment is missing")
    block = b"".join(by[n]["block"] for n in sorted(by))
    total = by[len(by)]["total"]
    if len(by) > 1 and total != len(block):
        raise ValueError("the segments don't add up to the total length")
    return block


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Archives -> (record_id, page_id, record_type, refers_to, digest, payload), a row per response and revisit.

    Payloads are whole and verified; a revisit's payload is null.
    """
    files = spark.read.format("binaryFile").load(path).select("content")

    def step(batch: pa.RecordBatch):
        out = []
        for content in batch.column(0).to_pylist():
            for f, block in parse(content):
                number = int(f.get("warc-segment-number", "1"))
                total = int(f["warc-segment-total-length"]) if "warc-segment-total-length" in f else None
                kind = f["warc-type"]
                origin = f.get("warc-segment-origin-id", f["warc-record-id"])
                digest = f.get("warc-payload-digest", "").removeprefix("sha1:")
                out.append((origin, kind, number, total, f.get("warc-refers-to"), digest, None if kind == "revisit" else block))
            if sum(len(x[-1] or b"") for x in out) > 4 << 20:
                yield pack(out)
                out = []
        if out:
            yield pack(out)

    def pack(rows):
        kinds = [pa.string(), pa.string(), pa.int32(), pa.int64(), pa.string(), pa.string(), pa.binary()]
        columns = list(zip(*rows, strict=True))
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=_FIELDS)

    schema = "origin string, kind string, number int, total long, refers_to string, digest string, block binary"
    parts = map_texts(files, ["content"], schema, lambda: step, 1)
    grouped = parts.groupBy("origin").agg(
        F.max(F.when(F.col("kind") != "continuation", F.col("kind"))).alias("kind"),
        F.max("refers_to").alias("refers_to"),
        F.max(F.when(F.col("kind") != "continuation", F.col("digest"))).alias("digest"),
        F.collect_list(F.when(F.col("kind") != "revisit", F.struct("number", "total", "block"))).alias("parts"),
        F.sum((F.col("kind") != "continuation").cast("long")).alias("copies"),
    )

    def assemble(batch: pa.RecordBatch):
        payloads = []
        for kind, parts_, digest in zip(batch.column(1).to_pylist(), batch.column(4).to_pylist(), batch.column(3).to_pylist(), strict=True):
            if kind is None:
                raise ValueError("continuation records without their first segment")
            payload = None if kind == "revisit" else payload_of(_joined(parts_))
            if payload is not None and base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
                raise ValueError("a payload does not have the digest that its record names")
            payloads.append(payload)
        return pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), batch.column(2), batch.column(3), batch.column(5), pa.array(payloads, pa.binary())],
            names=["record_id", "record_type", "refers_to", "digest", "copies", "payload"],
        )

    whole = map_texts(
        grouped, ["origin", "kind", "refers_to", "digest", "parts", "copies"],
        "record_id string, record_type string, refers_to string, digest string, copies long, payload binary", lambda: assemble, 64,
    )
    page = lambda c: F.expr(f"try_cast(split_part({c}, ':', 3) AS bigint)")
    return whole.select(
        "record_id", page("record_id").alias("page_id"), "record_type", page("refers_to").alias("refers_to"),
        F.col("refers_to").alias("refers_to_record"), "digest", "copies", "payload",
    )


_FIELDS = ["origin", "kind", "number", "total", "refers_to", "digest", "block"]


def warc_round_trip(pages: DataFrame, least_bytes: int = 0, segment: int = SEGMENT_BYTES, name: str = "warc") -> DataFrame:
    """Write pages as archives in the shared folder, read them back and describe each page's record."""
    spark = pages.sparkSession
    scratch = Scratch(spark, name)
    path = scratch.path("archive")
    write_warc(pages, path, scratch, least_bytes, segment)
    read = read_warc(spark, path).withColumn("payload_bytes", F.octet_length("payload").cast("long")).drop("payload", "page")
    read = scratch.store(read, "read")
    scratch.drop_path(path)
    answers = read.where("record_type = 'response'").select(F.col("record_id").alias("refers_to_record"), F.col("payload_bytes").alias("full"))
    joined = read.where("record_type = 'revisit'").join(answers, "refers_to_record").withColumn("payload_bytes", F.col("full"))
    names = ["page_id", "payload_bytes", F.col("digest").alias("payload_digest"), "record_type", "refers_to", "copies"]
    both = read.where("record_type = 'response'").select(*names).unionByName(joined.select(*names))
    each = F.explode(F.expr("sequence(1, copies)"))
    return both.select("*", each.alias("copy")).drop("copies", "copy")


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_round_trip(table(spark, sf_dir, "pages"), name="op7")


OP7_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS sha FROM pages),
g AS (SELECT sha, max(page_id) AS first FROM p GROUP BY sha HAVING count(*) > 1),
b AS (SELECT i, CAST(i AS BIGINT) AS k FROM range(32) AS t(i)),
d AS (
  SELECT sha, string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + CAST((CAST('0x' || substr(sha, 1 + 10 * (k // 8), 10) AS BIGINT) >> CAST(35 - 5 * (k % 8) AS BIGINT)) & 31 AS BIGINT), 1), '' ORDER BY k) AS digest
  FROM (SELECT DISTINCT sha FROM p), b GROUP BY sha)
SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, digest AS payload_digest,
  CASE WHEN first IS NULL OR page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to
FROM p JOIN d USING (sha) LEFT JOIN g USING (sha)
"""
