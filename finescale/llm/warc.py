"""WARC archives as a Spark sink and source.

Writing: one record per page, an HTTP response in chunked transfer framing, cut into segments where it is long: the first
record is segment 1, the others are ``continuation`` records that name its id, their number and, in the last, the total length.
Of records with equal payloads of at least ``revisit_from`` bytes, those with the smallest page id are responses, later ones
revisits without payload. Spark's text writer makes the files: a row is a record, the line separator is the blank line pair
that ends every WARC record.

Reading: every file is parsed by content lengths, wherever a payload may hold what looks like a header. Segments are grouped
by origin, ordered, checked for gaps and against the total length, joined, and their chunk framing is undone. A record whose
segments or chunks do not add up is returned with ``intact`` false and no payload.

A file holds at most ``records_per_file`` records of ``segment`` bytes and some headers each, which bounds what a task holds. Files are compressed whole by ``compression`` (``none`` for plain ones).
Null html counts as empty, a null url leaves out that header, a page without an id is always written whole and read with a
null id. Rows that repeat a page id are all written; of equal copies of the smallest id all are responses. Other columns are
ignored; an empty table gives an archive without records.
"""

from __future__ import annotations

import gzip
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

END = b"\r\n\r\n"
CHUNK = 8192
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD = ("record_id string, record_type string, target_uri string, refers_to string, payload_digest string, "
          "segment_number int, origin_id string, total_length bigint, block binary")


def chunked(payload: bytes, size: int = CHUNK) -> bytes:
    """Chunked transfer framing."""
    parts = []
    for at in range(0, len(payload), size):
        part = payload[at:at + size]
        parts += [b"%x\r\n" % len(part), part, b"\r\n"]
    return b"".join(parts) + b"0\r\n\r\n"


def unchunked(framed: bytes) -> bytes | None:
    """Payload of a chunked body, or None where the framing is broken. Extensions and trailers are skipped."""
    parts, at = [], 0
    while True:
        end = framed.find(b"\r\n", at)
        size = re.fullmatch(rb"\s*([0-9a-fA-F]+)\s*(?:;.*)?", framed[at:end]) if end >= 0 else None
        if not size:
            return None
        n, at = int(size[1], 16), end + 2
        if not n:
            return b"".join(parts)
        if framed[at + n:at + n + 2] != b"\r\n":
            return None
        parts.append(framed[at:at + n])
        at += n + 2


def record(fields: list[tuple[str, object]], block: bytes) -> bytes:
    """A record without the blank lines at its end."""
    head = "".join(f"{k}: {v}\r\n" for k, v in fields if v is not None)
    return b"WARC/1.1\r\n" + head.encode() + b"Content-Length: %d\r\n\r\n" % len(block) + block


def _uri(url: str | None) -> str | None:
    return None if url is None else re.sub(r"[\s\x00-\x1f\x7f]", lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), url)


def records(page: int | None, url: str | None, digest: str, refers_to: int | None, payload: bytes, unique: str, segment: int,
            date: str) -> Iterator[bytes]:
    """The records of one page."""
    name = "none" if page is None else page
    common = [("WARC-Date", date), ("WARC-Target-URI", _uri(url)), ("WARC-Payload-Digest", f"sha256:{digest}"),
              ("Content-Type", "application/http;msgtype=response")]
    if refers_to is not None:
        yield record([("WARC-Type", "revisit"), ("WARC-Record-ID", f"<urn:page:{name}>"), ("WARC-Profile", PROFILE),
                      ("WARC-Refers-To", f"<urn:page:{refers_to}>"), *common], HTTP)
        return
    block = HTTP + chunked(payload)
    if len(block) <= segment:
        yield record([("WARC-Type", "response"), ("WARC-Record-ID", f"<urn:page:{name}>"), *common], block)
        return
    origin = f"<urn:page:{name}:{unique}>"
    for k, at in enumerate(range(0, len(block), segment), 1):
        if k == 1:
            fields = [("WARC-Type", "response"), ("WARC-Record-ID", origin), *common, ("WARC-Segment-Number", 1)]
        else:
            fields = [("WARC-Type", "continuation"), ("WARC-Record-ID", f"<urn:page:{name}:{unique}:{k}>"), ("WARC-Date", date),
                      ("WARC-Segment-Origin-ID", origin), ("WARC-Segment-Number", k),
                      ("WARC-Segment-Total-Length", len(block) if at + segment >= len(block) else None)]
        yield record(fields, block[at:at + segment])


def write_archive(pages: DataFrame, path: str, revisit_from: int = 100, segment: int = 16_384, records_per_file: int = 8_192,
                  date: str = "1970-01-01T00:00:00Z", compression: str = "gzip") -> None:
    """Writes ``page_id, url, html`` to WARC files below ``path``. Which pages revisit which is found on ids and digests
    alone; the payloads then meet their page id, so that a payload that a third of all pages share is not one key."""
    base = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"),
                        F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload"))
    base = base.withColumn("digest", F.sha2("payload", 256))
    ids = base.filter(F.octet_length("payload") >= revisit_from).select("page_id", "digest")
    shared = ids.groupBy("digest").agg(F.min("page_id").alias("first"), F.max("page_id").alias("last")).filter("first < last")
    revisits = (ids.join(shared.select("digest", "first"), "digest").filter("page_id > first")
                .groupBy("page_id", "digest").agg(F.min("first").alias("refers_to")))
    rows = base.join(revisits, ["page_id", "digest"], "left").select("page_id", "url", "digest", "refers_to", "payload")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, out, size = 0, [], 0
        at = TaskContext.get().partitionId()
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                for row in zip(*(c.to_pylist() for c in batch.slice(k, 256).columns)):
                    number += 1
                    for x in records(*row, f"{at}.{number}", segment, date):
                        out.append(x)
                        size += len(x)
                        if size > 8 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["value"])
                            out, size = [], 0
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["value"])

    (rows.mapInArrow(task, "value binary").select(F.col("value").cast("string"))
     .write.option("lineSep", END.decode()).option("maxRecordsPerFile", records_per_file).option("compression", compression)
     .text(path))


_FIELD = re.compile(rb"(?m)^([A-Za-z-]+):[ \t]*(.*?)[ \t]*\r?$")


def parse(data: bytes) -> Iterator[tuple]:
    """Rows of ``RECORD`` from the bytes of one file. A header without an end, a length or its bytes is an error: what follows cannot be
    trusted, and no record is lost unseen."""
    if data[:2] == b"\x1f\x8b":
        data = gzip.decompress(data)
    at = 0
    while (at := data.find(b"WARC/", at)) >= 0:
        end = data.find(END, at)
        if end < 0:
            raise ValueError(f"damaged record at byte {at}: its header does not end")
        fields = {k.lower(): v.decode() for k, v in _FIELD.findall(data, at, end)}
        length = int(fields.get(b"content-length", "-1"))
        if length < 0 or end + 4 + length > len(data):
            raise ValueError(f"damaged record at byte {at}: no length, or fewer bytes than it says")
        number, total = fields.get(b"warc-segment-number"), fields.get(b"warc-segment-total-length")
        yield (fields.get(b"warc-record-id"), fields.get(b"warc-type"), fields.get(b"warc-target-uri"), fields.get(b"warc-refers-to"),
               fields.get(b"warc-payload-digest"), number and int(number), fields.get(b"warc-segment-origin-id"), total and int(total),
               data[end + 4:end + 4 + length])
        at = end + 4 + length


_KINDS = [pa.string()] * 5 + [pa.int32(), pa.string(), pa.int64(), pa.binary()]
_NAMES = [f.split()[0] for f in RECORD.split(", ")]


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Every record of the archive as it is stored."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                out, size = [], 0
                for row in parse(batch.column("content")[k].as_py()):
                    out.append(row)
                    size += len(row[-1])
                    if size > 8 << 20:
                        yield _table(out)
                        out, size = [], 0
                yield _table(out)

    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(task, RECORD)


def _table(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * 9, _KINDS)], names=_NAMES)


def reassembled(found: DataFrame) -> DataFrame:
    """Records of ``read_records`` with segments joined and payloads decoded: ``record_id, record_type, target_uri, refers_to,
    payload_digest, payload, intact``. Only segments are shuffled, by their origin."""
    whole = found.filter("segment_number IS NULL").select(
        "record_id", "record_type", "target_uri", "refers_to", "payload_digest", F.lit(None).cast("bigint").alias("total"),
        F.array(F.struct(F.lit(1).alias("n"), "block")).alias("segments"))
    first = F.col("segment_number") == 1
    joined = found.filter("segment_number IS NOT NULL").groupBy(F.coalesce("origin_id", "record_id").alias("record_id")).agg(
        *[F.max(F.when(first, F.col(c))).alias(c) for c in ("record_type", "target_uri", "refers_to", "payload_digest")],
        F.max("total_length").alias("total"), F.collect_list(F.struct(F.col("segment_number").alias("n"), "block")).alias("segments"))
    joined = joined.withColumn("total", F.coalesce("total", F.lit(-1)))

    def body(total: int | None, segments: list[dict]) -> tuple[bytes | None, bool]:
        segments.sort(key=lambda s: s["n"])
        block = b"".join(s["block"] for s in segments)
        if [s["n"] for s in segments] != list(range(1, len(segments) + 1)) or total not in (None, len(block)):
            return None, False
        head, split, rest = block.partition(END)
        payload = rest if b"chunked" not in head.lower() else unchunked(rest)
        return payload, bool(split) and payload is not None

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                revisit = [t == "revisit" for t in part.column("record_type").to_pylist()]
                got = [(None, True) if r else body(t, s) for r, t, s in
                       zip(revisit, part.column("total").to_pylist(), part.column("segments").to_pylist())]
                yield pa.RecordBatch.from_arrays([*part.columns[:5], pa.array([p for p, _ in got], pa.binary()),
                                                  pa.array([i for _, i in got], pa.bool_())],
                                                 names=[*part.schema.names[:5], "payload", "intact"])

    return whole.unionByName(joined).mapInArrow(
        task, "record_id string, record_type string, target_uri string, refers_to string, payload_digest string, "
              "payload binary, intact boolean")


def page_of(name: str) -> F.Column:
    return F.regexp_extract(F.col(name), r"^<urn:page:(-?\d+)", 1).try_cast("bigint")


def summary(read: DataFrame) -> DataFrame:
    """Per record what a revisit leaves out, too: ``page_id, payload_bytes, payload_digest, record_type, refers_to``. Raises
    where a record does not hold what its digest says."""
    from finescale.llm.shared import written
    kept = F.substring_index("payload_digest", ":", -1)
    own = F.when(F.col("record_type") == "response", F.sha2("payload", 256)).otherwise(kept)
    sound = F.col("intact") & (own == kept)
    slim = written(read.select(
        page_of("record_id").alias("page_id"), F.octet_length("payload").cast("bigint").alias("payload_bytes"),
        F.when(sound, own).otherwise(F.raise_error(F.concat(F.lit("damaged record "), "record_id"))).alias("payload_digest"),
        "record_type", page_of("refers_to").alias("refers_to")), "warc-read")
    responses = slim.filter("record_type = 'response'")
    sizes = responses.filter("page_id IS NOT NULL").groupBy(F.col("page_id").alias("refers_to"), "payload_digest").agg(
        F.max("payload_bytes").alias("bytes"))
    revisits = slim.filter("record_type = 'revisit'").join(sizes, ["refers_to", "payload_digest"], "left").select(
        "page_id", F.col("bytes").alias("payload_bytes"), "payload_digest", "record_type", "refers_to")
    return responses.unionByName(revisits)


ORACLE = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
r AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS head FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN head < page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN head < page_id THEN head END AS refers_to FROM r"""
