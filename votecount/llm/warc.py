"""WARC archives in Zstandard with a dictionary, written and read by Spark's own file code.

An archive begins with a skippable frame that holds the dictionary; then every record is a frame of
its own, followed by an empty skippable frame, which decoders pass over. That empty frame is at the
same time the row separator of Spark's text writer and reader, so archives go through the usual
commit protocol to any store (a lost executor's file is written again, never half a file), and
are read back in splits however large they are, one record at a time. The dictionary is trained
once on a bounded sample of records (``SAMPLE_ROWS`` payloads, the smallest by digest, of each
its first ``SAMPLE_BYTES``) and embedded in every archive; with too few records there is none.

Records of equal payload: the one with the smallest page id is a response, the others are revisits
that name it. The smallest id per digest is aggregated map-side first and joined back; only digests
that repeat take part, and a hot payload's rows are split by the run-time skew join.

Edge cases: a null payload counts as empty; rows that repeat the smallest id with the same payload
are all responses; a null id is written as such and is a response only if no row with that payload
has an id; a null URL leaves out the header; line breaks in a URL are escaped; an empty table
writes no archive and reads back no rows.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from votecount.llm.common import fresh, shared_folder

LEVEL = 3
DICTIONARY_BYTES = 32 << 10
SAMPLE_ROWS, SAMPLE_BYTES = 512, 8 << 10
#: A fixed stamp: the pages carry none, and archives of equal pages should be equal.
DATE = "2024-01-01T00:00:00Z"
#: An empty skippable frame, and the head of the one that holds a dictionary.
SEPARATOR = b"\x50\x2a\x4d\x18\x00\x00\x00\x00"
DICTIONARY_MAGIC = b"\x5d\x2a\x4d\x18"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id, url: str | None, payload: bytes, first_id=None, revisit: bool = False, sha1: str | None = None) -> bytes:
    """One WARC record; a revisit holds the headers of the response only."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    digest = base64.b32encode(bytes.fromhex(sha1)).decode() if sha1 else payload_digest(payload)
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:page:{'null' if page_id is None else page_id}>",
        f"WARC-Date: {DATE}",
    ]
    if url is not None:
        lines.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    if revisit:
        lines += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: <urn:page:{first_id}>"]
    lines += [
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> dict:
    """What a record says; a response's payload is held against its digest."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(re.search(rb"Content-Length: (\d+)", http)[1])
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    kind = fields["WARC-Type"]
    if kind == "response" and (len(payload) != size or payload_digest(payload) != digest):
        raise ValueError(f"{fields['WARC-Record-ID']}: the payload does not match its digest")

    def number(name: str) -> int | None:
        value = fields.get(name, "<urn:page:null>")[len("<urn:page:") : -1]
        return None if value in ("null", "None") else int(value)

    return {
        "page_id": number("WARC-Record-ID"),
        "url": fields.get("WARC-Target-URI"),
        "payload": payload if kind == "response" else None,
        "payload_bytes": size,
        "payload_digest": digest,
        "record_type": kind,
        "refers_to": number("WARC-Refers-To") if kind == "revisit" else None,
    }


def train(pages: DataFrame) -> bytes | None:
    """A dictionary from a bounded sample of the records, or none if they are too few."""
    # First the digests alone, then the payloads of the smallest ones.
    first = pages.select("_sha").distinct().orderBy("_sha").limit(SAMPLE_ROWS).agg(F.max("_sha")).first()[0]
    sample = pages.where(F.col("_sha") <= F.lit(first or "")).groupBy("_sha").agg(
        F.min("_id").alias("_id"), F.min(F.substring(F.col("_payload").cast("binary"), 1, SAMPLE_BYTES)).alias("p")
    )
    sample = sample.orderBy("_sha").collect()
    records = [record(r._id, None, bytes(r.p), sha1=r._sha) for r in sample]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, records).as_bytes()
    except zstandard.ZstdError:
        return None


def _frames(dictionary: bytes | None) -> tuple[bytes, zstandard.ZstdCompressionDict | None]:
    """The leading skippable frame and the dictionary itself."""
    if dictionary is None:
        return b"", None
    held = dictionary
    if SEPARATOR in held:  # the format also allows a compressed dictionary
        held = zstandard.ZstdCompressor(level=19).compress(dictionary)
    return DICTIONARY_MAGIC + struct.pack("<I", len(held)) + held, zstandard.ZstdCompressionDict(dictionary)


def _compressed(compressors: list, data: bytes) -> bytes:
    """One frame in which the separator does not occur."""
    for c in compressors:
        if SEPARATOR not in (frame := c.compress(data)):
            return frame
    raise ValueError("no compression level keeps the separator out of this record")


def write(pages: DataFrame, path: str, key: str = "page_id", url: str = "url", payload: str = "html") -> str:
    """Write one archive per partition under ``path``; returns the path."""
    spark = pages.sparkSession
    rows = pages.select(
        F.col(key).cast("bigint").alias("_id"), F.col(url).alias("_url"), F.coalesce(F.col(payload), F.lit("")).alias("_payload")
    ).withColumn("_sha", F.sha1(F.col("_payload").cast("binary")))
    shared = spark.sparkContext.broadcast(train(rows))
    repeated = rows.groupBy("_sha").agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_n")).where("_n > 1")
    repeated = repeated.select(fresh(F.col("_sha")).alias("_key"), "_first")
    roles = rows.withColumn("_key", fresh(F.col("_sha"))).join(repeated, "_key", "left")
    revisit = F.col("_first").isNotNull() & ~F.col("_id").eqNullSafe(F.col("_first"))
    roles = roles.select("_id", "_url", "_payload", "_sha", "_first", revisit.alias("_revisit"))

    def archive(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lead, trained = _frames(shared.value)
        levels = (LEVEL, 1, 5, 9, 12, 15, 19)
        compressors = [zstandard.ZstdCompressor(level=n, dict_data=trained, write_checksum=True) for n in levels]
        out, size = ([lead] if lead else []), 0
        for batch in batches:
            columns = [batch.column(i) for i in range(batch.num_columns)]
            for i in range(batch.num_rows):
                at, link, text, sha, first, again = (c[i].as_py() for c in columns)
                out.append(_compressed(compressors, record(at, link, text.encode(), first, again, sha)))
                size += len(out[-1])
                if size > 1 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["frame"])
                    out, size = [], 0
        if size or len(out) > 1:
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["frame"])

    frames = roles.mapInArrow(archive, "frame binary").select(F.col("frame").cast("string").alias("value"))
    frames.write.option("lineSep", SEPARATOR.decode("latin-1")).text(path)
    return path


_ROW = pa.schema(
    [("page_id", pa.int64()), ("url", pa.string()), ("payload", pa.binary()), ("payload_bytes", pa.int64()),
     ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())]
)


def read(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """One row per record: page_id, url, payload (if asked for), payload_bytes, payload_digest, record_type, refers_to."""
    lines = spark.read.option("lineSep", SEPARATOR.decode("latin-1")).text(path)
    frames = lines.select(F.col("value").cast("binary").alias("frame"))
    is_dictionary = F.substring("frame", 1, 4) == F.lit(DICTIONARY_MAGIC)
    # The archives of one writing share one dictionary, so this is one row a writing.
    kept = frames.where(is_dictionary).distinct().collect()
    shared = spark.sparkContext.broadcast([bytes(r.frame)[8:] for r in kept])
    names = [f.name for f in _ROW if payload or f.name != "payload"]

    def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = {}
        for held in shared.value:
            if held[:4] == b"\x28\xb5\x2f\xfd":
                held = zstandard.ZstdDecompressor().decompress(held)
            d = zstandard.ZstdCompressionDict(held)
            known[d.dict_id()] = zstandard.ZstdDecompressor(dict_data=d)
        plain = zstandard.ZstdDecompressor()

        def table(rows: list[dict]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], _ROW.field(n).type) for n in names], names)

        for batch in batches:
            rows, size = [], 0
            for cell in batch.column(0):
                frame = cell.as_py()
                number = zstandard.get_frame_parameters(frame).dict_id
                data = (known[number] if number else plain).decompress(frame)
                rows.append(parse(data))
                size += len(data)
                if size > 4 << 20:
                    yield table(rows)
                    rows, size = [], 0
            if rows:
                yield table(rows)

    types = {"page_id": "bigint", "payload_bytes": "bigint", "refers_to": "bigint", "payload": "binary"}
    return frames.where(~is_dictionary).mapInArrow(opened, ", ".join(f"{n} {types.get(n, 'string')}" for n in names))


def archive_and_read(pages: DataFrame, key: str = "page_id", url: str = "url", payload: str = "html") -> DataFrame:
    """Write all pages, read the archives back: one row per page, as its record says."""
    path = write(pages, f"{shared_folder(pages.sparkSession)}/warc", key, url, payload)
    found = read(pages.sparkSession, path, payload=False)
    return found.select(F.col("page_id").alias(key), "payload_bytes", "payload_digest", "record_type", "refers_to")


_CHARS = " || ".join(
    f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(h, {5 * i + 1}, 5))::BIGINT >> {s}) & 31)::INTEGER + 1, 1)"
    for i in range(8)
    for s in (15, 10, 5, 0)
)
SQL = f"""
WITH p AS (
  SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages
), f AS (
  SELECT h, min(page_id) AS first_id FROM p GROUP BY h
)
SELECT page_id, payload_bytes, {_CHARS} AS payload_digest,
  CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = first_id THEN NULL ELSE first_id END AS refers_to
FROM p JOIN f USING (h)
"""
