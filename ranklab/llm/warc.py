"""Operator 10: WARC archives with segmented records.

Writing: each row becomes a WARC/1.1 record whose HTTP block carries the payload in
chunked transfer framing. Long blocks are split over a first record and continuation
records. Of rows with equal payloads one is a response and the others are revisit records
that refer to it. Spark's text writer writes the files (gzip), with the
blank lines that end a record as line separator; it works on every file
system Spark can write, and a lost task is simply written again.

Reading: files are parsed record by record by their Content-Length. Continuation
records are grouped by the identifier of their origin, ordered by segment number,
checked against the total length, and the chunked framing is decoded. Only
segmented records are shuffled with their bytes.

Defined results: a null payload is empty; a null url is written as an empty URI; a
null page_id sorts after all others (a response without id is referred to as null); rows tied at the smallest
page_id of equal payloads are all responses; equal rows (same id, url and payload) are
written and read back each; an empty table gives an empty archive. Damaged records
(missing segment, wrong length, bad framing, wrong digest) keep their row, with the fault in
``status`` and null payload.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ranklab.llm.common import in_tasks, register, shared_path, table
from ranklab.session import cut_lineage

SEGMENT_BYTES = 32 * 1024
CHUNK_BYTES = 8 * 1024
MIN_SHARED_BYTES = 100
FILE_BYTES = 128 << 20        # of an archive file, uncompressed: records are bounded, so their number bounds a file
HEAD_BYTES = 2048             # headers of a record, about
PIECE = 1 << 16              # bytes of a file that are inflated at once
HTTP_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

RAW = ("record_id string, kind string, page_id string, refers_to string, origin string, segment int, total long, "
       "digest string, block binary")


# ------------------------------------------------------------------ framing

def chunked(payload: bytes, size: int = CHUNK_BYTES) -> bytes:
    """Chunked transfer framing of a payload."""
    out = []
    for i in range(0, len(payload), size):
        part = payload[i:i + size]
        out += (b"%x\r\n" % len(part), part, b"\r\n")
    return b"".join((*out, b"0\r\n\r\n"))


def dechunked(body: bytes) -> bytes:
    """Inverse of ``chunked``; chunk extensions and trailers are skipped. Raises ValueError if the framing is broken."""
    out, at = [], 0
    while True:
        eol = body.find(b"\r\n", at)
        if eol < 0:
            raise ValueError("chunk size without end")
        n = int(body[at:eol].split(b";")[0], 16)
        at = eol + 2
        if n == 0:
            return b"".join(out)
        if len(body) < at + n + 2 or body[at + n:at + n + 2] != b"\r\n":
            raise ValueError("chunk shorter than its size")
        out.append(body[at:at + n])
        at += n + 2


def payload_of(block: bytes) -> bytes:
    """The payload of an HTTP response block."""
    head, gap, body = block.partition(b"\r\n\r\n")
    if not gap:
        raise ValueError("no end of HTTP headers")
    return dechunked(body) if re.search(rb"(?im)^transfer-encoding:\s*chunked\s*$", head) else body


def record_id(page_id, url, digest: str) -> str:
    h = hashlib.sha256(f"{page_id}|{url}|{digest}".encode("utf-8", "surrogatepass")).hexdigest()
    return f"<urn:uuid:{h[:8]}-{h[8:12]}-{h[12:16]}-{h[16:20]}-{h[20:32]}>"


def _record(fields: list, block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in fields if v is not None)
    return b"WARC/1.1\r\n" + head.encode("utf-8", "surrogatepass") + b"Content-Length: %d\r\n\r\n" % len(block) + block


def _uri(url) -> str:
    return "" if url is None else re.sub(r"[\x00-\x20\x7f]", lambda m: quote(m[0]), url)


def framed(payload: bytes, size: int, chunk: int = CHUNK_BYTES) -> Iterator[bytes]:
    """The HTTP response block of a payload in parts of ``size`` bytes; only a part is built at a time."""
    held, view = bytearray(HTTP_HEAD), memoryview(payload)
    for i in range(0, len(payload), chunk):
        part = view[i:i + chunk]
        held += b"%x\r\n" % len(part)
        held += part
        held += b"\r\n"
        while len(held) >= size:
            yield bytes(held[:size])
            del held[:size]
    held += b"0\r\n\r\n"
    yield from (bytes(held[i:i + size]) for i in range(0, len(held), size))


def framed_bytes(n: int, chunk: int = CHUNK_BYTES) -> int:
    """Length of the whole block of a payload of ``n`` bytes."""
    whole, rest = divmod(n, chunk)
    return len(HTTP_HEAD) + n + whole * (len(b"%x" % chunk) + 4) + (len(b"%x" % rest) + 4 if rest else 0) + 5


def _row_records(row: dict, segment_bytes: int, date: str) -> Iterator[bytes]:
    digest, page, url = row["digest"], row["page_id"], row["url"]
    common = [("WARC-Date", date), ("WARC-Target-URI", _uri(url)), ("X-Page-Id", page), ("WARC-Payload-Digest", f"sha256:{digest}")]
    name = record_id(page, url, digest)
    if row["kind"] == "revisit":
        to = record_id(row["to_id"], row["to_url"], digest)
        yield _record([("WARC-Type", "revisit"), ("WARC-Record-ID", name), *common, ("WARC-Refers-To", to),
                       ("WARC-Profile", PROFILE), ("Content-Type", "application/http; msgtype=response")], HTTP_HEAD)
        return
    payload = (row["html"] or "").encode("utf-8", "surrogatepass")
    total = framed_bytes(len(payload))
    last = -(-total // segment_bytes)
    for k, part in enumerate(framed(payload, segment_bytes), 1):
        if k == 1:
            yield _record([("WARC-Type", "response"), ("WARC-Record-ID", name), *common,
                           ("Content-Type", "application/http; msgtype=response"), ("WARC-Segment-Number", 1 if last > 1 else None)], part)
        else:
            yield _record([("WARC-Type", "continuation"), ("WARC-Record-ID", f"{name[:-1]}:{k}>"), ("WARC-Date", date),
                           ("WARC-Segment-Origin-ID", name), ("WARC-Segment-Number", k),
                           ("WARC-Segment-Total-Length", total if k == last else None)], part)


def _records(batch, segment_bytes: int, date: str):
    held, size = [], 0           # an output batch for each few MB keeps the task's memory small
    for i in range(batch.num_rows):
        for r in _row_records({c: batch.column(c)[i].as_py() for c in batch.schema.names}, segment_bytes, date):
            held.append(r)
            size += len(r)
            if size > 4 << 20:
                yield pa.RecordBatch.from_arrays([pa.array(held, pa.binary())], ["record"])
                held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.binary())], ["record"])


def write_archives(pages: DataFrame, path: str, segment_bytes: int = SEGMENT_BYTES, min_shared: int = MIN_SHARED_BYTES,
                   date: str = "2024-01-01T00:00:00Z") -> None:
    """Write one record (or segmented record) per row of ``pages`` (page_id, url, html) below ``path``."""
    p = pages.select("page_id", "url", "html", F.sha2(F.coalesce("html", F.lit("")), 256).alias("digest"),
                     F.coalesce(F.octet_length("html"), F.lit(0)).alias("n"))
    first = p.filter(F.col("n") >= min_shared).groupBy("digest").agg(
        F.min(F.struct(F.col("page_id").isNull().alias("none"), "page_id", "url")).alias("to"))
    # a written table: both sides of the join are then shuffled, so that Spark can split a hot payload's rows
    j = p.join(cut_lineage(first), "digest", "left")
    kind = F.when(F.col("to").isNull() | F.col("page_id").eqNullSafe(F.col("to.page_id")), "response").otherwise("revisit")
    rows = j.select("page_id", "url", F.when(kind == "response", F.col("html")).alias("html"), "digest", kind.alias("kind"),
                    F.col("to.page_id").alias("to_id"), F.col("to.url").alias("to_url"))
    records = rows.transform(in_tasks(_records, "record binary", segment_bytes, date))
    records.select(F.col("record").cast("string")).write.option("lineSep", "\r\n\r\n").option("compression", "gzip") \
        .option("maxRecordsPerFile", max(1, FILE_BYTES // (segment_bytes + HEAD_BYTES))).text(path)


def inflated(data):
    """The bytes of one archive file in pieces; a gzip file is inflated member by member."""
    if data[:2] != b"\x1f\x8b":
        yield from (data[i:i + PIECE] for i in range(0, len(data), PIECE))
        return
    at = 0
    while at < len(data):
        if data[at:at + 2] != b"\x1f\x8b":
            if bytes(data[at:]).strip(b"\0"):
                raise ValueError(f"no gzip member at byte {at}")
            return                                       # padding
        member, feed = zlib.decompressobj(31), b""
        while not member.eof:
            if not feed:
                feed = data[at:at + PIECE]
                at += len(feed)
                if not feed:
                    raise ValueError("gzip member without end")
            out = member.decompress(feed, 16 * PIECE)
            feed = member.unconsumed_tail
            if out:
                yield out
        at -= len(member.unused_data)


def parse(data):
    """The records of one archive file: (headers, block) by Content-Length. No more than a record and a piece is held inflated."""
    feed, buf, at, done = inflated(data), bytearray(), 0, 0      # done: bytes of the file before buf
    while True:
        end = buf.find(b"\r\n\r\n", at)
        while end < 0 and (piece := next(feed, None)) is not None:
            del buf[:at]
            done, at, seen = done + at, 0, len(buf)
            buf += piece
            end = buf.find(b"\r\n\r\n", max(0, seen - 3))
        if at >= len(buf):
            return
        if end < 0 or not buf.startswith(b"WARC/", at):
            raise ValueError(f"no record at byte {done + at}")
        head = {}
        for line in bytes(buf[at:end]).split(b"\r\n")[1:]:
            k, _, v = line.partition(b":")
            head[k.strip().lower().decode()] = v.strip().decode("utf-8", "replace")
        stop = end + 4 + int(head["content-length"])
        while len(buf) < stop + 4 and (piece := next(feed, None)) is not None:
            buf += piece
        yield head, bytes(buf[end + 4:stop])
        at = stop + 4


def _parsed(batch):
    schema = pa.schema([("record_id", pa.string()), ("kind", pa.string()), ("page_id", pa.string()), ("refers_to", pa.string()),
                        ("origin", pa.string()), ("segment", pa.int32()), ("total", pa.int64()), ("digest", pa.string()),
                        ("block", pa.binary())])
    rows, size = [], 0
    for data in batch.column("content"):
        for h, block in parse(memoryview(data.as_buffer()).cast("B")):
            seg = h.get("warc-segment-number")
            rows.append((h["warc-record-id"], h["warc-type"], h.get("x-page-id"), h.get("warc-refers-to"),
                         h.get("warc-segment-origin-id") or (h["warc-record-id"] if seg else None),
                         int(seg) if seg else None,
                         int(h["warc-segment-total-length"]) if "warc-segment-total-length" in h else None,
                         h.get("warc-payload-digest", "").removeprefix("sha256:") or None, block))
            size += len(block) + 300
            if size > 4 << 20:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)
                rows, size = [], 0
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)


def reassemble(records: DataFrame) -> DataFrame:
    """Whole records of parsed ones: segments grouped by origin, in order, with their total length verified.

    Equal records (a repeated row) have equal identifiers; each segment number is kept once and the
    whole record is repeated as often as its first segment came.
    """
    whole = records.filter("segment is null").select("record_id", "kind", "page_id", "refers_to", "digest", F.array("block").alias("blocks"),
                                                     F.lit("ok").alias("status"))
    parts = records.filter("segment is not null")
    one = parts.groupBy("origin", "segment").agg(
        F.first("block").alias("block"), F.max("total").alias("total"), F.count(F.lit(1)).alias("copies"),
        *[F.max(c).alias(c) for c in ("page_id", "digest")])
    g = one.groupBy("origin").agg(
        F.sort_array(F.collect_list(F.struct("segment", "block"))).alias("parts"), F.max("total").alias("total"),
        F.max(F.when(F.col("segment") == 1, F.col("copies"))).alias("copies"), F.max("page_id").alias("page_id"),
        F.max("digest").alias("digest"), F.sum(F.octet_length("block").cast("long")).alias("found"))
    # the parts stay an array, in order, and are joined once, where they are decoded
    status = F.when(F.element_at("parts", -1)["segment"] != F.size("parts"), "missing segment") \
        .when(F.col("copies").isNull() | F.col("total").isNull(), "missing segment") \
        .when(F.col("found") != F.col("total"), "wrong length").otherwise("ok")
    g = g.withColumn("status", status).withColumn("_n", F.explode(F.sequence(F.lit(1), F.coalesce("copies", F.lit(1)).cast("int"))))
    return whole.unionByName(g.select(F.col("origin").alias("record_id"), F.lit("response").alias("kind"), "page_id",
                                      F.lit(None).cast("string").alias("refers_to"), "digest", F.col("parts.block").alias("blocks"), "status"))


def _decoded(batch):
    n = batch.num_rows
    payloads, status = [None] * n, batch.column("status").to_pylist()
    for i, (kind, digest, blocks) in enumerate(zip(batch.column("kind").to_pylist(), batch.column("digest").to_pylist(),
                                                   batch.column("blocks"))):
        if kind != "response" or status[i] != "ok":
            continue
        try:
            payloads[i] = payload_of(b"".join(b.as_py() for b in blocks))
        except ValueError:
            status[i] = "bad framing"
            continue
        if digest is not None and hashlib.sha256(payloads[i]).hexdigest() != digest:
            status[i], payloads[i] = "wrong digest", None
    cols = [batch.column(c) for c in ("record_id", "kind", "page_id", "refers_to")]
    found = [None if p is None else hashlib.sha256(p).hexdigest() for p in payloads]
    yield pa.RecordBatch.from_arrays([*cols, pa.array(payloads, pa.binary()),
                                      pa.array([None if p is None else len(p) for p in payloads], pa.int64()),
                                      pa.array(found, pa.string()), pa.array(status, pa.string())],
                                     ["record_id", "kind", "page_id", "refers_to", "payload", "payload_bytes", "payload_digest", "status"])


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """Response and revisit records below ``path``: record_id, kind, page_id (string), refers_to (record
    id), payload (null for revisits), payload_bytes, payload_digest, status."""
    files = spark.read.format("binaryFile").load(path).select("content")
    return reassemble(files.transform(in_tasks(_parsed, RAW))).transform(in_tasks(
        _decoded, "record_id string, kind string, page_id string, refers_to string, payload binary, payload_bytes long, "
                  "payload_digest string, status string"))


def resolve_revisits(records: DataFrame) -> DataFrame:
    """Per record: page_id, payload_bytes, payload_digest, record_type, refers_to (a page_id), status; a
    revisit takes size and digest from the response that it refers to."""
    narrow = cut_lineage(records.drop("payload"))
    target = narrow.filter("kind = 'response'").groupBy(F.col("record_id").alias("_to")).agg(
        F.max("page_id").alias("_page"), F.max("payload_bytes").alias("_bytes"), F.max("payload_digest").alias("_digest"))
    revisits = narrow.filter("kind = 'revisit'").join(target, F.col("refers_to") == F.col("_to"), "left").select(
        "page_id", F.col("_bytes").alias("payload_bytes"), F.col("_digest").alias("payload_digest"),
        F.col("kind").alias("record_type"), F.col("_page").alias("refers_to"),
        F.when(F.col("_to").isNull(), "missing response").otherwise(F.col("status")).alias("status"))
    responses = narrow.filter("kind = 'response'").select(
        "page_id", "payload_bytes", "payload_digest", F.col("kind").alias("record_type"),
        F.lit(None).cast("string").alias("refers_to"), "status")
    return responses.unionByName(revisits)


@register("op10_warc_round_trip", f"""
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha256(coalesce(html, '')) AS h FROM pages),
f AS (SELECT h, min(page_id) AS first FROM p WHERE n >= {MIN_SHARED_BYTES} GROUP BY h)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, p.h AS payload_digest,
       CASE WHEN f.first IS NULL OR page_id = f.first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> f.first THEN f.first END AS refers_to
FROM p LEFT JOIN f ON p.h = f.h""")
def op10_warc_round_trip(spark, sf_dir):
    path = shared_path(spark, "archive")
    write_archives(table(spark, sf_dir, "pages"), path)
    r = resolve_revisits(read_archives(spark, path))
    return r.select(F.col("page_id").cast("long").alias("page_id"), "payload_bytes", "payload_digest", "record_type",
                    F.col("refers_to").cast("long").alias("refers_to"))
