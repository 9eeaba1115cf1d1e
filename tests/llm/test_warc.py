import gzip
import hashlib
import random

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from ranklab.llm import warc
from ranklab.llm.common import shared_path


def round_trip(spark, rows, segment=300):
    path = shared_path(spark, "test-archive")
    df = spark.createDataFrame(rows, "page_id long, url string, html string, kind string, digest string")
    warc.write_archives(df, path, segment_bytes=segment)
    return path, warc.read_archives(spark, path)


def pages():
    r = random.Random(1)
    alphabet = "abc é\r\n<>\n😀WARC/1.1"
    rows = [(i, f"http://x/{i}", "".join(r.choices(alphabet, k=r.choice([0, 1, 99, 100, 299, 301, 5000, 40_000]))), "c", "d") for i in range(60)]
    rows += [(100 + i, "http://copy/", rows[7][2] + "x" * 100, "c", "d") for i in range(9)]
    rows += [(200, None, None, None, None), (201, "bad\r\nurl", "WARC/1.1\r\n\r\n\r\n\r\nWARC/1.1\r\nContent-Length: 5\r\n\r\n" * 9, None, None),
             (None, "u", "y" * 150, None, None), (300, "u", "y" * 150, None, None), (None, "n", "only without id " * 20, None, None),
             (3, "again", "z", None, None), (400, "same", "q" * 5000, None, None), (400, "same", "q" * 5000, None, None)]
    return rows


def test_round_trip_is_exact(spark):
    rows = pages()
    _, records = round_trip(spark, rows)
    got = warc.resolve_revisits(records)
    assert got.filter("status <> 'ok'").count() == 0
    first = {}
    for page, _, html, *_ in rows:
        h = (html or "").encode()
        if len(h) >= 100 and page is not None:
            first[h] = min(page, first.get(h, page))
    want = []
    for page, _, html, *_ in rows:
        h = (html or "").encode()
        to = first.get(h)
        revisit = to is not None and page != to
        want.append((None if page is None else str(page), len(h), hashlib.sha256(h).hexdigest(), "revisit" if revisit else "response",
                     str(to) if revisit else None))
    cols = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    assert sorted((tuple(r[c] for c in cols) for r in got.collect()), key=str) == sorted(want, key=str)


def test_payload_bytes_survive(spark):
    rows = pages()[:60]
    _, records = round_trip(spark, rows)
    got = {r["page_id"]: bytes(r["payload"]) for r in records.filter("kind = 'response'").collect()}
    want = {str(p): (h or "").encode() for p, _, h, *_ in rows}
    assert all(got[p] == want[p] for p in got) and len(got) >= 50


def test_damage_is_reported(spark):
    rows = [(i, "u", str(i) * 2000, None, None) for i in range(4)]
    path, _ = round_trip(spark, rows)
    raw = spark.read.format("binaryFile").load(path).select("content").transform(warc.in_tasks(warc._parsed, warc.RAW))
    raw = raw.withColumn("n", F.col("segment"))
    page = {r["page_id"]: r["record_id"] for r in raw.filter("segment = 1").collect()}
    lost = raw.filter(~((F.col("origin") == page["0"]) & (F.col("segment") == 3)))
    lost = lost.filter(~((F.col("origin") == page["1"]) & F.col("total").isNotNull()))
    lost = lost.withColumn("total", F.when(F.col("origin") == page["2"], F.col("total") + 1).otherwise(F.col("total")))
    status = {r["page_id"]: r["status"] for r in warc.reassemble(lost.drop("n")).collect()}
    assert status == {"0": "missing segment", "1": "missing segment", "2": "wrong length", "3": "ok"}


@pytest.mark.parametrize("n", [0, 1, 10, 8192, 8193, 100_000])
def test_chunked_framing(n):
    data = bytes(random.Random(n).randbytes(n))
    assert warc.dechunked(warc.chunked(data)) == data
    assert warc.dechunked(b"5;x=y\r\nhello\r\n0\r\nTrailer: 1\r\n\r\n") == b"hello"
    with pytest.raises(ValueError):
        warc.dechunked(b"5\r\nhell")


def test_empty_table(spark):
    _, records = round_trip(spark, [])
    assert records.count() == 0


def test_files_of_several_gzip_members(spark, monkeypatch):
    monkeypatch.setattr(warc, "PIECE", 7)
    raw = [warc._record([("WARC-Type", "response"), ("WARC-Record-ID", f"<urn:uuid:{k}>")], b"block \r\n\r\n %d " % k * (k * 50)) + b"\r\n\r\n" for k in range(6)]
    want = list(warc.parse(b"".join(raw)))
    assert [h["warc-record-id"] for h, _ in want] == [f"<urn:uuid:{k}>" for k in range(6)] and want[5][1] == b"block \r\n\r\n 5 " * 250
    one_each = b"".join(gzip.compress(r) for r in raw)
    assert list(warc.parse(one_each)) == list(warc.parse(one_each + bytes(20))) == want
    assert list(warc.parse(gzip.compress(b"".join(raw)[:333]) + gzip.compress(b"".join(raw)[333:]))) == want
    batch = pa.RecordBatch.from_arrays([pa.array([one_each, b"".join(raw)], pa.binary())], ["content"])
    assert [r["record_id"] for b in warc._parsed(batch) for r in b.to_pylist()] == [f"<urn:uuid:{k}>" for k in range(6)] * 2
    for broken in (one_each[:-4], one_each + b"x"):
        with pytest.raises(ValueError):
            list(warc.parse(broken))


def test_framing_in_parts_is_the_whole_block():
    for n in (0, 1, 99, 8191, 8192, 8193, 40_000, 100_000):
        payload = bytes(range(256)) * (n // 256) + b"x" * (n % 256)
        block = warc.HTTP_HEAD + warc.chunked(payload)
        assert warc.framed_bytes(n) == len(block)
        for size in (100, 8192, 32_768, 1 << 20):
            parts = list(warc.framed(payload, size))
            assert b"".join(parts) == block and all(len(p) == size for p in parts[:-1]) and 0 < len(parts[-1]) <= size


def test_a_very_long_page_comes_back(spark, tmp_path):
    page = "<p>é lorem</p>" * 3_000_000                 # 45 MB, about 1,400 segments
    pq.write_table(pa.table({"page_id": [1, 2], "url": ["u", "v"], "html": [page, "s"]}), tmp_path / "pages.parquet")
    df = spark.read.parquet(str(tmp_path / "pages.parquet"))
    warc.write_archives(df, str(tmp_path / "a"))
    got = {r["page_id"]: (r["payload_bytes"], r["status"]) for r in warc.read_archives(spark, str(tmp_path / "a")).drop("payload").collect()}
    assert got == {"1": (len(page.encode()), "ok"), "2": (1, "ok")}


def test_files_are_bounded_in_bytes(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "FILE_BYTES", 300_000)
    df = spark.range(1).select(warc.F.col("id").alias("page_id"), warc.F.lit("u").alias("url"), warc.F.repeat(warc.F.lit("lorem "), 400_000).alias("html"))
    warc.write_archives(df, str(tmp_path / "a"))
    import gzip
    sizes = [len(gzip.decompress(p.read_bytes())) for p in (tmp_path / "a").glob("*.gz")]
    assert len(sizes) > 5 and max(sizes) <= 300_000
    assert warc.read_archives(spark, str(tmp_path / "a")).first()["payload_bytes"] == 2_400_000
