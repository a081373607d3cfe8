import hashlib

import pytest
from pyspark.sql import functions as F

from millrace.llm import warc


def brute(rows):
    out = []
    for at, (p, h) in enumerate(rows):
        data = (h or "").encode()
        same = [(r[0] is not None, r[0] or 0, j) for j, r in enumerate(rows) if (r[1] or "").encode() == data]
        held = max(same)
        first = len(data) < 1000 or held[2] == at
        out.append((p, len(data), hashlib.sha1(data).hexdigest(), "response" if first else "revisit", None if first else rows[held[2]][0], True))
    return sorted(out, key=str)


def pages(spark, rows):
    df = spark.createDataFrame([(p, "http://x.example/a b", h) for p, h in rows], "page_id long, url string, html string").coalesce(1)
    return df.withColumn("block", F.lit("clash")).withColumn("row", F.lit(1)).withColumn("payload", F.lit("clash"))


ROWS = [(1, "a" * 2000), (2, "a" * 2000), (2, "a" * 2000), (3, None), (4, ""), (None, "b" * 1500), (5, "b" * 1500), (6, "é" * 499), (7, "é" * 499), (8, "ö\r\n\r\n0\r\n\r\n" * 9000), (9, "x" * 999), (9, "x" * 999)]


def test_round_trip(spark):
    got = warc.round_trip(pages(spark, ROWS), segment=700).collect()
    assert sorted(map(tuple, got), key=str) == brute(ROWS)


def test_empty(spark):
    assert warc.round_trip(pages(spark, [])).collect() == []


def segments(spark, keep):
    records = warc.read_records(warc.write_archives(pages(spark, [(1, "z" * 5000)]), segment=600))
    return warc.reassemble(records.where(keep)).collect()


def test_a_lost_segment_is_told(spark):
    assert [r.complete for r in segments(spark, "true")] == [True]
    assert [r.complete for r in segments(spark, "number <> 3")] == [False]
    assert [r.complete for r in segments(spark, "total is null")] == [False]
    assert [(r.complete, r.type) for r in segments(spark, "number > 1")] == [(False, None)]


def test_chunk_framing():
    for n in (0, 1, 4096, 4097, 20000):
        data = bytes(range(256)) * (n // 256 + 1)
        assert warc.unframe_chunks(warc.frame_chunks(data[:n])) == data[:n]
    assert warc.unframe_chunks(b"3;ext=1\r\nabc\r\n0\r\n\r\n") == b"abc"
    with pytest.raises(ValueError):
        warc.unframe_chunks(b"3\r\nabcd\r\n0\r\n\r\n")


def test_plain_archives_are_read():
    data = warc.record_bytes([("WARC-Type", "warcinfo")], b"hello") + warc.record_bytes([("WARC-Type", "resource")], b"")
    assert [(h["warc-type"], b) for h, b in warc.parse_records(data)] == [("warcinfo", b"hello"), ("resource", b"")]


def test_archive_files(spark, tmp_path):
    for i, r in enumerate(warc.write_archives(pages(spark, ROWS), segment=900).collect()):
        (tmp_path / f"{i}.warc.gz").write_bytes(r.data)
    files = spark.read.format("binaryFile").load(str(tmp_path)).select(F.col("content").alias("data"))
    assert warc.read_archives(files).count() == len(ROWS)
