import hashlib

import pytest
import zstandard
from pyspark.sql import functions as F

from planwise.llm.warc import BadArchive, make_archive, make_record, op4_warc, read_archive, read_archives, write_archives
from tests.llm.conftest import SF


def _expected(rows):
    first = {}
    for i, h in rows:
        b = (h or "").encode()
        if len(b) >= 100:
            first.setdefault(b, []).append(i)
    out = []
    for i, h in rows:
        b = (h or "").encode()
        ids = first.get(b, [])
        known = [x for x in ids if x is not None]
        to = min(known) if len(ids) > 1 and known and i != min(known) else None
        out.append((i, len(b), hashlib.sha256(b).hexdigest(), "revisit" if to is not None else "response", to))
    return sorted(out, key=str)


def test_op4_equals_brute_force(spark):
    rows = [(r.page_id, r.html) for r in spark.read.parquet(f"{SF}/pages.parquet").collect()]
    assert sorted((tuple(r) for r in op4_warc(spark, SF).collect()), key=str) == _expected(rows)


def test_round_trip_of_edge_cases(spark, tmp_dir):
    long = "é" * 200_000
    rows = [(1, "http://a/\r\nX: y", "p" * 100, 0), (2, None, "p" * 100, 0), (3, "u", "p" * 99, 0), (4, "u", "p" * 99, 0),
            (5, "u", None, 0), (6, "u", "", 0), (None, "u", "p" * 100, 0), (7, "u", long, 0), (0, "u", long, 0),
            (0, "u", long, 0), (8, "u", "a\r\n\r\nWARC/1.1\r\n" * 20, 0)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string, refers_to int")
    assert write_archives(pages, tmp_dir + "/a", archive_bytes=1000).agg(F.sum("records")).first()[0] == len(rows)
    back = read_archives(spark, tmp_dir + "/a").collect()
    got = sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in back), key=str)
    assert got == _expected([(i, h) for i, _, h, _ in rows])
    assert {bytes(r.payload).decode() for r in back if r.record_type == "response"} == {h or "" for _, _, h, _ in rows}
    empty = pages.limit(0)
    assert write_archives(empty, tmp_dir + "/b").count() == 0


def _record(i=1, payload=b"x" * 300):
    return make_record(i, "http://a", payload, hashlib.sha256(payload).hexdigest(), None)


def test_broken_archives_are_named():
    good = make_archive([_record(i) for i in range(20)])
    assert [r["page_id"] for r in read_archive(good)] == list(range(20))
    frames = [r["frame_at"] for r in read_archive(good)]
    for bad in (good[:-3], good[:frames[5] + 2], good[:frames[3]] + b"junk" + good[frames[3]:],
                good[:frames[2] + 30] + bytes([good[frames[2] + 30] ^ 255]) + good[frames[2] + 31:]):
        with pytest.raises(BadArchive):
            list(read_archive(bad))
    for change in ((b"WARC/1.1", b"WARC/9.9"), (b"Content-Length: 3", b"Content-Length: 4"), (b"WARC-Date", b"WARC Date"),
                   (b"sha256:", b"sha999:"), (b"response\r\nWARC-Record", b"resource\r\nWARC-Record")):
        broken = _record().replace(*change, 1)
        assert broken != _record()
        with pytest.raises(BadArchive):
            list(read_archive(make_archive([broken])))


def test_archives_without_a_dictionary_are_read():
    one = zstandard.ZstdCompressor(write_checksum=True)
    data = one.compress(_record(7)) + one.compress(_record(8, b""))
    assert [r["page_id"] for r in read_archive(data)] == [7, 8]


def test_files_of_lost_attempts_are_left_out(spark):
    from planwise.llm.common import shared_dir, stored, table
    pages, path = table(spark, SF, "pages"), shared_dir(spark, "archives")
    ordered = lambda c: pages.repartition(3).sortWithinPartitions(c)
    write_archives(ordered("url"), path, archive_bytes=200_000).collect()  # an attempt that was lost, in another order
    written = stored(write_archives(ordered("page_id"), path, archive_bytes=150_000), "written")
    got = read_archives(spark, path, payloads=False, written=written).select("page_id").collect()
    assert sorted(r.page_id for r in got) == sorted(r.page_id for r in pages.collect())
    short = written.withColumn("records", written.records + 1)
    with pytest.raises(Exception, match="were written"):
        read_archives(spark, path, payloads=False, written=short).collect()
