"""Archives: round trips, revisits, and the format itself."""

import base64
import glob
import hashlib
import struct

import pytest
import zstandard

from pyspark.sql import functions as F

from careerlake.llm import warc

ROWS = [
    (1, "http://a/1", "<p>one</p>"), (2, "http://a/2", "<p>two</p>"), (3, "http://a b/3\n", "<p>one</p>"),
    (4, None, None), (5, "u", ""), (6, "u", "é日𝄞" * 1000), (7, "u", "x\r\n\r\ny" * 50_000), (7, "u", "x\r\n\r\ny" * 50_000),
    (None, "u", "<p>two</p>"), (None, "u", "alone"),
]


def digest(html):
    return base64.b32encode(hashlib.sha1((html or "").encode()).digest()).decode()


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame([(*r, "x", 1) for r in ROWS], "page_id long, url string, html string, body string, digest int")


def expected(rows, least=0):
    out = []
    for page, _, html in rows:
        same = [p for p, _, h in rows if (h or "") == (html or "")]
        top = max((p for p in same if p is not None), default=None)
        small = len((html or "").encode()) < least
        revisit = not small and len(same) > 1 and top is not None and page != top
        out.append((page, len((html or "").encode()), digest(html), "revisit" if revisit else "response", top if revisit else None))
    return sorted(out, key=str)


def taken(records):
    return sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in records), key=str)


def test_round_trip(spark, pages):
    _, records = warc.archived(pages)
    rows = records.collect()
    assert taken(rows) == expected(ROWS)
    payloads = {(r.page_id, bytes(r.payload)) for r in rows if r.record_type == "response"}
    assert payloads == {(p, (h or "").encode()) for p, _, h in ROWS if (p, h) not in {(1, "<p>one</p>"), (None, "<p>two</p>"), (4, None)}}
    assert {r.url for r in rows if r.page_id == 3} == {"http://a%20b/3%0A"}


def test_small_payloads_are_all_responses(spark, pages, tmp_path):
    index = warc.write(pages, str(tmp_path / "w"), min_bytes=11)
    assert taken(warc.read(spark, index).collect()) == expected(ROWS, 11)


def test_format(spark, pages, tmp_path):
    index = warc.write(pages, str(tmp_path / "w")).collect()
    files = glob.glob(f"{tmp_path}/w/*.warc.zst")
    assert {r.archive for r in index} == set(files)
    for name in files:
        data = open(name, "rb").read()
        magic, size = struct.unpack("<II", data[:8])
        assert magic == 0x184D2A5D
        words = zstandard.ZstdCompressionDict(data[8 : 8 + size])
        at = 8 + size
        for row in sorted((r for r in index if r.archive == name), key=lambda r: r.offset):
            assert row.offset == at  # each record is a frame of its own, readable without the others
            record = zstandard.ZstdDecompressor(dict_data=words).decompress(data[at : at + row.length])
            assert record.startswith(b"WARC/1.1\r\nWARC-Type: re") and record.endswith(b"\r\n\r\n")
            at += row.length
        assert at == len(data)


def test_dictionary_is_trained_on_many_records(spark, tmp_path):
    made = spark.range(3000).selectExpr(
        "id AS page_id", "concat('http://h/', id) AS url",
        "concat('<html><head><title>page ', id, '</title></head><body><div class=\"content\">', md5(string(id)), '</div></body></html>') AS html")
    trained = warc.dictionary(made)
    assert zstandard.ZstdCompressionDict(trained).dict_id() != 0
    sizes = [warc.write(made, str(tmp_path / "w")).selectExpr("sum(length)").first()[0]]
    plain = sum(len(zstandard.compress(warc._record(r.asDict()), 6)) for r in warc.decided(made).collect())
    assert sizes[0] < 0.6 * plain


def test_damage_is_noticed(spark, pages, tmp_path):
    index = warc.write(pages, str(tmp_path / "w"))
    name = index.first().archive
    data = bytearray(open(name, "rb").read())
    data[-6] ^= 255
    open(name, "wb").write(data)
    with pytest.raises(Exception):
        warc.read(spark, index).collect()


def test_empty_table(spark, pages):
    index, records = warc.archived(pages.limit(0))
    assert index.count() == records.count() == 0


def test_the_dictionary_sees_whole_payloads(spark):
    """What stands only far down in long payloads is in the dictionary, too."""
    pages = spark.range(300).select(
        F.col("id").alias("page_id"), F.lit("http://h.org/").alias("url"),
        F.concat(F.repeat(F.sha2(F.col("id").cast("string"), 512), 100), F.repeat(F.lit("<footer>mark</footer>"), 400)).alias("html"))
    assert b"<footer>mark" in warc.dictionary(pages)
