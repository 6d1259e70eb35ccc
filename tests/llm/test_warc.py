import base64
import gzip
import hashlib
import io

import pytest
from pyspark.sql import functions as F

from churnkit.llm import common as C
from churnkit.llm import warc

PAGES = "page_id long, url string, html string"
ROWS = [(1, "http://a/1", "<p>one</p>"), (2, "http://a/2", "<p>one</p>"), (9, None, "<p>one</p>"), (3, "http://a/ü\r\n3", "<p>ünï</p>"),
        (4, "http://a/4", None), (5, "http://a/5", ""), (6, "http://a/6", "x" * 300_000), (7, "http://a/7", "x" * 300_000),
        (8, "http://a/8", "a\r\n\r\nb"), (8, "http://a/8", "a\r\n\r\nb"), (None, "http://a/0", "<p>one</p>"), (10, "u", "WARC/1.1\r\n\r\n")]


def plain(rows, min_bytes=0):
    out = []
    for page_id, _, html in rows:
        b = (html or "").encode()
        same = [p for p, _, h in rows if (h or "").encode() == b and p is not None]
        keeper = max(same) if same and len(b) >= min_bytes else None
        revisit = page_id is not None and keeper is not None and page_id < keeper
        out.append((page_id, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "revisit" if revisit else "response",
                    keeper if revisit else None))
    return sorted(out, key=str)


def found(spark, rows, **how):
    pages = spark.createDataFrame(rows, PAGES).repartition(3).withColumn("key", F.lit(1)).withColumn("refers_to", F.lit("x"))
    got = warc.round_trip(pages, C.fresh_path(spark, "warc-test"), **how)
    return sorted([tuple(r) for r in got.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()], key=str)


@pytest.mark.parametrize("min_bytes", [0, 1, 50])
def test_round_trip(spark, min_bytes):
    assert found(spark, ROWS, min_bytes=min_bytes) == plain(ROWS, min_bytes)


def test_empty_table_and_rolling(spark):
    assert found(spark, []) == []
    pages = spark.createDataFrame(ROWS, PAGES).coalesce(1)
    listing = warc.write(pages, C.fresh_path(spark, "warc-test"), roll=200)
    assert listing.count() > 3 and listing.agg(F.sum("records")).first()[0] == len(ROWS)
    assert warc.read(listing).count() == len(ROWS)


def test_many_copies_of_one_payload(spark):
    rows = [(i, f"http://a/{i}", "same" if i % 3 == 0 else f"own {i}") for i in range(900)]
    assert found(spark, rows) == plain(rows)


def members(data):
    return [warc.read_record(m) for m in warc.members(io.BytesIO(data))]


def test_reader_follows_the_frame():
    one, two = (warc.record(i, "http://a/", b"payload %d" % i * 50_000, None, "2000-01-01T00:00:00Z") for i in (1, 2))
    data = gzip.compress(one) + gzip.compress(two)
    got = members(data)
    assert [r[0] for r in got] == [1, 2] and all(r[-1] for r in got)
    assert warc.sha1_base32(b"payload 2" * 50_000) == got[1][5]
    changed = gzip.compress(one.replace(b"payload 1", b"payload 7", 1))
    assert members(changed)[0][-1] is False
    for broken in (data[:-20], gzip.compress(one[:-2]), gzip.compress(b"HTTP/1.1 200\r\n\r\n"), gzip.compress(b"WARC/1.1\r\n"),
                   data[:40] + b"\0" * 30 + data[70:]):
        with pytest.raises((warc.DamagedArchive, KeyError)):
            members(broken)
