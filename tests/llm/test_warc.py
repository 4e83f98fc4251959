"""WARC archives: round trips, revisits, and magic inside payloads."""

import base64
import hashlib

import pytest

from panelforge.llm import warc
from panelforge.llm.common import shared_dir

TRAP = "before WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:999>\r\nWARC-Target-URI: x\r\nWARC-Payload-Digest: sha1:X\r\nContent-Length: 3\r\n\r\nabc\r\n\r\nafter"
PAGES = [(1, "http://a/\r\nX: y", "<p>é</p>"), (2, None, "<p>é</p>"), (3, "http://c", None), (4, "http://d", ""), (5, "http://e", TRAP * 40), (6, "http://f", "x" * 9000), (None, "http://g", "null id"), (7, "http://h", TRAP), (7, "http://h", TRAP)]


def expected(pages):
    largest = {}
    for k, _, html in pages:
        if k is not None:
            largest[html or ""] = max(largest.get(html or "", k), k)
    out = []
    for k, _, html in pages:
        data, top = (html or "").encode(), largest.get(html or "")
        kind = "response" if k == top else "revisit"
        out.append((k, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), kind, top if kind == "revisit" else None))
    return sorted(out, key=repr)


def test_round_trip_over_small_blocks(spark):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string").selectExpr("*", "'x' AS digest", "1 AS n").coalesce(2)
    archives = warc.write_archives(warc.plan_records(pages), archive_bytes=6000)
    for block in (300, 1000, 4 << 20):
        got = warc.read_archives(archives, block).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()
        assert sorted(map(tuple, got), key=repr) == expected(PAGES)


def test_candidates_hold_the_trap_that_the_chain_rejects(spark):
    pages = spark.createDataFrame([(5, "u", TRAP * 3)], "page_id long, url string, html string")
    archives = warc.write_archives(warc.plan_records(pages))
    blocks = archives.selectExpr("path", "size", "0L AS first")
    assert warc.candidates(blocks, shared_dir(spark), 1 << 20).count() == 4
    assert [r.page_id for r in warc.read_archives(archives).collect()] == [5]


def test_long_urls_do_not_end_the_chain(spark):
    rows = [(1, "http://a", "one"), (2, "http://b/" + "x" * 100_000, "two"), (3, "http://c/" + " " * 70_000, TRAP), (4, "http://d", "four")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    archives = warc.write_archives(warc.plan_records(pages))
    for block in (1000, 4 << 20):
        got = warc.read_archives(archives, block).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()
        assert sorted(map(tuple, got), key=repr) == expected(rows)


@pytest.mark.parametrize("damage", ["magic", "first", "length", "cut", "tail"])
@pytest.mark.parametrize("block", [400, 4 << 20])
def test_broken_chains_are_never_silent(spark, damage, block):
    pages = spark.createDataFrame([(k, f"http://{k}", f"page {k} " * 20) for k in range(20)], "page_id long, url string, html string").coalesce(1)
    (archive,) = warc.write_archives(warc.plan_records(pages).coalesce(1)).collect()
    path = archive.path.removeprefix("file://")
    data = bytearray(open(path, "rb").read())
    starts = [r.offset for r in warc.read_archives(spark.createDataFrame([archive]), block).orderBy("offset").collect()]
    at = {"magic": starts[7], "first": 0, "length": starts[7], "cut": starts[19], "tail": len(data)}[damage]
    if damage in ("magic", "first"):
        data[at] ^= 1
    elif damage == "length":
        place = data.index(b"Content-Length: ", at) + 16
        data[place : place + 1] = b"x"
    elif damage == "cut":
        del data[-10:]
    else:
        data += b"rest"
    with open(path, "wb") as file:
        file.write(data)
    archives = spark.createDataFrame([(archive.path, len(data))], "path string, size long")
    with pytest.raises(Exception, match=f"no whole record at {at}, {len(data) - at} bytes unread"):
        warc.read_archives(archives, block).collect()
    rows = warc.read_archives(archives, block, "report").collect()
    assert sorted(r.offset for r in rows) == sorted([x for x in starts if x < at] + [at])
    assert [(r.offset, r.payload_bytes) for r in rows if r.record_type == "broken"] == [(at, len(data) - at)]


def test_no_pages(spark):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.read_archives(warc.write_archives(warc.plan_records(pages))).count() == 0


def test_short_payloads_are_all_responses(spark):
    pages = spark.createDataFrame([(1, "a", "x"), (2, "b", "x")], "page_id long, url string, html string")
    assert warc.plan_records(pages, least_bytes=2).filter("refers_to is not null").count() == 0
