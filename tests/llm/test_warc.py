"""Archives: an exact round trip, selections, odd pages."""

import base64
import gzip
import hashlib

import pytest

from dugout.llm import queries, warc
from tests.conftest import SF

COLUMNS = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def _digest(text):
    return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


@pytest.fixture(scope="module")
def pages(spark):
    rows = [
        (1, "http://a/", "<p>one</p>", "x"), (2, "http://b/", "<p>one</p>", "y"), (3, None, None, None),
        (4, "http://c/ä b\r\nX: y", "", "z"), (5, "http://d/", "a\r\n\r\nWARC/1.1\r\n\r\n日本" * 300, "w"),
        (None, "http://e/", "<p>one</p>", "v"), (None, "http://f/", "alone", "u"),
        (6, "http://g/", "twice", "t"), (6, "http://g/", "twice", "t"), (7, "http://h/", "long " * 50000, "s"),
    ]
    return spark.createDataFrame(rows, "page_id long, url string, html string, file string").repartition(3)


def test_round_trip_of_odd_pages(spark, pages):
    index, folder = warc.archive_pages(spark, pages)
    got = sorted((tuple(r[c] for c in COLUMNS) for r in warc.read_records(index, folder).collect()), key=str)
    heads = {}
    rows = [(r["page_id"], r["html"] or "") for r in pages.collect()]
    for i, html in rows:
        heads[html] = max([heads.get(html), i], key=lambda v: -1 if v is None else v)
    expected = [
        (i, len(html.encode()), _digest(html), "response" if i == heads[html] else "revisit",
         None if i == heads[html] else heads[html]) for i, html in rows
    ]
    assert got == sorted(expected, key=str)


def test_small_payloads_are_responses_below_the_limit(spark, pages):
    index, _ = warc.archive_pages(spark, pages, min_bytes=11)
    assert index.where("payload_bytes < 11 AND record_type = 'revisit'").count() == 0


def test_selected_records_come_back_with_their_payload(spark, pages):
    index, folder = warc.archive_pages(spark, pages)
    for limits in ({}, {"gap_bytes": 0, "range_bytes": 1}):
        found = warc.read_records(index.where("page_id IN (5, 7)"), folder, **limits).collect()
        assert {r["page_id"]: bytes(r["payload"]).decode()[:3] for r in found} == {5: "a\r\n", 7: "lon"}


def test_ranges_join_neighbours_and_split_at_gaps(spark):
    index = spark.createDataFrame([("f", 0, 10), ("f", 10, 5), ("f", 40, 5), ("g", 3, 2)],
                                  "file string, offset long, length long")
    found = {(r["file"], r["from"], r["to"], len(r["parts"])) for r in warc.byte_ranges(index, gap_bytes=20).collect()}
    assert found == {("f", 0, 15, 2), ("f", 40, 45, 1), ("g", 3, 5, 1)}


def test_damage_is_reported():
    raw = warc.record_bytes(1, "u", b"body", "response", None, warc.digest_of(b"body"), 4)
    headers, http, payload = warc.parse_record(raw)
    assert payload == b"body" and http["content-length"] == "4" and headers["warc-type"] == "response"
    with pytest.raises(ValueError):
        warc.parse_record(raw[:-3])
    assert gzip.decompress(gzip.compress(raw, mtime=0)) == raw


def test_small_ranges_of_large_payloads_come_in_slices():
    bodies = [bytes([65 + i]) * 300_000 for i in range(10)]
    members = [gzip.compress(warc.record_bytes(i, "u", b, "response", None, warc.digest_of(b), len(b)), mtime=0)
               for i, b in enumerate(bodies)]
    parts, at = [], 7
    for m in members:
        parts.append({"offset": at, "length": len(m)})
        at += len(m)
    raw = b"".join(members)
    assert len(raw) < 20_000
    found = list(warc.records_of(raw, parts, 7, "f", limit=700_000))
    assert [len(rows) for rows in found] == [2] * 5
    assert [r[-1] for rows in found for r in rows] == bodies
    assert [len(rows) for rows in warc.records_of(raw, parts, 7, "f", limit=1)] == [1] * 10


def test_payloads_that_share_sha1_alone_stay_apart(spark, pages, monkeypatch):
    monkeypatch.setattr(warc.F, "sha1", lambda c: warc.F.lit("00" * 20))
    kinds = warc.plan_records(pages, "page_id", "url", "html", 0).groupBy("record_type").count().collect()
    assert {r["record_type"]: r["count"] for r in kinds} == {"response": 7, "revisit": 3}


def test_no_payload_travels_under_a_key_that_pages_share(spark, pages):
    planned = warc.plan_records(pages, "page_id", "url", "html", 0)._jdf.queryExecution()
    mode = spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    blocks = planned.explainString(mode).split("\n\n")
    shuffles = [b for b in blocks if ") Exchange\n" in b and "hashpartitioning" in b]
    carrying = [b for b in shuffles if "payload" in b]
    assert len(shuffles) > len(carrying) and all("hashpartitioning(coalesce(page_id" in b for b in carrying)


def test_no_pages(spark, pages):
    index, folder = warc.archive_pages(spark, pages.limit(0))
    assert warc.read_records(index, folder).count() == 0


def test_every_page_of_the_test_table(spark):
    assert queries.op6_warc(spark, SF).count() == spark.read.parquet(f"{SF}/pages.parquet").count()
