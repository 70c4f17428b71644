import base64
import gzip
import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from reelframe.llm import warc

PAGES = "page_id long, url string, html string, sha1 int"


def expected(rows, least=0):
    heads = {}
    for i, _, html, _ in rows:
        data = (html or "").encode()
        if i is not None and len(data) >= least:
            heads[data] = min(i, heads.get(data, i))
    out = []
    for i, _, html, _ in rows:
        data = (html or "").encode()
        head = heads.get(data)
        refers = head if head is not None and i != head else None
        out.append((i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "response" if refers is None else "revisit", refers))
    return sorted(out, key=str)


ROWS = [(3, "http://a/x", "<p>one</p>", 0), (1, None, "<p>one</p>", 0), (2, "u", None, 0), (5, "u\nv", "", 0), (7, "u", "é" * 70_000, 0), (8, "u", "x\r\n\r\ny", 0), (8, "u", "x\r\n\r\ny", 0), (None, "u", "x\r\n\r\ny", 0), (None, "u", "alone", 0)]


@pytest.mark.parametrize("least", [0, 5])
def test_pages_round_trip(spark, least):
    got = warc.archive_pages(spark, spark.createDataFrame(ROWS, PAGES), least)
    assert sorted((tuple(r)[:5] for r in got.collect()), key=str) == expected(ROWS, least)


def test_empty_table(spark):
    assert warc.archive_pages(spark, spark.createDataFrame([], PAGES)).count() == 0


def test_files_are_plain_gzip(spark, tmp_path):
    folder = f"file://{tmp_path}/a"
    warc.write_archives(warc.plan_records(spark.createDataFrame(ROWS[:2], PAGES)), folder)
    text = b"".join(gzip.open(p).read() for p in (tmp_path / "a").glob("part*"))
    assert text.count(b"WARC/1.1\r\n") == 2 and b"<p>one</p>" in text
    full = warc.read_archives(spark, folder, with_payload=True).filter("record_type = 'response'").first()
    assert bytes(full["payload"]) == b"<p>one</p>"


@settings(max_examples=60, deadline=None)
@given(st.lists(st.binary(max_size=300_000 // 50), max_size=4), st.booleans())
def test_records(payloads, blank):
    data = b"".join(warc.gzip_member(warc.build_record(i, "u", p, hashlib.sha1(p).hexdigest(), None)) + blank * warc.EMPTY_MEMBER for i, p in enumerate(payloads))
    got = [r for m in warc.iter_members(memoryview(data)) if (r := warc.parse_record(m))]
    assert [r["payload"] for r in got] == payloads


@pytest.mark.parametrize("cut", ["payload", "length", "member"])
def test_damage_is_found(cut):
    record = warc.build_record(1, "u", b"some payload", hashlib.sha1(b"some payload").hexdigest(), None)
    if cut == "payload":
        record = record.replace(b"some payload", b"same payload")
    if cut == "length":
        record = record.replace(b"msgtype=response\r\nContent-Length: ", b"msgtype=response\r\nContent-Length: 1")
    data = warc.gzip_member(record)
    with pytest.raises(warc.WarcError):
        for m in warc.iter_members(memoryview(data[:-20] if cut == "member" else data)):
            warc.parse_record(m)
