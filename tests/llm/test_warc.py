import gzip
import hashlib
import tempfile
from pathlib import Path

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from checks.compare import compare, duck
from gridloom.llm import warc
from gridloom.llm.queries import QUERIES, SQL

T = "page_id long, url string, html string"


def brute(rows):
    data = [(p, (h or "").encode()) for p, _, h in rows]
    first = {}
    for p, d in data:
        if p is not None and len(d) >= 100:
            first[d] = min(first.get(d, p), p)
    out = []
    for p, d in data:
        to = first.get(d)
        revisit = to is not None and p != to
        out.append((p, len(d), hashlib.sha256(d).hexdigest(), "revisit" if revisit else "response", to if revisit else None))
    return sorted(out, key=str)


def ours(df):
    return sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in df.collect()), key=str)


ROWS = [
    (1, "http://a/é x\r\ny", "<p>" + "ü🙂" * 300), (2, None, "<p>" + "ü🙂" * 300), (0, "u", "short"), (3, "u", "short"), (4, "u", None), (5, "u", ""), (6, "u", "\r\n\r\nWARC/1.1\r\n\0" * 40),
    (7, "u", "x" * 99), (8, "u", "x" * 99), (9, "u", "y" * 100), (10, "u", "y" * 100), (None, "u", "y" * 100), (None, "u", "n" * 200), (None, "u", "n" * 200),
    (11, "u", "long " * 60000), (12, "u", "long " * 60000), (13, "u", "other" * 40000), (13, "u", "other" * 40000), (13, "v", "other" * 40000),
]


@pytest.mark.parametrize("segment", [700, warc.SEGMENT])
def test_round_trip(spark, segment):
    df = spark.createDataFrame([(*r, "x") for r in ROWS], T + ", payload string").repartition(4)
    path = warc.write_archives(df, segment=segment)
    records = warc.read_archives(spark, path)
    assert ours(warc.page_records(records)) == brute(ROWS)
    kept = {hashlib.sha256(bytes(r.payload)).hexdigest() for r in records.filter("record_type = 'response'").collect()}
    assert kept == {d for _, _, d, kind, _ in brute(ROWS) if kind == "response"}


def test_files_are_plain_warc(spark):
    path = warc.write_archives(spark.createDataFrame(ROWS, T), segment=1000).removeprefix("file://")
    content = b"".join(gzip.decompress(f.read_bytes()) for f in Path(path).glob("part-*"))
    assert content.count(b"WARC-Type: continuation") > 100 and content.count(b"WARC-Segment-Total-Length") > 3
    plain = list(warc.parse(memoryview(content)))
    assert len(plain) == content.count(b"WARC-Record-ID")


def test_empty(spark):
    df = spark.createDataFrame([], T)
    assert warc.read_archives(spark, warc.write_archives(df)).count() == 0


def test_broken_records_have_no_payload(spark):
    parts = [gzip.decompress(r) for r in warc.records(1, "u", b"z" * 5000, "d", None, 1000)]
    whole = gzip.decompress(next(warc.records(2, "u", b"z" * 5000, "d", None)))
    folder = Path(tempfile.mkdtemp(prefix="run-", dir="/tmp"))
    (folder / "missing.warc").write_bytes(b"".join(parts[:2] + parts[3:]))
    (folder / "framing.warc").write_bytes(whole.replace(b"1388\r\n", b"1387\r\n"))
    (folder / "other.warc").write_bytes(b"WARC/1.1\r\nWARC-Type: warcinfo\r\nContent-Length: 2\r\n\r\nab\r\n\r\n" + parts[0][:50])
    got = warc.read_archives(spark, str(folder)).collect()
    assert sorted((r.record_id, r.payload) for r in got) == [("<urn:page:1:d>", None), ("<urn:page:2:d>", None)]
    (folder / "missing.warc").write_bytes(b"".join(reversed(parts)))
    assert {r.record_id: r.payload and bytes(r.payload) for r in warc.read_archives(spark, str(folder)).collect()}["<urn:page:1:d>"] == b"z" * 5000


@settings(max_examples=100, deadline=None)
@given(st.binary(max_size=300))
def test_chunked_framing(payload):
    assert warc.unchunked(warc.chunked(payload)) == payload
    assert warc.unchunked(warc.chunked(payload)[:-5]) is None or not payload


def test_query(spark, sf):
    assert compare(spark, duck(sf), QUERIES["op2_warc"], SQL["op2_warc"], sf) == ""
