import gzip
import hashlib

import pytest

from quillon.llm import archive
from quillon.storage import new_path


def test_arc_versions_and_lengths():
    for version in (1, 2):
        records = [("http://a.b/c d", b"HTTP/1.1 200 OK\r\nX-Page-Id: 5\r\n\r\nline\nfiledesc://x\n\n"), ("-", b""), ("http://z", b"\r\n\r\n\nhttp://q 0 0 x 3")]
        raw = archive.arc_head(version, "n.arc") + b"\n" + b"".join(archive.arc_record(version, "n.arc", u, "1.2.3.4", "20010203040506", "text/html", c) + b"\n" for u, c in records)
        for content in (raw, gzip.compress(raw)):
            got = list(archive.parse_arc(content))
            assert [(r["url"], r["content"]) for r in got] == records
            assert {(r["ip"], r["date"], r["mime"]) for r in got} == {("1.2.3.4", "20010203040506", "text/html")}
        with pytest.raises(ValueError, match="torn"):
            list(archive.parse_arc(raw[:-5]))
    with pytest.raises(ValueError, match="filedesc"):
        list(archive.parse_arc(b"http://a 1 2 3 4\n"))


def test_round_trip(spark):
    big = "é<p>\r\n\r\nWARC/1.1\r\n\n漢" * 20
    rows = [
        (5, "http://b/ x\n", big), (3, "http://a", big), (9, None, big), (1, "http://c", "short"), (2, "http://d", "short"), (4, "http://e", None),
        (6, "http://f", ""), (7, "http://g", "x" * 99), (8, "http://g", "x" * 99), (10, "h", "y" * 100), (11, "h", "y" * 100), (None, "n", big), (None, "n2", "z" * 200),
    ]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id bigint, url string, html string, digest string")
    arc, warc = new_path(spark, "arc"), new_path(spark, "warc")
    archive.write_arc(pages.repartition(4), arc, "page_id", "url", "html")
    archive.convert(archive.read_arc(spark, arc), warc)
    got = archive.read_warc(spark, warc).collect()
    assert len(got) == len(rows)
    ids = {r.record_id: r for r in got}
    html = {i: (h or "").encode() for i, _, h in rows if i is not None}
    for r in got:
        payload = html[r.key] if r.key is not None else (big.encode() if r.n_bytes == len(big.encode()) else b"z" * 200)
        assert r.n_bytes == len(payload) and r.digest == hashlib.sha256(payload).hexdigest()
        assert r.payload is None if r.record_type == "revisit" else bytes(r.payload) == payload
        assert r.date == "2024-01-01T00:00:00Z"
        assert (ids[r.refers_id].key if r.refers_id else None) == {5: 3, 9: 3, 11: 10, None: 3}.get(r.key) or r.n_bytes == 200
    assert sum(r.record_type == "revisit" for r in got) == 4


def test_empty(spark):
    pages = spark.createDataFrame([], "page_id bigint, url string, html string")
    arc, warc = new_path(spark, "arc"), new_path(spark, "warc")
    archive.write_arc(pages, arc, "page_id", "url", "html")
    archive.convert(archive.read_arc(spark, arc), warc)
    assert archive.read_warc(spark, warc).count() == 0
