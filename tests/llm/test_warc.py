import base64
import gzip
import hashlib

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from txnrisk.llm import warc as W

SCHEMA = "page_id long, url string, html string, payload string, copy_digest string, first_page string, refers_to string"
LONG = "é😀" * 200_000
PAGES = [
    (5, "http://a/5", "same"), (3, "http://a/3", "same"), (9, None, "same"), (1, "http://a/1\r\nX: y", "one\r\n\r\nWARC/1.1\r\n"), (2, "http://é", None), (4, "http://a/4", ""),
    (6, "", LONG), (7, "http://a/7", LONG), (None, "http://a/n", "only"), (None, "http://a/m", "same"), (8, "http://a/8", "x"), (8, "http://a/8", "x"),
]


def pages(spark, rows=PAGES):
    return spark.createDataFrame([(*r, "x", "x", "x", "x") for r in rows], SCHEMA)


def brute(rows, least):
    out, first = [], {}
    for page, _, html in rows:
        data = (html or "").encode()
        if page is not None and len(data) >= least:
            first[data] = min(page, first.get(data, page))
    for page, _, html in rows:
        data = (html or "").encode()
        revisit = data in first and first[data] != page
        out.append((page, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if revisit else "response", first[data] if revisit else None))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    return W.write_warc(pages(spark), folder=f"file://{tmp_path_factory.mktemp('warc')}/gz")


def read_back(spark, path):
    rows = W.read_warc(spark, path, verify=True).select(W.page_of(F.col("record_id")).alias("p"), "payload_bytes", "payload_digest", "record_type", W.page_of(F.col("refers_to_id")).alias("r"))
    return sorted((tuple(r) for r in rows.collect()), key=str)


@pytest.mark.parametrize(("least", "compress"), [(0, True), (0, False), (3, True)])
def test_round_trip(spark, tmp_path, least, compress):
    path = W.write_warc(pages(spark), folder=f"file://{tmp_path}/w", min_bytes=least, compress=compress)
    assert read_back(spark, path) == brute(PAGES, least)


def test_payloads_and_urls(spark, folder):
    rows = W.read_warc(spark, folder, payload=True).filter("record_type = 'response'").collect()
    got = {r.record_id: (bytes(r.payload), r.target_uri) for r in rows}
    assert got["<urn:page:6>"] == (LONG.encode(), "") and got["<urn:page:2>"] == (b"", "http://é")
    assert got["<urn:page:1>"] == (b"one\r\n\r\nWARC/1.1\r\n", "http://a/1%0D%0AX: y")
    assert W.read_warc(spark, folder).filter("record_id = '<urn:page:9>'").first().target_uri is None


def test_filters_run_before_payloads(spark, tmp_path):
    good = W.record_bytes(1, "http://good/", b"fine", None, "2024-01-01T00:00:00Z")
    bad = W.record_bytes(2, "http://bad/", b"spoilt payload", None, "2024-01-01T00:00:00Z")
    member = W.gzip_member(bad)
    head = W._MEMBER.size + 20
    for name, spoilt in (("plain.warc", bad.replace(b"spoilt", b"broken")), ("packed.warc.gz", member[: head + 150] + bytes(len(member) - head - 158) + member[-8:])):
        path = tmp_path / name
        parts = [good, spoilt, good] if name.startswith("plain") else [W.gzip_member(good), spoilt, W.gzip_member(good)]
        path.write_bytes(b"".join(parts))
        found = W.read_warc(spark, f"file://{path}", verify=True)
        if name.startswith("plain"):
            with pytest.raises(PySparkException, match="does not match"):
                found.collect()
        kept = found.filter("target_uri = 'http://good/' and record_type = 'response'")
        assert "ArrowEval" not in kept._jdf.queryExecution().toString()
        if name.startswith("plain"):
            assert kept.count() == 2


def test_pushed_predicates(spark, folder):
    records = W.read_warc(spark, folder)
    want = [r for r in records.collect() if r.record_type == "revisit" and (r.target_uri or "").startswith("http://a/")]
    found = records.filter(F.col("record_type").isin("revisit") & F.col("target_uri").startswith("http://a/") & F.col("refers_to_id").isNotNull())
    assert sorted(found.collect()) == sorted(want) and want
    # A test of a column that only the payload decides stays with Spark.
    assert {r.record_id for r in records.filter("payload_bytes = 1").collect()} == {"<urn:page:8>"}


def test_foreign_gzip(spark, tmp_path):
    records = [W.record_bytes(i, f"http://x/{i}", b"p" * i, None, "2024-01-01T00:00:00Z") for i in range(5)]
    (tmp_path / "a.warc.gz").write_bytes(b"".join(gzip.compress(r) for r in records))
    (tmp_path / "b.warc").write_bytes(b"".join(records))
    (tmp_path / "other.txt").write_bytes(b"no archive")
    found = W.read_warc(spark, f"file://{tmp_path}", verify=True).filter("record_id <> '<urn:page:0>'")
    assert sorted(r.payload_bytes for r in found.collect()) == [1, 1, 2, 2, 3, 3, 4, 4]


def test_empty(spark, tmp_path):
    path = W.write_warc(pages(spark, []), folder=f"file://{tmp_path}/none")
    assert W.read_warc(spark, path).count() == 0
