import hashlib
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from corpuspack.llm import warc
from corpuspack.llm.common import pages as read_pages
from corpuspack.llm.queries import op1_warc_capture_index
from tests.conftest import SF_SMALL

COLUMNS = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]


def brute_force(rows):
    out = []
    for page_id, html in rows:
        payload = (html or "").encode()
        same = [p for p, h in rows if (h or "").encode() == payload and p is not None]
        first = max(same) if same and len(payload) >= warc.LEAST_REVISIT else None
        again = first is not None and page_id != first
        out.append((page_id, len(payload), hashlib.sha1(payload).hexdigest(), "revisit" if again else "response", first if again else None))
    return sorted(out, key=str)


def rows_of(df):
    return sorted((tuple(r) for r in df.select(*COLUMNS).collect()), key=str)


def test_query_against_sql_and_brute_force(spark):
    got = rows_of(op1_warc_capture_index(spark, SF_SMALL))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW pages AS SELECT * FROM '{SF_SMALL}/pages.parquet'")
    assert got == sorted(con.sql(warc.ROUND_TRIP_SQL).fetchall(), key=str)
    assert got == brute_force([(r["page_id"], r["html"]) for r in read_pages(spark, SF_SMALL).collect()])


def make_pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit("clash")).withColumn("offset", F.lit(1))


def test_revisits_nulls_and_repeated_rows(spark, tmp_path):
    big, limit = "é" * 800, "x" * 1000
    rows = [
        (1, "http://a.example/x", big), (2, "http://a.example/x", big), (3, "https://b.example/", big), (4, "http://c.example", "x" * 999), (5, "http://c.example", "x" * 999),
        (6, "u", limit), (7, "u", limit), (7, "u", limit), (None, None, None), (None, "http://a.example/x", big), (8, None, ""), (9, "http://d.example/\n\t x", "\r\n\r\nWARC/1.1"),
        (10, "http://d.example/q?a=1#frag", "y" * 3_000_000), (-4, "http://A.example:80/x", "z"),
    ]
    df = make_pages(spark, rows)
    out = warc.round_trip(df, str(tmp_path / "w"), with_payload=True)
    assert rows_of(out) == brute_force([(p, h) for p, _, h in rows])
    payload = {r["page_id"]: r for r in out.collect() if r["page_id"] is not None}
    assert payload[10]["payload"] == b"y" * 3_000_000 and payload[2]["payload"] is None and payload[9]["payload"] == b"\r\n\r\nWARC/1.1"
    assert warc.round_trip(make_pages(spark, []), str(tmp_path / "none")).count() == 0


def test_lookup_by_url(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "BLOCK_CAPTURES", 4)
    rows = [(i, f"http://h{i % 7}.example/{i % 5}", f"page {i}") for i in range(200)]
    captures = warc.write_archives(make_pages(spark, rows), str(tmp_path / "a"))
    index = warc.build_index(captures, f"file://{tmp_path}/i")
    assert captures.count() == 200 and index.shards == sorted(index.shards)
    wanted = spark.createDataFrame([("http://H3.example:80/2#part",), ("https://h5.example/1",), ("http://nowhere.example/",), (None,)], "url string")
    found = warc.find_captures(wanted, index)
    assert sorted(r["page_id"] for r in found.collect()) == [i for i in range(200) if (i % 7, i % 5) in ((3, 2), (5, 1))]
    records = warc.read_records(found, with_payload=True).collect()
    assert all(r["payload"] == f"page {r['page_id']}".encode() for r in records) and records


def test_keys_sort_by_reversed_host():
    assert warc.url_key("http://User@www.Example.COM:80/A?b=1#c") == "com,example,www)/A?b=1"
    assert warc.url_key("https://example.com:8443") == "com,example:8443)/"
    assert warc.url_key(None) == "" and warc.url_key("not a url") == "not%20a%20url"


def test_broken_record_is_an_error():
    good = warc.record(1, "u", b"payload" * 3, "response", None)
    squeeze = lambda raw: (c := zlib.compressobj(6, zlib.DEFLATED, 31)).compress(raw) + c.flush()
    assert warc.parse(squeeze(good))["payload"] == b"payload" * 3
    with pytest.raises(ValueError):
        warc.parse(squeeze(good.replace(b"payloadp", b"payload!")))


def test_stretches_join_near_ranges():
    rows = [("a", 0, 10), ("a", 10, 10), ("a", 20 + warc.GAP_BYTES, 5), ("a", 10**9, 5), ("b", 0, 1)]
    assert [len(r) for r in warc.stretches(rows)] == [3, 1, 1]
