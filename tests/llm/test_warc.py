import hashlib

import pytest

from bondflow.llm import shared, warc


def test_round_trip_with_magic_in_payloads(spark):
    fake = "WARC/1.0\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    long = "x" * 1500
    pages = [(1, "http://a/", "plain"), (2, None, None), (3, "http://b/\r\nX: y", fake * 3), (4, "u", long), (5, "u", long), (6, "u", long), (7, "u", "plain"), (8, "u", "WARC/1.0\r\n"), (9, "u", "é" * 600), (10, "u", "é" * 600), (None, "u", "z"), (11, "u", fake * 400), (12, "", "")]
    df = spark.createDataFrame(pages, "page_id bigint, url string, html string")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")  # parts begin inside records, headers and magics
    try:
        got = {r["page_id"]: r for r in warc.round_trip(df.coalesce(2)).collect()}
        path = shared.new_path(spark, "warc")
        warc.write(df.coalesce(1), path)
        texts = {r["record_id"]: bytes(r["payload"]) for r in warc.read(spark, path).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert len(got) == len(pages)
    for key, _, html in pages:
        raw = (html or "").encode()
        assert (got[key]["payload_bytes"], got[key]["payload_digest"]) == (len(raw), hashlib.sha1(raw).hexdigest())
    assert {k: r["refers_to"] for k, r in got.items() if r["record_type"] == "revisit"} == {4: 6, 5: 6, 9: 10}
    assert texts["<urn:row:11>"] == (fake * 400).encode() and texts["<urn:row:3>"] == (fake * 3).encode() and texts["<urn:row:4>"] == b""


def test_empty_table(spark):
    assert warc.round_trip(spark.createDataFrame([], "page_id bigint, url string, html string")).count() == 0


def test_a_broken_header_ends_the_chain(spark):
    path = shared.new_path(spark, "broken")
    good = "WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:row:1>\r\nContent-Length: 2\r\n\r\nab"
    rows = spark.createDataFrame([(good,), ("WARC/1.0\r\nContent-Length: x\r\n\r\nzz",), (good,)], "value string").coalesce(1)
    rows.write.option("lineSep", warc.GAP).text(path)
    found = warc.read(spark, path).collect()
    assert [r["length"] for r in found if r["length"] is not None] == [2]


def test_a_revisit_needs_its_response(spark, monkeypatch):
    rows = [(i, "u", "same " * 300) for i in range(4)] + [(9, "v", "other")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    got = {r["page_id"]: tuple(r)[1:] for r in warc.round_trip(pages.selectExpr("*", "1 as file", "2 as digest")).collect()}
    digest = got[3][1]
    assert got == {3: (1500, digest, "response", None), 9: (5, got[9][1], "response", None)} | {i: (1500, digest, "revisit", 3) for i in range(3)}
    read = warc.read
    monkeypatch.setattr(warc, "read", lambda *a, **k: read(*a, **k).where("record_id <> '<urn:row:3>'"))
    with pytest.raises(Exception, match="names no response"):
        warc.round_trip(pages).collect()


def test_both_ways_of_finding_equal_payloads_agree(spark):
    pages = [(i, "u", f"{'p' * 1200}{i % 5}") for i in range(40)] + [(i, "u", "short") for i in range(3)] + [(None, "u", "q" * 1001), (3, "u", "q" * 1001), (None, "u", "n" * 2000), (None, "u", "n" * 2000), (7, "u", None), (8, "u", "alone" * 500)]
    rows = spark.createDataFrame(pages, "id bigint, url string, payload string")
    sent, joined = (sorted(map(str, (r.asDict() for r in warc.classify(rows, most_bits=bits).select("id", "bytes", "digest", "original").collect()))) for bits in (1 << 28, 0))
    assert sent == joined and len(sent) == len(pages)
    assert sum("'original': None" not in x for x in sent) == 36
