import base64
import hashlib

from plumeline.llm import warc

PAGES = [(3, "http://a/x", "<p>é</p>"), (1, "http://a/y z", "<p>é</p>"), (2, None, None), (4, "http://b/", ""), (5, "http://b/1", "x" * 100_000), (6, "http://b/2", "\r\n\r\n<p>WARC-Type: revisit</p>\r\n\r\n"), (7, "http://ü/", "one")]


def archived(spark, tmp_path, rows, **settings):
    pages = spark.createDataFrame([(*r, "no") for r in rows], "page_id long, url string, html string, payload string")
    warc.write_archive(pages, f"{tmp_path}/a", **settings)
    return warc.parse(warc.read_archive(spark, f"{tmp_path}/a")).collect()


def test_round_trip(spark, tmp_path):
    found = {r.page_id: r for r in archived(spark, tmp_path, PAGES)}
    assert len(found) == len(PAGES)
    first = {}
    for i, _, h in sorted(PAGES, key=lambda r: r[0]):
        first.setdefault(h or "", i)
    for i, _, h in PAGES:
        data, r = (h or "").encode(), found[i]
        assert (r.payload_bytes, r.payload_digest) == (len(data), base64.b32encode(hashlib.sha1(data).digest()).decode())
        assert (r.record_type, r.refers_to) == (("response", None) if first[h or ""] == i else ("revisit", first[h or ""]))
        assert r.payload is None if r.record_type == "revisit" else bytes(r.payload) == data
    assert spark.read.parquet(f"{tmp_path}/a/payloads").count() == len(first)


def test_small_payloads_and_repeated_rows(spark, tmp_path):
    found = archived(spark, tmp_path, [*PAGES, PAGES[0], (None, None, "one")], least=5)
    assert sorted((r.page_id or 0, r.record_type) for r in found if r.payload_bytes < 5) == [(0, "response"), (2, "response"), (4, "response"), (7, "response")]
    assert len(found) == len(PAGES) + 2


def test_empty(spark, tmp_path):
    assert archived(spark, tmp_path, []) == []
