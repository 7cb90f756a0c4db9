import base64
import hashlib

from geolith.llm import warc

PAGE = "<!DOCTYPE html><html><head><title> A &amp; B </title><style>p{}</style></head><body><!-- no --><script>var x='<p>';</script><p>One <b>bold</b>&nbsp;word<br>two</p><ul><li><a href='/a?x=1&amp;y'>A</a><li><a HREF=\"http://h/\">H</a></ul>3 < 4</body></html>"


def test_text_of():
    assert warc.text_of(PAGE) == "One bold word\ntwo\nA\nH\n3 < 4"
    assert warc.text_of("") == "" and warc.text_of("<script>never closed") == ""


def test_derivatives(spark):
    pages = [(1, "http://h/x", PAGE), (2, None, None), (3, "http://h/y", ""), (1, "http://h/x", PAGE), (None, "http://h/z", "plain " * 50_000)]
    source = warc.responses(spark.createDataFrame(pages, "page_id long, url string, html string"))
    by_id = {r.record_id: r for r in source.collect()}
    rows = warc.derivatives(source).collect()
    assert len(rows) == 2 * len(pages)
    for r in rows:
        origin = by_id[r.refers_to]
        assert r.target_uri == origin.target_uri and r.date == origin.date and r.payload_digest == origin.payload_digest
        assert r.block_digest == "sha1:" + base64.b32encode(hashlib.sha1(r.block).digest()).decode()
    one = {r.record_type: r for r in rows if r.page_id == 1}
    assert bytes(one["conversion"].block).decode() == warc.text_of(PAGE)
    meta = bytes(one["metadata"].block).decode().split("\r\n")
    origin = by_id[one["metadata"].refers_to]
    assert {"http-status: HTTP/1.1 200 OK", "http-header-content-type: text/html; charset=utf-8", f"source-block-digest: {origin.block_digest}", f"source-payload-digest: {origin.payload_digest}", "title: A & B", "outlink: /a?x=1&y", "outlink: http://h/"} <= set(meta)
    assert len({r.record_id for r in rows}) == 2 * len({p[:2] for p in pages})


def test_serialized_records_come_back(spark):
    pages = spark.createDataFrame([(1, "http://h/x", PAGE), (2, None, "é")], "page_id long, url string, html string")
    records = warc.derivatives(warc.responses(pages)).orderBy("record_id")
    rows = warc.serialized(records).collect()
    back = warc.parsed(b"".join(bytes(r.warc) for r in rows))
    assert back == [{f: (bytes(r[f]) if f == "block" else r[f]) for f in warc.FIELDS} for r in rows]


def test_other_records_and_payloads(spark):
    schema = f"page_id long, {warc.RECORD}"
    gz = "Größe".encode("latin-1")
    rows = [
        (1, "response", "<urn:uuid:1>", None, "u", "d", "application/http", None, "sha1:KEPT", b"HTTP/1.0 404 Not Found\nContent-Type: text/plain; charset=latin-1\n\n" + gz),
        (2, "request", "<urn:uuid:2>", None, "u", "d", "t", None, None, b"GET /"),
        (3, "response", None, None, None, None, None, None, None, None),
        (4, "response", "<urn:uuid:4>", None, "u", None, "t", None, None, b"HTTP/ broken"),
    ]
    got = {(r.page_id, r.record_type): r for r in warc.derivatives(spark.createDataFrame(rows, schema)).collect()}
    assert set(got) == {(k, t) for k in (1, 3, 4) for t in ("metadata", "conversion")}
    assert bytes(got[1, "conversion"].block).decode() == "Größe" and got[1, "metadata"].payload_digest == "sha1:KEPT"
    assert b"http-status: HTTP/1.0 404 Not Found" in bytes(got[1, "metadata"].block)
    assert bytes(got[3, "conversion"].block) == b"" and got[4, "conversion"].date is None


def test_empty(spark):
    assert warc.query(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
