import base64
import gzip
import hashlib
import html
import os
import re
import uuid
import zlib
from html.parser import HTMLParser

import pytest
import zstandard
from compare import SF, available

from geolith.llm import warc

BLOCKS = "p div br li ul ol tr table h1 h2 h3 h4 h5 h6 article section nav footer header main aside blockquote pre hr dl dt dd form figure".split()
HIDDEN = {"script", "style", "noscript", "template", "svg", "head"}


class Reader(HTMLParser):
    """Text by a real parser, for pages whose tags are all closed."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out, self.hidden, self.title, self.in_title, self.links = [], [], None, False, []

    def handle_starttag(self, tag, attrs):
        if tag in HIDDEN:
            self.hidden.append(tag)
            self.out.append(" ")
        if tag in BLOCKS and not self.hidden:
            self.out.append("\n")
        self.in_title = tag == "title" and self.title is None
        if tag == "a":
            self.links += [v for k, v in attrs if k == "href" and v]

    def handle_endtag(self, tag):
        if self.hidden and self.hidden[-1] == tag:
            self.hidden.pop()
        if tag in BLOCKS and not self.hidden:
            self.out.append("\n")
        self.in_title = False

    def handle_comment(self, data):
        self.out.append(" ")

    def handle_data(self, data):
        if self.in_title:
            self.title = (self.title or "") + data
        if not self.hidden:
            self.out.append(data)


def read(page):
    r = Reader()
    r.feed(page)
    r.close()
    lines = [re.sub(r"[ \t\r\f\v ]+", " ", x).strip(" ") for x in "".join(r.out).split("\n")]
    return "\n".join(x for x in lines if x), r


def sha1(raw):
    return "sha1:" + base64.b32encode(hashlib.sha1(raw).digest()).decode()


def brute(pages):
    space, out = uuid.uuid5(uuid.NAMESPACE_URL, "urn:warc:derivative"), []
    for key, url, page in pages:
        raw = (page or "").encode()
        head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(raw)}\r\n\r\n".encode()
        source = f"<urn:uuid:{uuid.uuid5(space, chr(10).join(('response', str(key), url or '', sha1(raw))))}>"
        text, r = read(page or "")
        fields = ["http-status: HTTP/1.1 200 OK", "http-header-content-type: text/html; charset=utf-8", f"http-header-content-length: {len(raw)}"]
        fields += [f"source-block-digest: {sha1(head + raw)}", f"source-payload-digest: {sha1(raw)}", f"source-payload-length: {len(raw)}"]
        if r.title is not None:
            fields.append("title: " + " ".join(r.title.split()))
        fields += [f"outlink: {' '.join(x.split())}" for x in dict.fromkeys(x.strip() for x in r.links)]
        made = "".join(f"{x}\r\n" for x in fields).encode()
        for kind, block in (("metadata", made), ("conversion", text.encode())):
            own = f"<urn:uuid:{uuid.uuid5(space, chr(10).join((kind, source)))}>"
            out.append((key, kind, own, source, url, len(block), sha1(block), sha1(raw)))
    return out


PAGES = [
    (1, "http://a.net/", '<!DOCTYPE html><html><head><title>A &amp; b</title><script>x="<p>"</script></head><body><p title="a > b">One &lt; two</p><div data-x=\'>\'>three<br>four</div><a href="/x?a=1&amp;b=2">l</a><svg><text>no</text></svg></body></html>'),
    (2, None, "<p>plain   text</p>\n\n<ul><li>one</li><li>two</li></ul><!-- <p>no</p> -->end"),
    (3, "http://b.net/", None),
    (3, "http://b.net/", None),
    (4, "", ""),
    (5, "http://c.net/", "<html><body>" + "<p>word word</p>" * 20_000 + "</body></html>"),
]


def rows_of(df):
    return sorted((tuple(r) for r in df.select("page_id", "record_type", "record_id", "refers_to", "target_uri", "block_length", "block_digest", "payload_digest").collect()), key=str)


def test_query_equals_brute_force(spark):
    df = spark.createDataFrame([(*p, "x", b"y") for p in PAGES], "page_id long, url string, html string, record_id string, block binary").repartition(3)
    assert rows_of(warc.query(df)) == sorted(brute(PAGES), key=str)
    assert warc.query(df.limit(0)).count() == 0


@pytest.mark.skipif(not available(), reason="no test tables")
def test_query_over_the_whole_table_equals_brute_force(spark):
    pages = spark.read.parquet(os.path.join(SF, "pages.parquet"))
    rows = [(r.page_id, r.url, r.html) for r in pages.collect()]
    assert rows_of(warc.query(pages)) == sorted(brute(rows), key=str) and len(rows) >= 50


def test_encodings_are_undone():
    page = "<p>" + "text of the page " * 50 + "</p>"
    raw = page.encode()
    chunks = b"".join(b"%x;ext=1\r\n%s\r\n" % (len(raw[k : k + 100]), raw[k : k + 100]) for k in range(0, len(raw), 100)) + b"0\r\n\r\n"
    cases = {
        "Transfer-Encoding: chunked": chunks,
        "Content-Encoding: gzip": gzip.compress(raw),
        "Content-Encoding: deflate": zlib.compress(raw),
        "content-encoding: deflate ": zlib.compress(raw)[2:-4],
        "Content-Encoding: zstd": zstandard.compress(raw),
        "Content-Encoding: deflate, gzip": gzip.compress(zlib.compress(raw)),
        "X: y": raw,
    }
    for header, payload in cases.items():
        block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n" + header.encode() + b"\r\n\r\n" + payload
        meta, text = warc.derive("<urn:uuid:1>", None, None, None, block)
        assert text[8].decode() == html.unescape("text of the page " * 50).strip(), header
        assert f"source-payload-digest: {sha1(payload)}" in meta[8].decode()
    meta, text = warc.derive("<urn:uuid:1>", None, None, None, b"HTTP/1.1 200 OK\r\nContent-Encoding: br\r\n\r\nxyz")
    assert text[8] == b"" and b"content-encoding-kept: br" in meta[8]
    assert warc.dechunked(b"not chunked\r\n") == b"not chunked\r\n" and warc.dechunked(b"5\r\nabc") == b"abc"
