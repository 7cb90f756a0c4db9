"""Derivatives of WARC responses: a metadata record and a plain-text conversion record for each.

A derivative refers to its response by ``WARC-Refers-To`` and keeps its target, its date and its payload digest; the
metadata block lists the source's HTTP status and headers, its digests, the title and the links.  Record ids come
from the source's id and the kind, so that a task that runs again makes the same records.

Records are rows (``RECORD``) with the block as bytes; ``serialized`` and ``parsed`` turn rows into the WARC/1.1 form
and back.  A response without an HTTP head (no blank line) is all payload.  Digests are of what was stored; text comes
from the payload with its chunks joined and its compression (gzip, deflate, zstd) undone.  A payload under another
content encoding has an empty text, and the metadata name the encoding.  Responses that are not HTML convert to their
text as it is.

A null block is an empty one; a null target or date leaves its field out.  A very long page is one value.  Repeated
rows give repeated records with equal ids.  Other columns, whatever their names, are left out.  An empty table gives
an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import html
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import modest_batches

#: record_type, record_id, refers_to, target_uri, date and content_type as in the header; block: the record's bytes.
RECORD = "record_type string, record_id string, refers_to string, target_uri string, date string, content_type string, block_digest string, payload_digest string, block binary"
FIELDS = [x.split()[0] for x in RECORD.split(", ")]
SPACE = uuid.uuid5(uuid.NAMESPACE_URL, "urn:warc:derivative")

#: The rest of a tag: quoted values may hold its end sign; a quote that is never closed ends with the tag.
REST = r"(?:(?:[^>\"']++|\"[^\"]*\"|'[^']*')*+>|[^>]*>)"
#: What may stand in a head; it ends before anything else, as its end tag may be left out.
IN_HEAD = rf"(?:\s+|<!--.*?(?:-->|\Z)|<(title|script|style|noscript|template)\b{REST}.*?</\2\s*>|<(?:script|style)\b{REST}.*|</?(?:meta|link|base|title|noscript|template)\b{REST})"
#: Only comments, scripts and styles run to the end of the page; others without an end tag lose the tag alone.
DROP = re.compile(rf"(?is)<!--.*?(?:-->|\Z)|<svg\b[^>]*/>|<(script|style)\b{REST}.*?(?:</\1\s*>|\Z)|<head\b{REST}{IN_HEAD}*+(?:</head\s*>)?|<(noscript|template|svg)\b{REST}.*?</\3\s*>")
BREAK = re.compile(rf"(?i)</?(?:p|div|br|li|ul|ol|tr|table|h[1-6]|article|section|nav|footer|header|main|aside|blockquote|pre|hr|dl|dt|dd|form|figure)\b{REST}")
TAG = re.compile(rf"<[a-zA-Z/!?]{REST}")
BLANK = re.compile(r"[ \t\r\f\v ]+")
LINES = re.compile(r" ?\n[ \n]*")
TITLE = re.compile(rf"(?is)<title\b{REST}(.*?)</title\s*>")
HREF = re.compile(r"(?is)<a\b[^>]*?\bhref\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))")
CHARSET = re.compile(r"(?i)charset\s*=\s*[\"']?([\w.-]+)")


def digest(raw: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(raw).digest()).decode()


def new_id(*parts: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(SPACE, chr(10).join(parts))}>"


def split_http(block: bytes) -> tuple[str, list[tuple[str, str]], bytes]:
    """(status line, headers, payload)."""
    if not block.startswith(b"HTTP/"):
        return "", [], block
    head, found, payload = block.partition(b"\r\n\r\n")
    if not found:
        head, found, payload = block.partition(b"\n\n")
    if not found:
        return "", [], block
    first, *rest = head.decode("utf-8", "replace").splitlines()
    return first, [(k.strip(), v.strip()) for k, _, v in (x.partition(":") for x in rest)], payload


def dechunked(raw: bytes) -> bytes:
    """The chunks of a chunked body, up to where it breaks off; ``raw`` where it is not chunked after all."""
    out, at = [], 0
    while (end := raw.find(b"\r\n", at)) >= 0:
        try:
            size = int(raw[at:end].split(b";")[0], 16)
        except ValueError:
            break
        if size <= 0:
            break
        out.append(raw[end + 2 : end + 2 + size])
        at = end + 4 + size
    return b"".join(out) if out or raw.startswith(b"0") else raw


def inflated(raw: bytes, encoding: str) -> bytes | None:
    """``raw`` with a content encoding undone, as far as it goes; null where the encoding is not known."""
    if encoding in ("", "identity"):
        return raw
    if encoding in ("gzip", "x-gzip", "deflate"):
        for bits in (47, -15):  # with a head of either kind, or bare
            try:
                return zlib.decompressobj(bits).decompress(raw)
            except zlib.error:
                continue
        return raw
    if encoding == "zstd":
        try:
            return zstandard.ZstdDecompressor().decompressobj().decompress(raw)
        except zstandard.ZstdError:
            return raw
    return None


def body_of(headers: list[tuple[str, str]], payload: bytes) -> tuple[bytes, str]:
    """(the payload with its encodings undone, the content encoding that could not be)."""
    named = {k.lower(): v.lower() for k, v in headers}
    if "chunked" in named.get("transfer-encoding", ""):
        payload = dechunked(payload)
    for encoding in reversed([x.strip() for x in named.get("content-encoding", "").split(",")]):
        found = inflated(payload, encoding)
        if found is None:
            return b"", encoding
        payload = found
    return payload, ""


def text_of(page: str) -> str:
    """Visible text: one line for each block element, runs of blanks as one space."""
    page = TAG.sub("", BREAK.sub("\n", DROP.sub(" ", page)))
    if "&" in page:
        page = html.unescape(page)
    return LINES.sub("\n", BLANK.sub(" ", page)).strip()


def decoded(payload: bytes, content_type: str) -> str:
    found = CHARSET.search(content_type)
    try:
        return payload.decode(found[1] if found else "utf-8", "replace")
    except LookupError:
        return payload.decode("utf-8", "replace")


def derive(record_id: str, target: str | None, date: str | None, payload_digest: str | None, block: bytes) -> list[tuple]:
    status, headers, payload = split_http(block)
    kind = next((v for k, v in headers if k.lower() == "content-type"), "text/html")
    body, unknown = body_of(headers, payload)
    page = decoded(body, kind)
    source_payload = payload_digest or digest(payload)
    is_html = "html" in kind.lower()
    title = TITLE.search(page) if is_html else None
    fields = [("http-status", status)] if status else []
    fields += [(f"http-header-{k.lower()}", v) for k, v in headers]
    fields += [("source-block-digest", digest(block)), ("source-payload-digest", source_payload), ("source-payload-length", str(len(payload)))]
    if unknown:
        fields.append(("content-encoding-kept", unknown))
    if title:
        fields.append(("title", " ".join(html.unescape(title[1]).split())))
    if is_html:
        links = dict.fromkeys(html.unescape(a or b or c).strip() for a, b, c in HREF.findall(page))
        fields += [("outlink", " ".join(x.split())) for x in links if x]
    made = "".join(f"{k}: {v}\r\n" for k, v in fields).encode()
    text = (text_of(page) if is_html else page).encode()
    return [(k, new_id(k, record_id), record_id, target, date, t, digest(b), source_payload, b) for k, t, b in (("metadata", "application/warc-fields", made), ("conversion", "text/plain; charset=utf-8", text))]


def responses(pages: DataFrame, url_col: str = "url", html_col: str = "html", key_col: str = "page_id", date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Response records of a table of raw pages, with its key in front.  The date is a parameter: pages have none."""
    names = [key_col, *FIELDS]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for key, url, page in zip(*(c.to_pylist() for c in batch.columns)):
                raw = (page or "").encode()
                head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(raw)}\r\n\r\n".encode()
                rows.append((key, "response", new_id("response", str(key), url or "", digest(raw)), None, url, date, "application/http; msgtype=response", digest(head + raw), digest(raw), head + raw))
            yield batch_of(rows, names, batch.column(0).type)

    modest_batches(pages.sparkSession)
    key = pages.schema[key_col].dataType.simpleString()
    return pages.select(key_col, url_col, html_col).mapInArrow(run, f"`{key_col}` {key}, {RECORD}")


def batch_of(rows: list[tuple], names: list[str], key: pa.DataType) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [()] * len(names)
    kinds = [key] * (len(names) - len(FIELDS)) + [pa.binary() if n == "block" else pa.string() for n in FIELDS]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)


def derivatives(records: DataFrame, key_col: str = "page_id") -> DataFrame:
    """The metadata and the conversion record of each response in ``records``; other records give none."""
    names = [key_col, *FIELDS]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for key, rid, target, day, payload, block in zip(*(c.to_pylist() for c in batch.columns)):
                rows += [(key, *x) for x in derive(rid or new_id("response", str(key)), target, day, payload, block or b"")]
            yield batch_of(rows, names, batch.column(0).type)

    own = records.where("record_type = 'response'").select(key_col, "record_id", "target_uri", "date", "payload_digest", "block")
    return own.mapInArrow(run, f"`{key_col}` {records.schema[key_col].dataType.simpleString()}, {RECORD}")


HEADERS = (("WARC-Type", "record_type"), ("WARC-Record-ID", "record_id"), ("WARC-Refers-To", "refers_to"), ("WARC-Target-URI", "target_uri"), ("WARC-Date", "date"), ("Content-Type", "content_type"), ("WARC-Block-Digest", "block_digest"), ("WARC-Payload-Digest", "payload_digest"))


def serialized(records: DataFrame) -> DataFrame:
    """``records`` with ``warc``: the bytes of each record; written one after another they make a WARC file."""
    head = F.concat(F.lit("WARC/1.1\r\n"), *[F.coalesce(F.concat(F.lit(f"{k}: "), F.col(c), F.lit("\r\n")), F.lit("")) for k, c in HEADERS], F.lit("Content-Length: "), F.octet_length("block").cast("string"), F.lit("\r\n\r\n"))
    return records.withColumn("warc", F.concat(head.cast("binary"), F.col("block"), F.lit("\r\n\r\n").cast("binary")))


def parsed(warc: bytes) -> list[dict]:
    """The records of a WARC file's bytes."""
    out, at = [], 0
    names = {k.lower(): c for k, c in HEADERS}
    while at < len(warc):
        end = warc.index(b"\r\n\r\n", at)
        own = dict.fromkeys(FIELDS)
        size = 0
        for line in warc[at:end].decode().split("\r\n")[1:]:
            k, _, v = line.partition(": ")
            if k.lower() == "content-length":
                size = int(v)
            else:
                own[names[k.lower()]] = v
        own["block"] = warc[end + 4 : end + 4 + size]
        out.append(own)
        at = end + 4 + size + 4
    return out


def query(pages: DataFrame) -> DataFrame:
    """page_id, record_type, record_id, refers_to, target_uri, block_length, block_digest, payload_digest."""
    out = derivatives(responses(pages))
    return out.select("page_id", "record_type", "record_id", "refers_to", "target_uri", F.octet_length("block").cast("long").alias("block_length"), "block_digest", "payload_digest")
