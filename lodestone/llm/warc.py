"""WARC derivatives: metadata and plain-text conversion records of response records.

A response record becomes two records that point back to it:

* ``metadata`` (application/warc-fields): what the response's HTTP header and HTML tell, with
  its status, type, title, language, digests and numbers of links and words;
* ``conversion`` (text/plain): the visible text.

Both carry WARC-Refers-To with the response's record id, its target URI and date, and the
source's digests; their own ids are name-based UUIDs of the response's id and the
record type, so that building twice gives equal records.  WARC-Concurrent-To links the
two.  Digests are SHA-1 in base32 over block and payload as WARC/1.1 has them.

Records are built row by row, whatever the size of a page, and written through Spark: a
partition's records follow one another in one file, which the job's commit publishes.

Defined results: a null url or html counts as empty; an empty page still gives both records,
the conversion one with an empty block; bytes that aren't UTF-8 are replaced; a response whose
header can't be parsed has status 0 and is taken as body from its first byte.  A record that lacks an id goes by
one made of its bytes, one without a length, or with one that is no number, reaches to its end, header lines without a colon are skipped; a
null response gives nulls.  Rows stay one by
one; pages of equal id, url and html give records of equal ids.  Columns other than those named are left out.
"""

from __future__ import annotations

import base64
import hashlib
import html as entities
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import bounded_batches, each_batch, table

_SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")
DATE = "2024-01-01T00:00:00Z"
_HIDDEN = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|template|noscript|head)\b.*?(?:</\1\s*>|\Z)|<[!?][^>]*>", re.DOTALL | re.IGNORECASE)
_BREAK = re.compile(r"</?(?:p|div|br|li|ul|ol|tr|td|th|table|h[1-6]|section|article|header|footer|nav|main|aside|blockquote|pre|form|hr|dd|dt|dl|title|body|html)\b[^>]*>", re.IGNORECASE)
_TAG = re.compile(r"</?[a-zA-Z][^>]*>")
_TITLE = re.compile(r"<title\b[^>]*>(.*?)</title\s*>", re.DOTALL | re.IGNORECASE)
_LANG = re.compile(r"<html\b[^>]*?\blang\s*=\s*[\"']?([A-Za-z-]+)", re.IGNORECASE)
_LINK = re.compile(r"<a\b[^>]*?\bhref\s*=", re.IGNORECASE)
_LINE = re.compile(r"[^\S\n]+")


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(*names: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(_SPACE, chr(10).join(names))}>"


def record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    """A WARC/1.1 record; line breaks in a header value become spaces."""
    lines = "".join(f"{k}: {' '.join(v.splitlines())}\r\n" for k, v in [*headers, ("WARC-Block-Digest", digest(block)), ("Content-Length", str(len(block)))])
    return f"WARC/1.1\r\n{lines}\r\n".encode() + block + b"\r\n\r\n"


def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and block of the first record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = (line.partition(":") for line in head.decode("utf-8", "replace").split("\r\n")[1:])
    headers = {name.strip(): value.strip() for name, colon, value in lines if colon}
    size = headers.get("Content-Length", "")
    return headers, rest[: int(size)] if size.isascii() and size.isdigit() else rest


def response(page: str, url: str, body: str, date: str = DATE) -> bytes:
    """A response record around a page."""
    payload = body.encode()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode() + payload
    return record(
        [("WARC-Type", "response"), ("WARC-Record-ID", record_id(page, url, hashlib.sha1(payload).hexdigest())), ("WARC-Date", date), ("WARC-Target-URI", url), ("WARC-Payload-Digest", digest(payload)), ("Content-Type", "application/http; msgtype=response")],
        http,
    )


def split_http(block: bytes) -> tuple[int, dict[str, str], bytes]:
    """Status, header fields by lower-case name and body of an HTTP response."""
    head, gap, body = block.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    status = re.match(r"HTTP/\d(?:\.\d)?\s+(\d{3})", lines[0])
    if not status or not gap:
        return 0, {}, block
    fields = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:]) if k}
    return int(status[1]), fields, body


def visible_text(html: str) -> str:
    """The text that a reader sees: no markup, scripts or comments; lines trimmed, empty ones dropped."""
    shown = _TAG.sub("", _BREAK.sub("\n", _HIDDEN.sub(" ", html)))
    lines = (_LINE.sub(" ", line).strip() for line in entities.unescape(shown).replace("\r", "\n").split("\n"))
    return "\n".join(line for line in lines if line)


def derive(source: bytes) -> tuple[dict[str, str], bytes, bytes, str]:
    """The response's headers, its metadata and conversion records and the plain text."""
    headers, block = parse_record(source)
    status, fields, body = split_http(block)
    html = body.decode("utf-8", "replace")
    text = visible_text(html)
    title = _TITLE.search(html)
    lang = _LANG.search(html)
    origin = headers.setdefault("WARC-Record-ID", record_id(hashlib.sha1(source).hexdigest()))
    ids = {kind: record_id(origin, kind) for kind in ("metadata", "conversion")}
    common = [("WARC-Date", headers.get("WARC-Date", DATE)), ("WARC-Target-URI", headers.get("WARC-Target-URI", "")), ("WARC-Refers-To", origin)]
    facts = [
        ("http-status", str(status)),
        ("content-type", fields.get("content-type", "")),
        ("title", " ".join(entities.unescape(_TAG.sub("", title[1])).split()) if title else ""),
        ("language", lang[1].lower() if lang else ""),
        ("links", str(len(_LINK.findall(html)))),
        ("words", str(len(text.split()))),
        ("source-block-digest", headers.get("WARC-Block-Digest", "")),
        ("source-payload-digest", headers.get("WARC-Payload-Digest", "")),
        *((f"source-{k}", v) for k, v in sorted(fields.items())),
    ]
    described = "".join(f"{k}: {' '.join(v.splitlines())}\r\n" for k, v in facts).encode()
    plain = text.encode()
    metadata = record([("WARC-Type", "metadata"), ("WARC-Record-ID", ids["metadata"]), *common, ("WARC-Concurrent-To", ids["conversion"]), ("Content-Type", "application/warc-fields")], described)
    conversion = record(
        [("WARC-Type", "conversion"), ("WARC-Record-ID", ids["conversion"]), *common, ("WARC-Concurrent-To", ids["metadata"]), ("WARC-Source-Payload-Digest", headers.get("WARC-Payload-Digest", "")), ("WARC-Payload-Digest", digest(plain)), ("Content-Type", "text/plain; charset=utf-8")],
        plain,
    )
    return headers, metadata, conversion, text


def responses(pages: DataFrame) -> DataFrame:
    """(page_id, response): a response record for each page of (page_id, url, html)."""
    bounded_batches(pages.sparkSession)

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        rows = zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True)
        made = [response(str(i), url or "", html or "") for i, url, html in rows]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.binary())], ["page_id", "response"])

    return pages.select("page_id", "url", "html").mapInArrow(each_batch(run), "page_id long, response binary")


def derivatives(records: DataFrame) -> DataFrame:
    """For each (page_id, response) both derived records, and what one looks for in them."""
    bounded_batches(records.sparkSession)
    names = ["page_id", "response_id", "metadata", "conversion", "text"]

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        made = [({}, None, None, None) if r is None else derive(r) for r in batch.column(1).to_pylist()]
        columns = [[h.get("WARC-Record-ID") for h, *_ in made], [m for _, m, _, _ in made], [c for _, _, c, _ in made], [t for *_, t in made]]
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.binary(), pa.binary(), pa.string()), strict=True))], names)

    return records.select("page_id", "response").mapInArrow(each_batch(run), "page_id long, response_id string, metadata binary, conversion binary, text string")


def write_warc(derived: DataFrame, path: str) -> None:
    """Writes the records as text files of Spark, one stream of records for each partition."""
    both = F.decode(F.concat("metadata", "conversion"), "UTF-8")
    line = F.substring(both, F.lit(1), F.length(both) - 1)  # the line end that the writer adds is the records' last one
    derived.select(line.alias("value")).write.option("lineSep", "\n").text(path)


def op7_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both records of every page, by their ids, digests and sizes."""
    derived = derivatives(responses(table(spark, sf_dir, "pages")))
    header = lambda name, of: F.regexp_extract(F.decode(F.col(of), "UTF-8"), rf"(?m)^{name}: (.*)$", 1)
    return derived.select(
        "page_id",
        "response_id",
        header("WARC-Record-ID", "metadata").alias("metadata_id"),
        header("WARC-Record-ID", "conversion").alias("conversion_id"),
        header("WARC-Refers-To", "conversion").alias("refers_to"),
        header("WARC-Block-Digest", "metadata").alias("metadata_digest"),
        header("WARC-Payload-Digest", "conversion").alias("text_digest"),
        F.length("metadata").cast("long").alias("metadata_bytes"),
        F.length("conversion").cast("long").alias("conversion_bytes"),
        F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"),
    )
