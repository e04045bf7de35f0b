import hashlib
from html.parser import HTMLParser

from support import SF

from lodestone.llm import warc as w

PAGE = "<!doctype html><html lang='en'><head><title>A &amp; B</title><script>var x = '<p>';</script></head><body><h1>Hi</h1><p>one &lt;two&gt;<br>three <b>four</b></p><!-- no --><a href='/x'>link</a><style>p{}</style></body></html>"


class Plain(HTMLParser):
    def __init__(self):
        super().__init__()
        self.text, self.hidden = [], 0

    def handle_starttag(self, tag, attrs):
        self.hidden += tag in ("script", "style", "template", "noscript", "head")

    def handle_endtag(self, tag):
        self.hidden -= tag in ("script", "style", "template", "noscript", "head")

    def handle_data(self, data):
        if not self.hidden:
            self.text.append(data)


def test_visible_text():
    assert w.visible_text(PAGE) == "Hi\none <two>\nthree four\nlink"
    assert w.visible_text("") == ""
    assert w.visible_text("a < b & c") == "a < b & c"
    assert w.visible_text("<p>open <script>never closed") == "open"


def test_derived_records_point_to_their_source():
    source = w.response("7", "http://x/y", PAGE)
    headers, metadata, conversion, text = w.derive(source)
    m, mb = w.parse_record(metadata)
    c, cb = w.parse_record(conversion)
    assert m["WARC-Refers-To"] == c["WARC-Refers-To"] == headers["WARC-Record-ID"]
    assert (m["WARC-Type"], c["WARC-Type"], c["WARC-Target-URI"]) == ("metadata", "conversion", "http://x/y")
    assert (m["WARC-Concurrent-To"], c["WARC-Concurrent-To"]) == (c["WARC-Record-ID"], m["WARC-Record-ID"])
    assert c["WARC-Block-Digest"] == w.digest(cb) and m["WARC-Block-Digest"] == w.digest(mb) and cb.decode() == text
    fields = dict(line.split(": ", 1) for line in mb.decode().splitlines())
    assert (fields["title"], fields["language"], fields["links"], fields["http-status"]) == ("A & B", "en", "1", "200")
    assert fields["source-payload-digest"] == c["WARC-Source-Payload-Digest"] == w.digest(PAGE.encode())
    assert fields["source-content-type"] == "text/html; charset=utf-8"
    assert w.derive(source) == (headers, metadata, conversion, text)  # building twice gives equal records


def test_broken_responses():
    _, metadata, conversion, text = w.derive(w.record([("WARC-Record-ID", "<urn:x>")], b"no header <b>here</b> \xff"))
    assert text == "no header here �"
    assert b"http-status: 0" in metadata and w.parse_record(conversion)[0]["WARC-Refers-To"] == "<urn:x>"


def test_query_against_an_html_parser(spark):
    pages = {r["page_id"]: r for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    rows = {r["page_id"]: r for r in w.op7_warc_derivatives(spark, SF).collect()}
    assert rows.keys() == pages.keys()
    for i, r in rows.items():
        text = w.visible_text(pages[i]["html"] or "")
        assert r["text_sha256"] == hashlib.sha256(text.encode()).hexdigest() and r["text_digest"] == w.digest(text.encode())
        assert r["refers_to"] == r["response_id"]
        parser = Plain()
        parser.feed(pages[i]["html"] or "")
        assert "".join(text.split()) == "".join("".join(parser.text).split())


def test_odd_pages(spark, tmp_path):
    rows = [(1, None, None, "z"), (2, "http://a\r\nX: 1", "", "z"), (2, "u", "<p>x", "z"), (None, "u", "\x00", "z")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    made = w.derivatives(w.responses(pages)).collect()
    assert len(made) == 4 and all(w.parse_record(bytes(r["conversion"]))[0]["WARC-Refers-To"] == r["response_id"] for r in made)
    assert w.derivatives(w.responses(pages.limit(0))).count() == 0
    w.write_warc(w.derivatives(w.responses(pages)), f"file://{tmp_path}/out")
    whole = b"".join(p.read_bytes() for p in sorted((tmp_path / "out").glob("part-*")))
    assert whole.count(b"WARC/1.1\r\n") == 8


def test_odd_records(spark):
    records = [None, b"", b"WARC/1.1\r\nWARC-Type:response\r\nnonsense\r\n\r\n<p>a b</p>", b"WARC/1.1\r\nContent-Length: x\r\nWARC-Record-ID:<urn:x>\r\n\r\nHTTP/1.1 404 no\r\n\r\nc", b"\xff\xfe"]
    rows = w.derivatives(spark.createDataFrame(list(enumerate(records)), "page_id long, response binary")).collect()
    by = {r["page_id"]: r for r in rows}
    assert by[0]["metadata"] is None and by[0]["response_id"] is None
    assert [by[i]["text"] for i in range(1, 5)] == ["", "a b", "c", ""]
    assert by[3]["response_id"] == "<urn:x>" and b"http-status: 404" in by[3]["metadata"]
    assert len({by[i]["response_id"] for i in range(1, 5)}) == 4
