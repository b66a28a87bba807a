import base64
import hashlib
import json
from html.parser import HTMLParser

import pytest

from lucerna.llm import queries, warc


def sha(data):
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


PAGES = [(1, "http://a/x?y=1", "<html><title> A &amp; b </title><script>no()</script><p>One <b>two</b></p><a class=q href='/z?a=1&amp;b=2'>go</a><img src=i.png>", "k"), (2, None, None, "k"), (3, "http://b/", "", None), (None, "http://c/", "é" * 100_000, "k"), (1, "http://a/x?y=1", "other", "k")]


@pytest.fixture
def pages(spark):
    return spark.createDataFrame(PAGES, "page_id long, url string, html string, block string")


def test_records(spark, pages):
    got = warc.derivatives(warc.responses(pages), ("page_id",)).collect()
    assert len(got) == 2 * len(PAGES)
    sources = {r.record_id: r for r in warc.responses(pages).collect()}
    for r in got:
        source = sources[r.refers_to]
        payload = bytes(source.block).partition(b"\r\n\r\n")[2]
        assert r.target_uri == source.target_uri and r.warc_date == source.warc_date and r.page_id == source.page_id
        assert r.block_digest == sha(bytes(r.block)) and r.payload_digest in {sha(p.encode()) for _, _, h, _ in PAGES for p in [h or ""]}
        assert r.content_length == len(r.block) and (r.warc_type == "metadata") == (r.content_type == "application/json")
        assert payload is not None
    first = [r for r in got if r.page_id == 1 and b"Links" in r.block and json.loads(bytes(r.block))["HTML"]["Title"]]
    meta = json.loads(bytes(first[0].block))
    assert meta["HTML"]["Title"] == "A & b" and meta["HTML"]["Links"] == [{"path": "a", "url": "/z?a=1&b=2"}, {"path": "img", "url": "i.png"}]
    assert meta["HTTP"]["Status"] == "HTTP/1.1 200 OK" and ["Content-Type", "text/html; charset=utf-8"] in meta["HTTP"]["Headers"]
    assert any(r.warc_type == "conversion" and bytes(r.block).decode() == "A & b\nOne two\ngo" for r in got)


def test_ids_are_repeatable_and_distinct(pages):
    a, b = ([r.record_id for r in warc.derivatives(warc.responses(pages)).collect()] for _ in range(2))
    assert sorted(a) == sorted(b) and len(set(a)) == 8  # a repeated page repeats its ids


def test_files_round_trip(spark, pages, tmp_path):
    records = [r.asDict() for r in warc.derivatives(warc.responses(pages)).collect()]
    data = b"".join(warc.encode(r | {"block": bytes(r["block"])}) for r in records)
    assert list(warc.decode(data)) == [r | {"block": bytes(r["block"])} for r in records]
    (tmp_path / "a.warc").write_bytes(data)
    back = warc.read(spark, str(tmp_path)).collect()
    assert sorted(r.record_id for r in back) == sorted(r["record_id"] for r in records)
    warc.write(warc.derivatives(warc.responses(pages)), str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == len(records)
    with pytest.raises(ValueError):
        list(warc.decode(data[:-40]))
    with pytest.raises(ValueError):
        list(warc.decode(b"junk"))


def test_other_responses():
    latin = {"record_id": "<a>", "target_uri": None, "warc_date": None, "block": b"HTTP/1.0 200 OK\r\nContent-Type: text/html; charset=iso-8859-1\r\n\r\n<p>caf\xe9</p>"}
    assert [bytes(r["block"]) for r in warc.derive(latin)][1].decode() == "café"
    plain = {"record_id": None, "target_uri": None, "warc_date": None, "block": b"no http \xff"}
    assert [r["block"].decode() for r in warc.derive(plain)][1] == "no http �"
    assert len(list(warc.derive(plain | {"block": None}))) == 2


def test_source_headers_and_digests_stay(spark, tmp_path):
    http = b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n5\r\n<p>hi\r\n0\r\n\r\n"
    others = [["WARC-IP-Address", "192.0.2.7"], ["WARC-Concurrent-To", "<urn:a>"], ["WARC-Concurrent-To", "<urn:b>"], ["WARC-Truncated", "length"], ["X-Note", "one two"]]
    named = {"WARC-Type": "response", "WARC-Record-ID": "<urn:r>", "WARC-Target-URI": "http://a/", "WARC-Date": "2024-05-06T07:08:09Z", "WARC-Block-Digest": "md5:B", "WARC-Payload-Digest": "sha256:P", "Content-Type": "application/http; msgtype=response", "Content-Length": len(http)}
    head = "".join(f"{k}: {v}\r\n" for k, v in [*others[:4], *named.items()]) + "X-Note: one\r\n two\r\n"
    data = b"WARC/1.0\r\n" + head.encode() + b"\r\n" + http + b"\r\n\r\n"
    source = list(warc.decode(data))
    assert source[0]["headers"] == others and list(warc.decode(warc.encode(source[0]))) == source
    (tmp_path / "a.warc").write_bytes(data)
    got = warc.derivatives(warc.read(spark, str(tmp_path))).collect()
    assert [r.payload_digest for r in got] == ["sha256:P"] * 2 and all(r.block_digest == sha(bytes(r.block)) for r in got)
    meta = json.loads(bytes(next(r.block for r in got if r.warc_type == "metadata")))
    assert meta["Payload"]["Digest"] == "sha256:P" and meta["Container"]["Headers"] == others
    assert all(meta["Container"][k] == v for k, v in named.items() if k != "WARC-Payload-Digest")
    bare = warc.derivatives(warc.read(spark, str(tmp_path)).drop("block_digest", "payload_digest", "headers")).collect()
    assert {r.payload_digest for r in bare} == {sha(http.partition(b"\r\n\r\n")[2])}
    assert any(json.loads(bytes(r.block))["Container"]["WARC-Block-Digest"] == sha(http) for r in bare if r.warc_type == "metadata")


def test_hostile_markup():
    for page in ("<a " * 60_000, "<title>" * 30_000, "<script>" * 30_000, "<!--" * 50_000, "<" * 100_000, "<a href='" * 30_000):
        list(warc.derive({"record_id": "<a>", "target_uri": None, "warc_date": None, "block": page.encode()}))


def test_empty(spark, pages):
    assert warc.derivatives(warc.responses(pages.limit(0))).count() == 0


class Reader(HTMLParser):
    """An independent reading of a page, by the standard library's parser."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out, self.links, self.title, self.skip, self.inside = [], [], None, None, False

    def handle_starttag(self, tag, attrs):
        if self.skip:
            return
        wanted = {"a": "href", "area": "href", "link": "href", "img": "src", "script": "src", "iframe": "src"}.get(tag)
        for k, v in attrs:
            if k == wanted:
                self.links.append({"path": tag, "url": v or ""})
                break
        if tag in ("script", "style", "noscript", "template"):
            self.skip = tag
            self.out.append(" ")
        self.inside = self.inside or tag == "title"
        if tag in warc.BREAK:
            self.out.append("\n")

    def handle_endtag(self, tag):
        if self.skip:
            self.skip = None if tag == self.skip else self.skip
            return
        if tag == "title":
            self.inside, self.title = False, self.title or ""
        if tag in warc.BREAK:
            self.out.append("\n")

    def handle_data(self, data):
        if not self.skip:
            self.out.append(data)
            if self.inside and self.title is None:
                self.words = getattr(self, "words", "") + data


def test_pages_read_independently(spark):
    """Every record of every page against another parser: text, title, links, digests, references and header fields."""
    pages = {r.page_id: r for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect()}
    got = queries.op3_warc(spark, "/root/testdata/sf0.001").collect()
    assert len(got) == 2 * len(pages)
    for r in got:
        source = pages[r.page_id]
        body = (source.html or "").encode()
        block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(body) + body
        assert r.payload_digest == sha(body) and r.block_digest == sha(r.block.encode()) and r.content_length == len(r.block.encode()) and r.target_uri == source.url
        reader = Reader()
        reader.feed(source.html or "")
        reader.close()
        if r.warc_type == "conversion":
            lines = (" ".join(x.split()) for x in "".join(reader.out).split("\n"))
            assert r.block == "\n".join(x for x in lines if x)
            continue
        meta = json.loads(r.block)
        assert r.block == json.dumps(meta, ensure_ascii=False, sort_keys=True, separators=(",", ":"))
        assert meta["HTML"] == {"Title": " ".join(getattr(reader, "words", "").split()), "Links": reader.links}
        assert meta["Container"]["WARC-Record-ID"] == r.refers_to and meta["Container"]["WARC-Block-Digest"] == sha(block) and meta["Container"]["Content-Length"] == len(block)
        assert meta["Payload"] == {"Digest": sha(body), "Length": len(body)} and meta["HTTP"]["Headers"][1] == ["Content-Length", str(len(body))]


def test_quoted_attributes():
    """A '>' in a quoted attribute ends no tag; comments and scripts hold no links."""
    page = warc.read_page("<p title=\"a > b\">x<a href='/q?a=1>2'>y</a><!-- <a href=z> --><script src=s.js>'<a href=w>'</script><img alt='>' src=i.png>")
    assert page.text == "xy" and [x["url"] for x in page.links] == ["/q?a=1>2", "s.js", "i.png"]
