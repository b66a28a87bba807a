"""WARC derivatives: metadata and plain-text conversion records from response records.

Each response gives two records that name it in WARC-Refers-To and keep its target URI, date and payload digest: `metadata`
with a canonical JSON block of envelope, HTTP headers, title and links, and `conversion` with the page's text. The envelope
holds the response's block digest and all its other WARC headers, as they were.
Record ids are name-based UUIDs of the response's id and the kind, so a retried task makes the same ids.
A response's own digests stay, whatever their algorithm. Digests computed here are SHA-1 in base 32: over a derived record's
block, and where the response has none, over its block and its payload as served.

Defined results: a null block is empty; a response that isn't HTTP has no HTTP headers and its whole block as the
payload; text in another charset than UTF-8 is read by the declared charset, undecodable bytes as U+FFFD; a null
id takes the id of an empty name; repeated rows each give their records; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import html as entities
import json
import re
import uuid
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import short_batches, sliced
from .html import ATTRIBUTE, CUT_OFF, TOKEN

#: Fixed values of the format.
VERSION, CRLF = b"WARC/1.0", b"\r\n"
HEADERS = ("WARC-Type", "WARC-Record-ID", "WARC-Refers-To", "WARC-Target-URI", "WARC-Date", "WARC-Block-Digest", "WARC-Payload-Digest", "Content-Type", "Content-Length")
KNOWN = {h.lower() for h in HEADERS}
#: A record's columns; `headers` holds the headers beyond HEADERS as (name, value), in order, with repeated ones.
FIELDS = "warc_type string, record_id string, refers_to string, target_uri string, warc_date string, content_type string, content_length bigint, block_digest string, payload_digest string, headers array<array<string>>, block binary"
NAMES = [f.split()[0] for f in FIELDS.split(", ")]
KINDS = [{"content_length": pa.int64(), "headers": pa.list_(pa.list_(pa.string())), "block": pa.binary()}.get(n, pa.string()) for n in NAMES]
#: Columns that a response may have beside record_id, target_uri, warc_date and block, and where the envelope names them.
OPTIONAL = {"warc_type": "WARC-Type", "refers_to": "WARC-Refers-To", "content_type": "Content-Type", "block_digest": None, "payload_digest": None, "headers": None}
FOLDED = re.compile(r"\r\n[ \t]+")

#: Elements whose text isn't the page's; elements that end a line; elements that link, by the attribute that does.
UNREAD = frozenset("script style noscript template".split())
BREAK = frozenset("address article aside blockquote body br dd div dl dt fieldset figure footer form h1 h2 h3 h4 h5 h6 head header hr html li main nav ol p pre section table td th title tr ul".split())
LINK = {"a": "href", "area": "href", "link": "href", "img": "src", "script": "src", "iframe": "src"}
CHARSET = re.compile(rb"charset\s*=\s*[\"']?([\w.:-]+)", re.I)


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(name: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, name)}>"


def response_block(html: str | None) -> bytes:
    body = (html or "").encode()
    return b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: " + str(len(body)).encode() + b"\r\n\r\n" + body


class Page(NamedTuple):
    """A page's text, blocks a line each and white space runs one space; the text of its first title; and its links."""

    text: str
    title: str
    links: list[dict[str, str]]


def read_page(page: str) -> Page:
    """Markup read tag by tag, with quoted attributes whole, in time linear in the page."""
    if cut := CUT_OFF.search(page, page.rfind(">") + 1):  # a last tag that never ends is none
        page = page[: cut.start()]
    out: list[str] = []
    links, at, title, begun = [], 0, None, -1
    clean = lambda x: " ".join(entities.unescape(x).split())
    while m := TOKEN.search(page, at):
        out.append(page[at : m.start()])
        at = m.end()
        if not m[2]:
            continue
        name = m[2].lower()
        if name == "title" and title is None:
            if not m[1] and begun < 0:
                begun = len(out)
            elif m[1] and begun >= 0:
                title = clean("".join(out[begun:]))
        if not m[1] and (attribute := LINK.get(name)):
            found = next((v for k, *v in ATTRIBUTE.findall(m[3]) if k.lower() == attribute), None)
            if found is not None:
                links.append({"path": name, "url": entities.unescape("".join(found))})
        if name in UNREAD and not m[1]:
            at = re.compile(rf"</{name}(?=[\s/>])[^>]*>|\Z", re.I).search(page, at).end()
            out.append(" ")
        elif name in BREAK:
            out.append("\n")
    out.append(page[at:])
    return Page("\n".join(x for line in "".join(out).split("\n") if (x := clean(line))), title or "", links)


def http(block: bytes) -> tuple[str, list[tuple[str, str]], bytes]:
    """Status line, headers and payload of a block."""
    if not block.startswith(b"HTTP/"):
        return "", [], block
    head, _, payload = block.partition(b"\r\n\r\n")
    status, *lines = head.decode("latin-1").split("\r\n")
    return status, [(k.strip(), v.strip()) for k, _, v in (x.partition(":") for x in lines) if k.strip()], payload


def decoded(headers: list[tuple[str, str]], payload: bytes) -> str:
    kind = next((v for k, v in headers if k.lower() == "content-type"), "")
    found = CHARSET.search(kind.encode()) or CHARSET.search(payload[:2048])
    try:
        return payload.decode(found[1].decode() if found else "utf-8", "replace")
    except LookupError:
        return payload.decode("utf-8", "replace")


def derive(response: dict) -> Iterator[dict]:
    """The metadata and the conversion record of a response record."""
    block = response["block"] or b""
    status, headers, payload = http(block)
    text = decoded(headers, payload)
    payload_digest = response.get("payload_digest") or digest(payload)
    page = read_page(text)
    envelope = {"WARC-Record-ID": response["record_id"], "WARC-Target-URI": response["target_uri"], "WARC-Date": response["warc_date"], "Content-Length": len(block)}
    envelope |= {"WARC-Block-Digest": response.get("block_digest") or digest(block), "Headers": [list(x) for x in response.get("headers") or ()]}
    envelope |= {name: response[c] for c, name in OPTIONAL.items() if name and response.get(c) is not None}
    meta = {
        "Container": envelope,
        "Payload": {"Length": len(payload), "Digest": payload_digest},
        "HTTP": {"Status": status, "Headers": [list(x) for x in headers]},
        "HTML": {"Title": page.title, "Links": page.links},
    }
    for kind, content_type, data in (
        ("metadata", "application/json", json.dumps(meta, ensure_ascii=False, sort_keys=True, separators=(",", ":")).encode()),
        ("conversion", "text/plain", page.text.encode("utf-8", "replace")),
    ):
        yield {
            "warc_type": kind, "record_id": record_id(f"{response['record_id'] or ''}#{kind}"), "refers_to": response["record_id"], "target_uri": response["target_uri"], "warc_date": response["warc_date"],
            "content_type": content_type, "content_length": len(data), "block_digest": digest(data), "payload_digest": payload_digest, "headers": [], "block": data,
        }


def derivatives(responses: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Two records, as columns of FIELDS, for each response row with record_id, target_uri, warc_date and block and, where
    the frame has them, the columns of OPTIONAL as `read` gives them; `keep`: columns of the response to carry along."""
    short_batches(responses.sparkSession)
    has = {c.lower() for c in responses.columns}
    source = ["block", "record_id", "target_uri", "warc_date", *(c for c in OPTIONAL if c in has)]
    names = list(dict.fromkeys([*source, *keep]))

    def run(batches):
        for b in sliced(batches, 0):
            rows = b.select(source).to_pylist()
            made = [(i, r) for i, row in enumerate(rows) for r in derive(row)]
            at = pa.array([i for i, _ in made], pa.int64())
            yield pa.RecordBatch.from_arrays([*(b.column(c).take(at) for c in keep), *(pa.array([r[n] for _, r in made], k) for n, k in zip(NAMES, KINDS))], [*keep, *NAMES])

    schema = "".join(f"{c} {responses.schema[c].dataType.simpleString()}, " for c in keep) + FIELDS
    return responses.select(*names).mapInArrow(run, schema)


def responses(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Response records of crawled pages: (id, record_id, target_uri, warc_date, block)."""
    short_batches(pages.sparkSession)

    def run(batches):
        for b in sliced(batches, 2):
            ids = [record_id(f"{u or ''}#{i}") for i, u in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
            blocks = [response_block(x) for x in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids), b.column(1), pa.array([date] * len(ids)), pa.array(blocks, pa.binary())], [id_col, "record_id", "target_uri", "warc_date", "block"])

    kind = pages.schema[id_col].dataType.simpleString()
    return pages.select(id_col, url_col, html_col).mapInArrow(run, f"{id_col} {kind}, record_id string, target_uri string, warc_date string, block binary")


# ---- files ----


def encode(record: dict) -> bytes:
    """A record in WARC form. Absent values have no header."""
    values = (record["warc_type"], record["record_id"], record["refers_to"], record["target_uri"], record["warc_date"], record["block_digest"], record["payload_digest"], record["content_type"], str(len(record["block"])))
    pairs = [*zip(HEADERS, values), *(record.get("headers") or ())]
    head = CRLF.join([VERSION, *(f"{k}: {v}".encode() for k, v in pairs if v is not None)])
    return head + CRLF * 2 + record["block"] + CRLF * 2


def decode(data: bytes) -> Iterator[dict]:
    """The records of a WARC file; raises ValueError where one is cut short or doesn't begin as one."""
    at = 0
    while at < len(data):
        if not data.startswith(b"WARC/", at):
            raise ValueError(f"no record at byte {at}")
        end = data.index(CRLF * 2, at)
        fields, others = {}, []
        for k, _, v in (x.partition(":") for x in FOLDED.sub(" ", data[at:end].decode()).split("\r\n")[1:]):
            if (key := k.strip().lower()) in KNOWN and key not in fields:
                fields[key] = v.strip()
            else:
                others.append([k.strip(), v.strip()])
        size, start = int(fields["content-length"]), end + 4
        if start + size > len(data):
            raise ValueError(f"record at byte {at} is cut short")
        get = lambda k: fields.get(k.lower())
        yield {
            "warc_type": get("WARC-Type"), "record_id": get("WARC-Record-ID"), "refers_to": get("WARC-Refers-To"), "target_uri": get("WARC-Target-URI"), "warc_date": get("WARC-Date"),
            "content_type": get("Content-Type"), "content_length": size, "block_digest": get("WARC-Block-Digest"), "payload_digest": get("WARC-Payload-Digest"), "headers": others, "block": data[start : start + size],
        }
        at = start + size + 4


def write(records: DataFrame, path: str) -> None:
    """Records as encoded bytes in Parquet, a file per task, in a folder any executor reaches."""

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([encode(r) for r in b.to_pylist()], pa.binary())], ["record"])

    records.select(*NAMES).mapInArrow(run, "record binary").write.parquet(path)


def read(spark, path: str) -> DataFrame:
    """Records of .warc files under a path that Spark can list; a file is read whole by one task, as are
    crawls' files of about a gigabyte or less."""

    def run(batches):
        for b in batches:
            for data in b.column(0).to_pylist():
                rows = list(decode(data))
                yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], k) for n, k in zip(NAMES, KINDS)], NAMES)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select(F.col("content")).mapInArrow(run, FIELDS)
