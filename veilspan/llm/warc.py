"""WARC derivative builder: from each response record a metadata record and a plain-text conversion record.

Both derivatives refer to the response by WARC-Refers-To, keep its target URI and date, and name each other by
WARC-Concurrent-To. The metadata record is JSON: the source's own WARC headers, its HTTP status line and headers in order,
its digests as stated and as computed, title, meta tags and links. The conversion record holds the page's text: tags
taken out, block elements as line breaks, character references decoded, blanks within lines run together, empty lines left
out. Record ids are name-based, so a task that runs again gives the same records. Digests are SHA-1 in base 32.

Chunked and compressed (gzip, deflate) bodies are undone for the text; digests are those of the bytes as stored. The
character set is that of the HTTP header, else of a meta tag in the first 1,024 bytes, else UTF-8; bytes that
don't fit become U+FFFD. Records that are not responses have no derivatives; a response that can't be read as HTTP has
derivatives with an empty text. A null or empty body gives an empty text and a null URI no target header. Repeated
rows each get their derivatives, with the same ids. Extra columns are ignored. Every record is handled on its own:
there is no shuffle.
"""

from __future__ import annotations

import base64
import hashlib
import html
import json
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VERSION = b"WARC/1.1"
#: The date of records that are made from pages, which have none.
DATE = "2024-01-01T00:00:00Z"

#: Elements that break a line, and those whose content is no text.
BLOCKS = frozenset("address article aside blockquote br dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr li main nav ol option p pre section table tbody td tfoot th thead title tr ul".split())
_HIDDEN = "script|style|template|noscript|title|textarea|svg|iframe"
_TAG = re.compile(rf"<!--.*?(?:-->|\Z)|<({_HIDDEN})\b([^>]*+)>.*?(?:</\1\s*+>|\Z)|<(/?[a-z][^\s/>]*+)((?:[^>\"']|\"[^\"]*+\"|'[^']*+')*+)>|<[!?/a-z][^>]*+(?:>|\Z)", re.S | re.I)
_ATTRIBUTE = re.compile(r"""([a-z][a-z0-9:_-]*+)\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s"'>]++))""", re.I)
_TITLE = re.compile(r"<title\b[^>]*+>(.*?)(?:</title\s*+>|\Z)", re.S | re.I)
_CHARSET = re.compile(rb"""<meta[^>]+charset\s*=\s*["']?\s*([A-Za-z0-9_.:-]+)""", re.I)
_BLANKS = re.compile(r"[ \t\f\v\r ]+")
#: The attribute that holds a link, by element.
_LINKS = {"a": "href", "area": "href", "link": "href", "img": "src", "script": "src", "iframe": "src", "source": "src"}


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(*parts: bytes) -> str:
    """A name-based id."""
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.sha1(b'\0'.join(parts)).digest()[:16], version=5)}>"


def build(headers: list[tuple[str, str]], block: bytes) -> bytes:
    """A record: headers in order, Content-Length last. Line breaks in values become blanks."""
    lines = [VERSION, *(f"{k}: {_one_line(v)}".encode() for k, v in headers), f"Content-Length: {len(block)}".encode()]
    return b"\r\n".join(lines) + b"\r\n\r\n" + block + b"\r\n\r\n"


def _one_line(value: str) -> str:
    return re.sub(r"[\r\n]+", " ", value)


def _header_lines(data: bytes) -> list[tuple[str, str]]:
    found: list[tuple[str, str]] = []
    for line in data.decode("utf-8", "replace").splitlines():
        if line[:1] in " \t" and found:  # a folded line goes on the one before
            found[-1] = (found[-1][0], f"{found[-1][1]} {line.strip()}")
        else:
            name, colon, value = line.partition(":")
            if colon:
                found.append((name.strip(), value.strip()))
    return found


def records(data: bytes) -> Iterator[tuple[list[tuple[str, str]], bytes]]:
    """(headers, block) of each record of a file, plain or compressed record by record."""
    while data[:2] == b"\x1f\x8b":
        part = zlib.decompressobj(31)
        plain = part.decompress(data) + part.flush()
        yield from records(plain)
        data = part.unused_data
    at = 0
    while (at := data.find(b"WARC/", at)) >= 0:
        end = data.find(b"\r\n\r\n", at)
        if end < 0:
            return
        headers = _header_lines(data[at:end].partition(b"\r\n")[2])
        size = next((v for k, v in headers if k.lower() == "content-length"), "0")
        size = int(size) if size.isdigit() else 0
        yield headers, data[end + 4 : end + 4 + size]
        at = end + 4 + size


def response(uri: str | None, body: bytes, name: str, date: str = DATE) -> bytes:
    """A response record of a page."""
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(body)}\r\n\r\n".encode() + body
    headers = [("WARC-Type", "response"), ("WARC-Record-ID", record_id(b"response", name.encode(), (uri or "").encode(), block)), ("WARC-Date", date)]
    headers += [("WARC-Target-URI", uri)] * bool(uri)
    return build([*headers, ("Content-Type", "application/http; msgtype=response"), ("WARC-Payload-Digest", digest(body)), ("WARC-Block-Digest", digest(block))], block)


def _dechunked(data: bytes) -> bytes:
    out, at = [], 0
    while (end := data.find(b"\r\n", at)) >= 0:
        size = data[at:end].split(b";")[0].strip()
        if not re.fullmatch(rb"[0-9A-Fa-f]{1,15}", size) or not int(size, 16):
            break
        out.append(data[end + 2 : end + 2 + int(size, 16)])
        at = end + 4 + int(size, 16)
    return b"".join(out)


def _gunzipped(data: bytes) -> bytes:
    """All members of data; what follows the last, or a member that can't be read, is left out."""
    part = zlib.decompressobj(31)
    out = [part.decompress(data)]
    while (data := part.unused_data)[:2] == b"\x1f\x8b":
        part = zlib.decompressobj(31)
        try:
            out.append(part.decompress(data))
        except zlib.error:
            break
    return b"".join(out)


def http(block: bytes) -> tuple[str, list[tuple[str, str]], bytes, bytes]:
    """(status line, headers, body as stored, body with chunks and compression undone)."""
    head, gap, body = block.partition(b"\r\n\r\n")
    if not head.startswith(b"HTTP/"):
        return "", [], block, b""
    status, _, rest = head.partition(b"\r\n")
    headers = _header_lines(rest)
    has = {k.lower(): v.lower() for k, v in headers}
    plain = _dechunked(body) if "chunked" in has.get("transfer-encoding", "") else body
    coding = has.get("content-encoding", "")
    try:
        if "gzip" in coding:
            plain = _gunzipped(plain)
        elif "deflate" in coding:
            plain = zlib.decompressobj(15 if plain[:1] == b"\x78" else -15).decompress(plain)
    except zlib.error:
        plain = b""
    return status.decode("latin-1"), headers, body, plain


def decoded(body: bytes, content_type: str) -> str:
    found = re.search(r"charset\s*=\s*[\"']?([A-Za-z0-9_.:-]+)", content_type, re.I)
    meta = _CHARSET.search(body[:1024]) if not found else None
    name = found[1] if found else meta[1].decode() if meta else "utf-8"
    try:
        return body.decode(name, "replace")
    except LookupError:
        return body.decode("utf-8", "replace")


def _line(text: str) -> str:
    return _BLANKS.sub(" ", text.replace("\n", " ")).strip()


def page(source: str) -> dict:
    """title, metas, links and text of a page."""
    links: list[dict] = []
    metas: list[dict] = []

    def tag(m: re.Match) -> str:
        name, attributes = (m[1], m[2]) if m[1] else (m[3], m[4])
        if not name:
            return ""
        name = name.lower()
        if name in _LINKS or name == "meta":
            has = {k.lower(): html.unescape(a or b or c) for k, a, b, c in _ATTRIBUTE.findall(attributes)}
            if name == "meta" and has:
                metas.append(has)
            elif url := has.get(_LINKS.get(name, "")):
                links.append({"path": f"{name.upper()}@/{_LINKS[name]}", "url": url})
        return "\n" if name.lstrip("/") in BLOCKS else ""

    title = _TITLE.search(source)
    # line breaks of the source are blanks
    text = html.unescape(_TAG.sub(tag, source.replace("\n", " ")))
    lines = (_line(x) for x in text.split("\n"))
    return {"title": _line(html.unescape(title[1])) if title else "", "metas": metas, "links": links, "text": "\n".join(x for x in lines if x)}


def derive(data: bytes) -> Iterator[dict]:
    """The derivatives of the response records in data."""
    for headers, block in records(data):
        has = {k.lower(): v for k, v in headers}
        if has.get("warc-type", "").lower() != "response":
            continue
        status, fields, body, plain = http(block)
        kind = next((v for k, v in fields if k.lower() == "content-type"), "")
        found = page(decoded(plain, kind)) if status else {"title": "", "metas": [], "links": [], "text": ""}
        source, uri, date = has.get("warc-record-id", ""), has.get("warc-target-uri", ""), has.get("warc-date", DATE)
        ids = {k: record_id(k.encode(), source.encode(), digest(block).encode()) for k in ("metadata", "conversion")}
        envelope = {
            "Envelope": {
                "WARC-Header-Length": sum(len(k.encode()) + len(v.encode()) + 4 for k, v in headers),
                "WARC-Header-Metadata": [[k, v] for k, v in headers],
                "Block-Digest": digest(block),
                "Payload-Digest": digest(body),
                "Payload-Metadata": {"HTTP-Response-Metadata": {"Response-Message": status, "Headers": [[k, v] for k, v in fields], "Entity-Length": len(body), "HTML-Metadata": {"Title": found["title"], "Metas": found["metas"], "Links": found["links"]}}},
            }
        }
        for name, other, content, made in (("metadata", "conversion", "application/json", json.dumps(envelope, ensure_ascii=False).encode("utf-8", "replace")), ("conversion", "metadata", "text/plain", found["text"].encode("utf-8", "replace"))):
            own = [("WARC-Type", name), ("WARC-Record-ID", ids[name]), ("WARC-Refers-To", source), ("WARC-Concurrent-To", ids[other]), ("WARC-Date", date), *([("WARC-Target-URI", uri)] * bool(uri)), ("WARC-Block-Digest", digest(made)), ("Content-Type", content)]
            yield {"warc_type": name, "record_id": ids[name], "refers_to": source, "concurrent_to": ids[other], "target_uri": uri, "source_payload_digest": digest(body), "block_digest": digest(made), "n_links": len(found["links"]), "title": found["title"], "record": build(own, made)}


_FIELDS = pa.schema([("warc_type", pa.string()), ("record_id", pa.string()), ("refers_to", pa.string()), ("concurrent_to", pa.string()), ("target_uri", pa.string()), ("source_payload_digest", pa.string()), ("block_digest", pa.string()), ("n_links", pa.int64()), ("title", pa.string()), ("record", pa.binary())])
_DDL = "warc_type string, record_id string, refers_to string, concurrent_to string, target_uri string, source_payload_digest string, block_digest string, n_links long, title string, record binary"


def responses(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, record): a response record of each page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [response(u, (h or "").encode("utf-8", "replace"), n or "") for n, u, h in zip(*(batch.column(k).to_pylist() for k in (1, 2, 3)), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.binary())], names=["id", "record"])

    chosen = pages.select(F.col(id_col).alias("id"), F.col(id_col).cast("string").alias("name"), F.col(url_col).cast("string").alias("u"), F.col(html_col).cast("string").alias("h"))
    return chosen.mapInArrow(run, f"id {pages.schema[id_col].dataType.simpleString()}, record binary").withColumnRenamed("id", id_col)


def derivatives(records_: DataFrame, id_col: str = "page_id", record_col: str = "record") -> DataFrame:
    """(id, warc_type, record_id, .., record): the derivatives of each row's response records."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 256):
                rows, made = [], []
                for k, data in enumerate(batch.column(1).slice(low, 256).to_pylist(), low):
                    found = list(derive(data or b""))
                    rows += [k] * len(found)
                    made += found
                if made:
                    own = pa.RecordBatch.from_pylist(made, schema=_FIELDS)
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), *own.columns], names=["id", *_FIELDS.names])

    chosen = records_.select(F.col(id_col).alias("id"), F.col(record_col).cast("binary").alias("record"))
    return chosen.mapInArrow(run, f"id {records_.schema[id_col].dataType.simpleString()}, {_DDL}").withColumnRenamed("id", id_col)


def scan(spark: SparkSession, path: str) -> DataFrame:
    """(path, record): WARC files, each a row; derivatives() takes the records out. Files are read whole, up to 2 GB each."""
    return spark.read.format("binaryFile").load(path).select("path", F.col("content").alias("record"))
