"""WARC derivatives: metadata and plain-text conversion records linked to their responses.

``records`` reads WARC records from bytes, plain or gzip members, and keeps what it cannot
read countable; ``read_warc`` does so for the files of a folder, one file a row. ``derive``
turns a response record into a metadata record (JSON of the HTTP status, headers, title,
links and digests) and, for text and HTML payloads, a conversion record (the visible text).
Transfer and content encodings (chunked, gzip, deflate) are undone first. Both carry the
response's id in WARC-Refers-To, its target, date and other fields that describe the
capture, and its block and payload digests under WARC-Refers-To-Block-Digest and
WARC-Refers-To-Payload-Digest; block and payload digests of their own come beside them. All
fields of the source, repeated ones too, are listed in the metadata. Ids are name-based
UUIDs, so a rerun after a lost executor gives the same bytes. A row is handled on its own;
there is no shuffle, and time grows in proportion to a record's length.

Defined results: a null page is an empty body; a null address is an empty target; records
other than responses give no derivative; payloads that are neither HTML nor text, or whose
content encoding cannot be undone, give metadata only; a truncated record is counted and
ends its file; repeated rows give equal records; an empty table gives an empty table.
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
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .html_blocks import blocks, tags
from .rows import map_rows

VERSION = "WARC/1.1"
SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # the URL name space of RFC 4122
TITLE = re.compile(r"<title(?=[\s>])[^>]*+>([^<]*+)", re.I)
LINKING = frozenset(("a", "img", "link", "script", "iframe", "form"))
LINK = re.compile(r"(?<![^\s\"'])(?:href|src|action)\s*+=\s*+(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
CARRIED = ("WARC-Target-URI", "WARC-Date", "WARC-IP-Address", "WARC-Warcinfo-ID", "WARC-Identified-Payload-Type")
DIGESTS = ("WARC-Block-Digest", "WARC-Payload-Digest")
HTML_TYPES = ("", "text/html", "application/xhtml+xml")
CHARSET = re.compile(r"charset\s*=\s*[\"']?\s*([\w-]+)", re.I)
BODY = re.compile(rb"<body(?=[\s/>])", re.I)
COPY = 1 << 20


@dataclass
class Record:
    """One record: named fields in their order, and the block."""

    fields: list[tuple[str, str]]
    block: bytes = b""
    version: str = VERSION
    lookup: dict[str, str] = field(init=False)

    def __post_init__(self) -> None:
        self.lookup = {k.lower(): v for k, v in reversed(self.fields)}

    def get(self, name: str) -> str | None:
        return self.lookup.get(name.lower())

    def to_bytes(self) -> bytes:
        head = "".join(f"{k}: {v}\r\n" for k, v in self.fields)
        return f"{self.version}\r\n{head}\r\n".encode() + self.block + b"\r\n\r\n"


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(*parts: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(SPACE, chr(10).join(parts))}>"


def _plain(data: bytes) -> Iterator[bytes]:
    """Plain bytes of concatenated gzip members, one member at a time, or the bytes themselves."""
    if data[:2] != b"\x1f\x8b":
        yield data
        return
    at = 0
    while data[at : at + 2] == b"\x1f\x8b":
        stream, out = zlib.decompressobj(31), []
        try:
            while not stream.eof and at < len(data):
                piece = data[at : at + COPY]
                out.append(stream.decompress(piece))
                at += len(piece) - len(stream.unused_data)
        except zlib.error:
            yield b"".join(out)
            return
        yield b"".join(out)


def records(data: bytes) -> Iterator[Record | None]:
    """The records of a file in order; None at the end stands for one that is broken."""
    buffer = b""
    for more in _plain(data):
        buffer += more
        at = 0
        while (made := _record(buffer, at)) is not None:
            record, at = made
            yield record
        buffer = buffer[at:]
    if buffer.strip(b"\r\n"):
        yield None


def _record(data: bytes, at: int) -> tuple[Record, int] | None:
    """The record that begins at a place and where it ends, if all of it is there."""
    while data[at : at + 2] == b"\r\n":
        at += 2
    end = data.find(b"\r\n\r\n", at)
    lines = data[at:end].decode("utf-8", "replace").split("\r\n") if end >= 0 else []
    if not lines or not lines[0].startswith("WARC/"):
        return None
    fields: list[tuple[str, str]] = []
    for line in lines[1:]:
        if line[:1] in (" ", "\t") and fields:
            fields[-1] = (fields[-1][0], f"{fields[-1][1]} {line.strip()}")
        elif ":" in line:
            name, value = line.split(":", 1)
            fields.append((name.strip(), value.strip()))
    record = Record(fields, version=lines[0].strip())
    length = record.get("Content-Length") or ""
    stop = end + 4 + int(length) if length.isdigit() else len(data) + 1
    if stop > len(data):
        return None
    record.block = data[end + 4 : stop]
    return record, stop


def parse(data: bytes) -> tuple[list[Record], int]:
    """(records, number of broken ones)."""
    found = list(records(data))
    return [r for r in found if r is not None], sum(r is None for r in found)


def response(url: str, body: bytes, date: str, key: str = "") -> Record:
    """A response record of an HTML page."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(body)}\r\n\r\n".encode()
    target = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)
    return Record(
        [
            ("WARC-Type", "response"), ("WARC-Record-ID", record_id("response", target, key, digest(body))), ("WARC-Date", date), ("WARC-Target-URI", target),
            ("WARC-Payload-Digest", digest(body)), ("WARC-Block-Digest", digest(head + body)), ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(head) + len(body))),
        ],
        head + body,
    )


def _http(block: bytes) -> tuple[str, list[tuple[str, str]], bytes]:
    """(status line, headers, body) of an HTTP response."""
    end, gap = block.find(b"\r\n\r\n"), 4
    if end < 0:
        end, gap = len(block), 0
    lines = block[:end].decode("latin-1").split("\r\n")
    return lines[0], [(k.strip(), v.strip()) for k, _, v in (x.partition(":") for x in lines[1:]) if v], block[end + gap :]


def _header(headers: list[tuple[str, str]], name: str) -> str:
    return ", ".join(v for k, v in headers if k.lower() == name)


def _unchunked(body: bytes) -> bytes:
    """The bytes of a chunked body, as far as its chunks are whole; a body without chunks as it is."""
    out, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        size = body[at:end].split(b";")[0].strip() if end >= 0 else b""
        if not re.fullmatch(rb"[0-9A-Fa-f]{1,15}", size):
            return b"".join(out) if out else body
        if int(size, 16) == 0:
            return b"".join(out)
        out.append(body[end + 2 : end + 2 + int(size, 16)])
        at = end + 4 + int(size, 16)


def decoded(headers: list[tuple[str, str]], body: bytes) -> bytes | None:
    """A body without its transfer and content encodings, or None where one cannot be undone."""
    if "chunked" in _header(headers, "transfer-encoding").lower():
        body = _unchunked(body)
    for coding in reversed([c.strip().lower() for c in _header(headers, "content-encoding").split(",") if c.strip()]):
        if coding in ("gzip", "x-gzip") and body[:2] == b"\x1f\x8b":
            body = b"".join(_plain(body))
        elif coding == "deflate":
            for window in (15, -15):
                try:
                    body = zlib.decompressobj(window).decompress(body)
                    break
                except zlib.error:
                    continue
            else:
                return None
        elif coding not in ("identity", "gzip", "x-gzip"):
            return None
    return body


def _text(kind: str, body: bytes) -> str:
    named = CHARSET.search(kind)
    try:
        return body.decode(named[1] if named else _declared(body) or "utf-8", "replace")
    except LookupError:
        return body.decode("utf-8", "replace")


def _declared(body: bytes) -> str | None:
    """The charset that a meta tag of a page's head names; the head ends with the body's tag, however long it is."""
    for m in tags(BODY.split(body, maxsplit=1)[0].decode("latin-1")):
        if m["name"] and m["name"].lower() == "meta" and not m["end"] and (found := CHARSET.search(m["attrs"])):
            return found[1]
    return None


def _links(page: str) -> list[dict[str, str]]:
    """Tag and address of every link of a page, in order."""
    out = []
    for m in tags(page):
        if m["name"] and not m["end"] and m["name"].lower() in LINKING:
            found = LINK.search(m["attrs"])
            if found:
                out.append({"tag": m["name"].lower(), "url": html.unescape(found[1] or found[2] or found[3] or "")})
    return out


def _linked(source: Record, kind: str, content_type: str, block: bytes, payload: bytes) -> Record:
    own = record_id(kind, source.get("WARC-Record-ID") or "", digest(block))
    fields = [("WARC-Type", kind), ("WARC-Record-ID", own), *((k, v) for k in CARRIED if (v := source.get(k)) is not None), ("WARC-Refers-To", source.get("WARC-Record-ID") or "")]
    if source.get("WARC-Target-URI") is not None and source.get("WARC-Date") is not None:
        fields += [("WARC-Refers-To-Target-URI", source.get("WARC-Target-URI") or ""), ("WARC-Refers-To-Date", source.get("WARC-Date") or "")]
    fields += [(k.replace("WARC-", "WARC-Refers-To-"), v) for k in DIGESTS if (v := source.get(k)) is not None]
    fields += [("WARC-Block-Digest", digest(block)), ("WARC-Payload-Digest", digest(payload)), ("Content-Type", content_type), ("Content-Length", str(len(block)))]
    return Record(fields, block)


def derive(source: Record) -> tuple[Record, Record | None] | None:
    """(metadata, conversion) of a response record; the conversion is None where the payload is no text."""
    if (source.get("WARC-Type") or "").lower() != "response":
        return None
    status, headers, body = _http(source.block)
    plain, kind = decoded(headers, body), _header(headers, "content-type")
    media = kind.split(";")[0].strip().lower()
    is_html, is_text = plain is not None and media in HTML_TYPES, plain is not None and media.startswith("text/")
    page = _text(kind, plain) if is_html or is_text else ""
    title = TITLE.search(page) if is_html else None
    text = "\n".join(t for t, _, _ in blocks(page)) if is_html else page
    about = {
        "envelope": {"id": source.get("WARC-Record-ID"), "fields": [list(f) for f in source.fields], "actual_block_digest": digest(source.block), "actual_payload_digest": digest(body)},
        "http": {"status": status, "headers": [list(h) for h in headers], "body_bytes": len(body), "decoded_bytes": None if plain is None else len(plain)},
        "html": {"title": " ".join(html.unescape(title[1]).split()) if title else None, "links": _links(page) if is_html else [], "text_bytes": len(text.encode())},
    }
    block = json.dumps(about, ensure_ascii=False, sort_keys=True, separators=(",", ":")).encode()
    conversion = _linked(source, "conversion", "text/plain; charset=utf-8", text.encode(), text.encode()) if is_html or is_text else None
    return _linked(source, "metadata", "application/json", block, block), conversion


FILES = "path string, at long, broken boolean, record_id string, type string, target string, date string, fields array<struct<name:string,value:string>>, block binary"


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """The records of all WARC files (plain or gzip) under a path, by any file system Spark reads: file, number, fields and block of each.

    broken marks the row, the last of its file, that stands for what could not be read. A file is held whole by its task.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).where(F.lower("path").rlike(r"\.warc(\.gz)?$")).select("path", "content")

    def of(name: str, content: bytes) -> Iterator[tuple]:
        for k, r in enumerate(records(content)):
            if r is None:
                yield name, k, True, None, None, None, None, [], None
            else:
                fields = [{"name": a, "value": b} for a, b in r.fields]
                yield name, k, False, r.get("WARC-Record-ID"), r.get("WARC-Type"), r.get("WARC-Target-URI"), r.get("WARC-Date"), fields, r.block

    return map_rows(files, lambda: of, FILES, 500)


def derive_records(found: DataFrame) -> DataFrame:
    """path, at, refers_to, metadata and conversion (bytes, null where there is none) of the responses in read_warc()'s rows."""

    def of(name: str, at: int, fields: list[dict], block: bytes) -> Iterator[tuple]:
        made = derive(Record([(f["name"], f["value"]) for f in fields], block))
        if made:
            yield name, at, made[0].get("WARC-Refers-To"), made[0].to_bytes(), made[1].to_bytes() if made[1] else None

    return map_rows(found.where("NOT broken").select("path", "at", "fields", "block"), lambda: of, "path string, at long, refers_to string, metadata binary, conversion binary", 500)


OUT = (
    "page_id long, url string, response_id string, metadata_id string, conversion_id string, refers_to string, payload_digest string, digests_hold boolean, n_links long, text_bytes long, "
    "text_digest string, metadata_sha256 string, conversion_sha256 string, warc_bytes long"
)


def derive_pages(pages: DataFrame, date: str = "2024-01-01T00:00:00Z", records: bool = False) -> DataFrame:
    """For every page: its response record is written and read back, and both derivatives are made from what was read.

    With ``records`` the derivatives' bytes are returned too.
    """

    def of(page_id: int | None, url: str | None, page: str | None) -> Iterator[tuple]:
        stored = response(url or "", (page or "").encode(), date, str(page_id)).to_bytes()
        (source,), _ = parse(stored)
        metadata, conversion = derive(source)
        about = json.loads(metadata.block)
        whole = about["envelope"]["actual_block_digest"] == source.get("WARC-Block-Digest") and about["envelope"]["actual_payload_digest"] == source.get("WARC-Payload-Digest")
        m, c = metadata.to_bytes(), conversion.to_bytes()
        row = (
            page_id, url, source.get("WARC-Record-ID"), metadata.get("WARC-Record-ID"), conversion.get("WARC-Record-ID"), conversion.get("WARC-Refers-To"), source.get("WARC-Payload-Digest"), whole,
            len(about["html"]["links"]), len(conversion.block), conversion.get("WARC-Block-Digest"), hashlib.sha256(m).hexdigest(), hashlib.sha256(c).hexdigest(), len(stored) + len(m) + len(c),
        )
        yield (*row, m, c) if records else row

    schema = OUT + (", metadata binary, conversion binary" if records else "")
    return map_rows(pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html"), lambda: of, schema, 2_000)
