"""The registered WARC query returns both derivative records."""

import gzip
import hashlib
import json
import time
import zlib

from siftline.llm import queries
from siftline.llm import warc_derive as w


def test_query_returns_records(spark):
    rows = queries.op3_warc_derive(spark, "/root/testdata/sf0.001").limit(20).collect()
    assert rows
    for r in rows:
        for kind, data, sha, own in (("metadata", r["metadata"], r["metadata_sha256"], r["metadata_id"]), ("conversion", r["conversion"], r["conversion_sha256"], r["conversion_id"])):
            (record,), broken = w.parse(bytes(data))
            assert broken == 0 and record.get("WARC-Type") == kind and record.get("WARC-Record-ID") == own
            assert record.get("WARC-Refers-To") == r["response_id"] and hashlib.sha256(data).hexdigest() == sha


def http(body, *headers, kind="text/html"):
    head = "".join(f"{h}\r\n" for h in (f"Content-Type: {kind}", *headers))
    return f"HTTP/1.1 200 OK\r\n{head}\r\n".encode() + body


def hand_built(block, name, *fields):
    """A record as another writer would lay it out."""
    lines = [f"WARC-Record-ID: <urn:x:{name}>", "WARC-Type: response", "WARC-Target-URI: http://h/é", "WARC-Date: 2020-02-02T00:00:00Z", *fields, f"Content-Length: {len(block)}"]
    return ("WARC/1.0\r\n" + "\r\n".join(lines) + "\r\n\r\n").encode() + block + b"\r\n\r\n"


def test_foreign_files(spark, tmp_path):
    """Chunked, compressed and non-text payloads, repeated and folded fields, source digests, a truncated file."""
    page = "<title>T</title><p>hello <a class=x href='/u'>é</a></p>".encode()
    chunked = b"%x\r\n" % 10 + page[:10] + b"\r\n" + b"%x;x=y\r\n" % (len(page) - 10) + page[10:] + b"\r\n0\r\n\r\n"
    blocks = {
        "plain": http(page), "chunked": http(chunked, "Transfer-Encoding: chunked"), "gzip": http(gzip.compress(page), "Content-Encoding: gzip"), "deflate": http(zlib.compress(page), "content-encoding: deflate"),
        "both": http(b"%x\r\n" % len(gzip.compress(page, mtime=0)) + gzip.compress(page, mtime=0) + b"\r\n0\r\n\r\n", "Transfer-Encoding: chunked", "Content-Encoding: gzip"), "png": http(b"\x89PNG\0", kind="image/png"), "br": http(b"\1\2", "Content-Encoding: br"),
        "text": http("<p>as is".encode("latin-1"), kind="text/plain; charset=latin-1"),
    }
    made = [hand_built(b, n, "WARC-Payload-Digest: sha1:SOURCE", "X-Twice: a", "X-Twice: b", "X-Folded: c", " d") for n, b in blocks.items()]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.warc.gz").write_bytes(b"".join(map(gzip.compress, made[:5])))
    (tmp_path / "in" / "b.warc").write_bytes(b"".join(made[5:]) + made[0][:-20])
    (tmp_path / "in" / "c.txt").write_bytes(made[0])
    found = w.read_warc(spark, str(tmp_path / "in"))
    assert found.where("broken").count() == 1 and found.where("NOT broken").count() == len(blocks)
    out = {}
    for r in w.derive_records(found).collect():
        (metadata,), _ = w.parse(bytes(r["metadata"]))
        conversion = w.parse(bytes(r["conversion"]))[0][0] if r["conversion"] else None
        out[r["refers_to"].split(":")[-1][:-1]] = json.loads(metadata.block), metadata, conversion
    for name in ("plain", "chunked", "gzip", "deflate", "both"):
        about, metadata, conversion = out[name]
        assert conversion.block == "hello é".encode() and about["html"]["title"] == "T" and about["html"]["links"] == [{"tag": "a", "url": "/u"}]
        assert conversion.get("WARC-Refers-To-Payload-Digest") == metadata.get("WARC-Refers-To-Payload-Digest") == "sha1:SOURCE"
        assert [f for f in about["envelope"]["fields"] if f[0].startswith("X-")] == [["X-Twice", "a"], ["X-Twice", "b"], ["X-Folded", "c d"]]
    assert out["png"][2] is out["br"][2] is None and out["text"][2].block == b"<p>as is"


def test_links_are_linear():
    began = time.time()
    for page in ("<a " * 100_000, "<title" * 100_000, "<a href=" * 100_000, "<a x" + " href" * 100_000 + ">"):
        w.derive(w.response("u", page.encode(), "2020-02-02T00:00:00Z"))
    assert time.time() - began < 30
