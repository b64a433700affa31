"""Transport streams and page text: round trips, damage, and layouts with known labels."""

import random
import time

import numpy as np
import pytest

from siftline.llm import html_blocks as h
from siftline.llm import media_ts as m


def test_round_trip_any_size():
    r = random.Random(2)
    for n in [0, 1, 575, 576, 577, 9216, 9217, 100_001, *(r.randrange(60_000) for _ in range(40))]:
        payload = m.pad(r.randbytes(n))
        found = m.parse(m.mux(payload))
        assert len(payload) % 576 == 0 and payload
        assert b"".join(u["data"] for u in found["units"]) == payload
        assert found["continuity_errors"] == found["skipped"] == found["broken"] == 0
        assert found["programs"] == {1: m.PMT_PID} and found["streams"] == {m.DATA_PID: m.PRIVATE_TYPE}
        assert [u["pts"] for u in found["units"]] == [k * m.TICKS for k in range(len(found["units"]))]


def test_damage():
    stream = m.mux(m.pad(random.Random(3).randbytes(5_000)))
    packets = [stream[i : i + 188] for i in range(0, len(stream), 188)]
    assert m.parse(b"".join(packets[:5] + packets[6:]))["continuity_errors"] == 1
    assert m.parse(b"".join(packets[:5] + [packets[4]] + packets[5:]))["repeats"] == 1
    assert m.parse(b"junk" + stream)["skipped"] == 4
    broken = bytes([packets[0][0], packets[0][1] | 0x80]) + packets[0][2:]
    assert m.parse(broken + stream[188:])["programs"] == {}
    assert m.parse(b"")["units"] == [] and m.parse(b"\x47" * 100)["packets"] == 0


def packet(pid, start, cc, body, field=b""):
    """A hand-built packet, padded by its adaptation field."""
    room = 184 - len(body)
    if room or field:
        field = (field or b"\0").ljust(room - 1, b"\xff") if room > 1 else b""
        body = bytes([len(field)]) + field + body if room else body
    return bytes([0x47, (0x40 if start else 0) | pid >> 8, pid & 255, (0x30 if room else 0x10) | cc]) + body


def test_foreign_stream():
    """Two sections that share a packet, a table that is not current, a new version, a clock that differs in a repeat."""
    section = lambda program, pid, kind, version=0, current=1: (lambda h: h + m.crc32_mpeg(h).to_bytes(4, "big"))(bytes([2, 0xB0, 18, program >> 8, program & 255, 0xC0 | version << 1 | current, 0, 0, 0xE1, 0, 0xF0, 0, kind, 0xE0 | pid >> 8, pid & 255, 0xF0, 0]))
    pat = (lambda h: h + m.crc32_mpeg(h).to_bytes(4, "big"))(bytes([0, 0xB0, 17, 0, 1, 0xC1, 0, 0, 0, 1, 0xE0, 0x50, 0, 2, 0xE0, 0x50]))
    a, b = section(1, 0x101, 2), section(2, 0x102, 3)
    late, old = section(2, 0x103, 4, 1, 0), section(2, 0x104, 5, 2)
    out = [packet(0, True, 0, (b"\0" + pat).ljust(184, b"\xff"))]
    out += [packet(0x50, True, 0, b"\0" + a[:10]), packet(0x50, True, 1, bytes([len(a) - 10]) + a[10:] + b[:9]), packet(0x50, False, 2, b[9:] + late)]
    found = m.parse(b"".join(out))
    assert found["programs"] == {1: 0x50, 2: 0x50} and found["streams"] == {0x101: 2, 0x102: 3}
    assert m.parse(b"".join([*out, packet(0x50, True, 3, b"\0" + old)]))["streams"] == {0x101: 2, 0x104: 5}
    pes = b"\0\0\1\xe0\0\0\x80\0\0" + b"x" * 100
    clock = [packet(0x101, True, 0, pes, b"\x10" + bytes([k]) * 6) for k in (1, 2)]
    found = m.parse(b"".join(out + clock))
    assert (found["repeats"], found["continuity_errors"], len(found["units"])) == (1, 0, 1) and found["units"][0]["data"] == b"x" * 100


def test_damaged_units(spark):
    stream = m.mux(m.pad(random.Random(3).randbytes(30_000)))
    packets = [stream[i : i + 188] for i in range(0, len(stream), 188)]
    found = m.parse(b"".join(packets[:60] + packets[61:]))
    assert [u["damaged"] for u in found["units"]] == [False, True, False, False]
    rows = m.stream_units(spark.createDataFrame([(1, bytearray(stream))], "doc_id long, media binary"), "media").collect()
    assert len(rows) == 4 and all(r["random_access"] and not r["damaged"] for r in rows)
    assert m.describe(m.parse(m.mux(m.pad(b"a" * 700)))) != m.describe(m.parse(m.mux(m.pad(b"q" * 700))))
    none = spark.createDataFrame([], "doc_id long, text string, units int")
    assert m.store_texts(none).count() == 0 and m.stream_units(m.write_streams(none), "media").count() == 0


def test_store_texts(spark):
    rows = [(1, "é" * 400, 5), (None, None, 5), (2, "", 5), (3, "é" * 400, 5)]
    out = {r["doc_id"]: r for r in m.store_texts(spark.createDataFrame(rows, "doc_id long, text string, media int")).collect()}
    assert out[1].asDict() | {"doc_id": 0} == out[3].asDict() | {"doc_id": 0}
    assert out[None]["n_bytes"] == 0 and out[2]["payload_bytes"] == 576 and out[1]["n_bytes"] == 800
    parsed = m.parse_streams(m.write_streams(spark.createDataFrame(rows, "doc_id long, text string, x int")), "media", unit_data=False).where("doc_id = 1").first()
    assert parsed["transport"]["continuity_errors"] == 0 and len(parsed["transport"]["units"]) == 1


def test_blocks():
    page = "<html><head><title>t</title><style>p{}</style></head><body><nav><li>one<li><a href=x>two</a></nav><!-- no --><p><b>a &amp; b<br><p>c\n  d</p>e<script>var t='</p>'</script><table><tr><td>f<td>g</table></body>"
    assert [t for t, _, _ in h.blocks(page)] == ["one", "two", "a & b", "c d", "e", "f", "g"]
    assert h.blocks("") == [] and [t for t, _, _ in h.blocks("plain &lt; text")] == ["plain < text"]


def texts(page):
    return [t for t, _, _ in h.blocks(page)]


def test_blocks_of_broken_markup():
    assert texts("<article><p>one<p><svg><path d=1></p><p>two</p></article>") == ["one", "two"]
    assert texts("<p>a<svg><svg>x</svg><text>y</text></svg>b<svg/>c</p>") == ["abc"]
    assert texts("<p>a</p><svg><svg>x</svg><p>b</p>") == ["a", "b"]
    assert texts("<p>so <math><mi>x</mi><mo>+</mo><mn>1</mn></math> holds</p>") == ["so x+1 holds"]
    assert texts('<p class="x>hello</p><p class="y">there</p>') == ["hello", "there"]
    assert texts('<p class="x>hello') == ["hello"] and texts("<p title='a > b'>c") == ["c"] and texts('<p title="a <b> c">d') == ["d"]
    assert texts("<p>a<script>var b<p>c</p>") == ["a", "c"] and texts("<p>a<!-->b<!-- x -->c") == ["abc"]
    assert texts("<select><option>a<option>b</select><p>c<textarea>d</textarea><iframe>e") == ["ce"]


def test_blocks_are_linear():
    """Deep, unclosed and crossed markup of some hundred thousand tags."""
    n = 60_000
    began = time.time()
    assert len(texts("<div>x" * n)) == n
    for page in ('<a "' * n, "<b>" * n + "<div>" * n + "</b>" * n + "</i>" * n, "<i>" * n + "<b>" * n + "</i>" * n, "<h1>a" * n, "<svg>a" * n, "<svg><svg></svg>" * n, "<p title='>x'\">" * n, "<script>a" * n, "<!-- a" * n, "<a '>'>" * n + '<p "'):
        texts(page)
    assert time.time() - began < 60
    label = h.labeller(h.train(40, 1))
    assert len(label(["<div><p>one two</p>" * 30_000])[0]) == 30_000


def test_parts_of_a_long_page_do_not_matter(monkeypatch):
    params = h.train(40, 1)
    pages = [p for p, _ in h.layouts(np.random.default_rng(5), 6)]
    whole = h.labeller(params)(pages)
    monkeypatch.setattr(h, "STEPS", 5)
    for a, b in zip(whole, h.labeller(params)(pages), strict=True):
        assert [t for t, _ in a] == [t for t, _ in b] and np.allclose([q for _, q in a], [q for _, q in b], atol=1e-4)


def test_extract_edges(spark):
    page = "<article><p>One sentence of some words here.</p></article>"
    rows = [(1, "u", page, 9), (1, "u", page, 9), (2, None, None, 9)]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string, n_chars int")
    assert sorted(r["n_chars"] for r in h.extract(frame).collect()) == [0, 32, 32]
    assert h.extract(frame.limit(0)).count() == 0


def test_held_out_layouts_and_extract(spark):
    params = h.train()
    label = h.labeller(params)
    right = total = 0
    for page, labels in h.layouts(np.random.default_rng(99), 60):
        found = label([page])[0]
        assert len(found) == len(labels)
        right += sum((q >= 0.5) == y for (_, q), y in zip(found, labels, strict=True))
        total += len(labels)
    assert right / total > 0.97
    rows = [(1, "u", "<nav><ul><li><a>x</a></li></ul></nav><article><h1>Title here.</h1><p>One two three four five six seven.</p><p>Eight  nine&nbsp;ten eleven twelve.</p></article><footer>&copy; z</footer>"), (2, "u", None), (None, None, "")]
    out = {r["page_id"]: r for r in h.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert out[1]["text"] == "Title here.\n\nOne two three four five six seven.\n\nEight nine ten eleven twelve." and out[1]["n_chars"] == len(out[1]["text"])
    assert (out[2]["text"], out[2]["n_chars"]) == ("", 0) and out[None]["text"] == ""


def test_gradients_by_difference():
    rng = np.random.default_rng(0)
    net = h.Lstm(rng, 5, 3)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    x, mask, y = rng.normal(size=(4, 2, 5)), np.ones((4, 2)), rng.integers(0, 2, (4, 2)).astype(float)
    mask[3, 1] = 0

    def loss():
        q = net.forward(x, mask)
        return -(mask * (y * np.log(q) + (1 - y) * np.log(1 - q))).sum() / mask.sum()

    grads = net.gradients(x, mask, y)
    for name in ("wf", "cb", "v"):
        flat, k = net.p[name].reshape(-1), 2
        flat[k] += 1e-3
        up = loss()
        flat[k] -= 2e-3
        down = loss()
        flat[k] += 1e-3
        assert abs((up - down) / 2e-3 - grads[name].reshape(-1)[k]) < 1e-3


def test_clashing_column_names(spark):
    media = m.write_streams(spark.createDataFrame([(1, "text")], "doc_id long, text string"))
    assert m.stream_units(media, "media").count() >= 1
    for name in ("PID", "transport", "data"):
        with pytest.raises(ValueError, match="already"):
            m.stream_units(media.withColumn(name, media["doc_id"]), "media")
    from siftline.llm import preferences

    turn = "array<struct<role:string,text:string>>"
    pairs = spark.createDataFrame([(1, [("user", "a")], [("user", "b")], "mine")], f"pair_id long, chosen {turn}, rejected {turn}, Prompt string")
    with pytest.raises(ValueError, match="prompt"):
        preferences.format_pairs(pairs)
