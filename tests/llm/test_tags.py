"""Tags whose quotes are not closed, in any number, and charsets anywhere in a page's head."""

import time

import pytest

from siftline.llm import html_blocks, warc_derive


@pytest.mark.parametrize("n", [0, 49, 50, 5_000])
def test_broken_tags_change_nothing_about_others(n):
    page = "<p title='open>broken</p>\n" * n + '<p title="a > b">kept text</p>' + '<p title="x>also broken</p>'
    texts = [t for t, _, _ in html_blocks.blocks(page)]
    assert texts == ["broken"] * n + ["kept text", "also broken"]


def test_ends_of_tags():
    found = [(t["name"], bool(t["end"]), t["attrs"], page[t.end() :]) for page in ('<a b="c>d">e', "<a b='c>d=' e='f'>g", '<a b="c', "<A/>", "</a x>y") for t in html_blocks.tags(page)]
    assert found == [("a", False, ' b="c>d"', "e"), ("a", False, " b='c", "d=' e='f'>g"), ("a", False, ' b="c', ""), ("A", False, "/", ""), ("a", True, " x", "y")]
    assert [t["cdata"] for t in html_blocks.tags("<![CDATA[<p>]]><!-- <p> --><p>")] == ["<p>", None, None]


@pytest.mark.parametrize("bad", ['<p a="> <p b=">x" ', '<p title="a > b" c=\'', '<a x=">', "<!-", "<a '"])
def test_broken_pages_take_linear_time(bad):
    began = time.time()
    assert sum(1 for _ in html_blocks.tags(bad * 100_000 + '"')) >= 0
    assert time.time() - began < 10


def test_charset_anywhere_in_the_head():
    word = "café".encode("latin-1")
    for head in (b"", b" " * 5_000, b"<script>" + b"x" * 3_000 + b"</script>", b"<!-- <meta charset=utf-8> -->"):
        for meta in (b"<meta charset=latin-1>", b'<meta name="' + b"y" * 400 + b'" content="text/html; charset=iso-8859-1">'):
            assert "café" in warc_derive._text("text/html", b"<head>" + head + meta + b"</head><body>" + word)
    assert "caf�" in warc_derive._text("text/html", b"<body><meta charset=latin-1>" + word)
    assert "café" in warc_derive._text("text/html; charset=latin-1", word) and "caf�" in warc_derive._text("text/html; charset=no-such", word)
