"""Single expressions against values known from the language's own library or worked out by hand."""

import html
from urllib.parse import quote, urljoin

import pytest
from pyspark.sql import functions as F

from pagemill.functions import binary, entities, markdown_text as mt, urls
from pagemill.operators import classify, embedded, links, richtext, titles

BASES = ["http://a.com/b/c/d?q=1#f", "https://h.org", "http://x.com:8080/a/"]
REFS = ["", "x", "/x/y", "../z", "./q", "../../../g", "?k=v", "#top", "//o.net/p?x#y", "https://a.com/abc", "mailto:x@y", "a//b", "/a/./b/../c", ".."]


def test_join_url_follows_the_standard(rows):
    df = rows("b string, r string", *[(b, r) for b in BASES for r in REFS])
    for row in df.select("b", "r", urls.join_url(F.col("b"), F.col("r")).alias("j")).collect():
        assert row.j == urljoin(row.b, row.r)


@pytest.mark.parametrize("text", ["a &amp; b &copy; &#65; &#x42;&nope; &amp;copy; & x", "plain", "&eacute;&yuml;&omega;&harr;"])
def test_unescape(value, text):
    assert value(entities.unescape, t=text) == html.unescape(text)


def test_percent_encoding(value):
    text = "a b+c/%d?é=1&x#~*'()!,;:@$"
    assert value(urls.percent_encode, t=text) == quote(text, safe="")
    assert value(lambda t: urls.percent_encode(t, ":/?&=#"), t=text) == quote(text, safe=":/?&=#")


@pytest.mark.parametrize("url, expected", [
    ("http://u:p@Host.com:8080/a?b#c", "http://host.com:8080/a"), ("ftp://x/y?z", "ftp://x/y?z"), ("/rel?q", "/rel?q"), ("", ""),
    ("http://x.com:99999/a?q", "http://x.com:99999/a?q"), ("HTTP://X.com/A?b", "http://x.com/A")])
def test_redact(value, url, expected):
    assert value(urls.redact, u=url) == expected
    assert value(lambda u: urls.redact(urls.redact(u)), u=url) == expected


@pytest.mark.parametrize("title, stem", [("CON", "_CON"), ("con.txt", "_con.txt"), ("a / b", "a-b"), ("  ", "untitled"), ("标题 1", "标题-1")])
def test_file_stem(value, title, stem):
    assert value(urls.file_stem, t=title) == stem


def test_segments_rebuild_and_protect_fences(value):
    md = "# T\n\n\n\n\nx\n```py\n# c\n\n\n\n\n[a](b)\n```\n## H\n~~~\n# in\n```\n~~~\nend"
    assert "".join(value(mt.segments, t=md)) == md
    assert value(lambda t: mt.demote_headings(t, 2), t=md) == md.replace("# T", "### T").replace("## H", "#### H")
    assert value(mt.squeeze_blank_lines, t=md) == md.replace("# T\n\n\n\n\n", "# T\n\n\n")


def test_long_link_lists_do_not_overflow(value):
    md = "### Nav\n" + "".join(f"- [l{i}](http://x/{i})\n" for i in range(60_000)) + "text\n"
    found = value(lambda t: mt.drop_anchor_lists(t, 20), t=md)
    assert (found.md, found.lists, found.lines) == ("text\n", 1, 60_001)


def test_following_headings_survive_list_removal(value):
    md = "".join(f"- [l{i}](u{i})\n" for i in range(21)) + "## A\n### B\ntext\n\n---\n"
    assert value(lambda t: mt.drop_anchor_lists(t, 20), t=md).md == "## A\n### B\ntext\n\n---\n"


def test_duplicate_title(value):
    run = lambda m, t: mt.drop_duplicate_title(m, t)
    assert value(run, m="# My Title!\n\n\nbody", t="my  title") == "body\n"
    assert value(run, m="##\n\nbody", t="x") == "body\n"
    assert value(run, m="# Other\nbody", t="x") == "# Other\nbody\n"


def test_title_with_challenge_word_is_no_challenge(value):
    page = "<title>Weekly Challenge 314</title><body>" + "long text " * 60 + "</body>"
    assert value(classify.challenge, h=page).confidence == "none"
    assert value(classify.challenge, h="<title>Just a moment...</title>").confidence == "high"


def test_images_skip_placeholders_and_icons(value):
    page = '<img src="data:x" data-src="/a.png"><img src="/favicon.ico"><picture><source srcset="/s.webp 2x"><img src="/t.png"></picture><!--<img src="no">-->'
    assert value(lambda h: links.page_images(h, F.lit("http://h.org/p")), h=page) == ["http://h.org/a.png", "http://h.org/s.webp"]


def test_links_keep_first_of_each_target(value):
    page = '<a href="/a#1">one</a><a href="/a#2">two</a><a href="#x">no</a><a href="http://o.org/">far</a><a href="/b"><img></a>'
    found = value(lambda h: links.page_links(h, F.lit("http://h.org/p")), h=page)
    assert [(x.url, x.text) for x in found] == [("http://h.org/a#1", "one"), ("http://h.org/b", "http://h.org/b")]


def test_svg_needs_no_html_around(rows):
    df = rows("b binary", (bytearray(b"<svg></svg>"),), (bytearray(b"<svg></svg><html><body></body></html>"),), (bytearray(b"\xff\xd8\xff"),))
    assert [r.e for r in df.select(binary.extension_from_bytes(F.col("b")).alias("e")).collect()] == [".svg", None, ".jpg"]


def test_multibyte_charset(spark, rows):
    raw = '<meta charset="sjis">日本'.encode("shift_jis")
    spark.conf.set("spark.sql.legacy.javaCharsets", "true")
    try:
        got = rows("b binary", (bytearray(raw),)).select(binary.decode_page(F.col("b"), ["Shift_JIS"]).alias("t")).first().t
    finally:
        spark.conf.unset("spark.sql.legacy.javaCharsets")
    assert got == '<meta charset="sjis">日本'


def test_inline_cleaning(value):
    assert value(richtext.clean_inline, t="<b onclick=x()>a</b><script>y</script><a href=' javascript:z'>l</a>".replace("' javascript:z'", '" javascript:z"')) == '<b>a</b>y<a href="">l</a>'


def test_main_section_falls_back(value):
    assert value(titles.main_html, h="<article>a</article><article>bb</article>") == "bb"
    assert value(titles.main_html, h="<body>x") == "<body>x"


def test_async_article_without_title(value):
    assert value(embedded.async_fields, h="<script>window.cgiDataNew={content: JsDecode('x')}</script>") is None


def test_character_references_as_the_standard_library(spark):
    from html.entities import html5
    texts = [f"a&{n}b" for n in html5] + [f"&{n.rstrip(';')} x&{n.rstrip(';')}" for n in html5] + [f"&#{n};&#x{n:x};&#{n}" for n in (*range(0, 260), 0xD7FF, 0xD800, 0xFDD0, 0xFFFE, 0x10FFFF, 0x110000)]
    texts += ["&", "&&", "&;", "&#;", "&#x;", "&#xg", "&amp&lt", "&copy 2024", "&notit; &notin; &notinx", "&#00000000000000065;", "&#x0000000000041;", "&#99999999999999999999;", "&amp;lt;", "x", "", "&é;&" + "a" * 50 + ";"]
    got = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", entities.unescape(F.col("t")).alias("u")).collect()
    assert [(texts[r.i], r.u) for r in sorted(got)] == [(t, html.unescape(t)) for t in texts]


def test_joined_urls_as_the_standard_library(spark):
    bases = ["http://h/a/b", "http://h/a//b/", "https://h.org", "http://h/a/b?q#f"]
    refs = ["/r//s", "//x.org//y", "r//s", "../r//s", "/r/../s//t/.", "./", "..", "?k", "#f", "/a/./b//", "c//../d"]
    pairs = [(b, r) for b in bases for r in refs]
    got = spark.createDataFrame(pairs, "b string, r string").select("b", "r", urls.join_url(F.col("b"), F.col("r")).alias("u")).collect()
    assert {(x.b, x.r): x.u for x in got} == {(b, r): urljoin(b, r) for b, r in pairs}
