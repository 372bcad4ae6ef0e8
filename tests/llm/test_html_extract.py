"""Main text of the given pages exactly, differencing on pages without an article element, and odd markup."""

import html
import re

from pagemill.llm.html_extract import blocks, common_lines, extract
from pagemill.llm.queries import op4_html_extraction
from tests.conftest import SF_DIR


def article_of(page):
    inner = re.search(r"<article>(.*)</article>", page, re.S)[1]
    parts = [" ".join(html.unescape(re.sub(r"<[^>]*>", " ", re.sub(r"</?b>", "", p))).split()) for p in re.split(r"</?(?:p|h1)>", inner)]
    return "\n\n".join(p for p in parts if p)


def test_given_pages(spark):
    pages = {r.page_id: r for r in spark.read.parquet(f"{SF_DIR}/pages.parquet").collect()}
    got = op4_html_extraction(spark, SF_DIR).collect()
    assert len(got) == len(pages)
    for r in got:
        assert (r.url, r.text, r.n_chars) == (pages[r.page_id].url, article_of(pages[r.page_id].html), len(r.text))


def test_longest_common_lines():
    assert common_lines([1, 2, 3, 4, 5, 2], [9, 2, 4, 3, 5, 7, 2]) in ([1, 2, 4, 5], [1, 3, 4, 5])
    assert common_lines([], [1]) == [] and common_lines([1, 1, 1], [1, 1]) in ([0, 1], [1, 2], [0, 2])


def test_differencing_without_an_article(spark):
    def page(k):
        body = "".join(f"<p>Own text {k} line {j}, which goes on for a while.</p>" for j in range(4))
        return f"<html><body><div>Site name</div><div>Home | About</div>{body}<div>All rights reserved.</div></body></html>"
    rows = [(k, f"https://h.org/a/{k:03d}?x=1", page(k)) for k in range(40)] + [(100, "https://other.org/", page(0)), (101, None, page(1)), (None, "https://h.org/a/001", None), (102, "https://h.org/a/b", "")]
    rows += [(200, "http://copy.org/1", page(7)), (201, "http://copy.org/2", page(7))]
    df = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, key string").repartition(5)
    got = {r.page_id: r.text for r in extract(df).collect()}
    own = lambda k: "\n\n".join(f"Own text {k} line {j}, which goes on for a while." for j in range(4))
    whole = lambda k: f"Site name\n\nHome | About\n\n{own(k)}\n\nAll rights reserved."
    near = [k for k in range(40) if got[k] != own(k)]
    assert all(got[k] == whole(k) for k in near) and len(near) <= 3  # those nearest to the empty pages
    assert (got[100], got[101], got[None], got[102]) == (whole(0), whole(1), "", "")
    assert got[200] == got[201] == whole(7)
    assert extract(df.limit(0)).count() == 0


def test_zones_and_broken_markup():
    assert blocks("<nav>menu<article><h1>T &amp; t</h1><p>one <b>two<br>three</p><p>four<aside>x</aside><div class='reader-comments'>no<p>no</div><form>f</form></article><footer>f") == [
        (1, "T & t"), (1, "one two three"), (1, "four")]
    assert blocks("<div class='layout no-sidebar'><p>a<p>b</div><div class='ad'>c</div><div id=cookie-notice><p>d</p></div><header>e</header>f < g &lt;h") == [(0, "a"), (0, "b"), (0, "f < g <h")]
    assert blocks("<main><header><h1>kept</h1></header><article class='comment'>no</article><li>x<li>y<ul><li>z</ul></main>") == [(1, "kept"), (1, "x"), (1, "y"), (1, "z")]
    assert blocks("<p>a<script>var t='</p>';</script> b<!-- c --><style>d</style>") == [(0, "a b")]
    assert blocks("") == [] and blocks("<" * 50 + "x")[0][1].endswith("x") and blocks("<p>unclosed <b") != []


def test_pages_with_an_article_are_differenced(spark):
    """Template that all neighbours repeat at the edges of their articles goes; passages that some or many articles share stay."""
    own = lambda k: [f"Own text {k} line {j}, which goes on for a while." for j in range(4)]
    inner = lambda k: [*own(k)[:2], *(["A passage in every article."]), *own(k)[2:], *(["Shared by some."] if k % 3 else [])]

    def page(lines):
        return "<html><body><div>Site</div><article><p>By our staff</p>" + "".join(f"<p>{x}</p>" for x in lines) + "<p>Share this text</p></article><div>Rights</div></body></html>"
    rows = [(k, f"https://h.org/a/{k:03d}", page(inner(k))) for k in range(40)]
    rows += [(100 + k, f"https://h.org/a/020/{k}", page(inner(20))) for k in range(12)]  # copies
    rows += [(200 + k, f"https://small.org/{k}", page(inner(k))) for k in range(5)]  # too few to tell
    rows += [(300 + k, f"https://same.org/{k:02d}", page([*own(0), *own(1), f"Edit {k}"])) for k in range(30)]  # near copies of one article
    got = {r.page_id: r.text for r in extract(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)).collect()}
    assert all(got[k] == "\n\n".join(inner(k)) for k in range(40))
    assert all(got[100 + k] == got[20] for k in range(12))
    assert all(got[200 + k] == "\n\n".join(["By our staff", *inner(k), "Share this text"]) for k in range(5))
    assert all(got[300 + k] == "\n\n".join(["By our staff", *own(0), *own(1), f"Edit {k}", "Share this text"]) for k in range(30))


def test_next_different_page(spark):
    """Empty pages and copies are gone past, also across the blocks of a host."""
    body = lambda k: "".join(f"<p>Own text {k} line {j}, which goes on for a while.</p>" for j in range(4))
    rows = [(k, f"https://h.org/{k:05d}", f"<div>Site name</div>{body(k)}") for k in range(2_100)]
    rows += [(10_000 + k, f"https://h.org/{k:05d}/b", "") for k in range(2_100)] + [(20_000 + k, f"https://h.org/{k:05d}/c", f"<div>Site name</div>{body(k)}<p>z</p>") for k in range(0, 2_100, 100)]
    got = {r.page_id: r.text for r in extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert [k for k, t in got.items() if "Site name" in t] == [] and got[10_005] == ""
    assert got[999] == "\n\n".join(f"Own text 999 line {j}, which goes on for a while." for j in range(4))
