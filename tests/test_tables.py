"""Table operators: regions, conversion, rich text, lookups and numbering on small fixtures."""

import tempfile

from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from pagemill.operators import blocks, embedded, links, markdown, regions, rewrite, richtext, sequence, site, tokens as tk
from pagemill.plans.page_job import PageOptions, page_results

HTML = [
    "<nav>a<br></nav><p>x</p>", "<div class='ad'><div>in</div></div>tail", "<div class=ad>never closed <p>y", "</p></p><nav></nav>b</nav>c",
    "<p class='x ad y'>p</p><img class=ad>z", "<nav><nav>inner</nav></nav>!", "<aside id=a>q</aside><script>var t='<nav>';</script>",
]


def brute_strip(page, names, cls):
    """The counting rule, one token at a time."""
    import re
    out, depth, hits = [], 0, 0
    for tok in re.findall(r"(?is)<!--.*?-->|<script\b.*?</script\s*>|<[a-z/!][^>]*>|[^<]+|<", page):
        tag = re.match(r"</?([a-z]+)", tok)
        void = bool(tag) and tag.group(1) in tk.VOID_STRIP
        if depth:
            if tok.startswith("</"):
                depth -= 1
            elif tag and not void and not tok.startswith("<script"):
                depth += 1
            continue
        classes = (re.search(r"class=['\"]?([^'\">]*)", tok) or [None, ""])[1].split()
        if tag and not tok.startswith("</") and (tag.group(1) in names or cls in classes):
            hits += 1
            depth = 0 if void else 1
            continue
        out.append(tok)
    return re.sub(r"[\"']", "", "".join(out)), hits


def check_strip(spark, htmls):
    df = spark.createDataFrame(list(enumerate(htmls)), "page_id long, html string")
    got = {r.page_id: (r.html.replace('"', "").replace("'", ""), r.elements_removed) for r in regions.strip_elements(df, ["nav", ".ad"]).collect()}
    assert got == {i: brute_strip(h, {"nav"}, "ad") for i, h in enumerate(htmls)}


def test_strip_matches_the_counting_rule(spark):
    check_strip(spark, HTML)


@settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.lists(st.sampled_from(["<nav>", "</nav>", "<p>", "</p>", "<br>", "<div class=ad>", "</div>", "x", "y z"]), min_size=1, max_size=25), min_size=20, max_size=20))
def test_strip_matches_the_counting_rule_on_random_pages(spark, pages):
    check_strip(spark, ["".join(p) for p in pages])


def test_tokens_rebuild_pages(pages):
    back = tk.join_tokens(tk.tokens(pages)).withColumnRenamed("html", "again")
    assert back.join(pages, "page_id").where("again <> html").count() == 0


def test_target_stops_at_its_end(rows):
    df = rows("page_id long, html string", (1, '<div id="c"><div>a<br></div><img>b</div><footer>no</footer>'), (2, '<img id="c"><p>no</p>'), (3, "<p>none</p>"))
    got = {r.page_id: r.html for r in regions.target_sections(df, [("id", "c")]).collect()}
    assert got == {1: '<div id="c"><div>a<br></div><img>b</div>', 2: '<img id="c">'}


def md(rows, *htmls, **options):
    df = rows("page_id long, html string, url string", *[(i, h, "http://h.com/d/p") for i, h in enumerate(htmls)])
    return [r.md for r in markdown.html_to_markdown(df, **options).orderBy("page_id").collect()]


def test_conversion(rows):
    got = md(
        rows,
        "<h1>T &amp; x</h1><p>Hello <b>bold</b>, <i>it</i>.</p><ul><li>one</li><li>two<ol start=5><li>a</li><li>b</li></ol></li></ul><p>after</p>",
        "<table><tr><th>A|B</th><th>C</th></tr><tr><td>1<br>2 <a href='/q'>l</a></td></tr><tr><td></td></tr></table>",
        "<p>中文<b>粗</b>字</p><pre><code class='language-py'># c\nx &lt; 1\n</code></pre><p>a <code>b`c</code></p>",
        "<p><a href='/p'><img src='/i.png' alt='[A]'></a> <a href='java\tscript:x'>bad</a></p><h2></h2><blockquote>q</blockquote><hr>",
        "<table><tr><td>out<table><tr><td>in</td></tr></table></td></tr></table><p>z</p>",
        "<p>open <b>never<p>next<br/>line", "")
    assert got == [
        "# T & x\n\nHello **bold**, *it*.\n\n- one\n- two\n  5. a\n  6. b\n\n\nafter\n",
        "| A\\|B | C |\n| --- | --- |\n| 1<br>2 [l](http://h.com/q) |  |\n",
        "中文**粗**字\n\n```py\n# c\nx < 1\n```\n\na `b\\`c`\n",
        "![A](http://h.com/i.png)bad\n\n> q\n\n---\n",
        "| out |\n| --- |\n\nz\n",
        "open **never\n\nnext\nline\n"]


def test_conversion_carries_page_columns(rows):
    df = rows("page_id long, html string, url string, tag string", (1, "<!-- c --><p>a</p>", "http://h/", "x"), (2, None, "http://h/", "y"))
    got = {r.page_id: (r.md, r.tag) for r in markdown.html_to_markdown(df, carry=["tag"]).collect()}
    assert got == {1: ("a\n", "x"), 2: ("\n", "y")}


def test_row_numbers_agree_with_a_window_when_a_key_is_hot(spark):
    df = spark.range(5000).select((F.col("id") * 3).alias("ord"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 50)).alias("k"))
    got = sequence.row_numbers(df, ["k"], ["ord"], "n")
    want = df.selectExpr("ord", "row_number() OVER (PARTITION BY k ORDER BY ord) AS want")
    assert got.join(want, "ord").where("n <> want").count() == 0 and got.count() == 5000


def test_lookup_serves_hot_and_missing_keys(spark):
    left = spark.range(6000).select("id", F.when(F.col("id") % 3 == 0, "home").when(F.col("id") % 3 == 1, F.concat(F.lit("u"), "id")).alias("url"))
    right = spark.range(3000).select(F.concat(F.lit("u"), "id").alias("url"), F.col("id").cast("string").alias("v")).unionByName(
        spark.createDataFrame([("home", "H")], "url string, v string"))
    got = sequence.lookup(left, right, "url", "v")
    assert got.count() == 6000 and got.where("v = 'H'").count() == 2000
    assert got.where("id % 3 = 1 AND id < 3000 AND v = cast(id AS string)").count() == 1000
    assert got.where("id % 3 = 2 AND v IS NOT NULL").count() == 0


def test_internal_links_try_candidates_in_order(rows):
    docs = rows("page_id long, md string", (1, "[a](http://h/x%20y) [b](http://h/p?q=1#f) ![i](http://h/p) [c](http://o/)\n```\n[d](http://h/p)\n```\n"))
    known = rows("url string, anchor string", ("http://h/x y", "s1"), ("http://h/p", "s2"))
    got = rewrite.internal_links(docs, known).first()
    assert (got.md, got.rewritten) == ("[a](#s1) [b](#s2) ![i](http://h/p) [c](http://o/)\n```\n[d](http://h/p)\n```\n", 2)


def results(rows, *titles):
    return rows("site string, ord long, url string, title string, md string, success boolean, error string",
                *[("s", i, f"http://s/{i}", t, "# H\ntext", t != "bad", None if t != "bad" else "boom") for i, t in enumerate(titles)])


def test_anchors_and_file_names(rows):
    r = results(rows, "A", "bad", "A", "a!", "A_1", "CON")
    assert [x.anchor for x in site.with_anchors(r).orderBy("ord").collect()] == ["a", None, "a-2", "a-3", "a_1", "con"]
    assert [x.file_name for x in site.file_names(r).orderBy("ord").collect()] == ["A.md", "A_1.md", "a.md", "A_1_1.md", "_CON.md"]


def test_merged_document_reads_in_order(rows):
    r = results(rows, "One [x]", "bad")
    text = "\n".join(x.text for x in site.merged_sections(r, "2026-01-01 00:00:00").orderBy("part", "ord").collect())
    assert "pages: 1" in text and "1. [One \\[x\\]](#one-x)" in text and '<h2 id="one-x">One [x]</h2>' in text and "### H" in text
    assert text.index("2. ~~bad~~") < text.index("<h2 id=") < text.index("> ⚠️ 获取失败：boom")


def test_write_documents_keeps_order(spark, rows):
    r = results(rows, *[f"T{i}" for i in range(30)])
    out = tempfile.mkdtemp(prefix="run-", dir="/tmp") + "/docs"
    sections = site.merged_sections(r, "2026-01-01 00:00:00", rewrite_links=False)
    site.write_documents(sections, out, files=4)
    import pathlib
    parts = sorted(pathlib.Path(out, "site=s").glob("part-*"))
    joined = "".join(p.read_text() for p in parts)
    assert joined == "".join(x.text + "\n" for x in sections.orderBy("part", "ord").collect())


def test_missing_children_and_nested_blocks(rows):
    b = rows("block_id string, type string, properties string, format string, content array<string>",
             ("p", "page", '{"title":[["P"]]}', None, ["l1", "l2", "q"]), ("l1", "numbered_list", '{"title":[["one"]]}', None, ["l3"]),
             ("l3", "to_do", '{"title":[["do"]],"checked":[["Yes"]]}', None, []), ("l2", "numbered_list", '{"title":[["two",[["b"]]]]}', None, []),
             ("q", "toggle", '{"title":[["t"]]}', None, ["c", "gone"]), ("c", "code", '{"title":[["<x>"]],"language":[["SQL"]]}', None, []))
    roots = rows("page_id string, block_id string", ("1", "p"))
    assert blocks.to_html(b, roots).first().html == (
        "<ol>\n<li>one<p>☑ do</p>\n</li>\n<li>two</li>\n".replace("<li>two", "<li><b>two</b>") + "</ol>\n"
        '<details><summary>t</summary>\n<pre><code class="language-sql">&lt;x&gt;</code></pre>\n</details>\n')
    assert [r.block_id for r in blocks.missing(blocks.tree(b, roots), b).collect()] == ["gone"]


def test_json_slice_ignores_braces_in_strings(rows):
    df = rows("id long, text string", (1, '{"a":"}{\\"","b":{"c":1}} tail }'), (2, "no"), (3, '{"open":1'))
    assert [(r.id, r.slice) for r in embedded.json_slices(df).collect()] == [(1, '{"a":"}{\\"","b":{"c":1}}')]


def test_delta_tail_without_newline(rows):
    ops = rows("doc_id long, seq long, insert string, attributes string", (1, 0, "a\nb", None), (1, 1, "\n", '{"list":"bullet"}'), (1, 2, "T", '{"header":"x"}'))
    assert richtext.delta_to_html(ops).first().html == "<p>a</p>\n<ul>\n<li>b</li>\n</ul>\n<h2>T</h2>\n"


def test_crawl_list_keeps_listed_copies(rows):
    listed = rows("ord long, url string, title string", (0, "http://h/a", None), (1, "http://h/a#x", "t"))
    crawled = rows("page_id long, ord long, url string, text string", (1, 0, "http://h/a#q", "no"), (2, 0, "http://h/b#1", "late"), (1, 1, "http://h/b", "first"))
    got = links.crawl_list(listed, crawled).orderBy("source", "page_id", "ord").collect()
    assert [(r.source, r.url, r.title) for r in got] == [(0, "http://h/a", None), (0, "http://h/a#x", "t"), (1, "http://h/b", "first")]


def test_page_job_paths(rows):
    doc = '{"type":"doc","content":[{"type":"paragraph","content":[{"type":"text","text":"' + "words " * 20 + '"}]}]}'
    df = rows("page_id long, url string, html string",
              (1, "http://h/1", "<title>Just a moment</title>"),
              (2, "http://h/2", '<script id="__NEXT_DATA__">{"props":{"pageProps":{"fallback":{"article/detail":{"articleInfo":{"title":"N","content":' + doc + "}}}}}}</script>"),
              (3, "http://h/3", 'window<script>window._ROUTER_DATA = {"loaderData":{"p":{"curDoc":{"Title":"R","MDContent":"# R\\n' + "text " * 20 + '![i](/a.png)"}}}}</script>'),
              (4, "https://mp.weixin.qq.com/s", '<h1 class="rich_media_title">W</h1><div class="rich_media_content"><p>body text</p></div><p>Share</p>'),
              (5, "https://mp.weixin.qq.com/t", "<script>window.cgiDataNew={is_async:'1',title: JsDecode('A'), nick_name: JsDecode('me'), content: JsDecode('x\\x0ay')}</script>"),
              (6, "http://h/6", '<meta name="generator" content="Docusaurus"><nav>menu</nav><div class="theme-doc-markdown"><h1>D</h1><nav>menu</nav><p>docs</p></div>'),
              (7, "http://h/7", "<p></p>"))
    got = {r.page_id: r for r in page_results(df, PageOptions(auto_detect=True)).collect()}
    assert len(got) == 7
    assert not got[1].success and "challenge" in got[1].error
    assert got[2].success and got[2].title == "N" and got[2].md.startswith("words words")
    assert got[3].title == "R" and got[3].image_urls == ["http://h/a.png"] and "](http://h/a.png)" in got[3].md and "# R" not in got[3].md
    assert (got[4].title, got[4].md) == ("W", "body text")
    assert got[5].md == "> 公众号：**me**\n\nx\ny"
    assert (got[6].title, got[6].md) == ("D", "docs\n")
    assert not got[7].success and "empty" in got[7].error


def test_articles_join_back_to_their_pages(rows):
    """The stored articles meet their own pages again, with the columns that the page job takes."""
    md = '<script>window._ROUTER_DATA = {"loaderData":{"p":{"curDoc":{"Title":"R","MDContent":"text"}}}}</script>'
    tree = '<script id="__NEXT_DATA__">{"props":{"pageProps":{"fallback":{"article/detail":{"articleInfo":{"content":{"type":"doc","content":[{"type":"paragraph","content":[{"type":"text","text":"t"}]}]}}}}}}}</script>'
    pages = rows("page_id long, html string", (1, md), (2, "<p>no</p>"), (3, tree), (4, md + tree), (5, None))
    found = embedded.articles(pages).select("page_id", F.struct("title", "body", "is_markdown").alias("e"))
    got = {r.page_id: r.e and (r.e.title, r.e.is_markdown) for r in pages.join(found, "page_id", "left").collect()}
    assert got == {1: ("R", True), 2: None, 3: ("", False), 4: ("", False), 5: None}


def test_asset_names_with_other_characters(rows):
    files = rows("file_name string", ("a b.png",), ("plain.png",), ("x(1).png",), ("gone one.png",), ("é.png",), ("gone.png",))
    docs = rows("md string", ("![](img/a%20b.png) and ![t](<img/x(1).png>)",), ("see theplain.png. é.png",))
    assert sorted(r.file_name for r in site.unused_assets(files, docs).collect()) == ["gone one.png", "gone.png"]


def test_rules_from_a_table(spark, rows):
    """Against the same selectors given as a list, page by page."""
    from pagemill.operators import regions
    htmls = ['<nav a="1">x<b>y</b></nav><p class="q r" ID=" i ">t</p><IMG data-z>', '<p data-a=\'x"y\' lang=en>a</p><script class="q">1<2</script><p>b</p>', "", "<p>none", '<div><p class=r>a</div>tail']
    own = {"a": ["[data-a*=\"x\"]", ".q", "P"], "b": [" #i ", "[lang = 'en']", "nav"], "c": []}
    sites = ["a", "b", "c"]
    pages = rows("page_id long, site string, html string", *[(k * 10 + n, s, h) for n, s in enumerate(sites) for k, h in enumerate(htmls)], (99, None, htmls[0]), (98, "a", None))
    table = rows("site string, rank int, selector string", *[(s, 10 * k, r) for s, rs in own.items() for k, r in enumerate(rs)], ("a", 10, ".q"), (None, 15, ".r"), (None, 1, "[no]"), ("b", 3, None), ("z", 1, "p"))
    got = {r.page_id: (r.html, r.elements_removed) for r in regions.strip_by_rules(pages, table).collect()}
    for site in [*sites, None]:
        listed = sorted([(10 * k, r) for k, r in enumerate(own.get(site, []))] + [(15, ".r"), (1, "[no]")])
        want = regions.strip_elements(pages.where(F.col("site").eqNullSafe(site)), [r for _, r in listed]).collect()
        assert {r.page_id: got[r.page_id] for r in want} == {r.page_id: (r.html, r.elements_removed) for r in want} and want
    large = spark.range(20_000).selectExpr("concat('s', id % 100) AS site", "id AS rank", "concat('.c', id) AS selector")
    size = lambda t: len(regions.strip_by_rules(pages, t)._jdf.queryExecution().optimizedPlan().toString())
    assert size(large) < 1.1 * size(spark.range(1).selectExpr("'s' AS site", "id AS rank", "'p' AS selector"))  # rules are not part of the plan


def test_page_job_with_rules_of_sites(rows):
    html = "<html><head><title>T</title></head><body><article><h1>T</h1><div class='promo'>Buy</div><p>Long enough body of text for the page, with words.</p></article></body></html>"
    pages = rows("page_id long, url string, html string", (1, "http://a.org/1", html), (2, "http://b.org:80/2", html))
    got = {r.page_id: r.md for r in page_results(pages, PageOptions(), rows("site string, rank int, selector string", ("b.org:80", 1, ".promo"))).collect()}
    assert "Buy" in got[1] and "Buy" not in got[2] and "Long enough" in got[2]


def test_block_trees_in_doubling_rounds(spark, monkeypatch):
    """Random graphs with shared blocks, circles and repeated children against a breadth-first walk; a long chain in few rounds."""
    import random
    rng = random.Random(8)
    children = {f"b{k}": [f"b{rng.randrange(140)}" for _ in range(rng.randrange(1, 4))] for k in range(120)}
    roots = [("p1", "b0"), ("p1", "b7"), ("p2", "b3"), ("p3", "gone"), ("p3", "b3"), ("p1", "b0")]
    df = spark.createDataFrame([(k, "text", None, None, v) for k, v in children.items()], "block_id string, type string, properties string, format string, content array<string>")
    want = {}
    for page in {p for p, _ in roots}:
        level = {b: ([], None) for p, b in roots if p == page}
        found = dict(level)
        while level:
            step = {}
            for parent, (path, _) in level.items():
                for k, child in enumerate(children.get(parent, [])):
                    if child not in found:
                        step[child] = min(step.get(child, ([1 << 30], "")), (path + [k], parent))
            found.update(step)
            level = step
        want |= {(page, b): v for b, v in found.items()}
    got = blocks.tree(df, spark.createDataFrame(roots, "page_id string, block_id string"))
    assert {(r.page_id, r.block_id): (r.path, r.parent) for r in got.collect()} == want and got.count() == len(want) > 60
    stored = []
    monkeypatch.setattr(blocks, "durable", lambda d, f=blocks.durable: stored.append(1) or f(d))
    chain = spark.range(3000).selectExpr("concat('c', id) AS block_id", "'text' AS type", "CAST(NULL AS string) AS properties", "CAST(NULL AS string) AS format", "array(concat('c', id + 1)) AS content")
    long = blocks.tree(chain, spark.createDataFrame([("p", "c0")], "page_id string, block_id string"))
    assert long.count() == 3001 and long.where("size(path) <> CAST(substr(block_id, 2) AS int)").isEmpty() and len(stored) <= 2 * 14


def test_first_assigned_json_of_a_script(rows):
    cases = ['{"a": 1}', 'x = 1; y = {"b": "= {"}; z = {"c": 2}', 'f = {g: function() { h = {"d": {"e": "}"}}; }}; i = {"late": 1}', 'a = {b: 1}; c = {d', 'if (s = /"/) { t = {"u": "v w"} }',
             'a = { b = {"in": [1, {"x": 2}]}', "// don't = {\nq =\n {\"r\": \"it's\"}", "var a = 1;", "", 'm = {}', '"x = {1}"; n = {"o": "a\\"}"}']
    want = {0: cases[0], 1: '{"b": "= {"}', 2: '{"d": {"e": "}"}}', 4: '{"u": "v w"}', 5: '{"in": [1, {"x": 2}]}', 6: '{"r": "it\'s"}', 9: "{}", 10: '{"o": "a\\"}"}'}
    got = embedded.json_texts(rows("sid long, script string", *enumerate(cases)))
    assert {r.sid: r.json for r in got.collect()} == want


def test_many_assignments_in_one_script(rows):
    many = "".join(f"v{k} = {{f{k}: [{k}], 'g': 'x'}};" for k in range(50_000)) + 'last = {"found": true}'
    got = embedded.json_texts(rows("sid long, script string", (1, many))).collect()
    assert [r.json for r in got] == ['{"found": true}']


def test_short_strings_are_looked_into(rows):
    inner = '{\\"type\\":\\"doc\\",\\"content\\":[{\\"type\\":\\"paragraph\\",\\"content\\":[{\\"type\\":\\"text\\",\\"text\\":\\"hi\\"}]}]}'
    docs = rows("doc_id long, json string", (1, '{"s":"' + inner + '"}'))
    assert [r.html.strip() for r in embedded.roots_to_html(embedded.richtext_roots(docs)).collect()] == ["<p>hi</p>"]
    assert embedded.richtext_roots(docs, min_nested=200).count() == 0
