"""Work per page: what is one token, what is looked at once."""

import re

from pyspark.sql import functions as F

from pagemill.functions import markdown_text as mt
from pagemill.operators import blocks, embedded, markdown


def test_plain_tables_are_one_token(rows):
    plain = "<table border=1><tr><td>a<br/>b</td><td><a href='/x'>c</a></td></tr><tr><td>1 &amp; 2</td></tr></table>"
    pages = rows("page_id long, html string, url string", (1, f"<p>t</p>{plain}<p>u</p>", "http://h.org/d/p"),
                 (2, f"<table><tr><td>{plain}</td></tr></table>", "http://h.org/d/p"), (3, f"<pre>{plain}</pre>", "http://h.org/d/p"),
                 (4, f"<svg>{plain}</svg>", "http://h.org/d/p"))
    cut = markdown._cut(pages, "html", "url", "page_id", False, [], True)
    count = {r.page_id: r["count"] for r in cut.groupBy("page_id").count().collect()}
    assert count[1] == 7 and count[2] > 20 and count[3] > 10
    md = {r.page_id: r.md for r in markdown.html_to_markdown(pages).collect()}
    assert md[1] == "t\n\n| a<br>b | [c](http://h.org/x) |\n| --- | --- |\n| 1 & 2 |  |\n\nu\n"
    assert 4 not in md


def test_table_tags_are_read_at_once_as_one_by_one(rows):
    """A bracket in an attribute makes the table go token by token."""
    cells = ["a  b\r\nc", "x<br/><BR>y<br>", "<p>one</p> <div>two</div>", "&am<b>p;</b> &amp &lt;br&gt;z&#13;q &noti<i/>n;", "<a href='/p q?a&amp;b' title=\"x\">l|k</a>", "<A>n</A><a href='../u'></a>",
             "<img src=i.png alt='[c]'/><img src='data:x'>", "\xa0 t \u2028", "<span/>s<area/><td>in", "<ul><li>1<li>2</ul>", "<a href='/c'>over</td><td>two</a>", "\t", "<input value='&amp;'>v;"]
    html = "{}<caption>c &amp;</caption><TR class=r>" + "</tr><tr>".join(f"<td>{c}</td><TH colspan=1>{n}</th >" for n, c in enumerate(cells)) + "</tr><tr><td/><td> </td></table >"
    pages = rows("page_id long, html string, url string", *[(n, html.format(t), "http://h.org/d/p?q#f") for n, t in enumerate(["<table>", "<table title='<'>"])])
    assert markdown._cut(pages, "html", "url", "page_id", False, [], True).where("kind = 'table'").count() == 2
    at_once, one_by_one = (r.md for r in markdown.html_to_markdown(pages).orderBy("page_id").collect())
    assert at_once == one_by_one and at_once.startswith("| a b<br>c | 0 |  |\n| --- | --- | --- |\n| x<br>y | 1 |  |\n") and "| [l\\|k](http://h.org/p%20q?a&b) | 4 |" in at_once


def test_generated_methods_are_small_enough_to_be_compiled(spark, rows):
    """The JVM only interprets methods of more than 8,000 bytes."""
    pages = rows("page_id long, html string, url string", (1, "<p>t</p>", "http://h.org/d/p"))
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        text = spark._jvm.PythonSQLUtils.explainString(markdown.html_to_markdown(pages)._jdf.queryExecution(), "codegen")
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    sizes = [int(x) for x in re.findall(r"maxMethodCodeSize:(\d+)", text)]
    assert len(sizes) > 10 and max(sizes) <= 8000


def test_text_without_anything_to_rewrite_is_not_rewritten(value):
    texts = ["a\n \nb", "\n\n\n\n\na", "a\n\n\n\n\nb", " \t\nx", "a\r\n \r\nb", "# \nx", "#\t \nx", "x\n##", "### T [#](#t)", "a   b", "#  \nq"]
    old = {"blank": lambda s: F.regexp_replace(F.regexp_replace(F.regexp_replace(s, r"(?m)^[ \t\x0b\f\r]+$", ""), r"\n{4,}", "\n\n\n"), r"\A\n{3,}", "\n\n"),
           "bare": lambda s: F.regexp_replace(s, r"(?m)^[ \t]*#{1,6}[ \t]*(?:\n|\z)", "")}
    for t in texts:
        assert value(lambda s: mt.squeeze_blank_lines(s) == old["blank"](s), s=t), t
        assert value(lambda s: mt.drop_empty_headings(s) == old["bare"](s), s=t), t
    assert value(mt.drop_heading_permalinks, s="### T [#](#t)") == "### T"


def test_block_markup_travels_once(rows):
    cells = lambda *values: "{" + ",".join(f'"c{i}":[["{v}"]]' for i, v in enumerate(values)) + "}"
    records = rows("block_id string, type string, properties string, format string, content array<string>",
                   ("p", "page", "{}", "{}", ["t", "e", "x"]), ("t", "table", "{}", '{"table_block_column_header":true}', ["r0", "n", "r1", "r2"]),
                   ("r0", "table_row", "{}", "{}", []), ("r1", "table_row", cells("a", "b"), "{}", ["d"]), ("r2", "table_row", cells("c"), "{}", []),
                   ("n", "text", '{"title":[["note"]]}', "{}", []), ("d", "text", '{"title":[["deep"]]}', "{}", []),
                   ("e", "table", "{}", "{}", []), ("x", "text", '{"title":[["rows of no table"]]}', "{}", ["r3"]), ("r3", "table_row", cells("z"), "{}", []))
    roots = rows("page_id string, block_id string", ("q", "p"))
    assert blocks.to_html(records, roots).first().html == (
        "<table>\n<tr><th>a</th><th>b</th></tr>\n<tr><td>c</td></tr>\n</table>\n<p>note</p>\n<p>deep</p>\n<p>rows of no table</p>\n")
    made = blocks.fragments(blocks.tree(records, roots), records).groupBy("page_id").count()
    assert made._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning(page_id") == 1


def test_scripts_are_searched_where_nothing_else_was_found(rows, monkeypatch):
    page = '<script>window._ROUTER_DATA = {"loaderData":{"a":{"curDoc":{"Title":"T","MDContent":"text"}}}}</script>'
    pages = rows("page_id long, html string", (1, page), (2, "<p>no script</p>"), (3, None))
    searched, search = [], embedded.script_articles

    def noted(some, *args):
        searched.extend(r.page_id for r in some.collect())
        return search(some, *args)

    monkeypatch.setattr(embedded, "script_articles", noted)
    assert [(r.page_id, r.source_type, r.body) for r in embedded.articles(pages).collect()] == [(1, "modernjs", "text")]
    assert sorted(searched) == [2, 3]
