"""Queries over Markdown: conversion rules, line clean-ups, rich text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.catalog.base import FLAT, H1, ORIGIN, TITLE, TOKENS, UNESC, derived, esc, escq, flat, query, table
from pagemill.catalog.page_queries import LINKS_SQL, conversation_dumps, doc_json
from pagemill.functions import markdown_text as mt
from pagemill.operators import blocks, embedded, markdown, richtext
from pagemill.sources import pages as src

BASE = "'http://h.org/d/p'"
DOC = "doc_id"


def docs(spark, sf) -> DataFrame:
    """Documents with their whole text on one line, HTML-escaped."""
    t = table(spark, sf, "documents").withColumn("t", flat())
    e = F.col("t")
    for a, b in [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")]:
        e = F.replace(e, F.lit(a), F.lit(b))
    return t.withColumns({"e": e, "url": F.expr(BASE)})


def convert(spark, sf, html: str, **options) -> DataFrame:
    made = docs(spark, sf).select(DOC, "url", F.expr(html).alias("html"))
    return markdown.html_to_markdown(made, "html", "url", DOC, **options)


def flat_docs(expected: str) -> str:
    """Oracle over documents with non-empty text ``t``; all-blank texts are checked by the same expression."""
    return f"SELECT doc_id, {expected} AS md FROM (SELECT *, {FLAT} AS t, chr(10) AS n FROM documents)"


# Paragraph text as the conversion writes it; an empty paragraph leaves nothing.
@query("md1_skipped_elements", flat_docs("'A' || n || n || t || CASE WHEN t = '' THEN '' ELSE n || n END || 'B' || n"))
def _(spark, sf):
    return convert(spark, sf, "'<p>A</p><script>var x=\"<p>no</p>\";</script><style>p{}</style><svg><text>no</text></svg><button>no</button><video><p>no</p></video>"
                              "<div class=\"kg-video-card\"><div class=\"kg-video-container\">no</div></div><p>' || e || '</p><audio>no</audio><p>B</p>'")


@query("md2_headings", flat_docs("CASE WHEN t = '' THEN '' ELSE '## ' || t || n || n END || '###### last' || n"))
def _(spark, sf):
    return convert(spark, sf, "'<h2>' || e || '</h2><h3> </h3><h4><img src=\"/x.png\"></h4><h6>last</h6>'")


@query("md3_blocks", flat_docs("'a' || n || 'b' || n || n || '---' || CASE WHEN t = '' THEN '' ELSE n || n || t END || n || n || n || 'end' || n"))
def _(spark, sf):
    return convert(spark, sf, "'<p>a<br>b</p><hr><p>' || e || '</p><p></p><p>end</p>'")


@query("md4_emphasis", flat_docs("'x **' || source || '**, *' || lang || '*end' || n"))
def _(spark, sf):
    return convert(spark, sf, "'<p>x <b>' || source || '</b>, <em>' || lang || '</em> end</p>'")


@query("md5_spacing", flat_docs("'one ' || source || ' two 中文文**粗**字, ' || lang || '.x' || n"))
def _(spark, sf):
    return convert(spark, sf, "'<p>one<span>' || source || '</span>two 中文<span>文</span><b>粗</b>字<span>, </span>' || lang || '<span>.x</span></p>'")


@query("md6_inline_code", flat_docs("'see `' || regexp_replace(replace(t, '`', '\\`'), '^$', '') || '`' || '!' || n"))
def _(spark, sf):
    return convert(spark, sf, "'<p>see <code>' || e || '</code>!</p>'")


LANGS = "CASE doc_id % 4 WHEN 0 THEN ' data-lang=\"sql\"' WHEN 1 THEN ' class=\"x language-c++\"' WHEN 2 THEN ' class=\"hl Python\"' ELSE ' class=\"plain\"' END"
CODE = "regexp_replace(regexp_replace(text, '^\\n+', ''), '\\n+$', '')"


@query("md7_fenced_code", f"SELECT doc_id, '```' || CASE doc_id % 4 WHEN 0 THEN 'sql' WHEN 1 THEN 'c++' WHEN 2 THEN 'python' ELSE '' END || chr(10) || {CODE} || chr(10) || '```' || chr(10) || chr(10) || 'end' || chr(10) AS md FROM documents")
def _(spark, sf):
    e = F.col("text")
    for a, b in [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")]:
        e = F.replace(e, F.lit(a), F.lit(b))
    made = docs(spark, sf).select(DOC, "url", F.concat(F.lit("<pre><code"), F.expr(LANGS), F.lit(">"), e, F.lit("</code></pre><p>end</p>")).alias("html"))
    return markdown.html_to_markdown(made, "html", "url", DOC)


@query("md8_links", flat_docs("'[' || source || '](http://h.org/x%20' || doc_id || '%28a%29)' || ' then bad[http://o.org/](http://o.org/)' || n || n || '# T' || n"))
def _(spark, sf):
    return convert(spark, sf, "'<p><a href=\"/x ' || doc_id || '(a)\"> ' || source || '</a> then <a href=\"javascript:x\">bad</a> <a href=\"http://o.org/\"></a></p><h1>T<a href=\"#t\">¶</a></h1>'")


@query("md9_images", flat_docs("'![a b](http://h.org/i/' || doc_id || '.png)' || n || n || t || CASE WHEN t = '' THEN '' ELSE n || n END || '![](http://h.org/d/in.png)' || n"))
def _(spark, sf):
    return convert(spark, sf, "'<img alt=\"[a b]\" src=\"/i/' || doc_id || '.png\"><p>' || e || '</p><a href=\"/p\"><img src=\"in.png\"></a><img src=\"/favicon.ico\">'")


@query("md10_lists", flat_docs("'- a' || n || '  5. ' || source || n || '  6. y' || n || n || n || '- z' || n"))
def _(spark, sf):
    return convert(spark, sf, "'<ul><li>a<ol start=\"5\"><li>' || source || '</li><li>y</li></ol></li><li>z</li></ul>'")


@query("md11_blockquote", flat_docs("'a' || n || n || '> ' || source || n || n || 'b' || n"))
def _(spark, sf):
    return convert(spark, sf, "'<p>a</p><blockquote>' || source || '</blockquote><p>b</p>'")


TABLE_SQL = """SELECT o_orderkey AS doc_id, '| Line | Flag | Note |' || chr(10) || '| --- | --- | --- |' || chr(10) || rows AS md FROM
 (SELECT l_orderkey AS o_orderkey, string_agg('| ' || l_linenumber || '<br>x | ' || l_returnflag || '\\|' || l_linestatus || ' | ' ||
 CASE WHEN l_linenumber % 2 = 0 THEN '[part](http://h.org/p/' || l_partkey || ')' ELSE '' END || ' |' || chr(10), '' ORDER BY l_linenumber, l_partkey, l_suppkey) AS rows FROM lineitem GROUP BY l_orderkey)"""


def order_tables(spark, sf) -> DataFrame:
    """Every order as an HTML table of its lines."""
    line = table(spark, sf, "lineitem").withColumn("row", F.concat(
        F.lit("<tr><td>"), "l_linenumber", F.lit("<br>x</td><td>"), "l_returnflag", F.lit("|"), "l_linestatus", F.lit("</td>"),
        F.when(F.col("l_linenumber") % 2 == 0, F.concat(F.lit('<td><a href="/p/'), "l_partkey", F.lit('">part</a></td>'))).otherwise(""), F.lit("</tr>")))
    rows = line.groupBy(F.col("l_orderkey").alias(DOC)).agg(F.array_join(F.transform(F.array_sort(F.collect_list(
        F.struct("l_linenumber", "l_partkey", "l_suppkey", "row"))), lambda r: r["row"]), "").alias("rows"))
    return rows.select(DOC, F.concat(F.lit("<table><thead><tr><th>Line</th><th>Flag</th><th>Note</th></tr></thead><tbody>"), "rows",
                                     F.lit("<tr><td> </td></tr></tbody></table>")).alias("html"), F.expr(BASE).alias("url"))


@query("md12_tables", TABLE_SQL)
def _(spark, sf):
    return markdown.html_to_markdown(order_tables(spark, sf), "html", "url", DOC)


@query("md13_complex_tables", flat_docs("""CASE WHEN doc_id % 2 = 0 THEN '<table class="k"><tr><td colspan="2" title="&quot;q&quot;">' || """ + esc("t") + """ || '</td></tr><tr><td>a</td><td><a>b</a></td></tr></table>'
 ELSE '| ' || replace(t, '|', '\\|') || ' |' || n || '| --- |' END || n"""))
def _(spark, sf):
    simple = "'<table><tr><td>' || e || '</td></tr></table>'"
    odd = ("'<table class=k onclick=\"x()\"><tr><td colspan=2 title=' || chr(39) || '\"q\"' || chr(39) || '>' || e || '</td></tr><tr><td>a</td><td><a href=\"java&#10;script:x\">b</a></td></tr></table>'")
    return convert(spark, sf, f"CASE WHEN doc_id % 2 = 0 THEN {odd} ELSE {simple} END", keep_html=True).where("true")


@query("md14_math", flat_docs("'a $x_{' || doc_id || '}$ b' || n || n || '$$' || n || 'E=' || doc_id || n || '$$' || n || n || 'c $k^2$ d' || n || n || n || source || n"))
def _(spark, sf):
    return convert(spark, sf, "'<p>a <script type=\"math/tex\">x_{' || doc_id || '}</script> b</p><script type=\"math/tex; mode=display\">E=' || doc_id || '</script>"
                              "<p>c <span class=\"katex\"><span class=\"katex-mathml\"><math><annotation encoding=\"application/x-tex\">k^2</annotation></math></span><span class=\"katex-html\">kk2</span></span> d</p>"
                              "<p><span class=\"katex\">lost</p><p>' || source || '</p>'")


@query("md15_destination_escape", "SELECT page_id, replace(replace(replace(url || ' (x)', ' ', '%20'), '(', '%28'), ')', '%29') AS dest FROM pages")
def _(spark, sf):
    from pagemill.functions import urls
    return table(spark, sf, "pages").select("page_id", urls.link_destination(F.concat("url", F.lit(" (x)"))).alias("dest"))


# --- line-level steps over documents, with a fence put around part of them -------------------------------------

FENCED = "text || chr(10) || chr(10) || chr(10) || chr(10) || '# tail' || chr(10) || '```' || chr(10) || '# code' || chr(10) || chr(10) || chr(10) || chr(10) || chr(10) || '```' || chr(10) || '##' || chr(10) || 'end'"
LINES = f"""lines AS (SELECT doc_id, i, line, sum(CASE WHEN regexp_matches(line, '^[ \\t]*(```|~~~)') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) % 2 = 1
 OR regexp_matches(line, '^[ \\t]*(```|~~~)') AS fenced FROM (SELECT doc_id, unnest(string_split({FENCED}, chr(10))) AS line, generate_subscripts(string_split({FENCED}, chr(10)), 1) AS i FROM documents))"""


def lines_oracle(line: str, where: str = "true") -> str:
    return f"WITH {LINES} SELECT doc_id, string_agg({line}, chr(10) ORDER BY i) AS md FROM lines WHERE {where} GROUP BY doc_id"


def fenced(spark, sf) -> DataFrame:
    return derived(spark, sf, "documents", md=FENCED)


@query("mdp1_fence_lines", f"WITH {LINES} SELECT doc_id, count(*) FILTER (fenced) AS fenced_lines, count(*) FILTER (NOT fenced) AS free_lines FROM lines GROUP BY doc_id")
def _(spark, sf):
    segs = fenced(spark, sf).select(DOC, F.explode(mt.segments(F.col("md"))).alias("s")).where("s <> ''")
    n = F.length("s") - F.length(F.replace(F.col("s"), F.lit("\n"), F.lit(""))) + F.when(F.col("s").endswith("\n"), 0).otherwise(1)
    counted = segs.select(DOC, n.alias("n"), mt.is_fence(F.col("s")).alias("f"))
    return counted.groupBy(DOC).agg(F.sum(F.when(F.col("f"), F.col("n")).otherwise(0)).alias("fenced_lines"),
                                    F.sum(F.when(F.col("f"), 0).otherwise(F.col("n"))).alias("free_lines"))


@query("mdp2_blank_lines", f"""WITH {LINES}, runs AS (SELECT *, trim(line, chr(32) || chr(9) || chr(13)) = '' AND NOT fenced AS blank, sum(CASE WHEN trim(line, chr(32) || chr(9) || chr(13)) = '' AND NOT fenced THEN 0 ELSE 1 END)
 OVER (PARTITION BY doc_id ORDER BY i) AS g FROM lines), num AS (SELECT *, sum(CASE WHEN blank THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, g ORDER BY i) AS k FROM runs)
 SELECT doc_id, string_agg(CASE WHEN blank THEN '' ELSE line END, chr(10) ORDER BY i) AS md FROM num WHERE NOT blank OR k <= 2 GROUP BY doc_id""")
def _(spark, sf):
    return fenced(spark, sf).select(DOC, mt.squeeze_blank_lines(F.col("md")).alias("md"))


@query("mdp3_latex", flat_docs("'$$a$$ ' || t || ' `\\(c\\)` $y$' || n || '```' || n || '\\(z\\)' || n || '```'"))
def _(spark, sf):
    md = F.concat(F.lit("\\[a\\] "), "t", F.lit(" `\\(c\\)` \\(y\\)\n```\n\\(z\\)\n```"))
    return docs(spark, sf).select(DOC, mt.latex_delimiters(md).alias("md"))


@query("mdp4_empty_headings", f"WITH {LINES} SELECT doc_id, string_agg(line, chr(10) ORDER BY i) AS md FROM lines WHERE fenced OR NOT regexp_matches(line, '^[ \\t]*#{{1,6}}[ \\t]*$') GROUP BY doc_id")
def _(spark, sf):
    return fenced(spark, sf).select(DOC, mt.drop_empty_headings(F.col("md")).alias("md"))


@query("mdp5_permalinks", "SELECT doc_id, '## ' || source || chr(10) || text AS md FROM documents")
def _(spark, sf):
    return derived(spark, sf, "documents", md="'## ' || source || ' [#](http://x/#a) [ ¶ ](b) ' || chr(10) || text").select(DOC, mt.drop_heading_permalinks(F.col("md")).alias("md"))


@query("mdp6_duplicate_title", r"SELECT doc_id, regexp_replace(repeat('intro' || chr(10), 199) || text, '\s+$', '') || chr(10) AS md FROM documents")
def _(spark, sf):
    # the title comes on line 200
    d = table(spark, sf, "documents").withColumn("md", F.concat(F.lit("intro\n" * 199 + "#  "), F.upper("source"), F.lit("! Title \n  \n"), "text"))
    return d.select(DOC, mt.drop_duplicate_title(F.col("md"), F.concat("source", F.lit(" title"))).alias("md"))


@query("mdp7_demote_headings", lines_oracle("CASE WHEN fenced OR NOT regexp_matches(line, '^#{1,6}[ \\t]') THEN line ELSE repeat('#', least(6, length(regexp_extract(line, '^(#+)', 1)) + 2)::INT) || regexp_extract(line, '^#+(.*)$', 1) END"))
def _(spark, sf):
    return fenced(spark, sf).select(DOC, mt.demote_headings(F.col("md"), 2).alias("md"))


# --- whole pages ----------------------------------------------------------------------------------------------

@query("page_main_text", f"""WITH {TOKENS.replace('FROM pages', "FROM (SELECT page_id, url, regexp_extract(html, '(?is)<article[^>]*>(.*?)</article>', 1) AS html FROM pages)")}
 SELECT page_id, any_value({H1.replace('html', 'p.html')}) AS title, cast(sum(CASE WHEN kind = 'text' THEN length(trim(regexp_replace({UNESC.format('tok')}, '\\s+', ' ', 'g'))) ELSE 0 END) AS BIGINT) AS n_chars
 FROM tok JOIN pages p USING (page_id) GROUP BY page_id""")
def _(spark, sf):
    """Title and visible main text length of every page."""
    from pagemill.operators import titles, tokens as tk
    p = table(spark, sf, "pages").withColumn("main", titles.main_html(F.col("html")))
    return p.select("page_id", F.coalesce(titles.first_heading(F.col("main")), titles.title_tag(F.col("html"))).alias("title"),
                    tk.visible_length(F.col("main")).alias("n_chars"))


# The conversion of whole pages keeps every letter of the text and every link.
@query("page_markdown", f"""SELECT page_id, length(regexp_replace({UNESC.format("regexp_replace(regexp_replace(html, '(?is)<script.*?</script>|<style.*?</style>|<!--.*?-->', '', 'g'), '<[^>]+>', '', 'g')")}, '[^\\p{{L}}]', '', 'g'))::BIGINT AS letters,
 len(regexp_extract_all(html, '<a href'))::BIGINT AS links FROM pages""")
def _(spark, sf):
    md = markdown.html_to_markdown(table(spark, sf, "pages"))
    links = F.size(F.regexp_extract_all("md", F.lit(r"\]\(http[^)]*\)"), F.lit(0)))
    bare = F.regexp_replace("md", r"\]\(http[^)]*\)", "")
    return md.select("page_id", F.length(F.regexp_replace(bare, r"[^\p{L}]", "")).alias("letters"), links.alias("links"))


# --- rich text ------------------------------------------------------------------------------------------------

DIALECT = "doc_id % 4"


def richtext_docs(spark, sf) -> DataFrame:
    d = table(spark, sf, "documents")
    quoted = F.regexp_extract(F.to_json(F.struct(F.col("text").alias("s"))), r'(?s)^\{"s":(.*)\}$', 1)
    prose = F.concat(F.lit('{"content":[{"type":"heading","attrs":{"level":9},"content":[{"type":"text","text":"H","marks":[{"type":"italic"},{"type":"link","attrs":{"href":"http://x/?a&b"}}]}]},{"type":"paragraph","content":[{"type":"text","text":'),
                     quoted, F.lit('}]},{"type":"orderedList","attrs":{"start":3},"content":[{"type":"listItem","content":[{"type":"paragraph","content":[{"type":"text","text":"i"}]}]}]}],"type":"doc"}'))
    slate = F.concat(F.lit('{"type":"doc","children":[{"type":"block-quote","children":[{"bold":true,"italic":false,"text":'), quoted, F.lit(',"code":true},{"text":""}]},{"type":"image","url":"http://x/i.png","alt":"A"},{"type":"mystery","children":[{"text":"m"}]}]}'))
    lexical = F.concat(F.lit('{"root":{"type":"root","children":[{"type":"heading","tag":"h4","children":[{"type":"text","format":9,"text":'), quoted, F.lit('}]},{"type":"table","children":[{"type":"tablerow","children":[{"type":"tablecell","attrs":{"colspan":"3"},"children":[{"type":"text","text":"c"}]}]}]},{"type":"horizontalrule"}]}}'))
    editor = F.concat(F.lit('{"time":1,"blocks":[{"type":"header","data":{"text":"E <script>x</script>","level":3}},{"type":"code","data":{"code":'), quoted, F.lit('}},{"type":"list","data":{"style":"ordered","items":["a",{"content":"b <i onclick=\\"x\\">c</i>"}]}},{"type":"delimiter","data":{}},{"type":"odd","data":{"text":"z"}}]}'))
    n = F.col(DOC) % 4
    return d.select(DOC, F.when(n == 0, prose).when(n == 1, slate).when(n == 2, lexical).otherwise(editor).alias("json"))


E = escq("text")
NL = "chr(10)"
RICH = f"""CASE doc_id % 4 WHEN 0 THEN '<h6><a href="http://x/?a&amp;b"><em>H</em></a></h6>' || {NL} || '<p>' || {E} || '</p>' || {NL} || '<ol start="3">' || {NL} || '<li><p>i</p>' || {NL} || '</li>' || {NL} || '</ol>' || {NL}
 WHEN 1 THEN '<blockquote>' || CASE WHEN text = '' THEN '' ELSE '<strong><code>' || {E} || '</code></strong>' END || '</blockquote>' || {NL} || '<img src="http://x/i.png" alt="A">' || {NL} || 'm'
 WHEN 2 THEN '<h4><u><strong>' || {E} || '</strong></u></h4>' || {NL} || '<table>' || {NL} || '<tr><td colspan="3">c</td></tr>' || {NL} || '</table>' || {NL} || '<hr>' || {NL}
 ELSE '<h3>E x</h3>' || {NL} || '<pre><code>' || {E} || '</code></pre>' || {NL} || '<ol>' || {NL} || '<li>a</li>' || {NL} || '<li>b <i>c</i></li>' || {NL} || '</ol>' || {NL} || '<hr>' || {NL} || '<p>z</p>' || {NL} END"""


@query("rt1_richtext_nodes", "SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 9 WHEN 1 THEN 7 WHEN 2 THEN 9 ELSE 6 END AS nodes, CASE doc_id % 4 WHEN 0 THEN 5 WHEN 1 THEN 3 WHEN 2 THEN 6 ELSE 2 END AS deepest FROM documents")
def _(spark, sf):
    return richtext.nodes(richtext_docs(spark, sf)).groupBy(DOC).agg(F.count("*").alias("nodes"), F.max("depth").alias("deepest"))


@query("rt2_richtext_html", f"SELECT doc_id, {RICH} AS html FROM documents")
def _(spark, sf):
    return richtext.to_html(richtext_docs(spark, sf))


@query("rt3_marks", f"""SELECT doc_id, CASE WHEN doc_id % 32 >= 16 THEN '' ELSE '' END || CASE WHEN doc_id % 8 >= 4 THEN '<s>' ELSE '' END || CASE WHEN doc_id % 16 >= 8 THEN '<u>' ELSE '' END || CASE WHEN doc_id % 4 >= 2 THEN '<em>' ELSE '' END
 || CASE WHEN doc_id % 2 >= 1 THEN '<strong>' ELSE '' END || CASE WHEN doc_id % 32 >= 16 THEN '<code>' ELSE '' END || {E} || CASE WHEN doc_id % 32 >= 16 THEN '</code>' ELSE '' END || CASE WHEN doc_id % 2 >= 1 THEN '</strong>' ELSE '' END
 || CASE WHEN doc_id % 4 >= 2 THEN '</em>' ELSE '' END || CASE WHEN doc_id % 16 >= 8 THEN '</u>' ELSE '' END || CASE WHEN doc_id % 8 >= 4 THEN '</s>' ELSE '' END AS html FROM documents""")
def _(spark, sf):
    d = table(spark, sf, "documents").select(DOC, F.to_json(F.struct(F.lit("text").alias("type"), F.col("text"), (F.col(DOC) % 32).alias("format"))).alias("node"))
    return d.select(DOC, richtext.marked_text(richtext.parse(F.col("node"))).alias("html"))


@query("rt4_attributes", """SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 1 WHEN 1 THEN 6 WHEN 2 THEN 2 WHEN 3 THEN 4 ELSE 2 END AS level,
 '<img src="' || CASE WHEN doc_id % 2 = 0 THEN 'http://x/' || doc_id ELSE 'f' || doc_id END || '" alt="' || source || '">' || chr(10) AS image FROM documents""")
def _(spark, sf):
    node = ("CASE doc_id % 5 WHEN 0 THEN '{\"attrs\":{\"level\":0}}' WHEN 1 THEN '{\"data\":{\"level\":\"77\"}}' WHEN 2 THEN '{\"level\":\"abc\"}' WHEN 3 THEN '{\"tag\":\"h4\"}' ELSE '{}' END")
    image = "CASE WHEN doc_id % 2 = 0 THEN '{\"attrs\":{\"src\":\"http://x/' || doc_id || '\",\"alt\":\"' || source || '\"},\"url\":\"no\"}' ELSE '{\"data\":{\"file\":{\"url\":\"f' || doc_id || '\"},\"caption\":\"' || source || '\"}}' END"
    return derived(spark, sf, "documents", node=node, image=image).select(
        DOC, richtext.heading_level(richtext.parse(F.col("node"))).alias("level"), richtext.image_tag(richtext.parse(F.col("image"))).alias("image"))


@query("rt5_editor_blocks", f"SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN '<p>' || t || '</p>' ELSE '<blockquote>' || t || '</blockquote>' END || chr(10) AS html FROM (SELECT doc_id, '<b>' || source || '</b>alert <a href=\"\">x</a>' AS t FROM documents)")
def _(spark, sf):
    raw = F.concat(F.lit("<b onmouseover='x'>"), "source", F.lit("</b><script>alert</script> <a href=\"javascript:y\">x</a>"))
    kind = F.when(F.col(DOC) % 2 == 0, "paragraph").otherwise("quote")
    d = table(spark, sf, "documents").select(DOC, F.to_json(F.struct(kind.alias("type"), F.struct(raw.alias("text")).alias("data"))).alias("node"))
    return d.select(DOC, richtext.block_html(richtext.parse(F.col("node"))).alias("html"))


DELTA_LINES = f"""SELECT conv_id AS doc_id, '<h2>Talk ' || conv_id || '</h2>' || chr(10) || '<ol>' || chr(10) || string_agg('<li>' || CASE WHEN role = 'user' THEN '<strong>' || {escq('t')} || '</strong>' ELSE {escq('t')} END || '</li>' || chr(10), '' ORDER BY turn)
 || '</ol>' || chr(10) || '<ul>' || chr(10) || '<li><input type="checkbox" checked>done</li>' || chr(10) || '</ul>' || chr(10) || '<p><img src="http://x/i.png"><a href="http://x/">l</a></p>' || chr(10) AS html
 FROM (SELECT *, {FLAT} AS t FROM conversations) GROUP BY conv_id"""


@query("rt6_delta", DELTA_LINES)
def _(spark, sf):
    """Conversations as delta documents: a header, one list line per turn, a checkbox, an image and a link."""
    talk = table(spark, sf, "conversations").withColumn("t", flat())
    turn = F.array(F.struct(F.col("t").alias("insert"), F.when(F.col("role") == "user", '{"bold":true}').alias("attributes")),
                   F.struct(F.lit("\n").alias("insert"), F.lit('{"list":"ordered"}').alias("attributes")))
    lines = talk.select(F.col("conv_id").alias(DOC), ((F.col("turn") + 1) * 10).alias("base"), F.posexplode(turn).alias("k", "op"))
    body = lines.select(DOC, (F.col("base") + F.col("k")).alias("seq"), "op.insert", "op.attributes")
    frame = F.array(F.struct(F.lit(0).alias("seq"), F.concat(F.lit("Talk "), DOC).alias("insert"), F.lit(None).cast("string").alias("attributes")),
                    F.struct(F.lit(1).alias("seq"), F.lit("\n").alias("insert"), F.lit('{"header":2}').alias("attributes")),
                    F.struct(F.lit(100000).alias("seq"), F.lit("\ndone").alias("insert"), F.lit(None).cast("string").alias("attributes")),
                    F.struct(F.lit(100001).alias("seq"), F.lit("\n").alias("insert"), F.lit('{"list":"bullet","checked":true}').alias("attributes")),
                    F.struct(F.lit(100002).alias("seq"), F.lit('{"image":"http://x/i.png"}').alias("insert"), F.lit(None).cast("string").alias("attributes")),
                    F.struct(F.lit(100003).alias("seq"), F.lit("l").alias("insert"), F.lit('{"link":"http://x/"}').alias("attributes")))
    ends = talk.select(F.col("conv_id").alias(DOC)).distinct().select(DOC, F.explode(frame).alias("o")).select(DOC, "o.*")
    return richtext.delta_to_html(body.unionByName(ends))


@query("rt7_block_inline", f"""SELECT doc_id, '<a href="http://x/?a&amp;b"><i><b>' || {E} || '</b></i></a> plain<mark>' || {escq('source')} || '</mark>' AS html FROM documents""")
def _(spark, sf):
    head = F.to_json(F.array(F.col("text")))
    prop = F.concat(F.lit("["), F.regexp_replace(head, r"\]\z", ""), F.lit(',[["b"],["i"],["a","http://x/?a&b"]]],[" plain"],["'), "source", F.lit('",[["h"]]]]'))
    return table(spark, sf, "documents").select(DOC, blocks.rich_text(prop).alias("html"))


def block_table(spark, sf) -> tuple[DataFrame, DataFrame]:
    found = src.block_records(conversation_dumps(spark, sf))
    roots = found.where("type = 'page'").select("page_id", "block_id")
    return found.drop("page_id"), roots


@query("rt8_block_tree", """SELECT cast(conv_id AS varchar) AS page_id, 'b-' || conv_id || '-' || turn AS block_id, cast(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS varchar) AS path FROM conversations
 UNION ALL SELECT DISTINCT cast(conv_id AS varchar), 'root-' || conv_id, '' FROM conversations
 UNION ALL SELECT 'deep-' || conv_id, 'd-' || i || '-' || conv_id, rtrim(repeat('0/', i), '/') FROM (SELECT DISTINCT conv_id FROM conversations), (SELECT unnest(range(30)) AS i)
 UNION ALL SELECT DISTINCT 'deep-' || conv_id, 'shared', '1' FROM conversations""")
def _(spark, sf):
    """Besides the conversations: chains of 30 levels that end in a circle, with one block shared by all levels and held by two dumps."""
    found, roots = block_table(spark, sf)
    ids = table(spark, sf, "conversations").select("conv_id").distinct().select("conv_id", F.explode(F.sequence(F.lit(0), F.lit(29))).alias("i"))
    name = lambda i: F.concat(F.lit("d-"), i.cast("string"), F.lit("-"), "conv_id")
    blank = F.lit(None).cast("string")
    chain = ids.select(name(F.col("i")).alias("block_id"), F.lit("text").alias("type"), blank.alias("properties"), blank.alias("format"),
                       F.array(name(F.when(F.col("i") < 29, F.col("i") + 1).otherwise(F.lit(0))), F.lit("shared")).alias("content"))
    none = F.array().cast("array<string>")
    shared = spark.range(2).select(F.lit("shared").alias("block_id"), F.lit("text").alias("type"), blank.alias("properties"), blank.alias("format"), none.alias("content"))
    found = found.unionByName(chain).unionByName(shared)
    roots = roots.unionByName(ids.where("i = 0").select(F.concat(F.lit("deep-"), "conv_id").alias("page_id"), name(F.col("i")).alias("block_id")))
    return blocks.tree(found, roots).select("page_id", "block_id", F.array_join(F.col("path").cast("array<string>"), "/").alias("path"))


BLOCK_SQL = """SELECT cast(conv_id AS varchar) AS page_id, string_agg(CASE WHEN role = 'user' THEN CASE WHEN prev = 'user' THEN '' ELSE '<ul>' || chr(10) END || '<li>' || e || '</li>' || chr(10) || CASE WHEN nxt = 'user' THEN '' ELSE '</ul>' || chr(10) END
 WHEN text = '' THEN '' ELSE '<p>' || e || '</p>' || chr(10) END, '' ORDER BY turn) AS html FROM (SELECT *, """ + escq("text") + """ AS e, coalesce(lag(role) OVER w, '') AS prev, coalesce(lead(role) OVER w, '') AS nxt
 FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) GROUP BY conv_id"""


@query("rt9_block_html", BLOCK_SQL)
def _(spark, sf):
    return blocks.to_html(*block_table(spark, sf))


@query("rt10_block_lists", "SELECT cast(conv_id AS varchar) AS page_id, count(*) FILTER (role = 'user' AND prev <> 'user') AS lists FROM (SELECT *, coalesce(lag(role) OVER (PARTITION BY conv_id ORDER BY turn), '') AS prev FROM conversations) GROUP BY conv_id")
def _(spark, sf):
    found, roots = block_table(spark, sf)
    html = blocks.to_html(found, roots)
    return html.select("page_id", F.size(F.regexp_extract_all("html", F.lit("<ul>\n<li>"), F.lit(0))).alias("lists"))


@query("rt11_block_tables", """SELECT cast(o_orderkey AS varchar) AS page_id, '<table>' || chr(10) || '<tr><th>' || o_orderpriority || '</th><th>' || o_orderstatus || '</th></tr>' || chr(10) || '<tr><td>' || o_custkey || '</td><td><b>x</b></td></tr>' || chr(10) || '</table>' || chr(10) AS html FROM orders""")
def _(spark, sf):
    """Every order as a page holding one native table with a header row."""
    o = table(spark, sf, "orders").withColumn("id", F.col("o_orderkey").cast("string"))
    cell = lambda c: F.concat(F.lit('[["'), c, F.lit('"]]'))
    none = F.array().cast("array<string>")

    def record(prefix, kind, properties, format_, content):
        return F.struct(F.concat(F.lit(prefix), "id").alias("block_id"), F.lit(kind).alias("type"), properties.alias("properties"),
                        F.lit(format_).alias("format"), content.alias("content"))

    rows = F.array(*[F.concat(F.lit(x), "id") for x in ["r1-", "r2-", "gone-"]])
    first = F.concat(F.lit('{"z":'), cell(F.col("o_orderpriority")), F.lit(',"a":'), cell(F.col("o_orderstatus")), F.lit("}"))
    second = F.concat(F.lit('{"z":'), cell(F.col("o_custkey").cast("string")), F.lit(',"a":[["x",[["b"]]]]}'))
    rec = F.array(record("p", "page", F.lit("{}"), "{}", F.array(F.concat(F.lit("t"), "id"))),
                  record("t", "table", F.lit("{}"), '{"table_block_column_header":true}', rows),
                  record("r1-", "table_row", first, "{}", none), record("r2-", "table_row", second, "{}", none))
    made = o.select("id", F.explode(rec).alias("b")).select("id", "b.*")
    return blocks.to_html(made.drop("id"), made.where("type = 'page'").select(F.col("id").alias("page_id"), "block_id"))


@query("rt12_embedded_markdown", "SELECT doc_id, '> **tip**:' || chr(10) || 'x' || source || chr(10) || chr(10) || '![i](http://x/' || doc_id || '.png)' AS md FROM documents")
def _(spark, sf):
    md = F.concat(F.lit(":::tip\n<span id=\"a\"></span>x"), "source", F.lit("\n:::\n![i](http://x/"), F.col(DOC).cast("string"), F.lit(".png =98x)\n  `}\n></RenderMd> tail "), "text")
    return table(spark, sf, "documents").select(DOC, mt.clean_embedded_markdown(md).alias("md"))


@query("rt13_async_markdown", r"""SELECT doc_id, regexp_replace('> 公众号：**' || source || '**' || chr(10) || '> sig' || chr(10) || chr(10) || md, '\s+$', '') AS md FROM
 (SELECT doc_id, any_value(source) AS source, string_agg(trim(line, ' ' || chr(9) || chr(13)), chr(10) ORDER BY i) AS md FROM (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents) GROUP BY doc_id)""")
def _(spark, sf):
    info = F.struct(F.col("source").alias("nick_name"), F.lit("sig").alias("signature"), F.col("text").alias("content"))
    return table(spark, sf, "documents").select(DOC, embedded.async_markdown(info).alias("md"))


# --- clean-up -------------------------------------------------------------------------------------------------

TIDY = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace({0}, '\n{{3,}}', chr(10) || chr(10), 'g'), '\n[ \t]+\n', chr(10) || chr(10), 'g'), '^\s+', ''), '\s+$', '')"


@query("cln1_messenger_noise", "SELECT doc_id, " + TIDY.format("'a' || chr(10) || chr(10) || text || chr(10) || chr(10) || chr(10) || 'Cancel the order'") + " AS md FROM documents")
def _(spark, sf):
    md = "'a' || chr(10) || ' Video, Mini Program ,Like' || chr(10) || text || chr(10) || '[Allow](javascript:x)' || chr(10) || '阅读原文' || chr(10) || 'Cancel the order' || chr(10) || 'CANCEL'"
    return derived(spark, sf, "documents", md=md).select(DOC, mt.drop_messenger_noise(F.col("md")).alias("md"))


@query("cln2_wiki_noise", "SELECT doc_id, " + TIDY.format("'A ' || text || chr(10) || ' [keep](b)'") + " AS md FROM documents")
def _(spark, sf):
    md = "'A [[Edit](x?cmd=edit)]' || text || chr(10) || '[History](h)[^](#n) [Top](#t)[?](p?action=edit)[keep](b)'"
    d = derived(spark, sf, "documents", md=md).withColumn("md", F.concat(F.lit("A [[Edit](x?cmd=edit)]"), F.col("text"), F.lit("\n[History](h)[^](#n) [Top](#t)[?](p?action=edit)[keep](b)")))
    return d.select(DOC, mt.drop_wiki_noise(F.col("md")).alias("md"))


LIST = "repeat('- [' || source || '](http://x.org/' || cast(doc_id AS varchar(20)) || ')' || chr(10), cast(doc_id % 30 AS int))"


@query("cln3_anchor_lists", f"""SELECT doc_id, CASE WHEN doc_id % 30 >= 20 THEN 1 ELSE 0 END AS lists, CASE WHEN doc_id % 30 >= 20 THEN doc_id % 30 ELSE 0 END AS lines,
 regexp_replace(CASE WHEN doc_id % 30 >= 20 THEN '' ELSE {LIST} END || 'after' || chr(10) || text, '\\n{{4,}}', chr(10) || chr(10) || chr(10), 'g') AS md FROM documents""")
def _(spark, sf):
    r = mt.drop_anchor_lists(F.col("md"), 20)
    return derived(spark, sf, "documents", md=LIST + " || 'after' || chr(10) || text").select(DOC, r.alias("r")).select(DOC, "r.lists", "r.lines", "r.md")


@query("cln4_redact_url", "SELECT page_id, regexp_extract(url, '^([^?#]*)', 1) AS redacted, 'http://h.org:8080/p' AS odd FROM pages")
def _(spark, sf):
    from pagemill.functions import urls
    odd = F.concat(F.lit("http://u"), "page_id", F.lit(":pw@H.org:8080/p?x#y"))
    return table(spark, sf, "pages").select("page_id", urls.redact(F.col("url")).alias("redacted"), urls.redact(odd).alias("odd"))


@query("cln5_redact_markdown", "SELECT page_id, '[a](' || r || ') ![b](<' || r || '> \"t\") <img src=\"' || r || '\"> ' || url AS md FROM (SELECT page_id, url, regexp_extract(url, '^([^?#]*)', 1) AS r FROM pages)")
def _(spark, sf):
    md = "'[a](' || url || ') ![b]( <' || url || '> \"t\" ) <img src=\"' || url || '\"> ' || url"
    return derived(spark, sf, "pages", md=md).select("page_id", mt.redact_destinations(F.col("md")).alias("md"))


@query("cln8_absolute_images", "SELECT doc_id, '![a](http://h.org/x/' || doc_id || '.png) ' || text || ' ![b](http://h.org/d/rel.png \"T t\") ![c](https://o.org/c.png =5x) ![d](data:x)' AS md FROM documents")
def _(spark, sf):
    md = "'![a](/x/' || cast(doc_id AS varchar(20)) || '.png =10x20) ' || text || ' ![b](rel.png \"T t\") ![c](https://o.org/c.png =5x) ![d](data:x)'"
    return derived(spark, sf, "documents", md=md).select(DOC, mt.absolute_images(F.col("md"), F.lit("http://h.org/d/p")).alias("md"))


@query("cln9_shared_assets", "SELECT doc_id, '![a](../shared/' || doc_id || '.png) <img alt=\"\" src=\"../shared/b.png\"> ' || text AS md FROM documents")
def _(spark, sf):
    md = "'![a](page.assets/' || cast(doc_id AS varchar(20)) || '.png) <img alt=\"\" src=\"page.assets/b.png\"> ' || text"
    return derived(spark, sf, "documents", md=md).select(DOC, mt.shared_asset_paths(F.col("md"), "../shared").alias("md"))
