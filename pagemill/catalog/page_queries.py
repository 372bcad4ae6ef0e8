"""Queries over pages: sources, classification, extraction."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.catalog.base import ESC, FLAT, H1, ORIGIN, TITLE, TOKENS, UNESC, derived, escq, flat, query, table
from pagemill.functions import binary, markdown_text as mt, urls
from pagemill.operators import classify, embedded, links, regions, titles, tokens as tk
from pagemill.plans.page_job import PageOptions, page_results
from pagemill.sources import pages as src


def pages(spark, sf) -> DataFrame:
    return table(spark, sf, "pages")


# --- sources --------------------------------------------------------------------------------------------------

@query("src1_page_scan", "SELECT page_id, url, length(html) AS n_chars FROM pages")
def _(spark, sf):
    return src.read_pages(spark, f"{sf}/pages.parquet").select("page_id", "url", F.length("html").alias("n_chars"))


LINE = ("CASE page_id % 5 WHEN 0 THEN '# ' || url WHEN 1 THEN url WHEN 2 THEN '  ' || url || ' | Page ' || cast(page_id AS varchar(20)) || ' | x '"
        " WHEN 3 THEN 'ftp' || url ELSE '   ' END")


@query("src2_url_list", """
SELECT page_id AS line_no, url, CASE WHEN page_id % 5 = 2 THEN 'Page ' || page_id || ' | x' END AS title, 'ok' AS status FROM pages WHERE page_id % 5 IN (1, 2)
UNION ALL SELECT page_id, 'ftp' || url, NULL, 'rejected' FROM pages WHERE page_id % 5 = 3""")
def _(spark, sf):
    ok, rejected = src.url_list(derived(spark, sf, "pages", line=LINE).select("line", F.col("page_id").alias("line_no")))
    return ok.withColumn("status", F.lit("ok")).unionByName(
        rejected.withColumns({"title": F.lit(None).cast("string"), "status": F.lit("rejected")}))


# Letters a to z, and what all further characters of a page become, in each set; the first two keep the page as it is.
LETTERS = "abcdefghijklmnopqrstuvwxyz"
SETS = {"utf-8": None, "windows-1252": None, "iso-8859-2": "ąćčďęěśŁłňőřšťůźžŽ˝ß×÷äöüýé", "koi8-r": "абвгдежзийклмнопрстуфхцчшщыё", "windows-1251": "юяьэђѓєљњќўџ№«»–—“”…€абвгдЖ",
        "gbk": "的一是在不了有和人这中大为上个国我以要他时来用们生到作", "Shift_JIS": "あいうえおかきくけこ日本語漢字表示ｱｲｳァイウ十予構能", "euc-kr": "가나다라마바사아자차카타파하각간날말밤삽앙정책켜틀품힝"}


def set_text(name: str, every: str = "", html: str = "html") -> str:
    """SQL of a page's text in the letters of a set; ``every``: the flag for all matches, where one is needed."""
    if SETS[name] is None:
        return html if name == "utf-8" else f"replace(regexp_replace({html}, '[^\t\n\r -~äöüßéèêçñíóáúÉÈÊÇÑ]', '€'{every}), '$', '“')"
    return f"regexp_replace(translate({html}, '{LETTERS}', '{SETS[name][:26]}'), '[^\t\n\r -~{SETS[name]}]', '{SETS[name][26]}'{every})"


@query("src3_saved_html", "SELECT page_id, CASE page_id % 8 " + " ".join(
    f"WHEN {k} THEN '<meta charset={name}>' || {set_text(name, chr(44) + chr(39) + 'g' + chr(39))}" for k, name in enumerate(SETS)) + " END AS html FROM pages")
def _(spark, sf):
    """Whole pages in eight character sets. The bytes are spelled out, since Spark has no encoder for most sets."""
    def written(name: str) -> str:
        text = set_text(name)
        for c in dict.fromkeys(SETS[name] or "äöüßéèêçñíóáúÉÈÊÇÑ€“"):
            text = f"replace({text}, '{c}', decode(unhex('{c.encode(name).hex()}'), 'ISO-8859-1'))"
        return f"encode('<meta charset={name}>' || {text}, 'ISO-8859-1')"
    raw = F.expr("CASE page_id % 8 " + " ".join(f"WHEN {k} THEN " + (written(name) if name != "utf-8" else "encode('<meta charset=utf-8>' || html, 'UTF-8')") for k, name in enumerate(SETS)) + " END")
    return pages(spark, sf).select("page_id", raw.alias("content")).select("page_id", binary.decode_page(F.col("content")).alias("html"))


@query("src4_declared_charset", """
SELECT page_id, CASE page_id % 5 WHEN 0 THEN 'Shift_JIS' WHEN 1 THEN 'GB2312' WHEN 2 THEN NULL WHEN 3 THEN 'ISO-8859-1' ELSE 'UTF-8' END AS charset FROM pages""")
def _(spark, sf):
    head = ("CASE page_id % 5 WHEN 0 THEN '<meta charset = \"sjis\">' WHEN 1 THEN '<META http-equiv=\"Content-Type\" content=\"text/html; charset=GB2312\">'"
            " WHEN 2 THEN '<meta charset=\"no-such-set\">' WHEN 3 THEN '<meta name=x charset=latin1 />' ELSE '' END")
    raw = derived(spark, sf, "pages", head=head)
    return raw.select("page_id", binary.declared_charset(F.encode(F.concat("head", "html"), "UTF-8")).alias("charset"))


@query("src5_size_guard", "SELECT page_id, CASE WHEN page_id % 9 = 4 THEN 'no html' WHEN strlen(html) > 3000 THEN 'html too large' END AS error FROM pages")
def _(spark, sf):
    return derived(spark, sf, "pages", html="CASE WHEN page_id % 9 <> 4 THEN html END").select("page_id", src.size_error(F.col("html"), 3000).alias("error"))


def conversation_dumps(spark, sf) -> DataFrame:
    """One saved record map per conversation: the page block, its turns, each with its text."""
    talk = table(spark, sf, "conversations").withColumn("bid", F.concat_ws("-", F.lit("b"), "conv_id", "turn"))
    props = F.to_json(F.struct(F.array(F.array("text")).alias("title")))
    value = F.concat(F.lit('{"value":{"type":"'), F.when(F.col("role") == "user", "bulleted_list").otherwise("text"), F.lit('","properties":'), props, F.lit("}}"))
    per = talk.withColumn("entry", F.concat(F.lit('"'), "bid", F.lit('":'), value))
    return per.groupBy("conv_id").agg(
        F.expr("listagg(entry, ',') WITHIN GROUP (ORDER BY turn)").alias("entries"),
        F.expr("listagg('\"' || bid || '\"', ',') WITHIN GROUP (ORDER BY turn)").alias("ids")).select(
        F.col("conv_id").cast("string").alias("page_id"), F.concat(
            F.lit('{"recordMap":{"block":{"bad":7,"empty":{"value":{}},"root-'), "conv_id", F.lit('":{"value":{"type":"page","properties":{"title":[["Talk"]]},"content":['),
            "ids", F.lit("]}},"), "entries", F.lit("}}}")).alias("json"))


@query("src6_block_records", """
SELECT cast(conv_id AS varchar) AS page_id, 'b-' || conv_id || '-' || turn AS block_id, CASE WHEN role = 'user' THEN 'bulleted_list' ELSE 'text' END AS type,
  text AS title, 0 AS children FROM conversations
UNION ALL SELECT cast(conv_id AS varchar), 'root-' || conv_id, 'page', 'Talk', count(*) FROM conversations GROUP BY conv_id""")
def _(spark, sf):
    from pagemill.operators import blocks
    found = src.block_records(conversation_dumps(spark, sf))
    return found.select("page_id", "block_id", "type", blocks.plain_text(F.get_json_object("properties", "$.title")).alias("title"),
                        F.size("content").alias("children"))


# --- classification -------------------------------------------------------------------------------------------

CHALLENGE = ("CASE page_id % 6 WHEN 0 THEN html WHEN 1 THEN '<title>Just a Moment...</title>' || html WHEN 2 THEN html || '<script>window.__cf_chl_opt={}</script>'"
             " WHEN 3 THEN '<html><body><p>Please enable JavaScript</p></body></html>' WHEN 4 THEN html || '<noscript>Enable scripts</noscript>'"
             " ELSE '<title>Weekly Challenge 314</title>' || html END")
CHALLENGE_RESULT = """CASE page_id % 6 WHEN 1 THEN 'title: just a moment' WHEN 2 THEN 'cloudflare marker'
  WHEN 3 THEN 'please enable script|short text (24): javascript, enable' WHEN 4 THEN 'noscript warning' ELSE '' END"""
CONFIDENCE = "CASE page_id % 6 WHEN 0 THEN 'none' WHEN 5 THEN 'none' WHEN 4 THEN 'medium' ELSE 'high' END"


@query("cls1_challenge", f"SELECT page_id, page_id % 6 NOT IN (0, 5) AS is_challenge, {CONFIDENCE} AS confidence, {CHALLENGE_RESULT} AS signals FROM pages")
def _(spark, sf):
    c = classify.challenge(F.col("html"))
    return derived(spark, sf, "pages", html=CHALLENGE).select("page_id", c.alias("c")).select(
        "page_id", "c.is_challenge", "c.confidence", F.array_join("c.signals", "|").alias("signals"))


WEAK = "CASE page_id % 3 WHEN 0 THEN html WHEN 1 THEN 'Please WAIT' || html ELSE html || ' please wait' END"


@query("cls2_weak_challenge", f"""SELECT page_id, contains(lower(h), 'please wait') OR contains(lower(h), 'cloudflare') AS weak,
 length(h) < 15000 AND (contains(lower(substring(h, 1, 4000)), 'please wait') OR contains(lower(substring(h, 1, 4000)), 'cloudflare')) AS bounded FROM (SELECT page_id, {WEAK} AS h FROM pages)""")
def _(spark, sf):
    return derived(spark, sf, "pages", h=WEAK).select("page_id", classify.weak_challenge(F.col("h")).alias("weak"), classify.weak_challenge(F.col("h"), 4000, 15000).alias("bounded"))


@query("cls3_challenge_gate", f"""SELECT page_id, CASE WHEN page_id % 6 NOT IN (0, 5) AND page_id % 2 <> 0 THEN 'challenge page, confidence ' || {CONFIDENCE} END AS error FROM pages""")
def _(spark, sf):
    p = derived(spark, sf, "pages", html=CHALLENGE)
    return p.select("page_id", classify.gate_error(classify.challenge(F.col("html")), F.col("page_id") % 2 == 0).alias("error"))


WX_URL = ("CASE page_id % 4 WHEN 0 THEN 'https://mp.weixin.qq.com/s/' || url WHEN 1 THEN 'http://weixin.qq.com/x' WHEN 2 THEN 'https://mp.weixin.qq.com:443/s' ELSE url END")


@query("cls4_messenger_url", "SELECT page_id, page_id % 4 IN (0, 1) AS hit FROM pages")
def _(spark, sf):
    return derived(spark, sf, "pages", u=WX_URL).select("page_id", classify.is_messenger_url(F.col("u")).alias("hit"))


@query("cls5_messenger_markup", "SELECT page_id, page_id % 3 <> 0 AS hit FROM pages")
def _(spark, sf):
    h = "CASE page_id % 3 WHEN 0 THEN html WHEN 1 THEN html || '<div DATA-MPTYPE=\"Article\">' ELSE '<script>var biz = 1</script>' || html END"
    return derived(spark, sf, "pages", h=h).select("page_id", classify.is_messenger_html(F.col("h")).alias("hit"))


@query("cls6_async_article", "SELECT page_id, page_id % 6 IN (1, 2, 3) AS hit FROM pages")
def _(spark, sf):
    h = ("CASE page_id % 6 WHEN 0 THEN html WHEN 1 THEN html || '<script>window.cgiDataNew={is_async: 1}</script>' WHEN 2 THEN '<script>window.cgiDataNew={is_async:\"1\"}</script>'"
         " WHEN 3 THEN '<script>window.cgiDataNew={is_async : ' || chr(39) || '1' || chr(39) || '}</script>' WHEN 4 THEN '<script>window.cgiDataNew={is_async: 0}</script>'"
         " ELSE '<script>window.cgiDataNew={is_async: 1}</script><div id=\"js_content\">' END")
    return derived(spark, sf, "pages", h=h).select("page_id", classify.is_async_article(F.col("h")).alias("hit"))


WS_URL = ("CASE page_id % 5 WHEN 0 THEN 'https://www.notion.so/My-Page-' || md5(url) || '?v=1' WHEN 1 THEN 'https://team-x.notion.site/' || md5(url) || '/'"
          " WHEN 2 THEN 'https://notion.so/' WHEN 3 THEN 'https://notion.example.com/' || md5(url) ELSE 'https://www.notion.so/short-id' END")
DASHED = "substr(md5(url),1,8)||'-'||substr(md5(url),9,4)||'-'||substr(md5(url),13,4)||'-'||substr(md5(url),17,4)||'-'||substr(md5(url),21,12)"


@query("cls7_workspace_url", "SELECT page_id, page_id % 5 IN (0, 1) AS hit FROM pages")
def _(spark, sf):
    return derived(spark, sf, "pages", u=WS_URL).select("page_id", classify.is_workspace_url(F.col("u")).alias("hit"))


@query("cls8_workspace_page_id", f"SELECT page_id, CASE WHEN page_id % 5 IN (0, 1, 3) THEN {DASHED} END AS block_id FROM pages")
def _(spark, sf):
    return derived(spark, sf, "pages", u=WS_URL).select("page_id", classify.workspace_page_id(F.col("u")).alias("block_id"))


DOCS_HTML = ("CASE page_id % 6 WHEN 0 THEN html WHEN 1 THEN '<meta name=\"generator\" content=\"Docusaurus v3\"><div class=\"theme-doc-markdown\">' || html"
             " WHEN 2 THEN '<!-- built with MkDocs -->' || html WHEN 3 THEN '<div class=\"rst-content wy-nav-content\">Read the Docs sphinx</div>' || html"
             " WHEN 4 THEN '<a href=\"https://app.gitbook.com\">x</a><div class=' || chr(39) || 'gb-root' || chr(39) || '>' || html ELSE '<div class=\"wiki-content\">' || html END")


def _signal_values() -> str:
    rows = []
    for rank, p in enumerate(classify.PRESETS):
        rows += [(rank, p["name"], "pattern", s, 30) for s in p["patterns"]] + [(rank, p["name"], "class", s, 25) for s in p["classes"]]
        rows += [(rank, p["name"], "meta", s, 35) for s in p["meta"]]
    return ", ".join(f"({r}, '{n}', '{k}', '{s}', {w})" for r, n, k, s, w in rows)


FRAMEWORK_SQL = f"""WITH h AS (SELECT page_id, {DOCS_HTML} AS h FROM pages), s(rank, preset, kind, val, w) AS (VALUES {_signal_values()}),
scored AS (SELECT page_id, rank, preset, least(100, sum(w)) AS score FROM h JOIN s ON
  (kind = 'pattern' AND contains(lower(h), lower(val))) OR (kind = 'class' AND (contains(h, 'class="' || val || '"') OR contains(h, 'class=''' || val || '''') OR contains(h, ' ' || val)))
  OR (kind = 'meta' AND regexp_matches(h, '(?i)' || val)) GROUP BY ALL),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY score DESC, rank) = 1)
SELECT p.page_id, CASE WHEN score >= 20 THEN preset END AS framework, CASE WHEN score >= 20 THEN score / 100.0 ELSE 0.0 END::DOUBLE AS score,
 CASE WHEN score >= 60 THEN preset END AS applied FROM pages p LEFT JOIN best USING (page_id)"""


@query("cls9_docs_framework", f"SELECT page_id, framework, score FROM ({FRAMEWORK_SQL})")
def _(spark, sf):
    f = classify.framework(F.col("h"))
    return derived(spark, sf, "pages", h=DOCS_HTML).select("page_id", f.alias("f")).select("page_id", F.col("f.name").alias("framework"), F.col("f.score").alias("score"))


@query("cls10_auto_apply", f"SELECT page_id, applied FROM ({FRAMEWORK_SQL})")
def _(spark, sf):
    return derived(spark, sf, "pages", h=DOCS_HTML).select("page_id", classify.applied_preset(classify.framework(F.col("h"))).alias("applied"))


PRESET_NAME = "CASE page_id % 4 WHEN 0 THEN 'MkDocs' WHEN 1 THEN 'generic' WHEN 2 THEN 'mintlify' ELSE 'none' END"


@query("cls11_preset_lookup", """SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'content' WHEN 1 THEN 'content,main-content,main' WHEN 2 THEN 'content-area' END AS target_ids,
 CASE page_id % 4 WHEN 0 THEN '.md-sidebar,.md-nav,.md-footer,.md-header,nav' WHEN 1 THEN 'nav,aside,.sidebar,.navigation,.toc,.table-of-contents'
 WHEN 2 THEN 'nav,aside,.sidebar,.on-this-page,.page-navigation,[data-testid=''sidebar'']' END AS exclude FROM pages""")
def _(spark, sf):
    p = derived(spark, sf, "pages", preset=PRESET_NAME).select("page_id", "preset")
    return classify.with_preset_options(p).select("page_id", F.array_join("target_ids", ",").alias("target_ids"), F.array_join("exclude", ",").alias("exclude"))


ICON_URL = "CASE page_id % 5 WHEN 0 THEN url || '/FavIcon.png' WHEN 1 THEN 'https://x.org/icon/a.png' WHEN 2 THEN 'https://x.org/a.ICO' WHEN 3 THEN url ELSE 'https://x.org/icons/b.png' END"


@query("cls12_icon", "SELECT page_id, page_id % 5 IN (0, 1, 2) AS icon FROM pages")
def _(spark, sf):
    return derived(spark, sf, "pages", u=ICON_URL).select("page_id", urls.is_icon(F.col("u")).alias("icon"))


HREF = ("CASE page_id % 5 WHEN 0 THEN 'java' || chr(9) || 'script:alert(1)' WHEN 1 THEN ' DATA:text/html,x' WHEN 2 THEN url WHEN 3 THEN '/javascript:x' ELSE 'file:///etc' END")


@query("cls13_unsafe_link", "SELECT page_id, page_id % 5 IN (0, 1, 4) AS unsafe FROM pages")
def _(spark, sf):
    return derived(spark, sf, "pages", h=HREF).select("page_id", urls.is_unsafe_link(F.col("h")).alias("unsafe"))


@query("cls14_visible_length", f"""WITH {TOKENS} SELECT page_id, cast(sum(CASE WHEN kind = 'text' THEN
 length(trim(regexp_replace({UNESC.format('tok')}, '\\s+', ' ', 'g'))) ELSE 0 END) AS BIGINT) AS text_len,
 sum(CASE WHEN kind = 'text' THEN length(trim(regexp_replace({UNESC.format('tok')}, '\\s+', ' ', 'g'))) ELSE 0 END) < 500 AS thin FROM tok GROUP BY page_id""")
def _(spark, sf):
    n = pages(spark, sf).select("page_id", tk.visible_length(F.col("html")).alias("text_len"))
    return n.withColumn("thin", classify.client_rendered(F.col("text_len")))


LINKED = "repeat('- [' || source || '](http://x.org/' || cast(doc_id AS varchar(20)) || ')' || chr(10), cast(doc_id % 15 AS int)) || text"


@query("cls15_link_density", f"""SELECT doc_id, len(l) AS links, length(md) AS chars, round(list_sum(list_transform(l, lambda x: length(x)))::DOUBLE / length(md), 6) AS density FROM
 (SELECT doc_id, md, regexp_extract_all(md, '\\[[^\\]]+\\]\\([^)]+\\)') AS l FROM (SELECT doc_id, {LINKED} AS md FROM documents)) WHERE len(l) > 0
 UNION ALL SELECT doc_id, 0, length(md), 0.0 FROM (SELECT doc_id, {LINKED} AS md FROM documents) WHERE len(regexp_extract_all(md, '\\[[^\\]]+\\]\\([^)]+\\)')) = 0""")
def _(spark, sf):
    d = mt.link_density(F.col("md"))
    return derived(spark, sf, "documents", md=LINKED).select("doc_id", d.alias("d")).select(
        "doc_id", "d.links", "d.chars", F.round("d.density", 6).alias("density"))


@query("cls16_quality_warnings", f"""SELECT doc_id, concat_ws('|', CASE WHEN list_sum(list_transform(l, lambda x: length(x))) * 1.0 / length(md) > 0.5 THEN 'link_density' END,
 CASE WHEN doc_id % 15 >= 10 THEN 'link_list_blocks:1' END) AS warnings FROM
 (SELECT doc_id, md, regexp_extract_all(md, '\\[[^\\]]+\\]\\([^)]+\\)') AS l FROM (SELECT doc_id, {LINKED} AS md FROM documents))""")
def _(spark, sf):
    return derived(spark, sf, "documents", md=LINKED).select("doc_id", F.array_join(mt.quality_warnings(F.col("md")), "|").alias("warnings"))


BODY = "CASE doc_id % 3 WHEN 0 THEN chr(10) || '  ' WHEN 1 THEN source ELSE text END"


@query("cls17_body_gate", f"""SELECT doc_id, CASE WHEN n = 0 THEN 'empty' WHEN n < 50 THEN 'short' END AS gate FROM
 (SELECT doc_id, length(regexp_replace(regexp_replace({BODY}, '^\\s+', ''), '\\s+$', '')) AS n FROM documents)""")
def _(spark, sf):
    return derived(spark, sf, "documents", md=BODY).select("doc_id", classify.body_gate(F.col("md")).alias("gate"))


@query("cls18_page_errors", f"""SELECT page_id, page_id % 6 IN (0, 5) AND page_id % 10 NOT IN (3, 7) AS success, CASE WHEN page_id % 10 = 3 THEN 'no html' WHEN page_id % 10 = 7 THEN 'html too large'
 WHEN page_id % 6 NOT IN (0, 5) THEN 'challenge page, confidence ' || {CONFIDENCE} END AS error FROM pages""")
def _(spark, sf):
    p = derived(spark, sf, "pages", html=CHALLENGE)
    odd = F.when(F.col("page_id") % 10 == 3, F.lit(None)).when(F.col("page_id") % 10 == 7, F.concat("html", F.repeat(F.lit("<!-- long -->"), F.lit(20_000)))).otherwise(F.col("html"))
    return page_results(p.select("page_id", "url", odd.alias("html")), PageOptions(embedded_articles=False, max_html_bytes=200_000)).select("page_id", "success", "error")


# --- extraction -----------------------------------------------------------------------------------------------

@query("ext1_tokens", f"WITH {TOKENS} SELECT page_id, pos, tok, kind, name FROM tok")
def _(spark, sf):
    return tk.tokens(pages(spark, sf)).select("page_id", "pos", "tok", "kind", "name")


@query("ext2_depth", f"WITH {TOKENS} SELECT page_id, pos, cast(depth AS BIGINT) AS depth FROM deep")
def _(spark, sf):
    return tk.with_depth(tk.tokens(pages(spark, sf))).select("page_id", "pos", "depth")


TWO_ARTICLES = "'<article>' || url || '</article>' || html || '<main>' || html || '</main>'"


@query("ext3_main_html", f"""SELECT page_id, max_by(s, length(s) * 1000 - i) AS main_html FROM (SELECT page_id, unnest(l) AS s, generate_subscripts(l, 1) AS i FROM
 (SELECT page_id, regexp_extract_all({TWO_ARTICLES}, '(?is)<article\\b[^>]*>(.*?)</article>', 1) AS l FROM pages)) GROUP BY page_id""")
def _(spark, sf):
    return derived(spark, sf, "pages", h=TWO_ARTICLES).select("page_id", titles.main_html(F.col("h")).alias("main_html"))


CANON_AD = ESC.format(UNESC.format("regexp_extract(html, '<div class=\"ad\">([^<]*)</div>', 1)"))


@query("ext4_target_section", f"SELECT page_id, '<div class=\"ad\">' || {CANON_AD} || '</div>' AS html FROM pages")
def _(spark, sf):
    return regions.target_sections(pages(spark, sf), [("class", "ad")]).select("page_id", "html")


NAV_ID = "CASE WHEN page_id % 2 = 0 THEN replace(html, '<nav>', '<nav id=\"content\">') ELSE html END"


@query("ext5_target_priority", f"""SELECT page_id, CASE WHEN page_id % 2 = 0 THEN '<nav id="content">' || regexp_extract(html, '(?s)<nav>(.*?)</nav>', 1) || '</nav>'
 ELSE '<div class="ad">' || {CANON_AD} || '</div>' END AS html, CASE WHEN page_id % 2 = 0 THEN 'id=content' ELSE 'class=ad' END AS selector FROM pages""")
def _(spark, sf):
    p = derived(spark, sf, "pages", html=NAV_ID)
    return regions.target_sections(p, [("id", "main"), ("id", "content"), ("class", "prose"), ("class", "ad")])


MATCHES = {"nav": "name = 'nav'", ".ad": "contains(tok, 'class=\"ad\"')", "[href]": "contains(tok, ' href=')", "[lang=en]": "contains(tok, 'lang=\"en\"')",
           "[href*=\"the\"]": "regexp_matches(tok, 'href=\"[^\"]*the')", "#none": "false"}


@query("ext6_selectors", "WITH " + TOKENS + " SELECT selector, count(*) AS hits FROM (" + " UNION ALL ".join(
    f"SELECT '{s}' AS selector FROM tok WHERE kind = 'start' AND {c}" for s, c in MATCHES.items()) + ") GROUP BY selector")
def _(spark, sf):
    opening = tk.tokens(pages(spark, sf)).where("kind IN ('start', 'selfclose')").withColumn("attrs", tk.attr_map(F.col("tok")))
    read = opening.withColumn("classes", tk.classes(F.col("attrs")))
    tag = regions.tag_columns()
    hits = F.array_compact(F.array(*[F.when(tag.matches(s), F.lit(s)) for s in MATCHES]))
    return read.select(F.explode(hits).alias("selector")).groupBy("selector").agg(F.count("*").alias("hits"))


STRIPPED = f"""WITH {TOKENS},
hit AS (SELECT page_id, pos, depth, CASE WHEN name = 'nav' THEN 'nav' WHEN contains(tok, 'class="ad"') THEN '.ad' ELSE 'b' END AS rule FROM deep
 WHERE kind = 'start' AND (name IN ('nav', 'b') OR contains(tok, 'class="ad"'))),
reg AS (SELECT h.page_id, h.pos, any_value(rule) AS rule, coalesce(min(d.pos), 9000000000) AS fin FROM hit h LEFT JOIN deep d
 ON d.page_id = h.page_id AND d.pos > h.pos AND d.depth < h.depth GROUP BY h.page_id, h.pos),
outer_reg AS (SELECT * FROM reg r WHERE NOT EXISTS (SELECT 1 FROM reg o WHERE o.page_id = r.page_id AND o.pos < r.pos AND o.fin >= r.pos)),
kept AS (SELECT page_id, pos, CASE WHEN kind = 'text' THEN {ESC.format(UNESC.format('tok'))} ELSE tok END AS out FROM deep d
 WHERE NOT EXISTS (SELECT 1 FROM outer_reg r WHERE r.page_id = d.page_id AND d.pos BETWEEN r.pos AND r.fin))"""


@query("ext7_strip_elements", STRIPPED + """ SELECT p.page_id, coalesce(k.html, '') AS html, coalesce(n, 0) AS elements_removed, length(p.html) AS chars_before, coalesce(length(k.html), 0) AS chars_after
 FROM pages p LEFT JOIN (SELECT page_id, string_agg(out, '' ORDER BY pos) AS html FROM kept GROUP BY page_id) k USING (page_id)
 LEFT JOIN (SELECT page_id, count(*) AS n FROM outer_reg GROUP BY page_id) o USING (page_id)""")
def _(spark, sf):
    return regions.strip_elements(pages(spark, sf), ["nav", ".ad", "b"]).select("page_id", "html", "elements_removed", "chars_before", "chars_after")


# A table of rules: 400 for each site, of which a site has one or two that fit anything, and one for all sites.
SITE_OF = r"regexp_extract(url, '^https?://([^/?#]+)', 1)"
RULE_N = "CASE WHEN n = 7 AND k % 4 = 0 THEN ' nav ' WHEN n = 9 AND k % 4 = 1 THEN '.ad' WHEN n = 11 AND k % 4 = 1 THEN 'B' WHEN n = 3 AND k % 4 = 2 THEN '[CLASS=\"ad\"]' WHEN n = 300 AND k % 4 = 2 THEN 'div' WHEN n % 3 = 0 THEN '.x' || n WHEN n % 3 = 1 THEN '#x' || k ELSE '[data-x*=' || n || ']' END"
RULES_SQL = f"""rules AS (SELECT site, n AS rank, {RULE_N} AS selector FROM (SELECT site, k, unnest(range(400)) AS n FROM (SELECT {SITE_OF} AS site, min(page_id) AS k FROM pages GROUP BY 1))
 UNION ALL SELECT NULL, 350, 'ul'),
keyed AS (SELECT site, rank, selector, CASE WHEN trim(selector) = 'nav' THEN 't:nav' WHEN selector = 'B' THEN 't:b' WHEN selector LIKE '[CLASS%' THEN 'c:ad' WHEN selector LIKE '[data%' THEN 'a:data-x'
 WHEN selector LIKE '.%' THEN 'c:' || substr(selector, 2) WHEN selector LIKE '#%' THEN 'i:' || substr(selector, 2) ELSE 't:' || selector END AS key FROM rules),
tags AS (SELECT page_id, {SITE_OF} AS site, pos, depth, 't:' || name AS key FROM deep WHERE kind = 'start' UNION ALL SELECT page_id, {SITE_OF}, pos, depth, 'c:ad' FROM deep WHERE kind = 'start' AND contains(tok, 'class="ad"')),
hit AS (SELECT t.page_id, t.site, t.pos, any_value(t.depth) AS depth, min_by(r.selector, r.rank) AS rule FROM tags t JOIN keyed r ON r.key = t.key AND (r.site = t.site OR r.site IS NULL) GROUP BY ALL)"""
RULED = f"""WITH {TOKENS}, {RULES_SQL},
reg AS (SELECT h.page_id, h.pos, any_value(rule) AS rule, coalesce(min(d.pos), 9000000000) AS fin FROM hit h LEFT JOIN deep d
 ON d.page_id = h.page_id AND d.pos > h.pos AND d.depth < h.depth GROUP BY h.page_id, h.pos),
"""


def site_rules(spark, sf) -> DataFrame:
    sites = pages(spark, sf).groupBy(urls.authority(F.col("url")).alias("site")).agg(F.min("page_id").alias("k"))
    rules = sites.select("site", "k", F.explode(F.sequence(F.lit(0), F.lit(399))).alias("n")).select("site", F.col("n").alias("rank"), F.expr(RULE_N).alias("selector"))
    return rules.union(spark.range(1).select(F.lit(None).cast("string"), F.lit(350), F.lit("ul")))


def sited(spark, sf) -> DataFrame:
    return pages(spark, sf).withColumn("site", urls.authority(F.col("url")))


@query("ext6_rule_table", f"WITH {TOKENS}, {RULES_SQL} SELECT site, rule AS selector, count(*) AS hits FROM hit GROUP BY ALL")
def _(spark, sf):
    return regions.rule_hits(sited(spark, sf), site_rules(spark, sf))


@query("ext7_rule_table", RULED + STRIPPED[STRIPPED.index("outer_reg AS"):] + """ SELECT p.page_id, coalesce(k.html, '') AS html, coalesce(n, 0) AS elements_removed, length(p.html) AS chars_before, coalesce(length(k.html), 0) AS chars_after
 FROM pages p LEFT JOIN (SELECT page_id, string_agg(out, '' ORDER BY pos) AS html FROM kept GROUP BY page_id) k USING (page_id)
 LEFT JOIN (SELECT page_id, count(*) AS n FROM outer_reg GROUP BY page_id) o USING (page_id)""")
def _(spark, sf):
    return regions.strip_by_rules(sited(spark, sf), site_rules(spark, sf))


@query("ext5_target_table", f"""SELECT page_id, CASE WHEN k % 2 = 0 AND page_id % 2 = 0 THEN '<nav id="content">' || regexp_extract(html, '(?s)<nav>(.*?)</nav>', 1) || '</nav>'
 ELSE '<div class="ad">' || {CANON_AD} || '</div>' END AS html, CASE WHEN k % 2 = 0 AND page_id % 2 = 0 THEN 'id=content' ELSE 'class=ad' END AS selector FROM (SELECT *, min(page_id) OVER (PARTITION BY {SITE_OF}) AS k FROM pages)""")
def _(spark, sf):
    """Sites with an even number look for an id before the class that all sites look for."""
    targets = site_rules(spark, sf).where("site IS NOT NULL").select("site", "rank", F.lit("class").alias("how"), F.concat(F.lit("no-"), "rank").alias("value"))
    sites = sited(spark, sf).groupBy("site").agg(F.min("page_id").alias("k")).where("k % 2 = 0")
    targets = targets.union(sites.select("site", F.lit(401), F.lit("id"), F.lit("content"))).union(spark.range(1).select(F.lit(None).cast("string"), F.lit(500), F.lit("class"), F.lit("ad")))
    return regions.sections_by_table(sited(spark, sf).withColumn("html", F.expr(NAV_ID)), targets).select("page_id", "html", "selector")


DEFAULTS = ",".join(regions.NAV_SELECTORS + regions.TOC_SELECTORS)


@query("ext8_selector_set", f"SELECT page_id, '{DEFAULTS},.ad,#x' || page_id AS selectors FROM pages")
def _(spark, sf):
    built = F.array_distinct(F.concat(regions.selector_set(True, True, ".ad, nav"), F.array(F.concat(F.lit("#x"), "page_id"))))
    return pages(spark, sf).select("page_id", F.array_join(built, ",").alias("selectors"))


@query("ext9_title_tag", f"SELECT page_id, {TITLE} AS title FROM pages")
def _(spark, sf):
    return pages(spark, sf).select("page_id", titles.title_tag(F.col("html")).alias("title"))


@query("ext10_first_heading", f"SELECT page_id, {H1} AS h1 FROM pages")
def _(spark, sf):
    return pages(spark, sf).select("page_id", titles.first_heading(F.col("html")).alias("h1"))


WX_HTML = ("CASE page_id % 4 WHEN 0 THEN '<h1 class=\"rich_media_title\" id=\"a\"> Big <b>News</b>  ' || url || ' </h1>' || html"
           " WHEN 1 THEN '<meta property=\"og:title\" content=\"A &amp; B ' || url || '\">' || html WHEN 2 THEN '<meta name=\"twitter:title\" content=\"T\">' || html ELSE html END")


@query("ext11_messenger_title", "SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'Big News ' || url WHEN 1 THEN 'A & B ' || url WHEN 2 THEN 'T' END AS title FROM pages")
def _(spark, sf):
    return derived(spark, sf, "pages", h=WX_HTML).select("page_id", titles.messenger_title(F.col("h")).alias("title"))


@query("ext12_title_resolution", f"""SELECT page_id, CASE page_id % 5 WHEN 0 THEN 'Custom' WHEN 1 THEN 'From data' WHEN 2 THEN {H1} WHEN 3 THEN {TITLE} ELSE 'Untitled' END AS title FROM pages""")
def _(spark, sf):
    p = derived(spark, sf, "pages", custom="CASE WHEN page_id % 5 = 0 THEN 'Custom' END", emb="CASE WHEN page_id % 5 < 2 THEN 'From data' END",
                article="CASE WHEN page_id % 5 = 2 THEN html ELSE '<p>x</p>' END", h="CASE WHEN page_id % 5 = 4 THEN '<p>x</p>' ELSE html END")
    return p.select("page_id", titles.resolve(F.col("custom"), F.col("emb"), F.lit(False), F.col("h"), F.col("article")).alias("title"))


LINKS_SQL = f"""SELECT page_id, i, {ORIGIN} || href AS url, text FROM (SELECT page_id, url, unnest(regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 1)) AS href,
 unnest(regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 2)) AS text, unnest(range(len(regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>')))) AS i FROM pages)
 QUALIFY row_number() OVER (PARTITION BY page_id, url, href ORDER BY i) = 1"""


@query("ext13_links", f"SELECT page_id, url, text, row_number() OVER (PARTITION BY page_id ORDER BY i) - 1 AS ord FROM ({LINKS_SQL})")
def _(spark, sf):
    return links.links(pages(spark, sf)).select("page_id", "ord", "url", "text")


IMG_HTML = ("'<picture><source srcset=\"/p/' || cast(page_id AS varchar(20)) || '.webp 2x, /q.webp\"><img src=\"/no.png\"></picture><img src=\"data:image/gif;base64,AA\" data-src=\"/lazy.jpg\">"
            "<img src=\"/favicon.ico\"><img srcset=\"/s1.png 1x, /s2.png 2x\"><img src=\"/lazy.jpg\"><img alt=x src=' || chr(39) || '//cdn.example.org/a&amp;b.png' || chr(39) || '>' || html")


@query("ext14_images", f"""SELECT page_id, unnest([0, 1, 2, 3]) AS ord, unnest([o || '/p/' || page_id || '.webp', o || '/lazy.jpg', o || '/s1.png', regexp_extract(o, '^(https?:)', 1) || '//cdn.example.org/a&b.png']) AS image_url
 FROM (SELECT page_id, {ORIGIN} AS o FROM pages)""")
def _(spark, sf):
    return links.images(derived(spark, sf, "pages", html=IMG_HTML))


def async_pages(spark, sf) -> DataFrame:
    """Documents as the script of a messenger page, escaped the way such pages escape."""
    def coded(c):
        for plain, code in [("\\", "\\x5c"), ("'", "\\x27"), ('"', "\\x22"), ("&", "\\x26"), ("<", "\\x3c"), (">", "\\x3e"), ("\n", "\\x0a"), ("\r", "\\x0d")]:
            c = F.replace(c, F.lit(plain), F.lit(code))
        return c
    d = table(spark, sf, "documents")
    script = F.concat(F.lit("<html><script>window.cgiDataNew = { is_async: '1', title: JsDecode('T"), "doc_id", F.lit("'), nick_name: JsDecode('"), coded(F.col("source")),
                      F.lit("'), ori_create_time: '17"), "doc_id", F.lit("', content: JsDecode('old'), text_page_info: { content_noencode: JsDecode('"), coded(F.col("text")),
                      F.lit("') }, signature: JsDecode('') };</script></html>"))
    return d.select(F.col("doc_id").alias("page_id"), script.alias("html"))


@query("ext15_async_fields", "SELECT doc_id AS page_id, 'T' || doc_id AS title, source AS nick_name, text AS content, '17' || doc_id AS create_time FROM documents")
def _(spark, sf):
    return async_pages(spark, sf).select("page_id", embedded.async_fields(F.col("html")).alias("f")).select(
        "page_id", "f.title", "f.nick_name", "f.content", "f.create_time")


def doc_json(text="text"):
    """A small rich-text document around a text column."""
    leaf = F.to_json(F.struct(F.lit("text").alias("type"), F.col(text).alias("text")))
    return F.concat(F.lit('{"type":"doc","content":[{"type":"heading","attrs":{"level":"3"},"content":[{"type":"text","text":"H","marks":[{"type":"bold"}]}]},{"type":"paragraph","content":['),
                    leaf, F.lit("]}]}"))


def next_pages(spark, sf) -> DataFrame:
    d = table(spark, sf, "documents")
    quoted = F.regexp_extract(F.to_json(F.struct(doc_json().alias("s"))), r'(?s)^\{"s":(.*)\}$', 1)
    page = F.concat(F.lit('<html><body><script id="__NEXT_DATA__" type="application/json">{"props":{"pageProps":{"fallback":{"/user":{"x":1},"api/article/detail?id=1":{"articleInfo":{"title":"D'), "doc_id",
                    F.lit('","content":'), quoted, F.lit("}}}}}}</script></body></html>"))
    return d.select(F.col("doc_id").alias("page_id"), page.alias("html"))


DOC_HTML = f"'<h3><strong>H</strong></h3>' || chr(10) || '<p>' || {escq('text')} || '</p>' || chr(10)"
FULL = "'<!DOCTYPE html><html><head><meta charset=\"utf-8\"><title>D' || doc_id || '</title></head><body><h1>D' || doc_id || '</h1>' || chr(10) || {0} || '</body></html>'"


@query("ext16_next_article", f"SELECT doc_id AS page_id, 'D' || doc_id AS title, {FULL.format(DOC_HTML)} AS body FROM documents")
def _(spark, sf):
    return embedded.next_articles(next_pages(spark, sf)).select("page_id", "title", "body")


def router_pages(spark, sf) -> DataFrame:
    d = table(spark, sf, "documents")
    md = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit('"MDContent":'), F.regexp_extract(F.to_json(F.struct(F.col("text").alias("s"))), r'(?s)^\{"s":(.*)\}$', 1))).otherwise(F.concat(
        F.lit('"MDContent":"","Content":'), F.regexp_extract(F.to_json(F.struct(F.concat(F.lit('{"data":{"10":{"ops":[{"insert":"tail\\n"}]},"2":{"ops":[{"insert":'),
                                                                                       F.regexp_extract(F.to_json(F.struct(flat().alias("s"))), r'(?s)^\{"s":(.*)\}$', 1),
                                                                                       F.lit('},{"insert":"\\n","attributes":{"header":2}}]}}}')).alias("s"))), r'(?s)^\{"s":(.*)\}$', 1)))
    page = F.concat(F.lit("<script>window._ROUTER_DATA = {\"loaderData\":{\"layout\":{\"a\":\"}\"},\"doc/page\":{\"curDoc\":{\"Title\":\"D"), "doc_id", F.lit('",'), md, F.lit("}}}};</script>"))
    return d.select(F.col("doc_id").alias("page_id"), page.alias("html"))


DELTA = f"CASE WHEN {FLAT} = '' THEN '<h2></h2>' ELSE '<h2>' || {escq(FLAT)} || '</h2>' END || chr(10) || '<p>tail</p>' || chr(10)"


@query("ext17_router_article", f"""SELECT doc_id AS page_id, 'D' || doc_id AS title, true AS is_markdown, regexp_replace(regexp_replace(text, '^\\s+', ''), '\\s+$', '') AS body FROM documents
 WHERE doc_id % 2 = 0 AND regexp_replace(text, '\\s', '', 'g') <> ''
 UNION ALL SELECT doc_id, 'D' || doc_id, false, {FULL.format(DELTA)} FROM documents WHERE doc_id % 2 = 1""")
def _(spark, sf):
    return embedded.router_articles(router_pages(spark, sf)).select("page_id", "title", "is_markdown", "body")


def script_pages(spark, sf) -> DataFrame:
    pad = F.lit(" " * 10 + "/* " + "x" * 200 + " */")
    page = F.concat(F.lit("<title>D"), "doc_id", F.lit("</title><script>var a = 1;</script><SCRIPT>window.state = {\"p\":{\"body\":"), doc_json(), F.lit("}};"), pad, F.lit("</SCRIPT>"))
    return table(spark, sf, "documents").select(F.col("doc_id").alias("page_id"), page.alias("html"))


@query("ext18_script_article", f"SELECT doc_id AS page_id, 'D' || doc_id AS title, {FULL.format(DOC_HTML)} AS body FROM documents")
def _(spark, sf):
    return embedded.script_articles(script_pages(spark, sf)).select("page_id", "title", "body")


SLICE = "'{\"a\":{\"t\":\"' || replace(replace(text, chr(92), chr(92) || chr(92)), '\"', chr(92) || '\"') || ' } {\"},\"b\":[{}]}'"


@query("ext19_json_slice", f"SELECT doc_id AS id, {SLICE} AS slice FROM documents")
def _(spark, sf):
    d = derived(spark, sf, "documents", text_=SLICE + " || '; var x = {}; }'")
    return embedded.json_slices(d.select(F.col("doc_id").alias("id"), F.col("text_").alias("text")))


@query("ext20_richtext_search", f"""SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN {DOC_HTML} WHEN 1 THEN '<p>' || {escq('text')} || '</p>' || chr(10) WHEN 2 THEN '<p>' || {escq('text')} || '</p>' || chr(10)
 WHEN 3 THEN '<h2>' || {escq(FLAT)} || '</h2>' || chr(10) WHEN 4 THEN {DOC_HTML} ELSE '<p>' || {escq('text')} || '</p>' || chr(10) END AS html FROM documents WHERE doc_id % 6 <> 3 OR {FLAT} <> ''""")
def _(spark, sf):
    """By document: an article after comments, a list of nodes at the top, one under a name, insertions under a name, a document in a string of a string, the first of two."""
    d = table(spark, sf, "documents")
    quoted = lambda c: F.regexp_extract(F.to_json(F.struct(c.alias("s"))), r'(?s)^\{"s":(.*)\}$', 1)
    text = quoted(F.col("text"))
    para = F.concat(F.lit('{"type":"paragraph","children":[{"text":'), text, F.lit("}]}"))
    single = F.concat(F.lit('{"type":"doc","content":[{"type":"paragraph","content":[{"type":"text","text":'), text, F.lit("}]}]}"))
    shapes = [F.concat(F.lit('{"comments":{"n":[{"kind":"text","text":"NOISE"}]},"article":'), doc_json(), F.lit("}")), F.concat(F.lit("["), para, F.lit("]")),
              F.concat(F.lit('{"a":1,"data":['), para, F.lit("]}")), F.concat(F.lit('{"items":[{"insert":'), quoted(flat()), F.lit('},{"insert":"\\n","attributes":{"header":2}}]}')),
              F.concat(F.lit('{"outer":'), quoted(F.concat(F.lit('{"inner":'), quoted(F.concat(F.lit('{"pad":"'), F.repeat(F.lit("x"), F.lit(300)), F.lit('","doc":'), doc_json(), F.lit("}"))), F.lit("}"))), F.lit("}")),
              F.concat(F.lit('{"x":'), single, F.lit(',"y":{"type":"doc","content":[{"type":"paragraph","content":[{"type":"text","text":"SECOND"}]}]}}'))]
    chosen = F.element_at(F.array(*shapes), (F.col("doc_id") % 6 + 1).cast("int"))
    return embedded.roots_to_html(embedded.richtext_roots(d.select("doc_id", chosen.alias("json")))).select("doc_id", "html")


@query("ext21_embedded_dispatch", f"""SELECT doc_id AS page_id, CASE doc_id % 3 WHEN 0 THEN 'nextjs' WHEN 1 THEN 'json_fallback' ELSE 'modernjs' END AS source_type,
 CASE WHEN doc_id % 3 < 2 THEN {FULL.format(DOC_HTML)} WHEN doc_id % 2 = 0 THEN regexp_replace(regexp_replace(text, '^\\s+', ''), '\\s+$', '') ELSE {FULL.format(DELTA)} END AS body FROM documents
 WHERE doc_id % 6 <> 2 OR regexp_replace(text, '\\s', '', 'g') <> ''""")
def _(spark, sf):
    forms = [next_pages(spark, sf), script_pages(spark, sf), router_pages(spark, sf)]
    pages = reduce(DataFrame.unionByName, [p.where(F.col("page_id") % 3 == k) for k, p in enumerate(forms)])
    return embedded.articles(pages).select("page_id", "source_type", "body")


MD_IMG = "'![a](/x/' || cast(doc_id AS varchar(20)) || '.png =10x20) ' || text || ' ![b](rel.png \"T t\") ![c](https://o.org/c.png) ![d](data:x)'"


@query("ext22_markdown_images", "SELECT doc_id, 'http://h.org/x/' || doc_id || '.png|http://h.org/d/rel.png|https://o.org/c.png' AS found FROM documents")
def _(spark, sf):
    return derived(spark, sf, "documents", md=MD_IMG).select("doc_id", F.array_join(mt.image_urls(F.col("md"), F.lit("http://h.org/d/p")), "|").alias("found"))
