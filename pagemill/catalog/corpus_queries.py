"""Queries over sets of pages: lookups, numbering, aggregates, names, documents."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.catalog.base import H1, ORACLES, ORIGIN, SITE, TOKENS, derived, esc, escq, query, table
from pagemill.catalog.page_queries import DOCS_HTML, FRAMEWORK_SQL, IMG_HTML, LINKS_SQL, STRIPPED, conversation_dumps
from pagemill.functions import binary, entities, markdown_text as mt, text as tx, urls
from pagemill.operators import blocks, classify, links, regions, rewrite, sequence, site, titles, tokens as tk
from pagemill.plans.page_job import PageOptions, page_results
from pagemill.session import shared_folder
from pagemill.sources import named_files, pages as src

RUN = "2026-01-01 00:00:00"
# A body: links, an image and code with the page's address, a link to the first page of its site, and the whole text of the page.
MD = "'# Top' || chr(10) || 'see [home](' || url || '#x) and ![i](' || url || '/a.png?w=1) [out](https://o.example.org/p?q=1)' || chr(10) || '```' || chr(10) || '[code](' || url || ')' || chr(10) || '# c' || chr(10) || '```' || chr(10) || 'start [first](' || home || ')' || chr(10) || chr(10) || body"
BASE_SQL = f"""SELECT ord, site, url, home, body, title, {MD} AS md, success, error FROM (SELECT page_id AS ord, {SITE} AS site, url, min_by(url, page_id) OVER (PARTITION BY {SITE}) AS home,
 regexp_replace(html, '<[^>]*>', '', 'g') AS body, {H1} AS title, page_id % 7 <> 3 AS success, CASE WHEN page_id % 7 = 3 THEN 'timeout' END AS error FROM pages)"""
SLUG = r"coalesce(nullif(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower({0}), '[^\p{{L}}\p{{N}}_\s\-]', '', 'g'), '\s+', '-', 'g'), '-+', '-', 'g'), '^-+|-+$', '', 'g'), ''), 'section')"
ANCHORED = f"""base AS ({BASE_SQL}), anchored AS (SELECT *, CASE WHEN success THEN {SLUG.format('title')} END AS slug FROM base),
anch AS (SELECT *, CASE WHEN success THEN CASE WHEN row_number() OVER w = 1 THEN slug ELSE slug || '-' || row_number() OVER w END END AS anchor FROM anchored WINDOW w AS (PARTITION BY site, slug, success ORDER BY ord))"""


def results(spark, sf) -> DataFrame:
    """Page results with the text of each page; every seventh page failed."""
    p = table(spark, sf, "pages").select("page_id", urls.authority(F.col("url")).alias("site"), "url", "html")
    homes = p.groupBy("site").agg(F.min_by("url", "page_id").alias("home"))
    p = p.join(homes, "site").withColumn("body", F.regexp_replace("html", "<[^>]*>", "")).withColumn("md", F.expr(MD))
    return p.select(F.col("page_id").alias("ord"), "site", "url", titles.first_heading(F.col("html")).alias("title"),
                    "md", (F.col("page_id") % 7 != 3).alias("success"), F.when(F.col("page_id") % 7 == 3, "timeout").alias("error"))


# --- lookups --------------------------------------------------------------------------------------------------

BARE_URL = "regexp_extract(url, '^([^#]*)', 1)"
REDACTED = "regexp_extract(url, '^([^?#]*)', 1)"
# Targets carry a fragment: the address itself is known only for pages without one, then the redacted form is tried.
KNOWN = f"""known AS (SELECT site, u, max_by(anchor, ord) AS anchor FROM (SELECT site, ord, anchor, url AS u FROM anch WHERE success) GROUP BY site, u)"""
LINKED_SQL = f"""WITH {ANCHORED}, {KNOWN}, hit AS (SELECT a.*, coalesce(k0.anchor, k1.anchor, k2.anchor) AS target, coalesce(h0.anchor, h1.anchor, h2.anchor) AS first_target FROM anch a
 LEFT JOIN known k0 ON k0.site = a.site AND k0.u = a.url || '#x' LEFT JOIN known k1 ON k1.site = a.site AND k1.u = {BARE_URL.replace('url', 'a.url')} LEFT JOIN known k2 ON k2.site = a.site AND k2.u = {REDACTED.replace('url', 'a.url')}
 LEFT JOIN known h0 ON h0.site = a.site AND h0.u = a.home LEFT JOIN known h1 ON h1.site = a.site AND h1.u = {BARE_URL.replace('url', 'a.home')} LEFT JOIN known h2 ON h2.site = a.site AND h2.u = {REDACTED.replace('url', 'a.home')} WHERE a.success)"""
NEW_MD = MD.replace("'see [home](' || url || '#x)", "'see [home](' || CASE WHEN target IS NULL THEN url || '#x' ELSE '#' || target END || ')").replace(
    "|| home ||", "|| CASE WHEN first_target IS NULL THEN home ELSE '#' || first_target END ||")
N_REWRITTEN = "(target IS NOT NULL)::BIGINT + (first_target IS NOT NULL)::BIGINT"


@query("j1_link_anchor_lookup", f"{LINKED_SQL} SELECT site, ord, target AS anchor FROM hit WHERE target IS NOT NULL")
def _(spark, sf):
    _, anchored = site.stored_pages(results(spark, sf))
    found = anchored.where("success").select("site", "ord", F.concat("url", F.lit("#x")).alias("_t"))
    return rewrite.resolve(found, site.url_anchors(anchored), rewrite.link_candidates(F.col("_t")), ["site", "ord"], "anchor", "site")


@query("cln6_internal_links", f"{LINKED_SQL} SELECT site, ord, {NEW_MD} AS md, {N_REWRITTEN} AS rewritten FROM hit")
def _(spark, sf):
    stored, anchored = site.stored_pages(results(spark, sf))
    return site._linked(stored.where("success").select("site", "ord", "md"), site.url_anchors(anchored))


IMG_MD = "'![a](http://i.org/' || cast(doc_id % 50 AS varchar(20)) || '.png) <IMG alt=\"\" src=\"http://i.org/b c.png\"> [l](http://i.org/1.png) ' || text || ' ![z](http://i.org/none.png)'"


def asset_table(spark, sf) -> DataFrame:
    n = table(spark, sf, "documents").select((F.col("doc_id") % 50).alias("n")).distinct()
    return n.select(F.concat(F.lit("http://i.org/"), "n", F.lit(".png")).alias("url"), F.concat(F.lit("assets/"), "n", F.lit(".png")).alias("local_path")).unionByName(
        n.where("n = 0").select(F.lit("http://i.org/b%20c.png").alias("url"), F.lit("assets/bc.png").alias("local_path")))


LOCAL_MD = "'![a](assets/' || doc_id % 50 || '.png) <IMG alt=\"\" src=\"assets/bc.png\"> [l](http://i.org/1.png) ' || text || ' ![z](http://i.org/none.png)'"


@query("cln7_local_images", f"SELECT doc_id, {LOCAL_MD} AS md, 2 AS rewritten FROM documents")
def _(spark, sf):
    d = derived(spark, sf, "documents", md=IMG_MD)
    return rewrite.local_images(d, asset_table(spark, sf), "md", "doc_id")


@query("j2_image_local_path", "SELECT doc_id, 'assets/' || doc_id % 50 || '.png' AS local_path FROM documents")
def _(spark, sf):
    refs = derived(spark, sf, "documents", u="'http://i.org/' || cast(doc_id % 50 AS varchar(20)) || '.png'").select("doc_id", "u")
    return sequence.lookup(refs, asset_table(spark, sf).withColumnRenamed("url", "u"), "u", "local_path", F.col("doc_id")).select("doc_id", "local_path")


CRAWL = f"""crawl AS (SELECT page_id, i, url AS page, regexp_extract(url, '^([^#]*)', 1) AS key, url, text FROM ({LINKS_SQL})),
listed AS (SELECT page_id AS ord, {ORIGIN} || '/The' AS url FROM pages),
fresh AS (SELECT key, min_by(url, page_id * 100000 + i) AS url, min_by(text, page_id * 100000 + i) AS title FROM crawl GROUP BY key)"""


def listed_urls(spark, sf) -> DataFrame:
    p = table(spark, sf, "pages")
    return p.select(F.col("page_id").alias("ord"), F.concat(urls.scheme(F.col("url")), F.lit("://"), urls.authority(F.col("url")), F.lit("/The")).alias("url"),
                    F.lit(None).cast("string").alias("title"))


@query("j3_new_crawl_links", f"WITH {CRAWL} SELECT url, title FROM fresh WHERE key NOT IN (SELECT url FROM listed)")
def _(spark, sf):
    return links.crawl_list(listed_urls(spark, sf), links.links(table(spark, sf, "pages"))).where("source = 1").select("url", "title")


@query("u1_crawl_list", f"WITH {CRAWL} SELECT 0 AS source, url, NULL AS title FROM listed UNION ALL SELECT 1, url, title FROM fresh WHERE key NOT IN (SELECT url FROM listed)")
def _(spark, sf):
    return links.crawl_list(listed_urls(spark, sf), links.links(table(spark, sf, "pages"))).select("source", "url", "title")


def stored_files(spark, sf) -> DataFrame:
    d = table(spark, sf, "documents")
    return d.select(F.concat(F.lit("img/"), "doc_id", F.lit(" y.png")).alias("path")).unionByName(
        d.select(F.concat(F.lit("img/"), "doc_id", F.when(F.col("doc_id") % 2 == 0, " x.png").otherwise(" other.png")).alias("path")))


def referenced(spark, sf) -> DataFrame:
    return derived(spark, sf, "documents", md="'![a](<img/' || cast(doc_id AS varchar(20)) || ' x.png>) ![b](img/' || cast(doc_id AS varchar(20)) || '%20y.png \"t\") ![c](http://r.org/c.png) ![d](gone%2Fd.png) ' || text")


@query("j4_missing_files", "SELECT doc_id, 'gone%2Fd.png' AS ref FROM documents UNION ALL SELECT doc_id, 'img/' || doc_id || ' x.png' FROM documents WHERE doc_id % 2 = 1")
def _(spark, sf):
    refs = site.image_references(referenced(spark, sf), "md", "doc_id")
    return site.missing_files(refs, stored_files(spark, sf)).select("doc_id", "ref")


@query("ag8_reference_report", "SELECT doc_id, 4 AS image_refs, 3 AS local_refs, CASE WHEN doc_id % 2 = 1 THEN 2 ELSE 1 END AS missing FROM documents")
def _(spark, sf):
    return site.reference_report(referenced(spark, sf), stored_files(spark, sf), "md", "doc_id")


@query("j5_unused_assets", """SELECT file_name FROM (SELECT DISTINCT 'f' || (page_id % 40) || '.png' AS file_name FROM pages) f
 WHERE NOT EXISTS (SELECT 1 FROM pages p WHERE contains('![x](a.assets/001-f' || (p.page_id % 25) || '.png) ' || p.url, f.file_name))""")
def _(spark, sf):
    p = table(spark, sf, "pages")
    files = p.select(F.concat(F.lit("f"), F.col("page_id") % 40, F.lit(".png")).alias("file_name")).distinct()
    docs = p.select("page_id", F.concat(F.lit("![x](a.assets/001-f"), F.col("page_id") % 25, F.lit(".png) "), "url").alias("md"))
    return site.unused_assets(files, docs)


@query("j6_detected_preset", f"""SELECT page_id, CASE applied WHEN 'docusaurus' THEN 'theme-doc-markdown,markdown,docMainContainer' WHEN 'readthedocs' THEN 'rst-content,document,body'
 WHEN 'gitbook' THEN 'markdown-section,page-inner,book-body' WHEN 'sphinx' THEN 'document,body,rst-content' WHEN 'mkdocs' THEN 'md-content__inner,md-typeset,rst-content' END AS target_classes FROM ({FRAMEWORK_SQL})""")
def _(spark, sf):
    found = derived(spark, sf, "pages", h=DOCS_HTML).select("page_id", classify.applied_preset(classify.framework(F.col("h"))).alias("preset"))
    return classify.with_preset_options(found).select("page_id", F.array_join("target_classes", ",").alias("target_classes"))


@query("j7_missing_blocks", "SELECT cast(conv_id AS varchar) AS page_id, 'b-' || conv_id || '-' || turn AS block_id FROM conversations WHERE turn % 5 = 4")
def _(spark, sf):
    found = src.block_records(conversation_dumps(spark, sf))
    roots = found.where("type = 'page'").select("page_id", "block_id")
    partial = found.where("NOT block_id RLIKE '^b-.*-[0-9]*[49]$'").drop("page_id")
    return blocks.missing(blocks.tree(partial, roots), partial)


IMAGES_SQL = f"""img AS (SELECT page_id, unnest([0, 1, 2, 3]) AS ord, unnest([o || '/p/' || page_id || '.webp', o || '/lazy.jpg', o || '/s1.png', regexp_extract(o, '^(https?:)', 1) || '//cdn.example.org/a&b.png']) AS image_url
 FROM (SELECT page_id, {ORIGIN} AS o FROM pages))"""


def image_refs(spark, sf) -> DataFrame:
    return links.images(derived(spark, sf, "pages", html=IMG_HTML))


@query("j9_image_first_page", f"WITH {IMAGES_SQL} SELECT image_url, min(page_id) AS page_id FROM img GROUP BY image_url")
def _(spark, sf):
    return sequence.first_seen(image_refs(spark, sf), ["image_url"], ["page_id", "ord"]).select("image_url", "page_id")


@query("j10_tokens_in_regions", STRIPPED + " SELECT d.page_id, d.pos FROM deep d WHERE EXISTS (SELECT 1 FROM outer_reg r WHERE r.page_id = d.page_id AND d.pos BETWEEN r.pos AND r.fin)")
def _(spark, sf):
    marked = regions.strip_regions(tk.tokens(table(spark, sf, "pages")), ["nav", ".ad", "b"])
    return marked.where("removed").select("page_id", "pos")


# --- aggregates -----------------------------------------------------------------------------------------------

@query("ag1_outcome", f"SELECT site, count(*) FILTER (success) AS succeeded, count(*) FILTER (NOT success) AS failed, CASE WHEN count(*) FILTER (NOT success) = 0 THEN 'ok' WHEN count(*) FILTER (success) = 0 THEN 'failed' ELSE 'partial' END AS status FROM ({BASE_SQL}) GROUP BY site")
def _(spark, sf):
    return site.outcome(results(spark, sf))


@query("ag2_image_totals", f"WITH {IMAGES_SQL} SELECT count(*) AS refs, count(DISTINCT image_url) AS images FROM img")
def _(spark, sf):
    return image_refs(spark, sf).agg(F.count("*").alias("refs"), F.countDistinct("image_url").alias("images"))


@query("ag3_strip_rules", STRIPPED + " SELECT rule, count(*) AS hits FROM outer_reg GROUP BY rule")
def _(spark, sf):
    return regions.rule_counts(table(spark, sf, "pages"), ["nav", ".ad", "b"]).orderBy(F.desc("hits"))


@query("ag4_framework_counts", f"SELECT framework, count(*) AS pages, round(max(score), 2) AS best FROM ({FRAMEWORK_SQL}) WHERE framework IS NOT NULL GROUP BY framework")
def _(spark, sf):
    f = derived(spark, sf, "pages", h=DOCS_HTML).select(classify.framework(F.col("h")).alias("f"))
    return f.where("f.name IS NOT NULL").groupBy(F.col("f.name").alias("framework")).agg(F.count("*").alias("pages"), F.round(F.max("f.score"), 2).alias("best"))


@query("ag5_longest_section", f"SELECT {SITE} AS site, max(length(regexp_extract(html, '(?is)<article[^>]*>(.*?)</article>', 1))) AS longest FROM pages GROUP BY 1")
def _(spark, sf):
    p = table(spark, sf, "pages")
    return p.groupBy(urls.authority(F.col("url")).alias("site")).agg(F.max(F.length(titles.main_html(F.col("html")))).alias("longest"))


@query("ag6_anchor_stats", f"WITH {ANCHORED} SELECT site, cast(sum(n) AS BIGINT) AS total_anchors, count(*) AS unique_anchors, count(*) FILTER (n > 1) AS collisions FROM (SELECT site, slug, count(*) AS n FROM anch WHERE success GROUP BY ALL) GROUP BY site")
def _(spark, sf):
    return site.anchor_stats(site.with_anchors(results(spark, sf)))


@query("ag7_redacted_assets", f"SELECT {REDACTED} AS url, string_agg(DISTINCT 'a' || page_id % 3, ',' ORDER BY 'a' || page_id % 3) AS paths FROM pages GROUP BY 1")
def _(spark, sf):
    a = table(spark, sf, "pages").select("url", F.concat(F.lit("a"), F.col("page_id") % 3).alias("local_path"))
    return rewrite.redacted_assets(a).select("url", F.array_join("paths", ",").alias("paths"))


# --- numbering ------------------------------------------------------------------------------------------------

@query("w1_anchors", f"WITH {ANCHORED} SELECT site, ord, anchor FROM anch")
def _(spark, sf):
    return site.with_anchors(results(spark, sf)).select("site", "ord", "anchor")


STEM = r"coalesce(nullif(regexp_replace(regexp_replace(regexp_replace(trim({0}), '[^\p{{L}}\p{{N}}_.\-]+', '-', 'g'), '-{{2,}}', '-', 'g'), '^-+|-+$', '', 'g'), ''), 'untitled')"
FILE_SQL = f"""WITH base AS ({BASE_SQL}), f AS (SELECT *, substring(CASE WHEN regexp_matches(st, '(?i)^(con|prn|aux|nul|com[1-9]|lpt[1-9])(\\.[^.]*)?$') THEN '_' || st ELSE st END, 1, 50) AS stem FROM (SELECT *, {STEM.format('title')} AS st FROM base WHERE success)),
 n AS (SELECT *, row_number() OVER (PARTITION BY site, stem ORDER BY ord) - 1 AS k FROM f), names AS (SELECT *, stem || CASE WHEN k = 0 THEN '' ELSE '_' || k END || '.md' AS file_name FROM n)"""


@query("j8_positional_files", f"{FILE_SQL}, placed AS (SELECT site, ord, row_number() OVER (PARTITION BY site ORDER BY ord) AS n FROM base) SELECT site, n, file_name FROM placed JOIN names USING (site, ord)")
def _(spark, sf):
    r = results(spark, sf).drop("md")
    names = site.file_names(r).select("site", "ord", "file_name")
    return sequence.row_numbers(r, ["site"], ["ord"], "n").join(names, ["site", "ord"]).select("site", "n", "file_name")


CHAINED = {"Zz": "Zz.md", "ZZ ": "ZZ.md", "Zz ": "Zz_1.md", "Zz_1": "Zz_1_1.md", "Zz_1_1": "Zz_1_1_1.md", " Zz": "Zz_2.md"}


@query("w2_file_names", f"{FILE_SQL} SELECT site, ord, file_name FROM names UNION ALL " + " UNION ALL ".join(
    f"SELECT DISTINCT site, {7919 * 10 ** 12 * (i + 1) + i * i}, '{name}' FROM base" for i, name in enumerate(CHAINED.values())))
def _(spark, sf):
    """Besides the pages: titles whose numbered names meet other titles, under page numbers that are far apart."""
    pages = results(spark, sf)
    rows = [F.struct(F.lit(7919 * 10 ** 12 * (i + 1) + i * i).alias("ord"), F.lit(t).alias("title")) for i, t in enumerate(CHAINED)]
    more = pages.select("site").distinct().select("site", F.explode(F.array(*rows)).alias("m")).select("site", "m.*", F.lit(True).alias("success"))
    return site.file_names(pages.select("site", "ord", "title", "success").unionByName(more)).select("site", "ord", "file_name")


@query("w3_asset_names", f"""WITH {IMAGES_SQL}, firsts AS (SELECT image_url, min(page_id * 10 + ord) AS k FROM img GROUP BY image_url), num AS (SELECT *, row_number() OVER (ORDER BY k) AS n FROM firsts)
 SELECT image_url, n, CASE WHEN n < 1000 THEN lpad(n::VARCHAR, 3, '0') ELSE n::VARCHAR END || '-' || replace(regexp_extract(image_url, '([^/]*)\\.[a-z]+$', 1), '&', '-') || regexp_extract(image_url, '(\\.[a-z]+)$', 1) AS file_name, k // 10 AS page_id FROM num""")
def _(spark, sf):
    return links.asset_names(image_refs(spark, sf))


@query("w4_running_counters", f"WITH {TOKENS} SELECT page_id, pos, cast(sum(CASE WHEN kind = 'start' AND name IN ('ul', 'ol') THEN 1 WHEN kind = 'end' AND name IN ('ul', 'ol') THEN -1 ELSE 0 END) OVER w AS BIGINT) AS list_depth, count(*) FILTER (kind = 'start' AND name = 'li') OVER w AS items FROM tok WINDOW w AS (PARTITION BY page_id ORDER BY pos)")
def _(spark, sf):
    t = tk.tokens(table(spark, sf, "pages"))
    w = tk.running(tk.by_page())
    lists = F.col("name").isin("ul", "ol")
    step = F.when((F.col("kind") == "start") & lists, 1).when((F.col("kind") == "end") & lists, -1).otherwise(0)
    return t.select("page_id", "pos", F.sum(step).over(w).alias("list_depth"), F.count_if((F.col("kind") == "start") & (F.col("name") == "li")).over(w).alias("items"))


@query("w5_runs", "SELECT conv_id, run, any_value(role) AS role, count(*) AS size FROM (SELECT *, sum(CASE WHEN role = prev THEN 0 ELSE 1 END) OVER (PARTITION BY conv_id ORDER BY turn)::BIGINT AS run FROM (SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS prev FROM conversations)) GROUP BY conv_id, run")
def _(spark, sf):
    return sequence.runs(table(spark, sf, "conversations"), ["conv_id"], ["turn"], "role")


@query("s1_input_order", f"SELECT row_number() OVER (ORDER BY page_id) AS n, url FROM pages")
def _(spark, sf):
    p = table(spark, sf, "pages").select(F.lit(0).alias("batch"), F.col("page_id").alias("ord"), "url")
    return sequence.row_numbers(p, ["batch"], ["ord"], "n").select("n", "url").orderBy("n")


@query("s2_preview", "SELECT page_id, url FROM pages ORDER BY page_id LIMIT 10")
def _(spark, sf):
    return table(spark, sf, "pages").select("page_id", "url").orderBy("page_id").limit(10)


@query("s3_top_collisions", f"SELECT slug, count(*) AS n FROM (SELECT CASE doc_id % 4 WHEN 0 THEN 'topic-' || doc_id % 24 WHEN 1 THEN 'section' WHEN 2 THEN source ELSE 'one-' || doc_id END AS slug FROM documents) GROUP BY slug HAVING count(*) > 1 ORDER BY n DESC, slug LIMIT 10")
def _(spark, sf):
    title = "CASE doc_id % 4 WHEN 0 THEN 'Topic ' || cast(doc_id % 24 AS varchar(20)) || '!' WHEN 1 THEN '?!' WHEN 2 THEN upper(source) ELSE 'one - ' || cast(doc_id AS varchar(20)) END"
    d = derived(spark, sf, "documents", title=title).select(F.col("source").alias("site"), F.col("doc_id").alias("ord"), "title", F.lit(True).alias("success"))
    return site.top_collisions(d.withColumn("slug", urls.anchor_slug(F.col("title"))))


@query("u2_distinct_in_order", f"WITH {IMAGES_SQL} SELECT page_id, string_agg(image_url, ' ' ORDER BY ord) AS found FROM img GROUP BY page_id")
def _(spark, sf):
    p = derived(spark, sf, "pages", html=IMG_HTML + " || " + IMG_HTML)
    return p.select("page_id", F.array_join(links.page_images(F.col("html"), F.col("url")), " ").alias("found"))


# --- scalar expressions ---------------------------------------------------------------------------------------

REFS = {"'../x/./y?q#f'": "{o} || CASE WHEN len(regexp_extract_all(path, '/')) >= 2 THEN regexp_replace(regexp_replace(path, '[^/]*$', ''), '[^/]+/$', '') ELSE '/' END || 'x/y?q#f'",
        "'//cdn.org/a'": "regexp_extract(url, '^(https?:)', 1) || '//cdn.org/a'", "'?k=v'": "{o} || path || '?k=v'", "'/r//s'": "{o} || '/r//s'", "'mailto:a@b'": "'mailto:a@b'"}
CHOICE = "CASE page_id % 5 " + " ".join(f"WHEN {i} THEN {r}" for i, r in enumerate(REFS)) + " END"
JOINED = "CASE page_id % 5 " + " ".join(f"WHEN {i} THEN {r.format(o='o')}" for i, r in enumerate(REFS.values())) + " END"


@query("fn_url_join", f"SELECT page_id, {JOINED} AS url FROM (SELECT page_id, url, {ORIGIN} AS o, regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1) AS path FROM pages)")
def _(spark, sf):
    return derived(spark, sf, "pages", ref=CHOICE).select("page_id", urls.join_url(F.col("url"), F.col("ref")).alias("url"))


@query("fn_defragment", f"SELECT page_id, {BARE_URL} AS url FROM pages")
def _(spark, sf):
    return table(spark, sf, "pages").select("page_id", urls.defragment(F.col("url")).alias("url"))


@query("fn_host", f"SELECT page_id, {SITE} AS host, page_id % 2 = 0 AS same FROM pages")
def _(spark, sf):
    u = "replace(url, '://', '://User:pw@')"
    other = "CASE WHEN page_id % 2 = 0 THEN upper(url) ELSE '/relative' END"
    p = derived(spark, sf, "pages", u=u, other=other)
    return p.select("page_id", urls.host(F.col("u")).alias("host"), urls.same_host(F.col("url"), F.col("other")).alias("same"))


@query("fn_port_aliases", f"""SELECT page_id, CASE page_id % 3 WHEN 0 THEN u || ' ' || s || '://' || h || rest WHEN 1 THEN u || ' ' || s || '://' || h || CASE s WHEN 'https' THEN ':443' ELSE ':80' END || rest
 ELSE u || ' ' || s || '://' || h || CASE s WHEN 'https' THEN ':443' ELSE ':80' END || rest END AS aliases
 FROM (SELECT page_id, {SITE} AS h, regexp_extract(url, '^(https?)', 1) AS s, regexp_extract(url, '^https?://[^/?#]*([^#]*)', 1) AS rest,
 CASE page_id % 3 WHEN 0 THEN regexp_replace(url, '^(https?://[^/?#]*)', '\\1:8080') WHEN 1 THEN url ELSE regexp_replace(url, '^(https?://[^/?#]*)', '\\1:99999') END AS u FROM pages)""")
def _(spark, sf):
    p = table(spark, sf, "pages")
    u = F.when(F.col("page_id") % 3 == 0, F.regexp_replace("url", r"^(https?://[^/?#]*)", "$1:8080")).when(
        F.col("page_id") % 3 == 1, F.col("url")).otherwise(F.regexp_replace("url", r"^(https?://[^/?#]*)", "$1:99999"))
    return p.select("page_id", F.array_join(urls.port_aliases(u), " ").alias("aliases"))


@query("fn_anchor_slug", f"SELECT page_id, {SLUG.format(H1)} AS slug FROM pages")
def _(spark, sf):
    return table(spark, sf, "pages").select("page_id", urls.anchor_slug(titles.first_heading(F.col("html"))).alias("slug"))


@query("fn_title_key", r"SELECT page_id, regexp_replace(lower(trim(regexp_replace(" + H1 + r", '\s+', ' ', 'g'))), '[^\p{L}\p{N}_ ]+', '', 'g') AS key FROM pages")
def _(spark, sf):
    return table(spark, sf, "pages").select("page_id", urls.title_key(titles.first_heading(F.col("html"))).alias("key"))


@query("fn_file_stem", f"SELECT page_id, CASE page_id % 4 WHEN 0 THEN '_COM1' WHEN 1 THEN '_nul.txt' WHEN 2 THEN 'untitled' ELSE CASE WHEN regexp_matches({STEM.format(H1)}, '(?i)^(con|prn|aux|nul|com[1-9]|lpt[1-9])(\\.[^.]*)?$') THEN '_' ELSE '' END || {STEM.format(H1)} END AS stem FROM pages")
def _(spark, sf):
    name = F.when(F.col("page_id") % 4 == 0, "COM1").when(F.col("page_id") % 4 == 1, " nul.txt").when(F.col("page_id") % 4 == 2, "?? //").otherwise(titles.first_heading(F.col("html")))
    return table(spark, sf, "pages").select("page_id", urls.file_stem(name).alias("stem"))


PAGE_STEM = f"regexp_replace({SITE}, '^www\\.', '') || regexp_replace(regexp_replace(regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1), '/+$', ''), '/+', '_', 'g')"


@query("fn_page_stem", f"SELECT page_id, {PAGE_STEM} AS stem, substring(regexp_replace({SITE}, '^www\\.', '') || '_' || repeat('ab', 60), 1, 71) || '-' || substring(sha1(u), 1, 8) AS long_stem FROM (SELECT page_id, url, {ORIGIN} || '/' || repeat('ab', 60) AS u FROM pages)")
def _(spark, sf):
    long = "regexp_extract(url, '^(https?://[^/?#]+)', 1) || '/' || repeat('ab', 60)"
    return derived(spark, sf, "pages", u=long).select("page_id", urls.page_stem(F.col("url")).alias("stem"), urls.page_stem(F.col("u")).alias("long_stem"))


@query("fn_path_limit", "SELECT page_id, CASE WHEN length(nm) + 5 <= 100 THEN nm ELSE substring(nm, 1, greatest(10, length(nm) - 3 - (length(nm) + 5 - 100) - 8)::INT) || '-' || substring(sha1(nm), 1, 6) || '.md' END AS name FROM (SELECT page_id, repeat('n', (page_id % 200)::INT + 1) || '.md' AS nm FROM pages)")
def _(spark, sf):
    p = derived(spark, sf, "pages", nm="repeat('n', cast(page_id % 200 AS int) + 1) || '.md'")
    return p.select("page_id", urls.fit_path("/out", F.col("nm"), 100).alias("name"))


@query("fn_string_escapes", "SELECT doc_id, trim(replace(replace(replace(replace(replace(text, '\\', '\\\\'), '\"', '\\\"'), chr(10), ' '), chr(13), ' '), chr(9), ' ')) AS yaml, replace(replace(text, '[', '\\['), ']', '\\]') AS label FROM documents")
def _(spark, sf):
    return table(spark, sf, "documents").select("doc_id", tx.yaml_string(F.col("text")).alias("yaml"), tx.link_label(F.col("text")).alias("label"))


@query("fn_entities", f"SELECT doc_id, text || '©é—&nope;A☃© 2024–€&<Š⇒Œ∑♠Anotit;' || chr(8713) || ';x&#xg;' || chr(65533) || chr(65533) AS plain, {escq('text')} AS escaped FROM documents")
def _(spark, sf):
    coded = F.concat(tx.html_escape(F.col("text")), F.lit("&copy;&eacute;&mdash;&nope;&#65;&#x2603;&copy 2024&#150;&#x80;&amp&lt&Scaron;&rArr;&OElig;&sum;&spades;&#0000000065;"
                                                           "notit;&notin;;x&#xg;&#xD800;&#99999999999;"))
    return table(spark, sf, "documents").select("doc_id", entities.unescape(coded).alias("plain"), tx.html_escape(F.col("text")).alias("escaped"))


@query("fn_script_unescape", "SELECT doc_id, '<a href=\"x\">' || chr(92) || text || chr(10) || '&</a>' AS plain FROM documents")
def _(spark, sf):
    raw = F.concat(F.lit("\\x3ca href=\\x22x\\x22\\x3e\\x5c"), "text", F.lit("\\x0a\\x26\\x3c/a\\x3e"))
    return table(spark, sf, "documents").select("doc_id", tx.script_unescape(raw).alias("plain"))


@query("fn_percent_coding", "SELECT doc_id, url_encode(text) AS coded, text AS back, 'a+b%zz' AS odd FROM documents")
def _(spark, sf):
    d = table(spark, sf, "documents").withColumn("coded", urls.percent_encode(F.col("text")))
    return d.select("doc_id", "coded", urls.percent_decode(F.col("coded")).alias("back"), urls.percent_decode(F.lit("a+b%zz")).alias("odd"))


@query("fn_extension_from_type", "SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN '.jpg' WHEN 1 THEN '.svg' WHEN 2 THEN '.ico' END AS ext FROM documents")
def _(spark, sf):
    d = derived(spark, sf, "documents", ct="CASE doc_id % 4 WHEN 0 THEN 'image/JPEG; q=1' WHEN 1 THEN ' image/svg+xml' WHEN 2 THEN 'image/x-icon' ELSE 'text/' || source END")
    return d.select("doc_id", binary.extension_from_type(F.col("ct")).alias("ext"))


@query("fn_extension_from_bytes", "SELECT page_id, CASE page_id % 8 WHEN 0 THEN '.png' WHEN 1 THEN '.jpg' WHEN 2 THEN '.gif' WHEN 3 THEN '.webp' WHEN 4 THEN '.pdf' WHEN 5 THEN '.avif' WHEN 6 THEN '.svg' END AS ext FROM pages")
def _(spark, sf):
    heads = ["89504E470D0A1A0A00000000", "FFD8FF", "474946383961", "524946460000000057454250", "25504446", "000000006674797061766966"]
    head = F.lit("")
    for i, h in enumerate(heads):
        head = F.when(F.col("page_id") % 8 == i, F.lit(h)).otherwise(head)
    rest = F.when(F.col("page_id") % 8 == 6, F.concat(F.lit(" <?xml?><svg>"), "url")).when(F.col("page_id") % 8 == 7, F.concat(F.lit("<svg></svg>"), "html")).otherwise(F.col("html"))
    content = F.concat(F.unhex(head), F.encode(rest, "UTF-8"))
    return table(spark, sf, "pages").select("page_id", binary.extension_from_bytes(content).alias("ext"))


@query("fn_asset_name", "SELECT image_url, n, lpad(n::VARCHAR, 3, '0') || CASE k WHEN 0 THEN '-a.JPG' WHEN 1 THEN '-x-y.png' WHEN 2 THEN '-f.php' ELSE '-image-' || n || '.bin' END AS file_name FROM (SELECT *, row_number() OVER (ORDER BY page_id) AS n FROM (SELECT page_id, page_id % 4 AS k, 'http://i' || page_id || '.org' || CASE page_id % 4 WHEN 0 THEN '/a.JPG?x' WHEN 1 THEN '/x%20y' WHEN 2 THEN '/f.php' ELSE '/' END AS image_url FROM pages))".replace("lpad(n::VARCHAR, 3, '0')", "CASE WHEN n < 1000 THEN lpad(n::VARCHAR, 3, '0') ELSE n::VARCHAR END"))
def _(spark, sf):
    refs = derived(spark, sf, "pages", image_url="'http://i' || cast(page_id AS varchar(20)) || '.org' || CASE page_id % 4 WHEN 0 THEN '/a.JPG?x' WHEN 1 THEN '/x%20y' WHEN 2 THEN '/f.php' ELSE '/' END",
                   content_type="CASE WHEN page_id % 4 = 1 THEN 'image/png' END")
    return links.asset_names(refs.select("page_id", F.lit(0).alias("ord"), "image_url", "content_type")).select("image_url", "n", "file_name")


# --- documents ------------------------------------------------------------------------------------------------

def redacted_sql(md: str) -> str:
    return md.replace("url || '#x'", f"{REDACTED} || ''").replace("url || '/a.png?w=1)", "regexp_extract(url || '/a.png?w=1', '^([^?#]*)', 1) || ')").replace("p?q=1)", "p)").replace(
        "'[code](' || url", f"'[code](' || {REDACTED}").replace("THEN home", f"THEN {REDACTED.replace('url', 'home')}").replace("|| home ||", f"|| {REDACTED.replace('url', 'home')} ||")


DEMOTED = NEW_MD.replace("'# Top'", "'### Top'")
REDACTED_MD = redacted_sql(DEMOTED)
LABEL = "replace(replace(title, '[', '\\['), ']', '\\]')"
OUT1_SQL = f"""{LINKED_SQL}, head AS (SELECT site, count(*) FILTER (success) AS pages, min_by({ORIGIN}, ord) FILTER (success) AS origin FROM anch GROUP BY site),
 body AS (SELECT site, ord, {REDACTED_MD} AS md, {N_REWRITTEN} AS n FROM hit)
SELECT site, 0 AS part, -1 AS ord, '---' || chr(10) || 'title: "批量导出文档"' || chr(10) || 'date: "{RUN}"' || chr(10) || 'pages: ' || pages || chr(10) || '---' || chr(10) || chr(10) || '# 批量导出文档' || chr(10) ||
 CASE WHEN pages > 0 THEN chr(10) || '## 文档信息' || chr(10) || chr(10) || '- **导出时间**：{RUN}' || chr(10) || '- **页面数量**：' || pages || ' 页' || chr(10) || '- **来源站点**：' || origin || chr(10) || chr(10) || '---' || chr(10) ELSE '' END || chr(10) || '## 目录' || chr(10) AS text FROM head
UNION ALL SELECT site, 1, ord, row_number() OVER (PARTITION BY site ORDER BY ord) || '. ' || CASE WHEN success THEN '[' || {LABEL} || '](#' || anchor || ')' ELSE '~~' || {LABEL} || '~~ (获取失败)' END FROM anch
UNION ALL SELECT site, 2, -1, chr(10) || '---' || chr(10) FROM head
UNION ALL SELECT a.site, 3, a.ord, CASE WHEN success THEN '<h2 id="' || anchor || '">' || {escq('title')} || '</h2>' || chr(10) || chr(10) || '- 来源：' || {REDACTED} || chr(10) || chr(10) || body.md || chr(10) || chr(10) || '---' || chr(10)
 ELSE '## ' || title || chr(10) || chr(10) || '> ⚠️ 获取失败：timeout' || chr(10) || chr(10) || '- 原始链接：' || {REDACTED} || chr(10) || chr(10) || '---' || chr(10) END FROM anch a LEFT JOIN body ON body.site = a.site AND body.ord = a.ord
UNION ALL SELECT site, 4, -1, chr(10) || '<!-- 站内链接改写：共 ' || sum(n)::BIGINT || ' 处 -->' FROM body GROUP BY site HAVING sum(n) > 0"""


@query("out1_merged_document", OUT1_SQL)
def _(spark, sf):
    return site.merged_sections(results(spark, sf), RUN)


@query("ag9_ordered_assembly", f"SELECT site, sum(length(text))::BIGINT AS chars, count(*) AS sections, sha256(string_agg(text, chr(10) ORDER BY part, ord)) AS document_sha256 FROM ({OUT1_SQL}) GROUP BY site")
def _(spark, sf):
    return site.assembled(site.merged_sections(results(spark, sf), RUN))


@query("out2_index_document", f"""{FILE_SQL}, head AS (SELECT site, count(*) FILTER (success) AS pages, min_by({ORIGIN}, ord) AS origin FROM base GROUP BY site)
SELECT site, 0 AS part, -1 AS ord, '---' || chr(10) || 'title: "批量导出索引"' || chr(10) || 'date: "{RUN}"' || chr(10) || 'pages: ' || pages || chr(10) || '---' || chr(10) || chr(10) || '# 批量导出索引' || chr(10) || chr(10) || '## 文档信息' || chr(10) || chr(10) ||
 '- **导出时间**：{RUN}' || chr(10) || '- **页面数量**：' || pages || ' 页' || chr(10) || '- **来源站点**：' || origin || chr(10) || chr(10) || '---' || chr(10) || chr(10) || '## 页面列表' || chr(10) AS text FROM head
UNION ALL SELECT b.site, 1, b.ord, row_number() OVER (PARTITION BY b.site ORDER BY b.ord) || '. ' || CASE WHEN b.success THEN '[' || {LABEL.replace('title', 'b.title')} || '](./' || names.file_name || ')' ELSE '~~' || {LABEL.replace('title', 'b.title')} || '~~ (获取失败: timeout)' END
 FROM base b LEFT JOIN names ON names.site = b.site AND names.ord = b.ord""")
def _(spark, sf):
    return site.index_lines(results(spark, sf), RUN)


YTITLE = "replace(replace(title, '\\', '\\\\'), '\"', '\\\"')"
FRONT = f"'---' || chr(10) || 'title: \"' || {YTITLE} || '\"' || chr(10) || 'source: \"' || {REDACTED} || '\"' || chr(10) || 'date: \"{RUN}\"' || chr(10) || '---' || chr(10) || chr(10)"
PLAIN_MD = redacted_sql(MD.replace("url || '#x)", "url || '#x' || ')"))
PAGE_DOC = f"{FRONT} || '# ' || title || chr(10) || chr(10) || '- Source: ' || {REDACTED} || chr(10) || chr(10) || {PLAIN_MD}"


@query("out3_page_documents", f"{FILE_SQL} SELECT site, ord, file_name, {PAGE_DOC} AS content FROM names")
def _(spark, sf):
    return site.page_files(results(spark, sf), RUN)


INDEX_SQL = ORACLES["out2_index_document"]
NAMED_SQL = f"""SELECT 'pages/' || site || '/' || file_name AS path, content FROM ({FILE_SQL} SELECT site, file_name, {PAGE_DOC} AS content FROM names)
UNION ALL SELECT 'pages/' || site || '/index.md', string_agg(text, chr(10) ORDER BY part, ord) FROM ({INDEX_SQL}) GROUP BY site
UNION ALL SELECT 'merged/' || site || '.md', string_agg(text, chr(10) ORDER BY part, ord) FROM ({OUT1_SQL}) GROUP BY site"""


@query("out3_named_files", NAMED_SQL)
def _(spark, sf):
    """All documents of all sites, written as files to the shared folder and read from there."""
    folder = f"{shared_folder(spark)}/documents-{uuid.uuid4().hex}"
    named_files.write_files(site.document_rows(results(spark, sf), RUN), folder)
    return named_files.read_files(spark, folder).select("path", F.col("content").cast("string").alias("content"))


@query("out4_front_matter", f"SELECT ord, replace({FRONT}, chr(10) || '---' || chr(10) || chr(10), chr(10) || 'tags: [\"a\", \"b\"]' || chr(10) || '---' || chr(10) || chr(10)) AS front FROM ({BASE_SQL})")
def _(spark, sf):
    return results(spark, sf).select("ord", site.front_matter(F.col("title"), urls.redact(F.col("url")), RUN, ["a", "b"]).alias("front"))


@query("out5_asset_map", f"SELECT {REDACTED} AS url, '[\"' || string_agg(DISTINCT 'a' || page_id % 3, '\",\"' ORDER BY 'a' || page_id % 3) || '\"]' AS paths FROM pages GROUP BY 1")
def _(spark, sf):
    a = table(spark, sf, "pages").select("url", F.concat(F.lit("a"), F.col("page_id") % 3).alias("local_path"))
    return rewrite.redacted_assets(a).select("url", F.to_json("paths").alias("paths"))


@query("out6_dual_output", f"SELECT 'merged' AS kind, site, part, ord, text FROM ({OUT1_SQL}) UNION ALL SELECT 'split', site, 0, ord, content FROM ({FILE_SQL} SELECT site, ord, {PAGE_DOC} AS content FROM names)")
def _(spark, sf):
    merged, split = site.dual_output(results(spark, sf), RUN, "../shared")
    return merged.select(F.lit("merged").alias("kind"), "site", "part", "ord", "text").union(
        split.select(F.lit("split"), "site", F.lit(0), "ord", "content"))


@query("out7_single_page", f"SELECT ord, {PAGE_DOC} AS content FROM ({BASE_SQL})")
def _(spark, sf):
    return results(spark, sf).select("ord", site.page_document(F.col("title"), F.col("url"), F.col("md"), RUN).alias("content"))


@query("page_results", f"SELECT page_id, url, {H1} AS title, true AS success, 0 AS images FROM pages")
def _(spark, sf):
    found = page_results(table(spark, sf, "pages"), PageOptions(strip_nav=True, exclude=".ad", auto_detect=False))
    return found.select("page_id", "url", "title", "success", F.size("image_urls").alias("images"))
