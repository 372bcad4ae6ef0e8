"""Pages in, page results out: the one job behind batch conversion and saved pages."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.functions import markdown_text as mt, urls
from pagemill.functions.text import bind, blank_to_null, is_filled
from pagemill.operators import classify, embedded, links, markdown, regions, titles
from pagemill.sources.pages import size_error


@dataclass(frozen=True)
class PageOptions:
    target_ids: str = ""
    target_classes: str = ""
    strip_nav: bool = False
    strip_toc: bool = False
    exclude: str = ""
    auto_detect: bool = False
    anchor_list_threshold: int = 0
    wiki_noise: bool = False
    keep_html: bool = False
    embedded_articles: bool = True
    force: bool = False
    max_html_bytes: int = 0


def _names(text: str) -> list[str]:
    return [s.strip() for s in text.split(",") if s.strip()]


def _with_embedded(base: DataFrame, wanted: bool) -> DataFrame:
    """Add the embedded article (``e``) of pages that carry one in their scripts."""
    if not wanted:
        return base.withColumn("e", F.lit(None).cast("struct<title:string,body:string,is_markdown:boolean>"))
    may_have = base.where(F.contains("html", F.lit("__NEXT_DATA__")) | F.contains("html", F.lit("_ROUTER_DATA"))
                          | (F.size(embedded.candidate_scripts(F.col("html"))) > 0))
    found = embedded.articles(may_have).select("page_id", F.struct("title", "body", "is_markdown").alias("e"))
    return base.join(found, "page_id", "left")


def page_results(pages: DataFrame, options: PageOptions = PageOptions(), rules: DataFrame | None = None) -> DataFrame:
    """``page_id, url, title, md, success, error, image_urls``. ``pages``: ``page_id, url, html`` and optionally ``title``.

    ``rules`` (``site, rank, selector``) name elements to strip by site, the host with its port; those with a null site hold for all.

    Every page gives a row: one without HTML, or with more than ``max_html_bytes`` of it, fails with an error. Pages that need
    no conversion (failed, or with a ready article) go through with no HTML; what is known about a page travels along with it.
    """
    custom = F.col("title") if "title" in pages.columns else F.lit(None).cast("string")
    unusable = size_error(F.col("html"), options.max_html_bytes)
    base = pages.select("page_id", "url", F.when(unusable.isNull(), F.col("html")).otherwise(F.lit("")).alias("html"), custom.alias("custom"), unusable.alias("unusable"))
    joined = _with_embedded(base, options.embedded_articles)
    checked = joined.withColumn("error", F.coalesce("unusable", classify.gate_error(classify.challenge(F.col("html")), F.col("e").isNotNull(), options.force)))
    is_ready = F.col("error").isNull() & F.coalesce(F.col("e.is_markdown"), F.lit(False))
    shown = F.when(F.col("e").isNotNull() & ~F.col("e.is_markdown"), F.col("e.body")).otherwise(F.col("html"))
    paged = checked.withColumns({"ready": is_ready, "html": shown}).withColumn(
        "is_messenger", classify.is_messenger_url(F.col("url")) | classify.is_messenger_html(F.col("html")))
    drawn = F.when(F.col("is_messenger") & classify.is_async_article(F.col("html")) & ~F.col("ready"), embedded.async_fields(F.col("html")))
    paged = paged.withColumn("drawn", drawn).withColumn("drawn", F.when(F.col("drawn.content") != "", F.col("drawn")))
    convert = F.col("error").isNull() & ~F.col("ready") & F.col("drawn").isNull()

    ids, classes = _names(options.target_ids), _names(options.target_classes)
    aim = lambda i, c: [("id", x) for x in i] + [("class", x) for x in c]
    own = regions.selector_list(options.strip_nav, options.strip_toc, options.exclude)
    targets, selectors, route = {"plain": aim(ids, classes)}, {"plain": own}, F.lit("plain")
    if not ids and not classes:
        targets["messenger"], selectors["messenger"] = aim([], ["rich_media_content"]), own
        route = F.when(F.col("is_messenger"), "messenger").otherwise(route)
    if options.auto_detect:
        route = F.coalesce(classify.applied_preset(classify.framework(F.col("html"))), route)
        for p in classify.PRESETS:
            targets[p["name"]] = aim(ids or p["target_ids"], classes or p["target_classes"])
            selectors[p["name"]] = regions.selector_list(True, True, ",".join([options.exclude, *p["exclude"]]))

    known = F.coalesce(blank_to_null(F.col("custom")), blank_to_null(F.col("e.title")), F.col("drawn.title"),
                       F.when(F.col("is_messenger"), titles.messenger_title(F.col("html"))))
    facts = paged.select(
        "page_id", "url", "error", "custom", "is_messenger", F.when(convert, route).alias("route"), known.alias("known_title"),
        titles.title_tag(F.col("html")).alias("tag_title"), F.when(convert, F.col("html")).alias("html"),
        F.when(convert, titles.main_html(F.col("html"))).alias("article"),
        F.when(F.col("ready"), F.col("e.body")).otherwise(embedded.async_markdown(F.col("drawn"))).alias("ready_md"), "ready")
    fields = ["url", "error", "custom", "is_messenger", "route", "known_title", "tag_title", "article", "ready_md", "ready"]

    rows, fresh = facts, True
    aimed = [r for r, t in targets.items() if t]
    if aimed:
        needs = rows.withColumn("_aimed", F.when(F.col("route").isin(*aimed), F.col("html"))).withColumn("_way", F.col("route"))
        cut = regions.target_sections(needs, targets, "_aimed", route="_way", carry=fields, spread_first=fresh)
        rows, fresh = cut.withColumn("article", F.coalesce("html", "article")).drop("html", "selector"), False
    pruned = [r for r, s in selectors.items() if s or rules is not None]
    if pruned:
        needs = rows.withColumn("_pruned", F.when(F.col("route").isin(*pruned), F.col("article"))).withColumn("_way", F.col("route"))
        needs = needs.withColumn("_site", urls.authority(F.col("url"))) if rules is not None else needs
        kept = regions.strip_elements(needs, selectors, "_pruned", route="_way", carry=fields, spread_first=fresh, rules=rules, site="_site")
        rows, fresh = kept.withColumn("article", F.when(F.col("route").isin(*pruned), F.col("html")).otherwise(F.col("article"))).select("page_id", *fields), False

    titled = rows.withColumn("title", F.when(F.col("error").isNotNull(), F.coalesce("custom", "url")).otherwise(F.coalesce(
        "known_title", titles.first_heading(F.col("article")), "tag_title", F.lit("Untitled"))))
    titled = titled.withColumn("image_urls", F.coalesce(links.page_images(F.col("article"), F.col("url")), F.array().cast("array<string>")))
    carried = ["url", "error", "is_messenger", "route", "title", "image_urls", "ready_md", "ready"]
    done = markdown.html_to_markdown(titled.withColumn("_base", F.col("url")), "article", "_base", keep_html=options.keep_html,
                                     carry=carried, spread_first=fresh)

    body = bind(F.col("md"), lambda m: mt.drop_duplicate_title(m, F.col("title")))
    body = F.when(F.col("is_messenger"), mt.drop_messenger_noise(body)).otherwise(body)
    if options.wiki_noise:
        body = mt.drop_wiki_noise(body)
    absolute = mt.absolute_images(F.col("ready_md"), F.col("url"))
    ready = F.when(F.col("ready"), mt.drop_duplicate_title(absolute, F.col("title"))).otherwise(F.col("ready_md"))
    final = done.withColumn("md", F.when(F.col("route").isNotNull(), body).otherwise(F.coalesce(ready, F.lit(""))))
    final = final.withColumn("image_urls", F.when(F.col("ready"), mt.image_urls(F.col("md"), F.col("url"))).otherwise(F.col("image_urls")))
    threshold = options.anchor_list_threshold or (10 if options.auto_detect else 0)
    if threshold > 0:
        applies = F.lit(True) if options.anchor_list_threshold else ~F.col("route").isin("plain", "messenger")
        stripped = bind(F.col("md"), lambda m: mt.drop_anchor_lists(m, threshold)["md"])
        final = final.withColumn("md", F.when(applies & (F.col("ready") | F.col("route").isNotNull()), stripped).otherwise(F.col("md")))
    error = F.coalesce("error", F.when(~is_filled(F.col("md")), F.lit("empty body after conversion")))
    return final.withColumn("error", error).select(
        "page_id", "url", "title", F.when(F.col("error").isNull(), F.col("md")).otherwise(F.lit("")).alias("md"),
        F.col("error").isNull().alias("success"), "error", "image_urls")
