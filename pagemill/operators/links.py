"""Links and images of a page, and the crawl list built from them.

Extraction is a map over pages (nothing is shuffled); only the list-wide steps group by URL, and they do so with
aggregates that merge copies before the exchange.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.functions import entities, urls
from pagemill.functions.text import bind, blank_to_null, strip
from pagemill.operators import sequence, tokens as tk

_HREF_OPEN = r"""<a(?=\s)(?:[^>"']|"[^"]*"|'[^']*')*?\shref\s*=\s*(?:"[^"]+"|'[^']+'|[^\s"'>]+)[^>]*>"""
_ANCHOR = rf"(?is){_HREF_OPEN}(?:(?!{_HREF_OPEN})(?!</a[\s>]).)*+</a\s*>"


def first_by(items: Column, field: str) -> Column:
    """Keep the first struct per ``field``, in order; the structs have an integer ``i``."""
    rest = F.array_sort(F.transform(items, lambda x: F.struct(x[field].alias("k"), x["i"].alias("i"), x.alias("x"))))
    firsts = F.filter(rest, lambda x, n: (n == 0) | (x["k"] != F.get(rest, n - 1)["k"]))
    return F.transform(F.array_sort(F.transform(firsts, lambda x: F.struct(x["i"].alias("i"), x["x"].alias("x")))),
                       lambda x: x["x"])


def page_links(html: Column, base: Column, pattern: str | None = None, same_domain: bool = True) -> Column:
    """ARRAY<STRUCT<i, url, text, page_url>>: absolute links, one per target without its fragment."""
    found = F.regexp_extract_all(tk.without_raw(html), F.lit(_ANCHOR), F.lit(0))

    def one(a: Column, i: Column) -> Column:
        href = tk.attr(tk.attr_map(F.regexp_extract(a, r"""(?is)^(<a(?:[^>"']|"[^"]*"|'[^']*')*>)""", 1)), "href")
        inner = F.regexp_replace(F.regexp_replace(a, r"(?is)^<a[^>]*>|</a\s*>$", ""), r"<[A-Za-z/!][^>]*>", "")
        text = strip(entities.unescape(inner))
        return bind(href, lambda h: bind(urls.join_url(base, h), lambda u: F.struct(
            i.alias("i"), u.alias("url"), F.coalesce(blank_to_null(text), u).alias("text"),
            urls.defragment(u).alias("page_url"), h.alias("href"))))

    def wanted(x: Column) -> Column:
        keep = ~x["href"].startswith("#") & ~F.contains(x["url"], F.lit("cmd=edit")) & ~F.contains(
            x["url"], F.lit("cmd=secedit"))
        if same_domain:
            keep = keep & (urls.authority(x["url"]) == urls.authority(base))
        if pattern:
            keep = keep & x["url"].rlike(pattern)
        return keep

    return bind(F.filter(F.transform(found, one), wanted), lambda items: first_by(items, "page_url"))


def links(pages: DataFrame, html: str = "html", base: str = "url", key: str = "page_id", **options) -> DataFrame:
    """``key, ord, url, text, page_url`` (ord counts the kept links of a page from zero)."""
    found = page_links(F.col(html), F.col(base), **options)
    return pages.select(key, F.posexplode(found).alias("ord", "_l")).select(
        key, "ord", "_l.url", "_l.text", "_l.page_url")


def crawl_list(listed: DataFrame, crawled: DataFrame) -> DataFrame:
    """The listed URLs as they are, followed by crawled ones not yet there (compared without fragments).

    ``listed``: ``ord, url, title``; ``crawled``: ``page_id, ord, url, text``. Result: ``source, page_id, ord,
    url, title``, in list order, then in crawl order.
    """
    fresh = sequence.first_seen(
        crawled.withColumn("page_url", urls.defragment(F.col("url"))), ["page_url"], ["page_id", "ord"], ["url", "text"])
    known = listed.select(urls.defragment(F.col("url")).alias("page_url")).distinct()
    added = fresh.join(known, "page_url", "left_anti")
    return listed.select(F.lit(0).alias("source"), F.lit(0).cast("bigint").alias("page_id"),
                         F.col("ord").cast("bigint").alias("ord"), "url", "title").unionByName(
        added.select(F.lit(1).alias("source"), F.col("page_id").cast("bigint").alias("page_id"),
                     F.col("ord").cast("bigint").alias("ord"), "url", F.col("text").alias("title")))


# --- images ---------------------------------------------------------------------------------------------------

_UNIT = r"(?is)<picture\b[^>]*>.*?(?:</picture\s*>|\z)|<img\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*>"


def first_of_srcset(value: Column) -> Column:
    return blank_to_null(F.substring_index(strip(F.substring_index(value, ",", 1)), " ", 1))


def image_source(attrs: Column) -> Column:
    """The URL an image really shows: lazy-loading attributes win over inline placeholders."""
    def usable(name: str) -> Column:
        value = blank_to_null(tk.attr(attrs, name))
        return F.when(~F.lower(strip(value)).startswith("data:"), value)
    # Attribute order.
    return F.coalesce(*[usable(n) for n in ["src", "data-src", "data-original", "data-lazy-src"]],
                      first_of_srcset(tk.attr(attrs, "srcset")))


def page_images(html: Column, base: Column) -> Column:
    """ARRAY of absolute image URLs in page order, without icons, inline data and repeats."""
    img = F.lit(r"(?is)<img\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*>")

    def of_unit(u: Column) -> Column:
        before = F.regexp_extract(u, r"(?is)^(<picture\b.*?)<img\b", 1)
        source = first_of_srcset(tk.attr(tk.attr_map(F.regexp_extract(before, r"(?is)(<source\b[^>]*\bsrcset\b[^>]*>)", 1)), "srcset"))
        tags = F.regexp_extract_all(u, img, F.lit(0))
        return F.transform(tags, lambda t, i: F.coalesce(F.when(i == 0, source), bind(tk.attr_map(t), image_source)))

    raw = F.flatten(F.transform(F.regexp_extract_all(tk.without_raw(html), F.lit(_UNIT), F.lit(0)), of_unit))
    clean = F.filter(F.transform(raw, lambda r: strip(entities.unescape(r))),
                     lambda r: r.isNotNull() & (r != "") & ~r.startswith("data:"))
    full = F.transform(clean, lambda r: urls.join_url(base, r))
    return F.array_distinct(F.filter(full, lambda u: ~urls.is_icon(u)))


def images(pages: DataFrame, html: str = "html", base: str = "url", key: str = "page_id") -> DataFrame:
    return pages.select(key, F.posexplode(page_images(F.col(html), F.col(base))).alias("ord", "image_url"))


def asset_names(image_refs: DataFrame, batch: list[str] | None = None) -> DataFrame:
    """Number the distinct images of each batch in first-seen order and give each a file name.

    ``image_refs``: ``page_id, ord, image_url`` with optional ``content_type``, ``content`` and batch columns.
    Result: batch columns, ``image_url, n, file_name, page_id`` (the page that showed it first).
    """
    from pagemill.functions import binary

    groups = batch or []
    extra = [c for c in ["content_type", "content"] if c in image_refs.columns]
    unique = sequence.first_seen(image_refs, [*groups, "image_url"], ["page_id", "ord"], extra)
    if not groups:
        unique = unique.withColumn("_all", F.lit(0))
    numbered = sequence.row_numbers(unique, groups or ["_all"], ["page_id", "ord"], "n")
    base = urls.percent_decode(F.regexp_extract(F.regexp_replace(urls.path(F.col("image_url")), "/+$", ""), r"([^/]*)$", 1))
    named = F.coalesce(blank_to_null(base), F.concat(F.lit("image-"), F.col("n").cast("string")))
    ext = F.regexp_extract(named, r"(?<=[^.])(\.[^.]*)$", 1)
    root = F.substring(named, F.lit(1), F.length(named) - F.length(ext))
    # Extensions kept as they are.
    known = F.lower(ext).isin(".png", ".jpg", ".jpeg", ".gif", ".webp", ".svg", ".avif", ".bmp", ".ico")
    by_type = binary.extension_from_type(F.col("content_type")) if "content_type" in extra else F.lit(None).cast("string")
    by_bytes = binary.extension_from_bytes(F.col("content")) if "content" in extra else F.lit(None).cast("string")
    final = F.when(known, ext).otherwise(F.coalesce(by_type, by_bytes, blank_to_null(ext), F.lit(".bin")))
    number = F.when(F.col("n") < 1000, F.lpad(F.col("n").cast("string"), 3, "0")).otherwise(F.col("n").cast("string"))
    name = F.concat(number, F.lit("-"), urls.plain_stem(root), final)
    return numbered.select(*groups, "image_url", "n", name.alias("file_name"), "page_id")
