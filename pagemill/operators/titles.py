"""Main content and titles of a page, as map-side expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagemill.functions.entities import unescape
from pagemill.functions.text import blank_to_null, first_match, squeeze, strip


def best_section(html: Column, tag: str) -> Column:
    """Longest inner HTML of ``tag`` (the first one on ties), NULL when there is none or it is empty."""
    inner = F.regexp_extract_all(html, F.lit(rf"(?is)<{tag}\b[^>]*>(.*?)</{tag}>"), F.lit(1))
    ranked = F.transform(inner, lambda s, i: F.struct(F.length(s).alias("n"), (-i).alias("first"), s.alias("s")))
    return blank_to_null(F.array_max(ranked)["s"])


def main_html(html: Column) -> Column:
    return F.coalesce(best_section(html, "article"), best_section(html, "main"), best_section(html, "body"), html)


def title_tag(html: Column) -> Column:
    return blank_to_null(squeeze(unescape(first_match(html, r"(?is)<title\b[^>]*>(.*?)</title>"))))


def first_heading(html: Column) -> Column:
    """Text of the first h1; an h1 that never closes runs to the end of the fragment."""
    inner = first_match(html, r"(?is)<h1(?=[\s/>])[^>]*>(.*?)(?:</h1\s*>|\z)")
    bare = F.regexp_replace(inner, r"(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>", "")
    runs = F.filter(F.split(bare, r"<[A-Za-z/!][^>]*>"), lambda t: strip(unescape(t)) != "")
    return blank_to_null(squeeze(unescape(F.array_join(runs, ""))))


def messenger_title(html: Column) -> Column:
    heading = first_match(html, r"""(?is)<h1[^>]*class=["'][^"']*rich_media_title[^"']*["'][^>]*>(.*?)</h1>""")

    def meta(key: str) -> Column:
        raw = first_match(html, rf"""(?i)<meta[^>]*{key}["'][^>]*content=["']([^"']+)["']""")
        return blank_to_null(strip(unescape(raw)))

    return F.coalesce(blank_to_null(squeeze(unescape(F.regexp_replace(heading, "<[^>]+>", "")))),
                      meta("""property=["']og:title"""), meta("""name=["']twitter:title"""))


def resolve(custom: Column, embedded: Column, is_messenger: Column, html: Column, article: Column) -> Column:
    """Custom title, embedded title, messenger title (messenger pages only), first heading, title tag, 'Untitled'."""
    return F.coalesce(
        blank_to_null(custom), blank_to_null(embedded), F.when(is_messenger, messenger_title(html)),
        first_heading(article), title_tag(html), F.lit("Untitled"))


def file_title(embedded: Column, is_messenger: Column, html: Column) -> Column:
    """Title used for automatic file names: like :func:`resolve`, headings searched on the whole page."""
    return F.coalesce(blank_to_null(embedded), F.when(is_messenger, messenger_title(html)),
                      first_heading(html), title_tag(html), F.lit("Untitled"))

