"""Rewriting destinations inside Markdown by lookup in a table of URLs.

Documents are cut into pieces; only the pieces that are links or images are looked up, and the lookup is safe against
a URL that a large part of all documents points to.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.functions import markdown_text as mt, urls
from pagemill.operators import sequence
from pagemill.session import durable

_LINK = r"(?<!!)\[[^\]]+\]\([^)]+\)"
_IMAGE = r"""!\[[^\]]*\]\([^)\s]+\)|(?i:<img\b[^>]*\bsrc=["'][^"']+["'])"""


def pieces(docs: DataFrame, pattern: str, md: str, key: str, fences: bool, carry: list[str] | None = None) -> DataFrame:
    """``key, *carry, seg, i, piece, hit``: text cut at the matches of a pattern; with ``fences``, fenced code is left whole."""
    kept = [key, *(carry or [])]
    cut = F.lit(rf"(?s){pattern}|(?:(?!{pattern}).)++")
    blocks = mt.segments(F.col(md)) if fences else F.array(F.col(md))
    segs = docs.select(*kept, F.posexplode(blocks).alias("seg", "_s"))
    inner = F.when(mt.is_fence(F.col("_s")), F.array("_s")).otherwise(F.regexp_extract_all("_s", cut, F.lit(0))) if fences else (
        F.regexp_extract_all("_s", cut, F.lit(0)))
    hit = F.col("piece").rlike(rf"(?s)\A(?:{pattern})\z")
    if fences:
        hit = hit & ~mt.is_fence(F.col("_s"))
    return segs.select(*kept, "seg", "_s", F.posexplode(inner).alias("i", "piece")).select(*kept, "seg", "i", "piece", hit.alias("hit"))


def link_candidates(url: Column) -> Column:
    """Spellings under which a link target may be known, in the order they are tried."""
    raw_fragment = F.when(urls.fragment(url) != "", urls.defragment(url))
    return F.array_distinct(F.array_compact(F.array(url, urls.percent_decode(url), raw_fragment, urls.redact(url))))


def image_candidates(url: Column) -> Column:
    return F.array_distinct(F.array_compact(F.array(url, urls.percent_encode(url, ":/?&=#"), urls.percent_decode(url))))


def resolve(found: DataFrame, table: DataFrame, candidates: Column, ids: list[str], value: str, group: str | None = None) -> DataFrame:
    """``ids, value``: the first candidate that the table (``url, value`` and optionally a group column) knows.

    Both sides are slim and stored once: what is looked up, and the entries.
    """
    key = F.col("candidate") if group is None else F.concat_ws("\x01", F.col(group), F.col("candidate"))
    right_key = F.col("url") if group is None else F.concat_ws("\x01", F.col(group), F.col("url"))
    tries = found.select(*ids, *([group] if group and group not in ids else []), F.posexplode(candidates).alias("priority", "candidate"))
    tries = durable(tries.select(*ids, "priority", key.alias("_lookup")))
    known = durable(table.select(right_key.alias("_lookup"), F.col(value)))
    joined = sequence.lookup(tries, known, "_lookup", value).where(F.col(value).isNotNull())
    return joined.groupBy(*ids).agg(F.min_by(value, "priority").alias(value))


def _put_back(cut: DataFrame, found: DataFrame, new_piece: Column, key: str, value: str) -> DataFrame:
    joined = cut.join(found, [key, "seg", "i"], "left")
    changed = F.col("hit") & F.col(value).isNotNull()
    return joined.withColumn("_p", F.when(changed, new_piece).otherwise(F.col("piece"))).groupBy(key).agg(
        F.expr("listagg(_p, '') WITHIN GROUP (ORDER BY seg, i)").alias("md"), F.count_if(changed).alias("rewritten"))


def internal_links(docs: DataFrame, anchors: DataFrame, md: str = "md", key: str = "page_id", group: str | None = None) -> DataFrame:
    """``key, md, rewritten``: links to known pages become anchors. ``anchors``: ``url, anchor`` (unique per group)."""
    carry = [group] if group is not None else []
    cut = pieces(docs, _LINK, md, key, True, carry)
    target = F.regexp_extract("piece", r"(?s)\A\[[^\]]+\]\(([^)]+)\)\z", 1)
    hits = cut.where("hit").select(key, *carry, "seg", "i", target.alias("_t"))
    found = resolve(hits, anchors, link_candidates(F.col("_t")), [key, "seg", "i"], "anchor", group)
    label = F.regexp_extract("piece", r"(?s)\A(\[[^\]]+\])", 1)
    return _put_back(cut, found, F.concat(label, F.lit("(#"), "anchor", F.lit(")")), key, "anchor")


def local_images(docs: DataFrame, assets: DataFrame, md: str = "md", key: str = "page_id") -> DataFrame:
    """``key, md, rewritten``: image destinations become local paths. ``assets``: ``url, local_path``."""
    cut = pieces(docs, f"(?:{_IMAGE})", md, key, fences=False)
    target = F.coalesce(F.nullif(F.regexp_extract("piece", r"(?s)\A!\[[^\]]*\]\(([^)\s]+)\)\z", 1), F.lit("")),
                        F.regexp_extract("piece", r"""(?is)\bsrc=["']([^"']+)["']\z""", 1))
    hits = cut.where("hit").select(key, "seg", "i", target.alias("_t"))
    found = resolve(hits, assets, image_candidates(F.col("_t")), [key, "seg", "i"], "local_path")
    front = F.when(F.col("piece").startswith("!"), F.regexp_extract("piece", r"(?s)\A(!\[[^\]]*\]\()", 1)).otherwise(
        F.regexp_extract("piece", r"""(?is)\A(.*\bsrc=["'])""", 1))
    return _put_back(cut, found, F.concat(front, "local_path", F.right(F.col("piece"), F.lit(1))), key, "local_path")


def redacted_assets(assets: DataFrame) -> DataFrame:
    """``url, paths``: distinct local paths per redacted URL, in path order."""
    return assets.select(urls.redact(F.col("url")).alias("url"), "local_path").distinct().groupBy("url").agg(
        F.array_sort(F.collect_list("local_path")).alias("paths"))
