"""Main text of web pages by nearest-URL page differencing.

A page is read into text blocks. Blocks inside elements that never hold an article (menus, footers, forms, scripts, adverts, notices,
reader comments and the like, known by tag or by a word of their class or id) go. What remains lies inside ``article`` or
``main``, or outside of both. Every page is aligned, by longest common subsequence of all its blocks, with the page of its host whose
URL path is nearest in sorted order and that is neither empty nor a copy (over 80 of 100 characters shared); the outside blocks that
both share are deleted as template.

Blocks inside an ``article`` or ``main`` element are aligned too, but articles repeat whole passages and even each other, and a passage
that some articles share is part of each. Such a block is template only at the beginning or the end of the article, and only if it
is shared in order with each of the ``TEMPLATE_PAGES`` nearest pages that have another article (not over half of whose characters are
shared); with fewer such pages within ``REACH`` nothing is deleted there. If a page has an article element with text, its outside
blocks are not part of the main text. Pages of a host with equal blocks are one page here, at the first of their paths.

White space in a block becomes one blank, character references are decoded, blocks are joined by an empty line in page order. Null
and empty pages give an empty text; a page without a host or without another page on it is not differenced. Repeated rows and null ids are kept.
"""

from __future__ import annotations

import bisect
import html
import itertools
import re
from collections import defaultdict

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagemill.operators.sequence import row_numbers
from pagemill.session import durable

COPY_PERCENT = 80
#: Pages on each side, in the order of paths, that a page can be aligned with.
REACH = 8
#: Other articles that must share a block at the edge of an article before it counts as template, and what share of two articles makes them copies.
TEMPLATE_PAGES, SAME_PERCENT = 8, 50
#: Pages of a host that one task aligns.
BLOCK = 1_000
#: Deletions broadcast to the pages; beyond this number they are joined by shuffle.
BROADCAST_PAGES = 200_000

# Elements by their role, and words in class or id that mark what is not the article.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img".split())
DROPPED = frozenset("nav footer aside form script style noscript template iframe object svg canvas button select textarea dialog menu head title option audio video map".split())
NOTED = frozenset("""ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert popup
    modal overlay menu nav navbar navigation breadcrumb breadcrumbs sidebar sidebars rail footer topbar masthead toolbar share sharing social related recommended
    recommendations newsletter subscribe subscription signup login search comment comments commentlist reply replies respond disqus discussion pagination pager widget widgets
    skip copyright disclaimer tags""".split())
NEGATED = frozenset("no has with without hide hidden".split())
SELF_CLOSING = {"p": frozenset(["p"]), "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr", "td", "th"]),
                "td": frozenset(["td", "th"]), "th": frozenset(["td", "th"])}
BARRIER = frozenset("div section article main table ul ol dl blockquote body html td th".split())

_token = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|textarea|title|noscript|template|svg|iframe)\b[^>]*>.*?(?:</\1\s*>|\Z)|<(?:\"[^\"]*\"|'[^']*'|[^'\">])*>|<[^>]*>|[^<]+|<", re.S | re.I)
_tag = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)").match
_marks = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I).findall
_hidden = re.compile(r"""\shidden(?=[\s>=/])|aria-hidden\s*=\s*["']?true|display\s*:\s*none""", re.I).search
_words = re.compile(r"[a-z]+").findall

OUTSIDE, MAIN, GONE = 0, 1, 2


def unwanted(tag: str) -> bool:
    """True if a class, id or role names something that is not the article, or the element is hidden."""
    for group in _marks(tag):
        words = _words("".join(group).lower())
        for k, word in enumerate(words):
            if word in NOTED and not (k and words[k - 1] in NEGATED):
                return True
    return bool(_hidden(tag))


def blocks(page: str) -> list[tuple[int, str]]:
    """``(zone, text)`` of the page's blocks that are not gone."""
    out: list[tuple[int, str]] = []
    held: list[str] = []
    stack: list[tuple[str, int]] = []
    zone = OUTSIDE

    def close():
        if held:
            text = " ".join(html.unescape("".join(held)).split())
            held.clear()
            if text:
                out.append((zone, text))

    for m in _token.finditer(page):
        token = m.group()
        if token[0] != "<" or token == "<":
            if zone != GONE:
                held.append(token)
            continue
        tag = _tag(token)
        if m.group(1) or not tag:
            if not m.group(1) and token[1:2] not in ("!", "?", "/") and zone != GONE:
                held.append(token)  # a lone angle bracket
            continue
        ends, name = tag.group(1), tag.group(2).lower()
        if name == "br":
            held.append(" ")
            continue
        if name in VOID:
            if name not in INLINE:
                close()
            continue
        if ends:
            depth = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == name), None)
            if name not in INLINE:
                close()
            if depth is not None:
                zone = stack[depth][1]
                del stack[depth:]
            continue
        if name not in INLINE:
            close()
            closing = SELF_CLOSING.get(name)
            if closing:
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] in closing:
                        zone = stack[k][1]
                        del stack[k:]
                        break
                    if stack[k][0] in BARRIER:
                        break
        if token.endswith("/>") and name not in INLINE and name not in ("p", "div", "li"):
            continue
        stack.append((name, zone))
        if name in ("article", "main"):
            left = next((n for n, z in reversed(stack[:-1]) if z != GONE), "") if zone == GONE else ""
            if zone != GONE or left in ("nav", "header", "footer", "head"):  # an article is not inside these: they were left open
                zone = GONE if unwanted(token) and "comment" in token.lower() else MAIN
        elif zone != GONE and name not in ("html", "body") and (name in DROPPED or name == "header" and zone != MAIN or unwanted(token)):
            zone = GONE
    close()
    return out


def common_lines(a: list[int], b: list[int]) -> list[int]:
    """Indices in ``a`` of a longest common subsequence of the two lists."""
    places = defaultdict(list)
    for j, line in enumerate(b):
        places[line].append(j)
    ends: list[int] = []
    links: list[tuple] = []
    for i, line in enumerate(a):
        for j in reversed(places.get(line, ())):
            k = bisect.bisect_left(ends, j)
            node = (i, links[k - 1] if k else None)
            if k == len(ends):
                ends.append(j)
                links.append(node)
            else:
                ends[k], links[k] = j, node
    out, node = [], links[-1] if links else None
    while node:
        out.append(node[0])
        node = node[1]
    return out[::-1]


def shared_lines(a: list[tuple[int, int]], b: list[tuple[int, int]]) -> list[int]:
    """Places in ``a`` (lists of line hash and length) to delete; none if the pages are copies."""
    found = common_lines([h for h, _ in a], [h for h, _ in b])
    both = 100 * sum(a[i][1] for i in found)
    if both > COPY_PERCENT * sum(n for _, n in a) and both > COPY_PERCENT * sum(n for _, n in b):
        return []
    return found


def with_key(pages: DataFrame, page_id: str, url: str, page: str) -> DataFrame:
    """The three columns, and a key that equal rows share."""
    slim = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).alias("url"), F.coalesce(F.col(page), F.lit("")).alias("html"))
    return slim.withColumn("key", F.xxhash64("page_id", "url", "html"))


def page_lines(pages: DataFrame) -> DataFrame:
    """``key, host, path, lines, digest`` of the pages that have a host and text: hash, length and zone of each block."""
    line = pa.struct([("h", pa.int64()), ("n", pa.int64()), ("main", pa.bool_())])

    @F.arrow_udf(T.ArrayType(T.StructType([T.StructField("h", T.LongType()), T.StructField("n", T.LongType()), T.StructField("main", T.BooleanType())])))
    def lines(texts: pa.Array) -> pa.Array:
        return pa.array([[{"h": xxhash.xxh64_intdigest(t) - 2**63, "n": len(t), "main": z == MAIN} for z, t in blocks(text)] for text in texts.to_pylist()], pa.list_(line))

    host = F.lower(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    path = F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    found = pages.select("key", host.alias("host"), path.alias("path"), lines("html").alias("lines")).where("size(lines) > 0 AND host <> ''")
    return found.dropDuplicates(["key"]).withColumn("digest", F.xxhash64("lines"))


def common_prefix(a: str, b: str) -> int:
    return next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))


def template(path: str, lines: list, near: list[tuple[str, list]]) -> list[int]:
    """The places of a page's blocks that are template, given the ``path, lines`` of pages around it, the nearest first."""
    outside = not all(main for *_, main in lines)
    article = sum(n for _, n, main in lines if main)
    gone: list[int] = []
    shared, others = None, 0
    for _, other in near:
        if outside:
            found = shared_lines([x[:2] for x in lines], [x[:2] for x in other])
            if found or not {h for h, *_ in lines} & {h for h, *_ in other}:  # not a copy
                gone, outside = [k for k in found if not lines[k][2]], False
        if article and others < TEMPLATE_PAGES and shared != set():
            mine, theirs = ([(k, h, n) for k, (h, n, main) in enumerate(x) if main] for x in (lines, other))
            found = common_lines([h for _, h, _ in mine], [h for _, h, _ in theirs])
            both = 100 * sum(mine[i][2] for i in found)
            if theirs and both <= SAME_PERCENT * min(article, sum(n for *_, n in theirs)):
                shared = {mine[i][0] for i in found} & (shared if shared is not None else {k for k, *_ in mine})
                others += 1
        if not outside and (not article or others == TEMPLATE_PAGES or shared == set()):
            break
    if shared and others == TEMPLATE_PAGES:
        places = [k for k, (*_, main) in enumerate(lines) if main]
        for side in (places, places[::-1]):
            gone += itertools.takewhile(shared.__contains__, side)
    return sorted(set(gone))


def aligned(table: pa.Table) -> pa.Table:
    """``host, digest, gone`` of the pages of a block, which comes with ``REACH`` pages on either side."""
    rows = sorted(zip(*(table.column(c).to_pylist() for c in ("rn", "own", "path", "lines", "host", "digest"))), key=lambda r: r[0])
    pages = [(r[2], [(x["h"], x["n"], x["main"]) for x in r[3]]) for r in rows]
    out = []
    for k, (_, own, path, _, host, digest) in enumerate(rows):
        if own:
            sides = [pages[max(0, k - REACH):k][::-1], pages[k + 1:k + 1 + REACH]]
            near = sorted(((d, side, p) for side, found in enumerate(sides) for d, p in enumerate(found)), key=lambda x: (-common_prefix(x[2][0], path), x[0], x[1]))
            out.append((host, digest, template(path, pages[k][1], [p for *_, p in near])))
    out = [r for r in out if r[2]]
    return pa.table({"host": pa.array([r[0] for r in out], pa.string()), "digest": pa.array([r[1] for r in out], pa.int64()),
                     "gone": pa.array([r[2] for r in out], pa.list_(pa.int32()))})


def deletions(lines: DataFrame) -> DataFrame:
    """``key, gone``: the places of the blocks that are template, for pages that have such blocks.

    The different pages of a host are numbered in the order of their paths and dealt in blocks; the pages at the ends of a block go
    to the next block as well.
    """
    first = F.min(F.struct("path", "key")).alias("at")
    different = lines.groupBy("host", "digest").agg(first, F.first("lines").alias("lines")).select("host", "at.path", "at.key", "digest", "lines")
    numbered = row_numbers(different, ["host"], ["path", "key"]).withColumn("block", F.expr(f"(rn - 1) div {BLOCK}"))
    blocks_of = F.array_distinct(F.array(*[F.greatest(F.lit(0), F.expr(f"(rn - 1 + {d}) div {BLOCK}")) for d in (0, -REACH, REACH)]))
    dealt = numbered.withColumn("to", F.explode(blocks_of)).withColumn("own", F.col("to") == F.col("block"))
    gone = dealt.select("host", "to", "rn", "own", "path", "lines", "digest").groupBy("host", "to").applyInArrow(
        aligned, "host string, digest long, gone array<int>")
    return lines.select("key", "host", "digest").join(gone, ["host", "digest"]).select("key", "gone")


@F.arrow_udf(T.StringType())
def main_text(pages: pa.Array, gone: pa.Array) -> pa.Array:
    """The main text of a page, without the blocks at the places given."""
    out = []
    for page, places in zip(pages.to_pylist(), gone.to_pylist()):
        found = blocks(page)
        zone = MAIN if any(z == MAIN for z, _ in found) else OUTSIDE
        drop = set(places or ())
        out.append("\n\n".join(t for k, (z, t) in enumerate(found) if z == zone and k not in drop))
    return pa.array(out, pa.string())


def extract(pages: DataFrame, page_id: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """``page_id, url, text, n_chars`` of every page."""
    keyed = with_key(pages, page_id, url, page)
    gone = durable(deletions(durable(page_lines(keyed))))
    few = F.broadcast if gone.count() <= BROADCAST_PAGES else (lambda df: df)
    joined = keyed.join(few(gone), "key", "left")
    text: Column = main_text("html", "gone")
    return joined.select("page_id", "url", text.alias("text")).withColumn("n_chars", F.length("text").cast("bigint"))
