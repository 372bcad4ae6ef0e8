"""Verdicts on page URLs: explicit rules, and redirect equivalence for what no rule names.

Pages are aliases of each other when redirects or canonical links connect their URLs: the connected components of the graph whose edges
lead from a page's URL to the target of its ``<link rel=canonical>`` and of its refreshing ``<meta>``, and from source to target of
redirects given as a table. A URL that a rule fits has the rule's verdict. Any other URL takes part in its component: it is
allowed if the component has a URL that a rule allows (explicit allow goes first), blocked if it has one that a rule blocks, else allowed.
Targets count whether or not they are pages of the table.

A rule (verdict, host, path) fits its host and all subdomains where the URL's path starts with the rule's path; the one with the longest
host and path wins, allow before block. The host is what lies between the first ``://`` and ``/``, ``?``, ``#`` or the end, with A-Z in
lower case; the path goes on to ``?``, ``#`` or the end.

Every task joins the URLs it reads in a union-find over at most ``NODES`` of them and names the groups it finds by its own number, so
a target that a third of all pages share becomes one group in each task, not one key. Only URLs that several groups hold link groups,
and components are searched for among groups. Verdicts go back by group, whose size is bounded by ``NODES``.

URLs are the same when they agree without fragment, with scheme and host in lower case. Null URLs and those without ``://`` have an empty
host and path and fit no rule; a null URL is no alias of anything and is allowed. Null or empty HTML has no edges. Repeated rows are
judged one by one. Empty tables give no rows. Other columns, whatever their names, are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.functions.entities import unescape
from pagemill.functions.text import strip
from pagemill.functions.urls import join_url
from pagemill.llm.components import components
from pagemill.operators import tokens as tk
from pagemill.session import durable

#: ``verdict, host, path``.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
NODES = 200_000
_parts = re.compile(r"(.*?)://([^/?#]*)([^?#]*)(\?[^#]*)?", re.S)
_lower = {c: c + 32 for c in range(65, 91)}


def split_url(url: str | None) -> tuple[str, str]:
    """Host and path, both empty without ``://``."""
    found = _parts.match(url or "")
    return (found[2].translate(_lower), found[3]) if found else ("", "")


def identity(url: str) -> str:
    """The URL without its fragment, scheme and host in lower case."""
    found = _parts.match(url)
    return f"{found[1].translate(_lower)}://{found[2].translate(_lower)}{found[3]}{found[4] or ''}" if found else url.split("#", 1)[0]


class Rules:
    """Rules by host, those of one host from the longest path to the shortest."""

    def __init__(self, rules: Iterable[tuple[str, str, str]]):
        self.by_host: dict[str, list[tuple[str, str]]] = {}
        for verdict, host, path in sorted(rules, key=lambda r: (-len(r[2]), r[0])):
            self.by_host.setdefault(host, []).append((path, verdict))

    def fitting(self, host: str, path: str) -> tuple[str | None, str | None]:
        """Rule and verdict for a URL, (None, None) if no rule fits."""
        best, rest = None, host
        while rest:
            for start, verdict in self.by_host.get(rest, ()):
                if path.startswith(start):
                    best = min(best or (1,), (-len(rest) - len(start), verdict, rest + start))
                    break
            rest = rest.partition(".")[2]
        return (best[2], best[1]) if best else (None, None)


def alias_targets(url: Column, html: Column) -> Column:
    """Absolute targets of the canonical links and refreshes of a page."""
    tags = F.regexp_extract_all(tk.without_raw(html), F.lit(r"(?i)<(?:link|meta)\b(?:\"[^\"]*+\"|'[^']*+'|[^'\">])*+>"), F.lit(0))

    def target(tag: Column) -> Column:
        def of(m: Column) -> Column:
            rel = F.split(F.lower(F.coalesce(tk.attr(m, "rel"), F.lit(""))), r"\s+")
            refresh = F.lower(strip(F.coalesce(tk.attr(m, "http-equiv"), F.lit("")))) == "refresh"
            content = F.regexp_extract(tk.attr(m, "content"), r"""(?is)^\s*[\d.]*\s*[;,\s]\s*url\s*=\s*["']?(.*?)["']?\s*$""", 1)
            return F.when(tag.rlike("(?i)^<link") & F.array_contains(rel, "canonical"), strip(tk.attr(m, "href"))).when(tag.rlike("(?i)^<meta") & refresh, strip(content))
        return F.get(F.transform(F.array(tk.attr_map(tag)), of), F.lit(0))

    found = F.filter(F.transform(tags, target), lambda t: F.coalesce(t, F.lit("")) != "")
    absolute = F.transform(found, lambda t: join_url(url, t))
    none = F.array().cast("array<string>")
    return F.when(html.rlike("(?i)canonical|refresh") & url.isNotNull(), F.coalesce(absolute, none)).otherwise(none)


class Groups:
    """Union-find over URL digests; groups get numbers when it is emptied."""

    def __init__(self):
        self.number, self.above, self.flags = {}, [], []

    def node(self, key: bytes, verdict: str | None) -> int:
        n = self.number.get(key)
        if n is None:
            n = self.number[key] = len(self.above)
            self.above.append(n)
            self.flags.append((verdict == "allow") * 2 + (verdict == "block"))
        return n

    def top(self, n: int) -> int:
        while self.above[n] != n:
            self.above[n] = n = self.above[self.above[n]]
        return n

    def join(self, a: int, b: int) -> None:
        a, b = self.top(a), self.top(b)
        if a != b:
            self.above[max(a, b)] = min(a, b)


GROUPED = "page_id long, url string, host string, path string, rule string, verdict string, is_page boolean, `group` long, node binary, size long, flags long"


def grouped(edges: DataFrame, rules: Rules) -> DataFrame:
    """Pages with their rule and group, then the URLs of each group, then groups of several URLs with what their rules say."""
    def run(batches):
        base, schema = TaskContext.get().partitionId() << 32, pa.schema([
            ("page_id", pa.int64()), *[(c, pa.string()) for c in ("url", "host", "path", "rule", "verdict")], ("is_page", pa.bool_()),
            ("group", pa.int64()), ("node", pa.binary()), ("size", pa.int64()), ("flags", pa.int64())])
        found, pages, judged = Groups(), [], {}

        def name(url: str) -> tuple[int, str, str, str | None, str | None]:
            if url not in judged:
                host, path = split_url(url)
                rule, verdict = rules.fitting(host, path)
                judged[url] = (found.node(hashlib.md5(identity(url).encode("utf-8", "surrogatepass")).digest(), verdict), host, path, rule, verdict)
            return judged[url]

        def rows():
            tops = [found.top(n) for n in range(len(found.above))]
            size, flags = [0] * len(tops), [0] * len(tops)
            for n, t in enumerate(tops):
                size[t] += 1
                flags[t] |= found.flags[n]
            out = [(i, url, *judged_, True, None if n is None else base + tops[n], None, None, None if n is None else flags[tops[n]]) for i, url, n, judged_ in pages]
            out += [(None,) * 6 + (False, base + tops[n], key, size[tops[n]], flags[tops[n]]) for key, n in found.number.items()]
            for a in range(0, len(out), 20_000):
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out[a:a + 20_000]), schema)], schema=schema)

        for batch in batches:
            for is_page, i, url, targets in zip(*(batch.column(c).to_pylist() for c in range(4))):
                if url is None:
                    pages.append((i, None, None, ("", "", None, None)))
                    continue
                n, *rest = name(url)
                if is_page:
                    pages.append((i, url, n, tuple(rest)))
                for t in targets:
                    found.join(n, name(t)[0])
                if len(judged) + len(pages) >= NODES:
                    yield from rows()
                    base += len(found.above)
                    found, pages, judged = Groups(), [], {}
        if pages or found.above:
            yield from rows()

    return edges.mapInArrow(run, GROUPED)


def judge(pages: DataFrame, rules: Iterable[tuple[str, str, str]] = RULES, redirects: DataFrame | None = None, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """``page_id, host, path, rule, verdict, url`` of every page. ``redirects``: more edges, ``source, target``."""
    own = pages.select(F.lit(True).alias("is_page"), F.col(page_id).cast("bigint").alias("page_id"), F.col(url).alias("url"), alias_targets(F.col(url), F.col(html)).alias("targets"))
    if redirects is not None:
        own = own.union(redirects.where("source IS NOT NULL AND target IS NOT NULL").select(F.lit(False), F.lit(None).cast("bigint"), "source", F.array("target")))
    rows = durable(grouped(own, Rules(rules)))
    nodes = rows.where("node IS NOT NULL").select("node", "group", "size", "flags")
    least = nodes.groupBy("node").agg(F.min("group").alias("least"), F.count("*").alias("n")).where("n > 1").drop("n")
    links = nodes.join(least, "node").where("group != least").select("least", "group")
    part = durable(components(links).select(F.col("node").alias("group"), "component"))
    said = nodes.where("size > 1").groupBy("group").agg(F.first("flags").alias("flags"))
    said = part.join(said, "group").groupBy("component").agg(F.bit_or("flags").alias("said"))
    linked = part.join(said, "component").select("group", "said")
    judged = rows.where("is_page").join(linked, "group", "left")
    flags = F.coalesce(F.col("said"), F.lit(0)).bitwiseOR(F.coalesce(F.col("flags"), F.lit(0)))
    aliased = F.when((flags.bitwiseAND(F.lit(2)) == 0) & (flags.bitwiseAND(F.lit(1)) == 1), "block").otherwise("allow")
    return judged.select("page_id", "host", "path", "rule", F.coalesce("verdict", aliased).alias("verdict"), "url")
