"""Element regions in the token table: strip matching subtrees, cut out a target element.

A region ends at the first later token whose running depth falls below that of its start tag. Since depth moves
in steps of one, that is the next end tag on the same level: one window per (page, level) finds it, without a
self-join and without ever looking at two pages at once.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagemill.functions.text import bind, strip
from pagemill.operators import tokens as tk

# Selectors for navigation and for in-page tables of contents.
NAV_SELECTORS = ["nav", "aside", "[role=navigation]", "[role=complementary]", ".sidebar", ".side-bar", ".sidenav",
                 ".side-nav", ".nav-sidebar", ".menu", ".navigation", ".site-nav", ".doc-sidebar",
                 ".theme-doc-sidebar-container", ".pagination-nav"]
TOC_SELECTORS = [".toc", ".table-of-contents", ".on-this-page", ".page-toc", ".article-toc", "[data-toc]",
                 ".theme-doc-toc-mobile", ".theme-doc-toc-desktop"]

_FOREVER = 1 << 60


def selector_set(nav: bool = False, toc: bool = False, custom: str = "") -> Column:
    """ARRAY of selectors: defaults, then the comma-separated own ones, first occurrence kept."""
    own = F.filter(F.transform(F.split(F.lit(custom), ","), strip), lambda s: s != "")
    default = (NAV_SELECTORS if nav else []) + (TOC_SELECTORS if toc else [])
    fixed = F.array(*[F.lit(s) for s in default]).cast("array<string>")
    return F.array_distinct(F.concat(fixed, own))


def selector_list(nav: bool = False, toc: bool = False, custom: str = "") -> list[str]:
    default = (NAV_SELECTORS if nav else []) + (TOC_SELECTORS if toc else [])
    return list(dict.fromkeys(default + [s.strip() for s in custom.split(",") if s.strip()]))


@dataclass(frozen=True)
class Tag:
    """The columns of a start tag that selectors look at."""

    name: Column
    attrs: Column
    classes: Column

    def matches(self, selector: str) -> Column:
        s = selector.strip()
        if s.startswith("."):
            return F.array_contains(self.classes, s[1:])
        if s.startswith("#"):
            return F.coalesce(strip(tk.attr(self.attrs, "id")) == s[1:], F.lit(False))
        if s.startswith("[") and s.endswith("]"):
            label, sep, wanted = s[1:-1].partition("*=") if "*=" in s else s[1:-1].partition("=")
            label, wanted = label.strip().lower(), wanted.strip()
            if len(wanted) >= 2 and wanted[0] == wanted[-1] and wanted[0] in "\"'":
                wanted = wanted[1:-1]
            if not sep:
                return tk.attr(self.attrs, label).isNotNull()
            value = tk.attr(self.attrs, label)
            hit = F.contains(value, F.lit(wanted)) if sep == "*=" else value == wanted
            return F.coalesce(hit, F.lit(False))
        return self.name == s.lower()


def first_rule(tag: Tag, selectors: list[str]) -> Column:
    """The first selector that matches the tag, NULL for none."""
    return F.coalesce(*[F.when(tag.matches(s), F.lit(s)) for s in selectors], F.lit(None).cast("string"))


def with_rule(toks: DataFrame, rule: Column) -> DataFrame:
    """Add ``rule`` for start tags (``rule`` may use the columns ``attrs`` and ``classes``)."""
    opening = F.col("kind").isin("start", "selfclose", "raw")
    head = F.when(F.col("kind") == "raw", F.regexp_extract("tok", r"^(<[^>]*>)", 1)).otherwise(F.col("tok"))
    read = toks.withColumn("attrs", F.when(opening, tk.attr_map(head)))
    listed = read.withColumn("classes", F.when(F.col("attrs").isNotNull(), tk.classes(F.col("attrs"))))
    return listed.withColumn("rule", F.when(opening, rule)).drop("classes", "attrs")


def tag_columns() -> Tag:
    return Tag(F.col("name"), F.col("attrs"), F.coalesce(F.col("classes"), F.array().cast("array<string>")))


def with_region_end(marked: DataFrame, key: str = "page_id") -> DataFrame:
    """Add ``region_end`` to the rows whose ``rule`` is set; needs ``delta`` and ``depth``."""
    level = F.col("depth") + F.when(F.col("kind") == "end", 1).otherwise(0)
    closing = F.when(F.col("kind") == "end", F.col("pos"))
    leveled = marked.withColumn("_level", level).withColumn("_close", closing)
    by_level = Window.partitionBy(key, "_level").orderBy("pos")
    follows = F.expr("lead(_close, 1) IGNORE NULLS").over(by_level)
    end = F.when(F.col("delta") == 0, F.col("pos")).otherwise(F.coalesce(follows, F.lit(_FOREVER)))
    return leveled.withColumn("region_end", F.when(F.col("rule").isNotNull(), end)).drop("_level", "_close")


def strip_regions(toks: DataFrame, selectors: list[str] | None = None, rule: Column | None = None,
                  key: str = "page_id") -> DataFrame:
    """Mark what a stripping pass removes: ``removed`` tokens, and ``hit`` on the outermost matched start tags."""
    deep = tk.with_depth(toks, key, tk.VOID_STRIP)
    if "rule" not in toks.columns:
        deep = with_rule(deep, rule if rule is not None else first_rule(tag_columns(), selectors or []))
    ended = with_region_end(deep, key)
    before = tk.by_page(key).rowsBetween(Window.unboundedPreceding, -1)
    reach = F.coalesce(F.max("region_end").over(before), F.lit(-1))
    inside = reach >= F.col("pos")
    return (
        ended.withColumn("_inside", inside)
        .withColumn("hit", F.col("rule").isNotNull() & ~F.col("_inside"))
        .withColumn("removed", F.col("_inside") | F.col("hit"))
        .drop("_inside")
    )


def _by_route(route: str | None, options: dict, build) -> Column:
    """One expression for all pages: ``build(option)`` of the route each page takes."""
    if route is None:
        return build(options)
    out = F.lit(None)  # the branches give it its type
    for name, option in options.items():
        out = F.when(F.col(route) == name, build(option)).otherwise(out)
    return out


def strip_elements(pages: DataFrame, selectors: list[str] | dict[str, list[str]], html: str = "html", key: str = "page_id",
                   route: str | None = None, carry: list[str] | None = None, spread_first: bool = True, rules: DataFrame | None = None,
                   site: str = "site") -> DataFrame:
    """``key, html, elements_removed, chars_before, chars_after`` for every page, plus the carried columns.

    With a ``route`` column, ``selectors`` maps each route to its own list; all routes share one pass. Rules of a table (``site, rank,
    selector``) go before the lists.
    """
    rule = _by_route(route, selectors, lambda s: first_rule(tag_columns(), s))
    if rules is not None:
        toks = tk.tokens(with_site_rules(pages, rules, site), html, key, keep=[route] if route else None, carry=carry,
                         mark=lambda t: table_rule(t, [F.col("_own"), F.col("_all")])["selector"]).withColumnRenamed("rule", "_listed")
        return _stripped(strip_regions(toks, rule=F.coalesce("_listed", rule), key=key), key, carry)
    toks = tk.tokens(pages, html, key, keep=[route] if route else None, carry=carry, spread_first=spread_first)
    return _stripped(strip_regions(toks, rule=rule, key=key), key, carry)


def _stripped(marked: DataFrame, key: str, carry: list[str] | None) -> DataFrame:
    written = F.when(~F.col("removed"), tk.canonical(F.col("tok"), F.col("kind"), F.col("name")))
    joined = tk.join_tokens(
        marked.withColumn("_out", written), "_out", key,
        extra=[F.count_if("hit").alias("elements_removed"), F.sum(F.length("tok")).alias("chars_before"),
               *([F.first("carry", ignorenulls=True).alias("carry")] if carry else [])])
    done = joined.withColumn("chars_after", F.length("html").cast("bigint"))
    return done.select(*[c for c in done.columns if c != "carry"], "carry.*") if carry else done


# --- rules as tables ------------------------------------------------------------------------------------------

def read_selector(selector: Column) -> Column:
    """STRUCT<key, name, op, wanted>: what a tag must have to be looked at (``t:`` name, ``c:`` class, ``i:`` id, ``a:`` attribute), and the test of
    the attribute's value (``=``, ``*=`` or '')."""
    def read(s: Column) -> Column:
        inner = F.substring(s, F.lit(2), F.length(s) - 2)
        op = F.when(F.contains(inner, F.lit("*=")), "*=").when(F.contains(inner, F.lit("=")), "=").otherwise("")
        cut = lambda g: F.when(op == "*=", F.regexp_extract(inner, r"(?s)^(.*?)\*=(.*)$", g)).when(op == "=", F.regexp_extract(inner, r"(?s)^([^=]*)=(.*)$", g)).otherwise(inner)
        name, after = F.lower(strip(cut(1))), strip(cut(2))
        wanted = F.regexp_replace(after, r"""(?s)^(["'])(.*)\1\z""", "$2")
        rest, none = F.substring(s, F.lit(2), F.length(s)), F.lit("")

        def of(key: Column, *test: Column) -> Column:
            return F.struct(key.alias("key"), *[t.alias(n) for t, n in zip(test or (none, none, none), ("name", "op", "wanted"))])
        return (F.when(s.startswith("."), of(F.concat(F.lit("c:"), rest))).when(s.startswith("#"), of(F.concat(F.lit("i:"), rest)))
                .when(s.startswith("[") & s.endswith("]"), of(F.concat(F.lit("a:"), name), name, op, F.when(op == "", "").otherwise(wanted)))
                .otherwise(of(F.concat(F.lit("t:"), F.lower(s)))))
    return bind(strip(selector), read)


def rule_index(rules: DataFrame) -> DataFrame:
    """``site, index``: the rules of a site by what a tag must have. ``rules``: ``site, rank, selector``; a null site stands for all sites.

    An index is as large as the list of rules of one site, not of all.
    """
    parsed = rules.select("site", read_selector(F.col("selector")).alias("s"), "rank", "selector").where("selector IS NOT NULL")
    entry = F.struct(F.col("rank").cast("bigint").alias("rank"), "selector", "s.name", "s.op", "s.wanted")
    by_key = parsed.groupBy("site", F.col("s.key").alias("key")).agg(F.sort_array(F.collect_set(entry)).alias("entries"))
    return by_key.groupBy("site").agg(F.map_from_entries(F.collect_list(F.struct("key", "entries"))).alias("index"))


def table_rule(tok: Column, indexes: list[Column]) -> Column:
    """STRUCT<rank, selector> of the first rule by rank in any of the indexes that fits a token, NULL for none and for all but start tags."""
    head = F.regexp_extract(tok, r"^(<[^>\"']*+(?:\"[^\"]*+\"[^>\"']*+|'[^']*+'[^>\"']*+)*+>|<[^>]*>)", 1)
    name = F.lower(F.regexp_extract(tok, r"^<([A-Za-z][^\s/>]*)", 1))

    def at(index: Column) -> Callable[[Column], Column]:
        return lambda k: F.try_element_at(index, k)

    def found(attrs: Column) -> Column:
        ids = F.when(tk.attr(attrs, "id").isNotNull(), F.array(F.concat(F.lit("i:"), strip(tk.attr(attrs, "id")))))
        none = F.array().cast("array<string>")
        filled = F.map_keys(F.map_filter(attrs, lambda k, v: v.isNotNull()))
        keys = F.concat(F.array(F.concat(F.lit("t:"), name)), F.coalesce(F.transform(tk.classes(attrs), lambda c: F.concat(F.lit("c:"), c)), none),
                        F.coalesce(ids, none), F.coalesce(F.transform(filled, lambda a: F.concat(F.lit("a:"), a)), none))
        listed = [F.flatten(F.array_compact(F.transform(keys, at(index)))) for index in indexes]
        all_ = F.concat(*[F.coalesce(x, F.array().cast("array<struct<rank:bigint,selector:string,name:string,op:string,wanted:string>>")) for x in listed])

        def fits(r: Column) -> Column:
            value = F.try_element_at(attrs, r["name"])
            return F.when(r["op"] == "", True).when(r["op"] == "=", value == r["wanted"]).otherwise(F.contains(value, r["wanted"]))
        return F.array_min(F.transform(F.filter(all_, lambda r: F.coalesce(fits(r), F.lit(False))), lambda r: F.struct(r["rank"].alias("rank"), r["selector"].alias("selector"))))
    return F.when(name != "", bind(tk.attr_map(head), found))


def with_site_rules(pages: DataFrame, rules: DataFrame, site: str = "site") -> DataFrame:
    """Pages with ``_own`` and ``_all``, the indexes of their site's rules and of the rules for all sites.

    One row of a site meets its pages; no rule is part of the plan, however many there are. A hot site's pages are split by the skew join.
    """
    index = rule_index(rules)
    own = index.where("site IS NOT NULL").select(F.col("site").alias("_rule_site"), F.col("index").alias("_own"))
    shared = index.where("site IS NULL").select("index").scalar()
    return pages.join(own, F.col(site) == F.col("_rule_site"), "left").drop("_rule_site").withColumn("_all", shared)


def strip_by_rules(pages: DataFrame, rules: DataFrame, html: str = "html", key: str = "page_id", site: str = "site") -> DataFrame:
    """As :func:`strip_elements`, with rules from a table (``site, rank, selector``); of the rules that fit a tag the lowest rank counts."""
    toks = tk.tokens(with_site_rules(pages, rules, site), html, key, mark=lambda t: table_rule(t, [F.col("_own"), F.col("_all")])["selector"])
    return _stripped(strip_regions(toks, key=key), key, None)


def rule_hits(pages: DataFrame, rules: DataFrame, html: str = "html", key: str = "page_id", site: str = "site") -> DataFrame:
    """``site, selector, hits``: tags that each rule of a table is the first to fit."""
    toks = tk.tokens(with_site_rules(pages, rules, site), html, key, keep=[site], mark=lambda t: table_rule(t, [F.col("_own"), F.col("_all")])["selector"])
    return toks.where("rule IS NOT NULL").groupBy(site, F.col("rule").alias("selector")).agg(F.count("*").alias("hits"))


def sections_by_table(pages: DataFrame, targets: DataFrame, html: str = "html", key: str = "page_id", site: str = "site") -> DataFrame:
    """As :func:`target_sections`, with targets from a table ``site, rank, how, value`` (how: id or class)."""
    rules = targets.where("how IN ('id', 'class')").select("site", "rank", F.concat(F.when(F.col("how") == "id", "#").otherwise("."), "value").alias("selector"))

    def label(t: Column) -> Column:
        def named(r: Column) -> Column:
            how = F.when(r["selector"].startswith("#"), "id=").otherwise("class=")
            return F.when(r.isNotNull(), F.struct(r["rank"].alias("rank"), F.concat(how, F.substring(r["selector"], F.lit(2), F.length(r["selector"]))).alias("label")))
        return bind(table_rule(t, [F.col("_own"), F.col("_all")]), named)
    toks = tk.tokens(with_site_rules(pages, rules, site), html, key, mark=label)
    return _sections(tk.with_depth(toks, key, tk.VOID_TARGET), key, None)


def rule_counts(pages: DataFrame, selectors: list[str], html: str = "html", key: str = "page_id") -> DataFrame:
    """Hits per rule over the corpus."""
    marked = strip_regions(tk.tokens(pages, html, key), selectors, key=key)
    return marked.where("hit").groupBy("rule").agg(F.count("*").alias("hits"))


def target_sections(pages: DataFrame, targets: list[tuple[str, str]] | dict[str, list[tuple[str, str]]], html: str = "html",
                    key: str = "page_id", route: str | None = None, carry: list[str] | None = None,
                    spread_first: bool = True) -> DataFrame:
    """Cut out the first element hit by the best target; ``targets`` are ("id"|"class", value) in priority order.

    Returns ``key, html, selector`` of the pages with a hit, or of all pages (html NULL without a hit) together with the
    carried columns. With a ``route`` column, each route has its own targets.
    """
    cut = tk.tokens(pages, html, key, keep=[route] if route else None, carry=carry, spread_first=spread_first)
    toks = tk.with_depth(cut, key, tk.VOID_TARGET)
    tag = tag_columns()

    def best_target(options: list[tuple[str, str]]) -> Column:
        found = [F.when(tag.matches(("#" if how == "id" else ".") + value), F.struct(
            F.lit(i).alias("rank"), F.lit(f"{how}={value}").alias("label"))) for i, (how, value) in enumerate(options)]
        return F.coalesce(*found) if found else F.lit(None).cast("struct<rank:int,label:string>")

    return _sections(with_rule(toks, _by_route(route, targets, best_target)), key, carry)


def _sections(ruled: DataFrame, key: str, carry: list[str] | None) -> DataFrame:
    """The first element with the lowest ``rule`` (rank, label) of each page."""
    ended = with_region_end(ruled, key)
    whole = Window.partitionBy(key)
    best = F.min(F.when(F.col("rule").isNotNull(), F.struct("rule", "pos", "region_end"))).over(whole)
    inside = F.coalesce(F.col("pos").between(F.col("_best.pos"), F.col("_best.region_end")), F.lit(False))
    kept = ended.withColumn("_best", best).where((inside | F.col("carry").isNotNull()) if carry else inside)
    written = F.when(inside, tk.canonical(F.col("tok"), F.col("kind"), F.col("name")))
    joined = tk.join_tokens(kept.withColumn("_out", written), "_out", key, extra=[
        F.min("_best.rule.label").alias("selector"), *([F.first("carry", ignorenulls=True).alias("carry")] if carry else [])])
    section = F.nullif(strip(F.col("html")), F.lit(""))
    if carry:
        return joined.select(key, section.alias("html"), "selector", "carry.*")
    return joined.select(key, section.alias("html"), "selector").where("html IS NOT NULL")
