"""HTML to Markdown over the token table.

Every token becomes at most one Markdown fragment; a plain table is one token. What a token needs to know about its surroundings (inside a link,
a table, code, math, the list it belongs to, how many line breaks the output ends with) comes from windows over the
page's tokens; the text inside a link, cell or code block is gathered on the tag that closes it. The page is shuffled
once, before it is cut up.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagemill.functions import entities, markdown_text as mt, urls
from pagemill.functions.text import WS, bind, blank_to_null, first_match, html_escape, is_filled, replace_all, strip
from pagemill.operators import links, tokens as tk

# Element groups of the conversion.
SKIPPED = ["svg", "video", "audio", "button"]
HEADINGS = ["h1", "h2", "h3", "h4", "h5", "h6"]
BLOCK_LEVEL = ["p", "div", *HEADINGS, "ul", "ol", "li", "table", "thead", "tbody", "tr", "td", "th", "blockquote",
               "pre", "hr", "section", "article", "header", "footer", "main", "aside", "nav", "figure", "figcaption",
               "details", "summary", "form", "fieldset"]
CODE_LANGUAGES = ["bash", "c", "cpp", "csharp", "css", "go", "html", "java", "javascript", "js", "json", "kotlin", "perl",
                  "php", "python", "py", "ruby", "rust", "scala", "shell", "sh", "sql", "swift", "toml", "typescript",
                  "ts", "xml", "yaml", "yml"]
# Tags that change the output. Others are dropped at once on pages where nothing but the output depends on them.
ACTIVE = ["a", "img", "p", "br", "hr", *HEADINGS, "pre", "code", "annotation", "strong", "b", "em", "i", "ul", "ol", "li",
          "blockquote", "table", "tr", "td", "th", *SKIPPED]
# A whole table without tables, raw elements, comments or muted elements inside; its tags are those of ``tokens.TOKEN``.
_QUOTED = r"[^>\"']*+(?:\"[^\"]*+\"[^>\"']*+|'[^']*+'[^>\"']*+)*+"
TABLE = (rf"<table(?=[\s>]){_QUOTED}(?<!/)>(?:[^<]++|<(?!/?(?:(?:table|annotation|{'|'.join(SKIPPED)})(?:[\s/>])|(?:script|style)\b))/?[a-z]{_QUOTED}>)*+</table\s*>")
CJK = r"[\u3400-\u9fff\u3040-\u30ff\uac00-\ud7af\uff00-\uffef]"

# Private separators used while the pieces of a table are one string.
ROW, ROW_END, CELL, CELL_END, LINK, LINK_URL, LINK_TEXT, LINK_END = (
    "\x11", "\x17", "\x12", "\x13", "\x14", "\x1d", "\x15", "\x16")


def code_language(attrs: Column) -> Column:
    """Language of a code element from its attributes, '' when unknown or not a plain word."""
    explicit = F.coalesce(*[blank_to_null(F.regexp_extract(strip(tk.attr(attrs, a)), r"^(\S+)", 1))
                            for a in ["data-language", "data-lang", "lang"]])

    def from_classes(found: Column) -> Column:
        marked = F.filter(F.transform(found, lambda c: first_match(c, r"^(?:language|lang)[-_]([A-Za-z0-9_+.\-]+)$")),
                          lambda c: c.isNotNull())
        known = F.filter(F.transform(found, F.lower), lambda c: c.isin(*CODE_LANGUAGES))
        return F.coalesce(F.get(marked, 0), F.get(known, 0))

    chosen = F.coalesce(explicit, bind(tk.classes(attrs), from_classes), F.lit(""))
    return bind(chosen, lambda c: F.when(c.rlike(r"^[A-Za-z0-9_+.\-]+$"), c).otherwise(F.lit("")))


def safe_tag(tok: Column, kind: Column, name: Column) -> Column:
    """A tag kept as HTML, without event handlers and without executable URLs."""
    found = F.regexp_extract_all(F.regexp_replace(tok, r"^<[^\s/>]+|[\s/]*>\z", ""), F.lit(tk._ATTR), F.lit(0))

    def pair(a: Column) -> Column:
        value = F.regexp_replace(F.regexp_replace(a, r"(?s)^[^\s=]+\s*=?\s*", ""), r"""(?s)^(["'])(.*)\1\z""", "$2")
        return F.struct(F.lower(F.regexp_extract(a, r"^([^\s=]+)", 1)).alias("n"), F.contains(a, F.lit("=")).alias("has"),
                        entities.unescape(value).alias("v"))

    def allowed(p: Column) -> Column:
        bare = F.lower(F.regexp_replace(p["v"], r"[\x00-\x20]+", ""))
        bad = p["n"].isin("href", "src", "xlink:href", "srcset") & bare.rlike("^(?:javascript|vbscript):")
        bad = bad | ((p["n"] == "href") & bare.startswith("data:"))
        bad = bad | (p["n"].isin("src", "xlink:href") & bare.startswith("file:"))
        return ~p["n"].startswith("on") & ~(p["has"] & bad)

    written = F.transform(F.filter(F.transform(found, pair), allowed), lambda p: F.when(
        p["has"], F.concat(p["n"], F.lit('="'), html_escape(p["v"]), F.lit('"'))).otherwise(p["n"]))
    return F.when(kind == "end", F.concat(F.lit("</"), name, F.lit(">"))).otherwise(
        F.concat(F.lit("<"), F.concat_ws(" ", F.array(name), written), F.lit(">")))


def _href(attrs: Column) -> Column:
    return bind(tk.attr(attrs, "href"), lambda h: F.when(~urls.is_unsafe_link(h), h))


def _full(href: Column, base: Column, parts: Column | None = None) -> Column:
    return F.when(F.coalesce(href, F.lit("")) != "", urls.join_url(base, href, parts))


def _image(attrs: Column, base: Column, parts: Column | None = None) -> Column:
    """Markdown of an ``img``, NULL for icons and embedded data."""
    url = bind(links.image_source(attrs), lambda s: F.when(
        s.isNotNull() & ~F.lower(strip(s)).startswith("data:"), urls.join_url(base, s, parts)))
    alt = replace_all(strip(F.coalesce(tk.attr(attrs, "alt"), F.lit(""))), [("[", ""), ("]", "")])
    return bind(url, lambda u: F.when(u.isNotNull() & ~urls.is_icon(u), F.concat(
        F.lit("!["), alt, F.lit("]("), urls.link_destination(u), F.lit(")"))))


def _single_blanks(text: Column) -> Column:
    return F.regexp_replace(text, r"[ \t\r\f\x0b]{2,}|[\t\r\f\x0b]", " ")


def _no_returns(text: Column) -> Column:
    return F.replace(text, F.lit("\r"), F.lit(" "))


def is_whole_table(tok: Column) -> Column:
    return tok.startswith("<") & tok.rlike(rf"(?is)\A<table(?=[\s>]){_QUOTED}>.*</table\s*>\z")


def _cells(tok: Column, base: Column, pieces: Column) -> Column:
    """The separated string of a plain table, its own tags included.

    Tags become separators for the whole table at once; only links, images and text from an ampersand on are looked at one by one. Where a
    tag has angle brackets inside, the table goes token by token (``pieces``). Blanks are made single with the cells.
    """
    def link(attrs: Column, parts: Column) -> Column:
        return bind(_href(attrs), lambda h: F.concat(F.lit(LINK), F.coalesce(h, F.lit("")), F.lit(LINK_URL),
                                                     F.coalesce(_full(h, base, parts), F.lit("")), F.lit(LINK_TEXT)))

    def part(tok: Column, parts: Column) -> Column:
        name = F.lower(F.regexp_extract(tok, r"^<(/?[A-Za-z][^\s/>]*)", 1))
        return F.when(~tok.startswith("<"), _single_blanks(entities.unescape(tok))).otherwise(bind(name, lambda n: (
            F.when(n.isin("td", "th"), CELL).when(n.isin("/td", "/th"), CELL_END).when(n == "tr", ROW).when(n == "/tr", ROW_END)
            .when(n.isin("br", "p", "div", "li", "/p", "/div", "/li"), "<br>").when(n == "a", bind(tk.attr_map(tok), lambda a: link(a, parts)))
            .when(n == "/a", LINK_END).when(n == "img", bind(tk.attr_map(tok), lambda a: _image(a, base, parts))))))

    def special(p: Column, parts: Column) -> Column:
        return (F.when(p.startswith("&"), _no_returns(entities.unescape(p)))
                .when(p.rlike(r"(?i)^<a[\s/>]"), bind(tk.attr_map(p), lambda a: link(a, parts)))
                .when(p.rlike(r"(?i)^<img[\s/>]"), bind(tk.attr_map(p), lambda a: _image(a, base, parts)))
                .otherwise(_no_returns(F.replace(p, F.lit("<>"), F.lit("")))))

    def each(found: Column, use: Callable[[Column, Column], Column]) -> Column:
        return bind(urls.parts(base), lambda parts: F.array_join(F.transform(found, lambda p: use(p, parts)), ""))

    rest, void = r"(?=[\s/>])[^>]*>", "|".join(tk.VOID_CONVERT)
    marked = F.when(F.contains(tok, F.lit("/>")), F.regexp_replace(
        tok, rf"(?i)<(?!(?:{void})[\s/>])([a-z][^\s/>]*)([^>]*)/>", "<$1$2></$1>")).otherwise(tok)
    for names, sign in [("t[dh]", CELL), ("/t[dh]", CELL_END), ("tr", ROW), ("/tr", ROW_END), ("/a", LINK_END), ("(?:br|/?(?:p|div|li))", "<br>")]:
        marked = F.regexp_replace(marked, f"(?i)<{names}{rest}", sign)
    # Any other tag leaves a mark, so that no reference goes on behind it.
    marked = F.regexp_replace(marked, r"(?i)<(?!(?:a|img)[\s/>]|br>)[^>]*>", "<>")
    apart = r"(?i)<(?:a|img)(?=[\s/>])[^>]*>|&[^<&]*+|(?:[^<&]++|<(?!(?:a|img)[\s/>]))++"
    at_once = bind(marked, lambda m: F.when(m.rlike(r"(?i)&|<(?:a|img)[\s/>]"), each(F.regexp_extract_all(m, F.lit(apart), F.lit(0)), special))
                   .otherwise(_no_returns(F.replace(m, F.lit("<>"), F.lit("")))))
    simple = r"""[^<>"']*+(?:"[^"<>]*+"[^<>"']*+|'[^'<>]*+'[^<>"']*+)*+"""
    return F.when(tok.rlike(f"<(?!{simple}>)"), each(pieces, part)).otherwise(at_once)


# --- per-token columns ----------------------------------------------------------------------------------------

def _cut(pages: DataFrame, html: str, base: str, key: str, keep_html: bool, carry: list[str], spread_first: bool) -> DataFrame:
    """Tokens with everything that depends on one tag alone; page URL and HTML go no further."""
    slim = pages.select(key, F.col(html).alias("_html"), F.coalesce(F.col(base), F.lit("")).alias("_base"),
                        *([F.struct(*carry).alias("_carry")] if carry else []))
    spread = tk.spread(slim, key) if spread_first else slim
    html_col = F.col("_html")
    void = "|".join(tk.VOID_CONVERT)

    def opened(t: Column) -> Column:
        name = F.regexp_extract(t, r"^<([A-Za-z][^\s/>]*)", 1)
        empty = t.endswith("/>") & (name != "") & ~t.rlike(rf"(?i)^<(?:{void})[\s/>]")
        return F.when(empty, F.array(F.concat(F.regexp_replace(t, r"/>\z", ""), F.lit(">")),
                                     F.concat(F.lit("</"), name, F.lit(">")))).otherwise(F.array(t))

    def cut_up(t: Column, pieces: Column) -> Column:
        return bind(pieces, lambda p: F.when(F.contains(t, F.lit("/>")), F.flatten(F.transform(p, opened))).otherwise(p))

    # decided once per page: formulas and media cards look at every tag, cells also break lines at div
    every = F.lit(True) if keep_html else F.contains("_html", F.lit("katex")) | F.contains("_html", F.lit("kg-"))
    with_table = html_col.rlike("(?i)<table")
    flags = [F.coalesce(every, F.lit(True)).alias("_every"), F.coalesce(with_table, F.lit(True)).alias("_cells")]
    pieces = F.regexp_extract_all(html_col, F.lit(tk.TOKEN), F.lit(0))
    if not keep_html:
        # A table is one token where all tables of the page are plain ones and nothing around them can reach into their cells.
        apart = with_table & ~every & ~html_col.rlike(r"(?i)<(?:annotation|pre)[\s/>]") & ~(F.contains("_html", F.lit("&")) & html_col.rlike(
            r"""(?i)class\s*=\s*(?:"[^"]*&|'[^']*&|[^\s"'>]*&)"""))
        whole = F.regexp_extract_all(html_col, F.lit(f"(?is){TABLE}|" + tk.TOKEN.removeprefix("(?is)")), F.lit(0))
        nested = lambda t: t.startswith("<") & t.rlike(r"(?i)\A</?table[\s/>]") & ~is_whole_table(t)
        pieces = F.when(F.coalesce(apart, F.lit(False)), bind(whole, lambda p: F.when(F.exists(p, nested), pieces).otherwise(p))).otherwise(pieces)
    paired = cut_up(html_col, pieces)
    if carry:  # page columns travel on an empty token in front of the page
        paired = F.concat(F.array(F.lit("")), F.coalesce(paired, F.array().cast("array<string>")))
    cut = spread.select(key, "_base", *(["_carry"] if carry else []), *flags, paired.alias("_pieces")).select(
        key, "_base", *(["_carry"] if carry else []), "_every", "_cells", F.posexplode("_pieces").alias("pos", "tok"))
    if carry:
        cut = cut.withColumn("carry", F.when(F.col("pos") == 0, F.col("_carry"))).drop("_carry")
    kind = bind(tk.kind_of(F.col("tok")), lambda k: F.when(k == "selfclose", F.lit("start")).otherwise(k))
    if not keep_html:
        kind = F.when(F.col("_cells") & is_whole_table(F.col("tok")), F.lit("table")).otherwise(kind)
    name = F.lower(F.regexp_extract("tok", r"^</?([A-Za-z][^\s/>]*)", 1))
    cut = cut.withColumn("kind", kind).withColumn(
        "name", F.when(F.col("kind").isin("start", "end", "raw"), name).otherwise(F.lit("")))
    active = F.col("name").isin(*ACTIVE) | ((F.col("name") == "div") & F.col("_cells")) | F.col("_every")
    cut = cut.where(~F.col("kind").isin("comment", "decl") & (active | ~F.col("kind").isin("start", "end")))

    # Attributes are read once, as a map, and only from tags the conversion looks at.
    read = ["a", "img", "pre", "code", "script", "annotation", "ol", "td", "th"]
    head = F.when(F.col("kind") == "raw", F.regexp_extract("tok", r"^(<[^>]*>)", 1)).otherwise(F.col("tok"))
    wanted = F.col("kind").isin("start", "raw") & (F.col("name").isin(*read) | F.contains("tok", F.lit("class")))
    cut = cut.withColumn("attrs", F.when(wanted, tk.attr_map(head)))
    attrs = F.col("attrs")
    tok, start, tag = F.col("tok"), F.col("kind") == "start", F.col("name")
    classed = start & tk.has_attr(attrs, "class")
    href = F.when(start & (tag == "a"), _href(attrs))
    image = F.when(start & (tag == "img"), _image(attrs, F.col("_base")))
    math = F.lower(strip(F.coalesce(tk.attr(attrs, "type"), F.lit(""))))
    tex = F.when(math.startswith("math/tex"), F.struct(
        F.contains(math, F.lit("mode=display")).alias("display"),
        strip(F.regexp_replace("tok", r"(?is)^<script[^>]*>|</script\s*>\z", "")).alias("tex")))
    list_start = F.coalesce(tk.attr(attrs, "start").try_cast("int") - 1, F.lit(0))

    # One nested column that is NULL for most tokens: the windows below copy rows, and narrow rows copy fast.
    info = F.struct(
        href.alias("href"),
        F.when(start & (tag == "a"), bind(href, lambda h: _full(h, F.col("_base")))).alias("href_full"),
        F.when(start & (tag == "a"), F.concat("_base", F.lit("#"))).alias("own_page"),
        image.alias("image"),
        F.when(start & tag.isin("pre", "code"), code_language(attrs)).alias("lang"),
        F.when((F.col("kind") == "raw") & (tag == "script"), tex).alias("tex"),
        F.when(classed & ~tag.isin("figure", "figcaption"), F.exists(tk.classes(attrs), lambda c: c.rlike(
            "^kg-(?:video|audio|file)-|kg-video"))).otherwise(F.lit(False)).alias("card"),
        F.when(classed & (tag == "span"), bind(tk.classes(attrs), lambda c: F.when(
            F.array_contains(c, "katex-display"), 2).when(F.array_contains(c, "katex"), 1).otherwise(0))).otherwise(
                F.lit(0)).alias("katex"),
        F.when(start & (tag == "annotation"), F.lower(strip(F.coalesce(tk.attr(attrs, "encoding"), F.lit("")))).isin(
            "application/x-tex", "text/tex")).otherwise(F.lit(False)).alias("tex_note"),
        F.when(start & (tag == "ol"), list_start).otherwise(F.lit(0)).alias("list_start"),
        F.when(start & tag.isin("td", "th"), F.coalesce(tk.attr(attrs, "colspan"), F.lit("1")).isin("", "1")
               & F.coalesce(tk.attr(attrs, "rowspan"), F.lit("1")).isin("", "1")).otherwise(F.lit(True)).alias("plain_cell"),
    )
    used = F.col("attrs").isNotNull() | (start & tag.isin("a", "td", "th", "pre", "code"))
    kept = ([F.col("tok")] if keep_html else []) + ([F.col("carry")] if carry else [])
    cells = _cells(tok, F.col("_base"), cut_up(tok, F.regexp_extract_all(tok, F.lit(tk.TOKEN), F.lit(0))))
    txt = F.when(F.col("kind") == "text", entities.unescape(tok)).when(F.col("kind") == "table", cells)
    return cut.select(key, "pos", "kind", "name", *kept, txt.alias("txt"),
                      F.when(used, info).alias("info"))


def _step(opens: Column, closes: Column) -> Column:
    return F.when(opens, 1).when(closes, -1).otherwise(0)


def _clamped(total: str, low: str) -> Column:
    """Running sum that never falls below zero."""
    return F.col(total) - F.least(F.lit(0), F.col(low))


def _context(cut: DataFrame, key: str, keep_html: bool, carry: bool) -> DataFrame:
    w = tk.by_page(key)
    so_far = tk.running(w)
    start, end, tag = F.col("kind") == "start", F.col("kind") == "end", F.col("name")

    def last_pos(flag: Column) -> Column:
        return F.last(F.when(flag, F.col("pos")), ignorenulls=True).over(so_far)

    sums = cut.withColumns({
        "s_sum": F.sum(_step(start & tag.isin(*SKIPPED), end & tag.isin(*SKIPPED))).over(so_far),
        "c_sum": F.sum(_step(start & F.col("info.card"), end & (tag == "div"))).over(so_far),
        "span": F.sum(_step(start & (tag == "span"), end & (tag == "span"))).over(so_far),
    })
    lows = sums.withColumns({
        "s_min": F.min("s_sum").over(so_far),
        "c_min": F.min("c_sum").over(so_far),
        "kx": F.last(F.when(F.col("info.katex") > 0, F.struct("pos", "span")), ignorenulls=True).over(so_far),
        "kd": F.last(F.when(F.col("info.katex") > 1, F.struct("pos", "span")), ignorenulls=True).over(so_far),
        "block_pos": last_pos(start & tag.isin(*BLOCK_LEVEL)),
    })
    skip = (_clamped("s_sum", "s_min") > 0) | (_clamped("c_sum", "c_min") > 0) | (
        (F.col("kind") == "raw") & F.col("info.tex").isNull()) | (tag.isin(*SKIPPED))
    seen = lows.withColumn("skip", skip).withColumns({
        "kx_out": last_pos(F.col("span") < F.col("kx.span")),
        "kd_out": last_pos(F.col("span") < F.col("kd.span")),
        "t_sum": F.sum(_step(start & (tag == "table") & ~F.col("skip"), end & (tag == "table") & ~F.col("skip"))).over(so_far),
    })
    since = lambda at, other: F.coalesce(F.col(other), F.lit(-1)) < F.col(at)
    in_katex = F.col("kx").isNotNull() & since("kx.pos", "kx_out") & since("kx.pos", "block_pos")
    in_display = F.col("kd").isNotNull() & since("kd.pos", "kd_out") & since("kd.pos", "block_pos")
    inked = seen.select(
        key, "pos", "kind", "name", *(["tok"] if keep_html else []), *(["carry"] if carry else []), "txt", "info", "t_sum", "skip", F.coalesce(in_katex, F.lit(False)).alias("in_katex"),
        F.coalesce(in_display, F.lit(False)).alias("in_display"))
    live = inked.withColumn("t_min", F.min("t_sum").over(so_far)).where(~F.col("skip")).withColumn(
        "t", _clamped("t_sum", "t_min").cast("int"))
    free = F.col("t") == 0

    is_a, is_pre, is_code = tag == "a", tag == "pre", tag == "code"
    heading = tag.isin(*HEADINGS)
    flags = live.withColumns({
        "a_open": last_pos(start & is_a & free), "a_close": last_pos(end & is_a & free),
        "pre_open": last_pos(start & is_pre & free), "pre_close": last_pos(end & is_pre & free),
        "h_open": last_pos(start & heading & free), "h_close": last_pos(end & heading & free),
        "note_open": last_pos(F.col("info.tex_note")), "note_close": last_pos(end & (tag == "annotation")),
        "table_open": last_pos(start & (tag == "table") & (F.col("t") == 1)),
        "list_sum": F.sum(_step(start & tag.isin("ul", "ol") & free, end & tag.isin("ul", "ol") & free)).over(so_far),
        "pictures": F.sum(F.when(F.col("info.image").isNotNull() & free, 1).otherwise(0)).over(so_far),
    })
    is_open = lambda x: F.coalesce(F.col(f"{x}_open") > F.coalesce(F.col(f"{x}_close"), F.lit(-1)), F.lit(False))
    placed = flags.withColumns({
        "in_pre": is_open("pre"), "in_a": is_open("a"), "in_h": is_open("h"), "in_note": is_open("note"),
    }).withColumns({
        "code_open": last_pos(start & is_code & free & ~F.col("in_pre")),
        "code_close": last_pos(end & is_code & free & ~F.col("in_pre")),
        "list_min": F.min("list_sum").over(so_far),
        "a_link": F.last(F.when(start & is_a & free, F.struct(
            F.col("info.href").alias("href"), F.col("info.href_full").alias("url"), F.col("info.own_page").alias("page"),
            F.col("pictures").alias("pictures"))), ignorenulls=True).over(so_far),
        "pre_lang": F.last(F.when(start & is_pre & free, F.col("info.lang")), ignorenulls=True).over(so_far),
        "code_lang": F.last(F.when(start & is_code & F.col("in_pre") & (F.col("info.lang") != ""), F.struct(F.col("pos"), F.col("info.lang").alias("lang"))),
                            ignorenulls=True).over(so_far),
        "note_display": F.last(F.when(F.col("info.tex_note"), F.col("in_display")), ignorenulls=True).over(so_far),
        **({"table_html": F.last(F.when(start & (tag == "table") & (F.col("t") == 1), F.col("tok")),
                                 ignorenulls=True).over(so_far)} if keep_html else {}),
    }).drop("t_sum", "t_min", "skip", "in_display", "a_close", "a_open", "pre_close", "h_close", "h_open", "note_open",
            "note_close", "table_open").withColumns({"in_code": is_open("code"), "depth": _clamped("list_sum", "list_min").cast("int")})
    text = F.col("txt")
    filled = is_filled(text)
    plain = (F.col("kind") == "text") & free & ~F.col("in_katex") & ~F.col("in_pre") & ~F.col("in_note") & ~F.col("in_code")
    titled = F.col("in_h") & plain & filled & ~(F.col("in_a") & text.rlike(rf"^[{WS}]*[#¶§][{WS}]*$"))
    counted = placed.withColumns({
        "h_text": F.sum(F.when(titled, 1).otherwise(0)).over(so_far),
        "a_end": F.when(end & is_a & free, F.col("pos")), "pre_end": F.when(end & is_pre & free, F.col("pos")),
        "code_end": F.when(end & is_code & free & ~F.col("in_pre"), F.col("pos")),
        "note_end": F.when(end & (tag == "annotation"), F.col("pos")),
        "table_end": F.when(end & (tag == "table") & (F.col("t") == 0), F.col("pos")),
    })
    ahead = lambda c: F.expr(f"lead({c}, 1) IGNORE NULLS").over(w)
    looked = counted.withColumns({
        "h_from": F.last(F.when(start & heading & free, F.col("h_text")), ignorenulls=True).over(so_far),
        "h_end": F.when(end & heading & free, F.col("h_text")),
        "h_was_open": F.lag("in_h", 1, False).over(w),
    }).withColumns({f"{c}_next": ahead(f"{c}_end") for c in ["a", "pre", "code", "note", "table"]}).withColumn(
        "h_to", ahead("h_end"))
    return looked


# --- fragments ------------------------------------------------------------------------------------------------

def _numbered(ctx: DataFrame, key: str) -> DataFrame:
    """Add ``item`` (number inside its list) and ``ordered`` to list items, whatever the nesting."""
    start, tag = F.col("kind") == "start", F.col("name")
    of_list = start & tag.isin("ul", "ol", "li") & (F.col("t") == 0) & (F.col("depth") > 0)
    level = F.when(of_list, F.col("depth"))
    w = Window.partitionBy(key, "_level").orderBy("pos")
    so_far = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    leveled = ctx.withColumn("_level", level).withColumn(
        "_items", F.sum(F.when(F.col("_level").isNotNull() & (tag == "li"), 1).otherwise(0)).over(so_far))
    opened = F.last(F.when(F.col("_level").isNotNull() & tag.isin("ul", "ol"), F.struct(
        tag.alias("tag"), F.coalesce("info.list_start", F.lit(0)).alias("first"), F.col("_items").alias("before"))), ignorenulls=True).over(so_far)
    return leveled.withColumn("_list", opened).withColumn(
        "item", F.col("_items") - F.col("_list.before") + F.col("_list.first")).withColumn(
        "ordered", F.col("_list.tag") == "ol").drop("_level", "_items", "_list")


def _fragments(ctx: DataFrame, key: str, keep_html: bool, carry: bool) -> DataFrame:
    """One row per token: where its text goes (``unit``), what it adds (``part``) and the blank lines it asks for."""
    start, end, tag, text = F.col("kind") == "start", F.col("kind") == "end", F.col("name"), F.col("txt")
    is_text = F.col("kind") == "text"
    in_table = (F.col("t") > 0)
    table_end = F.col("table_end").isNotNull()
    in_note_text = is_text & F.col("in_note")
    muted = is_text & ~F.col("in_note") & F.col("in_katex")
    in_pre = is_text & F.col("in_pre") & ~F.col("in_note") & ~muted
    level_one = (F.col("t") == 1)
    unit = (
        F.when(in_note_text, F.col("note_next")).when(in_pre, F.col("pre_next"))
        .when(in_table & ~(start & (tag == "table") & level_one), F.col("table_next"))
        .when(is_text & F.col("in_code"), F.col("code_next")).when(is_text & F.col("in_a"), F.col("a_next"))
        .otherwise(F.col("pos"))
    )
    whole_table = F.col("kind") == "table"
    cell_text = _single_blanks(text)
    in_cell_part = (
        F.when(is_text, cell_text)
        .when(start & (tag == "tr"), ROW).when(end & (tag == "tr"), ROW_END)
        .when(start & tag.isin("td", "th"), CELL).when(end & tag.isin("td", "th"), CELL_END)
        .when((start & tag.isin("br", "p", "div", "li")) | (end & tag.isin("p", "div", "li")), "<br>")
        .when(start & (tag == "a"), F.concat(F.lit(LINK), F.coalesce("info.href", F.lit("")), F.lit(LINK_URL),
                                             F.coalesce("info.href_full", F.lit("")), F.lit(LINK_TEXT)))
        .when(end & (tag == "a"), LINK_END).when(F.col("info.image").isNotNull(), F.col("info.image")))
    gathered = (
        F.when(whole_table, text).when(muted, F.lit(""))
        .when(in_note_text | in_pre, text)
        .when(in_table, F.when(level_one, in_cell_part))
        .when(is_text & (F.col("in_code") | F.col("in_a")), text)
    )
    dropped_end = (F.col("h_end").isNotNull() & F.col("h_was_open") & (F.col("h_end") == F.col("h_from")))
    free, dropped = ~in_table, F.col("dropped")
    rank = F.substring(tag, 2, 1).try_cast("int")
    item = F.concat(F.repeat(F.lit("  "), F.col("depth") - 1), F.when(
        F.col("ordered"), F.concat(F.col("item").cast("string"), F.lit(". "))).otherwise(F.lit("- ")))
    own = (
        F.when(dropped | dropped_end, F.lit(""))
        .when(start & tag.isin(*HEADINGS), F.concat(F.repeat(F.lit("#"), rank), F.lit(" ")))
        .when(end & tag.isin(*HEADINGS, "p", "blockquote"), "\n\n")
        .when(start & (tag == "br"), "\n").when(start & (tag == "hr"), "---\n\n")
        .when(tag.isin("strong", "b") & ~is_text, "**").when(tag.isin("em", "i") & ~is_text, "*")
        .when(start & (tag == "blockquote"), "> ")
        .when(start & (tag == "li") & (F.col("depth") > 0), item)
        .when(end & tag.isin("ul", "ol", "li"), "\n")
        .when(F.col("info.image").isNotNull(), F.when(F.col("in_a"), F.col("info.image")).otherwise(F.concat("info.image", F.lit("\n"))))
    )
    asks = (
        F.when(in_table & ~(start & (tag == "table") & level_one), 0)
        .when(whole_table, 2)
        .when(start & (tag == "p") & (F.col("depth") == 0), 2)
        .when(start & tag.isin("hr", "pre", "blockquote", "table", *HEADINGS), 2)
        .when(start & tag.isin("ul", "ol"), F.when(F.col("depth") > 1, 1).otherwise(2))
        .when(start & (tag == "li") & (F.col("depth") > 0), 1)
        .when(F.col("info.image").isNotNull() & ~F.col("in_a") & ~dropped, 2)
        .when(F.col("info.tex.display") & (F.col("info.tex.tex") != ""), 2)
        .otherwise(0)
    )
    closes = (F.when(F.col("a_end").isNotNull(), "a").when(F.col("pre_end").isNotNull(), "pre")
              .when(F.col("code_end").isNotNull(), "code").when(F.col("note_end").isNotNull(), "note")
              .when(table_end | whole_table, "table"))
    free_text = is_text & free & ~F.col("in_note") & ~muted & ~in_pre & ~F.col("in_code") & ~F.col("in_a")
    picture_seen = F.col("pictures") - F.col("a_link.pictures") > 0
    # Half of it goes ahead of the windows that number items: the JVM runs a generated method of more than 8,000 bytes without compiling it.
    fence = F.coalesce(blank_to_null(F.col("pre_lang")), F.when(F.col("code_lang.pos") > F.col("pre_open"), F.col("code_lang.lang")), F.lit(""))
    placed = _numbered(ctx.withColumns({"unit": unit, "closes": closes}).withColumns({
        "here": F.col("unit") == F.col("pos"), "gathered": gathered, "fence": F.when(F.col("closes") == "pre", fence),
        "dropped": F.col("in_h") & F.coalesce(F.col("h_to") == F.col("h_from"), F.lit(False))}), key)
    closes, here = F.col("closes"), F.col("here")
    columns = [
        key, F.col("pos"), F.col("unit"), F.col("gathered"),
        F.when(here, asks).alias("asks"),
        F.when(here & free & ~is_text, own).alias("own"),
        F.when(free_text & is_filled(text) & ~dropped, text).alias("words"),
        closes,
        F.when(closes == "a", F.struct(F.col("a_link.href").alias("href"), F.col("a_link.url").alias("url"),
                                       F.col("a_link.page").alias("page"), F.coalesce(picture_seen, F.lit(False)).alias("seen"))).alias("link"),
        F.col("fence"),
        F.when(closes == "note", F.coalesce("note_display", F.lit(False))).alias("display"),
        F.col("info.tex").alias("tex"), dropped,
    ]
    if carry:
        columns.append(F.col("carry"))
    if keep_html:
        piece = F.when(is_text, html_escape(text, quote=False)).otherwise(safe_tag(F.col("tok"), F.col("kind"), tag))
        void_end = end & tag.isin(*tk.VOID_CONVERT)
        columns += [
            F.when((in_table | table_end) & ~(start & (tag == "table") & level_one) & ~void_end, piece).alias("html_part"),
            F.when(table_end, safe_tag(F.col("table_html"), F.lit("start"), F.lit("table"))).alias("html_head"),
            F.when(in_table, (F.col("t") > 1) | ~F.coalesce("info.plain_cell", F.lit(True))).alias("complex"),
        ]
    return placed.select(*columns)


def _link_markdown(text: Column, link: Column) -> Column:
    href, full = F.coalesce(link["href"], F.lit("")), link["url"]

    def written(label: Column) -> Column:
        local = href.startswith("#") | F.coalesce(full.startswith(link["page"]), F.lit(False))
        mark = (href != "") & label.isin("#", "¶", "§") & local
        tagged = (F.lower(label) == "tag") & (href != "") & (href.startswith("#") | href.startswith(link["page"]))
        return F.when(mark | tagged, "").when(
            href != "", F.concat(F.lit("["), label, F.lit("]("), urls.link_destination(full), F.lit(")"))).otherwise(label)

    bare = strip(text)
    return F.when((bare == "") & link["seen"], F.lit("")).otherwise(
        bind(F.when(bare == "", href).otherwise(bare), written))


def table_markdown(cells: Column) -> Column:
    """Markdown of one table from its separated string: rows padded to the widest, the first one is the header."""
    def link(p: Column) -> Column:
        full = F.regexp_extract(p, f"{LINK_URL}([^{LINK_TEXT}]*)", 1)
        written = lambda href, label: F.when(href != "", F.concat(
            F.lit("["), label, F.lit("]("), urls.link_destination(full), F.lit(")"))).otherwise(label)
        return bind(F.regexp_extract(p, f"{LINK}([^{LINK_URL}]*)", 1), lambda href: bind(
            strip(F.regexp_extract(p, f"(?s){LINK_TEXT}(.*){LINK_END}", 1)),
            lambda text: written(href, F.when(text == "", href).otherwise(text))))

    pieces = F.regexp_extract_all(cells, F.lit(f"{LINK}[^{LINK}{LINK_END}]*+{LINK_END}|[^{LINK}]++|{LINK}"), F.lit(0))
    linked = F.when(F.contains(cells, F.lit(LINK)), F.array_join(F.transform(pieces, lambda p: F.when(
        p.startswith(LINK) & p.endswith(LINK_END), link(p)).otherwise(p)), "")).otherwise(cells)

    # All cells of the table at once. A line separator may stand behind the last line break, as in front of "$".
    def tidied(c: Column) -> Column:
        blanks = lambda t: F.regexp_replace(t, r"[ \t\f\x0b]+", " ")
        lines = F.regexp_replace(blanks(F.regexp_replace(c, r"\r\n?", "\n")), r"\s*\n\s*", "<br>")
        c = F.when(c.rlike(r"[\r\n]"), lines).otherwise(blanks(c))
        for pattern, new in [(r"(?i)\s*+(?:<br>\s*+)++", "<br>"), (f"{CELL}<br>", CELL), (rf"<br>(?=[\x85\u2028\u2029]?{CELL_END})", "")]:
            c = F.regexp_replace(c, pattern, new)
        return c

    tidy = bind(linked, lambda c: F.when(c.rlike(r"(?i)[\t\r\n\f\x0b]|  |<br>"), tidied(c)).otherwise(c))
    for pattern, new in [(f"{CELL}[{WS}]++", CELL), (f"[{WS}]++{CELL_END}", CELL_END)]:
        tidy = F.regexp_replace(tidy, pattern, new)
    safe = F.replace(tidy, F.lit("|"), F.lit("\\|"))
    rows = F.filter(
        F.transform(F.regexp_extract_all(safe, F.lit(f"{ROW}([^{ROW}{ROW_END}]*){ROW_END}"), F.lit(1)),
                    lambda r: F.regexp_extract_all(r, F.lit(f"{CELL}([^{CELL}{CELL_END}]*){CELL_END}"), F.lit(1))),
        lambda r: F.exists(r, lambda c: c != ""))

    def lay_out(found: Column) -> Column:
        width = F.array_max(F.transform(found, lambda r: F.size(r)))

        def line(r: Column, width: Column) -> Column:
            padded = F.when(F.size(r) < width, F.concat(r, F.array_repeat(F.lit(""), width - F.size(r)))).otherwise(r)
            return F.concat(F.lit("| "), F.array_join(padded, " | "), F.lit(" |\n"))

        def joined(lines: Column, width: Column) -> Column:
            rule = F.concat(F.lit("| "), F.array_join(F.array_repeat(F.lit("---"), width), " | "), F.lit(" |\n"))
            body = F.array_join(F.slice(lines, F.lit(2), F.greatest(F.size(lines), F.lit(1))), "")
            return F.concat(F.get(lines, 0), rule, body, F.lit("\n"))

        return F.when(F.size(found) > 0, bind(width, lambda w: bind(F.transform(found, lambda r: line(r, w)), lambda lines: joined(lines, w)))).otherwise(F.lit(""))

    return bind(rows, lay_out)


def _math(tex: Column, display: Column) -> Column:
    return F.when(display, F.concat(F.lit("$$\n"), tex, F.lit("\n$$\n\n"))).otherwise(
        F.concat(F.lit("$"), F.replace(tex, F.lit("\n"), F.lit(" ")), F.lit("$")))


def _units(parts: DataFrame, key: str, keep_html: bool, carry: bool) -> DataFrame:
    """One row per output position: ``unit, asks, words, part``."""
    aggs = [
        F.expr("listagg(gathered, '') WITHIN GROUP (ORDER BY pos)").alias("gathered"),
        *[F.max(c).alias(c) for c in ["asks", "own", "words", "closes", "link", "fence", "display", "tex"]],
        F.max(F.when(F.col("pos") == F.col("unit"), F.col("dropped"))).alias("dropped"),
    ]
    if carry:
        aggs.append(F.first("carry", ignorenulls=True).alias("carry"))
    if keep_html:
        aggs += [F.expr("listagg(html_part, '') WITHIN GROUP (ORDER BY pos)").alias("html_part"),
                 F.max("html_head").alias("html_head"), F.max("complex").alias("complex")]
    units = parts.where(F.col("unit").isNotNull()).groupBy(key, "unit").agg(*aggs)
    text = F.coalesce("gathered", F.lit(""))
    code = F.regexp_replace(F.regexp_replace(text, r"\r\n?", "\n"), r"\A\n+|\n+\z", "")
    note = strip(text)
    table = table_markdown(text)
    if keep_html:
        table = F.when(F.col("complex"), F.concat("html_head", F.coalesce("html_part", F.lit("")), F.lit("\n\n"))).otherwise(table)
    shown = ~F.coalesce("dropped", F.lit(False))
    inline_note = (F.col("closes") == "note") & ~F.coalesce("display", F.lit(False)) & (note != "")
    inline_tex = F.col("tex").isNotNull() & ~F.col("tex.display") & (F.col("tex.tex") != "")
    part = (
        F.when(~shown, F.lit(""))
        .when(F.col("closes") == "a", _link_markdown(text, F.col("link")))
        .when(F.col("closes") == "pre", F.concat(F.lit("```"), "fence", F.lit("\n"), code, F.lit("\n```\n\n")))
        .when(F.col("closes") == "code", F.concat(F.lit("`"), F.replace(strip(text), F.lit("`"), F.lit("\\`")), F.lit("`")))
        .when((F.col("closes") == "note") & (note != "") & F.col("display"), _math(note, F.lit(True)))
        .when(F.col("closes") == "table", table)
        .when(F.col("tex.display") & (F.col("tex.tex") != ""), _math(F.col("tex.tex"), F.lit(True)))
        .otherwise(F.coalesce("own", F.lit("")))
    )
    words = F.when(shown, F.coalesce("words", F.when(inline_note, _math(note, F.lit(False))),
                                     F.when(inline_tex, _math(F.col("tex.tex"), F.lit(False)))))
    asks = F.when(F.col("closes").eqNullSafe("note") & F.col("display") & (note != ""), 2).otherwise(
        F.coalesce("asks", F.lit(0)))
    return units.select(key, "unit", *(["carry"] if carry else []), asks.alias("asks"), _single_blanks(words).alias("words"),
                        F.coalesce(part, F.lit("")).alias("part"))


def _spaced(units: DataFrame, key: str, carry: bool) -> DataFrame:
    """Add the line breaks and blanks that depend on what the output ends with."""
    w = Window.partitionBy(key).orderBy("unit")
    so_far = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    out = F.coalesce(F.col("words"), F.col("part"))
    body = units.withColumn("out", out).withColumns({
        "solid": F.col("out").rlike(r"[^\n]"),
        "breaks": F.when(F.col("out").rlike(r"[^\n]"), 0).otherwise(F.length("out")),
        "tail": F.when(F.col("out").endswith("\n"), F.length("out") - F.length(F.rtrim("out", F.lit("\n")))).otherwise(0),
        "last_char": F.when(F.col("out") != "", F.right(F.col("out"), F.lit(1))).when(F.col("asks") > 0, "\n"),
    })
    sums = body.withColumns({
        "run": F.sum(F.col("solid").cast("int")).over(so_far), "total": F.sum("breaks").over(so_far)})
    level = F.when(F.col("solid"), F.col("tail") - F.col("total")).when(
        F.col("asks") > 0, F.col("asks") - (F.col("total") - F.col("breaks")))
    leveled = sums.withColumn("level", F.when(level.isNotNull(), F.struct(F.col("run").alias("run"), level.alias("n"))))
    seen = leveled.withColumns({
        "had": F.max("level").over(before), "had_total": F.lag("total", 1).over(w),
        "prev": F.last("last_char", ignorenulls=True).over(before)})
    missing = F.greatest(F.lit(0), F.col("asks") - (F.col("had_total") + F.col("had.n")))
    lines = F.when((F.col("asks") > 0) & (F.col("had.run") > 0), F.repeat(F.lit("\n"), missing.cast("int"))).otherwise(F.lit(""))
    prev = F.when((F.col("asks") > 0), F.lit("\n")).otherwise(F.coalesce("prev", F.lit("\n")))
    trimmed = F.when(prev.isin("*", "`"), F.regexp_replace("words", r"^\s+", "")).otherwise(F.col("words"))

    def blank(t: Column) -> Column:
        first = F.left(t, F.lit(1))
        gap = (~prev.isin("\n", " ", "(", "[", "*", "`", "_") & ~first.isin(" ", "\n", ".", ",", ":", ";", ")", "]")
               & ~(prev.rlike(CJK) & first.rlike(CJK)))
        return F.concat(F.when(gap, F.lit(" ")).otherwise(F.lit("")), t)

    text = F.when(F.col("words").isNotNull(), bind(trimmed, blank)).otherwise(F.col("part"))
    return seen.select(key, "unit", *(["carry"] if carry else []), F.concat(lines, text).alias("piece"))


def polish(md: Column) -> Column:
    """Text-level steps after the fragments are joined."""
    md = F.replace(md, F.lit("\r\n"), F.lit("\n"))
    for step in [mt.squeeze_blank_lines, mt.latex_delimiters, mt.drop_empty_headings, mt.drop_heading_permalinks]:
        md = bind(md, step)
    return F.concat(strip(md), F.lit("\n"))


def html_to_markdown(pages: DataFrame, html: str = "html", base: str = "url", key: str = "page_id",
                     keep_html: bool = False, carry: list[str] | None = None, spread_first: bool = True) -> DataFrame:
    """``key, md`` for every page that has any token; with ``carry``, those page columns for every page.

    ``spread_first`` is False when the pages come from a step that already grouped them by key.
    """
    kept = carry or []
    ctx = _context(_cut(pages, html, base, key, keep_html, kept, spread_first), key, keep_html, bool(kept))
    spaced = _spaced(_units(_fragments(ctx, key, keep_html, bool(kept)), key, keep_html, bool(kept)), key, bool(kept))
    joined = spaced.groupBy(key).agg(F.expr("listagg(piece, '') WITHIN GROUP (ORDER BY unit)").alias("md"),
                                     *([F.first("carry", ignorenulls=True).alias("carry")] if kept else []))
    return joined.select(key, polish(F.coalesce("md", F.lit(""))).alias("md"), *(["carry.*"] if kept else []))
