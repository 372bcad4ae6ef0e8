"""Articles that a page carries as data in its scripts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagemill.functions import markdown_text as mt
from pagemill.functions.text import bind, blank_to_null, html_escape, is_filled, script_unescape, strip
from pagemill.operators import richtext, tokens as tk
from pagemill.session import durable

#: What a script must hold to be worth cutting.
_MARKERS = r'''"(?:type|blocks|children|ops|insert)\\*"\s*:'''


def script_bodies(html: Column) -> Column:
    """ARRAY of script bodies; self-closing script tags have none."""
    return F.regexp_extract_all(html, F.lit(r"(?is)<script(?=[\s>])(?:[^>]*[^>/])?>(.*?)</script>"), F.lit(1))


def candidate_scripts(html: Column) -> Column:
    """Bodies that may hold rich text: they name one of its fields."""
    return F.filter(F.transform(script_bodies(html), strip), lambda b: b.rlike(_MARKERS))


def json_slices(texts: DataFrame, text: str = "text", key: str = "id") -> DataFrame:
    """``key, slice``: the JSON object a text starts with, braces inside strings ignored; no row without one.

    The text is cut at strings and braces; the object ends where the running brace depth first returns to zero.
    """
    spread = tk.spread(texts.where(F.col(text).startswith("{")).select(key, F.col(text).alias("_t")), key)
    pieces = F.regexp_extract_all(F.col("_t"), F.lit(r"""(?s)"(?:[^"\\]++|\\.)*+"|[{}]|[^"{}]++|\""""), F.lit(0))
    cut = spread.select(key, F.posexplode(pieces).alias("pos", "tok"))
    w = tk.by_page(key)
    deep = cut.withColumn("depth", F.sum(F.when(F.col("tok") == "{", 1).when(F.col("tok") == "}", -1).otherwise(0)).over(tk.running(w)))
    ended = deep.withColumn("end", F.min(F.when(F.col("depth") == 0, F.col("pos"))).over(Window.partitionBy(key)))
    return ended.where(F.col("pos") <= F.col("end")).groupBy(key).agg(
        F.expr("listagg(tok, '') WITHIN GROUP (ORDER BY pos)").alias("slice"))


def _full_page(title: Column, body: Column) -> Column:
    safe = html_escape(F.coalesce(title, F.lit("")))
    return F.concat(F.lit('<!DOCTYPE html><html><head><meta charset="utf-8"><title>'), safe, F.lit("</title></head><body><h1>"),
                    safe, F.lit("</h1>\n"), body, F.lit("</body></html>"))


# --- page data of two site frameworks -------------------------------------------------------------------------

def next_payload(html: Column) -> Column:
    """STRUCT<title, content>: article title and rich-text JSON of the first article entry in the page data."""
    raw = F.regexp_extract(html, r"""(?is)<script[^>]*id=["']__NEXT_DATA__["'][^>]*>(.*?)</script>""", 1)
    fallback = F.from_json(F.get_json_object(raw, "$.props.pageProps.fallback"), "map<string,string>")
    hits = F.filter(F.map_entries(fallback), lambda e: F.contains(e["key"], F.lit("article/detail")))
    info = F.get_json_object(F.get(hits, 0)["value"], "$.articleInfo")
    return bind(info, lambda i: F.struct(F.get_json_object(i, "$.title").alias("title"),
                                         F.get_json_object(i, "$.content").alias("content")))


def next_articles(pages: DataFrame, html: str = "html", key: str = "page_id", min_length: int = 0) -> DataFrame:
    """``key, title, body, source_type, is_markdown`` from pages with article data in the first format.

    Articles whose HTML is shorter than ``min_length`` do not count, in this and the other formats.
    """
    found = pages.where(F.contains(html, F.lit("__NEXT_DATA__"))).select(key, next_payload(F.col(html)).alias("_p"))
    docs = found.select(key, F.col("_p.title").alias("title"), F.col("_p.content").alias("json")).where(
        F.get_json_object("json", "$.type") == "doc")
    body = richtext.to_html(docs, "json", key).where(F.length(strip(F.col("html"))) >= max(min_length, 1))
    return docs.select(key, F.coalesce("title", F.lit("")).alias("title")).join(body, key).select(
        key, "title", _full_page(F.col("title"), F.col("html")).alias("body"), F.lit("nextjs").alias("source_type"),
        F.lit(False).alias("is_markdown"))


def router_payload(slice_: Column) -> Column:
    """STRUCT<title, markdown, content> of the first loader entry that holds a document."""
    loaders = F.from_json(F.get_json_object(slice_, "$.loaderData"), "map<string,string>")
    hits = F.filter(F.transform(F.map_values(loaders), lambda v: F.get_json_object(v, "$.curDoc")), lambda d: d.isNotNull())
    return bind(F.get(hits, 0), lambda d: F.struct(
        F.coalesce(blank_to_null(F.get_json_object(d, "$.Title")), F.get_json_object(d, "$.title"), F.lit("")).alias("title"),
        F.get_json_object(d, "$.MDContent").alias("markdown"), F.get_json_object(d, "$.Content").alias("content")))


def router_articles(pages: DataFrame, html: str = "html", key: str = "page_id", min_length: int = 0) -> DataFrame:
    """As :func:`next_articles` for the second format: Markdown when there is enough of it, else a delta document."""
    at = F.regexp_extract(F.col(html), r"(?s)window\._ROUTER_DATA\s*=\s*(\{.*)", 1)
    texts = pages.where(F.contains(html, F.lit("_ROUTER_DATA"))).select(key, at.alias("text"))
    docs = json_slices(texts, "text", key).select(key, router_payload(F.col("slice")).alias("_d")).select(key, "_d.*").where("title IS NOT NULL")
    enough = F.length(strip(F.coalesce("markdown", F.lit("")))) > min_length
    ready = docs.where(enough).select(key, "title", mt.clean_embedded_markdown(F.col("markdown")).alias("body"),
                                      F.lit("modernjs").alias("source_type"), F.lit(True).alias("is_markdown"))
    rest = docs.where(~enough & is_filled(F.coalesce("content", F.lit(""))))
    body = richtext.delta_to_html(delta_sections(rest, "content", key), key).where(F.length(strip(F.col("html"))) >= max(min_length, 1))
    drawn = rest.select(key, "title").join(body, key).select(
        key, "title", _full_page(F.col("title"), F.col("html")).alias("body"), F.lit("modernjs").alias("source_type"),
        F.lit(False).alias("is_markdown"))
    return ready.unionByName(drawn)


def delta_sections(docs: DataFrame, content: str = "content", key: str = "doc_id") -> DataFrame:
    """Operations of all sections of a delta document; numeric section names sort as numbers."""
    entries = F.map_entries(F.from_json(F.get_json_object(content, "$.data"), "map<string,string>"))
    numeric = F.forall(entries, lambda e: e["key"].rlike("^[0-9]+$"))
    order = F.transform(entries, lambda e, i: F.struct(F.when(numeric, e["key"].cast("int")).otherwise(i).alias("n"), e["value"].alias("v")))
    ops = F.flatten(F.transform(F.array_sort(order), lambda s: F.coalesce(
        F.from_json(F.get_json_object(s["v"], "$.ops"), "array<string>"), F.array().cast("array<string>"))))
    return docs.select(key, F.posexplode(ops).alias("seq", "op")).select(
        key, "seq", F.get_json_object("op", "$.insert").alias("insert"), F.get_json_object("op", "$.attributes").alias("attributes"))


# --- any rich text in any script ------------------------------------------------------------------------------

_ASSIGNED = r"=\s*\{"


def _assigned_json(texts: DataFrame, key: str) -> DataFrame:
    """``key, json``: the first object assigned in a text (``key, text``) that is JSON.

    All braces of a text are paired at once by their level. The outermost assigned objects are tested; only those that are no JSON are
    looked into for further ones, so every round reads what the one before has refused, and nothing is copied for each start.
    """
    layer = texts.select(key, F.array().cast("array<int>").alias("path"), F.col("text"))
    best: DataFrame | None = None
    while True:
        named = tk.spread(layer.select(F.struct(key, "path").alias("_id"), "text"), "_id")
        pieces = F.regexp_extract_all("text", F.lit(r"""(?s)"(?:[^"\\\n]++|\\.)*+"|[{}]|[^"{}]++|\""""), F.lit(0))
        cut = named.select("_id", F.posexplode(pieces).alias("pos", "tok"))
        w, tok = tk.by_page("_id"), F.col("tok")
        deep = cut.withColumns({"_depth": F.sum(F.when(tok == "{", 1).when(tok == "}", -1).otherwise(0)).over(tk.running(w)), "_before": F.lag("tok", 1).over(w)})
        level = F.when(tok == "{", F.col("_depth")).when(tok == "}", F.col("_depth") + 1)
        paired = deep.withColumn("_level", level).withColumn("_end", F.lead("pos", 1).over(Window.partitionBy("_id", "_level").orderBy("pos")))
        start = (tok == "{") & F.col("_before").rlike(r"=\s*\z") & F.col("_end").isNotNull()
        begun = paired.withColumn("_end", F.when(start, F.col("_end")))
        reach = F.max("_end").over(w.rowsBetween(Window.unboundedPreceding, -1))
        outer = F.when(F.col("_end").isNotNull() & (F.coalesce(reach, F.lit(-1)) < F.col("pos")), F.struct("pos", "_end"))
        owned = begun.withColumn("_outer", outer).withColumn("_own", F.last("_outer", ignorenulls=True).over(tk.running(w))).where("pos <= _own._end")
        slices = owned.groupBy("_id", F.col("_own.pos").alias("at")).agg(F.expr("listagg(tok, '') WITHIN GROUP (ORDER BY pos)").alias("text"))
        slices = durable(slices.select(f"_id.{key}", F.concat("_id.path", F.array("at")).alias("path"), "text", F.try_parse_json("text").isNotNull().alias("good")))
        hits = slices.where("good").groupBy(key).agg(F.min(F.struct("path", F.col("text").alias("json"))).alias("_hit"))
        if best is not None:
            hits = best.union(hits).groupBy(key).agg(F.min("_hit").alias("_hit"))
        best = durable(hits)
        refused = slices.where(~F.col("good") & F.substring("text", F.lit(2), F.length("text")).rlike(_ASSIGNED)).drop("good")
        open_ = refused.join(best, key, "left").where(F.col("_hit").isNull() | (F.col("path") < F.col("_hit.path")))
        layer = durable(open_.select(key, "path", F.substring("text", F.lit(2), F.length("text")).alias("text")))
        if layer.isEmpty():
            return best.select(key, "_hit.json")


def json_texts(scripts: DataFrame, text: str = "script", key: str = "sid") -> DataFrame:
    """``key, json``: a script that is JSON as a whole, else the first object assigned in it that is JSON.

    Strings in double quotes end on their line. Where a single quotation mark (in a pattern or a comment) has turned strings inside out and
    nothing was found, the script is read once more the other way round.
    """
    # The parser passes over what follows a first value ("use strict"; ...), so the text is parsed as the value of a field.
    framed = F.try_parse_json(F.concat(F.lit('{"v":'), F.col(text), F.lit("}")))
    cut = scripts.select(key, F.col(text).alias("text"), framed.isNotNull().alias("_whole"))
    whole = cut.where("_whole").select(key, F.col("text").alias("json"))
    rest = cut.where(~F.col("_whole") & F.col("text").rlike(_ASSIGNED)).select(key, "text")
    first = durable(_assigned_json(rest, key))
    turned = rest.join(first, key, "left_anti").where(F.col("text").rlike(r'"[^"\n]*=\s*\{')).withColumn("text", F.concat(F.lit('"'), "text"))
    return whole.unionByName(first).unionByName(_assigned_json(turned, key))


def _roots_of_layer(docs: DataFrame, key: str, min_nested: int) -> tuple[DataFrame, DataFrame]:
    """The first rich-text root of each text (``key, path, kind, json``), and the strings in it that hold JSON (``key, path, json``)."""
    cut = docs.select("_doc", F.posexplode(F.regexp_extract_all("json", F.lit(richtext.JSON_TOKEN), F.lit(0))).alias("pos", "tok"))
    cut = cut.where(~F.col("tok").rlike(r"^\s"))
    w = tk.by_page("_doc")
    tok = F.col("tok")
    deep = cut.withColumns({
        "depth": F.sum(F.when(tok.isin("{", "["), 1).when(tok.isin("}", "]"), -1).otherwise(0)).over(tk.running(w)),
        "name": F.when(F.lag("tok", 1).over(w) == ":", F.regexp_replace(F.lag("tok", 2).over(w), '^"|"$', "")),
        "next": F.lead("tok", 1).over(w), "key_of_next": F.when(tok == ":", F.regexp_replace(F.lag("tok", 1).over(w), '^"|"$', ""))})
    grouped = deep.withColumn("level", F.when(tok.isin("}", "]"), F.col("depth") + 1).otherwise(F.col("depth")))
    soon = Window.partitionBy("_doc", "level").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    owned = grouped.withColumn("owner", F.last(F.when(tok.isin("{", "["), F.col("pos")), ignorenulls=True).over(soon)).where("owner IS NOT NULL")
    opens, of = F.col("pos") == F.col("owner"), F.col("key_of_next")
    boxes = owned.groupBy("_doc", "owner").agg(
        F.max(F.when(opens, tok)).alias("box"), F.max(F.when(opens, F.col("name"))).alias("hung"), F.max(F.when(opens, F.col("next"))).alias("first"),
        F.max("pos").alias("end"), F.max(F.when(of == "type", F.col("next"))).alias("type"),
        *[F.coalesce(F.bool_or(of == n), F.lit(False)).alias(n) for n in ("content", "children", "data", "insert")])
    after = Window.partitionBy("_doc").orderBy("owner")
    facts = F.struct("type", "content", "children", "data", "insert")
    item = F.when((F.col("box") == "[") & (F.col("first") == "{"), F.lead(facts).over(after)).alias("item")
    seen = boxes.select("*", item)
    kind = (F.when((F.col("box") == "{") & (F.col("type") == '"doc"') & F.col("content"), "tree")
            .when((F.col("box") == "{") & (F.col("hung") == "root") & F.col("type").isin('"root"', '"doc"'), "tree")
            .when((F.col("hung") == "blocks") & F.col("item.type").isNotNull() & F.col("item.data"), "blocks")
            .when(F.col("item.type").isNotNull() & (F.col("item.children") | F.col("item.content")), "list")
            .when(F.col("item.insert"), "delta"))
    hits = seen.withColumn("kind", kind).where("kind IS NOT NULL").groupBy("_doc").agg(F.min(F.struct("owner", "end", "kind")).alias("_hit"))
    inside = cut.join(hits, "_doc").where((F.col("pos") >= F.col("_hit.owner")) & (F.col("pos") <= F.col("_hit.end")))
    found = inside.groupBy("_doc").agg(F.expr("listagg(tok, '') WITHIN GROUP (ORDER BY pos)").alias("json"), F.first("_hit").alias("_hit"))
    found = found.select(f"_doc.{key}", F.concat("_doc.path", F.array("_hit.owner")).alias("path"), F.col("_hit.kind").alias("kind"), "json")
    strings = cut.where((F.length("tok") >= min_nested) & tok.rlike(r'^"\s*[\{\[]'))
    opened = F.get_json_object(F.concat(F.lit('{"s":'), "tok", F.lit("}")), "$.s")
    inner = strings.select(f"_doc.{key}", F.concat("_doc.path", F.array("pos")).alias("path"), opened.alias("json")).where(F.try_parse_json("json").isNotNull())
    return found, inner


def richtext_roots(docs: DataFrame, json: str = "json", key: str = "doc_id", min_nested: int = 0) -> DataFrame:
    """``key, path, kind, json``: the first rich text inside larger JSON, in reading order.

    Roots are a document node, a ``root`` node, a list of blocks, a list of nodes and a list of insertions, under any name and at the
    top; strings that hold JSON are looked into, as often as they are nested (those of ``min_nested`` characters or more). ``json`` is the
    root alone.
    """
    layer = docs.select(key, F.array().cast("array<int>").alias("path"), F.col(json).alias("json"))
    hits: list[DataFrame] = []
    while True:
        found, inner = _roots_of_layer(layer.select(F.struct(key, "path").alias("_doc"), "json"), key, min_nested)
        hits.append(found)
        layer = durable(inner)
        if layer.isEmpty():
            break
    every = reduce(DataFrame.unionByName, hits)
    return every.groupBy(key).agg(F.min_by(F.struct("path", "kind", "json"), "path").alias("_r")).select(key, "_r.*")


def roots_to_html(roots: DataFrame, key: str = "doc_id") -> DataFrame:
    """``key, html`` of what :func:`richtext_roots` finds."""
    kind = F.col("kind")
    whole = (F.when(kind == "blocks", F.concat(F.lit('{"blocks":'), "json", F.lit("}"))).when(kind == "list", F.concat(F.lit('{"type":"doc","content":'), "json", F.lit("}")))
             .when(kind == "delta", F.concat(F.lit('{"ops":'), "json", F.lit("}"))).otherwise(F.col("json")))
    framed = roots.select(key, "kind", whole.alias("json"))
    trees = richtext.to_html(framed.where("kind <> 'delta'"), "json", key)
    return trees.unionByName(richtext.delta_to_html(richtext.delta_ops(framed.where("kind = 'delta'"), "json", key), key))


def script_articles(pages: DataFrame, html: str = "html", key: str = "page_id", min_length: int = 0) -> DataFrame:
    """The first rich text in the scripts of each page: ``key, title, body, source_type, is_markdown``."""
    scripts = pages.select(key, F.regexp_extract(html, r"(?i)<title[^>]*>([^<]+)</title>", 1).alias("title"),
                           F.posexplode(candidate_scripts(F.col(html))).alias("n", "script"))
    named = durable(scripts.select(F.struct(key, "n").alias("sid"), F.trim("title").alias("title"), "script"))
    roots = durable(richtext_roots(json_texts(named, "script", "sid"), "json", "sid"))
    drawn = roots_to_html(roots, "sid").where(F.length(strip(F.col("html"))) >= max(min_length, 1))
    best = drawn.join(named.select("sid", "title"), "sid").groupBy(F.col(f"sid.{key}").alias(key)).agg(F.min_by(F.struct("title", "html"), "sid.n").alias("b"))
    return best.select(key, F.col("b.title").alias("title"), _full_page(F.col("b.title"), F.col("b.html")).alias("body"),
                       F.lit("json_fallback").alias("source_type"), F.lit(False).alias("is_markdown"))


def articles(pages: DataFrame, html: str = "html", key: str = "page_id", min_length: int = 0) -> DataFrame:
    """Embedded article of each page that has one: first format, second format, then any script.

    Scripts are searched on the pages only that have no article in the first two formats.
    """
    stored = durable(next_articles(pages, html, key, min_length).unionByName(router_articles(pages, html, key, min_length)))
    # The rank comes after storing: where articles are joined back to pages, Spark renames the stored columns, but not in what it knows of
    # those that are nullable in one format only, and then cannot plan a union straight above them.
    named = stored.withColumn("_rank", F.when(F.col("source_type") == "nextjs", 0).otherwise(1))
    rest = pages.select(key, html).join(named.select(key).distinct(), key, "left_anti")
    union = named.unionByName(script_articles(rest, html, key, min_length).withColumn("_rank", F.lit(2)))
    best = F.min_by(F.struct("title", "body", "source_type", "is_markdown"), "_rank").alias("b")
    return union.groupBy(key).agg(best).select(key, "b.*")


# --- messenger articles drawn by a script ---------------------------------------------------------------------

def async_fields(html: Column) -> Column:
    """STRUCT of the seven article fields from the page script, NULL without a title."""
    chunk = F.regexp_extract(html, r"(?s)(window\.cgiDataNew.*?)(?:</script>|\z)", 1)

    def decoded(text: Column, field: str, guard: bool = True) -> Column:
        before = r"(?<![_A-Za-z0-9])" if guard else ""
        return blank_to_null(script_unescape(F.regexp_extract(text, rf"(?s){before}{field}\s*:\s*JsDecode\('(.*?)'\)", 1)))

    def fields(c: Column) -> Column:
        info = F.regexp_extract(c, r"(?s)(text_page_info.*)", 1)
        content = F.coalesce(decoded(info, "content_noencode", False), decoded(c, "content_noencode"), decoded(c, "content"), F.lit(""))
        raw_time = strip(F.regexp_extract(c, r"""(?<![_A-Za-z0-9])ori_create_time\s*:\s*['"]?([^'",\s}]+)['"]?""", 1))
        text = lambda f: F.coalesce(decoded(c, f), F.lit(""))
        return F.when(decoded(c, "title").isNotNull(), F.struct(
            decoded(c, "title").alias("title"), text("nick_name").alias("nick_name"), content.alias("content"),
            F.coalesce(decoded(c, "create_time"), raw_time).alias("create_time"), text("cdn_url").alias("cdn_url"),
            text("source_url").alias("source_url"), text("signature").alias("signature")))

    return bind(chunk, fields)


def async_markdown(info: Column) -> Column:
    # Header labels.
    header = F.when(info["nick_name"] != "", F.concat(
        F.lit("> 公众号：**"), info["nick_name"], F.lit("**\n"),
        F.when(info["signature"] != "", F.concat(F.lit("> "), info["signature"], F.lit("\n"))).otherwise(F.lit("")), F.lit("\n"))).otherwise(F.lit(""))
    lines = F.array_join(F.transform(F.split(info["content"], "\n"), strip), "\n")
    return strip(F.concat(header, lines))
