"""HTML as a table: one row per tag, text run, comment, declaration or raw script/style element.

Pages are spread over the cluster by key *before* they are cut up, so the compressed page crosses the network
once and every later window or grouping on the key finds its rows in place: no token is shuffled.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagemill.functions import entities
from pagemill.functions.text import bind, html_escape, squeeze

TOKEN = (
    r"(?is)<!--.*?-->|<script\b[^>]*>.*?</script\s*>|<style\b[^>]*>.*?</style\s*>"
    r"|<[a-z/!?][^>\"']*+(?:\"[^\"]*+\"[^>\"']*+|'[^']*+'[^>\"']*+)*+>|<[a-z/!?][^>]*>|[^<]+|<"
)

# Elements without an end tag. Three lists, because stripping, targeting and conversion each
# have their own.
VOID_STRIP = ["area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track",
              "wbr", "command", "keygen", "menuitem"]
VOID_TARGET = ["area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track",
               "wbr"]
VOID_CONVERT = ["area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source",
                "track", "wbr", "path", "rect", "circle", "polygon", "polyline", "line", "ellipse"]


def spread(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """Distribute whole pages by key.

    The number of partitions is given, because pages grow many times over when they are cut up: left alone, the
    adaptive planner would merge partitions by the size of the compressed pages and leave most cores idle.
    """
    spark = pages.sparkSession
    wanted = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return pages.repartition(max(wanted, spark.sparkContext.defaultParallelism), F.col(key))


def kind_of(tok: Column) -> Column:
    return (
        F.when(~tok.startswith("<") | (tok == "<"), "text")
        .when(tok.startswith("<!--"), "comment")
        .when(tok.rlike(r"^<[!?]"), "decl")
        .when(tok.rlike(r"(?is)^<(?:script|style)\b.*</"), "raw")
        .when(tok.startswith("</"), "end")
        .when(tok.endswith("/>"), "selfclose")
        .otherwise("start")
    )


def tokens(pages: DataFrame, html: str = "html", key: str = "page_id", keep: list[str] | None = None,
           spread_first: bool = True, carry: list[str] | None = None, mark: Callable[[Column], Column] | None = None) -> DataFrame:
    """``key, *keep, pos, tok, kind, name``. The concatenated tokens of a page are the page.

    With ``carry``, page columns travel as one struct on an empty token put in front of each page, so that later steps
    need no join to get them back; a page without HTML still has that token. ``mark`` adds a column ``rule`` that is made from
    each token while the page's other columns are at hand, before the page is taken apart.
    """
    kept = keep or []
    base = pages if mark else pages.select(key, *kept, F.col(html).alias("_html"), *([F.struct(*carry).alias("_carry")] if carry else []))
    if spread_first:
        base = spread(base, key)
    pieces = F.regexp_extract_all(F.col(html if mark else "_html"), F.lit(TOKEN), F.lit(0))
    if carry:
        pieces = F.concat(F.array(F.lit("")), F.coalesce(pieces, F.array().cast("array<string>")))
    if mark:
        pieces = F.transform(pieces, lambda t: F.struct(t.alias("tok"), mark(t).alias("rule")))
        base = base.select(key, *kept, pieces.alias("_pieces"), *([F.struct(*carry).alias("_carry")] if carry else []))
        pieces = F.col("_pieces")
    cut = base.select(key, *kept, *(["_carry"] if carry else []), F.posexplode(pieces).alias("pos", "tok"))
    if mark:
        cut = cut.withColumn("rule", F.col("tok.rule")).withColumn("tok", F.col("tok.tok"))
    if carry:
        cut = cut.withColumn("carry", F.when(F.col("pos") == 0, F.col("_carry"))).drop("_carry")
    name = F.lower(F.regexp_extract("tok", r"^</?([A-Za-z][^\s/>]*)", 1))
    return cut.withColumn("kind", kind_of(F.col("tok"))).withColumn(
        "name", F.when(F.col("kind").isin("start", "end", "selfclose", "raw"), name).otherwise(F.lit("")))


def by_page(key: str = "page_id") -> Window:
    return Window.partitionBy(key).orderBy("pos")


def running(window: Window) -> Window:
    return window.rowsBetween(Window.unboundedPreceding, Window.currentRow)


def with_depth(toks: DataFrame, key: str = "page_id", void: list[str] | None = None) -> DataFrame:
    """Add ``delta`` and the running ``depth``: starts count up, every end tag counts down, nothing is matched."""
    delta = (
        F.when(F.col("kind") == "end", -1)
        .when((F.col("kind") == "start") & ~F.col("name").isin(*(void or VOID_STRIP)), 1)
        .otherwise(0)
    )
    return toks.withColumn("delta", delta).withColumn("depth", F.sum("delta").over(running(by_page(key))))


def join_tokens(toks: DataFrame, text: str = "tok", key: str = "page_id", out: str = "html",
                extra: list[Column] | None = None) -> DataFrame:
    """Put the pieces of each page back together in order."""
    return toks.groupBy(key).agg(
        F.expr(f"coalesce(listagg({text}, '') WITHIN GROUP (ORDER BY pos), '')").alias(out), *(extra or []))


# --- attributes -----------------------------------------------------------------------------------------------

_ATTR = r"""[^\s/>"'=][^\s/>=]*(?:\s*=\s*(?:"[^"]*"|'[^']*'|[^\s"'>]+))?"""


def attr_map(tag: Column) -> Column:
    """MAP of attribute name to unescaped value (NULL for a bare attribute); the last one wins. '' tags give NULL."""
    def pair(a: Column) -> Column:
        value = F.regexp_replace(F.regexp_replace(a, r"(?s)^[^\s=]+\s*=?\s*", ""), r"""(?s)^(["'])(.*)\1\z""", "$2")
        return F.struct(F.lower(F.regexp_extract(a, r"^([^\s=]+)", 1)).alias("key"),
                        F.when(F.contains(a, F.lit("=")), entities.unescape(value)).alias("value"))

    def last_wins(pairs: Column) -> Column:
        return F.map_from_entries(F.filter(pairs, lambda x, i: ~F.exists(
            F.slice(pairs, i + 2, F.size(pairs)), lambda y: y["key"] == x["key"])))

    body = F.regexp_replace(tag, r"^<[^\s/>]+|[\s/]*>\z", "")
    found = F.transform(F.regexp_extract_all(body, F.lit(_ATTR), F.lit(0)), pair)
    return F.when(tag.rlike(r"^<[A-Za-z][^\s/>]*[\s/]+[^\s/>]"), bind(found, last_wins))


def attr(attrs: Column, name: str) -> Column:
    return F.try_element_at(attrs, F.lit(name))


def has_attr(attrs: Column, name: str) -> Column:
    return F.coalesce(F.map_contains_key(attrs, name), F.lit(False))


def classes(attrs: Column) -> Column:
    """Class names of a tag, [] when it has none."""
    return F.filter(F.split(F.coalesce(attr(attrs, "class"), F.lit("")), r"\s+"), lambda c: c != "")


def canonical(tok: Column, kind: Column, name: Column) -> Column:
    """The token as it is written back: lower-case names, double-quoted attributes, minimal text escapes."""
    found = F.regexp_extract_all(F.regexp_replace(tok, r"^<[^\s/>]+|[\s/]*>\z", ""), F.lit(_ATTR), F.lit(0))

    def one(a: Column) -> Column:
        label = F.lower(F.regexp_extract(a, r"^([^\s=]+)", 1))
        value = F.regexp_replace(F.regexp_replace(a, r"(?s)^[^\s=]+\s*=?\s*", ""), r"""(?s)^(["'])(.*)\1\z""", "$2")
        return F.when(F.contains(a, F.lit("=")), F.concat(
            label, F.lit('="'), html_escape(entities.unescape(value)), F.lit('"'))).otherwise(label)

    attrs = F.concat_ws(" ", F.array(name), F.transform(found, one))
    plain = tok.rlike(r"^<[a-z0-9]+>$")
    return (
        F.when(kind == "text", html_escape(entities.unescape(tok), quote=False))
        .when(kind == "end", F.concat(F.lit("</"), name, F.lit(">")))
        .when((kind == "start") & ~plain, F.concat(F.lit("<"), attrs, F.lit(">")))
        .when(kind == "selfclose", F.concat(F.lit("<"), attrs, F.lit("/>")))
        .otherwise(tok)
    )


def visible_length(html: Column) -> Column:
    """Visible characters of a page: white space collapsed inside each text run, scripts and styles left out.

    A fold over the page's own pieces, so no page is taken apart into rows for it.
    """
    pieces = F.regexp_extract_all(html, F.lit(TOKEN), F.lit(0))
    runs = F.filter(pieces, lambda t: ~t.startswith("<") | (t == "<"))
    return F.aggregate(runs, F.lit(0).cast("bigint"), lambda n, t: n + F.length(squeeze(entities.unescape(t))))


def without_raw(html: Column) -> Column:
    """The page without comments and without script and style elements, in which tags are not tags."""
    return F.regexp_replace(
        html, r"(?is)<!--.*?-->|<script\b[^>]*>.*?</script\s*>|<style\b[^>]*>.*?</style\s*>", "")
