"""Workspace pages stored as block records: find a page's blocks, order them, render them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagemill.functions import urls
from pagemill.functions.text import bind, html_escape
from pagemill.session import durable

_RICH = "array<array<string>>"


def rich_text(value: Column) -> Column:
    """HTML of a rich-text property: segments of text with optional format codes, applied in order."""
    def segment(s: Column) -> Column:
        formats = F.coalesce(F.from_json(F.get(s, 1), _RICH), F.array().cast(_RICH))

        def wrap(text: Column, f: Column) -> Column:
            code = F.get(f, 0)
            # Format code -> tag.
            out = text
            for name, tag in [("b", "b"), ("i", "i"), ("s", "s"), ("c", "code"), ("_", "u"), ("h", "mark")]:
                out = F.when(code == name, F.concat(F.lit(f"<{tag}>"), text, F.lit(f"</{tag}>"))).otherwise(out)
            return F.when((code == "a") & (F.size(f) > 1), F.concat(
                F.lit('<a href="'), html_escape(F.get(f, 1)), F.lit('">'), text, F.lit("</a>"))).otherwise(out)

        return F.aggregate(formats, html_escape(F.coalesce(F.get(s, 0), F.lit(""))), wrap)

    return F.coalesce(F.array_join(F.transform(F.from_json(value, _RICH), segment), ""), F.lit(""))


def plain_text(value: Column) -> Column:
    return F.coalesce(F.array_join(F.transform(F.from_json(value, _RICH), lambda s: F.get(s, 0)), ""), F.lit(""))


def first_value(properties: Column, name: str) -> Column:
    return F.get(F.get(F.from_json(F.get_json_object(properties, f"$.{name}"), _RICH), 0), 0)


def proxied_image(url: Column, block_id: Column) -> Column:
    """Public address of an internally stored image."""
    # The workspace's image service.
    stored = F.concat(F.lit("https://www.notion.so/image/"), urls.percent_encode(url), F.lit("?table=block&id="), block_id)
    return F.when(url.startswith("attachment:") | F.contains(url, F.lit("s3")), stored).when(
        url.startswith("/"), F.concat(F.lit("https://www.notion.so"), url)).otherwise(url)


def by_id(blocks: DataFrame) -> DataFrame:
    """One record for each block id, whatever the number of dumps that hold it: the smallest of those with the most children."""
    rest = [c for c in blocks.columns if c not in ("block_id", "content")]
    best = F.min_by(F.struct("content", *rest), F.struct(-F.size("content"), *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in rest])).alias("_b")
    return blocks.groupBy("block_id").agg(best).select("block_id", "_b.*").select(blocks.columns)


def tree(blocks: DataFrame, roots: DataFrame) -> DataFrame:
    """Walk from the root blocks to all blocks below: ``page_id, block_id, path, parent``.

    ``roots``: ``page_id, block_id``. ``path`` is the list of child positions, so it sorts in reading order. A block belongs to a page
    once, at the shortest and then first of its paths, so shared blocks are not multiplied and circles end.

    Distances double: after ``k`` rounds all blocks nearer than ``2 ** k`` are known, and ``steps`` holds the first walk of just ``2 ** k``
    steps from each block to each other. A shortest walk of up to twice that length is one to a known block and one such walk, so
    a chain of 10,000 blocks takes 15 rounds. The records are read once, for the single steps.
    """
    return _walk(by_id(blocks), roots)


def _walk(blocks: DataFrame, roots: DataFrame) -> DataFrame:
    """:func:`tree` over records of which each block has one. Rounds end as soon as there are no walks of their length."""
    single = blocks.select(F.col("block_id").alias("top"), F.posexplode("content").alias("ord", "block_id"))
    steps = durable(single.groupBy("top", "block_id").agg(F.array(F.min("ord")).alias("part")).withColumn("parent", F.col("top")))
    seen = durable(roots.select("page_id", "block_id", F.array().cast("array<int>").alias("path"), F.lit(None).cast("string").alias("parent")).distinct())
    known = seen.count()
    while True:
        further = seen.select("page_id", F.col("block_id").alias("top"), "path").join(steps, "top").select(
            "page_id", "block_id", F.concat("path", "part").alias("path"), "parent")
        best = seen.union(further).groupBy("page_id", "block_id").agg(F.min(F.struct(F.size("path").alias("n"), "path", "parent")).alias("_s"))
        seen = durable(best.select("page_id", "block_id", "_s.path", "_s.parent"))
        before, known = known, seen.count()
        if known == before:
            return seen
        after = steps.select(F.col("top").alias("block_id"), F.col("block_id").alias("_to"), F.col("part").alias("_part"), F.col("parent").alias("_parent"))
        twice = steps.drop("parent").join(after, "block_id").groupBy("top", "_to").agg(F.min(F.struct(F.concat("part", "_part").alias("part"), F.col("_parent").alias("parent"))).alias("_s"))
        steps = durable(twice.select("top", F.col("_to").alias("block_id"), "_s.part", "_s.parent"))
        if steps.isEmpty():
            return seen


def missing(walked: DataFrame, blocks: DataFrame) -> DataFrame:
    """Child ids that no record describes."""
    return walked.select("page_id", "block_id").distinct().join(blocks.select("block_id"), "block_id", "left_anti")


def _markup(kind: Column, title: Column, p: Column, f: Column, block_id: Column) -> Column:
    """STRUCT<opening, closing> around a block's children. Lists are grouped by the caller."""
    link = F.coalesce(first_value(p, "link"), F.lit(""))
    source = F.coalesce(first_value(p, "source"), F.lit(""))
    shown = F.coalesce(F.nullif(first_value(p, "title"), F.lit("")), link)
    tick = F.when(F.lower(first_value(p, "checked")) == "yes", "☑ ").otherwise("☐ ")
    icon = F.coalesce(F.concat(html_escape(F.nullif(F.get_json_object(f, "$.page_icon"), F.lit(""))), F.lit(" ")), F.lit(""))
    lang = F.lower(F.coalesce(first_value(p, "language"), F.lit("")))
    code = html_escape(plain_text(F.get_json_object(p, "$.title")))
    raw_image = F.coalesce(F.nullif(first_value(p, "source"), F.lit("")), F.nullif(F.get_json_object(f, "$.display_source"), F.lit("")))
    caption = rich_text(F.get_json_object(p, "$.caption"))
    image = F.concat(F.lit('<img src="'), html_escape(proxied_image(raw_image, block_id)), F.lit('" alt="'), html_escape(caption), F.lit('">'))
    figure = F.when(caption != "", F.concat(F.lit("<figure>"), image, F.lit("<figcaption>"), caption, F.lit("</figcaption></figure>\n"))).otherwise(
        F.concat(image, F.lit("\n")))
    para = lambda inner: F.concat(F.lit("<p>"), inner, F.lit("</p>\n"))
    anchor = lambda href, text: para(F.concat(F.lit('<a href="'), html_escape(href), F.lit('">'), html_escape(text), F.lit("</a>")))
    none = F.lit("")
    opening = (
        F.when(kind == "header", F.concat(F.lit("<h1>"), title, F.lit("</h1>\n")))
        .when(kind == "sub_header", F.concat(F.lit("<h2>"), title, F.lit("</h2>\n")))
        .when(kind == "sub_sub_header", F.concat(F.lit("<h3>"), title, F.lit("</h3>\n")))
        .when(kind == "to_do", para(F.concat(tick, title)))
        .when(kind == "toggle", F.concat(F.lit("<details><summary>"), title, F.lit("</summary>\n")))
        .when(kind == "quote", F.concat(F.lit("<blockquote>"), title))
        .when(kind == "callout", F.concat(F.lit('<div class="callout"><p>'), icon, title, F.lit("</p>")))
        .when(kind == "code", F.concat(F.lit("<pre><code"), F.when(lang != "", F.concat(
            F.lit(' class="language-'), html_escape(lang), F.lit('"'))).otherwise(none), F.lit(">"), code, F.lit("</code></pre>\n")))
        .when(kind == "image", F.coalesce(figure, none)).when(kind == "divider", "<hr/>\n")
        .when(kind == "bookmark", F.when(link != "", anchor(link, shown)).otherwise(none))
        .when(kind.isin("column_list", "column"), '<div class="columns">')
        .when(kind.isin("embed", "video", "audio", "file"), F.when(source != "", anchor(source, source)).otherwise(none))
        .when(kind == "table_of_contents", "")
        .when(kind.isin("bulleted_list", "numbered_list"), F.concat(F.lit("<li>"), title))
        .when(kind == "page", F.when(title != "", F.concat(F.lit("<h2>"), title, F.lit("</h2>\n"))).otherwise(none))
        .when(title != "", para(title)).otherwise(none)
    )
    closing = (
        F.when(kind == "toggle", "</details>\n").when(kind == "quote", "</blockquote>\n")
        .when(kind.isin("callout", "column_list", "column"), "</div>\n")
        .when(kind.isin("bulleted_list", "numbered_list"), "</li>\n").otherwise("")
    )
    return F.struct(opening.alias("opening"), closing.alias("closing"))


def _row_cells(properties: Column) -> Column:
    """HTML of the cells of a native table's row, in the order they are stored."""
    cells = F.filter(F.transform(F.map_entries(F.from_json(properties, "map<string,string>")), lambda e: e["value"]),
                     lambda v: v.startswith("["))
    return F.transform(cells, rich_text)


def _row_html(cells: Column, tag: Column) -> Column:
    return bind(tag, lambda t: F.concat(F.lit("<tr>"), F.array_join(F.transform(cells, lambda c: F.concat(
        F.lit("<"), t, F.lit(">"), c, F.lit("</"), t, F.lit(">"))), ""), F.lit("</tr>\n")))


def fragments(walked: DataFrame, blocks: DataFrame) -> DataFrame:
    """``page_id, path, at, part``: opening (at 0) and closing (at 1) markup of every block below the page.

    Markup is made from the record where it meets its path, and travels once, to its page.
    """
    info = walked.where(F.size("path") > 0).join(blocks.where("type IS NOT NULL"), "block_id")
    kind = F.col("type")
    none = F.lit(None).cast("array<string>")
    made = F.when(~kind.isin("table", "table_row"), _markup(
        kind, rich_text(F.get_json_object("properties", "$.title")), F.col("properties"), F.col("format"), F.col("block_id")))
    head = F.when(kind == "table", F.coalesce(F.get_json_object("format", "$.table_block_column_header") == "true", F.lit(False)))
    slim = info.select("page_id", "parent", "path", (kind == "table_row").alias("_row"), head.alias("_head"),
                       F.when(kind.isin("table", "table_row"), F.col("block_id")).alias("_id"),
                       F.when(kind == "bulleted_list", "ul").when(kind == "numbered_list", "ol").otherwise("").alias("_tag"),
                       made.alias("_m"), F.when(kind == "table_row", _row_cells(F.col("properties"))).otherwise(none).alias("_cells"))
    paged = slim.repartition("page_id")
    # rows of a table: numbered and framed among themselves, if the table is a block of the page
    own = Window.partitionBy("page_id", F.when(F.col("_row"), F.col("parent")).otherwise(F.col("_id")))
    filled = F.coalesce(F.col("_row") & (F.size("_cells") > 0), F.lit(False))
    by_row = own.orderBy("path").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = paged.withColumns({"_head": F.max("_head").over(own), "_rows": F.sum(filled.cast("int")).over(own), "_n": F.sum(filled.cast("int")).over(by_row)})
    cell = F.when(F.col("_head") & (F.col("_n") == 1), "th").otherwise("td")
    row = F.concat(F.when(F.col("_n") == 1, "<table>\n").otherwise(""), _row_html(F.col("_cells"), cell), F.when(F.col("_n") == F.col("_rows"), "</table>\n").otherwise(""))
    # what is not shown: rows of anything but a table, and everything below a block that swallows its children
    by_parent = Window.partitionBy("page_id", "parent", "_row").orderBy("path")
    runs = ranked.withColumns({"_before": F.lag("_tag", 1, "").over(by_parent), "_after": F.lead("_tag", 1, "").over(by_parent)})
    starts = F.when((F.col("_tag") != "") & (F.col("_before") != F.col("_tag")), F.concat(F.lit("<"), "_tag", F.lit(">\n"))).otherwise(F.lit(""))
    ends = F.when((F.col("_tag") != "") & (F.col("_after") != F.col("_tag")), F.concat(F.lit("</"), "_tag", F.lit(">\n"))).otherwise(F.lit(""))
    # a closing piece sorts after everything below its block: its path is extended by the largest position; rows come before all else below their table
    in_table = F.concat(F.slice("path", F.lit(1), F.size("path") - 1), F.array(F.lit(-1)), F.slice("path", -1, 1))
    pieces = F.when(F.col("_row"), F.array(F.struct(in_table.alias("path"), F.when(filled & F.col("_head").isNotNull() & F.col("page_id").isNotNull(), row).alias("part")))).otherwise(F.array(
        F.struct("path", F.concat(starts, F.col("_m.opening")).alias("part")),
        F.struct(F.concat("path", F.array(F.lit(2147483647))).alias("path"), F.concat(F.col("_m.closing"), ends).alias("part"))))
    return runs.select("page_id", F.explode(pieces).alias("_e")).select("page_id", "_e.path", "_e.part").where("part <> ''")


def to_html(blocks: DataFrame, roots: DataFrame) -> DataFrame:
    """``page_id, html``: the body of each page."""
    blocks = durable(by_id(blocks))
    walked = _walk(blocks, roots)
    return fragments(walked, blocks).groupBy("page_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("path", "part"))), lambda e: e["part"]), "").alias("html"))
