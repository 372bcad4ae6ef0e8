"""Site-level tables and documents built from page results.

``results``: ``site, ord, url, title, md, success, error`` with ``ord`` the page number, dense or not, once in a site. Documents are produced as
ordered rows, never as one string per site: a site may hold a third of all pages, so its document is a sorted set of
sections that is written out in order by many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.functions import markdown_text as mt, urls
from pagemill.functions.text import html_escape, link_label, yaml_string
from pagemill.operators import rewrite, sequence
from pagemill.session import durable

# Wording of the generated documents.
DOC_TITLE, INDEX_TITLE = "批量导出文档", "批量导出索引"
INFO, TOC, PAGES = "## 文档信息", "## 目录", "## 页面列表"
EXPORTED, COUNT, SITE, UNIT = "- **导出时间**：", "- **页面数量**：", "- **来源站点**：", " 页"
FAILED, FAILED_WHY, ORIGINAL, SOURCE, REWRITTEN = "(获取失败)", "(获取失败: ", "- 原始链接：", "- 来源：", "站内链接改写：共 "


def with_anchors(results: DataFrame) -> DataFrame:
    """Add ``slug`` and ``anchor``: the slug, then slug-2, slug-3 in page order. Failed pages get none."""
    good = results.where("success").select("site", "ord", urls.anchor_slug(F.col("title")).alias("slug"))
    numbers = sequence.row_numbers(good, ["site", "slug"], ["ord"], "_n")
    anchor = F.when(F.col("_n") == 1, F.col("slug")).otherwise(F.concat("slug", F.lit("-"), F.col("_n").cast("string")))
    return results.join(numbers, ["site", "ord"], "left").select(*results.columns, "slug", anchor.alias("anchor"))


def stored_pages(results: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The results, evaluated and stored once, and their slim columns with slugs and anchors, which all document parts are made from."""
    stored = durable(results)
    return stored, durable(with_anchors(stored.drop("md")))


def anchor_stats(anchored: DataFrame) -> DataFrame:
    """Per site: anchors, distinct slugs, slugs used more than once."""
    per_slug = anchored.where("success").groupBy("site", "slug").agg(F.count("*").alias("n"))
    return per_slug.groupBy("site").agg(F.sum("n").alias("total_anchors"), F.count("*").alias("unique_anchors"),
                                        F.count_if(F.col("n") > 1).alias("collisions"))


def top_collisions(anchored: DataFrame, k: int = 10) -> DataFrame:
    """The most repeated slugs of the whole export."""
    return anchored.where("success").groupBy("slug").agg(F.count("*").alias("n")).where("n > 1").orderBy(
        F.desc("n"), "slug").limit(k)


def url_anchors(anchored: DataFrame) -> DataFrame:
    """``site, url, anchor``: every spelling of a page's address; the last page wins, the own address before aliases."""
    good = anchored.where("success").select("site", "ord", "anchor", F.posexplode(urls.port_aliases(F.col("url"))).alias("alias", "url"))
    return good.groupBy("site", "url").agg(F.max_by("anchor", F.struct("ord", F.col("alias"))).alias("anchor"))


def front_matter(title: Column, url: Column, run_time: str, tags: list[str] | None = None) -> Column:
    lines = [F.lit("---"), F.concat(F.lit('title: "'), yaml_string(title), F.lit('"')),
             F.concat(F.lit('source: "'), yaml_string(url), F.lit('"')), F.lit(f'date: "{run_time}"')]
    if tags:
        quoted = ", ".join(f'"{t}"' for t in tags)
        lines.append(F.lit(f"tags: [{quoted}]"))
    return F.concat(F.concat_ws("\n", *lines, F.lit("---")), F.lit("\n\n"))


def page_document(title: Column, url: Column, md: Column, run_time: str, redact: bool = True) -> Column:
    """One page as a file: front matter, title, source, body."""
    shown = urls.redact(url) if redact else url
    body = mt.redact_destinations(md) if redact else md
    return F.concat(front_matter(title, shown, run_time), F.lit("# "), title, F.lit("\n\n- Source: "), shown, F.lit("\n\n"), body)


def file_names(results: DataFrame, folder: str = "", reserved: tuple[str, ...] = ()) -> DataFrame:
    """Add ``file_name`` to successful pages: a stem from the title, ``_1``, ``_2`` for repeats in page order, each name once.

    Pages of one stem take its numbers in order. Where two stems meet in one name, the earlier page keeps it; the other stem may not
    use that number, and its pages move up. This goes on over the stems concerned until all names differ. Only site, page number and stem
    take part; ``site, ord`` identify a page, numbers are not negative. Names made from ``reserved`` titles are left for others.
    """
    named = results.where("success").select("site", "ord", F.substring(urls.file_stem(F.col("title")), 1, 50).alias("_stem"))
    for k, title in enumerate(reserved, 1):
        named = named.union(results.select("site").distinct().select("site", F.lit(-k).cast("bigint"), urls.file_stem(F.lit(title))))
    fitted = named.withColumn("_stem", F.regexp_replace(urls.fit_path(folder, F.concat("_stem", F.lit(".md"))), r"\.md$", ""))
    ranked = durable(sequence.row_numbers(fitted, ["site", "_stem"], ["ord"], "_n").select("site", "ord", "_stem", (F.col("_n") - 1).alias("_rank")))
    refused: DataFrame | None = None
    while True:
        placed = ranked.withColumn("_k", F.col("_rank"))
        if refused is not None:
            few = F.broadcast if refused.count() <= 100_000 else (lambda df: df)
            placed = ranked.join(few(refused), ["site", "_stem"], "left").withColumn("_k", F.aggregate(
                F.coalesce("_refused", F.array().cast("array<bigint>")), F.col("_rank"), lambda k, r: F.when(r <= k, k + 1).otherwise(k)))
        placed = placed.withColumn("_name", F.when(F.col("_k") == 0, F.col("_stem")).otherwise(F.concat("_stem", F.lit("_"), F.col("_k").cast("string"))))
        owners = placed.groupBy("site", "_name").agg(F.count("*").alias("_n"), F.min("ord").alias("_owner")).where("_n > 1")
        lost = placed.join(owners, ["site", "_name"]).where("ord > _owner").groupBy("site", "_stem").agg(F.sort_array(F.collect_set("_k")).alias("_lost"))
        lost = durable(lost)
        if lost.isEmpty():
            break
        if refused is None:
            refused = lost.withColumnRenamed("_lost", "_refused")
        else:
            none = F.array().cast("array<bigint>")
            refused = durable(refused.join(lost, ["site", "_stem"], "full_outer").select(
                "site", "_stem", F.sort_array(F.array_union(F.coalesce("_refused", none), F.coalesce("_lost", none))).alias("_refused")))
    names = placed.select("site", "ord", F.concat("_name", F.lit(".md")).alias("file_name"))
    return results.where("success").join(names, ["site", "ord"]).select(*results.columns, "file_name")


def page_files(results: DataFrame, run_time: str, folder: str = "", redact: bool = True, assets: str | None = None, reserved: tuple[str, ...] = ()) -> DataFrame:
    """``site, ord, file_name, content``: one document per successful page."""
    md = mt.shared_asset_paths(F.col("md"), assets) if assets else F.col("md")
    return file_names(results, folder, reserved).select("site", "ord", "file_name", page_document(
        F.col("title"), F.col("url"), md, run_time, redact).alias("content"))


def _numbered_pages(results: DataFrame) -> DataFrame:
    return sequence.row_numbers(results.drop("md"), ["site"], ["ord"], "n")


def _head(results: DataFrame) -> DataFrame:
    """Per site: successful pages and the origin of the first one; merged map-side before any exchange."""
    origin = F.concat(urls.scheme(F.col("url")), F.lit("://"), urls.authority(F.col("url")))
    return results.groupBy("site").agg(
        F.count_if("success").alias("pages"), F.min_by(F.when(F.col("success"), origin), F.when(F.col("success"), F.col("ord"))).alias("origin"),
        F.min_by(origin, "ord").alias("first_origin"))


def merged_sections(results: DataFrame, run_time: str, rewrite_links: bool = True, redact: bool = True, toc: bool = True,
                    title: str = DOC_TITLE) -> DataFrame:
    """The merged document of every site as rows ``site, part, ord, text``; sorted by (part, ord), joined by line breaks.

    Parts: 0 head, 1 contents, 2 separator, 3 pages, 4 footer.
    """
    stored, anchored = stored_pages(results)
    bodies = stored.where("success").select("site", "ord", mt.demote_headings(F.col("md"), 2).alias("md"))
    if rewrite_links:
        bodies = _linked(bodies, url_anchors(anchored))
    else:
        bodies = bodies.withColumn("rewritten", F.lit(0).cast("bigint"))
    body = mt.redact_destinations(F.col("b.md")) if redact else F.col("b.md")
    shown = urls.redact(F.col("a.url")) if redact else F.col("a.url")
    joined = anchored.alias("a").join(bodies.alias("b"), ["site", "ord"], "left")
    good = F.concat(F.lit('<h2 id="'), F.col("a.anchor"), F.lit('">'), html_escape(F.col("a.title")), F.lit("</h2>\n\n" + SOURCE), shown,
                    F.lit("\n\n"), body, F.lit("\n\n---\n"))
    bad = F.concat(F.lit("## "), F.col("a.title"), F.lit("\n\n> ⚠️ 获取失败："), F.coalesce("a.error", F.lit("None")), F.lit("\n\n" + ORIGINAL), shown, F.lit("\n\n---\n"))
    pages = joined.select("site", F.lit(3).alias("part"), "ord", F.when(F.col("a.success"), good).otherwise(bad).alias("text"),
                          F.coalesce("b.rewritten", F.lit(0)).alias("rewritten"))
    pages = durable(pages) if rewrite_links else pages
    head_text = F.concat(
        F.lit(f'---\ntitle: "{title}"\ndate: "{run_time}"\npages: '), F.col("pages").cast("string"), F.lit(f"\n---\n\n# {title}\n"),
        F.when(F.col("pages") > 0, F.concat(F.lit(f"\n{INFO}\n\n{EXPORTED}{run_time}\n{COUNT}"), F.col("pages").cast("string"),
                                            F.lit(f"{UNIT}\n{SITE}"), F.col("origin"), F.lit("\n\n---\n"))).otherwise(F.lit("")))
    heads = _head(anchored).select("site", F.lit(0).alias("part"), F.lit(-1).cast("bigint").alias("ord"), F.concat(
        head_text, F.lit(f"\n{TOC}\n" if toc else "")).alias("text"))
    parts = heads.unionByName(pages.drop("rewritten"))
    if toc:
        label = link_label(F.col("title"))
        entry = F.concat(F.col("n").cast("string"), F.lit(". "), F.when(F.col("success"), F.concat(
            F.lit("["), label, F.lit("](#"), "anchor", F.lit(")"))).otherwise(F.concat(F.lit("~~"), label, F.lit(f"~~ {FAILED}"))))
        parts = parts.unionByName(_numbered_pages(anchored).select("site", F.lit(1).alias("part"), "ord", entry.alias("text")))
        parts = parts.unionByName(heads.select("site", F.lit(2).alias("part"), "ord", F.lit("\n---\n").alias("text")))
    if rewrite_links:
        footer = pages.groupBy("site").agg(F.sum("rewritten").alias("r")).where("r > 0").select(
            "site", F.lit(4).alias("part"), F.lit(-1).cast("bigint").alias("ord"),
            F.concat(F.lit(f"\n<!-- {REWRITTEN}"), F.col("r").cast("string"), F.lit(" 处 -->")).alias("text"))
        parts = parts.unionByName(footer)
    return parts


def _linked(bodies: DataFrame, table: DataFrame) -> DataFrame:
    """Rewrite links of all sites at once; a page is known by its site and number."""
    named = bodies.withColumn("_id", F.concat_ws("\x01", "site", F.col("ord").cast("string")))
    done = rewrite.internal_links(named, table, "md", "_id", "site")
    return done.select(F.substring_index("_id", "\x01", 1).alias("site"), F.substring_index("_id", "\x01", -1).cast("bigint").alias("ord"),
                       "md", "rewritten")


def index_lines(results: DataFrame, run_time: str, title: str = INDEX_TITLE, reserved: tuple[str, ...] = ()) -> DataFrame:
    """The index document of every site as rows ``site, part, ord, text`` (part 0 head, 1 entries)."""
    results = results.drop("md")
    names = file_names(results, "", reserved).select("site", "ord", "file_name")
    numbered = _numbered_pages(results).join(names, ["site", "ord"], "left")
    label = link_label(F.col("title"))
    entry = F.concat(F.col("n").cast("string"), F.lit(". "), F.when(F.col("success"), F.concat(
        F.lit("["), label, F.lit("](./"), "file_name", F.lit(")"))).otherwise(F.concat(
            F.lit("~~"), label, F.lit(f"~~ {FAILED_WHY}"), F.coalesce("error", F.lit("None")), F.lit(")"))))
    head = F.concat(F.lit(f'---\ntitle: "{title}"\ndate: "{run_time}"\npages: '), F.col("pages").cast("string"),
                    F.lit(f"\n---\n\n# {title}\n\n{INFO}\n\n{EXPORTED}{run_time}\n{COUNT}"), F.col("pages").cast("string"),
                    F.lit(f"{UNIT}\n{SITE}"), F.col("first_origin"), F.lit(f"\n\n---\n\n{PAGES}\n"))
    return _head(results).select("site", F.lit(0).alias("part"), F.lit(-1).cast("bigint").alias("ord"), head.alias("text")).unionByName(
        numbered.select("site", F.lit(1).alias("part"), "ord", entry.alias("text")))


def dual_output(results: DataFrame, run_time: str, assets: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Merged sections and page files from results that are evaluated once; page files use the merged documents' assets."""
    stored = durable(results)
    return merged_sections(stored, run_time), page_files(stored, run_time, assets=assets)


def assembled(sections: DataFrame) -> DataFrame:
    """``site, chars, sections, document_sha256`` of the documents that the sections make, joined by line breaks.

    Each document is one value here; :func:`document_rows` is the form for documents of any size.
    """
    return sections.groupBy("site").agg(F.sum(F.length("text")).alias("chars"), F.count("*").alias("sections"), F.sha2(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("part", "ord", "text"))), lambda s: s["text"]), "\n"), 256).alias("document_sha256"))


INDEX_FILE = "index"


def document_rows(results: DataFrame, run_time: str, redact: bool = True, assets: str | None = None) -> DataFrame:
    """All documents of all sites as rows ``path, part, ord, content`` for :func:`pagemill.sources.named_files.write_files`.

    ``pages/<site>/<name>.md`` for every page, ``pages/<site>/index.md`` with links to them and ``merged/<site>.md``. The results are
    evaluated once. A colon in a site is written ``%3A``, an empty site ``_``.
    """
    stored = durable(results)
    folder = F.replace(F.coalesce(F.nullif("site", F.lit("")), F.lit("_")), F.lit(":"), F.lit("%3A"))
    own = page_files(stored, run_time, "", redact, assets, (INDEX_FILE,))
    own = own.select(F.concat(F.lit("pages/"), folder, F.lit("/"), "file_name").alias("path"), F.lit(0).alias("part"), F.lit(0).cast("bigint").alias("ord"), "content")
    index = index_lines(stored, run_time, reserved=(INDEX_FILE,)).select(F.concat(F.lit("pages/"), folder, F.lit(f"/{INDEX_FILE}.md")), "part", "ord", "text")
    merged = merged_sections(stored, run_time, redact=redact).select(F.concat(F.lit("merged/"), folder, F.lit(".md")), "part", "ord", "text")
    return own.union(index).union(merged)


def write_documents(sections: DataFrame, path: str, files: int | None = None) -> None:
    """Write ordered sections as text under one folder per site.

    Rows are range-partitioned by (site, part, ord), so a large site spreads over many files whose names sort in
    document order; joining a site's files gives its document.
    """
    order = ["site", "part", "ord"]
    ranged = sections.repartitionByRange(files, *order) if files else sections.repartitionByRange(*order)
    ranged.sortWithinPartitions(*order).select("site", "text").write.mode("overwrite").partitionBy("site").text(path)


def outcome(results: DataFrame) -> DataFrame:
    """Per site: succeeded, failed and the resulting status."""
    return results.groupBy("site").agg(F.count_if("success").alias("succeeded"), F.count_if(~F.col("success")).alias("failed")).withColumn(
        "status", F.when(F.col("failed") == 0, "ok").when(F.col("succeeded") == 0, "failed").otherwise("partial"))


# --- integrity checks -----------------------------------------------------------------------------------------

def image_references(docs: DataFrame, md: str = "md", key: str = "page_id") -> DataFrame:
    """``key, ref, is_local`` of every Markdown image."""
    raw = F.explode(F.regexp_extract_all(md, F.lit(r"!\[[^\]]*\]\(([^)]+)\)"), F.lit(1)))
    refs = docs.select(key, raw.alias("ref")).select(key, F.trim("ref").alias("ref"))
    bare = F.when(F.col("ref").rlike("^<.*>$"), F.trim(F.substring("ref", F.lit(2), F.length("ref") - 2))).otherwise(F.col("ref"))
    clean = F.trim(F.regexp_replace(bare, r"""\s+["'][^"']*["']\s*$""", ""))
    return refs.select(key, clean.alias("ref")).withColumn("is_local", ~F.col("ref").rlike("(?i)^[a-z]+://"))


def missing_files(references: DataFrame, files: DataFrame) -> DataFrame:
    """Local references without a file, first as written, then percent-decoded. ``files``: ``path``.

    Files are asked once for each distinct reference, so a logo that all documents show is one row of the lookup.
    """
    local = references.where("is_local")
    names = local.select("ref").distinct()
    gone = names.join(files.select(F.col("path").alias("ref")), "ref", "left_anti").withColumn("_d", urls.percent_decode(F.col("ref")))
    gone = gone.join(files.select(F.col("path").alias("_d")), "_d", "left_anti").select("ref")
    return local.join(gone, "ref", "left_semi").select(references.columns)


def reference_report(docs: DataFrame, files: DataFrame, md: str = "md", key: str = "page_id") -> DataFrame:
    """Per document: image references, local ones, missing ones."""
    refs = image_references(docs, md, key)
    totals = refs.groupBy(key).agg(F.count("*").alias("image_refs"), F.count_if("is_local").alias("local_refs"))
    gone = missing_files(refs, files).groupBy(key).agg(F.count("*").alias("missing"))
    return totals.join(gone, key, "left").select(key, "image_refs", "local_refs", F.coalesce("missing", F.lit(0)).alias("missing"))


def unused_assets(files: DataFrame, docs: DataFrame, md: str = "md") -> DataFrame:
    """Asset files whose name occurs nowhere in any document.

    Names made of word characters, dots and dashes only occur inside one run of such characters: every piece of a run that is as
    long as some name is looked up, in runs with a dot if all names have one. Other names are looked up among the last path parts of
    all link and image destinations, as written and percent-decoded.
    """
    facts = files.agg(F.struct(F.collect_set(F.length("file_name")).alias("n"), F.bool_and(F.contains("file_name", F.lit("."))).alias("dot"))).scalar()
    words = docs.select(F.explode(F.regexp_extract_all(md, F.lit(r"[\p{L}\p{N}_.\-]+"), F.lit(0))).alias("w")).distinct().withColumn("facts", facts)
    words = words.where(~F.col("facts.dot") | F.contains("w", F.lit("."))).withColumn("lengths", F.col("facts.n"))
    pieces = F.flatten(F.transform(F.filter(F.col("lengths"), lambda n: n <= F.length("w")), lambda n: F.transform(
        F.sequence(F.lit(1), F.length("w") - n + 1), lambda i: F.substring(F.col("w"), i, n))))
    seen = words.select(F.explode(F.array_distinct(pieces)).alias("file_name"))
    targets = F.regexp_extract_all(md, F.lit(r"""\]\(\s*<[^>\n]+|\]\(\s*[^)<\n]+|\b(?:src|href)\s*=\s*["']([^"'\n]+)"""), F.lit(0))
    ends = docs.select(F.explode(targets).alias("t")).distinct().select(F.regexp_replace("t", r"""^(?:\]\(\s*<?|(?:src|href)\s*=\s*["'])""", "").alias("t"))
    ends = ends.select(F.explode(F.array(F.col("t"), F.regexp_replace("t", r"""\s+["'].*$""", ""), F.regexp_replace("t", r"[?#].*$", ""))).alias("t"))
    last = F.trim(F.substring_index("t", "/", -1))
    linked = ends.select(F.explode(F.array(last, urls.percent_decode(last))).alias("file_name"))
    return files.join(seen.unionByName(linked).distinct(), "file_name", "left_anti")
