"""Inputs: page tables, URL lists, saved HTML files, block records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagemill.functions import binary
from pagemill.functions.text import strip

#: The page size that crawls usually allow; a page job has no limit unless it is given one.
MAX_HTML_BYTES = 10 * 1024 * 1024


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """``page_id, url, html`` of every page; see :func:`size_error` for those that cannot be used."""
    return spread_over_cores(spark.read.parquet(path).select("page_id", "url", "html"))


def spread_over_cores(df: DataFrame) -> DataFrame:
    """``df`` in as many partitions as there are cores, if its input comes in fewer splits (a file with one row group is one split).

    Pages take far more time to work on than to move. Inputs with enough splits, as large ones have, are left as they are.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def size_error(html: Column, max_bytes: int = 0) -> Column:
    """Why a page cannot be used: it has no HTML, or more than ``max_bytes`` of it (0: no limit). NULL for a usable page."""
    missing = F.when(html.isNull(), "no html")
    return missing.when(F.octet_length(html) > max_bytes, "html too large") if max_bytes > 0 else missing


def url_line(line: Column) -> Column:
    """STRUCT<url, title, status> of one line of a URL list; status is 'ok', 'skipped' or 'rejected'."""
    text = strip(line)
    has_title = F.contains(text, F.lit("|"))
    url = strip(F.when(has_title, F.substring_index(text, "|", 1)).otherwise(text))
    title = F.when(has_title, strip(F.regexp_extract(text, r"(?s)^[^|]*\|(.*)$", 1)))
    status = F.when((text == "") | text.startswith("#"), "skipped").when(url.rlike("^https?://"), "ok").otherwise("rejected")
    return F.struct(url.alias("url"), title.alias("title"), status.alias("status"))


def url_list(lines: DataFrame, line: str = "line", number: str = "line_no") -> tuple[DataFrame, DataFrame]:
    """Accepted ``line_no, url, title`` and rejected ``line_no, url``."""
    read = lines.select(number, url_line(F.col(line)).alias("_u")).select(number, "_u.*")
    return (read.where("status = 'ok'").select(number, "url", "title"), read.where("status = 'rejected'").select(number, "url"))


def read_url_list(spark: SparkSession, path: str) -> DataFrame:
    """``path, line_no, line`` of URL list files, with true line numbers in each file.

    Files are read in splits, so a list of any size is many tasks. Lines of a file are in order by block and by place in the block;
    the blocks are numbered by the sum of the lines before them.
    """
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"),
                                         F.monotonically_increasing_id().alias("at"), F.make_valid_utf8(F.col("value")).alias("line"))
    sizes = lines.groupBy("path", "block").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    before = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("path", "block", "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    return lines.join(starts, ["path", "block"]).select("path", (F.col("start") + F.col("at") - F.col("first") + 1).alias("line_no"), "line")


def read_saved_html(spark: SparkSession, path: str, max_bytes: int = 0, charsets: list[str] | None = None) -> DataFrame:
    """``path, html, error`` of saved pages, decoded by their declared character set.

    ``charsets``: the declared sets that count, all by default. With ``max_bytes`` a larger file is not read and gives a row with an error instead. Spark skips files without any bytes.
    """
    files = spark.read.format("binaryFile").load(path)
    if max_bytes <= 0:
        return files.select("path", binary.decode_page(F.col("content"), charsets).alias("html"), F.lit(None).cast("string").alias("error"))
    small = files.where(F.col("length") <= max_bytes).select("path", binary.decode_page(F.col("content"), charsets).alias("html"), F.lit(None).cast("string").alias("error"))
    large = files.where(F.col("length") > max_bytes).select("path", F.lit(None).cast("string").alias("html"), F.lit("html too large").alias("error"))
    return small.unionByName(large)


def block_records(dumps: DataFrame, json: str = "json", key: str = "page_id") -> DataFrame:
    """``key, block_id, type, properties, format, content`` from saved record maps; malformed entries are ignored."""
    records = F.from_json(F.get_json_object(json, "$.recordMap.block"), "map<string,string>")
    entries = dumps.select(key, F.explode(records).alias("block_id", "_r")).select(
        key, "block_id", F.get_json_object("_r", "$.value").alias("_v")).where("_v IS NOT NULL AND _v NOT IN ('{}', 'null')")
    get = lambda p: F.get_json_object("_v", f"$.{p}")
    return entries.select(key, "block_id", F.coalesce(get("type"), F.lit("")).alias("type"), get("properties").alias("properties"),
                          get("format").alias("format"), F.coalesce(F.from_json(get("content"), "array<string>"),
                                                                    F.array().cast("array<string>")).alias("content"))
