"""Registry of the named queries and of the SQL each one is checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagemill.sources.pages import spread_over_cores

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def widen(df: DataFrame) -> DataFrame:
    """Integers as BIGINT, so that both engines report one type."""
    small = (T.IntegerType, T.ShortType, T.ByteType)
    return df.select(*[F.col(f.name).cast("bigint").alias(f.name) if isinstance(f.dataType, small) else F.col(f.name)
                       for f in df.schema.fields])


def query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        QUERIES[name] = lambda spark, sf_dir: widen(fn(spark, sf_dir))
        if oracle is not None:
            ORACLES[name] = oracle
        return fn
    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    found = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread_over_cores(found) if name in ("pages", "documents") else found


def derived(spark: SparkSession, sf_dir: str, name: str, **columns: str) -> DataFrame:
    """A whole table with extra columns; the SQL expressions are the ones the oracle uses too."""
    return table(spark, sf_dir, name).withColumns({k: F.expr(v) for k, v in columns.items()})


def flat(text: str = "text") -> Column:
    """A document's whole text on one line."""
    return F.trim(F.regexp_replace(F.col(text), r"\s{2,}|[\t\n\x0b\f\r]", " "))  # single blanks are left as they are


FLAT = r"trim(regexp_replace(text, '\s+', ' ', 'g'))"
ESC = "replace(replace(replace({0}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"
ESCQ = "replace(replace(" + ESC + ", '\"', '&quot;'), '''', '&#x27;')"


def esc(sql: str) -> str:
    return ESC.format(sql)


def escq(sql: str) -> str:
    return ESCQ.format(sql)


# --- SQL used by several oracles ------------------------------------------------------------------------------

UNESC = "replace(replace(replace(replace({0}, '&quot;', '\"'), '&copy;', '©'), '&middot;', '·'), '&amp;', '&')"
TOKENS = r"""
tok AS (
  SELECT page_id, url, pos, tok,
    CASE WHEN NOT starts_with(tok, '<') OR tok = '<' THEN 'text'
         WHEN starts_with(tok, '<!--') THEN 'comment' WHEN starts_with(tok, '<!') THEN 'decl'
         WHEN regexp_matches(tok, '(?is)^<(?:script|style)\b.*</') THEN 'raw'
         WHEN starts_with(tok, '</') THEN 'end' WHEN ends_with(tok, '/>') THEN 'selfclose' ELSE 'start' END AS kind,
    CASE WHEN starts_with(tok, '<!') THEN '' ELSE lower(regexp_extract(tok, '^</?([A-Za-z][^\s/>]*)', 1)) END AS name
  FROM (SELECT page_id, url, unnest(l) AS tok, generate_subscripts(l, 1) - 1 AS pos
        FROM (SELECT page_id, url, regexp_extract_all(html, '(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>|<[a-z/!][^>]*>|[^<]+|<') AS l FROM pages))),
deep AS (
  SELECT *, sum(CASE WHEN kind = 'end' THEN -1 WHEN kind = 'start' AND name NOT IN
    ('area','base','br','col','embed','hr','img','input','link','meta','param','source','track','wbr','command','keygen','menuitem')
    THEN 1 ELSE 0 END) OVER (PARTITION BY page_id ORDER BY pos) AS depth FROM tok)
"""
ORIGIN = r"regexp_extract(url, '^(https?://[^/?#]+)', 1)"
SITE = r"regexp_extract(url, '^https?://([^/?#]+)', 1)"
TITLE = "trim(regexp_replace(" + UNESC.format(r"regexp_extract(html, '(?is)<title\b[^>]*>(.*?)</title>', 1)") + r", '\s+', ' ', 'g'))"
H1 = "trim(regexp_replace(" + UNESC.format(r"regexp_extract(html, '(?is)<h1>(.*?)</h1>', 1)") + r", '\s+', ' ', 'g'))"
