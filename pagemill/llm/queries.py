"""One named query for each operator of this folder, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    from pagemill.llm.common import bounded_batches
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pagemill.llm.decontam import contaminated
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


#: Every pair of equal tokens, counted along diagonals; no seeds.
ORACLES["op1_decontamination"] = r"""
WITH d AS (SELECT DISTINCT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS t FROM documents WHERE doc_id IS NOT NULL),
ids AS (SELECT DISTINCT item_id, text FROM benchmark), b AS (SELECT DISTINCT text, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS t FROM benchmark),
dt AS (SELECT doc_id, t AS doc, unnest(t) AS tok, generate_subscripts(t, 1) AS p FROM d),
bt AS (SELECT text, len(t) AS n, least(len(t), 12) AS w, CASE WHEN len(t) < 6 THEN 100 ELSE 80 END AS pct, unnest(t) AS tok, generate_subscripts(t, 1) AS p FROM b WHERE len(t) >= 1),
m AS (SELECT doc_id, doc, text, w, n, pct, dt.p - bt.p AS diag, bt.p AS p FROM dt JOIN bt USING (tok)),
busy AS (SELECT * FROM m QUALIFY count(*) OVER (PARTITION BY doc_id, doc, text, diag) * 100 >= pct * w),
s AS (SELECT doc_id, text, w, pct, count(*) OVER (PARTITION BY doc_id, doc, text, diag ORDER BY p RANGE BETWEEN CURRENT ROW AND 11 FOLLOWING) AS k FROM busy),
best AS (SELECT doc_id, text, k, w FROM s WHERE k * 100 >= pct * w)
SELECT doc_id, item_id, max({'k': k, 'w': w}).k AS n_agree, max({'k': k, 'w': w}).w AS n_window FROM best JOIN ids USING (text) GROUP BY doc_id, item_id
"""


@query
def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pagemill.llm.quality import score_documents
    return score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pagemill.llm.fingerprints import fingerprints, printed
    return fingerprints(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), printed(F.col("sketch")).alias("fingerprint"),
        printed(F.col("edited_sketch")).alias("edited_fingerprint"), "near_edited", "near_next", "n_shingles")


@query
def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pagemill.llm.html_extract import extract
    return extract(table(spark, sf_dir, "pages"))


@query
def op5_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pagemill.llm.minhash_forest import classes
    return classes(table(spark, sf_dir, "documents"), width=2)


@query
def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pagemill.llm.chat_trie import build, read_back
    control = "</s>[INST] ok [/INST]"
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.createDataFrame([(-7, 0, "user", control), (-7, 1, "assistant", control)], "conv_id long, turn long, role string, text string")
    return read_back(build(turns.union(extra))).select("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")


@query
def op7_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pagemill.llm.lm_automaton import score_held_out
    return score_held_out(table(spark, sf_dir, "documents")).select(
        "doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


@query
def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pagemill.llm.token_counts import count_tokens
    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query
def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pagemill.llm.suffix_dedup import remove_repeats
    return remove_repeats(table(spark, sf_dir, "documents")).select(
        "doc_id", F.octet_length(F.coalesce("text", F.lit(""))).cast("bigint").alias("n_bytes"), "__cut.n_removed", "__cut.n_spans",
        F.sha2("__cut.kept", 256).alias("kept_sha256"))


@query
def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pagemill.llm.bpe import encode_packed
    coded = encode_packed(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return coded.select("doc_id", (F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
                        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


@query
def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pagemill.llm.prefix_trie import borrowed_beginnings, trie_nodes
    return trie_nodes(borrowed_beginnings(table(spark, sf_dir, "conversations")))


#: CRC-32 bit by bit; a node is named by the digests of its turns, and adds itself to all its ancestors.
ORACLES["op11_prefix_trie"] = r"""
WITH t AS (SELECT conv_id AS c, octet_length(encode(coalesce(text, ''))) AS bytes, md5(octet_length(encode(coalesce(role, ''))) || ':' || coalesce(role, '') || coalesce(text, '')) AS m,
  row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), md5(octet_length(encode(coalesce(role, ''))) || ':' || coalesce(role, '') || coalesce(text, ''))) AS r
  FROM conversations WHERE conv_id IS NOT NULL),
ids AS (SELECT c, xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(c::VARCHAR, ''), lambda x: [ascii(x)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
  lambda a, b: CASE WHEN b >= 0 THEN xor(a, b) WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384::BIGINT) ELSE a >> 1 END), 4294967295::BIGINT) % 9 AS h FROM (SELECT DISTINCT c FROM t)),
u AS (SELECT ids.c, 0 AS part, b.r, b.m, b.bytes FROM ids JOIN t b ON b.c = ids.c - ids.c % 5 AND b.r <= ids.h
  UNION ALL SELECT ids.c, 1, t.r, t.m, t.bytes FROM ids JOIN t ON t.c = ids.c AND t.r > ids.h),
s AS (SELECT ids.c, coalesce(list(u.m ORDER BY part, r) FILTER (u.m IS NOT NULL), []) AS ms, coalesce(list(u.bytes ORDER BY part, r) FILTER (u.m IS NOT NULL), []) AS bs
  FROM ids LEFT JOIN u ON u.c = ids.c GROUP BY ids.c),
p AS (SELECT c, unnest(range(0, len(ms) + 1)) AS d, ms, bs FROM s),
k AS (SELECT c, d, array_to_string(ms[1:d], '') AS key, CASE WHEN d > 0 THEN bs[d] ELSE 0 END AS bytes, d = len(ms) AS ends FROM p),
n AS (SELECT key, d, min(c) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(bytes) AS saved, coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (ends), '') AS e FROM k GROUP BY key, d),
f AS (SELECT n.*, (SELECT count(*) FROM n AS x WHERE x.d = n.d + 1 AND left(x.key, 32 * n.d) = n.key) AS n_children FROM n),
g AS (SELECT left(key, 32 * a) AS key, sum(saved) AS saved, count(*) FILTER (n_children = 0) AS n_leaves FROM (SELECT *, unnest(range(0, d + 1)) AS a FROM f) GROUP BY 1)
SELECT f.conv_id, f.d AS depth, up.conv_id AS parent_conv_id, f.n_convs, f.n_children, g.n_leaves, g.saved::BIGINT AS saved_tokens, sha256(f.e) AS ends_sha256
FROM f JOIN g USING (key) LEFT JOIN n AS up ON up.d = f.d - 1 AND up.key = left(f.key, 32 * (f.d - 1))
"""


@query
def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pagemill.llm.lexical_search import search
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


#: Every document that shares a term with an item is scored.
ORACLES["op12_lexical_search"] = r"""
WITH d AS (SELECT row_number() OVER () AS n, doc_id, regexp_extract_all(text, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t FROM documents),
dt AS (SELECT n, doc_id, len(t) AS size, translate(unnest(t), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term FROM d WHERE len(t) > 0),
total AS (SELECT count(DISTINCT n) AS docs, count(*) AS terms FROM dt),
b AS (SELECT DISTINCT item_id, text, regexp_extract_all(text, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t FROM benchmark),
bt AS (SELECT DISTINCT item_id, text, translate(unnest(t), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term FROM b),
tf AS (SELECT n, doc_id, size, term, count(*) AS tf FROM dt WHERE term IN (SELECT term FROM bt) GROUP BY ALL),
w AS (SELECT term, floor(1000 * ln((2 * any_value(docs) + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM tf, total GROUP BY term),
s AS (SELECT item_id, text, n, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + (50 * size * docs) // terms))))::BIGINT AS score
  FROM bt JOIN tf USING (term) JOIN w USING (term), total GROUP BY ALL)
SELECT item_id, row_number() OVER (PARTITION BY item_id, text ORDER BY score DESC, doc_id NULLS FIRST)::INTEGER AS rank, doc_id, score
FROM s WHERE score > 0 QUALIFY rank <= 50
"""


@query
def op13_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pagemill.llm.url_filter import judge
    return judge(table(spark, sf_dir, "pages"))


#: Rules one by one; aliases by reachability over absolute targets of canonical links and refreshes.
ORACLES["op13_url_filters"] = r"""
WITH RECURSIVE rules(verdict, host, path) AS (VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')),
p AS (SELECT row_number() OVER () AS n, page_id, url, regexp_replace(coalesce(html, ''), '(?is)<!--.*?-->|<script\b[^>]*>.*?</script\s*>|<style\b[^>]*>.*?</style\s*>', '', 'g') AS html FROM pages),
tags AS (SELECT url, unnest(regexp_extract_all(html, '(?i)<(?:link|meta)\b[^>]*>')) AS tag FROM p),
e AS (SELECT url AS a, CASE WHEN regexp_matches(tag, '(?i)^<link.*\brel\s*=\s*["'']?(?:[^"''>]*\s)?canonical\b') THEN regexp_extract(tag, '(?i)\bhref\s*=\s*["'']?([^"''>\s]+)', 1)
  WHEN regexp_matches(tag, '(?i)^<meta.*\bhttp-equiv\s*=\s*["'']?refresh\b') THEN regexp_extract(tag, '(?i)\burl\s*=\s*["'']*([^"''>\s]+)', 1) ELSE '' END AS b FROM tags WHERE url IS NOT NULL),
u AS (SELECT DISTINCT url FROM (SELECT url FROM p UNION ALL SELECT b FROM e WHERE b != '') WHERE url IS NOT NULL),
s AS (SELECT url, translate(regexp_extract(url, '(?s)^(.*?)://', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS scheme,
  translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path,
  regexp_extract(url, '(?s)^.*?://[^/?#]*[^?#]*(\?[^#]*)', 1) AS q FROM u),
f AS (SELECT s.url, s.host, s.path, CASE WHEN contains(s.url, '://') THEN s.scheme || '://' || s.host || s.path || s.q ELSE split_part(s.url, '#', 1) END AS id, r.host || r.path AS rule, r.verdict
  FROM s LEFT JOIN rules r ON (s.host = r.host OR s.host LIKE '%.' || r.host) AND starts_with(s.path, r.path) QUALIFY row_number() OVER (PARTITION BY s.url ORDER BY length(r.host || r.path) DESC NULLS LAST, r.verdict) = 1),
g AS (SELECT fa.id AS a, fb.id AS b FROM e JOIN f fa ON fa.url = e.a JOIN f fb ON fb.url = e.b WHERE e.b != ''),
ways AS (SELECT a, b FROM g UNION SELECT b, a FROM g),
reach AS (SELECT DISTINCT id AS x, id AS y FROM f UNION SELECT reach.x, ways.b FROM reach JOIN ways ON ways.a = reach.y),
said AS (SELECT reach.x AS id, bool_or(f.verdict = 'allow') AS allowed, bool_or(f.verdict = 'block') AS blocked FROM reach JOIN f ON f.id = reach.y GROUP BY reach.x)
SELECT p.page_id, coalesce(f.host, '') AS host, coalesce(f.path, '') AS path, f.rule, coalesce(f.verdict, CASE WHEN said.allowed IS NOT TRUE AND said.blocked THEN 'block' ELSE 'allow' END) AS verdict, p.url
FROM p LEFT JOIN f ON f.url = p.url LEFT JOIN said ON said.id = f.id
"""
