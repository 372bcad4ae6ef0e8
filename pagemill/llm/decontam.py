"""Benchmark decontamination with spaced seeds, in DataFrame functions only.

Texts become lower-case tokens of letters and digits. Fixed masks pick some tokens of a short window and ignore the others; their
hash is a seed. Seeds of the documents are joined with those of the benchmark, and every diagonal (document place minus item
place) with a hit is verified on the tokens themselves: the item lies on the document along the diagonal, and some ``WINDOW``
consecutive tokens of it (all, if it has fewer) must agree in 80 of 100 places. Any such overlap of an item of ``MIN_TOKENS`` or
more has four agreeing tokens in the form of a mask, so the seeds lose none.

Shorter items are too short for a mask with gaps: their seed is the hash of all their tokens, and they match as a whole only. Short words
can be in many clean documents; ``min_tokens`` leaves items below it out.

The benchmark's seeds are broadcast in blocks of at most ``BLOCK_SEEDS``, one pass over the documents each; more seeds make more
passes, not larger broadcasts. Hits are distinct diagonals, summed up before the shuffle.

Items are told apart by their text, so null and repeated item ids lose nothing: a pair with a null id stands for all items without one.
Null and empty texts have no tokens and match nothing. Rows that repeat give one pair for each id and item. Documents without an id are
filtered like others but not reported.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.session import durable

MASKS = ((0, 1, 2, 3), (0, 1, 3, 4), (0, 2, 3, 5))
WINDOW, PERCENT, MIN_TOKENS = 12, 80, 6
BLOCK_SEEDS = 1_000_000
#: Hits broadcast to pick the documents to verify; beyond this number they are joined by shuffle.
BROADCAST_HITS = 500_000


def tokens(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def hashed(df: DataFrame, text: str) -> DataFrame:
    """``df`` with the hashes of its tokens instead of its text."""
    return df.withColumn("hashes", F.transform(tokens(F.col(text)), lambda t: F.xxhash64(t))).drop(text)


def seeds(df: DataFrame) -> DataFrame:
    """A row ``seed, place`` for each mask at each place, next to the other columns of ``df`` but ``hashes``."""
    def at(mask: int) -> Column:
        places = MASKS[mask]
        last = F.size("hashes") - max(places) - 1
        return F.when(last >= 0, F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(F.lit(mask), *[F.get("hashes", i + k) for k in places])))

    kept = [c for c in df.columns if c != "hashes"]
    return reduce(DataFrame.unionAll, [df.select(*kept, F.posexplode(at(m)).alias("place", "seed")) for m in range(len(MASKS))])


def item_key(text: str) -> Column:
    return F.unhex(F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary")))


def items_of(benchmark: DataFrame, text: str, min_tokens: int) -> DataFrame:
    """``item_key, item`` (token hashes) of the distinct texts with ``min_tokens`` tokens or more."""
    slim = benchmark.select(item_key(text).alias("item_key"), F.coalesce(F.col(text), F.lit("")).alias("item_text")).distinct()
    return hashed(slim, "item_text").withColumnRenamed("hashes", "item").where(F.size("item") >= max(min_tokens, 1))


def whole_seeds(df: DataFrame, sizes: list[int]) -> DataFrame:
    """A row ``seed, place`` for each stretch of each of the given numbers of tokens, next to the other columns of ``df`` but ``hashes``."""
    def at(n: int) -> Column:
        last = F.size("hashes") - n
        return F.when(last >= 0, F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(F.lit(-n), *[F.get("hashes", i + k) for k in range(n)])))

    kept = [c for c in df.columns if c != "hashes"]
    return reduce(DataFrame.unionAll, [df.select(*kept, F.posexplode(at(n)).alias("place", "seed")) for n in sizes])


def overlaps(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_text: str = "text", min_tokens: int = 1) -> DataFrame:
    """``key, item_key, n_agree, n_window`` of verified overlaps; the keys are the MD5 of the whole texts."""
    items = items_of(benchmark, item_text, min_tokens)
    own = items.select("item_key", F.col("item").alias("hashes"))
    item_seeds = seeds(own.where(F.size("hashes") >= MIN_TOKENS))
    short = own.where(F.size("hashes") < MIN_TOKENS)
    sizes = sorted(r.n for r in short.select(F.size("hashes").alias("n")).distinct().collect())  # at most MIN_TOKENS - 1 numbers
    for n in sizes:
        item_seeds = item_seeds.unionAll(whole_seeds(short.where(F.size("hashes") == n), [n]))
    item_seeds = item_seeds.select("seed", "item_key", F.col("place").alias("item_place")).distinct()
    blocks = item_seeds.count() // BLOCK_SEEDS + 1
    body = F.coalesce(F.col(text), F.lit(""))
    slim = docs.select(F.md5(body.cast("binary")).alias("key"), body.alias("text"))
    cut = hashed(slim, "text")
    doc_seeds = seeds(cut).unionAll(whole_seeds(cut, sizes)) if sizes else seeds(cut)

    def block_hits(b: int) -> DataFrame:
        part = item_seeds.where(F.pmod("seed", F.lit(blocks)) == b) if blocks > 1 else item_seeds
        return doc_seeds.join(F.broadcast(part), "seed").select("key", "item_key", (F.col("place") - F.col("item_place")).alias("diagonal"))

    hits = reduce(DataFrame.unionAll, map(block_hits, range(blocks))).distinct()
    hits = durable(hits.groupBy("key", "item_key").agg(F.collect_set("diagonal").alias("diagonals")))
    small = F.broadcast if hits.count() <= BROADCAST_HITS else (lambda df: df)
    found = hashed(slim.join(small(hits), "key"), "text").join(items, "item_key").dropDuplicates(["key", "item_key"])
    laid = found.withColumn("diagonal", F.explode("diagonals"))
    agree = F.transform("item", lambda t, k: F.when((k + F.col("diagonal") >= 0) & (F.get("hashes", F.greatest(k + F.col("diagonal"), F.lit(0))) == t), 1).otherwise(0))
    laid = laid.select("key", "item_key", "diagonal", F.least(F.size("item"), F.lit(WINDOW)).alias("n_window"), agree.alias("agree"))
    sums = F.transform(F.sequence(F.lit(1), F.size("agree") - F.col("n_window") + 1),
                       lambda s: F.aggregate(F.slice("agree", s, F.col("n_window")), F.lit(0), lambda a, x: a + x))
    laid = laid.withColumn("sums", sums).withColumn("n_agree", F.array_max("sums"))
    percent = F.when(F.col("n_window") < MIN_TOKENS, 100).otherwise(PERCENT)
    right = laid.where(F.col("n_agree") * 100 >= F.col("n_window") * percent)
    return right.groupBy("key", "item_key").agg(F.max("n_agree").alias("n_agree"), F.first("n_window").alias("n_window"))


def contaminated(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """``doc_id, item_id, n_agree, n_window``: the documents that hold a passage of an item, with the agreeing tokens of the best window."""
    found = overlaps(docs, benchmark, text, item_text)
    named = benchmark.select(item_key(item_text).alias("item_key"), F.col(item_id).alias("item_id")).distinct()
    keyed = docs.select(F.col(doc_id).alias("doc_id"), F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary")).alias("key")).where("doc_id IS NOT NULL")
    pairs = keyed.join(found, "key").join(named, "item_key").groupBy("doc_id", "item_id").agg(F.max(F.struct("n_agree", "n_window")).alias("best"))
    return pairs.select("doc_id", "item_id", F.col("best.n_agree").cast("bigint").alias("n_agree"), F.col("best.n_window").cast("bigint").alias("n_window"))


def keep_clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that hold no passage of the benchmark, with their columns as they are."""
    dirty = overlaps(docs, benchmark).select(F.col("key").alias("__key")).distinct()
    key = F.md5(F.coalesce(docs["text"], F.lit("")).cast("binary"))
    return docs.join(dirty, key == F.col("__key"), "left_anti")
