"""Document fingerprints: bottom-k sketches of shingle hashes, in DataFrame functions only.

A sketch is the sorted array of the ``K`` smallest distinct hashes of a text's word shingles. The sketch of a union is made from the
sketches of its parts (``merged``), so texts of any number of parts are summed up before a shuffle. From sketches come the
resemblance of two texts, the containment of one in the other, and the number of distinct shingles; all are exact while no
sketch is full, else estimates with a standard error of about ``sqrt(p * (1 - p) / K)``.

Words are those of the lower-cased text (A-Z), cut at white space; a text with fewer words than a shingle is one shingle; null and
empty texts have an empty sketch. Two empty sketches resemble each other fully, an empty and a filled one not at all.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

K, WIDTH = 128, 5
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Range buckets for each shuffle partition, so that a bucket is a small part of a task.
BUCKETS_PER_PARTITION = 4
HEADS = pa.schema([("b", pa.int32()), ("head", pa.int64()), ("before", pa.int32())])


def with_sketch(df: DataFrame, text: str, name: str, width: int = WIDTH, k: int = K) -> DataFrame:
    """``df`` with the sketch of a text column."""
    words = F.filter(F.split(F.translate(F.coalesce(F.col(text), F.lit("")), UPPER, LOWER), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    hashed = df.withColumn("__hashes", F.transform(words, lambda w: F.xxhash64(w)))
    whole = F.when(F.size("__hashes") > 0, F.array(F.xxhash64("__hashes"))).otherwise(F.array().cast("array<bigint>"))
    shingles = F.transform(F.sequence(F.lit(0), F.size("__hashes") - width), lambda i: F.xxhash64(*[F.get("__hashes", i + j) for j in range(width)]))
    every = hashed.withColumn("__shingles", F.when(F.size("__hashes") >= width, shingles).otherwise(whole)).drop("__hashes")
    return every.withColumn(name, F.slice(F.sort_array(F.array_distinct("__shingles")), 1, k)).drop("__shingles")


def merged(a: Column, b: Column, k: int = K) -> Column:
    """The sketch of the union."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Shared part of the union's sketch."""
    both = merged(a, b, k)
    shared = F.size(F.array_intersect(both, F.array_intersect(a, b)))
    return F.when(F.size(both) == 0, 1.0).otherwise(shared / F.greatest(F.size(both), F.lit(1)))


def distinct_shingles(a: Column, k: int = K) -> Column:
    """Number of distinct shingles: exact below ``k``, else from the place of the k-th hash among all possible ones."""
    share = (F.element_at(a, -1).cast("double") + F.lit(2.0 ** 63)) / F.lit(2.0 ** 64)
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((k - 1) / share)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Part of ``a`` that is in ``b``."""
    shared = resemblance(a, b, k) * distinct_shingles(merged(a, b, k), k)
    return F.when(F.size(a) == 0, 1.0).otherwise(F.least(F.lit(1.0), shared / F.greatest(distinct_shingles(a, k), F.lit(1.0))))


def printed(a: Column) -> Column:
    """A sketch as text: hexadecimal hashes in order."""
    return F.array_join(F.transform(a, lambda h: F.lower(F.hex(h))), ",")


def with_next(df: DataFrame, doc_id: str, columns: list[str]) -> DataFrame:
    """``df`` with ``next_<column>`` from the row with the next larger id; the last row's next is the first one.

    Ids are dealt into ranges at their quantiles. The first row of each range also goes to the range before it, so that one
    exchange brings every row together with its next. Rows with one id are ordered by ``columns``; null ids come first.
    """
    spark = df.sparkSession
    buckets = BUCKETS_PER_PARTITION * int(spark.conf.get("spark.sql.shuffle.partitions"))
    ids = df.select(F.col(doc_id).alias("id"))
    cuts = ids.agg(F.percentile_approx("id", [k / buckets for k in range(1, buckets)], 10 * buckets)).first()[0] or []
    cuts = F.array(*[F.lit(int(c)) for c in sorted(set(cuts))]).cast("array<bigint>")
    bucket = F.coalesce(F.size(F.filter(cuts, lambda c: c <= F.col("id"))), F.lit(0))
    # One row for each range, at most ``buckets``.
    firsts = ids.withColumn("b", bucket).groupBy("b").agg(F.min(F.struct(F.col("id").isNotNull().alias("has"), "id")).alias("least")).orderBy("b").collect()
    # From an Arrow table Spark takes rows without starting Python workers in the executors.
    rows = pa.table([[r.b for r in firsts], [r.least.id for r in firsts], [firsts[k - 1].b for k in range(len(firsts))]], HEADS)
    heads = spark.createDataFrame(rows, "b int, head long, before int")
    dealt = df.withColumn("id", F.col(doc_id)).withColumn("b", bucket).join(F.broadcast(heads), "b")
    own = F.struct(F.col("b").alias("b"), F.lit(False).alias("lent"))
    lent = F.struct(F.col("before").alias("b"), F.lit(True).alias("lent"))
    dealt = dealt.withColumn("to", F.explode(F.when(F.col("id").eqNullSafe(F.col("head")), F.array(own, lent)).otherwise(F.array(own))))
    dealt = dealt.select(*df.columns, "to.b", "to.lent", "id")
    w = Window.partitionBy("b").orderBy("lent", F.col("id").asc_nulls_first(), *columns)
    return dealt.select("*", *[F.lead(c).over(w).alias(f"next_{c}") for c in columns]).where("NOT lent").drop("b", "lent", "id")


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Sketches of every text, of its edited text, and of the next document's text, with their likeness.

    ``doc_id, n_chars, edited, sketch, edited_sketch, near_edited, near_next, n_shingles``; in the edited text the last half is replaced
    by as many characters of the next document.
    """
    slim = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    pairs = with_next(with_sketch(slim, "text", "sketch"), "doc_id", ["text", "sketch"])
    half = F.floor(F.length("text") / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), F.length("text") - half), F.substring("next_text", F.lit(1), half))
    both = with_sketch(pairs.withColumn("edited", edited), "edited", "edited_sketch")
    return both.select("doc_id", F.length("text").cast("bigint").alias("n_chars"), "edited", "sketch", "edited_sketch",
                       resemblance(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"),
                       resemblance(F.col("sketch"), F.col("next_sketch")).alias("near_next"), distinct_shingles(F.col("sketch")).alias("n_shingles"))
