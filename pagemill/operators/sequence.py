"""Numbering and lookups that hold up when one key owns a large part of the rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagemill.session import durable

#: A key with more than one in so many left rows of a lookup is hot; there are fewer such keys than this number.
HOT_SHARE = 10_000


def row_numbers(df: DataFrame, keys: list[str], order: list[str], out: str = "rn") -> DataFrame:
    """``row_number`` per key in ``order`` without putting a whole key into one task.

    The rows are sorted into ranges of key and order and stored, so ``df`` is evaluated once. A range numbers its own rows; only the keys
    that a range begins or ends with can go on in another one, and the counts of these few (two for each range) are added in front.
    Hand in slim rows with a total order inside a key.
    """
    stored = durable(df.repartitionByRange(*keys, *order).withColumn("_part", F.spark_partition_id()))
    numbered = stored.withColumn("_in", F.row_number().over(Window.partitionBy("_part", *keys).orderBy(*order)))
    key = F.struct(*keys)
    edges = stored.groupBy("_part").agg(F.array(F.min(key), F.max(key)).alias("ends")).select(F.explode("ends").alias("_key")).distinct()
    split = stored.select("_part", key.alias("_key")).join(F.broadcast(edges), "_key").groupBy("_key", "_part").agg(F.count("*").alias("_size"))
    before = Window.partitionBy("_key").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = split.select("_key", "_part", F.sum("_size").over(before).alias("_start")).where("_start > 0")
    starts = starts.select(F.col("_part").alias("_at"), "_start", *[F.col(f"_key.{k}").alias(f"_k{n}") for n, k in enumerate(keys)])
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_k{n}")) for n, k in enumerate(keys)], F.col("_part") == F.col("_at"))
    joined = numbered.join(F.broadcast(starts), same, "left")
    return joined.select(*df.columns, (F.coalesce("_start", F.lit(0)) + F.col("_in")).cast("bigint").alias(out))


def first_seen(df: DataFrame, keys: list[str], order: list[str], carry: list[str] | None = None) -> DataFrame:
    """One row per key, the first in order. An aggregate, so copies are merged before anything is shuffled."""
    kept = [c for c in (carry or []) if c not in keys]
    best = F.min_by(F.struct(*order, *kept), F.struct(*order)).alias("_first")
    picked = df.groupBy(*keys).agg(best)
    return picked.select(*keys, *[F.col(f"_first.{c}").alias(c) for c in [*order, *kept]])


def lookup(left: DataFrame, right: DataFrame, key: str, value: str, row_id: Column | None = None) -> DataFrame:
    """Left join ``left.key`` to a ``right`` that has one row per key, safe against hot keys on the left.

    A key with more than one in ``HOT_SHARE`` of the left rows is hot; there can be fewer than ``HOT_SHARE`` such
    keys whatever the data, so their right rows are broadcast. Everything else joins through a shuffle in which no
    key is large; rows that are already served are spread out there instead of piling up on one NULL key.
    """
    counts = left.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("_n"))
    total = counts.agg((F.sum("_n") / HOT_SHARE).alias("_limit"))
    hot_keys = counts.where(F.col("_n") > F.greatest(F.coalesce(total.scalar(), F.lit(0)), F.lit(1_000)))
    slim = right.select(F.col(key).alias("_key"), F.col(value).alias("_value"))
    hot = slim.join(hot_keys.select(F.col(key).alias("_key")), "_key", "left_semi")
    served = left.join(F.broadcast(hot.withColumnsRenamed({"_key": "_hot_key", "_value": "_hot_value"})),
                       F.col(key) == F.col("_hot_key"), "left")
    spread_id = row_id if row_id is not None else F.xxhash64(*[F.col(c) for c in left.columns])
    join_key = F.when(F.col("_hot_key").isNotNull() | F.col(key).isNull(),
                      F.concat(F.lit("\x00"), spread_id.cast("string"))).otherwise(F.col(key))
    joined = served.withColumn("_join", join_key).join(slim, F.col("_join") == F.col("_key"), "left")
    return joined.select(*left.columns, F.coalesce("_hot_value", "_value").alias(value))


def runs(df: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """``keys, run, value, size``: maximal stretches of equal values inside one document."""
    w = Window.partitionBy(*keys).orderBy(*order)
    changed = df.withColumn("_new", (~F.col(value).eqNullSafe(F.lag(value, 1).over(w)) | (F.row_number().over(w) == 1)).cast("int"))
    numbered = changed.withColumn("run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return numbered.groupBy(*keys, "run").agg(F.first(value).alias(value), F.count("*").alias("size"))
