"""Connected components of a table of links, without bringing links or components to the driver."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.session import durable


def forest(links: DataFrame) -> DataFrame:
    """Each task reduces the links it reads to ``(node, smallest node of its part)``; in this form components stay the same."""
    def run(batches):
        root: dict[int, int] = {}

        def find(x: int) -> int:
            top = x
            while root.setdefault(top, top) != top:
                top = root[top]
            while root[x] != top:
                root[x], x = top, root[x]
            return top

        def rows():
            nodes = list(root)
            keys, tops = np.array(nodes, np.int64), np.array([find(x) for x in nodes], np.int64)
            return pa.RecordBatch.from_arrays([pa.array(keys[keys != tops]), pa.array(tops[keys != tops])], ["u", "v"])

        for batch in batches:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                a, b = find(a), find(b)
                if a != b:
                    root[max(a, b)] = min(a, b)
            if len(root) > 1_000_000:
                yield rows()
                root.clear()
        if root:
            yield rows()

    return links.mapInArrow(run, "u long, v long")


def components(links: DataFrame) -> DataFrame:
    """``node, component`` of every node that has a link in ``links`` (two columns of ids); the component is its smallest node.

    Stars alternate: every node hands its larger neighbours, then its smaller ones, to the smallest node it knows, until nothing
    changes. Links of a node are never gathered; only minima and distinct pairs are.
    """
    a, b = links.columns
    edges = durable(forest(links.where(F.col(a) != F.col(b)).select(F.col(a).alias("u"), F.col(b).alias("v"))).distinct())
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = both.join(least, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        nxt = durable(small.select("e.u", "e.v").where("u != v").distinct())
        print_of = [df.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first() for df in (edges, nxt)]
        edges = nxt
        if print_of[0] == print_of[1]:
            break
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
