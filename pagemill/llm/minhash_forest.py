"""Near-duplicate classes with a MinHash LSH forest.

Texts with equal shingle sets are one node. A node has ``TREES`` short signature orders of ``DEPTH`` minima each. All orders are
sorted in ranges over the cluster. Nodes whose longest common prefix reaches ``FIRST`` minima form a region, and the depth adapts
to it: a region with more than ``REGION`` nodes is cut at the next minimum until its parts are smaller. Small regions give pairs
of neighbours; the sets of larger ones meet in one place, where pivots are compared with all others until every two nodes in
different classes have been compared. What a cut has kept apart is made up for: members of a cut region that are not in its
largest class are compared with all its members, block by block; so are those of a region that lies at the edge of a range. So no group is expanded into all its pairs, and no partner is
dropped. Every link is confirmed on full sets of 64-bit shingle hashes: ``100 * intersection >= 80 * union``.

Two nodes at similarity 0.8 meet in an order with probability 0.8 ** 4, so that a lone pair just at the limit is missed with a
probability of 0.0003 (one of 0.9 with less than one in a million); the sorted ranges and adaptive cuts lower this only for
groups of thousands, whose members have many links.

Null and empty texts, and texts without words, have no shingles and no links. A text with fewer words than a shingle is one
shingle. Rows that share an id are one document with several texts. Rows without an id
make no links: they take the class of an equal text, else null, and are kept.
"""

from __future__ import annotations

import hashlib
import itertools
import struct

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.llm.common import words
from pagemill.session import durable
from pagemill.llm.components import components
from pagemill.llm.merges import WordCache, per_worker

TREES, DEPTH, FIRST = 16, 8, 4
SMALL, REGION, OVERLAP = 16, 2048, 8
#: Marks the name of a region that was cut.
LARGE = "large:"
PERCENT = 80
#: Ids broadcast to pick the candidates' texts; beyond this number the texts are joined by shuffle.
BROADCAST_IDS = 1_000_000
_ODD = np.uint64(0x9E3779B97F4A7C15)


def shingle_set(text: bytes, width: int) -> np.ndarray:
    """Sorted distinct hashes of the word shingles of a text."""
    hashes = per_worker(("word hashes", 0), lambda: WordCache(xxhash.xxh64_intdigest))
    found = np.array([hashes[w] for w in words(text)], np.uint64)
    if len(found) < width:
        return np.array([xxhash.xxh64_intdigest(found.tobytes(), seed=len(found))], np.uint64) if len(found) else found
    mixed = np.zeros(len(found) - width + 1, np.uint64)
    for k in range(width):
        mixed = (mixed ^ mixed >> np.uint64(29)) * _ODD + found[k:len(found) - width + 1 + k]
    mixed = (mixed ^ mixed >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
    return np.unique(mixed ^ mixed >> np.uint64(32))


def _factors() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(11)
    n = TREES * DEPTH
    return rng.integers(1, 1 << 32, n, np.uint64).astype(np.uint32) | np.uint32(1), rng.integers(0, 1 << 32, n, np.uint64).astype(np.uint32)


def signature(shingles: np.ndarray) -> np.ndarray:
    """Minima of the set under all hash functions."""
    a, b = _FACTORS
    low, high = shingles.astype(np.uint32), (shingles >> np.uint64(32)).astype(np.uint32)
    out = np.full(TREES * DEPTH, 0xFFFFFFFF, np.uint32)
    for k in range(0, len(low), 1024):
        h = low[k:k + 1024, None] * a
        h ^= h >> np.uint32(15)
        h += high[k:k + 1024, None]
        h *= b | np.uint32(1)
        np.minimum(out, h.min(axis=0), out=out)
    return out


_FACTORS = _factors()


def summaries(docs: DataFrame, width: int) -> DataFrame:
    """``id, n, digest, sig`` of every row: set size, digest of the whole set, and its signature orders."""
    def run(batches):
        for batch in batches:
            n, digests, sigs = [], [], []
            for text in batch.column(1).to_pylist():
                shingles = shingle_set(text, width)
                n.append(len(shingles))
                digests.append(hashlib.blake2b(shingles.tobytes(), digest_size=16).digest() if n[-1] else None)
                sigs.append(signature(shingles).astype(">u4").tobytes() if n[-1] else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(digests, pa.binary()), pa.array(sigs, pa.binary())],
                                             ["id", "n", "digest", "sig"])
    return docs.select("id", "text").mapInArrow(run, "id long, n long, digest binary, sig binary")


def regions(nodes: DataFrame) -> DataFrame:
    """``region, id, other``: pairs of small regions (region null), members of larger ones and, under a name of its own, of each region that was cut or may lie in several ranges."""
    orders = nodes.select("id", "n", "sig", F.explode(F.sequence(F.lit(0), F.lit(TREES - 1))).alias("tree"))
    orders = orders.select("tree", F.expr(f"substring(sig, tree * {4 * DEPTH} + 1, {4 * DEPTH})").alias("order"), "n", "id")
    runs = orders.repartitionByRange("tree", "order").sortWithinPartitions("tree", "order", "id")

    def pairs(order, n, ids, lo, hi):
        for i in range(lo, hi):
            for j in range(i + 1, hi):
                if 100 * min(n[i], n[j]) >= PERCENT * max(n[i], n[j]) and (order[i] == order[j]).sum() >= FIRST + 2 and ids[i] != ids[j]:
                    yield None, min(ids[i], ids[j]), max(ids[i], ids[j])

    def cut(order, n, ids, lo, hi, depth, tree):
        """The rows of one region, its first ``depth`` minima being equal."""
        if hi - lo <= SMALL:
            yield from pairs(order, n, ids, lo, hi)
            return
        if hi - lo <= REGION or depth == DEPTH:
            for k in range(lo, max(lo + 1, hi - OVERLAP), REGION - OVERLAP):
                name = hashlib.blake2b(struct.pack("<qq", tree, depth) + order[k].tobytes() + struct.pack("<q", ids[k]), digest_size=12).hexdigest()
                for i in range(k, min(hi, k + REGION)):
                    yield name, ids[i], None
        else:
            ends = [*(np.flatnonzero(np.diff(order[lo:hi, depth].astype(np.int64))) + lo + 1).tolist(), hi]
            for a, b in zip([lo, *ends], ends):
                if b - a > 1:
                    yield from cut(order, n, ids, a, b, depth + 1, tree)

    def close(rows, edge=False):
        # The first and the last region of a range may go on in the next one; all parts of a region share its name.
        if rows and (edge or len(rows) > REGION):
            name = f"{LARGE}{rows[0][0]}:{rows[0][1][:4 * FIRST].hex()}"
            for row in rows:
                yield name, row[3], None
        if len(rows) > 1:
            order = np.frombuffer(b"".join(r[1] for r in rows), ">u4").reshape(-1, DEPTH)
            yield from cut(order, [r[2] for r in rows], [r[3] for r in rows], 0, len(rows), FIRST, rows[0][0])

    def batch_of(rows):
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), *(pa.array([r[k] for r in rows], pa.int64()) for k in (1, 2))],
                                          ["region", "id", "other"])

    def closed(batches):
        # A run of equal first minima within the sorted range; its rows are some tens of bytes each.
        held, edge = [], True
        for batch in batches:
            for row in zip(*(batch.column(k).to_pylist() for k in range(4))):
                if held and (held[0][0] != row[0] or held[0][1][:4 * FIRST] != row[1][:4 * FIRST]):
                    yield from close(held, edge)
                    held, edge = [], False
                held.append(row)
        yield from close(held, True)

    def run(batches):
        rows = closed(batches)
        while out := list(itertools.islice(rows, 20_000)):
            yield batch_of(out)

    return runs.mapInArrow(run, "region string, id long, other long")


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= PERCENT * (len(a) + len(b) - both)


def region_links(ids: list[int], sets: list[np.ndarray]):
    """Links that join all classes within a region, each confirmed on full sets.

    A pivot is compared with every other node at once. Pivots come from all classes but the largest until those have no other
    nodes left: then all nodes of different classes have been compared.
    """
    size = np.array([len(s) for s in sets])
    values, flat = np.unique(np.concatenate(sets), return_inverse=True)
    starts = np.concatenate([[0], np.cumsum(size)[:-1]])
    label, pivoted = np.arange(len(ids)), np.zeros(len(ids), bool)
    while True:
        names, sizes = np.unique(label, return_counts=True)
        open_ = np.flatnonzero(~pivoted & ((label != names[sizes.argmax()]) | (not pivoted.any())))
        if len(names) == 1 or not len(open_):
            return
        p = open_[0]
        pivoted[p] = True
        mark = np.zeros(len(values), np.int64)
        mark[flat[starts[p]:starts[p] + size[p]]] = 1
        both = np.add.reduceat(mark[flat], starts)
        hit = 100 * both >= PERCENT * (size + size[p] - both)
        for k in np.flatnonzero(hit & (label != label[p])).tolist():
            if label[k] != label[p]:
                yield ids[p], ids[k]
                label[label == label[k]] = label[p]


def candidate_sets(found: DataFrame, docs: DataFrame, width: int) -> DataFrame:
    """``id, shingles`` of all candidates."""
    ids = found.select(F.explode(F.array("id", "other")).alias("id")).where("id IS NOT NULL").distinct()
    ids = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids

    def to_sets(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([shingle_set(t, width).tobytes() for t in batch.column(1).to_pylist()], pa.binary())], ["id", "shingles"])

    return durable(docs.select("id", "text").join(ids, "id", "left_semi").mapInArrow(to_sets, "id long, shingles binary"))


def confirm(found: DataFrame, sets: DataFrame) -> DataFrame:
    """``a, b`` of the candidates that are links."""
    def check_pairs(batches):
        for batch in batches:
            a, b, x, y = (batch.column(k).to_pylist() for k in range(4))
            hit = [k for k in range(len(a)) if linked(np.frombuffer(x[k], np.uint64), np.frombuffer(y[k], np.uint64))]
            yield pa.RecordBatch.from_arrays([pa.array([v[k] for k in hit], pa.int64()) for v in (a, b)], ["a", "b"])

    pairs = found.where("region IS NULL").select(F.col("id").alias("a"), F.col("other").alias("b")).distinct()
    pairs = pairs.join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("x")), "a").join(sets.select(F.col("id").alias("b"), F.col("shingles").alias("y")), "b")
    links = pairs.select("a", "b", "x", "y").mapInArrow(check_pairs, "a long, b long")

    def check_regions(batches):
        held, name = [], None

        def close():
            got = list(region_links([r[1] for r in held], [np.frombuffer(r[2], np.uint64) for r in held])) if len(held) > 1 else []
            return pa.RecordBatch.from_arrays([pa.array([g[k] for g in got], pa.int64()) for k in (0, 1)], ["a", "b"])

        for batch in batches:
            for row in zip(*(batch.column(k).to_pylist() for k in range(3))):
                if row[0] != name:
                    yield close()
                    held, name = [], row[0]
                held.append(row)
        yield close()

    members = found.where(F.col("region").isNotNull() & ~F.col("region").startswith(LARGE)).select("region", "id").join(sets, "id").select("region", "id", "shingles")
    return links.union(members.repartition("region").sortWithinPartitions("region").mapInArrow(check_regions, "a long, b long"))


def cell_links(ids: list[int], labels: list[int], stray: list[bool], sets: list[np.ndarray]):
    """Links between the strays of a cell and its other members, one for each class that a stray is linked with."""
    members = [k for k in range(len(ids)) if not stray[k]]
    if not members or len(members) == len(ids):
        return
    size = np.array([len(sets[k]) for k in members])
    values, flat = np.unique(np.concatenate([sets[k] for k in members]), return_inverse=True)
    starts = np.concatenate([[0], np.cumsum(size)[:-1]])
    for p in (k for k in range(len(ids)) if stray[k]):
        both = np.add.reduceat(np.isin(values, sets[p], assume_unique=True).astype(np.int64)[flat], starts)
        hits = np.flatnonzero(100 * both >= PERCENT * (size + len(sets[p]) - both)).tolist()
        yield from {labels[members[k]]: (ids[p], ids[members[k]]) for k in hits if labels[members[k]] != labels[p]}.values()


def stray_links(large: DataFrame, belongs: DataFrame, sets: DataFrame) -> DataFrame:
    """``a, b``: links of the members of cut regions that are outside the region's largest class.

    A region's members and its strays are dealt into blocks of ``REGION``; every block of strays meets every block of members.
    """
    members = large.join(belongs.select(F.col("node").alias("id"), "component"), "id", "left").select("region", "id", F.coalesce("component", "id").alias("label"))
    sizes = members.groupBy("region", "label").agg(F.count("*").alias("n")).groupBy("region").agg(
        F.max_by("label", F.struct("n", "label")).alias("main"), F.sum("n").alias("n"), F.max("n").alias("in_main"))
    blocks = lambda n: F.ceil(n / REGION).cast("int")
    dealt = members.join(sizes.select("region", "main", blocks(F.col("n")).alias("rows"), blocks(F.col("n") - F.col("in_main")).alias("strays")), "region").where("strays > 0")
    block = lambda n: F.pmod(F.xxhash64("id"), n).cast("int")
    as_member = dealt.select("region", block(F.col("rows")).alias("r"), F.explode(F.sequence(F.lit(0), F.col("strays") - 1)).alias("s"), "id", "label", F.lit(False).alias("stray"))
    as_stray = dealt.where("label != main").select("region", F.explode(F.sequence(F.lit(0), F.col("rows") - 1)).alias("r"), block(F.col("strays")).alias("s"), "id", "label", F.lit(True).alias("stray"))
    cells = as_member.union(as_stray).join(sets, "id").select("region", "r", "s", "id", "label", "stray", "shingles")

    def run(batches):
        held, name = [], None

        def close():
            got = list(cell_links([r[3] for r in held], [r[4] for r in held], [r[5] for r in held], [np.frombuffer(r[6], np.uint64) for r in held]))
            return pa.RecordBatch.from_arrays([pa.array([g[k] for g in got], pa.int64()) for k in (0, 1)], ["a", "b"])

        for batch in batches:
            for row in zip(*(batch.column(k).to_pylist() for k in range(7))):
                if row[:3] != name:
                    yield close()
                    held, name = [], row[:3]
                held.append(row)
        yield close()

    return cells.repartition("region", "r", "s").sortWithinPartitions("region", "r", "s").mapInArrow(run, "a long, b long")


def classes(docs: DataFrame, width: int = 5, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` of every row: the class's smallest id, and whether the row is the one with it."""
    slim = docs.select(F.col(doc_id).cast("long").alias("id"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("text"))
    rows = durable(summaries(slim, width))
    nodes = rows.where("n > 0 AND id IS NOT NULL").groupBy("digest").agg(F.min("id").alias("id"), F.first("n").alias("n"), F.first("sig").alias("sig"))
    nodes = nodes.select("digest", "id", "n", "sig")
    found = durable(regions(nodes).distinct())
    sets = candidate_sets(found, slim, width)
    links = durable(confirm(found, sets))
    belongs = components(links)
    large = found.where(F.col("region").startswith(LARGE)).select("region", "id")
    if not large.isEmpty():
        more = durable(stray_links(large, belongs, sets))
        if not more.isEmpty():
            belongs = components(links.union(more))
    node_of = nodes.select("digest", F.col("id").alias("node"))
    named = node_of.join(belongs, "node", "left").select("digest", F.coalesce("component", "node").alias("class"))
    out = rows.drop("sig").join(named, "digest", "left").select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.coalesce("class", "id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def keep_one(docs: DataFrame, width: int = 5) -> DataFrame:
    """One document of each class of near-duplicates, with its columns as they are."""
    gone = classes(docs, width).where(~F.col("kept")).select(F.col("doc_id").alias("__gone")).distinct()
    return docs.join(gone, F.col("doc_id") == F.col("__gone"), "left_anti")
