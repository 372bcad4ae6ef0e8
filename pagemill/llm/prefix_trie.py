"""Statistics of the prefix trie of conversations, on double arrays.

A conversation is the sequence of its turns; every distinct beginning of ``d`` turns is a node of depth ``d``, from the root without
turns. Turns travel as 16-byte digests of role and text with the length of the text, so texts are neither shuffled nor kept.

Conversations are sorted by path into ranges, cut by the first ``RANGE_TURNS`` turns and then by id, so that a first turn or a whole
conversation that a third of all rows share goes over many ranges. A task packs the paths of at most ``TURNS`` turns into a shard: turns
get dense ids, a BASE and a CHECK array hold the trie, and walking the paths through it gives the nodes. Nodes below the first and the
last path of a shard may go on in its neighbours: these few upper nodes are left open, added up over all shards by their digest, and
their subtrees are summed in as many rounds as the logarithm of their depth. All other nodes are finished in their shard.

Turns are ordered by ``turn``, nulls first, then by role and by the digest of the text; null roles and texts count as empty. Repeated
rows are repeated turns. Equal conversations share all nodes. Rows without a conversation id belong to no conversation and are left
out. An empty table has no nodes. Other columns, whatever their names, are not read. One conversation is one value, as one text is.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagemill.session import durable

KEY = 16
RANGE_TURNS = 8
TURNS = 200_000
NO_ENDS = hashlib.sha256(b"").hexdigest()


class DoubleArray:
    """A trie over dense codes: the child of state ``s`` by code ``c`` is ``base[s] + c``, if ``check`` there names ``s``. The root is state 0."""

    WINDOW, WIDE = 512, 64

    def __init__(self):
        self.base, self.check = np.zeros(1024, np.int64), np.full(1024, -1, np.int64)
        self.check[0] = 0
        self.top, self.low = 1, 1

    def _room(self, size: int) -> None:
        while len(self.check) < size:
            self.base = np.concatenate([self.base, np.zeros(len(self.base), np.int64)])
            self.check = np.concatenate([self.check, np.full(len(self.check), -1, np.int64)])

    def _fit(self, steps: np.ndarray) -> int:
        """A slot from which the given steps all lead to free slots: among the first holes, else behind everything."""
        if len(steps) <= self.WIDE:
            self._room(self.low + self.WINDOW + int(steps[-1]) + 1)
            holes = np.flatnonzero(self.check[self.low:self.low + self.WINDOW] < 0) + self.low
            fits = (self.check[holes[:, None] + steps] < 0).all(axis=1)
            if fits.any():
                return int(holes[fits.argmax()])
        return self.top

    def add(self, parents: np.ndarray, codes: np.ndarray) -> None:
        """New children, sorted by parent and code: families first, then the single ones into the holes."""
        starts = np.flatnonzero(np.r_[True, parents[1:] != parents[:-1]])
        sizes = np.diff(np.r_[starts, len(parents)])
        for a, n in zip(starts[sizes > 1].tolist(), sizes[sizes > 1].tolist()):
            own = codes[a:a + n]
            slot = self._fit(own - own[0])
            slots = slot + own - own[0]
            self._room(int(slots[-1]) + 1)
            self.base[parents[a]] = slot - own[0]
            self.check[slots] = parents[a]
            self.top = max(self.top, int(slots[-1]) + 1)
        lone = starts[sizes == 1]
        if len(lone):
            holes = np.flatnonzero(self.check[self.low:self.top] < 0)[:len(lone)] + self.low
            slots = np.concatenate([holes, np.arange(self.top, self.top + len(lone) - len(holes))])
            self._room(int(slots[-1]) + 1)
            self.base[parents[lone]] = slots - codes[lone]
            self.check[slots] = parents[lone]
            self.top, self.low = max(self.top, int(slots[-1]) + 1), int(slots[-1]) + 1 if len(holes) < len(lone) else self.low

    def step(self, states: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """The states reached, -1 where there is none."""
        to = self.base[states] + codes
        inside = (to > 0) & (to < self.top)
        return np.where(inside & (self.check[np.where(inside, to, 0)] == states), to, -1)


def packed(paths: list[np.ndarray]) -> DoubleArray:
    """The double array of all given code sequences, built level by level."""
    trie = DoubleArray()
    order = sorted(range(len(paths)), key=lambda k: -len(paths[k]))
    lengths = np.array([len(paths[k]) for k in order], np.int64)
    flat = np.concatenate([paths[k] for k in order] or [np.zeros(0, np.int64)])
    begins = np.cumsum(lengths) - lengths
    states = np.zeros(len(order), np.int64)
    for depth in range(int(lengths[0]) if len(lengths) else 0):
        n = int(np.searchsorted(-lengths, -depth))  # those longer than depth
        codes = flat[begins[:n] + depth]
        by = np.lexsort((codes, states[:n]))
        s, c = states[:n][by], codes[by]
        new = np.r_[True, (s[1:] != s[:-1]) | (c[1:] != c[:-1])]
        trie.add(s[new], c[new])
        states[:n] = trie.step(states[:n], codes)
    return trie


class Shard:
    """The nodes of a run of sorted paths, from a walk over their double array."""

    def __init__(self, ids: list[int], paths: list[bytes], sizes: list[list[int]]):
        heads = [k for k in range(len(paths)) if k == 0 or paths[k] != paths[k - 1]]
        ends = heads[1:] + [len(paths)]
        names: dict[bytes, int] = {}
        coded = [np.array([names.setdefault(p[j:j + KEY], len(names)) for j in range(0, len(p), KEY)], np.int64) for p in (paths[k] for k in heads)]
        self.digests = list(names)
        self.trie = packed(coded)
        top = self.trie.top
        self.depth, self.n_convs, self.n_bytes = np.full(top, -1, np.int64), np.zeros(top, np.int64), np.zeros(top, np.int64)
        self.first = np.full(top, np.iinfo(np.int64).max, np.int64)
        self.levels: list[np.ndarray] = []
        self.members: dict[int, list[int]] = {}
        self._walk(coded, heads, ends, ids, sizes)
        self.open = np.zeros(top, bool)
        for path in (coded[0], coded[-1]):
            self._leave_open(path[:RANGE_TURNS])
        self._sum()

    def _walk(self, coded, heads, ends, ids, sizes) -> None:
        order = sorted(range(len(coded)), key=lambda k: -len(coded[k]))
        lengths = np.array([len(coded[k]) for k in order], np.int64)
        flat, widths = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in ([coded[k] for k in order], [np.array(sizes[heads[k]], np.int64) for k in order]))
        begins = np.cumsum(lengths) - lengths
        copies = np.array([ends[k] - heads[k] for k in order], np.int64)
        least = np.array([min(ids[heads[k]:ends[k]]) for k in order], np.int64)
        states = np.zeros(len(order), np.int64)
        for depth in range(int(lengths[0]) + 1):
            n = int(np.searchsorted(-lengths, -depth, "right"))  # those of at least depth turns
            if depth:
                at = begins[:n] + depth - 1
                states[:n] = self.trie.step(states[:n], flat[at])
                self.n_bytes[states[:n]] = widths[at]
            np.add.at(self.n_convs, states[:n], copies[:n])
            np.minimum.at(self.first, states[:n], least[:n])
            self.depth[states[:n]] = depth
            self.levels.append(np.unique(states[:n]))
        for k, s in zip(order, states.tolist()):
            self.members[s] = sorted(ids[heads[k]:ends[k]])

    def _leave_open(self, path: np.ndarray) -> None:
        state = np.zeros(1, np.int64)
        self.open[0] = True
        for code in path:
            state = self.trie.step(state, np.array([code]))
            self.open[state] = True
        if len(path) == RANGE_TURNS:
            for level in self.levels[RANGE_TURNS + 1:]:
                self.open[level] |= self.open[self.trie.check[level]]

    def _sum(self) -> None:
        """Subtree sums; an open node holds those of its finished children only."""
        top = self.trie.top
        self.children, self.leaves, self.saved = (np.zeros(top, np.int64) for _ in range(3))
        for level in reversed(self.levels):
            done = level[~self.open[level]]
            self.leaves[done] += self.children[done] == 0
            self.saved[done] += (self.n_convs[done] - 1) * self.n_bytes[done]
            if len(done):
                above = self.trie.check[done]
                for total, own in ((self.children, 1), (self.leaves, self.leaves[done]), (self.saved, self.saved[done])):
                    np.add.at(total, above, own)

    def keys(self) -> dict[int, bytes]:
        """Digests of the open nodes."""
        keys = {0: b""}
        for level in self.levels[1:]:
            for s in level[self.open[level]].tolist():
                up = int(self.trie.check[s])
                keys[s] = hashlib.blake2b(keys[up] + self.digests[s - int(self.trie.base[up])], digest_size=KEY).digest()
        return keys

    def rows(self, shard: int) -> pa.RecordBatch:
        nodes = np.concatenate(self.levels)
        up, opened, keys = self.trie.check[nodes], self.open[nodes], self.keys()
        above_open = self.open[up] & (nodes != 0)
        ends = []
        for s, o in zip(nodes.tolist(), opened.tolist()):
            text = ",".join(map(str, self.members[s])) if s in self.members else None
            ends.append(text if o else NO_ENDS if text is None else hashlib.sha256(text.encode()).hexdigest())
        return pa.RecordBatch.from_pydict({
            "shard": np.full(len(nodes), shard, np.int64), "open": opened,
            "key": pa.array([keys[s] if o else None for s, o in zip(nodes.tolist(), opened.tolist())], pa.binary()),
            "parent_key": pa.array([keys[p] if a else None for p, a in zip(up.tolist(), above_open.tolist())], pa.binary()),
            "conv_id": self.first[nodes], "depth": self.depth[nodes],
            "parent_conv_id": pa.array(self.first[up], mask=self.open[up]),
            "n_convs": self.n_convs[nodes], "n_children": self.children[nodes], "n_leaves": self.leaves[nodes],
            "saved_tokens": self.saved[nodes], "n_bytes": self.n_bytes[nodes], "ends": pa.array(ends, pa.string())})


SCHEMA = ("shard long, open boolean, key binary, parent_key binary, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, "
          "n_leaves long, saved_tokens long, n_bytes long, ends string")


def sequences(turns: DataFrame, family: Column | None = None, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``conv_id, family, turns`` with the ordered turns (``turn, role, digest, n_bytes``) of every conversation; families lie together."""
    who, what = F.coalesce(F.col(role), F.lit("")), F.coalesce(F.col(text), F.lit(""))
    digest = F.unhex(F.md5(F.concat(F.octet_length(who).cast("string"), F.lit(":"), who, what).cast("binary")))
    row = F.struct(F.col(turn).alias("turn"), who.alias("role"), digest.alias("digest"), F.octet_length(what).cast("bigint").alias("n_bytes"))
    slim = turns.where(F.col(conv_id).isNotNull()).select(F.col(conv_id).cast("bigint").alias("conv_id"), row.alias("row"))
    slim = slim.withColumn("family", F.col("conv_id") if family is None else family)
    return slim.repartition("family").groupBy("family", "conv_id").agg(F.sort_array(F.collect_list("row")).alias("turns"))


def borrowed_beginnings(turns: DataFrame, group: int = 5, longest: int = 8) -> DataFrame:
    """Conversations with other beginnings: the first ``h`` turns come from the first id of their group of ``group`` ids, the rest is their own.

    ``h`` is the CRC of the decimal id modulo ``longest + 1``. The first turns of one conversation meet those of its few companions only.
    """
    found = sequences(turns, F.col("conv_id") - F.col("conv_id") % group)
    lender = F.first(F.when(F.col("conv_id") == F.col("family"), F.slice("turns", 1, longest)), ignorenulls=True).over(Window.partitionBy("family"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % (longest + 1)).cast("int")
    lent = found.withColumn("lent", lender).withColumn("h", h)
    kept = F.concat(F.coalesce(F.slice("lent", F.lit(1), F.col("h")), F.slice("turns", 1, 0)),
                    F.slice("turns", F.col("h") + 1, F.greatest(F.size("turns") - F.col("h"), F.lit(0))))
    return lent.select("conv_id", "family", kept.alias("turns"))


def shards(sequences_: DataFrame) -> DataFrame:
    """Nodes of all shards, finished or open, by range of paths."""
    path = F.unhex(F.array_join(F.transform("turns", lambda t: F.hex(t["digest"])), ""))
    rows = sequences_.select("conv_id", path.alias("path"), F.col("turns.n_bytes").alias("sizes")).withColumn("head", F.substring("path", 1, RANGE_TURNS * KEY))

    def run(batches):
        task, n = TaskContext.get().partitionId() << 32, 0
        ids, paths, sizes, held = [], [], [], 0
        for batch in batches:
            for i, p, s in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "path", "sizes"))):
                ids.append(i), paths.append(p), sizes.append(s)
                held += len(s) + 1
                if held >= TURNS:
                    yield Shard(ids, paths, sizes).rows(task + n)
                    ids, paths, sizes, held, n = [], [], [], 0, n + 1
        if ids:
            yield Shard(ids, paths, sizes).rows(task + n)

    return rows.repartitionByRange("head", "conv_id").sortWithinPartitions("head", "path", "conv_id").select("conv_id", "path", "sizes").mapInArrow(run, SCHEMA)


def digests_of_runs(runs: DataFrame) -> DataFrame:
    """``key, ends_sha256`` from comma-joined runs of ids (``key, begin, ends``); runs follow each other by ``begin`` and stream through the hash."""
    def run(batches):
        key = sha = None
        for batch in batches:
            keys, digests = [], []
            for k, _, text in zip(*(batch.column(j).to_pylist() for j in range(3))):
                if k != key:
                    if sha is not None:
                        keys.append(key), digests.append(sha.hexdigest())
                    key, sha = k, hashlib.sha256()
                else:
                    sha.update(b",")
                sha.update(text.encode())
            yield pa.RecordBatch.from_pydict({"key": pa.array(keys, pa.binary()), "ends_sha256": pa.array(digests, pa.string())})
        if sha is not None:
            yield pa.RecordBatch.from_pydict({"key": pa.array([key], pa.binary()), "ends_sha256": pa.array([sha.hexdigest()], pa.string())})

    return runs.select("key", "begin", "ends").repartition("key").sortWithinPartitions("key", "begin").mapInArrow(run, "key binary, ends_sha256 string")


def subtree_sums(nodes: DataFrame) -> DataFrame:
    """``key, n_leaves, saved_tokens`` summed over the subtree of every node of ``nodes`` (``key, up, n_leaves, saved_tokens``).

    Every round doubles the distance: a node takes in the sums of those whose pointer has reached it, and pointers jump on.
    """
    nodes = durable(nodes)
    while not nodes.where("up IS NOT NULL").isEmpty():
        sent = nodes.where("up IS NOT NULL").groupBy(F.col("up").alias("key")).agg(F.sum("n_leaves").alias("more_leaves"), F.sum("saved_tokens").alias("more_saved"))
        jump = nodes.select(F.col("key").alias("up"), F.col("up").alias("next"))
        nodes = durable(nodes.join(sent, "key", "left").join(jump, "up", "left").select(
            "key", F.col("next").alias("up"), (F.col("n_leaves") + F.coalesce("more_leaves", F.lit(0))).alias("n_leaves"),
            (F.col("saved_tokens") + F.coalesce("more_saved", F.lit(0))).alias("saved_tokens")))
    return nodes.select("key", "n_leaves", "saved_tokens")


def trie_nodes(sequences_: DataFrame) -> DataFrame:
    """``conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256`` of every node of the trie.

    ``conv_id`` is the smallest member, so it names the node together with ``depth``. See the module for the meaning of odd rows.
    """
    rows = durable(shards(sequences_))
    parts = rows.where("open")
    merged = parts.groupBy("key").agg(
        F.max("parent_key").alias("parent_key"), F.min("conv_id").alias("conv_id"), F.max("depth").alias("depth"), F.max("n_bytes").alias("n_bytes"),
        *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")])
    merged = durable(merged)
    below = merged.where("parent_key IS NOT NULL").groupBy(F.col("parent_key").alias("key")).agg(F.count("*").alias("n_open"))
    nodes = merged.join(below, "key", "left").withColumn("n_children", F.col("n_children") + F.coalesce("n_open", F.lit(0))).drop("n_open")
    own = nodes.select("key", F.col("parent_key").alias("up"), (F.col("n_leaves") + (F.col("n_children") == 0).cast("bigint")).alias("n_leaves"),
                       (F.col("saved_tokens") + (F.col("n_convs") - 1) * F.col("n_bytes")).alias("saved_tokens"))
    digests = digests_of_runs(parts.where("ends IS NOT NULL").withColumn("begin", F.substring_index("ends", ",", 1).cast("bigint")))
    names = merged.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("parent_conv_id"))
    upper = nodes.drop("n_leaves", "saved_tokens").join(subtree_sums(own), "key").join(digests, "key", "left").join(names, "parent_key", "left")
    upper = upper.withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(NO_ENDS)))
    # A finished node below an open one gets the name of its parent by way of its shard, so no key holds more rows than a shard.
    by_shard = parts.select("shard", F.col("key").alias("parent_key")).join(names, "parent_key")
    done = rows.where("NOT open").withColumnRenamed("ends", "ends_sha256")
    hung = done.where("parent_key IS NOT NULL").drop("parent_conv_id").join(by_shard, ["shard", "parent_key"])
    out = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return done.where("parent_key IS NULL").select(out).union(hung.select(out)).union(upper.select(out))
