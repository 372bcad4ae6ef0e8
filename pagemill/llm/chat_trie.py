"""Chat formatting as a prefix tree.

Conversations that begin with the same turns share them: in the stream of tokens a shared turn is written once, depth first. Every
node (a turn after its ancestors) has its place in the stream, its position ids, which go on from its parent's, and the intervals of
the stream that it attends to: its ancestors and itself. A token here is one code point of the formatted text.

The distinct conversations are sorted in ranges by the digests of their prefixes, so that a task writes a part of the tree in order
and needs only the last conversation before its own. For each range the driver holds the first and the last path, and adds up the
lengths; a tree larger than a range, such as that of a very common first turn, goes over many ranges and is still one tree.

A turn is ``<|im_start|>role`` + newline + text + ``<|im_end|>`` + newline. In roles and texts a backslash is doubled, and control
strings (of this and of common other templates) get a backslash after their first character; so reading back is exact and no text can
pass for a mark. Turns are ordered by ``turn``, then role and text, nulls first; null texts and roles count as empty. Conversations
that are equal share all nodes. Rows without a conversation id form one conversation with a null id.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagemill.session import durable

START, END = "<|im_start|>", "<|im_end|>"
CONTROL = (START, END, "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
LOSS_ROLE = "assistant"
KEY = 16
_control = re.compile("|".join(map(re.escape, CONTROL)))
_turn = re.compile(re.escape(START) + r"((?:\\.|[^\\\n])*)\n((?:\\.|[^\\])*?)" + re.escape(END) + r"\n", re.S)


def escape(text: str) -> str:
    return _control.sub(lambda m: m[0][0] + "\\" + m[0][1:], text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


def format_turn(role: str, text: str) -> tuple[str, int, int]:
    """The formatted turn, and where its loss mask begins and ends in it."""
    head = START + escape(role).replace("\n", "\\\n") + "\n"
    body = escape(text)
    whole = head + body + END + "\n"
    return (whole, len(head), len(head) + len(body)) if role == LOSS_ROLE else (whole, 0, 0)


def parse(formatted: str) -> list[tuple[str, str]]:
    """Roles and texts of a formatted conversation."""
    return [(unescape(m[1]), unescape(m[2])) for m in _turn.finditer(formatted)]


_segment = T.StructType([T.StructField("text", T.StringType()), T.StructField("loss_from", T.IntegerType()), T.StructField("loss_to", T.IntegerType())])
_segment_arrow = pa.struct([("text", pa.string()), ("loss_from", pa.int32()), ("loss_to", pa.int32())])


@F.arrow_udf(T.StructType([T.StructField("path", T.BinaryType()), T.StructField("segments", T.ArrayType(_segment))]))
def formatted(turns: pa.Array) -> pa.Array:
    """``path`` (the digests of all prefixes, end to end) and formatted turns of each conversation."""
    paths, segments = [], []
    for rows in turns.to_pylist():
        digest, path, own = b"", [], []
        for row in rows:
            text, a, b = format_turn(row["role"], row["text"])
            digest = hashlib.blake2b(digest + text.encode("utf-8"), digest_size=KEY).digest()
            path.append(digest)
            own.append({"text": text, "loss_from": a, "loss_to": b})
        paths.append(b"".join(path))
        segments.append(own)
    return pa.StructArray.from_arrays([pa.array(paths, pa.binary()), pa.array(segments, pa.list_(_segment_arrow))], ["path", "segments"])


def shared_turns(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b)) // KEY
    return next((k for k in range(n) if a[k * KEY:(k + 1) * KEY] != b[k * KEY:(k + 1) * KEY]), n)


def lay_out(rows, begin: int, inherited: list[int]):
    """Depth-first layout of sorted ``(path, segments)`` from the stream place ``begin`` on.

    ``inherited`` are the places of the first nodes of the first path that were written before. Yields ``(path, places, fresh, lengths)``;
    nodes from ``fresh`` on are new.
    """
    before, places = None, inherited
    for path, lengths in rows:
        fresh = len(inherited) if before is None else shared_turns(before, path)
        places = places[:fresh]
        for n in lengths[fresh:]:
            places.append(begin)
            begin += n
        yield path, list(places), fresh, lengths
        before = path


def merged_intervals(places: list[int], lengths: list[int]) -> list[tuple[int, int]]:
    """Stretches of the stream that the given nodes cover; neighbours become one."""
    out: list[tuple[int, int]] = []
    for a, n in zip(places, lengths):
        if out and out[-1][1] == a:
            out[-1] = (out[-1][0], a + n)
        else:
            out.append((a, a + n))
    return out


class Trie:
    """``nodes``: ``place, length, position, depth, text, loss_from, loss_to, attends`` in stream order. ``leaves``: ``path, places``
    for each distinct conversation. ``conversations``: ``conv_id, path``."""

    def __init__(self, nodes: DataFrame, leaves: DataFrame, conversations: DataFrame):
        self.nodes, self.leaves, self.conversations = nodes, leaves, conversations


def build(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> Trie:
    spark = turns.sparkSession
    slim = turns.select(F.col(conv_id).alias("conv_id"), F.struct(F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"),
                                                                  F.coalesce(F.col(text), F.lit("")).alias("text")).alias("row"))
    whole = slim.groupBy("conv_id").agg(F.sort_array(F.collect_list("row")).alias("rows")).select("conv_id", formatted("rows").alias("f"))
    whole = durable(whole.select("conv_id", "f.path", "f.segments"))
    distinct = whole.groupBy("path").agg(F.first("segments").alias("segments"))
    ordered = durable(distinct.repartitionByRange("path").sortWithinPartitions("path").withColumn("part", F.spark_partition_id()))

    def summary(batches):
        first = last = None
        places: list[int] = []
        total = part = 0

        def rows():
            nonlocal first, part
            for batch in batches:
                for path, lengths, p in zip(*(batch.column(k).to_pylist() for k in range(3))):
                    if first is None:
                        first, part = (path, lengths), p
                    yield path, lengths
        for path, places, fresh, lengths in lay_out(rows(), 0, []):
            last = path
            total += sum(lengths[fresh:])
        if first is not None:
            yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "first": pa.array([first[0]], pa.binary()), "lengths": pa.array([first[1]], pa.list_(pa.int64())),
                                              "last": pa.array([last], pa.binary()), "places": pa.array([places], pa.list_(pa.int64())), "total": pa.array([total], pa.int64())})

    lengths = F.transform("segments", lambda s: F.length(s["text"]).cast("bigint"))
    parts = ordered.select("path", lengths.alias("lengths"), "part").mapInArrow(summary, "part int, first binary, lengths array<long>, last binary, places array<long>, total long").orderBy("part").collect()
    begins, begin, last, stack = {}, 0, b"", []
    for r in parts:  # one row for each range
        common = shared_turns(last, bytes(r.first)) if last else 0
        again = sum(r.lengths[:common])
        inherited = stack[:common]
        begins[r.part] = (begin, inherited)
        kept = min(common, shared_turns(bytes(r.first), bytes(r.last)))
        stack = inherited[:kept] + [begin - again + p for p in r.places[kept:]]
        begin += r.total - again
        last = bytes(r.last)
    shared = spark.sparkContext.broadcast(begins)
    schema = pa.schema([("place", pa.int64()), ("length", pa.int64()), ("position", pa.int64()), ("depth", pa.int32()), ("text", pa.string()), ("loss_from", pa.int32()), ("loss_to", pa.int32()),
                        ("attends", pa.list_(pa.struct([("from", pa.int64()), ("to", pa.int64())]))), ("path", pa.binary()), ("places", pa.list_(pa.int64()))])

    def write(batches):
        held, begins_at = {}, None

        def rows():
            for batch in batches:
                for path, segments, part in zip(*(batch.column(k).to_pylist() for k in range(3))):
                    held["segments"], held["part"] = segments, part
                    yield path, [len(s["text"]) for s in segments]

        source = rows()
        head = next(source, None)
        if head is None:
            return
        begins_at = shared.value[held["part"]]

        def again():
            yield head
            yield from source

        out = []
        for path, places, fresh, sizes in lay_out(again(), begins_at[0], list(begins_at[1])):
            for k in range(fresh, len(places)):
                s = held["segments"][k]
                spans = [{"from": a, "to": b} for a, b in merged_intervals(places[:k + 1], sizes[:k + 1])]
                out.append((places[k], sizes[k], sum(sizes[:k]), k, s["text"], s["loss_from"], s["loss_to"], spans, None, None))
            out.append((None,) * 8 + (path, places))
            if len(out) > 5000:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)

    both = durable(ordered.select("path", "segments", "part").mapInArrow(write, "place long, length long, position long, depth int, text string, loss_from int, loss_to int, "
                                                                         "attends array<struct<from: long, to: long>>, path binary, places array<long>"))
    return Trie(both.where("place IS NOT NULL").drop("path", "places"), both.where("place IS NULL").select("path", "places"), whole.select("conv_id", "path"))


_read = T.StructType([T.StructField(n, t) for n, t in (("n_turns", T.LongType()), ("turns_sha256", T.StringType()), ("loss_chars", T.LongType()), ("loss_sha256", T.StringType()), ("formatted_chars", T.LongType()))])


@F.arrow_udf(_read)
def read_digest(nodes: pa.Array) -> pa.Array:
    """Digests of the turns and of the text under the loss mask, from a conversation's nodes in stream order."""
    out = []
    for rows in nodes.to_pylist():
        whole = "".join(r["text"] for r in rows)
        turns, loss = parse(whole), "".join(unescape(r["text"][r["loss_from"]:r["loss_to"]]) for r in rows)
        out.append({"n_turns": len(turns), "turns_sha256": hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode("utf-8")).hexdigest(),
                    "loss_chars": len(loss), "loss_sha256": hashlib.sha256(loss.encode("utf-8")).hexdigest(), "formatted_chars": len(whole)})
    return pa.array(out, pa.struct([("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())]))


def read_back(trie: Trie) -> DataFrame:
    """``conv_id`` and the digests of every conversation, read from the stream's nodes."""
    steps = trie.leaves.select("path", F.explode("places").alias("place")).join(trie.nodes.select("place", "text", "loss_from", "loss_to"), "place")
    rows = steps.groupBy("path").agg(F.sort_array(F.collect_list(F.struct("place", "text", "loss_from", "loss_to"))).alias("nodes"))
    read = rows.select("path", read_digest("nodes").alias("r")).select("path", "r.*")
    return trie.conversations.join(read, "path").drop("path")
