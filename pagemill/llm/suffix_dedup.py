"""Removal of repeated passages with suffix arrays built by external induced sorting.

A byte goes if it is covered by a string of ``length`` bytes that also starts at another place of any text. Such strings are found in
four steps, each of which keeps every true repeat:

1. Every window of ``length`` bytes is owned by the smallest hash among its short grams. Neighbouring windows with one smallest gram
   form a run. Equal windows have equal owners, so runs whose owner occurs once in the corpus are out.
2. Of the runs left, equal ones are added up before the shuffle.
3. Runs go to shards by owner, so all equal windows meet in one shard. Its suffixes are sorted by external induced sorting
   (``induced_sort``), and neighbours that agree in ``length`` bytes are repeats, as are runs that were added up. A run whose owner
   has no other run is not sorted: within a run every window has its smallest gram at another offset, so no two are equal.
4. The spans go back to the texts in which their runs occur.

Common-prefix values are not carried through induction but read off neighbours at the end, up to ``length`` bytes; the inner order of
valleys comes from rank doubling rather than from further inductions, as numpy moves whole batches and a large alphabet has none.

Bytes are those of UTF-8; null texts count as empty and lose nothing. Repeated rows count as different places. Texts that are equal
lose the same bytes. Rows keep their ids, null or not.
"""

from __future__ import annotations

import collections
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagemill.llm.common import KeyCounts
from pagemill.session import durable
from pagemill.llm.induced_sort import repeated_starts
from pagemill.llm.merges import forget

LENGTH = 200
SHARD_BYTES = 3 << 20
PIECE = 1 << 15
#: Texts with candidate runs that are picked by a broadcast of their hashes; beyond this number they are joined by shuffle.
BROADCAST_TEXTS = 2_000_000
HOT_SHARE = 10_000
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_PLACE = np.uint64((1 << 24) - 1)


def gram_hashes(raw: np.ndarray, length: int) -> tuple[np.ndarray, int]:
    """Hashes of all grams of a power of two, made by doubling, and their size."""
    size, h = 1, (raw.astype(np.uint64) + np.uint64(1)) * _A
    while size * 3 <= length and size < 64:
        longer = h[:-size] * _B
        longer += h[size:]
        longer *= _A
        longer ^= longer >> np.uint64(31)
        h, size = longer, size * 2
    return h, size


def sliding(x: np.ndarray, width: int, op) -> np.ndarray:
    """Running minimum or maximum, from those of widths that double."""
    size, out, n = 1, x, len(x) - width + 1
    while size * 2 <= width:
        out = op(out[:-size], out[size:])
        size *= 2
    return op(out[:n], out[width - size:width - size + n])


def windows(raw: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """For each window start: the place of its smallest gram (the last of equal ones), and the hash of that gram."""
    h, size = gram_hashes(raw, length)
    place = _PLACE - np.arange(len(h), dtype=np.uint64)
    low = sliding((h & ~_PLACE) | place, length - size + 1, np.minimum)
    low = (_PLACE - (low & _PLACE)).astype(np.int64)
    return low, h[low]


def pieces(texts: list[bytes], length: int):
    """``(raw, text number, offset in text, valid)`` of texts laid end to end in groups of bounded size; long texts overlap themselves."""
    group, size = [], 0
    for k, text in enumerate(texts):
        for at in range(0, max(1, len(text) - length + 1), PIECE):
            part = text[at:at + PIECE + length - 1]
            if len(part) >= length:
                group.append((k, at, part))
                size += len(part)
            if size >= PIECE:
                yield _joined(group, length)
                group, size = [], 0
    if group:
        yield _joined(group, length)


def _joined(group, length):
    raw = np.frombuffer(b"".join(g[2] for g in group), np.uint8)
    sizes = np.array([len(g[2]) for g in group])
    ends = np.cumsum(sizes)
    number = np.repeat(np.array([g[0] for g in group], np.int32), sizes)
    place = np.arange(len(raw), dtype=np.int32)
    offset = place - np.repeat((ends - sizes - [g[1] for g in group]).astype(np.int32), sizes)
    n = len(raw) - length + 1
    valid = place[:n] <= np.repeat((ends - length).astype(np.int32), sizes)[:n]
    return raw, number, offset, valid


def runs_of(change: np.ndarray, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last index of the stretches of ``keep`` between changes, which are told of each index but the first."""
    first, last = keep.copy(), keep.copy()
    first[1:] &= change | ~keep[:-1]
    last[:-1] &= change | ~keep[1:]
    return np.flatnonzero(first), np.flatnonzero(last)


def owned_runs(texts: list[bytes], length: int):
    """``(text numbers, firsts, lasts, owners)`` of the runs of windows with one smallest gram."""
    for raw, number, offset, valid in pieces(texts, length):
        low, owner = windows(raw, length)
        change = (low[1:] != low[:-1]) | (number[1:len(low)] != number[:len(low) - 1])
        first, last = runs_of(change, valid)
        yield number[first], offset[first], offset[last], owner[first].astype(np.int64)


def _seen(seen: set, digest: bytes) -> bool:
    if digest in seen:
        return True
    if len(seen) > 200_000:
        seen.clear()
    seen.add(digest)
    return False


def repeated_runs(texts: DataFrame, length: int) -> DataFrame:
    """``id, firsts``: for each text (by its hash), the starts of the runs whose owner occurs more than once."""
    def keys(batches):
        forget()
        counts = KeyCounts()
        for batch in batches:
            for *_, owner in owned_runs(batch.column(1).to_pylist(), length):
                for out in counts.add(owner):
                    yield pa.RecordBatch.from_arrays([pa.array(o) for o in out], ["key", "n"])
        for out in counts.rest():
            yield pa.RecordBatch.from_arrays([pa.array(o) for o in out], ["key", "n"])

    def places(batches):
        seen: set[int] = set()
        for batch in batches:
            rows = [(i, t) for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) if not _seen(seen, i)]
            ids = np.array([i for i, _ in rows], np.int64)
            for number, first, _, owner in owned_runs([t for _, t in rows], length):
                yield pa.RecordBatch.from_arrays([pa.array(owner), pa.array(ids[number]), pa.array(first.astype(np.int32))], ["key", "id", "first"])

    slim = texts.select("id", "text")
    repeated = durable(slim.mapInArrow(keys, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).where("n > 1"))
    # Places of a key that holds more than one in HOT_SHARE of all (there are fewer than HOT_SHARE such keys) are dealt over many tasks.
    deals = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    total = repeated.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    hot = repeated.where(F.col("n") > max(total // HOT_SHARE, 1_000)).select("key", F.lit(True).alias("hot"))
    dealt = repeated.select("key").join(F.broadcast(hot), "key", "left").select(
        "key", F.explode(F.when(F.col("hot"), F.sequence(F.lit(0), F.lit(deals - 1))).otherwise(F.array(F.lit(0)))).alias("deal"))
    found = slim.mapInArrow(places, "key long, id long, first int").join(F.broadcast(hot), "key", "left").withColumn(
        "deal", F.when(F.col("hot"), F.pmod(F.xxhash64("id", "first"), F.lit(deals)).cast("int")).otherwise(F.lit(0)))
    return found.join(dealt, ["key", "deal"], "left_semi").groupBy("id").agg(F.collect_set("first").alias("firsts"))


def _wanted_runs(batch, length: int):
    """``(digest of text, owner, first, body)`` of the candidate runs of a batch of ``md5, text, firsts``."""
    md5s, texts, wanted = (batch.column(k).to_pylist() for k in range(3))
    wanted = [set(w) for w in wanted]
    for numbers, firsts, lasts, owners in owned_runs(texts, length):
        for k, a, b, owner in zip(numbers.tolist(), firsts.tolist(), lasts.tolist(), owners.tolist()):
            if a in wanted[k]:
                yield md5s[k], owner, a, texts[k][a:b + length]


def _digest(body: bytes) -> bytes:
    return hashlib.blake2b(body, digest_size=16).digest()


def run_bodies(joined: DataFrame, length: int) -> DataFrame:
    """``owner, digest, body, n``: candidate runs, equal ones of a task added up."""
    def run(batches):
        bodies: dict[bytes, list] = {}
        size = 0

        def flush():
            return pa.RecordBatch.from_arrays([pa.array([v[0] for v in bodies.values()], pa.int64()), pa.array(bodies.keys(), pa.binary()), pa.array([v[1] for v in bodies.values()], pa.binary()),
                                               pa.array([v[2] for v in bodies.values()], pa.int64())], ["owner", "digest", "body", "n"])

        for batch in batches:
            for _, owner, _, body in _wanted_runs(batch, length):
                digest = _digest(body)
                held = bodies.get(digest)
                if held is None:
                    bodies[digest] = [owner, body, 1]
                    size += len(body) + 200
                    if size > 24 << 20:
                        yield flush()
                        bodies, size = {}, 0
                else:
                    held[2] += 1
        if bodies:
            yield flush()

    return joined.mapInArrow(run, "owner long, digest binary, body binary, n long")


def run_places(joined: DataFrame, length: int) -> DataFrame:
    """``digest, md5, first``: where in a text a candidate run begins; once for each distinct text of a task."""
    def run(batches):
        seen: set[bytes] = set()
        for batch in batches:
            fresh = [not _seen(seen, d) for d in batch.column(0).to_pylist()]
            rows = [(_digest(body), md5, first) for md5, _, first, body in _wanted_runs(batch.filter(pa.array(fresh, pa.bool_())), length)]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate((pa.binary(), pa.binary(), pa.int32()))], ["digest", "md5", "first"])

    return joined.mapInArrow(run, "digest binary, md5 binary, first int")


def merged_spans(starts: np.ndarray, length: int) -> np.ndarray:
    """Ends of the stretches that strings of ``length`` at ``starts`` cover, as rows of two."""
    if not len(starts):
        return np.zeros((0, 2), np.int32)
    cut = np.diff(starts) > length
    return np.stack([starts[np.append(True, cut)], starts[np.append(cut, True)] + length], axis=1).astype(np.int32)


def spans_of(held: dict[bytes, list], length: int):
    """``digest, starts`` of the repeats in the bodies of a shard, given by digest as body, owner and number."""
    runs = collections.Counter(owner for _, owner, _ in held.values())
    several = {d: body for d, (body, owner, _) in held.items() if runs[owner] > 1}
    found = dict(zip(several, repeated_starts(list(several.values()), length)))
    none = np.zeros(0, np.int64)
    for d, (body, _, n) in held.items():
        yield d, np.arange(len(body) - length + 1) if n > 1 else found.get(d, none)


def shard_spans(bodies: DataFrame, length: int, shards: int) -> DataFrame:
    """``digest, spans`` of the run bodies that hold repeats; one suffix order for each shard."""
    def run(batches):
        forget()
        held: dict[bytes, list] = {}
        for batch in batches:
            for digest, body, n, owner in zip(*(batch.column(k).to_pylist() for k in range(4))):
                held.setdefault(digest, [body, owner, 0])[2] += n
        out = [(d, merged_spans(starts, length).tobytes()) for d, starts in spans_of(held, length)]
        out = [x for x in out if x[1]]
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.binary()) for k in (0, 1)], ["digest", "spans"])

    return bodies.select("digest", "body", "n", "owner").repartition(shards, "owner").mapInArrow(run, "digest binary, spans binary")


def repeats(texts: DataFrame, length: int = LENGTH, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """``md5, found`` of the texts (``id, md5, text``) that hold repeats: where runs lie in a text, and the spans within them."""
    runs = durable(repeated_runs(texts, length))
    n_texts, n_runs = runs.agg(F.count("*"), F.coalesce(F.sum(F.size("firsts")), F.lit(0))).first()
    candidates = texts.join(F.broadcast(runs.select("id")), "id", "left_semi") if n_texts <= BROADCAST_TEXTS else texts
    # Both passes read the same exchange of the candidates' texts; storing the bodies would take more room than cutting them again.
    joined = candidates.join(runs, "id").select("md5", "text", "firsts")
    shards = max(n_runs * 3 * length // 2 // shard_bytes + 1, int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    spans = shard_spans(run_bodies(joined, length), length, shards)
    places = run_places(joined, length).distinct()
    return durable(places.join(spans, "digest").groupBy("md5").agg(F.collect_list(F.struct("first", "spans")).alias("found")))


CUT = T.StructType([T.StructField("kept", T.BinaryType()), T.StructField("n_removed", T.LongType()), T.StructField("n_spans", T.LongType())])


def _cut(texts: pa.Array, found: pa.Array, characters: bool) -> pa.Array:
    """A text without the bytes that are covered, their number, and the number of stretches removed."""
    forget()
    kept, removed, stretches = [], [], []
    for text, rows in zip(texts.to_pylist(), found.to_pylist()):
        cover = np.zeros(len(text) + 1, np.int64)
        for row in rows or ():
            ends = np.frombuffer(row["spans"], np.int32).reshape(-1, 2) + row["first"]
            np.add.at(cover, ends[:, 0], 1)
            np.add.at(cover, ends[:, 1], -1)
        gone = np.cumsum(cover)[:-1] > 0
        rest = np.frombuffer(text, np.uint8)[~gone].tobytes() if gone.any() else text
        kept.append(rest.decode("utf-8", "ignore").encode() if characters and gone.any() else rest)
        removed.append(int(gone.sum()))
        stretches.append(int((np.diff(gone.astype(np.int8), prepend=0) == 1).sum()))
    return pa.StructArray.from_arrays([pa.array(kept, pa.binary()), pa.array(removed, pa.int64()), pa.array(stretches, pa.int64())], ["kept", "n_removed", "n_spans"])


@F.arrow_udf(CUT)
def cut_out(texts: pa.Array, found: pa.Array) -> pa.Array:
    return _cut(texts, found, False)


@F.arrow_udf(CUT)
def cut_out_characters(texts: pa.Array, found: pa.Array) -> pa.Array:
    return _cut(texts, found, True)


def remove_repeats(docs: DataFrame, text: str = "text", length: int = LENGTH, shard_bytes: int = SHARD_BYTES, characters: bool = False) -> DataFrame:
    """``docs`` with a struct column ``__cut``: ``kept`` (bytes), ``n_removed``, ``n_spans``.

    With ``characters``, ``kept`` lacks the rest of a character that a cut splits, too; the counts are those of the bytes covered.
    """
    udf = cut_out_characters if characters else cut_out
    body = F.coalesce(F.col(text), F.lit("")).cast("binary")
    texts = docs.select(F.xxhash64(body).alias("id"), F.unhex(F.md5(body)).alias("md5"), body.alias("text"))
    found = repeats(texts, length, shard_bytes).select(F.col("md5").alias("__md5"), F.col("found").alias("__found"))
    keyed = docs.withColumn("__key", F.unhex(F.md5(body)))
    same = F.col("__key") == F.col("__md5")
    cut = lambda df: df.withColumn("__cut", udf(body, F.col("__found"))).drop("__key", "__md5", "__found")
    whole = F.struct(body.alias("kept"), F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"))
    if found.count() > BROADCAST_TEXTS:
        return cut(keyed.join(found, same, "left"))
    # Only the texts that lose something are shuffled and cut.
    some = F.broadcast(found.select("__md5"))
    untouched = keyed.join(some, same, "left_anti").drop("__key").withColumn("__cut", whole)
    return cut(keyed.join(some, same, "left_semi").join(found, same)).select(untouched.columns).unionAll(untouched)


def cut_texts(docs: DataFrame, **options: int) -> DataFrame:
    """``docs`` with repeats removed from ``text``; a character that a cut splits goes as a whole, ``n_chars`` follows the text."""
    # Cut and whole characters in one step: a second Python function in the stage would be a second worker for every task, and workers stay.
    cut = remove_repeats(docs, characters=True, **options)
    text = F.when(F.col("__cut.n_removed") > 0, F.col("__cut.kept").cast("string")).otherwise(F.col("text"))
    out = cut.withColumn("text", text).drop("__cut")
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(docs.columns)
