"""Language-model scores from a weighted backoff automaton.

Counts cover all training documents and every word, pair and triple, however rare. A word whose count exceeds 1 in ``WORD_SHARE``
of all tokens is common (there can be no more than ``WORD_SHARE`` of those, whatever the data): it has a number that every
executor knows, other words go by a 63-bit hash.

A state is a context of up to two words. An arc carries the interpolated log-probability of its word; what the discounts of a state
leave over is the weight of its failure arc, which leads to the shorter context. With absolute discounts the probabilities of
all words, one place for unknown words included, sum to one at every state.

All arcs of a corpus fit nowhere, so texts are cut into chunks of a fixed number of places, and each chunk gets the arcs that its
words can take:

1. A chunk sends its distinct pairs and triples, with their training counts, as packed blocks to the owners of the pairs.
2. An owner adds up the counts of all chunks and returns, in the order of each block, the count of each pair, the number of
   different words that follow it, and the count of each triple.
3. The chunk builds states, arcs and failure arcs from that, and walks its texts. The state behind two words is the same by whatever
   arcs they are read, so it is looked up for all places at once, and all places take their arcs and failure arcs together.

A pair of two very frequent words is split among several owners by its third word; the numbers of following words add up. A text
longer than a chunk goes on in the next one with its last two words as context.

Null texts count as empty: one end token. Rows that repeat are kept, each with its own result; a null id is kept too. Without
training documents every token is unknown and every base probability is 1. Chunks are named by partition and place, so the rows of
a partition must come in the same order if it is computed again, as those of files do.
"""

from __future__ import annotations

import array
import collections
import itertools
from collections.abc import Iterable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.llm.common import remainder, words
from pagemill.session import durable

WORD_SHARE = 1_000_000
#: Places of a chunk.
CHUNK = 1 << 18
#: Training places of an owner, on average.
OWNED = 1 << 20
#: A pair whose words both hold more than 1 in SPLIT_SHARE of all places has several owners.
SPLIT_SHARE = 2_000
DISCOUNT = 0.75
#: The end of a text as a word; no word is empty.
END = b""
#: Bits of a word's place among the words of a chunk.
BITS = 21
LOW = (1 << BITS) - 1
REPLY, SEQUENCE, FOLLOW, WORD, RARE = range(5)


def count_words(texts: DataFrame) -> DataFrame:
    """``word, n`` of all words and ends; each task adds up its own words before the shuffle."""
    def run(batches):
        counts, ends = collections.Counter(), 0
        for batch in batches:
            for text in batch.column(0).to_pylist():
                counts.update(words(text))
                ends += 1
                if len(counts) > 250_000:
                    yield pa.RecordBatch.from_pydict({"word": pa.array(counts.keys(), pa.binary()), "n": pa.array(counts.values(), pa.int64())})
                    counts = collections.Counter()
        if ends:
            counts[END] = ends
        yield pa.RecordBatch.from_pydict({"word": pa.array(counts.keys(), pa.binary()), "n": pa.array(counts.values(), pa.int64())})

    return texts.mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


class Vocabulary:
    """Common words with numbers from 1 on, the most frequent first, and their counts."""

    def __init__(self, common: list[bytes], counts: list[int], total: int, distinct: int):
        self.total, self.distinct = total, distinct
        self.counts = np.array([0, *counts], np.int64)
        self.number = {w: i for i, w in enumerate(common, 1)}

    def keys(self, words: Iterable[bytes]) -> np.ndarray:
        """The numbers of common words, negative 63-bit hashes (SipHash) of all others."""
        words = list(words)
        keys = np.fromiter(map(self.number.get, words, itertools.repeat(0)), np.int64, len(words))
        rare = np.flatnonzero(keys == 0)
        bodies = np.empty(len(rare), object)
        bodies[:] = [words[i] for i in rare.tolist()]
        keys[rare] = -1 - (pd.util.hash_array(bodies, categorize=False) >> np.uint64(1)).astype(np.int64)
        return keys

    def count(self, keys: np.ndarray) -> np.ndarray:
        """Counts of common words; 0 for others."""
        return self.counts[np.maximum(keys, 0)]


class Model:
    """The word counts of the training texts as a table and the vocabulary that the executors share."""

    def __init__(self, counts: DataFrame, vocabulary: Vocabulary):
        self.counts, self.vocabulary = counts, vocabulary
        self.shared = counts.sparkSession.sparkContext.broadcast(vocabulary)


def train(texts: DataFrame, word_share: int = WORD_SHARE) -> Model:
    """Count the words of all rows of ``texts`` (one binary column)."""
    counts = durable(count_words(texts))
    total, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    common = counts.where((F.col("n") * word_share > total) | (F.length("word") == 0)).toPandas().sort_values(["n", "word"], ascending=False)
    return Model(counts, Vocabulary([bytes(w) for w in common["word"]], common["n"].tolist(), total, distinct))


def pack(*columns: np.ndarray) -> bytes:
    """Columns of longs as one value: their lengths, then their bytes, the lowest bytes of a column first."""
    planes = b"".join(np.ascontiguousarray(c.astype("<i8").view(np.uint8).reshape(-1, 8).T).tobytes() for c in columns)
    return np.array([len(c) for c in columns], "<i8").tobytes() + pa.compress(planes, codec="zstd", asbytes=True)


def unpack(body: bytes, columns: int) -> list[np.ndarray]:
    sizes = np.frombuffer(body, "<i8", columns)
    if not sizes.sum():
        return [np.zeros(0, np.int64)] * columns
    planes = np.frombuffer(pa.decompress(body[8 * columns:], decompressed_size=int(sizes.sum()) * 8, codec="zstd", asbytes=True), np.uint8)
    ends = np.cumsum(sizes) * 8
    return [np.ascontiguousarray(planes[e - 8 * n:e].reshape(8, n).T).reshape(-1).view("<i8") for e, n in zip(ends.tolist(), sizes.tolist())]


def spread(*columns: np.ndarray) -> np.ndarray:
    """A hash of each row of longs."""
    h = np.zeros(len(columns[0]), np.uint64)
    for c in columns:
        h = (h ^ c.astype(np.int64).view(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return h


def distinct(codes: np.ndarray) -> np.ndarray:
    """Sorted distinct codes; sorting is faster here than the hash table of ``np.unique``."""
    codes = np.sort(codes)
    return codes[np.diff(codes, prepend=-1) != 0]


def numbered(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct codes, and the place of each code among them; codes and places that fit into one long are sorted as such."""
    bits = max(len(codes) - 1, 0).bit_length()
    if len(codes) and int(codes.min()) >= 0 and int(codes.max()).bit_length() + bits < 64:
        packed = codes << bits
        packed |= np.arange(len(codes))
        packed.sort()
        order, codes = packed & ((1 << bits) - 1), packed >> bits
    else:
        order = np.argsort(codes)
        codes = codes[order]
    new = np.ones(len(codes), bool)
    new[1:] = codes[1:] != codes[:-1]
    place = np.empty(len(codes), np.int32)
    place[order] = np.cumsum(new, dtype=np.int32) - 1
    return codes[new], place


def in_order(x: np.ndarray) -> np.ndarray:
    """Stable order of numbers from 0 on, 16 bits at a time: numpy sorts those by counting."""
    order, most = np.argsort((x & 0xFFFF).astype(np.uint16), kind="stable"), int(x.max(initial=0)) >> 16
    while most:
        x = x >> 16
        order = order[np.argsort((x[order] & 0xFFFF).astype(np.uint16), kind="stable")]
        most >>= 16
    return order


def numbers() -> dict[bytes, int]:
    """Numbers of words from 1 on, in the order in which they come."""
    return collections.defaultdict(itertools.count(1).__next__)


class Chunk:
    """The distinct words of a chunk as sorted keys, and its pieces of texts as places among them, each behind two context words."""

    def __init__(self, keys: np.ndarray, seq: np.ndarray, starts: np.ndarray, sizes: np.ndarray):
        self.keys, self.seq, self.starts, self.sizes = keys, seq, starts, sizes
        self.none = int(np.searchsorted(keys, 0))
        # Places of words, without the two before each piece.
        self.places = np.arange(sizes.sum()) + np.repeat(2 * np.arange(1, len(sizes) + 1), sizes)
        self.has_pair, self.has_triple = seq[self.places - 1] != self.none, seq[self.places - 2] != self.none
        # Pairs behind every word of a piece but the first: a triple's context is the pair one place before, also where a piece goes on.
        known = np.zeros(len(seq), bool)
        known[1:] = (seq[1:] != self.none) & (seq[:-1] != self.none)
        known[np.cumsum(sizes + 2) - sizes - 2] = False
        at = np.flatnonzero(known)
        #: Sorted codes of distinct pairs, contexts of triples among them; numbers of those at each place.
        self.pairs, number = numbered(seq[at - 1] << BITS | seq[at])
        pair_at = np.zeros(len(seq), np.int64)
        pair_at[at] = number
        self.pair_of = pair_at[self.places[self.has_pair]]
        three = self.places[self.has_triple]
        #: Sorted codes of distinct triples, by the number of their context and their last word.
        self.triples, self.triple_of = numbered(pair_at[three - 1] << BITS | seq[three])
        self.context_of = self.triples >> BITS
        #: The number of the pair that a triple ends with.
        self.shorter_of = np.zeros(len(self.triples), np.int64)
        self.shorter_of[self.triple_of] = pair_at[three]

    def deal(self, vocabulary: Vocabulary, owners: int, owned: int) -> None:
        """Entries, that is pairs or splits of them, and triples in the order of their owners."""
        first, second = self.keys[self.pairs >> BITS], self.keys[self.pairs & LOW]
        most = max(owned, vocabulary.total // SPLIT_SHARE)
        splits = 1 + np.minimum(vocabulary.count(first), vocabulary.count(second)) // most
        begin = np.cumsum(splits) - splits
        pair = np.repeat(np.arange(len(self.pairs)), splits)
        split = np.arange(len(pair)) - begin[pair]
        owner = (spread(first[pair], second[pair], split) % np.uint64(owners)).astype(np.int64)
        order = in_order(owner)
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        third = spread(self.keys[self.triples & LOW]) % splits[self.context_of].astype(np.uint64)
        entry = rank[begin[self.context_of] + third.astype(np.int64)]
        self.entry_owner, self.entry_pair, self.entry_split = owner[order], pair[order], split[order]
        self.triple_order = in_order(entry)
        self.triples_of = np.bincount(entry, minlength=len(order))

    def requests(self, weight: np.ndarray):
        """``owner, body`` for each owner; ``weight`` tells which pieces are for training."""
        trained = np.repeat(weight, self.sizes)
        n2 = np.bincount(self.pair_of, trained[self.has_pair], len(self.pairs)).astype(np.int64)
        n3 = np.bincount(self.triple_of, trained[self.has_triple], len(self.triples)).astype(np.int64)[self.triple_order]
        first, second = self.keys[self.pairs >> BITS][self.entry_pair], self.keys[self.pairs & LOW][self.entry_pair]
        n2 = np.where(self.entry_split == 0, n2[self.entry_pair], 0)
        third = self.keys[self.triples & LOW][self.triple_order]
        cuts = np.flatnonzero(np.diff(self.entry_owner, prepend=-1)).tolist() + [len(self.entry_owner)]
        ends = np.concatenate([[0], np.cumsum(self.triples_of)])
        for a, b in zip(cuts, cuts[1:]):
            s, e = ends[a], ends[b]
            yield int(self.entry_owner[a]), pack(np.diff(first[a:b], prepend=0), second[a:b], n2[a:b], self.triples_of[a:b], third[s:e], n3[s:e])


def chunks(texts: DataFrame, model: Model, chunk: int, owners: int = 0, owned: int = 0) -> DataFrame:
    """``owner, chunk, body`` from ``doc_id, trained, text, part``: the blocks of all chunks, or without ``owners`` the chunks themselves.

    Cutting texts twice costs less than carrying the chunks along with their blocks. The words of a chunk that are not common are a
    block too, of an owner that no other block has.
    """
    shared = model.shared

    def run(batches):
        vocabulary = shared.value
        name = row = None
        local, seq = numbers(), array.array("q")
        pieces: list[tuple] = []
        size = 0

        def flush():
            keys, place = np.unique(np.append(0, vocabulary.keys(local)), return_inverse=True)
            rows, ids, known, trained, sizes = (np.array(c, np.int64) for c in zip(*pieces))
            place = place[np.frombuffer(seq, np.int64)]
            if owners:
                one = Chunk(keys, place, rows, sizes)
                one.deal(vocabulary, owners, owned)
                found = [(-1 - name, pack(np.diff(keys[keys < 0], prepend=0))), *one.requests(trained)]
            else:
                found = [(None, pack(np.diff(keys, prepend=0), place, np.diff(rows, prepend=0), ids, known, sizes))]
            return pa.RecordBatch.from_arrays([pa.array([o for o, _ in found], pa.int64()), pa.array([name] * len(found), pa.int64()),
                                               pa.array([b for _, b in found], pa.binary())], ["owner", "chunk", "body"])

        for batch in batches:
            for i, trained, text, part in zip(*(batch.column(k).to_pylist() for k in range(4))):
                if name is None:
                    name = row = part << 32
                tokens = words(text)
                tokens.append(END)
                at = 0
                while at < len(tokens):
                    piece = tokens[at:at + chunk - size]
                    before = tokens[max(0, at - 2):at]
                    seq.extend([0] * (2 - len(before)))
                    seq.extend(map(local.__getitem__, before + piece))
                    pieces.append((row, i or 0, i is not None, bool(trained), len(piece)))
                    size += len(piece)
                    at += len(piece)
                    if size == chunk:
                        yield flush()
                        local, seq, pieces, size = numbers(), array.array("q"), [], 0
                        name += 1
                row += 1
        if pieces:
            yield flush()

    return texts.mapInArrow(run, "owner long, chunk long, body binary")


ANSWERS = pa.schema([("owner", pa.int64()), ("chunk", pa.int64()), ("kind", pa.int32()), ("body", pa.binary())])


def answer(table: pa.Table) -> pa.Table:
    """What one owner returns: a reply to each block, and how many different pairs each word begins, and at how many places."""
    owner = table.column("owner")[0].as_py()
    if owner < 0:
        return pa.Table.from_arrays([table.column("owner"), table.column("chunk"), pa.array([RARE] * len(table), pa.int32()), table.column("body")], schema=ANSWERS)
    names, bodies = table.column("chunk").to_pylist(), table.column("body")
    sizes = np.array([np.frombuffer(body.as_buffer(), "<i8", 6) for body in bodies])
    n, n_third = sizes[:, 0].sum(), sizes[:, 4].sum()
    # All blocks end to end; counts within a block are below its number of places.
    words_at = np.empty(2 * n + n_third, np.int64)
    n2, triples_of, n3 = np.empty(n, np.int32), np.empty(n, np.int32), np.empty(n_third, np.int32)
    ends, third_ends = np.cumsum(sizes[:, 0]).tolist(), np.cumsum(sizes[:, 4]).tolist()
    spans = list(zip([0, *ends], ends, [0, *third_ends], third_ends))
    for body, (a, b, s, e) in zip(bodies, spans):
        first, second, n2[a:b], triples_of[a:b], third, n3[s:e] = unpack(body.as_py(), 6)
        words_at[a:b], words_at[n + a:n + b], words_at[2 * n + s:2 * n + e] = np.cumsum(first), second, third
    keys, place = numbered(words_at)
    del words_at
    m = len(keys)
    pairs, pair = numbered(place[:n].astype(np.int64) * m + place[n:2 * n])
    triples, triple = numbered(np.repeat(pair, triples_of).astype(np.int64) * m + place[2 * n:])
    del place, triples_of
    n2 = np.bincount(pair, n2, len(pairs)).astype(np.int64)
    n3 = np.bincount(triple, n3, len(triples)).astype(np.int64)
    follow = np.bincount((triples // m)[n3 > 0], minlength=len(pairs))
    seen = np.bincount((pairs // m)[n2 > 0], minlength=m)
    begun = np.bincount(pairs // m, n2, m).astype(np.int64)
    out = [(owner, name, REPLY, pack(n2[pair[a:b]], follow[pair[a:b]], n3[triple[s:e]])) for name, (a, b, s, e) in zip(names, spans)]
    out.append((owner, None, FOLLOW, pack(np.diff(keys[seen > 0], prepend=0), begun[seen > 0], seen[seen > 0])))
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), ANSWERS)], schema=ANSWERS)


class Automaton:
    """States, arcs and failure arcs for the texts of a chunk. State 0 is the root; then come the words, then the pairs.

    ``count`` and ``follow`` tell how often a word occurs and how many different words follow it; ``n2`` and ``follow3`` the same of
    the chunk's pairs, ``n3`` how often its triples occur.
    """

    def __init__(self, chunk: Chunk, count: np.ndarray, follow: np.ndarray, n2: np.ndarray, follow3: np.ndarray, n3: np.ndarray, floor: float):
        m = len(chunk.keys)
        base = (count + 0.5) / floor
        self.log_base = np.log10(base)
        v, w = chunk.pairs >> BITS, chunk.pairs & LOW
        places = np.where(follow > 0, count, 0)
        left2 = DISCOUNT * follow / np.maximum(places, 1)
        p2 = np.where(places[v] > 0, np.maximum(n2 - DISCOUNT, 0) / np.maximum(places[v], 1) + left2[v] * base[w], base[w])
        left3 = DISCOUNT * follow3 / np.maximum(n2, 1)
        at = chunk.context_of
        shorter = chunk.shorter_of
        p3 = np.maximum(n3 - DISCOUNT, 0) / np.maximum(n2[at], 1) + left3[at] * p2[shorter]
        start = np.where(places > 0, 1 + np.arange(m), 0)
        #: Where a word leads that was read behind the word before it.
        after = np.where(follow3 > 0, 1 + m + np.arange(len(v)), start[w])
        two, three = n2 > 0, n3 > 0
        #: Arcs by state and word, in order: states of words come before those of pairs.
        self.arcs = np.concatenate([((1 + v) << BITS | w)[two], ((1 + m + at) << BITS | (chunk.triples & LOW))[three]])
        self.to = np.concatenate([after[two], after[shorter][three]])
        self.logp = np.log10(np.concatenate([p2[two], p3[three]]))
        left = np.concatenate([[1.0], left2, left3])
        self.weight = np.log10(np.where(left > 0, left, 1))
        self.fail = np.concatenate([np.zeros(1 + m, np.int64), start[w]])
        self.start, self.after = start, after

    def read(self, state: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each state and the word read there: its log-probability, and the state behind it."""
        logp, behind = self.log_base[word], self.start[word]
        lost = np.zeros(len(word))
        waiting = np.flatnonzero(state)
        state = state[waiting]
        while len(waiting):
            code = state << BITS | word[waiting]
            arc = np.searchsorted(self.arcs, code)
            found = self.arcs[np.minimum(arc, len(self.arcs) - 1)] == code if len(self.arcs) else np.zeros(len(code), bool)
            logp[waiting[found]], behind[waiting[found]] = self.logp[arc[found]], self.to[arc[found]]
            waiting, state = waiting[~found], state[~found]
            lost[waiting] += self.weight[state]
            state = self.fail[state]
            waiting, state = waiting[state > 0], state[state > 0]
        return logp + lost, behind

    def walk(self, state: int, ids: list[int]) -> float:
        """Log-probability of the words from a state on."""
        total = 0.0
        for w in ids:
            logp, behind = self.read(np.array([state]), np.array([w]))
            state, total = int(behind[0]), total + float(logp[0])
        return total

    def walk_all(self, chunk: Chunk) -> np.ndarray:
        """Log-probability of the word at every place of the chunk; equal triples are read once, in their order."""
        first = ~chunk.has_triple
        out = np.empty(len(first))
        out[first] = self.read(self.start[chunk.seq[chunk.places[first] - 1]], chunk.seq[chunk.places[first]])[0]
        out[chunk.has_triple] = self.read(self.after[chunk.context_of], chunk.triples & LOW)[0][chunk.triple_of]
        return out


SCORES = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])


def score(docs: DataFrame, trained: Column, doc_id: str = "doc_id", text: str = "text", word_share: int = WORD_SHARE, chunk: int = CHUNK,
          owned: int = OWNED) -> DataFrame:
    """``doc_id, n_tokens, n_known, train_tokens, base_score, score`` of every row, by a model of the rows where ``trained`` holds."""
    texts = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(trained, F.lit(False)).alias("trained"),
                        F.coalesce(F.col(text), F.lit("")).cast("binary").alias("text"),
                        F.spark_partition_id().alias("part"))  # that of the input, also where a task's own number is another
    model = train(texts.where("trained").select("text"), word_share)
    vocabulary, shared = model.vocabulary, model.shared
    floor = vocabulary.total + 0.5 * (vocabulary.distinct + 1)
    owners = 1 + vocabulary.total // owned
    answers = durable(chunks(texts, model, chunk, owners, owned).groupBy("owner").applyInArrow(answer, "owner long, chunk long, kind int, body binary"))

    def begun(common: bool) -> DataFrame:
        """``k, c, f``: places of a word and the number of different words that follow it."""
        def run(batches):
            for batch in batches:
                for body in batch.column(0).to_pylist():
                    keys, *n = unpack(body, 3)
                    keys = np.cumsum(keys)
                    yield pa.RecordBatch.from_arrays([pa.array(x[(keys > 0) == common]) for x in (keys, *n)], ["k", "c", "f"])

        return answers.where(F.col("kind") == FOLLOW).select("body").mapInArrow(run, "k long, c long, f long").groupBy("k").agg(
            F.sum("c").alias("c"), F.sum("f").alias("f"))

    # As many rows as there are common words, at most WORD_SHARE.
    common = begun(True).toPandas()
    follows = np.zeros(len(vocabulary.counts), np.int64)
    follows[common["k"].to_numpy(np.int64)] = common["f"].to_numpy(np.int64)
    followed = docs.sparkSession.sparkContext.broadcast(follows)

    def rare(batches):
        for batch in batches:
            for name, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                keys = np.cumsum(unpack(body, 1)[0])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), name)), pa.array(keys)], ["chunk", "k"])

    def walked(table: pa.Table) -> pa.Table:
        kind = table.column("kind").to_numpy()
        bodies = table.column("body").filter(pa.array(kind == SEQUENCE)).to_pylist()
        keys, seq, rows, ids, known, sizes = unpack(bodies[0], 6)
        keys, rows = np.cumsum(keys), np.cumsum(rows)
        one = Chunk(keys, seq, rows, sizes)
        one.deal(shared.value, owners, owned)
        replies = table.filter(pa.array(kind == REPLY)).sort_by("owner").column("body").to_pylist()
        n2, follow3, n3 = (np.concatenate(c) for c in zip(*(unpack(b, 3) for b in replies))) if replies else [np.zeros(0, np.int64)] * 3
        # Splits that meet at one owner have been counted as one there.
        apart = (np.diff(one.entry_owner, prepend=-1) != 0) | (np.diff(one.entry_pair, prepend=-1) != 0)
        n2, follow3 = (np.bincount(one.entry_pair, c * apart, len(one.pairs)) for c in (n2, follow3))
        by_triple = np.empty(len(one.triples))
        by_triple[one.triple_order] = n3
        count, after = shared.value.count(keys), followed.value[np.maximum(keys, 0)]
        words_of = table.filter(pa.array(kind == WORD))
        at = np.searchsorted(keys, words_of.column("k").to_numpy())
        count[at], after[at] = words_of.column("c").to_numpy(), words_of.column("f").to_numpy()
        automaton = Automaton(one, count, after, n2, follow3, by_triple, floor)
        ends = np.cumsum(sizes)
        real = seq[one.places]
        sums = [np.add.reduceat(c, ends - sizes) for c in ((count[real] > 0).astype(np.int64), automaton.log_base[real], automaton.walk_all(one))]
        return pa.Table.from_arrays([pa.array(rows), pa.array(ids, mask=known == 0), pa.array(sizes), *map(pa.array, sums)], schema=SCORES)

    cut = chunks(texts, model, chunk).select("chunk", "body")
    found = answers.where(F.col("kind") == RARE).select("chunk", "body").mapInArrow(rare, "chunk long, k long").join(begun(False), "k")
    parts = answers.where(F.col("kind") == REPLY).unionByName(cut.withColumn("kind", F.lit(SEQUENCE)), allowMissingColumns=True).unionByName(
        found.withColumn("kind", F.lit(WORD)), allowMissingColumns=True)
    scored = parts.groupBy("chunk").applyInArrow(walked, "row long, doc_id long, n_tokens long, n_known long, base_score double, score double")
    sums = [F.sum(c).alias(c) for c in ("n_tokens", "n_known", "base_score", "score")]
    return scored.groupBy("row", "doc_id").agg(*sums).drop("row").withColumn("train_tokens", F.lit(vocabulary.total).cast("long"))


def score_held_out(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **sizes: int) -> DataFrame:
    """Train on the rows whose id's crc32 modulo 5 is not 1 and score every row; adds ``held_out``."""
    return score(docs, remainder(F.col(doc_id)) != 1, doc_id, text, **sizes).withColumn("held_out", remainder(F.col("doc_id")) == 1)
