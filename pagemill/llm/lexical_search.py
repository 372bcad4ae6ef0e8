"""Ranked lexical search: the best documents for each item of a query set, by the Best Position Algorithm.

A first pass over the documents counts all terms and keeps, per shard of about ``SHARD_BYTES`` of text, the occurrences of the items'
terms. With the totals of the whole corpus, a second pass turns a shard into impact lists (one per term, highest impact first) and
answers every item in it: each list is read on from its best position, the end of the stretch from its top in which every entry has
been seen; each new document is looked up directly in all lists of the item, which marks its places there as seen. No unseen document
can score more than the sum of the impacts at the best positions, so the item is done when that sum is strictly below the score of the
document of rank ``k`` (a document that ties may have a smaller id). The best of all shards are the best of the corpus.

A small first wave of shards gives each item a floor, the score of rank ``k`` among them; in the other shards the floor stops the
reading as well, so what they send on does not grow with their number times ``k``.

Terms are the maximal stretches of letters and digits of ASCII and of all characters beyond, A-Z in lower case, of whole texts. The
impact of a term is an integer function of its occurrences, the document's length and the term's rarity; scores are sums of integers
and the same in any order. Items are searched for in blocks of at most ``BLOCK_BYTES`` of text, one pass over the documents each, so
what is broadcast is bounded.

Null and empty texts have no terms and are found by nothing. Every row is a document: rows with equal ids or texts are ranked one by one.
Equal scores go by ascending id, null ids first. Rows of items with the same id and text are one item; items with the same id and
another text are ranked each for itself. An item without terms, or whose terms occur nowhere, has no rows; empty tables give none.
Other columns, whatever their names, are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagemill.session import durable

K = 50
SHARD_BYTES = 16 << 20
BLOCK_BYTES = 4 << 20
#: Of so many shards, one is in the first wave.
WAVE = 64
#: Entries that a list is read on by at first; each further round reads twice as many.
FIRST_READ = 16

#: Terms keep letters, digits and all bytes of characters beyond ASCII; A-Z become lower case, other bytes blanks.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


def terms(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(FOLD).split()


def item_blocks(items: DataFrame, item_id: str, text: str) -> list[DataFrame]:
    """Distinct ``item_id, text`` with a number ``item``, cut by it into blocks whose texts are bounded."""
    slim = items.select(F.col(item_id).alias("item_id"), F.coalesce(F.col(text), F.lit("")).alias("text")).distinct()
    numbered = durable(slim.withColumn("item", F.monotonically_increasing_id()))
    size = numbered.agg(F.sum(F.octet_length("text")), F.max(F.octet_length("text"))).first()
    blocks = (size[0] or 0) // BLOCK_BYTES + 1
    return [numbered.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == b) for b in range(blocks)]


STORED = "shard long, ids array<long>, lengths binary, terms binary, places binary, counts binary, n_docs long, n_terms long"


def shard_postings(docs: DataFrame, vocabulary, doc_id: str, text: str) -> DataFrame:
    """A row for each shard: ids and lengths of its documents, the occurrences of the vocabulary's terms, sorted by term, and totals over all terms."""
    def run(batches):
        known = vocabulary.value
        ids, lengths, codes, places, counts, held = [], [], [], [], [], 0

        def row():
            order = np.argsort(np.concatenate(codes), kind="stable") if codes else np.zeros(0, np.int64)
            part = lambda x, kind: (np.concatenate(x)[order] if x else np.zeros(0)).astype(kind).tobytes()
            found = np.array(lengths, np.int64)
            return pa.RecordBatch.from_pydict({
                "shard": pa.array([0], pa.int64()), "ids": pa.array([ids], pa.list_(pa.int64())), "lengths": pa.array([found.tobytes()], pa.binary()),
                "terms": pa.array([part(codes, np.int32)], pa.binary()), "places": pa.array([part(places, np.int32)], pa.binary()),
                "counts": pa.array([part(counts, np.int32)], pa.binary()), "n_docs": pa.array([int((found > 0).sum())], pa.int64()),
                "n_terms": pa.array([int(found.sum())], pa.int64())})

        for batch in batches:
            for i, value in zip(batch.column(0).to_pylist(), batch.column(1)):
                own = terms(value.as_py())
                if own:
                    hits = [k for k in map(known.get, own) if k is not None]
                    code, n = np.unique(np.array(hits, np.int64), return_counts=True)
                    codes.append(code), counts.append(n), places.append(np.full(len(code), len(ids)))
                    ids.append(i), lengths.append(len(own))
                    held += sum(map(len, own)) + len(own)
                    if held >= SHARD_BYTES:
                        yield row()
                        ids, lengths, codes, places, counts, held = [], [], [], [], [], 0
        if ids:
            yield row()

    found = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, STORED)
    return durable(found.withColumn("shard", F.monotonically_increasing_id()))


def weights(stored: DataFrame, n_vocabulary: int, n_docs: int) -> np.ndarray:
    """The weight of each term of the vocabulary, from the number of documents that hold it."""
    def run(batches):
        df = np.zeros(n_vocabulary, np.int64)
        for batch in batches:
            for codes in batch.column(0).to_pylist():
                df += np.bincount(np.frombuffer(codes, np.int32), minlength=n_vocabulary)
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_pydict({"term": at, "df": df[at]})

    df = np.zeros(n_vocabulary, np.int64)
    for r in stored.select("terms").mapInArrow(run, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).toLocalIterator():
        df[r.term] = r.df  # one row for each term of a block of items
    return np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(n) + 1))) for n in df], np.int64)


class ImpactLists:
    """The impact lists of a shard, by term and by document."""

    def __init__(self, lengths: np.ndarray, codes: np.ndarray, places: np.ndarray, counts: np.ndarray, weight: np.ndarray, n_docs: int, n_terms: int):
        norm = 100 - 50 + (50 * lengths * n_docs) // max(n_terms, 1)
        tf = counts.astype(np.int64)
        impacts = weight[codes] * ((1_000_000_000 * tf) // (1000 * tf + 20 * norm[places]))
        order = np.lexsort((places, -impacts, codes))
        self.codes, self.docs, self.impacts = codes[order], places[order].astype(np.int64), impacts[order]
        self.begins = np.searchsorted(self.codes, np.arange(len(weight) + 1))
        by_doc = np.argsort(self.docs, kind="stable")  # direct access: the entries of a document, as places in the lists
        self.entries, self.of_doc = by_doc, np.searchsorted(self.docs[by_doc], np.arange(len(lengths) + 1))
        self.slot = np.full(len(weight), -1, np.int64)

    def best(self, wanted: np.ndarray, k: int, floor: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents and scores: all of the ``k`` best (with ties of the last one) that reach ``floor``, and maybe others below them."""
        wanted = wanted[self.begins[wanted + 1] > self.begins[wanted]]
        starts = self.begins[wanted]
        sizes = self.begins[wanted + 1] - starts
        first = np.cumsum(sizes) - sizes  # the lists of this item, one behind the other
        self.slot[wanted] = np.arange(len(wanted))
        whole = np.arange(int(sizes.sum())) + np.repeat(starts - first, sizes)
        docs, impacts = self.docs[whole], self.impacts[whole]
        seen, known = np.zeros(len(whole) + 1, bool), np.zeros(0, np.int64)
        scores, position, read = np.zeros(0, np.int64), np.zeros(len(wanted), np.int64), FIRST_READ
        scored = np.zeros(len(self.of_doc) - 1, bool)
        while len(wanted):
            # Sorted access: each list goes on from its best position.
            todo = np.minimum(sizes - position, read)
            at = np.arange(int(todo.sum())) + np.repeat(first + position - (np.cumsum(todo) - todo), todo)
            new = np.unique(docs[at])
            new = new[~scored[new]]
            scored[new] = True
            # Direct access: all entries of the new documents in the lists of this item, and their places there.
            n = self.of_doc[new + 1] - self.of_doc[new]
            rows = self.entries[np.arange(int(n.sum())) + np.repeat(self.of_doc[new] - (np.cumsum(n) - n), n)]
            owner, slots = np.repeat(np.arange(len(new)), n), self.slot[self.codes[rows]]
            mine = slots >= 0
            rows, owner, slots = rows[mine], owner[mine], slots[mine]
            seen[first[slots] + rows - starts[slots]] = True
            total = np.zeros(len(new), np.int64)
            np.add.at(total, owner, self.impacts[rows])
            known, scores = np.concatenate([known, new]), np.concatenate([scores, total])
            # Best positions: behind the seen stretch from the top of each list.
            gaps = np.flatnonzero(~seen)
            position = np.minimum(gaps[np.searchsorted(gaps, first)] - first, sizes)
            open_ = position < sizes
            bound = int(impacts[(first + position - 1)[open_]].sum())
            kth = int(np.partition(scores, len(scores) - k)[len(scores) - k]) if len(scores) >= k else -1
            if not open_.any() or bound < max(kth, floor):
                break
            read *= 2
        self.slot[wanted] = -1
        if len(scores) > k:
            floor = max(floor, int(np.partition(scores, len(scores) - k)[len(scores) - k]))
        good = (scores > 0) & (scores >= floor)
        return known[good], scores[good]


def shard_answers(stored: DataFrame, queries, floors) -> DataFrame:
    """``item, doc_id, score`` of the best documents of every shard. ``queries``: weights, totals and term codes of the items."""
    def run(batches):
        weight, n_docs, n_terms, k, items = queries.value
        floor = floors.value
        for batch in batches:
            for ids, lengths, codes, places, counts in zip(*(batch.column(c).to_pylist() for c in range(5))):
                lists = ImpactLists(np.frombuffer(lengths, np.int64), np.frombuffer(codes, np.int32), np.frombuffer(places, np.int32),
                                    np.frombuffer(counts, np.int32), weight, n_docs, n_terms)
                out, docs, scores = [], [], []
                for item, wanted in items:
                    d, s = lists.best(wanted, k, floor.get(item, 0))
                    order = sorted(range(len(d)), key=lambda j: (-int(s[j]), ids[d[j]] is not None, ids[d[j]] or 0))[:k]
                    out += [item] * len(order)
                    docs += [ids[d[j]] for j in order]
                    scores += [int(s[j]) for j in order]
                yield pa.RecordBatch.from_pydict({"item": pa.array(out, pa.int64()), "doc_id": pa.array(docs, pa.int64()), "score": pa.array(scores, pa.int64())})

    return stored.select("ids", "lengths", "terms", "places", "counts").mapInArrow(run, "item long, doc_id long, score long")


def best_of(found: DataFrame, k: int) -> DataFrame:
    """``found`` with ``rank`` up to ``k`` for each item; tasks keep their own ``k`` best before rows are shuffled."""
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_first("doc_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search(docs: DataFrame, items: DataFrame, k: int = K, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``k`` documents with the highest score above 0 for every item."""
    spark = docs.sparkSession
    answers = []
    for block in item_blocks(items, item_id, item_text):
        rows = [(r.item, sorted(set(terms(r.text)))) for r in block.select("item", "text").collect()]  # at most a block
        vocabulary = {t: n for n, t in enumerate(sorted({t for _, own in rows for t in own}))}
        stored = shard_postings(docs, spark.sparkContext.broadcast(vocabulary), doc_id, text)
        total = stored.agg(F.coalesce(F.sum("n_docs"), F.lit(0)), F.coalesce(F.sum("n_terms"), F.lit(0)), F.count("*")).first()
        weight = weights(stored, len(vocabulary), total[0])
        wanted = [(i, np.array([vocabulary[t] for t in own], np.int64)) for i, own in rows if own]
        queries = spark.sparkContext.broadcast((weight, total[0], total[1], k, wanted))
        early = F.pmod(F.xxhash64("shard"), F.lit(WAVE)) == 0
        parts = [early, ~early] if total[2] > WAVE else [F.lit(True)]
        floors: dict[int, int] = {}
        for part in parts:
            found = durable(best_of(shard_answers(stored.where(part), queries, spark.sparkContext.broadcast(floors)), k))
            answers.append(found.drop("rank").join(block.select("item", "item_id"), "item"))
            floors = {r.item: r.score for r in found.where(F.col("rank") == k).select("item", "score").collect()} if part is not parts[-1] else {}  # one number for each item of a block
    found = answers[0]
    for a in answers[1:]:
        found = found.union(a)
    return best_of(found, k).select("item_id", F.col("rank").cast(T.IntegerType()).alias("rank"), "doc_id", "score")
