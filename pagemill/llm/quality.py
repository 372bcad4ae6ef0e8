"""Quality classifier: random-indexing word vectors pooled per document, and a two-layer network in numpy.

Every word has a sparse index vector made from its hash. The context vector of a word is the sum of its own and its neighbours'
index vectors over the labelled sample; being whole numbers, the sums do not depend on the order of rows or tasks. A document
is the mean of its words' unit vectors and the logarithm of its length. A network with one hidden layer is trained on these,
and a temperature fitted on a part kept apart turns its logits into calibrated probabilities.

The model is fitted on at most ``SAMPLE_ROWS`` labelled rows, chosen by a hash of their ids, and knows at most ``VOCABULARY``
words; other words are represented by the vector of their shape (case, digits, marks). Both bounds are parameters. Scoring is
map-only and reads whole texts.

Null texts count as empty; an empty text has a score like any other. Repeated rows are kept; a null id takes no part in
learning. Labels that disagree about a document are averaged. Without labels of both kinds the score of every text is the share
of label 1, or 0.5 without any label.
"""

from __future__ import annotations

import collections
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.llm.common import remainder
from pagemill.llm.merges import WordCache, forget

SAMPLE_ROWS = 10_000
VOCABULARY = 30_000
DIM, NONZERO, WINDOW = 64, 6, 2
#: Tasks that gather the vectors of the bounded sample, each with a table of the whole vocabulary.
TASKS = 8
#: Words of a text, or rows of a table of vectors, that are handled at once.
PART = 2_000
SHAPES = ["\x00upper", "\x00lower", "\x00title", "\x00digit", "\x00mixed", "\x00marks"]
HIDDEN, EPOCHS, SEED = 32, 60, 17
THRESHOLD = 0.3

_units = re.compile(r"\w+|[^\w\s]+").findall


def shape(word: str) -> str:
    """The class of words that an unknown word is taken for."""
    if word.isupper():
        return "\x00upper"
    if word.islower():
        return "\x00lower"
    if word.istitle():
        return "\x00title"
    return "\x00digit" if word.isdigit() else "\x00mixed" if word.isalnum() else "\x00marks"


def index_vector(word: str) -> np.ndarray:
    """``NONZERO`` places set to 1 or -1, all by the word's hash."""
    out, seed = np.zeros(DIM, np.int64), word.encode("utf-8", "replace")
    for k in range(NONZERO):
        h = zlib.crc32(seed, 0x9E3779B1 * (k + 1) & 0xFFFFFFFF)
        h = (h ^ h >> 15) * 0x2C1B3C6D & 0xFFFFFFFF
        out[(h ^ h >> 12) % DIM] += 1 if h >> 31 else -1
    return out


def frequent_units(texts: DataFrame, most: int = VOCABULARY) -> list[str]:
    """The words that occur most often, and all shapes."""
    def run(batches):
        forget()
        counts: collections.Counter = collections.Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                counts.update(_units(text or ""))
            if len(counts) > 200_000:
                yield pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], ["word", "n"])
                counts.clear()
        yield pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], ["word", "n"])

    totals = texts.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return [r.word for r in totals.orderBy(F.desc("n"), "word").limit(most).collect()] + SHAPES


def add_vectors(total: np.ndarray, row: dict[str, int], found: list[str]) -> None:
    """Add the context vectors of a text's words to the rows of ``total``; only ``PART`` words of a text have theirs at once."""
    names = list(dict.fromkeys(found))
    number = {w: i for i, w in enumerate(names)}
    ids = np.array([number[w] for w in found])
    index = np.array([index_vector(w) for w in names])
    known = np.array([row.get(w, -1) for w in names])
    class_of = np.array([row[shape(w)] for w in names])
    for a in range(0, len(ids), PART):
        here = ids[a:a + PART]
        before, after = ids[max(0, a - WINDOW):a], ids[a + PART:a + PART + WINDOW]
        empty = np.zeros((WINDOW + 1, DIM), np.int64)
        around = np.cumsum(np.concatenate([empty[len(before):], index[before], index[here], index[after], empty[len(after) + 1:]]), axis=0)
        around = around[2 * WINDOW + 1:] - around[:-2 * WINDOW - 1]
        order = np.argsort(here, kind="stable")
        starts = np.flatnonzero(np.diff(here[order], prepend=-1))
        vectors, word = np.add.reduceat(around[order], starts), here[order][starts]
        listed = known[word] >= 0
        total[known[word][listed]] += vectors[listed]
        np.add.at(total, class_of[word], vectors)


def context_vectors(texts: DataFrame, vocabulary: int = VOCABULARY) -> dict[str, np.ndarray]:
    """Context vectors of the most frequent words and of all shapes; each task adds up its own before the shuffle."""
    words = frequent_units(texts, vocabulary)
    shared = texts.sparkSession.sparkContext.broadcast({w: i for i, w in enumerate(words)})
    fields = ", ".join(f"v{k} long" for k in range(DIM))

    def run(batches):
        row = shared.value
        total = np.zeros((len(row), DIM), np.int64)
        for batch in batches:
            for text in batch.column(0).to_pylist():
                found = _units(text or "")
                if found:
                    add_vectors(total, row, found)
        used = np.flatnonzero(total.any(axis=1))
        for a in range(0, len(used), PART):
            part = used[a:a + PART]
            yield pa.RecordBatch.from_arrays([pa.array(part), *(pa.array(total[part, k]) for k in range(DIM))], ["row", *(f"v{k}" for k in range(DIM))])

    partial = texts.coalesce(TASKS).mapInArrow(run, f"row long, {fields}")
    totals = partial.groupBy("row").agg(*[F.sum(f"v{k}").alias(f"v{k}") for k in range(DIM)]).collect()
    found = {r[0]: np.array(r[1:], np.float64) for r in totals}
    return {w: found[i] for i, w in enumerate(words) if i in found}


class Features:
    """A document's pooled vector."""

    def __init__(self, vectors: dict[str, np.ndarray]):
        self.row = {w: i for i, w in enumerate(vectors, 1)}
        matrix = np.array([np.zeros(DIM), *vectors.values()])
        self.matrix = (matrix / np.maximum(np.linalg.norm(matrix, axis=1, keepdims=True), 1e-9)).astype(np.float32)

    def cache(self) -> WordCache:
        """Rows by word; kept with the features for as long as a Python worker holds them."""
        if "_rows" not in self.__dict__:
            self._rows = WordCache(lambda w: self.row.get(w) or self.row.get(shape(w), 0))
        return self._rows

    def __call__(self, text: str, rows: WordCache) -> np.ndarray:
        found = _units(text)
        pooled = np.zeros(DIM + 1, np.float32)
        if found:
            uses = collections.Counter(map(rows.__getitem__, found))
            n = np.fromiter(uses.values(), np.float32, len(uses))
            pooled[:DIM] = n @ self.matrix[list(uses)] / len(found)
        pooled[DIM] = np.log1p(len(found)) / 10
        return pooled


class Network:
    """tanh layer, logit, temperature."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        self.prior = float(y.mean()) if len(y) else 0.5
        self.trained = len(np.unique(y)) == 2 and len(y) >= 10
        if not self.trained:
            return
        rng = np.random.default_rng(SEED)
        order = rng.permutation(len(y))
        apart, rest = order[:len(y) // 5], order[len(y) // 5:]
        self.mean, self.spread = x.mean(axis=0), x.std(axis=0) + 1e-6
        z = (x - self.mean) / self.spread
        self.w1 = rng.normal(0, 1 / np.sqrt(z.shape[1]), (z.shape[1], HIDDEN))
        self.b1, self.w2, self.b2 = np.zeros(HIDDEN), rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), np.zeros(1)
        weights = [self.w1, self.b1, self.w2, self.b2]
        first, second = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
        step = 0
        for _ in range(EPOCHS):
            for batch in np.array_split(rng.permutation(rest), max(1, len(rest) // 128)):
                step += 1
                hidden = np.tanh(z[batch] @ self.w1 + self.b1)
                error = (sigmoid(hidden @ self.w2 + self.b2) - y[batch]) / len(batch)
                back = np.outer(error, self.w2) * (1 - hidden ** 2)
                for w, g, m, v in zip(weights, (z[batch].T @ back, back.sum(0), hidden.T @ error, error.sum(keepdims=True)), first, second):
                    g = g + 1e-4 * w
                    m += 0.1 * (g - m)
                    v += 0.001 * (g * g - v)
                    w -= 0.003 * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)
        self.temperature = 1.0
        logits = self.logits(x[apart])
        choices = np.exp(np.linspace(-1.5, 3, 91))
        self.temperature = float(min(choices, key=lambda t: log_loss(logits / t, y[apart])))

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.mean) / self.spread @ self.w1 + self.b1) @ self.w2 + self.b2

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(self.logits(x) / self.temperature) if self.trained else np.full(len(x), self.prior)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def log_loss(logits: np.ndarray, y: np.ndarray) -> float:
    return float(np.mean(np.logaddexp(0, logits) - y * logits)) if len(y) else 0.0


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality", sample_rows: int = SAMPLE_ROWS,
        vocabulary: int = VOCABULARY) -> tuple[Features, Network]:
    """Fit on labelled rows whose id's crc32 modulo 5 is not 0; everything collected is bounded by the parameters."""
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & (remainder(F.col("doc_id")) != 0))
    chosen = (known.groupBy("doc_id").agg(F.avg(label).alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
              .select(F.col("doc_id").alias("__id"), F.col("label").alias("__label")))
    rows = docs.select(F.col(doc_id).alias("__id"), F.coalesce(F.col(text), F.lit("")).alias("__text")).join(F.broadcast(chosen), "__id")
    rows = rows.select("__id", "__text", "__label").persist()
    features = Features(context_vectors(rows.select("__text"), vocabulary))
    shared = docs.sparkSession.sparkContext.broadcast(features)

    def pool(batches):
        cache = shared.value.cache()
        for batch in batches:
            x = [shared.value(t or "", cache) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([v.tolist() for v in x], pa.list_(pa.float32())), batch.column(2)], ["id", "x", "label"])

    # A document that has many rows counts once.
    got = rows.dropDuplicates(["__id"]).mapInArrow(pool, "id long, x array<float>, label double").orderBy("id").collect()
    rows.unpersist()
    y = np.array([r.label >= 0.5 for r in got], np.float64)
    return features, Network(np.array([r.x for r in got], np.float64).reshape(-1, DIM + 1), y)


def scorer(spark, model: tuple[Features, Network]):
    """A column function from whole texts to the probability of label 1."""
    shared = spark.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        forget()
        features, network = shared.value
        rows = features.cache()
        x = np.array([features(t or "", rows) for t in texts.to_pylist()], np.float64).reshape(-1, DIM + 1)
        return pa.array(network(x), pa.float64())

    return score


def score_documents(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", **sizes: int) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row."""
    score = scorer(docs.sparkSession, fit(docs, labels, doc_id, text, **sizes))
    scored = docs.select(F.col(doc_id).alias("doc_id"), (remainder(F.col(doc_id)) == 0).alias("held_out"), score(F.col(text)).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that the classifier does not reject, with their columns as they are."""
    score = scorer(docs.sparkSession, fit(docs, labels))
    return docs.where(score(F.col("text")) >= threshold)
