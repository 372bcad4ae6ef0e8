"""Exact counts and base scores against brute force; the automaton's probabilities sum to one and beat the base on repeats."""

import collections
import math
import zlib

import numpy as np
import pytest

from pagemill.llm.common import words
from pagemill.llm.lm_automaton import BITS, END, Automaton, Chunk, pack, score_held_out, unpack

TEXTS = [(i, f"the cat sat on the mat number {i % 7} and The dog saw it again") for i in range(60)] + [
    (100, None), (101, ""), (102, "  \n\t "), (103, "unseen\x0bwords  only"), (104, "é É a b " * 400), (5, "the cat"), (105, "twice"), (105, "twice"), (None, "no id")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "x") for i, t in TEXTS], "doc_id long, text string, score string")


def test_against_brute_force(docs):
    got = collections.defaultdict(list)
    for r in score_held_out(docs, word_share=30, chunk=50).collect():
        got[r.doc_id].append((r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 8)))
        assert r.score <= 0 and math.isfinite(r.score)
    fold = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 5
    tokens = [(i, words((t or "").encode()) + [END]) for i, t in TEXTS]
    counts = collections.Counter(w for i, ws in tokens if fold(i) != 1 for w in ws)
    n, v = sum(counts.values()), len(counts)
    want = collections.defaultdict(list)
    for i, ws in tokens:
        base = sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws)
        want[i].append((fold(i) == 1, len(ws), sum(counts[w] > 0 for w in ws), n, round(base, 8)))
    assert {k: sorted(x) for k, x in got.items()} == {k: sorted(x) for k, x in want.items()}


def test_states_are_distributions():
    texts = [[1, 2, 3, 1, 2, 4, 5], [2, 3, 3, 1, 2, 3, 5], [4, 5], [5]]  # 5 ends a text, 6 is not known
    one, two, three = collections.Counter(), collections.Counter(), collections.Counter()
    for t in texts:
        one.update(t)
        two.update(zip(t, t[1:]))
        three.update(zip(t, t[1:], t[2:]))
    # Every triple there could be, so that the chunk asks for all arcs.
    pieces = [[u, v, w] for u in range(1, 7) for v in range(1, 7) for w in range(1, 7)]
    seq = np.array([x for p in pieces for x in [0, 0, *p]])
    chunk = Chunk(np.arange(7), seq, np.arange(len(pieces)), np.full(len(pieces), 3))
    pairs = [(p >> BITS, p & (1 << BITS) - 1) for p in chunk.pairs.tolist()]
    triples = [(pairs[c][0], pairs[c][1], t & (1 << BITS) - 1) for c, t in zip(chunk.context_of, chunk.triples.tolist())]
    follow2, follow3 = collections.Counter(p[0] for p in two), collections.Counter(t[:2] for t in three)
    numbers = [np.array(x) for x in ([one[w] for w in range(7)], [follow2[w] for w in range(7)], [two[p] for p in pairs],
                                     [follow3[p] for p in pairs], [three[t] for t in triples])]
    model = Automaton(chunk, *numbers, sum(one.values()) + 0.5 * (len(one) + 1))
    states = {0, *model.to, *(s for s in model.start if s)}
    assert len(states) > 8 and any(model.fail[s] for s in states)
    for state in states:
        assert np.isclose(sum(10 ** model.walk(state, [w]) for w in range(1, 7)), 1, atol=1e-9)


def test_blocks_come_back():
    columns = [np.array([], np.int64), np.array([-1, 1 << 62, 0, -(1 << 63)]), np.arange(300)]
    assert all((a == b).all() and len(a) == len(b) for a, b in zip(unpack(pack(*columns), 3), columns))
    assert [len(c) for c in unpack(pack(columns[0], columns[0]), 2)] == [0, 0]


def test_repeats_score_above_the_base(docs):
    rows = {r.doc_id: r for r in score_held_out(docs, word_share=1000).collect()}
    assert all(rows[i].score > rows[i].base_score for i in range(60) if i != 5)


def test_empty_table(spark):
    assert score_held_out(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    lone = spark.createDataFrame([(i, "a b") for i in range(50) if zlib.crc32(str(i).encode()) % 5 == 1], "doc_id long, text string")
    assert {(r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in score_held_out(lone).collect()} == {(3, 0, 0, 0.0)}


def test_every_pair_and_triple_counts(docs):
    """Scores are those of all counts, those of rare words and single occurrences too, whatever the shares are."""
    fold = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 5
    tokens = [(i, words((t or "").encode()) + [END]) for i, t in TEXTS]
    one, two, three = collections.Counter(), collections.Counter(), collections.Counter()
    for i, ws in tokens:
        if fold(i) != 1:
            one.update(ws)
            two.update(zip(ws, ws[1:]))
            three.update(zip(ws, ws[1:], ws[2:]))
    n, v = sum(one.values()), len(one)

    def chance(context, w):
        if not context:
            return (one[w] + 0.5) / (n + 0.5 * (v + 1))
        grams = two if len(context) == 1 else three
        after = {g[-1]: k for g, k in grams.items() if g[:-1] == context}
        lower, places = chance(context[1:], w), sum(after.values())
        return (max(after.get(w, 0) - 0.75, 0) + 0.75 * len(after) * lower) / places if places else lower

    want, known = collections.defaultdict(list), {}
    for i, ws in tokens:
        for k, w in enumerate(ws):
            key = tuple(ws[max(0, k - 2):k]), w
            known[key] = known.get(key) or chance(*key)
        want[i].append(sum(math.log10(known[tuple(ws[max(0, k - 2):k]), w]) for k, w in enumerate(ws)))
    for sizes in ({"word_share": 30}, {}, {"chunk": 7, "owned": 20}, {"word_share": 30, "chunk": 100, "owned": 3}):
        got = collections.defaultdict(list)
        for r in score_held_out(docs, **sizes).collect():
            got[r.doc_id].append(r.score)
        assert set(got) == set(want)
        assert not [(sizes, i, got[i], want[i]) for i in want if not np.allclose(sorted(got[i]), sorted(want[i]), atol=1e-8)]


def test_frequent_pairs_are_split(docs, monkeypatch):
    """Pairs of frequent words have several owners; scores stay the same, also across the cuts of a long text."""
    from pagemill.llm import lm_automaton
    whole = sorted((r.doc_id or -1, round(r.score, 8)) for r in score_held_out(docs).collect())
    monkeypatch.setattr(lm_automaton, "SPLIT_SHARE", 1_000_000)
    split = sorted((r.doc_id or -1, round(r.score, 8)) for r in score_held_out(docs, owned=2, chunk=64).collect())
    assert whole == split
    # The places of a piece, its pairs in several splits, and every triple with one owner.
    vocabulary = lm_automaton.Vocabulary([b"a", b"b"], [90, 80], 170, 2)
    chunk = Chunk(np.arange(3), np.array([0, 0, 1, 2, 1, 2, 2, 1]), np.array([0]), np.array([6]))
    chunk.deal(vocabulary, 7, 20)
    assert len(chunk.entry_pair) > len(chunk.pairs) and chunk.triples_of.sum() == len(chunk.triples)


def test_all_places_at_once():
    """The places of a chunk score as its texts do that are walked word by word with a carried state; many words, so that codes are long."""
    rng = np.random.default_rng(3)
    sizes = rng.integers(1, 60, 400)
    texts = [np.minimum(rng.zipf(1.2, n), 4_000) for n in sizes]
    chunk = Chunk(np.arange(4_001), np.concatenate([np.append([0, 0], t) for t in texts]), np.arange(400), sizes)
    pairs = list(zip((chunk.pairs >> BITS).tolist(), (chunk.pairs & (1 << BITS) - 1).tolist()))
    triples = [(*pairs[c], t & (1 << BITS) - 1) for c, t in zip(chunk.context_of.tolist(), chunk.triples.tolist())]
    one, two, three = collections.Counter(), collections.Counter(), collections.Counter()
    for t in (t.tolist() for t in texts[::2]):  # the others are held out
        one.update(t)
        two.update(zip(t, t[1:]))
        three.update(zip(t, t[1:], t[2:]))
    follow2, follow3 = collections.Counter(p[0] for p in two), collections.Counter(t[:2] for t in three)
    numbers = [np.array(x) for x in ([one[w] for w in range(4_001)], [follow2[w] for w in range(4_001)], [two[p] for p in pairs], [follow3[p] for p in pairs], [three[t] for t in triples])]
    model = Automaton(chunk, *numbers, sum(one.values()) + 0.5 * (len(one) + 1))
    got = np.add.reduceat(model.walk_all(chunk), np.cumsum(sizes) - sizes)
    assert np.allclose(got, [model.walk(0, t.tolist()) for t in texts], atol=1e-9)


def test_an_owner_keeps_its_memory_small():
    """An owner holds the blocks of its chunks once, not several times as longs."""
    import tracemalloc

    import pyarrow as pa

    from pagemill.llm.lm_automaton import answer
    rng = np.random.default_rng(5)
    n, blocks = 20_000, []
    for _ in range(20):
        first, second, third = np.sort(rng.integers(1, 5_000, n)), rng.integers(1, 5_000, n), rng.integers(1, 5_000, n)
        blocks.append(pack(np.diff(first, prepend=0), second, np.ones(n, np.int64), np.ones(n, np.int64), third, np.ones(n, np.int64)))
    table = pa.table({"owner": pa.array([0] * 20, pa.int64()), "chunk": pa.array(range(20), pa.int64()), "body": pa.array(blocks, pa.binary())})
    tracemalloc.start()
    got = answer(table)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(got) == 21 and sum(int(unpack(b, 3)[0].sum() > 0) for b in got.column("body").to_pylist()) == 21
    assert most < 150 * 20 * n, most / (20 * n)


def test_codes_and_orders():
    """Codes are numbered alike whether they are sorted with their places in one long or not; orders are stable."""
    from pagemill.llm.lm_automaton import in_order, numbered
    rng = np.random.default_rng(9)
    for codes in (rng.integers(0, 50, 400), rng.integers(0, 1 << 40, 400), rng.integers(-9, 9, 400), rng.integers(0, 1 << 62, 400), np.zeros(0, np.int64), np.array([7])):
        got, place = numbered(codes)
        assert got.tolist() == sorted(set(codes.tolist())) and (got[place] == codes).all()
    for most in (1, 9, 1 << 17, 1 << 40):
        x = rng.integers(0, most, 500)
        assert in_order(x).tolist() == np.argsort(x, kind="stable").tolist()


def test_words_have_keys_of_their_own():
    from pagemill.llm.lm_automaton import Vocabulary
    keys = Vocabulary([b"the", END], [9, 5], 14, 2).keys([b"x%d" % i for i in range(50_000)] + [b"the", END, "é".encode()])
    assert len(set(keys.tolist())) == 50_003 and (keys < 0).sum() == 50_001 and keys[-3:-1].tolist() == [1, 2]


def test_shuffles_go_when_their_rows_are_stored(spark):
    """The files of the shuffles behind a stored table do not wait for the driver's garbage collection."""
    import pathlib
    import time

    from pyspark.sql import functions as F

    from pagemill.session import durable
    tops = [pathlib.Path(d) for d in spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()]
    files = lambda: {f.name for top in tops for f in top.rglob("shuffle_*.data")}
    before = files()
    stored = durable(spark.range(1_000).repartition(3, "id").groupBy((F.col("id") % 7).alias("k")).count())
    ends = time.time() + 20
    while files() - before and time.time() < ends:
        time.sleep(0.2)
    assert not files() - before and stored.count() == 7
