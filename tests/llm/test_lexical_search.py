"""Rankings against brute force, and against SQL on the given tables."""

import math
import re

import duckdb
import numpy as np
import pytest

from pagemill.llm import lexical_search
from pagemill.llm.lexical_search import ImpactLists, search, terms
from pagemill.llm.queries import ORACLES, op12_lexical_search
from tests.conftest import SF_DIR

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def cut(t):
    return [re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in TERM.findall(t or "")]


def brute(docs, items, k=50):
    texts = [(i, cut(t)) for i, t in docs]
    N, L = sum(bool(t) for _, t in texts), sum(len(t) for _, t in texts)
    df = {}
    for _, t in texts:
        for x in set(t):
            df[x] = df.get(x, 0) + 1
    out = []
    for item, text in sorted(set(items), key=str):
        scored = []
        for i, t in texts:
            if t:
                m = 100 - 50 + (50 * len(t) * N) // L
                s = sum(math.floor(1000 * math.log((2 * N + 2) / (2 * df[x] + 1))) * ((1000000000 * t.count(x)) // (1000 * t.count(x) + 20 * m)) for x in set(cut(text)) if x in t)
                if s > 0:
                    scored.append((-s, i is not None, i or 0, i))
        out += [(item, r, i, -s) for r, (s, _, _, i) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=str)


def tables(rng, n=400):
    vocab = [f"w{k}" for k in range(80)] + ["É", "日本", "Zz", "a1"]
    share = 1 / np.arange(1, len(vocab) + 1)
    text = lambda n: "-".join(rng.choice(vocab, n, p=share / share.sum()))
    docs = [(k, text(int(rng.integers(0, 40)))) for k in range(n)] + [(1000 + k, "copy of w1 w40, W41!") for k in range(150)]
    docs += [(2000, None), (2001, ""), (2002, " .,\t"), (2003, "w3 " * 50_000), (5, "w70 w71"), (5, "w70 w71"), (None, "w70 w71"), (2004, "É É é")]
    items = [(k, text(int(rng.integers(1, 30)))) for k in range(25)] + [(30, None), (31, ""), (32, "nowhere"), (33, "w1 w40 w41"), (33, "w1 w40 w41"), (33, "w70 w71"), (None, "É"), (34, "日本, zz ZZ")]
    return docs, items


@pytest.mark.parametrize("shard, first, block", [(1 << 24, 16, 1 << 22), (600, 1, 300)])
def test_against_brute_force(spark, monkeypatch, shard, first, block):
    for name, value in (("SHARD_BYTES", shard), ("FIRST_READ", first), ("BLOCK_BYTES", block), ("WAVE", 4)):
        monkeypatch.setattr(lexical_search, name, value)
    docs, items = tables(np.random.default_rng(12))
    d = spark.createDataFrame([(i, t, 1, "x") for i, t in docs], "doc_id long, text string, shard int, item string")
    b = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, rank int")
    got = search(d, b)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, got.collect()), key=str) == brute(docs, items)


def test_stops_early_and_strictly_below(monkeypatch):
    rng = np.random.default_rng(5)
    n = 20_000
    lengths = np.full(n, 100)
    codes, places, counts = [], [], []
    for c in range(4):
        own = np.sort(rng.choice(n, 8000, replace=False))
        codes.append(np.full(len(own), c)), places.append(own), counts.append(rng.zipf(2.0, len(own)).clip(1, 60))
    lists = ImpactLists(lengths, np.concatenate(codes), np.concatenate(places), np.concatenate(counts), np.array([900, 700, 500, 300]), n, 100 * n)
    exact = np.bincount(lists.docs, weights=lists.impacts, minlength=n).astype(np.int64)
    docs, scores = lists.best(np.arange(4), 50, 0)
    least = np.sort(exact)[-50]
    assert set(np.flatnonzero(exact >= least)) <= set(docs.tolist()) and (exact[docs] == scores).all()  # every tie of the last rank is there
    reads = []
    unique = np.unique
    monkeypatch.setattr(lexical_search.np, "unique", lambda x, *a, **b: reads.append(len(x)) or unique(x, *a, **b))
    lists.best(np.arange(4), 50, 0)
    assert sum(reads) < 16_000  # less than half of the entries
    full = sum(reads)
    reads.clear()
    lists.best(np.arange(4), 50, int(exact.max()))
    assert sum(reads) < full


def test_as_sql(spark):
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{SF_DIR}/{name}.parquet')")
    want = con.execute(ORACLES["op12_lexical_search"]).fetchall()
    got = [(r.item_id, r.rank, r.doc_id, r.score) for r in op12_lexical_search(spark, SF_DIR).collect()]
    assert sorted(got) == sorted(want) and len(got) > 100


def test_terms():
    text = "Ab-cÉ9 \x7fx\x80y_z Q"
    assert [t.decode() for t in terms(text)] == cut(text) and terms(None) == []


def test_empty_tables(spark):
    d, b = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    one = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    for x, y in ((d, b), (d, one.withColumnRenamed("doc_id", "item_id")), (one, b)):
        got = search(x, y)
        assert got.count() == 0 and dict(got.dtypes) == {"item_id": "bigint", "rank": "int", "doc_id": "bigint", "score": "bigint"}
