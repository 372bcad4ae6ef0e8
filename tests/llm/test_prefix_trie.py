"""Trie statistics against brute force over all prefixes, and against SQL on the given tables."""

import hashlib
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pytest

from pagemill.llm import prefix_trie
from pagemill.llm.prefix_trie import DoubleArray, borrowed_beginnings, packed, sequences, trie_nodes
from pagemill.llm.queries import ORACLES, op11_prefix_trie
from tests.conftest import SF_DIR


def texts(rows):
    """Ordered ``(role, text)`` of every conversation."""
    out = defaultdict(list)
    sha = lambda r, t: hashlib.md5(f"{len(r.encode())}:{r}{t}".encode()).digest()
    for c, turn, role, text in rows:
        if c is not None:
            out[c].append(((turn is not None, turn or 0), role or "", sha(role or "", text or ""), text or ""))
    return {c: [(r, t) for _, r, _, t in sorted(v)] for c, v in out.items()}


def rebuilt(convs):
    out = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = convs.get(c - c % 5, [])[:h] + own[h:]
    return out


def brute(convs):
    members, ends = defaultdict(list), defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
        ends[tuple(turns)].append(c)
    children = defaultdict(list)
    for p in members:
        if p:
            children[p[:-1]].append(p)
    out = []
    for p, m in members.items():
        sub, leaves, saved = [p], 0, 0
        while sub:
            q = sub.pop()
            sub += children[q]
            leaves += not children[q]
            saved += (len(members[q]) - 1) * len(q[-1][1].encode()) if q else 0
        digest = hashlib.sha256(",".join(map(str, sorted(ends.get(p, [])))).encode()).hexdigest()
        out.append((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(children[p]), leaves, saved, digest))
    return sorted(out, key=str)


def odd_rows():
    rng = np.random.default_rng(11)
    rows = [(c, t, "user" if t % 2 == 0 else "assistant", f"é{rng.integers(0, 2)}" if t else "hello") for c in range(300) for t in range(int(rng.integers(1, 14)))]
    rows += [(1000 + c, t, "user", "same") for c in range(200) for t in range(12)]  # copies of one conversation, longer than a range's key
    rows += [(2000 + c, t, "user", f"deep {t}" if t < 30 else f"end {c}") for c in range(10) for t in range(31)]
    rows += [(5001, 0, "user", "no lender"), (5001, 1, "user", "x"), (6, None, None, None), (6, None, None, None), (7, 3, "user", ""), (7, 3, "user", ""), (None, 0, "user", "no id"),
             (9000, 0, "u", "long " * 50_000), (9001, 0, "a", "bc"), (9002, 0, "ab", "c"), (4, 2, "z", "tie"), (4, 2, "a", "tie"), (4, 2, "a", "tied")]
    return rows


@pytest.mark.parametrize("shard", [50, 200_000])
def test_against_brute_force(spark, monkeypatch, shard):
    monkeypatch.setattr(prefix_trie, "TURNS", shard)
    rows = odd_rows()
    df = spark.createDataFrame([(*r, b"x", 1) for r in rows], "conv_id long, turn long, role string, text string, key binary, depth int")
    for convs, found in ((texts(rows), sequences(df)), (rebuilt(texts(rows)), borrowed_beginnings(df))):
        got = trie_nodes(found)
        assert got.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
        assert sorted(map(tuple, got.collect()), key=str) == brute(convs)


def test_as_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{SF_DIR}/conversations.parquet')")
    cur = con.execute(ORACLES["op11_prefix_trie"])
    names = [d[0] for d in cur.description]
    got = op11_prefix_trie(spark, SF_DIR)
    assert sorted(map(str, map(tuple, got.select(names).collect()))) == sorted(str(tuple(r)) for r in cur.fetchall())


def test_double_array():
    rng = np.random.default_rng(3)
    paths = [rng.integers(0, 40, int(n)) for n in rng.integers(0, 12, 3000)] + [np.arange(500)] + [np.array([k]) for k in range(500)]
    trie = packed(paths)
    prefixes = {tuple(p[:d]) for p in paths for d in range(len(p) + 1)}
    states = set()
    for p in prefixes:
        s = np.zeros(1, np.int64)
        for c in p:
            s = trie.step(s, np.array([c]))
        assert s[0] >= 0
        states.add(int(s[0]))
    assert len(states) == len(prefixes) == (trie.check >= 0).sum()
    assert trie.step(np.zeros(1, np.int64), np.array([10_000]))[0] == -1 and DoubleArray().step(np.zeros(1, np.int64), np.array([3]))[0] == -1
    assert trie.top < 1.3 * len(prefixes)  # densely packed


def test_empty_table(spark):
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    got = trie_nodes(borrowed_beginnings(empty))
    assert got.count() == 0 and dict(got.dtypes) == {"conv_id": "bigint", "depth": "bigint", "parent_conv_id": "bigint", "n_convs": "bigint", "n_children": "bigint",
                                                     "n_leaves": "bigint", "saved_tokens": "bigint", "ends_sha256": "string"}
    only_nulls = spark.createDataFrame([(None, 1, "a", "b")], "conv_id long, turn long, role string, text string")
    assert trie_nodes(borrowed_beginnings(only_nulls)).count() == 0
