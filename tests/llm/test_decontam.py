"""Overlaps against a brute-force alignment, and against SQL on the given tables."""

import re

import duckdb
import numpy as np

from pagemill.llm.decontam import contaminated, keep_clean, overlaps
from pagemill.llm.queries import ORACLES, op1_decontamination
from tests.conftest import SF_DIR


def toks(t):
    return re.findall(r"[^\W_]+", (t or "").lower())


def brute(docs, items):
    out = {}
    for i, d in docs:
        for j, b in items:
            d_, b_ = toks(d), toks(b)
            w = min(12, len(b_))
            if not b_ or i is None:
                continue
            percent = 80 if len(b_) >= 6 else 100  # short items as a whole only
            for diag in range(-len(b_), len(d_)):
                agree = [0 <= k + diag < len(d_) and d_[k + diag] == t for k, t in enumerate(b_)]
                best = max(sum(agree[s:s + w]) for s in range(len(b_) - w + 1))
                if best * 100 >= percent * w:
                    out[i, j] = max(out.get((i, j), (0, w)), (best, w))
    return out


def test_against_brute_force(spark):
    rng = np.random.default_rng(2)
    vocab = [f"w{k}" for k in range(60)]
    text = lambda n: " ".join(rng.choice(vocab, n))
    items = [(j, text(n)) for j, n in enumerate([30, 14, 12, 9, 7, 6, 5, 3, 25])] + [(50, None), (51, ""), (2, text(13)), (None, text(30)), (None, text(4)), (60, "zz"), (61, "qq")]
    docs = []
    for i in range(60):
        words = toks(items[i % 9][1])
        for k in rng.choice(len(words), min(len(words), i % 5), replace=False):
            words[k] = "zz"
        part = words[:rng.integers(4, len(words) + 1)] if i % 2 and len(words) > 4 else words
        docs.append((i, text(rng.integers(0, 20)) + ", " + "; ".join(part).upper() + "\n" + text(rng.integers(0, 20))))
    docs += [(110, "x " + items[-4][1] + " y"), (111, "x " + items[-3][1].upper() + "."), (112, items[6][1]), (113, "x, " + items[7][1] + "! y"), (100, None), (101, ""), (102, "zz " * 3000), (7, text(5)), (103, items[0][1]), (103, items[0][1]), (None, items[0][1])]
    d = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, key string")
    b = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): (r.n_agree, r.n_window) for r in contaminated(d, b).collect()}
    want = brute(docs, items)
    assert got == want and len(want) > 20
    assert {(110, None), (111, None), (112, 6), (113, 7)} <= set(want)
    con = duckdb.connect()
    for name, rows, key in (("documents", docs, "doc_id"), ("benchmark", items, "item_id")):
        con.execute(f"CREATE TABLE {name} ({key} BIGINT, text VARCHAR)")
        con.executemany(f"INSERT INTO {name} VALUES (?, ?)", rows)
    assert {(a, b): (k, w) for a, b, k, w in con.execute(ORACLES["op1_decontamination"]).fetchall()} == want
    kept = sorted(str(r.doc_id) for r in keep_clean(d, b).collect())
    dirty = {t for t in {t for _, t in docs} if brute([(0, t)], items)}
    assert kept == sorted(str(i) for i, t in docs if t not in dirty) and keep_clean(d, b).columns == d.columns


def test_as_sql(spark):
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{SF_DIR}/{name}.parquet')")
    want = con.execute(ORACLES["op1_decontamination"]).fetchall()
    got = [(r.doc_id, r.item_id, r.n_agree, r.n_window) for r in op1_decontamination(spark, SF_DIR).collect()]
    assert sorted(got) == sorted(want) and want


def test_empty_tables_and_no_python(spark):
    d = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    b = spark.read.parquet(f"{SF_DIR}/benchmark.parquet")
    assert contaminated(d.limit(0), b).count() == 0 and contaminated(d, b.limit(0)).count() == 0
    assert "Python" not in overlaps(d, b)._jdf.queryExecution().executedPlan().toString()
