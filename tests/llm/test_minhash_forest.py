"""Classes against brute force over all pairs."""

import numpy as np
import pytest

from pagemill.llm import minhash_forest
from pagemill.llm.common import words
from pagemill.llm.components import components
from pagemill.llm.minhash_forest import classes, keep_one
from tests.conftest import SF_DIR


def brute(rows, width):
    sets = {}
    for i, t in rows:
        w = words((t or "").encode())
        sets[i] = {tuple(w[k:k + width]) for k in range(max(1, len(w) - width + 1))} if w else set()
    label = {i: i for i in sets}
    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and sets[a] and sets[b] and 100 * both >= 80 * len(sets[a] | sets[b]) and label[a] != label[b]:
                low, high = sorted((label[a], label[b]))
                label = {k: low if v == high else v for k, v in label.items()}
    return {i: (len(sets[i]), label[i], label[i] == i) for i in sets}


@pytest.mark.parametrize("width", [2, 5])
def test_corpus(spark, width):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    want = brute([(r.doc_id, r.text) for r in docs.collect()], width)
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in classes(docs, width).collect()} == want
    assert {r.doc_id for r in keep_one(docs, width).collect()} == {i for i, w in want.items() if w[2]}


@pytest.mark.parametrize("region", [2048, 24])
def test_large_group_and_odd_rows(spark, monkeypatch, region):
    monkeypatch.setattr(minhash_forest, "REGION", region)
    monkeypatch.setattr(minhash_forest, "OVERLAP", 4)
    rng = np.random.default_rng(3)
    base = [f"w{k}" for k in range(120)]
    rows = []
    for i in range(150):
        own = list(base)
        for k in rng.choice(120, rng.integers(0, 9), replace=False):
            own[k] = f"x{rng.integers(10**6)}"
        rows.append((1000 - i, " ".join(own)))
    rows += [(2000 + i, "the same text of some words again and again " * 3) for i in range(40)] + [(1, None), (2, ""), (3, " \n "), (4, "word"), (5, "Word"), (6, "other"), (7, "a b"), (8, "A  B")]
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, digest string, kept int")
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in classes(docs, 2).collect()}
    assert got == brute(rows, 2)
    assert keep_one(docs, 2).columns == docs.columns


def test_null_ids_and_empty_table(spark):
    rows = spark.createDataFrame([(None, "a b c"), (None, "none like it"), (1, "a b c"), (1, "d e f"), (2, "d e f")], "doc_id long, text string")
    got = sorted((str(r.doc_id), str(r.component_id), r.kept) for r in classes(rows, 2).collect())
    assert got == [("1", "1", True), ("1", "1", True), ("2", "1", False), ("None", "1", True), ("None", "None", True)]
    assert classes(rows.limit(0), 2).count() == 0


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(k, k + 1) for k in range(300)] + [(1000, 1001), (7, 7)], "a long, b long").repartition(7)
    got = {r.node: r.component for r in components(links).collect()}
    assert got == {k: 0 for k in range(301)} | {1000: 1000, 1001: 1000}


@pytest.mark.parametrize("region", [2048, 64])
def test_a_region_has_one_name_in_all_ranges(spark, monkeypatch, region):
    monkeypatch.setattr(minhash_forest, "REGION", region)
    rng = np.random.default_rng(5)
    rows = []
    for i in range(600):
        sig = rng.integers(0, 2**32, (minhash_forest.TREES, minhash_forest.DEPTH), np.uint32)
        sig[3, :minhash_forest.FIRST] = 7
        rows.append((i, 50, bytearray(sig.astype(">u4").tobytes())))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "60")
    try:
        found = minhash_forest.regions(spark.createDataFrame(rows, "id long, n long, sig binary")).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    prefix = f"{minhash_forest.LARGE}3:{'00000007' * minhash_forest.FIRST}"
    names = {r.region for r in found if r.region and r.region.startswith(prefix)}
    assert names == {prefix} and {r.id for r in found if r.region == prefix} == set(range(600))
