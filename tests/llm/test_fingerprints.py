"""Edited texts exactly; resemblance, containment and counts against whole shingle sets."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from pagemill.llm.fingerprints import K, containment, distinct_shingles, fingerprints, merged, resemblance, with_sketch
from pagemill.llm.queries import op3_fingerprints
from tests.conftest import SF_DIR


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def likeness(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def expected(rows):
    rows = [(i, t or "") for i, t in rows]
    out = {}
    for k, (i, t) in enumerate(rows):
        nxt = rows[(k + 1) % len(rows)][1]
        half = len(t) // 2
        edited = t[:len(t) - half] + nxt[:half]
        out[i] = (len(t), edited, likeness(shingles(t), shingles(edited)), likeness(shingles(t), shingles(nxt)))
    return out


def test_corpus(spark):
    rows = spark.read.parquet(f"{SF_DIR}/documents.parquet").orderBy("doc_id").collect()
    want = expected([(r.doc_id, r.text) for r in rows])
    got = op3_fingerprints(spark, SF_DIR).collect()
    assert len(got) == len(want)
    error = 0
    for r in got:
        n, edited, near, nxt = want[r.doc_id]
        assert (r.n_chars, r.edited_sha256) == (n, hashlib.sha256(edited.encode()).hexdigest())
        assert abs(r.near_edited - near) < 0.25 and abs(r.near_next - nxt) < 0.25
        error += abs(r.near_edited - near)
    assert error / len(got) < 0.05
    texts = {r.doc_id: r.text for r in rows}
    assert len({r.fingerprint for r in got}) == len({frozenset(shingles(t)) for t in texts.values()})


@pytest.mark.parametrize("ids", [[5, 1, 9, 3, 2, 7], [10**12 * k for k in range(1, 7)], [1, 2, 3, 4, 5, None]])
def test_odd_rows(spark, ids):
    texts = ["one two three four five six seven", None, "", "é ü A b\x0bC d e f", "one two three four five six seven", "word " * 5000]
    rows = list(zip(ids, texts))
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, id string").repartition(3)
    want = expected(sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)))
    for r in fingerprints(df).collect():
        assert (r.n_chars, r.edited) == want[r.doc_id][:2]
        assert abs(r.near_edited - want[r.doc_id][2]) < 1e-9 and abs(r.near_next - want[r.doc_id][3]) < 1e-9


def test_repeated_ids_one_row_and_none(spark):
    df = spark.createDataFrame([(1, "a b"), (1, "a b"), (1, "c d")], "doc_id long, text string")
    assert sorted(r.edited for r in fingerprints(df).collect()) == ["a a", "a c", "c a"]
    assert [(r.edited, r.near_next) for r in fingerprints(df.limit(1)).collect()] == [("a a", 1.0)]
    assert fingerprints(df.limit(0)).count() == 0


def test_no_python_workers(spark):
    docs = spark.sql("SELECT IF(id = 20, NULL, id) AS doc_id, concat('text ', id) AS text FROM range(21)")
    got = fingerprints(docs)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "LocalRelation" in plan and "LogicalRDD" not in plan  # an RDD made of Python rows starts workers in the executors
    assert got.count() == 21


def test_estimates(spark):
    words = [f"w{k}" for k in range(4000)]
    df = spark.createDataFrame([(" ".join(words[:3000]), " ".join(words[1000:]))], "a string, b string")
    df = with_sketch(with_sketch(df, "a", "x"), "b", "y")
    r = df.select(resemblance(F.col("x"), F.col("y")).alias("r"), containment(F.col("x"), F.col("y")).alias("c"), distinct_shingles(F.col("x")).alias("n"),
                  distinct_shingles(merged(F.col("x"), F.col("y"))).alias("u"), F.size("x").alias("k")).first()
    assert r.k == K and abs(r.r - 0.5) < 0.15 and abs(r.c - 2 / 3) < 0.2 and abs(r.n - 2996) < 900 and abs(r.u - 3996) < 1200
