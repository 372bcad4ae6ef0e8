"""Held-out accuracy on the given labels, and odd inputs."""

import numpy as np
import pytest

from pagemill.llm import quality
from pagemill.llm.queries import op2_quality
from pagemill.llm.quality import keep_good, score_documents

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    got = op2_quality(spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").where("held_out").collect()
    assert len(got) > 40 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    right = sum(r.predicted == r.quality for r in got) / len(got)
    low = [r.score for r in got if r.quality == 0]
    high = [r.score for r in got if r.quality == 1]
    print(right, sum(low) / len(low), sum(high) / len(high))
    assert right >= 0.85 and sum(low) / len(low) + 0.3 < sum(high) / len(high)


def test_odd_rows(spark):
    rows = [(i, "good words here. " * 5 if i % 2 else "BAD!! $$$ " * 9, i % 2) for i in range(60)]
    docs = spark.createDataFrame([(i, t, "x", 0.0) for i, t, _ in rows] + [(100, None, "x", 0.0), (101, "", "x", 0.0), (None, "no id", "x", 0.0), (3, "again", "x", 0.0),
                                                                          (102, "long " * 200_000, "x", 0.0)], "doc_id long, text string, label string, score double")
    labels = spark.createDataFrame([(i, q, 0) for i, _, q in rows] + [(5, 0, 0), (5, 1, 0), (None, 1, 0), (7, None, 0), (999, 1, 0)], "doc_id long, quality int, toxic int")
    got = score_documents(docs, labels).collect()
    assert len(got) == 65 and all(r.score is not None and 0 <= r.score <= 1 for r in got)
    assert score_documents(docs, labels).collect() == got
    assert sorted(keep_good(docs, labels).columns) == sorted(docs.columns)


@pytest.mark.parametrize("labels, expected", [([], 0.5), ([(1, 1, 0), (2, 1, 0)], 1.0)])
def test_one_kind_of_label_or_none(spark, labels, expected):
    docs = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "doc_id long, text string")
    got = score_documents(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    assert {r.score for r in got} == {expected}
    assert score_documents(docs.limit(0), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).count() == 0


def test_long_texts_need_little_memory():
    """The context vectors of a long text are added up part by part, with the sums of the whole text."""
    import tracemalloc
    found = ["w%d" % (k * k % 397) for k in range(30_000)]
    row = {w: i for i, w in enumerate([*dict.fromkeys(found[:300]), *quality.SHAPES])}
    want = np.zeros((len(row), quality.DIM), np.int64)
    index = np.array([quality.index_vector(w) for w in found])
    padded = np.concatenate([np.zeros((quality.WINDOW, quality.DIM), np.int64), index, np.zeros((quality.WINDOW, quality.DIM), np.int64)])
    around = sum(padded[k:k + len(found)] for k in range(2 * quality.WINDOW + 1))
    for k, w in enumerate(found):
        if w in row:
            want[row[w]] += around[k]
        want[row[quality.shape(w)]] += around[k]
    for size in (1, 2, 5, 301, 5_000):
        total = np.zeros_like(want)
        quality.add_vectors(total, row, found[:size])
        assert total.any() and (size > 2 or (total[row[found[0]]] == index[:size].sum(axis=0)).all())
    total = np.zeros_like(want)
    tracemalloc.start()
    quality.add_vectors(total, row, found)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert (total == want).all() and most < 12 << 20, most
