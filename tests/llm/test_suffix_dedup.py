"""Suffix order and removed bytes against brute force."""

import collections
import hashlib

import numpy as np
import pytest

from pagemill.llm import suffix_dedup
from pagemill.llm.induced_sort import Scratch, repeated_starts, suffix_order
from pagemill.llm.queries import op9_suffix_dedup
from pagemill.llm.suffix_dedup import cut_texts, remove_repeats
from tests.conftest import SF_DIR


def brute(texts, length):
    counts = collections.Counter(t[i:i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - length + 1):
            if counts[t[i:i + length]] > 1:
                gone[i:i + length] = True
        out.append((len(t), int(gone.sum()), int((np.diff(gone.astype(np.int8), prepend=0) == 1).sum()), bytes(np.frombuffer(t, np.uint8)[~gone])))
    return out


def test_suffix_order_and_starts():
    rng = np.random.default_rng(0)
    for _ in range(60):
        t = np.append(rng.integers(1, 4, rng.integers(1, 80)), 0).astype(np.uint16)
        assert np.concatenate(suffix_order(t, 100, Scratch(0))).tolist() == sorted(range(len(t)), key=lambda i: t.tolist()[i:])
        length = int(rng.integers(1, 14))
        bodies = [bytes(rng.integers(0, 3, rng.integers(0, 60)).astype(np.uint8)) for _ in range(6)]
        counts = collections.Counter(b[i:i + length] for b in bodies for i in range(len(b) - length + 1))
        assert [x.tolist() for x in repeated_starts(bodies, length)] == [[i for i in range(len(b) - length + 1) if counts[b[i:i + length]] > 1] for b in bodies]


def test_large_shards_use_files(monkeypatch):
    monkeypatch.setattr("pagemill.llm.induced_sort.MEMORY", 1)
    body = bytes(np.random.default_rng(1).integers(97, 105, 300_000).astype(np.uint8))
    got = repeated_starts([body, b"x" + body[1000:1400]], 200)
    assert got[0].tolist() == list(range(1000, 1201)) and got[1].tolist() == list(range(1, 202))


@pytest.mark.parametrize("length, shard", [(200, 1 << 20), (24, 2000)])
def test_texts_against_brute_force(spark, monkeypatch, length, shard):
    monkeypatch.setattr(suffix_dedup, "PIECE", 700)
    rng = np.random.default_rng(4)
    word = lambda n: " ".join("".join(rng.choice(list("abcdé"), 3)) for _ in range(n))
    shared, start = word(90), word(40)
    texts = [word(200) + shared + word(30), start + shared[20:], shared, word(400), word(400), None, "", "short", "aaaa" * 300, "abc" * 400, start + word(50), word(10) * 40]
    texts += [texts[3], texts[3][:500] + "!" + texts[3][500:], "é" * 500]
    docs = spark.createDataFrame([(i, t, "x", 0) for i, t in enumerate(texts)] + [(None, shared, "y", 0)], "doc_id long, text string, md5 string, n_removed int")
    got = sorted((r.doc_id if r.doc_id is not None else 99, (r.n, r.a, r.b, bytes(r.k))) for r in remove_repeats(docs, length=length, shard_bytes=shard).selectExpr(
        "doc_id", "octet_length(coalesce(text, '')) n", "__cut.n_removed a", "__cut.n_spans b", "__cut.kept k").collect())
    want = brute([(t or "").encode() for t in [*texts, shared]], length)
    assert got == list(zip([*range(len(texts)), 99], want))
    cut = {r.doc_id: r.text for r in cut_texts(docs, length=length).collect()}
    assert cut == {i: t if not w[1] else w[3].decode("utf-8", "ignore") for i, t, w in zip([*range(len(texts)), None], [*texts, shared], want)}
    assert cut_texts(docs).columns == docs.columns


def test_query(spark):
    rows = spark.read.parquet(f"{SF_DIR}/documents.parquet").orderBy("doc_id").collect()
    want = {r.doc_id: (n, a, b, hashlib.sha256(k).hexdigest()) for r, (n, a, b, k) in zip(rows, brute([(r.text or "").encode() for r in rows], 200))}
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in op9_suffix_dedup(spark, SF_DIR).collect()} == want


def test_empty_table(spark):
    assert remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_lone_runs_are_not_sorted(monkeypatch):
    """A run that no other run of its owner can share a window with needs no suffix order."""
    sorted_ = []
    monkeypatch.setattr(suffix_dedup, "repeated_starts", lambda bodies, length: sorted_.extend(bodies) or repeated_starts(bodies, length))
    rng = np.random.default_rng(6)
    text = bytes(rng.integers(97, 123, 5_000).astype(np.uint8))
    texts, held = [text, text, b"-" * 9 + text[:900], bytes(rng.integers(97, 123, 500).astype(np.uint8))], {}
    for numbers, firsts, lasts, owners in suffix_dedup.owned_runs(texts, 200):
        for k, a, b, owner in zip(numbers.tolist(), firsts.tolist(), lasts.tolist(), owners.tolist()):
            body = texts[k][a:b + 200]
            held.setdefault(hashlib.md5(body).digest(), [body, owner, 0])[2] += 1
    got = dict(suffix_dedup.spans_of(held, 200))
    assert len(sorted_) < len(held) / 4
    counts = collections.Counter(b[i:i + 200] for b, _, n in held.values() for i in range(len(b) - 199) for _ in range(min(n, 2)))
    assert {d: s.tolist() for d, s in got.items()} == {d: [i for i in range(len(b) - 199) if counts[b[i:i + 200]] > 1] for d, (b, _, _) in held.items()}


def test_texts_without_repeats_stay_in_the_engine(spark):
    """A very common passage is dealt over many tasks; texts that lose nothing do not go through Python."""
    rng = np.random.default_rng(7)
    word = lambda n: "".join(rng.choice(list("abcdefgh"), n))
    shared = word(220)
    texts = [word(20) + shared for _ in range(1_200)] + [word(300) for _ in range(20)]
    out = remove_repeats(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("cut_out(") == 1, plan
    got = sorted((r.doc_id, r.a, bytes(r.k)) for r in out.selectExpr("doc_id", "__cut.n_removed a", "__cut.kept k").collect())
    assert got == [(i, a, k) for i, (_, a, _, k) in enumerate(brute([t.encode() for t in texts], 200))]


def test_texts_are_cut_by_one_function(spark):
    """A task that cuts texts has one Python worker: characters that a cut splits go in the same step."""
    rng = np.random.default_rng(8)
    word = lambda n: "".join(rng.choice(list("abcdéü€"), n))
    shared = word(150)
    texts = [word(60) + shared + word(40), "é" + shared[1:], shared, word(300), None, ""]
    out = cut_texts(spark.createDataFrame([(i, t, len(t or "")) for i, t in enumerate(texts)], "doc_id long, text string, n_chars int"))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1, plan
    want = [(i, t if not gone else k.decode("utf-8", "ignore")) for i, (t, (_, gone, _, k)) in enumerate(zip(texts, brute([(t or "").encode() for t in texts], 200)))]
    assert sorted((r.doc_id, r.text) for r in out.collect()) == want and any(k != (t or "") for (_, k), t in zip(want, texts) if t)
