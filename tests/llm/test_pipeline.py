"""Each stage against a brute-force version on its own input, and the whole run."""

import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from pagemill.llm.quality import THRESHOLD, score_documents
from tests.conftest import SF_DIR
from tests.llm.test_decontam import brute as leaks
from tests.llm.test_minhash_forest import brute as near_classes
from tests.llm.test_suffix_dedup import brute as repeats


@pytest.fixture(scope="module")
def steps(spark, tmp_path_factory):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    out = [docs]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path_factory.mktemp("stages") / str(k))
        stage(spark, out[-1], SF_DIR).write.parquet(path)
        out.append(spark.read.parquet(path))
    return out


def rows(df):
    return {r.doc_id: r for r in df.collect()}


def test_stages(spark, steps):
    docs, good, single, cut, clean, coded = map(rows, steps)
    assert [s.columns for s in steps[1:-1]] == [steps[0].columns] * 4 and [s.schema["text"].dataType for s in steps[1:-1]] == [steps[0].schema["text"].dataType] * 4
    scores = {r.doc_id: r.score for r in score_documents(steps[0], spark.read.parquet(f"{SF_DIR}/labels.parquet")).collect()}
    assert set(good) == {i for i, s in scores.items() if s >= THRESHOLD} and all(good[i] == docs[i] for i in good) and len(good) < len(docs)
    assert set(single) == {i for i, c in near_classes([(i, r.text) for i, r in good.items()], 5).items() if c[2]} and len(single) < len(good)
    order = list(single)
    for i, (_, gone, _, kept) in zip(order, repeats([(single[i].text or "").encode() for i in order], 200)):
        assert cut[i].text == (kept.decode("utf-8", "ignore") if gone else single[i].text) and cut[i].n_chars == len(cut[i].text)
    assert set(cut) == set(single)
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF_DIR}/benchmark.parquet").collect()]
    dirty = {i for i, _ in leaks([(i, r.text) for i, r in cut.items()], items)}
    assert set(clean) == set(cut) - dirty
    lib = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert {i: (r.n_tokens, r.ids) for i, r in coded.items()} == {i: (len(ids), ids) for i, r in clean.items() for ids in [lib.encode(r.text or "", add_special_tokens=False).ids]}


def test_run_gives_what_the_stages_give(spark, steps):
    assert rows(corpus_pipeline.run(spark, SF_DIR)) == rows(steps[-1])


def test_odd_rows_and_empty_table(spark, tmp_path):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    odd = spark.createDataFrame([(None, None, None, None, None), (1, "", None, "s", 0), (1, "", None, "s", 0), (2, None, "en", None, None), (3, "x " * 60_000, "en", "s", 120_000)], docs.schema)
    for start in (odd, odd.limit(0)):
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            start = stage(spark, start, SF_DIR)
        assert start.columns == ["doc_id", "lang", "source", "n_tokens", "ids"]
        start.collect()
