"""Encoding and counting agree with the public library, text by text."""

import hashlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from pagemill.llm.bpe import Decoder, encode_documents, encode_packed, ids_digest
from pagemill.llm.merges import MergeTable, merge, merge_long
from pagemill.llm.token_counts import count_tokens
from tests.conftest import SF_DIR

TEXTS = [None, "", " ", "\n\n  \t x", "a", "Hello world's  end", "naïve café ÀÉ ß ΑΣ Σ İ", "日本語のテキスト。", "😀😃 👩‍👩‍👧", "a\x00b\x1c\x1f\x85 c",
         "<|endoftext|>", "x<|endoftext|><|startoftext|> y <|end", "1234567890 12", "don't we'll I'M", "a" * 5000, "ab" * 700 + " !" * 300, "é" * 40,
         " 　 end", "The the THE", "x" * 20 + "\n" * 50]


@pytest.fixture(scope="module")
def texts(spark):
    own = [(i, t, "clash") for i, t in enumerate(TEXTS)] + [(1, "a", "repeated"), (1, "a", "repeated"), (None, "b", "no id")]
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").limit(60).collect()
    own += [(1000 + r.doc_id, r.text, "corpus") for r in docs]
    return spark.createDataFrame(own, "doc_id long, text string, n_tokens string"), own


def test_ids_and_text_as_the_library(texts):
    df, own = texts
    lib = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    coded = encode_documents(df, public_tokenizers.path("byte_bpe_50k.json")).withColumn("digest", ids_digest("ids")).collect()
    want = []
    for i, t, _ in own:
        ids = lib.encode(t or "", add_special_tokens=False).ids
        want.append((i, ids, lib.decode(ids, skip_special_tokens=False), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()))
    key = lambda r: (r[0] is None, r[0] or 0, str(r[1]))
    assert sorted([tuple(r) for r in coded], key=key) == sorted(want, key=key)


def test_packed_ids(texts):
    df, own = texts
    path = public_tokenizers.path("byte_bpe_50k.json")
    lists = sorted((str(r.doc_id), r.decoded, list(r.ids)) for r in encode_documents(df, path).collect())
    assert sorted((str(r.doc_id), r.decoded, np.frombuffer(r.ids, "<u4").tolist()) for r in encode_packed(df, path).collect()) == lists


def test_bytes_that_are_no_text():
    table = MergeTable(public_tokenizers.path("byte_bpe_50k.json"))
    lib = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = [[], [table.first[0xC3]], [table.first[0xC3], table.first[0xA9], 50256], [table.first[0xFF], table.first[0x41], table.first[0xE6]]]
    got = Decoder(table)([np.array(r, "<u4").tobytes() for r in rows]).to_pylist()
    assert got == [lib.decode(r, skip_special_tokens=False) for r in rows]


def test_long_words_by_scan_and_heap_and_library():
    table = MergeTable(public_tokenizers.path("byte_bpe_50k.json"))
    lib = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rng = np.random.default_rng(9)
    for n in rng.integers(257, 1500, 25).tolist():
        word = bytes(rng.choice(list(b"theandingo"), n).tolist())
        ids = [table.first[b] for b in word]
        assert merge(list(ids), table.pairs) == merge_long(list(ids), table.pairs) == lib.encode(word.decode(), add_special_tokens=False).ids


def test_counts_as_the_library(texts):
    df, own = texts
    lib = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    got = count_tokens(df, public_tokenizers.path("word_bpe_49k.json"), limit=50).collect()
    want = [(i, len((t or "").encode()), n := len(lib.encode(t or "", add_special_tokens=False).ids), n > 50) for i, t, _ in own]
    key = lambda r: (r[0] is None, r[0] or 0, r[1:])
    assert sorted([tuple(r) for r in got], key=key) == sorted(want, key=key)


def test_empty_table(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert encode_documents(none, public_tokenizers.path("byte_bpe_50k.json")).count() == 0
    assert count_tokens(none, public_tokenizers.path("word_bpe_49k.json")).count() == 0


def test_scan_and_heap_merge_alike():
    table = MergeTable(public_tokenizers.path("byte_bpe_50k.json"))
    rng = np.random.default_rng(5)
    for _ in range(200):
        word = bytes(rng.choice(list(b"theanding "), rng.integers(1, 60)).tolist())
        ids = [table.first[b] for b in word]
        assert merge(list(ids), table.pairs) == merge_long(list(ids), table.pairs)


def test_many_words_as_one_by_one():
    table = MergeTable(public_tokenizers.path("word_bpe_49k.json"))
    rng = np.random.default_rng(7)
    words = [bytes(rng.choice(list(b"theanding.'1\xc3\xa9"), rng.integers(0, 40)).tolist()) for _ in range(3000)]
    assert [np.frombuffer(x, "<u4").tolist() for x in table.encode_many(words)] == [table.encode(w) for w in words]
