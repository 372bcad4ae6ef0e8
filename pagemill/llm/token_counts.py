"""Token counts with a whole-token shortcut.

Before the job starts, every vocabulary string that ends a word is merged on its own; those that end as one token are proven
whole. A document's pre-tokens that are proven count one each without being merged; only the rest are, with a cache of
bounded size in each Python worker. Map-only: no shuffle, rows do not depend on one another.

Null texts count as empty, and an empty text has no tokens. Strings of special tokens inside a text count as one token each.
Repeated rows are kept. Letters that Unicode added after the library's own tables were made may be cut differently.
"""

from __future__ import annotations

import unicodedata

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.llm.merges import MergeTable, SegmentCache, per_worker

#: Fixed value: the pattern of the word-level pre-tokenizer.
PRETOKENS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def whole_tokens(table: MergeTable) -> set[str]:
    """Vocabulary strings that encode, alone, as one token."""
    whole = set()
    for i in table.ends_word:
        word = table.token_bytes[i]
        if word and table.encode(word) == [i]:
            try:
                whole.add(word.decode("utf-8"))
            except UnicodeDecodeError:
                pass  # part of a character: never a pre-token
    return whole


class Counter:
    """Tokens of whole texts; only words that are not proven whole are merged."""

    def __init__(self, table: MergeTable, whole: set[str]):
        def count(words: list[str]) -> list[int]:
            rest = [w for w in words if w not in whole]
            merged = dict(zip(rest, table.encode_many([w.encode("utf-8") for w in rest])))
            return [len(merged[w]) // 4 if w in merged else 1 for w in words]

        self.segments = SegmentCache(regex.compile(PRETOKENS).findall, count, sum)
        self.special = regex.compile("|".join(map(regex.escape, table.specials))) if table.specials else None

    def __call__(self, texts: list[str]) -> list[int]:
        pieces = [self.special.split(t) if self.special is not None and self.special.search(t) else [t] for t in texts]
        # The library lower-cases letter by letter, without the rule for a sigma at the end of a word.
        plain = [unicodedata.normalize("NFC", p).replace("Σ", "σ").lower() for ps in pieces for p in ps]
        counts = iter(map(sum, self.segments(plain)))
        return [len(ps) - 1 + sum(next(counts) for _ in ps) for ps in pieces]


def count_tokens(docs: DataFrame, path: str, limit: int = 2048, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` of every document."""
    table = MergeTable(path)
    shared = docs.sparkSession.sparkContext.broadcast((table, whole_tokens(table)))

    @F.arrow_udf("bigint")
    def n_tokens(texts: pa.Array) -> pa.Array:
        counter = per_worker(("counter", path), lambda: Counter(*shared.value))
        return pa.array(counter([t or "" for t in texts.to_pylist()]), pa.int64())

    whole = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    counted = whole.select("doc_id", F.octet_length("text").cast("bigint").alias("n_bytes"), n_tokens("text").alias("n_tokens"))
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
