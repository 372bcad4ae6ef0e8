"""BPE encoding and decoding with a contiguous rank array.

Each text is cut into pre-tokens by the vocabulary's pattern; a pre-token's parts and the ranks between them lie in two short
lists, in which the lowest rank is found by scanning, its boundary deleted and its neighbours' ranks looked up again. Results
are kept per Python worker in a cache of bounded size. There is no shuffle and rows do not depend on one another.

Null texts count as empty; an empty text has no ids and decodes to the empty text. Repeated rows and repeated or null ids of
rows are kept as they come. The strings of special tokens inside a text are encoded as those tokens, as the library does by
default. Letters that Unicode added after the library's own tables were made may be cut differently.
"""

from __future__ import annotations

import hashlib
import itertools

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagemill.llm.merges import MergeTable, SegmentCache, per_worker

#: Fixed value: the pattern of the byte-level pre-tokenizer.
PRETOKENS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class Encoder:
    """Encodes whole texts into little-endian 32-bit ids."""

    def __init__(self, table: MergeTable):
        self.specials = table.specials
        self.segments = SegmentCache(regex.compile(PRETOKENS).findall, lambda words: table.encode_many([w.encode("utf-8") for w in words]), b"".join)
        self.special = regex.compile("(" + "|".join(map(regex.escape, sorted(table.specials, key=len, reverse=True))) + ")") if table.specials else None

    def __call__(self, texts: list[str]) -> list[bytes]:
        pieces, owner = [], []
        for text in texts:
            parts = self.special.split(text) if self.special is not None and self.special.search(text) else [text]
            owner.append(parts[1::2])
            pieces += parts[::2]
        coded = iter(map(b"".join, self.segments(pieces)))
        return [next(coded) + b"".join(self.specials[s].to_bytes(4, "little") + next(coded) for s in found) for found in owner]


def _lists(parts: list[bytes]) -> pa.Array:
    offsets = np.fromiter(itertools.accumulate((len(p) // 4 for p in parts), initial=0), np.int32, len(parts) + 1)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(parts), "<i4")))


def _ids_of(ids: pa.Array) -> list[np.ndarray]:
    ids = ids.fill_null([]) if ids.null_count else ids
    offsets, values = ids.offsets.to_numpy(), ids.values.to_numpy(zero_copy_only=False)
    return [values[a:b] for a, b in zip(offsets[:-1], offsets[1:])]


class Bpe:
    """Column functions for one vocabulary file, which the driver reads and sends to the executors (its size is fixed)."""

    def __init__(self, spark, path: str):
        self.shared = shared = spark.sparkContext.broadcast(MergeTable(path))

        @F.arrow_udf("array<int>")
        def encode(texts: pa.Array) -> pa.Array:
            encoder = per_worker(("encoder", path), lambda: Encoder(shared.value))
            return _lists(encoder([t or "" for t in texts.to_pylist()]))

        @F.arrow_udf("string")
        def decode(ids: pa.Array) -> pa.Array:
            token = shared.value.token_bytes.__getitem__
            return pa.array([b"".join(map(token, row.tolist())).decode("utf-8", "replace") for row in _ids_of(ids)], pa.string())

        self._encode, self._decode = encode, decode

    def encode(self, text: Column) -> Column:
        """Ids of a whole text, as array<int>."""
        return self._encode(text)

    def decode(self, ids: Column) -> Column:
        """The text of ids; bytes that are no UTF-8 become replacement characters, as in the library."""
        return self._decode(ids)


@F.arrow_udf(T.StringType())
def ids_digest(ids: pa.Array) -> pa.Array:
    """SHA-256 of the ids as little-endian unsigned 32-bit integers."""
    return pa.array([hashlib.sha256(row.astype("<u4").tobytes()).hexdigest() for row in _ids_of(ids)], pa.string())


class Decoder:
    """Texts of many rows of ids at once: each id is an element of one array of token bytes, and a row's elements are joined."""

    def __init__(self, table: MergeTable):
        self.tokens = pa.array([table.token_bytes.get(i, b"") for i in range(max(table.token_bytes) + 1)], pa.large_binary())

    def __call__(self, rows: list[bytes]) -> pa.Array:
        offsets = np.fromiter(itertools.accumulate((len(r) // 4 for r in rows), initial=0), np.int64, len(rows) + 1)
        taken = self.tokens.take(pa.array(np.frombuffer(b"".join(rows), "<u4")))
        texts = pc.binary_join(pa.LargeListArray.from_arrays(pa.array(offsets), taken), pa.scalar(b"", pa.large_binary()))
        try:
            return texts.cast(pa.large_string()).cast(pa.string())
        except pa.ArrowInvalid:  # bytes that are no UTF-8
            return pa.array([t.decode("utf-8", "replace") for t in texts.to_pylist()], pa.string())


def _coded(docs: DataFrame, path: str, doc_id: str, text: str, packed: bool) -> DataFrame:
    """Ids and decoded text in one step: chained column functions would encode a text once for each use of its ids."""
    shared = docs.sparkSession.sparkContext.broadcast(MergeTable(path))

    def run(batches):
        encoder, decoder = per_worker(("coder", path), lambda: (Encoder(shared.value), Decoder(shared.value)))
        for batch in batches:
            for a in range(0, batch.num_rows, 500):
                part = batch.slice(a, 500)
                rows = encoder([t or "" for t in part.column(1).to_pylist()])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(rows, pa.binary()) if packed else _lists(rows), decoder(rows)], ["doc_id", "ids", "decoded"])

    return docs.select(F.col(doc_id).cast("long"), F.col(text)).mapInArrow(run, f"doc_id long, ids {'binary' if packed else 'array<int>'}, decoded string")


def encode_documents(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, ids, decoded`` of every document: its token ids and the text read back from them."""
    return _coded(docs, path, doc_id, text, False)


def encode_packed(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """As :func:`encode_documents`, with the ids as little-endian unsigned 32-bit integers end to end."""
    return _coded(docs, path, doc_id, text, True)
