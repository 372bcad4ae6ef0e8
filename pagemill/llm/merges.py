"""Merge tables of public BPE vocabulary files, and the merging of one pre-token."""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa

ID_BITS = 20
ID_MASK = (1 << ID_BITS) - 1
NO_RANK = 1 << 62
SHORT = 32  # bytes; words up to this length are merged together, row by row of a matrix
LONG = 256  # parts; longer words are merged with a heap instead of repeated scans, with the same result


def byte_letters() -> list[str]:
    """The printable stand-in of each byte: visible Latin-1 characters stand for themselves, the rest follow from 256 on."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(rest)) for b in range(256)]


class MergeTable:
    """What a vocabulary file says, in the form the encoder needs.

    ``pairs`` maps two adjacent ids (packed into one integer) to rank and merged id (packed likewise), so the smallest
    value is the merge to make first and also names its result.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab: dict[str, int] = model["vocab"]
        self.ending = model.get("end_of_word_suffix") or ""
        letters = byte_letters()
        self.first = [vocab[c] for c in letters]
        self.last = [vocab[c + self.ending] for c in letters]
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.pairs = {}
        for rank, (a, b) in enumerate(model["merges"]):
            self.pairs.setdefault(vocab[a] << ID_BITS | vocab[b], rank << ID_BITS | vocab[a + b])
        self._index_pairs()
        back = {c: b for b, c in enumerate(letters)}
        #: Bytes of each id and whether the id ends a word.
        self.token_bytes: dict[int, bytes] = {}
        self.ends_word: set[int] = set()
        for token, i in vocab.items():
            if self.ending and token.endswith(self.ending):
                self.ends_word.add(i)
                token = token[:-len(self.ending)]
            self.token_bytes[i] = bytes(back[c] for c in token)
        for token, i in self.specials.items():
            self.token_bytes[i] = token.encode("utf-8")

    def _index_pairs(self) -> None:
        """The pairs in arrays, found by hash with open addressing."""
        self.bits = max(8, (4 * len(self.pairs)).bit_length())
        self.keys, self.values = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, NO_RANK, np.int64)
        packed = np.array(list(self.pairs), np.int64)
        for slot, key in zip(self._slots(packed).tolist(), self.pairs):
            while self.keys[slot] >= 0:
                slot = (slot + 1) & (1 << self.bits) - 1
            self.keys[slot], self.values[slot] = key, self.pairs[key]

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).astype(np.int64)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Packed rank and result of each pair."""
        keys = left << ID_BITS | right
        slots = self._slots(keys)
        out = self.values[slots]
        open_ = np.flatnonzero((self.keys[slots] != keys) & (self.keys[slots] >= 0))
        out[self.keys[slots] != keys] = NO_RANK
        while len(open_):
            slots[open_] = (slots[open_] + 1) & (1 << self.bits) - 1
            at = self.keys[slots[open_]]
            hit = at == keys[open_]
            out[open_[hit]] = self.values[slots[open_[hit]]]
            open_ = open_[~hit & (at >= 0)]
        return out

    def encode(self, word: bytes) -> list[int]:
        """Ids of one pre-token."""
        if not word:
            return []
        ids = [self.first[b] for b in word[:-1]]
        ids.append(self.last[word[-1]])
        return merge(ids, self.pairs) if len(ids) <= LONG else merge_long(ids, self.pairs)

    def encode_many(self, words: list[bytes]) -> list[bytes]:
        """Ids of many pre-tokens as little-endian 32-bit integers; short words of one length are merged together."""
        out: list[bytes] = [b""] * len(words)
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        first, last = np.array(self.first, np.int64), np.array(self.last, np.int64)
        for n in np.unique(lengths).tolist():
            where = np.flatnonzero(lengths == n)
            if not n:
                continue
            if n > SHORT or len(where) < 8:
                for k in where.tolist():
                    out[k] = np.array(self.encode(words[k]), "<u4").tobytes()
                continue
            letters = np.frombuffer(b"".join([words[k] for k in where.tolist()]), np.uint8).reshape(-1, n)
            ids = first[letters]
            ids[:, -1] = last[letters[:, -1]]
            for rows, parts in self._merge_rows(ids):
                coded = parts.astype("<u4").tobytes()
                width = 4 * parts.shape[1]
                for at, k in enumerate(where[rows].tolist()):
                    out[k] = coded[at * width:(at + 1) * width]
        return out

    def _merge_rows(self, ids: np.ndarray):
        """Row numbers and ids of finished words. All rows have the same number of parts: each round deletes one boundary of each."""
        rows = np.arange(len(ids))
        ranks = self.ranks(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(len(ids), -1)
        while len(rows):
            if not ranks.shape[1]:
                yield rows, ids
                return
            at = ranks.argmin(axis=1)
            low = ranks[np.arange(len(rows)), at]
            done = low == NO_RANK
            if done.any():
                yield rows[done], ids[done]
                rows, ids, ranks, at, low = rows[~done], ids[~done], ranks[~done], at[~done], low[~done]
            if not len(rows):
                return
            k = np.arange(len(rows))
            stay = np.ones(ids.shape, bool)
            stay[k, at + 1] = False
            ids[k, at] = low & ID_MASK
            ids = ids[stay].reshape(len(rows), -1)
            ranks = ranks[stay[:, 1:]].reshape(len(rows), -1)
            left, right = np.flatnonzero(at > 0), np.flatnonzero(at < ranks.shape[1])
            ranks[left, at[left] - 1] = self.ranks(ids[left, at[left] - 1], ids[left, at[left]])
            ranks[right, at[right]] = self.ranks(ids[right, at[right]], ids[right, at[right] + 1])


def merge(ids: list[int], pairs: dict[int, int]) -> list[int]:
    """Contiguous rank array: the parts and the ranks between them lie in two short lists.

    The lowest rank is found by scanning, its boundary is deleted, and the ranks on either side are looked up again.
    """
    ranks = [pairs.get(a << ID_BITS | b, NO_RANK) for a, b in zip(ids, ids[1:])]
    while ranks:
        low = min(ranks)
        if low == NO_RANK:
            break
        i = ranks.index(low)
        del ranks[i], ids[i + 1]
        ids[i] = low & ID_MASK
        if i:
            ranks[i - 1] = pairs.get(ids[i - 1] << ID_BITS | ids[i], NO_RANK)
        if i < len(ranks):
            ranks[i] = pairs.get(ids[i] << ID_BITS | ids[i + 1], NO_RANK)
    return ids


def merge_long(ids: list[int], pairs: dict[int, int]) -> list[int]:
    """The same merges in n log n steps, for words whose scans would be quadratic."""
    n = len(ids)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))

    def rank(i: int) -> int:
        j = after[i]
        return pairs.get(ids[i] << ID_BITS | ids[j], NO_RANK) if j < n else NO_RANK

    heap = [(r, i) for i in range(n) if (r := rank(i)) != NO_RANK]
    heapq.heapify(heap)
    while heap:
        low, i = heapq.heappop(heap)
        if ids[i] < 0 or rank(i) != low:
            continue  # the pair is gone
        j = after[i]
        ids[i], ids[j] = low & ID_MASK, -1
        after[i] = after[j]
        if after[i] < n:
            before[after[i]] = i
        for k in (before[i], i):
            if k >= 0 and (r := rank(k)) != NO_RANK:
                heapq.heappush(heap, (r, k))
    return [i for i in ids if i >= 0]


class WordCache(dict):
    """Results by word; emptied when full, so that a worker's memory stays bounded whatever the vocabulary of the texts."""

    def __init__(self, compute, size: int = 100_000, longest: int = 64):
        super().__init__()
        self.compute, self.size, self.longest = compute, size, longest

    def __missing__(self, word):
        value = self.compute(word)
        if len(word) <= self.longest:
            if len(self) >= self.size:
                self.clear()
            self[word] = value
        return value


_loose_blank = re.compile(r" (?=\s|\Z)").search


def segments(text: str) -> list[str]:
    """``text`` cut before every blank that a character other than white space follows: there a pre-token starts in any case.

    The blank is left out, so a segment stands for a blank and itself; the first one has no blank and is marked by one.
    """
    pieces = text.split(" ")
    pieces[0] = " " + pieces[0]
    if not _loose_blank(text):
        return pieces
    out = pieces[:1]
    for p in pieces[1:]:
        if not p or p[0].isspace():
            out[-1] += " " + p
        else:
            out.append(p)
    return out


def spelled(segment: str) -> str:
    """The characters that a segment stands for."""
    return segment[1:] if segment[0] == " " else " " + segment


class SegmentCache:
    """What each segment comes to, kept per worker in bounded dictionaries; new words of a group of texts are merged together."""

    def __init__(self, cut: Callable[[str], list[str]], merge_words: Callable[[list[str]], list], total: Callable[[list], object], size: int = 100_000):
        self.cut, self.merge_words, self.total, self.size = cut, merge_words, total, size
        self.segments: dict[str, object] = {}
        self.words: dict[str, object] = {}

    def __call__(self, texts: list[str]) -> list[list]:
        """The results of the segments of each text."""
        out, group, chars = [], [], 0
        for text in texts:
            group.append(text)
            chars += len(text)
            if chars > 1_000_000:
                out += self._group(group)
                group, chars = [], 0
        return out + self._group(group)

    def _group(self, texts: list[str]) -> list[list]:
        cut_texts = [segments(t) for t in texts]
        if len(self.segments) > self.size:
            self.segments = {}
        if len(self.words) > self.size:
            self.words = {}
        known = self.segments
        fresh = {s: self.cut(spelled(s)) for s in set().union(*cut_texts) if s not in known}
        words = list({w for ws in fresh.values() for w in ws if w not in self.words})
        self.words.update(zip(words, self.merge_words(words)))
        word = self.words.__getitem__
        known.update((s, self.total(list(map(word, ws)))) for s, ws in fresh.items())
        return [list(map(known.__getitem__, t)) for t in cut_texts]


_PER_WORKER: list = []


def forget() -> None:
    """Let go of what an earlier job keeps in this worker, and of the memory that Arrow keeps for later."""
    _PER_WORKER.clear()
    pa.default_memory_pool().release_unused()


def per_worker(key, build):
    """An object kept in this Python worker between batches and tasks; a worker keeps one, so that memory does not add up over jobs."""
    if not _PER_WORKER or _PER_WORKER[0] != key:
        _PER_WORKER.clear()
        _PER_WORKER.extend((key, build()))
    return _PER_WORKER[1]
