"""External induced sorting of the suffixes of one shard, to a bounded depth.

Suffixes wait in one queue for each leading character; the queues, taken in the order of characters, are the priority queue of
induction: what is taken from one places the suffixes before it behind in their own queues. Whole batches move at once, and
queues, like all arrays of the shard, go to files in the task's scratch folder once the shard is larger than ``MEMORY``.

Suffixes that begin at a valley of the text (a smaller character before, hence "LMS") are named by one round of induction. Their
order is then refined by doubling over the names, up to ``depth`` characters, and a second round induces all other suffixes.
"""

from __future__ import annotations

import tempfile

import numpy as np

MEMORY = 1 << 26
SEPARATOR, FIRST_BYTE = 1, 2


class Scratch:
    """Arrays in memory, or in files of a folder that goes with the task, by the size of the shard."""

    def __init__(self, size: int):
        self.folder = tempfile.TemporaryDirectory(prefix="shard-") if size > MEMORY else None

    def keep(self, a: np.ndarray) -> np.ndarray:
        if self.folder is None or a.nbytes < 1 << 20:
            return a
        f = tempfile.TemporaryFile(dir=self.folder.name)
        a.tofile(f)
        return np.memmap(f, a.dtype, "r+", shape=a.shape)

    def close(self) -> None:
        if self.folder is not None:
            self.folder.cleanup()


class Queues:
    """One queue of suffix positions for each leading character, in the order in which they came."""

    def __init__(self, n: int, scratch: Scratch):
        self.parts: list[list[np.ndarray]] = [[] for _ in range(n)]
        self.scratch = scratch

    def put(self, letters: np.ndarray, positions: np.ndarray) -> None:
        if not len(positions):
            return
        order = np.argsort(letters, kind="stable")
        letters, positions = letters[order], positions[order]
        starts = np.flatnonzero(np.diff(letters.astype(np.int32), prepend=-1))
        for a, b in zip(starts, [*starts[1:], len(letters)]):
            self.parts[letters[a]].append(self.scratch.keep(positions[a:b]))

    def take(self, letter: int) -> np.ndarray:
        parts, self.parts[letter] = self.parts[letter], []
        return np.concatenate(parts) if parts else np.zeros(0, np.int64)


def slopes(text: np.ndarray) -> np.ndarray:
    """True where a suffix is larger than the one after it ("L"); the last character counts as the smallest suffix."""
    differs = np.flatnonzero(np.append(text[:-1] != text[1:], True))
    falls = np.append(text[:-1] > text[1:], False)
    return np.repeat(falls[differs], np.diff(differs, prepend=-1))


def induce(text: np.ndarray, falling: np.ndarray, valleys: np.ndarray, alphabet: int, scratch: Scratch) -> list[np.ndarray]:
    """All suffixes in order, by leading character, from the order of the valleys."""
    seeds = Queues(alphabet, scratch)
    seeds.put(text[valleys], valleys)
    up, down = Queues(alphabet, scratch), Queues(alphabet, scratch)
    falling_in_order: list[np.ndarray] = []
    for c in range(alphabet):
        done, batch = [], up.take(c)
        while len(batch):
            done.append(batch)
            before = batch[batch > 0] - 1
            letters = text[before]
            fits = falling[before]
            up.put(letters[fits & (letters != c)], before[fits & (letters != c)])
            batch = before[fits & (letters == c)]
        seed = seeds.take(c)
        before = seed[seed > 0] - 1
        up.put(text[before], before)
        falling_in_order.append(scratch.keep(np.concatenate(done)) if done else np.zeros(0, np.int64))
    out: list[np.ndarray] = [np.zeros(0, np.int64)] * alphabet
    for c in range(alphabet - 1, -1, -1):
        done, batch = [], down.take(c)
        while len(batch):
            done.append(batch)
            before = batch[batch > 0] - 1
            letters = text[before]
            fits = ~falling[before]
            down.put(letters[fits & (letters != c)], before[fits & (letters != c)])
            batch = before[fits & (letters == c)]
        last = falling_in_order[c][::-1]
        before = last[last > 0] - 1
        before = before[~falling[before]]
        down.put(text[before], before)
        out[c] = scratch.keep(np.concatenate([falling_in_order[c], *(d[::-1] for d in reversed(done))]))
    # The last character is the smallest suffix of all and is placed by no other.
    out[text[-1]] = np.concatenate([[len(text) - 1], out[text[-1]]])
    return out


def order_of_valleys(text: np.ndarray, falling: np.ndarray, valleys: np.ndarray, alphabet: int, depth: int, scratch: Scratch) -> np.ndarray:
    """The valleys in the order of their suffixes, compared for at least ``depth`` characters."""
    if len(valleys) < 2:
        return valleys
    is_valley = np.zeros(len(text), bool)
    is_valley[valleys] = True
    found = np.concatenate([p[is_valley[p]] for p in induce(text, falling, valleys, alphabet, scratch)])
    at = np.searchsorted(valleys, found)
    length = np.append(np.diff(valleys), 0)[at] + 1
    new = length[1:] != length[:-1]
    open_ = np.flatnonzero(~new)
    k = 0
    while len(open_):
        differ = text[found[open_ + 1] + k] != text[found[open_] + k]
        new[open_[differ]] = True
        open_ = open_[~differ & (length[open_] > k + 1)]
        k += 1
    rank = np.zeros(len(valleys) + 1, np.int64)  # the place behind the last is smaller than all
    rank[at] = np.cumsum(np.append(True, new))
    step, many = 1, np.arange(len(valleys))
    while step * 2 <= 2 * depth and len(many):
        top = int(rank.max()) + 1
        key = rank[many] * top + rank[np.minimum(many + step, len(valleys))]
        order = np.argsort(key, kind="stable")
        sorted_, groups = key[order], rank[many][order]
        fresh_group = np.append(True, groups[1:] != groups[:-1])
        fresh_key = np.append(True, sorted_[1:] != sorted_[:-1])
        # Ranks count all valleys up to the group's first: a group's parts move up within the group.
        place = np.arange(len(many))
        group_start = np.maximum.accumulate(np.where(fresh_group, place, 0))
        key_start = np.maximum.accumulate(np.where(fresh_key, place, 0))
        if step == 1 and len(many) == len(valleys):
            rank[many[order]] = key_start + 1
        else:
            rank[many[order]] = groups + key_start - group_start
        alone = fresh_key & np.append(fresh_key[1:], True)
        many = np.sort(many[order][~alone])
        step *= 2
    return valleys[np.argsort(rank[:-1], kind="stable")]


def suffix_order(text: np.ndarray, depth: int, scratch: Scratch) -> list[np.ndarray]:
    """All positions of ``text`` (small whole numbers, the last one 0 and the only 0) in the order of their first ``depth`` characters at least."""
    alphabet = int(text.max()) + 1
    falling = scratch.keep(slopes(text))
    valleys = np.flatnonzero(falling[:-1] & ~falling[1:]) + 1
    return induce(text, falling, order_of_valleys(text, falling, valleys, alphabet, depth, scratch), alphabet, scratch)


def repeated_starts(bodies: list[bytes], length: int) -> list[np.ndarray]:
    """For each body, the starts of ``length`` bytes that are also found at another place of any body."""
    sizes = np.fromiter(map(len, bodies), np.int64, len(bodies))
    if not len(bodies):
        return []
    scratch = Scratch(int(sizes.sum()) * 8)
    try:
        raw = np.frombuffer(b"\0".join(bodies) + b"\0" * (length + 9), np.uint8)
        starts = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]])
        text = raw[:int(starts[-1] + sizes[-1]) + 2]
        # Only the bytes that occur are letters: their number decides over the number of queues and the width of a letter.
        used = np.flatnonzero(np.bincount(text, minlength=256))
        letter = np.zeros(256, np.uint8 if len(used) + FIRST_BYTE <= 256 else np.uint16)
        letter[used] = FIRST_BYTE + np.arange(len(used))
        text = letter[text]
        text[starts[1:] - 1] = SEPARATOR
        text[-2], text[-1] = SEPARATOR, 0
        text = scratch.keep(text)
        fits = np.ones(len(text), bool)  # where ``length`` bytes of one body begin
        for_ends = np.repeat(starts + sizes, sizes + 1)
        fits[:len(for_ends)] = np.arange(len(for_ends)) + length <= for_ends
        fits[len(for_ends):] = False
        repeated = np.zeros(len(text), bool)
        word = np.ndarray((len(raw) - 7,), "<u8", raw, strides=(1,))
        offsets = [length - 8, *range(0, max(length - 8, 0), 8)] if length >= 8 else []
        last = np.zeros(0, np.int64)
        for part in suffix_order(text, length, scratch):
            part = np.concatenate([last, part[fits[part]]])
            a, b = part[:-1], part[1:]
            # Common prefix of neighbours in the order, followed up to ``length``.
            for k in offsets:
                same = word[a + k] == word[b + k]
                a, b = a[same], b[same]
            for k in range(length if length < 8 else 0):
                same = raw[a + k] == raw[b + k]
                a, b = a[same], b[same]
            repeated[a] = repeated[b] = True
            last = part[-1:]
        return [np.flatnonzero(repeated[s:s + n]) for s, n in zip(starts, sizes)]
    finally:
        scratch.close()
