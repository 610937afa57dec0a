"""Vectorised text helpers used inside Arrow tasks: batches, words, 64-bit hashes, shingles.

A *word* is a maximal run of ``[0-9a-z]`` and non-ASCII characters after lower-casing ``A-Z``.
All functions work on the UTF-8 bytes of many texts at once, in pieces of about a megabyte, so the
memory of a task does not depend on the Arrow batch size.
"""

from __future__ import annotations

import numpy as np

PIECE = 1 << 20
_P = 0x9E3779B97F4A7C15
_P_INV = pow(_P, -1, 1 << 64)


def _word_table() -> np.ndarray:
    t = np.zeros(256, np.uint8)
    t[48:58] = np.arange(48, 58)
    t[97:123] = np.arange(97, 123)
    t[65:91] = np.arange(97, 123)
    t[128:] = np.arange(128, 256)
    return t


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: spreads every input bit over the whole word."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def pieces(texts: list, limit: int = PIECE):
    """Yield (first index, list of UTF-8 bytes) with about ``limit`` bytes each; null is empty.  Texts may be an Arrow column."""
    first, held, size = 0, [], 0
    for i, t in enumerate(texts):
        b = ((t.as_py() if hasattr(t, "as_py") else t) or "").encode("utf-8", "replace")
        if held and size + len(b) > limit:
            yield first, held
            first, held, size = i, [], 0
        held.append(b)
        size += len(b)
    if held:
        yield first, held


class Hasher:
    """Word positions and hashes of a list of UTF-8 texts."""

    def __init__(self):
        self.table = _word_table()
        self.powers = self._powers(_P)
        self.inverse = self._powers(_P_INV)

    @staticmethod
    def _powers(base: int) -> np.ndarray:
        p = np.full(PIECE, base, np.uint64)
        p[0] = 1
        return np.multiply.accumulate(p)

    def words(self, texts: list) -> tuple[np.ndarray, np.ndarray]:
        """(hash of every word in order, first word of each text with the total at the end)."""
        size = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
        bounds = np.concatenate([[0], np.cumsum(size)])
        raw = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
        starts, hashes, lo = [], [], 0
        while lo < len(raw):
            hi = self._cut(raw, lo)
            s, h = self._hash(raw[lo:hi])
            starts.append(s + lo)
            hashes.append(h)
            lo = hi
        if not starts:
            return np.zeros(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
        start, h = np.concatenate(starts), np.concatenate(hashes)
        return h, np.searchsorted(start, bounds)

    def _cut(self, raw: np.ndarray, lo: int) -> int:
        """End of the piece that begins at ``lo``: never inside a word, if the word fits a piece."""
        hi = lo + PIECE
        if hi >= len(raw):
            return len(raw)
        gap = np.flatnonzero(self.table[raw[lo:hi]] == 0)
        return lo + int(gap[-1]) + 1 if len(gap) else hi

    def _hash(self, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        m = self.table[raw]
        inside = np.zeros(len(m) + 2, bool)
        inside[1:-1] = m != 0
        edge = np.flatnonzero(inside[1:] != inside[:-1])
        start, end = edge[::2], edge[1::2]
        total = np.zeros(len(m) + 1, np.uint64)
        np.cumsum(m.astype(np.uint64) * self.powers[:len(m)], out=total[1:])
        h = (total[end] - total[start]) * self.inverse[start]
        return start, mix(h ^ ((end - start).astype(np.uint64) << np.uint64(56)))


class WholeHasher(Hasher):
    """A Hasher that never cuts a word, however long it is."""

    def _cut(self, raw: np.ndarray, lo: int) -> int:
        hi = super()._cut(raw, lo)
        while hi < len(raw) and self.table[raw[hi - 1]] and self.table[raw[hi]]:
            gap = np.flatnonzero(self.table[raw[hi:hi + PIECE]] == 0)
            hi = hi + int(gap[0]) if len(gap) else min(len(raw), hi + PIECE)
        if hi - lo > len(self.powers):
            for name, base in (("powers", _P), ("inverse", _P_INV)):
                p = np.full(hi - lo, base, np.uint64)
                p[0] = 1
                setattr(self, name, np.multiply.accumulate(p))
        return hi


def word_hash(hasher: Hasher, word: str) -> int:
    h, _ = hasher.words([word.encode()])
    return int(h[0])


def shingles(h: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(shingle hash, index of its text): ``k`` words each; a shorter text is one shingle of all its words."""
    n = np.diff(first)
    count = np.where(n >= k, n - k + 1, (n > 0).astype(np.int64))
    doc = np.repeat(np.arange(len(n)), count)
    at = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count) + first[:-1][doc]
    room = first[1:][doc] - at
    out = np.zeros(len(at), np.uint64)
    pad = np.concatenate([h, np.zeros(k, np.uint64)])
    for j in range(k):
        out = out * np.uint64(0xD6E8FEB86659FD93) + np.where(j < room, pad[at + j] | np.uint64(1), np.uint64(0))
    return mix(out), doc


def numbered(key: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each (text, key): the order that sorts equal pairs together, and the start of every run in it."""
    mixed = mix(key + mix(doc.astype(np.uint64) + np.uint64(1)))
    order = np.argsort(mixed, kind="stable")
    s = mixed[order]
    new = np.ones(len(s), bool)
    new[1:] = s[1:] != s[:-1]
    return order, np.flatnonzero(new)
