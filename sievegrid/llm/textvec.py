"""Vectorised hashing of words and n-grams over whole batches of texts.

A batch is one byte buffer. Word hashes come from prefix sums of a polynomial
over 64-bit integers (an odd base has an inverse, so any substring's hash is
two look-ups and a product); no Python runs per word.
"""

from __future__ import annotations

import numpy as np

BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
_powers = np.ones(1, np.uint64)
_inverses = np.ones(1, np.uint64)


def _grow(n: int) -> None:
    global _powers, _inverses
    if len(_powers) < n:
        n = max(n, 2 * len(_powers))
        with np.errstate(over="ignore"):
            _powers = np.concatenate([[np.uint64(1)], np.cumprod(np.full(n, BASE, np.uint64))])
            _inverses = np.concatenate([[np.uint64(1)], np.cumprod(np.full(n, INVERSE, np.uint64))])


def mix(h: np.ndarray) -> np.ndarray:
    """Finalizer that spreads every bit (the 64-bit variant of a public hash)."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
        h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def _class_table(extra: bytes, wide: bool) -> np.ndarray:
    t = np.zeros(256, bool)
    t[list(b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789" + extra)] = True
    if wide:
        t[128:] = True
    return t


ASCII_WORD = _class_table(b"_", False)
ANY_WORD = _class_table(b"_'", True)
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32


class Words:
    """hash: of each word in lower case; row: its text; start, end: bytes in buf; n: words of each text."""

    def __init__(self, texts: list[str | None], table: np.ndarray = ASCII_WORD, fold: bool = True):
        enc = [t.encode("utf-8", "surrogatepass") if t else b"" for t in texts]
        lens = np.fromiter((len(e) + 1 for e in enc), np.int64, len(enc))
        self.offsets = np.concatenate([[0], np.cumsum(lens)])
        raw = np.frombuffer(b"\n".join([*enc, b""]), np.uint8) if enc else np.zeros(0, np.uint8)
        self.raw = raw
        buf = FOLD[raw] if fold else raw
        inside = np.zeros(len(buf) + 2, bool)
        inside[1:-1] = table[buf]
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        self.start, self.end = edges[::2], edges[1::2]
        self.row = np.searchsorted(self.offsets, self.start, side="right") - 1
        self.n = np.bincount(self.row, minlength=len(texts))[: len(texts)]
        self.buf = buf
        _grow(len(buf) + 1)
        with np.errstate(over="ignore"):
            self.prefix = np.concatenate([[np.uint64(0)], np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * _powers[: len(buf)])])
        self.hash = mix(self.span(self.start, self.end))

    def span(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Raw hash of the bytes [a, b) of the folded buffer."""
        with np.errstate(over="ignore"):
            return (self.prefix[b] - self.prefix[a]) * _inverses[a]


def multiset_elements(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """(element hash, row), sorted by row and word: the k-th occurrence of a word is an element of its own."""
    order = np.lexsort((w.hash, w.row))
    h, row = w.hash[order], w.row[order]
    if not len(h):
        return h, row
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    first = np.flatnonzero(new)
    occ = np.arange(len(h)) - np.repeat(first, np.diff(np.append(first, len(h))))
    with np.errstate(over="ignore"):
        return mix(h + occ.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)), row
