"""Byte-level BPE from a published rank file.

A text is cut into pieces by the tokenizer's own pattern; each distinct piece
is merged once per worker and remembered. Short pieces use a contiguous array
of part boundaries with the rank of each adjacent pair: scan for the minimum,
delete that boundary, refresh the two neighbouring ranks. Pieces beyond
SHORT bytes (runs without blanks can be as long as a document) use the same
merges through a heap over a linked list, which is n log n.
"""

from __future__ import annotations

import base64
import heapq
import re
from functools import lru_cache

import regex

SHORT = 96
NO_RANK = 1 << 60
#: Distinct pieces remembered per worker; the cache is emptied beyond it.
CACHE_PIECES = 400_000


def vocabulary_path(name: str = "byte_bpe_50k.tiktoken", folder: str | None = None) -> str:
    """Where a public rank file lies; `folder` overrides the installed package."""
    if folder:
        return f"{folder}/{name}"
    import public_tokenizers

    return public_tokenizers.path(name)


class Bpe:
    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.wide = regex.compile(pattern).findall
        # On texts of ASCII only, the same pattern over ASCII classes; the standard module is faster there.
        self.narrow = re.compile(pattern.replace(r"\p{L}", "[A-Za-z]").replace(r"\p{N}", "[0-9]").replace("[^\\s[A-Za-z][0-9]]", r"[^\sA-Za-z0-9]"), re.ASCII).findall if "(?i" not in pattern else self.wide
        self.cache: dict[str, list[int]] = {}

    def split(self, text: str) -> list[str]:
        return self.narrow(text) if text.isascii() else self.wide(text)

    def merge(self, piece: bytes) -> list[int]:
        ranks = self.ranks
        if piece in ranks:
            return [ranks[piece]]
        return self._merge_short(piece) if len(piece) <= SHORT else self._merge_long(piece)

    def _merge_short(self, piece: bytes) -> list[int]:
        get = self.ranks.get
        bounds = list(range(len(piece) + 1))
        adjacent = [get(piece[i : i + 2], NO_RANK) for i in range(len(piece) - 1)]
        while adjacent:
            low = min(adjacent)
            if low == NO_RANK:
                break
            i = adjacent.index(low)
            del bounds[i + 1]
            del adjacent[i]
            if i < len(adjacent):
                adjacent[i] = get(piece[bounds[i] : bounds[i + 2]], NO_RANK)
            if i:
                adjacent[i - 1] = get(piece[bounds[i - 1] : bounds[i + 1]], NO_RANK)
        ranks = self.ranks
        return [ranks[piece[a:b]] for a, b in zip(bounds, bounds[1:])]

    def _merge_long(self, piece: bytes) -> list[int]:
        n, get = len(piece), self.ranks.get
        end = list(range(1, n + 1))  # of the part that starts here
        prev = list(range(-1, n - 1))
        alive = [True] * n
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := get(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, stop = heapq.heappop(heap)
            j = end[i]
            if not alive[i] or j >= n or end[j] != stop:
                continue
            alive[j] = False
            end[i] = stop
            if stop < n:
                prev[stop] = i
                if (r := get(piece[i : end[stop]])) is not None:
                    heapq.heappush(heap, (r, i, end[stop]))
            if (p := prev[i]) >= 0 and (r := get(piece[p:stop])) is not None:
                heapq.heappush(heap, (r, p, stop))
        ranks, out, i = self.ranks, [], 0
        while i < n:
            out.append(ranks[piece[i : end[i]]])
            i = end[i]
        return out

    def piece(self, piece: str) -> list[int]:
        got = self.cache.get(piece)
        if got is None:
            got = self.merge(piece.encode("utf-8", "surrogatepass"))
            if len(self.cache) >= CACHE_PIECES:
                self.cache.clear()
            self.cache[piece] = got
        return got

    def length(self, piece: str) -> int:
        return len(self.cache.get(piece) or self.piece(piece))

    def encode(self, text: str | None) -> list[int]:
        """Ids of a whole text; special-token strings are ordinary text; empty for null and empty."""
        if not text:
            return []
        out: list[int] = []
        cache, extend, slow = self.cache, out.extend, self.piece
        for p in self.split(text):
            extend(cache.get(p) or slow(p))
        return out

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        cache, slow = self.cache, self.piece
        return sum([len(cache.get(p) or slow(p)) for p in self.split(text)])


@lru_cache(maxsize=4)
def _tokenizer(path: str, pattern: str) -> Bpe:
    return Bpe(path, pattern)


def tokenizer(path: str | None = None, pattern: str | None = None) -> Bpe:
    """One tokenizer per worker process and vocabulary file."""
    if pattern is None:
        import public_tokenizers

        pattern = public_tokenizers.PATTERN
    return _tokenizer(path or vocabulary_path(), pattern)
