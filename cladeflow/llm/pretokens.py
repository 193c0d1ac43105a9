"""Vectorised pre-tokenisation and pre-token caches for byte-level BPE.

``split`` finds the matches of the usual byte-level pattern (contractions, an optional space and a run of
letters, of digits or of other characters, white space) for all texts of a chunk with a fixed number of
numpy passes over their code points. ``PreTokenCache`` maps the 64-bit hashes of pre-tokens to token ids
through a direct-mapped table, so an encoder written in Python sees only the few pre-tokens that miss.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Sequence

import numpy as np

from cladeflow.llm.textops import Hasher, codepoints, mix

OTHER, LETTER, NUMBER, SPACE = 0, 1, 2, 3
# The code points with the Unicode property White_Space.
WHITE_SPACE = [*range(0x9, 0xE), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
# The contractions of the pattern.
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")
_classes: np.ndarray | None = None


def classes() -> np.ndarray:
    """Class of every code point, from the Unicode general categories."""
    global _classes
    if _classes is None:
        table = np.zeros(0x110000, np.uint8)
        kinds = {"L": LETTER, "N": NUMBER}
        for code in range(0x110000):
            kind = kinds.get(unicodedata.category(chr(code))[0])
            if kind:
                table[code] = kind
        table[WHITE_SPACE] = SPACE
        _classes = table
    return _classes


def split(codes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Start of every match of the pattern in the texts whose code points stand end to end."""
    n = len(codes)
    if not n:
        return np.zeros(0, np.int64)
    kind = classes()[codes]
    fresh = np.zeros(n + 1, bool)
    fresh[offsets] = True
    last = fresh[1:]  # of its text
    fresh = fresh[:-1]
    blank = kind == SPACE
    change = np.ones(n, bool)
    change[1:] = kind[1:] != kind[:-1]
    change |= fresh
    after_space = np.zeros(n, bool)
    after_space[1:] = codes[:-1] == 32
    after_space &= ~fresh
    before_word = np.zeros(n, bool)
    before_word[:-1] = ~blank[1:]
    before_word &= ~last
    starts = change & (blank | ~after_space)
    starts |= blank & before_word  # the last of a white-space run goes with the next word or stands alone
    quotes = np.flatnonzero((codes == 39) & starts)
    quotes = quotes[~last[quotes]]
    if len(quotes):
        quotes = quotes[change[quotes + 1] & (kind[quotes + 1] == LETTER)]
    if len(quotes):
        one = codes[quotes + 1]
        two = np.where(last[quotes + 1], 0, codes[np.minimum(quotes + 2, n - 1)])
        length = np.zeros(len(quotes), np.int64)
        for c in CONTRACTIONS:
            hit = one == ord(c[0])
            if len(c) == 2:
                hit &= two == ord(c[1])
            length[hit & (length == 0)] = len(c)
        quotes, length = quotes[length > 0], length[length > 0]
        starts[quotes + 1] = False
        rest = quotes + 1 + length
        rest = rest[rest < n]
        starts[rest[~fresh[rest] & (kind[rest] == LETTER)]] = True
    return np.flatnonzero(starts)


class Pieces:
    """Pre-tokens of some texts: start, end (code points in ``codes``), hash, and row offsets into them."""

    def __init__(self, texts: Sequence[str]):
        self.codes, offsets = codepoints(list(texts))
        self.joined = "".join(texts)
        self.starts = split(self.codes, offsets)
        self.ends = np.append(self.starts[1:], len(self.codes))
        self.first = np.searchsorted(self.starts, offsets)
        hasher = Hasher(mix(self.codes.astype(np.uint64) + np.uint64(1)))
        self.hashes = hasher.ranges(self.starts, self.ends)

    def text(self, i: int) -> str:
        return self.joined[self.starts[i] : self.ends[i]]


class PreTokenCache:
    """Token ids by pre-token hash. encode: from a list of distinct pre-tokens to their lists of ids.

    The table has ``2**bits`` places and each key one place, so it needs no search; a key that finds its
    place taken replaces what is there. Ids stand in a pool that is emptied, with the table, when full.
    """

    def __init__(self, encode: Callable[[list[str]], list[list[int]]], bits: int = 19, pool: int = 1 << 22):
        self.encode, self.mask, self.limit = encode, np.uint64((1 << bits) - 1), pool
        self.clear()

    def clear(self) -> None:
        size = int(self.mask) + 1
        self.keys = np.zeros(size, np.uint64)
        self.start = np.zeros(size, np.int64)
        self.length = np.full(size, -1, np.int32)
        self.pool = np.zeros(1 << 16, np.int32)
        self.used = 0

    def lookup(self, pieces: Pieces) -> tuple[np.ndarray, np.ndarray]:
        """Start in the pool and number of ids of every pre-token."""
        if self.used > self.limit:
            self.clear()
        hashes = pieces.hashes
        place = (hashes & self.mask).astype(np.int64)
        start, length = self.start[place], self.length[place]
        missing = np.flatnonzero((self.keys[place] != hashes) | (length < 0))
        if len(missing):
            order = missing[np.argsort(hashes[missing])]
            new = np.ones(len(order), bool)
            new[1:] = hashes[order][1:] != hashes[order][:-1]
            which = order[new]
            ids = self.encode([pieces.text(i) for i in which.tolist()])
            counts = np.fromiter(map(len, ids), np.int64, len(ids))
            at = self.used + np.cumsum(counts) - counts
            total = int(counts.sum())
            while self.used + total > len(self.pool):
                self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
            self.pool[self.used : self.used + total] = np.fromiter((t for x in ids for t in x), np.int32, total)
            self.used += total
            group = np.cumsum(new) - 1
            start[order], length[order] = at[group], counts[group]
            self.keys[place[which]], self.start[place[which]], self.length[place[which]] = hashes[which], at, counts
        return start, length

    def ids(self, pieces: Pieces) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, and the offsets of the texts into them."""
        start, length = self.lookup(pieces)
        total = np.zeros(len(length) + 1, np.int64)
        np.cumsum(length, out=total[1:])
        place = np.repeat(start - total[:-1], length)
        place += np.arange(total[-1])
        return self.pool[place], total[pieces.first]
