"""An FM-index over sequences of word codes, in numpy.

Codes are 1 and above; 0 separates runs of words, and each separator counts as a
symbol of its own, so no match crosses one. Ranks come from a wavelet matrix
over the Burrows-Wheeler transform; every eighth text position, and the first of
each run, keeps its suffix position, so locating takes at most seven steps back.
"""

from __future__ import annotations

import numpy as np

U64 = np.uint64
SAMPLE = 8


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Suffix order by prefix doubling from four words on; separators sort first, by position."""
    n = len(text)
    bits = max(1, int(text.max()).bit_length())
    key, alive = np.zeros(n, dtype=U64), np.ones(n, dtype=bool)
    width = min(4, 64 // bits)
    for k in range(width):
        part = np.zeros(n, dtype=U64)
        part[: n - k] = text[k:]
        part[~alive] = 0
        key = (key << U64(bits)) | part
        alive[: n - k] &= text[k:] != 0
        alive[n - k :] = False
    order = np.argsort(key, kind="stable")
    ended = ~alive[order]  # a suffix with a separator among its first symbols differs from all others, in order of position
    span = width
    while True:
        ordered = key[order]
        changed = ordered[1:] != ordered[:-1]
        if span == width:
            changed |= ended[1:]
        rank_ordered = np.zeros(n, dtype=np.int64)
        np.cumsum(changed, out=rank_ordered[1:])
        rank = np.empty(n, dtype=np.int64)
        rank[order] = rank_ordered
        tied = np.zeros(n, dtype=bool)
        same = rank_ordered[1:] == rank_ordered[:-1]
        tied[1:] |= same
        tied[:-1] |= same
        if not same.any():
            return order
        at = np.flatnonzero(tied)  # from here on, only suffixes that are still alike are sorted again
        suffix = order[at]
        after = suffix + span
        second = np.where(after < n, rank[np.minimum(after, n - 1)] + 1, 0)
        again = np.lexsort((second, rank[suffix]))
        order[at] = suffix[again]
        key = rank.astype(U64) * U64(2 * n + 2)
        key[suffix] += second.astype(U64)
        span *= 2


class FMIndex:
    def __init__(self, text: np.ndarray, symbols: int):
        """text: codes, with a separator at its end. symbols: codes are below that."""
        self.n, self.levels = len(text), max(1, int(symbols).bit_length())
        order = suffix_array(text)
        bwt = text[order - 1].astype(np.int64)
        counts = np.bincount(text, minlength=symbols + 1)
        self.before = np.concatenate(([0], np.cumsum(counts)))[: symbols + 1]
        sampled_text = np.arange(self.n) % SAMPLE == 0
        sampled_text[1:] |= text[:-1] == 0
        sampled = sampled_text[order]
        self.positions = order[sampled]
        self.sampled_bits = _Bits(sampled)
        self.bits, self.zeros, seq = [], [], bwt
        for level in range(self.levels - 1, -1, -1):
            one = (seq >> level) & 1 == 1
            self.bits.append(_Bits(one))
            self.zeros.append(int(self.n - one.sum()))
            seq = np.concatenate((seq[~one], seq[one]))
        self.first = self._walk(np.arange(symbols + 1), np.zeros(symbols + 1, dtype=np.int64))

    def _walk(self, code: np.ndarray, at: np.ndarray) -> np.ndarray:
        for k, level in enumerate(range(self.levels - 1, -1, -1)):
            ones = self.bits[k].rank(at)
            at = np.where((code >> level) & 1 == 1, self.zeros[k] + ones, at - ones)
        return at

    def occurrences(self, code: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each code stands in the transform before each position."""
        return self._walk(code, at) - self.first[code]

    def search(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The range of suffixes that begin with each phrase; phrases are rows of codes, filled up behind."""
        low, high = np.zeros(len(phrases), dtype=np.int64), np.full(len(phrases), self.n, dtype=np.int64)
        for back in range(1, phrases.shape[1] + 1 if len(phrases) else 0):
            at = np.flatnonzero((lengths >= back) & (high > low))
            code = phrases[at, lengths[at] - back]
            low[at] = self.before[code] + self.occurrences(code, low[at])
            high[at] = self.before[code] + self.occurrences(code, high[at])
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """The text position of each suffix."""
        out, steps, at, open_ = np.empty(len(rows), dtype=np.int64), 0, rows.copy(), np.arange(len(rows))
        while len(open_):
            found = self.sampled_bits.get(at)
            out[open_[found]] = self.positions[self.sampled_bits.rank(at[found])] + steps
            open_, at = open_[~found], at[~found]
            code, pos = np.zeros(len(at), dtype=np.int64), at
            for k in range(self.levels):
                one, ones = self.bits[k].get(pos), self.bits[k].rank(pos)
                code = (code << 1) | one
                pos = np.where(one, self.zeros[k] + ones, pos - ones)
            at = self.before[code] + pos - self.first[code]
            steps += 1
        return out


class _Bits:
    """A bit vector with ranks: 64 bits a word and a running count."""

    def __init__(self, bits: np.ndarray):
        packed = np.packbits(bits, bitorder="little")
        self.words = np.zeros(len(bits) // 64 + 1, dtype=U64)
        self.words.view(np.uint8)[: len(packed)] = packed
        self.sums = np.concatenate(([0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)))

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Ones before each position."""
        word = at >> 6
        low = (U64(1) << (at & 63).astype(U64)) - U64(1)
        return self.sums[word] + np.bitwise_count(self.words[word] & low).astype(np.int64)

    def get(self, at: np.ndarray) -> np.ndarray:
        return (self.words[at >> 6] >> (at & 63).astype(U64)) & U64(1) == U64(1)
