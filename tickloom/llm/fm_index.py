"""An FM-index of word sequences in one shard: a wavelet matrix over the
Burrows-Wheeler transform, with packed bits and a count per 64 of them.

Searches run on many patterns at once: each step takes one more word to the left of
every pattern and narrows its interval of the sorted suffixes."""

from __future__ import annotations

import numpy as np

SEPARATOR = 1


def suffix_order(symbols: np.ndarray, reach: int) -> np.ndarray:
    """Suffixes in the order of their first `reach` symbols or more, by doubling."""
    rank, width = np.unique(symbols, return_inverse=True)[1].astype(np.int64), 1
    while True:
        after = np.zeros(len(rank), np.int64)
        after[:-width] = rank[width:] + 1 if width < len(rank) else 0
        key = rank * (len(rank) + 1) + after
        order = np.argsort(key, kind="stable")
        step = np.concatenate(([0], (key[order][1:] != key[order][:-1]).astype(np.int64)))
        rank[order] = np.cumsum(step)
        width *= 2
        if width >= reach or rank[order[-1]] == len(rank) - 1 or width >= len(rank):
            return order


class Bits:
    """A bit sequence that counts its set bits before a position."""

    def __init__(self, bits: np.ndarray):
        padded = np.zeros((len(bits) // 64 + 1) * 64, np.uint8)
        padded[:len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        counts = np.bitwise_count(self.words).astype(np.int64)
        self.before = np.cumsum(counts) - counts

    def ones(self, at: np.ndarray) -> np.ndarray:
        word = at >> 6
        low = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & low)


class FMIndex:
    """symbols: the sequences one after another, each followed by SEPARATOR; words are
    numbered from SEPARATOR + 1 on.  Answers patterns of at most `reach` words."""

    def __init__(self, symbols: np.ndarray, reach: int):
        text = np.concatenate((symbols, np.zeros(1, symbols.dtype))).astype(np.int64)
        order = suffix_order(text, reach)
        self.first = np.concatenate(([0], np.cumsum(np.bincount(text))))
        self.levels: list[tuple[int, Bits, int]] = []
        row = text[order - 1]
        for bit in reversed(range(int(text.max()).bit_length())):
            bits = ((row >> bit) & 1).astype(np.uint8)
            self.levels.append((bit, Bits(bits), int(len(bits) - bits.sum())))
            row = np.concatenate((row[bits == 0], row[bits == 1]))
        #: Where the rows of each symbol begin in the last level.
        self.begins = self._descend(np.arange(len(self.first) - 1), np.zeros(len(self.first) - 1, np.int64))

    def _descend(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for bit, bits, zeros in self.levels:
            ones = bits.ones(at)
            at = np.where((symbol >> bit) & 1, zeros + ones, at - ones)
        return at

    def start(self, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return self.first[symbol], self.first[symbol + 1]

    def extend(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The intervals of symbol + pattern, given those of the patterns."""
        n = len(symbol)
        down = self._descend(np.concatenate((symbol, symbol)), np.concatenate((low, high)))
        base = self.first[symbol] - self.begins[symbol]
        return base + down[:n], base + down[n:]


def repeated_windows(index: FMIndex, symbols: np.ndarray, starts: np.ndarray, ends: np.ndarray, window: int) -> np.ndarray:
    """(start) positions in symbols of the windows, in the given stretches, whose words
    occur at least twice in the index.

    Matching statistics by the right end: from the last end of a stretch leftwards, the
    longest match to the left of each; an end that the match of a later one covers far
    enough needs no search of its own."""
    known = np.zeros(len(starts), np.int64)
    found = []
    for back in range(int((ends - starts).max(initial=window - 1)) - window + 1):
        end = ends - back
        live = end - starts >= window
        known = np.maximum(known - 1, 0)
        todo = np.flatnonzero(live & (known < window))
        at = end[todo] - 1
        low, high = index.start(symbols[at]) if len(todo) else (at, at)
        good = high - low >= 2
        known[todo] = 0
        while True:
            todo, at, low, high = todo[good], at[good], low[good], high[good]
            known[todo] = end[todo] - at
            more = at > starts[todo]
            todo, at, low, high = todo[more], at[more] - 1, low[more], high[more]
            if not len(todo):
                break
            low, high = index.extend(symbols[at], low, high)
            good = high - low >= 2
        hit = live & (known >= window)
        found.append(end[hit] - window)
    return np.concatenate(found) if found else np.zeros(0, np.int64)
