"""A learned index from code points to bytes of UTF-8 text.

The boundaries of the code points of a text are an increasing list of byte offsets.
Line segments go through that list so that each offset is at most `error` away from
its segment; what is left is stored as one signed byte per code point.  An offset is
looked up by finding its segment among the few there are, taking the line's value and
adding the stored residual, which is exact."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: Largest distance of an offset from its line; with rounding it fits a signed byte.
ERROR = 120
#: Bytes whose offsets are held at a time while fitting.
BLOCK = 1 << 20
FIRST_STEP = 1024


def _segment_end(x: np.ndarray, y: np.ndarray, error: int) -> tuple[int, float]:
    """How many points from the first on one line through the first can serve, and its
    slope: the cone of slopes that keep every point within `error` narrows until empty."""
    low, high, end, step = -np.inf, np.inf, 1, FIRST_STEP
    while end < len(x):
        stop = min(end + step, len(x))
        dx, dy = (x[end:stop] - x[0]).astype(float), (y[end:stop] - y[0]).astype(float)
        lows = np.maximum.accumulate(np.maximum((dy - error) / dx, low))
        highs = np.minimum.accumulate(np.minimum((dy + error) / dx, high))
        over = lows > highs
        if over.any():
            k = int(over.argmax())
            if k:
                low, high = lows[k - 1], highs[k - 1]
            return end + k, _middle(low, high)
        low, high, end, step = lows[-1], highs[-1], stop, step * 2
    return end, _middle(low, high)


def _middle(low: float, high: float) -> float:
    return 1.0 if not np.isfinite(low) else (low + high) / 2


def _on_line(start: np.ndarray, base: np.ndarray, slope: np.ndarray, at: np.ndarray) -> np.ndarray:
    return base + np.floor(slope * (at - start) + 0.5).astype(np.int64)


@dataclass
class RankIndex:
    """`start`, `base`, `slope`: first rank, its offset and slope of each segment;
    `residual`: a byte per rank; `ranks`: how many code points there are."""

    start: np.ndarray
    base: np.ndarray
    slope: np.ndarray
    residual: np.ndarray
    ranks: int

    @classmethod
    def fit(cls, data: np.ndarray, error: int = ERROR, block: int = BLOCK) -> RankIndex:
        """The index of all code point boundaries of UTF-8 bytes, the end included."""
        starts, bases, slopes, residuals, rank = [], [], [], [], 0
        for at in range(0, len(data) + 1, block):
            y = at + np.flatnonzero((data[at:at + block] & 0xC0) != 0x80)
            if at + block > len(data):
                y = np.append(y, len(data))
            x = rank + np.arange(len(y))
            rank += len(y)
            i = 0
            while i < len(y):
                n, slope = _segment_end(x[i:], y[i:], error)
                starts.append(x[i])
                bases.append(y[i])
                slopes.append(slope)
                residuals.append((y[i:i + n] - _on_line(x[i], y[i], np.float64(slope), x[i:i + n])).astype(np.int8))
                i += n
        return cls(np.array(starts, np.int64), np.array(bases, np.int64), np.array(slopes, float),
                   np.concatenate(residuals), rank - 1)

    def offsets(self, ranks: np.ndarray) -> np.ndarray:
        """Byte offsets of the boundaries with these ranks (0 to `ranks`)."""
        ranks = np.asarray(ranks, np.int64)
        k = np.searchsorted(self.start, ranks, side="right") - 1
        return _on_line(self.start[k], self.base[k], self.slope[k], ranks) + self.residual[ranks]

    def rank_of(self, offsets: np.ndarray) -> np.ndarray:
        """Ranks of boundaries given as byte offsets: a binary search in which every
        probe is a predicted offset."""
        offsets = np.asarray(offsets, np.int64)
        low, high = np.zeros(len(offsets), np.int64), np.full(len(offsets), self.ranks, np.int64)
        while (low < high).any():
            middle = (low + high) // 2
            less = self.offsets(middle) < offsets
            low, high = np.where(less, np.minimum(middle + 1, high), low), np.where(less, high, middle)
        return low
